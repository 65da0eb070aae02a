"""Fill-in-middle, line dedup and the conversation trie against plain Python, with the odd cases."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from flowlens.llm import fim, lines, trie
from flowlens.llm.common import prepare

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_fim(key, text, unit="token"):
    text = text or ""
    parts = UNITS.findall(text) if unit == "token" else list(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
    pre, mid, suf = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(parts), "plain", None, None, None, None, text
    sizes = len(pre), len(mid), len(pre.encode()), len(mid.encode())
    if h[3] % 100 < 80:
        return len(parts), "spm", *sizes, f"<S>{suf}<P>{pre}<M>{mid}"
    return len(parts), "psm", *sizes, f"<P>{pre}<S>{suf}<M>{mid}"


def odd_texts():
    rng = random.Random(3)
    alphabet = "ab \n\t\x0b  é世😀<PSM>"
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    return rows + [(None, "no id, é"), (1, None), (1, ""), (2, "   "), (3, "holds <M> a mark"), (5, "x" * 300_000 + " é"), (6, "世 " * 50_000),
                   (7, "same"), (7, "same"), (8, "<P"), (9, "tail \u0085 ")]


@pytest.mark.parametrize(("unit", "block"), [("token", 8 << 20), ("token", 64), ("char", 1000)])
def test_fill_in_middle_matches_plain_python(spark, unit, block):
    prepare(spark)
    rows = odd_texts()
    df = spark.createDataFrame([(i, t, "kept", "clash") for i, t in rows], "doc_id long, text string, extra string, Form string").coalesce(2)
    out = fim.fill_in_middle(df, p=fim.FimParams(unit=unit, block_bytes=block))
    assert out.columns == ["doc_id", "text", "extra", *(f.name for f in fim.FIELDS)]
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    cols = [f.name for f in fim.FIELDS]
    order = lambda rows: sorted(rows, key=repr)
    assert order((r["doc_id"], r["text"], r["extra"], *(r[c] for c in cols)) for r in got) == order((i, t, "kept", *brute_fim(i, t, unit)) for i, t in rows)
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(df).count() == 0


def test_exception_index_converts_both_ways():
    import numpy as np
    text = "aé世😀b" * 7
    index = fim.Exceptions(np.frombuffer(text.encode(), np.uint8))
    chars = np.arange(len(text) + 1)
    bytes_ = np.array([len(text[:k].encode()) for k in chars])
    assert (index.to_bytes(chars) == bytes_).all() and (index.to_chars(bytes_) == chars).all()


def line_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))


def brute_lines(rows, least=20, docs=3):
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[line_key(line)].add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        own = -(2**63) if i is None else i
        split = (t or "").split("\n")
        kept = [x for x in split if not (len(k := line_key(x)) >= least and len(holders[k]) >= docs and own != max(holders[k]))]
        out.append((i, len(split), len(split) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rng = random.Random(5)
    common = [f"This line number {k} stands in many documents É世" for k in range(12)] + ["short", "", "exactly twenty chars", "é" * 19, "é" * 20]
    rows = []
    for i in range(120):
        some = [rng.choice(["", " ", "\t", " "]) + rng.choice([x, x.upper(), x.lower()]) + rng.choice(["", "\r", " "]) for x in rng.sample(common, rng.randint(0, 8))]
        rows.append((i, "\n".join([*some, f"a line of its own for document {i}", *some[:2]])))
    whole = "\n".join(common)
    return rows + [(None, whole), (None, "This line number 1 stands in many documents É世"), (3, None), (4, ""), (5, whole), (5, whole), (-7, whole),
                   (900, "\n" * 50), (901, whole + "\n" + "x" * 200_000), (2**62, common[3])]


@pytest.mark.parametrize("p", [lines.LineParams(), lines.LineParams(batches=5, fan=2, flush=20), lines.LineParams(batches=1, least=5, docs=2)])
def test_line_dedup_matches_plain_python(spark, p):
    prepare(spark)
    rows = line_rows()
    df = spark.createDataFrame([(i, t, "kept", 1, "x") for i, t in rows], "doc_id long, text string, extra string, n_lines int, part string").repartition(4)
    out = lines.dedup_lines(df, p=p)
    assert out.columns == ["doc_id", "text", "extra", "part", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted(brute_lines(rows, p.least, p.docs), key=repr)
    assert any(r[2] for r in got)


def test_line_dedup_of_an_empty_table(spark):
    prepare(spark)
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_take_batches_in_any_order_and_stay_few(spark):
    rng = random.Random(1)
    seen = collections.defaultdict(set)
    runs = lines.LineRuns(spark, docs=3, fan=3)
    for _ in range(5):
        rows = [(rng.randint(0, 40), 0, rng.randint(0, 100)) for _ in range(150)]
        for a, _, d in rows:
            seen[a].add(d)
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, doc long"))
        assert all(len(level) < 3 for level in runs.levels)
    got = collections.defaultdict(dict)
    for r in runs.compacted().collect():
        got[r["h1"]][r["rank"]] = r["doc"]
    assert got == {a: dict(enumerate(sorted(d, reverse=True)[:3], 1)) for a, d in seen.items()}
    names = runs.runs()
    runs.drop()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_a_settled_key_is_not_added_again(spark):
    runs = lines.LineRuns(spark, docs=3, fan=10)
    runs.add(spark.createDataFrame([(1, 1, 90), (1, 1, 80), (1, 1, 70), (2, 2, 90)], "h1 long, h2 long, doc long"))
    runs.add(spark.createDataFrame([(1, 1, 60), (2, 2, 60), (1, 1, 75)], "h1 long, h2 long, doc long"))
    assert sorted((r["h1"], r["doc"]) for r in spark.table(runs.runs()[1]).collect()) == [(1, 75), (2, 60)]
    runs.drop()


def brute_trie(rows, head=lambda c: zlib.crc32(str(c).encode()) % 6):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    full = {c: own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:head(c)] + v[head(c):] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    out = []
    for n, ms in members.items():
        below = [x for x in members if x[:len(n)] == n]
        out.append((min(ms), len(n), min(members[n[:-1]]) if n else None, len(ms), children[n], sum(not children[x] for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()))
    return out


def conversation_rows():
    rng = random.Random(9)
    rows = []
    for c in [*range(90, 260), -3, -100, -250, 5000]:
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "世界", "", None, "a long text " * 5])) for t in range(rng.randint(1, 9))]
    rows += [(700, None, "user", "first, by null"), (700, 1, "user", "x"), (700, 1, "user", "x"), (700, 0, "a", "y" * 100_000), (None, 0, "user", "nobody's")]
    rows += [(800, t, "user", "same") for t in range(45)] + [(c, t, "user", "same") for c in (801, 802) for t in range(30)] + [(901, 0, None, None)]
    return rows


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("height", [None, 2, 3, 100])
def test_trie_matches_plain_python(spark, height):
    prepare(spark)
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, depth int").repartition(5)
    turns, convs = trie.rebuild(trie.numbered(df), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, 5)
    got = [tuple(r[c] for c in COLS) for r in trie.trie(turns, convs, height).collect()]
    assert sorted(got, key=repr) == sorted(brute_trie(rows), key=repr)


def test_trie_of_an_empty_table(spark):
    prepare(spark)
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns, convs = trie.rebuild(trie.numbered(df), F.lit(2), 5)
    assert trie.trie(turns, convs).count() == 0


def test_digest_joins_blocks_in_order(spark):
    ids = list(range(-50, 950))
    df = spark.createDataFrame([(1, 1, i) for i in reversed(ids)] + [(2, 2, 7)], "k1 long, k2 long, conv_id long")
    got = {r["k1"]: r["ends_sha256"] for r in trie.digests(df, chunk=7).collect()}
    assert got == {1: sha(",".join(map(str, ids))), 2: sha("7")}
