"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is a sequence of tokens: runs of characters other than white space, cut after 16 characters. A k-mer is ``K``
tokens in a row, its s-mers are the runs of ``S`` tokens inside. A k-mer is an anchor (a closed syncmer) when its smallest
s-mer, by hash, is its first or its last. Whether a k-mer is an anchor depends on its own tokens only, so an edit changes no
anchor elsewhere, and equal passages have equal anchors wherever they stand.

Only 9 tokens in a row are sure to hold a closed syncmer. So texts of fewer than ``SHORT`` tokens have all runs of ``S`` tokens as anchors too, and
texts of fewer than ``TINY`` also each token. Texts on either side of a limit still share the anchors of the longer runs.

A fingerprint is the 32-bit hashes of the anchors in text order, as hexadecimal text. The likeness of two is the Dice
coefficient of their sets of anchors; ``matched_positions`` gives the anchors that two texts share with their positions.

Defined results: a null text counts as empty; every text with a token has an anchor;
the fingerprint of a text without tokens, and of no other, is empty, and two empty ones are alike (1), an empty and another one are not (0);
equal texts have equal fingerprints; an empty table gives an empty result. Next document: descending doc_id,
null ids last, ties by text hash, after the last the first; a single row is its own next. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.common import prepare, table

K, S, RANGES = 6, 2, 200
SHORT, TINY = 32, 8


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S{1,16}"), 0), lambda x: F.xxhash64(x))


def s_mers(tokens: Column) -> Column:
    """Hashes of all runs of two tokens."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.xxhash64(a, b))


def anchors_of(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: the anchors of ``text`` in order, as array<struct<pos int, hash int>>."""
    t, m = f"_{name}_tokens", f"_{name}_smers"
    df = df.withColumn(t, token_hashes(F.col(text))).withColumn(m, s_mers(F.col(t)))
    at = lambda i: F.get(F.col(m), i)
    inner = K - S                                          # s-mers i .. i + inner lie in the k-mer that begins at i

    def closed(i: Column) -> Column:
        edge = F.least(at(i), at(i + inner))
        rest = F.least(*(at(i + j) for j in range(1, inner)))
        made = F.xxhash64(*(at(i + j) for j in range(0, inner + 1, 2)))
        return F.when(edge <= rest, F.struct(i.alias("pos"), made.bitwiseAND(0xFFFFFFFF).alias("hash")))

    long_ = F.filter(F.transform(F.sequence(F.lit(0), F.size(t) - K), closed), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    each = lambda x: F.transform(x, lambda h, i: F.struct(i.alias("pos"), h.bitwiseAND(0xFFFFFFFF).alias("hash")))
    long_ = F.when(F.size(t) >= K, long_).otherwise(none)
    short = F.array_sort(F.concat(long_, each(F.col(m)), F.when(F.size(t) < TINY, each(F.col(t))).otherwise(none)))
    made = F.when(F.size(t) >= SHORT, long_).otherwise(short)
    return df.withColumn(name, made).drop(t, m)


def hashes(anchors: str) -> Column:
    return F.transform(anchors, lambda x: x["hash"])


def fingerprint(anchors: str) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x["hash"])), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Dice coefficient of two sets of anchors."""
    x, y = F.array_distinct(hashes(a)), F.array_distinct(hashes(b))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def matched_positions(a: str, b: str) -> Column:
    """The anchors of ``a`` that ``b`` has too: hash, position in a, first position in b."""
    there = F.map_from_entries(F.transform(F.array_distinct(hashes(b)), lambda h: F.struct(
        h, F.array_min(F.transform(F.filter(b, lambda y: y["hash"] == h), lambda y: y["pos"])))))
    both = F.transform(a, lambda x: F.struct(x["hash"].alias("hash"), x["pos"].alias("a"), F.get(F.transform(
        F.array(F.lit(0)), lambda _: F.element_at(there, x["hash"])), 0).alias("b")))
    return F.filter(both, lambda x: x["b"].isNotNull())


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the same with ``next_text``: the text of the next row in descending order of doc_id.

    Rows are dealt into ranges of doc_id, each a window task; a range also gets a copy of the next range's first row, so
    neighbours across ranges meet without one task seeing all rows."""
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = base.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / RANGES for i in range(1, RANGES)], 10_000).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))                               # at most RANGES - 1 numbers
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    bounds = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.array().cast("array<bigint>")
    place = F.size(F.filter(bounds, lambda c: c >= key))         # 0 holds the largest ids
    rows = base.select("doc_id", "text", place.alias("part"), F.lit(False).alias("copy"))
    # the first row of each range, in the order below; ranges are few
    order = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", F.xxhash64("text").alias("h"))
    first = rows.groupBy("part").agg(F.max_by("text", order).alias("text"))
    around = Window.orderBy("part")
    ranges = first.select("part", "text").where("part is not null")
    heads = ranges.select(F.coalesce(F.lag("part").over(around), F.max("part").over(Window.partitionBy())).alias("part"), "text")
    copies = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", "part", F.lit(True).alias("copy"))
    w = Window.partitionBy("part").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))
    out = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "part", "copy").unionAll(copies).withColumn("next_text", F.lead("text").over(w))
    return out.where("not copy").select("doc_id", "text", "next_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_document_fingerprints: fingerprints of every text and of its edited version, and their likeness."""
    prepare(spark)
    df = with_next(table(spark, sf_dir, "documents")).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    df = anchors_of(anchors_of(anchors_of(df, "text", "own"), "edited", "new"), "next_text", "next")
    return df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("own").alias("fingerprint"),
                     fingerprint("new").alias("edited_fingerprint"), likeness("own", "new").alias("near_edited"), likeness("own", "next").alias("near_next"))
