"""Flow CSV records -> model features (operators B2-B9, B20, A10, G12 preprocessing).

All steps are projections and filters on one row at a time; the whole serve path is a
single stage without a shuffle. Many features at once are read batch by batch (``mapInArrow``):
a projection of that many texts is too long a method for the JVM to compile.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.stats import finite_or_zero, safe_double
from flowlens.schemas import FEATURE_NAME_MAP, FLOW_COLUMNS_80, FLOW_COLUMNS_82, MODEL_FEATURES_DEFAULT

UNMAPPED = ("src_ip", "dst_ip", "src_port", "protocol", "timestamp")
#: Fields that tell which flow a scored row is about (E4): its endpoints, protocol and time.
IDENTITY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "timestamp"]


# Transport fields removed from a shipped event before scoring.
TRANSPORT_FIELDS = ["@version", "@timestamp", "agent", "ecs", "event", "host", "input", "log", "message", "tags",
                    "decoded"]


def drop_transport_metadata(df: DataFrame, nested: str = "decoded.csv", target: str = "csv") -> DataFrame:
    """Move the nested CSV array to a top-level column and drop transport fields."""
    out = df.withColumn(target, F.col(nested)) if "." in nested and nested.split(".")[0] in df.columns else df
    return out.drop(*[c for c in TRANSPORT_FIELDS if c in out.columns])


def csv_prediction(scored: DataFrame) -> DataFrame:
    """The event's prediction as the service returns it (lower case), on the same row."""
    return scored.withColumn("prediction", F.lower(F.col("prediction")))


def split_by_width(df: DataFrame, csv: str = "csv", widths: tuple[int, ...] = (80, 82)) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by array width; rejects go to a second output."""
    ok = F.coalesce(F.size(F.col(csv)), F.lit(-1)).isin(*widths)      # a line that could not be decoded has no array
    return df.filter(ok), df.filter(~ok)


def drop_header_rows(df: DataFrame, csv: str = "csv") -> DataFrame:
    """Q10: drop the CSV header line (its first field is a column name)."""
    first = F.trim(F.col(csv)[0])
    return df.filter(~first.isin(FLOW_COLUMNS_82[0], FLOW_COLUMNS_80[0]) | first.isNull())


def csv_to_record(df: DataFrame, csv: str = "csv", keep: list[str] | None = None) -> DataFrame:
    """Positional array -> named string columns (82 layout; 80 layout lacks the IPs).

    One offset per row (2 for the 80-field layout); each field is then a bounds-safe
    lookup, so no per-row array is rebuilt. ``keep`` names columns of ``df``; record fields are kept anyway."""
    keep = [c for c in keep or [] if c in df.columns]
    off = F.when(F.size(F.col(csv)) == 80, F.lit(2)).otherwise(F.lit(0))
    return df.select(*keep, *[F.get(F.col(csv), F.lit(i) - off).alias(name)
                              for i, name in enumerate(FLOW_COLUMNS_82)])


def record_to_features(df: DataFrame, keep: list[str] | None = None, features: list[str] | None = None,
                       time_unit: float | None = None) -> DataFrame:
    """Rename to model feature names, text -> double (empty/text -> 0.0), missing
    features -> 0.0 in model order, +/-inf and NaN -> 0.0. ``time_unit`` optionally
    multiplies the duration (Q9: the meter emits seconds)."""
    keep = keep or []
    features = features or MODEL_FEATURES_DEFAULT
    inv = {v: k for k, v in FEATURE_NAME_MAP.items()}
    out = []
    for f in features:
        src = inv.get(f)
        if src is not None and src in df.columns and src not in UNMAPPED:
            x = F.col(src).try_cast("double")
            if time_unit and src == "flow_duration":
                x = x * F.lit(float(time_unit))
            out.append(finite_or_zero(x).alias(f))
        elif f in df.columns:
            out.append(finite_or_zero(safe_double(F.col(f).cast("string"))).alias(f))
        else:
            out.append(F.lit(0.0).alias(f))
    return df.select(*keep, *out)


def csv_events_to_features(df: DataFrame, csv: str = "csv", keep: list[str] | None = None,
                           features: list[str] | None = None, drop_header: bool = True) -> DataFrame:
    """G12 preprocessing: B3 -> (Q10) -> B5 -> B6 -> B7 -> B8 -> B9. ``keep`` names columns of ``df`` or fields of the
    record, such as those of ``IDENTITY``."""
    acc, _ = split_by_width(df, csv)
    if drop_header:
        acc = drop_header_rows(acc, csv)
    features = features or MODEL_FEATURES_DEFAULT
    at = _places(features, keep or [])
    if at is None or len(at) <= FEW_FEATURES:
        return record_to_features(csv_to_record(acc, csv, keep), keep, features)
    rows = csv_to_record(acc.withColumn("_csv", F.col(csv)), "_csv", [*(keep or []), "_csv"]).select(*(keep or []), "_csv")
    places = np.array([-1 if k is None else k for k in at])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            width = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.append(0, width.cumsum()[:-1]) - np.where(width == 80, 2, 0)
            x = np.zeros((len(places), b.num_rows))
            there = places >= 0
            value, _ = read_numbers(texts.flatten().take(pa.array((first + places[there, None]).ravel())))
            x[there] = value.reshape(-1, b.num_rows)
            yield _with_features(b.columns[:-1], b.schema.names[:-1], x, features)

    return rows.mapInArrow(read, _features_schema(rows, keep or [], features))


#: More features than these are read batch by batch.
FEW_FEATURES = 16


def _places(features: list[str], keep: list[str]) -> list[int | None] | None:
    """Each feature's place in the 82-field record (None: it has none, and is 0.0); None if one is a column of another kind."""
    inv = {v: k for k, v in FEATURE_NAME_MAP.items()}
    if any(f in keep or f in FLOW_COLUMNS_82 for f in features):
        return None
    return [FLOW_COLUMNS_82.index(inv[f]) if f in inv and inv[f] not in UNMAPPED else None for f in features]


def _features_schema(df: DataFrame, keep: list[str], features: list[str]) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in keep], *[T.StructField(f, T.DoubleType()) for f in features]])


def _with_features(columns: list, names: list[str], x: np.ndarray, features: list[str]) -> pa.RecordBatch:
    """The columns with the features (one a row of ``x``) behind them; what is not finite is 0.0."""
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(v) for v in np.where(np.isfinite(x), x, 0.0)]], names=[*names, *features])


_PLAIN = r"^-?[0-9]{1,17}(\.[0-9]{1,17})?([eE][+-]?[0-9]{1,2})?$"
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[fFdD]?")
_HEX = re.compile(r"[+-]?0[xX](?:[0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?[0-9]+[fFdD]?")
_BLANKS = "".join(map(chr, range(33)))


def _number(text: str) -> float | None:
    """A text as Spark's ``try_cast`` to double reads it; None if it is no number."""
    t = text.strip(_BLANKS)
    sign = -1.0 if t[:1] == "-" else 1.0
    if t.lower().removeprefix("+").removeprefix("-") in ("inf", "infinity") and t[:2] not in ("+-", "-+"):
        return sign * math.inf
    if t.lower() == "nan" or t in ("+NaN", "-NaN"):
        return math.nan
    if _DECIMAL.fullmatch(t):
        return float(t.rstrip("fFdD"))
    if _HEX.fullmatch(t):
        try:
            return float.fromhex(t.rstrip("fFdD"))
        except OverflowError:
            return sign * math.inf
    return None


def read_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether each is a number) of texts, as ``try_cast`` to double reads them. Each distinct text is read once; plain
    ones all together."""
    coded = texts.dictionary_encode()
    known = coded.dictionary
    plain = pc.match_substring_regex(known, _PLAIN)
    value = np.append(pc.if_else(plain, known, None).cast(pa.float64()).to_numpy(zero_copy_only=False), np.nan)
    ok = np.append(plain.to_numpy(zero_copy_only=False).astype(bool), False)
    for k in np.flatnonzero(~ok[:-1]):
        x = _number(known[k].as_py())
        if x is not None:
            value[k], ok[k] = x, True
    at = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)        # the last entry stands for null
    return value[at], ok[at]


def records_to_csv_array(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Inverse of B5 for sinks and tests: the record's fields as an array of strings."""
    columns = columns or FLOW_COLUMNS_82
    return df.select(F.array(*[F.col(c).cast("string") for c in columns]).alias("csv"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once for each row: what comes later reads it, where the optimizer would repeat a
    projection's expression in every filter and column that uses it."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def _entries(m: Column) -> Column:
    """The entries of a ``map<string,string>`` request, with stripped names."""
    return F.transform(F.map_entries(m), lambda e: F.struct(F.trim(e["key"]).alias("key"), e["value"].try_cast("double").alias("value")))


def _reason(entries: Column) -> Column:
    """Why a request can't be scored; null if it can."""
    names = F.transform(entries, lambda e: e["key"])
    return (F.when(entries.isNull(), "no object of names and numbers")
            .when(F.size(F.array_distinct(names)) < F.size(names), "a name stands there twice")
            .when(F.exists(entries, lambda e: e["value"].isNull()), "a value is no number"))


def split_requests(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """A10: requests (JSON text of an object, or a ``map<string,string>``) -> (accepted with ``col`` a ``map<string,double>`` of
    stripped names, rejected with a ``reason``). A number may be written as text; anything else that is no number is a reject, never a zero."""
    m = F.from_json(F.col(col), "map<string,string>") if dict(df.dtypes)[col] == "string" else F.col(col)
    read = _once(_once(_once(df, "_m", m), "_entries", _entries(F.col("_m"))), "reason", _reason(F.col("_entries")))
    # the map is built for accepted rows alone: names that are twins can't be in one
    numbers = F.when(F.col("reason").isNull(), F.map_from_entries("_entries"))
    return (_once(read.drop(col), col, numbers).filter("reason is null").select(*df.columns),
            read.filter("reason is not null").drop("_m", "_entries"))


def request_map_to_features(df: DataFrame, col: str, keep: list[str] | None = None,
                            features: list[str] | None = None) -> DataFrame:
    """A10 + B8/B9: a ``map<string,double>`` request (or JSON text of one, of which rejects are left out: see ``split_requests``)
    -> model features. Names are stripped; missing features are 0.0; extra keys are dropped."""
    keep = keep or []
    features = features or MODEL_FEATURES_DEFAULT
    kind = dict(df.dtypes)[col]
    if kind == "map<string,double>":
        # all names are looked up in one pass over the map, not one after the other
        record = T.StructType([T.StructField(f, T.DoubleType()) for f in features])
        df = _once(df, "_record", F.from_json(F.to_json(F.col(col)), record))
        return df.select(*keep, *[finite_or_zero(F.coalesce(F.col("_record").getField(f), F.lit(0.0))).alias(f) for f in features])
    rows = df.select(*keep, (F.from_json(F.col(col), "map<string,string>") if kind == "string" else F.col(col)).alias("_m"))
    column = {f: i for i, f in enumerate(features)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, x = _read_maps(b.column(b.num_columns - 1), column)
            yield _with_features([c.filter(pa.array(good)) for c in b.columns[:-1]], b.schema.names[:-1], x[:, good], features)

    return rows.mapInArrow(read, _features_schema(rows, keep, features))


def _read_maps(maps: pa.MapArray, column: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows without a ``_reason``, the numbers by name: one row for each of ``column``) of a batch of requests."""
    n, ends = len(maps), maps.offsets.to_numpy()
    row = np.repeat(np.arange(n), np.diff(ends))
    names = maps.keys[ends[0]:ends[-1]].dictionary_encode()
    stripped: dict[str, int] = {}
    code = np.array([stripped.setdefault(k.strip(" "), len(stripped)) for k in names.dictionary.to_pylist()] or [0], np.int64)[names.indices.to_numpy()]
    value, ok = read_numbers(maps.items[ends[0]:ends[-1]])
    cell = row * len(stripped) + code
    if n * len(stripped) <= 4 * len(cell) + 1_000_000:
        twice = np.flatnonzero(np.bincount(cell) > 1)
    else:                                                     # many names in few maps
        cells, times = np.unique(cell, return_counts=True)
        twice = cells[times > 1]
    good = maps.is_valid().to_numpy(zero_copy_only=False).copy()
    good[row[~ok]] = False
    good[twice // max(len(stripped), 1)] = False
    to = np.array([column.get(k, -1) for k in stripped] or [0])[code]
    x = np.zeros((len(column), n))
    x[to[to >= 0], row[to >= 0]] = value[to >= 0]
    return good, x


def explode_batch_request(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """A10: a JSON list of request objects -> (one row per object: ``flow_idx``, ``request``; rejected lists with a ``reason``).
    One object that can't be scored rejects its list, as a batch is answered as a whole."""
    items = _once(df, "_items", F.transform(F.from_json(F.col(col), "array<map<string,string>>"), _entries))
    reason = F.when(F.col("_items").isNull(), "no list of objects").otherwise(
        F.get(F.filter(F.transform("_items", _reason), lambda r: r.isNotNull()), F.lit(0)))
    read = _once(items, "reason", reason)
    rows = read.filter("reason is null").select(*[c for c in df.columns if c != col], F.posexplode("_items").alias("flow_idx", "request"))
    return rows.withColumn("request", F.map_from_entries("request")), read.filter("reason is not null").drop("_items")


def csv_text_to_array(text: Column) -> Column:
    """A CSV line -> array of trimmed fields."""
    return F.transform(F.split(text, ","), lambda s: F.trim(s))


def decode_csv_line(line: Column) -> Column:
    """A3: a CSV line as the transport decodes it: a quoted field may hold commas, and a doubled quote stands for one.
    Fields are not trimmed. Null where a quote is not closed."""
    field = r',((?:[^",]++|"[^"]*+")*+)'                     # up to the next comma outside quotes, in one pass over the line
    open_ = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    unquoted = F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(field), F.lit(1)), lambda s: F.when(
        s.startswith('"') & s.endswith('"') & (F.length(s) >= 2), F.replace(F.substring(s, F.lit(2), F.length(s) - 2), F.lit('""'), F.lit('"'))).otherwise(s))
    return F.when(F.contains(line, F.lit('"')), F.when(~open_, unquoted)).otherwise(F.split(line, ",", -1))


def decode_lines(df: DataFrame, line: str) -> DataFrame:
    """A3: lines with their fields as ``csv``, decoded once for all that reads them."""
    return _once(df, "csv", decode_csv_line(F.col(line)))
