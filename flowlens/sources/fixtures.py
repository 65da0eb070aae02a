"""Deterministic fixture views over the driver tables (see FIXTURES.md).

The driver tables hold no packets and no labelled flows, so the packet, labelled-flow and
flow-CSV inputs are views derived by Spark from ``events`` and ``lineitem``. Each view is
one SQL text with dialect tokens, so Spark and the DuckDB oracle read identical rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TOKENS = {
    "spark": {
        "{US}": "unix_micros(cast(ts as timestamp))",
        "{OPEN}": "{{", "{CLOSE}": "}}",
        "{DIV}": "div",
        "{STR}": "string",
        "{CONCAT}": "concat",
        "{ARR(": "array(",
        "{REST}": "transform(sequence(7, 82), i -> {E})",
        "{SLICE(3,82)}": "slice(f, 3, 80)",
        "{SLICE(1,81)}": "slice(f, 1, 81)",
    },
    "duckdb": {
        "{US}": "epoch_us(ts)",
        "{OPEN}": "{", "{CLOSE}": "}",
        "{DIV}": "//",
        "{STR}": "varchar",
        "{CONCAT}": "list_concat",
        "{ARR(": "[",
        "{REST}": "list_transform(range(7, 83), lambda i: {E})",
        "{SLICE(3,82)}": "f[3:82]",
        "{SLICE(1,81)}": "f[1:81]",
    },
}
_ARR_CLOSE = {"spark": ")", "duckdb": "]"}

PACKETS_SQL = """
WITH b AS (
 SELECT event_id AS pkt_seq, user_id, event_type,
  1704067200000000 + ({US} - 1704067200000000) {DIV} (CASE user_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 5000 WHEN 2 THEN 50000 ELSE 500000 END) AS ts_us,
  concat('10.1.', cast(user_id {DIV} 256 AS {STR}), '.', cast(user_id % 256 AS {STR})) AS client_ip,
  40000 + user_id % 1000 AS client_port,
  CASE user_id % 4 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 ELSE 53 END AS server_port,
  CASE WHEN user_id % 8 = 7 THEN 17 ELSE 6 END AS protocol,
  event_id % 3 = 0 AS from_server,
  CASE WHEN event_type = 'view' THEN 0 ELSE cast(floor(value) AS bigint) END AS payload_len,
  CASE WHEN event_id % 17 = 0 THEN 24 ELSE 20 END AS ip_hdr_len
 FROM {events})
SELECT pkt_seq, ts_us,
 CASE WHEN from_server THEN '10.0.0.1' ELSE client_ip END AS src_ip,
 CASE WHEN from_server THEN client_ip ELSE '10.0.0.1' END AS dst_ip,
 cast(CASE WHEN from_server THEN server_port ELSE client_port END AS bigint) AS src_port,
 cast(CASE WHEN from_server THEN client_port ELSE server_port END AS bigint) AS dst_port,
 protocol, ip_hdr_len, payload_len,
 cast(14 + ip_hdr_len + CASE WHEN protocol = 6 THEN 20 ELSE 8 END + payload_len AS bigint) AS frame_len,
 CASE WHEN protocol = 17 THEN '' WHEN pkt_seq % 25 = 0 THEN 'FA' WHEN pkt_seq % 41 = 0 THEN 'PAU'
      WHEN pkt_seq % 43 = 0 THEN 'AE' WHEN event_type = 'signup' THEN 'S' WHEN event_type = 'error' THEN 'RA'
      WHEN event_type = 'view' THEN 'A' ELSE 'PA' END AS tcp_flags,
 CASE WHEN protocol = 17 THEN 0 ELSE (pkt_seq * 37) % 65536 END AS tcp_window
FROM b
"""

#: The same packets as three taps would have written them: each names its capture, and every capture counts from 0.
CAPTURES_SQL = """
SELECT p.* EXCEPT (pkt_seq), pkt_seq {DIV} 3 AS pkt_seq, concat('tap', cast(pkt_seq % 3 AS {STR})) AS capture FROM ({PACKETS}) p
"""

LABELLED_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 cast(cast(l_shipdate AS date) AS {STR}) AS ship_day, l_suppkey % 8 AS file_no,
 CASE l_returnflag WHEN 'N' THEN ' BENIGN '
  WHEN 'A' THEN CASE l_linenumber % 3 WHEN 0 THEN 'DoS slowloris' WHEN 1 THEN 'DoS Slowhttptest' ELSE 'Bot' END
  ELSE CASE l_linenumber % 2 WHEN 0 THEN 'PortScan' ELSE 'DDoS' END END AS label,
 l_quantity AS f0,
 CASE WHEN l_orderkey % 97 = 0 THEN CAST('Infinity' AS double) WHEN l_orderkey % 89 = 0 THEN CAST('-Infinity' AS double)
  WHEN l_orderkey % 83 = 0 THEN CAST('NaN' AS double) WHEN l_orderkey % 79 = 0 THEN NULL ELSE l_extendedprice END AS f1,
 CASE WHEN l_returnflag = 'N' THEN l_discount ELSE l_discount * 10 + 1 END AS f2,
 l_extendedprice * 100000 AS f3, CAST(0 AS double) AS f4, l_quantity AS f5,
 md5(concat_ws('|', '42', cast(l_orderkey AS {STR}), cast(l_linenumber AS {STR}), cast(l_partkey AS {STR}),
  cast(l_suppkey AS {STR}), cast(cast(l_shipdate AS date) AS {STR}))) AS row_hash
FROM {lineitem}
"""

_CSV_E = ("CASE WHEN (l_orderkey + i) % 53 = 0 THEN '' WHEN (l_orderkey + i) % 59 = 0 THEN 'bad' "
          "ELSE cast(l_linenumber * i AS {STR}) END")

FLOW_CSV_SQL = """
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 {CONCAT}({ARR('10.1.0.1','10.0.0.1','40000',cast(l_suppkey AS {STR}),'6','2024-01-01 00:00:00'{ARR_END}, {REST}) AS f FROM {lineitem})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE l_linenumber % 5 WHEN 0 THEN {SLICE(3,82)} WHEN 1 THEN {SLICE(1,81)} ELSE f END AS csv FROM a
"""

#: Request bodies, sound and unsound; ``reason`` and the two numbers are what a reader should find in them.
REQUESTS_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE l_orderkey % 7 WHEN 0 THEN concat('{OPEN}"Flow Duration": ', cast(l_partkey AS {STR}), ', " Total Fwd Packets ": ', cast(l_suppkey AS {STR}), ', "Other": 1{CLOSE}')
  WHEN 1 THEN '{OPEN}"Flow Duration": 1' WHEN 2 THEN '{OPEN}"Flow Duration": "abc"{CLOSE}' WHEN 3 THEN '{OPEN}"Flow Duration": 1, " Flow Duration": 2{CLOSE}'
  WHEN 4 THEN concat('{OPEN}"Flow Duration": "', cast(l_partkey AS {STR}), '"{CLOSE}') WHEN 5 THEN NULL ELSE '{OPEN}"Flow Duration": null{CLOSE}' END AS request,
 CASE l_orderkey % 7 WHEN 0 THEN NULL WHEN 4 THEN NULL WHEN 3 THEN 'a name stands there twice' WHEN 2 THEN 'a value is no number'
  WHEN 6 THEN 'a value is no number' ELSE 'no object of names and numbers' END AS reason,
 cast(l_partkey AS double) AS duration, cast(CASE l_orderkey % 7 WHEN 0 THEN l_suppkey ELSE 0 END AS double) AS fwd
FROM {lineitem}
"""

# Feature columns of the labelled view and the two that feed the fixed scoring model.
LABELLED_FEATURES = ["f0", "f1", "f2", "f3", "f4", "f5"]


def render(sql: str, dialect: str) -> str:
    """Replace dialect tokens; table references stay as ``{name}`` placeholders."""
    out = sql.replace("{REST}", _TOKENS[dialect]["{REST}"]).replace("{E}", _CSV_E)
    out = out.replace("{ARR_END}", _ARR_CLOSE[dialect])
    for tok, rep in _TOKENS[dialect].items():
        out = out.replace(tok, rep)
    return out


def duckdb_view(name: str) -> str:
    """SQL text of a fixture view for DuckDB (base tables are pre-registered views)."""
    sql = {"packets": PACKETS_SQL, "labelled": LABELLED_SQL, "flow_csv": FLOW_CSV_SQL,
           "requests": REQUESTS_SQL,
           "captures": CAPTURES_SQL.replace("{PACKETS}", PACKETS_SQL).replace("EXCEPT", "EXCLUDE")}[name]
    return render(sql, "duckdb").replace("{events}", "events").replace("{lineitem}", "lineitem")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over the task slots when it has fewer splits than slots."""
    from flowlens.sources.io import read_parquet
    return read_parquet(spark, os.path.join(sf_dir, f"{name}.parquet"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets view (schema of ``flowlens.schemas.PACKETS``) derived from ``events``."""
    return spark.sql(render(PACKETS_SQL, "spark"), events=table(spark, sf_dir, "events"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets view with a ``capture`` column, numbered from 0 in each capture."""
    sql = render(CAPTURES_SQL.replace("{PACKETS}", PACKETS_SQL), "spark")
    return spark.sql(sql, events=table(spark, sf_dir, "events"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled-flows view derived from ``lineitem`` (dirty f1, padded labels)."""
    return spark.sql(render(LABELLED_SQL, "spark"), lineitem=table(spark, sf_dir, "lineitem"))


def flow_csv_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow-CSV events as ``FLOW_CSV_SQL`` says them."""
    return spark.sql(render(FLOW_CSV_SQL, "spark"), lineitem=table(spark, sf_dir, "lineitem"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies (JSON text) derived from ``lineitem``."""
    return spark.sql(render(REQUESTS_SQL, "spark"), lineitem=table(spark, sf_dir, "lineitem")).drop("reason", "duration", "fwd")


def flow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow-CSV events as lines of text: one field in some of them needs quotes, some lines are headers, some end in an open quote."""
    from pyspark.sql import functions as F
    from flowlens.schemas import FLOW_COLUMNS_82
    quoted = F.transform("csv", lambda x: F.when(x == "bad", '"b""a,d"').otherwise(x))
    line = F.when(F.col("l_orderkey") % 103 == 0, ",".join(FLOW_COLUMNS_82)).when(
        F.col("l_orderkey") % 101 == 0, F.concat(F.array_join(quoted, ","), F.lit('"'))).otherwise(F.array_join(quoted, ","))
    return flow_csv(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))


def _csv_arrays(b: pa.RecordBatch) -> pa.Array:
    """The ``csv`` column of ``FLOW_CSV_SQL`` for a batch of (l_orderkey, l_linenumber, ..., l_suppkey): every text that occurs
    is written once, and the arrays are taken from those."""
    order, line, supp = (b.column(b.schema.get_field_index(c)) for c in ("l_orderkey", "l_linenumber", "l_suppkey"))
    i = np.arange(7, 83)
    lines, supps = line.dictionary_encode(), supp.dictionary_encode()
    products = pa.array(np.multiply.outer(lines.dictionary.to_numpy(zero_copy_only=False).astype(np.int64), i).ravel()).cast(pa.string())
    fixed = pa.array(["10.1.0.1", "10.0.0.1", "40000", "6", "2024-01-01 00:00:00", "", "bad", None], pa.string())
    pool = pa.concat_arrays([fixed, supps.dictionary.cast(pa.string()), products])
    null = len(fixed) - 1
    s = pc.fill_null(supps.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n = pc.fill_null(lines.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.empty((b.num_rows, 82), np.int64)
    at[:, :6] = [0, 1, 2, null, 3, 4]
    at[:, 3] = np.where(s < 0, null, s + len(fixed))
    at[:, 6:] = np.where(n[:, None] < 0, null, len(fixed) + len(supps.dictionary) + n[:, None] * len(i) + (i - 7))
    known = order.is_valid().to_numpy(zero_copy_only=False)[:, None]
    key = pc.fill_null(order, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at[:, 6:][known & ((key[:, None] % 59 + i) % 59 == 0)] = 6
    at[:, 6:][known & ((key[:, None] % 53 + i) % 53 == 0)] = 5
    kind = np.where(n < 0, -1, pc.fill_null(line, 0).to_numpy(zero_copy_only=False) % 5)
    there = np.ones(at.shape, bool)
    there[kind == 0, :2] = False
    there[kind == 1, 81] = False
    ends = np.append(0, there.sum(1).cumsum()).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pool.take(pa.array(at[there])))


def flow_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow-CSV events (``csv array<string>`` of width 82, 80 or 81) derived from ``lineitem``: the rows of ``flow_csv_view``,
    built batch by batch. Nothing is stored; a query that reads them more than once keeps what it needs of them."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _csv_arrays(b)], names=[*b.schema.names, "csv"])

    schema = T.StructType([*rows.schema.fields, T.StructField("csv", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(build, schema).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "csv")
