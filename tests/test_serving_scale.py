"""Serving at size: what is read batch by batch equals the plain expressions, and no step grows faster than its input."""

import time

from pyspark.sql import functions as F

from flowlens.operators import records as R
from flowlens.schemas import FEATURE_NAME_MAP, FLOW_COLUMNS_82, MODEL_FEATURES_DEFAULT

TEXTS = ["1", "-0", "007", "+5", " 2.5 ", "\t3\n", "1.", ".5", "1e5", "1E-3", "1d", "2.5F", "0x1p3", "0x1p5000", "-0x1p5000", "1e400", "-1e400", "1e-400", "NaN", "nan", "+NaN", "+nan",
         "Infinity", "-inf", "+INF", "+-inf", "", " ", "bad", "1 2", "1_0", "١", "--1", "1e", "e1", ".", "123456789012345678901234567890", "0.1234567890123456789", "2024-01-01", None, "1f d", "- 1"]


def test_numbers_are_those_of_try_cast(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    want = [r[0] for r in df.orderBy("i").select(F.col("t").try_cast("double")).collect()]
    import pyarrow as pa
    value, ok = R.read_numbers(pa.array(TEXTS, pa.string()))
    assert [repr(float(v)) if k else None for v, k in zip(value, ok)] == [None if w is None else repr(w) for w in want]


def test_all_features_equal_the_features_one_by_one(spark):
    line = lambda k, n: [TEXTS[(k + i) % len(TEXTS)] for i in range(n)]
    rows = [(k, line(k, (82, 80, 81)[k % 3])) for k in range(90)] + [(90, None), (91, list(FLOW_COLUMNS_82)), (92, [])]
    df = spark.createDataFrame(rows, "id int, csv array<string>").repartition(3)
    wide = R.csv_events_to_features(df, keep=["id", "src_ip"])
    assert wide.columns == ["id", "src_ip", *MODEL_FEATURES_DEFAULT]
    assert "MapInArrow" in wide._jdf.queryExecution().toString()
    ok = R.drop_header_rows(R.split_by_width(df)[0])
    plain = R.record_to_features(R.csv_to_record(ok, keep=["id"]), ["id", "src_ip"])
    assert sorted(map(repr, wide.collect())) == sorted(map(repr, plain.collect())) and wide.count() == 60
    assert R.csv_events_to_features(df, keep=["id"], features=[*MODEL_FEATURES_DEFAULT, "unknown"]).first()["unknown"] == 0.0


def test_requests_are_read_in_one_pass(spark):
    import json
    rows = [(k, json.dumps({f" {f} " if k % 2 else f: (k + i) / 7 if i % 3 else str(k * i) for i, f in enumerate(MODEL_FEATURES_DEFAULT[: k % 78])})) for k in range(100)]
    rows += [(100, '{"Flow Duration": "NaN", "x": 1}'), (101, '{"Flow Duration": 1, "x": "no"}'), (102, '{"x": 1, " x": 1}'), (103, "{"), (104, None), (105, "{}")]
    df = spark.createDataFrame(rows, "id int, body string").repartition(3)
    got = R.request_map_to_features(df, "body", ["id"])
    assert sum(map(got._jdf.queryExecution().optimizedPlan().toString().count, ("Generate",))) == 0     # no copy of a row for each step
    plain = R.request_map_to_features(R.split_requests(df, "body")[0], "body", ["id"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect())) and got.count() == 102
    assert R.request_map_to_features(df.select("id", F.from_json("body", "map<string,string>").alias("body")), "body", ["id"]).count() == 102


def test_flow_csv_is_built_in_batches_with_the_rows_of_its_sql(spark, tmp_path):
    from flowlens.sources import fixtures as fx
    rows = [(None if k % 19 == 5 else k * 31 - 900, None if k % 17 == 3 else k % 7 - 1, k, None if k % 13 == 1 else k % 5) for k in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    built, sql = fx.flow_csv(spark, str(tmp_path)), fx.flow_csv_view(spark, str(tmp_path))
    assert "MapInArrow" in built._jdf.queryExecution().toString()
    assert built.dtypes == sql.dtypes
    assert sorted(map(repr, built.collect())) == sorted(map(repr, sql.collect()))


def test_a_long_quoted_line_takes_one_pass(spark):
    line = ",".join(['"a,""b"""', "", "x"] * 20_000)
    began = time.time()
    got = spark.createDataFrame([(line,), ('"",', ), (',"a"',), ('"a\nb",c',)], "line string").select(F.col("line"), R.decode_csv_line(F.col("line")).alias("csv")).collect()
    assert time.time() - began < 60
    assert got[0]["csv"] == ['a,"b"', "", "x"] * 20_000
    assert [r["csv"] for r in got[1:]] == [["", ""], ["", "a"], ["a\nb", "c"]]


def test_files_are_written_in_ranges(spark, tmp_path):
    from flowlens.plans.train_queries import KEYS, _by_file
    n = spark.sparkContext.defaultParallelism
    rows = spark.range(4000).selectExpr("id l_orderkey", "1 l_linenumber", "id l_partkey", "id l_suppkey", "id % 2 file_no").repartition(n)
    sizes = [r["n"] for r in _by_file(rows).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000          # less than a whole file
    _by_file(rows).write.partitionBy("file_no").csv(str(tmp_path / "out"))
    files = sorted((tmp_path / "out" / "file_no=1").glob("part-*"))
    got = [int(x.split(",")[0]) for f in files for x in f.read_text().split()]
    assert len(files) > 1 and got == list(range(1, 4000, 2))
    assert len(KEYS) == 4
