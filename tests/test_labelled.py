"""Rows by position, sampling to the target, encodings decided file by file."""

import pytest

from flowlens.sources.labelled import read_labelled, read_labelled_with_fallback


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _csv(path, name, n, encoding="utf-8", header=" A, Label"):
    path.write_bytes((header + "\n" + "".join(f"{i},{name}\n" for i in range(n))).encode(encoding))
    return str(path)


def test_first_rows_of_split_files(spark, tmp_path, small_blocks):
    files = [_csv(tmp_path / f"f {i}.csv", f"n{i}", 2000) for i in range(3)]
    assert read_labelled(spark, files).rdd.getNumPartitions() > 3
    for cap in (1, 999, 1500, 5000):
        got = read_labelled(spark, files, rows_per_file=cap).collect()
        for i in range(3):
            assert sorted(r["A"] for r in got if r["Label"] == f"n{i}") == list(range(min(cap, 2000)))
    assert read_labelled(spark, files, rows_per_file=0).count() == 0


def test_files_until_the_target_then_a_sample(spark, tmp_path, small_blocks):
    files = [_csv(tmp_path / f"{n}.csv", n, 1000) for n in ("c", "a", "b")]
    files[1] = _csv(tmp_path / "a.csv", "a", 1000, header="Label ,A")     # another header between the two
    first = {tuple(r) for r in read_labelled(spark, files, target_rows=1000).select("A", "Label").collect()}
    assert first == {(float(i), "c") for i in range(1000)}                # the first file in the given order is enough
    rows = [r["source_file"] for r in read_labelled(spark, files, rows_per_file=800, target_rows=1200, sample=True).collect()]
    assert len(rows) == 1200 and set(rows) == {"c.csv", "a.csv"}          # a sample of the 1,600 rows of two files
    again = [r["source_file"] for r in read_labelled(spark, files, rows_per_file=800, target_rows=1200, sample=True).collect()]
    assert sorted(rows) == sorted(again) and min(rows.count("c.csv"), rows.count("a.csv")) > 500
    assert read_labelled(spark, files, target_rows=9999).count() == 3000


def test_encoding_of_each_file_under_caps(spark, tmp_path, small_blocks):
    files = [_csv(tmp_path / "lat in.csv", "Café", 900, "latin-1"), _csv(tmp_path / "utf.csv", "Café", 900),
             _csv(tmp_path / "mark.csv", "a�b", 900), "file://" + _csv(tmp_path / "uri.csv", "Größe", 900, "latin-1")]
    got = read_labelled_with_fallback(spark, files, rows_per_file=9).collect()
    assert len(got) == 36
    assert {(r["source_file"].replace("%20", " "), r["Label"]) for r in got} == {
        ("lat in.csv", "Café"), ("utf.csv", "Café"), ("mark.csv", "a�b"), ("uri.csv", "Größe")}
    with pytest.warns(UserWarning, match="not found"):
        assert read_labelled_with_fallback(spark, [files[1], str(tmp_path / "none.csv")], target_rows=5, sample=True).count() == 5
    with pytest.raises(FileNotFoundError), pytest.warns(UserWarning):
        read_labelled_with_fallback(spark, [str(tmp_path / "none.csv")])
