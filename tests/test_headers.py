"""First lines of files, by the bytes that are read."""

from __future__ import annotations

from tidemark.sources import csvs, headers


def test_large_files_are_not_read_whole(spark, tmp_path):
    big = tmp_path / "in" / "a b" / "x+y%20z.csv"
    big.parent.mkdir(parents=True)
    with big.open("w") as f:
        f.write("\ufeffts,asset_label\r\n")
        f.writelines(f"{i},T\n" for i in range(400_000))
    (tmp_path / "in" / "empty.csv").write_text("")
    (tmp_path / "in" / "line.csv").write_text("ts")
    (tmp_path / "in" / "wide.csv").write_text(",".join(f"c{i}" for i in range(3000)) + "\n1\n")
    (tmp_path / "in" / "_hidden").mkdir()
    (tmp_path / "in" / "_hidden" / "h.csv").write_text("ts\n")
    (tmp_path / "in" / "other.txt").write_text("ts\n")
    spark.dataSource.register(headers.HeaderSource)
    got = {r["path"].split("/")[-1]: r for r in spark.read.format("file_headers").load(str(tmp_path / "in")).collect()}
    assert got.keys() == {"x+y%20z.csv", "empty.csv", "line.csv", "wide.csv"}
    assert got["x+y%20z.csv"]["header"] == "ts,asset_label" and got["x+y%20z.csv"]["bytes_read"] == headers.BYTES < got["x+y%20z.csv"]["size"]
    assert got["empty.csv"]["header"] == "" and got["line.csv"]["header"] == "ts"
    assert got["wide.csv"]["header"].endswith("c2999") and got["wide.csv"]["bytes_read"] == got["wide.csv"]["size"]


def test_the_same_through_spark_alone(spark, tmp_path, monkeypatch):
    """A store that Arrow does not know."""
    for name, text in (("a/x y.csv", "ts,v\n1,2\n"), ("b/+%.csv", '"ts","w"\n1,2\n')):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    own = csvs.headers(spark, str(tmp_path))
    monkeypatch.setattr(headers, "_known", lambda *a: False)
    other = csvs.headers(spark, str(tmp_path))
    assert {k: [p.removeprefix("file:") for p in v] for k, v in other.items()} == own == {("ts", "v"): [f"{tmp_path}/a/x y.csv"], ("ts", "w"): [f"{tmp_path}/b/+%.csv"]}
    assert not headers._known(spark, "viewfs://cluster/in")


def test_no_files(spark, tmp_path):
    assert csvs.headers(spark, str(tmp_path)) == {}
    scan = csvs.read_series(spark, str(tmp_path))
    assert scan.rows.collect() == scan.files.collect() == scan.skipped.collect() == []


def test_many_files(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"{i:03d}.csv").write_text(f"ts,{'ab'[i % 2]}\n1700000000000,1\n")
    rows = headers.first_lines(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4 and {len(v) for v in csvs.headers(spark, str(tmp_path)).values()} == {50}
    assert csvs.read_series(spark, str(tmp_path), levels=False).rows.count() == 100
