"""File order, rejected values, and tables that are published together."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codewave.operators import assemble
from codewave.plans import code_wave as W
from codewave.sources import readers, writers


@pytest.fixture
def files(spark, tmp_path):
    """Two folders; rows as (household, text) in the order they were written."""
    written = []
    for n, folder in enumerate(["b", "a"]):  # the order of paths, not of names
        for part in range(3):
            rows = [(f"h{(i * 7 + part) % 4}" if i % 11 else None, f"{n}-{part}-{i:03d}") for i in range(50)]
            written += rows
            df = spark.createDataFrame(rows, "folio string, texto string").coalesce(1)
            df.write.mode("append").parquet(str(tmp_path / folder / f"part={part}"))
            df.write.mode("append").option("header", True).csv(str(tmp_path / f"{folder}-csv" / f"part={part}"))
    return tmp_path, written


def numbered(written):
    seen, out = {}, []
    for household, text in written:
        seen[household] = seen.get(household, 0) + 1
        out.append((household, text, seen[household]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_persons_are_numbered_in_file_order(spark, files, rows, monkeypatch, chunk):
    monkeypatch.setattr(assemble, "ORDER_CHUNK", chunk)
    root, written = files
    got = readers.load_person_files(spark, [str(root / "b"), str(root / "a")], ["folio", "texto"], "folio")
    assert rows(got) == numbered(written)


@pytest.mark.parametrize("split", ["128m", "200"])
def test_text_files_too(spark, files, rows, split):
    root, written = files
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)  # several splits of one file
    try:
        read = readers.read_in_order(spark, [str(root / "b-csv"), str(root / "a-csv")], "csv", "folio string, texto string, part int")
        got = rows(read.filter("texto <> 'texto'"), "_file_no", "texto")
        assert [t for _, t in got] == [t for _, t in sorted((n // 50, w[1]) for n, w in enumerate(written))]
        places = read.groupBy("_file_no").agg(F.min("_row_no"), F.max("_row_no"), F.count("*"), F.count_distinct("_row_no"))
        assert {tuple(r)[1:] for r in places.collect()} == {(0, 50, 51, 51)}
        order = [r["texto"] for r in read.orderBy("_file_no", "_row_no").collect() if r["texto"] != "texto"]
        assert order == [t for _, t in written]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_row_numbers_need_no_exchange_of_rows(spark, files):
    root, written = files
    df = readers.read_in_order(spark, [str(root / "b"), str(root / "a")])
    got = assemble.file_row_id(df.select("texto", "_file_no", "_row_no"))
    assert [r["texto"] for r in got.orderBy("id_fila").collect()] == [t for _, t in written]
    assert [r["id_fila"] for r in got.orderBy("id_fila").collect()] == list(range(1, 301))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_bad_values_go_to_a_second_output(spark, tmp_path):
    good = [(1, "10", "1.5"), (2, None, None), (3, "x", "2.0"), (4, "7.5", "y")]
    spark.createDataFrame(good, "id long, code string, share string").coalesce(1).write.parquet(str(tmp_path / "w1"))
    spark.createDataFrame([(5, 3.0), (6, 2.5)], "id long, codigo double").coalesce(1).write.parquet(str(tmp_path / "w2"))
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("code", T.IntegerType()), T.StructField("share", T.DoubleType())]
    )
    paths = [str(tmp_path / "w1"), str(tmp_path / "w2")]
    loaded = readers.load_union_checked(paths, schema, {"code": "codigo"}, {"share": "0.5"}, spark)
    assert sorted(map(tuple, loaded.rows.collect())) == [(1, 10, 1.5), (2, None, None), (5, 3, 0.5)]
    bad = sorted((r["file"].split("/")[-2], r["row_no"], r["column"], r["value"]) for r in loaded.rejected.collect())
    assert bad == [("w1", 2, "code", "x"), ("w1", 3, "code", "7.5"), ("w1", 3, "share", "y"), ("w2", 1, "code", "2.5")]
    total = sum(spark.read.parquet(p).count() for p in paths)
    assert loaded.rows.count() + loaded.rejected.select("file", "row_no").distinct().count() == total


class Killed(Exception):
    pass


def test_no_reader_sees_half_a_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    a, b = spark.range(3), spark.range(5)
    with pytest.raises(ValueError):
        writers.read_published(spark, root, "a")
    assert writers.publish_tables({"a": a, "b": b}, root, "001")

    # Stopped between the two tables of the next version.
    parquet = type(a.write).parquet
    monkeypatch.setattr(type(a.write), "parquet", lambda self, path, **k: (_ for _ in ()).throw(Killed()) if path.endswith("/b") else parquet(self, path, **k))
    with pytest.raises(Killed):
        writers.publish_tables({"a": spark.range(30), "b": spark.range(50)}, root, "002")
    monkeypatch.undo()
    assert writers.published_versions(spark, root) == ["001"]
    assert writers.read_published(spark, root, "a").count() == 3

    assert writers.publish_tables({"a": spark.range(31), "b": spark.range(51)}, root, "002")
    assert [writers.read_published(spark, root, n).count() for n in "ab"] == [31, 51]
    assert not writers.publish_tables({"a": spark.range(9), "b": spark.range(9)}, root, "002")
    assert writers.read_published(spark, root, "a").count() == 31
    assert writers.read_published(spark, root, "b", "001").count() == 5
    with pytest.raises(ValueError):
        writers.read_published(spark, root, "a", "003")


def test_waves_are_delivered_once_per_batch(spark, tmp_path, monkeypatch):
    from codewave.streaming import score_stream

    folder, root, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    monkeypatch.setattr(W, "code_wave", lambda model, wave, *a, **k: (wave.filter("id < 4"), wave.filter("id >= 4")))
    failed = []
    publish = W.publish_tables

    def once(tables, *rest):
        if not failed:
            failed.append(1)
            raise Killed
        return publish(tables, *rest)

    monkeypatch.setattr(W, "publish_tables", once)
    wave = spark.range(10)
    wave.coalesce(1).write.parquet(folder)

    def run():
        query = score_stream.code_wave_stream(spark, None, folder, wave.schema, None, "id", [], root, check)
        query.awaitTermination()

    with pytest.raises(Exception):
        run()
    run()  # the same batch again
    spark.range(100, 103).coalesce(1).write.mode("append").parquet(folder)
    run()
    run()  # nothing new
    assert writers.published_versions(spark, root) == ["0000000000", "0000000001"]
    sizes = [
        writers.read_published(spark, root, sheet, v).count()
        for v in writers.published_versions(spark, root) for sheet in (W.HUMAN_SHEET, W.TECHNICAL_SHEET)
    ]
    assert sizes == [4, 6, 0, 3]
    assert set(json.loads(open(f"{root}/_published/0000000000.json").read())) == {W.HUMAN_SHEET, W.TECHNICAL_SHEET}
