import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codewave.operators import assemble, features, joins, quality, reconcile, texts, triage
from codewave.plans.training_set import build_training_set
from codewave.sources import readers, writers


def test_null_keys_match(spark, rows):
    a = spark.createDataFrame([(1, None), (2, "x")], "n int, k string")
    b = spark.createDataFrame([(None, 10), ("x", 20), ("y", 30)], "k string, m int")
    assert rows(joins.null_safe_join(a, b, ["k"]), "n", "m") == [(1, 10), (2, 20)]
    assert rows(joins.null_safe_join(a, b, ["k"], "full"), "k", "n", "m") == sorted(
        [(None, 1, 10), ("x", 2, 20), ("y", None, 30)], key=repr
    )
    assert rows(joins.null_safe_join(b, a, ["k"], "left_anti"), "m") == [(30,)]


def test_keys_that_are_never_missing_use_plain_equality(spark, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "n int, k string")
    b = spark.createDataFrame([("x", 20), ("z", 30)], "k string, m int")
    safe = joins.null_safe_join(a, b, ["k"], "full")
    plain = joins.null_safe_join(a, b, ["k"], "full", nullable_keys=False)
    assert rows(safe, "k", "n", "m") == rows(plain, "k", "n", "m")


def test_lookup_broadcasts_by_the_size_of_what_was_written(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "n int, k string")
    table = spark.createDataFrame([("a", 10), (None, 20)], "k string, m int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold, broadcast in (("10m", True), ("-1", False)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = joins.lookup(df, table, ["k"])
            assert rows(got, "n", "m") == [(1, 10), (2, 20), (3, None)]
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) is broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("typed, share", [("SI", 1.0), (" Si. ", 1.0), ("1", 1.0), ("no", 0.0)])
def test_flags_are_normalised_before_they_are_counted(spark, typed, share):
    df = spark.createDataFrame([("01", typed, 80)], "c string, f string, w int")
    codes = spark.createDataFrame([("01", "x")], "c string, glosa string")
    assert quality.agreement_by_code(df, "c", "f", codes, "glosa").first()["prop"] == share
    assert quality.agreement_across_waves(df, "c", "f", "w", [80], codes).first()["prop80"] == share


@pytest.mark.parametrize("copies, kept", [(2, 0), (3, 3)])
def test_min_support_counts_missing_codes(spark, copies, kept):
    df = spark.createDataFrame([(i, None) for i in range(copies)] + [(9, "a")] * 4, "id int, c string")
    got = reconcile.min_support(df, "c")
    assert got.filter("c is null").count() == kept and got.filter("c = 'a'").count() == 4


def test_drop_sentinels_keeps_nulls(spark, rows):
    df = spark.createDataFrame(
        [("-88", 1), ("", 1), (None, 1), ("pan", 999), ("pan", None), ("pan", 5)], "t string, c int"
    )
    assert rows(reconcile.drop_sentinels(df, "t", "c")) == sorted([(None, 1), ("pan", None), ("pan", 5)], key=repr)


def test_label_index_is_dense_and_sorted(spark, rows):
    labels = ["10", "2", "1", None, "01", "ñ", "n", "10"]
    keys, indexed = reconcile.index_labels(spark.createDataFrame([(v,) for v in labels], "c string"), "c")
    want = sorted({v for v in labels if v is not None}, key=lambda s: s.encode()) + [None]
    assert rows(keys) == sorted([(v, i) for i, v in enumerate(want)], key=repr)
    assert indexed.count() == len(labels) and indexed.filter("codigo_int is null").count() == 0


def test_numeric_labels_become_text(spark, rows):
    keys, _ = reconcile.index_labels(spark.createDataFrame([(3.0,), (12.0,)], "c double"), "c")
    assert rows(keys) == [("12", 0), ("3", 1)]


def test_first_patch_wins(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, c string")
    one = spark.createDataFrame([(1, "first")], "id int, codigo_nuevo string")
    two = spark.createDataFrame([("a", "second")], "c string, codigo_nuevo string")
    assert rows(reconcile.patch_codes(df, "c", [(one, ["id"]), (two, ["c"])]), "id", "c") == [
        (1, "first"), (2, "second"), (3, "b"),
    ]


def test_reconcile_reviewed_only(spark, rows):
    a = spark.createDataFrame([(1, 5), (2, None), (3, 101)], "k int, rev long")
    b = spark.createDataFrame([(1, 6), (2, 7), (4, 102), (5, None)], "k int, old long")
    full = reconcile.reconcile_sources(a, b, ["k"], "rev", "old")
    assert rows(full, "k", "aeciuo_2") == [(1, 5), (2, 7), (5, None)]
    only = reconcile.reconcile_sources(a, b, ["k"], "rev", "old", reviewed_only=True)
    assert rows(only, "k", "aeciuo_2") == [(1, 5)]


def test_wave_order_and_window(spark, rows):
    df = spark.createDataFrame([("80",), ("82",), ("1",), ("24",), ("x",), (None,), ("99",)], "w string")
    got = [r["w"] for r in assemble.ordered_waves(df, "w").orderBy(F.col("wave_order").asc_nulls_last()).collect()]
    assert got[:4] == ["80", "82", "1", "24"] and set(got[4:]) == {"x", None, "99"}
    assert rows(assemble.wave_window(df, "w", 82)) == [(80,)]
    assert rows(assemble.wave_window(df, "w", 2)) == [(1,), (80,), (82,), (99,)]


def test_triage_parts_are_disjoint_and_complete(spark):
    data = [(i, float(i % 7) if i % 5 else None) for i in range(103)]
    df = spark.createDataFrame(data, "id long, d double")
    human, auto = triage.triage_split(df, "d", "id", 0.6)
    ids = [r["id"] for r in human.collect()], [r["id"] for r in auto.collect()]
    assert len(ids[0]) == int(103 * (1 - 0.6)) and sorted(ids[0] + ids[1]) == list(range(103))
    hardest = sorted(data, key=lambda r: (r[1] is None, r[1] or 0.0, r[0]))[: len(ids[0])]
    assert set(ids[0]) == {r[0] for r in hardest}


def test_triage_of_nothing(spark):
    human, auto = triage.triage_split(spark.createDataFrame([], "id long, d double"), "d", "id")
    assert human.count() == 0 and auto.count() == 0


def test_remaining_rows_removes_duplicates_of_taken_rows(spark, rows):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "t string, c int")
    taken = spark.createDataFrame([("a", None)], "t string, c int")
    assert rows(triage.remaining_rows(df, taken)) == [("b", 1)]
    assert rows(triage.remaining_rows(df, taken, ["t"])) == [("b", 1)]


def test_reviewers_take_turns(spark, rows):
    df = spark.createDataFrame([(i, float(10 - i)) for i in range(1, 6)], "id long, d double")
    got = rows(triage.assign_reviewers(df, "d", "id", ["even", "odd"]), "d", "persona_codifica")
    assert got == [(5.0, "odd"), (6.0, "even"), (7.0, "odd"), (8.0, "even"), (9.0, "odd")]


def test_grid_of_a_wave_without_hits_and_unknown_hits(spark, rows):
    data = [(1, i, float(i), 0) for i in range(20)] + [(2, 100 + i, float(i), None if i % 2 else 1) for i in range(20)]
    df = spark.createDataFrame(data, "w int, id long, d double, hit int")
    grid = quality.cutoff_accuracy_grid(df, "w", "d", "id", "hit", [0.02, 0.1, 0.5])
    assert rows(grid, "w", "cut", "k", "hits", "accuracy") == [
        (1, "0.02", 0, 0, 0.0), (1, "0.10", 2, 0, 0.0), (1, "0.50", 10, 0, 0.0),
        (2, "0.02", 0, 0, 0.0), (2, "0.10", 2, 1, 0.5), (2, "0.50", 10, 5, 0.5),
    ]


def test_bins_of_a_small_wave(spark):
    df = spark.createDataFrame([(1, i, float(i), 1) for i in range(3)], "w int, id long, d double, hit int")
    bins = {r["d"]: r["bin"] for r in quality.difficulty_bins(df, "w", "d", "id", "hit").collect()}
    assert bins[0] == 1 and bins[2] == 13 and 1 < bins[1] <= 13


def test_confusion_matrix_is_dense_and_complete(spark, rows):
    df = spark.createDataFrame([(2, 2), (2, 4), (4, 4), (4, 9), (4, 1)], "t int, p int")
    keys = spark.createDataFrame([(2, "b"), (3, "c")], "i int, c string")
    cm = quality.confusion_matrix(df, "t", "p", keys, "i", "c")
    assert cm.count() == 9 and cm.agg(F.sum("n")).first()[0] == 3
    assert (2, 4, "b", None, 1) in rows(cm)
    metrics = {r["codigo_int"]: r for r in quality.class_metrics(df, "t", "p").collect()}
    assert [metrics[k]["tp"] for k in (2, 3, 4)] == [1, 0, 1]
    assert metrics[3]["recall"] is None and metrics[2]["precision"] == 1.0


@pytest.mark.parametrize("n, total, text", [(729, 1000, "72.9%"), (1, 1, "100%"), (1, 3, "33.33%"), (1, 2, "50%"), (0, 5, "0%")])
def test_percent_text(spark, n, total, text):
    df = spark.createDataFrame([(n, total)], "n int, t int")
    assert df.select(quality.percent_text(F.col("n") / F.col("t"))).first()[0] == text


def test_vocabulary_order_and_unknown_words(spark, rows):
    train = spark.createDataFrame([(1, "b a b"), (2, "c a"), (3, "")], "id long, t string")
    vocab = features.fit_vocabulary(train, "t", "id")
    assert rows(vocab, "idx", "word", "n", "n_docs") == [(2, "b", 2, 1), (3, "a", 2, 2), (4, "c", 1, 1)]
    new = spark.createDataFrame([(7, "a zz b"), (8, ""), (9, None)], "id long, t string")
    seqs = features.encode_sequences(new, "t", "id", vocab)
    assert rows(seqs) == [(7, [3, 1, 2]), (8, []), (9, [])]
    padded = features.pad_sequences(seqs, "seq", 2)
    assert rows(padded) == [(7, [1, 2]), (8, [0, 0]), (9, [0, 0])]


def test_vocabulary_with_large_ids(spark, rows):
    big = 2**62
    train = spark.createDataFrame([(big + 1, "x y"), (big, "z w z"), (big + 2, "y x w")], "id long, t string")
    vocab = features.fit_vocabulary(train, "t", "id")
    assert [r[1] for r in rows(vocab, "idx", "word")] == ["z", "w", "x", "y"]


def test_pooling(spark):
    tokens = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 1)], "id long, idx int")
    vectors = spark.createDataFrame([(2, [1.0, -2.0]), (3, [4.0, -1.0])], "idx int, embedding array<float>")
    got = {r["id"]: r["pooled"] for r in features.pool_embeddings(tokens, vectors, "id", 2).collect()}
    assert got[1] == pytest.approx([4.0, -1.0, 2.0, -5 / 3]) and got[2] == [0.0, 0.0, 0.0, 0.0]


def test_combine_keeps_the_trailing_blank(spark):
    df = spark.createDataFrame([("a", "")], "x string, y string")
    assert texts.combine_text(df, "xy", ["x", "y"]).first()["xy"] == "a "


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["Código Nuevo", "codigoNuevo", "% x", "1 a", "Conformidad del registro ciuo 08.cl"])
    assert readers.clean_column_names(df).columns == [
        "codigo_nuevo", "codigo_nuevo_2", "percent_x", "x1_a", "conformidad_del_registro_ciuo_08_cl",
    ]


def test_ambiguous_columns_are_errors(spark):
    df = spark.createDataFrame([(1, 2)], ["codigo_a", "codigo_b"])
    with pytest.raises(ValueError):
        readers.rename_by_pattern(df, "^codigo", "c")
    schema = T.StructType([T.StructField("codigo", T.StringType())])
    with pytest.raises(ValueError):
        readers.load_union([df], schema, {"codigo": "codigo_."})


def test_load_union_from_paths(spark, tmp_path, rows):
    a = spark.createDataFrame([("x", 1.0)], "codigo string, n double")
    b = spark.createDataFrame([("80", 2, "y")], "wave string, n int, codigo_cod string")
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    schema = T.StructType(
        [T.StructField("wave", T.StringType()), T.StructField("code", T.StringType()), T.StructField("n", T.LongType())]
    )
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    got = readers.load_union(paths, schema, {"code": "codigo(_cod)?"}, {"wave": "79"}, spark)
    assert rows(got) == [("79", "x", 1), ("80", "y", 2)]


def test_semicolon_csv_uses_decimal_commas(spark, tmp_path, rows):
    df = spark.createDataFrame([("a;b", 1.5, 3), (None, None, None)], "t string, x double, n int")
    writers.write_semicolon_csv(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "1,5" in text and text.startswith("t;x;n")
    assert rows(readers.read_semicolon_csv(spark, str(tmp_path / "out"), df.schema)) == rows(df)


def test_latin1_files(spark, tmp_path):
    (tmp_path / "raw.csv").write_bytes("oficio\nalbañil\n".encode("latin1"))
    schema = T.StructType([T.StructField("oficio", T.StringType())])
    assert readers.read_latin1_csv(spark, str(tmp_path / "raw.csv"), schema).first()["oficio"] == "albañil"


def test_write_table_splits_by_wave(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id int, submuestra int")
    writers.write_table(df, str(tmp_path / "t"))
    assert {p.name for p in (tmp_path / "t").glob("submuestra=*")} == {f"submuestra={w}" for w in range(3)}
    assert rows(spark.read.parquet(str(tmp_path / "t")), "id", "submuestra") == rows(df)


def test_unknown_mode_is_an_error():
    with pytest.raises(ValueError):
        build_training_set("otro", {}, 80)


def test_new_wave_mode(spark, rows):
    new = spark.createDataFrame([(1, "-88", "x"), (2, "Vende PAN", "77"), (3, None, "de")], "id int, oficio string, tareas string")
    got = build_training_set("nuevos", {"new": new}, 80)
    assert rows(got, "id", "oficio_tarea", "tareas_proc") == [(2, "vende pan 77", ""), (3, " ", "")]


def test_crosstab_drops_nulls_and_fills_zeros(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 1), ("a", None)], "x string, y int")
    assert rows(quality.crosstab(df, "x", "y", [1, 2])) == [("a", 2, 0), ("b", 0, 1)]
    assert rows(quality.crosstab(df, "x")) == [("a", 3), ("b", 1)]


def test_attach_predictions_filters(spark, rows):
    pred = spark.createDataFrame(
        [(1, 1, "03", "80"), (2, 1, "3", "80"), (3, 1, "03", "11"), (4, 1, "03", "1")], "interview_id int, nro_rph int, pred_nueva string, submuestra string"
    )
    human = spark.createDataFrame(
        [(1, 1, "SI", "03"), (2, 1, "1", "03"), (3, 1, "si", "03"), (4, 1, "no", "-77")], "interview_id int, nro_rph int, predice string, codigo_cod string"
    )
    got = triage.attach_predictions(pred, human, ["interview_id", "nro_rph"])
    assert rows(got, "interview_id", "predice2", "predice", "codigo_cod") == [(1, 1, "si", 3), (2, 0, "1", 3)]


def test_wide_tables_refuse_values_without_a_column(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 9)], "code string, hit int, wave int")
    with pytest.raises(Exception, match="value without a column: 9"):
        quality.code_by_wave(df, "code", "hit", "wave", [1, 2]).collect()
    with pytest.raises(Exception, match="value without a column: 9"):
        quality.crosstab(df, "code", "wave", [1, 2]).collect()
