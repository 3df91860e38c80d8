from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codewave.operators import score, train
from codewave.streaming.score_stream import score_wave_stream

WORDS = {"a": "pan harina horno masa", "b": "camión ruta carga viaje", "c": "niños clase escuela libro"}


@pytest.fixture(scope="module")
def answers(spark):
    data = []
    for i in range(90):
        label = "abc"[i % 3]
        words = WORDS[label].split()
        data.append((i, f"{words[i % 4]} {words[(i + 1) % 4]}", words[(i + 2) % 4], label))
    return spark.createDataFrame(data, "id long, oficio string, tareas string, aeciuo_2 string")


@pytest.fixture(scope="module")
def model(answers):
    prepared = score.prepare_wave(answers)
    return train.train_multi_field(prepared, ["oficio_proc", "tareas_proc"], "aeciuo_2")


def accuracy(scored):
    return scored.select(F.avg((F.col("prediction") == F.col("codigo_int")).cast("int"))).first()[0]


def test_multi_field_learns(answers, model):
    assert accuracy(train.predict(model, score.prepare_wave(answers), "aeciuo_2")) > 0.9


def test_linear_svm_learns(answers):
    prepared = score.prepare_wave(answers)
    svm = train.train_linear_svm(prepared, ["oficio_tarea"], "aeciuo_2")
    assert accuracy(train.predict(svm, prepared, "aeciuo_2")) > 0.9


def test_two_levels_learn(answers):
    prepared = score.prepare_wave(answers).withColumn(
        "aeciuo_2", F.concat(F.translate("aeciuo_2", "abc", "xxz"), "aeciuo_2")
    )
    levels = train.train_two_levels(prepared, ["oficio_tarea"], "aeciuo_2", "id")
    assert levels.learner.groups == (0, 0, 1)
    scored = train.predict(levels, prepared, "aeciuo_2")
    assert accuracy(scored) > 0.9
    assert all(sum(r["probability"]) == pytest.approx(1) for r in scored.collect())


def test_same_scores_every_time(answers, model):
    def scores():
        out = score.score_wave(model, answers).select("id", F.round("pbb_caso", 9).alias("p")).collect()
        return sorted(map(tuple, out))

    assert scores() == scores()


def test_score_wave_drops_no_answers(spark, model):
    new = spark.createDataFrame([(1, "-99", "x"), (2, "pan", "horno")], "id long, oficio string, tareas string")
    got = score.score_wave(model, new).collect()
    assert [r["id"] for r in got] == [2] and got[0]["codigo_int"] == 0 and got[0]["dificultad"] > 1
    assert sum(got[0]["proba"]) == pytest.approx(1.0)


def test_best_model_is_saved_and_read_back(answers, tmp_path):
    prepared = score.prepare_wave(answers)
    path = str(tmp_path / "model")
    best, losses = train.select_best_model(prepared, ["oficio_tarea"], "aeciuo_2", "id", path, passes=4, patience=2)
    assert min(losses[1:]) < losses[0]
    assert accuracy(train.predict(best, prepared, "aeciuo_2")) > 0.9


def test_the_query_trains_as_long_as_the_reference(spark, monkeypatch):
    """At most 100 passes, and 15 without a lower loss before training stops."""
    import inspect

    import __spark_entry__ as entry

    told = []
    real = inspect.signature(train.select_best_model)

    def select(*args, **options):
        told.append(real.bind(*args, **options))
        return None, [1.0]

    monkeypatch.setattr(train, "select_best_model", select)
    assert entry.queries()["select_best_model"](spark, "/root/testdata/sf0.001").count() == 1
    told[0].apply_defaults()
    assert (told[0].arguments["passes"], told[0].arguments["patience"]) == (100, 15)


def test_compare_strategies_on_one_split(answers, monkeypatch):
    splits = []
    split = train.stratified_split
    monkeypatch.setattr(train, "stratified_split", lambda *a, **k: splits.append(1) or split(*a, **k))
    two_digits = F.concat((F.col("id") % 2).cast("string"), "aeciuo_2")
    prepared = score.prepare_wave(answers).withColumn("aeciuo_2", two_digits)
    strategies = train.text_strategies("oficio_tarea", "id", dim=8, passes=3)
    table = train.compare_strategies(prepared, "aeciuo_2", "id", strategies).collect()
    names = ["tfidf", "sequences", "embeddings", "two levels"]
    assert [tuple(r)[:2] for r in table] == [(n, d) for d in (1, 2) for n in names]
    assert len(splits) == 1 and len({r["n"] for r in table}) == 1


def test_strategies_share_their_features(answers, monkeypatch):
    made = []
    to_sparse = train.to_sparse
    monkeypatch.setattr(train, "to_sparse", lambda *a, **k: made.append(1) or to_sparse(*a, **k))
    two_digits = F.concat((F.col("id") % 2).cast("string"), "aeciuo_2")
    prepared = score.prepare_wave(answers).withColumn("aeciuo_2", two_digits)
    shared = {"tfidf": train.text_strategies("oficio_tarea", "id", passes=1)["tfidf"]}
    alone = {"tfidf": lambda fit, label: train.train_single_field(fit, "oficio_tarea", label, "id", passes=1)}
    tables = []
    for strategies in (shared, alone):
        tables.append(train.compare_strategies(prepared, "aeciuo_2", "id", strategies).collect())
        made.append("end")
    assert made == [1, "end", 1, 1, "end"]
    assert tables[0] == tables[1]


def test_saved_model_scores_alike(answers, model, tmp_path):
    path = str(tmp_path / "saved")
    model.save(path)
    again = train.Classifier.load(path, answers, ["oficio_proc", "tareas_proc"])
    a, b = (m.score(score.prepare_wave(answers)).select("id", "probability") for m in (model, again))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    with pytest.raises(ValueError):
        train.Classifier.load(path, answers, ["other"])


def test_unseen_words_and_empty_texts_are_scored(spark, model):
    new = spark.createDataFrame([(1, "zzz yyy", "xxx"), (2, "", ""), (3, None, None)], "id long, oficio_proc string, tareas_proc string")
    got = model.score(new).collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3]
    assert all(sum(r["probability"]) == pytest.approx(1) for r in got)


def test_answers_are_scored_in_blocks_like_a_plain_sum(spark, model, monkeypatch):
    monkeypatch.setattr(train, "SCORED_ROWS", 2)
    texts = [("pan zzz horno pan", "masa"), ("ruta", "yyy xxx"), ("zzz zzz", None), ("", ""), ("clase", "clase horno")] * 5
    new = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, oficio_proc string, tareas_proc string")
    plan = model._linear_scores(new, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan and "Generate" not in plan
    words = {(r["field"], r["word"]): (r["idf"], np.array(r["w"])) for r in model.space.words.collect()}
    got = {r["id"]: r["z"] for r in model._linear_scores(new, "id").collect()}
    assert len(got) == 20
    for i, fields in enumerate(texts):
        z, squares, counts = np.zeros(3), 0.0, Counter((f, w) for f, t in enumerate(fields) for w in (t or "").split())
        unseen = Counter()
        for (f, w), n in counts.items():
            if (f, w) not in words:
                unseen[f] += n
                continue
            x = (1 + np.log(n)) * words[f, w][0]
            z, squares = z + x * words[f, w][1], squares + x * x
        for f, n in unseen.items():
            x = (1 + np.log(n)) * model.space.unknown_idf
            z, squares = z + x * np.array(model.unknown[f]), squares + x * x
        if counts:
            assert got[i] == pytest.approx(list(z / np.sqrt(squares) + np.array(model.constant)))


def test_bags_are_scored_in_blocks_like_a_plain_sum(spark, answers, monkeypatch):
    monkeypatch.setattr(train, "SCORED_ROWS", 2)
    bag = train.train_pooled_embedding(score.prepare_wave(answers), "oficio_tarea", "aeciuo_2", "id", dim=4)
    texts = ["pan zzz horno pan", "zzz", "", "ruta clase"] * 4
    new = spark.createDataFrame(list(enumerate(texts)), "id long, oficio_tarea string")
    vectors = {r["word"]: np.array(r["w"]) for r in bag.space.words.collect()}
    got = {r["id"]: r["z"] for r in bag._bag_scores(new, "id").collect()}
    assert sorted(got) == [i for i, t in enumerate(texts) if set(t.split()) & set(vectors)]
    for i in got:
        each = np.array([vectors[w] for w in texts[i].split() if w in vectors])
        wanted = np.concatenate([each.max(axis=0), each.mean(axis=0), [1]]) @ np.array(bag.layer)
        assert got[i] == pytest.approx(list(wanted))


def test_stream_scores_each_file_once(spark, answers, model, tmp_path):
    folder, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    new = answers.drop("aeciuo_2")
    new.filter("id < 40").write.parquet(folder)
    score_wave_stream(spark, model, folder, new.schema, sink, check).awaitTermination()
    assert spark.read.parquet(sink).count() == 40
    new.filter("id >= 40").write.mode("append").parquet(folder)
    score_wave_stream(spark, model, folder, new.schema, sink, check).awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == 90
    batch = score.score_wave(model, new)
    difference = out.join(batch, "id").filter(out["codigo_int"] != batch["codigo_int"])
    assert difference.count() == 0


def test_both_sheets_together_are_the_wave(answers, model, tmp_path):
    from codewave.plans.code_wave import code_wave

    path = str(tmp_path / "saved")
    model.save(path)
    saved = train.Classifier.load(path, answers, ["oficio_proc", "tareas_proc"])
    wave = answers.select(F.concat(F.lit("9400-"), "id").alias("folio"), "oficio", "tareas", "aeciuo_2")
    wave = wave.withColumnRenamed("aeciuo_2", "truth")
    codes = answers.select("aeciuo_2").distinct().withColumn("glosa", F.upper("aeciuo_2"))
    human, technical = code_wave(saved, wave, codes, "folio", ["A", "B"])
    assert human.count() == 36 and technical.count() == 54
    ids = [r["folio"] for r in human.select("folio").union(technical.select("folio")).collect()]
    assert sorted(ids) == sorted(r["folio"] for r in wave.collect())
    assert technical.filter("truth <> prediccion_modelo OR glosa_prediccion <> upper(truth)").count() == 0
    assert {r["persona_codifica"]: r["count"] for r in technical.groupBy("persona_codifica").count().collect()} == {
        "A": 27, "B": 27
    }
    assert "CODIGO" in human.columns and "predice_bien" in technical.columns
