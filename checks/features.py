"""Features, training and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import query
from codewave.functions import arrays as A
from codewave.operators import features, score, spaces, train
from codewave.session import scratch_path, stage_table

TEXT = "oficio_tarea"
DIM = 64
MAXLEN = 25


def _split(spark, sf):
    df = V.f_split(spark, sf, "id", TEXT, "split")
    return df, df.filter(F.col("split") == "train")


def _vocabulary(spark, sf):
    return features.fit_vocabulary(_split(spark, sf)[1], TEXT, "id")


def _sequences(spark, sf):
    df, fit = _split(spark, sf)
    return features.encode_sequences(df, TEXT, "id", features.fit_vocabulary(fit, TEXT, "id"))


def _vectors(spark, sf, vocab):
    """Vectors for the most frequent words: as many as there are embeddings."""
    emb = V.table(spark, sf, "embeddings").select((F.col("vec_id") + 2).cast("int").alias("idx"), "embedding")
    return vocab.join(emb, "idx").select("word", "idx", "embedding")


def _whole(col, digits: int = 4):
    """A vector as text of whole numbers, so that both engines print it alike."""
    scaled = F.transform(col, lambda x: F.round(x * 10**digits).cast("bigint").cast("string"))
    return F.array_join(scaled, " ")


@query("fit_vocabulary", "SELECT word, n, n_docs, idx FROM f_vocab")
def _(spark, sf):
    return _vocabulary(spark, sf)


_SEQ = """SELECT s.id, coalesce(q.seq, []) AS seq FROM f_split s LEFT JOIN (
            SELECT t.id, list(coalesce(v.idx, 1) ORDER BY t.p) AS seq FROM f_tokens t LEFT JOIN f_vocab v ON t.word = v.word GROUP BY t.id) q
          ON s.id = q.id"""


@query("encode_sequences", f"SELECT id, coalesce(array_to_string(seq, ' '), '') AS seq FROM ({_SEQ})")
def _(spark, sf):
    seqs = _sequences(spark, sf)
    return seqs.select("id", F.array_join(F.col("seq").cast("array<string>"), " ").alias("seq"))


@query(
    "pad_sequences",
    f"""SELECT id, array_to_string(list_concat(kept, [0 for i in range({MAXLEN} - len(kept))]), ' ') AS seq FROM (
          SELECT id, CASE WHEN len(seq) > {MAXLEN} THEN seq[len(seq) - {MAXLEN} + 1:] ELSE seq END AS kept FROM ({_SEQ}))""",
)
def _(spark, sf):
    seqs = _sequences(spark, sf)
    padded = features.pad_sequences(seqs, "seq", MAXLEN)
    return padded.select("id", F.array_join(F.col("seq").cast("array<string>"), " ").alias("seq"))


@query(
    "tfidf",
    """SELECT id, idx, round((1 + ln(tf)) * ln(1 + n_train / (1 + n_docs)), 6) AS tfidf FROM (
         SELECT t.id, coalesce(v.idx, 1) AS idx, count(*) AS tf, max(coalesce(v.n_docs, 0)) AS n_docs,
           (SELECT CAST(count(*) AS DOUBLE) FROM f_split WHERE split = 'train') AS n_train
         FROM f_tokens t LEFT JOIN f_vocab v ON t.word = v.word
         GROUP BY t.id, coalesce(v.idx, 1))""",
)
def _(spark, sf):
    df, fit = _split(spark, sf)
    vocab = features.fit_vocabulary(fit, TEXT, "id")
    out = features.tfidf(fit, df, TEXT, "id", vocab)
    return out.withColumn("tfidf", F.round("tfidf", 6))


@query(
    "sparse_features",
    """SELECT id, (SELECT CAST(max(idx) + 1 AS BIGINT) FROM f_vocab) AS size,
         string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY idx) AS indices,
         string_agg(CAST(CAST(round(weight * 10000) AS BIGINT) AS VARCHAR), ' ' ORDER BY idx) AS vals
       FROM (SELECT t.id, coalesce(v.idx, 1) AS idx,
               (1 + ln(count(*))) * ln(1 + (SELECT CAST(count(*) AS DOUBLE) FROM f_split WHERE split = 'train')
                 / (1 + max(coalesce(v.n_docs, 0)))) AS weight
             FROM f_tokens t LEFT JOIN f_vocab v ON t.word = v.word GROUP BY t.id, coalesce(v.idx, 1))
       GROUP BY id""",
)
def _(spark, sf):
    df, fit = _split(spark, sf)
    space = spaces.fit_space(fit, [TEXT], "id")
    vectors = spaces.to_sparse(space.gathered(df, "id"), "id", space.size)
    return vectors.select(
        "id",
        "features.size",
        F.array_join(F.col("features.indices").cast("array<string>"), " ").alias("indices"),
        _whole(F.col("features.values")).alias("vals"),
    )


@query("document_term_counts", "SELECT id, word, count(*) AS tf FROM f_tokens GROUP BY id, word")
def _(spark, sf):
    return features.document_term_counts(V.f_text(spark, sf), TEXT, "id")


_VECTOR_TEXT = "array_to_string([CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT) for x in embedding], ' ')"
_ZERO_TEXT = f"array_to_string([0 for i in range({DIM})], ' ')"


@query(
    "embedding_lookup",
    f"""SELECT v.idx, v.word, coalesce({_VECTOR_TEXT}, {_ZERO_TEXT}) AS embedding, f.word IS NOT NULL AS covered
        FROM f_vocab v LEFT JOIN f_vectors f ON v.word = f.word""",
)
def _(spark, sf):
    vocab = _vocabulary(spark, sf)
    matrix = features.embedding_lookup(vocab, _vectors(spark, sf, vocab), DIM)
    return matrix.select("idx", "word", _whole(F.col("embedding")).alias("embedding"), "covered")


_GRAMS = "flatten([[substr('<' || word || '>', s, n) for s in range(1, length(word) + 4 - n)] for n in range(3, 7)])"
_BYTE = "CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT)"


@query(
    "embedding_subwords",
    f"""WITH without AS (SELECT word FROM f_vocab EXCEPT SELECT word FROM f_vectors),
        grams AS (SELECT word, unnest({_GRAMS}) AS gram FROM without),
        codes AS (SELECT word, hex(gram) AS code FROM grams),
        placed AS (
          SELECT word, list_reduce(
              [2166136261] || [{_BYTE} + CASE WHEN {_BYTE} > 127 THEN 4294967040 ELSE 0 END for i in range(len(code) // 2)],
              lambda h, b: (xor(h, b) * 16777619) & 4294967295) % (SELECT max(vec_id) + 1 FROM embeddings) AS bucket
          FROM codes),
        cells AS (
          SELECT word, d, avg(CAST(embedding[d] AS DOUBLE)) AS x
          FROM placed JOIN embeddings ON vec_id = bucket CROSS JOIN (SELECT unnest(range(1, {DIM + 1})) AS d) GROUP BY word, d),
        built AS (
          SELECT word, string_agg(CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR), ' ' ORDER BY d) AS embedding
          FROM cells GROUP BY word)
        SELECT v.idx, v.word, coalesce(b.embedding, {_ZERO_TEXT}) AS embedding, b.word IS NOT NULL AS covered
        FROM f_vocab v JOIN without USING (word) LEFT JOIN built b USING (word)""",
)
def _(spark, sf):
    vocab = _vocabulary(spark, sf)
    vectors = _vectors(spark, sf, vocab)
    table = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("bucket"), "embedding")
    buckets = table.agg(F.max("bucket")).first()[0] + 1
    # Only what is left of the vocabulary is looked up, so that no vector is exchanged to leave words out.
    without = vocab.join(vectors.select("word"), "word", "left_anti")
    matrix = features.embedding_lookup(without, vectors, DIM, table, buckets)
    return matrix.select("idx", "word", _whole(F.col("embedding")).alias("embedding"), "covered")


@query(
    "pool_embeddings",
    f"""WITH v AS (SELECT t.id, t.word, f.embedding FROM f_tokens t LEFT JOIN f_vectors f ON t.word = f.word),
        dims AS (SELECT unnest(range(1, {DIM + 1})) AS d),
        cells AS (SELECT id, d, coalesce(CAST(embedding[d] AS DOUBLE), 0.0) AS x FROM v CROSS JOIN dims)
        SELECT id, CAST(d - 1 AS INTEGER) AS dim, round(max(x), 6) AS maximo, round(avg(x), 5) AS media FROM cells GROUP BY id, d""",
)
def _(spark, sf):
    df, fit = _split(spark, sf)
    vocab = features.fit_vocabulary(fit, TEXT, "id")
    tokens = stage_table(features.encode_counts(df, TEXT, "id", vocab), "counts")
    pooled = features.pool_embeddings(tokens, _vectors(spark, sf, vocab), "id", DIM, times="tf")
    parts = F.arrays_zip(
        F.slice("pooled", 1, DIM).alias("maximo"), F.slice("pooled", DIM + 1, DIM).alias("media")
    )
    return pooled.select("id", F.posexplode(parts).alias("dim", "c")).select(
        "id", "dim", F.round("c.maximo", 6).alias("maximo"), F.round("c.media", 5).alias("media")
    )


# --- training and scoring: no SQL -------------------------------------------------

FIELDS = ["oficio_proc", "tareas_proc"]


def _labelled(spark, sf, *texts):
    df = V.f_split(spark, sf, "id", "aeciuo_2", *texts, "split").filter(F.col("aeciuo_2").isNotNull())
    return df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")


def _predictions(model, test):
    scored = train.predict(model, test, "aeciuo_2")
    return scored.select("id", "codigo_int", F.col("prediction").cast("int").alias("prediccion"))


@query("train_multi_field")
def _(spark, sf):
    fit, test = _labelled(spark, sf, *FIELDS)
    return _predictions(train.train_multi_field(fit, FIELDS, "aeciuo_2", "id"), test)


@query("train_single_field")
def _(spark, sf):
    fit, test = _labelled(spark, sf, TEXT)
    return _predictions(train.train_single_field(fit, TEXT, "aeciuo_2", "id"), test)


@query("train_pooled_embedding")
def _(spark, sf):
    fit, test = _labelled(spark, sf, TEXT)
    vectors = _vectors(spark, sf, _vocabulary(spark, sf))
    return _predictions(train.train_pooled_embedding(fit, TEXT, "aeciuo_2", "id", vectors, DIM), test)


@query("train_linear_svm")
def _(spark, sf):
    fit, test = _labelled(spark, sf, TEXT)
    return _predictions(train.train_linear_svm(fit, [TEXT], "aeciuo_2", "id"), test)


@query("train_two_levels")
def _(spark, sf):
    fit, test = _labelled(spark, sf, TEXT)
    return _predictions(train.train_two_levels(fit, [TEXT], "aeciuo_2", "id"), test)


@query("select_best_model")
def _(spark, sf):
    df = V.f_split(spark, sf, "id", "aeciuo_2", TEXT)
    path = scratch_path(spark, "model")
    _model, losses = train.select_best_model(df, [TEXT], "aeciuo_2", "id", path)
    return spark.createDataFrame(list(enumerate(losses)), "pasada int, perdida double")


@query("compare_strategies")
def _(spark, sf):
    df = V.f_split(spark, sf, "id", "aeciuo_2", TEXT)
    strategies = train.text_strategies(TEXT, "id", MAXLEN, dim=32, passes=4)
    return train.compare_strategies(df, "aeciuo_2", "id", strategies)


@query("score_wave")
def _(spark, sf):
    fit, _test = _labelled(spark, sf, *FIELDS)
    model = train.train_multi_field(fit, FIELDS, "aeciuo_2", "id")
    new = V.f_resp(spark, sf).select("id", "submuestra", "oficio", "tareas")
    return score.score_wave(model, new).select("id", "submuestra", "codigo_int", "dificultad", "pbb_caso")


# --- decoding ---------------------------------------------------------------------


@query(
    "decode_prediction",
    """SELECT p.vec_id, p.codigo_int, k.aeciuo_2, k.glosa FROM f_predictions p LEFT JOIN (
         SELECT f_keys.codigo_int, f_keys.aeciuo_2, glosa FROM f_keys JOIN f_codes ON f_keys.aeciuo_2 = f_codes.aeciuo_2) k
       ON p.codigo_int = k.codigo_int""",
)
def _(spark, sf):
    decoded = score.decode_prediction(V.f_proba(spark, sf), "proba", V.f_keys(spark, sf), V.f_codes(spark, sf))
    return decoded.select("vec_id", "codigo_int", "aeciuo_2", "glosa")


@query("difficulty_ratio", "SELECT vec_id, round(dificultad, 6) AS dificultad FROM f_predictions")
def _(spark, sf):
    ratio = A.difficulty_ratio(F.col("proba"))
    return V.f_proba(spark, sf).select("vec_id", F.round(ratio, 6).alias("dificultad"))


@query("top_probability", "SELECT vec_id, pbb_caso FROM f_predictions")
def _(spark, sf):
    return V.f_proba(spark, sf).select("vec_id", A.top_probability(F.col("proba")).alias("pbb_caso"))


@query(
    "top_k_codes",
    """SELECT vec_id, rank, c.codigo_int, proba, aeciuo_2 FROM (
         SELECT vec_id, CAST(i - 1 AS INTEGER) AS codigo_int, proba,
           CAST(row_number() OVER (PARTITION BY vec_id ORDER BY proba DESC, i) AS INTEGER) AS rank
         FROM (SELECT vec_id, unnest(proba) AS proba, generate_subscripts(proba, 1) AS i FROM f_proba)) c
       JOIN f_keys ON c.codigo_int = f_keys.codigo_int WHERE rank <= 3""",
)
def _(spark, sf):
    return score.top_k_codes(V.f_proba(spark, sf), "proba", "vec_id", 3, V.f_keys(spark, sf))
