"""Vocabulary, sequences, TF-IDF and word vectors as long tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from codewave.functions.arrays import pad_sequence
from codewave.functions.text import vocabulary_tokens
from codewave.operators.rank import exact_rank
from codewave.session import block_of, stage_bucketed, stage_table

# 0 is padding, 1 an unknown word, so words start at 2.
UNKNOWN_INDEX, FIRST_INDEX = 1, 2

POOLED_ROWS = 256  # answers of a block that are pooled at a time
SUBWORD_ROWS = 1024  # words that are taken apart at a time
SUBWORD_NUMBERS = 1 << 27  # numbers of bucket vectors that a task holds


def fit_vocabulary(train: DataFrame, col: str, ident: str, tokens: Column | None = None) -> DataFrame:
    """``(word, n, n_docs, idx)``: words by frequency, ties by first appearance, from 2.

    ``tokens`` may give other words of an answer than those of the column; ``ident`` is a unique number.

    Words are counted per batch of answers in Arrow and these counts summed up, so what is
    exchanged are the different words of a batch. The counts are written before they are ranked,
    and the vocabulary is written as well: it is state that scoring needs, and Spark then knows
    its size when it joins to it.
    """
    tokens = vocabulary_tokens(F.col(col)) if tokens is None else tokens
    answers = train.select(F.col(ident).cast("bigint").alias("i"), tokens.alias("words"))
    rows = answers.mapInArrow(_word_counts, "word string, n bigint, n_docs bigint, i bigint, p int")
    counts = rows.groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"), F.min("i").alias("i"), F.min_by("p", "i").alias("p")
    )
    return _ranked(counts)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, n_docs, i, p) of (i, words): how often the answers of a batch have a word, how many
    of them do, and the first of these by number with the word's first position in it."""
    for batch in batches:
        lists, ident = batch.column("words"), batch.column("i")
        words = lists.flatten().dictionary_encode()
        code, k = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        by_number = pc.sort_indices(ident, null_placement="at_end").to_numpy().astype(np.int64)
        place = np.empty(len(sizes), np.int64)
        place[by_number] = np.arange(len(sizes))
        # Each answer and different word once, answers by number, with the word's first position.
        pairs, at = np.unique(np.repeat(place, sizes) * k + code, return_index=True)
        word, first = np.unique(pairs % max(k, 1), return_index=True)  # all of 0 to k - 1
        row = by_number[pairs[first] // max(k, 1)]
        position = at[first] - (np.cumsum(sizes) - sizes)[row]
        n = np.bincount(code, minlength=k), np.bincount(pairs % max(k, 1), minlength=k)
        columns = [words.dictionary, *map(pa.array, n), ident.take(pa.array(row)), pa.array(position.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "n_docs", "i", "p"])


def _ranked(counts: DataFrame) -> DataFrame:
    counts = stage_table(counts, "words")
    ranked = exact_rank(counts, "n", "i", descending=True, tie_break=["p"])
    index = (F.col("rank") + FIRST_INDEX - 1).cast("int").alias("idx")
    return stage_table(ranked.select("word", "n", "n_docs", index), "vocabulary")


def encode_tokens(df: DataFrame, col: str, ident: str, vocab: DataFrame) -> DataFrame:
    """``(ident, pos, idx)``: one row per token, unknown words as 1."""
    tokens = df.select(ident, F.posexplode(vocabulary_tokens(F.col(col))).alias("pos", "word"))
    return tokens.join(vocab.select("word", "idx"), "word", "left").select(
        ident, "pos", F.coalesce("idx", F.lit(UNKNOWN_INDEX)).alias("idx")
    )


def in_blocks(
    df: DataFrame, ident: str, columns: Sequence[str], tokens: Column, known: DataFrame, of_word: Mapping[str, Column]
) -> tuple[GroupedData, GroupedData]:
    """Answers (block, columns, words) and the different words of each block (block, word, of_word).

    Answers are dealt into blocks, once to find their words and once to be read. Only the different
    words of a block are joined to ``known``, so what is exchanged are texts and these words, not a
    row per word of an answer. The words are written, bucketed by block.
    """
    blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = block_of(F.xxhash64(ident), blocks, df.sparkSession).alias("_b")
    kept = [c for c in df.columns if c in {ident, *columns}]
    placed = df.select(block, *kept).repartition(blocks, "_b")
    different = placed.select("_b", F.explode(tokens).alias("word")).distinct()
    found = different.join(known, "word", "left").select("_b", "word", *[c.alias(n) for n, c in of_word.items()])
    found = stage_bucketed(found, "block_words", "_b", blocks)
    answers = placed.select("_b", *kept, tokens.alias("_t"))
    return answers.groupBy("_b"), found.groupBy("_b")


def words_at(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row of its word, for every word of the answers; words of each answer)."""
    lists = left.column("_t").combine_chunks()
    at = pc.index_in(lists.flatten(), value_set=right.column("word").combine_chunks())
    sizes = lists.value_lengths().fill_null(0)
    return at.to_numpy(zero_copy_only=False), sizes.to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _kind(df: DataFrame, col: str) -> str:
    return f"`{col}` {df.schema[col].dataType.simpleString()}"


def encode_sequences(
    df: DataFrame, col: str, ident: str, vocab: DataFrame, out: str = "seq"
) -> DataFrame:
    """``(ident, seq)``: token indices in text order, an empty array for an empty text."""
    index = {"idx": F.coalesce("idx", F.lit(UNKNOWN_INDEX)).cast("bigint")}
    left, right = in_blocks(df, ident, [col], vocabulary_tokens(F.col(col)), vocab.select("word", "idx"), index)

    def coded(answers: pa.Table, words: pa.Table) -> pa.Table:
        at, sizes = words_at(answers, words)
        return pa.table([answers.column(ident), _lists(sizes, words.column("idx").to_numpy()[at])], names=[ident, "idx"])

    sequences = left.cogroup(right).applyInArrow(coded, f"{_kind(df, ident)}, idx array<bigint>")
    return sequences.select(ident, F.col("idx").cast("array<int>").alias(out))


def count_words(
    df: DataFrame, ident: str, columns: Sequence[str], tokens: Column, known: DataFrame, unknown: Column, value: Column, keep: Sequence[str] = ()
) -> DataFrame:
    """``(ident, *keep, idx, tf, value)``: the indices of an answer in order, how often it has each, and
    a number of each.

    ``known`` has (word, idx, value); other words get ``unknown`` and ``value``, which may depend on
    the word. ``tokens`` are the words of ``columns``. Answers without words have empty arrays.
    """
    of_word = {"idx": F.coalesce("idx", unknown).cast("bigint"), "value": F.coalesce("value", value).cast("double")}
    left, right = in_blocks(df, ident, [*columns, *keep], tokens, known, of_word)
    kept = [ident, *keep]

    def counted(answers: pa.Table, words: pa.Table) -> pa.Table:
        at, sizes = words_at(answers, words)
        indices, place = np.unique(words.column("idx").to_numpy(), return_inverse=True)
        largest = np.full(len(indices), -np.inf)
        np.maximum.at(largest, place, words.column("value").to_numpy())
        coded = pa.concat_arrays(answers.column(ident).chunks).dictionary_encode()
        answer = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, tf = np.unique(np.repeat(answer, sizes) * len(indices) + place[at], return_counts=True)
        own, index = np.divmod(pairs, max(len(indices), 1))
        numbers, rows = np.unique(answer, return_index=True)
        rows, n = pa.array(rows), np.bincount(own, minlength=numbers[-1] + 1)[numbers]
        lists = [_lists(n, x) for x in (indices[index], tf.astype(np.int64), largest[index])]
        return pa.table([*(answers.column(c).take(rows) for c in kept), *lists], names=[*kept, "idx", "tf", "value"])

    schema = ", ".join([*(_kind(df, c) for c in kept), "idx array<bigint>, tf array<bigint>, value array<double>"])
    return left.cogroup(right).applyInArrow(counted, schema)


def pad_sequences(df: DataFrame, seq: str, maxlen: int) -> DataFrame:
    return df.withColumn(seq, pad_sequence(F.col(seq), maxlen))


def document_term_counts(df: DataFrame, col: str, ident: str) -> DataFrame:
    """``(ident, word, tf)``: how often a word occurs in an answer."""
    words = df.select(ident, F.explode(vocabulary_tokens(F.col(col))).alias("word"))
    return words.groupBy(ident, "word").agg(F.count(F.lit(1)).alias("tf"))


def encode_counts(df: DataFrame, col: str, ident: str, vocab: DataFrame) -> DataFrame:
    """``(ident, idx, tf)``: how often an answer has each index, unknown words as 1."""
    known = vocab.select("word", "idx", F.lit(0.0).alias("value"))
    counted = count_words(df, ident, [col], vocabulary_tokens(F.col(col)), known, F.lit(UNKNOWN_INDEX), F.lit(0.0))
    each = counted.select(ident, F.explode(F.arrays_zip("idx", "tf")).alias("t"))
    return each.select(ident, F.col("t.idx").cast(vocab.schema["idx"].dataType).alias("idx"), "t.tf")


def tfidf(
    train: DataFrame, df: DataFrame, col: str, ident: str, vocab: DataFrame
) -> DataFrame:
    """``(ident, idx, tfidf)`` with (1 + ln tf) * ln(1 + N / (1 + df)); unknown words have df 0."""
    n_train = train.count()
    known = vocab.select("word", "idx", F.col("n_docs").alias("value"))
    unknown, none = F.lit(UNKNOWN_INDEX), F.lit(0)
    terms = count_words(df, ident, [col], vocabulary_tokens(F.col(col)), known, unknown, none)
    terms = terms.select(ident, F.explode(F.arrays_zip("idx", "tf", "value")).alias("t"))
    weight = (1 + F.log("t.tf")) * F.log(1 + F.lit(float(n_train)) / (1 + F.col("t.value")))
    return terms.select(ident, F.col("t.idx").cast(vocab.schema["idx"].dataType).alias("idx"), weight.alias("tfidf"))


def subword_grams(word: Column, low: int = 3, high: int = 6) -> Column:
    """All runs of ``low`` to ``high`` letters of a word between the marks < and >."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    runs = [
        F.transform(
            F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - n + 1)).otherwise(
                F.array().cast("array<int>")
            ),
            _run(marked, n),
        )
        for n in range(low, high + 1)
    ]
    return F.concat(*runs)


def _run(text: Column, n: int):
    return lambda start: F.substring(text, start, F.lit(n))


def gram_bucket(gram: Column, buckets: int) -> Column:
    """The bucket of a run of letters: FNV-1a of its bytes in 32 bits, modulo the buckets.

    Published sub-word models extend the sign of a byte before they mix it in; so does this.
    """
    code = F.hex(F.encode(gram, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(code), F.lit(2))
    byte = F.transform(places, lambda p: F.conv(F.substring(code, p, F.lit(2)), 16, 10).cast("bigint"))
    signed = F.transform(byte, lambda b: F.when(b > 127, b + 0xFFFFFF00).otherwise(b))
    mixed = F.aggregate(
        signed, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    )
    return mixed % buckets


def _gram_buckets(words: list[str], buckets: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, bucket) of all runs of letters of some words, by place.

    The same numbers as ``subword_grams`` and ``gram_bucket`` give, for many words at a time.
    """
    text = np.frombuffer("".join(f"<{w}>" for w in words).encode(), np.uint8)
    signed = text.astype(np.int8).astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)
    letter = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))  # where letters begin
    letters = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    end = np.cumsum(letters)
    place, bucket = [], []
    for n in range(low, high + 1):
        runs = np.maximum(letters - n + 1, 0)
        of = np.repeat(np.arange(len(words)), runs)
        first = np.arange(len(of)) - (np.cumsum(runs) - runs)[of] + (end - letters)[of]
        at, size = letter[first], letter[first + n] - letter[first]
        mixed = np.full(len(of), 2166136261, np.uint64)
        for i in range(int(size.max(initial=0))):
            more = np.flatnonzero(size > i)
            mixed[more] = ((mixed[more] ^ signed[at[more] + i]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
        place.append(of)
        bucket.append((mixed % np.uint64(buckets)).astype(np.int64))
    place, bucket = np.concatenate(place), np.concatenate(bucket)
    order = np.argsort(place, kind="stable")
    return place[order], bucket[order]


def _run_sums(buckets: int, low: int, high: int):
    """(idx, word, n, total) of rows in the order of (cell, word): first a cell's vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, found, parts = None, np.zeros(0, np.int64), []
        matrix = np.zeros((0, 0))

        def of_words(idx: pa.Array, words: pa.Array) -> pa.RecordBatch:
            place, bucket = _gram_buckets(words.to_pylist(), buckets, low, high)
            at = np.minimum(np.searchsorted(found, bucket), max(len(found) - 1, 0))
            hit = found[at] == bucket if len(found) else np.zeros(len(bucket), bool)
            place, at = place[hit], at[hit]
            have, first, n = np.unique(place, return_index=True, return_counts=True)
            width = matrix.shape[1]
            total = np.add.reduceat(matrix[at].astype(float), first) if len(have) else np.zeros((0, width))
            sizes = np.zeros(len(words), np.int32)
            sizes[have] = width
            counts = np.zeros(len(words), np.int64)
            counts[have] = n
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            totals = pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))
            return pa.RecordBatch.from_arrays([idx, words, pa.array(counts), totals], ["idx", "word", "n", "total"])

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for start, stop in zip(cuts, cuts[1:]):
                if stop == start:
                    continue
                if cells[start] != cell:
                    cell, parts = cells[start], []
                    found, matrix = np.zeros(0, np.int64), np.zeros((0, 0))
                rows = batch.slice(start, stop - start)
                known = rows.filter(pc.is_null(rows.column("word")))
                if known.num_rows:
                    vectors = known.column("v").flatten().to_numpy().reshape(known.num_rows, -1)
                    parts.append((known.column("bucket").to_numpy(), vectors))
                rows = rows.filter(pc.is_valid(rows.column("word")))
                if rows.num_rows and parts:
                    numbers, vectors = (np.concatenate(p) for p in zip(*parts))
                    order = np.argsort(numbers, kind="stable")
                    found, matrix, parts = numbers[order], vectors[order], []
                for k in range(0, rows.num_rows, SUBWORD_ROWS):
                    part = rows.slice(k, SUBWORD_ROWS)
                    yield of_words(part.column("idx"), part.column("word"))

    return sums


def subword_vectors(
    words: DataFrame, subwords: DataFrame, buckets: int, dim: int, low: int = 3, high: int = 6
) -> DataFrame:
    """``(idx, word, embedding)``: the mean of the vectors of a word's runs of letters.

    ``words`` has (idx, word), each word once, ``subwords`` (bucket, embedding), each bucket once.
    The embedding is null for a word none of whose runs has a vector.

    Words are dealt into blocks and the buckets into ranges of ``SUBWORD_NUMBERS`` numbers (most
    tables are one range). A task holds the vectors of a range and takes words as they come, so
    words and each block's share of the table are exchanged, not a vector for every run.
    """
    ranges = max(1, -(-buckets * dim // SUBWORD_NUMBERS))
    blocks = 2 * words.sparkSession.sparkContext.defaultParallelism
    no_word, no_vector = F.lit(None).cast("string"), F.lit(None)
    block = F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int")
    at_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    at_range = F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))
    own_range = (F.col("bucket") * ranges / F.lit(buckets)).cast("int")
    known = subwords.filter(F.col("bucket").between(0, buckets - 1) & F.col("embedding").isNotNull())
    kind = known.schema["embedding"].dataType
    known = known.select(own_range.alias("r"), F.col("bucket").cast("bigint").alias("bucket"), F.col("embedding").alias("v"))
    known = known.select("r", at_block.alias("b"), F.lit(None).cast("bigint").alias("idx"), no_word.alias("word"), "bucket", "v")
    spread = words.select(at_range.alias("r"), block.alias("b"), F.col("idx").cast("bigint").alias("idx"), "word")
    spread = spread.withColumns({"bucket": F.lit(None).cast("bigint"), "v": no_vector.cast(kind)})
    cells = known.unionByName(spread).withColumn("cell", F.col("r") * blocks + F.col("b")).drop("r", "b")
    # Rows of a cell without a word, its vectors, come first.
    cells = cells.repartition(blocks * ranges, "cell").sortWithinPartitions("cell", F.col("word").isNotNull())
    sums = cells.mapInArrow(_run_sums(buckets, low, high), "idx bigint, word string, n bigint, total array<double>")
    if ranges > 1:
        total = array_to_vector(F.when(F.col("n") > 0, F.col("total")).otherwise(F.array_repeat(F.lit(0.0), dim)))
        summed = sums.withColumn("total", total).groupBy("idx", "word").agg(F.sum("n").alias("n"), Summarizer.sum(F.col("total")).alias("total"))
        sums = summed.withColumn("total", vector_to_array("total"))
    each = F.zip_with("total", F.array_repeat(F.col("n"), dim), lambda t, n: t / n)
    idx = F.col("idx").cast(words.schema["idx"].dataType).alias("idx")
    return sums.select(idx, "word", F.when(F.col("n") > 0, each).alias("embedding"))


def embedding_lookup(
    vocab: DataFrame,
    vectors: DataFrame,
    dim: int,
    subwords: DataFrame | None = None,
    buckets: int = 2_000_000,
    low: int = 3,
    high: int = 6,
) -> DataFrame:
    """``(idx, word, embedding, covered)``: zeros for a word without a vector.

    With ``subwords`` (bucket, embedding) a word without a vector of its own gets the mean of
    those of its runs of letters.
    """
    zeros = F.array_repeat(F.lit(0.0), dim)
    own = vectors.select("word", F.col("embedding").cast("array<double>").alias("embedding"))
    joined = vocab.select("idx", "word").join(own, "word", "left").select("idx", "word", "embedding")
    if subwords is not None:
        without = joined.filter(F.col("embedding").isNull()).select("idx", "word")
        built = subword_vectors(without, subwords, buckets, dim, low, high)
        joined = joined.filter(F.col("embedding").isNotNull()).union(built)
    return joined.select(
        "idx", "word", F.coalesce("embedding", zeros).alias("embedding"), F.col("embedding").isNotNull().alias("covered")
    )


def pool_embeddings(
    tokens: DataFrame, vectors: DataFrame, ident: str, dim: int, blocks: int | None = None, times: str | None = None
) -> DataFrame:
    """``(ident, pooled)``: element-wise maximum, then mean, of an answer's word vectors.

    ``tokens`` has one row per token with an index, or one per different token and how often it
    occurs (the column ``times``); an unknown word counts as zeros. Answers are
    dealt into blocks. A block fetches the vector of each of its different words once and pools
    locally, so what is exchanged are word counts and the different words of a block with their
    vectors as they come, not dimensions per token. ``blocks`` is the session's number of
    partitions by default.
    """
    blocks = blocks or int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64(ident), F.lit(blocks)).cast("int").alias("block")
    each = F.lit(1).alias("n") if times is None else F.col(times).alias("n")
    placed = tokens.select(block, ident, "idx", each).repartition(blocks, "block")
    counts = placed.groupBy("block", ident, "idx").agg(F.sum("n").cast("double").alias("w"))
    words = counts.select(F.col("block").alias("at"), F.col("idx").alias("word")).distinct()
    known = vectors.select(F.col("idx").alias("word"), F.col("embedding").alias("v"))
    fetched = words.join(known, "word").select("at", "word", "v")
    id_type = tokens.schema[ident].dataType.simpleString()

    def pool(left: pa.Table, right: pa.Table) -> pa.Table:
        coded = left.column(ident).combine_chunks().dictionary_encode()
        coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
        answer = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        word = right.column("word").to_numpy()
        matrix = np.zeros((len(word) + 1, dim))  # the last row for words without a vector
        if len(word):
            matrix[:-1] = right.column("v").combine_chunks().flatten().to_numpy().reshape(len(word), dim)
        by_word = np.argsort(word)
        wanted = left.column("idx").to_numpy()
        at = np.searchsorted(word[by_word], wanted)
        found = at < len(word)
        found[found] = word[by_word][at[found]] == wanted[found]
        row = np.full(len(wanted), len(word))
        row[found] = by_word[at[found]]
        order = np.argsort(answer, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(answer[order]) != 0]))
        out = []
        for start in range(0, len(first), POOLED_ROWS):
            part = first[start : start + POOLED_ROWS]
            end = first[start + POOLED_ROWS] if start + POOLED_ROWS < len(first) else len(order)
            mine = order[part[0] : end]
            weight = left.column("w").to_numpy()[mine]
            values, begin = matrix[row[mine]], part - part[0]
            mean = np.add.reduceat(values * weight[:, None], begin) / np.add.reduceat(weight, begin)[:, None]
            out.append(np.concatenate([np.maximum.reduceat(values, begin), mean], axis=1))
        pooled = np.concatenate(out)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * 2 * dim, pa.int32()), pa.array(pooled.ravel()))
        return pa.table([left.column(ident).take(pa.array(order[first])), lists], names=[ident, "pooled"])

    pairs = counts.groupBy("block").cogroup(fetched.groupBy("at"))
    return pairs.applyInArrow(pool, f"`{ident}` {id_type}, pooled array<double>")
