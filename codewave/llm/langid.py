"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of variable order, learned from a bounded sample
of labelled texts and frozen. A byte is coded in the longest context that the language's
tree has; a byte not seen there costs an escape and is coded in the next shorter context,
with the bytes already ruled out excluded. So every context gives a proper distribution
over 256 bytes, and a text's score in a language is its exact code length in bits. The
language with the shortest code wins, the first by name in a tie.

Counting the contexts is a Spark aggregation; the ``MAX_CONTEXTS`` most frequent contexts
of each language make the model. Scoring walks one tree that unites the contexts of all
languages, for many bytes at a time.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is any
text if no language was learned; null and repeated ids are scored like others; texts of any
length are scored whole, in pieces that share their contexts; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewave.llm.sampling import bounded_sample
from codewave.session import stage_table

ORDER = 4  # bytes of context at most
MAX_CONTEXTS = 6000  # of each language
MIN_CONTEXT = 8  # times that a context must have been seen
SAMPLE_TEXTS = 1000  # labelled texts of each language, whole
PIECE = 1 << 19  # bytes scored at a time
DAMPING = 8.0  # neighbouring bytes are not independent: bits count an eighth in the score


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8"), np.uint8)


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """For every byte its last ``order`` bytes and itself as one number; starts with pads."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for back in range(order, -1, -1):
        out = (out << np.uint64(8)) | data[ORDER - back : len(data) - back].astype(np.uint64)
    return out


def count_contexts(labelled: DataFrame) -> DataFrame:
    """(lang, o, gram, n): how often each byte followed each context of o bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.full(ORDER, 10, np.uint8)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = [_bytes(t.as_py()) for t in batch.column(1)]
            for lang in sorted(set(langs)):
                parts = [_grams_of(t, pad) for t, at in zip(texts, langs) if at == lang]
                for o in range(ORDER + 1):
                    gram, n = np.unique(np.concatenate([p[o] for p in parts]), return_counts=True)
                    names = pa.array([lang] * len(gram), pa.string())
                    orders = pa.array(np.full(len(gram), o, np.int32))
                    columns = [names, orders, pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "o", "gram", "n"])

    counts = labelled.select("lang", "text").mapInArrow(run, "lang string, o int, gram bigint, n bigint")
    return counts.groupBy("lang", "o", "gram").agg(F.sum("n").alias("n"))


def _grams_of(data: np.ndarray, pad: np.ndarray) -> list[np.ndarray]:
    padded = np.concatenate([pad, data])
    return [_grams(padded, o) for o in range(ORDER + 1)]


def learn(labelled: DataFrame, sample: int = SAMPLE_TEXTS, contexts: int = MAX_CONTEXTS) -> dict:
    """The frozen statistics of (id, lang, text): bounded by ``contexts`` per language."""
    chosen = bounded_sample(labelled.filter("lang IS NOT NULL AND text IS NOT NULL"), "id", "lang", sample)
    grams = stage_table(
        count_contexts(chosen).withColumn("ctx", F.shiftrightunsigned("gram", 8)), "contexts"
    )
    totals = grams.groupBy("lang", "o", "ctx").agg(F.sum("n").alias("total"))
    totals = totals.filter((F.col("total") >= MIN_CONTEXT) | (F.col("o") == 0))
    # A shorter context is at least as frequent and comes first in a tie: trees stay whole.
    first = Window.partitionBy("lang").orderBy(F.desc("total"), "o", "ctx")
    kept = totals.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= contexts)
    rows = grams.join(kept.select("lang", "o", "ctx"), ["lang", "o", "ctx"]).select("lang", "o", "gram", "n").toPandas()
    return {
        "langs": sorted(rows["lang"].unique().tolist()),
        "lang": rows["lang"].to_numpy(str),
        "o": rows["o"].to_numpy(np.int64),
        "gram": rows["gram"].to_numpy(np.int64),
        "n": rows["n"].to_numpy(np.float64),
    }


class Trees:
    """One tree of the contexts of all languages, and the cost of every byte in each."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        ctx = model["gram"].view(np.uint64) >> np.uint64(8)
        symbol = (model["gram"] & 255).astype(np.int64)
        key = model["o"].astype(np.uint64) << np.uint64(40) | ctx  # sorted by order first
        keys, node = np.unique(key, return_inverse=True)
        order = (keys >> np.uint64(40)).astype(int)
        size = len(keys)
        self.dead = size
        self.child = np.full((size + 1, 256), size, np.int32)
        parent = np.zeros(size, np.int64)
        for i in range(1, size):  # the parent lacks the oldest byte
            o, c = order[i], int(keys[i]) & ((1 << 40) - 1)
            oldest = c >> (8 * (o - 1))
            parent[i] = np.searchsorted(keys, np.uint64((o - 1) << 40 | (c & ((1 << (8 * (o - 1))) - 1))))
            self.child[parent[i], oldest] = i
        self.bits = np.zeros((size, 256, len(self.langs)), np.float16)
        for k, lang in enumerate(self.langs):
            own = model["lang"] == lang
            p = self._distributions(node[own], symbol[own], model["n"][own], parent, size)
            self.bits[:, :, k] = -np.log2(p)
        self.bits = self.bits.reshape(size * 256, len(self.langs))

    @staticmethod
    def _distributions(node, symbol, n, parent, size) -> np.ndarray:
        counts = np.zeros((size, 256), np.float32)
        counts[node, symbol] = n
        p = np.empty((size, 256), np.float32)
        for i in range(size):
            below = p[parent[i]] if i else np.full(256, 1 / 256, np.float32)
            seen = counts[i] > 0
            kinds = seen.sum()
            if not kinds:
                p[i] = below  # this language hasn't got the context
            elif kinds == 256:
                p[i] = counts[i] / counts[i].sum()
            else:
                whole = counts[i].sum() + kinds
                rest = below * ~seen
                p[i] = np.where(seen, counts[i] / whole, kinds / whole * rest / rest.sum())
        return p

    def cost(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte after the first ORDER ones, in each language."""
        deepest = cursor = np.zeros(len(data) - ORDER, np.int32)
        for back in range(1, ORDER + 1):
            cursor = self.child[cursor, data[ORDER - back : len(data) - back]]
            deepest = np.where(cursor != self.dead, cursor, deepest)
        return self.bits[deepest.astype(np.int64) * 256 + data[ORDER:]]

    def lengths(self, texts: list[np.ndarray]) -> np.ndarray:
        """Code lengths of texts in bits, one row per text."""
        out = np.zeros((len(texts), len(self.langs)))
        group: list[int] = []
        size = 0
        for i, text in enumerate([*texts, None]):
            if group and (text is None or size + len(text) > PIECE):
                self._add(out, texts, group)
                group, size = [], 0
            if text is None:
                break
            if len(text) > PIECE:
                self._add_long(out, i, text)
            elif len(text):
                group.append(i)
                size += len(text)
        return out

    def _add(self, out, texts, group) -> None:
        pad = np.full(ORDER, 10, np.uint8)
        data = np.concatenate([x for i in group for x in (pad, texts[i])])
        sizes = np.array([len(texts[i]) for i in group])
        ends = np.cumsum(sizes + ORDER) - ORDER
        cost = self.cost(data).astype(np.float32)
        for at in ends[:-1]:  # the pads of the next text
            cost[at : at + ORDER] = 0
        out[group] = np.add.reduceat(cost, ends - sizes, axis=0, dtype=np.float64)

    def _add_long(self, out, i, text) -> None:
        data = np.concatenate([np.full(ORDER, 10, np.uint8), text])
        for at in range(0, len(text), PIECE):
            out[i] += self.cost(data[at : at + PIECE + ORDER]).sum(axis=0, dtype=np.float64)


@lru_cache(maxsize=1)
def _trees(broadcast_id: int, holder) -> Trees:
    return Trees(holder.model.value)


class _Holder:
    """Makes a broadcast model a cache key that needs no hashing of the model."""

    def __init__(self, model):
        self.model = model

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other) -> bool:
        return True


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row per row of ``docs``."""
    holder = _Holder(docs.sparkSession.sparkContext.broadcast(model))
    name = hash((len(model["n"]), float(model["n"].sum()), id(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(name, holder)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if trees is not None and trees.langs:
                bits = trees.lengths([_bytes(t) for t in texts])
                weight = np.exp2((bits.min(axis=1, keepdims=True) - bits) / DAMPING)
                best = bits.argmin(axis=1)
                lang = [trees.langs[b] if ok else "und" for b, ok in zip(best, lettered)]
                score = np.where(lettered, 1 / weight.sum(axis=1), 0.0)
            columns = [batch.column(0), pa.array(lang, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = narrow.mapInArrow(run, "id bigint, lang_pred string, score double")
    return scored.withColumnRenamed("id", id_col)
