"""Quality classifier: histogram gradient-boosted trees over document statistics.

Tasks turn every whole text into a short vector of statistics, written once. A bounded
sample of labelled vectors trains the trees: features are binned by quantiles, a level of a
tree is chosen from histograms of gradients, and the finished trees are flattened into
arrays of features, limits and leaves. Scoring follows all trees of a batch at once.

Defined cases: a null text has the statistics of an empty one and is scored; without labels
every score is 0.5, with labels of one kind the trees only tell the prior; rows with a null
label are no labels; a document with several labels counts with each; null and repeated ids
are scored; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewave.llm.sampling import bounded_sample
from codewave.session import stage_table

SAMPLE_ROWS = 20_000  # labelled documents that the trees are fitted on, at most about
BINS = 64
DEPTH = 5
ROUNDS = 100
RATE = 0.1
LEAF_PENALTY = 1.0
MIN_LEAF = 10.0  # weight of a leaf in rows

FEATURES = (
    "log_bytes log_words word_length word_length_spread upper letters digits blanks marks symbols "
    "high_bytes entropy distinct_words distinct_growth top_word marked_words upper_words short_words "
    "log_lines line_length repeated_lines repeated_pairs longest_word sentence_words"
).split()

_CLASS = np.zeros(256, np.int64)  # of a byte
for _name, _range in enumerate(
    [range(65, 91), range(97, 123), range(48, 58), (9, 10, 11, 12, 13, 32), b".,;:'\"-()?", b"#$%&*+/<=>@[]\\^_`{|}~!", range(128, 256)],
    start=1,
):
    _CLASS[list(_range)] = _name


def statistics(text: str) -> np.ndarray:
    """The features of one text, in the order of FEATURES."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    words = text.split()
    lines = text.split("\n")
    n, w = max(len(data), 1), max(len(words), 1)
    share = np.bincount(data, minlength=256) / n
    _, upper, lower, digits, blanks, marks, symbols, high = np.bincount(_CLASS, weights=share, minlength=8)
    used = share[share > 0]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = set(zip(words, words[1:]))
    long_lines = [line for line in lines if line.strip()]
    return np.array(
        [
            np.log1p(len(data)),
            np.log1p(len(words)),
            sizes.mean(),
            sizes.std(),
            upper,
            upper + lower + high,
            digits,
            blanks,
            marks,
            symbols,
            high,
            -(used * np.log2(used)).sum(),
            len(counts) / w,
            len(counts) / np.sqrt(w),
            max(counts.values(), default=0) / w,
            sum(not x[-1].isalnum() for x in words) / w,
            sum(map(str.isupper, words)) / w,
            (sizes < 4).mean(),
            np.log1p(len(lines)),
            n / len(lines),
            1 - len(set(long_lines)) / max(len(long_lines), 1),
            1 - len(pairs) / max(len(words) - 1, 1),
            sizes.max(),
            w / (1 + text.count(". ") + text.count(".\n")),
        ],
        np.float32,
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the features of every row, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(1)]
            flat = np.concatenate([np.zeros(0, np.float32), *rows])
            size = len(FEATURES)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size)
            x = pa.ListArray.from_arrays(offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["id", "x"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id bigint, x array<float>")


class Forest:
    """Boosted trees as flat arrays; a tree is complete and DEPTH levels deep."""

    def __init__(self, prior: float):
        self.prior = prior
        self.feature = np.zeros((0, 2**DEPTH - 1), np.int32)
        self.limit = np.zeros((0, 2**DEPTH - 1), np.float32)
        self.leaf = np.zeros((0, 2**DEPTH), np.float64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.prior)
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Forest:
    """Boosting of the logistic loss; deterministic."""
    if not len(y):
        return Forest(0.0)
    rate = (y.sum() + 1) / (len(y) + 2)
    forest = Forest(float(np.log(rate / (1 - rate))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
    margin = np.full(len(y), forest.prior)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree, at = _grow(binned, cuts, p - y, p * (1 - p))
        trees.append(tree)
        margin += tree[2][at]
    forest.feature, forest.limit, forest.leaf = (np.stack(part) for part in zip(*trees))
    return forest


def _grow(binned, cuts, gradient, weight):
    """One tree and the leaf of every row."""
    feature = np.zeros(2**DEPTH - 1, np.int32)
    limit = np.full(2**DEPTH - 1, np.inf, np.float32)  # rows go left where nothing is gained
    at = np.zeros(len(gradient), np.int64)
    for level in range(DEPTH):
        nodes = 2**level
        best = np.full(nodes, 1e-6)
        choice = np.full((nodes, 2), -1)
        for f, bins in enumerate(binned):
            key = at * BINS + bins
            g = np.bincount(key, gradient, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
            h = np.bincount(key, weight, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
            n = np.bincount(key, minlength=nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
            total_g, total_h, total_n = g[:, -1:], h[:, -1:], n[:, -1:]
            gain = (
                g**2 / (h + LEAF_PENALTY)
                + (total_g - g) ** 2 / (total_h - h + LEAF_PENALTY)
                - total_g**2 / (total_h + LEAF_PENALTY)
            )
            gain[(n < MIN_LEAF) | (total_n - n < MIN_LEAF)] = 0
            gain[:, len(cuts[f]) :] = 0
            cut = gain.argmax(axis=1)
            value = gain[np.arange(nodes), cut]
            better = value > best
            best[better] = value[better]
            choice[better] = np.stack([np.full(nodes, f), cut], axis=1)[better]
        right = np.zeros(len(at), np.int64)
        for node in np.nonzero(choice[:, 0] >= 0)[0]:
            f, cut = choice[node]
            feature[nodes - 1 + node], limit[nodes - 1 + node] = f, cuts[f][cut]
            rows = at == node
            right[rows] = binned[f][rows] > cut
        at = 2 * at + right
    g, h = np.bincount(at, gradient, 2**DEPTH), np.bincount(at, weight, 2**DEPTH)
    return (feature, limit, -RATE * g / (h + LEAF_PENALTY)), at


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Forest:
    """Trees from (id, x) and labels (id, y), on a bounded sample of the labelled rows."""
    chosen = bounded_sample(labels.filter("y IS NOT NULL AND id IS NOT NULL"), "id", None, sample)
    rows = stats.join(chosen, "id").select("id", "y", "x").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    x = rows["x"].combine_chunks()
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float32) if len(rows) else np.zeros(0, np.float32)
    return fit(flat.reshape(-1, len(FEATURES)), rows["y"].to_numpy().astype(np.float64))


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """(id, score) of (id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(x))], ["id", "score"])

    return stats.mapInArrow(run, "id bigint, score double")


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7
) -> DataFrame:
    """(id, score, predicted): labels (id, y) with y 1 for a good document."""
    stats = stage_table(document_statistics(docs, id_col, text_col), "statistics")
    scored = score(stats, train(stats, labels))
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.withColumn("predicted", predicted).withColumnRenamed("id", id_col)


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7
) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns.

    The trees learn from the documents of a bounded sample of the labels (id, y); scoring
    is one pass over the texts in which no row is moved.
    """
    chosen = bounded_sample(labels.filter("y IS NOT NULL AND id IS NOT NULL"), "id", None, SAMPLE_ROWS)
    known = F.broadcast(chosen.select(F.col("id").alias("_id")).distinct())  # SAMPLE_ROWS at most, about
    learned = docs.join(known, docs[id_col] == known["_id"], "left_semi")
    forest = train(document_statistics(learned, id_col, text_col), labels)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(at)]
            x = np.stack(rows) if rows else np.zeros((0, len(FEATURES)), np.float32)
            yield batch.filter(pa.array(forest.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
