"""Removal of repeated phrases of LENGTH words, located by Aho-Corasick automata.

A window is LENGTH consecutive words of a text. Words covered by a window that also starts
earlier (in a smaller id, or further ahead in the same text) are removed; the first occurrence
stays.

1. Copies. Of equal texts only the one with the smallest id is searched; in all others every
   window starts earlier as well.
2. Candidates. In every window the piece of PIECE words with the smallest hash is its anchor.
   Equal windows have equal anchors, so a window can only recur if its anchor does. Anchors
   are counted in Spark; runs of windows with one recurring anchor (intervals) are cut out of
   the texts and equal ones put together, with their number and first place.
3. Confirmation. Different intervals of an anchor meet in one shard. A window that they have
   more than once is a recurring phrase, and its first place is known; an interval that occurs
   again and has no other of its anchor beside it is one phrase as a whole.
4. Automata. Each shard compiles its phrases, as sequences of word numbers, into automata of
   up to BATCH intervals, and streams its intervals through them. As every interval of an
   anchor is routed to its shard, all documents pass by the phrases they may have and no others.
5. Places found go back to every document that has the interval, and ranges of words are cut.

An anchor with more than KINDS different intervals (the end of a passage that very many texts
go on from differently) would fill a shard by itself. Its windows are confirmed by grouping
them by their text and located by joining on it, which splits evenly.

Defined cases: a null text has no words; texts shorter than LENGTH words lose nothing; rows with
one id are ordered by a hash of their text; rows that repeat an id and its text are one
document with one result each; a null id is smaller than all others; an empty table gives an
empty result; other columns are not read. Whole texts are searched, PART bytes at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewave.session import stage_table

LENGTH = 20
PIECE = 5
WINDOWS = LENGTH - PIECE + 1  # pieces in a window
PART = 1 << 22  # bytes, then words, that are hashed at a time
KINDS = 1024  # different intervals of one anchor in a shard
BATCH = 4096  # intervals of one automaton
CUT_ROWS = 10_000  # intervals that are cut out together
SHARD_INTERVALS = 50_000

_NO_ID = -(1 << 63)
_PLACE = np.uint64((1 << 24) - 1)
_CYCLE = 4096  # letters after which the letter weights repeat
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 62, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)


_LETTER = np.where(_SPACE, np.uint64(0), _odd(1, 256))
_WEIGHT = _odd(2, _CYCLE)
_WORD_WEIGHT = _odd(3, PIECE)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every word of a text in bytes."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = at + PART
        while end < len(data) and not _SPACE[data[end]]:
            gap = np.flatnonzero(_SPACE[data[end : end + 4096]])
            end = end + int(gap[0]) if len(gap) else end + 4096
        part = data[at:end]
        letter = ~_SPACE[part]
        starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
        if len(starts):
            size = np.diff(np.append(starts, len(part)))
            place = np.arange(starts[0], len(part)) - np.repeat(starts, size)
            values = _LETTER[part[starts[0] :]] * _WEIGHT[place & (_CYCLE - 1)]
            out.append(_mixed(np.add.reduceat(values, starts - starts[0])))
        at = end
    return np.concatenate(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks of that width."""
    full = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(x) - width + 1], ahead[width - 1 : len(x)])


def intervals(words: np.ndarray) -> np.ndarray:
    """Rows (anchor, first window, windows) that cover all windows of a text's word hashes."""
    out = [np.zeros((0, 3), np.int64)]
    for at in range(0, max(len(words) - LENGTH + 1, 0), PART):
        part = words[at : at + PART + LENGTH - 1]
        pieces = len(part) - PIECE + 1
        hashes = _mixed(sum(part[j : j + pieces] * _WORD_WEIGHT[j] for j in range(PIECE)))
        keys = (hashes & ~_PLACE) | np.arange(pieces, dtype=np.uint64)
        place = (_sliding_min(keys, WINDOWS) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        anchor = hashes[place[first]].view(np.int64) & ~1
        out.append(np.stack([anchor, first + at, np.diff(np.append(first, len(place)))], axis=1))
    return np.concatenate(out)


def _bytes(text) -> np.ndarray:
    return np.frombuffer((text.as_py() or "").encode("utf-8"), np.uint8)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [() for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, th, t): an id that is never null, a hash of the text and the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID))
    return docs.select(k.alias("k"), F.xxhash64(text).alias("th"), text.alias("t"))


def _anchors(rows: DataFrame) -> DataFrame:
    """(digest, k, th, anchors): different anchors of a text, odd if it has them repeatedly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, found = [], []
            for text in batch.column("t"):
                data = _bytes(text)
                digests.append(hashlib.md5(data).digest())
                anchor, times = np.unique(intervals(word_hashes(data))[:, 0], return_counts=True)
                found.append(anchor | (times > 1))
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), batch.column("k"), batch.column("th"), lists], ["digest", "k", "th", "anchors"]
            )

    return rows.mapInArrow(run, "digest binary, k bigint, th bigint, anchors array<bigint>")


_INTERVAL = pa.schema(
    [
        ("k", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("anchor", pa.int64()),
        ("content", pa.binary()), ("phrase", pa.binary()),
    ]
)


def _cut(rows: DataFrame) -> DataFrame:
    """Intervals of (k, th, t, wanted) with a wanted anchor; a text has each phrase once."""

    def parts(k: int, th: int, data: bytes, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        every = intervals(word_hashes(np.frombuffer(data, np.uint8)))
        every = every[np.isin(every[:, 0], wanted)]
        words, seen = data.split(), set()
        for at in range(0, len(every), CUT_ROWS):
            part = every[at : at + CUT_ROWS]
            contents, phrases = [], []
            for first, end in zip(part[:, 1].tolist(), (part[:, 1] + part[:, 2] + LENGTH - 1).tolist()):
                phrase = b" ".join(words[first:end])
                content = hashlib.md5(phrase).digest()
                contents.append(content)
                phrases.append(None if content in seen else phrase)
                seen.add(content)
            n = len(part)
            columns = [np.full(n, k), np.full(n, th), part[:, 1], part[:, 0], contents, phrases]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _INTERVAL.types)], schema=_INTERVAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[pa.RecordBatch] = []
            for k, th, text, wanted in zip(*[batch.column(c) for c in ("k", "th", "t", "wanted")]):
                anchors = wanted.values.to_numpy(zero_copy_only=False)
                for part in parts(k.as_py(), th.as_py(), text.as_py().encode("utf-8"), anchors):
                    held.append(part)
                    if sum(map(len, held)) >= CUT_ROWS:
                        yield pa.concat_batches(held)
                        held = []
            if held:
                yield pa.concat_batches(held)

    return rows.select("k", "th", "t", "wanted").mapInArrow(
        run, "k bigint, th bigint, first bigint, anchor bigint, content binary, phrase binary"
    )


_FOUND = pa.schema(
    [
        ("content", pa.binary()), ("at", pa.int64()), ("windows", pa.int64()),
        ("k", pa.int64()), ("th", pa.int64()), ("first", pa.int64()),
    ]
)


def recurring_phrases(texts: list[tuple], counts: list[int], places: list[tuple]) -> dict[tuple, tuple]:
    """Phrases that recur in the different texts of one anchor, each with its first place.

    A text is a sequence of word numbers, which occurs ``count`` times, first at ``place``. A text
    without another beside it recurs as a whole; of several the windows are compared.
    """
    if len(texts) == 1:
        return {texts[0]: places[0]} if counts[0] > 1 else {}
    seen: dict[tuple, list] = {}
    for text, n, (k, th, first) in zip(texts, counts, places):
        for at in range(len(text) - LENGTH + 1):
            window, place = text[at : at + LENGTH], (k, th, first + at)
            held = seen.get(window)
            if held is None:
                seen[window] = [n, place]
            else:
                held[0] += n
                held[1] = min(held[1], place)
    return {window: place for window, (n, place) in seen.items() if n > 1}


def locate(texts: list[tuple], phrases: dict[tuple, tuple]) -> Iterator[list[tuple[int, int, tuple]]]:
    """For each text (at, windows, place): where phrases start in it, and their first places."""
    if not phrases:
        yield from ([] for _ in texts)
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase, place in phrases.items():
        automaton.add_word(phrase, (len(phrase), place))
    automaton.make_automaton()
    for text in texts:
        yield [(end - n + 1, n - LENGTH + 1, place) for end, (n, place) in automaton.iter(text)]


def _runs(found: list[tuple[int, int, tuple]]) -> list[list]:
    """[at, windows, k, th, first]: neighbours whose first places are neighbours are put together."""
    runs: list[list] = []
    for at, windows, (k, th, first) in found:
        if runs:
            begin, n, *place = runs[-1]
            if at == begin + n and [k, th, first] == [*place[:2], place[2] + n]:
                runs[-1][1] += windows
                continue
        runs.append([at, windows, k, th, first])
    return runs


def _search_shards(contents: DataFrame, shards: int) -> DataFrame:
    """Runs of recurring windows in each different interval."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        anchors, contents, counts, *place, phrases = zip(*held)
        places = list(zip(*place))
        number: dict[bytes, int] = {}
        texts = [tuple([number.setdefault(w, len(number)) for w in p.split(b" ")]) for p in phrases]
        known: dict[tuple, tuple] = {}
        start = 0
        for end in range(1, len(held) + 1):
            if end == len(held) or anchors[end] != anchors[start]:
                known |= recurring_phrases(texts[start:end], counts[start:end], places[start:end])
                start = end
        return _batch([(c, *run) for c, hits in zip(contents, locate(texts, known)) for run in _runs(hits)], _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in columns]):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    columns = ["anchor", "content", "n", "k", "th", "first", "phrase"]
    ordered = contents.select(columns).repartition(shards, "anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(run, "content binary, at bigint, windows bigint, k bigint, th bigint, first bigint")


def _search_crowded(contents: DataFrame) -> DataFrame:
    """The same for intervals of anchors that have very many: by the text of each window."""
    words = F.split(F.col("phrase").cast("string"), " ")
    starts = F.sequence(F.lit(0), F.size(words) - LENGTH)
    windows = F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, LENGTH), " "))
    each = contents.select("content", "n", "k", "th", "first", F.posexplode(windows).alias("at", "window"))
    place = F.struct("k", "th", (F.col("first") + F.col("at")).alias("first"))
    known = each.groupBy("window").agg(F.sum("n").alias("n"), F.min(place).alias("place"))
    known = stage_table(known.filter("n > 1").select("window", "place.*"), "windows")
    one = F.lit(1).cast("bigint").alias("windows")
    at = F.col("at").cast("bigint").alias("at")
    return each.select("content", "at", "window").join(known, "window").select("content", at, one, "k", "th", "first")


def find_phrases(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The texts (k, th, t), and (k, th, spans) of those that are searched.

    A span [a, b) are words of a window that starts earlier as well; spans may overlap. A text
    without a row in the second table is a copy of an earlier one.
    """
    rows = _texts(docs, id_col, text_col)
    first = [F.first(c).alias(c) for c in ("th", "anchors")]
    different = _anchors(rows).groupBy("digest").agg(F.min("k").alias("k"), *first)
    different = stage_table(different.select(F.monotonically_increasing_id().alias("r"), "k", "th", "anchors"), "anchors")

    each = different.select("r", F.explode("anchors").alias("a"))
    each = each.select("r", F.col("a").bitwiseAND(F.lit(-2)).alias("anchor"), (1 + F.col("a").bitwiseAND(F.lit(1))).alias("m"))
    again = stage_table(each.groupBy("anchor").agg(F.sum("m").alias("n")).filter("n > 1").select("anchor"), "again")
    wanted = each.select("r", "anchor").join(again, "anchor").groupBy("r").agg(F.collect_list("anchor").alias("wanted"))
    wanted = wanted.join(different.select("r", "k", "th"), "r").drop("r")
    cut = stage_table(_cut(rows.join(wanted, ["k", "th"])), "intervals")

    # Of equal intervals the first place; the first one of a text has the phrase along with it.
    # Two places are enough to recur, and rows that repeat an id and its text have only one.
    head = F.min(F.struct("k", "th", "first", "phrase")).alias("head")
    tail = F.max(F.struct("k", "th", "first")).alias("tail")
    n = F.when(F.struct("head.k", "head.th", "head.first") == F.col("tail"), 1).otherwise(2).cast("bigint")
    contents = cut.groupBy("anchor", "content").agg(head, tail)
    contents = stage_table(contents.select("anchor", "content", n.alias("n"), "head.*"), "contents")
    crowded = contents.groupBy("anchor").count().filter(F.col("count") > KINDS).select("anchor")
    crowded = stage_table(crowded, "crowded")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(shards, contents.count() // SHARD_INTERVALS)
    found = _search_shards(contents.join(crowded, "anchor", "left_anti"), shards)
    found = stage_table(found.union(_search_crowded(contents.join(crowded, "anchor"))), "found")

    own = cut.select(F.col("k").alias("own_k"), F.col("th").alias("own_th"), F.col("first").alias("own_first"), "content")
    places = own.join(found, "content").withColumn("a", F.col("own_first") + F.col("at"))
    is_first = (F.col("own_k") == F.col("k")) & (F.col("own_th") == F.col("th")) & (F.col("a") == F.col("first"))
    spans = places.filter(~is_first).select(
        F.col("own_k").alias("k"), F.col("own_th").alias("th"), "a", (F.col("a") + F.col("windows") + LENGTH - 1).alias("b")
    )
    spans = spans.groupBy("k", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # of one text
    searched = different.select("k", "th").join(spans, ["k", "th"], "left")
    return rows, searched.withColumn("spans", F.coalesce("spans", F.array()))


def with_kept_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept), one row per row of ``docs``."""
    rows, searched = find_phrases(docs, id_col, text_col)
    joined = rows.join(searched, ["k", "th"], "left").select("k", "t", "spans")
    schema = pa.schema(
        [("k", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text, spans in zip(*[batch.column(c) for c in ("k", "t", "spans")]):
                words = text.as_py().encode("utf-8").split()
                kept, end = [], 0
                if not spans.is_valid:  # a copy
                    ranges = [(0, len(words))] if len(words) >= LENGTH else []
                else:
                    ranges = sorted((s["a"], s["b"]) for s in spans.as_py())
                for a, b in ranges:
                    kept.extend(words[end:a])
                    end = max(end, b)
                kept.extend(words[end:])
                rest = b" ".join(kept)
                removed = len(words) - len(kept)
                out.append((k.as_py(), len(words), removed, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8")))
            yield _batch(out, schema)

    out = joined.mapInArrow(run, "k bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return out.select(F.nullif("k", F.lit(_NO_ID)).alias(id_col), *out.columns[1:])


def remove_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256), one row per row of ``docs``."""
    return with_kept_words(docs, id_col, text_col).drop("kept")
