"""Removal of repeated byte strings of LENGTH bytes, found with suffix arrays.

1. Anchors. In every window of LENGTH bytes the piece of PIECE bytes with the smallest hash
   is the window's anchor. Equal windows have equal anchors at equal places, so a window
   can only repeat if its anchor does. Runs of windows with one anchor are an interval;
   every window of a text is in exactly one interval.
2. Intervals. Those whose anchor occurs again are cut out of the texts. Equal intervals are
   put together; an interval that occurs twice is repeated as a whole.
3. Shards. Different intervals of one anchor go to one shard, or, if there are very many,
   to several. A shard concatenates its intervals, sorts their suffixes to LENGTH bytes by
   prefix doubling (Larsson and Sadakane) and takes the common prefixes of neighbours
   (Kasai et al.). A window with a neighbour of LENGTH common bytes is repeated.
4. Merging. Shards that share an anchor send one digest for each different window; ranges
   of digests meet in one task, which looks up each shard's sorted digests in the others'
   by binary search.

What moves is anchors (about one per 137 bytes) and the intervals of repeated anchors. The
texts are exchanged once, for cutting and for the result. Nothing is capped: a passage in
a third of all documents has one interval inside and different ones at its ends only.

Defined cases: a null text is an empty text; texts shorter than LENGTH lose nothing; rows
that repeat an id and its text are occurrences of their own, so they lose what is repeated;
null ids are treated as one id; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewave.session import stage_table

LENGTH = 400
PIECE = 128
WINDOWS = LENGTH - PIECE + 1  # pieces in a window
TEXT_PART = 1 << 22  # bytes of a text that are searched for anchors at a time
SHARD_INTERVALS = 2048  # different intervals of one anchor in one shard
TASK_INTERVALS = 20_000  # different intervals in a task that sorts shards
BATCH_BYTES = 1 << 20  # of small shards that are sorted together

_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, and a value for every byte."""
    size = TEXT_PART + LENGTH + 1
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    values = np.random.default_rng(400).integers(1, 1 << 63, 256).astype(np.uint64)
    return up, down, values


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every piece of PIECE bytes."""
    up, down, values = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    x = (sums[PIECE:] - sums[:-PIECE]) * down[: len(data) - PIECE + 1]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours (van Herk)."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def intervals(data: np.ndarray) -> np.ndarray:
    """Rows (anchor hash, first window, windows, place of the anchor) that cover all windows."""
    out = [np.zeros((0, 4), np.int64)]
    for at in range(0, max(len(data) - LENGTH + 1, 0), TEXT_PART):
        part = data[at : at + TEXT_PART + LENGTH - 1]
        hashes = piece_hashes(part)
        keys = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
        place = (_sliding_min(keys, WINDOWS) & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(first, len(place)))
        anchor = place[first]
        out.append(np.stack([hashes[anchor].view(np.int64), first + at, count, anchor - first], axis=1))
    return np.concatenate(out)


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first LENGTH bytes, and the first eight bytes of each.

    Groups of suffixes that agree in h bytes are refined by the rank h bytes further on;
    groups of one are left alone.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    lead = np.zeros(n, np.uint64)
    for j in range(8):
        lead = (lead << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(lead, kind="stable")
    rank = np.zeros(n + LENGTH, np.int64)  # 0 beyond the end
    new = np.concatenate([[True], lead[order][1:] != lead[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    h = 8
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while h < LENGTH and len(open_):
        step = min(h, LENGTH - h)
        suffix = order[open_]
        key = rank[suffix] << 32 | rank[suffix + step]
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[open_] = suffix
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        rank[suffix] = open_[at] + 1
        h += step
        open_ = open_[~(new & np.append(new[1:], True))]
    return order, lead


def repeated_windows(texts: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
    """For each interval which of its windows occurs again in these intervals."""
    text = np.concatenate(texts)
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    counts = np.asarray(counts)
    owned = np.zeros(len(text), bool)
    for s, c in zip(starts, counts):
        owned[s : s + c] = True
    order, lead = suffix_order(text)
    order = order[owned[order]]
    before = np.full(len(text), -1, np.int64)  # the window in front, in the order
    before[order[1:]] = order[:-1]
    common = _common_prefixes(lead, before, starts, counts)
    repeated = np.zeros(len(text), bool)
    again = np.flatnonzero(common >= LENGTH)
    repeated[again] = True
    repeated[before[again]] = True
    return [repeated[s : s + c] for s, c in zip(starts, counts)]


def _common_prefixes(lead, before, starts, counts) -> np.ndarray:
    """Kasai's rule, for all intervals side by side: when a window and its neighbour move on
    together, their common prefix shrinks by one byte at most. Only a part of all suffixes
    is in the order, so the rule is used where the neighbour did move on, and nowhere else.
    Bytes are compared eight at a time."""
    common = np.zeros(len(lead), np.int64)
    last = len(lead) - 1
    h = np.zeros(len(starts), np.int64)
    neighbour = np.full(len(starts), -2)
    for step in range(counts.max()):
        live = np.flatnonzero(counts > step)
        i = starts[live] + step
        j = before[i]
        along = (j >= 0) & (j == neighbour[live] + 1)
        have = np.where(along, np.maximum(h[live] - 1, 0), 0)
        neighbour[live] = np.where(j >= 0, j, -2)
        open_ = np.flatnonzero((j >= 0) & (have < LENGTH))
        while len(open_):
            at = have[open_]
            a, b = i[open_] + at, j[open_] + at
            inside = (a <= last) & (b <= last)
            x = lead[np.minimum(a, last)] ^ lead[np.minimum(b, last)]
            equal = np.where(x == 0, 8, (64 - _bit_length(x)) // 8)
            have[open_] = at + np.where(inside, equal, 0)
            open_ = open_[inside & (x == 0) & (have[open_] < LENGTH)]
        h[live] = have
        common[i] = have
    return common


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Of unsigned 64-bit numbers."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return np.bitwise_count(x).astype(np.int64)


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Bytes covered by windows at sorted starts, as maximal ranges."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > LENGTH)
    first = starts[np.concatenate([[0], gap + 1])]
    last = starts[np.append(gap, len(starts) - 1)] + LENGTH
    return list(zip(first.tolist(), last.tolist()))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, th, t): an id that is never null, a hash of the text and the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    return docs.select(k.alias("k"), F.xxhash64(text).alias("th"), text.alias("t"))


def _find_anchors(rows: DataFrame) -> DataFrame:
    """One row per different text: (digest, m, k, th, n, parts); m texts are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, packed, sizes = [], [], []
            for text in batch.column(2):
                data = (text.as_py() or "").encode("utf-8")
                digests.append(hashlib.md5(data).hexdigest())
                packed.append(intervals(np.frombuffer(data, np.uint8)))
                sizes.append(len(data))
            offsets = pa.array(np.cumsum([0, *[p.size for p in packed]]).astype(np.int32))
            flat = np.concatenate([np.zeros((0, 4), np.int64), *packed]).ravel()
            parts = pa.ListArray.from_arrays(offsets, pa.array(flat))
            columns = [pa.array(digests, pa.string()), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), parts]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "k", "th", "n", "parts"])

    return rows.mapInArrow(run, "digest string, k bigint, th bigint, n bigint, parts array<bigint>")


def _cut(rows: DataFrame) -> DataFrame:
    """(k, th, first, anchor, content, windows, m, bytes) of (k, th, m, t, list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, th, m, text, wanted in zip(*[batch.column(c) for c in range(5)]):
                data = text.as_py().encode("utf-8")
                for w in wanted.as_py():
                    piece = data[w["first"] : w["first"] + w["windows"] + LENGTH - 1]
                    content = hashlib.md5(b"%d:" % w["place"] + piece).hexdigest()
                    out.append((k.as_py(), th.as_py(), w["first"], w["anchor"], content, w["windows"], m.as_py(), piece))
                if len(out) > 20_000:
                    yield _batch(out, _CUT)
                    out = []
            yield _batch(out, _CUT)

    return rows.select("k", "th", "m", "t", "list").mapInArrow(
        run, "k bigint, th bigint, first bigint, anchor bigint, content string, windows bigint, m bigint, bytes binary"
    )


_CUT = pa.schema(
    [
        ("k", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("anchor", pa.int64()),
        ("content", pa.string()), ("windows", pa.int64()), ("m", pa.int64()), ("bytes", pa.binary()),
    ]
)
_RANGE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_SORTED = pa.schema(
    [
        ("anchor", pa.int64()), ("content", pa.string()), ("shard", pa.int32()),
        ("ranges", _RANGE), ("starts", pa.list_(pa.int32())), ("windows", pa.list_(pa.binary())),
    ]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


def _search_shards(shards: DataFrame, tasks: int) -> DataFrame:
    """Sorts every shard (anchor, shard); one row per interval with its repeated ranges.

    Where an anchor has several shards, each different window is sent along by digest.
    """

    def solve(held: list[dict]) -> pa.RecordBatch:
        texts = [np.frombuffer(r["bytes"], np.uint8) for r in held]
        found = repeated_windows(texts, [r["windows"] for r in held])
        sent: set[tuple[int, bytes]] = set()
        out = []
        for row, repeated in zip(held, found):
            starts, windows = [], []
            if row["shards"] > 1:
                for s in range(row["windows"]):
                    w = hashlib.blake2b(row["bytes"][s : s + LENGTH], digest_size=16).digest()
                    if not repeated[s] or (row["anchor"], w) not in sent:
                        starts.append(s)
                        windows.append(w)
                        if repeated[s]:
                            sent.add((row["anchor"], w))
            ranges = [{"a": a, "b": b} for a, b in _ranges(np.flatnonzero(repeated))]
            out.append((row["anchor"], row["content"], row["shard"], ranges, starts, windows))
        return _batch(out, _SORTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, key = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["anchor"], row["shard"]) != key:
                    key = (row["anchor"], row["shard"])
                    if size > BATCH_BYTES:
                        yield solve(held)
                        held, size = [], 0
                held.append(row)
                size += len(row["bytes"])
        if held:
            yield solve(held)

    columns = ["anchor", "shard", "shards", "content", "windows", "bytes"]
    ordered = shards.select(columns).repartition(tasks, "anchor", "shard").sortWithinPartitions("anchor", "shard")
    return ordered.mapInArrow(
        run,
        "anchor bigint, content string, shard int, ranges array<struct<a:bigint,b:bigint>>, "
        "starts array<int>, windows array<binary>",
    )


def _merge_shards(sorted_: DataFrame) -> DataFrame:
    """(anchor, content, start): windows that another shard of their anchor has as well."""
    sent = sorted_.filter(F.size("starts") > 0).select(
        "anchor", "content", "shard", F.explode(F.arrays_zip("starts", "windows")).alias("w")
    )
    sent = sent.select("anchor", "content", "shard", F.col("w.starts").alias("start"), F.col("w.windows").alias("window"))
    sent = sent.withColumn("bin", F.conv(F.hex(F.substring("window", 1, 2)), 16, 10).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key = None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["anchor"], row["bin"]) != key:
                    if held:
                        yield meet(held)
                    held, key = [], (row["anchor"], row["bin"])
                held.append(row)
        if held:
            yield meet(held)

    def meet(held: list[dict]) -> pa.RecordBatch:
        shard = np.array([r["shard"] for r in held])
        window = np.array([r["window"].hex() for r in held])
        hit = np.zeros(len(held), bool)
        lists = {s: np.sort(window[shard == s]) for s in np.unique(shard)}
        for s, mine in lists.items():
            others = shard != s
            place = np.minimum(np.searchsorted(mine, window[others]), len(mine) - 1)
            hit[others] |= mine[place] == window[others]
        rows = [(r["anchor"], r["content"], r["start"]) for r, h in zip(held, hit) if h]
        return _batch(rows, pa.schema([("anchor", pa.int64()), ("content", pa.string()), ("start", pa.int64())]))

    ordered = sent.repartition("anchor", "bin").sortWithinPartitions("anchor", "bin")
    return ordered.mapInArrow(run, "anchor bigint, content string, start bigint")


def find_repeats(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The texts (k, th, t) and ranges to remove (k, th, a, b), not yet merged."""
    rows = _texts(docs, id_col, text_col)
    first = [F.first(c).alias(c) for c in ("th", "n", "parts")]
    different = _find_anchors(rows).groupBy("digest").agg(F.count("*").alias("m"), F.min("k").alias("k"), *first)
    different = stage_table(different, "anchors")
    fields = [F.get("parts", F.col("p") + i).alias(c) for i, c in enumerate(("anchor", "first", "windows", "place"))]
    each = different.filter("size(parts) > 0").select(
        "k", "th", "m", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1, F.lit(4))).alias("p")
    )
    each = each.select("k", "th", "m", *fields)
    # Written, so that both joins by anchor read plain exchanges, whose hot keys are split.
    again = stage_table(each.groupBy("anchor").agg(F.sum("m").alias("n")).filter("n > 1").select("anchor"), "again")
    wanted = each.join(again, "anchor").groupBy("k", "th", "m")
    wanted = wanted.agg(F.collect_list(F.struct("anchor", "first", "windows", "place")).alias("list"))
    # A row that repeats an id and its text is cut again: m is above 1 then in any case.
    cut = stage_table(_cut(rows.join(wanted, ["k", "th"])), "intervals")

    contents = cut.groupBy("anchor", "content", "windows").agg(F.sum("m").alias("n"))
    kinds = contents.groupBy("anchor").agg(F.count("*").alias("kinds"))
    shards = F.ceil(F.col("kinds") / SHARD_INTERVALS).cast("int")
    open_ = stage_table(kinds.filter("kinds > 1").select("anchor", "kinds", shards.alias("shards")), "open")
    body = cut.join(open_.drop("kinds"), "anchor").dropDuplicates(["anchor", "content"])
    body = body.withColumn("shard", F.pmod(F.xxhash64("content"), F.col("shards")).cast("int"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, (open_.agg(F.sum("kinds")).first()[0] or 0) // TASK_INTERVALS)
    sorted_ = stage_table(_search_shards(body, tasks), "shards")

    whole = contents.filter("n > 1").select(
        "anchor", "content", F.lit(0).cast("bigint").alias("a"), (F.col("windows") + LENGTH - 1).alias("b")
    )
    local = sorted_.select("anchor", "content", F.inline("ranges"))
    merged = _merge_shards(sorted_).select(
        "anchor", "content", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b")
    )
    found = whole.union(local).union(merged)
    spans = cut.select("k", "th", "first", "anchor", "content").join(found, ["anchor", "content"])
    spans = spans.select("k", "th", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    # Equal texts were searched once; all of each is repeated.
    copied = different.filter(f"m > 1 AND n >= {LENGTH}").select("digest", "n")
    copies = rows.select("k", "th", F.md5(F.encode("t", "UTF-8")).alias("digest")).join(copied, "digest")
    copies = copies.select("k", "th", F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b")).distinct()
    return rows, spans.union(copies)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``."""
    return with_kept_bytes(docs, id_col, text_col).drop("kept")


def with_kept_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``remove_repeats``, with the remaining bytes of every text in ``kept``."""
    rows, spans = find_repeats(docs, id_col, text_col)
    spans = spans.groupBy("k", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # of one text
    joined = rows.join(spans, ["k", "th"], "left").select("k", "t", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("k", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()),
            ]
        )
        for batch in batches:
            out, size = [], 0
            for k, text, marked in zip(*[batch.column(c) for c in range(3)]):
                data = text.as_py().encode("utf-8")
                kept, at, removed, n = [], 0, 0, 0
                end = -1
                for a, b in sorted((s["a"], s["b"]) for s in marked.as_py() or []):
                    if a > end:
                        n += 1
                        kept.append(data[at:a])
                    removed += max(0, b - max(a, end))
                    end = at = max(end, b)
                rest = b"".join([*kept, data[at:]])
                out.append((k.as_py(), len(data), removed, n, hashlib.sha256(rest).hexdigest(), rest))
            yield _batch(out, schema)

    out = joined.mapInArrow(
        run, "k bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
    no_id = F.lit(-(1 << 63))
    return out.select(F.nullif("k", no_id).alias(id_col), *out.columns[1:])
