"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into seven blocks. Two fingerprints that differ in four
bits at most agree in three whole blocks at least, so each one is filed under all 35
triples of blocks, and only fingerprints filed together are compared, by Hamming distance.

Equal fingerprints are joined before anything is compared. A file of up to ``FILE_ROWS``
fingerprints is compared whole and gives a spanning forest of its links, not all pairs. The
members of larger files take an exact way whose cost grows with their number only: each is
written with all its neighbours at two bits or fewer, and two fingerprints at four bits or
fewer share a neighbour. A neighbour has 2,081 owners at most.

Defined cases: a text without words, null included, has fingerprint zero and is linked like
any other; a text with fewer words than a shingle is one shingle; a null id is ignored as a
component's smallest id; repeated rows give repeated results; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewave.llm.components import components
from codewave.session import stage_table

BLOCKS = (9, 9, 9, 9, 9, 9, 10)  # bits
FILE_ROWS = 2048
_SEED = 42

# A sketch for similarity: so many fingerprints side by side, in blocks of 16 bits. At a
# Jaccard similarity of 0.8 two sketches share a block in nine of ten cases, at 0.9 in 99 of
# 100; pairs that differ in fewer bits than there are blocks share one always.
LANES = 8
SKETCH_BLOCKS = 4 * LANES
# Of 512 bits: pairs with similarity 0.8 differ in 78 bits on average, spread 8.
SKETCH_BITS = 88
SKETCH_FILE_ROWS = 4096


def _shingle_hashes(text: str, words_per_shingle: int) -> np.ndarray:
    """XXH64 of every shingle of whole texts, repeats included."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    spans = zip(starts.tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(view[a:b], _SEED) for a, b in spans), "<u8", len(starts))


def fingerprint_text(text: str, words_per_shingle: int) -> int:
    """Majority bits of the hashes of all shingles, as a signed 64-bit number."""
    return int(_majority(_shingle_hashes(text, words_per_shingle)).view(np.int64)[0])


def sketch_text(text: str, words_per_shingle: int) -> np.ndarray:
    """LANES independent fingerprints, from mixes of one hash per shingle."""
    hashes = _shingle_hashes(text, words_per_shingle)
    out = []
    for lane in range(LANES):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * (lane + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(x ^ (x >> np.uint64(31))))
    return np.concatenate(out)


def _majority(hashes: np.ndarray) -> np.ndarray:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """(id, fp), one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint_text(t.as_py() or "", words_per_shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id bigint, fp bigint")


def _files(bits: int) -> list[Column]:
    """The masked fingerprint for every set of blocks that a close pair must share."""
    masks, at = [], 0
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << at)
        at += width
    chosen = [sum(c) for c in combinations(masks, len(BLOCKS) - bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    return [
        F.struct(F.lit(i).cast("tinyint").alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key"))
        for i, m in enumerate(signed)
    ]


def spanning_links(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links at ``bits`` or fewer that connect what all such links connect."""
    values = fps.astype(np.int64).view(np.uint64)
    left = np.arange(len(values))  # not yet reached
    out = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= bits
            reached = left[near]
            out += [(int(fps[at]), int(fps[b])) for b in reached]
            queue += reached.tolist()
            left = left[~near]
    return out


def _balls(distinct: DataFrame) -> DataFrame:
    """(a, b): every fingerprint and the smallest owner of each neighbour at two bits."""
    flips = [0, *(1 << i for i in range(64))]
    flips += [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    flips = np.array(flips, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 64):
                part = fps[at : at + 64].view(np.uint64)
                near = (part[:, None] ^ flips[None, :]).view(np.int64).ravel()
                owner = np.repeat(part.view(np.int64), len(flips))
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(owner)], ["near", "fp"])

    owners = distinct.select("fp").mapInArrow(run, "near bigint, fp bigint").groupBy("near")
    # Distinct fingerprints with one common neighbour at two bits: 2,081 at most.
    shared = owners.agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    return shared.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a != b")


def close_links(distinct: DataFrame, bits: int) -> DataFrame:
    """(a, b) between distinct fingerprints; their components are those of all close pairs."""
    filed = distinct.select("fp", F.explode(F.array(*_files(bits))).alias("f")).select("fp", "f.t", "f.key")
    sizes = stage_table(filed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "files")
    members = filed.join(sizes, ["t", "key"])
    small = members.filter(F.col("n") <= FILE_ROWS).groupBy("t", "key")
    small = small.agg(F.collect_list("fp").alias("fps")).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [p for fps in batch.column(0) for p in spanning_links(fps.values.to_numpy(), bits)]
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    links = small.mapInArrow(run, "a bigint, b bigint")
    if sizes.filter(F.col("n") > FILE_ROWS).isEmpty():
        return links
    crowded = members.filter(F.col("n") > FILE_ROWS).select("fp").distinct()
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return links.union(_balls(crowded).filter(near))


def sketches(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """(id, th, node, sketch): th is a hash of the text, the node the digest of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch_text(t.as_py() or "", words_per_shingle) for t in batch.column(1)]
            nodes = [hashlib.md5(m.tobytes()).hexdigest() for m in made]
            flat = np.concatenate([np.zeros(0, "<u8"), *made]).view(np.int64)
            offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * LANES)
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat))
            columns = [batch.column(0), batch.column(2), pa.array(nodes, pa.string()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "th", "node", "sketch"])

    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), text_hash(text).alias("th"))
    return narrow.mapInArrow(run, "id bigint, th bigint, node string, sketch array<bigint>")


def text_hash(text: Column) -> Column:
    """Tells texts under one id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def similar_links(distinct: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """(a, b) between nodes whose sketches share a block and differ in at most ``bits``.

    A file larger than SKETCH_FILE_ROWS is dealt to chunks, and every pair of chunks is one
    unit of work: nothing is left out, and what a unit emits is a spanning forest.
    """
    blocks = F.array(
        *[F.shiftrightunsigned(F.get("sketch", F.lit(i // 4)), 16 * (i % 4)).bitwiseAND(0xFFFF).cast("int") for i in range(SKETCH_BLOCKS)]
    )
    filed = distinct.select("node", "sketch", F.posexplode(blocks).alias("t", "key"))
    sizes = filed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / SKETCH_FILE_ROWS).cast("int")
    members = filed.join(sizes, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    unit = ["t", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")]
    units = members.select(*unit, "node", "sketch").groupBy("t", "key", "p", "q")
    units = units.agg(F.collect_list("node").alias("nodes"), F.flatten(F.collect_list("sketch")).alias("sketches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for names, flat in zip(batch.column(0), batch.column(1)):
                found = _spanning_sketches(flat.values.to_numpy().view(np.uint64).reshape(-1, LANES), bits)
                names = names.values
                a.append(names.take(pa.array(found[:, 0])))
                b.append(names.take(pa.array(found[:, 1])))
            if a:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(a), pa.concat_arrays(b)], ["a", "b"])

    return units.select("nodes", "sketches").mapInArrow(run, "a string, b string")


def _spanning_sketches(values: np.ndarray, bits: int) -> np.ndarray:
    left, out = np.arange(len(values)), [np.zeros((0, 2), np.int64)]
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]).sum(axis=1, dtype=np.int64) <= bits
            reached = left[near]
            out.append(np.stack([np.full(len(reached), at), reached], axis=1))
            queue += reached.tolist()
            left = left[~near]
    return np.concatenate(out)


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5
) -> DataFrame:
    """The rows of ``docs`` that stay: of documents linked at a similarity of about 0.8 or more,
    directly or over others, the one with the smallest id.

    A document is an id and its text: of texts under one id each is judged by itself, and of two
    that are linked the one with the smaller hash stays. Rows that repeat both stay together or
    go together. Rows with a null id stay. Texts without words are copies of one another.
    """
    rows = stage_table(sketches(docs, id_col, text_col, words_per_shingle), "sketches")
    document = F.when(F.col("id").isNotNull(), F.struct("id", "th"))
    distinct = stage_table(
        rows.groupBy("node").agg(F.min(document).alias("first"), F.first("sketch").alias("sketch")), "distinct"
    )
    roots = components(similar_links(distinct))
    rooted = distinct.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("stays"))
    named = rooted.join(least, "root").select("node", "stays")
    gone = rows.join(named, "node").filter((F.col("id") != F.col("stays.id")) | (F.col("th") != F.col("stays.th")))
    gone = gone.filter(F.col("id").isNotNull()).select(F.col("id").alias("_gone"), F.col("th").alias("_text")).distinct()
    same_text = text_hash(docs[text_col].cast("string")) == gone["_text"]
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & same_text, "left_anti")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 5,
    bits: int = 4,
) -> DataFrame:
    """(id, fingerprint, component_id, fp), one row per row of ``docs``.

    component_id is the smallest id that is reached over links of at most ``bits`` bits.
    """
    assert 0 <= bits < len(BLOCKS)
    rows = stage_table(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    distinct = stage_table(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(close_links(distinct, bits))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
