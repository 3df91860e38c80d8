"""The trie of conversations by their turns, and what sharing its prefixes saves.

1. A turn becomes a token of 24 bytes: 128 bits of the SHA-256 of its role and text, and the
   number of bytes of the text. A conversation is its tokens in turn order, one after another
   (its path); paths in byte order are the trie in depth-first order.
2. Equal paths are put together first, with their number, smallest id and the digest of their
   ids. Ids meet in blocks of neighbouring numbers, so a path that a third of all conversations
   have is spread over blocks; only its blocks, not its ids, meet in one task, where they are
   digested as a stream.
3. Different paths are range-partitioned into shards. A shard sorts its matrix of turn ids,
   padded with zeros and taken a band of columns at a time (``np.lexsort``). Where a row
   differs from the one before it in a column or an earlier one (``logical_or.accumulate``), a
   node starts; ``reduceat`` over the starts sums up each depth.
4. A shard is told the last path of the shard before it and the first of the one behind, so it
   knows which nodes start in it, which paths end in a leaf, and which of its nodes go on in
   another shard. Those boundary nodes are partial sums, and recombine by the digest of
   their prefix. All sums add up: what a node saves is bytes times conversations below it, less
   the bytes of each node counted where it starts.

Defined cases: turns are ordered by number (null first), then by token where numbers tie;
repeated rows are turns of their own; a null role or text is empty; rows without a conversation
id belong to no conversation; an empty table gives no node; other columns are not read. A
conversation is one row of 24 bytes a turn, so it must stay below 2 GB, or 89 million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewave.session import stage_table

TOKEN = 24  # bytes of a turn: 16 of its digest, 8 of its size
HEADS = 5  # conversations that share a beginning
MOST_SHARED = 9  # shared turns are fewer
ID_BLOCK_BITS = 12  # ids that agree above these bits are digested together
SHARD_TURNS = 1 << 16
BAND = 64  # columns of the matrix at a time

EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def _size_hex(text: Column) -> Column:
    return F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0")


def turn_tokens(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, turn, token) of the rows that have a conversation."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    told = F.encode(F.concat(_size_hex(role), role, text), "UTF-8")
    token = F.concat(F.substring(F.sha2(told, 256), 1, 32), _size_hex(text))
    rows = df.select(F.col(conv_col).cast("bigint").alias("c"), F.col(turn_col).alias("turn"), F.unhex(token).alias("token"))
    return rows.filter(F.col("c").isNotNull())


def paths(tokens: DataFrame) -> DataFrame:
    """(c, path): each conversation's tokens in order."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "token")))  # null turns first
    joined = F.array_join(F.transform(ordered, lambda t: F.hex(t["token"])), "")
    return tokens.groupBy("c").agg(F.unhex(joined).alias("path"))


def share_beginnings(convs: DataFrame) -> DataFrame:
    """(c, path) rebuilt: the first h turns of the head, then its own after the first h.

    The head of c is c - c % HEADS (the remainder has the sign of c), and h the checksum of c modulo MOST_SHARED. A head has
    few followers, so the join is even.
    """
    h = (F.crc32(F.encode(F.col("c").cast("string"), "UTF-8")) % MOST_SHARED).cast("int")
    own = convs.withColumns({"head": F.col("c") - F.col("c") % HEADS, "h": h * TOKEN})
    first = F.substring("path", 1, TOKEN * MOST_SHARED).alias("start")
    heads = convs.filter(F.col("c") % HEADS == 0).select(F.col("c").alias("head"), first)
    both = own.join(heads, "head", "left")
    shared = F.coalesce(F.expr("substring(start, 1, h)"), F.lit(b""))
    return both.select("c", F.concat(shared, F.expr("substring(path, h + 1, length(path))")).alias("path"))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """(path, n, conv, ends): conversations of a path, the smallest, the digest of all ids."""
    block = F.shiftright("c", ID_BLOCK_BITS)
    ids = F.array_sort(F.collect_list("c"))
    blocks = convs.groupBy("path", block.alias("block")).agg(ids.alias("ids"))
    blocks = blocks.select(
        "path",
        "block",
        F.size("ids").cast("bigint").alias("n"),
        F.array_min("ids").alias("conv"),
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"),
    )
    schema = pa.schema([("path", pa.binary()), ("n", pa.int64()), ("conv", pa.int64()), ("ends", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            done = []
            for path, n, conv, text in zip(*[batch.column(c).to_pylist() for c in ("path", "n", "conv", "text")]):
                if held and held[0] == path:
                    held[1] += n
                    digest.update(b",")
                else:
                    if held:
                        done.append((*held, digest.hexdigest()))
                    held, digest = [path, n, conv], hashlib.sha256()
                digest.update(text.encode())
            yield _batch(done, schema)
        if held:
            yield _batch([(*held, digest.hexdigest())], schema)

    ordered = blocks.repartition("path").sortWithinPartitions("path", "block")
    return ordered.mapInArrow(run, "path binary, n bigint, conv bigint, ends string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [() for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _turns(path: bytes) -> np.ndarray:
    """Turns x (two halves of the digest, size)."""
    return np.frombuffer(path, ">u8").reshape(-1, 3).astype(np.uint64)


def _band(rows: list[np.ndarray], at: int) -> np.ndarray:
    """Both halves of the ids of the turns at ``at`` and behind, zeros beyond a row's end."""
    matrix = np.zeros((len(rows), BAND, 2), np.uint64)
    for i, row in enumerate(rows):
        part = row[at : at + BAND, :2]
        matrix[i, : len(part)] = part
    return matrix


def sort_rows(rows: list[np.ndarray]) -> np.ndarray:
    """The order of the rows, a row before those it begins; later bands are sorted first."""
    lengths = np.array([len(r) for r in rows])
    order = np.zeros(0, np.int64)
    for at in range((max(lengths.max(), 1) - 1) // BAND * BAND, -1, -BAND):
        ending = np.flatnonzero((lengths > at) & (lengths <= at + BAND))
        if at == 0:
            ending = np.flatnonzero(lengths <= BAND)
        order = np.concatenate([ending, order])
        keys = _band([rows[i] for i in order], at).reshape(len(order), -1)
        order = order[np.lexsort(keys.T[::-1])]
    return order


def common_depths(rows: list[np.ndarray]) -> np.ndarray:
    """Turns that each sorted row has in common with the one before it; the first has none."""
    lengths = np.array([len(r) for r in rows])
    common = np.zeros(len(rows), np.int64)
    live, at = np.arange(1, len(rows)), 0
    while len(live):
        mine, before = _band([rows[i] for i in live], at), _band([rows[i - 1] for i in live], at)
        changed = np.logical_or.accumulate((mine != before).any(axis=2), axis=1)
        inside = np.minimum(np.minimum(lengths[live], lengths[live - 1]) - at, BAND)
        same = np.minimum((~changed).sum(axis=1), inside)
        common[live] += same
        live, at = live[same == BAND], at + BAND
    return common


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero((a[:n, :2] != b[:n, :2]).any(axis=1))
    return int(differ[0]) if len(differ) else n


def _prefix_digests(path: bytes, depth: int) -> list[bytes]:
    """Digest of every prefix of 0 to ``depth`` turns."""
    running, out = hashlib.sha256(), []
    for d in range(depth + 1):
        out.append(running.digest()[:16])
        running.update(path[d * TOKEN : (d + 1) * TOKEN])
    return out


_NODES = pa.schema(
    [
        ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
        ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()),
    ]
)
_NODE_TYPES = (
    "depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, key binary, parent_key binary"
)


def shard_nodes(shard: pa.Table) -> pa.Table:
    """The nodes of a shard; those with a ``key`` go on in another shard."""
    return pa.Table.from_batches(_nodes_by_depth(shard), schema=_NODES)


def _nodes_by_depth(shard: pa.Table) -> Iterator[pa.RecordBatch]:
    side = shard.column("side").to_numpy()
    path = shard.column("path").to_pylist()
    inside = np.flatnonzero(side == 0)
    rows = [_turns(path[i]) for i in inside]
    if not rows:
        return
    order = sort_rows(rows)
    inside, rows = inside[order], [rows[i] for i in order]
    n, conv = (shard.column(c).to_numpy()[inside] for c in ("n", "conv"))
    ends = np.array(shard.column("ends").to_pylist(), object)[inside]
    lengths = np.array([len(r) for r in rows])

    around = {s: _turns(path[i]) for i, s in enumerate(side) if s}
    common = common_depths(rows)
    common[0] = _common(around[-1], rows[0]) if -1 in around else -1
    behind = _common(around[1], rows[-1]) if 1 in around else -1
    leaf = (np.append(common[1:], behind) < lengths).astype(np.int64)
    first_keys = _prefix_digests(path[inside[0]], common[0])
    last_keys = _prefix_digests(path[inside[-1]], behind)

    # Bytes up to a depth, all rows behind one another; a row has a place for depth 0.
    offset = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    flat = np.concatenate([np.concatenate([[0], r[:, 2].astype(np.int64)]) for r in rows])
    upto = np.cumsum(flat)
    upto -= np.repeat(upto[offset] - flat[offset], lengths + 1)
    total = upto[offset + lengths]

    above = np.full(len(rows), -1)  # the smallest conversation of the node above
    above_key = np.full(len(rows), None, object)
    for depth in range(lengths.max() + 1):
        live = np.flatnonzero(lengths >= depth)
        starts = common[live] < depth
        group = np.flatnonzero(starts | (np.arange(len(live)) == 0))
        gross = n[live] * (total[live] - upto[offset[live] + max(depth - 1, 0)])
        own = total[live] - upto[offset[live] + np.maximum(max(depth - 1, 0), common[live])]
        child = (lengths[live] > depth) & (common[live] <= depth)
        smallest = np.minimum.reduceat(conv[live], group)
        first = live[group]
        keys = np.full(len(group), None, object)
        if live[0] == 0 and depth <= common[0]:
            keys[0] = first_keys[depth]
        if live[-1] == len(rows) - 1 and depth <= behind:
            keys[-1] = last_keys[depth]
        digest = [ends[i] if lengths[i] == depth else (None if k else EMPTY_DIGEST) for i, k in zip(first, keys)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(group), depth)),
                pa.array(smallest),
                pa.array(above[first], mask=(above_key[first] != None) | (depth == 0)),  # noqa: E711
                pa.array(np.add.reduceat(n[live], group)),
                pa.array(np.add.reduceat(child.astype(np.int64), group)),
                pa.array(np.add.reduceat(leaf[live], group)),
                pa.array(np.add.reduceat(gross - own, group)),
                pa.array(digest, pa.string()),
                pa.array(keys.tolist(), pa.binary()),
                pa.array(above_key[first].tolist(), pa.binary()),
            ],
            schema=_NODES,
        )
        size = np.diff(np.append(group, len(live)))
        above[live] = np.repeat(smallest, size)
        above_key[live] = np.repeat(keys, size)


def trie_nodes(distinct: DataFrame) -> DataFrame:
    """The nodes of the trie of (path, n, conv, ends), which is a written table."""
    spark = distinct.sparkSession
    turns = distinct.agg(F.sum(F.length("path") / TOKEN + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(turns) // SHARD_TURNS + 1)
    placed = distinct.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id())
    placed = stage_table(placed, "shards")

    # One line per shard.
    ends = placed.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    order = Window.orderBy("shard")
    before = ends.select("shard", F.lit(-1).alias("side"), F.lag("high").over(order).alias("path"))
    behind = ends.select("shard", F.lit(1).alias("side"), F.lead("low").over(order).alias("path"))
    around = before.union(behind).filter(F.col("path").isNotNull())
    rows = placed.withColumn("side", F.lit(0)).unionByName(around, allowMissingColumns=True)
    nodes = stage_table(rows.groupBy("shard").applyInArrow(shard_nodes, _NODE_TYPES), "nodes")

    whole = nodes.filter(F.col("key").isNull())
    parts = nodes.filter(F.col("key").isNotNull()).groupBy("depth", "key", "parent_key")
    sums = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    boundary = parts.agg(
        F.min("conv_id").alias("conv_id"), *sums.values(), F.coalesce(F.max("ends_sha256"), F.lit(EMPTY_DIGEST)).alias("ends_sha256")
    )
    boundary = stage_table(boundary, "boundary")
    parents = boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    inner = whole.filter(F.col("parent_key").isNull()).drop("key", "parent_key")
    outer = whole.filter(F.col("parent_key").isNotNull()).unionByName(boundary, allowMissingColumns=True)
    outer = outer.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("_parent"))
    return inner.unionByName(outer.select(*inner.columns))


def build_trie(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    share: bool = True,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ``share`` rebuilds the conversations with their head's turns."""
    convs = paths(turn_tokens(df, conv_col, turn_col, role_col, text_col))
    if share:
        convs = share_beginnings(convs)
    distinct = stage_table(distinct_paths(convs), "paths")
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return trie_nodes(distinct).select(*names)
