"""BPE encoding and decoding over a table of distinct words.

1. Tasks split texts into words as the tokenizer does and pack runs of documents into
   blocks: each block has a list of its distinct words, each document a list of positions
   in it. Blocks are exchanged once, by their key; steps 2 and 3 both read it.
2. Equal words of all blocks meet in one bucket, by hash. A bucket's task holds a table of
   its distinct words, encodes each once and sends the ids back to the blocks by position.
3. The ids that a block uses, each once, meet the pieces of the vocabulary in a join by id.
   Documents take ids and pieces by the positions of their words.

A word costs one encoding however often it occurs, hot words move once per block, and a
block is bounded by ``BLOCK_BYTES`` of distinct words and ``BLOCK_DOCS`` documents.

The texts come from a written table: a task that runs again after a lost executor must
see its rows in the same order. The key of a block depends on all it holds, so blocks of
an order that did change find no words and raise an error; they never take wrong ones.

Defined cases: a null text is an empty text and has no ids; special tokens written out in a
text become their ids; repeated rows give repeated results; a null id stays null; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

BLOCK_DOCS = 4096
BLOCK_BYTES = 4 << 20

# Texts of these characters are in normal form, have plain lower case, and both libraries
# class them alike; other texts are normalised and split by the tokenizer's own parts.
_PLAIN = regex.compile(r"[\x00-\x1B\x20-\u012F\u0131-\u017F]*")


class Splitter:
    """Splits a text into the words that the tokenizer's model sees."""

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        described = json.loads(definition)
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.marks = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True)))
        first = described["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(first["pattern"]["Regex"]).findall
        self.units = _byte_units()
        self.bytes = {c: b for b, c in enumerate(self.units)}
        self.suffix = described["model"]["end_of_word_suffix"] or ""

    def _plain_words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.words(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(self.bytes.__getitem__, part)).decode() for part, _ in parts]

    def split(self, text: str) -> list[str]:
        """Words in order; a special token is a word of its own, in capitals of its own text."""
        if "<|" not in text:
            return self._plain_words(text)
        out: list[str] = []
        for k, part in enumerate(regex.split(self.marks, text)):
            if part is not None and part in self.special:
                out.append("\0" + part)
            elif part:
                out.extend(self._plain_words(part))
        return out

    def encode(self, word: str) -> list[int]:
        if word.startswith("\0") and word[1:] in self.special:
            return [self.special[word[1:]]]
        return [t.id for t in self.model.tokenize("".join(self.units[b] for b in word.encode()))]


@lru_cache(maxsize=1)
def _byte_units() -> list[str]:
    """The public byte-to-character rule: printable bytes stand for themselves, the others
    for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(moved)) for b in range(256)]


@lru_cache(maxsize=2)
def _splitter(definition: str) -> Splitter:
    return Splitter(definition)


def pieces(spark: SparkSession, definition: str) -> DataFrame:
    """(id, piece) of the whole vocabulary, special tokens included."""
    vocabulary = Tokenizer.from_str(definition).get_vocab(with_added_tokens=True)
    frame = pd.DataFrame({"id": list(vocabulary.values()), "piece": list(vocabulary.keys())})
    return spark.createDataFrame(frame.astype({"id": "int32"}), "id int, piece string")


_PACKED = pa.schema(
    [
        ("block", pa.int64()),
        ("words", pa.binary()),
        ("ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())),
        ("places", pa.binary()),
    ]
)


def _squeeze(numbers: list[np.ndarray], text: bytes = b"") -> bytes:
    """Arrays of numbers as planes of equal bytes, as high bytes are mostly alike, and a
    text behind them, compressed."""
    planes = [np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in numbers]
    body = b"".join([*planes, text])
    head = np.array([len(body), *map(len, numbers)], "<u8").tobytes()
    return head + pa.compress(body, "zstd", asbytes=True)


def _unsqueeze(data: bytes, arrays: int) -> tuple[list[np.ndarray], bytes]:
    size, *counts = np.frombuffer(data, "<u8", arrays + 1).tolist()
    body = pa.decompress(data[8 * (arrays + 1) :], size, "zstd", asbytes=True)
    numbers, at = [], 0
    for n in counts:
        planes = np.frombuffer(body, np.uint8, 4 * n, at).reshape(4, n)
        numbers.append(planes.T.copy().view("<u4").ravel())
        at += 4 * n
    return numbers, body[at:]


def _strings(lengths: np.ndarray, text: bytes) -> pa.StringArray:
    """The strings whose UTF-8 bytes stand one behind the other in ``text``."""
    offsets = np.cumsum(np.append(0, lengths), dtype=np.int32)
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(text)])


def _pack(definition: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(definition)
        made = 0

        def block(seen, ids, lengths, places):
            nonlocal made
            made += 1
            coded = [w.encode() for w in seen]
            words = _squeeze([np.fromiter(map(len, coded), np.uint32, len(coded))], b"".join(coded))
            flat = _squeeze([np.concatenate([np.zeros(0, np.int32), *places])])
            key = hashlib.blake2b(repr((TaskContext.get().partitionId(), made, ids)).encode(), digest_size=8)
            key.update(words)
            key.update(flat)
            rows = [[int.from_bytes(key.digest(), "big", signed=True)], [words], [ids], [lengths], [flat]]
            return pa.RecordBatch.from_arrays(
                [pa.array(r, t) for r, t in zip(rows, _PACKED.types)], schema=_PACKED
            )

        seen: dict[str, int] = {}
        ids, lengths, places, size = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = splitter.split(text.as_py() or "")
                for w in dict.fromkeys(words):
                    if w not in seen:
                        seen[w] = len(seen)
                        size += len(w) + 8
                ids.append(key)
                lengths.append(len(words))
                places.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                size += 4 * len(words) // 8
                if size > BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield block(seen, ids, lengths, places)
                    seen, ids, lengths, places, size = {}, [], [], [], 0
        if ids:
            yield block(seen, ids, lengths, places)

    return pack


def _deal(buckets: int):
    """(bucket, block, words): the distinct words of a block by the hash of the word."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column("block").to_pylist(), batch.column("words")):
                (lengths,), text = _unsqueeze(data.as_py(), 1)
                ends = np.cumsum(lengths, dtype=np.int64).tolist()
                coded = [text[a:b] for a, b in zip([0, *ends], ends)]
                bucket = np.fromiter(map(zlib.crc32, coded), np.uint32, len(coded)) % buckets
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = [
                    _squeeze([k, lengths[k]], b"".join([coded[i] for i in k.tolist()]))
                    for k in np.split(order, cuts[1:])
                ] if len(coded) else []
                columns = [bucket[cuts].astype(np.int32), np.full(len(rows), key, np.int64)]
                columns = [*map(pa.array, columns), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "words"])

    return deal


def _encode_words(definition: str):
    """(block, bundle) of rows (bucket, block, words) in the order of their buckets: the
    positions of the words in the block and their ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(definition)
        at, table = None, {}
        for batch in batches:
            bundles = []
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("words")):
                if bucket != at:
                    at, table = bucket, {}
                (k, lengths), text = _unsqueeze(data.as_py(), 2)
                words = _strings(lengths, text).to_pylist()
                for w in words:
                    if w not in table:
                        table[w] = splitter.encode(w)
                ids = [table[w] for w in words]
                counts = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))
                bundles.append(_squeeze([k, counts, flat]))
            columns = [batch.column("block"), pa.array(bundles, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "bundle"])

    return encode


def _open_bundles(bundles: list[bytes]) -> pa.ListArray:
    """The ids of a block's words in the order of their positions."""
    opened = [_unsqueeze(b, 3)[0] for b in bundles]
    k, counts, flat = (np.concatenate([np.zeros(0, np.uint32), *(n[i] for n in opened)]) for i in range(3))
    offsets = np.cumsum(np.append(0, counts), dtype=np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
    return ids.take(pa.array(np.argsort(k)))


def _block_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, id): the ids that a block uses, each once."""
    for batch in batches:
        for key, bundles in zip(batch.column("block").to_pylist(), batch.column("bundles")):
            used = np.unique(_open_bundles(bundles.as_py()).flatten().to_numpy())
            columns = [np.full(len(used), key, np.int64), used]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["block", "id"])


def decode_ids(used: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, pieces): for each key the pieces (id, piece) of its ids, through a join by id.

    The vocabulary is a fixed table of some ten thousand rows and is broadcast; a key has
    at most as many different ids.
    """
    named = used.join(F.broadcast(vocabulary), "id")
    return named.groupBy(key).agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))


def _joined_pieces(ids: pa.ListArray, pieces: pa.StructArray) -> list[str]:
    """The pieces of every word, joined by a blank."""
    order = pc.sort_indices(pieces.field("id"))
    known = pieces.field("id").take(order).to_numpy()
    flat = ids.flatten().to_numpy()
    place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    if not np.array_equal(known[place], flat):
        raise ValueError("an id has no piece in the vocabulary")
    taken = pieces.field("piece").take(order).take(pa.array(place))
    offsets = np.cumsum(np.append(0, pc.list_value_length(ids).to_numpy()), dtype=np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), taken), " ").to_pylist()


_OUT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode_decode(
    docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", output=None
) -> DataFrame:
    """Digest columns of every document, or what ``output`` makes of its ids and pieces.

    ``definition`` is the JSON text of a tokenizer. ``output`` is a pair of a function and
    a schema: the function takes the ids and the joined pieces of a block's words and gives
    a function from the positions of a document's words to a tuple of the schema.
    """
    spark = docs.sparkSession
    make, schema = output or (_digests, _OUT.fields[1:])
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    types = "block bigint, words binary, ids array<bigint>, lengths array<int>, places binary"
    # All columns are read on both ways from here, so that both share the one exchange.
    packed = narrow.mapInArrow(_pack(definition), types).repartition("block")

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = packed.mapInArrow(_deal(buckets), "bucket int, block bigint, words binary")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    bundles = dealt.mapInArrow(_encode_words(definition), "block bigint, bundle binary")
    # One row per block: bounded by what a block may hold.
    lists = bundles.filter("block IS NOT NULL").groupBy("block").agg(F.collect_list("bundle").alias("bundles"))
    named = decode_ids(lists.mapInArrow(_block_ids, "block bigint, id int"), pieces(spark, definition), "block")
    whole = packed.join(lists, "block", "left").join(named, "block", "left")
    fields = T.StructType([T.StructField("id", T.LongType()), *schema])
    arrow = to_arrow_schema(fields)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = _open_bundles(row.column("bundles")[0].as_py() or [])
                texts = _joined_pieces(ids, pc.list_flatten(row.column("pieces"))) if len(ids) else []
                (n_words,) = np.frombuffer(row.column("words")[0].as_py(), "<u8", 1, 8)
                if len(texts) != n_words:
                    raise ValueError("the rows of a task changed when it ran again: write the documents first")
                prepare = make(ids, texts)
                (places,), _ = _unsqueeze(row.column("places")[0].as_py(), 1)
                at, rows = 0, []
                keys = row.column("ids")[0].as_py()
                for key, n in zip(keys, row.column("lengths")[0].as_py()):
                    rows.append((key, *prepare(places[at : at + n])))
                    at += n
                    if len(rows) == 256:
                        yield _rows(rows, arrow)
                        rows = []
                if rows:
                    yield _rows(rows, arrow)

    out = whole.mapInArrow(unpack, fields)
    return out.withColumnRenamed("id", id_col)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _digests(ids: pa.ListArray, texts: list[str]):
    """For the words of a block: a function from positions to the digest columns."""
    counts = np.append(pc.list_value_length(ids).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    numbers = pc.binary_join(ids.cast(pa.list_(pa.string())), " ").to_pylist()

    def prepare(places: np.ndarray) -> tuple[int, str, str]:
        # Without a decoder in the definition, pieces are joined by one blank.
        at = places.tolist()
        joined = " ".join([numbers[p] for p in at])
        text = " ".join([texts[p] for p in at])
        return (
            int(counts[places].sum()),
            hashlib.sha256(joined.encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )

    return prepare


def token_lists(ids: pa.ListArray, texts: list[str]):
    """For the words of a block: a function from positions to the ids and the digest columns."""
    digests = _digests(ids, texts)

    def prepare(places: np.ndarray) -> tuple:
        taken = ids.take(pa.array(places, pa.int64())).flatten()
        return (taken.to_numpy(zero_copy_only=False), *digests(places))

    return prepare


TOKEN_LISTS = (token_lists, [T.StructField("ids", T.ArrayType(T.IntegerType())), *_OUT.fields[1:]])


def read_definition(path: str) -> str:
    """The JSON text of a tokenizer file; the path is the caller's parameter."""
    return Path(path).read_text(encoding="utf-8")
