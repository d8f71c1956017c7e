"""Token ids in files: frequency-ranked ids, byte-aligned variable-length codes, control bytes apart.

Layout of one shard (numbers little-endian)::

    magic b"RKVB" | u32 version | u64 documents | u64 tokens | u64 first token's place in the corpus | u64 documents without id
    i64 x documents: doc_id, ascending, those without id at the end (as 0) | u64 x documents: tokens of each document
    control bytes: 2 bits a token, four tokens a byte, lowest bits first; length of the code less one
    data bytes: each token's rank by falling corpus frequency, 1 to 4 bytes, little-endian
    newline (the end of the record that Spark's writer appends)

A file holds up to `FILE_SHARDS` shards, one after another.  The ranks' table (rank -> id) is a file of its own, u32 each,
in the same folder.  Spark's writer names the files and commits them, so task retries and lost executors leave no partial
ones; where a shard belongs is in its head.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .chunks import ChunkEncoder, groups

MAGIC = b"RKVB"
_HEAD = "<4sIQQQQ"
VERSION = 2
#: With shards of two million tokens, files of some 50 MB, which a task reads one at a time.
FILE_SHARDS = 16
#: Parts of texts whose ids a worker keeps, some 170 bytes each; bytes of text encoded at once.
KEEP, STEP = 1_000_000, 16_000_000

#: For each control byte: the lengths of its four codes, and the bytes they take together.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_TOTAL = _LENGTHS.sum(axis=1, dtype=np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2**32."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    n = len(ranks)
    length = np.ones(n, dtype=np.uint8)
    widest = _widest(int(ranks.max(initial=0)))
    for k in range(1, widest):
        length += ranks >= np.uint32(1 << 8 * k)
    codes = np.zeros(-(-n // 4) * 4, dtype=np.uint8)
    codes[:n] = length - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    raw = (ranks.astype("<u2") if widest <= 2 else ranks).view(np.uint8)
    return control.tobytes(), raw[_used(length, 2 if widest <= 2 else 4)].tobytes()


def _used(length: np.ndarray, width: int) -> np.ndarray:
    """Which bytes of numbers of a width are part of their codes."""
    used = np.ones(len(length) * width, dtype=bool)
    for k in range(1, width):
        used[k::width] = length > k
    return used


def _widest(top: int) -> int:
    return max(1, -(-top.bit_length() // 8))


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Ranks back, by table lookup of the control bytes.  `data` may be longer than the codes."""
    length = _LENGTHS[control].reshape(-1)[:n]
    width = 2 if int(length.max(initial=1)) <= 2 else 4
    out = np.zeros(n * width, dtype=np.uint8)
    out[_used(length, width)] = data[: int(length.sum(dtype=np.int64))]
    return out.view(f"<u{width}").astype(np.uint32)


def data_bytes(control: np.ndarray, n: int) -> int:
    """Length of the data bytes of n codes."""
    return int(_TOTAL[control].sum()) - (-n % 4)


def _tokenizer(path: str) -> ChunkEncoder:
    from array import array

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    spaced = np.zeros(tokenizer.get_vocab_size() + 1, dtype=bool)  # the token begins with a space or line feed
    for piece, i in tokenizer.get_vocab().items():
        spaced[i] = piece[:1] in ("Ġ", "Ċ")

    def whole(xs: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(xs, add_special_tokens=False)]

    def parts(xs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = ["".join(xs[i : i + 64]) for i in range(0, len(xs), 64)]
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        return ids, np.diff(np.flatnonzero(spaced[ids]), append=len(ids))

    return ChunkEncoder(whole, parts, KEEP)


_kept: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of a tokenizers file, one for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _kept:
        _kept[path] = _tokenizer(path)
    return _kept[path]


def _blocks(path: str, end_id: int, wide: bool, shard_tokens: int) -> Callable:
    """Texts in doc_id order -> one row a shard of about so many tokens."""
    dtype = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, block = encoder(path), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        coded: list[np.ndarray] = []  # each document's ids, and the end id
        end = np.array([end_id], dtype=dtype)
        held = inside = 0  # tokens of this block, and of the partition's earlier ones

        def row() -> pa.RecordBatch:
            all_ids = np.concatenate(coded)
            sizes = np.array([len(x) + 1 for x in coded[::2]], dtype="<u8")
            unnamed = docs.count(None)
            keys = [*docs[: len(docs) - unnamed], *[0] * unnamed]
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int64()),
                    "block": pa.array([block], pa.int64()),
                    "inside": pa.array([inside], pa.int64()),
                    "n_docs": pa.array([len(docs)], pa.int64()),
                    "n_tokens": pa.array([int(sizes.sum())], pa.int64()),
                    "n_unnamed": pa.array([unnamed], pa.int64()),
                    "docs": [np.array(keys, dtype="<i8").tobytes()],
                    "sizes": [sizes.tobytes()],
                    "ids": [all_ids.tobytes()],
                    "counts": [np.bincount(all_ids).astype("<u4").tobytes()],
                }
            )

        for batch in batches:
            pa.default_memory_pool().release_unused()
            keys, column = batch.column(0).to_pylist(), batch.column(1)
            for piece in groups(column, STEP):
                ids, begin = encode(column[piece])
                ids = ids.astype(dtype)
                for key, a, b in zip(keys[piece], begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    docs.append(key)
                    coded.append(ids[a:b])
                    coded.append(end)
                    held += b - a + 1
                    if held >= shard_tokens:
                        yield row()
                        docs, coded, held, inside, block = [], [], 0, inside + held, block + 1
        if docs:
            yield row()

    return run


_BLOCKS = "part long, block long, inside long, n_docs long, n_tokens long, n_unnamed long, docs binary, sizes binary, ids binary, counts binary"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for raw in batch.column(0):
            new = np.frombuffer(raw.as_buffer(), dtype="<u4").astype(np.int64)
            short, long = sorted((total, new), key=len)
            long[: len(short)] += short
            total = long
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])


def _packed(order: np.ndarray, wide: bool, before: dict[int, int]) -> Callable:
    rank = np.zeros(int(order.max(initial=0)) + 1, dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], dtype="<u4" if wide else "<u2")
                control, data = pack(rank[ids])
                body = b"".join((struct.pack(_HEAD, MAGIC, VERSION, r["n_docs"], r["n_tokens"], before[r["part"]] + r["inside"], r["n_unnamed"]), r["docs"], r["sizes"], control, data))
                yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["body"])

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shard_tokens: int = 2_000_000) -> None:
    """Tokenise documents and write shard files and the rank table into `folder`.

    Rows are in ascending order of doc_id, those without one at the end; rows of one doc_id by a hash of the text, so that
    they too are dealt out.  Text null or empty: the end id alone.  Repeated rows are all written.  An empty table: no shard.
    Columns other than doc_id and text are not read.  `shard_tokens` bounds the memory of a writing task, and with
    `FILE_SHARDS` that of a reading one, but for one document that is longer.
    """
    spark = docs.sparkSession
    work = tables.Workspace(spark, "token-ids")
    vocabulary = len_vocabulary(tokenizer)
    wide = max(vocabulary, end_id + 1) > 1 << 16
    rows = tables.texts(docs).withColumn("tie", F.xxhash64("text"))
    order = F.col("doc_id").asc_nulls_last(), F.col("tie").asc()
    ordered = rows.repartitionByRange(tables.partitions(spark), *order).sortWithinPartitions(*order)
    blocks = work.put(ordered.mapInArrow(_blocks(tokenizer, end_id, wide, shard_tokens), _BLOCKS), "blocks")

    # At most one row for each id of the vocabulary.
    counts = blocks.select("counts").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    ranked = counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(dtype=np.int64)
    # One row for each partition of the writing job.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).toPandas().sort_values("part")
    before = dict(zip(parts["part"].tolist(), (parts["n"].cumsum() - parts["n"]).tolist(), strict=True))
    coded = blocks.drop("counts").mapInArrow(_packed(ranked, wide, before), "body binary")
    coded.select(F.col("body").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", FILE_SHARDS).text(f"{folder}/shards")
    table = spark.createDataFrame([(bytearray(ranked.astype("<u4").tobytes()),)], "body binary").select(F.col("body").cast("string").alias("value"))
    table.coalesce(1).write.mode("overwrite").text(f"{folder}/ranks")
    work.drop("blocks")


def _unpacked(order: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                data = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                while len(data):
                    shard = parse(data, order)
                    data = data[shard.length + 1 :]
                    ends = np.cumsum(shard.sizes)
                    view = memoryview(shard.ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(view[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), shard.sizes.tolist(), strict=True)]
                    named = pa.array(shard.docs, mask=np.arange(len(shard.docs)) >= len(shard.docs) - shard.unnamed)
                    yield pa.RecordBatch.from_arrays(
                        [named, pa.array(shard.start + ends - shard.sizes), pa.array(shard.sizes), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


class Shard(NamedTuple):
    docs: np.ndarray
    sizes: np.ndarray  # tokens of each document
    start: int  # the first token's place in the corpus
    unnamed: int  # so many documents at the end have no id
    ids: np.ndarray
    length: int  # bytes, without the newline


def parse(data: np.ndarray, order: np.ndarray) -> Shard:
    """The shard that `data` begins with."""
    at = struct.calcsize(_HEAD)
    magic, version, n_docs, n_tokens, start, unnamed = struct.unpack(_HEAD, data[:at].tobytes())
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a shard of this format")
    docs = data[at : at + 8 * n_docs].copy().view("<i8")
    sizes = data[at + 8 * n_docs : at + 16 * n_docs].copy().view("<i8")
    at += 16 * n_docs
    control = data[at : at + -(-n_tokens // 4)]
    at += len(control)
    end = at + data_bytes(control, n_tokens)
    return Shard(docs, sizes, start, unnamed, order[unpack(control, data[at:end], n_tokens)], end)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone; rows in no order."""
    order = np.concatenate([np.frombuffer(bytes(r.content), dtype=np.uint8) for r in _files(spark, f"{folder}/ranks").collect() if len(r.content) > 1] or [np.zeros(1, np.uint8)])
    ids = order[: len(order) // 4 * 4].view("<u4").astype(np.uint32)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return _files(spark, f"{folder}/shards").mapInArrow(_unpacked(ids), schema)


def len_vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
