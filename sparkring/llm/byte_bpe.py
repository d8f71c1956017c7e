"""Byte-level BPE through a sentencepiece model that is serialised straight from a table of ranks.

Every piece of the vocabulary is written with its bytes mapped to characters, scored by its negative rank, under an
identity normaliser; sentencepiece then merges the best pair first and the leftmost of equals, as the ranks ask.
Nothing is trained.  Texts are cut into pre-tokens by the pattern, and each pre-token is encoded alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tables
from .chunks import ChunkEncoder, gather, groups, runs

#: Bytes 0..255 are the characters U+0100..U+01FF of the model's pieces.
_SHIFT = {b: 0x100 + b for b in range(256)}
_UNKNOWN = ""


def load_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file in rank order; ranks must run from 0 without a gap."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in pieces] != list(range(len(pieces))):
        raise ValueError("ranks have gaps")
    return pieces


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def model(pieces: list[bytes]) -> bytes:
    """The sentencepiece model: id 0 is the unknown piece, id r + 1 the piece of rank r."""

    def entry(text: str, score: float, kind: int) -> bytes:
        return _message(1, _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    unknown, normal, bpe = 2, 1, 2
    body = [entry(_UNKNOWN, 0.0, unknown)]
    body += [entry(p.decode("latin-1").translate(_SHIFT), -float(r), normal) for r, p in enumerate(pieces)]
    none = (1 << 64) - 1  # -1: there is no such piece
    trainer = _number(3, bpe) + _number(4, len(pieces) + 1) + _number(40, 0) + b"".join(_number(k, none) for k in (41, 42, 43))
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(body) + _message(2, trainer) + _message(3, normaliser)


class Codec:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.pieces = load_ranks(path)
        self.ranks = {p: struct.pack("<I", r) for r, p in enumerate(self.pieces)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model(self.pieces))
        self.find = regex.compile(pattern).findall
        self.size = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)
        self.known: dict[str, bytes] = {}
        self.encode = ChunkEncoder(self._encode, lambda xs: runs(self._encode(xs)), keep=150_000)

    def _encode(self, texts: list[str]) -> list[bytes]:
        find = self.find
        parts = [find(x) for x in texts]
        new = list(set().union(*parts).difference(self.known))
        if len(self.known) + len(new) > 100_000:
            self.known.clear()
            new = list(set().union(*parts))
        rest: list[tuple[str, str]] = []
        for x in new:
            raw = x.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[x] = whole
            else:
                rest.append((x, raw.decode("latin-1").translate(_SHIFT)))
        for i in range(0, len(rest), 20_000):
            run = rest[i : i + 20_000]
            ids = self.model.encode([b for _, b in run], num_threads=1)
            flat = np.fromiter((k for x in ids for k in x), dtype="<i8") - 1
            raw = flat.astype("<u4").tobytes()
            at = 0
            for (x, _), own in zip(run, ids, strict=True):
                end = at + 4 * len(own)
                self.known[x] = raw[at:end]
                at = end
        look = self.known.__getitem__
        out = [b"".join(map(look, x)) for x in parts]
        for x in new:
            if len(x) > 256:
                del self.known[x]
        return out

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids; begin: where the runs begin, and the end."""
        data, at = gather(self.flat, self.start, self.size, ids.astype(np.int64))
        raw, at = data.tobytes(), at[begin].tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_kept: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    key = path, pattern
    if key not in _kept:
        _kept[key] = Codec(path, pattern)
    return _kept[key]


def _run(path: str, pattern: str, digests: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            pa.default_memory_pool().release_unused()
            for piece in groups(texts, 3_000_000):
                flat, begin = own.encode(texts[piece])
                raw = flat.tobytes()
                ids = [raw[4 * a : 4 * b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                back = own.decode(flat, begin)
                columns = [keys.slice(piece.start, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if digests:
                    columns += [pa.array(map(sha, ids), pa.string()), pa.array(map(sha, back), pa.string())]
                else:
                    columns += [pa.array(ids, pa.binary()), pa.array([x.decode() for x in back], pa.string())]
                names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def round_trip(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Each document's ids (little-endian unsigned 32-bit) and the text decoded from them, or their SHA-256 digests.

    Null and empty texts have no ids and decode to the empty text.  Rows are kept as they are, repeated or null doc_ids
    included; columns other than doc_id and text are not read.  One pass without a shuffle; memory is bounded by a few
    megabytes of text and the kept parts, or by one text where that is longer.
    """
    names = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return tables.texts(docs).mapInArrow(_run(path, pattern, digests), f"doc_id long, n_tokens long, {names}")
