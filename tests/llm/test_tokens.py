"""Encoders, token files and the byte-level BPE round trip against the libraries themselves."""

from __future__ import annotations

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkring.llm import byte_bpe, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = [" ", "  ", "\n", "\n\n", "\t", " \n", "a", "foo", "Bar.", "it's", "'s", "12", "é", "é.", "»!", "…", "...", "!!", "%%%", " ", " ", "　", "日本", "🙂", "_", "x_", "<|endoftext|>", "\x1c", "\r\n", "'", "dogs'", "²", "Ⅷ."]


def odd_texts(n: int = 400) -> list[str | None]:
    rng = random.Random(5)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(12))) for _ in range(n)]
    out += [" ".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(n)]
    return [None, "", " ", "\n", *out, "word " * 2000, "x" * 3000, "a b"]


def reference_bpe():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chunked_encoding_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    texts = odd_texts()
    encode = token_files._tokenizer(JSON)
    for keep in (400_000, 50):
        encode.keep = keep
        flat, begin = encode(pa.array(texts, pa.string()))
        for k, text in enumerate(texts):
            assert flat[begin[k] : begin[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_parts_are_kept_between_calls():
    """Also long ones, which are not kept, next to others; a vocabulary of 700,000 parts is encoded once."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    rng = random.Random(6)
    parts = ["x" * 300, "é" * 400 + "!", "\u3000" * 300, "ab\ncd", "ef.", *(f"w{i}" for i in range(40))]
    encode = token_files._tokenizer(JSON)
    encode.keep = 30
    for _ in range(40):
        texts = [" ".join(rng.choices(parts, k=9)) for _ in range(4)]
        flat, begin = encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encode, given = token_files._tokenizer(JSON), []
    spaced = encode.spaced
    encode.spaced = lambda xs: given.append(len(xs)) or spaced(xs)
    for k in (0, 1, 0):
        encode(pa.array([" ".join(f"w{i}" for i in range(k * 350_000, (k + 1) * 350_000))]))
    assert 690_000 < sum(given) <= 700_000


def test_serialised_model_equals_the_ranks():
    texts, library = odd_texts(), reference_bpe()
    own = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    flat, begin = own.encode(pa.array(texts, pa.string()))
    back = own.decode(flat, begin)
    for k, text in enumerate(texts):
        assert flat[begin[k] : begin[k + 1]].tolist() == library.encode_ordinary(text or ""), repr(text)
        assert back[k] == (text or "").encode()


@pytest.mark.parametrize("top", [1, 200, 256, 60_000, 70_000, 1 << 31])
def test_variable_length_codes(top):
    ranks = np.random.default_rng(top).integers(0, top, 1003).astype(np.uint32)
    for n in (0, 1, 4, 1003):
        control, data = token_files.pack(ranks[:n])
        codes = np.frombuffer(control, np.uint8)
        assert len(codes) == -(-n // 4) and token_files.data_bytes(codes, n) == len(data)
        assert (token_files.unpack(codes, np.frombuffer(data + b"xx", np.uint8), n) == ranks[:n]).all()


def test_files(spark, tmp_path, monkeypatch):
    """Rows without an id come last, and take no place of the others."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FILE_SHARDS", 3)
    library = Tokenizer.from_file(JSON)
    rows = [(i * 3 - 5, x, "clash") for i, x in enumerate(["one two", None, "", "ten words " * 200, "one two", "é\n\nù"] * 5)]
    docs = spark.createDataFrame(rows + [(None, "no id", "x")] * 2, "doc_id long, text string, start string").repartition(3)
    token_files.write(docs, str(tmp_path / "files"), JSON, shard_tokens=300)
    got = [tuple(r) for r in token_files.read(spark, str(tmp_path / "files")).collect()]
    start, want = 0, []
    for key, text, _ in [*sorted(rows), (None, "no id", ""), (None, "no id", "")]:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((key, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    files = list((tmp_path / "files" / "shards").glob("part-*"))
    assert 1 < len(files) < sum(x.read_bytes().count(token_files.MAGIC) for x in files)


def test_files_of_one_id(spark, tmp_path):
    """All rows of one doc_id are written, and dealt over the partitions by their texts; a long text is one document."""
    rows = [(7, f"text {i}", i) for i in range(200)] + [(7, "same", 0)] * 20 + [(7, "long " * 300_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie int").repartition(3)
    token_files.write(docs, str(tmp_path / "files"), JSON, shard_tokens=300)
    got = token_files.read(spark, str(tmp_path / "files")).collect()
    at = sorted((r["start"], r["n_tokens"]) for r in got)
    assert len(got) == len(rows) and {r["doc_id"] for r in got} == {7} and at[0][0] == 0
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))
    assert len(list((tmp_path / "files" / "shards").glob("part-*"))) > 1


def test_files_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(empty, str(tmp_path / "files"), JSON)
    assert token_files.read(spark, str(tmp_path / "files")).collect() == []


def test_round_trip(spark):
    texts = odd_texts(40)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id"), (1, "again")], "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    library = reference_bpe()
    want = sorted((repr(k), len(ids := library.encode_ordinary(x or "")), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()) for k, x in [*enumerate(texts), (None, "no id"), (1, "again")])
    got = sorted((repr(r[0]), *r[1:]) for r in byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, digests=True).collect())
    assert got == want
    plain = byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    assert plain.columns == ["doc_id", "n_tokens", "ids", "decoded"] and plain.count() == len(want)
    assert byte_bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
