"""The registered queries, over whole tables, against brute force, the libraries, or held-out rows."""

from __future__ import annotations

import collections
import hashlib
import html
import re
import struct
import zlib
from pathlib import Path

import pytest

from sparkring.llm import decontaminate
from sparkring.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


def table(name: str, columns: str) -> list[tuple]:
    return duckdb.sql(f"select {columns} from '{TABLES}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def documents():
    return table("documents", "doc_id, text")


def rows(spark, name: str) -> list:
    return QUERIES[name](spark, str(TABLES)).collect()


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", x)[1]) for x in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_op1(spark):
    pages = dict(table("pages", "page_id, html"))
    got = rows(spark, "op1_html_text")
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])


def test_op2(spark, documents):
    split = {d: (t or "").encode().split() for d, t in documents}
    count = collections.Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
    got = rows(spark, "op2_repeats")
    assert len(got) == len(documents)
    for r in got:
        own = split[r["doc_id"]]
        mark = bytearray(len(own))
        for i in range(len(own) - 34):
            if count[tuple(own[i : i + 35])] > 1:
                mark[i : i + 35] = b"\1" * 35
        kept = [w for w, m in zip(own, mark, strict=True) if not m]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_op3(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = {r["doc_id"]: r for r in rows(spark, "op3_token_files")}, 0
    for key, text in sorted(documents):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(got[key]) == (key, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_op4(spark, documents):
    quality = dict(table("labels", "doc_id, quality"))
    got = rows(spark, "op4_quality")
    assert len(got) == len(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in quality]
    assert sum(r["predicted"] == quality[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_op5(spark, documents):
    got = {(r["doc_id"], r["value_sha256"]) for r in rows(spark, "op5_secrets")}
    planted = re.compile(r'AKIA[A-Z0-9]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}')
    assert got == {(d, hashlib.sha256(m.encode()).hexdigest()) for d, t in documents for m in planted.findall(t or "")}


def test_op6(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{TABLES}/embeddings.parquet'")
    want = con.execute(ORACLES["op6_topk"])
    columns = [c[0] for c in want.description]
    got = QUERIES["op6_topk"](spark, str(TABLES)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_op7(spark, documents):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets, lists, parent = {}, collections.defaultdict(list), {d: d for d, _ in documents}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for d, t in documents:
        w = (t or "").encode().translate(lower).split()
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
        shared = collections.Counter(x for s in sets[d] for x in lists[s])
        for x, n in shared.items():
            if 100 * n >= 85 * (len(sets[d]) + len(sets[x]) - n):
                a, b = sorted((find(d), find(x)))
                parent[b] = a
        for s in sets[d]:
            lists[s].append(d)
    assert {tuple(r) for r in rows(spark, "op7_jaccard")} == {(d, len(s), find(d)) for d, s in sets.items()}


def test_op8(spark, documents):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for d, t in documents:
        ids = library.encode_ordinary(t or "")
        want.add((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {tuple(r) for r in rows(spark, "op8_byte_bpe")} == want


def test_op9(spark, documents):
    lang = dict(table("documents", "doc_id, lang"))
    got = rows(spark, "op9_language")
    assert len(got) == len(documents) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op10(spark, documents):
    plain = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    want = set()
    split = {d: plain(t) for d, t in documents}
    for item, text in table("benchmark", "item_id, text"):
        words = plain(text)
        allowed = decontaminate.allowed(len(words), 0.2)
        for d, own in split.items():
            if len(set(words) - set(own)) > allowed:
                continue
            row = [0] * (len(own) + 1)
            for i, a in enumerate(words, 1):
                new = [i]
                for j, b in enumerate(own, 1):
                    new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
                row = new
            if min(row) <= allowed:
                want.add((d, item))
    assert {(r["doc_id"], r["item_id"]) for r in rows(spark, "op10_decontaminate")} == want
