"""Top-k search against all products; page text on templates; decontamination, language, quality and secrets."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkring.llm import decontaminate, fold, html_text, language, quality, secrets, topk, words

# Exact top-k search


def brute(rows, k, scale=64):
    use = [(i, np.floor(scale * np.asarray(v, float))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, q in use:
        if i % 20 or i in seen:
            continue
        seen.add(i)
        best = sorted((-int(q @ c), j) for j, c in use if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,dims,k", [(300, 40, 20), (15, 5, 20), (200, 16, 3)])
def test_top_k(spark, n, dims, k):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, dims)]) for i in range(n)]
    rows[7] = (7, rows[0][1])
    rows += [(1000, None), (1020, []), (1040, [float("nan")] * dims), (1060, [float("inf"), *[0.0] * (dims - 1)]), (None, rows[0][1])]
    rows += [(40, rows[40][1] if n > 40 else rows[0][1]), (33, rows[0][1]), (34, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    for block in (4096, 5):
        got = topk.search(frame, F.col("vec_id") % 20 == 0, k=k, query_block=block).collect()
        if n > 40:
            assert sorted(map(tuple, got)) == brute(rows, k)
        else:
            assert {tuple(r) for r in got} >= {x for x in brute(rows[:n], k) if x[0] not in (40,) and x[1] == 0}


def test_top_k_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(none, F.col("vec_id") % 20 == 0).collect() == []


def test_sparse_and_dense_phases_agree(monkeypatch):
    rng = np.random.default_rng(1)
    ids, v = np.arange(400), np.floor(64 * rng.normal(0, 0.2, (400, 48)))
    results = []
    for dense in (0.0, 0.02, 2.0):
        monkeypatch.setattr(topk, "DENSE", dense)
        own = topk.Search(ids[:30], v[:30], 5, topk._seed(ids[:30], v[:30], 5))
        own.add(ids, v)
        results.append([x.tolist() for x in own.found])
    assert results[0] == results[1] == results[2]


# Page text

ARTICLE = "<article><h1>Title &amp; more</h1><p>First  paragraph\nwith <a href=x>a link</a> &eacute;&#33;</p><div>Second <b>bold</b></div><ul><li>point</li></ul><p>Be.</p></article>"
TEXT = "Title & more\n\nFirst paragraph with a link é!\n\nSecond bold\n\npoint\n\nBe."
AROUND = [
    "<nav><ul><li><a href=/>Home</a></li></ul></nav>",
    "<header><h2>Site name</h2><p>Our motto is long enough to look like a paragraph of text.</p></header>",
    "<div class='sidebar-left'><p>Read our other articles about many things of interest.</p></div>",
    "<aside>Also <p>interesting</p></aside>",
    "<div id=cookie-notice>We use cookies to make this page better for you.</div>",
    "<form><label>Name</label><input><button>Send</button></form>",
    "<section class='comments'><article class='comment'><p>I do not agree with any of this at all.</p></article></section>",
    "<div role=complementary>Related</div><div class=ad>Buy now, it is cheap and good</div>",
    "<script>var x = '<p>no</p>';</script><style>p{}</style><!-- <p>hidden</p> -->",
    "<footer>&copy; the site</footer>",
]


@pytest.mark.parametrize("seed", range(20))
def test_article_among_boilerplate(seed):
    rng = random.Random(seed)
    before, after = ([x for x in rng.sample(AROUND, 5)] for _ in range(2))
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{''.join(before)}{ARTICLE}{''.join(after)}</body></html>"
    assert html_text.main_text(page) == TEXT
    assert html_text.main_text(page.replace("</body></html>", "")) == TEXT
    assert html_text.main_text(page.upper().replace("&AMP;", "&amp;").replace("&EACUTE;", "&eacute;")) == TEXT.upper().replace("É", "é")


def test_advert_inside_the_article():
    page = ARTICLE.replace("<div>Second", "<div class='ad-box'>Advert text</div><div>Second")
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize("tag", ["article", "main"])
def test_links_inside_an_article(tag):
    links = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(7))
    body = f"<h1><a href=x>Title</a></h1><p>Text.</p><ul>{links[: 3 * len(links) // 7]}</ul><p>More.</p><ul>{links}</ul><p>End.</p><p><a href=y>Last</a></p>"
    want = ["Title", "Text.", *(f"Link {i}" for i in range(3)), "More.", *(f"Link {i}" for i in range(7)), "End.", "Last"]
    page = f"<body>{AROUND[0]}<div><a href=/>Home</a></div><{tag}>{body}</{tag}><article><a href=z>Other</a></article>{AROUND[-1]}</body>"
    assert html_text.main_text(page) == "\n\n".join(want)
    inner = f"<main><ul>{links}</ul><article>{body}</article><ul>{links}</ul></main>"
    assert html_text.main_text(inner) == "\n\n".join(want)


def test_pages_without_an_article():
    body = "".join(f"<p>{'Words of a longer paragraph ' * 6}{i}.</p>" for i in range(4))
    menu = "<div><a href=1>One</a> <a href=2>Two</a></div>" * 5
    page = f"<html><body>{menu}<div>{body}</div>{menu}</body></html>"
    assert html_text.main_text(page) == "\n\n".join(f"{'Words of a longer paragraph ' * 6}{i}." for i in range(4))
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<nav>menu</nav>") == html_text.main_text("") == html_text.main_text(None) == ""
    assert html_text.main_text("<p>a<br>b&nbsp;c <unclosed") == "a b c <unclosed"


def test_adverts_without_an_article():
    long, ad, legal = f"<p>{'Words of a longer paragraph ' * 6}.</p>", "<div class=ad>Buy now, it is cheap and good</div>", "<p>Short text</p><p>of the site</p>"
    text = f"{'Words of a longer paragraph ' * 6}."
    page = f"<body><div><h1>Head</h1>{long}{ad}<h2>Part</h2><p>Short.</p>{ad}<p><a href=x>Link</a></p>{ad}<div>Short closing sentence.</div></div></body>"
    assert html_text.main_text(page) == f"Head\n\n{text}\n\nPart\n\nShort.\n\nLink\n\nShort closing sentence."
    assert html_text.main_text(f"<body><p>First.</p>{ad}{long}</body>") == f"First.\n\n{text}"
    assert html_text.main_text(f"<body><div><div>{long}</div>{ad}<div>Short.</div></div></body>") == f"{text}\n\nShort."
    assert html_text.main_text(f"<body><div><section>{long}</section>{ad}<section><h2>Part</h2><p>Short.</p></section></div></body>") == f"{text}\n\nPart\n\nShort."
    assert html_text.main_text(f"<body><div>{long}{long}</div>{ad}<div>{legal}</div></body>") == f"{text}\n\n{text}"
    assert html_text.main_text(f"<div><p>One.</p>{ad}<p>Two.</p></div>") == "One.\n\nTwo."


def test_pages(spark):
    rows = [(1, "u", f"<html><body>{ARTICLE}</body></html>", "x"), (None, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "v", ARTICLE * 300, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {repr(r["page_id"]): r for r in html_text.extract(pages).collect()}
    assert got["1"]["text"] == TEXT and got["1"]["n_chars"] == len(TEXT) and got["None"]["text"] == "" and got["3"]["n_chars"] > 300 * len(TEXT)
    assert html_text.extract(pages).count() == 5 and html_text.extract(pages.limit(0)).count() == 0


# Decontamination


def edit_distance(item: list, text: list) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(40))
def test_distance(seed):
    rng = np.random.default_rng(seed)
    item, text = (rng.integers(0, 4, rng.integers(1, 15)).astype(np.uint64) for _ in range(2))
    edits, start, end = decontaminate.distance(item, text)
    assert edits == edit_distance(item.tolist(), text.tolist())
    assert 0 <= start <= end <= len(text) and edit_distance(item.tolist(), text[start:end].tolist()) == edits


def test_passages(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 50)))) for i in range(30)] + [(90, None), (91, ""), (92, "tiny item"), (92, "tiny item"), (None, "one more item that has no id of its own")]
    docs, want = [(0, None), (1, ""), (2, "nothing here"), (3, "a TINY, item!"), (4, "tiny other item")], {(3, 92)}
    for k in range(5, 205):
        item, text = items[rng.randrange(30)]
        own, allowed = text.split(), decontaminate.allowed(len(text.split()), 0.2)
        edits = rng.randrange(0, 2 * allowed + 1)
        for _ in range(edits):
            at, kind = rng.randrange(len(own)), rng.randrange(3)
            own[at : at + 1] = [[word()], [word(), own[at]], []][kind]
        filler = [word() for _ in range(rng.randrange(80))]
        at = rng.randrange(len(filler) + 1)
        whole = [*filler[:at], *own, *filler[at:]]
        docs.append((k, " ".join(x.upper() + rng.choice(["", "!!", "."]) for x in whole)))
        if edit_distance(text.split(), whole) <= allowed:
            want.add((k, item))
    frame = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id long, text string, item_id string, edits int").repartition(3)
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    got = decontaminate.passages(frame, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert not found - want and len(want - found) <= 0.01 * len(want)
    kept = decontaminate.without(frame, bench)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in found}
    assert decontaminate.passages(frame, bench.limit(0)).count() == 0 and decontaminate.passages(frame.limit(0), bench).count() == 0


# Language and quality


def test_fold(spark):
    def emit(batches):
        for batch in batches:
            counts = np.zeros(40_000, dtype=np.int64)
            np.add.at(counts, batch.column(0).to_numpy(), 1)
            yield fold.rows("x", counts)

    got = fold.collect(spark.range(0, 30_000, numPartitions=5).mapInArrow(emit, fold.SCHEMA), {"x": 40_000})["x"]
    assert got.tolist() == [1] * 30_000 + [0] * 10_000


def test_language(spark):
    rng = random.Random(4)
    speech = {"aa": "the of and is was thing other", "bb": "der die und ist straße über", "cc": "le la été garçon être où"}
    rows = [(i, " ".join(rng.choice(speech[x].split()) for _ in range(rng.randrange(3, 40))), x, "s") for i, x in enumerate(rng.choices(list(speech), k=300))]
    rows += [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, "12 !? 34", None, "s"), (903, "der die das und", None, "s"), (None, "the thing", None, "s"), (5, "le la", "cc", "s"), (904, "garçon " * 30_000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    model = language.train(docs, ~language.held_out(5, 0))
    assert model.langs == ["aa", "bb", "cc"]
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    pred = {repr(r["doc_id"]): (r["lang_pred"], r["score"]) for r in got}
    assert pred["900"] == pred["901"] == pred["902"] == ("und", 0.0)
    assert pred["903"][0] == "bb" and pred["None"][0] == "aa" and pred["904"][0] == "cc"
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] != 5]
    assert sum(pred[repr(r[0])][0] == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for _, s in pred.values())
    none = language.train(docs.limit(0), ~language.held_out(5, 0))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    kept = language.identify(docs, model, keep=("doc_id", "text", "lang")).where("lang_pred = 'und'")
    assert kept.count() == 3 and kept.columns == ["doc_id", "text", "lang", "lang_pred", "score"]


def test_quality(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinshrd") for _ in range(rng.randrange(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(20, 90))).capitalize() + "."
    bad = [lambda: " ".join(word().upper() + "!!" for _ in range(40)), lambda: f"{word()} " * 50, lambda: " | ".join(word() for _ in range(40))]
    rows, labels = [], []
    for i in range(600):
        q = int(rng.random() < 0.7)
        rows.append((i, good() if q else rng.choice(bad)(), i, "x"))
        labels.append((i, q, 0))
    rows += [(700, None, 0, "x"), (701, "", 0, "x"), (None, "text", 0, "x"), (1, "a repeated id", 0, "x")]
    labels += [(700, None, None), (None, 1, 1), (2, 7, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, features string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    use = ~language.held_out(4, 2)
    got = quality.classify(docs, marks, use).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    held = [(i, q) for i, q, _ in labels[:600] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((score[i] >= 0.7) == bool(q) for i, q in held) >= 0.95 * len(held)
    assert {r["score"] for r in quality.classify(docs, marks.limit(0), use).collect()} == {0.5}
    assert quality.classify(docs.limit(0), marks, use).count() == 0


def test_statistics_are_per_text():
    texts = ["One two two.\nTHREE 4!", "", None, "a | b | c", "é ü " * 10]
    whole = quality.statistics(pa.array(texts))
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert whole.shape == (5, quality.D) and np.allclose(whole, alone) and np.isfinite(whole).all()


# Secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark))


def test_secrets(spark, forest):
    key, token, word = "AKIA" + "Q7ZK2M4XW9PLT3VB", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "b3f0a1c29d8e47f65a"
    true = {1: f"before {key} after", 2: f'the token = "{token}" here', 3: f"é password={word} und {key}", 4: f"{key}"}
    false = {10: None, 11: "", 12: "plain words only", 13: f"commit {token} merged", 14: "card 4111111111111111 and +1 (706) 555-3138", 15: "https://example.org/about/image-gallery-2019/index", 16: "someVeryLongIdentifierName2 and another", 17: "words " * 20_000}
    rows = [(k, t, "s", 0, "c") for k, t in [*true.items(), *false.items()]] + [(1, true[1], None, 0, "c"), (None, f"x {key}", "s", 0, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, row string").repartition(3)
    found = secrets.scan(docs, forest)
    got = [(r["doc_id"], r["start"], r["length"]) for r in found.collect()]
    want = [(1, 7, 20)] * 2 + [(2, 13, 40), (3, 11, 18), (3, 34, 20), (4, 0, 20), (None, 2, 20)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    clean = {(repr(r["doc_id"]), r["text"], r["n_chars"]) for r in secrets.redact(docs, found).collect()}
    assert ("3", "é password=[SECRET] und [SECRET]", 32) in clean and ("4", "[SECRET]", 8) in clean and ("None", "x [SECRET]", 10) in clean
    assert ("13", false[13], len(false[13])) in clean and secrets.redact(docs, found).count() == len(rows)
    assert secrets.redact(docs, found).columns == docs.columns
    assert secrets.scan(docs.limit(0), forest).count() == 0


def test_no_python_in_the_scan(spark, forest):
    docs = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    plan = secrets.scan(docs, forest)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_forest_on_generated_findings(spark, forest):
    other = secrets.labelled_findings(spark, 4000).where("doc_id >= 2400")
    scored = forest.transform(secrets.with_features(secrets.candidates(other, "path", keep=("label",))))
    right, n = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.count("*")).first()
    assert right >= 0.97 and n >= 1500


# Words


def test_words_and_windows():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1cé ") for _ in range(rng.randrange(30))) for _ in range(200)] + [None, ""]
    codes: dict = {}
    for w in words.split(pa.array(texts)):
        for k in range(w.rows.start, w.rows.stop):
            own = (texts[k] or "").encode().split()
            at = w.first[k - w.rows.start]
            assert w.first[k - w.rows.start + 1] - at == len(own)
            for i, x in enumerate(own):
                assert codes.setdefault(x, w.hash[at + i]) == w.hash[at + i]
        hashed, inside = words.windows(w.hash, 3), words.window_mask(w.first, 3)
        assert len(hashed) == len(inside) == len(w.hash) - 2
    assert len(set(codes.values())) == len(codes)
