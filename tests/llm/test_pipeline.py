"""The corpus pipeline, stage by stage, against brute force."""

from __future__ import annotations

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of five kinds and a benchmark; returns the folder and the documents that should survive each stage."""
    rng = random.Random(12)
    speech = {"aa": "the of and is was thing other house".split(), "bb": "der die und ist straße über haus wald".split()}
    word = lambda x: rng.choice(speech[x]) + rng.choice(["", "", "er", "ing", "ung", "s", "est"]) + str(rng.choice(["", "", "n", "m", "o"]))
    text = lambda x, n: " ".join(word(x) for _ in range(n))
    items = [text(rng.choice("ab") * 2, rng.randrange(15, 40)) for _ in range(8)]
    rows, kept = [], []
    for i in range(120):
        x = rng.choice("ab") * 2
        rows.append([i, text(x, rng.randrange(130, 200)), x])
    for i in range(120, 140):  # near copies: two words in 130 or more; exact ones
        own = rows[i - 120][1].split()
        if i % 2:
            own[7] = own[40] = "changed"
        rows.append([i, " ".join(own), rows[i - 120][2]])
    for i in range(140, 150):  # contaminated
        rows.append([i, f"{text('aa', 40)} {rng.choice(items)} {text('bb', 30)}", "aa"])
    for i in range(150, 156):  # no letters
        rows.append([i, "12 34 !? " * (i - 149) if i > 151 else None if i == 150 else "", "aa"])
    for i in range(156, 166):
        rows.append([i, f"{text('aa', 50)} AKIA{''.join(rng.choice('QWERTYUIPASDFGHJKZXCVBNM234567') for _ in range(16))} {text('aa', 20)}", "aa"])
    rows.append([None, text("bb", 70), "bb"])
    kept = [r[0] for r in rows if r[0] is None or r[0] < 120 or r[0] >= 156]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(k, t, x, "src", len(t) if t is not None else None) for k, t, x in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, kept


def test_stages(spark, tables):
    folder, rows, kept = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {k: t for k, t, _ in rows}
    work = corpus_pipeline.tables.Workspace(spark, "test")
    expect = [
        {k for k, t, _ in rows if t and re.search(r"[^\W\d_]", t)},
        {k for k in text if k is None or not 120 <= k < 140 and not 150 <= k < 156},
        set(kept),
        set(kept),
        set(kept),
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES, expect, strict=True):
        docs = work.put(stage(spark, docs, folder), name)
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want, name
        assert docs.count() == len(want)
        if name != "tokens":
            assert docs.columns == COLUMNS
        if name == "secrets":
            for r in docs.collect():
                clean = re.sub(r"AKIA[A-Z0-9]{16}", "[SECRET]", text[r["doc_id"]])
                assert r["text"] == clean and r["n_chars"] == len(clean)
    assert corpus_pipeline.run(spark, folder).count() == len(kept)


def test_empty_table(spark, tables, tmp_path):
    folder, _, _ = tables
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids_and_clashing_names(spark, tmp_path):
    """Texts that share a doc_id are documents of their own; exact rows repeat; columns of other names do not disturb."""
    rng = random.Random(7)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    one, two, three, four = (text() for _ in range(4))
    rows = [(1, one), (1, one), (1, two), (2, one), (3, three), (3, four), (4, four), (5, f"{two} x"), (None, one), (None, one)]
    docs = spark.createDataFrame([(k, t, "aa", "s", len(t), 1, "c") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key int, component_id string")
    kept = corpus_pipeline.distinct(spark, docs, str(tmp_path))
    assert kept.columns == COLUMNS
    got = [(r["doc_id"], r["text"].removesuffix(" x")) for r in kept.collect()]
    assert sorted(t for k, t in got if k is not None) == sorted([one, two, three, four]) and got.count((None, one)) == 2
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such passage is there at all in any of them")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 6
