"""The operators' queries over whole tables; SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, html_text, jaccard, language, quality, repeats, secrets, token_files, topk
from .tables import Workspace, load


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(load(spark, sf_dir, "documents"), window=35, digest=True)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Workspace(spark, "token-files").root
    token_files.write(load(spark, sf_dir, "documents"), folder, _tokenizer_file("byte_bpe_50k.json"))
    return token_files.read(spark, folder)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = language.held_out(4, 2)
    scored = quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(load(spark, sf_dir, "documents"), model).drop("row")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(load(spark, sf_dir, "documents"), size=4, percent=85)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, _tokenizer_file("byte_bpe_50k.tiktoken"), _pattern(), digests=True)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = load(spark, sf_dir, "documents"), language.held_out(5, 0)
    found = language.identify(docs, language.train(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.passages(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_repeats": op2_repeats,
    "op3_token_files": op3_token_files,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_topk": op6_topk,
    "op7_jaccard": op7_jaccard,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_language": op9_language,
    "op10_decontaminate": op10_decontaminate,
}

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op2_repeats": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
        p AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        m AS (SELECT DISTINCT r, i + k AS j FROM (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY s) > 1), range(35) t(k)),
        x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d)
        SELECT d.doc_id, CAST(count(x.j) AS BIGINT) AS n_words, CAST(count(m.j) AS BIGINT) AS n_removed,
            sha256(coalesce(string_agg(x.word, ' ' ORDER BY x.j) FILTER (m.j IS NULL), '')) AS kept_sha256
        FROM d LEFT JOIN x ON x.r = d.r LEFT JOIN m ON m.r = x.r AND m.j = x.j GROUP BY d.r, d.doc_id
    """,
    "op7_jaccard": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
        r(v, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.root FROM r JOIN (SELECT x, y FROM l UNION ALL SELECT y, x FROM l) e ON e.x = r.v)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.v = d.doc_id GROUP BY 1, 2
    """,
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
        FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
    """,
}
