"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fold, tables
from .chunks import groups

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
GROUP = 500_000  # bytes of text whose n-grams are held at a time
#: Languages are counted and scored in blocks of so many, each broadcast alone: buckets x languages x 4 bytes.
LANGUAGES = 128


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, every run of non-letters a single space, and each text's first place."""
    folded = [f" {x.lower()} " for x in texts]
    codes = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in folded], out=first[1:])
    other = (codes < 0x80) & ((codes < 97) | (codes > 122))
    codes = np.where(other, np.uint32(32), codes)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(other[1:] & other[:-1])
    keep[first[:-1]] = True  # a text keeps its leading space
    return codes[keep], np.append(0, np.cumsum(keep))[first]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all orders that lie within a text, text after text, and each text's first entry."""
    codes, first = _codes(texts)
    n, place = len(codes), np.arange(len(codes))
    last = np.repeat(first[1:], np.diff(first))
    value = np.zeros(n, dtype=np.uint32)
    out = np.zeros((n, len(ORDERS)), dtype=np.uint32)
    inside = np.zeros((n, len(ORDERS)), dtype=bool)
    for order in range(1, max(ORDERS) + 1):
        value *= np.uint32(0x9E3779B1)
        value[: n - order + 1] += codes[order - 1 :] + np.uint32(1)
        if order in ORDERS:
            k = ORDERS.index(order)
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF)
            out[:, k] = (mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1)
            inside[:, k] = place + order <= last
    return out[inside], np.append(0, np.cumsum(inside.sum(axis=1)))[first]


def _count(langs: list[str]) -> Callable:
    code = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(code) * BUCKETS, dtype=np.int64)
        for batch in batches:
            own = np.array([code[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for piece in groups(batch.column(0), GROUP):
                at, first = grams(batch.column(0)[piece].to_pylist())
                lang = np.repeat(own[piece], np.diff(first))
                total += np.bincount(lang * BUCKETS + at, minlength=len(total))
        yield fold.rows("grams", total)

    return run


class Block:
    """Some languages in ascending order, their log priors, and log P(bucket | language) as buckets x languages."""

    def __init__(self, langs: list[str], prior: np.ndarray, table: np.ndarray):
        self.langs, self.prior, self.table = langs, prior, table

    def score(self, texts: list[str]) -> np.ndarray:
        """Sparse scoring: the rows of the table for each text's n-grams are added up."""
        at, first = grams(texts)
        return np.add.reduceat(self.table[at], first[:-1], axis=0, dtype=np.float64) + self.prior


class Best:
    """The best language of each text so far, its log score, and the logarithm of the sum of all."""

    def __init__(self, langs: list[str | None], top: np.ndarray, total: np.ndarray):
        self.langs, self.top, self.total = langs, top, total

    @staticmethod
    def none(n: int) -> Best:
        return Best([None] * n, np.full(n, -np.inf), np.full(n, -np.inf))

    def add(self, block: Block, texts: list[str | None]) -> None:
        use = [i for i, x in enumerate(texts) if x and any(map(str.isalpha, x))]
        if not use:
            return
        score = block.score([texts[i] for i in use])
        best = score.argmax(axis=1)
        top = score[np.arange(len(use)), best]
        total = top + np.log(np.exp(score - top[:, None]).sum(axis=1))
        for i, b, better in zip(use, best.tolist(), (top > self.top[use]).tolist(), strict=True):
            if better:
                self.langs[i] = block.langs[b]
        self.top[use], self.total[use] = np.maximum(top, self.top[use]), np.logaddexp(total, self.total[use])

    def found(self) -> tuple[list[str], list[float]]:
        known = np.isfinite(self.top)
        share = np.exp(np.where(known, self.top, 0) - np.where(known, self.total, 0)) * known
        return [UNDETERMINED if x is None else x for x in self.langs], np.minimum(share, 1).tolist()


class Model:
    """Languages in ascending order, in blocks."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks

    @property
    def langs(self) -> list[str]:
        return [x for b in self.blocks for x in b.langs]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        best = Best.none(len(texts))
        for block in self.blocks:
            best.add(block, texts)
        return best.found()


def train(docs: DataFrame, use: Column, smoothing: float = 0.5) -> Model:
    """A model from text and lang of the rows where `use` holds and lang is not null; every such row counts.

    Any number of languages: each block of them is counted in a pass over its own rows.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), use.alias("use"))
    rows = rows.where("use and lang is not null and text is not null").select("text", "lang")
    size = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    every, langs, blocks = sum(size.values()), sorted(size), []
    for k in range(0, len(langs), LANGUAGES):
        own = langs[k : k + LANGUAGES]
        part = rows.where(F.col("lang").between(own[0], own[-1])) if len(langs) > LANGUAGES else rows
        counts = fold.collect(part.mapInArrow(_count(own), fold.SCHEMA), {"grams": len(own) * BUCKETS})["grams"]
        counts = counts.reshape(len(own), BUCKETS).T + smoothing
        prior = np.log(np.array([size[x] for x in own], dtype=np.float64) / every)
        blocks.append(Block(own, prior, np.ascontiguousarray(np.log(counts / counts.sum(axis=0)), dtype=np.float32)))
    return Model(blocks)


_SO_FAR = ("best_lang", "best_score", "best_total")


def _predict(shared, keep: tuple[str, ...], first: bool, last: bool) -> Callable:
    """One block's scores.  Between blocks the text goes on, with the best language so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value if shared else None
        for batch in batches:
            pa.default_memory_pool().release_unused()
            texts = batch.column("text")
            langs, top, total = ([], [], []) if first else (batch.column(x).to_pylist() for x in _SO_FAR)
            out: list[list] = [[], [], []]
            for piece in groups(texts, GROUP):
                own = texts[piece].to_pylist()
                best = Best.none(len(own)) if first else Best(langs[piece], np.array(top[piece]), np.array(total[piece]))
                if block:
                    best.add(block, own)
                for x, y in zip(out, best.found() if last else (best.langs, best.top.tolist(), best.total.tolist()), strict=False):
                    x += y
            kept = [batch.column(x) for x in keep]
            if last:
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out[0], pa.string()), pa.array(out[1], pa.float64())], names=[*keep, "lang_pred", "score"])
            else:
                columns = [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.float64(), pa.float64()), strict=True)]
                text = [] if "text" in keep else [texts]
                yield pa.RecordBatch.from_arrays([*kept, *text, *columns], names=[*keep, *(["text"] if text else []), *_SO_FAR])

    return run


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's `keep` columns, predicted language and its posterior probability.

    Null texts, texts without a letter, and all texts where the model has no language: ``und`` with score 0.  Equal
    scores go to the first language in order.  Rows are kept as they are, repeated ones included; other columns are not
    read, except `text`.  Very long texts are scored whole, one at a time.  One pass, no shuffle; the broadcast is of fixed
    size for a block of languages.  With more than one block, each has a pass of its own, and the rows are written between.
    """
    spark = docs.sparkSession
    rows = docs.select(*keep, *([] if "text" in keep else [F.col("text").cast("string").alias("text")]))
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.select(*keep).dtypes)
    between = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", best_lang string, best_score double, best_total double"
    blocks: list[Block | None] = [*model.blocks] or [None]
    work = tables.Workspace(spark, "language") if len(blocks) > 1 else None
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        shared = spark.sparkContext.broadcast(block) if block else None
        rows = rows.mapInArrow(_predict(shared, keep, k == 0, last), f"{fields}, lang_pred string, score double" if last else between)
        if not last:
            rows = work.put(rows, f"block-{k}")
            shared.destroy()
    return rows


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id's text leaves this remainder; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
