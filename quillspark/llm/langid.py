"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, sole_cache

BITS = 16
#: Odd multipliers of the rolling hash, one a place.
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
#: Characters hashed at a time; a longer text goes through in overlapping pieces, a shorter one with its neighbours.
CHUNK = 1 << 18


@lru_cache(1)
def _letters() -> np.ndarray:
    """True at each code point that is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def _codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text between spaces, everything but letters a space (0), runs of spaces once."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(0))
    codes = np.concatenate((np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)))
    return codes[np.concatenate((codes[1:] != 0, [True])) | (codes != 0)]


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that end at each character, for n = 1, 2, 3; those of n start at place n - 1."""
    out, total = [], np.zeros(len(codes), np.uint32)
    for n in range(3):
        total = total[1 * (n > 0) :] + codes[: len(codes) - n] * MIX[n] if n else codes * MIX[0]
        if n:
            total = total ^ (total >> np.uint32(15))
        out.append(((total * np.uint32(0x2C1B3C6D + 2 * n)) >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def _pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(0, max(1, len(codes) - 2), CHUNK):
        yield codes[max(0, i - 2 * (i > 0)) : i + CHUNK]


def counts_of(texts: list[str]) -> np.ndarray:
    """Occurrences of each bucket in the texts."""
    total, held, size = np.zeros(1 << BITS, np.int64), [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= CHUNK or i == len(texts) - 1:
            for piece in _pieces(_codes("\n".join(held))):
                for grams in _grams(piece):
                    total += np.bincount(grams, minlength=1 << BITS)
            held, size = [], 0
    return total


def scores_of(codes: list[np.ndarray], logs: np.ndarray) -> np.ndarray:
    """Sum over each text's n-grams of the rows of ``logs``: one row a text. The texts of a call go through together."""
    out = np.zeros((len(codes), logs.shape[1]))
    if not codes:
        return out
    whole = np.concatenate(codes)
    starts = np.cumsum([0] + [len(c) for c in codes[:-1]])
    for grams in _grams(whole):
        # n-grams over the seam of two texts are two separators and a letter at most, the same for all texts
        rows = np.concatenate((logs[grams], np.zeros((len(whole) - len(grams), logs.shape[1]), logs.dtype)))
        out += np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
    return out


class Model:
    """``langs``, log priors and the matrix of log probabilities, buckets by languages."""

    def __init__(self, langs: list[str], n_docs: np.ndarray, counts: np.ndarray, alpha: float):
        self.langs = langs
        self.prior = np.log(n_docs / n_docs.sum())
        totals = counts.sum(axis=1, keepdims=True) + alpha * counts.shape[1]
        chances = (counts + alpha) / totals
        self.logs = np.ascontiguousarray(np.log(chances).T.astype(np.float32))
        #: mean log-likelihood ratio of an n-gram of the language against chance
        self.gain = np.maximum((chances * np.log(chances)).sum(axis=1) + math.log(counts.shape[1]), 1e-9)


def train(docs: DataFrame, text_col: str, lang_col: str, id_col: str, eligible: Column, per_lang: int = 8000, alpha: float = 0.1) -> Model | None:
    """Fits the model on the eligible documents with a language, at most about ``per_lang`` a language.

    The sample is bounded by that parameter: each language keeps the documents whose hashed id falls below the share that
    gives it. None if there is nothing to learn from. The model has languages x 2**16 numbers; languages are taken to be
    few (hundreds).
    """
    rows = docs.where(eligible & F.col(lang_col).isNotNull())
    n_docs = dict(sorted((r[0], r[1]) for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()))
    if not n_docs:
        return None
    spark = docs.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, per_lang / n)) for k, n in n_docs.items()], "lang string, share double")
    chance = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), chance.alias("chance")).join(F.broadcast(shares), "lang").where("chance < share and text is not null").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole_cache("langid", lambda: None)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                total[lang] = total.get(lang, 0) + counts_of(list(texts))
        for lang, numbers in total.items():
            yield pd.DataFrame({"lang": [lang], "counts": [numbers.astype("<i8").tobytes()]})

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((np.frombuffer(x, "<i8") for part in parts for x in part["counts"]), np.zeros(1 << BITS, np.int64))
        yield pd.DataFrame({"lang": [key[0]], "counts": [total.tobytes()]})

    # two steps of sums, so that a task adds a bounded number of the partitions' vectors
    sums = sample.mapInPandas(count, "lang string, counts binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    sums = sums.repartition("lang", "part").mapInPandas(_add_up, "lang string, counts binary")
    found = {r["lang"]: np.frombuffer(bytes(r["counts"]), "<i8") for r in sums.groupBy("lang").applyInPandas(add, "lang string, counts binary").collect()}
    langs = sorted(found)
    if not langs:
        return None
    return Model(langs, np.array([float(n_docs[k]) for k in langs]), np.stack([found[k] for k in langs]).astype(float), alpha)


def _add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, numbers in zip(batch["lang"], batch["counts"], strict=True):
            total[lang] = total.get(lang, 0) + np.frombuffer(numbers, "<i8")
    for lang, numbers in total.items():
        yield pd.DataFrame({"lang": [lang], "counts": [numbers.astype("<i8").tobytes()]})


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "fit")) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, the posterior probability of that language given the whole text, and ``fit``.

    ``score`` says which of the learned languages it is, not whether it is one of them: over a whole text it is next to 1
    for any. ``fit`` does, whatever the length: the mean log-likelihood ratio of the text's n-grams between the language
    and chance, which takes all buckets as equally likely, as a part of what the language's own texts have on average. It is
    about 1 for text of the language, near 0 for random letters and negative for unknown scripts.

    ``und`` with score and fit 0 for a null text, one without letters, or without a model. Other columns pass through;
    ``names`` are those of the new columns, and an input column called so is replaced. Repeated rows are predicted alike;
    an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sole_cache("langid", lambda: None)
        model = shared.value
        for texts in batches:
            lang, score, fit = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.zeros(len(texts))
            todo, codes, size = [], [], 0

            def flush() -> None:
                nonlocal size
                _settle(scores_of(codes, model.logs), np.array([len(c) for c in codes]))
                todo.clear()
                codes.clear()
                size = 0

            def _settle(likely: np.ndarray, n_codes: np.ndarray) -> None:
                points = likely + model.prior
                best = points.argmax(axis=1)
                fit[todo] = (likely[np.arange(len(todo)), best] / (3 * n_codes) + math.log(1 << BITS)) / model.gain[best]
                odds = np.exp(points - points.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b, o in zip(todo, best, odds, strict=True):
                    lang[i], score[i] = model.langs[b], min(1.0, 1.0 / o)

            for i, text in enumerate(texts if model is not None else ()):
                if text is None or not (own := _codes(text)).any():
                    continue
                if len(own) > CHUNK:
                    total = sum(scores_of([p], model.logs) for p in _pieces(own))
                    kept, todo[:] = todo[:], [i]
                    _settle(total, np.array([len(own)]))
                    todo[:] = kept
                    continue
                todo.append(i)
                codes.append(own)
                size += len(own)
                if size >= CHUNK:
                    flush()
            if todo:
                flush()
            yield pd.DataFrame({"lang_pred": lang, "score": score, "fit": fit})

    # else a filter on the result has the texts predicted a second time, by Python workers of its own
    guess = F.pandas_udf(run, "lang_pred string, score double, fit double").asNondeterministic()
    return docs.select(*[F.col(f"`{c}`") for c in keep], guess(F.col(f"`{text_col}`")).alias("__guess")).select(
        *[F.col(f"`{c}`") for c in keep], *[F.col(f"__guess.{c}").alias(name) for c, name in zip(("lang_pred", "score", "fit"), names, strict=True)]
    )


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, "text", "lang", "doc_id", ~held_out())
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
