"""Language identification by mixture inference (operator 4).

Training counts hashed letter trigrams of each language over all training documents. For a document, expectation
maximisation estimates the proportions of languages that explain its trigrams best. The languages it is said to hold are
selected by penalised likelihood: starting with the best single language, the set grows by the next largest proportion,
however small, as long as the likelihood gains more than half the logarithm of the number of trigrams for each further
language. The score is the predicted language's proportion among all languages, before any is left out, so that short and
ambiguous texts score lower than long and plain ones.

The model has 2**DIM_BITS entries a language, whatever the corpus; `max_languages` bounds what is broadcast (more raise).

Defined results: `und` with score 0 if the text is null or has no letter, or nothing was learnt. Ties go to the first
language by name. Rows with a null language or text teach nothing. Empty tables give empty results.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM_BITS = 15
STEPS = 8
_SMOOTH = 0.05


def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    out = np.full(len(points), 32, np.uint32)
    for c in range(len(points)):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Hashed trigrams of letters and word ends; empty without a letter."""
    if not text:
        return np.empty(0, np.int64)
    c = letters[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    c = c[(c != 32) | np.append(True, c[:-1] != 32)]  # one space of each run
    if len(c) < 3:
        return np.empty(0, np.int64)
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - DIM_BITS)).astype(np.int64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", max_languages: int = 200) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of trigrams (rows) by language (columns), from all rows of `docs`."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, sums = letter_table(), {}
        for batch in batches:
            for name, x in zip(batch["lang"], batch["text"], strict=True):
                if name not in sums:
                    sums[name] = np.zeros(1 << DIM_BITS, np.int64)
                at, n = np.unique(trigrams(x, letters), return_counts=True)
                sums[name][at] += n
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": name, "i": at, "n": n[at]})

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    sums = rows.mapInPandas(count, "lang string, i long, n long").groupBy("lang", "i").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("i", "n")).alias("x")).orderBy("lang").limit(max_languages + 1).collect()
    if len(packed) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = np.zeros((1 << DIM_BITS, len(packed)))
    for k, r in enumerate(packed):
        counts[[x["i"] for x in r["x"]], k] = [x["n"] for x in r["x"]]
    return [r["lang"] for r in packed], np.log((counts + _SMOOTH) / (counts + _SMOOTH).sum(axis=0))


def _mixture(p: np.ndarray, n: np.ndarray, total: float) -> tuple[np.ndarray, float]:
    """Proportions of the columns of `p` by expectation maximisation, and the log likelihood."""
    mix = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(STEPS):
        mix *= (n / (p @ mix)) @ p / total
    return mix, float(n @ np.log(p @ mix))


def proportions(grams: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of each language in a text with these trigrams, zero for languages that aren't selected; and of all."""
    at, n = np.unique(grams, return_counts=True)
    log_p = logs[at]
    single = n @ log_p
    p = np.exp(log_p - log_p.max(axis=1, keepdims=True))  # a factor for each trigram changes no comparison
    single = single - n @ log_p.max(axis=1)
    total, best = n.sum(), int(single.argmax())
    out = np.zeros(logs.shape[1])
    out[best], reached = 1.0, float(single[best])
    if logs.shape[1] == 1:
        return out, out
    mix, _ = _mixture(p, n, total)
    order = [best, *(k for k in np.argsort(-mix, kind="stable") if k != best)]
    for size in range(2, len(order) + 1):
        part, likelihood = _mixture(p[:, order[:size]], n, total)
        if likelihood - reached <= 0.5 * np.log(total):
            break
        reached = likelihood
        out[:] = 0
        out[order[:size]] = part / part.sum()
    return out, mix / mix.sum()


def with_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", name: str = "languages") -> DataFrame:
    """All rows of `docs` with a struct of lang_pred, score (see above) and the selected languages' shares."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32)))

    @F.pandas_udf("struct<lang_pred:string,score:double,shares:map<string,double>>")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters, (names, logs) = letter_table(), sent.value
        for batch in texts:
            rows = []
            for x in batch:
                grams = trigrams(x, letters)
                if not len(grams) or not names:
                    rows.append(("und", 0.0, {}))
                    continue
                mix, every = proportions(grams, logs)
                k = int(mix.argmax())
                rows.append((names[k], float(min(1.0, every[k])), {names[k]: float(mix[k]) for k in np.flatnonzero(mix)}))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "shares"])

    return docs.withColumn(name, predict(F.col(text)))
