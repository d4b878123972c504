"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 2).

Features are the presence of hashed words, word pairs and pairs that skip a word. FTRL-proximal (McMahan et al., 2013)
learns with per-coordinate rates; L1 makes most weights zero. The training set is a bounded sample of the labelled rows
(`max_docs`, those with the smallest hashed identifiers), dealt by hash into shards of about SHARD_DOCS, or SHARD_BYTES of text if that is less; each shard learns by itself in a
fixed order, and the weights are averaged, so that the result doesn't depend on the cluster. The non-zero weights, at
most 2**DIM_BITS, are broadcast, and each whole text is scored.

Defined results: a null or empty text has the score of the bias alone. Labels that are null don't count; of several labels
of one document the highest counts, of several texts of one identifier the first in order of bytes. With no labelled rows all scores are 0.5. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.scratch import materialize

DIM_BITS = 18
SHARD_DOCS, SHARD_BYTES = 8000, 128 << 20
#: ASCII but letters and digits become spaces; bytes of other characters stay.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class Ftrl:
    """Rates, penalties and passes of the training."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    passes: int = 6


def held_out(doc_id: Column) -> Column:
    """True for the third of the identifiers from which no label is learnt."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class WordHashes(dict):
    """Numbers of words met before; `table` has hashes of a word and of its first 4 and 5 bytes (inflected forms)."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.zeros((1 << 12, 3), np.uint64)

    def __missing__(self, word: bytes) -> int:
        if len(self) == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self[word] = k = len(self)
        self.table[k] = xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(word[:4], 4), xxhash.xxh64_intdigest(word[:5], 5)
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        """The hashes of the words, a row for each; forgets all before if it has grown large."""
        if len(self) > 400_000:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[at]


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Coordinates of the text's words, their beginnings, pairs and skipping pairs; they may repeat."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_PLAIN).split() if text else []
    h = hashes.of(words)
    w = h[:, 0]
    pair = lambda a, b, by: (a * np.uint64(by)) ^ (b >> np.uint64(7))
    grams = np.concatenate([h.ravel(), pair(w[:-1], w[1:], 0x9E3779B97F4A7C15), pair(w[:-2], w[2:], 0xC2B2AE3D27D4EB4F)])
    return ((grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - DIM_BITS)).astype(np.int64)


def train(rows: list[np.ndarray], labels: np.ndarray, ftrl: Ftrl) -> tuple[np.ndarray, float]:
    """Weights and bias from rows of distinct coordinates, in the given order."""
    dim = 1 << DIM_BITS  # the bias is the last coordinate, without penalties
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = np.where(np.abs(zi) <= ftrl.l1, 0.0, -(zi - np.sign(zi) * ftrl.l1) / ((ftrl.beta + np.sqrt(n[i])) / ftrl.alpha + ftrl.l2))
        w[-1] = -zi[-1] / ((ftrl.beta + np.sqrt(n[dim])) / ftrl.alpha)
        return w

    rows = [np.append(r, dim) for r in rows]
    for _ in range(ftrl.passes):
        for i, y in zip(rows, labels, strict=True):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ftrl.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(dim + 1))
    return w[:dim], float(w[dim])


def _train_shard(ftrl: Ftrl):
    def shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "doc_id"])
        hashes = WordHashes()
        w, bias = train([np.unique(features(x, hashes)) for x in group["text"]], group["label"].to_numpy(float), ftrl)
        at = np.flatnonzero(w)
        return pd.DataFrame({"i": np.append(at, -1), "w": np.append(w[at], bias)})

    return shard


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 24_000, ftrl: Ftrl = Ftrl(), doc_id: str = "doc_id", text: str = "text") -> dict[int, float]:
    """Non-zero weights by coordinate, and the bias at -1, from `labels` (doc_id, label) of `docs`, a bounded sample."""
    known = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.withColumn("h", F.xxhash64(F.lit("ftrl"), "doc_id")).orderBy("h", "doc_id").limit(max_docs)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # `max_docs` rows of three numbers
    rows = materialize(texts.groupBy("doc_id", "h", "label").agg(F.min("text").alias("text")), "ftrl-rows")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_DOCS), -(-size // SHARD_BYTES))
    found = rows.withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(shards))).groupBy("shard").applyInPandas(_train_shard(ftrl), "i long, w double")
    sums = found.groupBy("i").agg(F.sum("w").alias("w"), F.sum(F.when(F.col("i") == -1, 1)).alias("n")).collect()
    n = max([r["n"] or 0 for r in sums], default=0)
    return {r["i"]: r["w"] / n for r in sums}


def with_scores(docs: DataFrame, weights: dict[int, float], text: str = "text", name: str = "score") -> DataFrame:
    """All rows of `docs` with the score; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, hashes = np.zeros(1 << DIM_BITS), WordHashes()
        for i, x in sent.value.items():
            if i >= 0:
                w[i] = x
        used, bias = w != 0, sent.value.get(-1, 0.0)
        for batch in texts:
            out = np.full(len(batch), bias)
            for k, x in enumerate(batch):
                i = features(x, hashes)
                out[k] += w[np.unique(i[used[i]])].sum()
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return docs.withColumn(name, score(F.col(text)))
