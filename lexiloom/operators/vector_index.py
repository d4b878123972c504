"""An index of vectors by inverted lists, for many queries at once.

Centres of lists come from k-means over a bounded sample (`sample` rows, those of the smallest hashes); every row is then
assigned to the list of its nearest centre. A query looks at the rows of its `probes` nearest lists only, whose scores are
exact. How many lists that takes is measured, not assumed: the exact neighbours of `checks` queries say which share of
them lies in the first n lists of their query, and the least n that reaches the wanted recall is used; with all lists the
result is the exact one. Large lists are split into parts, so one list may hold a third of all rows.

Defined results: vectors without an identifier or with null or NaN coordinates aren't in the index. All vectors have one
number of dimensions, else it is an error. Ties go by identifier.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.similarity import PART, best_of_parts, nearest_of_parts, search_all, whole_vectors

#: Lists at most, so that their centres can be sent to all tasks; rows of the sample; queries that the recall is measured on.
MOST_LISTS, SAMPLE, CHECKS = 4096, 20_000, 100
STEPS = 10
#: Rows, with their vectors, that a task makes of its queries at once.
ROWS = 10_000


def k_means(rows: np.ndarray, lists: int) -> np.ndarray:
    """Unit centres; rows are compared by their directions. A centre that loses all rows takes the row furthest from its own."""
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = rows / np.where(norm == 0, 1, norm)
    centres = np.unique(unit, axis=0)
    centres = centres[np.random.default_rng(0).permutation(len(centres))[:lists]]
    for _ in range(STEPS):
        near = unit @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = unit[near.max(axis=1).argsort()[: len(empty)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size == 0, centres, sums / np.where(size == 0, 1, size))
    return centres


def spread(queries: pd.DataFrame, centres: np.ndarray, probes: int) -> Iterator[pd.DataFrame]:
    """Queries, each once for each of its nearest lists, in frames of about ROWS rows: a frame for many queries would hold
    as many copies of their vectors as there are lists to look at."""
    step = max(1, ROWS // max(1, min(probes, len(centres))))
    for at in range(0, len(queries), step):
        some = queries.iloc[at : at + step]
        near = np.stack(some["vector"].to_list()) @ centres.T
        lists = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        out = some.loc[some.index.repeat(lists.shape[1]), ["verse_id", "vector", "kind"]]
        yield out.assign(list=lists.ravel(), at=np.tile(np.arange(lists.shape[1]), len(lists)))


@dataclass(frozen=True)
class VectorIndex:
    """`rows`: (verse_id, vector, kind, list) of all vectors; `kind`: the name of the column that kinds come from."""

    centres: np.ndarray
    rows: DataFrame
    kind: str | None = None

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """Queries (verse_id, vector, kind), each once for each of its nearest lists; `at`: from 0, in order of nearness."""
        sent = queries.sparkSession.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from spread(batch, sent.value, probes)

        return queries.mapInPandas(run, "verse_id long, vector array<double>, kind string, list int, at int")

    def probes_for(self, queries: DataFrame, top_k: int, recall: float = 0.95, checks: int = CHECKS) -> int:
        """The least number of lists in which `recall` of the exact neighbours of `checks` queries lie."""
        some = queries.orderBy(F.xxhash64("verse_id"), "verse_id").limit(checks)
        asked = whole_vectors(some, self.kind)
        exact = search_all(self.rows, asked, top_k, -np.inf, "kind" if self.kind else None)
        ranks = self.probed(asked, len(self.centres)).select(F.col("verse_id").alias("query_id"), "list", "at")
        found = exact.join(self.rows.select("verse_id", "list"), "verse_id").join(ranks, ["query_id", "list"]).groupBy("at").count().collect()
        by = np.zeros(max(1, len(self.centres)), np.int64)
        for at, n in found:
            by[at] += n
        return int(np.searchsorted(np.cumsum(by), recall * by.sum()) + 1) if by.sum() else 1

    def search(self, queries: DataFrame, top_k: int = 20, min_similarity: float = 0.3, probes: int | None = None, recall: float = 0.95) -> DataFrame:
        """As search_all(), of the rows in the lists that are looked at."""
        spark, dealt = queries.sparkSession, lambda n: F.pmod(F.xxhash64("verse_id"), n).cast("int")
        probes = probes or self.probes_for(queries, top_k, recall)
        asked = self.probed(whole_vectors(queries, self.kind), probes)
        sizes: dict[int, list[int]] = {}  # a row for each list, of which there are MOST_LISTS at most
        for k, df in enumerate((self.rows, asked)):
            for r in df.groupBy("list").count().collect():
                sizes.setdefault(r["list"], [0, 0])[k] = r["count"]
        table = spark.createDataFrame([(x, -(-n // PART) or 1, -(-m // (PART // 4)) or 1) for x, (n, m) in sizes.items()], "list int, parts int, groups int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        rows = self.rows.join(F.broadcast(table), "list").withColumn("part", dealt(F.col("parts"))).withColumn("group", every("groups"))
        asked = asked.join(F.broadcast(table), "list").withColumn("group", dealt(F.col("groups"))).withColumn("part", every("parts"))
        found = nearest_of_parts(asked.drop("parts", "groups", "at"), rows.drop("parts", "groups"), ("list", "group", "part"), top_k, self.kind is not None)
        return best_of_parts(found, top_k, min_similarity, self.kind)


def build(vectors: DataFrame, kind: str | None = None, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Of vectors (verse_id, vector, and the column `kind`). `lists`: by default the root of the number of rows."""
    rows = whole_vectors(vectors, kind)
    n, low, high = rows.agg(F.count("*"), F.min("dim"), F.max("dim")).first()
    if n and low != high:
        raise ValueError(f"vectors of {low} and of {high} dimensions have no common index")
    lists = min(MOST_LISTS, lists or max(1, round(n**0.5)))
    some = rows.orderBy(F.xxhash64("verse_id"), "verse_id").limit(sample).select("vector").toPandas()["vector"].to_list()
    centres = k_means(np.stack(some), lists) if some else np.empty((0, 0))
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(list=(np.stack(batch["vector"].to_list()) @ sent.value.T).argmax(axis=1).astype(np.int32))

    return VectorIndex(centres, rows.select("verse_id", "vector", "kind").mapInPandas(assign, "verse_id long, vector array<double>, kind string, list int"), kind)


def recall_of(found: DataFrame, exact: DataFrame, kind: str | None = None) -> float:
    """The share of the exact results that were found."""
    keys = ["query_id", "verse_id", *([kind] if kind else [])]
    n = exact.count()
    return exact.join(found.select(*keys), keys, "left_semi").count() / n if n else 1.0
