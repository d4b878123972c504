"""Merkle manifest of a dataset, kept as a postorder append log (operator 13).

Leaves of a tree ascend by their order, and every ARITY consecutive nodes become one. Builders take aligned blocks of
ARITY ** LEVELS nodes and append the nodes of their subtree as these complete, children before parents. So a node's place
in the log follows from the sizes of the subtrees before it (postorder()), and a proof's siblings are read at computed
places, without pointers. Roots of blocks are the input of the next round of builders; two rounds take 16 million leaves,
four take 10^14. Each tree's root is a leaf of one more tree, over all trees.

A proof is a text: of each level up to the root the node's place in its run and the digests of its siblings, as `2:ab..`,
joined by commas.

Defined results: nulls in a leaf are told from empty texts. Rows that repeat an identifier are leaves each, in order of
their digests; those without one come first. Rows without a language are the first tree. A lone leaf is its tree's root,
and its proof is what lies above. Empty tables have no rows. Columns that aren't named pass through, except those named
as the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.scratch import materialize

ARITY, LEVELS = 8, 4
DIGEST = 32


def leaf_of(*columns: Column) -> Column:
    """Hex SHA-256 over columns: `-` for null, else the length in bytes, a colon and the value."""
    of = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return F.sha2(F.concat(*(of(c.cast("string")) for c in columns)), 256)


def height(leaves: int, arity: int = ARITY) -> int:
    """Levels above the leaves until one node is left."""
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // arity), h + 1
    return h


def postorder(level: int, index: np.ndarray, leaves: int, top: int, arity: int = ARITY) -> np.ndarray:
    """Places in the log of nodes (`level`, `index`) of a tree of `leaves` leaves and `top` levels above them: all nodes
    that complete before the first leaf below, and then all of the own subtree but the node itself."""
    first = index * arity**level
    last = np.minimum(first + arity**level, leaves)
    before = sum(first // arity**k for k in range(top + 1))
    own = sum(-(-last // arity**k) - first // arity**k for k in range(level + 1))
    return before + own - 1


def _hash(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def append(digests: list[str], climb: int) -> bytes:
    """The log of the subtree over the nodes `digests`, `climb` levels high: a builder puts down each node as it completes,
    and keeps only the nodes whose parents haven't."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(climb + 1)]

    def put(level: int, digest: str) -> None:
        log.append(digest)
        open_runs[level].append(digest)
        if level < climb and len(open_runs[level]) == ARITY:
            close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        put(level + 1, _hash("".join(run)))

    for x in digests:
        put(0, x)
    for level in range(climb):  # the right edge
        if open_runs[level]:
            close(level)
    return bytes.fromhex("".join(log))


def siblings(log: bytes, leaves: int, climb: int) -> list[list[str]]:
    """Of each node at the bottom of a log its proof up to the log's top, level by level."""
    nodes = np.frombuffer(log, np.uint8).reshape(-1, DIGEST)
    out: list[list[str]] = [[] for _ in range(leaves)]
    for level in range(climb):
        count = -(-leaves // ARITY**level)
        digests = nodes[postorder(level, np.arange(count), leaves, climb)].tobytes().hex()
        steps = []
        for k in range(count):
            own, begin = k % ARITY, k - k % ARITY
            run = digests[2 * DIGEST * begin : 2 * DIGEST * min(begin + ARITY, count)]
            steps.append(f"{own}:{run[: 2 * DIGEST * own]}{run[2 * DIGEST * (own + 1) :]}")
        for i, mine in enumerate(out):
            mine.append(steps[i // ARITY**level])
    return out


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    for step in proof.split(",") if proof else ():
        own, _, beside = step.partition(":")
        at = 2 * DIGEST * int(own)
        leaf = _hash(beside[:at] + leaf + beside[at:])
    return leaf


def folded(leaf: Column, proof: Column) -> Column:
    """fold() of columns."""

    @F.arrow_udf("string")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([fold(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    return of(leaf, proof)


def digests_of(proof: Column) -> Column:
    """The siblings' digests of a proof, one after the other."""
    return F.regexp_replace(proof, "[0-9]:|,", "")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (tree, ...) with `at`, the place in the tree by `order`, and `size`, the tree's rows.

    Sorted ranges are written, so that places hold if a task is run again; a range then adds up the ranges before it.
    """
    ranges = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = materialize(ranges.withColumn("id", F.monotonically_increasing_id()), "manifest-rows").withColumn("run", F.shiftright("id", 33))
    runs = placed.groupBy("tree", "run").agg(F.min("id").alias("first"), F.count("*").alias("n"))  # one for each tree and range
    whole = Window.partitionBy("tree")
    before = F.sum("n").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "run", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"), F.sum("n").over(whole).alias("size"))
    return placed.join(runs, ["tree", "run"]).withColumn("at", F.col("id") + F.col("base")).drop("id", "run", "base")


@dataclass
class Manifest:
    """The log of a forest: `rounds` of (tree, block, size, climb, log), from the leaves up; `size`: the tree's nodes at
    the bottom of that round. `roots`: (tree, root, size), size in leaves."""

    rounds: list[DataFrame]
    roots: DataFrame

    def nodes(self) -> DataFrame:
        """(tree, position, level, digest): the log row by row, in completion order within each tree."""

        def spread(sizes: DataFrame, k: int) -> DataFrame:
            def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for r in batch.itertuples():
                        top, log = height(r.leaves), np.frombuffer(r.log, np.uint8).reshape(-1, DIGEST)
                        bottom = min(ARITY**LEVELS, r.size - r.block * ARITY**LEVELS)
                        for level in range(1 if k else 0, r.climb + 1):  # a round's bottom is the top of the one below
                            here = np.arange(-(-bottom // ARITY**level))
                            of_tree = here + r.block * ARITY ** (LEVELS - level)
                            found = log[postorder(level, here, bottom, r.climb)]
                            yield pd.DataFrame({"tree": r.tree, "position": postorder(k * LEVELS + level, of_tree, r.leaves, top), "level": k * LEVELS + level, "digest": [x.tobytes().hex() for x in found]})

            return sizes.mapInPandas(of, "tree string, position long, level int, digest string")

        leaves = self.roots.select("tree", F.col("size").alias("leaves"))
        out = [spread(x.join(leaves, "tree"), k) for k, x in enumerate(self.rounds)]
        every = out[0]
        for x in out[1:]:
            every = every.union(x)
        return every


def build(leaves: DataFrame) -> Manifest:
    """Of leaves (tree, at, size, digest), numbered in their trees. A group is a block."""
    block = ARITY**LEVELS
    largest = leaves.agg(F.max("size")).first()[0] or 0
    roots, rounds = leaves.select("tree", "at", "size", "digest"), []

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        size = int(rows["size"].iloc[0])
        climb = min(LEVELS, height(size))
        log = append(rows["digest"].tolist(), climb)
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "block": rows["block"].iloc[:1], "size": size, "climb": climb, "log": [log], "root": log[-DIGEST:].hex()})

    while True:
        grouped = roots.withColumn("block", F.floor(F.col("at") / block).cast("long")).groupBy("tree", "block")
        done = materialize(grouped.applyInPandas(run, "tree string, block long, size long, climb int, log binary, root string"), "manifest-log")
        rounds.append(done.drop("root"))
        roots = done.select("tree", F.col("block").alias("at"), F.expr(f"cast(ceil(size / {block}) as long)").alias("size"), F.col("root").alias("digest"))
        largest = -(-largest // block)
        if largest <= 1:
            sizes = leaves.filter("at = 0").select("tree", "size")
            return Manifest(rounds, roots.join(sizes.withColumnRenamed("size", "leaves"), "tree").select("tree", F.col("digest").alias("root"), F.col("leaves").alias("size")))


def paths(manifest: Manifest, above: DataFrame) -> DataFrame:
    """(tree, block, size, climb, log, path) of the lowest round: the proof from each block's root upwards.

    `above` (tree, path): what lies over each tree's root. From the top down, each round hands its blocks' paths on to the
    blocks that are its inputs.
    """
    block = ARITY**LEVELS
    upper = above.select("tree", F.lit(0).cast("long").alias("block"), "path")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                n = min(block, r.size - r.block * block)
                steps = [",".join(x for x in (*own, r.path) if x) for own in siblings(r.log, n, r.climb)]
                yield pd.DataFrame({"tree": r.tree, "block": np.arange(n) + r.block * block, "path": steps})

    for k, x in reversed(list(enumerate(manifest.rounds))):
        joined = x.join(upper, ["tree", "block"])
        if k == 0:
            return joined
        upper = joined.mapInPandas(spread, "tree string, block long, path string")
    raise ValueError("a manifest has one round at least")


def with_proofs(docs: DataFrame, tree: Column, order: str, leaf: Column, without: tuple[str, ...] = ("text",), **also: Column) -> DataFrame:
    """All rows of `docs`, without the columns `without`, with leaf, subroot (of its tree), root (of all trees) and proof;
    `also`: further columns, computed from the whole rows. A tree has the rows of one value of `tree`; trees are in order
    of its bytes, null first, and leaves in order of the column `order`.

    Texts are read once and don't travel: what is exchanged are identifiers and digests.
    """
    new = ["leaf", "subroot", "root", "proof", *also]
    names = [c for c in docs.columns if c not in (*new, *without)]
    key = F.coalesce(F.concat(F.lit("1"), tree), F.lit("0"))
    rows = docs.select(key.alias("tree"), F.col(f"`{order}`").alias("order"), leaf.alias("digest"), F.struct(F.lit(0).alias("__lx_0"), *(F.col(f"`{c}`") for c in names)).alias("row"), *(c.alias(f"also_{k}") for k, c in enumerate(also.values())))
    leaves = numbered(rows, ["order", "digest"])
    trees = build(leaves)
    forest = numbered(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest")), ["of"])
    top = build(forest)
    root = top.roots.select("root")
    over = _proofs(forest, top, docs.sparkSession.createDataFrame([("", "")], "tree string, path string"), ["digest", "of"])
    over = materialize(over.select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), F.col("proof").alias("path")), "manifest-trees", 1)
    own = _proofs(leaves, trees, over.select("tree", "path"), ["digest", "row", *(f"also_{k}" for k in range(len(also)))])
    whole = own.join(over.select("tree", "subroot"), "tree").crossJoin(F.broadcast(root))  # one row
    columns = [F.col("row")[c].alias(c) for c in names]
    return whole.select(*columns, F.col("digest").alias("leaf"), "subroot", "root", "proof", *(F.col(f"also_{k}").alias(c) for k, c in enumerate(also)))


def _proofs(leaves: DataFrame, manifest: Manifest, above: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, carried columns, proof) of each leaf: a block of them meets its block's log and path."""
    block = ARITY**LEVELS
    grouped = leaves.withColumn("block", F.floor(F.col("at") / block).cast("long"))
    rows = grouped.select("tree", "block", "at", F.struct(*carried).alias("carried"))
    out = T.StructType([rows.schema["tree"], rows.schema["carried"], T.StructField("proof", T.StringType())])

    def run(some: pa.Table, logs: pa.Table) -> pa.Table:
        proofs: list[str] = []
        if some.num_rows:
            log = logs.to_pylist()[0]
            base = log["block"] * block
            own = siblings(log["log"], min(block, log["size"] - base), log["climb"])
            proofs = [",".join(x for x in (*own[at - base], log["path"]) if x) for at in some["at"].to_pylist()]
        return pa.Table.from_arrays([some["tree"], some["carried"], pa.array(proofs, pa.string())], ["tree", "carried", "proof"])

    met = rows.groupBy("tree", "block").cogroup(paths(manifest, above).groupBy("tree", "block")).applyInArrow(run, out)
    return met.select("tree", *(F.col("carried")[c].alias(c) for c in carried), "proof")
