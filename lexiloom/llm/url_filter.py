"""URL filters: rules, and gradient-boosted trees on lexical features (operator 10), in DataFrame functions only.

Rules fit a host with all its subdomains and a path prefix; the longest wins. URLs that a rule decides are the labelled
ones. The trees learn from them by histograms: features are cut into BINS bins, equal rows of bins are pre-aggregated,
and each level of a tree is one grouped sum of gradients by (leaf, feature, bin), from which the best split of each leaf
follows. What reaches the driver is bounded by leaves * features * bins. A tree becomes a CASE expression.

Features: length, depth, digit ratio, entropy of the characters, parameter counts, hyphens, longest label, and smoothed
label statistics of the host's last one and two labels and of the first segment of the path.

Defined results: a null URL, or one without `://`, has an empty host and path and fits no rule. Without labelled URLs
the method says allow. Repeated rows count as often as they come. Empty tables give empty results. Other columns pass
through, but host, path, rule, verdict and score are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.scratch import materialize, quoted

BINS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`blocks` what is on `host` or below it and has a path beginning with `path`."""

    host: str
    path: str
    blocks: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """Name of the longest rule that fits `host` and `path`, and whether it blocks; nulls without one."""
    name, blocks = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        name, blocks = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.blocks)).otherwise(blocks)
    return name, blocks


def _count(c: Column, x: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))


def _entropy(c: Column) -> Column:
    """Shannon's, in bits, of the characters of the string, each by its number of occurrences."""
    n = F.greatest(F.lit(1), F.length(c)).cast("double")
    chars = F.array_distinct(F.split(c, ""))
    of = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    return -F.aggregate(F.filter(chars, lambda x: x != ""), F.lit(0.0), lambda s, x: s + of(x) * F.log2(of(x)))


def suffixes_of() -> dict[str, Column]:
    """Keys of the label statistics."""
    return {"top": F.element_at(F.split("host", r"\."), -1), "two": F.substring_index("host", ".", -2), "start": F.regexp_extract("path", r"\A/?([^/]*)", 1)}


def lexical(url: str) -> dict[str, Column]:
    """Numeric features of the URL alone."""
    u = F.coalesce(F.col(url), F.lit(""))
    digits = F.length(u) - F.length(F.regexp_replace(u, "[0-9]", ""))
    return {
        "length": F.length(u),
        "depth": _count(F.col("path"), "/"),
        "labels": _count(F.col("host"), "."),
        "digit_ratio": digits / F.greatest(F.lit(1), F.length(u)),
        "entropy": _entropy(u),
        "parameters": _count(u, "=") + _count(u, "&"),
        "fragment": _count(u, "#"),
        "hyphens": _count(F.col("host"), "-"),
        "longest_label": F.array_max(F.transform(F.split("host", r"\."), F.length)),
    }


@dataclass(frozen=True)
class Model:
    """Bin limits and suffix statistics are in `limits` and `suffixes`; a tree is (feature, bin, left, right) or a value."""

    limits: dict[str, list[float]]
    suffixes: dict[str, DataFrame]
    prior: float
    base: float
    trees: list


def _binned(limits: dict[str, list[float]]) -> dict[str, Column]:
    """The number of limits that a feature is above."""
    return {k: reduce(lambda a, b: a + b, ((F.col(f"__lx_{k}") > x).cast("int") for x in v), F.lit(0)) for k, v in limits.items()}


def _features(urls: DataFrame, url: str, suffixes: dict[str, DataFrame], prior: float) -> DataFrame:
    """Adds __lx_<feature>. The suffix tables are joined by size; those with few rows are broadcast by Catalyst."""
    out = urls.withColumns({f"__lx_{k}": c for k, c in lexical(url).items()})
    for k, table in suffixes.items():
        out = out.withColumn(f"__lx_k_{k}", suffixes_of()[k]).join(table.withColumnsRenamed({"suffix": f"__lx_k_{k}", "rate": f"__lx_{k}"}), f"__lx_k_{k}", "left")
        out = out.withColumn(f"__lx_{k}", F.coalesce(f"__lx_{k}", F.lit(prior)))
    return out


def _tree_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, cut, left, right = tree
    return F.when(F.col(feature) <= cut, _tree_column(left)).otherwise(_tree_column(right))


def _grow(rows: DataFrame, names: list[str], depth: int, l2: float, rate: float):
    """One tree of `depth` levels on `rows` (bins, g, h), a grouped sum for each level."""
    leaf = F.lit(0)
    splits: dict[int, tuple] = {}
    totals: dict[int, tuple[float, float]] = {}
    for _ in range(depth):
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("bin")) for k in names))).alias("f")
        sums = rows.select(leaf.alias("leaf"), pairs, "g", "h").groupBy("leaf", "f.k", "f.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        by: dict[int, dict[str, dict[int, tuple[float, float]]]] = {}
        for r in sums:
            by.setdefault(r["leaf"], {}).setdefault(r["k"], {})[r["bin"]] = (r["g"], r["h"])
        for n, features in by.items():
            g, h = (sum(x[i] for x in features[names[0]].values()) for i in (0, 1))
            totals[n] = g, h
            best = None
            for k in names:
                gl = hl = 0.0
                bins = sorted(features.get(k, {}))
                for b in bins[:-1]:
                    gl, hl = gl + features[k][b][0], hl + features[k][b][1]
                    gain = gl * gl / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g * g / (h + l2)
                    if min(hl, h - hl) >= 1 and gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = gain, k, b, (gl, hl)
            if best:
                splits[n] = best[1:3]
                totals[2 * n + 1], totals[2 * n + 2] = best[3], (g - best[3][0], h - best[3][1])
        open_leaves = [n for n in by if n in splits]
        if not open_leaves:
            break
        for n in open_leaves:
            k, b = splits[n]
            leaf = F.when(leaf == n, F.when(F.col(k) <= b, 2 * n + 1).otherwise(2 * n + 2)).otherwise(leaf)

    def build(n: int):
        if n in splits:
            return (*splits[n], build(2 * n + 1), build(2 * n + 2))
        g, h = totals.get(n, (0.0, 0.0))
        return round(-rate * g / (h + l2), 9)

    return build(0)


def learn(urls: DataFrame, label: str, url: str = "url", trees: int = 12, depth: int = 3, rate: float = 0.3, l2: float = 1.0, smoothing: float = 20.0) -> Model:
    """Trees for the boolean `label` (null: not labelled) of `urls`, which has host and path."""
    known = urls.filter(F.col(label).isNotNull()).select(url, "host", "path", F.col(label).cast("int").alias("__lx_y"))
    n, positive = known.agg(F.count("*"), F.sum("__lx_y")).first()
    if not n or positive in (0, n):
        return Model({}, {}, 0.0, 30.0 if n and positive else -30.0, [])
    prior = positive / n
    suffixes = {}
    for k, c in suffixes_of().items():
        rate_of = (F.sum("__lx_y") + smoothing * prior) / (F.count("*") + smoothing)
        suffixes[k] = materialize(known.groupBy(c.alias("suffix")).agg(F.round(rate_of, 6).alias("rate")), f"url-{k}", 1)
    rows = _features(known, url, suffixes, prior)
    names = [*lexical(url), *suffixes_of()]
    at = [(i + 1) / BINS for i in range(BINS - 1)]
    found = rows.agg(*(F.percentile_approx(f"__lx_{k}", at, 10_000).alias(k) for k in names)).first()
    limits = {k: sorted({float(x) for x in found[k]}) for k in names}
    bins = rows.select("__lx_y", *(c.alias(k) for k, c in _binned(limits).items()))
    packed = materialize(bins.groupBy("__lx_y", *names).agg(F.count("*").cast("double").alias("__lx_n")), "url-bins", 8)
    base, grown = math.log(prior / (1 - prior)), []
    margin = F.lit(base)
    for _ in range(trees):
        p = 1 / (1 + F.exp(-margin))
        part = packed.select(*names, p.alias("p"), "__lx_y", "__lx_n").withColumns({"g": F.col("__lx_n") * (F.col("p") - F.col("__lx_y")), "h": F.col("__lx_n") * F.col("p") * (1 - F.col("p"))})
        grown.append(_grow(part, names, depth, l2, rate))
        margin = margin + _tree_column(grown[-1])
    return Model(limits, suffixes, prior, base, grown)


def with_scores(urls: DataFrame, model: Model, url: str = "url") -> DataFrame:
    """Adds `score`, the probability of a true label."""
    names = [c for c in urls.columns if c != "score"]
    if not model.trees:
        return urls.select(*quoted(names)).withColumn("score", F.lit(1 / (1 + math.exp(-model.base))))
    rows = _features(urls.select(*quoted(names)), url, model.suffixes, model.prior)
    rows = rows.select(*quoted(names), *(c.alias(k) for k, c in ((f"__lx_b_{k}", c) for k, c in _binned(model.limits).items())))
    margin = reduce(lambda a, t: a + _tree_column(_prefixed(t)), model.trees, F.lit(model.base))
    return rows.select(*quoted(names), (1 / (1 + F.exp(-margin))).alias("score"))


def _prefixed(tree):
    return (f"__lx_b_{tree[0]}", tree[1], _prefixed(tree[2]), _prefixed(tree[3])) if isinstance(tree, tuple) else tree


def judge(urls: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """All rows of `urls` with host, path, rule (or null), score and verdict (the rule's, else that of the trees)."""
    names = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "score")]
    host, path = split_url(url)
    rows = urls.select(*quoted(names), host.alias("host"), path.alias("path"))
    name, blocks = fitting_rule(rules)
    rows = rows.withColumns({"rule": name, "__lx_blocks": blocks})
    scored = with_scores(rows, learn(rows, "__lx_blocks", url), url)
    verdict = F.when(F.coalesce("__lx_blocks", F.col("score") >= 0.5), "block").otherwise("allow")
    return scored.withColumn("verdict", verdict).select(*quoted(names), "host", "path", "rule", "score", "verdict")
