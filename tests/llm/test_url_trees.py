"""The trees of the URL filter against plain loops over rows, and their error on URLs that they haven't learned from."""

import math
from collections import Counter

from pyspark.sql import functions as F

from lexiloom.llm import queries, url_filter

FOLDER = "/root/testdata/sf0.01"
RULES = [("net", "/", 1), ("example.net", "/en/", 0), ("example.com", "/de/", 1), ("org", "/fr/", 0)]


def _parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends, default=len(rest))]
    path = rest[len(host) :]
    ends = [path.find(c) for c in "?#" if c in path]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[: min(ends, default=len(path))]


def _label(host, path):
    fits = [(len(h + p), y) for h, p, y in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1] if fits else None


def _features(url, host, path):
    u, n = url or "", max(1, len(url or ""))
    entropy = 0.0
    for c, k in Counter(u).items():
        entropy += k / n * (math.log(k / n) / math.log(2))
    count = lambda s, x: s.count(x)
    own = {"length": len(u), "depth": count(path, "/"), "labels": count(host, "."), "digit_ratio": sum(c in "0123456789" for c in u) / n, "entropy": -entropy, "parameters": count(u, "=") + count(u, "&"), "fragment": count(u, "#"), "hyphens": count(host, "-"), "longest_label": max(map(len, host.split(".")))}
    return own, {"top": host.split(".")[-1], "two": ".".join(host.split(".")[-2:]), "start": path.removeprefix("/").split("/")[0]}


def _by_loops(urls, trees=12, depth=3, rate=0.3, l2=1.0, smoothing=20.0, bins=16):
    """Scores of all URLs, by loops over rows instead of grouped sums."""
    at = [_parts(u) for u in urls]
    labels = [_label(*x) for x in at]
    made = [_features(u, *x) for u, x in zip(urls, at, strict=True)]
    known = [i for i, y in enumerate(labels) if y is not None]
    prior = sum(labels[i] for i in known) / len(known)
    rows = [dict(own) for own, _ in made]
    for k in ("top", "two", "start"):
        seen, positive = Counter(made[i][1][k] for i in known), Counter(made[i][1][k] for i in known if labels[i])
        for row, (_, keys) in zip(rows, made, strict=True):
            row[k] = round((positive[keys[k]] + smoothing * prior) / (seen[keys[k]] + smoothing), 6) if keys[k] in seen else prior
    for k in list(rows[0]):
        values = sorted(rows[i][k] for i in known)
        limits = {values[max(0, math.ceil(q / bins * len(values)) - 1)] for q in range(1, bins)}
        for row in rows:
            row[k] = sum(row[k] > x for x in limits)
    margins = [math.log(prior / (1 - prior))] * len(urls)

    def grow(members, level):
        """(margin's change of each row) of a node that holds `members`, a list of rows, known and others."""
        own = [i for i in members if labels[i] is not None]
        g, h = (sum(x[i] for i in own) for x in (gradient, weight))
        best = None
        for k in rows[0] if level < depth else ():
            for cut in sorted({rows[i][k] for i in own})[:-1]:
                gl, hl = (sum(x[i] for i in own if rows[i][k] <= cut) for x in (gradient, weight))
                gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                if min(hl, h - hl) >= 1 and gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = gain, k, cut
        if best is None:
            return {i: round(-rate * g / (h + l2), 9) for i in members}
        _, k, cut = best
        return grow([i for i in members if rows[i][k] <= cut], level + 1) | grow([i for i in members if rows[i][k] > cut], level + 1)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        gradient, weight = [a - (y or 0) for a, y in zip(p, labels, strict=True)], [a * (1 - a) for a in p]
        change = grow(list(range(len(urls))), 0)
        margins = [m + change[i] for i, m in enumerate(margins)]
    return at, labels, [1 / (1 + math.exp(-m)) for m in margins]


def test_against_loops(spark):
    """Every row of op10_url_filter on the whole table."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").orderBy("page_id").collect()
    at, labels, scores = _by_loops([r.url for r in pages])
    got = {r.page_id: r for r in queries.op10_url_filter(spark, FOLDER).collect()}
    assert len(got) == len(pages) and len({round(s, 6) for s in scores}) > 3
    for row, (host, path), label, score in zip(pages, at, labels, scores, strict=True):
        own = got[row.page_id]
        assert (own.host, own.path) == (host, path) and (own.rule is None) == (label is None)
        assert abs(own.score - score) < 2e-6, row.url
        if abs(score - 0.5) > 1e-6 or label is not None:
            assert own.verdict == ("block" if (score >= 0.5 if label is None else label) else "allow")


def test_odd_urls(spark):
    """Repeated rows, very long URLs, nulls, and columns with clashing names and dots."""
    urls = ["http://a.net/x", "http://a.net/x", "http://b.org/fr/" + "y" * 100_000, None, "", "http://" + "h" * 50_000, "http://q.com/?a=1&b=2"]
    names = ("host", "verdict", "top", "two", "start", "suffix", "rate", "length", "g", "a.b")
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").select("*", *(F.lit(f"own {c}").alias(c) for c in names))
    out = url_filter.judge(rows, queries.URL_RULES)
    got = out.orderBy("page_id").collect()
    assert [r.url for r in got] == urls and got[0][1:] == got[1][1:] and got[0].verdict == "block" and got[2].verdict == "allow"
    assert all(r[c] == f"own {c}" for r in got for c in names if c not in ("host", "verdict"))


def test_held_out(spark):
    """Trees that learn from two thirds of the URLs that rules decide judge the last third better than the larger class."""
    rows = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url")
    host, path = url_filter.split_url("url")
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("y", url_filter.fitting_rule(queries.URL_RULES)[1]).filter("y is not null")
    held = F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % 3 == 1
    scored = url_filter.with_scores(rows, url_filter.learn(rows.withColumn("label", F.when(~held, F.col("y"))), "label")).filter(held).collect()
    wrong = sum((r.score >= 0.5) != r.y for r in scored)
    larger = max(Counter(r.y for r in scored).values())
    print(f"held out: {len(scored)} URLs, {wrong} wrong, {len(scored) - larger} if all were of the larger class")
    assert wrong < len(scored) - larger
