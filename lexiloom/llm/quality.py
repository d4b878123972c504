"""Quality rules with adaptive thresholds (operator 3).

Each document gets integer signals, and from them metrics: shares in thousandths, and the mean length of words in tenths
of a character. For each (language, source) the distribution of each metric goes into a mergeable quantile sketch: counts
per bin, so that sketches of partitions, sources or days merge by adding counts, in any order, to the same result. Bins
are single values up to 127 and then as wide as a 64th of their value, so ranks are exact, values are too large by
nothing and too small by less than a 64th, nothing is clipped, and a sketch has at most 64 bins for each doubling.

A threshold is read from the sketch's tail: a share may be up to `reach` times its spread above the value that `level`
per cent of the documents don't exceed, where the spread is from the lower quartile to that value. The spread is at least
one bin, and, so that junk in a quarter or more of a source can't open its threshold, at most twice that of the median
source, each source counting once (with fewer than three sources of `least_docs` documents, the median language; with
fewer than three of these, twice the lower half of the source's own). This holds while less than three quarters (in the
last case, half) of a source are junk, and most sources aren't dirty.
The length of words has two thresholds, `reach` interquartile ranges outside the quartiles. Thresholds of small groups
are drawn towards those of their language's merged sketch, and these towards those of all, as if a group had PRIOR
documents of the coarser kind besides its own. Only documents that pass the base rules are sketched. Documents are then
joined with their thresholds.

Defined results: a null text has no words. Null language or source is a group of its own. A value that equals a threshold
passes. Empty tables give empty results. Repeated rows are judged (and counted) one by one. Columns of the input pass
through, whatever their names, unless they are called as one of the added columns: the added one then replaces it
(keep_good returns all columns as they were).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.scratch import materialize, quoted

PRIOR = 300
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose metric is more than `reach` spreads beyond the quantile `level`, in per cent; a two-sided
    rule goes by the quartiles."""

    metric: str
    level: int
    reach: int
    two_sided: bool = False


RULES = (
    Rule("symbol_share", 90, 4),
    Rule("dup_line_share", 98, 1),
    Rule("repeat_share", 95, 6),
    Rule("word_length", 75, 4, two_sided=True),
)


def signals_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """SIGNALS of one text. Words are runs of anything but ASCII white space, as bytes.split() has them."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - sum(map(len, words)))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: dict[tuple, int] = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        covered = 0  # words before this position are counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def _signals() -> Column:
    """UDF: SIGNALS of a text. It is made when it is used, as its type is parsed by the running session."""

    @F.pandas_udf(", ".join(f"{k} long" for k in SIGNALS))
    def signals(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([signals_of(x) for x in batch], columns=list(SIGNALS), dtype="int64")

    return signals


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds SIGNALS, metrics, and base_failed."""
    out = docs.withColumn("__lx_s", _signals()(F.col(text)))
    out = out.withColumns({k: F.col("__lx_s")[k] for k in SIGNALS}).drop("__lx_s")
    share = lambda part, whole: F.expr(f"1000 * {part} div greatest(1L, {whole})")
    return out.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "word_length": F.expr("10 * word_chars div greatest(1L, n_words)"),
            "base_failed": F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"),
        }
    )


def bin_of(value: str) -> Column:
    """The bin of a value that isn't negative: its leading seven binary digits count."""
    return F.expr(f"shiftleft(shiftright({value}, greatest(0, length(bin({value})) - 7)), greatest(0, length(bin({value})) - 7))")


def sketches(signals: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Mergeable sketches: (keys, metric, bin, n). Adding `n` of two results merges them."""
    pairs = F.explode(F.array(*(F.struct(F.lit(r.metric).alias("metric"), bin_of(r.metric).alias("bin")) for r in RULES)))
    return signals.select(*keys, pairs.alias("__lx_m")).groupBy(*keys, "__lx_m.metric", "__lx_m.bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones alone."""
    return sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: Iterable[str]) -> DataFrame:
    """(keys, metric, total, q25, q50, q75, qp): the lowest bin at which the share of rows reaches the quantile; qp is
    that of the rule's level."""
    w = Window.partitionBy(*keys, "metric")
    upto = sketch.select("*", F.sum("n").over(w.orderBy("bin")).alias("__lx_c"), F.sum("n").over(w).alias("total"))
    at = lambda level: F.min(F.when(F.col("__lx_c") * 100 >= F.col("total") * level, F.col("bin")))
    return upto.groupBy(*keys, "metric").agg(F.max("total").alias("total"), at(25).alias("q25"), at(50).alias("q50"), at(75).alias("q75"), at(_by_rule("level")).alias("qp"))


def _by_rule(field: str) -> Column:
    out = F.lit(None)
    for r in RULES:
        out = F.when(F.col("metric") == r.metric, F.lit(getattr(r, field))).otherwise(out)
    return out


def fences(found: DataFrame, peers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, total, lo, hi) from quantiles; `peers` has each metric's median spreads of sources and languages."""
    both = found.join(peers, F.col("metric") == F.col("p_metric"), "left")
    reach = _by_rule("reach")
    most = 2 * F.when(F.col("sources") >= 3, F.col("by_source")).when(F.col("langs") >= 3, F.col("by_lang")).otherwise(F.col("q50") - F.col("q25"))
    spread = F.greatest(F.lit(1).cast("long"), F.least(F.col("qp") - F.col("q25"), most))
    range_ = F.greatest(F.lit(1).cast("long"), F.col("q75") - F.col("q25"))
    lo = F.when(_by_rule("two_sided"), F.greatest(F.lit(0).cast("long"), F.col("q25") - reach * range_)).otherwise(F.lit(0).cast("long"))
    hi = F.when(_by_rule("two_sided"), F.col("q75") + reach * range_).otherwise(F.col("q25") + (1 + reach) * spread)
    return both.select(*keys, "metric", "total", lo.alias("lo"), hi.alias("hi"))


def thresholds(sketch: DataFrame, lang: str = "lang", source: str = "source", least_docs: int = 50) -> DataFrame:
    """One row for each (lang, source): lo_ and hi_ of each metric. Groups of `least_docs` documents are peers."""
    fine, by_lang = quantiles(sketch, [lang, source]), quantiles(merged(sketch, [lang]), [lang])
    both = fine.select("metric", "total", F.expr("qp - q25").alias("spread"), F.lit(True).alias("fine")).union(by_lang.select("metric", "total", F.expr("qp - q25"), F.lit(False)))
    median = lambda of: F.expr(f"percentile_disc(0.5) within group (order by spread) filter (where {of})").cast("long")
    peers = both.filter(F.col("total") >= least_docs).groupBy(F.col("metric").alias("p_metric"))
    peers = peers.agg(F.count_if("fine").alias("sources"), median("fine").alias("by_source"), F.count_if(~F.col("fine")).alias("langs"), median("not fine").alias("by_lang"))
    own = fences(fine, peers, [lang, source])
    renamed = lambda df, p: df.select(*(F.col(c).alias(f"{p}{c}") for c in df.columns))
    of_lang, of_all = renamed(fences(by_lang, peers, [lang]), "l_"), renamed(fences(quantiles(merged(sketch, []), []), peers, []), "a_")
    both = own.join(of_lang, F.expr(f"`{lang}` <=> `l_{lang}` and metric = l_metric"), "left").join(of_all, F.expr("metric = a_metric"), "left")
    for c in ("lo", "hi"):
        coarse = f"((l_total * l_{c} + {PRIOR} * a_{c}) div (l_total + {PRIOR}))"
        both = both.withColumn(f"used_{c}", F.expr(f"(total * {c} + {PRIOR} * {coarse}) div (total + {PRIOR})"))
    of = lambda c, m: F.max(F.when(F.col("metric") == m, F.col(f"used_{c}"))).alias(f"{c}_{m}")
    return both.groupBy(lang, source).agg(*(of(c, r.metric) for r in RULES for c in ("hi", "lo")))


def within_fences() -> Column:
    ok = F.lit(True)
    for r in RULES:
        ok = ok & (F.col(r.metric) <= F.col(f"__lx_hi_{r.metric}")) & (F.col(r.metric) >= F.col(f"__lx_lo_{r.metric}"))
    return ok


def judge_signals(signals: DataFrame, lang: str = "lang", source: str = "source", least_docs: int = 50) -> DataFrame:
    """All rows of `signals` (of with_signals, with any columns) and kept.

    The signals are written once, as the thresholds come from all rows; the thresholds, one row for each language and
    source, are written too, so that the join is a broadcast one only if their size allows it.
    """
    judged = materialize(signals, "quality-signals")
    sketch = materialize(sketches(judged.filter("not base_failed"), [lang, source]), "quality-sketch", 8)
    limits = materialize(thresholds(sketch, lang, source, least_docs), "quality-thresholds", 1)
    limits = limits.withColumnsRenamed({lang: "__lx_lang", source: "__lx_source"} | {f"{c}_{r.metric}": f"__lx_{c}_{r.metric}" for r in RULES for c in ("hi", "lo")})
    out = judged.join(limits, F.col(lang).eqNullSafe(F.col("__lx_lang")) & F.col(source).eqNullSafe(F.col("__lx_source")), "left")
    names = [c for c in judged.columns if c != "kept"]
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(within_fences(), F.lit(False))).select(*quoted(names), "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with the columns of `docs`."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__lx_doc"), "text", "lang", "source")
    passed = judge_signals(with_signals(whole).drop("text")).filter("kept")
    return passed.select("__lx_doc.*")
