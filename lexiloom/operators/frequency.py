"""Frequency, dispersion and keyness of a set of stems."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import statistics as S
from lexiloom.functions import text as T
from lexiloom.plans.corpus import Corpus

NO_SECTION = "Sin sección"


def of_stems(rows: DataFrame, stems: Iterable[str] | DataFrame) -> DataFrame:
    """Rows whose lemma is among the stems; a DataFrame (lemma) of many stems is joined, by the size that Catalyst sees."""
    if isinstance(stems, DataFrame):
        return rows.join(stems.select("lemma").distinct(), "lemma", "left_semi")
    stems = [s for s in stems if s]
    if stems and "surface" in rows.columns:
        rows = rows.filter(T.may_have_stem(F.col("surface"), stems))
    return rows.filter(F.col("lemma").isin(*stems)) if stems else rows.filter("false")


def of_works(rows: DataFrame, work_ids: Iterable[str] | None) -> DataFrame:
    work_ids = list(work_ids or [])
    return rows.filter(F.col("work_id").isin(*work_ids)) if work_ids else rows


def dispersion(corpus: Corpus, stems) -> DataFrame:
    """(work_id, divisions_present, divisions_total, dispersion), works without hits included."""
    hit = of_stems(corpus.lemma_index, stems).select("work_id", "division_id").distinct().groupBy("work_id").agg(F.count("*").alias("divisions_present"))
    all_works = corpus.works.select("work_id", F.col("divisions").alias("divisions_total"))
    out = all_works.join(hit, "work_id", "left").fillna(0, ["divisions_present"])
    return out.select("work_id", "divisions_present", "divisions_total", S.ratio(F.col("divisions_present"), F.col("divisions_total")).alias("dispersion"))


def frequency_by_work(corpus: Corpus, stems, work_ids: Iterable[str] | None = None) -> DataFrame:
    """All works, those without hits too. A verse with two of the stems counts twice in verse_count."""
    hits = of_stems(of_works(corpus.lemma_index, work_ids), stems).groupBy("work_id", "division_id", "lemma", "verse_id").agg(F.count("*").alias("n"))
    divisions = hits.groupBy("work_id", "division_id").agg(F.sum("n").alias("n"), F.count("*").alias("verses"))
    found = divisions.groupBy("work_id").agg(F.sum("n").alias("raw_count"), F.sum("verses").alias("verse_count"), F.count("*").alias("divisions_present"))
    out = of_works(corpus.works, work_ids).join(found, "work_id", "left").fillna(0, ["raw_count", "verse_count", "divisions_present"])
    spread = S.ratio(F.col("divisions_present"), F.col("divisions")).alias("dispersion")
    return out.select("work_id", "title", "tradition", "language", "raw_count", "verse_count", "total_tokens", S.rate(F.col("raw_count"), F.col("total_tokens")).alias("per_10k"), spread, "divisions_present", F.col("divisions").alias("divisions_total"))


def frequency_by_division(corpus: Corpus, stems, work_id: str) -> DataFrame:
    """All divisions of a work in their order; empty for an unknown work."""
    found = of_stems(corpus.lemma_index.filter(F.col("work_id") == work_id), stems).groupBy("division_id").agg(F.count("*").alias("raw_count"))
    out = corpus.divisions.filter(F.col("work_id") == work_id).join(found, "division_id", "left").fillna(0, ["raw_count"])
    return out.select("ordinal", "name", "section", "raw_count", "total_tokens", S.rate(F.col("raw_count"), F.col("total_tokens")).alias("per_10k")).orderBy("ordinal")


def against_the_rest(rows: DataFrame, count: str, tokens: str) -> DataFrame:
    """Each row's keyness against the sum of all others; rows are as few as works or sections are."""
    everything = rows.agg(F.sum(count).alias("__lx_n"), F.sum(tokens).alias("__lx_t"))
    joined = rows.crossJoin(F.broadcast(everything))  # one row
    a, c = F.col(count), F.col(tokens)
    return S.with_keyness(joined, a, F.col("__lx_n") - a, c, F.col("__lx_t") - c).drop("__lx_n", "__lx_t")


def keyness_matrix(corpus: Corpus, stems, work_ids: Iterable[str] | None = None) -> DataFrame:
    """Each work against the sum of the others."""
    rows = frequency_by_work(corpus, stems, work_ids).select("work_id", "raw_count", "total_tokens", "per_10k")
    return against_the_rest(rows, "raw_count", "total_tokens").orderBy(F.desc("log_likelihood"), "work_id")


def keyness_pair(corpus: Corpus, stems, target: str, reference: str) -> DataFrame:
    """One work against another; empty if either is unknown."""
    rows = frequency_by_work(corpus, stems, [target, reference])
    columns = [F.max(F.when(F.col("work_id") == w, F.col(c))).alias(f"{p}_{c}") for w, p in ((target, "target"), (reference, "reference")) for c in ("work_id", "raw_count", "total_tokens", "per_10k")]
    out = rows.agg(*columns).filter("target_work_id is not null and reference_work_id is not null")  # rows are read once
    return S.with_keyness(out, F.col("target_raw_count"), F.col("reference_raw_count"), F.col("target_total_tokens"), F.col("reference_total_tokens"))


def frequency_by_section(corpus: Corpus, stems, work_id: str) -> DataFrame:
    """Sections of a work in order of their first division, each against the rest of the work."""
    section = F.coalesce("section", F.lit(NO_SECTION))
    own = corpus.divisions.filter(F.col("work_id") == work_id)
    hits = of_stems(corpus.lemma_index.filter(F.col("work_id") == work_id), stems).groupBy("division_id").agg(F.count("*").alias("n"))
    rows = own.join(hits, "division_id", "left").groupBy(section.alias("section")).agg(
        F.count("*").alias("divisions"), F.sum("total_tokens").alias("total_tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("raw_count"), F.min("ordinal").alias("__lx_o")
    )
    rows = rows.withColumn("per_10k", S.rate(F.col("raw_count"), F.col("total_tokens")))
    return against_the_rest(rows, "raw_count", "total_tokens").orderBy("__lx_o").drop("__lx_o")


def heatmap(corpus: Corpus, stems) -> DataFrame:
    """Rates of all divisions with an intensity from 0.08 to 0.93 by the highest rate of the work, 0 without hits."""
    found = of_stems(corpus.lemma_index, stems).groupBy("division_id").agg(F.count("*").alias("raw_count"))
    rows = corpus.divisions.join(found, "division_id", "left").fillna(0, ["raw_count"]).withColumn("per_10k", S.rate(F.col("raw_count"), F.col("total_tokens")))
    most = F.max("per_10k").over(Window.partitionBy("work_id"))
    shade = F.when(F.col("per_10k") > 0, F.round(0.08 + 0.85 * F.col("per_10k") / most, 4)).otherwise(F.lit(0.0))
    return rows.select("work_id", "ordinal", "raw_count", "per_10k", shade.alias("intensity"))


def surface_forms(corpus: Corpus, stems, work_id: str | None = None) -> DataFrame:
    """The written forms of the stems, with their share in per cent."""
    hits = of_stems(of_works(corpus.lemma_index, [work_id] if work_id else None), stems)
    per_verse = hits.groupBy("surface", "verse_id").agg(F.count("*").alias("n"))
    forms = per_verse.groupBy("surface").agg(F.sum("n").alias("count"), F.count("*").alias("verse_count"))
    total = per_verse.agg(F.greatest(F.lit(1), F.coalesce(F.sum("n"), F.lit(0))).alias("__lx_t"))  # of the same exchange
    return forms.crossJoin(F.broadcast(total)).select("surface", "count", "verse_count", F.round(100 * F.col("count") / F.col("__lx_t"), 1).alias("share")).orderBy(F.desc("count"), "surface")


def top_surface(corpus: Corpus) -> DataFrame:
    """The most frequent written form of each lemma; ties go to the first in order."""
    counts = corpus.form_totals.groupBy("lemma", "surface").agg(F.sum("count").alias("count"))
    best = counts.groupBy("lemma").agg(F.max("count").alias("count"), F.min_by("surface", F.struct(-F.col("count"), F.col("surface"))).alias("surface"))
    return best.select("lemma", "surface", "count")


def distinctive_vocabulary(corpus: Corpus, work_id: str, work_ids: Iterable[str] | None = None, limit: int | None = 50, min_count: int = 5) -> DataFrame:
    """Lemmas that are significantly more frequent in a work than in the others (of `work_ids`)."""
    totals, works = of_works(corpus.lemma_counts, work_ids), of_works(corpus.works, work_ids)
    own = F.col("work_id") == work_id
    counts = totals.groupBy("lemma").agg(F.sum(F.when(own, F.col("count")).otherwise(0)).alias("count"), F.sum(F.when(own, 0).otherwise(F.col("count"))).alias("count_elsewhere")).filter(F.col("count") >= min_count)
    sizes = works.agg(F.sum(F.when(own, F.col("total_tokens"))).alias("__lx_c"), F.coalesce(F.sum(F.when(~own, F.col("total_tokens"))), F.lit(0)).alias("__lx_d"))
    rows = counts.crossJoin(F.broadcast(sizes))  # one row
    rows = S.with_keyness(rows, F.col("count"), F.col("count_elsewhere"), F.col("__lx_c"), F.col("__lx_d")).filter("effect_size > 0 and significant")
    out = rows.select("lemma", "count", "count_elsewhere", S.rate(F.col("count"), F.col("__lx_c")).alias("per_10k"), "log_likelihood", "effect_size").orderBy(F.desc("log_likelihood"), "lemma")
    return out.limit(limit) if limit else out
