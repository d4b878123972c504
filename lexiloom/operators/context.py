"""Words in context: concordance, parallel passages, collocations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import statistics as S
from lexiloom.functions import text as T
from lexiloom.operators.frequency import of_stems, of_works
from lexiloom.plans.corpus import Corpus

MOST_ROWS = 500


def _hits(corpus: Corpus, stems, work_ids) -> DataFrame:
    found = of_stems(of_works(corpus.lemma_index, work_ids), stems).groupBy("work_id", "verse_id").agg(F.count("*").alias("hits"), F.array_sort(F.collect_set("surface")).alias("matched_forms"))
    return found.join(corpus.verses.drop("work_id"), "verse_id")


def _numbered(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("work_id").orderBy("division_ordinal", "chapter", "number", "verse_id")
    return rows.withColumn("row_in_work", F.row_number().over(order))


def concordance(corpus: Corpus, stems, work_ids: Iterable[str] | None = None, limit: int = 100, offset: int = 0, per_work: int = 40) -> DataFrame:
    """Verses with a hit in reading order (tradition, division, chapter, number; then work and verse_id), at most
    `per_work` of each work before paging, so that large works leave room for small ones."""
    rows = _numbered(_hits(corpus, stems, work_ids)).filter(F.col("row_in_work") <= per_work)
    rows = rows.orderBy("tradition", "division_ordinal", "chapter", "number", "work_id", "verse_id").offset(max(0, offset)).limit(max(0, min(limit, MOST_ROWS)))
    titles = F.broadcast(corpus.works.select("work_id", F.col("title").alias("work_title")))  # a row for each work
    rows = rows.join(titles, "work_id").orderBy("tradition", "division_ordinal", "chapter", "number", "work_id", "verse_id")
    return rows.select("work_id", "work_title", "tradition", F.col("division_name").alias("division"), "verse_id", "ref", "text", "hits", F.array_join("matched_forms", ",").alias("matched_forms"), "row_in_work")


def concordance_total(corpus: Corpus, stems) -> DataFrame:
    """The number of verses with a hit, in all works, whatever the limits of a page."""
    return of_stems(corpus.lemma_index, stems).select("verse_id").distinct().agg(F.count("*").alias("total"))


def parallel(corpus: Corpus, stems, work_ids: Iterable[str] | None = None, per_work: int = 5) -> DataFrame:
    """The first passages of each work."""
    rows = _numbered(_hits(corpus, stems, work_ids)).filter(F.col("row_in_work") <= per_work)
    return rows.select("work_id", "tradition", "row_in_work", "ref", "text", "hits").orderBy("work_id", "row_in_work")


def _stemmed_forms(near: DataFrame) -> DataFrame:
    """(language, surface, n, lemma): terms among neighbours (language, surface), counted by form before they are stemmed."""
    forms = near.filter(T.is_term(F.col("surface"), F.col("language"))).groupBy("language", "surface").agg(F.count("*").alias("n"))
    return T.stemmed(forms, "surface", "language")


def collocations(corpus: Corpus, stems, work_id: str | None = None, window: int = 5, min_freq: int = 3, limit: int | None = 40) -> DataFrame:
    """Neighbours within `window` words of a hit, by PMI; the most frequent `limit` of them.

    A neighbour near two hits counts twice. The words around hits of a few stems are slices of their verse's own row,
    counted by form and stemmed then, so that neither the index nor texts are exchanged. In a corpus that was written the
    hits go to the buckets of verses for that. Hits of stems that are a table are exploded to the places around them, which
    then join the index on verse and place, so that long verses don't multiply. The work limits the pairs, not the totals.
    """
    anchors = of_stems(corpus.lemma_index, stems)
    hits = of_works(anchors, [work_id] if work_id else None).select("verse_id", "position")
    p = F.col("position")
    around = F.concat(F.slice("words", F.greatest(p - window, F.lit(0)) + 1, F.least(p, F.lit(window))), F.slice("words", p + 2, F.lit(window)))
    if corpus.places is not None:
        pairs = _stemmed_forms(corpus.places.join(hits, "verse_id").select("language", F.explode(around).alias("surface")))
    elif not isinstance(stems, DataFrame):
        placed = of_works(corpus.words, [work_id] if work_id else None).select("language", "words", F.posexplode("words").alias("position", "surface"))
        found = of_stems(T.stemmed(placed.filter(T.is_term(F.col("surface"), F.col("language"))), "surface", "language"), stems)
        pairs = _stemmed_forms(found.select("language", F.explode(around).alias("surface")))
    else:
        around = F.filter(F.sequence(F.col("position") - window, F.col("position") + window), lambda p: p != F.col("position"))
        places = hits.select("verse_id", F.explode(around).alias("position"))
        near = corpus.lemma_index.join(places.select("verse_id").distinct(), "verse_id", "left_semi")  # few verses have an anchor
        pairs = near.join(places, ["verse_id", "position"]).withColumn("n", F.lit(1).cast("long"))
    own = of_stems(pairs, stems).select("lemma").distinct() if isinstance(stems, DataFrame) else None
    pairs = pairs.join(own, "lemma", "left_anti") if own is not None else pairs.filter(~F.col("lemma").isin(*[s for s in stems if s] or [""]))
    joint = pairs.groupBy("lemma").agg(F.sum("n").alias("joint_count"), F.min("surface").alias("example")).filter(F.col("joint_count") >= min_freq)
    joint = joint.orderBy(F.desc("joint_count"), "lemma").limit(limit) if limit else joint
    counts = corpus.lemma_counts.groupBy("lemma").agg(F.sum("count").alias("__lx_own"))
    totals = counts.join(joint.select("lemma"), "lemma", "left_semi")
    sizes = corpus.works.agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("__lx_corpus")).crossJoin(anchors.agg(F.count("*").alias("__lx_anchors")))
    rows = joint.join(totals, "lemma").crossJoin(F.broadcast(sizes))  # one row
    score = S.pmi(F.col("joint_count"), F.col("__lx_anchors"), F.col("__lx_own"), F.col("__lx_corpus"))
    return rows.select("lemma", "example", "joint_count", score.alias("pmi")).orderBy(F.desc("pmi"), "lemma")
