"""A corpus from many sources, one batch for each, where a source that fails needn't stop the others."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.health import validate_language
from lexiloom.plans.corpus import Corpus
from lexiloom.sources.registry import Source, load
from lexiloom.streaming import ingest

# What a report calls the outcome of a source.
OK, LOADING, LOADED, FAILED = "ok", "descargando", "ya-descargado", "error"
REPORT = "work_id string, status string, verses long, tokens long, divisions long, error string"


def _load(spark: SparkSession, source: Source, path: str, folder: str) -> tuple[int, int, int]:
    """Verses, tokens and divisions that a source has brought, in place of what its work had before."""
    rows = load(spark, source, path)
    found = validate_language(Corpus(rows)).first()
    if found is None:
        return 0, 0, 0
    if not found["valid"]:
        raise ValueError(f"{source.title} ({source.edition}): {found['script']} ({found['share']:.0%} of the letters) where {source.language} is written in {found['expected']}")
    batch = max(ingest.committed(spark, folder), default=-1) + 1
    ingest.ingest_batch(rows, batch, folder, replaces=True, checked=True)
    own = ingest.rows_of_batch(spark, folder, "divisions", batch)
    return tuple(x or 0 for x in own.agg(F.sum("total_verses"), F.sum("total_tokens"), F.count("*")).first())


def build(spark: SparkSession, sources: Iterable[tuple[Source, str]], folder: str, skip_failed: bool = False, resume: bool = True, on_progress: Callable[[str, str], None] | None = None) -> DataFrame:
    """Ingests (source, path of its files) one after the other, and reports (work_id, status, verses, tokens, divisions,
    error) of each, in order. Files are read when it is a source's turn.

    With `resume`, works that have verses in the folder aren't loaded again. An error of a source is raised, or with
    `skip_failed` becomes its row of the report; nothing of that source counts then, and its work stays as it was. The
    batch of a source isn't committed before all of its files were read. A source without verses loads nothing.
    """
    notify = on_progress or (lambda work, status: None)
    report: list[tuple] = []
    for source, path in sources:
        if resume and not ingest.works(spark, folder).filter((F.col("work_id") == source.work_id) & (F.col("total_verses") > 0)).isEmpty():
            report.append((source.work_id, LOADED, None, None, None, None))
            notify(source.work_id, LOADED)
            continue
        notify(source.work_id, LOADING)
        try:
            report.append((source.work_id, OK, *_load(spark, source, path, folder), None))
        except Exception as e:
            if not skip_failed:
                raise
            report.append((source.work_id, FAILED, None, None, None, str(e)))
        notify(source.work_id, report[-1][1])
    return spark.createDataFrame(report, REPORT)
