"""Times the headline queries; prints one line of JSON. BENCH_SF_DIR and BENCH_CPUS say on what and with how many cores.

The index is built once, and timed as `build_index`; each query then runs once to warm up, and the median of five more runs
counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexiloom.plans import queries as plain  # noqa: E402

HEADLINE = (
    "frequency_by_work", "dispersion", "frequency_by_division", "frequency_by_section", "keyness_matrix", "surface_forms", "collocations", "distinctive_vocabulary", "concordance", "parallel", "search_text", "vector_search", "cross_tradition",
    "strip_html", "validate_language",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        plain.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    began = time.perf_counter()
    corpus = plain.corpus_of(spark, folder).persist()
    for table in (corpus.words, corpus.lemma_index, corpus.text_postings, corpus.text_lengths, corpus.lemma_totals, corpus.divisions, corpus.works):
        table.count()
    took = {"build_index": time.perf_counter() - began}
    for name in HEADLINE:
        run(name)
        took[name] = sorted(run(name) for _ in range(5))[2]
    print(json.dumps({"metric": "total of the headline queries on a built index", "value": round(sum(v for k, v in took.items() if k != "build_index"), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in took.items()}, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
