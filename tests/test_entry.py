import numpy as np
import pytest

import __spark_entry__ as entry
from lexiloom.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "embeddings", "conversations")


@pytest.mark.parametrize("name", ["tokenize", "frequency_by_work", "keyness_matrix", "collocations", "concordance", "search_text", "search_ranked", "search_segments", "kept_dispersion", "collocations_placed", "detect_script", "normalize_text", "normalize_decomposed", "corpus_health", "vector_search_all", "cross_tradition_all", "vector_search_verses", "engine_means", "model_choice", "reduced_vectors", "highlight", "query_words", "translation_cache", "gloss", "frequency_table"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, FOLDER).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.select(*columns).fetchall()))


def test_groups_against_sql(spark, tmp_path):
    """The fold over a page in which many results are one passage, some of them by way of a leader alone."""
    rng = np.random.default_rng(8)
    texts = []
    for k in range(60):
        words = [f"word{chr(97 + k % 9)}{chr(97 + j)}" for j in range(10)]
        texts.append(" ".join([*rng.choice(words, int(rng.integers(5, 11)), replace=False), *("extra", "other")[: k % 3]]) if k % 7 else "")
    vectors = rng.normal(size=(len(texts), 8))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).tolist()  # unit vectors, as those of the tables
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["vector_search_grouped"]).fetchall()
    got = QUERIES["vector_search_grouped"](spark, str(tmp_path)).select("verse_id", "leader", "similarity").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.verse_id != r.leader for r in got) > 5 and len({r.leader for r in got}) == 20


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
