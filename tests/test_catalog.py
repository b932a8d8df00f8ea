import numpy as np
import pytest

from kindred.plans import catalog
from tests.oracle import agree


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_agrees_with_sql(spark, sf_dir, name):
    agree(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLE[name])


def test_whole_table_is_searched(spark, sf_dir):
    """The query set id % 50 = 0 meets all rows but itself: rows with id % 5 = 0 are found too."""
    e = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in e.items()}
    best = {i: max([0.0] + [float(v @ unit[q]) for q in unit if q % 50 == 0 and q != i]) for i, v in unit.items()}
    want = sorted(best, key=lambda i: (-round(best[i], 9), i))[: catalog.K]
    assert any(i % 5 == 0 for i in want)
    for name in ("brute_topk_all", "brute_topk_arrow_all"):
        assert {r["id"] for r in catalog.QUERIES[name](spark, sf_dir).collect()} == set(want)


def test_reports_cover_all_rows(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    run = lambda name: catalog.QUERIES[name](spark, sf_dir)
    assert sum(r["cnt"] for r in run("bucket_hist_all").collect()) == n
    for name, col in (("bucket_members_all", "n"), ("bucket_summary_all", "n_seeds")):
        assert sum(r[col] for r in run(name).collect()) == n
    queries = (n + 49) // 50
    assert run("vec_dot_all").count() == queries * n - queries


def test_bound_reports_cover_whole_vectors(spark, sf_dir):
    """The 64-component reports split the rows that the 64-component search bounds."""
    run = lambda name: catalog.QUERIES[name](spark, sf_dir)
    split = run("bound_classify_64d").collect()
    assert sum(r["certain"] + r["deferred"] for r in split) == run("upper_bound").count()
    assert sum(r["deferred"] for r in split) == run("bound_prune_stats_64d").first()["deferred"]


def test_probing_reaches_the_recall_of_an_index(spark, sf_dir):
    assert catalog.QUERIES["recall_probed"](spark, sf_dir).first()["recall"] >= 0.9
