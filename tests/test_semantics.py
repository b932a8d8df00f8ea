"""Hand-computed cases and invariants on random vectors."""

import random

import pytest
from pyspark.sql import functions as F

from kindred import run
from kindred.functions import vector as V
from kindred.model import Params, prepare
from kindred.operators import evaluate, hashing, ranking, similarity, summary
from kindred.sources import vectors as source
from kindred.streaming import scoring


def rel(spark, rows, planes=None):
    df = prepare(spark.createDataFrame(rows, "i long, e array<double>"), "i", "e")
    return hashing.with_bucket(df, planes) if planes is not None else df


def noise(n, dims, seed, start=0):
    rng = random.Random(seed)
    return [(start + i, [rng.gauss(0, 1) for _ in range(dims)]) for i in range(n)]


def out(df):
    return [(r["id"], round(r["sim"], 9)) for r in df.collect()]


def test_signature_msb_first_sign_boundary_and_zero_vector(spark):
    got = rel(spark, [(0, [1.0, -1.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], [[1.0, 0.0], [0.0, 1.0]])
    assert {r["id"]: r["bucket"] for r in got.collect()} == {0: 2, 1: 3, 2: 3}


def test_recall_of_two_lists(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    r = evaluate.recall(ids([1, 3, 8, 4, 5, 6, 7]), ids([1, 2, 8, 10, 5, 6, 7])).first()
    assert (r["matched"], r["total"]) == (5, 7)
    assert evaluate.recall(ids([]), ids([1])).first()["recall"] is None


def test_floor_ties_and_k_beyond_the_pool(spark):
    pool = rel(spark, [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (9, [0.0, 0.0])], [])
    seeds = rel(spark, [(0, [-1.0, 0.0])], [])
    assert out(similarity.brute_topk(pool, seeds, 1000)) == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert out(similarity.lsh_topk(pool, seeds, 1000)) == [(1, 0.0), (2, 0.0), (3, 0.0), (9, 0.0)]
    assert out(similarity.bound_topk(pool, seeds, 2)) == [(1, 0.0), (2, 0.0)]


def test_seedless_bucket(spark):
    planes = [[1.0, 0.0]]
    pool, seeds = rel(spark, [(1, [-1.0, 0.1]), (2, [1.0, 0.0])], planes), rel(spark, [(0, [1.0, 0.0])], planes)
    assert out(similarity.lsh_topk(pool, seeds, 5)) == [(2, 1.0), (1, 0.0)]
    assert out(similarity.bound_topk(pool, seeds, 5)) == [(2, 1.0)]


def test_single_seed_bound_is_the_cosine(spark):
    pool, seeds = rel(spark, noise(5, 4, 1), []), rel(spark, noise(1, 4, 2), [])
    got = similarity.candidates(pool, summary.bucket_summary(seeds), 0).select("id", F.col("ub").alias("sim"))
    want = {r["id"]: r["sim"] for r in similarity.cosine_pairs(pool, seeds).collect()}
    assert all(abs(s - want[i]) < 1e-6 for i, s in out(got))


@pytest.mark.parametrize("dims,bits,k,least", [(3, 3, 7, 1), (3, 0, 5, 10), (6, 4, 10, 1), (4, 2, 500, 1)])
def test_bounded_equals_bucketed_and_kernels_agree(spark, dims, bits, k, least):
    planes = V.random_planes(bits, dims, 4)
    pool = rel(spark, [*noise(200, dims, 5), (999, [0.0] * dims)], planes)
    seeds = rel(spark, [*noise(40, dims, 6), (998, [0.0] * dims)], planes)
    want = out(similarity.lsh_topk(pool, seeds, k, keep_unmatched=False))
    assert out(similarity.bound_topk(pool, seeds, k, least)) == want
    sql = dict(out(similarity.lsh_max_sim(pool, seeds)))
    arrow = dict(out(similarity.lsh_max_sim_arrow(pool, seeds)))
    assert sql.keys() == arrow.keys() and all(abs(sql[i] - arrow[i]) < 1e-8 for i in sql)
    brute = dict(out(similarity.brute_max_sim(pool, seeds)))
    assert all(sql[i] <= s + 1e-9 for i, s in brute.items())
    if not bits:
        assert all(abs(sql[i] - s) < 1e-8 for i, s in brute.items())


def test_per_query_ranking(spark):
    d = spark.createDataFrame([(0, i, float(i % 3)) for i in range(6)] + [(1, 7, 2.0)], "query_id long, id long, dist double")
    assert [r["id"] for r in ranking.perquery_topk(d.where("query_id = 0"), 3).orderBy("rank").collect()] == [0, 3, 1]
    assert {r["query_id"]: r["kth"] for r in ranking.perquery_kth(d, 3).collect()} == {0: 1.0, 1: 2.0}


@pytest.mark.parametrize("line", ["1,2,3,4", "1,2", "4,abc,6", "7,,9"])
def test_bad_rows_raise(spark, line, tmp_path):
    (tmp_path / "x").write_text(f"1,2,3\n{line}\n")
    with pytest.raises(Exception, match="not a row of 3 numbers"):
        source.read_delimited(spark, str(tmp_path / "x"), 3).collect()


def test_text_round_trips(spark, tmp_path):
    (tmp_path / "x").write_text("1,2,3\n4,5,6.5\n")
    assert [tuple(r) for r in source.read_delimited(spark, str(tmp_path / "x"), 3).collect()] == [(0, [1, 2, 3]), (1, [4, 5, 6.5])]
    planes = V.random_planes(3, 4)
    source.write_planes(hashing.planes_frame(spark, planes), str(tmp_path / "p"))
    assert [r["w"] for r in source.read_planes(spark, str(tmp_path / "p"), 4).orderBy("plane").collect()] == planes
    source.write_topk(spark.createDataFrame([(5, 0.1), (2, 0.9)], "id long, sim double"), str(tmp_path / "t"))
    assert [r["id"] for r in source.read_ids(spark, str(tmp_path / "t")).collect()] == [2, 5]


def test_parameters_are_checked():
    assert Params.from_args(["--pool", "a", "--seeds", "b", "--dims", "4", "--n-bits", "3"])[0].n_bits == 3
    for bad in ({"k": 0}, {"n_bits": 31}, {"kernel": "x"}, {"n_samples": 0}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_command_line_runs_every_mode(spark, tmp_path, capsys):
    for name, rows in (("pool", noise(40, 4, 3)), ("seeds", noise(12, 4, 4))):
        (tmp_path / name).write_text("\n".join(";".join(map(str, v)) for _, v in rows) + "\n")
    args = ["--pool", str(tmp_path / "pool"), "--seeds", str(tmp_path / "seeds"), "--dims", "4", "--k", "7", "--n-bits", "2", "--n-samples", "3", "--sep", ";"]
    call = lambda *more: run.main([*args, *more], spark)
    planes = ["--planes", str(tmp_path / "planes")]
    got = {"lsh": dict(out(call("--mode", "lsh", "--normal", "--save-planes", planes[1], "--out", str(tmp_path / "ids"))))}
    stored = [r["w"] for r in source.read_planes(spark, planes[1], 4).orderBy("plane").collect()]
    assert stored == V.random_planes(2, 4, 0, normal=True)
    assert [r["id"] for r in source.read_ids(spark, str(tmp_path / "ids")).collect()] == list(got["lsh"])
    said = capsys.readouterr()
    assert len(said.out.splitlines()) == 7 and "pool=40 seeds=12" in said.err
    pool, seeds = (rel(spark, noise(n, 4, s), stored) for n, s in ((40, 3), (12, 4)))
    cost = evaluate.lsh_cost(pool, seeds).first()["pairs"]
    assert f"cosines={cost}" in said.err  # counted in the run itself
    assert got["lsh"] == dict(out(similarity.lsh_topk(pool, seeds, 7)))
    for mode in ("brute", "balls", "bound"):
        got[mode] = dict(out(call("--mode", mode, *planes, "--baseline", str(tmp_path / "ids"))))
        said = capsys.readouterr().err
        assert len(got[mode]) == 7 and f"matched={len(set(got[mode]) & set(got['lsh']))}" in said and "search_s=" in said
        assert "cosines=480" in said or mode != "brute"
    for found in (got["balls"], dict(out(similarity.brute_topk(pool, seeds, 7, kernel="sql")))):
        assert got["brute"] == pytest.approx(found)
    assert dict(out(call("--mode", "bound", "--centroid", "medoid", *planes))) == pytest.approx(got["bound"])
    capsys.readouterr()
    found = {r["mode"]: r["matched"] for r in call("--mode", "compare", *planes).collect()}
    assert found == {m: len(set(got[x]) & set(got["brute"])) for m, x in (("lsh", "lsh"), ("best", "lsh"), ("bound", "bound"))}
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert [r["agrees"] for r in call("--mode", "kernels", *planes).collect()] == [True] * 4
    swept = call("--mode", "sweep", "--sweep", "1,4").collect()
    sets = [V.random_planes(2, 4, i) for i in range(4)]
    costs = {r["sample"]: r["cost"] for r in hashing.signature_cost(seeds, sets).collect()}
    assert [(r["samples"], r["cost"]) for r in swept] == [(1, costs[0]), (4, min(costs.values()))]


def test_stream_scores_match_batch(spark, tmp_path, monkeypatch):
    """Over several arrivals, a restart and a batch that dies half-way: a row for each id, and the k best of all."""
    planes, home = V.random_planes(2, 3), f"file://{tmp_path}"
    pool, seeds = rel(spark, noise(60, 3, 8), planes).cache(), rel(spark, noise(900, 3, 9), planes)
    want = similarity.lsh_max_sim(pool, seeds, keep_unmatched=False)
    stream = lambda: spark.readStream.schema(pool.schema).parquet(f"{tmp_path}/in")
    for k in range(3):
        pool.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k == 2:  # the last arrival dies at first
            with monkeypatch.context() as m:
                m.setattr(scoring, "topk", lambda *a: 1 / 0)
                with pytest.raises(Exception, match="ZeroDivision"):
                    scoring.topk_stream(stream(), seeds, 7, f"{home}/top").awaitTermination()
        scoring.score_stream(stream(), seeds, f"{home}/all").awaitTermination()
        scoring.topk_stream(stream(), seeds, 7, f"{home}/top").awaitTermination()
        arrived = want.where(F.col("id") % 3 <= k)
        assert sorted(out(spark.read.parquet(f"{tmp_path}/all/scores").select("id", "sim"))) == sorted(out(arrived))
        assert out(scoring.best_so_far(spark, f"{home}/top")) == out(ranking.topk(arrived, 7))


def test_random_planes_decide_the_bucket(spark, sf_dir):
    import numpy as np

    from kindred.plans import catalog

    planes = np.array(V.random_planes(catalog.BITS, catalog.DIMS, 7))
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    want = {i: sum(int(d >= 0) << (catalog.BITS - 1 - b) for b, d in enumerate(planes @ x)) for i, x in v.items()}
    assert {r["id"]: r["bucket"] for r in catalog.lsh_random_planes(spark, sf_dir).collect()} == want
