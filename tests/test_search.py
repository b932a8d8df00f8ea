"""Tiles, bounded search, ball index, per-query ranking, medoid and numbered lines against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from kindred.functions import vector as V
from kindred.model import prepare
from kindred.operators import bounded, index, similarity, summary, tiles
from kindred.plans import catalog
from kindred.sources import vectors as source
from tests.test_semantics import noise, out, rel


def clustered(n, dims, seed, start=0, centres=12, spread=0.05):
    rng = random.Random(3)
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    rng = random.Random(seed)
    return [(start + i, [x + rng.gauss(0, spread) for x in rng.choice(middle)]) for i in range(n)]


def matrix(rows):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    return ids, v / np.linalg.norm(v, axis=1)[:, None]


def one(df):
    return df.withColumn("bucket", F.lit(0))


ZERO, NULL = (900, [0.0] * 4), (901, None)


@pytest.mark.parametrize("count_rows,others", [(tiles.COUNT_ROWS, False), (0, True)])
def test_tiles_of_any_size_give_the_maxima(spark, monkeypatch, count_rows, others):
    monkeypatch.setattr(tiles, "COUNT_ROWS", count_rows)
    monkeypatch.setattr(tiles, "CHUNK", 7)
    rows = [*noise(120, 4, 1), ZERO, NULL, (902, [1.0, 2.0])]
    seeds = [*(rows[:30] if others else noise(30, 4, 2, 300)), ZERO, NULL]
    grid = tiles.Grid(one(rel(spark, rows)), one(rel(spark, seeds)), 16, 8)
    assert (grid.rows, grid.cosines, grid.cells, grid.parts) == (120, 3600, 8 * 4, 8)
    got = dict(out(grid.run(tiles.best_cosine(others), tiles.SCORES).groupBy("id").agg(F.max("sim").alias("sim"))))
    (i, a), (j, b) = matrix(rows[:120]), matrix(seeds[:30])
    cos = a @ b.T
    if others:
        cos[i[:, None] == j] = -9
    assert got == pytest.approx(dict(zip(i.tolist(), np.maximum(cos.max(1), 0).tolist())))


def test_hot_bucket_is_split(spark):
    """90 % of the rows of both sides in one bucket: no cell has more than its tile's share, and no task more than a tenth."""
    mark = lambda n: rel(spark, noise(n, 4, n)).withColumn("bucket", F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99))
    pool, seeds = mark(3000), mark(1000)
    grid = tiles.Grid(pool, seeds, 256, 128)
    for side, tile in zip(grid.dealt(), (256, 128)):
        cells = [r["count"] for r in side.groupBy("bucket", "_w", "_part", "_block").count().collect()]
        assert max(cells) < 1.5 * tile and max(cells) <= sum(cells) / 10
    want = {r["id"]: r["sim"] for r in similarity.lsh_max_sim(pool, seeds, keep_unmatched=False).collect()}
    got = grid.run(tiles.best_cosine(), tiles.SCORES).groupBy("id").agg(F.max("sim").alias("sim"))
    assert dict(out(got)) == pytest.approx(want)


@pytest.mark.parametrize("k,others", [(1, False), (6, True), (500, False)])
def test_per_query_ranks_and_values(spark, monkeypatch, k, others):
    monkeypatch.setattr(tiles, "FAN_IN", 2)
    monkeypatch.setattr(tiles.Grid.__init__, "__defaults__", (13, 5))
    rows = [*noise(90, 4, 5), *[(200 + i, [1.0, 0.0, 0.0, float(i % 2)]) for i in range(20)]]  # many ties
    seeds = rows[::10] if others else noise(11, 4, 6)
    (i, a), (j, b) = matrix(rows), matrix(seeds)
    dist = 1 - a @ b.T
    want, kth = set(), {}
    for c, q in enumerate(j.tolist()):
        mine = sorted((round(float(d), 9), x) for d, x in zip(dist[:, c], i.tolist()) if not (others and x == q))[:k]
        want |= {(q, r, x, d) for r, (d, x) in enumerate(mine, 1)}
        kth[q] = mine[-1][0]
    args = rel(spark, [*rows, ZERO, NULL]), rel(spark, [*seeds, ZERO, NULL]), k, others
    got = {(r["query_id"], r["rank"], r["id"], round(r["dist"], 9)) for r in tiles.perquery_topk(*args).collect()}
    assert {x[:3] for x in got} == {x[:3] for x in want}
    plan = tiles.perquery_topk(*args)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    values = {r["query_id"]: r["kth"] for r in tiles.perquery_kth(*args).collect()}
    assert values == pytest.approx(kth, abs=1.1e-9)


@pytest.mark.parametrize(
    "make,dims,bits,k,least,centroid,others",
    [(noise, 3, 3, 7, 1, "mean", False), (noise, 3, 0, 5, 10, "medoid", True), (clustered, 8, 3, 10, 1, "mean", True), (clustered, 8, 2, 900, 1, "mean", False), (noise, 5, 4, 1, 3, "medoid", False)],
)
def test_moving_threshold_keeps_the_answer(spark, make, dims, bits, k, least, centroid, others):
    planes, rows = V.random_planes(bits, dims, 4), make(300, dims, 5)
    pool = rel(spark, [*rows, (999, [0.0] * dims), (998, None)], planes)
    seeds = rel(spark, [*(rows[::6] if others else make(60, dims, 6)), (997, [0.0] * dims)], planes)
    report = bounded.Report()
    got = out(bounded.bound_topk(pool, seeds, k, least, centroid, others, report))
    assert got == out(similarity.lsh_topk(pool, seeds, k, keep_unmatched=False, others=others, kernel="sql"))
    assert report.scored <= report.candidates and report.taus == sorted(report.taus)


def test_moving_threshold_scores_less_than_a_fixed_one(spark):
    """Phase 1 of a fixed threshold scores all certain rows; rounds stop earlier."""
    planes = V.random_planes(3, 3, 4)
    pool, seeds = rel(spark, noise(2000, 3, 5), planes), rel(spark, noise(200, 3, 6), planes)
    report = bounded.Report()
    got = out(bounded.bound_topk(pool, seeds, 20, 10, report=report))
    assert got == out(similarity.lsh_topk(pool, seeds, 20, keep_unmatched=False))
    cand = similarity.candidates(pool, summary.bucket_summary(seeds), 10)
    fixed = similarity.bound_prune_stats(pool, seeds, 20).first()
    scored = cand.count() - fixed["pruned"]
    assert report.rounds >= 1 and report.scored <= scored and report.scored_cosines < report.cosines


@pytest.mark.parametrize("make,k,balls,others", [(noise, 9, None, False), (clustered, 9, None, True), (clustered, 700, 5, True), (clustered, 9, 1, False)])
def test_ball_index_is_exact(spark, make, k, balls, others):
    rows = make(400, 8, 7)
    pool, seeds = rel(spark, [*rows, (999, [0.0] * 8)]), rel(spark, rows[::5] if others else make(80, 8, 8))
    assert out(bounded.ball_topk(pool, seeds, k, others, balls)) == out(similarity.brute_topk(pool, seeds, k, others, kernel="sql"))


def test_ball_index_grows_slower_than_the_product(spark):
    """On structured vectors, five times the rows and seeds take far less than 25 times the cosines."""
    took = []
    for n in (1000, 5000):
        report = bounded.Report()
        bounded.ball_topk(rel(spark, clustered(n, 16, 1, centres=40)), rel(spark, clustered(n // 5, 16, 2, 10**6, centres=40)), 10, report=report)
        took.append(report.scored_cosines + report.overhead)
        assert took[-1] < n * (n // 5) / 2 and report.scored < report.pairs / 5
    assert took[1] < 15 * took[0]


def test_searches_of_nothing(spark):
    pool, none = rel(spark, noise(9, 4, 1), [[1.0, 0, 0, 0]]), rel(spark, [ZERO], [[1.0, 0, 0, 0]])
    for a, b in ((pool, none), (none, pool), (none, none)):
        assert not bounded.ball_topk(a, b, 3).count() and not bounded.bound_topk(a, b, 3).count() and not similarity.brute_topk(a, b, 3).count()
        assert not tiles.perquery_topk(a, b, 3).count() and not tiles.perquery_kth(a, b, 3).count()
    assert summary.bucket_medoid(none).count() == 0
    alone, report = rel(spark, noise(1, 4, 1), [[1.0, 0, 0, 0]]), bounded.Report()
    assert not bounded.bound_topk(alone, alone, 3, 1, others=True, report=report).count() and report.scored_cosines == 0
    assert not bounded.ball_topk(alone, alone, 3, True).count()


def plain_medoid(rows, bucket):
    out = {}
    for b in set(bucket.values()):
        ids, v = matrix(sorted(r for r in rows if bucket[r[0]] == b))
        worst = np.round((v @ v.T).min(1), 9)
        out[b] = (int(ids[worst.argmax()]), float(worst.max()))
    return out


@pytest.mark.parametrize("make,bits", [(noise, 3), (clustered, 2)])
def test_medoid_equals_all_pairs(spark, make, bits):
    rows = [*make(300, 6, 2), *[(700 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(4)]]
    seeds = rel(spark, [*rows, (999, [0.0] * 6)], V.random_planes(bits, 6, 1)).cache()
    bucket = {r["id"]: r["bucket"] for r in seeds.collect()}
    got = {r["bucket"]: (r["seed_id"], round(r["min_cos"], 9)) for r in summary.bucket_medoid(seeds).collect()}
    want = plain_medoid(rows, bucket)
    assert {b: x[0] for b, x in got.items()} == {b: x[0] for b, x in want.items()}
    assert all(abs(got[b][1] - want[b][1]) < 2e-9 for b in want)


def test_medoid_judges_few(spark):
    """One hot bucket of structured vectors: far fewer cosines than its square."""
    rows, counted = clustered(3000, 8, 2, centres=1, spread=0.3), []
    got = summary.bucket_medoid(one(rel(spark, rows)), counted).first()
    assert got["seed_id"] == plain_medoid(rows, dict.fromkeys(range(3000), 0))[0][0]
    assert sum(counted) < 3000 * 3000 / 5


def test_lines_are_numbered_over_files_and_ranges(spark, tmp_path):
    want = []
    for name in ("b", "a", "c"):
        lines = [f"{name}{i} " + "x" * (i % 50) if i % 9 else "" for i in range(300)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want.append((name, lines))
    want = [x for _, lines in sorted(want) for x in lines]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = source.numbered_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 3
        assert [r["value"] for r in got.orderBy("id").collect()] == want
        assert [r["id"] for r in got.orderBy("id").collect()] == list(range(900))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("others", [False, True])
def test_index_compares_candidates_only(spark, monkeypatch, others):
    """Equal to a plain search of the same buckets, with several blocks of seeds; all probes give the exact answer."""
    rows = clustered(300, 6, 4)
    pool, seeds = [*rows, (999, [0.0] * 6)], rows[::7] if others else clustered(60, 6, 5, 10**6)
    planes = [V.random_planes(5, 6, t, normal=True) for t in range(3)]
    monkeypatch.setattr(index, "SEED_TILE", 9)
    (i, a), (j, b) = matrix(rows), matrix(seeds)
    cand = np.zeros((len(i), len(j)), bool)
    for w in np.array(planes):
        for c, d in enumerate(b @ w.T):
            cost = sorted((sum(x * x for k, x in enumerate(d) if m >> (4 - k) & 1), m) for m in range(32))[:4]
            own = sum(int(x >= 0) << (4 - k) for k, x in enumerate(d))
            keys = [sum(int(x >= 0) << (4 - k) for k, x in enumerate(y)) for y in a @ w.T]
            cand[:, c] |= np.isin(keys, [own ^ m for _, m in cost])
    if others:
        cand &= i[:, None] != j
    sim = np.where(cand, a @ b.T, -9).max(1)
    want = {int(x): max(float(s), 0.0) for x, s in zip(i, sim) if s > -9}
    seen = Observation()
    args = rel(spark, pool), rel(spark, seeds), 1000, planes
    assert dict(out(index.index_topk(*args, 4, others, seen))) == pytest.approx(want)
    assert seen.get["cosines"] == cand.sum() < 0.6 * cand.size
    assert out(index.index_topk(*args, 32, others)) == out(similarity.brute_topk(*args[:2], 1000, others))


def test_index_has_the_recall_of_an_index(spark, sf_dir):
    got = catalog.QUERIES["recall_index"](spark, sf_dir).first()
    assert got["recall"] >= 0.9 and got["share"] < 0.4


ODD = [(900, [0.0] * 4), (901, None), (902, [1.0, None, 0.0, 2.0]), (903, [1.0, 2.0]), (904, []), (None, [1.0, 1.0, 0.0, 0.5])]


@pytest.mark.parametrize("others", [False, True])
def test_every_pair_comes_out_of_tiles(spark, monkeypatch, others):
    """As a cross join with expressions, nulls included; the pairs are made in cells, not row by row in a nested loop."""
    monkeypatch.setattr(tiles, "PAIR_ROWS", 16)
    monkeypatch.setattr(tiles, "PAIR_SEEDS", 7)
    pool, seeds = rel(spark, [*noise(60, 4, 1), *ODD]), rel(spark, [*noise(60, 4, 1)[::4], *ODD, (905, [3.0, 1.0])])
    s = seeds.select(F.col("id").alias("seed_id"), F.col("v").alias("sv"), F.col("norm").alias("sn"))
    both = pool.crossJoin(s)
    both = both.where("id <> seed_id") if others else both
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for cosine, x in ((True, V.cosine("v", "sv", "norm", "sn")), (False, V.dot("v", "sv"))):
        for digits in (None, 6):
            got = tiles.every_pair(pool, seeds, cosine, others, digits)
            plan = got._jdf.queryExecution().toString()
            assert "Cartesian" not in plan and "NestedLoop" not in plan
            rows = sorted((tuple(r) for r in got.collect()), key=key)
            want = sorted((tuple(r) for r in both.select("id", "seed_id", x if digits is None else F.round(x, digits)).collect()), key=key)
            assert [r[:2] for r in rows] == [r[:2] for r in want] and [r[2] for r in rows] == pytest.approx([r[2] for r in want], abs=1e-12)
    assert tiles.every_pair(pool, seeds.where("false")).isEmpty()


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(1)
    values = [0.0000005, -0.0000005, 0.1234565, 2.5000005, -1e-9, 1.0, 1e300, -1e17, 123456789.0000005, 9007199254.7409915, float("inf"), 2.0**33 + 0.1, 0.0000015, 1.0000004999999999]
    values += [round(rng.uniform(-9, 9), 7) for _ in range(2000)] + [rng.gauss(0, 1) for _ in range(2000)]
    want = [r["y"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", F.round("x", 6).alias("y")).orderBy("i").collect()]
    got = tiles.rounded(np.array(values), 6).tolist()
    assert got == want and not any(str(x) == "-0.0" for x in got) and np.isnan(tiles.rounded(np.array([np.nan]), 6)[0])


def test_figures_of_pairs_without_pairs(spark):
    pool, seeds = rel(spark, [*noise(60, 4, 1), *ODD]), rel(spark, [*noise(20, 4, 2), *ODD])
    got = {r["id"]: (r["pairs"], r["best"]) for r in similarity.cosine_stats(pool, seeds).collect()}
    want = similarity.cosine_pairs(pool, seeds).groupBy("id").agg(F.count("sim").alias("pairs"), F.max("sim").alias("best"))
    want = {r["id"]: (r["pairs"], r["best"]) for r in want.collect()}
    assert got.keys() == want.keys() and all(got[i][0] == n and got[i][1] == pytest.approx(b) for i, (n, b) in want.items()) and want[900] == (0, None)
    assert similarity.cosine_stats(pool, seeds.where("false")).isEmpty()


@pytest.mark.parametrize("name", ["brute_max_sim", "brute_max_sim_all", "max_sim", "max_sim_all", "zero_norm_guard", "zero_norm_guard_all", "cosine_pairs", "cosine_pairs_all", "vec_dot_all"])
def test_pairs_are_multiplied_in_tiles(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" in plan and "_seeds" not in plan and "Cartesian" not in plan and plan.count("NestedLoop") <= ("guard" in name)


def test_pairs_shuffle_no_row_twice(spark, monkeypatch):
    """However many cells there are; before, a row was shuffled once for each tile of the other side."""
    monkeypatch.setattr(tiles, "PAIR_ROWS", 8)
    monkeypatch.setattr(tiles, "PAIR_SEEDS", 8)
    rng, width = np.random.default_rng(4), 64
    df = lambda lo, n: spark.createDataFrame([(lo + i, rng.normal(size=width).tolist()) for i in range(n)], "i long, x array<double>").coalesce(2).cache()
    pool, seeds = (prepare(x, "i", "x") for x in (df(0, 200), df(1000, 200)))
    store, jvm = spark._jsc.sc().statusStore(), spark.sparkContext._jvm

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = pool.count() - 200 + seeds.count() - 200 + shuffled()
    assert similarity.cosine_pairs(pool, seeds).select("id", "seed_id").toArrow().num_rows == 40_000
    assert shuffled() - before < 2 * 400 * width * 8


def cell(rows, **columns):
    import pyarrow as pa

    i, v = zip(*rows)
    return pa.table({"id": pa.array(i, pa.int64()), "v": pa.array(v, pa.list_(pa.float64())), "norm": np.linalg.norm(np.array(v), axis=1), **columns})


def test_counts_of_a_cell_follow_the_rank(spark):
    """A cell counts up to the rank sought, and the rest as one; before, each of a seed's bins."""
    n = len(cell(noise(3, 4, 3)))
    left, k = cell(noise(1500, 4, 4)), 5
    right = cell(noise(3, 4, 3), lo=np.zeros(n, int), hi=np.full(n, 2 * 10**9), rank=np.full(n, k))
    got = tiles.counted()(left, right)
    assert got.num_rows <= 3 * (k + 1) and got["n"].to_numpy().sum() == 4500


def test_lists_of_a_cell_are_compared_in_pieces():
    """Memory is that of a piece, not of all candidates of a cell (170 MB here before)."""
    import tracemalloc

    import pyarrow as pa

    seeds = noise(1000, 4, 1)
    left, right = noise(3000, 4, 2, 5000), cell(seeds)
    left = cell(left, near=pa.array([[q for q, _ in seeds]] * 3000, pa.list_(pa.int64())))
    (_, a), (_, b) = matrix(noise(3000, 4, 2, 5000)), matrix(seeds)
    tracemalloc.start()
    got = index._listed(False)(left, right)
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert peak < 60 and got["sim"].to_pylist() == pytest.approx(np.maximum((a @ b.T).max(1), 0).tolist()) and set(got["met"].to_pylist()) == {1000}
