"""The registered queries over the `embeddings` table, each with the SQL that it must agree with.

Seeds are the vectors with vec_id % 5 = 0, the pool the rest. A search NAME_all takes the query set vec_id % 50 = 0 against
all rows but the query itself. Similarities are rounded to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kindred.functions import vector as V
from kindred.model import prepare
from kindred.operators import bounded, evaluate, hashing, index, ranking, similarity, summary, tiles
from kindred.sources import vectors as source
from kindred.sources.work import shared_root

K, BITS, DIMS, SAMPLES = 20, 5, 64, 10
#: Planes in which a probed bucket may differ, the fewest that give recall 0.9 on the whole table at sf0.01 and sf0.1.
FLIPS = 4
#: Hash tables of the index, planes of each, and buckets that a query looks into in each.
TABLES, PLANES, PROBES = 24, 10, 16
R6 = lambda c: F.round(c, 6)


def _both(spark: SparkSession, sf_dir: str, dims: int = DIMS, bits: int | None = BITS, others: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pool, seeds), with buckets unless bits is None; others: the pool is the whole table."""
    e = prepare(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", dims)
    e = e if bits is None else hashing.with_bucket(e, V.fixture_planes(bits, dims))
    if others:
        return e, e.where(F.col("id") % 50 == 0)
    return e.where(F.col("id") % 5 != 0), e.where(F.col("id") % 5 == 0)


def _all(spark: SparkSession, sf_dir: str, dims: int = DIMS, bits: int | None = BITS) -> DataFrame:
    e = prepare(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", dims)
    return e if bits is None else hashing.with_bucket(e, V.fixture_planes(bits, dims))


def _pool(spark: SparkSession, sf_dir: str, dims: int = DIMS, bits: int | None = BITS) -> DataFrame:
    return _both(spark, sf_dir, dims, bits)[0]


def _seeds(spark: SparkSession, sf_dir: str, dims: int = DIMS, bits: int | None = BITS) -> DataFrame:
    return _both(spark, sf_dir, dims, bits)[1]


def _samples(bits: int = BITS, dims: int = DIMS) -> list[list[list[float]]]:
    return [V.fixture_planes(bits, dims, s) for s in range(SAMPLES)]


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors reach; where spark.checkpoint.dir names none, it raises on a cluster."""
    return f"{shared_root(spark)}/kindred-{uuid4().hex}"


def _sim(df: DataFrame) -> DataFrame:
    return df.select("id", R6("sim").alias("sim"))


# Queries ---------------------------------------------------------------------


def scan_vectors(spark, d):
    e = _all(spark, d, bits=None)
    line = e.select("id", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("value"))
    return source.parse_vectors(line, DIMS).select("id", F.size("v").alias("width"), R6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


def vec_dot(spark, d):
    pool, seeds = _both(spark, d, bits=None)
    s = seeds.where("id = 0").select(F.col("v").alias("sv"))
    return pool.crossJoin(s).select("id", R6(V.dot("v", "sv")).alias("dot"))


def vec_dot_all(spark, d):
    """Every row with every row of the query set but itself."""
    pool, seeds = _both(spark, d, bits=None, others=True)
    return tiles.every_pair(pool, seeds, cosine=False, others=True, digits=6).withColumnRenamed("x", "dot")


def vec_norm(spark, d):
    return _all(spark, d, bits=None).select("id", R6("norm").alias("norm"), R6(F.col("norm") * F.col("norm")).alias("sq"))


def cosine_pairs(spark, d, others=False):
    pool, seeds = _both(spark, d, bits=None, others=others)
    return similarity.cosine_pairs(pool, seeds, others, digits=6)


def zero_norm_guard(spark, d, others=False):
    """Vectors with id % 7 = 0 are blanked first; their pairs have no similarity."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    blank = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * F.lit(0).cast("float"))).otherwise(F.col("embedding"))
    e = prepare(e.withColumn("embedding", blank), "vec_id", "embedding")
    got = similarity.cosine_stats(e, e.where("id % 50 = 0")) if others else similarity.cosine_stats(e.where("id % 5 <> 0"), e.where("id % 5 = 0"))
    return got.withColumn("best", R6("best"))


def gen_planes(spark, d):
    p = hashing.planes_frame(spark, V.fixture_planes(BITS, DIMS))
    return p.select("plane", F.posexplode("w").alias("dim", "x")).select("plane", "dim", F.round("x", 12).alias("x"))


def lsh_signature(spark, d):
    return _all(spark, d).select("id", "bucket")


def bucket_members(spark, d, side=_seeds):
    got = hashing.bucket_members(side(spark, d))
    return got.select("bucket", F.size("ids").cast("bigint").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def bucket_hist(spark, d, side=_pool):
    return hashing.bucket_hist(side(spark, d))


def signature_cost(spark, d, side=_seeds):
    return hashing.signature_cost(side(spark, d, bits=None), _samples())


def best_signature(spark, d, side=_seeds):
    return hashing.best_signature(side(spark, d, bits=None), _samples())


def best_lsh_topk(spark, d, others=False):
    pool, seeds = _both(spark, d, bits=None, others=others)
    planes = hashing.best_planes(seeds, _samples())
    return _sim(similarity.lsh_topk(hashing.with_bucket(pool, planes), hashing.with_bucket(seeds, planes), K, others=others))


def lsh_cost(spark, d, others=False):
    return evaluate.lsh_cost(*_both(spark, d, others=others))


def lsh_cost_study(spark, d, others=False):
    got = evaluate.lsh_cost_study(*_both(spark, d, bits=None, others=others), _samples())
    return got.withColumn("avg_pairs", R6("avg_pairs"))


def bucket_centroid(spark, d, side=_seeds):
    got = summary.bucket_centroid(side(spark, d))
    return got.select("bucket", "n_seeds", R6("c_norm").alias("c_norm"), F.posexplode("centroid").alias("pos", "c")).withColumn("c", R6("c"))


def bucket_medoid(spark, d, side=_seeds):
    return summary.bucket_medoid(side(spark, d)).withColumn("min_cos", R6("min_cos"))


def bucket_summary(spark, d, side=_seeds):
    got = summary.bucket_summary(side(spark, d))
    return got.select("bucket", "n_seeds", R6("c_norm").alias("c_norm"), R6("theta_b").alias("theta_b"))


def upper_bound(spark, d, others=False):
    pool, seeds = _both(spark, d, others=others)
    got = similarity.candidates(pool, summary.bucket_summary(seeds), 10)
    return got.select("id", "bucket", R6("theta").alias("theta"), R6("ub").alias("ub"))


def bound_classify(spark, d, dims=3, bits=3, others=False):
    pool, seeds = _both(spark, d, dims, bits, others)
    got = similarity.candidates(pool, summary.bucket_summary(seeds), 10)
    return got.groupBy("bucket").agg(F.max("n_seeds").alias("n_seeds"), F.count_if("certain").alias("certain"), F.count_if(~F.col("certain")).alias("deferred"))


def _bound(dims: int, bits: int, least: int, centroid: str = "mean"):
    def run(spark, d, others=False):
        pool, seeds = _both(spark, d, dims, bits, others)
        return _sim(similarity.bound_topk(pool, seeds, K, least, centroid, others))

    return run


def bound_prune_stats(spark, d, dims=3, bits=3, others=False):
    pool, seeds = _both(spark, d, dims, bits, others)
    return similarity.bound_prune_stats(pool, seeds, K)


def brute_max_sim(spark, d, others=False):
    return _sim(similarity.brute_max_sim_arrow(*_both(spark, d, bits=None, others=others), others=others))


def brute_topk(spark, d, others=False):
    return _sim(similarity.brute_topk(*_both(spark, d, bits=None, others=others), K, others=others))


def brute_topk_arrow(spark, d, others=False):
    return _sim(ranking.topk(similarity.brute_max_sim_arrow(*_both(spark, d, bits=None, others=others), others=others), K))


def max_sim(spark, d, others=False):
    return _sim(similarity.lsh_max_sim_arrow(*_both(spark, d, others=others), keep_unmatched=False, others=others))


def lsh_topk(spark, d, others=False):
    return _sim(similarity.lsh_topk(*_both(spark, d, others=others), K, others=others))


def _probed(spark, d):
    pool, seeds = _both(spark, d, others=True)
    return similarity.lsh_topk(pool, hashing.in_near_buckets(seeds, BITS, FLIPS), K, others=True)


def lsh_topk_probed(spark, d):
    """lsh_topk_all with probes of the buckets near a query's own."""
    return _sim(_probed(spark, d))


def recall_probed(spark, d):
    got = evaluate.recall(similarity.brute_topk(*_both(spark, d, bits=None, others=True), K, others=True), _probed(spark, d))
    return got.withColumn("recall", R6("recall"))


def index_planes() -> list[list[list[float]]]:
    """TABLES sets of PLANES planes, to three digits so that the SQL can state them."""
    return [[[round(x, 3) for x in w] for w in V.random_planes(PLANES, DIMS, 100 + t, normal=True)] for t in range(TABLES)]


def lsh_topk_index(spark, d):
    """lsh_topk_all over several hash tables with query-directed probes."""
    return _sim(index.index_topk(*_both(spark, d, bits=None, others=True), K, index_planes(), PROBES, True))


def recall_index(spark, d):
    """How much of the exact answer the index finds, and how many cosines it takes of all."""
    pool, seeds = _both(spark, d, bits=None, others=True)
    seen = Observation()
    found = spark.createDataFrame(index.index_topk(pool, seeds, K, index_planes(), PROBES, True, seen).collect(), "id bigint, sim double")
    got = evaluate.recall(similarity.brute_topk(pool, seeds, K, others=True), found)
    cosines, pairs = tiles.observed(seen, "cosines"), pool.count() * seeds.count() - seeds.count()
    return got.withColumn("recall", R6("recall")).withColumn("cosines", F.lit(cosines).cast("bigint")).withColumn("share", R6(F.lit(cosines / max(pairs, 1))))


def lsh_topk_arrow(spark, d, others=False):
    return _sim(ranking.topk(similarity.lsh_max_sim_arrow(*_both(spark, d, others=others), others=others), K))


def recall(spark, d, others=False):
    got = evaluate.recall(similarity.brute_topk(*_both(spark, d, bits=None, others=others), K, others=others), similarity.lsh_topk(*_both(spark, d, others=others), K, others=others))
    return got.withColumn("recall", R6("recall"))


def brute_topk_balls(spark, d, others=False):
    """The exact search by a ball index over the seeds."""
    return _sim(bounded.ball_topk(*_both(spark, d, bits=None, others=others), K, others))


def perquery_topk(spark, d, others=False):
    return tiles.perquery_topk(*_both(spark, d, bits=None, others=others), 5, others).withColumn("dist", R6("dist"))


def perquery_kth(spark, d, others=False):
    return tiles.perquery_kth(*_both(spark, d, bits=None, others=others), 5, others).withColumn("kth", R6("kth"))


def planes_from_text(spark, d):
    path = shared_dir(spark)
    source.write_planes(hashing.planes_frame(spark, V.fixture_planes(BITS, DIMS)), path)
    return source.read_planes(spark, path, DIMS).select("plane", F.posexplode("w").alias("dim", "x")).select("plane", "dim", F.round("x", 12).alias("x"))


def planes_roundtrip(spark, d):
    """Buckets from planes that went through text: the same as from the literals."""
    path = shared_dir(spark)
    source.write_planes(hashing.planes_frame(spark, V.fixture_planes(BITS, DIMS)), path)
    planes = [r["w"] for r in source.read_planes(spark, path, DIMS).orderBy("plane").collect()]
    return hashing.with_bucket(_all(spark, d, bits=None), planes).select("id", "bucket")


def topk_sink(spark, d, others=False):
    path = shared_dir(spark)
    source.write_topk(similarity.lsh_topk(*_both(spark, d, others=others), K, others=others), path)
    return source.read_ids(spark, path)


def recall_vs_baseline(spark, d, others=False):
    path = shared_dir(spark)
    source.write_topk(similarity.brute_topk(*_both(spark, d, bits=None, others=others), K, others=others), path)
    got = evaluate.recall(source.read_ids(spark, path), similarity.lsh_topk(*_both(spark, d, others=others), K, others=others))
    return got.withColumn("recall", R6("recall"))


def recall_bound_vs_lsh(spark, d, others=False):
    """How much of the bounded answer the bucketed one has."""
    pool, seeds = _both(spark, d, others=others)
    got = evaluate.recall(similarity.bound_topk(pool, seeds, K, 1, others=others), similarity.lsh_topk(pool, seeds, K, others=others))
    return got.withColumn("recall", R6("recall"))


def scan_text_vectors(spark, d):
    """The whole table written in the order of its ids as delimited text, several files, and read again: the lines' numbers are the ids' ranks."""
    path = shared_dir(spark)
    cells = F.array_join(F.transform("v", lambda x: x.cast("string")), ",")
    _all(spark, d, bits=None).repartitionByRange(5, "id").sortWithinPartitions("id").select(cells.alias("value")).write.text(path)
    got = source.read_delimited(spark, path, DIMS)
    return got.select("id", F.size("v").alias("width"), R6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def lsh_random_planes(spark, d):
    """Buckets under planes drawn from a seed; the SQL is given the planes."""
    return hashing.with_bucket(_all(spark, d, bits=None), V.random_planes(BITS, DIMS, 7)).select("id", "bucket")


#: Name to query.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_vectors, vec_dot, vec_norm, cosine_pairs, zero_norm_guard, gen_planes, lsh_signature, bucket_members,
        bucket_hist, signature_cost, best_signature, best_lsh_topk, lsh_cost, lsh_cost_study, bucket_centroid,
        bucket_medoid, bucket_summary, upper_bound, bound_classify, bound_prune_stats, brute_max_sim, brute_topk, brute_topk_arrow,
        max_sim, lsh_topk, lsh_topk_arrow, recall, perquery_topk, perquery_kth, planes_from_text, planes_roundtrip,
        topk_sink, recall_vs_baseline, scan_text_vectors, recall_bound_vs_lsh, lsh_random_planes, brute_topk_balls,
    )
} | {"bound_topk": _bound(DIMS, BITS, 1), "bound_topk_3d": _bound(3, 3, 10), "bound_topk_medoid": _bound(DIMS, BITS, 1, "medoid"), "bound_topk_arrow": _bound(DIMS, BITS, 1)}

#: Searches that are registered over the whole table too.
SEARCHES = (
    "brute_topk", "brute_topk_arrow", "brute_max_sim", "lsh_topk", "lsh_topk_arrow", "max_sim", "best_lsh_topk", "bound_topk", "bound_topk_3d",
    "bound_topk_medoid", "bound_topk_arrow", "perquery_topk", "perquery_kth", "cosine_pairs", "recall", "recall_vs_baseline", "topk_sink",
    "brute_topk_balls", "recall_bound_vs_lsh",
)
QUERIES |= {f"{n}_all": partial(QUERIES[n], others=True) for n in SEARCHES}

#: Reports that are registered over all rows too.
REPORTS = ("bucket_hist", "bucket_members", "bucket_centroid", "bucket_medoid", "bucket_summary", "signature_cost", "best_signature")
QUERIES |= {f"{n}_all": partial(QUERIES[n], side=_all) for n in REPORTS} | {"vec_dot_all": vec_dot_all}
QUERIES |= {f.__name__: f for f in (lsh_topk_probed, recall_probed, lsh_topk_index, recall_index)}

#: Reports on the bound over whole vectors too.
BOUNDS = ("bound_classify", "bound_prune_stats")
QUERIES |= {f"{n}_64d": partial(QUERIES[n], dims=DIMS, bits=BITS) for n in BOUNDS}

#: Figures of a search that are registered for the query set against the whole table too, rows of the set included.
FIGURES = ("zero_norm_guard", "upper_bound", "lsh_cost", "lsh_cost_study", "bound_classify", "bound_prune_stats", "bound_classify_64d", "bound_prune_stats_64d")
QUERIES |= {f"{n}_all": partial(QUERIES[n], others=True) for n in FIGURES}


# SQL -------------------------------------------------------------------------


def _planes_sql(bits: int, dims: int, samples: int = 1) -> str:
    value = "(((p*7919+j*104729+12345)*48271 % 2147483647)*16807 % 2147483647)::DOUBLE/2147483647::DOUBLE*2-1"
    return f"""planes AS (SELECT p // {bits} AS sample, p % {bits} AS b, list(x ORDER BY j) AS w FROM
      (SELECT p, j, {value} AS x FROM range(0, {bits * samples}) a(p), range(1, {dims + 1}) c(j)) GROUP BY p)"""


def _sql(body: str, dims: int = DIMS, bits: int = BITS, samples: int = 1) -> str:
    """WITH e, h (bucketed, per sample), p (pool), s (seeds) and the body's own relations."""
    return f"""WITH e AS (SELECT vec_id AS id, embedding[1:{dims}]::DOUBLE[] AS v FROM embeddings), {_planes_sql(bits, dims, samples)},
    h AS (SELECT sample, id, v, sum(CASE WHEN list_dot_product(v, w) >= 0 THEN 1 << ({bits} - 1 - b) ELSE 0 END)::INT AS bucket
      FROM e, planes GROUP BY sample, id, v),
    p AS (SELECT * FROM h WHERE id % 5 <> 0), s AS (SELECT * FROM h WHERE id % 5 = 0){body}"""


_COS = "list_cosine_similarity(p.v, s.v)"
_BRUTE = f""", ex AS (SELECT p.id, greatest(0::DOUBLE, max({_COS})) AS sim FROM p, s GROUP BY p.id)"""
_INNER = f""", ex AS (SELECT p.id, greatest(0::DOUBLE, max({_COS})) AS sim FROM p JOIN s USING (sample, bucket) GROUP BY p.id)"""
_LEFT = f""", ex AS (SELECT p.id, coalesce(greatest(0::DOUBLE, max({_COS})), 0) AS sim FROM p LEFT JOIN s USING (sample, bucket) GROUP BY p.id)"""
_TOP = f"SELECT id, round(sim, 6) AS sim FROM ex ORDER BY round(ex.sim, 9) DESC, id LIMIT {K}"
_CENTRE = """, x AS (SELECT bucket, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM s),
    c AS (SELECT bucket, list(m ORDER BY pos) AS c FROM (SELECT bucket, pos, avg(x) AS m FROM x GROUP BY ALL) GROUP BY bucket),
    sm AS (SELECT bucket, count(*) AS n, any_value(c) AS c, sqrt(list_dot_product(any_value(c), any_value(c))) AS c_norm,
      max(acos(greatest(-1::DOUBLE, least(1::DOUBLE, list_cosine_similarity(s.v, c))))) AS tb FROM s JOIN c USING (bucket) GROUP BY bucket),
    cand AS (SELECT id, bucket, p.v, n, tb, acos(greatest(-1::DOUBLE, least(1::DOUBLE, list_cosine_similarity(p.v, c)))) AS th FROM p JOIN sm USING (bucket)),
    cl AS (SELECT *, CASE WHEN th > tb THEN cos(th - tb) ELSE 1::DOUBLE END AS ub, n < 10 OR th <= tb AS certain FROM cand)"""
_DIST = """, d AS (SELECT s.id AS query_id, p.id, 1 - list_cosine_similarity(p.v, s.v) AS dist FROM p, s),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id)::INT AS rank FROM d)"""


def _recall_sql(truth: str, found: str) -> str:
    a, b = (_sql(f"{x} {_TOP}") for x in (truth, found))
    return f"""WITH a AS (SELECT id FROM ({a})), b AS (SELECT id FROM ({b}))
    SELECT count(b.id) AS matched, count(*) AS total, round(count(b.id) / count(*)::DOUBLE, 6) AS recall FROM a LEFT JOIN b USING (id)"""


_RECALL = _recall_sql(_BRUTE, _LEFT)
_COST = ", t AS (SELECT sample, sum(n * n)::BIGINT AS cost FROM (SELECT sample, bucket, count(*) AS n FROM s GROUP BY ALL) GROUP BY sample)"
_BEST = f"""{_COST}, pick AS (SELECT arg_min(sample, (cost, sample)) AS sample FROM t),
    ex AS (SELECT p.id, coalesce(greatest(0::DOUBLE, max({_COS})), 0) AS sim FROM p JOIN pick USING (sample) LEFT JOIN s ON s.sample = p.sample AND s.bucket = p.bucket GROUP BY p.id)"""
_PLANES = f"""WITH {_planes_sql(BITS, DIMS)} SELECT b::INT AS plane, (pos - 1)::INT AS dim, round(x, 12) AS x
    FROM (SELECT b, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM planes)"""
_Z = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT p.id, count(*) FILTER (p.id % 7 <> 0 AND s.id % 7 <> 0) AS pairs,
      round(max(list_cosine_similarity(p.v, s.v)) FILTER (p.id % 7 <> 0 AND s.id % 7 <> 0), 6) AS best
    FROM e p, e s WHERE p.id % 5 <> 0 AND s.id % 5 = 0 GROUP BY p.id"""

#: Name to DuckDB SQL.
ORACLE: dict[str, str] = {
    "scan_vectors": "SELECT vec_id AS id, len(embedding)::INT AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    "vec_dot": _sql(" SELECT p.id, round(list_dot_product(p.v, s.v), 6) AS dot FROM p, s WHERE s.id = 0"),
    "vec_norm": _sql(" SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v, v), 6) AS sq FROM e"),
    "cosine_pairs": _sql(f" SELECT p.id, s.id AS seed_id, round({_COS}, 6) AS sim FROM p, s"),
    "zero_norm_guard": _Z,
    "gen_planes": _PLANES,
    "planes_from_text": _PLANES,
    "lsh_signature": _sql(" SELECT id, bucket FROM h"),
    "planes_roundtrip": _sql(" SELECT id, bucket FROM h"),
    "bucket_members": _sql(" SELECT bucket, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM s GROUP BY bucket"),
    "bucket_hist": _sql(" SELECT bucket, count(*) AS cnt FROM p GROUP BY bucket"),
    "signature_cost": _sql(f"{_COST} SELECT sample::INT AS sample, cost FROM t", samples=SAMPLES),
    "best_signature": _sql(f"{_COST} SELECT sample::INT AS sample, cost FROM t ORDER BY cost, sample LIMIT 1", samples=SAMPLES),
    "best_lsh_topk": _sql(f"{_BEST} {_TOP}", samples=SAMPLES),
    "lsh_cost": _sql(" SELECT count(*) AS pairs FROM p JOIN s USING (sample, bucket)"),
    "lsh_cost_study": _sql(""", n AS (SELECT p.sample, count(s.id) AS c FROM p LEFT JOIN s USING (sample, bucket) GROUP BY p.sample)
        SELECT min(c) AS min_pairs, max(c) AS max_pairs, round(avg(c), 6) AS avg_pairs FROM n""", samples=SAMPLES),
    "bucket_centroid": _sql(f"""{_CENTRE} SELECT bucket, n AS n_seeds, round(c_norm, 6) AS c_norm, (pos - 1)::INT AS pos, round(y, 6) AS c
        FROM (SELECT *, unnest(c) AS y, generate_subscripts(c, 1) AS pos FROM sm)"""),
    "bucket_medoid": _sql(""", w AS (SELECT a.bucket, a.id, min(round(list_cosine_similarity(a.v, b.v), 9)) AS c FROM s a JOIN s b USING (bucket) GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY c DESC, id) AS rn FROM w)
        SELECT bucket, id AS seed_id, round(c, 6) AS min_cos FROM o WHERE rn = 1"""),
    "bucket_summary": _sql(f"{_CENTRE} SELECT bucket, n AS n_seeds, round(c_norm, 6) AS c_norm, round(tb, 6) AS theta_b FROM sm"),
    "upper_bound": _sql(f"{_CENTRE} SELECT id, bucket, round(th, 6) AS theta, round(ub, 6) AS ub FROM cl"),
    "bound_classify": _sql(f"{_CENTRE} SELECT bucket, max(n) AS n_seeds, count(*) FILTER (certain) AS certain, count(*) FILTER (NOT certain) AS deferred FROM cl GROUP BY bucket", 3, 3),
    "bound_topk": _sql(f"{_INNER} {_TOP}"),
    "bound_topk_3d": _sql(f"{_INNER} {_TOP}", 3, 3),
    "bound_topk_medoid": _sql(f"{_INNER} {_TOP}"),
    "bound_prune_stats": _sql(f"""{_CENTRE}, sc AS (SELECT cl.id, greatest(0::DOUBLE, max(list_cosine_similarity(cl.v, s.v))) AS sim FROM cl JOIN s USING (bucket) WHERE certain GROUP BY cl.id),
        best AS (SELECT sim FROM sc ORDER BY round(sim, 9) DESC, id LIMIT {K}), tau AS (SELECT CASE WHEN count(*) < {K} THEN 0::DOUBLE ELSE min(sim) END AS tau FROM best),
        g AS (SELECT n, certain, NOT certain AND greatest(ub, 0::DOUBLE) + 1e-7::DOUBLE < tau AS pruned FROM cl, tau)
        SELECT count(*) FILTER (NOT certain) AS deferred, count(*) FILTER (pruned) AS pruned, coalesce(sum(n) FILTER (pruned), 0)::BIGINT AS saved_pairs,
          coalesce(sum(n) FILTER (n < 10), 0)::BIGINT AS small_pairs FROM g""", 3, 3),
    "bound_topk_arrow": _sql(f"{_INNER} {_TOP}"),
    "scan_text_vectors": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, len(embedding)::INT AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    "recall_bound_vs_lsh": _recall_sql(_INNER, _LEFT),
    "brute_max_sim": _sql(f"{_BRUTE} SELECT id, round(sim, 6) AS sim FROM ex"),
    "brute_topk": _sql(f"{_BRUTE} {_TOP}"),
    "brute_topk_arrow": _sql(f"{_BRUTE} {_TOP}"),
    "brute_topk_balls": _sql(f"{_BRUTE} {_TOP}"),
    "max_sim": _sql(f"{_INNER} SELECT id, round(sim, 6) AS sim FROM ex"),
    "lsh_topk": _sql(f"{_LEFT} {_TOP}"),
    "lsh_topk_arrow": _sql(f"{_LEFT} {_TOP}"),
    "topk_sink": _sql(f"{_LEFT} SELECT id FROM ({_TOP})"),
    "recall": _RECALL,
    "recall_vs_baseline": _RECALL,
    "perquery_topk": _sql(f"{_DIST} SELECT query_id, rank, id, round(dist, 6) AS dist FROM r WHERE rank <= 5"),
    "perquery_kth": _sql(f"{_DIST} SELECT query_id, round(max(dist), 6) AS kth FROM r WHERE rank <= 5 GROUP BY query_id"),
}

_DRAWN = ", ".join(f"(0, {b}, {[float(x) for x in w]})" for b, w in enumerate(V.random_planes(BITS, DIMS, 7)))
ORACLE["lsh_random_planes"] = ORACLE["lsh_signature"].replace(_planes_sql(BITS, DIMS), f"planes AS (SELECT * FROM (VALUES {_DRAWN}) t(sample, b, w))")


def _all_sql(sql: str) -> str:
    """The same over the whole table: queries id % 50 = 0, no row with itself."""
    for old, new in (
        ("p AS (SELECT * FROM h WHERE id % 5 <> 0), s AS (SELECT * FROM h WHERE id % 5 = 0)", "p AS (SELECT * FROM h), s AS (SELECT * FROM h WHERE id % 50 = 0)"),
        ("FROM p, s", "FROM p, s WHERE p.id <> s.id"),
        ("JOIN s USING (sample, bucket)", "JOIN s ON s.sample = p.sample AND s.bucket = p.bucket AND s.id <> p.id"),
        ("LEFT JOIN s ON s.sample = p.sample AND s.bucket = p.bucket GROUP", "LEFT JOIN s ON s.sample = p.sample AND s.bucket = p.bucket AND s.id <> p.id GROUP"),
    ):
        sql = sql.replace(old, new)
    return sql


ORACLE |= {f"{n}_all": _all_sql(ORACLE[n]) for n in SEARCHES}
ORACLE |= {f"{n}_all": ORACLE[n].replace("SELECT * FROM h WHERE id % 5 <> 0", "SELECT * FROM h").replace("SELECT * FROM h WHERE id % 5 = 0", "SELECT * FROM h") for n in REPORTS}
ORACLE["vec_dot_all"] = _all_sql(_sql(" SELECT p.id, s.id AS seed_id, round(list_dot_product(p.v, s.v), 6) AS dot FROM p, s"))
ORACLE |= {f"{n}_64d": _sql(ORACLE[n].removeprefix(_sql("", 3, 3))) for n in BOUNDS}
_SIDES = (("p AS (SELECT * FROM h WHERE id % 5 <> 0), s AS (SELECT * FROM h WHERE id % 5 = 0)", "p AS (SELECT * FROM h), s AS (SELECT * FROM h WHERE id % 50 = 0)"), ("p.id % 5 <> 0 AND s.id % 5 = 0", "s.id % 50 = 0"))
ORACLE |= {f"{n}_all": reduce(lambda sql, x: sql.replace(*x), _SIDES, ORACLE[n]) for n in FIGURES}
ORACLE |= {f"{n}_probed": ORACLE[f"{n}_all"].replace("s.bucket = p.bucket", f"bit_count(xor(s.bucket, p.bucket)) <= {FLIPS}") for n in ("lsh_topk", "recall")}


_INDEX = f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    pl AS (SELECT * FROM (VALUES {", ".join(f"({t}, {PLANES - 1 - b}, {w})" for t, ws in enumerate(index_planes()) for b, w in enumerate(ws))}) x(t, b, w)),
    d AS (SELECT id, t, b, list_dot_product(v, w::DOUBLE[]) AS d FROM e, pl), h AS (SELECT id, t, sum(CASE WHEN d >= 0 THEN 1 << b ELSE 0 END)::BIGINT AS bucket FROM d GROUP BY id, t),
    cost AS (SELECT id, t, mask, sum(CASE WHEN (mask >> b) & 1 = 1 THEN d * d / list_dot_product(v, v) ELSE 0 END) AS c FROM d JOIN e USING (id), range(0, {1 << PLANES}) m(mask) WHERE id % 50 = 0 GROUP BY ALL),
    probe AS (SELECT id, t, mask FROM cost QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY c, mask) <= {PROBES}),
    met AS (SELECT DISTINCT h.id, q.id AS seed FROM probe JOIN h q USING (id, t) JOIN h ON h.t = probe.t AND h.bucket = xor(q.bucket, mask) AND h.id <> q.id),
    ex AS (SELECT met.id, greatest(0::DOUBLE, max(list_cosine_similarity(a.v, b.v))) AS sim FROM met JOIN e a ON a.id = met.id JOIN e b ON b.id = seed GROUP BY met.id)"""
ORACLE["lsh_topk_index"] = f"{_INDEX} {_TOP}"
ORACLE["recall_index"] = f"""{_INDEX}, found AS ({_TOP}), truth AS (SELECT id FROM ({ORACLE["brute_topk_all"]})), n AS (SELECT count(*) AS cosines FROM met),
    total AS (SELECT count(*) * count(*) FILTER (id % 50 = 0) - count(*) FILTER (id % 50 = 0) AS pairs FROM e)
    SELECT count(found.id) AS matched, count(*) AS total, round(count(found.id) / count(*)::DOUBLE, 6) AS recall, any_value(cosines) AS cosines, round(any_value(cosines / pairs::DOUBLE), 6) AS share
    FROM truth LEFT JOIN found USING (id), n, total"""
