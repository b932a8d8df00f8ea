"""Blocked products of two vector relations: a grid of tiles, each a cell that one task multiplies.

Both sides carry a bucket, and only rows of one bucket meet. A bucket's pool rows are dealt to parts and its seeds to
blocks, as many as their measured counts ask for; every part meets every block in a cell of bounded size. So a hot bucket
becomes many cells, and neither side is ever shipped whole: cells are cogrouped and multiplied as matrices on Arrow tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kindred.sources.work import Work, ship

#: Rows of the two sides in a cell, some megabytes each: the larger they are, the fewer cells a row is sent to.
POOL_TILE, SEED_TILE = 1 << 13, 1 << 14
#: Cosines held at once while a cell is multiplied.
CHUNK = 1 << 21
#: Pool rows and seeds in a cell whose pairs all come out, and pairs that leave it at once.
PAIR_ROWS, PAIR_SEEDS, PAIR_CHUNK = 1 << 11, 1 << 13, 1 << 18
#: Partitions of a side at most; the tasks are the square of that.
PAIR_PARTS = 1 << 8
#: Rows of the table of counts, one a bucket, up to which it is broadcast; with more buckets it is joined.
COUNT_ROWS = 1 << 16
#: Lists that one step of the merge takes together.
FAN_IN = 64

Kernel = Callable[[pa.Table, pa.Table], pa.Table]
_COUNTS = "bucket bigint, _w int, _p bigint, _s bigint"


def unit(table: pa.Table) -> np.ndarray:
    """The vectors of a cell as rows of length 1."""
    n = table.num_rows
    v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return v.reshape(n, -1) / table["norm"].to_numpy()[:, None]


#: Stands for a null id in a cell.
NO_ID = -(2**63)


def ids(table: pa.Table) -> np.ndarray:
    return table["id"].fill_null(NO_ID).to_numpy()


def _same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs (down, across) that aren't surely of two rows: of one id, or with a null."""
    return (i[:, None] == j) | (i == NO_ID)[:, None] | (j == NO_ID)


class Grid:
    """Which parts and blocks two relations (id, bucket, v, norm and others) are dealt to.

    Rows without a positive norm meet nothing and are left out; so are buckets that only one side has. Vectors of
    different lengths don't meet. The counts are measured when the grid is made, unless `counts`, (bucket, width, pool rows,
    seeds) of each bucket, are known: `cosines` that the cells hold, `rows` of the pool that meet any seed, `cells`, and
    `parts`, the most that a bucket's pool is dealt to.
    """

    def __init__(self, pool: DataFrame, seeds: DataFrame, pool_tile: int = POOL_TILE, seed_tile: int = SEED_TILE, *, counts: list[tuple[int, int, int, int]] | None = None) -> None:
        live = lambda df: df.where("norm > 0").withColumn("_w", F.size("v"))
        self.pool, self.seeds, self.spark = live(pool), live(seeds), pool.sparkSession
        ship(self.spark)
        if counts is None:
            side = lambda df, p, s: df.select("bucket", "_w", F.lit(p).alias("p"), F.lit(s).alias("s"))
            both = side(self.pool, 1, 0).union(side(self.seeds, 0, 1)).groupBy("bucket", "_w").agg(F.sum("p").alias("_p"), F.sum("s").alias("_s"))
            table = both.where("_p > 0 AND _s > 0").select(F.col("bucket").cast("bigint").alias("bucket"), "_w", "_p", "_s")
            counts = [tuple(r) for r in table.coalesce(1).limit(COUNT_ROWS + 1).collect()]  # a row a bucket
        else:
            table = self.spark.createDataFrame(counts, _COUNTS)
        tiles = lambda n, size: F.ceil(F.col(n) / size).cast("int")
        deal = lambda t: t.select(F.col("bucket").cast("int").alias("bucket"), "_w", tiles("_p", pool_tile).alias("_parts"), tiles("_s", seed_tile).alias("_blocks"))
        if len(counts) <= COUNT_ROWS:
            each = [(p, s, -(-p // pool_tile), -(-s // seed_tile)) for _, _, p, s in counts]
            self.table = F.broadcast(deal(self.spark.createDataFrame(counts, _COUNTS)))
            self.cosines, self.rows = sum(p * s for p, s, _, _ in each), sum(x[0] for x in each)
            self.cells, self.parts = sum(a * b for _, _, a, b in each), max((x[2] for x in each), default=0)
        else:
            self.table, zero = deal(table), F.lit(0)
            got = table.join(self.table, ["bucket", "_w"]).agg(*(F.coalesce(f, zero).cast("bigint") for f in (F.sum(F.col("_p") * F.col("_s")), F.sum("_p"), F.sum(F.col("_parts") * F.col("_blocks")), F.max("_parts"))))
            self.cosines, self.rows, self.cells, self.parts = got.first()

    def dealt(self) -> tuple[DataFrame, DataFrame]:
        """Both sides with the cell of each row: bucket, _w, _part, _block. A row stands in every cell where it meets others."""
        own = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.pool.join(self.table, ["bucket", "_w"]).withColumn("_part", own("_parts")).withColumn("_block", every("_blocks"))
        right = self.seeds.join(self.table, ["bucket", "_w"]).withColumn("_block", own("_blocks")).withColumn("_part", every("_parts"))
        return (x.drop("_p", "_s", "_parts", "_blocks") for x in (left, right))

    def run(self, kernel: Kernel, schema: str) -> DataFrame:
        """What the kernel makes of every cell's two tables."""
        keys = ["bucket", "_w", "_part", "_block"]

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return empty
            return kernel(left, right)

        empty = _schema(schema).empty_table()
        left, right = self.dealt()
        right = right.select(*(F.col(c).alias(c) for c in right.columns))  # both may come from one table
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def _schema(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


#: What best_cosine() makes.
SCORES = "id bigint, sim double, met bigint"


def best_cosine(others: bool = False, floor: float = 0.0) -> Kernel:
    """(id, sim, met): each pool row's greatest cosine to the cell's seeds, floor at least, and how many it was compared with;
    others: not with itself, and a row that meets no other is left out."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, i, j = unit(left), unit(right).T, ids(left), ids(right)
        best, met, step = np.empty(len(a)), np.full(len(a), len(j)), max(1, CHUNK // len(j))
        for lo in range(0, len(a), step):
            cos = a[lo : lo + step] @ b
            if others:
                own = _same(i[lo : lo + step], j)
                cos[own] = -np.inf
                met[lo : lo + step] -= own.sum(1)
            best[lo : lo + step] = cos.max(1)
        some = met > 0
        return pa.table({"id": left["id"].filter(pa.array(some)), "sim": np.maximum(best[some], floor), "met": met[some]})

    return kernel


def best_of(scores: DataFrame, observation: Observation | None = None) -> DataFrame:
    """(id, sim) of SCORES; observation gets `cosines`, how many were computed, once the result has been."""
    if observation is not None:
        scores = scores.observe(observation, F.coalesce(F.sum("met"), F.lit(0)).alias("cosines"))
    return scores.groupBy("id").agg(F.max("sim").alias("sim"))


def observed(observation: Observation, name: str) -> int:
    """What has been observed; 0 where Spark saw while running that nothing comes out, and dropped the observed step."""
    try:
        return observation.get[name]
    except Py4JJavaError:
        return 0


class _Side:
    """Rows of one side of a cell whose pairs all come out: ids, the rows that have a product by their width, and their vectors."""

    def __init__(self, table: pa.Table, cosine: bool) -> None:
        table = table.combine_chunks()
        norm, width = table["norm"].to_numpy(), table["_w"].to_numpy()
        good = table["norm"].is_valid().to_numpy()
        if cosine:
            good = good & (norm != 0)
        self.id, self.n, self.groups = table["id"].combine_chunks(), table.num_rows, {}
        for w in np.unique(width[good]).tolist():
            at = np.flatnonzero(good & (width == w))
            v = table["v"].combine_chunks().take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), w)
            self.groups[w] = at, v / norm[at, None] if cosine else v

    def ids(self, spread: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
        return self.id.take(pa.array(spread(np.arange(self.n)))) if self.id.null_count else pa.array(spread(self.id.to_numpy()))


_EXACT = Context(prec=400, rounding=ROUND_HALF_UP)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x to so many digits, halves away from zero, as Spark's round() of doubles: by their shortest decimal form.

    What lies too near a half, or is too large, for doubles to tell is settled by decimals; infinities and NaN stay.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.abs(x) * 10.0**digits
        out = np.copysign(np.floor(y + 0.5) / 10.0**digits, x) + 0.0
        odd = np.flatnonzero(~(np.abs(y - np.floor(y) - 0.5) > 1e-6 + y * 1e-15) | (y >= 2.0**51))
    one = Decimal(1).scaleb(-digits)
    for i in odd.tolist():
        v = float(x[i])
        out[i] = float(_EXACT.quantize(Decimal(repr(v)), one)) + 0.0 if np.isfinite(v) else v
    return out


def _products(left: _Side, right: _Side, others: bool, digits: int | None) -> pa.RecordBatch:
    """(id, seed_id, x) of every pair of two sides; null where one has no product or the lengths differ."""
    x, some = np.zeros((left.n, right.n)), np.zeros((left.n, right.n), bool)
    for w in left.groups.keys() & right.groups.keys():
        (i, a), (j, b) = left.groups[w], right.groups[w]
        if len(i) == left.n and len(j) == right.n:
            x, some = a @ b.T, None
        else:
            x[np.ix_(i, j)], some[np.ix_(i, j)] = a @ b.T, True
    x = x.ravel() if digits is None else rounded(x.ravel(), digits)
    u, v, out = left.ids(lambda i: np.repeat(i, right.n)), right.ids(lambda j: np.tile(j, left.n)), pa.array(x, mask=None if some is None else ~some.ravel())
    batch = pa.RecordBatch.from_arrays([u, v, out], ["id", "seed_id", "x"])
    return batch.filter(pc.not_equal(u, v)) if others else batch  # a null id differs from none


def _tiled(df: DataFrame, size: int, name: str) -> DataFrame:
    """(name): the rows (id, v, norm, _w) of df in tiles of `size` at most, each one row that holds an Arrow stream, dealt out evenly."""
    rows = df.select("id", "v", "norm", F.coalesce(F.size("v"), F.lit(-1)).alias("_w"))
    n = max(1, -(-rows.count() // size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def tile() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], [name])

        for b in batches:
            while b.num_rows:
                some = b.slice(0, size - count)
                held.append(some)
                count, b = count + some.num_rows, b.slice(some.num_rows)
                if count == size:
                    yield tile()
                    held, count = [], 0
        if count:
            yield tile()

    return rows.coalesce(n).mapInArrow(pack, f"{name} binary").repartition(min(n, PAIR_PARTS))


def _product(left: DataFrame, right: DataFrame) -> DataFrame:
    """(_1, _2): every tile of one side with every tile of the other, a task for every two partitions.

    As a product of RDDs: a join would hold all tiles of a right partition at once, or be broadcast and leave few tasks.
    """
    spark, kinds = left.sparkSession, left.sparkSession._jvm.org.apache.spark.sql.Encoders
    rdd = lambda df: getattr(df._jdf, "as")(kinds.BINARY()).toJavaRDD()
    both = rdd(left).cartesian(rdd(right)).rdd()
    return DataFrame(spark._jsparkSession.createDataset(both, kinds.tuple(kinds.BINARY(), kinds.BINARY())).toDF(), spark)


def every_pair(pool: DataFrame, seeds: DataFrame, cosine: bool = True, others: bool = False, digits: int | None = None) -> DataFrame:
    """(id, seed_id, x) of every pair of rows of two relations (id, v, norm): the cosine, or the dot product, to `digits` digits.

    Null where a vector is null or holds a null, where lengths differ, and, of cosines, where a norm is zero. others: no row with itself.
    Each side is packed into tiles that are shuffled once, however many cells there are: every task reads its two
    partitions from the same shuffle files. A task sends the pairs of two tiles out in pieces, so memory is bounded.
    """
    ship(pool.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in zip(*b.columns):
                some, other = (pa.ipc.open_stream(x.as_buffer()).read_all() for x in cell)
                right = _Side(other, cosine)
                step = max(1, PAIR_CHUNK // right.n)
                for x in range(0, some.num_rows, step):
                    yield _products(_Side(some.slice(x, step), cosine), right, others, digits)

    cells = _product(_tiled(pool, PAIR_ROWS, "_left"), _tiled(seeds, PAIR_SEEDS, "_right"))
    return cells.mapInArrow(run, "id bigint, seed_id bigint, x double")


def _distances(left: pa.Table, right: pa.Table, others: bool) -> np.ndarray:
    """1 - cosine of every pool row (down) and seed (across); infinite for a row with itself."""
    dist = 1 - unit(left) @ unit(right).T
    if others:
        dist[ids(left)[:, None] == ids(right)] = np.inf
    return dist


def nearest(k: int, others: bool = False) -> Kernel:
    """(query_id, part, id, dist): the k pool rows of the cell nearest to each seed, ties to the lower id."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j, out, step = ids(left), ids(right), [], max(1, CHUNK // left.num_rows)
        for lo in range(0, len(j), step):
            dist = _distances(left, right.slice(lo, step), others)
            rank = np.round(dist, 9)
            edge = np.partition(rank, min(k, len(i)) - 1, axis=0)[min(k, len(i)) - 1]
            col, row = np.nonzero(((rank <= edge) & (dist < np.inf)).T)
            order = np.lexsort((i[row], rank[row, col], col))
            col, row = col[order], row[order]
            first = np.searchsorted(col, col)
            keep = np.arange(len(col)) - first < k
            out.append((j[lo + col[keep]], i[row[keep]], dist[row[keep], col[keep]]))
        q, i, d = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": q, "part": np.full(len(q), left["_part"][0].as_py(), np.int32), "id": i, "dist": d})

    return kernel


def perquery_topk(pool: DataFrame, seeds: DataFrame, k: int, others: bool = False) -> DataFrame:
    """(query_id, rank, id, dist): the k pool rows nearest to each seed, by 1 - cosine rounded to 9 digits, then by id.

    A cell keeps k rows of each of its seeds, so k times queries times cells are shuffled at most; the lists are merged FAN_IN
    at once, so no task reads more than k times FAN_IN rows of a query. Pairs without a similarity aren't ranked.
    """
    one = lambda df: df.withColumn("bucket", F.lit(0))
    grid = Grid(one(pool), one(seeds))
    lists, parts = grid.run(nearest(k, others), "query_id bigint, part int, id bigint, dist double"), grid.parts
    while parts > FAN_IN:
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        w = Window.partitionBy("query_id", "part").orderBy(F.round("dist", 9), "id")
        lists, parts = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank"), -(-parts // FAN_IN)
    w = Window.partitionBy("query_id").orderBy(F.round("dist", 9), "id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


#: Steps in which distances are told apart when a value of given rank is sought, and bins that a range of them is cut into.
STEP, BINS = 1e-9, 2048
_TOP = round(2 / STEP)
#: Counts that a cell makes at most.
KTH_ROWS = 1 << 20


def counted(others: bool = False) -> Kernel:
    """(query_id, bin, n): how many pool rows of the cell lie in each bin of a seed's range lo to hi, in steps of distance.

    Bins after the one in which the cell alone reaches the rank sought can't hold it; what lies there is one count, under BINS.
    """

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        j, out, step = ids(right), [], max(1, CHUNK // max(left.num_rows, BINS))
        for at in range(0, len(j), step):
            some = right.slice(at, step)
            lo, hi = (some[c].to_numpy() for c in ("lo", "hi"))
            value = np.clip(np.rint(_distances(left, some, others) / STEP), 0, np.inf)
            value = np.where(np.isinf(value), -1, np.minimum(value, _TOP)).astype(np.int64)
            inside = (value >= lo) & (value <= hi)
            bin_ = (value - lo) // _width(lo, hi) + BINS * np.arange(len(lo))
            n = np.bincount(bin_[inside], minlength=BINS * len(lo)).reshape(-1, BINS)
            before = np.cumsum(n, axis=1) - n
            early = before < some["rank"].to_numpy()[:, None]
            rest = np.where(early, 0, n).sum(1)
            q, b = np.nonzero(early & (n > 0))
            more = np.flatnonzero(rest)
            out.append((j[at + np.append(q, more)], np.append(b, np.full(len(more), BINS)).astype(np.int32), np.append(n[q, b], rest[more])))
        q, b, n = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": q, "bin": b, "n": n})

    return kernel


def _width(lo, hi):
    """Steps in a bin of the range, of numbers or of columns."""
    return F.floor((hi - lo) / BINS) + 1 if isinstance(lo, Column) else (hi - lo) // BINS + 1


def perquery_kth(pool: DataFrame, seeds: DataFrame, k: int, others: bool = False) -> DataFrame:
    """(query_id, kth): the k-th smallest distance 1 - cosine of each seed, to 9 digits, or the largest of fewer.

    A distributed selection, for any k: each round counts the distances of every query per bin of its range and goes on in
    the bin that holds the rank, until a bin is one step wide, after three rounds. Only counts are shuffled, k + 1 or BINS
    a query and cell at most. A range whose count isn't the one of the round before, because a product was rounded otherwise, starts
    anew. The table of results stays in the shared folder.
    """
    one = lambda df: df.withColumn("bucket", F.lit(0))
    few = max(1, min(SEED_TILE, KTH_ROWS // min(k + 1, BINS)))  # a cell makes up to so many counts a seed
    grid, work = Grid(one(pool), one(seeds), seed_tile=few), Work(pool.sparkSession, "kth")
    sought = grid.seeds.select(F.col("id").alias("query_id")).distinct()
    fresh = {"lo": F.lit(0).cast("bigint"), "hi": F.lit(_TOP).cast("bigint"), "rank": F.lit(k).cast("bigint"), "total": F.lit(None).cast("bigint")}
    state, rows, n = sought.withColumns(fresh), grid.seeds, 0
    while True:
        grid.seeds = rows.join(state.where("lo < hi").select(F.col("query_id").alias("id"), "lo", "hi", "rank"), "id")
        bins = grid.run(counted(others), "query_id bigint, bin int, n bigint").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("query_id").orderBy("bin")
        whole = Window.partitionBy("query_id")
        bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("seen", F.sum("n").over(whole)).join(state, "query_id")
        lost = F.col("seen") != F.coalesce("total", "seen")
        rank = F.least("rank", "seen")
        hit = bins.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
        low = F.col("lo") + F.col("bin") * _width(F.col("lo"), F.col("hi")).cast("bigint")
        new = {"lo": low, "hi": F.least(low + _width(F.col("lo"), F.col("hi")).cast("bigint") - 1, F.col("hi")), "rank": rank - F.col("upto") + F.col("n"), "total": F.col("n")}
        hit = hit.select("query_id", *(F.when(lost, fresh[c]).otherwise(e).cast("bigint").alias(c) for c, e in new.items()))
        state = work.stored(hit.unionByName(state.where("lo = hi")), str(n))
        if state.where("lo < hi").isEmpty():
            break
        n += 1
    for i in range(n):
        work.drop(str(i))
    return state.select("query_id", (F.col("lo") * F.lit(STEP)).alias("kth"))
