"""Searches that score candidates in rounds, the most promising first, and stop at a moving threshold.

A candidate is a pool row with a group of seeds and an upper bound of its similarity to any of them. Candidates are banded
by bound. A round scores one band as matrix tiles, which raises the k-th best similarity; the next round leaves out what is
bounded below it, and the search ends when the next band's top is. Angles obey the triangle inequality, so a group whose
members lie between two angles from a centre bounds a row by the row's own angle to that centre. What is skipped could
not be among the k best, so the answer is that of scoring everything.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kindred.functions import vector as V
from kindred.operators.ranking import topk
from kindred.operators.summary import bucket_summary
from kindred.operators.tiles import COUNT_ROWS, SCORES, Grid, best_cosine, best_of, observed
from kindred.sources.work import Work, ship

#: Bounds below the threshold by less than this are scored nevertheless: the error of arccos near 1.
SLACK = 1e-7
#: Bands of bounds: a bound of 1, then so many to a halving of the bound's angle. Neighbours are joined until a round has work enough.
BANDS, HALVING = 64, 4
#: Each round takes so many times the cosines of the rounds before it, if the candidates allow it.
GROWTH = 3
#: Balls that the seeds are cut into at most; their centres are what is broadcast.
MAX_BALLS = 1024


@dataclass
class Report:
    """What a search did: pairs of a row and a group of seeds, those among them that the first threshold leaves as candidates
    with their cosines, how many of these were scored, cosines besides (to centres), rounds, and the threshold after each."""

    pairs: int = 0
    candidates: int = 0
    cosines: int = 0
    scored: int = 0
    scored_cosines: int = 0
    overhead: int = 0
    rounds: int = 0
    taus: list[float] = field(default_factory=list)


class Best:
    """The k best (id, similarity) so far; k rows, on the driver."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, {}

    def add(self, rows) -> None:
        for i, s in rows:
            self.rows[i] = max(s, self.rows.get(i, s))
        self.rows = dict(sorted(self.rows.items(), key=lambda x: (-round(x[1], 9), x[0]))[: self.k])

    @property
    def tau(self) -> float:
        """The k-th best similarity, 0 as long as there are fewer."""
        return min(self.rows.values()) if len(self.rows) == self.k else 0.0


def bands(hist: list[tuple[int, int, int]], k: int) -> list[tuple[int, int]]:
    """(lowest, highest) bins of each round from (bin, candidates, cosines): first those of enough candidates for k rows."""
    out, some, done, high, taken = [], 0, 0, BANDS - 1, 0
    for b, n, cosines in sorted(hist, reverse=True):
        some, taken = some + cosines, taken + n
        if taken >= 4 * k and some >= GROWTH * done or b == min(hist)[0]:
            out.append((b, high))
            high, done, some = b - 1, done + some, 0
    return out


def _summed(rows) -> list[tuple[int, int, int]]:
    """Two numbers summed by a first: (band, candidates, cosines)."""
    out: dict[int, tuple[int, int]] = {}
    for b, n, c in rows:
        m, d = out.get(b, (0, 0))
        out[b] = (m + n, d + c)
    return [(b, n, c) for b, (n, c) in out.items()]


def _band(ub: Column) -> Column:
    """The band of a bound between 0 and 1, the highest for 1."""
    nth = F.floor(-HALVING * F.log2(F.acos(F.least(ub, F.lit(1.0))) / (math.pi / 2)))
    return F.when(ub >= 1, BANDS - 1).otherwise(F.greatest(F.lit(0), F.least(nth, F.lit(BANDS - 2)))).cast("int")


def _bands(ub: np.ndarray) -> np.ndarray:
    """_band() of an array."""
    with np.errstate(divide="ignore"):
        nth = np.floor(-HALVING * np.log2(np.arccos(np.minimum(ub, 1)) / (np.pi / 2)))
    return np.where(ub >= 1, BANDS - 1, np.clip(nth, 0, BANDS - 2)).astype(np.int64)


def _top(band: int) -> float:
    """No bound of the band is greater."""
    return 1.0 if band >= BANDS - 2 else math.cos(math.pi / 2 * 2 ** (-(band + 1) / HALVING))


Counts = list[tuple[int, int, int, int]]


def rounds(hist: list[tuple[int, int, int]], near: Callable[[int, int, float], tuple[DataFrame, Counts | None]], seeds: DataFrame, best: Best, others: bool, report: Report) -> None:
    """Scores the candidates near(lowest band, highest band, threshold) -> (id, v, norm, bucket), with their counts per bucket
    where they are known, band after band into `best`. The figures are observed in the runs themselves."""
    report.candidates, report.cosines = sum(x[1] for x in hist), sum(x[2] for x in hist)
    for low, high in bands(hist, best.k):
        if _top(high) + SLACK < best.tau:
            break
        rows, counts = near(low, high, best.tau)
        taken, seen = Observation(), Observation()
        grid = Grid(rows.observe(taken, F.count(F.lit(1)).alias("rows")), seeds, counts=counts)
        report.rounds += 1
        if grid.cosines:
            best.add(tuple(r) for r in topk(best_of(grid.run(best_cosine(others), SCORES), seen), best.k).collect())
            report.scored, report.scored_cosines = report.scored + observed(taken, "rows"), report.scored_cosines + observed(seen, "cosines")
        report.taus.append(best.tau)


def _result(pool: DataFrame, best: Best) -> DataFrame:
    return pool.sparkSession.createDataFrame(list(best.rows.items()), "id bigint, sim double")


def bound_topk(pool: DataFrame, seeds: DataFrame, k: int, min_bound_seeds: int = 10, centroid: str = "mean", others: bool = False, report: Report | None = None) -> DataFrame:
    """(id, sim) of the inner bucketed search, scoring rows in rounds by the bound of their bucket.

    Rows of buckets with fewer than min_bound_seeds seeds, or whose seeds have no centre, are bounded by 1.
    """
    report, best = report if report is not None else Report(), Best(k)
    with Work(pool.sparkSession, "bound") as work:
        s = bucket_summary(seeds, centroid).select("bucket", "n_seeds", "centroid", "c_norm", "theta_a", "theta_b")
        ub = V.ring_bound(V.angle(V.cosine("v", "centroid", "norm", "c_norm")), "theta_a", "theta_b")
        ub = F.when(F.col("n_seeds") < min_bound_seeds, 1.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(ub, F.lit(1.0))))
        rows = work.stored(pool.where("norm > 0").join(s, "bucket").select("id", "v", "norm", "bucket", "n_seeds", ub.alias("ub"), _band(ub).alias("band")), "rows")
        by = rows.groupBy("band", "bucket", F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("p"), F.max("n_seeds").alias("s"))
        cells = by.limit(COUNT_ROWS + 1).collect()
        known = len(cells) <= COUNT_ROWS  # else the grids count for themselves
        hist = _summed((r["band"], r["p"], r["p"] * r["s"]) for r in cells) if known else [tuple(r) for r in by.groupBy("band").agg(F.sum("p"), F.sum(F.col("p") * F.col("s"))).collect()]
        report.pairs = sum(x[1] for x in hist)

        def near(low: int, high: int, tau: float) -> tuple[DataFrame, Counts | None]:
            some = rows.where(F.col("band").between(low, high) & (F.col("ub") + SLACK >= tau)).select("id", "v", "norm", "bucket")
            counts: dict[tuple[int, int], tuple[int, int]] = {}
            for r in cells if known else ():
                if low <= r["band"] <= high:
                    counts[r["bucket"], r["w"]] = (counts.get((r["bucket"], r["w"]), (0, 0))[0] + r["p"], r["s"])
            return some, [(*k, *v) for k, v in counts.items()] if known else None

        rounds(hist, near, seeds, best, others, report)
    return _result(pool, best)


@dataclass
class Balls:
    """Centres (rows of length 1) with their ids, and per ball the least and greatest angle of its other members and their number."""

    centre: np.ndarray
    ids: np.ndarray
    least: np.ndarray | None = None
    most: np.ndarray | None = None
    size: np.ndarray | None = None

    def angles(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cos = v @ self.centre.T
        return cos, np.arccos(np.clip(cos, -1, 1))

    def bound(self, angle: np.ndarray) -> np.ndarray:
        return np.cos(np.maximum(0, np.maximum(angle - self.most, self.least - angle)))


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch (id, v, norm) as rows of length 1."""
    flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(b.num_rows, -1) / b.column("norm").to_numpy()[:, None]


def _balls(seeds: DataFrame, work: Work, number: int) -> tuple[Balls, DataFrame]:
    """The balls and their members (id, v, norm, bucket): every seed goes to its nearest centre, a sample of the seeds by hash."""
    picked = seeds.orderBy(F.xxhash64("id"), "id").limit(number).collect()
    balls = Balls(np.array([r["v"] for r in picked]) / np.array([[r["norm"]] for r in picked]), np.array([r["id"] for r in picked]))
    shipped = seeds.sparkSession.sparkContext.broadcast(balls)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, angle = shipped.value.angles(_vectors(b))
                nearest = angle.argmin(1)
                mine = np.isin(b.column("id").to_numpy(), shipped.value.ids)
                out = [b.column(c) for c in ("id", "v", "norm")] + [pa.array(nearest.astype(np.int32)), pa.array(angle[np.arange(len(angle)), nearest])]
                yield pa.RecordBatch.from_arrays(out, ["id", "v", "norm", "bucket", "angle"]).filter(pa.array(~mine))

    member = work.stored(seeds.mapInArrow(assign, "id bigint, v array<double>, norm double, bucket int, angle double"), "members")
    balls.least, balls.most, balls.size = np.full(len(picked), np.pi), np.zeros(len(picked)), np.zeros(len(picked), np.int64)
    for r in member.groupBy("bucket").agg(F.min("angle").alias("a"), F.max("angle").alias("b"), F.count(F.lit(1)).alias("n")).collect():  # a row a ball
        balls.least[r["bucket"]], balls.most[r["bucket"]], balls.size[r["bucket"]] = r["a"], r["b"], r["n"]
    return balls, member.drop("angle")


def ball_topk(pool: DataFrame, seeds: DataFrame, k: int, others: bool = False, balls: int | None = None, report: Report | None = None) -> DataFrame:
    """(id, sim) of the exact search over all seeds, by a ball index on the seeds.

    The seeds are cut into balls, the square root of their number (MAX_BALLS at most) unless given. The cosines of all pool
    rows to the centres, which are seeds, give the first threshold. Then a pool row meets only balls whose bound reaches the
    threshold, band after band. Where the bounds spare less than half of all cosines, the plain grid runs instead, with the
    same answer: then the rows would travel once for each ball. All vectors have one length.
    """
    report, best = report if report is not None else Report(), Best(k)
    ship(pool.sparkSession)
    pool, seeds = (x.where("norm > 0").select("id", "v", "norm") for x in (pool, seeds))
    with Work(pool.sparkSession, "balls") as work:
        q = seeds.count()
        number = balls or min(MAX_BALLS, int(np.ceil(np.sqrt(q))))
        if not q:
            return _result(pool, best)
        index, member = _balls(seeds, work, number)
        shipped = pool.sparkSession.sparkContext.broadcast(index)

        def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cos, i = shipped.value.angles(_vectors(b))[0], b.column("id").to_numpy()
                    if others:
                        cos[i[:, None] == shipped.value.ids] = -np.inf
                    sim = cos.max(1)
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.maximum(sim, 0.0))], ["id", "sim"]).filter(pa.array(sim > -np.inf))

        def banded(batches: Iterator[pa.RecordBatch], tau: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
            for b in batches:
                if b.num_rows:
                    ball = shipped.value
                    ub = np.maximum(ball.bound(ball.angles(_vectors(b))[1]), 0.0)
                    yield b, _bands(ub), (ub + SLACK >= tau) & (ball.size > 0)

        first = topk(pool.mapInArrow(lower, "id bigint, sim double").groupBy("id").agg(F.max("sim").alias("sim")), k)
        best.add(tuple(r) for r in first.collect())
        tau = best.tau

        def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, rows = np.zeros(BANDS * number, np.int64), 0
            for b, band, live in banded(batches, tau):
                rows += b.num_rows
                n += np.bincount((band * number + np.arange(number))[live], minlength=BANDS * number)
            some = np.flatnonzero(n)
            out = [*(pa.array(np.append(x, -1), pa.int32()) for x in (some // number, some % number)), pa.array(np.append(n[some], rows))]
            yield pa.RecordBatch.from_arrays(out, ["b", "ball", "n"])

        cells = [tuple(r) for r in pool.mapInArrow(histogram, "b int, ball int, n bigint").groupBy("b", "ball").agg(F.sum("n").alias("n")).collect()]  # BANDS a ball at most
        rows = sum(n for b, _, n in cells if b < 0)
        cells = [c for c in cells if c[0] >= 0]
        hist = _summed((b, n, n * int(index.size[ball])) for b, ball, n in cells)
        report.overhead, report.pairs = q * number + 2 * rows * number, rows * number
        if 2 * sum(c for _, _, c in hist) > rows * q:
            hist, one = [(BANDS - 1, rows, rows * q)], lambda df: df.withColumn("bucket", F.lit(0))
            rounds(hist, lambda low, high, tau: (one(pool), None), one(seeds), best, others, report)
            return _result(pool, best)

        def near(low: int, high: int, tau: float) -> tuple[DataFrame, Counts]:
            def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b, band, live in banded(batches, tau):
                    row, ball = np.nonzero(live & (band >= low) & (band <= high))
                    for lo in range(0, len(row), 4096):
                        some = b.take(pa.array(row[lo : lo + 4096]))
                        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(ball[lo : lo + 4096].astype(np.int32))], ["id", "v", "norm", "bucket"])

            n = _summed((ball, n, 0) for b, ball, n in cells if low <= b <= high)
            counts = [(ball, index.centre.shape[1], p, int(index.size[ball])) for ball, p, _ in n]
            return pool.mapInArrow(pairs, "id bigint, v array<double>, norm double, bucket int"), counts

        if hist:
            rounds(hist, near, member, best, others, report)
        report.overhead += report.rounds * rows * number
    return _result(pool, best)
