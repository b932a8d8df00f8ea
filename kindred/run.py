"""python -m kindred.run --pool POOL --seeds SEEDS --dims N [--mode MODE] ...: one expansion over delimited vectors.

Modes: brute, balls (exact, by a ball index), lsh, best, bound; compare (lsh, best and bound against brute), kernels (matrix
tiles against SQL on one input), sweep (the best of several numbers of sampled plane sets). Results go to standard
output, figures of the very run to standard error.
"""

from __future__ import annotations

import sys
import time
from argparse import Namespace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kindred.functions import vector as V
from kindred.model import Params, prepare
from kindred.operators import bounded, evaluate, hashing, similarity
from kindred.operators.tiles import observed
from kindred.sources import vectors as source

MODES = ("brute", "balls", "lsh", "best", "bound")


class Expansion:
    """One pool and seed set, searched in any mode."""

    def __init__(self, pool: DataFrame, seeds: DataFrame, dims: int, p: Params, planes: list[list[float]] | None = None, normal: bool = False) -> None:
        self.pool, self.seeds, self.dims, self.p, self.given, self.normal = pool, seeds, dims, p, planes, normal

    def planes(self, mode: str) -> list[list[float]]:
        """Those given, or drawn; of mode `best` and `bound` the best of the sampled sets."""
        if self.given is not None:
            return self.given
        draw = lambda i: V.random_planes(self.p.n_bits, self.dims, self.p.plane_seed + i, self.normal)
        return hashing.best_planes(self.seeds, [draw(i) for i in range(self.p.n_samples)]) if mode in ("best", "bound") else draw(0)

    def search(self, mode: str, kernel: str | None = None) -> tuple[DataFrame, dict[str, object]]:
        """((id, sim) of the k best, figures): seconds for planes and for the search, cosines compared and candidates skipped."""
        p, kernel, began = self.p, kernel or self.p.kernel, time.perf_counter()
        planes = self.planes(mode) if mode in ("lsh", "best", "bound") else None
        planned, report, seen = time.perf_counter(), bounded.Report(), Observation()
        if planes is not None:
            pool, seeds = (hashing.with_bucket(x, planes) for x in (self.pool, self.seeds))
        if mode == "brute":
            got = similarity.brute_topk(self.pool, self.seeds, p.k, kernel=kernel, observation=seen)
        elif mode == "balls":
            got = bounded.ball_topk(self.pool, self.seeds, p.k, report=report)
        elif mode == "bound":
            got = bounded.bound_topk(pool, seeds, p.k, p.min_bound_seeds, p.centroid, report=report)
        else:
            got = similarity.lsh_topk(pool, seeds, p.k, kernel=kernel, observation=seen)
        rows = sorted(got.collect(), key=lambda r: (-round(r["sim"], 9), r["id"]))  # k rows
        figures: dict[str, object] = {"mode": mode, "planning_s": round(planned - began, 3), "search_s": round(time.perf_counter() - planned, 3)}
        if mode in ("balls", "bound"):
            figures |= {"cosines": report.scored_cosines + report.overhead, "candidates": report.candidates, "skipped": report.candidates - report.scored, "rounds": report.rounds}
        elif kernel == "arrow":
            figures["cosines"] = observed(seen, "cosines")
        else:
            figures["kernel"] = kernel
        return self.pool.sparkSession.createDataFrame([tuple(r) for r in rows], "id bigint, sim double"), figures

    def compare(self) -> tuple[DataFrame, list[dict[str, object]]]:
        """(mode, matched, total, recall) of the bucketed modes against brute."""
        truth, first = self.search("brute")
        out, all_figures = None, [first]
        for m in ("lsh", "best", "bound"):
            found, figures = self.search(m)
            one = evaluate.recall(truth, found).select(F.lit(m).alias("mode"), "*")
            out, all_figures = one if out is None else out.unionByName(one), [*all_figures, figures]
        return out, all_figures

    def kernels(self) -> tuple[DataFrame, list[dict[str, object]]]:
        """(mode, kernel, seconds, agrees) of both kernels on this input, the second run of each; agrees: the same ids in the same order."""
        rows = []
        for mode in ("brute", "lsh"):
            answers = {}
            for kernel in ("sql", "arrow"):
                self.search(mode, kernel)
                found, figures = self.search(mode, kernel)
                answers[kernel] = [r["id"] for r in found.collect()]
                rows.append((mode, kernel, figures["search_s"], answers["sql"] == answers[kernel]))
        return self.pool.sparkSession.createDataFrame(rows, "mode string, kernel string, seconds double, agrees boolean"), []

    def sweep(self, samples: list[int]) -> tuple[DataFrame, list[dict[str, object]]]:
        """(samples, seconds, cost, cosines) of the best plane set among each number of sampled ones."""
        rows = []
        for n in samples:
            sets = [V.random_planes(self.p.n_bits, self.dims, self.p.plane_seed + i, self.normal) for i in range(n)]
            began = time.perf_counter()
            best = hashing.best_signature(self.seeds, sets).first()
            seconds = round(time.perf_counter() - began, 3)
            pairs = evaluate.lsh_cost(*(hashing.with_bucket(x, sets[best["sample"] or 0]) for x in (self.pool, self.seeds))).first()["pairs"]
            rows.append((n, seconds, best["cost"], pairs))
        return self.pool.sparkSession.createDataFrame(rows, "samples int, seconds double, cost bigint, cosines bigint"), []


def _load(spark: SparkSession, p: Params, args: Namespace) -> Expansion:
    pool, seeds = (prepare(source.read_delimited(spark, path, args.dims, args.sep), "id", "v") for path in (args.pool, args.seeds))
    planes = [r["w"] for r in source.read_planes(spark, args.planes, args.dims).orderBy("plane").collect()] if args.planes else None
    return Expansion(pool, seeds, args.dims, p, planes, args.normal)


def main(argv: list[str], spark: SparkSession | None = None) -> DataFrame:
    p, args = Params.from_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    began, tell = time.perf_counter(), lambda x: print("#", *(f"{k}={v}" for k, v in x.items()), file=sys.stderr)
    e = _load(spark, p, args)
    tell({"pool": e.pool.count(), "seeds": e.seeds.count(), "dims": args.dims, "read_s": round(time.perf_counter() - began, 3)})
    if args.save_planes:
        e.given = e.planes(args.mode)
        source.write_planes(hashing.planes_frame(spark, e.given), args.save_planes)
    if args.mode in MODES:
        got, figures = e.search(args.mode)
        figures = [figures]
        if args.out:
            source.write_topk(got, args.out)
        if args.baseline:
            stored = evaluate.recall(source.read_ids(spark, args.baseline, args.sep), got).first()
            figures.append({"baseline": args.baseline, **stored.asDict()})
    else:
        got, figures = e.sweep([int(n) for n in args.sweep.split(",")]) if args.mode == "sweep" else getattr(e, args.mode)()
    for row in got.collect():  # k rows, or one for each mode
        print(*row, sep=",")
    for x in figures:
        tell(x)
    return got


if __name__ == "__main__":
    main(sys.argv[1:])
