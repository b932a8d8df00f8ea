"""Parameters and the canonical vector relation."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import vector as V


@dataclass(frozen=True)
class Params:
    """Settings of one expansion run; every one is validated."""

    k: int = 20
    n_bits: int = 5
    n_samples: int = 10
    min_bound_seeds: int = 10
    plane_seed: int = 0
    centroid: str = "mean"
    kernel: str = "arrow"

    def __post_init__(self) -> None:
        if self.k < 1 or self.n_samples < 1 or self.min_bound_seeds < 0:
            raise ValueError("k and n_samples must be at least 1, min_bound_seeds at least 0")
        if not 0 <= self.n_bits <= 30:
            raise ValueError("n_bits must lie in 0..30")
        if self.centroid not in ("mean", "medoid") or self.kernel not in ("sql", "arrow"):
            raise ValueError("centroid is mean or medoid; kernel is sql or arrow")

    @classmethod
    def from_args(cls, argv: list[str]) -> tuple[Params, argparse.Namespace]:
        """Command-line settings: --pool and --seeds are paths, the rest as the fields."""
        parser = argparse.ArgumentParser(description="similarity audience expansion")
        parser.add_argument("--pool", required=True, help="delimited text, a vector to a line; an id is a line's number")
        parser.add_argument("--seeds", required=True)
        parser.add_argument("--dims", type=int, required=True)
        parser.add_argument("--mode", choices=("brute", "balls", "lsh", "best", "bound", "compare", "kernels", "sweep"), default="bound")
        parser.add_argument("--sep", default=",", help="what parts the cells of a line")
        parser.add_argument("--planes", help="read the planes from this file instead of drawing them")
        parser.add_argument("--save-planes", help="write the planes that the run uses")
        parser.add_argument("--normal", action="store_true", help="draw planes of normally distributed components")
        parser.add_argument("--out", help="write the ids found, best first")
        parser.add_argument("--baseline", help="compare the ids found with those stored here")
        parser.add_argument("--sweep", default="1,5,10,20,50", help="numbers of sampled plane sets that the sweep goes through")
        for f in fields(cls):
            parser.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=f.default)
        args = parser.parse_args(argv)
        return cls(**{f.name: getattr(args, f.name) for f in fields(cls)}), args


def prepare(df: DataFrame, id_col: str, vec_col: str, dims: int | None = None) -> DataFrame:
    """(id BIGINT, v ARRAY<DOUBLE>, norm DOUBLE); dims keeps a prefix of each vector.

    A null vector, or one with a null component, gets a null norm and so links with nothing.
    """
    v = F.col(vec_col).cast("array<double>")
    v = F.slice(v, 1, dims) if dims else v
    df = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    return df.withColumn("norm", V.norm("v"))
