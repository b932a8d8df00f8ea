"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.shared import drop, left_join_hot, shared_dir, stored


#: Edges contracted together, and in one task after edges of all tasks were once.
EDGES, TASK_EDGES = 1 << 18, 1 << 20


class Forest:
    """Union-find over 0..n-1; the least member is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as stars around the least node: same components, shorter paths. Stars are contracted with the edges that follow, up to
    EDGES together, until the stars alone are half of that."""

    def stars() -> pa.RecordBatch:
        u, v = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
        both = pa.concat_arrays([u, v]).dictionary_encode()
        order = pc.sort_indices(both.dictionary)
        nodes = both.dictionary.take(order)
        rank = np.empty(len(nodes), np.int64)
        rank[order.to_numpy()] = np.arange(len(nodes))
        at = rank[both.indices.to_numpy()]
        f = Forest(len(nodes))
        for i, j in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
            f.join(i, j)
        root = np.array([f.root(i) for i in range(len(nodes))], np.int64)
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(own)), nodes.take(pa.array(root[own]))], ["u", "v"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= EDGES:
            held = [stars()]
            if 2 * held[0].num_rows >= EDGES:
                yield held.pop()
    if held:
        yield stars()


def _large(e: DataFrame, total: int) -> DataFrame:
    """Each edge's lesser end gives way to the least node that it has an edge to."""
    least = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
    return left_join_hot(e, least, "v", total).select("u", F.coalesce("m", "v").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours get an edge to the least of these; they are few, for edges were contracted."""
    to = e.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return to.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each component of edges (u, v), for nodes with an edge; any type that has an order.

    Self-loops and repeated edges are ignored. Each round is stored in the shared folder, where the one before it goes;
    the number of rounds grows with the logarithm of the longest path, and only two numbers a round reach the driver.
    A node with very many edges is looked up in a broadcast table of bounded size.
    """
    spark, home = edges.sparkSession, shared_dir(edges.sparkSession, "components")
    kind = dict(edges.dtypes)["u"]
    put = lambda x, n: stored(x.distinct().mapInArrow(_contracted, f"u {kind}, v {kind}"), f"{home}/{n}")
    e = put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), 0)
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    was, n = mark(e), 0
    if was[0]:  # dealt by hash, the edges of one component met in few tasks; met in fewer tasks they leave little more than a tree
        e, n = stored(e.coalesce(was[0] // TASK_EDGES + 1).mapInArrow(_contracted, f"u {kind}, v {kind}"), f"{home}/1"), 1
        drop(spark, f"{home}/0")
        was = mark(e)
    while was[0]:
        n += 1
        e = put(_small(_large(e, was[0])), n)
        drop(spark, f"{home}/{n - 1}")
        now = mark(e)
        if now == was:
            break
        was = now
    heads = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads.select("node", F.col("node").alias("component")))
