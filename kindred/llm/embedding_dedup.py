"""Exact threshold pairs of embeddings by a dual traversal of cover trees.

Within a class the vectors form nested nets: each level's centres are a subset of the level below's, and radii halve
from level to level. Two trees are walked down together; a pair of nodes goes when the distance of its centres less
both covering radii exceeds the threshold, so no pair above the similarity is lost, and what reaches the bottom is
decided by the cosine itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import Forest, components
from kindred.llm.shared import left_join_hot, made, shared_dir, stored, swept, text_key

SIMILARITY = 0.93
#: Distinct vectors of a class that meet in one task; larger classes are cut into blocks, and every two blocks meet.
BLOCK_VECTORS = 8192
#: Radii of the nets, from the finest.
RADII = (0.125, 0.25, 0.5, 1.0)


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


def _net(x: np.ndarray, radius: float, count: list[int], step: int = 256) -> tuple[np.ndarray, np.ndarray] | None:
    """(centres, owner): indices of a greedy net, and for each point the position of a centre within radius.

    None if the net won't halve the points: if they are few and it doesn't, or if of the first 2 * step three in four are centres.
    count gets the cosines taken.
    """
    least = 1 - radius * radius / 2
    centres: list[int] = []
    owner = np.empty(len(x), np.int64)
    for lo in range(0, len(x), step):
        if lo >= 2 * step and len(centres) > 0.75 * lo:
            return None
        some = x[lo : lo + step]
        free = np.ones(len(some), bool)
        if centres:
            cos = some @ x[centres].T
            best = cos.argmax(1)
            free = cos[np.arange(len(some)), best] < least
            owner[lo : lo + step] = best
        own = some @ some.T
        count[0] += len(some) * (len(centres) + len(some))
        while free.any():
            i = int(free.argmax())
            near = free & (own[i] >= least)
            near[i] = True
            owner[lo : lo + step][near] = len(centres)
            centres.append(lo + i)
            free &= ~near
    return (np.array(centres, np.int64), owner) if len(centres) <= len(x) // 2 else None


class CoverTree:
    """Levels from the coarsest: (centre of each node, its covering radius, first child of each node and the end), the last are the points.

    A level stands for the points in the order `order`, so that what a node covers, and its children, are runs. A net that doesn't
    at least halve the level below it is left out, for its nodes would be looked at without being fewer; that changes no answer.
    Where not even the widest net halves the points, there is no other level. `cosines` counts those taken to build the tree.
    """

    def __init__(self, unit: np.ndarray) -> None:
        n = len(unit)
        at, node, levels, taken = np.arange(n), np.arange(n), [], [0]  # centres, node of each point; from the finest
        for r in RADII if _net(unit[: 1 << 10], RADII[-1], taken) else ():
            net = _net(unit[at], r, taken)
            if net:
                at, node = at[net[0]], net[1][node]
                levels.append((at, node))
        self.cosines = taken[0] + n * len(levels)
        self.order = np.lexsort([node for _, node in levels]) if levels else np.arange(n)
        self.unit = unit[self.order]
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        starts = [np.arange(n + 1)]  # where the points of each node begin
        for _, node in levels:
            starts.append(np.append(np.flatnonzero(np.diff(node[self.order], prepend=-1)), n))
        self.levels = []
        for k in range(len(levels), 0, -1):
            at, node = levels[k - 1]
            head = place[at][node[self.order][starts[k][:-1]]]
            far = _distance((self.unit * self.unit[np.repeat(head, np.diff(starts[k]))]).sum(1))
            self.levels.append((head, np.maximum.reduceat(far, starts[k][:-1]), np.searchsorted(starts[k - 1], starts[k])))
        self.levels.append((np.arange(n), np.zeros(n), np.arange(n + 1)))
        self.top = len(self.levels[0][0])

    def level(self, i: int):
        """Level i; a tree with fewer levels stays at its points, each its own child."""
        return self.levels[min(i, len(self.levels) - 1)]


#: Node pairs whose cosines are taken at once, and children of a pair from which they are by a matrix product.
PAIRS, BLOCK_PAIRS = 1 << 17, 1 << 11


def _products(a: CoverTree, b: CoverTree, ca: np.ndarray, cb: np.ndarray, ranges: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of the nodes in each product of ranges a0..a1 and b0..b1, and of no others; of a range of a tree with itself,
    those before a block's first row are left out, for they have come the other way round."""
    a0, a1, b0, b1 = ranges
    many = (a1 - a0) * (b1 - b0)
    for x in np.flatnonzero(many >= BLOCK_PAIRS).tolist():
        step = max(1, min(512, (1 << 22) // (b1[x] - b0[x])))
        for lo in range(a0[x], a1[x], step):
            i = np.arange(lo, min(lo + step, a1[x]))
            j = np.arange(lo if a is b and a0[x] == b0[x] else b0[x], b1[x])
            yield np.repeat(i, len(j)), np.tile(j, len(i)), (a.unit[ca[i]] @ b.unit[cb[j]].T).ravel()
    small = np.flatnonzero((many < BLOCK_PAIRS) & (many > 0))
    ends, x = np.cumsum(many[small]), 0
    while x < len(small):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + PAIRS, "right")))
        s = small[x:y]
        of = np.repeat(s, many[s])
        k = np.arange(len(of)) - np.repeat(np.cumsum(many[s]) - many[s], many[s])
        wide = (b1 - b0)[of]
        i, j = a0[of] + k // wide, b0[of] + k % wide
        yield i, j, np.einsum("ij,ij->i", a.unit[ca[i]], b.unit[cb[j]])
        x = y


def dual_links(a: CoverTree, b: CoverTree, similarity: float, count: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): linked points of a and b, by their place in the order of their tree; of one tree with itself, i < j.

    Cosines are taken of the children of node pairs that live, and of no others; count gets how many at each level.
    """
    reach, one = float(np.sqrt(2 - 2 * similarity)) + 1e-6, a is b
    depth = max(len(a.levels), len(b.levels))
    ranges = tuple(np.array([x]) for x in (0, a.top, 0, b.top))
    for k in range(depth):
        (ca, ra, ka), (cb, rb, kb) = a.level(k), b.level(k)
        last, live, seen = k == depth - 1, [], 0
        for i, j, cos in _products(a, b, ca, cb, ranges):
            seen += len(i)
            near = cos >= similarity if last else _distance(cos) - ra[i] - rb[j] <= reach
            if one:
                near &= (i < j) if last else (i <= j)
            i, j = i[near], j[near]
            if last:
                yield ca[i], cb[j]
            else:
                live.append((i, j))
        if count is not None:
            count.append(seen)
        if last:
            return
        i, j = (np.concatenate(x) for x in zip(*live))
        ends = [k < len(t.levels) - 1 for t in (a, b)]
        a0, a1 = (ka[i], ka[i + 1]) if ends[0] else (i, i + 1)
        b0, b1 = (kb[j], kb[j + 1]) if ends[1] else (j, j + 1)
        ranges = (a0, a1, b0, b1)


def _cell(unit: np.ndarray, side: np.ndarray, weight: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(root of each vector under the links found, linked weight) within one block, or between its two sides."""
    root, w = np.arange(len(unit)), np.zeros(len(unit), np.int64)
    left = np.flatnonzero(side == side[0])
    right = np.flatnonzero(side != side[0])
    a = CoverTree(unit[left])
    b = CoverTree(unit[right]) if len(right) else a
    left, right = left[a.order], right[b.order] if len(right) else left[a.order]
    for i, j in dual_links(a, b, similarity):
        i, j = left[i], right[j]
        w += np.bincount(i, weight[j], len(w)).astype(np.int64) + np.bincount(j, weight[i], len(w)).astype(np.int64)
        some = np.unique(np.stack([root[i], root[j]], 1)[root[i] != root[j]], axis=0)
        if len(some):
            f = Forest(len(root))
            for x, y in some.tolist():
                f.join(x, y)
            root = np.array([f.root(x) for x in range(len(root))])[root]
    return root, w


def embedding_dedup(vectors: DataFrame, similarity: float = SIMILARITY, id_col: str = "vec_id", vec_col: str = "embedding", class_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Rows link when their classes are equal and not null and the cosine in double precision is at least similarity.
    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors of different
    length. Other columns are ignored. Equal vectors are looked at once; they link with each other. n_links counts other rows; component_id is the
    smallest id reachable. Rows repeated with one id link with each other; an empty table gives no rows.
    """
    spark, before = vectors.sparkSession, len(made)
    home = shared_dir(spark, "vectors")
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(class_col).cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    keyed = stored(rows.withColumn("key", F.when(F.coalesce(good, F.lit(False)), text_key(F.to_json(F.struct("label", "v"))))), f"{home}/rows")
    reps = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    reps = stored(reps.withColumn("dims", F.size("v")), f"{home}/reps")
    blocks = reps.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).cast("int").alias("blocks"))
    member = reps.join(blocks, ["label", "dims"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    spread = member.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select(
        "label", "dims", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "key", "copies", "v"
    )

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            x = np.array([r[3] for r in held])
            x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
            unit = x / np.sqrt((x * x).sum(1, keepdims=True))
            side = np.array([r[0] for r in held])
            key = pa.array([r[1] for r in held], pa.binary())
            root, w = _cell(unit, side, np.array([r[2] for r in held], np.int64), similarity)
            some = np.flatnonzero(w)
            return pa.RecordBatch.from_arrays([key.take(pa.array(some)), key.take(pa.array(root[some])), pa.array(w[some])], ["u", "v", "w"])

        for b in batches:
            for label, dims, x, y, block, key, copies, vec in zip(*(c.to_pylist() for c in b.columns)):
                if (label, dims, x, y) != now:
                    if len(held) > 1 and (now[2] == now[3] or len({r[0] for r in held}) == 2):
                        yield done()
                    now, held = (label, dims, x, y), []
                held.append((block, key, copies, vec))
        if len(held) > 1 and (now[2] == now[3] or len({r[0] for r in held}) == 2):
            yield done()

    by = ["label", "dims", "x", "y"]
    found = stored(spread.repartition(*by).sortWithinPartitions(*by).mapInArrow(cells, "u binary, v binary, w bigint"), f"{home}/links")
    counts = found.groupBy("u").agg(F.sum("w").alias("w"))
    comp = components(found.select("u", "v"))
    low = reps.select("key", "low", "copies").join(comp, reps["key"] == comp["node"], "left").select("key", "low", "copies", F.coalesce("component", "key").alias("c"))
    least = low.groupBy("c").agg(F.min("low").alias("component_id"))
    klass = low.join(least, "c").join(counts, low["key"] == counts["u"], "left").select("key", "component_id", (F.col("copies") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"))
    out = left_join_hot(keyed.select("vec_id", "key"), klass, "key", keyed.count())
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return swept(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), before)
