"""Toxicity of texts: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are densities of a lexicon learned from the training labels, its nearness to second-person words,
and rates of capitals, punctuation and obfuscated spelling; language, source and identifiers are never inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import forget, shared_dir, stored

#: Labelled rows that the model is fitted on at most, by a hash of their id.
TRAIN_ROWS = 20_000
#: Folds of the rows in calibration.
FOLDS = 4
#: Evidence (likelihood ratio statistic) that a word of the lexicon needs.
EVIDENCE = 20.0
#: Words of the learned lexicon at most, those of most evidence (a parameter of the model, not of what is scored).
LEXICON_WORDS = 96
#: Second-person words of four languages (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti usted ustedes vosotros tus".encode().split())
#: Words on either side of a lexicon word that count as near.
NEAR = 6

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_PUNCT = bytes(b for b in range(33, 127) if b not in _LETTERS and b not in _DIGITS)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Punctuation and digits part words.
_PLAIN = bytes(b if b in _LETTERS else 32 for b in range(256)).translate(_LOWER)
#: Characters written for letters (fixed values); other punctuation vanishes, so that d.o.t.s join.
_FOR = dict(zip(b"013457@$!|", b"oieastasil"))
_JOINED = bytes(_FOR.get(b, b) for b in range(256)).translate(_LOWER)
_VANISH = bytes(b for b in range(256) if b not in _FOR and b not in _LETTERS and b not in b" \t\n\v\f\r")
_MIXED = re.compile(rb"[A-Za-z][0-9@$!|*][A-Za-z]|(?:\b[A-Za-z][.\-_*]){3}")

FEATURES = ("words", "hits", "hit_rate", "weight", "weight_rate", "top_weight", "kinds", "joined_hits", "joined_rate", "second", "near", "near_rate", "upper", "exclaim", "punct", "digit", "mixed")


def words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def features(text: bytes, lexicon: dict[bytes, float]) -> list[float]:
    """The dense features of a whole text."""
    w = words(text)
    n, size = max(1, len(w)), max(1, len(text))
    at = [i for i, x in enumerate(w) if x in lexicon]
    weights = [lexicon[w[i]] for i in at]
    second = [i for i, x in enumerate(w) if x in SECOND_PERSON]
    near = 0
    if at and second:
        a, s = np.array(at), np.array(second)
        lo = np.searchsorted(s, a - NEAR)
        near = int((np.searchsorted(s, a + NEAR, "right") > lo).sum())
    joined = sum(x in lexicon for x in text.translate(_JOINED, _VANISH).split())
    gone = lambda some: (len(text) - len(text.translate(None, some))) / size
    return [
        np.log1p(len(w)), len(at), len(at) / n, sum(weights), sum(weights) / n, max(weights, default=0.0), len({w[i] for i in at}),
        max(0, joined - len(at)), max(0, joined - len(at)) / n, len(second) / n, near, near / n,
        gone(_UPPER), gone(b"!"), gone(_PUNCT), gone(_DIGITS), len(_MIXED.findall(text)) / n,
    ]


@dataclass
class Trees:
    """Boosted trees of one depth, stored as arrays; cuts are upper bounds of the left branch."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while node[0:1].size and node[0] < len(f):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - len(f)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss on binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    m, inner = np.full(len(y), base), 2**depth - 1
    fs, cs, vs = [], [], []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-m))
        g, h = y - q, np.maximum(q * (1 - q), 1e-6)
        node, f, c = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            best = 1e-6
            if len(at) > 1:
                gt, ht = g[at].sum(), h[at].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[at, j], g[at], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[at, j], h[at], len(e) + 1))[:-1]
                    gain = np.where((hl >= least) & (ht - hl >= least), gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1), -1)
                    if gain.max() > best:
                        b = int(gain.argmax())
                        best, f[k], c[k] = gain[b], j, e[b]
            node[at] = 2 * k + 1 + (x[at, f[k]] > c[k])
        v = np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + 1) * rate
        m += v[node - inner]
        fs.append(f)
        cs.append(c)
        vs.append(v)
    return Trees(np.array(fs), np.array(cs), np.array(vs), base)


def isotonic(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (margin, probability), rising."""
    order = np.argsort(m, kind="stable")
    stack: list[list[float]] = []
    for a, b in zip(m[order].tolist(), y[order].tolist()):
        stack.append([a, b, 1.0])
        while len(stack) > 1 and stack[-2][1] >= stack[-1][1]:
            x, p, n = stack.pop()
            u, q, k = stack[-1]
            stack[-1] = [(u * k + x * n) / (n + k), (q * k + p * n) / (n + k), n + k]
    knots = np.array([s[:2] for s in stack])
    return knots[:, 0], knots[:, 1]


@dataclass
class Model:
    lexicon: dict[bytes, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the calibrated steps are tilted slightly by the margin, so that order within a step is kept."""
        if self.trees is None or not len(x):
            return np.full(len(x), self.base)
        m = self.trees.margin(x)
        raw = 1 / (1 + np.exp(-m))
        return np.clip(0.98 * np.interp(m, *self.knots) + 0.02 * raw, 0, 1)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, text, y) of training rows: labelled 0 or 1 and not held out; of several labels of an id the highest counts.

    At most `rows` of them, the lowest by a hash of their id, so their ids may be broadcast; of several rows of an id the
    one with the least text.
    """
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    known = docs.select(F.col(id_col).alias("id")).where(~held_out("id")).join(y, "id").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = text.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    return stored(one.select("id", "text", "y").repartition(8), shared_dir(docs.sparkSession, "labelled"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """A model of the labels, fitted on a bounded sample."""
    sample = labelled(docs, labels, id_col, text_col, label_col, rows)
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    total = sum(n.values())
    if not n.get(1) or not n.get(0):
        return Model({}, None, None, n.get(1, 0) / total if total else 0.0)
    lexicon = _lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.encode(), lexicon) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    got = sample.select("id", "text", "y").mapInArrow(run, f"id {dict(sample.dtypes)['id']}, y int, x array<double>").toArrow().sort_by("id")
    x, y = np.array(got["x"].to_pylist()), got["y"].to_numpy().astype(float)
    # every row gets a margin from trees that haven't seen it; those calibrate the trees fitted on all rows
    fold, margin = np.arange(len(y)) % FOLDS, np.full(len(y), np.nan)
    for k in range(FOLDS):
        rest = fold != k
        if (~rest).any() and 0 < y[rest].sum() < rest.sum():
            margin[~rest] = fit_trees(x[rest], y[rest]).margin(x[~rest])
    seen = ~np.isnan(margin)
    if not 0 < y[seen].sum() < seen.sum():
        return Model(lexicon, None, None, float(y.mean()))
    return Model(lexicon, fit_trees(x, y), isotonic(margin[seen], y[seen]), float(y.mean()))


def _lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Words whose document frequency is far higher among toxic training rows, with their log ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[bytes, int], int] = {}
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in set(words(t.encode())):
                    count[w, y] = count.get((w, y), 0) + 1
        w, y = [k[0] for k in count], [k[1] for k in count]
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(y, pa.int32()), pa.array(list(count.values()), pa.int64())], ["w", "y", "n"])

    once = sample.dropDuplicates(["text"])  # copies are no further evidence
    n = {r["y"]: r["count"] for r in once.groupBy("y").count().collect()}
    df = once.select("text", "y").mapInArrow(run, "w binary, y int, n bigint").groupBy("w").agg(F.sum(F.expr("IF(y = 1, n, 0)")).alias("a"), F.sum(F.expr("IF(y = 0, n, 0)")).alias("b"))
    a, b, n1, n0 = F.col("a"), F.col("b"), n.get(1, 0), n.get(0, 0)
    ratio = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    share = n1 / max(1, n1 + n0)
    part = lambda k, p: F.when(k > 0, k * F.log(k / ((a + b) * p))).otherwise(0.0)
    evidence = 2 * (part(a, share) + part(b, 1 - share))
    picked = df.where((a >= max(4, n1 // 50))).withColumn("r", ratio).where((F.col("r") > 2.0) & (evidence >= EVIDENCE)).orderBy(F.desc(evidence), "w").limit(LEXICON_WORDS)
    return {bytes(r["w"]): float(r["r"]) for r in picked.collect()}


def scorer(spark, model: Model):
    """A Column function from text to score; null is empty."""
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        forget()
        m = shipped.value
        if m.trees is None:
            return pa.array(np.full(len(text), m.base))
        x = np.array([features((t.as_py() or "").encode(), m.lexicon) for t in text]).reshape(-1, len(FEATURES))
        return pa.array(m.score(x))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from 0.5 on).

    Null and empty texts are scored as empty; repeated rows score alike; without labels of both kinds every score is
    the share of toxic ones among them, or 0.
    """
    score = scorer(docs.sparkSession, train(docs, labels, id_col, text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    score = scorer(docs.sparkSession, train(docs, labels, id_col, text_col))
    return docs.where(score(F.col(text_col)) < 0.5)
