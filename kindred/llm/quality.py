"""Document quality by hierarchical empirical Bayes over sites.

A classifier gives each document's evidence as a log likelihood ratio. Hosts and paths get posterior rates of good
documents from the sums of their documents' probabilities: a path is shrunk to its host, a host to the corpus, the more
the fewer documents it has; how much, the spread between sites decides. A document's score joins its evidence with the
rate of its path, from which its own share has been taken out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import shared_dir, stored
from kindred.llm.toxicity import Trees, fit_trees, held_out, labelled

#: Evidence counts up to this log likelihood ratio (a parameter of the model: no text alone outweighs its site without bound).
CAP = 12.0
_ALNUM = bytes(b for b in range(256) if b > 127 or chr(b).isalnum()) + b" \t\n\v\f\r"


def features(text: bytes) -> list[float]:
    """Dense features of a whole text: lengths, variety, repetition, layout, symbols."""
    w, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, size, m = max(1, len(w)), max(1, len(text)), max(1, len(lines))
    share = lambda some: sum(map(text.count, some)) / n
    symbols = len(text.translate(None, _ALNUM)) / size
    upper = (len(text) - len(text.translate(None, bytes(range(65, 91))))) / size
    digit = (len(text) - len(text.translate(None, b"0123456789"))) / size
    return [
        np.log1p(len(w)), len(text) / n, len(set(w)) / n ** 0.85, sum(a == b for a, b in zip(w, w[1:])) / n,
        len(w) / m, 1 - len(set(lines)) / m if lines else 0.0, sum(x.rstrip()[-1:] in b".!?\"" for x in lines) / m,
        symbols, upper, digit, share((b"|",)), share((b"###", b"$$$", b"%%%", b"&&&", b"***")), share((b"!",)), share((b",", b".")), share((b"http", b"www.", b"@")),
    ]


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[Trees | None, float]:
    """(trees, share of good ones) from a bounded sample of the labelled rows that aren't held out."""
    sample = labelled(docs, labels, id_col, text_col, label_col)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.encode()) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], ["id", "y", "x"])

    got = sample.select("id", "y", "text").mapInArrow(run, f"id {dict(sample.dtypes)['id']}, y int, x array<double>").toArrow().sort_by("id")
    y = got["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None, float(y.mean()) if len(y) else 0.5
    return fit_trees(np.array(got["x"].to_pylist()), y, rounds=60), float(y.mean())


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, rate: Column) -> float:
    """Prior documents a site is worth, by moments: the larger, the less the sites' rates differ beyond chance."""
    n, d = F.col("n"), F.col("s") / F.col("n") - rate
    r = sites.where("n > 1").agg(F.sum(n * d * d), F.sum(n), F.count(F.lit(1)), F.avg(rate * (1 - rate)), F.sum(n * n)).first()
    if not r[2] or r[2] < 2 or not r[3]:
        return 10.0
    spread, total, k, var, squares = (float(x) for x in r)
    between = (spread - k * var) / max(1e-9, total - squares / total)
    return float(min(1000.0, max(1.0, var / between - 1))) if between > 1e-9 else 1000.0


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: doc_id, held_out, evidence, host_rate, path_rate, score, kept (score of 0.5 and more).

    Null and empty texts are scored as empty. A null host is a site of its own, and so is a null path of a host.
    Repeated rows count each. Without labels of both kinds there is no evidence and the score is the rate. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    trees, base = fit(docs, labels, id_col, text_col, label_col)
    shipped = spark.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def llr(text: pa.Array) -> pa.Array:
        t = shipped.value
        if t is None:
            return pa.array(np.zeros(len(text)))
        x = np.array([features((s.as_py() or "").encode()) for s in text]).reshape(len(text), -1)
        return pa.array(np.clip(t.margin(x) - t.base, -CAP, CAP) if len(text) else np.zeros(0))

    named = lambda site: F.coalesce(F.concat(F.lit("="), site.cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), named(host).alias("host"), named(path).alias("path"), llr(F.col(text_col)).alias("evidence"))
    prior = float(np.log(base / (1 - base))) if 0 < base < 1 else 0.0
    rows = rows.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + prior))) if trees is not None else F.lit(base))
    rows = stored(rows, shared_dir(spark, "quality"))
    paths = stored(rows.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count(F.lit(1)).cast("double").alias("n")), shared_dir(spark, "quality-paths"))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    mean = total[0] / total[1] if total[1] else base
    k_host = _strength(hosts, F.lit(mean))
    hosts = hosts.select("host", ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    k_path = _strength(paths, F.col("host_rate"))
    out = rows.join(paths, ["host", "path"])  # a hot site's rows are split by adaptive execution; sites are unique on the right
    own = (F.col("s") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    logit = F.col("evidence") + _logit(own)
    return out.select("doc_id", "held_out", "evidence", "host_rate", own.alias("path_rate"), (1 / (1 + F.exp(-logit))).alias("score")).withColumn("kept", F.col("score") >= 0.5)
