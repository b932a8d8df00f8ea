"""URL filtering by rules, and by gradient-boosted trees where no rule fits.

A rule has a host and a path and decides for the URLs of that host and its subdomains whose path begins with its own; of
several the longest decides. What the rules decide are the labelled URLs. Trees are fitted on a bounded sample of
them over lexical features and judge the rest: lengths, depth, digit ratios, entropies, parameter counts, and how often URLs
of the same host suffix are blocked. That share leaves out the fold of URLs to which a training row belongs, so that no
row sees its own label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import drop, left_join_hot, shared_dir, stored
from kindred.llm.toxicity import Trees, fit_trees
from kindred.llm.words import buffers

#: Labelled URLs that the trees are fitted on at most: the lowest by a hash.
TRAIN_ROWS = 20_000
#: Folds that the labelled URLs are dealt to.
FOLDS = 5
#: Labelled URLs that the rate of all of them is worth beside a suffix's own.
PRIOR = 20.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "length", "host length", "path length", "query length", "labels", "depth", "host digits", "path digits", "host hyphens",
    "entropy", "host entropy", "path entropy", "parameters", "escapes", "fragment", "suffix", "rate of site", "site", "rate of domain", "domain",
)


def located(urls: DataFrame, url_col: str) -> DataFrame:
    """urls with host, path, query, fragment, domain (last label of the host), site (last two) and fold.

    The host goes from the first `://` to the next `/`, `?`, `#`, A-Z lower-cased; all are empty without `://`.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    out = urls.withColumn("_rest", rest).withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    out = out.withColumn("_tail", F.substr("_rest", F.length("_host") + 1)).withColumn("host", F.translate("_host", _UPPER, _LOWER))
    out = out.withColumn("path", F.regexp_extract("_tail", "^[^?#]*", 0)).withColumn("_tail", F.substr("_tail", F.length("path") + 1))
    out = out.withColumn("query", F.regexp_extract("_tail", r"^\?([^#]*)", 1)).withColumn("fragment", F.regexp_extract("_tail", "#(?s)(.*)", 1))
    out = out.withColumn("domain", F.substring_index("host", ".", -1)).withColumn("site", F.substring_index("host", ".", -2))
    return out.withColumn("fold", F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")).drop("_rest", "_host", "_tail")


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def decided(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (_row unique, host, path) with rule and verdict of the longest rule that fits, both null where none does.

    A row looks up each suffix of its host together with each beginning of its path for which there are rules of that many
    labels and characters; so it meets a rule by equality, and one of them at most. Of equal rules a block wins.
    """
    labels = F.size(F.split("host", r"\."))
    table = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shapes = table.select(labels.alias("l"), F.length("path").alias("c")).distinct().collect()  # pairs of small numbers
    own = F.split("host", r"\.")
    key = lambda l, c: F.when((F.size(own) >= l) & (F.length("path") >= c), F.struct(F.substring_index("host", ".", -l).alias("h"), F.substring("path", 1, c).alias("p")))
    keys = F.array_compact(F.array(*[key(r["l"], r["c"]) for r in shapes])) if shapes else F.array().cast("array<struct<h:string,p:string>>")
    probes = rows.select("_row", F.explode(keys).alias("k")).select("_row", F.col("k.h").alias("host"), F.col("k.p").alias("path"))
    rule = F.concat("host", "path")
    met = probes.join(table, ["host", "path"]).groupBy("_row").agg(F.max(F.struct(F.length(rule), F.length("host"), rule.alias("rule"), "verdict")).alias("m"))
    return rows.join(met, "_row", "left").select(*rows.columns, F.col("m.rule").alias("rule"), F.col("m.verdict").alias("verdict"))


def _count(x: pa.Array, *some: int) -> np.ndarray:
    """How many of the bytes each string has."""
    data, off = buffers(x)
    wanted = np.zeros(256, bool)
    wanted[list(some)] = True
    upto = np.concatenate([[0], np.cumsum(wanted[data])])
    return upto[off[1:]] - upto[off[:-1]]


def _entropy(x: pa.Array) -> np.ndarray:
    """Bits per byte of each string."""
    data, off = buffers(x)
    size = np.diff(off)
    cell = np.repeat(np.arange(len(size)) * 256, size) + data
    used, n = np.unique(cell, return_counts=True)
    share = n / size[used >> 8]
    return np.bincount(used >> 8, -share * np.log2(share), len(size))


def lexical(host: pa.Array, path: pa.Array, query: pa.Array, fragment: pa.Array, url: pa.Array) -> np.ndarray:
    """The features of each URL that its own text gives."""
    long = lambda x: np.diff(buffers(x)[1])
    digits = range(48, 58)
    slash, dot, dash, amp, percent = (ord(c) for c in "/.-&%")
    share = lambda x: _count(x, *digits) / np.maximum(long(x), 1)
    parameters = np.where(long(query) > 0, _count(query, amp) + 1, 0)
    last = np.where(long(path) > 0, _count(path, dot) / np.maximum(_count(path, slash), 1), 0)
    return np.stack([
        np.log1p(long(url)), long(host), np.log1p(long(path)), np.log1p(long(query)), _count(host, dot) + 1, _count(path, slash), share(host), share(path), _count(host, dash),
        _entropy(url), _entropy(host), _entropy(path), parameters, _count(url, percent), long(fragment) > 0, last,
    ], 1).astype(float)


def rates(n: np.ndarray, blocked: np.ndarray, rate: float) -> np.ndarray:
    """(log odds, weight) of the labelled URLs of a suffix, shrunk to the rate of all."""
    p = np.clip((blocked + PRIOR * rate) / (n + PRIOR), 1e-4, 1 - 1e-4)
    return np.stack([np.log(p / (1 - p)), np.log1p(n)], 1)


_ROW = ("host", "path", "query", "fragment", "url", "y", "fold", "n", "b", "dn", "db")


def _features(b: pa.RecordBatch, rate: float) -> np.ndarray:
    """Of a batch of _ROW columns; n, b, dn, db count labelled and blocked URLs of site and domain by fold."""
    text = [b.column(c) for c in _ROW[:5]]
    folds = lambda c: np.stack([x if x is not None else [0] * FOLDS for x in b.column(c).to_pylist()]).astype(float)
    y, fold = b.column("y").is_valid().to_numpy(False), b.column("fold").to_numpy(False)
    own = np.zeros((b.num_rows, FOLDS), bool)
    own[np.arange(b.num_rows)[y], fold[y]] = True
    seen = lambda c: np.where(own, 0, folds(c)).sum(1)
    return np.hstack([lexical(*text), rates(seen("n"), seen("b"), rate), rates(seen("dn"), seen("db"), rate)])


def _suffixes(labelled: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, n, b, dn, db) of every site of `sites` (site, domain): counts by fold of its labelled and blocked URLs, and of its domain's."""
    count = lambda some: F.array(*[F.coalesce(F.sum(F.when((F.col("fold") == k) & some, 1)), F.lit(0)) for k in range(FOLDS)])
    total = lambda c: F.array(*[F.sum(F.col(c)[k]) for k in range(FOLDS)])
    by = labelled.groupBy("site", "domain").agg(count(F.lit(True)).alias("n"), count(F.col("y") == 1).alias("b"))
    top = by.groupBy("domain").agg(total("n").alias("dn"), total("b").alias("db"))
    return sites.join(by.drop("domain"), "site", "left").join(top, "domain", "left").select("site", "n", "b", "dn", "db")


def fit(labelled: DataFrame, suffixes: DataFrame, rate: float, rows: int) -> Trees | None:
    """Trees on the labelled URLs of lowest hash, `rows` at most; copies of one count once, blocked if any is."""
    same = [F.first(c).alias(c) for c in ("host", "path", "query", "fragment", "fold", "site")]  # they follow from the URL
    sample = labelled.groupBy("url").agg(F.max("y").alias("y"), *same).orderBy(F.xxhash64("url"), "url").limit(rows)
    sample = sample.join(suffixes, "site").select(*_ROW).toArrow().sort_by("url")
    if not sample.num_rows:
        return None
    x = np.vstack([_features(b, rate) for b in sample.to_batches() if b.num_rows])
    y = sample["y"].to_numpy().astype(float)
    return fit_trees(x, y) if y.min() < y.max() else None


def url_filter(
    pages: DataFrame, rules: DataFrame, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", train_rows: int = TRAIN_ROWS, threshold: float = 0.5
) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, score (the trees' probability of a block; null where a rule decides).

    rules: (verdict, host, path); verdict is allow or block. labels: (url, blocked 0 or 1), further labelled URLs. A null URL
    or one without `://` has empty host and path and fits no rule. Without labelled URLs of both kinds the score is the
    share of blocked ones, or 0. Repeated rows are judged alike, each on its own; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    spark, home = pages.sparkSession, shared_dir(pages.sparkSession, "urls")
    slim = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.monotonically_increasing_id().alias("_row"))
    numbered = stored(located(slim, "url"), f"{home}/urls")  # so that a row's number is the same wherever it is read
    rows = stored(decided(numbered, rules), f"{home}/rows")
    drop(spark, f"{home}/urls")
    y = F.when(F.col("verdict") == "block", 1).when(F.col("verdict") == "allow", 0)
    rows = rows.withColumn("y", y)
    labelled = rows.where("y IS NOT NULL").drop("page_id", "_row", "rule", "verdict")
    if labels is not None:
        more = labels.select(F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("blocked").cast("int").alias("y")).where("y IN (0, 1)")
        labelled = labelled.unionByName(located(more, "url"))
    n, blocked = labelled.agg(F.count(F.lit(1)), F.sum("y")).first()
    rate = blocked / n if n else 0.0
    counts = rows.groupBy("site", "domain").agg(F.count(F.lit(1)).alias("n"))
    sites = counts.select("site", "domain").union(labelled.select("site", "domain")).distinct()
    suffixes = stored(_suffixes(labelled, sites), f"{home}/suffixes")
    trees = fit(labelled, suffixes, rate, train_rows) if 0 < rate < 1 else None
    shipped = spark.sparkContext.broadcast((trees, rate))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, base = shipped.value
        for b in batches:
            score = 1 / (1 + np.exp(-t.margin(_features(b, base)))) if t is not None and b.num_rows else np.full(b.num_rows, base)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("page_id", "host", "path")] + [pa.array(score, pa.float64())], ["page_id", "host", "path", "score"])

    ruled = rows.where("verdict IS NOT NULL").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"))
    rest = stored(rows.where("verdict IS NULL").select("page_id", "host", "path", "query", "fragment", "url", "y", "fold", "site"), f"{home}/rest")
    free = left_join_hot(rest, suffixes, "site", rest.count())
    kind = dict(rows.dtypes)["page_id"]
    judged = free.select("page_id", *_ROW).mapInArrow(judge, f"page_id {kind}, host string, path string, score double")
    verdict = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return ruled.unionByName(judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"), "score"))
