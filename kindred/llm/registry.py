"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import bpe, chat, embedding_dedup, exact_dedup, lexical_search, line_dedup, ngram_join, packing, quality, resampling, substring_dedup, toxicity, url_filter
from kindred.llm.shared import ship


def _docs(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded_digests(_docs(spark, d), public_tokenizers.path("byte_bpe_50k.json"))


def op2_chat(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    out = chat.format_chats(spark.read.parquet(f"{d}/conversations.parquet"))
    return out.withColumn("rendered_sha256", F.sha2("rendered", 256))


def op3_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.ngram_join(_docs(spark, d))


def op4_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, d), public_tokenizers.path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def op6_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_docs(spark, d).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return embedding_dedup.embedding_dedup(spark.read.parquet(f"{d}/embeddings.parquet"))


def op8_quality(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang")
    return quality.quality(_docs(spark, d), spark.read.parquet(f"{d}/labels.parquet"), F.col("source"), path)


def op9_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = line_dedup.line_dedup(_docs(spark, d))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, d))


def op11_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical_search.search(_docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


#: The rules of op12_url_filter: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op12_url_filter(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return url_filter.url_filter(spark.read.parquet(f"{d}/pages.parquet"), url_filter.rule_table(spark, URL_RULES))


def op13_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resampling.resample(_docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_bpe, op2_chat, op3_ngram_join, op4_packing, op5_toxicity, op6_substring_dedup, op7_embedding_dedup, op8_quality, op9_line_dedup, op10_exact_dedup, op11_lexical_search, op12_url_filter, op13_resampling)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": _NGRAM, "op6_substring_dedup": _SUBSTRING, "op7_embedding_dedup": _VECTORS, "op10_exact_dedup": _EXACT, "op11_lexical_search": _SEARCH, "op13_resampling": _RESAMPLING}


_EXACT = r"""WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) = 1 AS kept, sha256(norm) AS text_sha256 FROM n"""


_WORDS = r"""w AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM
  (SELECT doc_id, unnest(regexp_split_to_array({text}, '[\x20\x09-\x0D]+')) AS x, generate_subscripts(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), 1) AS i FROM documents) WHERE x <> '')"""

_NGRAM = (
    "WITH RECURSIVE "
    + _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
 g AS (SELECT doc_id, string_agg(x, ' ') OVER f AS k, count(*) OVER f AS c, count(*) OVER (PARTITION BY doc_id) AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
 s AS (SELECT DISTINCT doc_id, k FROM g WHERE c = 3 UNION SELECT doc_id, string_agg(x, ' ' ORDER BY pos) FROM w GROUP BY doc_id HAVING count(*) < 3),
 z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM met JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id, (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id"""
)

_SUBSTRING = (
    "WITH "
    + _WORDS.format(text="coalesce(text, '')")
    + """,
 g AS (SELECT doc_id, pos, string_agg(x, ' ') OVER f AS k, count(*) OVER f AS c FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
 rep AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM g WHERE c = 35) WHERE n > 1),
 gone AS (SELECT DISTINCT doc_id, pos + unnest(range(0, 35)) AS pos FROM rep),
 kept AS (SELECT w.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed, string_agg(x, ' ' ORDER BY w.pos) FILTER (gone.pos IS NULL) AS t FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.pos = w.pos GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id"""
)

_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
 c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""

_ASCII = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"""unnest(regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x""".format(text=_ASCII.format(text="text"))

_SEARCH = f"""WITH t AS (SELECT doc_id, {_TERMS} FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_TERMS} FROM benchmark WHERE text IS NOT NULL),
 z AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM z),
 f AS (SELECT doc_id, x, count(*) AS tf FROM t WHERE x IN (SELECT x FROM i) GROUP BY ALL),
 w AS (SELECT x, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY x, docs),
 q AS (SELECT item_id, x, count(*) AS r FROM i GROUP BY ALL),
 s AS (SELECT item_id, f.doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))))::BIGINT AS score
   FROM q JOIN f USING (x) JOIN w USING (x) JOIN z ON z.doc_id = f.doc_id, c GROUP BY item_id, f.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""

#: CRC-32 in SQL: its byte table by the rule of the polynomial, then a byte at a time.
_CRC = """crc AS (SELECT list(list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
 words AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM t UNION SELECT x FROM i)),
 bucket AS (SELECT x, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(h) // 2), lambda k: (instr('0123456789ABCDEF', h[2 * k + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * k + 2]) - 1)),
   lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS k FROM words, crc)"""

_RESAMPLING = f"""WITH t AS (SELECT doc_id, {_TERMS} FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_TERMS} FROM benchmark WHERE text IS NOT NULL), {_CRC},
 s AS (SELECT k, count(*) AS s FROM t JOIN bucket USING (x) GROUP BY k), g AS (SELECT k, count(*) AS t FROM i JOIN bucket USING (x) GROUP BY k),
 total AS (SELECT (SELECT sum(s) FROM s) AS s, (SELECT sum(t) FROM g) AS t),
 gain AS (SELECT k, floor(1000 * ln(((coalesce(g.t, 0) + 1)::DOUBLE * (total.s + 10000)::DOUBLE) / ((s.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN g USING (k), total),
 d AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM t JOIN bucket USING (x) JOIN gain USING (k) GROUP BY doc_id),
 e AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM documents LEFT JOIN d USING (doc_id)),
 f AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM f WHERE n_features >= 20)
SELECT f.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM f LEFT JOIN r USING (doc_id)"""
