"""Registered queries over the reference operators and their DuckDB oracles."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import annotate, chunk, lexicons, rewrite, text
from tessera.jobs import index as indexing
from tessera.operators import bm25, cluster, context, dedup, embed, fuse, history, meta, models, order, postings, rerank, search, smart, vector
from tessera.session import shared_dir, ship, write_table
from tessera.sources import files, tables
from tessera.streaming import events as event_stream
from tessera.streaming import ingest
from tessera.streaming import messages as message_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if oracle is not None:
            ORACLES[query.__name__] = oracle
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pieces of SQL that several oracles share

CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
TERMS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
TOKENS = "CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::BIGINT"
SENTENCES = "list_filter(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
LINES = "CASE WHEN length(text) > 0 THEN string_split(text, chr(10)) ELSE []::VARCHAR[] END"


def packed_sql(pieces: str) -> str:
    """SQL of greedy packing, of a table ``pieces(doc_id, s, line, most, overlap)``: ``packed(doc_id, chunk_index, first, "end", tokens, piece)``."""
    cost = TOKENS.replace("text", "x || CASE WHEN line THEN chr(10) ELSE '' END")
    return f"""
given AS ({pieces}),
priced AS (SELECT *, list_transform(s, lambda x: {cost}) AS cost FROM given WHERE len(s) > 0),
summed AS (SELECT *, list_transform(range(len(s) + 1), lambda i: coalesce(list_sum(cost[1:i]), 0)::BIGINT) AS upto FROM priced),
walk AS (
  SELECT doc_id, 0 AS i, 0 AS first, 0::BIGINT AS tokens, NULL::INT AS closed, NULL::BIGINT AS closed_tokens FROM summed
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN shut THEN back ELSE first END, CASE WHEN shut THEN upto[i + 1] - upto[back + 1] + own ELSE tokens + own END,
    CASE WHEN shut THEN first END, CASE WHEN shut THEN tokens END
  FROM (SELECT w.*, s.upto, s.cost[i + 1] AS own, tokens + s.cost[i + 1] > s.most AND i > first AS shut,
          list_filter(range(first, i + 1), lambda j: s.upto[i + 1] - s.upto[j + 1] <= s.overlap)[1]::INT AS back
        FROM walk w JOIN summed s USING (doc_id) WHERE i < len(s.s))),
ends AS (
  SELECT doc_id, closed AS first, i - 1 AS "end", closed_tokens AS tokens FROM walk WHERE closed IS NOT NULL
  UNION ALL SELECT w.doc_id, first, i, tokens FROM walk w JOIN summed s ON s.doc_id = w.doc_id AND i = len(s.s)),
packed AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY e."end") - 1)::INT AS chunk_index, first, e."end", tokens,
    CASE WHEN line THEN array_to_string(s[first + 1:e."end"], chr(10)) ELSE array_to_string(s[first + 1:e."end"], ' ') END AS piece FROM ends e JOIN summed USING (doc_id))"""


CHUNKS = f"""
cleaned AS (SELECT doc_id, source, {CLEAN} AS t FROM documents),
sized AS (SELECT *, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 1200 THEN 1 ELSE ceil((length(t) - 1200) / 1000.0)::INT + 1 END AS k FROM cleaned),
chunks AS (SELECT doc_id, source, i::INT AS chunk_index, substr(t, i * 1000 + 1, 1200) AS chunk FROM (SELECT *, unnest(range(k)) AS i FROM sized))"""
BM25 = f"""
doc_terms AS (SELECT doc_id AS id, {TERMS} AS t FROM documents),
totals AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM doc_terms),
tfs AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM doc_terms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
hits AS (
  SELECT query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE
         / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score
  FROM asked JOIN tfs USING (term) JOIN dfs USING (term), totals GROUP BY query_id, id),
keyword_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM hits)"""
QUERY_VECTORS = "qv AS (SELECT item_id AS query_id, text AS query, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id)"
COSINE = "list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v)))"
KNN = f"""
{QUERY_VECTORS},
vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
vector_ranked AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank
  FROM (SELECT query_id, id, round({COSINE}, 6) AS score FROM qv, vecs))"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries, with the vector of the same number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return items.join(vectors, "query_id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.posexplode(chunk.windows(F.col("text"), 1200, 200)).alias("chunk_index", "chunk"))


# --- chunking and text


@registered(f"WITH {CHUNKS} SELECT doc_id, chunk_index, chunk FROM chunks")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).drop("source")


@registered(f"WITH {CHUNKS} SELECT source, count(*)::BIGINT AS chunks, sum(length(chunk))::BIGINT AS chars FROM chunks GROUP BY source")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


@registered(
    f"""
WITH typed AS (
  SELECT doc_id, {CLEAN} AS t, CASE right(source, 1) WHEN '0' THEN 'meeting' WHEN '1' THEN 'prd' WHEN '2' THEN 'technical' WHEN '3' THEN 'wiki' ELSE 'general' END AS ty,
         CASE lang WHEN 'de' THEN 'mixed' WHEN 'fr' THEN 'korean' ELSE 'english' END AS la FROM documents),
base AS (SELECT *, CASE ty WHEN 'meeting' THEN 800 WHEN 'prd' THEN 1500 WHEN 'technical' THEN 1800 ELSE 1200 END AS s,
         CASE ty WHEN 'meeting' THEN 100 WHEN 'prd' THEN 300 WHEN 'technical' THEN 400 WHEN 'wiki' THEN 250 ELSE 200 END AS o FROM typed),
params AS (SELECT doc_id, t, ty, CASE la WHEN 'korean' THEN trunc(s * 0.7::DOUBLE)::INT WHEN 'mixed' THEN trunc(s * 0.85::DOUBLE)::INT ELSE s END AS size,
           CASE la WHEN 'korean' THEN trunc(o * 0.8::DOUBLE)::INT ELSE o END AS overlap FROM base),
sized AS (SELECT *, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= size THEN 1 ELSE ceil((length(t) - size) / (size - overlap)::DOUBLE)::INT + 1 END AS k FROM params)
SELECT doc_id, ty AS doc_type, size, overlap, i::INT AS chunk_index, md5(substr(t, (i * (size - overlap) + 1)::BIGINT, size)) AS chunk_hash
FROM (SELECT *, unnest(range(k)) AS i FROM sized)"""
)
def chunk_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.right("source", F.lit(1))
    kind = F.when(last == "0", "meeting").when(last == "1", "prd").when(last == "2", "technical").when(last == "3", "wiki").otherwise("general")
    language = F.when(F.col("lang") == "de", "mixed").when(F.col("lang") == "fr", "korean").otherwise("english")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", kind.alias("doc_type"), language.alias("language"))
    size, overlap = chunk.chunk_params(F.col("doc_type"), F.col("language"))
    cut = docs.withColumn("size", size).withColumn("overlap", overlap)
    pieces = cut.select("doc_id", "doc_type", "size", "overlap", F.posexplode(chunk.windows(F.col("text"), F.col("size"), F.col("overlap"))).alias("chunk_index", "chunk"))
    return pieces.withColumn("chunk_hash", text.content_hash(F.col("chunk"))).drop("chunk")


@registered(
    """
WITH words AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT doc_id, text, w, len(w) AS n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 200 THEN [0] ELSE
           range(0, (ceil((len(w) - 200) / 170.0)::BIGINT * 170 + 1)::BIGINT, 170) END) AS s FROM words)
SELECT doc_id, s::INT AS start, least(s + 200, n)::INT AS "end", md5(CASE WHEN n <= 200 THEN text ELSE array_to_string(list_slice(w, s + 1, s + 200), ' ') END) AS chunk_hash
FROM starts WHERE n <= 200 OR least(s + 200, n) - s >= 50 OR s + 170 >= n"""
)
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunk.token_windows(F.col("text"), 200, 30, 50)).alias("c"))
    return docs.select("doc_id", "c.start", "c.end", text.content_hash(F.col("c.text")).alias("chunk_hash"))


@registered(
    f"""WITH RECURSIVE {packed_sql(f"SELECT doc_id, {SENTENCES} AS s, false AS line, 256 AS most, 40 AS overlap FROM documents")}
SELECT doc_id, chunk_index, first, "end", tokens, md5(piece) AS chunk_hash FROM packed"""
)
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.sentence_chunks(F.col("text"), 256, 40)).alias("chunk_index", "c"))
    return docs.select("doc_id", "chunk_index", "c.first", "c.end", "c.tokens", text.content_hash(F.col("c.text")).alias("chunk_hash"))


@registered(
    f"""WITH RECURSIVE {packed_sql(f"SELECT doc_id, {LINES} AS s, true AS line, 256 AS most, 60 AS overlap FROM documents")}
SELECT doc_id, chunk_index, first AS start_line, "end" AS end_line, tokens, md5(piece) AS chunk_hash FROM packed"""
)
def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.code_chunks(F.col("text"), 256, 60)).alias("chunk_index", "c"))
    return docs.select("doc_id", "chunk_index", F.col("c.first").alias("start_line"), F.col("c.end").alias("end_line"), "c.tokens", text.content_hash(F.col("c.text")).alias("chunk_hash"))


TYPED_PIECES = f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {LINES} ELSE {SENTENCES} END AS s, doc_id % 4 = 0 AS line, 512 AS most,
  CASE doc_id % 4 WHEN 0 THEN 100 WHEN 1 THEN 100 WHEN 2 THEN 75 ELSE 50 END AS overlap FROM documents"""


@registered(f"""WITH RECURSIVE {packed_sql(TYPED_PIECES)} SELECT doc_id, chunk_index, first, "end", tokens, md5(piece) AS chunk_hash FROM packed""")
def chunk_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code by lines, all else by sentences, with the overlap of the type."""
    kind = F.when(F.col("doc_id") % 4 == 0, "code").when(F.col("doc_id") % 4 == 1, "meeting").when(F.col("doc_id") % 4 == 2, "technical").otherwise("wiki")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.adaptive_chunks(F.col("text"), kind)).alias("chunk_index", "c"))
    return docs.select("doc_id", "chunk_index", "c.first", "c.end", "c.tokens", text.content_hash(F.col("c.text")).alias("chunk_hash"))


@registered(
    """
WITH heads AS (SELECT doc_id, substr(coalesce(text, ''), 1, 500) AS h FROM documents),
counted AS (
  SELECT doc_id, length(regexp_replace(h, '[^\\p{Han}]', '', 'g')) AS han, length(regexp_replace(h, '[^\\p{Hiragana}\\p{Katakana}]', '', 'g')) AS kana,
    length(regexp_replace(h, '[^\\p{Hangul}]', '', 'g')) AS hangul, length(regexp_replace(h, '[^\\p{Latin}]', '', 'g')) AS latin FROM heads)
SELECT doc_id, CASE WHEN han + kana + hangul + latin = 0 THEN 'unknown' WHEN (han + kana + hangul) * 5 > latin AND latin * 5 > han + kana + hangul THEN 'mixed'
  WHEN han + kana + hangul <= latin THEN 'english' WHEN kana > 0 THEN 'japanese' WHEN hangul > han THEN 'korean' ELSE 'chinese' END AS language FROM counted"""
)
def document_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", annotate.document_language(F.col("text")).alias("language"))


@registered(
    """
WITH parts AS (
  SELECT doc_id, pos - 1 AS pos, part FROM (SELECT doc_id, unnest([substr(text, 1, 700), substr(text, 701, 500), substr(text, 1201)]) AS part, unnest([1, 2, 3]) AS pos FROM documents)),
cleaned AS (SELECT doc_id, pos, part, trim(regexp_replace(part, '\\s+', ' ', 'g')) AS t, pos = 1 AND length(part) <= 600 AS whole FROM parts),
sized AS (SELECT *, CASE WHEN whole THEN 1 WHEN length(t) = 0 THEN 0 WHEN length(t) <= 400 THEN 1 ELSE ceil((length(t) - 400) / 350.0)::INT + 1 END AS k FROM cleaned),
cut AS (SELECT doc_id, pos, i, CASE WHEN whole THEN '```' || part || '```' ELSE substr(t, (i * 350 + 1)::BIGINT, 400) END AS piece FROM (SELECT *, unnest(range(k)) AS i FROM sized))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) - 1)::INT AS chunk_index, md5(piece) AS chunk_hash FROM cut"""
)
def smart_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose characters 701 to 1200 are made a fenced block."""
    marked = F.concat(F.substring("text", 1, 700), F.lit("```"), F.substring("text", 701, 500), F.lit("```"), F.expr("substring(text, 1201)"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.fenced(marked, 400, 50)).alias("chunk_index", "chunk"))
    return docs.select("doc_id", "chunk_index", text.content_hash(F.col("chunk")).alias("chunk_hash"))


@registered(
    f"SELECT doc_id, {TOKENS} AS tokens, md5(text) AS content_hash, sha256(text) AS secure_hash FROM documents"
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.count_tokens(t).alias("tokens"), text.content_hash(t).alias("content_hash"), text.secure_hash(t).alias("secure_hash"))


@registered(
    r"""
WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10), 'g') AS t FROM pages),
shown AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS t FROM bare)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda l: regexp_replace(l, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), lambda l: l <> ''), chr(10)) AS text FROM shown"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@registered(
    """
SELECT o_orderkey, concat_ws(', ', 'o_custkey: ' || o_custkey::VARCHAR, 'o_orderstatus: ' || o_orderstatus, 'o_orderpriority: ' || o_orderpriority) AS text FROM orders"""
)
def csv_row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", files.rows_as_text(orders, ["o_custkey", "o_orderstatus", "o_orderpriority"]).alias("text"))


@registered(
    """
WITH cells AS (SELECT c_custkey, [['name', '', 'segment'], [c_name, c_mktsegment, ''], ['', NULL, c_name], ['a', 'b', 'c'], ['left', 'out', '']] AS data FROM customer),
lines AS (SELECT c_custkey, list_transform(data, lambda r: array_to_string(list_filter(r, lambda c: c IS NOT NULL AND c <> ''), ' | ')) AS l FROM cells)
SELECT c_custkey, chr(10) || '[Table on page ' || (c_custkey % 9)::VARCHAR || ']' || chr(10) || 'Headers: ' || l[1] || chr(10) || array_to_string(l[2:4], chr(10)) AS text FROM lines"""
)
def pdf_table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as a document reader yields them, made of customers."""
    row = lambda *cells: F.array(*(F.lit(c).cast("string") if c is None or isinstance(c, str) else c for c in cells))
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    data = F.array(row("name", "", "segment"), row(name, segment, ""), row("", None, name), row("a", "b", "c"), row("left", "out", ""))
    return table(spark, sf_dir, "customer").select("c_custkey", files.table_text(F.col("c_custkey") % 9, data).alias("text"))


# --- annotation


def _two_thousand(content: bytes) -> list[dict]:
    """Stands for a document parser: pages of 2,000 characters, with the first four words as a table and an image as wide as the page is long."""
    told = content.decode("utf-8")
    pages = [told[i : i + 2000] for i in range(0, len(told), 2000)]
    words = [[w for w in p.split(" ") if w][:4] for p in pages]
    return [{"text": p, "tables": [[w[:2], w[2:]]] if len(w) == 4 else [], "images": [{"width": len(p), "height": 10}]} for p, w in zip(pages, words, strict=True)]


@registered(
    """
WITH pages AS (SELECT doc_id, i + 1 AS page, substr(text, i * 2000 + 1, 2000) AS t FROM (SELECT doc_id, text, unnest(range(ceil(length(text) / 2000.0)::BIGINT)) AS i FROM documents)),
cut AS (SELECT *, list_filter(string_split(t, ' '), lambda w: w <> '')[1:4] AS w FROM pages),
parts AS (SELECT doc_id, 1 AS kind, 0 AS page, string_agg('[Page ' || page || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY page) AS part FROM cut GROUP BY doc_id
  UNION ALL SELECT doc_id, 2, page, chr(10) || '[Table on page ' || page || ']' || chr(10) || 'Headers: ' || w[1] || ' | ' || w[2] || chr(10) || w[3] || ' | ' || w[4] FROM cut WHERE len(w) = 4
  UNION ALL SELECT doc_id, 3, page, chr(10) || '[Image on page ' || page || ': ' || length(t) || 'x10 pixels]' FROM cut)
SELECT doc_id::VARCHAR AS source, md5(string_agg(part, chr(10) ORDER BY kind, page)) AS text_hash FROM parts GROUP BY doc_id"""
)
def paged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of pages, through a parser handed in."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.encode("text", "UTF-8").alias("content"))
    return files.pages_text(files.pages_of(docs, _two_thousand)).select("source", F.md5("text").alias("text_hash"))


@registered(
    """
WITH named AS (SELECT doc_id, text, lower(CASE doc_id % 5 WHEN 0 THEN 'Team-Minutes-' WHEN 1 THEN 'api_SPEC_' WHEN 2 THEN 'How-To ' WHEN 3 THEN 'retro spec ' ELSE 'notes ' END || source) AS f FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(f, 'meeting|minutes|standup|retro|retrospective') THEN 'meeting' WHEN regexp_matches(f, 'prd|requirement|spec|specification') THEN 'prd'
       WHEN regexp_matches(f, 'wiki|guide|manual|howto|how-to') THEN 'wiki' WHEN contains(text, '```') THEN 'technical' ELSE 'general' END AS doc_type FROM named"""
)
def doc_type_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under made names, so that each rule applies to some."""
    mod = F.col("doc_id") % 5
    lead = F.when(mod == 0, "Team-Minutes-").when(mod == 1, "api_SPEC_").when(mod == 2, "How-To ").when(mod == 3, "retro spec ").otherwise("notes ")
    return table(spark, sf_dir, "documents").select("doc_id", annotate.document_type(F.col("text"), F.concat(lead, "source")).alias("doc_type"))


@registered(
    r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(substr(text, 1, 2000), '\s+'), lambda x: length(x) > 3 AND regexp_matches(x, '^\p{Lu}')) AS k FROM documents)
SELECT doc_id, array_to_string(list_transform(k[1:10], lambda x: lower(x)), ',') AS keywords FROM w"""
)
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(annotate.keywords(F.col("text"), 10), ",").alias("keywords"))


@registered(
    """
SELECT conv_id, turn, regexp_matches(lower(text), 'image|chart|graph|diagram|figure|picture|visual|table|plot|illustration') AS visual,
  CASE WHEN lower(trim(text)) IN ('files?', 'documents?', 'files', 'documents', 'index?', 'index') THEN 'list'
       WHEN regexp_matches(lower(text), 'what.*(indexed|have|you.*got)|(show|list|available|indexed|tell me|want.*see|display).*(file|document)|(what|which) (file|document)|tell me.*index') THEN
         CASE WHEN regexp_matches(lower(text), 'how many|number|count|total') THEN 'count' WHEN regexp_matches(lower(text), 'statistic|summary|overview') THEN 'stats' ELSE 'list' END
       WHEN regexp_matches(lower(text), 'how many|number of|count|total') THEN 'count'
       WHEN regexp_matches(lower(text), 'what documents|which documents|list all|show all|what files|which files|indexed documents|available documents') THEN 'list'
       WHEN regexp_matches(lower(text), 'statistics|summary|overview|index info') THEN 'stats' END AS meta_type
FROM conversations"""
)
def message_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", annotate.visual_query(t).alias("visual"), annotate.meta_query(t).alias("meta_type"))


ASKED = """asked AS (
  SELECT doc_id, trim(CASE doc_id % 7 WHEN 0 THEN 'what is the latest API Spec of ' WHEN 1 THEN 'show files about ' WHEN 2 THEN 'fix the databse error in ' WHEN 3 THEN 'Meeting notes on "' || source || '" and '
    WHEN 4 THEN 'how to deploy ' WHEN 5 THEN 'running Tests for the exact cache ' ELSE 'find ' END || array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:3], ' ')) AS query FROM documents)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries made of a phrase and each document's first three words."""
    mod = F.col("doc_id") % 7
    notes = F.concat(F.lit('Meeting notes on "'), F.col("source"), F.lit('" and '))
    lead = (
        F.when(mod == 0, "what is the latest API Spec of ").when(mod == 1, "show files about ").when(mod == 2, "fix the databse error in ").when(mod == 3, notes)
        .when(mod == 4, "how to deploy ").when(mod == 5, "running Tests for the exact cache ").otherwise("find ")
    )
    head = F.array_join(F.slice(text.split_words(F.col("text")), 1, 3), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.concat(lead, head)).alias("query"))


ANALYSED = """hinted AS (SELECT *, lower(query) AS l, CASE WHEN regexp_matches(lower(query), 'meeting|standup|retro|retrospective|minutes') THEN 'meeting' WHEN regexp_matches(lower(query), 'prd|product requirement|specification|spec') THEN 'prd'
  WHEN regexp_matches(lower(query), 'technical|architecture|implementation|code|api') THEN 'technical' WHEN regexp_matches(lower(query), 'wiki|documentation|guide|manual') THEN 'wiki' END AS hint FROM asked),
words AS (SELECT *, list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '') AS w FROM hinted),
found AS (SELECT *, list_concat(list_transform(list_filter(w, lambda x: length(x) > 3 AND regexp_matches(x, '^\\p{Lu}'))[1:5], lambda x: lower(x)),
  CASE hint WHEN 'meeting' THEN ['meeting', 'agenda', 'discussion'] WHEN 'prd' THEN ['requirement', 'product', 'feature'] ELSE []::VARCHAR[] END) AS k FROM words)"""


@registered(
    f"""
WITH {ASKED},
{ANALYSED}
SELECT doc_id, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i)[1:8], ',') AS keywords,
  CASE WHEN len(w) > 5 OR regexp_matches(l, 'specific|exact|particular') THEN 'focused' ELSE 'broad' END AS search_scope, hint AS doc_type_hint,
  CASE WHEN regexp_matches(l, 'last|latest|recent|newest') THEN 'recent' END AS temporal_hint FROM found"""
)
def query_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _asked(spark, sf_dir).select("doc_id", annotate.analyze_query(F.col("query")).alias("a")).select("doc_id", "a.*")
    return done.withColumn("keywords", F.array_join("keywords", ","))


# --- query rewriting


def _values(name: str, entries: dict[str, list[str]]) -> str:
    rows = ", ".join(f"('{word}', '{other}')" for word, others in entries.items() for other in others)
    return f"{name}(word, other) AS (VALUES {rows})"


_FORMS = [("synonyms_of", lexicons.SYNONYMS), ("full_of", {k: [v] for k, v in lexicons.ABBREVIATIONS.items()})]
EXPANDED = f"""
{", ".join(_values(n, e) for n, e in _FORMS)},
{_values("forms", {b: [b, *f] for b, f in lexicons.VARIATIONS.items()})},
short_of AS (SELECT DISTINCT unnest(string_split(other, ' ')) AS word, word AS other FROM full_of),
variants_of AS (SELECT DISTINCT a.other AS word, b.other FROM forms a JOIN forms b USING (word) WHERE a.other <> b.other AND b.other <> b.word),
words AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '')) AS word FROM asked),
syn AS (SELECT doc_id, list_sort(list(DISTINCT other)) AS l FROM words JOIN synonyms_of USING (word) GROUP BY doc_id),
rel AS (SELECT doc_id, list_sort(list(DISTINCT other)) AS l FROM words JOIN (FROM full_of UNION ALL FROM short_of) USING (word) GROUP BY doc_id),
var AS (SELECT doc_id, list_sort(list(DISTINCT other)) AS l FROM words JOIN variants_of USING (word) GROUP BY doc_id),
expanded AS (
  SELECT asked.doc_id, query, coalesce(syn.l, []::VARCHAR[]) AS synonyms, coalesce(rel.l, []::VARCHAR[]) AS related, coalesce(var.l, []::VARCHAR[]) AS variations,
         list_sort(list_distinct(list_concat(coalesce(syn.l, []::VARCHAR[]), coalesce(rel.l, []::VARCHAR[]), coalesce(var.l, []::VARCHAR[])))) AS every
  FROM asked LEFT JOIN syn USING (doc_id) LEFT JOIN rel USING (doc_id) LEFT JOIN var USING (doc_id))"""


@registered(
    f"""
WITH {ASKED}, {EXPANDED}
SELECT doc_id, array_to_string(synonyms, ',') AS synonyms, array_to_string(related, ',') AS related_terms, array_to_string(variations, ',') AS variations,
  array_to_string(list_transform(list_concat([query], every[1:5]), lambda t: CASE WHEN contains(t, ' ') THEN '"' || t || '"' ELSE t END), ' OR ') AS combined_query
FROM expanded"""
)
def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _asked(spark, sf_dir).select("doc_id", rewrite.expand_query(F.col("query")).alias("e"))
    lists = [F.array_join(f"e.{c}", ",").alias(c) for c in ("synonyms", "related_terms", "variations")]
    return done.select("doc_id", *lists, "e.combined_query")


FIXED = "query"
for _typo, _right in lexicons.TYPOS.items():
    FIXED = f"regexp_replace({FIXED}, '{_typo}', '{_right}', 'gi')"


@registered(
    f"WITH {ASKED} SELECT doc_id, CASE WHEN regexp_matches(lower(query), '{'|'.join(lexicons.TYPOS)}') THEN {FIXED} END AS corrected FROM asked"
)
def spell_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("doc_id", rewrite.correct_spelling(F.col("query")).alias("corrected"))


PHRASES = r"""
pw AS (SELECT doc_id, query, regexp_extract_all(query, '"([^"]*)"', 1) AS quoted, list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: w <> '') AS w FROM asked),
phrases AS (SELECT doc_id, query, list_concat(quoted, flatten(list_transform(range(1, len(w)), lambda i: list_filter([
  CASE WHEN length(w[i]) > 2 AND length(w[i + 1]) > 2 THEN w[i] || ' ' || w[i + 1] END,
  CASE WHEN i + 2 <= len(w) AND length(w[i]) > 2 AND length(w[i + 2]) > 2 THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END], lambda x: x IS NOT NULL)))) AS p FROM pw)"""


@registered(f"WITH {ASKED}, {PHRASES} SELECT doc_id, array_to_string(p, ';') AS phrases FROM phrases")
def key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("doc_id", F.array_join(rewrite.key_phrases(F.col("query")), ";").alias("phrases"))


VARIED = r"""
forms_of AS (SELECT doc_id, query, list_filter([query,
  CASE WHEN query NOT LIKE '%?' THEN query || '?' END, CASE WHEN query NOT LIKE '%?' THEN 'What is ' || query || '?' END,
  CASE WHEN query NOT LIKE '%?' THEN 'How to ' || query || '?' END, CASE WHEN query NOT LIKE '%?' THEN 'Where is ' || query || '?' END,
  CASE WHEN regexp_matches(query, '^(what|how|where|when|why|who)') THEN regexp_replace(lower(query), '^(what|how|where|when|why|who)\s+(is|are|to|does|do)\s+', '') END,
  CASE WHEN NOT regexp_matches(lower(query), '^(find|search|get|show)') THEN 'find ' || query END,
  CASE WHEN NOT regexp_matches(lower(query), '^(find|search|get|show)') THEN 'search for ' || query END], lambda x: x IS NOT NULL) AS f FROM asked),
varied AS (SELECT doc_id, query, list_filter(f, lambda x, i: list_position(f, x) = i)[1:5] AS v FROM forms_of)"""


@registered(f"WITH {ASKED}, {VARIED} SELECT doc_id, array_to_string(v, ';') AS variations FROM varied")
def query_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("doc_id", F.array_join(rewrite.query_variations(F.col("query")), ";").alias("variations"))


@registered(
    f"""
WITH {ASKED}, {EXPANDED}, {VARIED},
many AS (SELECT e.doc_id, list_concat([e.query], CASE WHEN len(every) > 0 THEN [e.query || ' ' || array_to_string(every[1:2], ' ')] ELSE []::VARCHAR[] END, v, [e.query, e.query, e.query])[1:3] AS q
  FROM expanded e JOIN varied USING (doc_id))
SELECT doc_id, n::INT AS n, q[n + 1] AS query FROM many, range(3) r(n)"""
)
def multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("doc_id", F.posexplode(rewrite.multi_query(F.col("query"), 3)).alias("n", "query"))


@registered(
    f"""
WITH {ASKED}, {EXPANDED}, {PHRASES}
SELECT e.doc_id, CASE e.doc_id % 3 WHEN 0 THEN CASE WHEN len(p) > 0 THEN array_to_string(list_transform(p[1:3], lambda x: '"' || x || '"'), ' AND ') ELSE e.query END
  WHEN 1 THEN e.query || ' ' || array_to_string(synonyms[1:3], ' ')
  ELSE array_to_string(list_transform(list_concat([e.query], every[1:5]), lambda t: CASE WHEN contains(t, ' ') THEN '"' || t || '"' ELSE t END), ' OR ') END AS optimised
FROM expanded e JOIN phrases USING (doc_id)"""
)
def optimised_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("doc_id") % 3 == 0, "keyword").when(F.col("doc_id") % 3 == 1, "vector").otherwise("hybrid")
    return _asked(spark, sf_dir).select("doc_id", rewrite.optimised_query(F.col("query"), mode).alias("optimised"))


@registered(
    r"""
WITH said AS (
  SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations),
topics AS (
  SELECT conv_id, turn, text, before, lower(text) AS l, list_filter(regexp_split_to_array(coalesce(before, ''), '\s+'), lambda w: length(w) > 3 AND lower(w) NOT IN
    ('what','when','where','how','why','which','about','with','from','that','this','these','those','have','been','were','will','would','could','should','does','doing','done'))[1:3] AS t
  FROM said WHERE role = 'user')
SELECT conv_id, turn, text AS query, CASE WHEN before IS NOT NULL AND len(t) > 0 AND (regexp_matches(l, '\b(it|its|that|this|these|those|them|they|their)\b')
    OR regexp_matches(l, '^(what|how|why|when|where|who) about|^(tell|show|explain|describe) (me )?more|^(and|also|but|however)|^(can|could|would|should) (you|it|that)'))
  THEN text || CASE WHEN contains(l, 'it') THEN ' (referring to ' WHEN contains(l, 'that') OR contains(l, 'this') THEN ' (about ' ELSE ' (in context of ' END || array_to_string(t, ' ') || ')' ELSE text END AS reformulated
FROM topics"""
)
def reformulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.reformulate_turns(table(spark, sf_dir, "conversations"))


# --- duplicates and changes


@registered("SELECT min(doc_id) AS doc_id, md5(text) AS chunk_hash FROM documents GROUP BY text")
def exact_dedup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_by_content(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", "chunk_hash")


@registered(
    f"""
WITH {CHUNKS}, ranked AS (SELECT doc_id, chunk_index, md5(chunk) AS chunk_hash, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, chunk_index) AS rn FROM chunks)
SELECT doc_id, chunk_index, chunk_hash FROM ranked WHERE rn = 1"""
)
def exact_dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_by_content(_chunks(spark, sf_dir), "chunk", ["doc_id", "chunk_index"]).select("doc_id", "chunk_index", "chunk_hash")


PAIRS = """
unit AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
pairs AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS similarity FROM unit a JOIN unit b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= 0.4)"""


@registered(f"WITH {PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.near_pairs(_vectors(spark, sf_dir), 0.4)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@registered(
    f"""
WITH RECURSIVE {PAIRS},
numbered AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM unit),
walk AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS kept
  UNION ALL
  SELECT w.n + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.b = x.id AND list_contains(w.kept, p.a)) THEN w.kept ELSE list_append(w.kept, x.id) END
  FROM walk w JOIN numbered x ON x.n = w.n + 1)
SELECT unnest(kept) AS id FROM walk WHERE n = (SELECT max(n) FROM walk)"""
)
def near_dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_by_similarity(_vectors(spark, sf_dir), 0.4).select("id")


STATUS = """
fresh AS (SELECT 'doc' || doc_id::VARCHAR AS source, md5(text) AS h, doc_id FROM documents),
statuses AS (SELECT source, CASE WHEN doc_id % 11 = 0 THEN 'unreadable' WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM fresh)"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against an older index without some of them, with other hashes for some, and some unreadable now."""
    docs = table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("long")
    now = indexing.manifest(docs).withColumn("file_hash", F.when(number % 11 != 0, F.col("file_hash")))
    old = indexing.manifest(docs).filter(number % 5 != 0).withColumn("file_hash", F.when(number % 7 == 0, F.reverse("file_hash")).otherwise(F.col("file_hash")))
    return dedup.change_status(now, old)


@registered(f"WITH {STATUS} SELECT source, status FROM statuses")
def file_change_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir)


@registered(f"WITH {STATUS} SELECT status, count(*)::BIGINT AS files FROM statuses GROUP BY status")
def reindex_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.status_counts(_statuses(spark, sf_dir))


CHANGES = f"""
files AS (
  SELECT doc_id, 0 AS batch, text FROM documents WHERE doc_id % 2 = 0 UNION ALL
  SELECT doc_id, 1, CASE WHEN doc_id % 10 = 0 THEN text || ' changed' ELSE text END FROM documents WHERE doc_id % 2 = 1 OR doc_id % 10 = 0),
cleaned AS (SELECT doc_id, batch, 'doc' || doc_id::VARCHAR AS source, md5(text) AS file_hash, {CLEAN} AS t FROM files WHERE text IS NOT NULL),
sized AS (SELECT *, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 1200 THEN 1 ELSE ceil((length(t) - 1200) / 1000.0)::INT + 1 END AS k FROM cleaned),
cut AS (SELECT doc_id, batch, source, i::INT AS chunk_index, md5(substr(t, i * 1000 + 1, 1200)) AS chunk_hash FROM (SELECT *, unnest(range(k)) AS i FROM sized)),
first AS (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY source, chunk_index) AS place FROM cut WHERE batch = 0),
stayed AS (SELECT * EXCLUDE (place) FROM first WHERE place = 1 AND doc_id % 10 <> 0),
second AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY source, chunk_index) AS place FROM cut
  WHERE batch = 1 AND chunk_hash NOT IN (SELECT chunk_hash FROM stayed)),
indexed AS (SELECT * FROM stayed UNION ALL SELECT * EXCLUDE (place) FROM second WHERE place = 1)"""


def _changed_index(spark: SparkSession, sf_dir: str) -> tables.Snapshot:
    """An index of the documents after two batches, each indexed twice, and the removal of some sources."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    edited = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    texts = docs.select("doc_id", "text")
    batches = [indexing.manifest(rows, "text") for rows in (texts.filter("doc_id % 2 = 0"), texts.withColumn("text", edited))]
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    tables.create(spark, path, buckets=16)
    for number in (0, 0, 1, 0, 1):
        ingest.index_batch(spark, batches[number], path, number, threshold=None, window=(1200, 200))
    return tables.remove_sources(spark, path, indexing.manifest(docs.filter("doc_id % 7 = 0")))


@registered(f"WITH {CHANGES} SELECT source, chunk_index, chunk_hash FROM indexed WHERE doc_id % 7 <> 0")
def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed_index(spark, sf_dir).table(spark, "chunks").select("source", "chunk_index", "chunk_hash")


@registered(
    f"""WITH {CHANGES}
SELECT f.source, f.file_hash, (SELECT count(*) FROM indexed i WHERE i.source = f.source)::BIGINT AS chunks FROM cleaned f
WHERE f.doc_id % 7 <> 0 AND f.batch = CASE WHEN f.doc_id % 2 = 1 OR f.doc_id % 10 = 0 THEN 1 ELSE 0 END"""
)
def index_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger: sources whose chunks are all copies are in it too."""
    return _changed_index(spark, sf_dir).table(spark, "sources").select("source", "file_hash", "chunks")


@registered(
    f"""WITH {CHANGES}
SELECT 1::BIGINT AS version, (SELECT count(*) FROM cleaned WHERE batch = 0) AS files, (SELECT count(*) FROM cleaned WHERE batch = 0) AS sources,
  (SELECT count(DISTINCT chunk_hash) FROM cut WHERE batch = 0) AS chunks, (SELECT count(*) FROM first WHERE place = 1) AS kept
UNION ALL
SELECT 2, (SELECT count(*) FROM documents WHERE text IS NOT NULL), (SELECT count(*) FROM cleaned WHERE batch = 1),
  (SELECT count(DISTINCT chunk_hash) FROM cut WHERE batch = 1), (SELECT count(*) FROM second WHERE place = 1)"""
)
def index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batches counted while they ran."""
    return tables.runs(spark, _changed_index(spark, sf_dir).path).drop("unreadable", "seconds")


# --- retrieval


@registered(f"WITH {BM25} SELECT query_id, id, score, rank FROM keyword_ranked WHERE rank <= 10")
def bm25_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(_texts(spark, sf_dir), _queries(spark, sf_dir), 10)


def _postings(spark: SparkSession, sf_dir: str, columns: list[str]) -> str:
    """Stored postings of all documents, which came in two batches, the second of them twice."""
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *columns)
    for batch in (0, 1, 1):
        postings.append(docs.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == batch), path, columns, ("documents", batch))
    return path


@registered(f"WITH {BM25} SELECT query_id, id, score, rank FROM keyword_ranked WHERE rank <= 10")
def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item with a vector over stored postings of two segments."""
    return postings.search(spark, _postings(spark, sf_dir, ["text"]), _queries(spark, sf_dir), 10)


SOURCE_FIELD = BM25.replace("SELECT doc_id AS id, " + TERMS, "SELECT doc_id AS id, " + TERMS.replace("text", "source"))
for _cte in ("doc_terms", "totals", "tfs", "dfs", "asked", "hits", "keyword_ranked"):
    SOURCE_FIELD = re.sub(rf"\b{_cte}\b", f"source_{_cte}", SOURCE_FIELD)
FIELD_QUERIES = TERMS.replace("text", "text || ' src7'")


@registered(
    f"""
WITH {BM25.replace(f"unnest({TERMS}) AS term FROM benchmark", f"unnest({FIELD_QUERIES}) AS term FROM benchmark").replace("round(sum(", "(sum(").replace("), 6) AS score", ")) AS score")},
{SOURCE_FIELD.replace(f"unnest({TERMS}) AS term FROM benchmark", f"unnest({FIELD_QUERIES}) AS term FROM benchmark").replace("round(sum(", "(sum(").replace("), 6) AS score", ")) AS score")},
both_fields AS (SELECT query_id, id, round(sum(score), 6) AS score FROM (SELECT query_id, id, score FROM hits UNION ALL SELECT query_id, id, score FROM source_hits) GROUP BY query_id, id),
both_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM both_fields)
SELECT query_id, id, score, rank FROM both_ranked WHERE rank <= 10"""
)
def bm25_two_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item, with the name of a source added, over texts and sources."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" src7")).alias("query"))
    return bm25.search(docs, queries, 10, ["text", "source"])


@registered(
    f"""
SELECT field, term, count(DISTINCT id)::BIGINT AS df, count(*)::BIGINT AS total FROM (
  SELECT 0::INT AS field, doc_id AS id, unnest({TERMS}) AS term FROM documents
  UNION ALL SELECT 1::INT, doc_id, unnest({TERMS.replace("text", "source")}) FROM documents) GROUP BY field, term"""
)
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies and counts of all terms, from stored postings after their segments were made one."""
    path = _postings(spark, sf_dir, ["text", "source"])
    postings.compact(spark, path)
    return postings.term_statistics(spark, path)


@registered(f"WITH {KNN} SELECT query_id, id, score, rank FROM vector_ranked WHERE rank <= 5")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.nearest(_vectors(spark, sf_dir), _queries(spark, sf_dir), 5)


@registered(
    f"""
WITH {QUERY_VECTORS}, vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
far AS (SELECT query_id, id, round(-sqrt(greatest(list_dot_product(q, q) + list_dot_product(v, v) - 2 * list_dot_product(q, v), 0)), 6) + 0.0 AS score FROM qv, vecs WHERE query_id <> id)
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM far) WHERE rank <= 5"""
)
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of each query but itself, which is at distance 0."""
    return vector.nearest(_vectors(spark, sf_dir), _queries(spark, sf_dir), 6, "l2").filter("query_id <> id").select("query_id", "id", F.col("score"))


@registered(
    """
SELECT doc_id % 50 AS query_id, (doc_id * 7) % 1009 AS id, (doc_id // 50 + 1)::INT AS rank, d.source, md5(d.text) AS text_hash
FROM documents JOIN (SELECT doc_id AS other, source, text FROM documents) d ON d.other = (doc_id * 7) % 1009"""
)
def chunks_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of lists of ids, some of which aren't there."""
    docs = table(spark, sf_dir, "documents")
    hits = docs.select((F.col("doc_id") % 50).alias("query_id"), (F.col("doc_id") * 7 % 1009).alias("id"), (F.floor(F.col("doc_id") / 50) + 1).cast("int").alias("rank"))
    chunks = docs.select(F.col("doc_id").alias("id"), "source", text.content_hash(F.col("text")).alias("text_hash"))
    return search.by_ids(chunks, hits).select("query_id", "id", "rank", "source", "text_hash")


FUSED = """
fused AS (
  SELECT query_id, id, k.rank AS keyword_rank, v.rank AS vector_rank,
         round(coalesce(0.5::DOUBLE / (60.0::DOUBLE + k.rank), 0) + coalesce(0.5::DOUBLE / (60.0::DOUBLE + v.rank), 0), 9) AS score
  FROM (SELECT * FROM keyword_ranked WHERE rank <= 10) k FULL JOIN (SELECT * FROM vector_ranked WHERE rank <= 10) v USING (query_id, id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, keyword_rank NULLS LAST, vector_rank NULLS LAST, id)::INT AS rank FROM fused)"""
IN_BOTH = "keyword_ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM k0 JOIN qv USING (query_id))"


@registered(f"WITH {BM25.replace('keyword_ranked AS', 'k0 AS')}, {KNN}, {IN_BOTH}, {FUSED} SELECT query_id, id, coalesce(keyword_rank, 0)::INT AS keyword_rank, coalesce(vector_rank, 0)::INT AS vector_rank, score, rank FROM ranked")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _queries(spark, sf_dir)
    keyword, near = bm25.search(_texts(spark, sf_dir), queries, 10), vector.nearest(_vectors(spark, sf_dir), queries, 10)
    ranks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("keyword_rank", "vector_rank")]
    return fuse.reciprocal_ranks(keyword, near).select("query_id", "id", *ranks, "score", "rank")


@registered(f"WITH {BM25.replace('keyword_ranked AS', 'k0 AS')}, {KNN}, {IN_BOTH}, {FUSED} SELECT query_id, id, score, rank FROM ranked WHERE rank <= 5")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_search(_texts(spark, sf_dir), _vectors(spark, sf_dir), _queries(spark, sf_dir), 5)


@registered(
    f"""WITH {BM25.replace('FROM documents)', "FROM documents WHERE lang = 'en')").replace('keyword_ranked AS', 'k0 AS')},
{KNN.replace('FROM embeddings)', "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))")}, {IN_BOTH},
{FUSED.replace('rank <= 10', 'rank <= 15')} SELECT query_id, id, score, rank FROM ranked WHERE rank <= 5"""
)
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    return search.hybrid_search(_texts(spark, sf_dir), _vectors(spark, sf_dir), _queries(spark, sf_dir), 5, ids=ids)


BOOSTS = """
joined AS (SELECT b.item_id AS query_id, d.doc_id AS id, b.text AS query, d.source, d.text, d.lang, e.embedding::DOUBLE[] AS v, q.embedding::DOUBLE[] AS q
  FROM benchmark b LEFT JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
boosts AS (SELECT query_id, id, source, text, v, q,
  CASE WHEN contains(lower(source), 'src1') THEN 1.5 ELSE 0.0 END::DOUBLE + CASE WHEN contains(lower(lang), 'src1') THEN 1.0 ELSE 0.0 END::DOUBLE + CASE WHEN contains(substr(lower(text), 1, 500), 'src1') THEN 0.5 ELSE 0.0 END::DOUBLE
  + CASE WHEN contains(lower(source), 'the') THEN 1.5 ELSE 0.0 END::DOUBLE + CASE WHEN contains(lower(lang), 'the') THEN 1.0 ELSE 0.0 END::DOUBLE + CASE WHEN contains(substr(lower(text), 1, 500), 'the') THEN 0.5 ELSE 0.0 END::DOUBLE AS by_word,
  CASE WHEN query_id % 2 = 0 THEN CASE WHEN contains(lower(source), 'meeting') THEN 5.0 WHEN lang = 'meeting' THEN 3.0 WHEN contains(substr(lower(text), 1, 200), 'meeting') THEN 1.0 ELSE 0.0 END
       ELSE CASE WHEN lang = 'en' THEN 2.0 ELSE 0.0 END END::DOUBLE AS by_type FROM joined)"""


def _boost_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents, with the vectors that there are, and all items as queries with two keywords and a type."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.col("lang").alias("doc_type"), F.col("lang").alias("doc_keywords"))
    words, hint = F.array(F.lit("src1"), F.lit("THE")), F.when(F.col("query_id") % 2 == 0, "meeting").otherwise("en")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("keywords"))
    vectors = _vectors(spark, sf_dir)
    return docs.join(vectors, "id", "left"), items.withColumn("hint", hint).join(vectors.withColumnRenamed("id", "query_id"), "query_id", "left")


@registered(f"WITH {BOOSTS} SELECT query_id, id, by_word, by_type FROM boosts")
def keyword_and_type_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pair_boosts(*_boost_words(spark, sf_dir))


@registered(
    f"""
WITH {BOOSTS}, cos AS (SELECT *, {COSINE} AS c, by_word + by_type AS boost FROM boosts WHERE v IS NOT NULL AND q IS NOT NULL),
scored AS (SELECT *, round(c + 0.3::DOUBLE * boost / greatest(max(boost) OVER (PARTITION BY query_id), 1.0::DOUBLE), 6) AS score FROM cos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scored)
SELECT query_id, id, round(1 - c, 6) + 0.0::DOUBLE AS distance, score, rank FROM ranked WHERE rank <= 5"""
)
def boosted_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.boosted_nearest(*_boost_words(spark, sf_dir), 5)


CITED = """
cited AS (SELECT query_id, source, min(rank) AS first, count(*) AS n FROM found GROUP BY query_id, source),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS number FROM cited),
lines AS (SELECT query_id, string_agg('[' || number || '] **' || source || '**' || CASE WHEN n = 1 THEN ' (1 relevant section)' ELSE ' (' || n || ' relevant sections)' END, chr(10) ORDER BY number) AS citations FROM numbered GROUP BY query_id)"""


@registered(
    f"""
WITH {BM25}, found AS (SELECT query_id, k.rank, d.source, d.text FROM keyword_ranked k JOIN documents d ON d.doc_id = k.id WHERE k.rank <= 5), {CITED}
SELECT query_id, string_agg('• ' || substr(text, 1, 500), chr(10) ORDER BY rank) AS bullets, any_value(citations) AS citations FROM found JOIN lines USING (query_id) GROUP BY query_id"""
)
def context_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return search.context(bm25.search(docs, _queries(spark, sf_dir), 5).join(docs, "id"))


@registered(
    f"""
WITH {KNN}, best AS (SELECT query_id, round(avg(score), 6) AS quality FROM vector_ranked WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, quality, quality < 0.5 AS expand FROM best"""
)
def search_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.quality(vector.nearest(_vectors(spark, sf_dir), _queries(spark, sf_dir), 5))
    return found.withColumn("expand", annotate.should_expand(F.col("quality"), 0.5))


#: BM25 over the English documents alone.
BM25_ENGLISH = BM25.replace("FROM documents)", "FROM documents WHERE lang = 'en')")


@registered(
    f"""
WITH english AS (WITH {BM25_ENGLISH} SELECT * FROM keyword_ranked WHERE rank <= 5), {BM25}, {KNN},
good AS (SELECT query_id FROM vector_ranked WHERE rank <= 5 GROUP BY query_id HAVING round(avg(score), 6) >= 0.5),
narrow AS (SELECT query_id, id, score, rank, 'focused' AS stage FROM english JOIN good USING (query_id))
SELECT query_id, id, score, rank, stage FROM narrow UNION ALL
SELECT query_id, id, score, rank, 'broad' FROM keyword_ranked WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM narrow)"""
)
def two_stage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The focused stage filters before it searches."""
    queries, texts = _queries(spark, sf_dir), _texts(spark, sf_dir)
    english = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    return search.two_stage(texts, _vectors(spark, sf_dir), queries, english, 5, 0.5)


# --- reranking

CANDIDATES = f"""
candidates AS (SELECT query_id, id, k.score, b.text AS query, d.text FROM keyword_ranked k JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id WHERE k.rank <= 20),
covered AS (SELECT *, len(list_intersect(list_distinct({TERMS.replace('text', 'query')}), list_distinct({TERMS}))) / len(list_distinct({TERMS.replace('text', 'query')}))::DOUBLE AS c FROM candidates)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _queries(spark, sf_dir).select("query_id", "query")
    texts = _texts(spark, sf_dir)
    return bm25.search(texts, queries, 20).drop("rank").join(queries, "query_id").join(texts, "id")


@registered(
    f"""WITH {BM25}, {CANDIDATES}, ranked AS (SELECT query_id, id, round(c, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id)::INT AS rank FROM covered JOIN embeddings ON vec_id = query_id)
SELECT query_id, id, rerank_score, rank FROM ranked WHERE rank <= 5"""
)
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.rerank(_candidates(spark, sf_dir), 5).select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


def _load_coverage() -> models.Model:
    """Stands in for a cross-encoder: the share of the query's terms that the text has."""
    import regex

    cut = regex.compile(r"[^\p{L}\p{N}]+")
    parted = lambda text: {t for t in cut.split(text.lower()) if t}
    return lambda queries, texts: [len(q & parted(t)) / len(q) if (q := parted(query)) else 0.0 for query, t in zip(queries, texts, strict=True)]


@registered(ORACLES["lexical_rerank"])
def model_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranking by a model that each worker loads once."""
    candidates = _candidates(spark, sf_dir)
    found = rerank.rerank(candidates, 5, models.scorer(candidates, _load_coverage))
    return found.select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


MINMAX = "CASE WHEN max({0}) OVER w = min({0}) OVER w THEN 0.5 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


@registered(
    f"""WITH {BM25}, {CANDIDATES}, final AS (SELECT query_id, id, round(0.7::DOUBLE * {MINMAX.format('c')} + (1 - 0.7::DOUBLE) * {MINMAX.format('score')}, 6) AS final_score
  FROM covered JOIN embeddings ON vec_id = query_id WINDOW w AS (PARTITION BY query_id))
SELECT query_id, id, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id)::INT AS rank FROM final"""
)
def weighted_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.combined(_candidates(spark, sf_dir)).select("query_id", "id", "final_score", "rank")


@registered(
    """
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.latency_summary(table(spark, sf_dir, "events"), "value", "event_type")


# --- embedding and clusters


@registered(
    f"""
WITH t AS (SELECT doc_id AS id, md5(unnest({TERMS})) AS h FROM documents),
cells AS (SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM t GROUP BY ALL)
SELECT id, bucket::INT AS bucket, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM cells WHERE x <> 0"""
)
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = embed.hashed_embedding(_texts(spark, sf_dir), 64).select("id", F.posexplode("vector").alias("bucket", "x"))
    return made.filter("x <> 0").withColumn("x", F.round("x", 6))


def _load_counts() -> models.Model:
    """Stands in for an embedding model: counts of two letters; it can't embed a text with an address."""

    def model(texts: list[str]) -> list[list[float]]:
        if any("@" in t for t in texts):
            raise ValueError("address")
        return [[float(t.count("e")), float(t.count("a"))] for t in texts]

    return model


@registered(
    """
SELECT doc_id AS id, CASE WHEN NOT contains(text, '@') THEN length(text) - length(replace(text, 'e', '')) END::DOUBLE AS e,
  CASE WHEN NOT contains(text, '@') THEN length(text) - length(replace(text, 'a', '')) END::DOUBLE AS a, CASE WHEN contains(text, '@') THEN 'ValueError: address' END AS error FROM documents"""
)
def model_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding by a model that each worker loads once; texts that it can't embed have an error."""
    return models.embed(_texts(spark, sf_dir), _load_counts).select("id", F.col("vector")[0].alias("e"), F.col("vector")[1].alias("a"), "error")


@registered(
    """
WITH known AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id AS id, md5(text) AS text_hash, md5(text) IN (SELECT h FROM known) AS hit FROM documents"""
)
def embed_cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    cache = texts.filter("id % 3 = 0").select(F.lit("m").alias("model"), text.content_hash(F.col("text")).alias("text_hash"), F.lit(0).alias("vector")).distinct()
    hits, misses = embed.split_by_cache(texts, cache, "m")
    return hits.select("id", "text_hash", F.lit(True).alias("hit")).union(misses.select("id", "text_hash", F.lit(False)))


CENTROIDS = """
cells AS (SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i),
centroids AS (SELECT label AS cluster_id, list(x ORDER BY i) AS c FROM cells GROUP BY label),
far AS (SELECT vec_id AS id, cluster_id, round(sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS distance FROM embeddings, centroids),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, cluster_id)::INT AS rank FROM far)"""


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("vector"))
    return write_table(cluster.label_centroids(rows), "centroids")


@registered(f"WITH {CENTROIDS} SELECT id, cluster_id, distance AS cluster_distance FROM near WHERE rank = 1")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign(_vectors(spark, sf_dir), _centroids(spark, sf_dir)).select("id", "cluster_id", "cluster_distance")


@registered(f"WITH {CENTROIDS} SELECT id AS query_id, cluster_id, distance, rank FROM near JOIN benchmark ON item_id = id WHERE rank <= 2")
def nearest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.nearest_clusters(_queries(spark, sf_dir), _centroids(spark, sf_dir), 2)


@registered(
    f"""WITH {CENTROIDS} SELECT q.id AS query_id, count(*)::BIGINT AS candidates FROM near q JOIN benchmark ON item_id = q.id JOIN near a ON a.rank = 1 AND a.cluster_id = q.cluster_id
WHERE q.rank <= 2 GROUP BY q.id"""
)
def cluster_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = _centroids(spark, sf_dir)
    assigned = cluster.assign(_vectors(spark, sf_dir), centroids)
    return cluster.prune(assigned, _queries(spark, sf_dir), centroids, 2).groupBy("query_id").agg(F.count("*").alias("candidates"))


PRUNED = f"""{CENTROIDS}, {KNN.strip()},
pruned_ranked AS (
  SELECT v.query_id, v.id, v.score, row_number() OVER (PARTITION BY v.query_id ORDER BY v.score DESC, v.id)::INT AS rank
  FROM vector_ranked v JOIN near q ON q.id = v.query_id AND q.rank <= 2 JOIN near a ON a.id = v.id AND a.rank = 1 AND a.cluster_id = q.cluster_id)"""


def _near_in_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = _centroids(spark, sf_dir)
    stored = cluster.store(cluster.assign(_vectors(spark, sf_dir), centroids), f"{shared_dir(spark)}/by-cluster-{uuid.uuid4().hex}")
    return cluster.nearest_in_clusters(stored, _queries(spark, sf_dir), centroids, 5)


@registered(f"WITH {PRUNED} SELECT query_id, id, score, rank FROM pruned_ranked WHERE rank <= 5")
def nearest_in_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of each query in its two nearest clusters, of vectors stored by cluster."""
    return _near_in_clusters(spark, sf_dir)


@registered(
    f"""WITH {PRUNED} SELECT count(*)::BIGINT AS wanted, count(p.id)::BIGINT AS found
FROM vector_ranked v LEFT JOIN pruned_ranked p ON p.query_id = v.query_id AND p.id = v.id AND p.rank <= 5 WHERE v.rank <= 5"""
)
def cluster_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact best five the search in two clusters finds."""
    exact = vector.nearest(_vectors(spark, sf_dir), _queries(spark, sf_dir), 5).select("query_id", "id")
    own = _near_in_clusters(spark, sf_dir).select("query_id", "id", F.lit(1).alias("own"))
    return exact.join(own, ["query_id", "id"], "left").agg(F.count("*").alias("wanted"), F.count("own").alias("found"))


@registered(f"WITH {CENTROIDS} SELECT cluster_id, count(*)::BIGINT AS size, round(sum(distance * distance), 4) AS inertia FROM near WHERE rank = 1 GROUP BY cluster_id")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_stats(cluster.assign(_vectors(spark, sf_dir), _centroids(spark, sf_dir)))


@registered()
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return cluster.cluster_stats(cluster.assign(vectors, cluster.fit(vectors, 8)))


# --- the composed search

#: The benchmark's items as queries with leads that ask for a type, for recent ones, or for nothing.
PHRASED = """phrased AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'latest Meeting notes on ' WHEN 1 THEN 'Product specification of ' WHEN 2 THEN 'recent ' ELSE '' END || text AS text FROM benchmark)"""
SMART = f"""
{PHRASED}, {CENTROIDS},
held AS (SELECT doc_id, doc_id AS id, text, source, lang, embedding::DOUBLE[] AS v, cluster_id, DATE '2024-01-01' + (doc_id % 7)::INT AS modified,
  CASE doc_id % 4 WHEN 0 THEN 'meeting' WHEN 1 THEN 'prd' ELSE 'general' END AS doc_type FROM documents JOIN embeddings ON vec_id = doc_id JOIN near n ON n.id = doc_id AND n.rank = 1),
analysed AS (WITH asked AS (SELECT item_id AS doc_id, text AS query FROM phrased), {ANALYSED}
  SELECT doc_id AS query_id, list_filter(k, lambda x, i: list_position(k, x) = i)[1:8] AS words, hint, regexp_matches(l, 'last|latest|recent|newest') AS recent FROM found),
boosts AS (SELECT query_id, h.id, v, e.embedding::DOUBLE[] AS q, recent, modified,
  coalesce(list_sum(list_transform(words, lambda w: CASE WHEN contains(lower(source), w) THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(lang), w) THEN 1.0 ELSE 0 END
    + CASE WHEN contains(substr(lower(text), 1, 500), w) THEN 0.5 ELSE 0 END)), 0)::DOUBLE
  + CASE WHEN hint = 'meeting' THEN CASE WHEN contains(lower(source), 'meeting') THEN 5 WHEN doc_type = 'meeting' THEN 3 WHEN contains(substr(lower(text), 1, 200), 'meeting') THEN 1 ELSE 0 END
    WHEN doc_type = hint THEN 2 ELSE 0 END::DOUBLE AS boost
  FROM analysed JOIN embeddings e ON e.vec_id = query_id JOIN near r ON r.id = query_id AND r.rank <= 2 JOIN held h ON h.cluster_id = r.cluster_id
  WHERE hint IS NOT NULL OR recent OR len(words) > 0),
likened AS (SELECT *, {COSINE} AS c FROM boosts),
weighed AS (SELECT *, round(c + 0.3::DOUBLE * boost / greatest(max(boost) OVER (PARTITION BY query_id), 1.0::DOUBLE), 6) AS score FROM likened),
focused AS (SELECT query_id, id, round(1 - c, 6) + 0.0::DOUBLE AS distance, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE WHEN recent THEN modified END DESC NULLS LAST, id)::INT AS rank FROM weighed)"""


def _smart_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents as chunks with types and times, with the vectors and clusters that there are, centroids, and the benchmark's items as queries."""
    centroids = _centroids(spark, sf_dir)
    number = F.col("doc_id")
    kind = F.when(number % 4 == 0, "meeting").when(number % 4 == 1, "prd").otherwise("general")
    modified = F.date_add(F.lit("2024-01-01").cast("date"), (number % 7).cast("int"))
    docs = table(spark, sf_dir, "documents").select(number.alias("id"), "text", "source", kind.alias("doc_type"), F.col("lang").alias("doc_keywords"), modified.alias("file_modified"))
    chunks = write_table(docs.join(cluster.assign(_vectors(spark, sf_dir), centroids).select("id", "vector", "cluster_id"), "id", "left"), "chunks")  # an index is stored
    item = F.col("query_id") % 4
    lead = F.when(item == 0, "latest Meeting notes on ").when(item == 1, "Product specification of ").when(item == 2, "recent ").otherwise("")
    return chunks, centroids, _queries(spark, sf_dir).withColumn("query", F.concat(lead, "query"))


@registered(f"WITH {SMART} SELECT query_id, id, distance, score, rank FROM focused WHERE rank <= 5")
def focused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, centroids, queries = _smart_tables(spark, sf_dir)
    asked = queries.withColumn("a", annotate.analyze_query(F.col("query"))).select("query_id", "vector", "a.*")
    guided = asked.filter("doc_type_hint IS NOT NULL OR temporal_hint IS NOT NULL OR size(keywords) > 0")
    return smart.focused_search(chunks, centroids, guided, 5)


@registered(
    f"""WITH {SMART}, good AS (SELECT query_id FROM focused WHERE rank <= 5 GROUP BY query_id HAVING round(avg(1 - distance), 6) >= 0.4),
wide AS (WITH {BM25.replace("FROM benchmark", "FROM phrased").replace("keyword_ranked AS", "k0 AS")},
  {KNN.replace("FROM benchmark", "FROM phrased").replace("FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT id FROM held))")}, {IN_BOTH}, {FUSED.replace("rank <= 10", "rank <= 30")}
  SELECT query_id, id, rank FROM ranked WHERE rank <= 15),
hits AS (SELECT query_id, id, rank AS before, 'focused' AS stage FROM focused JOIN good USING (query_id) WHERE rank <= 5
  UNION ALL SELECT query_id, id, rank, 'broad' FROM wide WHERE query_id NOT IN (FROM good)),
told AS (SELECT query_id, h.id, before, stage, p.text AS query, d.text FROM hits h JOIN phrased p ON item_id = query_id JOIN documents d ON d.doc_id = h.id),
scored AS (SELECT *, round(len(list_intersect(list_distinct({TERMS.replace("text", "query")}), list_distinct({TERMS}))) / len(list_distinct({TERMS.replace("text", "query")}))::DOUBLE, 6) AS rerank_score FROM told),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, before, id)::INT AS rank FROM scored)
SELECT query_id, id, stage, rerank_score, rank FROM final WHERE rank <= 5"""
)
def smart_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis, clusters, boosts, fallback and reranking in one call."""
    return smart.smart_search(*_smart_tables(spark, sf_dir), 5, 0.4)


# --- what the index holds

TYPED = f"""WITH {CHUNKS}, typed AS (
  SELECT * REPLACE (CASE doc_id % 5 WHEN 0 THEN 'Team-Minutes-' WHEN 1 THEN 'api_SPEC_' WHEN 2 THEN 'How-To ' WHEN 3 THEN 'retro spec ' ELSE 'notes ' END || source AS source),
    CASE doc_id % 5 WHEN 0 THEN 'meeting' WHEN 1 THEN 'prd' WHEN 2 THEN 'wiki' WHEN 3 THEN 'meeting' ELSE CASE WHEN contains(chunk, '```') THEN 'technical' ELSE 'general' END END AS doc_type FROM chunks)"""


def _named() -> Column:
    """Sources under made names, so that each rule for types applies to some."""
    mod = F.col("doc_id") % 5
    lead = F.when(mod == 0, "Team-Minutes-").when(mod == 1, "api_SPEC_").when(mod == 2, "How-To ").when(mod == 3, "retro spec ").otherwise("notes ")
    return F.concat(lead, F.col("source"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))
    named = _chunks(spark, sf_dir).withColumn("source", _named())
    return named.select("source", "chunk_index", stamp.alias("timestamp"), annotate.document_type(F.col("chunk"), F.col("source")).alias("doc_type"), stamp.alias("file_modified"))


@registered(f"{TYPED} SELECT count(DISTINCT source)::BIGINT AS document_count, count(*)::BIGINT AS total_chunks, (count(*) // count(DISTINCT source))::BIGINT AS avg_chunks_per_doc FROM typed")
def index_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.counts(_index(spark, sf_dir))


@registered(
    f"""{TYPED} SELECT source AS document, count(*)::BIGINT AS chunks, min_by(doc_type, (doc_id, chunk_index)) AS type, strftime(TIMESTAMP '2024-01-01' + to_minutes(min(doc_id)), '%Y-%m-%d %H:%M') AS indexed_at FROM typed GROUP BY source"""
)
def index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.documents(_index(spark, sf_dir)).select("document", "chunks", "type", F.date_format("indexed_at", "yyyy-MM-dd HH:mm").alias("indexed_at"))


@registered(f"{TYPED} SELECT doc_type, count(*)::BIGINT AS chunks, count(DISTINCT source)::BIGINT AS documents FROM typed GROUP BY ROLLUP (doc_type)")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.rollup(_index(spark, sf_dir))


# --- conversations

USAGE = f"""
sized AS (SELECT *, {TOKENS} AS tok, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM conversations),
used AS (SELECT conv_id, coalesce(sum(tok) FILTER (role = 'system'), 0)::BIGINT AS system_tokens, coalesce(sum(tok) FILTER (role <> 'system' AND is_last), 0)::BIGINT AS current_tokens,
  coalesce(sum(tok) FILTER (role <> 'system' AND NOT is_last), 0)::BIGINT AS history_tokens, 100::BIGINT AS documents_tokens FROM sized GROUP BY conv_id),
full_used AS (SELECT *, (system_tokens + current_tokens + history_tokens + 100)::BIGINT AS total_tokens FROM used)"""


@registered(
    f"""WITH {USAGE} SELECT *, greatest(500 - total_tokens, 0)::BIGINT AS available_tokens, round(total_tokens / 500.0::DOUBLE, 6) AS usage_percentage,
CASE WHEN total_tokens / 500.0::DOUBLE >= 0.85 THEN 'red' WHEN total_tokens / 500.0::DOUBLE >= 0.75 THEN 'yellow' ELSE 'green' END AS warning_level FROM full_used"""
)
def context_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.usage(table(spark, sf_dir, "conversations"), 100, 500)


@registered(
    f"""WITH sized AS (SELECT *, CASE WHEN role = 'system' THEN 0 ELSE {TOKENS} END AS own, {TOKENS} AS tok FROM conversations),
summed AS (SELECT *, role = 'system' OR sum(own) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 150 AS kept FROM sized)
SELECT conv_id, count(*)::BIGINT AS original_count, count(*) FILTER (kept)::BIGINT AS trimmed_count, count(*) FILTER (NOT kept)::BIGINT AS messages_removed,
  coalesce(sum(tok) FILTER (NOT kept), 0)::BIGINT AS tokens_saved FROM summed GROUP BY conv_id"""
)
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.window_info(context.sliding_window(table(spark, sf_dir, "conversations"), 150))


@registered(
    f"""WITH {USAGE},
joined AS (SELECT s.*, f.total_tokens, greatest(500 - 100 - 80 - f.system_tokens - f.current_tokens, 0) + f.current_tokens AS goal FROM sized s JOIN full_used f USING (conv_id)),
summed AS (SELECT *, total_tokens + 80 <= 500 OR role = 'system' OR is_last OR sum(CASE WHEN role = 'system' THEN 0 ELSE tok END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= goal AS kept FROM joined)
SELECT conv_id, turn, role, kept FROM summed"""
)
def optimise_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.optimise(table(spark, sf_dir, "conversations"), 100, 80, 500).select("conv_id", "turn", "role", "kept")


FIRST = """
firsts AS (SELECT conv_id, trim(min_by(text, turn) FILTER (role = 'user')) AS f, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id),
named AS (SELECT conv_id, n, f, CASE WHEN f IS NULL THEN 'Empty Conversation' ELSE substr(f, 1, 50) || CASE WHEN length(f) > 50 THEN '...' ELSE '' END END AS name FROM firsts)"""
WORDS = """
spoken AS (SELECT conv_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM conversations WHERE role IN ('user', 'assistant')),
bare AS (SELECT DISTINCT conv_id, trim(w, '.,!?;:"''()[]{}') AS w FROM spoken WHERE length(w) > 2 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in lexicons.STOP_WORDS) + """)),
keyworded AS (SELECT conv_id, list_sort(list(w))[1:20] AS k FROM bare WHERE w <> '' GROUP BY conv_id)"""  # fmt: skip


@registered(f"WITH {FIRST} SELECT conv_id, name, CASE WHEN f IS NULL THEN 'Conversation with ' || n || ' messages' ELSE substr(f, 1, 100) || '... (' || n || ' messages)' END AS summary FROM named")
def conv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.summaries(table(spark, sf_dir, "conversations"))


@registered(f"WITH {WORDS} SELECT conv_id, array_to_string(k, ' ') AS keywords FROM keyworded")
def conv_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.conversation_keywords(table(spark, sf_dir, "conversations")).select("conv_id", F.array_join("keywords", " ").alias("keywords"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with names, times and flags derived from their ids."""
    messages = table(spark, sf_dir, "conversations")
    made = F.lit("2024-03-01 12:00:00").cast("timestamp") - F.make_dt_interval((F.col("conv_id") % 120).cast("int"))
    named = history.summaries(messages).select("conv_id", "name", made.alias("created_at"), made.alias("updated_at"), (F.col("conv_id") % 9 == 0).alias("pinned"), (F.col("conv_id") % 5 == 0).alias("archived"))
    return named.join(history.conversation_keywords(messages), "conv_id", "left")


@registered(
    f"""WITH {FIRST}, {WORDS},
hits AS (SELECT conv_id, count(*) FILTER (contains(lower(text), 'the')) AS h FROM conversations GROUP BY conv_id),
scored AS (SELECT conv_id, (CASE WHEN contains(lower(name), 'the') THEN 10 ELSE 0 END + 3 * coalesce(len(list_filter(k[1:5], lambda x: contains(x, 'the'))), 0) + h)::BIGINT AS relevance_score
  FROM named LEFT JOIN keyworded USING (conv_id) JOIN hits USING (conv_id))
SELECT conv_id, relevance_score FROM scored WHERE relevance_score > 0 ORDER BY relevance_score DESC, conv_id LIMIT 20"""
)
def conv_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.search(table(spark, sf_dir, "conversations"), _conversations(spark, sf_dir), "The", 20).select("conv_id", "relevance_score")


@registered(
    """
WITH c AS (SELECT DISTINCT conv_id, conv_id % 9 = 0 AS pinned, (conv_id % 120)::INT AS ago FROM conversations WHERE conv_id % 5 <> 0)
SELECT conv_id, pinned, row_number() OVER (ORDER BY pinned DESC, ago, conv_id)::INT AS position,
  CASE WHEN ago = 0 THEN 'Today' WHEN ago = 1 THEN 'Yesterday' WHEN ago < 7 THEN 'Last 7 days' WHEN ago < 30 THEN 'Last 30 days' ELSE 'Older' END AS recency, ago >= 90 AS expired FROM c"""
)
def conv_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    today, now = F.lit("2024-03-01").cast("date"), F.lit("2024-03-01 12:00:01").cast("timestamp")
    shown = _conversations(spark, sf_dir).filter(~F.col("archived"))
    gone = history.expired(_conversations(spark, sf_dir), now, 90).select("conv_id", F.lit(True).alias("gone"))
    rows = order.numbered(shown, F.col("pinned").desc(), F.col("updated_at").desc(), F.col("conv_id")).join(gone, "conv_id", "left")
    return rows.select("conv_id", "pinned", F.col("position").cast("int").alias("position"), history.recency(F.col("updated_at"), today).alias("recency"), F.coalesce("gone", F.lit(False)).alias("expired"))


@registered(
    f"""WITH {FIRST}, parts AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '## 👤 User' WHEN 'assistant' THEN '## 🤖 Assistant' ELSE '## ' || upper(role[1]) || role[2:] END || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)
SELECT conv_id, md5('# ' || name || chr(10) || chr(10) || '**Created:** ' || d || chr(10) || '**Updated:** ' || d || chr(10) || '**Messages:** ' || n || chr(10) || chr(10) || '---' || chr(10) || chr(10) || body) AS document_hash
FROM (SELECT *, strftime(TIMESTAMP '2024-03-01 12:00:00' - to_days((conv_id % 120)::INT), '%Y-%m-%d %H:%M:%S') AS d FROM named) JOIN parts USING (conv_id)"""
)
def conv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = history.exported(table(spark, sf_dir, "conversations"), _conversations(spark, sf_dir))
    return told.select("conv_id", text.content_hash(F.col("document")).alias("document_hash"))


CURRENT = "'Tell me more about conversation ' || conv_id::VARCHAR || '.'"
EVERY_MESSAGE = f"""every AS (
  SELECT DISTINCT conv_id, -1::BIGINT AS turn, 'system' AS role, 'Answer from the documents.' AS text FROM conversations UNION ALL
  SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') UNION ALL
  SELECT DISTINCT conv_id, 1::BIGINT << 62, 'user', {CURRENT} FROM conversations)"""


@registered(
    f"""WITH {EVERY_MESSAGE}, {USAGE.replace("FROM conversations", "FROM every")},
joined AS (SELECT s.*, f.total_tokens, greatest(500 - 100 - 80 - f.system_tokens - f.current_tokens, 0) + f.current_tokens AS goal FROM sized s JOIN full_used f USING (conv_id)),
summed AS (SELECT *, total_tokens + 80 <= 500 OR role = 'system' OR is_last OR sum(CASE WHEN role = 'system' THEN 0 ELSE tok END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= goal AS kept FROM joined)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS position, role, md5(text) AS text_hash, kept FROM summed"""
)
def build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation sends with a next question."""
    said = table(spark, sf_dir, "conversations")
    asked = F.concat(F.lit("Tell me more about conversation "), F.col("conv_id").cast("string"), F.lit("."))
    prompts = said.select("conv_id").distinct().select("conv_id", F.lit("Answer from the documents.").alias("system_prompt"), asked.alias("user_prompt"))
    sent = context.build_messages(said, prompts, 100, 80, 500)
    return sent.select("conv_id", "position", "role", text.content_hash(F.col("text")).alias("text_hash"), "kept")


@registered(
    f"""WITH {USAGE}, levels AS (SELECT *, round(total_tokens / 500.0::DOUBLE, 6) AS share, CASE WHEN total_tokens / 500.0::DOUBLE >= 0.85 THEN 'red' WHEN total_tokens / 500.0::DOUBLE >= 0.75 THEN 'yellow' ELSE 'green' END AS l FROM full_used)
SELECT conv_id, share >= 0.75 AS needs_window, least(round(share * 100, 1), 100.0::DOUBLE) AS percent,
  CASE WHEN total_tokens >= 1000 THEN printf('%.1fk', total_tokens / 1000) ELSE total_tokens::VARCHAR END AS used,
  CASE l WHEN 'red' THEN 'Context is over 85% full: start a new conversation.|Older messages may be dropped.|Ask more specific questions, so that fewer documents are added.'
         WHEN 'yellow' THEN 'Context is over 75% full: watch it.|Start a new conversation if this one loses its focus.|Use targeted questions.' ELSE 'Context has room.' END
  || CASE WHEN documents_tokens > 8000 THEN '|Much of the context is documents: use more specific terms.' ELSE '' END
  || CASE WHEN history_tokens > 15000 THEN '|The history is long: earlier parts may be dropped.' ELSE '' END AS advice FROM levels"""
)
def context_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = context.usage(table(spark, sf_dir, "conversations"), 100, 500)
    shown = context.display_usage(used).select("conv_id", "percent", "used")
    told = context.recommendations(used).select("conv_id", context.needs_window(F.col("usage_percentage")).alias("needs_window"), F.array_join("recommendations", "|").alias("advice"))
    return told.join(shown, "conv_id").select("conv_id", "needs_window", "percent", "used", "advice")


STORED = """stored AS (SELECT conv_id, 'kept ' || conv_id AS name, DATE '2023-01-01' AS created_at, conv_id % 9 = 0 AS pinned, false AS archived, 0::BIGINT AS messages FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 <> 0),
saved AS (SELECT conv_id, name, DATE '2024-03-01' AS created_at, false AS pinned, conv_id % 5 = 0 AS archived, n AS messages FROM named WHERE conv_id % 4 <> 0),
merged AS (SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, coalesce(o.name, n.name) AS name, coalesce(o.created_at, n.created_at) AS created_at,
  coalesce(o.pinned, n.pinned) AS pinned, coalesce(o.archived, n.archived) AS archived, coalesce(n.messages, o.messages) AS messages FROM stored o FULL JOIN saved n ON o.conv_id = n.conv_id)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored conversations with newer ones saved over them; each side lacks some of the other's."""
    said = table(spark, sf_dir, "conversations")
    flag = lambda n: F.col("conv_id") % n == 0
    kept = F.concat(F.lit("kept "), F.col("conv_id").cast("string"))
    stored = said.select("conv_id").distinct().filter(~flag(3)).select(
        "conv_id", kept.alias("name"), F.lit("2023-01-01").cast("date").alias("created_at"), flag(9).alias("pinned"), F.lit(False).alias("archived"), F.lit(0).cast("long").alias("messages")
    )
    named = history.first_user_message(said).filter(~flag(4))
    saved = named.select("conv_id", history.auto_name(F.col("first_message")).alias("name"), F.lit("2024-03-01").cast("date").alias("created_at"), F.lit(False).alias("pinned"), flag(5).alias("archived"), "messages")
    return history.upsert(stored, saved)


@registered(f"WITH {FIRST}, {STORED} SELECT conv_id, name, created_at::VARCHAR AS created_at, pinned, archived, messages FROM merged")
def conv_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("string"))


@registered(
    f"""WITH {FIRST}, {STORED}
SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'renamed' ELSE name END AS name, pinned OR conv_id % 8 = 0 AS pinned, archived FROM merged WHERE conv_id % 11 <> 0"""
)
def conv_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some conversations renamed, some pinned, some deleted."""
    rows = _merged(spark, sf_dir)
    chosen = lambda n: rows.filter(F.col("conv_id") % n == 0)
    marked = history.with_flag(history.with_flag(rows, chosen(7), "name", F.lit("renamed")), chosen(8), "pinned", F.lit(True))
    return history.delete(marked, chosen(11)).select("conv_id", "name", "pinned", "archived")


@registered(
    """WITH dated AS (SELECT DISTINCT event_id, ts FROM events), aged AS (SELECT *, date_diff('day', ts::DATE, DATE '2024-02-01') AS ago FROM dated)
SELECT event_id, CASE WHEN ago = 0 THEN strftime(ts, '%H:%M') WHEN ago < 7 THEN strftime(ts, '%a') WHEN ago < 365 THEN strftime(ts, '%b %d') ELSE strftime(ts, '%Y/%m/%d') END AS label FROM aged"""
)
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).distinct()
    return rows.select("event_id", history.time_label(F.col("ts"), F.lit("2024-02-01").cast("date")).alias("label"))


@registered(
    """WITH n AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k FROM conversations)
SELECT conv_id, turn FROM n WHERE role = 'assistant' AND k % 2 = 0"""
)
def conv_save_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.save_points(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn")


PROCESSED = ASKED.replace("asked AS", "raw_asked AS") + f""",
asked AS (SELECT doc_id, query AS original, CASE WHEN regexp_matches(lower(query), '{'|'.join(lexicons.TYPOS)}') THEN {FIXED} ELSE query END AS query FROM raw_asked)"""


@registered(
    f"""WITH {PROCESSED}, {EXPANDED}, {PHRASES}, {VARIED}
SELECT doc_id, original, query AS processed, array_to_string(every, ',') AS expanded, array_to_string(p, ';') AS phrases, array_to_string(v, ';') AS variations
FROM expanded JOIN (SELECT doc_id, original FROM asked) USING (doc_id) JOIN (SELECT doc_id, p FROM phrases) USING (doc_id) JOIN (SELECT doc_id, v FROM varied) USING (doc_id)"""
)
def processed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _asked(spark, sf_dir).select("doc_id", rewrite.process_query(F.col("query")).alias("p"))
    return done.select(
        "doc_id", "p.original", "p.processed", F.array_join("p.expansion.expanded_terms", ",").alias("expanded"), F.array_join("p.phrases", ";").alias("phrases"), F.array_join("p.variations", ";").alias("variations")
    )


MODELS = [*lexicons.MODEL_CONTEXTS, "some other model"]


@registered(
    f"""WITH modelled AS (SELECT doc_id, {TOKENS} AS tokens, ([{", ".join(f"'{m}'" for m in MODELS)}])[(doc_id % {len(MODELS)} + 1)::INT] AS model FROM documents),
limits AS (SELECT *, least(512, (CASE model {" ".join(f"WHEN '{m}' THEN {n}" for m, n in lexicons.MODEL_CONTEXTS.items())} ELSE 4096 END - 2000) // 4)::INT AS best FROM modelled)
SELECT doc_id, model, best, tokens > best AS oversize FROM limits"""
)
def chunk_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under the models' limits for a chunk, each model for some."""
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("doc_id") % len(MODELS) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", model.alias("model"), text.count_tokens(F.col("text")).alias("tokens"))
    return rows.select("doc_id", "model", chunk.optimal_chunk_tokens(F.col("model")).alias("best"), chunk.oversize(F.col("tokens"), F.col("model")).alias("oversize"))


@registered(
    """WITH known AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 3 = 0), looked AS (SELECT md5(text) IN (SELECT h FROM known) AS hit FROM documents)
SELECT count(*) FILTER (hit)::BIGINT AS hits, count(*) FILTER (NOT hit)::BIGINT AS misses, count(*) FILTER (hit) / count(*)::DOUBLE AS hit_rate FROM looked"""
)
def embed_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.cache_stats(embed_cache_split(spark, sf_dir))


@registered(
    """SELECT count(*)::BIGINT AS files, count(*) FILTER (doc_id % 13 = 0)::BIGINT AS failed, round(sum(n_chars / 1000.0::DOUBLE), 6) AS seconds, round(60 * count(*) / sum(n_chars / 1000.0::DOUBLE), 6) AS per_minute FROM documents"""
)
def index_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, with seconds by their length and some failures."""
    docs = table(spark, sf_dir, "documents")
    return meta.throughput(docs.select("source", (F.col("doc_id") % 13 != 0).alias("ok"), (F.col("n_chars") / 1000).alias("seconds")))


@registered(
    f"""
WITH RECURSIVE {PAIRS},
fresh AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM unit WHERE id NOT IN (SELECT item_id FROM benchmark)),
walk AS (
  SELECT 0::BIGINT AS n, (SELECT list(item_id) FROM benchmark JOIN unit ON id = item_id) AS kept, []::BIGINT[] AS added
  UNION ALL
  SELECT w.n + 1, CASE WHEN known THEN w.kept ELSE list_append(w.kept, id) END, CASE WHEN known THEN w.added ELSE list_append(w.added, id) END
  FROM (SELECT w.*, x.id, EXISTS (SELECT 1 FROM pairs p WHERE (p.b = x.id AND list_contains(w.kept, p.a)) OR (p.a = x.id AND list_contains(w.kept, p.b))) AS known
        FROM walk w JOIN fresh x ON x.n = w.n + 1) w)
SELECT unnest(added) AS id FROM walk WHERE n = (SELECT max(n) FROM walk)"""
)
def near_dup_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that aren't like those kept before, which are all of the benchmark's numbers, or like earlier ones."""
    vectors, items = _vectors(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return dedup.first_by_similarity(vectors.join(items, "id", "left_anti"), 0.4, vectors.join(items, "id", "left_semi")).select("id")


@registered(
    """
WITH counted AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> ''))::INT AS tokens FROM conversations)
SELECT conv_id, turn, tokens, CASE WHEN turn > 0 THEN tokens / turn::DOUBLE ELSE 0.0 END AS tokens_per_second FROM counted"""
)
def answer_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each message, and words a second with the turn's number as seconds."""
    return context.stream_stats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.col("turn").cast("double").alias("seconds")))


# --- streams


@registered(
    """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"""
)
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the events table run as a stream, up to its end."""
    stream = event_stream.windowed_counts(event_stream.read_events(spark, sf_dir, "events.parquet"))
    folder = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}"
    last = event_stream.run_updates(stream, f"{folder}/table", f"{folder}/checkpoint", ["window_start", "event_type"])
    return last.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@registered(
    f"""WITH {USAGE},
ended AS (SELECT conv_id, turn, tok, sum(CASE WHEN role = 'system' THEN 0 ELSE tok END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS upto, role FROM sized),
begun AS (SELECT conv_id, min(turn) AS kept_from, sum(tok)::BIGINT AS kept_tokens FROM ended WHERE upto <= 150 AND role <> 'system' GROUP BY conv_id)
SELECT f.conv_id, (SELECT count(*) FROM conversations c WHERE c.conv_id = f.conv_id)::BIGINT AS messages, f.total_tokens, coalesce(kept_from, -1)::BIGINT AS kept_from, coalesce(kept_tokens, 0)::BIGINT AS kept_tokens,
  CASE WHEN total_tokens / 500.0::DOUBLE >= 0.85 THEN 'red' WHEN total_tokens / 500.0::DOUBLE >= 0.75 THEN 'yellow' ELSE 'green' END AS warning_level
FROM full_used f LEFT JOIN begun USING (conv_id)"""
)
def stream_context_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage and windows of all conversations, whose messages come in three batches, out of order."""
    folder = f"{shared_dir(spark)}/messages-{uuid.uuid4().hex}"
    for part in (1, 0, 2):
        table(spark, sf_dir, "conversations").filter(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/said")
    running = message_stream.running_usage(message_stream.read_messages(spark, f"{folder}/said"), 100, 500, 150)
    last = event_stream.run_updates(running, f"{folder}/table", f"{folder}/checkpoint", ["conv_id"])
    begins = F.coalesce("kept_from", F.lit(-1).cast("long")).alias("kept_from")  # -1: nothing is kept
    return last.select("conv_id", "messages", "total_tokens", begins, "kept_tokens", "warning_level")


@registered(
    """
WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*)::BIGINT AS n FROM numbered GROUP BY user_id, s"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = event_stream.sessions(rows, "6 hours")
    return found.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
