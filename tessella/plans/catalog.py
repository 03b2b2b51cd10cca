"""Registered queries of the retrieval operators, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as fx
from tessella.functions.vectors import feature_index, feature_sign
from tessella.operators import blocks, chunks, evaluation, filters, fusion, layout, lexical, prompt, quality, rerank, sync, vector
from tessella.session import durable, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# == shared parts ==
_TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda t: lower(t))"
_ESTIMATE = "(CAST(floor(len(regexp_extract_all({0}, '[\\x{{4e00}}-\\x{{9fff}}]')) * 1.5::DOUBLE + len(regexp_extract_all({0}, '[A-Za-z0-9_]+')) * 1.3::DOUBLE) AS INTEGER) + 1)"

_BM25 = f"""
tok AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents),
stat AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
wanted AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
post AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (
  SELECT item_id AS query_id, doc_id AS chunk_id,
    sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25
  FROM post JOIN freq USING (term) JOIN wanted USING (term), stat GROUP BY ALL)
"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the part of chunks."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), F.lit("").alias("heading_path"), "source", "lang"
    )


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    found = lexical.bm25_search(_chunks(spark, sf_dir), _queries(spark, sf_dir))
    return lexical.rank_hits(found.select("query_id", "chunk_id", F.round("bm25", 6).alias("score")), k)


_TOP10 = f"""WITH {_BM25},
ranked AS (SELECT query_id, chunk_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, chunk_id) AS rank FROM scored),
top AS (SELECT * FROM ranked WHERE rank <= 10)"""
#: The candidates of a second stage.
_TOP100 = _TOP10.replace("rank <= 10)", "rank <= 100)")


# == text and statistics ==
@query(f"SELECT doc_id, {_ESTIMATE.format('text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fx.token_estimate("text").alias("tokens"))


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(_chunks(spark, sf_dir))
    return index.postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


@query(f"SELECT count(*) AS n, round(avg(len({_TOKENS.format('text')})), 6) AS avgdl FROM documents")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.build_index(_chunks(spark, sf_dir)).corpus_stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT item_id, list_distinct({_TOKENS.format('text')}).len() AS phrases FROM (SELECT item_id, array_to_string(list_filter({_TOKENS.format('text')}, lambda t: len(t) >= 2), ' ') AS text FROM benchmark)")
def query_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(fx.phrases("text")).cast("bigint").alias("phrases"))


@query("SELECT doc_id, sha1(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("content_hash"))


@query(
    """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^。！？.!?\\n]*[。！？.!?\\n]|[^。！？.!?\\n]+$') AS s FROM documents)
SELECT doc_id, len(s) AS sentences, sha1(array_to_string(s, '|')) AS digest FROM t"""
)
def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.filter(F.split("text", "(?<=[。！？.!?\\n])", -1), lambda s: s != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(cut).cast("bigint").alias("sentences"), F.sha1(F.array_join(cut, "|")).alias("digest"))


@query(
    """WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM documents),
w AS (SELECT doc_id, substr(x, p::INT, 300) AS content, (p - 1) // 250 AS chunk FROM (SELECT doc_id, x, unnest(range(1, length(x) + 1, 250)) AS p FROM t))
SELECT doc_id, chunk, sha1(content) AS digest FROM w WHERE content <> '' AND NOT regexp_full_match(content, '\\s+')"""
)
def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fx.char_windows("text", 300, 50)).alias("chunk", "content"))
    return windows.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.sha1("content").alias("digest"))


# == lexical ==
@query(_TOP10 + " SELECT query_id, chunk_id, score, rank::INT AS rank FROM top")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 10)


_PHRASES = f"list_distinct(list_filter({_TOKENS.format('b.text')}, lambda t: len(t) >= 2))"


@query(
    _TOP100
    + f""", asked AS (SELECT item_id, {_PHRASES} AS p, {_TOKENS.format('b.text')} AS t FROM benchmark b)
SELECT query_id, chunk_id,
  round(list_sum(list_transform(p, lambda x: CASE WHEN contains(lower(d.text), x) THEN 0.5::DOUBLE + least(len(x), 8) * 0.35::DOUBLE ELSE 0 END)
    ) + list_sum(list_transform(p, lambda x: CASE WHEN contains(lower(d.source), x) THEN least((0.5::DOUBLE + least(len(x), 8) * 0.35::DOUBLE) * 0.4::DOUBLE, 1) ELSE 0 END)), 6) AS phrase_boost,
  round(list_sum(list_transform(t, lambda x: CASE WHEN list_contains({_TOKENS.format('d.source')}, x) THEN 0.8::DOUBLE ELSE 0 END)), 6) AS metadata_boost
FROM top JOIN documents d ON chunk_id = d.doc_id JOIN asked ON item_id = query_id"""
)
def lexical_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase and metadata boosts of the hundred best BM25 hits."""
    hits = _top(spark, sf_dir, 100).join(_chunks(spark, sf_dir), "chunk_id").join(_queries(spark, sf_dir), "query_id")
    low = lambda c: F.lower(F.col(c))
    return hits.select(
        "query_id", "chunk_id", F.round(lexical.phrase_boost(fx.phrases("query"), low("content"), low("heading_path"), low("source")), 6).alias("phrase_boost"),
        F.round(lexical.metadata_boost(fx.terms("query"), fx.terms("heading_path"), fx.terms("source")), 6).alias("metadata_boost"),
    )


@query(
    f"""WITH {_BM25}, asked AS (SELECT item_id, {_PHRASES} AS p, {_TOKENS.format('b.text')} AS t FROM benchmark b),
total AS (SELECT query_id, chunk_id, round(bm25
  + list_sum(list_transform(p, lambda x: CASE WHEN contains(lower(d.text), x) THEN 0.5::DOUBLE + least(len(x), 8) * 0.35::DOUBLE ELSE 0 END))
  + list_sum(list_transform(p, lambda x: CASE WHEN contains(lower(d.source), x) THEN least((0.5::DOUBLE + least(len(x), 8) * 0.35::DOUBLE) * 0.4::DOUBLE, 1) ELSE 0 END))
  + list_sum(list_transform(t, lambda x: CASE WHEN list_contains({_TOKENS.format('d.source')}, x) THEN 0.8::DOUBLE ELSE 0 END)), 6) AS score
  FROM scored JOIN documents d ON chunk_id = d.doc_id JOIN asked ON item_id = query_id WHERE d.lang = 'en')
SELECT query_id, chunk_id, score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM total WHERE score > 0) WHERE r <= 100"""
)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 plus boosts under a metadata filter: the 100 best hits of each query."""
    return lexical.lexical_search(_chunks(spark, sf_dir), _queries(spark, sf_dir), 100, {"lang": "en"}, digits=6).select("query_id", "chunk_id", "score", "rank")


# == vectors ==
_NEAR = """
pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs)
"""


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = vectors.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    found = vector.block_search(vectors, asked, k)
    return lexical.rank_hits(found.select("query_id", "chunk_id", F.round("score", 6).alias("score")), k)


@query(f"WITH {_NEAR} SELECT query_id, chunk_id, score, rank::INT AS rank FROM near WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 10)


@query(
    f"""WITH t AS (SELECT doc_id, unnest({_TOKENS.format('lower(text)')}) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 128 AS i, CASE WHEN ('0x' || substr(sha256(w), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS s FROM t)
SELECT doc_id, i::INT AS i, sum(s)::DOUBLE AS value FROM h GROUP BY ALL HAVING sum(s) <> 0"""
)
def feature_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed feature hashing in long form, before normalisation."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(fx.feature_tokens("text")).alias("w"))
    words = tokens.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    hashed = words.select("doc_id", feature_index(F.col("w"), 128).alias("i"), (feature_sign(F.col("w")) * F.col("n")).alias("v"))
    return hashed.groupBy("doc_id", "i").agg(F.sum("v").alias("value")).filter("value <> 0")


# == fusion ==
_CHANNELS = f"""WITH {_BM25},
lex AS (SELECT query_id, chunk_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, chunk_id) AS rank FROM scored),
{_NEAR},
chan AS (SELECT 1 AS channel, 1.5::DOUBLE AS w, * FROM lex WHERE rank <= 100
  UNION ALL SELECT 0, 1.0::DOUBLE, query_id // 100, chunk_id, score, rank FROM near WHERE rank <= 100 AND query_id // 100 IN (SELECT item_id FROM benchmark)),
most AS (SELECT channel, query_id, max(abs(score)) AS m FROM chan GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, round(sum(w / (60 + rank) + w * 0.05::DOUBLE * score / m), 9) AS score, min(channel * 1000 + rank) AS seen
  FROM chan JOIN most USING (channel, query_id) GROUP BY ALL)
"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir, 100).withColumn("query_id", F.floor(F.col("query_id") / 100).cast("bigint"))
    near = near.join(_queries(spark, sf_dir).select("query_id"), "query_id", "left_semi")
    fused = fusion.fuse([(near, 1.0), (_top(spark, sf_dir, 100), 1.5)])
    return fused.withColumn("score", F.round("score", 9))


@query(_CHANNELS + " SELECT query_id, chunk_id, round(score, 6) AS score FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(
    _CHANNELS
    + """, placed AS (SELECT f.*, coalesce(d.source, '') AS source, row_number() OVER (PARTITION BY query_id, coalesce(d.source, '') ORDER BY score DESC, seen, chunk_id) - 1 AS k
  FROM fused f LEFT JOIN documents d ON d.doc_id = chunk_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score - 0.01::DOUBLE * k DESC, score DESC, seen, chunk_id) AS rank FROM placed)
SELECT query_id, chunk_id, rank::INT AS rank FROM best WHERE rank <= 20"""
)
def source_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _fused(spark, sf_dir).join(_chunks(spark, sf_dir).select("chunk_id", "source"), "chunk_id", "left")
    return fusion.diversify(held, 20).select("query_id", "chunk_id", "rank")


@query(
    _TOP10
    + """, kids AS (SELECT query_id, chunk_id, chunk_id // 5 * 5 AS parent, score FROM top),
best AS (SELECT query_id, parent, max(score) AS score FROM kids GROUP BY ALL)
SELECT query_id, parent AS chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent))::INT AS rank FROM best"""
)
def parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in groups of five ids: the first stands for its group."""
    docs = _chunks(spark, sf_dir)
    hits = _top(spark, sf_dir, 10).join(docs.select("chunk_id", "content"), "chunk_id").withColumn("parent_id", F.floor(F.col("chunk_id") / 5).cast("bigint") * 5)
    return fusion.expand_parents(hits, docs.filter("chunk_id % 5 = 0").select("chunk_id", "content"), 10).select("query_id", "chunk_id", "score", "rank")


# == reranking ==
@query(
    _TOP100
    + """, span AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM top)
SELECT query_id, chunk_id, round(CASE WHEN hi - lo <= 1e-9 * greatest(abs(hi), abs(lo)) THEN CASE WHEN score > 0 THEN 1 ELSE 0 END ELSE (score - lo) / (hi - lo) END, 6)::DOUBLE AS norm FROM span"""
)
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 100).select("query_id", "chunk_id", F.round(rerank.normalised_raw(F.col("score")), 6).alias("norm"))


_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_W = "(1 + least(len(x), 8) * 0.12::DOUBLE)"
_SUM = "list_reduce(list_prepend(0::DOUBLE, list_transform({0}, lambda x: {1})), lambda a, b: a + b)"
_SHARE = f"coalesce({_SUM.format('{0}', 'CASE WHEN {1} THEN ' + _W + ' * {2} ELSE 0 END')} / nullif({_SUM.format('{0}', _W)}, 0), 0)"


@query(
    _TOP100
    + f""", asked AS (SELECT item_id, {_ORDERED.format(_TOKENS.format('b.text'))} AS t, {_ORDERED.format("list_filter(" + _TOKENS.format('b.text') + ", lambda t: len(t) >= 2)")} AS p, regexp_replace(lower(b.text), '[^\\pL\\pN]+', '', 'g') AS c FROM benchmark b),
parts AS (SELECT query_id, chunk_id, score, rank,
    {_SHARE.format('t', "contains(concat(lower(d.text), ' ', lower(d.source)), x)", '1')} AS term,
    {_SHARE.format('p', "contains(lower(d.text), x) OR contains(lower(d.source), x)", "CASE WHEN contains(lower(d.text), x) THEN 1 ELSE 0.55::DOUBLE END")} AS phrase,
    greatest({_SHARE.format('t', "contains(lower(d.source), x)", '1')}, {_SHARE.format('p', "contains(lower(d.source), x)", '1')}) AS meta,
    {_SHARE.format('t', "contains(lower(d.source), x)", '1')} AS named,
    CASE WHEN len(c) >= 4 AND contains(regexp_replace(lower(concat(d.text, ' ', d.source)), '[^\\pL\\pN]+', '', 'g'), c) THEN 1 ELSE 0 END AS exact
  FROM top JOIN documents d ON chunk_id = d.doc_id JOIN asked ON item_id = query_id)
SELECT query_id, chunk_id, round(round(least(1, term * 0.41::DOUBLE + phrase * 0.30::DOUBLE + meta * 0.14::DOUBLE + named * 0.10::DOUBLE + exact * 0.05::DOUBLE
  + CASE WHEN term >= 0.60::DOUBLE THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN phrase >= 0.40::DOUBLE THEN 0.04::DOUBLE ELSE 0 END), 6), 4)::DOUBLE AS relevance FROM parts"""
)
def pair_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairwise relevance of the hundred best hits."""
    hits = _top(spark, sf_dir, 100).join(_chunks(spark, sf_dir), "chunk_id").join(rerank.query_profile(_queries(spark, sf_dir)), "query_id")
    score = rerank.pair_score(F.col("q_terms"), F.col("q_phrases"), F.col("q_compact"), F.lower("content"), F.lower("heading_path"), F.lower("source"))
    return hits.select("query_id", "chunk_id", F.round(score, 4).alias("relevance"))


@query(
    """WITH parts AS (SELECT vec_id, p, list_slice(embedding::DOUBLE[], p * 16 + 1, p * 16 + 16) AS v FROM embeddings, range(4) r(p)),
unit AS (SELECT vec_id, p, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM parts),
best AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, q.p, max(list_dot_product(q.v, d.v)) AS s FROM unit q JOIN unit d ON q.vec_id % 100 = 0 GROUP BY ALL),
sims AS (SELECT query_id, chunk_id, round((avg(s) + 1) / 2, 6) AS score FROM best GROUP BY ALL)
SELECT query_id, chunk_id, score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM sims) WHERE r <= 20"""
)
def max_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction over quarters of the vectors as token vectors: the 20 best of all vectors for each query."""
    sims = rerank.max_sim_top(*_sim_tokens(spark, sf_dir), 20).select("query_id", "chunk_id", F.round("sim", 6).alias("score"))
    return lexical.rank_hits(sims, 20)


def _sim_tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from tessella.functions.vectors import normalised

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("p"), F.col("embedding").cast("array<double>").alias("e"))
    unit = vectors.select("vec_id", normalised(F.slice("e", F.col("p") * 16 + 1, 16)).alias("v"))
    queries = unit.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    return queries, unit.select(F.col("vec_id").alias("chunk_id"), "v")


@query()
def max_sim_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``max_sim``, every pair of a query and a vector; tests compare it with brute force."""
    return rerank.max_sim_all(*_sim_tokens(spark, sf_dir)).select("query_id", "chunk_id", F.round("sim", 4).alias("sim"))


@query()
def late_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed token vectors use BLAKE2b, which SQL lacks; tests compare it with a scalar version."""
    hits = durable(_top(spark, sf_dir, 100).join(_chunks(spark, sf_dir), "chunk_id"))
    return rerank.rerank_late(hits, _queries(spark, sf_dir), 20).select("query_id", "chunk_id", "score", "rank")


# == evaluation ==
_GRADED = (
    _TOP10
    + """, graded AS (SELECT top.*, d.source, contains(d.text, b.text) AS relevant FROM top JOIN documents d ON chunk_id = d.doc_id JOIN benchmark b ON item_id = query_id),
report AS (SELECT item_id AS query_id, coalesce(round(1.0::DOUBLE / min(rank) FILTER (relevant), 6), 0) AS mrr, count(*) FILTER (relevant AND rank <= 1) > 0 AS hit1, count(*) FILTER (relevant AND rank <= 3) > 0 AS hit3,
  coalesce(round((count(*) FILTER (relevant AND rank <= 3))::DOUBLE / least(3, count(rank)), 6), 0) AS precision3,
  coalesce(round((count(*) FILTER (relevant AND rank <= 3))::DOUBLE / nullif(count(*) FILTER (relevant), 0), 6), 0) AS recall3,
  round(coalesce(avg(score), 0), 4) AS mean_score, round(count(DISTINCT source)::DOUBLE / nullif(count(rank), 0), 6) AS diversity
  FROM benchmark LEFT JOIN graded ON item_id = query_id GROUP BY item_id)"""
)


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = _top(spark, sf_dir, 10).join(_chunks(spark, sf_dir), "chunk_id").join(texts, "query_id")
    graded = hits.withColumn("relevant", F.contains("content", "text"))
    return evaluation.retrieval_report(graded, _queries(spark, sf_dir).withColumn("labelled", F.lit(True)))


@query(_GRADED + " SELECT query_id, mrr, hit1, hit3, precision3, recall3, mean_score, diversity FROM report")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select(
        "query_id", "mrr", F.col("hit_at_k")[1].alias("hit1"), F.col("hit_at_k")[3].alias("hit3"), F.col("precision_at_k")[3].alias("precision3"), F.col("recall_at_k")[3].alias("recall3"),
        F.round("mean_score", 4).alias("mean_score"), F.col("source_diversity").alias("diversity"),
    )


@query(_GRADED + " SELECT count(*) AS query_count, round(avg(mrr), 6) AS average_mrr, round(avg(hit1::INT), 6) AS hit1, round(avg(precision3), 6) AS precision3, round(avg(recall3), 6) AS recall3 FROM report")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.summarise_reports(_reports(spark, sf_dir))
    return out.select("query_count", "average_mrr", F.col("hit_rate_at_k")[1].alias("hit1"), F.col("average_precision_at_k")[3].alias("precision3"), F.col("average_recall_at_k")[3].alias("recall3"))


@query(
    _GRADED
    + """, m AS (SELECT 'mrr' AS metric, avg(mrr) AS actual FROM report UNION ALL SELECT 'hit_rate_at_1', avg(hit1::INT) FROM report),
g(name, value) AS (VALUES ('min_mrr', 0.85::DOUBLE), ('min_hit_rate_at_1', 0.1::DOUBLE), ('max_mrr', 0.9::DOUBLE))
SELECT name, value, round(actual, 6) AS actual, CASE WHEN name LIKE 'min%' THEN actual < value ELSE actual > value END AS failed FROM g JOIN m ON metric = substr(name, 5)"""
)
def gate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _reports(spark, sf_dir)
    wide = reports.agg(F.avg("mrr").alias("mrr"), F.avg(F.col("hit_at_k")[1].cast("int")).alias("hit_rate_at_1"))
    metrics = wide.select(F.explode(F.create_map(F.lit("mrr"), "mrr", F.lit("hit_rate_at_1"), "hit_rate_at_1")).alias("metric", "actual"))
    gates = spark.createDataFrame([("min_mrr", 0.85), ("min_hit_rate_at_1", 0.1), ("max_mrr", 0.9)], "name string, value double")
    return evaluation.gate_check(metrics, gates).withColumn("actual", F.round("actual", 6))


# == sync ==
def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus: the older lacks every seventh document and has other texts for every fifth; the newer lacks every eleventh."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("doc_id").alias("n"))
    old = docs.filter("n % 7 <> 0").withColumn("text", F.when(F.col("n") % 5 == 0, F.concat(F.lit("old "), F.col("text"))).otherwise(F.col("text")))
    return old, docs.filter("n % 11 <> 0")


_OLD = "old AS (SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0), new AS (SELECT doc_id::VARCHAR AS doc_id, text FROM documents WHERE doc_id % 11 <> 0)"


@query(
    f"""WITH {_OLD} SELECT coalesce(n.doc_id, o.doc_id) AS doc_id,
CASE WHEN o.doc_id IS NULL THEN 'ADD' WHEN n.doc_id IS NULL THEN 'DEL' WHEN n.text = o.text THEN 'SKIP' ELSE 'UPD' END AS action,
CASE WHEN o.doc_id IS NULL THEN 1 WHEN n.doc_id IS NOT NULL AND n.text <> o.text THEN 2 ELSE 1 END::INT AS version
FROM new n FULL JOIN old o ON n.doc_id = o.doc_id"""
)
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    manifest = old.select("doc_id", F.sha1("text").alias("source_hash"), F.lit(1).alias("version"), F.lit(0).cast("bigint").alias("updated_at"))
    return sync.diff_manifest(new, manifest).select("doc_id", "action", "version")


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS piece FROM {0})"


@query(
    f"""WITH {_OLD}, a AS {_LINES.format('new')}, b AS (SELECT DISTINCT doc_id, piece FROM {_LINES.format('old')})
SELECT a.doc_id, count(*) AS chunks, count(b.piece) AS reused FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.piece = b.piece GROUP BY a.doc_id"""
)
def chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks: how many of the newer state's have a known hash."""
    cut = lambda df: df.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("piece")).withColumn("content_hash", F.sha1("piece"))
    old, new = _versions(spark, sf_dir)
    flagged = sync.reuse_flags(cut(new), cut(old))
    return flagged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("reused").cast("bigint")).alias("reused"))


@query(
    f"""WITH {_OLD}, acts AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'ADD' WHEN n.doc_id IS NULL THEN 'DEL' WHEN n.text = o.text THEN 'SKIP' ELSE 'UPD' END AS action FROM new n FULL JOIN old o ON n.doc_id = o.doc_id),
a AS {_LINES.format('new')}, b AS {_LINES.format('old')}
SELECT (SELECT count(*) FROM acts WHERE action = 'ADD') AS added, (SELECT count(*) FROM acts WHERE action = 'UPD') AS updated, (SELECT count(*) FROM acts WHERE action = 'SKIP') AS skipped,
(SELECT count(*) FROM b JOIN acts USING (doc_id) WHERE action IN ('UPD', 'DEL')) AS deleted,
(SELECT count(*) FROM a JOIN acts USING (doc_id) WHERE action = 'UPD' AND (doc_id, piece) IN (SELECT (doc_id, piece) FROM b)) AS reused_chunks"""
)
def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda df: df.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("piece")).withColumn("content_hash", F.sha1("piece"))
    old, new = _versions(spark, sf_dir)
    manifest = old.select("doc_id", F.sha1("text").alias("source_hash"), F.lit(1).alias("version"), F.lit(0).cast("bigint").alias("updated_at"))
    diff = durable(sync.diff_manifest(new, manifest))
    changed = new.join(diff.filter("action in ('ADD', 'UPD')").select("doc_id"), "doc_id", "left_semi")
    return sync.sync_report(diff, cut(old), cut(changed)).select("added", "updated", "skipped", "deleted", "reused_chunks")


@query(f"WITH {_OLD} SELECT doc_id, sha1(text) AS digest FROM new UNION ALL SELECT doc_id, sha1(text) FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return sync.upsert(old.drop("n"), new.drop("n"), "doc_id").select("doc_id", F.sha1("text").alias("digest"))


@query("SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE lang IN ('en', 'de') AND source = 'src3' OR (lang IN ('en', 'de') AND source = 'src5') GROUP BY source")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.apply_filter(table(spark, sf_dir, "documents"), {"lang": ["en", "de"], "source": ("src3", "src5")}, default=False)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT count(*) AS document_count, sum(len(string_split(text, chr(10))))::BIGINT AS total_chunk_count, sum(length(text))::BIGINT AS raw_characters FROM documents")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.sources import datasets

    docs = table(spark, sf_dir, "documents")
    out = datasets.export_summary(docs, docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("piece")))
    return out.select("document_count", "total_chunk_count", "raw_characters")


# == prompts and memory ==
@query(
    """SELECT conv_id, turn, len(h) AS history, sha1(coalesce(array_to_string(list_transform(h, lambda x: x.role || ':' || x.text), '|'), '')) AS digest
FROM (SELECT conv_id, turn, coalesce(list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS h FROM conversations)"""
)
def conversation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = prompt.memory_window(table(spark, sf_dir, "conversations"))
    digest = F.sha1(F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"))
    return held.select("conv_id", "turn", F.size("history").cast("bigint").alias("history"), digest.alias("digest"))


@query(
    _TOP10
    + """, blocks AS (SELECT query_id, string_agg('[片段' || rank || ' | 来源:' || d.source || ' | 相关度:1.000 | chunk_id:' || chunk_id || ' | 页码:0 | 版本:1]' || chr(10) || regexp_replace(d.text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY rank) AS t
  FROM top JOIN documents d ON chunk_id = d.doc_id WHERE rank <= 3 GROUP BY query_id)
SELECT item_id AS query_id, sha1('【上下文】' || chr(10) || coalesce(t, '（无检索结果）') || chr(10) || chr(10) || '【问题】' || chr(10) || text) AS digest, 2 AS messages FROM benchmark LEFT JOIN blocks ON item_id = query_id"""
)
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _chunks(spark, sf_dir).select("chunk_id", "content", "source")
    hits = _top(spark, sf_dir, 3).join(docs, "chunk_id").withColumns({"score": F.lit(1.0), "page": F.lit(0), "heading_path": F.lit(""), "version": F.lit(1)})
    out = prompt.assemble_prompts(_queries(spark, sf_dir), hits)
    return out.select("query_id", F.sha1(F.element_at("messages", -1)["content"]).alias("digest"), F.size("messages").alias("messages"))


@query()
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that the first piece of evidence gives; checked by tests, as SQL's regular expressions have no look-ahead."""
    docs = _chunks(spark, sf_dir).select("chunk_id", "content", "source")
    hits = _top(spark, sf_dir, 3).join(docs, "chunk_id").withColumns({"page": F.lit(0), "heading_path": F.lit(""), "version": F.lit(1)})
    out = prompt.assemble_prompts(_queries(spark, sf_dir), hits)
    return out.select("query_id", prompt.extractive_answer(F.col("messages")).alias("answer"))


# == quality ==
_HEALTH = """health AS (SELECT doc_id, lang, length(text) AS n,
  len(regexp_extract_all(text, '[^\\pL\\pM\\pN\\pPc\\s\\x{4e00}-\\x{9fff}，。；：、！？（）“”!$&''()*+,./<=>?@\\[\\]`{|}~%#"\\-\\\\^]'))::DOUBLE / nullif(length(text), 0) AS g,
  len(regexp_extract_all(text, '[A-Za-z]-\\n[A-Za-z]')) AS b FROM documents),
signal AS (SELECT doc_id, lang, n AS char_count, round(coalesce(g, 1), 4) AS garbled_ratio, b AS hyphen_breaks,
  CASE WHEN n < 10 THEN 0 ELSE round(greatest(0, 1 - least(0.5::DOUBLE, coalesce(g, 1) * 5) - least(0.2::DOUBLE, b * 0.01::DOUBLE)), 4) END AS health_score FROM health)"""


@query(f"WITH {_HEALTH} SELECT doc_id, char_count::INT AS char_count, garbled_ratio, hyphen_breaks::INT AS hyphen_breaks, health_score::DOUBLE AS health_score FROM signal")
def page_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.page_signals(table(spark, sf_dir, "documents")).select("doc_id", "char_count", "garbled_ratio", "hyphen_breaks", "health_score")


@query(
    f"""WITH {_HEALTH}, ranked AS (SELECT *, count(*) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY health_score, doc_id) AS r FROM signal)
SELECT doc_id, lang FROM ranked WHERE r <= least(total, greatest(30, ceil(total * 0.05::DOUBLE)))::BIGINT // 2"""
)
def qa_sample_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half of the review sample that goes by health; the other half is in hash order."""
    signals = quality.page_signals(table(spark, sf_dir, "documents"))
    return quality.plan_samples(signals, F.col("lang"), ["doc_id"]).filter("part = 'risk'").select("doc_id", "lang")


@query()
def qa_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of the review sample; SQL has no such hash, tests compare it with brute force."""
    signals = quality.page_signals(table(spark, sf_dir, "documents"))
    return quality.plan_samples(signals, F.col("lang"), ["doc_id"]).select("doc_id", "lang", "part")


@query(
    """WITH r AS (SELECT CASE WHEN quality = 1 THEN 0.995 ELSE 0.98 END AS a, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN toxic = 1 THEN 0.5 ELSE 0.95 END AS f FROM labels),
p AS (SELECT a >= 0.99 AND coalesce(f >= 0.9, true) AS ok FROM r)
SELECT count(*) AS sampled, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, round(avg(ok::INT), 4) AS pass_rate, round(avg(ok::INT), 4) >= 0.95 AS release_ok FROM p"""
)
def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "labels").select(
        F.when(F.col("quality") == 1, 0.995).otherwise(0.98).alias("char_accuracy"),
        F.when(F.col("doc_id") % 3 == 0, None).when(F.col("toxic") == 1, 0.5).otherwise(0.95).alias("table_f1"), F.lit(None).cast("double").alias("key_field_accuracy"),
    )
    return quality.review_report(results)


# == structure ==
_MARKUP = """concat('# Doc ', doc_id, chr(10), text, chr(10), '## ', source, chr(10), '| a | b |', chr(10), '| ', lang, ' | 2 |', chr(10), '```py', chr(10), '# not a heading', chr(10), '```', chr(10), '![', lang, '](x.png)')"""


def _markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a title, a section, a table, a code fence and an image around its text."""
    parts = [F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n## "), F.col("source"), F.lit("\n| a | b |\n| "), F.col("lang"), F.lit(" | 2 |\n```py\n# not a heading\n```\n!["), F.col("lang"), F.lit("](x.png)")]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"))


@query(
    f"""WITH lines AS (SELECT doc_id, unnest(string_split({_MARKUP}, chr(10))) AS line, unnest(range(len(string_split({_MARKUP}, chr(10))))) AS ln FROM documents),
f AS (SELECT *, regexp_matches(line, '^\\s*```\\w*\\s*$')::INT AS fence FROM lines), s AS (SELECT *, sum(fence) OVER (PARTITION BY doc_id ORDER BY ln) AS seen FROM f),
k AS (SELECT doc_id, CASE WHEN fence = 1 OR seen % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^#{{1,6}}\\s+') THEN 'heading' WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'table' WHEN regexp_matches(line, '^\\s*!\\[[^\\]]*\\]\\(\\S+\\)\\s*$') THEN 'image' ELSE 'text' END AS kind FROM s)
SELECT doc_id, kind, count(*) AS lines FROM k GROUP BY ALL"""
)
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.classify_lines(_markup(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("lines"))


@query(
    """SELECT doc_id, 'text' AS type, 'Doc ' || doc_id AS heading_path FROM documents WHERE regexp_matches(text, '\\S')
UNION ALL SELECT doc_id, unnest(['table', 'code', 'image']), 'Doc ' || doc_id || ' > ' || source FROM documents"""
)
def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.with_heading_path(blocks.parse_blocks(_markup(spark, sf_dir)))
    return found.filter("type <> 'heading'").select("doc_id", "type", "heading_path")


@query()
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure-aware chunks of all documents; the sequential packing has no SQL form and is compared with a scalar one in tests."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return chunks.chunk_documents(docs, chunks.ChunkPolicy(text_size=300, text_overlap=50)).select("chunk_id", "doc_id", "chunk_index", "content_hash", "token_count", "start_line", "end_line")


@query()
def parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    _, children = chunks.parent_child_chunks(docs)
    return children.select("chunk_id", "parent_id", "content_hash", "token_count")


def _pages(spark: SparkSession) -> DataFrame:
    """Three pages: two columns with a title, a full-width heading between bands, and a sparse page."""
    cases = {
        "two": [(40, 20, 560, 50), (330, 160, 550, 180), (40, 100, 260, 120), (330, 100, 550, 120), (40, 160, 260, 180)],
        "bands": [(330, 80, 550, 100), (40, 80, 260, 100), (40, 160, 560, 190), (40, 220, 260, 240), (330, 220, 550, 240)],
        "sparse": [(40, 80, 420, 100), (40, 140, 420, 160), (40, 200, 420, 220), (470, 90, 540, 110)],
    }
    rows = [(name, 1, 600.0, [(0, [float(v) for v in box], [([(f"{name} {i}", 10.0)],)]) for i, box in enumerate(boxes)]) for name, boxes in cases.items()]
    return spark.createDataFrame(rows, f"doc_id string, page int, width double, blocks {layout.RAW_BLOCKS}")


@query("SELECT * FROM (VALUES ('two', 0, 0), ('two', 1, 2), ('two', 2, 4), ('two', 3, 3), ('two', 4, 1), ('bands', 0, 1), ('bands', 1, 0), ('bands', 2, 2), ('bands', 3, 3), ('bands', 4, 4), ('sparse', 0, 0), ('sparse', 1, 3), ('sparse', 2, 1), ('sparse', 3, 2)) t(doc_id, read_ord, bid)")
def page_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(_pages(spark)).select("doc_id", F.col("read_ord").cast("int").alias("read_ord"), "bid")
