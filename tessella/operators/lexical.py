"""BM25 with phrase and metadata boosts, for a whole set of queries in one plan.

Only postings of query terms are built; statistics cover all chunks, whatever a filter keeps. Queries that have
phrases but match no posting are scored on boosts alone over all chunks, as the fallback demands.

No text is ever joined to a query. A phrase stands in a text where it stands inside a run of its kind of characters.
A search whose query side fits a task is scored in arrays, block by block (``lexical_blocks``). For a larger one
postings and boosts are small rows that lie by chunk, and phrases meet the distinct runs of the corpus once, by
equality of substrings.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import CJK, let, phrases, terms
from tessella.operators import lexical_blocks
from tessella.operators.filters import filter_column
from tessella.session import durable, ship_package

K1, B = 1.5, 0.75


#: Up to this many rows (a query and a term or phrase each) the query side is broadcast or held by each task; the rows are counted first.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class LexicalIndex:
    """postings(term, chunk_id, tf), chunk_stats(chunk_id, dl), term_stats(term, df), corpus_stats(n, avgdl)."""

    postings: DataFrame
    chunk_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame


def build_index(chunks: DataFrame, key: str = "chunk_id", content: str = "content") -> LexicalIndex:
    tokens = chunks.select(F.col(key).alias("chunk_id"), terms(content).alias("t"))
    stats = tokens.select("chunk_id", F.size("t").cast("bigint").alias("dl"))
    postings = _exploded(tokens, "t", "chunk_id").groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
    return _index(postings, stats)


def _exploded(df: DataFrame, array: str, *columns: str | Column, name: str = "term") -> DataFrame:
    """One row for each element. A plain explode makes the optimiser compute the array once more, to filter out empty ones."""
    return df.select(*columns, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def _index(postings: DataFrame, stats: DataFrame) -> LexicalIndex:
    freq = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return LexicalIndex(postings, stats, freq, stats.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")))


def store_index(index: LexicalIndex, path: str) -> None:
    """Write the postings in the order of their terms, so that a query's terms prune what is read, and all statistics."""
    index.postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    for name in ("chunk_stats", "term_stats", "corpus_stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "chunk_stats", "term_stats", "corpus_stats")))


def update_index(index: LexicalIndex, changed: DataFrame, removed: DataFrame | None = None) -> LexicalIndex:
    """The index after ``changed``(chunk_id, content) replaced chunks or came new and the ids of ``removed``(chunk_id) went.

    Only changed chunks are read as text; all other postings stay as they are. Store it elsewhere than the old one.
    """
    gone = changed.select("chunk_id") if removed is None else changed.select("chunk_id").unionByName(removed.select("chunk_id"))
    new = build_index(changed)
    left = lambda df: df.join(gone.distinct(), "chunk_id", "left_anti")
    return _index(left(index.postings).unionByName(new.postings), left(index.chunk_stats).unionByName(new.chunk_stats))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, term, qtf)."""
    found = queries.select(F.col(key).alias("query_id"), terms(text).alias("t"))
    return _exploded(found, "t", "query_id").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(qtf: Column, tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    length = F.when(avgdl > 0, dl / avgdl).otherwise(F.lit(0.0))
    return qtf * idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length))


def _weigh(wanted: DataFrame, freq: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, term, qtf, df, n, avgdl) of the terms that occur: one row for each query and term."""
    return wanted.join(freq, "term").crossJoin(F.broadcast(stats))


def _score(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, chunk_id, bm25) of ``postings``(chunk_id, dl, term, tf) that lie by chunk."""
    part = bm25(F.col("qtf"), F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"))
    return postings.join(weights, "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("bm25"))


def bm25_scores(index: LexicalIndex, wanted: DataFrame) -> DataFrame:
    """(query_id, chunk_id, bm25) of every chunk that shares a term with the query, from a stored index."""
    some = index.postings.join(wanted.select("term").distinct(), "term", "left_semi").join(index.chunk_stats, "chunk_id")
    return _score(some, _weigh(wanted, index.term_stats, index.corpus_stats))


def _length(c: str) -> Column:
    """How many terms a text has; without CJK characters that is a count of words."""
    return F.when(F.col(c).rlike(f"[{CJK}]"), F.size(terms(c))).otherwise(F.regexp_count(F.col(c), F.lit("[A-Za-z0-9_]+"))).cast("bigint")


def _postings(chunks: DataFrame, wanted: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(postings that lie by chunk, weights) of the wanted terms; every statistic counts all chunks."""
    stats = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(_length(content)), F.lit(0.0)).alias("avgdl"))
    tokens = chunks.select(F.col(key).alias("chunk_id"), terms(content).alias("t"))
    exploded = _exploded(tokens, "t", "chunk_id", F.size("t").cast("bigint").alias("dl"))
    few = wanted.count() <= BROADCAST_ROWS
    vocabulary = wanted.select("term").distinct()
    some = exploded.join(F.broadcast(vocabulary) if few else vocabulary, "term", "left_semi")
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = some.repartition(parts, "chunk_id").groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    weights = _weigh(wanted, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats)
    return postings, F.broadcast(weights) if few else weights


def bm25_search(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", content: str = "content", query_key: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, chunk_id, bm25) in one pass over the chunks: only occurrences of query terms are shuffled, once."""
    return _score(*_postings(chunks, query_terms(queries, query_key, query), key, content))


def phrase_boost(query_phrases: Column, content: Column, heading: Column, source: Column) -> Column:
    """Weight of each phrase by where it stands: content, heading (0.75), source (0.4, at most 1)."""

    def add(total: Column, p: Column) -> Column:
        w = F.lit(0.5) + F.least(F.length(p), F.lit(8)) * F.lit(0.35)
        zero = F.lit(0.0)
        return (
            total
            + F.when(F.contains(content, p), w).otherwise(zero)
            + F.when(F.contains(heading, p), w * F.lit(0.75)).otherwise(zero)
            + F.when(F.contains(source, p), F.least(w * F.lit(0.4), F.lit(1.0))).otherwise(zero)
        )

    return F.aggregate(query_phrases, F.lit(0.0), add)


def metadata_boost(query_tokens: Column, heading_terms: Column, source_terms: Column) -> Column:
    """4 per query term (repeats counted) among the heading's terms, 0.8 among the source's."""
    hit = lambda arr, w: lambda total, t: total + F.when(F.array_contains(arr, t), F.lit(w)).otherwise(F.lit(0.0))
    total = lambda arr, w: let(arr, lambda a: F.aggregate(query_tokens, F.lit(0.0), hit(a, w)))
    return total(heading_terms, 4.0) + total(source_terms, 0.8)


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _runs_of(c: str) -> Column:
    """Distinct runs of word characters and of CJK characters of a lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(f"([a-z0-9_]+|[{CJK}]+)"), F.lit(1)))


def phrases_in_runs(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run, p): which phrases of ``wanted``(p) stand in which of the distinct ``runs``(run), by equality of substrings."""
    lengths = sorted(r["n"] for r in wanted.select(F.length("p").alias("n")).distinct().collect())  # a few small numbers
    if not lengths:
        return runs.select("run", F.col("run").alias("p")).limit(0)
    parts = F.array_distinct(F.concat(*[F.regexp_extract_all("run", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]))
    return _exploded(runs.select("run", parts.alias("t")), "t", "run", name="p").join(wanted.select("p").distinct(), "p", "left_semi").select("run", "p")


def boosts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, chunk_id, boost, phrased) where there is any boost; the sums of ``phrase_boost`` and ``metadata_boost``.

    ``texts``: chunk_id and the lower-case c, h, s (content, heading, source); ``asked``: query_id, qt (terms), qp (phrases).
    """
    weight = F.lit(0.5) + F.least(F.length("f"), F.lit(8)) * F.lit(0.35)
    said = _exploded(asked, "qp", "query_id", name="f").withColumn("w", weight)
    token = _exploded(asked, "qt", "query_id", name="f").groupBy("query_id", "f").agg(F.count(F.lit(1)).alias("times"))
    per = [said.select("query_id", "f", F.lit(k).alias("kind"), w.alias("w")) for k, w in enumerate((F.col("w"), F.col("w") * 0.75, F.least(F.col("w") * 0.4, F.lit(1.0))))]
    per += [token.select("query_id", "f", F.lit(k).alias("kind"), (F.col("times") * w).alias("w")) for k, w in ((3, 4.0), (4, 0.8))]
    weights = reduce(DataFrame.unionByName, per)

    each = lambda kind, found: F.transform(found, lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("f")))
    runs = texts.select("chunk_id", F.concat(*[each(k, _runs_of(c)) for k, c in enumerate("chs")]).alias("t"))
    rows = _exploded(runs, "t", "chunk_id", name="x").select("chunk_id", "x.kind", F.col("x.f").alias("run"))
    known = phrases_in_runs(rows.select("run").distinct(), said.select(F.col("f").alias("p")))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    phrased = rows.join(known, "run").select("chunk_id", "kind", F.col("p").alias("f")).repartition(parts, "chunk_id").distinct()
    marks = texts.select("chunk_id", F.concat(each(3, F.array_distinct(terms("h"))), each(4, F.array_distinct(terms("s")))).alias("t"))
    named = _exploded(marks, "t", "chunk_id", name="x").select("chunk_id", "x.kind", "x.f")
    few = weights.count() <= BROADCAST_ROWS

    def add(found: DataFrame, phrase: bool) -> DataFrame:
        mine = weights.filter(F.col("kind") < 3 if phrase else F.col("kind") >= 3)
        sums = found.join(F.broadcast(mine) if few else mine, ["kind", "f"]).groupBy("query_id", "chunk_id").agg(F.sum("w").alias("boost"))
        return sums.withColumn("phrased", F.lit(phrase))

    both = add(phrased, True).unionByName(add(named, False))
    return both.groupBy("query_id", "chunk_id").agg(F.sum("boost").alias("boost"), F.max("phrased").alias("phrased"))


def lexical_search(chunks: DataFrame, queries: DataFrame, top_k: int, conditions: Mapping[str, Any] | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): BM25 plus boosts; only positive scores; ties by chunk id.

    ``chunks``: chunk_id, content, heading_path, source and what the filter names. ``queries``: query_id, query.
    ``digits`` rounds scores before they are ranked, so that sums added up in another order still tie.
    """
    if top_k <= 0:
        return chunks.sparkSession.createDataFrame([], "query_id string, chunk_id string, score double, rank int")
    asked = queries.select("query_id", phrases("query").alias("qp"))
    wanted, said = _held(query_terms(queries)), _held(_exploded(asked, "qp", "query_id", name="p"))
    if wanted is not None and said is not None and wanted.num_rows + said.num_rows:
        hits = _block_hits(chunks, wanted, said, queries.schema["query_id"].dataType.simpleString(), top_k, conditions, 0.0 if digits is None else 10.0**-digits)
    else:
        hits = _joined_hits(chunks, queries, conditions)
    both = hits.filter("score > 0")
    return rank_hits(both if digits is None else both.withColumn("score", F.round("score", digits)), top_k)


def _held(rows: DataFrame) -> pa.Table | None:
    """Rows of the query side, unless they are too many for a task."""
    found = rows.limit(BROADCAST_ROWS + 1).toArrow()
    return found if found.num_rows <= BROADCAST_ROWS else None


def _block_hits(chunks: DataFrame, wanted: pa.Table, said: pa.Table, query_kind: str, top_k: int, conditions: Mapping[str, Any] | None, slack: float) -> DataFrame:
    """(query_id, chunk_id, score) of ``wanted``(query_id, term, qtf) and ``said``(query_id, p), with all that may be among the ``top_k``."""
    ship_package(chunks.sparkSession)
    key = chunks.schema["chunk_id"].dataType.simpleString()
    query_type = wanted.schema.field("query_id").type
    ids = pa.chunked_array([*wanted["query_id"].chunks, *said["query_id"].chunks], query_type).unique()
    words, texts = (pa.chunked_array(c.chunks, pa.string()).unique() for c in (wanted["term"], said["p"]))
    place = lambda column, values: pc.index_in(column, value_set=values).to_numpy().astype(np.int64)

    ok = F.coalesce(filter_column(chunks, conditions), F.lit(False)) if conditions else F.lit(True)
    low = chunks.select("chunk_id", "content", ok.alias("ok"), _low("content").alias("c"), _low("heading_path").alias("h"), _low("source").alias("s"))
    mine = lambda c: F.when(F.col("ok"), c)
    # Words are runs as they are, but for CJK runs and the two letters whose lower case has an ASCII letter.
    own = F.when(F.col("ok") & F.col("content").rlike(f"[{CJK}\\u0130\\u212a]"), _runs_of("c"))
    marks = [mine(F.array_distinct(terms(c))).alias(f"{c}t") for c in "hs"]
    cut = low.select("chunk_id", "ok", terms("content").alias("t"), own.alias("r"), *[mine(_runs_of(c)).alias(c) for c in "hs"], *marks)
    stored = durable(cut.mapInArrow(lexical_blocks.cutter(words, lexical_blocks.Trie.of(texts.to_pylist()), len(texts)), f"chunk_id {key}, {lexical_blocks.POSTINGS}"))

    totals = stored.filter("n is not null")
    n, avgdl = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("dl") / F.sum("texts"), F.lit(0.0))).collect()[0]
    per = totals.select(F.explode(F.arrays_zip("ids", "tf")).alias("x")).groupBy("x.ids").agg(F.sum("x.tf").alias("df")).toArrow()
    df = np.zeros(len(words))
    df[per["ids"].to_numpy()] = per["df"].to_numpy()

    query, term, qtf = place(wanted["query_id"], ids), place(wanted["term"], words), wanted["qtf"].to_numpy()
    there = df[term] > 0
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    scores = lexical_blocks.Weights.of(term[there], query[there], (qtf * idf[term])[there], len(words))
    rest = np.bincount(query[there], minlength=len(ids)) == 0  # no posting at all (before the filter)
    asker, phrase = place(said["query_id"], ids), place(said["p"], texts)
    w = 0.5 + np.minimum(np.array([len(p) for p in texts.to_pylist()], float), 8) * 0.35
    per_kind = [(phrase + k * len(texts), asker, weight[phrase]) for k, weight in enumerate((w, w * 0.75, np.minimum(w * 0.4, 1.0)))]
    per_kind += [(term + 3 * len(texts) + k * len(words), query, qtf * weight) for k, weight in enumerate((4.0, 0.8))]
    features = lexical_blocks.Weights.of(*(np.concatenate(x) for x in zip(*per_kind, strict=True)), 3 * len(texts) + 2 * len(words))

    def saturate(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * (dl / avgdl if avgdl > 0 else 0.0)))

    score = lexical_blocks.scorer(ids, scores, features, 3 * len(texts), rest, saturate, top_k, slack)
    kinds = f"query_id {query_kind}, chunk_id {key}, score double"
    return stored.filter("n is null").select("chunk_id", "dl", "ids", "tf", "features").mapInArrow(score, kinds)


def _joined_hits(chunks: DataFrame, queries: DataFrame, conditions: Mapping[str, Any] | None) -> DataFrame:
    """(query_id, chunk_id, score) of all hits, by joins of rows."""
    postings, weights = _postings(chunks, query_terms(queries), "chunk_id", "content")
    allowed = chunks.filter(filter_column(chunks, conditions)) if conditions else chunks
    asked = queries.select("query_id", terms("query").alias("qt"), phrases("query").alias("qp"))
    extra = boosts(allowed.select("chunk_id", _low("content").alias("c"), _low("heading_path").alias("h"), _low("source").alias("s")), asked)
    scored = _score(postings.join(allowed.select("chunk_id"), "chunk_id", "left_semi") if conditions else postings, weights)
    found = scored.join(extra, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", (F.col("bm25") + F.coalesce("boost", F.lit(0.0))).alias("score"))
    # No posting at all (before the filter): every chunk with one of the phrases may still earn boosts.
    rest = queries.select("query_id").join(weights.select("query_id").distinct(), "query_id", "left_anti")
    fallback = extra.filter("phrased").join(rest, "query_id", "left_semi").select("query_id", "chunk_id", F.col("boost").alias("score"))
    return found.unionByName(fallback)


def rank_hits(hits: DataFrame, top_k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Add the 1-based rank by score, then chunk id, and keep ``top_k`` (limited on both sides of the shuffle)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
