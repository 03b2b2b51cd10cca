"""Second-stage ranking: lexical pair scoring, late interaction and their registry."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import CJK, compact, let, phrases, terms
from tessella.functions.vectors import digest_embedding
from tessella.operators.best import Best
from tessella.session import ship_package

#: Numbers of query vectors that travel in a closure at once; tasks for each core; inner products closer than SLACK may tie in 6 digits.
BROADCAST_NUMBERS, TASKS_PER_CORE, SLACK = 4_000_000, 3, 4e-6

_ASKING = "吗 呢 几 哪些 哪个 多久 多少 是否 如何 怎么 什么".split()
_ALIASES = {"代理": "agent", "智能体": "agent", "系统": "system", "记忆": "memory"}


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def is_noise(term: Column) -> Column:
    """Interrogative fragments say nothing about evidence."""
    asking = term.rlike("|".join(_ASKING))
    return (term == "") | asking | (term.rlike(f"[{CJK}]") & F.contains(term, F.lit("是")) & (F.length(term) > 1))


def query_profile(queries: DataFrame, query: str = "query") -> DataFrame:
    """Add q_terms (aliases included), q_phrases and q_compact."""
    alias = F.create_map(*[F.lit(x) for p in _ALIASES.items() for x in p])
    kept = F.filter(terms(query), lambda t: ~is_noise(t))
    wide = F.flatten(F.transform(kept, lambda t: F.when(t.isin(*_ALIASES), F.array(t, F.element_at(alias, t))).otherwise(F.array(t))))
    return queries.select(
        "*", F.array_distinct(wide).alias("q_terms"), F.filter(phrases(query), lambda p: ~is_noise(p)).alias("q_phrases"), compact(query).alias("q_compact")
    )


def _weight(t: Column) -> Column:
    return F.lit(1.0) + F.least(F.length(t), F.lit(8)) * F.lit(0.12)


def _share(items: Column, value: Callable[[Column], Column]) -> Column:
    """Weighted mean of ``value`` over the items; 0 for none."""
    total = F.aggregate(items, F.lit(0.0), lambda s, t: s + _weight(t))
    got = F.aggregate(items, F.lit(0.0), lambda s, t: s + _weight(t) * value(t))
    return F.when(total > 0, clamp(got / total)).otherwise(F.lit(0.0))


def _flag(c: Column) -> Column:
    return c.cast("double")


def pair_score(q_terms: Column, q_phrases: Column, q_compact: Column, content: Column, heading: Column, source: Column) -> Column:
    """Relevance of a text to a query between 0 and 1, from lower-cased content, heading and source.

    A term among the words of the text is contained in the text as well, so containment decides.
    """

    def score(t: Column) -> Column:
        body, head, name, meta, everything = (t[k] for k in ("c", "h", "s", "meta", "all"))
        term = _share(q_terms, lambda x: _flag(F.contains(everything, x)))
        phrase = _share(q_phrases, lambda p: F.when(F.contains(body, p), 1.0).when(F.contains(head, p), 0.95).when(F.contains(name, p), 0.55).otherwise(0.0))
        in_meta = lambda items: _share(items, lambda x: _flag(F.contains(meta, x)))
        metadata = F.when(meta == "", 0.0).otherwise(F.greatest(in_meta(q_terms), in_meta(q_phrases)))
        latin = F.filter(q_terms, lambda x: ~x.rlike(f"[{CJK}]"))
        spaced = terms(F.replace(name, F.lit("-"), F.lit(" ")))
        named = F.when(name == "", 0.0).otherwise(let(spaced, lambda words: _share(latin, lambda x: _flag(F.array_contains(words, x) | F.contains(name, x)))))
        exact = F.when((F.length(q_compact) >= 4) & F.contains(compact(everything), q_compact), 1.0).otherwise(0.0)
        return let(
            F.struct(term.alias("t"), phrase.alias("p")),
            lambda v: F.round(
                clamp(
                    v["t"] * F.lit(0.41) + v["p"] * F.lit(0.30) + metadata * F.lit(0.14) + named * F.lit(0.10) + exact * F.lit(0.05)
                    + F.when(v["t"] >= 0.60, 0.06).otherwise(0.0) + F.when(v["p"] >= 0.40, 0.04).otherwise(0.0)
                ),
                6,
            ),
        )

    def widen(t: Column) -> Column:
        meta = F.trim(F.concat(t["h"], F.lit(" "), t["s"]))
        return let(meta, lambda m: let(F.struct(t["c"].alias("c"), t["h"].alias("h"), t["s"].alias("s"), m.alias("meta"), F.trim(F.concat(t["c"], F.lit(" "), m)).alias("all")), score))

    return let(F.struct(content.alias("c"), heading.alias("h"), source.alias("s")), widen)


def normalised_raw(score: Column, keys: tuple[str, ...] = ("query_id",)) -> Column:
    """Scores of a candidate list on 0..1; a list of equal scores is all 1 if positive, else 0."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    flat = F.abs(high - low) <= F.lit(1e-9) * F.greatest(F.abs(high), F.abs(low))
    return F.when(flat, F.when(score > 0, 1.0).otherwise(0.0)).otherwise(clamp((score - low) / (high - low)))


def order_by_relevance(hits: DataFrame, relevance: Column, top_k: int, weight: float = 0.95, raw_weight: float = 0.05) -> DataFrame:
    """Combine relevance with the normalised first-stage score; ties by that score, then by the first-stage rank."""
    scored = hits.withColumn("__raw", normalised_raw(F.col("score"))).withColumn("__new", F.round(clamp(clamp(relevance) * F.lit(weight) + clamp(F.col("__raw")) * F.lit(raw_weight)), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("__new"), F.desc("__raw"), "rank")
    ranked = scored.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= top_k)
    return ranked.withColumn("score", F.col("__new")).withColumn("rank", F.col("__rank")).drop("__raw", "__new", "__rank")


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def rerank_pairs(hits: DataFrame, queries: DataFrame, top_k: int, weight: float = 0.95, raw_weight: float = 0.05) -> DataFrame:
    """``hits``: query_id, chunk_id, score, rank, content, heading_path, source."""
    asked = query_profile(queries.select("query_id", "query")).drop("query")
    joined = hits.join(asked, "query_id")
    relevance = pair_score(F.col("q_terms"), F.col("q_phrases"), F.col("q_compact"), _low("content"), _low("heading_path"), _low("source"))
    return order_by_relevance(joined.withColumn("__rel", relevance), F.col("__rel"), top_k, weight, raw_weight).drop("__rel", "q_terms", "q_phrases", "q_compact")


def late_text(content: Column, heading: Column, source: Column, doc_id: Column) -> Column:
    part = lambda c: F.nullif(F.coalesce(c.cast("string"), F.lit("")), F.lit(""))
    return F.concat_ws(" ", part(content), part(heading), part(source), part(doc_id))


def token_matrix(texts: DataFrame, key: str, text: Column, most: int) -> DataFrame:
    """(key, pos, token): the first ``most`` distinct terms."""
    return texts.select(key, F.posexplode(F.slice(F.array_distinct(terms(text)), 1, most)).alias("pos", "token"))


def max_sim(query_tokens: DataFrame, chunk_tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, chunk_id, sim): the mean over query vectors of the best inner product, on 0..1.

    ``query_tokens``(query_id, qpos, qv) and ``chunk_tokens``(chunk_id, v) hold unit vectors; ``pairs``(query_id, chunk_id)
    are the candidates. The vectors of a side become one matrix, bounded by its token limit; products run in Arrow batches.
    """

    @F.pandas_udf("double")
    def best(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([(np.stack(a) @ np.stack(b).T).max(axis=1).mean() for a, b in zip(q, d, strict=True)])

    left = query_tokens.groupBy("query_id").agg(F.collect_list("qv").alias("q"))
    right = chunk_tokens.groupBy("chunk_id").agg(F.collect_list("v").alias("d"))
    met = pairs.join(left, "query_id").join(right, "chunk_id")
    return met.select("query_id", "chunk_id", F.round(clamp((best("q", "d") + 1) / 2), 6).alias("sim"))


def max_sim_all(query_tokens: DataFrame, chunk_tokens: DataFrame, query_block: int = 256, chunk_block: int = 1024) -> DataFrame:
    """As ``max_sim``, of every query with every chunk: blocks of both sides meet, each pair of blocks in products."""
    return _block_sims(query_tokens, chunk_tokens, None, query_block, chunk_block)


def max_sim_top(query_tokens: DataFrame, chunk_tokens: DataFrame, top_k: int, query_block: int = 256, chunk_block: int = 1024) -> DataFrame:
    """The rows of ``max_sim_all`` that may be among the ``top_k`` of a query by sim, then by chunk id: each task returns its own."""
    return _block_sims(query_tokens, chunk_tokens, top_k, query_block, chunk_block)


def _block_sims(query_tokens: DataFrame, chunk_tokens: DataFrame, top_k: int | None, query_block: int, chunk_block: int) -> DataFrame:
    """Queries travel in the tasks' closures, up to ``BROADCAST_NUMBERS`` at once; chunks stream past them."""
    spark = chunk_tokens.sparkSession
    ship_package(spark)
    held = lambda tokens, key, value: tokens.groupBy(key).agg(F.collect_list(value).alias("m")).filter(F.size("m") > 0).select(key, F.size("m").alias("n"), F.flatten("m").alias("m"))
    asked = held(query_tokens, "query_id", "qv").toArrow().combine_chunks()
    kinds = f"query_id {query_tokens.schema['query_id'].dataType.simpleString()}, chunk_id {chunk_tokens.schema['chunk_id'].dataType.simpleString()}, sim double"
    # Each task returns its own best of every query, so there are no more tasks than keep the cores busy, however large the input.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    chunks = held(chunk_tokens.repartition(max(1, parts), "chunk_id"), "chunk_id", "v")

    def steps() -> Iterator[pa.Table]:
        total = np.cumsum(pc.list_value_length(asked["m"]).to_numpy()) // BROADCAST_NUMBERS
        for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), len(total)]):
            yield asked.slice(a, b - a)

    found = [chunks.mapInArrow(_sims_of(q, top_k, query_block, chunk_block), kinds) for q in steps() if q.num_rows]
    met = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kinds)
    return met.withColumn("sim", F.round(clamp((F.col("sim") + 1) / 2), 6))


def _stacked(n: np.ndarray, m: pa.Array, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors by position and item) of blocks of items that have equally many vectors."""
    values = m.flatten().to_numpy(zero_copy_only=False)
    if not len(n):
        return
    width = len(values) // int(n.sum())
    first = np.cumsum(n) - n
    rows = values.reshape(-1, width)
    for count in np.unique(n):
        same = np.flatnonzero(n == count)
        for i in range(0, len(same), block):
            at = same[i : i + block]
            yield at, np.stack([rows[first[at] + k] for k in range(count)])


def _sims_of(asked: pa.Table, top_k: int | None, query_block: int, chunk_block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    ids = asked["query_id"].combine_chunks()
    queries = list(_stacked(asked["n"].to_numpy(), asked["m"].combine_chunks(), query_block))
    names = ["query_id", "chunk_id", "sim"]

    def sims(q: np.ndarray, d: np.ndarray) -> np.ndarray:
        total = np.zeros((q.shape[1], d.shape[1]))
        for one in q:
            best = one @ d[0].T
            for other in d[1:]:
                np.maximum(best, one @ other.T, out=best)
            total += best
        total /= len(q)
        if np.isnan(total.sum()):
            total[np.isnan(total)] = 1.0  # what the clamp makes of it
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), top_k, SLACK) if top_k else None
        for batch in batches:
            for at, d in _stacked(batch["n"].to_numpy(), batch["m"], chunk_block):
                chunk = batch["chunk_id"].take(pa.array(at))
                for query, q in queries:
                    sim = sims(q, d)
                    if best:
                        best.add(query, chunk, sim)
                    else:
                        of, to = np.divmod(np.arange(sim.size), len(at))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(query[of])), chunk.take(pa.array(to)), pa.array(sim.ravel())], names)
        if best and best.held:
            query, chunk, sim = best.cut()
            for i in range(0, len(query), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query[part])), chunk[part], pa.array(sim[part])], names)

    return run


def rerank_late(hits: DataFrame, queries: DataFrame, top_k: int, weight: float = 0.95, raw_weight: float = 0.05, query_tokens: int = 32, chunk_tokens: int = 180, dim: int = 64) -> DataFrame:
    """Late interaction over hashed token vectors; every distinct token is embedded once."""
    q = token_matrix(queries, "query_id", F.col("query"), max(1, query_tokens)).withColumnRenamed("pos", "qpos")
    texts = hits.select("chunk_id", late_text(F.col("content"), F.col("heading_path"), F.col("source"), F.col("doc_id")).alias("t")).dropDuplicates(["chunk_id"])
    d = token_matrix(texts, "chunk_id", F.col("t"), max(1, chunk_tokens)).drop("pos")
    vectors = q.select("token").union(d.select("token")).distinct().withColumn("v", digest_embedding("token", max(2, dim)))
    sims = max_sim(q.join(vectors, "token").select("query_id", "qpos", F.col("v").alias("qv")), d.join(vectors, "token").select("chunk_id", "v"), hits.select("query_id", "chunk_id"))
    joined = hits.join(sims, ["query_id", "chunk_id"], "left").fillna(0.0, ["sim"])
    return order_by_relevance(joined, F.col("sim"), top_k, weight, raw_weight).drop("sim")


def keep_first(hits: DataFrame, queries: DataFrame, top_k: int, **_: object) -> DataFrame:
    return hits.filter(F.col("rank") <= top_k)


_NAMES = {"ce": "pairs", "crossencoder": "pairs", "cross_encoder": "pairs", "pairs": "pairs", "colbert": "late", "late": "late", "off": "none", "none": "none", "no_rerank": "none", "bi_encoder": "none"}
RERANKERS: dict[str, Callable[..., DataFrame]] = {"pairs": rerank_pairs, "late": rerank_late, "none": keep_first}


def _key(name: str) -> str:
    return name.replace("-", "_").lower().strip()


def register_reranker(name: str, reranker: Callable[..., DataFrame]) -> None:
    """Add a reranker (hits, queries, top_k) -> hits under its own name."""
    key = _key(name)
    RERANKERS[key] = reranker
    _NAMES[key] = key


def reranker_name(name: str | None) -> str:
    key = _key(name or "cross_encoder")
    if key not in _NAMES:
        raise ValueError(f"unknown reranker {name!r}; known: {', '.join(sorted(_NAMES))}")
    return _NAMES[key]


def rerank(hits: DataFrame, queries: DataFrame, top_k: int, backend: str | None = None, **options: object) -> DataFrame:
    if top_k <= 0:
        return hits.limit(0)
    return RERANKERS[reranker_name(backend)](hits, queries, top_k, **options)
