"""Entry plans: index a source, answer a set of queries, evaluate them, or all of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import evaluation, fusion, lexical, prompt, rerank, sync, vector
from tessella.operators.chunks import ChunkPolicy, chunk_documents, parent_child_chunks
from tessella.operators.filters import apply_filter, with_default
from tessella.plans.settings import Settings, provider
from tessella.session import durable, ship_package
from tessella.sources.datasets import read_labelled_queries
from tessella.sources.files import read_documents
from tessella.sources.snapshots import SnapshotStore

_META = ("source", "version", "is_latest", "acl", "updated_at")


def build_chunks(docs: DataFrame, settings: Settings, acl: Sequence[str] | None = None, now: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """(chunks without vectors, parents or None) of ``docs``(doc_id, text, version)."""
    parents = None
    if settings.parent_child:
        parents, chunks = parent_child_chunks(docs)
    else:
        chunks = chunk_documents(docs, ChunkPolicy(text_size=settings.text_size, text_overlap=settings.text_overlap)).withColumns({"parent_id": F.lit(None).cast("string"), "is_parent": F.lit(None).cast("boolean")})
    allowed = F.array(*[F.lit(a) for a in (acl or [settings.acl])])

    def tagged(df: DataFrame) -> DataFrame:
        return df.join(docs.select("doc_id", "version"), "doc_id").withColumns({"source": F.col("doc_id"), "is_latest": F.lit(True), "acl": allowed, "updated_at": F.lit(now).cast("bigint")})

    return tagged(chunks), tagged(parents) if parents is not None else None


@dataclass
class IndexResult:
    report: dict[str, Any]
    chunk_count: int
    document_count: int


class KnowledgeBase:
    """A snapshot store with its settings; one chunk table feeds both channels."""

    def __init__(self, spark: SparkSession, settings: Settings) -> None:
        ship_package(spark)
        self.spark, self.settings = spark, settings.checked()
        self.store = SnapshotStore(spark, self.settings.store)
        self.provider = provider(self.settings.provider)

    # == indexing ==
    def sync(self, docs: DataFrame, acl: Sequence[str] | None = None, now: int = 0) -> IndexResult:
        """Bring the store in line with ``docs``(doc_id, text): only new and changed documents are chunked and embedded."""
        docs = durable(docs.select("doc_id", "text"))
        manifest = self.store.manifest()
        return self._apply(docs, sync.diff_manifest(docs, manifest), manifest, acl, now)

    def apply_changes(self, changes: DataFrame, acl: Sequence[str] | None = None, now: int = 0) -> IndexResult:
        """As ``sync`` for ``changes``(doc_id, text, deleted) only; documents that they don't name stay."""
        changes = durable(changes.select("doc_id", "text", "deleted"))
        manifest = self.store.manifest()
        live = changes.filter(~F.col("deleted") & F.col("text").isNotNull()).select("doc_id", "text")
        named = manifest.join(changes.select("doc_id"), "doc_id", "left_semi")
        rest = manifest.join(changes.select("doc_id"), "doc_id", "left_anti")
        same = rest.select("doc_id", F.lit("SKIP").alias("action"), "source_hash", "version", F.col("version").alias("previous_version"))
        return self._apply(live, sync.diff_manifest(live, named).unionByName(same), manifest, acl, now)

    def _apply(self, docs: DataFrame, diff: DataFrame, manifest: DataFrame, acl: Sequence[str] | None, now: int) -> IndexResult:
        diff = durable(diff)
        changed = docs.join(diff.filter("action in ('ADD', 'UPD')").select("doc_id", "version"), "doc_id")
        fresh, parents = build_chunks(changed, self.settings, acl, now)
        fresh = durable(fresh)
        stored, old_parents = self.store.read("chunks"), self.store.read("parents") if self.settings.parent_child else None
        old = fresh.withColumn("vector", F.lit(None).cast("array<double>")).limit(0) if stored is None else stored
        embed = self.provider.require_embed()
        # What a document held before keeps its vector; only new content is embedded.
        known = sync.reuse_vectors(fresh, old)
        embedded = known.withColumn("vector", F.coalesce("vector", embed(F.col("content"), self.settings.embedding_dim)))
        report = sync.sync_report(diff, old, fresh).collect()[0].asDict()
        target, before = self.store.begin(), self.store.current()
        sync.replace_documents(old, embedded.select(*old.columns), diff).write.parquet(f"{target}/chunks")
        if parents is not None:
            (parents if old_parents is None else sync.replace_documents(old_parents, parents.select(*old_parents.columns), diff)).write.parquet(f"{target}/parents")
        sync.next_manifest(diff, manifest, now).write.parquet(f"{target}/manifest")
        self.store.publish(target, before)
        return IndexResult(report, self.chunk_count(), self.store.manifest().count())

    def index(self, source: str, acl: Sequence[str] | None = None, reset: bool = False, now: int = 0) -> IndexResult:
        if reset:
            self.store.reset()
        return self.sync(read_documents(self.spark, source), acl, now)

    def chunk_count(self) -> int:
        chunks = self.store.read("chunks")
        return 0 if chunks is None else chunks.count()

    # == retrieval ==
    def _chunks(self) -> DataFrame:
        chunks = self.store.read("chunks")
        if chunks is None:
            raise ValueError("nothing is indexed yet")
        return chunks

    def retrieve(self, queries: DataFrame, conditions: Mapping[str, Any] | None = None, candidates: int | None = None, default_filter: bool = True) -> DataFrame:
        """Fused candidates of ``queries``(query_id, query) with the chunks' columns."""
        chunks = self._chunks()
        k = max(self.settings.candidates, candidates or 0)
        filters = with_default(conditions) if default_filter else dict(conditions or {})
        asked = queries.withColumn("vector", self.provider.require_embed()(F.col("query"), self.settings.embedding_dim))
        near = vector.vector_search(chunks, asked, k, filters)
        found = lexical.lexical_search(chunks, queries, k, filters)
        fused = fusion.hybrid(near, found, chunks, k)
        out = fused.drop("source").join(chunks.drop("vector"), "chunk_id")
        if self.settings.parent_child:
            parents = self.store.read("parents")
            wide = fusion.expand_parents(out, parents, k)
            return wide.join(parents.drop("content").unionByName(chunks.drop("vector", "content"), allowMissingColumns=True).dropDuplicates(["chunk_id"]), "chunk_id")
        return out

    def rerank(self, hits: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
        s = self.settings
        options: dict[str, Any] = {} if s.reranker not in ("pairs", "late") else {"weight": s.relevance_weight, "raw_weight": s.raw_weight}
        if s.reranker == "late":
            options |= {"query_tokens": s.late_query_tokens, "chunk_tokens": s.late_chunk_tokens, "dim": s.late_dim}
        return rerank.rerank(hits, queries, top_k, s.reranker, **options)

    def ask(self, queries: DataFrame, top_k: int | None = None, conditions: Mapping[str, Any] | None = None) -> DataFrame:
        """(query_id, query, answer, messages, contexts) of all queries in one plan; ``history`` may be a column of them."""
        k = top_k or self.settings.top_k
        plain = queries.select("query_id", "query")
        hits = durable(self.rerank(self.retrieve(plain, conditions, k), plain, k))
        prompts = prompt.assemble_prompts(queries, hits)
        shown = prompt.answer_contexts(hits)
        listed = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("rank", "source", "score", "chunk_id", "page", "heading_path", "preview")]))).alias("contexts"))
        answered = prompts.withColumn("answer", self.provider.require_answer()(F.col("messages")))
        return plain.join(answered, "query_id").join(listed, "query_id", "left")

    def evaluate(self, labelled: DataFrame, ks: Sequence[int] = (1, 3, 5), conditions: Mapping[str, Any] | None = None) -> DataFrame:
        """Retrieval reports of ``labelled``(query_id, query, relevant_*); no answers are made."""
        chosen = evaluation.valid_ks(ks)
        if not chosen:
            raise ValueError("at least one K must be positive")
        plain = labelled.select("query_id", "query")
        wide = max(self.settings.candidates, max(chosen))
        hits = self.rerank(self.retrieve(plain, conditions, wide), plain, wide)
        labels = labelled.select("query_id", "relevant_sources", "relevant_doc_ids", "relevant_chunk_ids")
        some = F.size("relevant_sources") + F.size("relevant_doc_ids") + F.size("relevant_chunk_ids") > 0
        return evaluation.retrieval_report(evaluation.mark_relevant(hits, labels), labelled.withColumn("labelled", some), chosen)


def one_query(spark: SparkSession, query: str) -> DataFrame:
    if not query or not query.strip():
        raise ValueError("a query is required")
    return spark.createDataFrame([("1", query.strip())], "query_id string, query string")


def run_index(spark: SparkSession, source: str, settings: Settings, **options: Any) -> IndexResult:
    return KnowledgeBase(spark, settings).index(source, **options)


def run_query(spark: SparkSession, query: str, settings: Settings, top_k: int | None = None, conditions: Mapping[str, Any] | None = None) -> dict[str, Any]:
    return KnowledgeBase(spark, settings).ask(one_query(spark, query), top_k, conditions).collect()[0].asDict(True)


def run_evaluation(spark: SparkSession, settings: Settings, query: str | None = None, dataset: str | None = None, labels: Mapping[str, Sequence[str]] | None = None, ks: Sequence[int] = (1, 3, 5)) -> dict[str, Any]:
    """Reports and their summary, for one query with labels or for a data set (exactly one of them)."""
    if (query is None) == (dataset is None):
        raise ValueError("either a query or a data set is needed")
    if dataset is not None:
        items = read_labelled_queries(spark, dataset)
    else:
        given = [list((labels or {}).get(k, [])) for k in ("relevant_sources", "relevant_doc_ids", "relevant_chunk_ids")]
        items = one_query(spark, query or "").join(
            spark.createDataFrame([("1", *given)], "query_id string, relevant_sources array<string>, relevant_doc_ids array<string>, relevant_chunk_ids array<string>"), "query_id"
        )
    reports = durable(KnowledgeBase(spark, settings).evaluate(items, ks))
    return {"reports": [r.asDict(True) for r in reports.orderBy("query_id").collect()], "summary": evaluation.summarise_reports(reports, ks).collect()[0].asDict(True)}


def run_all(spark: SparkSession, source: str, query: str, settings: Settings, **evaluation_options: Any) -> dict[str, Any]:
    """Index, ask and, if labels or a data set are given, evaluate."""
    out: dict[str, Any] = {"index": run_index(spark, source, settings), "query": run_query(spark, query, settings)}
    if evaluation_options:
        out["evaluation"] = run_evaluation(spark, settings, **({"query": query} if "dataset" not in evaluation_options else {}), **evaluation_options)
    return out
