"""A corpus pipeline of five stages, each by one operator of ``tessella.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next
stage's documents. All but the last return the columns of their input, extra columns included.

Defined results, for every stage: a null text is the empty text but stays null where it is kept; a null id or source is
a value like any other; rows that repeat are one document to the near-duplicate stage and documents of their own to the
others; an empty table stays empty. A stage's tables stay in the shared folder until its result is no longer read:
``run`` removes those of each stage once the next has its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import mixing, nearcopies, packing, secrets, toxicity
from tessella.llm.common import equal_groups, expand_groups, fresh, group_sizes, number_groups
from tessella.llm.queries import vocabulary
from tessella.session import discard, durable, keep, scratch, ship_package, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the documents that are left and their labels.

    A document without text stays, unless most labels say toxic; a repeated row stays or goes with its like; without
    labels of both kinds the score is their share, so none goes where none is toxic.
    """
    ship_package(spark)
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return docs.withColumn(score, toxicity.toxicity_score(model, "text")).filter(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest id stays, once.

    Candidates meet in the balls of op4's fingerprints, taken over five words, and those further apart in MinHash bands;
    both are verified. Texts without words, null ones included, are copies of one another; of rows with the same id and text the first by
    its other columns stays; of different texts under the smallest id the one of the smallest hash.
    """
    content = fresh(docs, "content")
    text = F.coalesce("text", F.lit(""))
    hashed = docs.withColumn(content, F.xxhash64(text))
    keyed = hashed.select("doc_id", F.struct(F.col("doc_id"), F.col(content).alias("content")).alias("row"), "text")
    rows = durable(nearcopies.band_rows(keyed, key="row"))
    grouped = nearcopies.assign_near_copies(rows, keyed, key="row")
    least = grouped.groupBy(F.col("component.doc_id").alias("i"), F.col("component.content").alias("c")).agg(F.count(F.lit(1)).alias("members"))
    # The member of a group that stays is its smallest (doc_id, content); of its repeated rows each task passes one on.
    kept = hashed.join(least, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col(content) == F.col("c")), "left_semi")
    one = fresh(kept, "one")
    others = [c for c in docs.columns if c != "text"]
    kept = kept.withColumn(one, F.row_number().over(Window.partitionBy("doc_id", content).orderBy(*others)))
    return kept.filter(F.col(one) == 1).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked where they stand; every document stays, a text without secrets as it is, and n_chars follows a changed text."""
    model = secrets.train_markov(secrets.labelled_samples(docs))
    base, spans = fresh(docs, "base"), fresh(docs, "spans")
    found = secrets.scan_secrets(docs, model, base=base, spans=spans)
    masked = found.withColumn("text", secrets.redact(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it: not at all, once or twice.

    Rows equal in id, source and size are interchangeable for the mix, so only the number of takes of each count (at
    most three counts) goes back to them; they get them in the order of a hash of the row, equal rows as one group.
    """
    mixed = mixing.mix_rows(mixing.count_rows(docs))
    once, twice = (F.sum((F.col("takes") == n).cast("bigint")) for n in (1, 2))
    dealt = durable(mixed.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"), once.alias("once"), twice.alias("twice")))
    size, copies = fresh(docs, "size"), fresh(docs, "copies")
    sized = docs.withColumn(size, mixing.word_count("text"))
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col(f"d.{size}") == F.col("m.size"))

    def meet(counts: DataFrame) -> DataFrame:
        return sized.alias("d").join(counts.alias("m"), same).select("d.*", F.col("m.once").alias("__once"), F.col("m.twice").alias("__twice"))

    alone = meet(dealt.filter("rows = 1")).withColumn(copies, F.col("__once") + 2 * F.col("__twice")).select(*docs.columns, copies)
    alone = alone.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
    if not dealt.filter("rows > 1").limit(1).count():
        return alone
    # The first rows appear twice, the next once: a group's copies are those of the numbers it covers.
    groups = equal_groups(meet(dealt.filter("rows > 1")))
    n, _ = group_sizes(groups)
    numbered = number_groups(groups, ["doc_id", "source", size, "__once", "__twice"], n)
    covered = lambda to: F.greatest(F.lit(0), F.least(F.col("__first") + F.col("__count"), to) - F.col("__first"))
    dealt_out = numbered.withColumn("__count", (covered(F.col("__twice")) + covered(F.col("__twice") + F.col("__once"))).cast("bigint"))
    return alone.unionByName(expand_groups(dealt_out, 2 * n).select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; a document without text is its end token alone, repeated rows are packed again."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Hash functions, models and the tokeniser have no SQL form; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one leaves is stored in the shared folder for the next, which then removes it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch():
            kept = keep(durable(stage(spark, docs, sf_dir)))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
