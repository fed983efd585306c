"""A pipeline over documents made of the training-data operators: each stage keeps what the next one works on.

Every function takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm import decontamination, jaccard, packing, pii, quality
from veil.llm.common import broadcast_if_small, discard, materialise, scratch, table
from veil.llm.queries import vocabulary


def _set_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list]:
    """docs with the columns that an operator would replace renamed, and the columns that restore docs."""
    taken = {n.lower() for n in names}
    renamed = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in taken}
    own = docs.select(*[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in docs.columns])
    return own, [F.col(f"`{renamed.get(c, c)}`").alias(c) for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of documents given here, doesn't reject.

    Where the labels give no model (none of one class that may be learned from), nothing tells documents apart and all are kept.
    """
    own, back = _set_aside(docs, ("score", "predicted"))
    model = quality.fit(own, table(spark, sf_dir, "labels"))
    if not model.curve:
        return docs
    return quality.score(own, model).filter("predicted = 1").select(*back)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the least id; documents without an id stay."""
    with scratch(spark) as keep:
        found = jaccard.near_duplicates(docs.select("doc_id", "text"))
        gone = keep(materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")), "near-copies"))
    gone = broadcast_if_small(gone, gone.count(), 16, 32 << 20)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind; n_chars follows the text."""
    own, back = _set_aside(docs, pii.FOUND)
    found = pii.find(own, redact=True).withColumn("text", F.col("redacted"))
    if "n_chars" in found.columns:
        changed = F.coalesce(F.length("spans") > 0, F.lit(False))
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*back)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces with their place in a sequence."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: Compression, boosted trees and tokenisation can't be expressed in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each stage's rows are written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:  # what the stage wrote on its way goes
            after = keep(materialise(stage(spark, docs, sf_dir), name))
        if i:
            discard(spark, docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
