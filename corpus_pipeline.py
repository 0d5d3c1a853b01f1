"""Corpus pipeline: quality, language, near duplicates, decontamination and packing, each stage on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlog.llm import common, jaccard, lang_id, quality, tiling
from sparrowlog.llm.queries import held_out, pack, read


def drop(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of (doc_id, text_md5), nulls equal: a decision is on an id and its text, so rows that share an
    id, or have none, are kept or dropped by their own text."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_md5").alias("gone_md5")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.md5(common.utf8(docs["text"])) == gone["gone_md5"])
    return docs.join(gone, same, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects (predicted 0)."""
    scored = quality.score_quality(docs, read(spark, sf_dir, "labels"), held_out(4))
    return drop(docs, scored.filter("predicted = 0"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are in no learned language: no letter, or a code length far above its language's texts."""
    found = common.materialise(lang_id.identify(docs, held_out(4)), "languages")
    return drop(docs, lang_id.without_language(found))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the least id, or any where none has an id. A decision is on an id
    and its text: rows that share an id with a document that stays, but not its text, go with their own group."""
    kept = jaccard.similar_documents(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (F.unhex(F.sha2(common.utf8(docs["text"]), 256)) == kept["text_sha256"])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return drop(docs, tiling.contaminated(docs, read(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their sequence and place."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: SQL has neither the fitted models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
