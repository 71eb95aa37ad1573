"""A training-corpus pipeline: each stage takes the documents that its predecessor kept.

A stage writes nothing itself; ``run`` writes each stage's rows to the shared folder and reads them again, so a lost
executor never costs more than the stage at hand.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequora.llm import common, decontaminate, line_dedup, packing, quality_classifier, shingle_dedup


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the stage's own documents with labels."""
    score = quality_classifier.scorer(spark, quality_classifier.fit(docs, common.table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) >= 0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share; n_chars follows the text where it changes."""
    names = [common.free_name(docs.columns, n) for n in line_dedup.NAMES]
    text, _, removed = names
    out = line_dedup.clean_lines(docs, names=names)
    changed = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(removed) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word similarity of 0.8 or more, the one with the smallest doc_id.

    Deletion variants of SimHashes nominate, shingle sets are compared exactly.
    """
    return shingle_dedup.keep_one(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, at_once=1 << 20)  # beside a heap that four stages have filled


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate_documents),
    ("best-fit packing", pack),
]

#: Neither the classifier, the fingerprints nor the packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for at, (_, stage) in enumerate(STAGES):
        with common.Scratch() as scratch:
            docs, path = common.materialise(stage(spark, docs, sf_dir), f"stage-{at}")
        scratch.drop(spark, path)
        if before:
            common.drop_path(spark, before)  # the stage that read it is written
        before = path
    return docs
