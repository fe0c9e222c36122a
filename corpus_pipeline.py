"""From raw documents to token ids: quality, repeated lines, near copies, source mix, byte-level BPE.

Every stage takes all rows of its predecessor.  All but the last return its columns, whatever they are called; an empty
table gives an empty one.  ``run`` writes each stage's rows as Parquet in the shared folder, so that none is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, common, line_dedup, mixing, quality, simhash


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored as texts without words, texts of any length whole; repeated rows stay or go together.
    The score is no column of the result: columns named score or predicted are the table's own.
    """
    return quality.accepted(docs, *quality.fit(docs, common.table(spark, sf_dir, "labels")))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; n_chars follows the text.

    Null texts become empty, as do texts all of whose lines go; repeated rows each stay, and count as one document of
    their id (null ids as one).  Texts of any length are taken whole.
    """
    kept = line_dedup.drop_shared_lines(docs, min_docs=10, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (similarity of five-word sets >= 0.8): that of smallest id.

    It is decided row by row: texts of one id that are not alike all stay, a null id comes last in its class.  Null, empty
    and blank texts are one class.  Ties between rows of equal id and text go by a hash of all columns.
    """
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times.

    Empty and null texts have no words and are not taken; null sources are a source; repeated rows are taken each, and
    what is taken of equal rows is dealt among them, so that reruns agree.
    """
    return mixing.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row: repeated rows each, null ids too; null and empty texts have no ids."""
    return bpe.encode(docs, *bpe.production()).select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES = [("quality", good_quality), ("line dedup", without_shared_lines), ("near copies", without_near_copies), ("mix", mixed), ("tokens", encoded)]

#: SQL can express neither the network nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, name.replace(" ", "-"))
    return docs
