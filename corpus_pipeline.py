"""A corpus pipeline of five operators: each stage reads what the one before has written.

Quality rules drop documents, near-duplicates leave one of each group, personal data
is replaced by its kind, sources are mixed to their weights, and the result is
encoded in sampled pieces. A stage takes any table with the columns of ``documents``
and carries further columns as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orograph.functions.ship import ship
from orograph.functions.tables import load, materialize
from orograph.llm.minhash import distinct_documents
from orograph.llm.mixing import mixed_documents
from orograph.llm.pieces import encode
from orograph.llm.pii import redacted
from orograph.llm.quality import good_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the fertility bands keep.

    Null and empty texts go, long ones are measured whole, equal rows fare alike, an
    empty table stays empty.
    """
    ship(spark)
    return good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of five-word shingles and a similarity of 0.8.

    Ties go to the smallest doc_id and repeated rows leave one; texts without words and
    rows without doc_id that nothing resembles stay; long texts are taken whole; an
    empty table stays empty.
    """
    ship(spark)
    return distinct_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind.

    Null and empty texts stay as they are, long ones are read whole, equal texts are
    changed alike, an empty table stays empty.
    """
    ship(spark)
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per whole copy that the mix takes, and the document at a source's cut up to it.

    Texts without words are not taken, those without a source are one source, rows of
    equal doc_id divide a cut evenly, long texts count whole, an empty table stays empty.
    """
    ship(spark)
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``ids``, sampled pieces drawn by doc_id, in place of the text.

    Null and empty texts have no ids, long ones are encoded whole, rows of equal id and
    text get equal ids, an empty table stays empty; a column named ids is replaced.
    """
    ship(spark)
    return encode(docs).drop("text")


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mixing", mixing), ("sentencepiece", sentencepiece)]
#: No stage but the mixing can be said in SQL; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table ``documents`` of ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
