"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that its predecessor kept, as written to Parquet and read
again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import settle, table
from lexmill.llm.langid import UNDETERMINED, identify, train
from lexmill.llm.line_dedup import line_dedup
from lexmill.llm.minhash import without_near_copies
from lexmill.llm.packing import pack
from lexmill.llm.substring_dedup import without_repeats

#: A document is rejected if less than half of what its words say speaks for one language. The score counts words
#: only as far as the fitting has seen their features: of held-out documents of learned languages 999 in 1000 score
#: over 0.6, texts of other languages and scripts under it, and texts without letters are rejected as such.
LEAST_SCORE = 0.5


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` as it is after the text has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    model = train(docs)
    known = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    # An input's own columns of these names would clash; the prefixed ones are dropped again.
    plain = docs.toDF(*[f"_in_{c}" for c in docs.columns])
    kept = identify(plain, model, "_in_text", tuple(plain.columns)).where(known)
    return kept.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; their documents stay. Copies of a page are one page here: they are for the near stage to judge."""
    return _measured(line_dedup(docs, copies_once=True).select(*docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words, similarity 0.8."""
    return without_near_copies(docs, k=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once go; their documents stay."""
    return _measured(without_repeats(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as pieces of training sequences."""
    return pack(docs)


STAGES = [
    ("language id", language_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("suffix-array dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
