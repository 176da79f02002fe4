"""A corpus pipeline over ``documents``: drop toxic texts and copies, mask secrets, pack for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last keep
the columns of ``documents``, further columns of the input included.

Odd rows are defined cases in every stage: a null text counts as an empty one,
a null ``doc_id`` is the smallest, repeated rows are copies of each other, an
empty table stays empty, and an input column may have any name that Spark takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import exact_dedup, packing, secrets, simhash, toxicity
from tidewake.llm.common import fold, saved, table



def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and that column's name.

    The numbers are written once and read from then on: numbers that each job
    made for itself would follow the file splits and so the cores present.
    """
    name = "row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return saved(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _without(numbered: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows whose number is not in ``gone``; other columns than the number stay."""
    return numbered.join(gone, row, "left_anti").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut; the model learns from labels outside the held-out fold.

    A null or empty text is scored as a text without words; repeated rows get
    one verdict; without labels of both kinds nothing is dropped.
    """
    labels = table(spark, sf_dir, "labels").where(~fold(1, 3, F.col("doc_id")))
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model, keep=tuple(docs.columns))
    return scored.where(F.col(f"`{scored.columns[-1]}`") < toxicity.CUT).drop(scored.columns[-1])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id, and of repeated rows one.

    Null and empty texts are equal texts. A null id stays only where no other has the text.
    """
    numbered, row = _numbered(docs)
    gone = exact_dedup.deduplicate(numbered, row_col=row).where(~F.col("kept")).select(F.col("row").alias(row))
    return _without(numbered, row, gone)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the first row in the stage's numbering.

    Texts without words have fingerprint 0 and form one group with what links to it.
    """
    numbered, row = _numbered(docs)
    gone = simhash.near_duplicates(numbered, row).where(F.col("component_id") != F.col(row)).select(row)
    return _without(numbered, row, gone)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials give way to a mark; ``n_chars`` follows the text.

    A text without a live credential stays as it is, and null stays null (with null ``n_chars``).
    """
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in the training batches; a null text has length 1, its end mark."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Trained and sampled stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
