"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

quality classifier -> MinHash near-dedup -> benchmark decontamination -> personal data -> best-fit packing

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents, and
any further columns as they came, whatever their names.

Defined results: a null text counts as an empty one and stays null; an empty text is scored by the classifier's curve, has
no near duplicates, benchmark windows or personal data, and is packed as the end token alone. A row without id is a document
of its own. Rows that repeat an id are one document to near-dedup, all of whose rows stay or go, and are otherwise judged
and packed each. Nulls in other columns change nothing. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, free_name, table
from strandline.llm.decontaminate import drop_contaminated
from strandline.llm.minhash import drop_near_duplicates
from strandline.llm.packing import pack
from strandline.llm.pii import redact
from strandline.llm.quality import fit_quality, score_quality

QUALITY_THRESHOLD = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at least QUALITY_THRESHOLD; the others go.

    Without a model (too few labelled documents of a class) all stay.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    if model.weights is None:
        return docs
    score = free_name(docs, "_score")
    return score_quality(docs, model, score).where(F.col(score) >= QUALITY_THRESHOLD).drop(score)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates, by sets of 5-word shingles of similarity 0.8."""
    return drop_near_duplicates(docs, shingle=5)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; n_chars is that of the new text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("pack", pack_stage),
]

#: Byte-pair ids and compressed sizes have no SQL form: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        before, docs = docs, scratch.settle(stage(spark, docs, sf_dir), name)
        scratch.release(before)  # a stage reads its predecessor's rows only
    return docs
