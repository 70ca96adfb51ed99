"""A corpus pipeline over the text operators. Each stage reads what its predecessor kept, written as Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barflow.llm import decontamination, langid, mixing, near_dedup, pseudonyms
from barflow.llm.session import fresh, shared_folder

#: Near duplicates: five-word shingles, a Jaccard similarity of 0.8, and fingerprints at 11 or fewer differing bits.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 11


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; it learns from the labelled ones. Null, empty and letterless texts go, whatever their
    label; repeated rows stay or go alike; very long texts are read whole; an empty table gives none; all columns stay."""
    return langid.accepted(docs, langid.fit(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of least id, once. Rows of one id with different texts are different documents. Null and empty
    texts are one group; rows without an id stand for a group that has no other; an empty table gives none."""
    return near_dedup.representatives(docs, RADIUS, SHINGLE, SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows stay or go alike; without items all stay."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms of the same format, and n_chars set to the new text's length where it changed.
    Null texts stay null; repeated rows stay; an empty table gives none."""
    (kinds,) = fresh(docs.columns, "kinds")
    new = pseudonyms.pseudonymised(docs, pseudonyms.key_of(spark), kinds_col=kinds)
    n_chars = F.when(F.size(kinds) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes).get("n_chars", "long")).alias("n_chars")
    return new.select(*[n_chars if c == "n_chars" else F.col(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight takes it, each copy with its number in ``copy``. Null ids, sources and texts
    are values like any other; rows that share id, source and size take turns; an empty table gives none."""
    return mixing.repeated(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("pii", pseudonymise),
    ("mixing", mix),
]

#: The learned stages and the rounding have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one kept lies in the folder of spark.checkpoint.dir until the session ends."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
