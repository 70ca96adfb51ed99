"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.llm.session import bounded


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def sampled_ids(labelled: DataFrame, per_class: int, seed: int = 0) -> DataFrame:
    """(doc_id, label) of the ``per_class`` ids of least hash of each label of ``labelled(doc_id, label)``; of a smaller label, all.

    A threshold on the hash, by the label's count, leaves little more than that many ids of any label to the window that
    cuts them off, so that no label's ids meet in one task. The same rows give the same sample. An id with several labels
    counts under the least one.
    """
    one = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    shares = one.groupBy("label").agg((F.lit(per_class + 8 * per_class**0.5 + 32) / F.count(F.lit(1))).alias("share"))
    hashed = F.xxhash64(F.lit(seed), "doc_id")
    chance = F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))
    near = one.join(bounded(shares), "label").where(chance < F.col("share")).select("doc_id", "label", chance.alias("chance"))
    order = Window.partitionBy("label").orderBy("chance", "doc_id")
    return near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_class).select("doc_id", "label")
