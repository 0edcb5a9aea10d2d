"""Bounded, deterministic samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null stays null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def training_rows(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(text, y) of at most ``per_class`` labelled documents of each class outside the held-out fold.

    The rows are those with the smallest hashes of their ids, so a rerun picks the same ones.  Texts are
    whole, however long.  An id whose label is null, or that has both labels, is skipped.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y_max")).where("y = y_max").select("doc_id", "y")
    pick = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        pick = one if pick is None else pick.unionByName(one)
    texts = documents.select("doc_id", "text").where("text is not null")
    # the picked ids are at most 2 * per_class rows
    return texts.join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def with_fold(documents: DataFrame, folds: int, held_out: int) -> Column:
    return F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
