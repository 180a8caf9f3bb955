"""Bounded samples of labelled rows, and the regression fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(divisor: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo divisor; null ids count as empty text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most about ``bound`` labelled documents, an even share by a hash of the id.

    The labels kept are few by construction, so they are broadcast and the texts don't move.  Ids with contradicting labels
    take the larger one, and of rows that repeat an id the smallest text stands for it: a row for each id, however often it repeats.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    total = known.count()
    if total > bound:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * bound / total))
    return docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def linear(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """x @ weights, each row added up by itself and in the order of its columns: a row's sum doesn't depend on the rows it came with."""
    total = np.zeros(len(x))
    for column, weight in enumerate(weights):
        total += x[:, column] * weight
    return total


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Newton's method with a ridge on all but the constant; y may be soft."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w
