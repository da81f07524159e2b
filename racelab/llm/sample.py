"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_col, only


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, parts: int, held_out: int) -> list[tuple[int, str, int]]:
    """At most ``rows`` (doc_id, text, label) outside the held-out fold, chosen by a hash of the id.

    The bound is a parameter of every operator that fits on it. The ids are chosen on the small
    labels table first; of the documents only these rows reach the driver. Of labels that disagree
    the larger counts, of texts of one id the first in order.
    """
    known = only(labels, doc_id="long", **{label: "int"}).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(fold_col(F.col("doc_id"), parts) != held_out).groupBy("doc_id").agg(F.max(label).alias(label))
    picked = {r.doc_id: r[label] for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()}
    if not picked:
        return []
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([(i,) for i in picked], "doc_id long"))
    texts = only(docs, doc_id="long", text="string").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return sorted((r.doc_id, r.text or "", picked[r.doc_id]) for r in texts.toLocalIterator())
