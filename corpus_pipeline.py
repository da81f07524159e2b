"""A corpus pipeline: language, toxicity, near duplicates, personal data, packing.

Every stage takes the documents that the one before kept. The first four return the columns of
documents, the last one the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racelab.llm import jaccard_join, language_id, packing, pii, toxicity
from racelab.llm import queries as q
from racelab.llm.common import Scratch

#: The stages hold fitted models, which SQL can't express.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or with no probable language go."""
    return language_id.keep_identified(docs, language_id.train(docs, q.ROWS_PER_LANGUAGE))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, q.table(spark, sf_dir, "labels"), q.LABELLED_ROWS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that of the smallest id, ids before null, then of the smallest hash
    of its text. Rows without words stay. Of rows that are equal in id and text one stays, the first by its
    other columns as JSON."""
    groups = jaccard_join.join(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text_key")).alias("_first")
    one = groups.where("component_key IS NOT NULL").groupBy("component_key").agg(first).select("_first.doc_id", "_first.text_key")
    kept = one.unionByName(groups.where("component_key IS NULL").select("doc_id", "text_key")).distinct().select(F.struct("doc_id", "text_key").alias("_kept"))
    own = F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"))
    rows = docs.join(kept, own.eqNullSafe(kept["_kept"]), "left_semi")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    if len(docs.columns) < 3:
        return rows.distinct()
    return rows.groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest)).alias("_rest")).select("doc_id", "text", "_rest.*").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; n_chars follows."""
    masked = pii.redact(docs, pii.train(docs, q.PII_ROWS))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, q.word_bpe())


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = q.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
