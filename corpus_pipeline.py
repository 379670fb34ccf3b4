"""Corpus pipeline: toxicity, language ID, near-dedup, packing, each on all that the stage before it kept.

Every stage but the last returns the columns of ``documents``. ``run`` writes each stage's result as Parquet under the
shared folder of the session and rereads it as the next stage's input, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm import jaccard, langid, packing, toxicity
from locusflow.llm.common import fold
from locusflow.session import cut, prepare

#: None of the stages can be said in SQL (trained models, xxHash64, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, whatever else there is."""
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold stay. Labels teach from the folds that are not held out.

    Null and empty texts get the score of a text without features; where nothing was labelled toxic every document has the prior's score.
    Repeated rows stay or go together; a null id is in a fold like any other.
    """
    model = toxicity.fit(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 4) != 2)
    return toxicity.keep(_columns(docs), model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is like a learned language, by ``langid.FLOOR`` or more, stay; a null lang becomes the predicted one.

    Null texts and texts without a letter go. Where no document has a known lang nothing is learned, and every text with a letter stays.
    Repeated rows stay or go together.
    """
    return langid.keep(_columns(docs), langid.fit(docs, fold("doc_id", 3) != 1))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8 or more) one row stays: that of the smallest id,
    then source, lang and n_chars; one without an id only where no row of the group has one. Null and empty texts are one group."""
    docs = _columns(docs)
    keyed = docs.withColumns({"_h": jaccard.text_hash("text"), "_null": F.col("doc_id").isNull()})
    groups = cut(jaccard.near_groups(docs))
    order = ("_null", "doc_id", "source", "lang", "n_chars")
    times = keyed.groupBy("_h", *order).agg(F.count("*").alias("times"))  # without the texts
    first = times.groupBy("_h").agg(F.min(F.struct(*order, "times")).alias("b"))  # one row a text, so that no text is a hot key of the join
    best = first.join(groups.withColumnRenamed("h", "_h"), "_h").groupBy("component").agg(F.min(F.struct(*(F.col(f"b.{c}").alias(c) for c in order), "_h", F.col("b.times").alias("times"))).alias("b")).select(*(F.col(f"b.{c}").alias(f"_b_{c}") for c in (*order, "_h", "times")))
    best = cut(best)
    same = [keyed["_h"] == best["_b__h"], *(keyed[c].eqNullSafe(best[f"_b_{c}"]) for c in order)]
    kept = keyed.join(best, same)
    again = kept.where("_b_times > 1").dropDuplicates(["_h", "doc_id"])  # these are equal in every column
    return kept.where("_b_times = 1").unionByName(again).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of ``packing.pack_documents``: every id of every document that is left, null and empty texts as their end id alone."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity_stage), ("language_id", language_stage), ("simhash_dedup", dedup_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
