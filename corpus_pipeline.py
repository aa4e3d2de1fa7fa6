"""From raw documents to a training mix: five stages, each over all that its predecessor kept.

Every stage returns rows that are written as Parquet and read again, so a lost
executor never costs more than tasks of the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.decontamination import decontaminate
from shardloom.llm.mixing import mix_documents
from shardloom.llm.near_dedup import WANTED_BROADCAST, near_dedup
from shardloom.llm.pseudonyms import KEY, pseudonymize
from shardloom.llm.quality import keep_good
from shardloom.llm.store import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are scored like others, repeated rows alike, texts whole; an empty table stays one.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Of rows that repeat an id and a text one stays. Documents without words are nobody's duplicates; rows without
    an id go where a row with an id is in their group, and else stay.
    """
    found = near_dedup(docs).select("doc_id", "text_hash", "kept")
    # rows that repeat, and documents of a group that aren't its first, are few beside the table
    lost = found.groupBy("doc_id", "text_hash").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("not kept or n > 1")
    lost = materialize(lost.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), "kept"), "lost")
    lost = F.broadcast(lost) if lost.count() <= WANTED_BROADCAST else lost
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("hash"))
    met = rows.join(lost, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left")
    met = materialize(met.filter(F.coalesce("kept", F.lit(True))).select("row", "id", "hash", F.col("kept").isNotNull().alias("repeats")), "first")
    once = met.filter("repeats").dropDuplicates(["id", "hash"])
    return met.filter("not repeats").union(once).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold several benchmark items, and without the words of single ones.

    Null and empty texts stay as they are, every repeated row is handled, texts whole; an empty table stays one.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With pseudonyms for personal numbers, dates and addresses; n_chars, if there, follows the text.

    Null and empty texts stay as they are, every repeated row is handled, texts whole; an empty table stays one.
    """
    kinds = _free("kinds", docs)
    out = pseudonymize(docs, KEY, kinds_col=kinds)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.size(kinds) > 0, F.length(F.col("text").cast("string")).cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars)
    return out.drop(kinds)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the leaf's domain, their tokens, and how often the mix holds them.

    These three are called domain, n_tokens and copies, behind an underscore for each column that has that name already.
    Null levels are the level ''; texts without tokens go along with their neighbours in the epoch; every repeated row
    counts; an empty table stays one.
    """
    mixed = mix_documents(docs, carry=True).filter("copies > 0")
    added = {"domain": "level_domain", "n_tokens": "n_tokens", "copies": "copies"}
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return mixed.select(*kept, *(F.col(v).alias(_free(k, docs)) for k, v in added.items()))


def _free(name: str, docs: DataFrame) -> str:
    """``name``, or what no column of ``docs`` is called yet."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


STAGES = [
    ("quality", quality),
    ("near_dedup", dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mix),
]

#: The classifier is learnt, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
