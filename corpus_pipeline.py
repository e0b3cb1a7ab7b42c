"""From documents to packed training sequences.

Each stage reads all that its predecessor kept. The first four return the columns of
documents: quality rules drop rows, near-duplicates keep one row of a group, personal data
is replaced in the texts, and mixing repeats or leaves out rows so that the sources come
near their targets. The last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import mixing, packing, pii, quality, simhash
from skyloom.llm.text import read, word_count
from skyloom.plans.shared import discard, materialize, settled

ORACLE_SQL = None  # XXH64, keyed surrogates and tokenisation are beyond SQL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.filter_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_documents(docs, pii.session_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: up to twice, or not at all.

    Rows of one id, text and source are taken together. Texts are shuffled once.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    key = F.concat(name, F.lit(":"), F.xxhash64("text", F.col("text").isNull(), "source", F.col("source").isNull()).cast("string"))
    sized = docs.select(key.alias("__row"), "source", word_count(F.col("text")).alias("__size"))
    sized = sized.groupBy("__row", "source").agg(F.sum("__size").alias("__size")).withColumn("__sources", F.array("source"))
    sized = materialize(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("__size").alias("s")).limit(mixing.MAX_PATTERNS + 1).collect()
    quotas = mixing.source_quotas([(r["source"], int(r["s"])) for r in totals])
    taken = mixing.mix(sized, quotas, "__row", "__size", "__sources").where("copies > 0").select(F.col("doc_id").alias("__row"), F.col("copies").alias("__copies"))
    out = docs.withColumn("__row", key).join(materialize(taken, "taken").hint("merge"), "__row")  # the same plan at every size
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage has written on its way is deleted once its result is written."""
    out = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = out
        out = settled(lambda: stage(spark, before, sf_dir), name)
        discard(before)
    return out
