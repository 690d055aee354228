"""A training-text pipeline over ``documents``: quality, near duplicates, decontamination, personal data, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame and calls one operator; its result is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
SQL can't express a fitted classifier or a tokeniser, so there is none; the stages are tested
against brute force.

Cases: empty tables give empty tables; a null text counts as empty: it is kept as it is by every
filter that finds nothing in it; rows with equal doc_id are judged one by one, by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontam, jaccard, packing, pii, quality
from panelspark.llm.shared import read, remove, scratch, temporary, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier doesn't reject."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("keep").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the row with the smallest doc_id (a null first; of equal ones any); documents without words are nobody's duplicates."""
    docs = docs.select(*COLUMNS)
    found = written(jaccard.classes(docs).where("n_shingles > 0").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")), "classes")
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    row = F.struct("doc_id", "text_hash")
    marked = found.join(kept, "root").select("doc_id", "text_hash", "n", row.eqNullSafe(F.col("kept")).alias("first"))
    hashed = docs.withColumn("h", F.xxhash64("text"))
    of = lambda rows: (rows.select(F.col("doc_id").alias("d"), "text_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("text_hash")))
    plain = hashed.join(*of(marked.where("not first or n > 1")), "left_anti")
    repeated = hashed.join(*of(marked.where("first and n > 1")), "left_semi").dropDuplicates(["doc_id", "h"])
    return plain.unionByName(repeated).select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold too much of the benchmark."""
    docs = docs.select(*COLUMNS)
    found = decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"), carry=("lang", "source", "n_chars"))
    return found.where(~decontam.is_contaminated(F.col("n_hit"), F.col("n_words"))).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data and what reveals it generalised or removed."""
    found = pii.sanitise(docs.select(*COLUMNS), carry=("lang", "source"))
    return found.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and where they lie in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of the tables in between only the last remains, which the result reads."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with temporary(spark, f"within-{name}"):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
