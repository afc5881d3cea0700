"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, token counts.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and rereads it as
the next stage's docs. Every stage but the last returns the columns of documents. Rows are judged one by one, by what
they hold: ids may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hammerfield.llm import bpe, decontam, jaccard, quality, suffix
from hammerfield.llm.workspace import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    The classifier learns from the labelled documents outside its held-out fold; labels of documents that are not in
    docs are not used. Each row is scored by its own text, whatever its id; a null or empty text scores as no feature.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = labels.filter(quality.remainder(labels["doc_id"], 4) != 2).select("doc_id", labels["quality"].alias("label"))
    scored = quality.score(docs.select(COLUMNS), quality.fit(docs, seen))
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (Jaccard of five-word shingles of 0.8 or more): that with the smallest id.

    Rows are judged one by one, also where they share an id or have none (these come last in a group); of rows equal in
    id and text one stays. Rows without words are in no group and stay.
    """
    found = stage(jaccard.similar_documents(docs, k=5, num=80, den=100), "groups")
    rows = docs.select(*COLUMNS, jaccard.row_key(docs).alias("row"))
    kept = rows.join(found.filter("NOT leads").select("row").distinct(), "row", "left_anti")
    twice = stage(found.filter("leads AND n_shingles > 0").groupBy("row").count().filter("count > 1").select("row"), "twice")
    if not twice.isEmpty():
        kept = kept.join(twice, "row", "left_anti").unionByName(kept.join(twice, "row", "left_semi").dropDuplicates(["row"]))
    return kept.select(COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages of 200 bytes or more that occur elsewhere too.

    Rows that share an id are documents of their own; a null text stays null.
    """
    return suffix.cut_repeats(docs.select(COLUMNS)).select(COLUMNS)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose text no benchmark item is found; rows are judged by their texts, whatever their ids."""
    text = F.md5(F.col("text").cast("binary"))
    leaks = decontam.find_leaks(docs.select(text.alias("leak"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="leak")
    return docs.select(COLUMNS).join(leaks.select("leak").distinct(), text == F.col("leak"), "left_anti").select(COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of every row left; a null text is empty."""
    return bpe.encode_and_decode(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("leaks", leaks_stage),
    ("tokens", tokens_stage),
]

#: The tokens of the last stage and the classifier of the first cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs
