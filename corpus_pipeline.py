"""From documents to packed token sequences: quality rules, near-duplicates, personal data, source mix, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), docs being what the stage before kept, and returns
a table that is written as Parquet and read again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import mixing, neardup, packing, pii, quality
from weftline.llm.store import stash, sweep, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't express the learned rules, the random field or the local search; the tests compare with plain versions.
ORACLE_SQL = None


def _key(name: str) -> Column:
    """A doc_id as a key that is never null."""
    return F.coalesce(F.col(name).cast("string"), F.lit("null")).alias("_id")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base test and the learned decision list keep.

    Null, empty and very short texts fail the base test and go. Repeated rows get equal verdicts. A null doc_id has no label, but is judged.
    Columns besides those of documents fall away, whatever their names. An empty table gives an empty one; so does each stage.
    """
    return quality.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("_kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, on sets of five words: that of the smallest doc_id.

    Rows without words are linked with nothing and stay, but repeated rows (same doc_id and text) are one. A row without
    a doc_id stays if its group has no doc_id at all. Very long texts are compared whole.
    """
    found = neardup.near_duplicates(docs, width=5, percent=80)
    kept = found.where("kept or component_id is null").select(_key("doc_id"), F.col("th").alias("_th")).distinct()
    rows = docs.select(*COLUMNS, _key("doc_id"), F.xxhash64("text").alias("_th"))
    return rows.join(kept, ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data in its text replaced by its kind in brackets; n_chars is counted anew.

    Null and empty texts stay as they are, with n_chars 0. Repeated rows and null doc_ids are rows like others.
    """
    text = F.col("_pii")["redacted"]
    return pii.scan(docs.select(*COLUMNS)).select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, always whole.

    Texts that are null or without words are taken 0 times and go. Null sources are one source. Repeated rows are rows of
    their own, told apart by their number among those of one doc_id and text; a row and its part of the mix meet by doc_id, text and number.
    """
    own = Window.partitionBy("_id", "_th").orderBy("source", "lang", "n_chars")
    rows = docs.select(*COLUMNS, _key("doc_id"), F.xxhash64("text").alias("_th"), mixing.word_count(F.col("text")).alias("_words")).withColumn("_copy", F.row_number().over(own))
    # Only slim rows go through the mix.
    slim = rows.select("doc_id", "source", "_id", "_th", "_words", "_copy")
    taken = mixing.whole(slim, size_col="_words", carry=("_id", "_th", "_copy")).where("copies > 0").select("_id", "_th", "_copy", "copies")
    d = rows.join(taken, ["_id", "_th", "_copy"])
    d = d.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return d.select("doc_id", "text", "lang", "source").withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in token sequences; null and empty texts are the end token alone, and longer ones are cut."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents; tables that were written on the way are deleted at the end, but for the result's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    sweep(spark, keep=docs)
    return docs
