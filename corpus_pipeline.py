"""A corpus pipeline: quality, near-duplicates, repeated strings, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next reads as Parquet. All but the last keep
the columns of documents.

Stages decide by row: rows without doc_id, and rows that repeat a doc_id with another text, are documents like others.
Null texts count as empty. Of rows with equal doc_id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import mixing, packing, quality, simhash, suffix
from skein.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def row_key() -> Column:
    """A row's identity: doc_id, which may be null or repeated, and text. A function, as columns want a session."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rates 0.5 or more."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(table(spark, sf_dir, "documents"), labels.where(~quality.held_out()))
    return quality.score(docs, model, ("text", "lang", "source", "n_chars")).where("score >= 0.5").select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id (none comes last); equal rows stay one.

    Near-duplicates share 0.8 or more of their five-word shingles; groups are what such links join.
    """
    rows = docs.withColumn("row", row_key())
    groups = simhash.similar(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id").distinct()
    ids = rows.select("row", F.col("doc_id").cast("long").alias("doc_id")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = groups.join(ids, "row").groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that stand earlier; n_chars follows. A text of which nothing is left goes."""
    sized = docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    left = suffix.dedup(sized, "lang", "source", "n_chars")
    return left.where("text != '' OR n_chars = 0").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, once for each epoch; that in which a leaf's budget ends is cut to the words taken.

    A leaf's order is seeded by row, not by doc_id.
    """
    keyed = materialise(mixing.leaves(docs.withColumn("doc_id", row_key())), "tokens")
    taken = mixing.choose(keyed, mixing.PLAN).select(F.col("doc_id").alias("row"), "epoch", "tokens", "take_tokens").distinct()
    words = F.split("text", r"(?<=\S)(?=\s)")  # each with the white space before it
    prefix = F.array_join(F.slice(words, F.lit(1), F.col("take_tokens").cast("int")), "")
    cut = docs.withColumn("row", row_key()).join(taken, "row").withColumn("text", F.when(F.col("take_tokens") < F.col("tokens"), prefix).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.when(F.col("take_tokens") < F.col("tokens"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_quality), ("simhash", keep_one_of_near_duplicates), ("suffix", cut_repeats), ("mixing", mix), ("packing", pack)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
