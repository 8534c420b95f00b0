"""Training-corpus pipeline over ``documents``: filter, deduplicate, decontaminate, tokenise.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns a DataFrame; ``run`` writes each stage's result to the shared folder and rereads it
as the next one's ``docs``. All stages but the last return the columns of their input; a
row's own columns travel in one struct, so their names cannot clash with an operator's.

Defined cases: null and empty texts fail the quality rules; repeated rows are one document
to the near-duplicate stage (one stays); an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from headway.llm import decontam, quality, queries, simhash, toxicity
from headway.llm.common import table, text_key
from headway.session import materialize, ship_package

#: SQL cannot express the trained and hashed stages; tests compare them with plain versions.
ORACLE_SQL = None


def _row() -> Column:
    return F.struct("*").alias("_row")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    v = quality.quality_verdicts(docs.select(_row(), "doc_id", "lang", "text"),
                                 table(spark, sf_dir, "labels", "doc_id", "quality"))
    return v.where("kept").select("_row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold."""
    ship_package(spark)
    model = toxicity.train_model(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    s = toxicity.score_texts(docs.select(_row(), "text"), model, keep=("_row",))
    return s.where("predicted = 0").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id (null ids last)."""
    ship_package(spark)
    keys = docs.select("doc_id", "text", *text_key(F.col("text")))
    found = simhash.near_duplicates(keys, keep=("doc_id", "k1", "k2"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "k1", "k2"))
                                      .alias("_first"))
    # The join and dropDuplicates deal rows by the same four columns, so a text is shuffled once.
    names = ["_id", "_none", "_k1", "_k2"]
    stay = first.select(*[c.alias(n) for c, n in zip(_key(F.col("_first.doc_id"), F.col("_first.k1"), F.col("_first.k2")), names)])
    rows = docs.select(_row(), *[c.alias(n) for c, n in zip(_key(F.col("doc_id"), *text_key(F.col("text"))), names)])
    return rows.join(stay, names, "left_semi").dropDuplicates(names).select("_row.*")


def _key(doc_id: Column, *text: Column) -> list[Column]:
    """Columns without nulls that name a document's id and text."""
    return [F.coalesce(doc_id.cast("string"), F.lit("")), doc_id.isNull(), *text]


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids and their decoding, as digests per document."""
    ship_package(spark)
    return queries.bpe_digests(docs)


STAGES = [("quality rules", keep_quality), ("toxicity", drop_toxic), ("SimHash near-dedup", drop_near_duplicates),
          ("benchmark decontamination", drop_contaminated), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
