"""The corpus pipeline: five stages over the documents, each written before the next one reads it.

Every stage takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of
``documents``; the last one returns token ids instead of the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe, decontaminate, ngram_join, pii, quality
from tillroll.llm.common import stored, table
from tillroll.llm.queries import GOOD, KEEP_PROBABILITY, fit_quality


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier takes for good with the wanted probability.

    A null text is judged like an empty one; rows with equal ids are judged one by one, those
    without an id too. Without any label all grades are equally likely and no document stays.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, tail=GOOD)
    return scored.where(F.col("tail_probability") >= KEEP_PROBABILITY).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    The join tells rows apart by a hash of all their columns, so rows of one id with different texts
    are documents of their own, and rows without an id are in groups like any other (an id goes
    before none). Of equal rows one stays. Rows without words are in no group and all stay.
    """
    rid = F.xxhash64(*docs.columns).alias("_rid")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), rid)
    joined = ngram_join.join(docs.select(rid, "text"), "_rid").where("n_shingles > 0")
    groups = joined.select("_rid", "component_id").distinct()
    order = F.struct(F.col("_row.doc_id").isNull().alias("last"), "_row.doc_id", "_rid")
    first = (
        rows.select("_rid", order.alias("order"))
        .join(groups, "_rid")
        .groupBy("component_id")
        .agg(F.min("order").alias("order"))
        .select("order._rid")
    )
    in_group = F.coalesce(F.col("_row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = (
        rows.where(in_group)
        .join(first, "_rid", "left_semi")
        .groupBy("_rid")
        .agg(F.min("_row").alias("_row"))
        .select("_row")
    )
    return kept.unionByName(rows.where(~in_group).select("_row")).select("_row.*")


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none and stay; every row is judged on its own; an empty benchmark
    takes nothing away.
    """
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*docs.columns)


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text.

    A null text stays null, and ``n_chars`` of a text without personal data stays as it is.
    """
    found = pii.find(docs)
    text = F.when(F.col("text").isNotNull(), pii.mask(F.col("text"), F.col("spans")))
    masked = found.select(
        F.struct(*docs.columns).alias("row"), text.alias("text"), (F.size("spans") > 0).alias("found")
    )
    length = F.when(F.col("found"), F.char_length("text")).otherwise(F.col("row.n_chars"))
    changed = {"text": F.col("text"), "n_chars": length.cast("bigint")}
    return masked.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; a document whose ids do not give its text back stops the run.

    Null and empty texts have no ids; repeated rows are encoded each.
    """
    vocabulary = bpe.Vocabulary.read(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    whole = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", "lang", "source", "text", F.sha2(whole, 256).alias("digest"))
    coded = bpe.round_trip(rows, vocabulary)
    same = F.sha2("decoded", 256) == F.col("digest")
    fault = F.concat(F.lit("ids do not give back document "), F.coalesce("doc_id", F.lit(-1)))
    ids = F.when(same, F.col("ids")).otherwise(F.raise_error(fault).cast("array<int>"))
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), ids.alias("ids")
    )


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_of_benchmark),
    ("personal_data", masked_documents),
    ("token_ids", encoded_documents),
]

#: No stage is expressible in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
