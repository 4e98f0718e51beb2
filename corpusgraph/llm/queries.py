"""The queries of this package, over the tables of a folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.text import pmid_number
from corpusgraph.llm import canonical, contamination, history, language, near_duplicates, packing, stable_sample, truncation
from corpusgraph.llm import term_frequency as tf

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


TERMS = {"head_type": "entity_type", "tail_type": "entity_type", "relation": "relation"}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms in fewer than 3 articles, or in more than 40 % of them."""
    return p4_term_frequencies(spark, folder).where("mark is not null").select("kind", "term", "mark")


def p4_term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of all terms, with a layout for each quarter in which triples were extracted."""
    return tf.term_frequencies(_table(spark, folder, "triples"), "pmid", TERMS, batch=F.quarter("extracted_at"))


LABELLED = ("rec_id", ["title", "abstract"], "lang")


def p1_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of each record that has a wrong label or none or several languages, with confidence and problem."""
    articles = _table(spark, folder, "articles")
    return language.mislabelled(articles, *LABELLED, language.train(articles, *LABELLED)).withColumnRenamed("key", "rec_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_languages(spark, folder).select("rec_id", "lang")


def p1_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch in one language of every record."""
    articles = _table(spark, folder, "articles")
    return language.segments(articles, *LABELLED[:2], language.train(articles, *LABELLED)).withColumnRenamed("key", "rec_id")


#: Articles are alike by sequences of three words, from a likeness of one half on.
ALIKE = {"length": 3, "threshold": 0.5}


def article_text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found, members = near_duplicates.near_duplicates(_table(spark, folder, "articles"), "rec_id", article_text(), **ALIKE)
    return near_duplicates.expanded(found, members).select(F.col("a").alias("rec_id_a"), F.col("b").alias("rec_id_b"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The class of equal texts, its links and the group of each record."""
    return near_duplicates.grouped(_table(spark, folder, "articles"), "rec_id", article_text(), **ALIKE).withColumnRenamed("key", "rec_id")


TYPED = {"head_type": "entity_type", "relation": "relation", "tail_type": "entity_type"}


def p3_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every value that is no term as it stands, with the term meant and the score."""
    return canonical.canonical_rows(_table(spark, folder, "triples"), "id1", _table(spark, folder, "vocab"), TYPED)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_canonical(spark, folder).select("id1", "field", "term")


def p3_unmatched_report(spark: SparkSession, folder: str) -> DataFrame:
    """How often each value without a term occurs, by column."""
    return p3_canonical(spark, folder).where(F.col("term") == canonical.UNMATCHED).groupBy("field", "value").agg(F.count("*").alias("n"))


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A twentieth of all PMIDs, with the bucket of each."""
    taken = stable_sample.sample(_table(spark, folder, "articles"), pmid_number("pmid"), 0.05)
    return taken.select(F.col("key").alias("pmid"), "bucket")


def p6_history(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that an earlier batch has already, and why. The last eight batches (of fewer than nine, all but the
    first) are delivered one by one to an index that the batches before them made."""
    articles = _table(spark, folder, "articles")
    batches = [r["batch"] for r in articles.select("batch").distinct().orderBy("batch").collect()]
    cuts = batches[1:][-8:]
    return history.replay(articles, "rec_id", "batch", article_text(), pmid_number("pmid"), cuts, **ALIKE)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_history(spark, folder).select("batch", F.col("key").alias("rec_id"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container and position of every text, in pieces where it exceeds 2,048 tokens. A container takes 24 segments and
    2,000 loss-bearing tokens at most."""
    counts = packing.token_counts(_table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack(counts, 2048, 24, 2000).withColumnRenamed("key", "doc_id")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    items = _table(spark, folder, "eval_items")
    return contamination.leaks(_table(spark, folder, "documents"), "doc_id", "text", items, "item_id", ["passage", "question"], "answer")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))


def p8_item_report(spark: SparkSession, folder: str) -> DataFrame:
    """In how many documents each item leaked."""
    items = _table(spark, folder, "eval_items")
    return contamination.reported(_leaks(spark, folder), items, "item_id").withColumnRenamed("item", "item_id")


def _cut(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(_table(spark, folder, "documents"), "doc_id", "text", "source", "doc_kind")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder).select("doc_id")


def p9_source_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts of each source are cut."""
    return truncation.source_shares(_table(spark, folder, "documents"), _cut(spark, folder), "text", "source")


def p9_length_spikes(spark: SparkSession, folder: str) -> DataFrame:
    """The limits that show in the lengths of each source."""
    return truncation.length_spikes(_table(spark, folder, "documents"), "text", "source")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_languages": p1_languages,
    "p1_segments": p1_segments,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_canonical": p3_canonical,
    "p3_unmatched_report": p3_unmatched_report,
    "p4_found": p4_found,
    "p4_term_frequencies": p4_term_frequencies,
    "p5_sample": p5_sample,
    "p6_found": p6_found,
    "p6_history": p6_history,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_item_report": p8_item_report,
    "p9_found": p9_found,
    "p9_source_shares": p9_source_shares,
    "p9_length_spikes": p9_length_spikes,
}
