"""Files that hold one JSON array of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.json_values import array_objects, read_object

#: The fields of an article, in the order of its file.
ARTICLE = ("PMID", "PMCID", "DOI", "Journal", "Publication_types", "Date", "Author", "Title", "Abstract")


def read_arrays(spark: SparkSession, paths: list[str], fields: list[str] = list(ARTICLE)) -> DataFrame:
    """(file, part, place, raw, <fields>): the objects of the arrays; entries that are no objects are left out.

    ``place`` is an entry's place in its file, ``part`` the file's place among all by name. A file whose root is no array
    fails the query. Files are bounded in records, so each is read by one task; other files beside it in others.
    """
    if not paths:
        columns = "".join(f", {f} string" for f in fields)
        return spark.createDataFrame([], f"file string, part int, place bigint, raw string{columns}")
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), array_objects(F.col("value")).alias("entries"))
    checked = whole.withColumn("entries", F.when(F.col("entries").isNull(), F.raise_error(F.concat(F.col("file"), F.lit(" holds no JSON array")))).otherwise(F.col("entries")))
    rows = checked.select("file", F.explode("entries").alias("e")).select("file", F.col("e.place").alias("place"), F.col("e.value").alias("raw"))
    order = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(paths))], "name string, part int")
    named = rows.withColumn("__o", read_object(F.col("raw"), fields))
    same = F.regexp_replace("file", "^file:/+", "/") == F.regexp_replace("name", "^file:/+", "/")
    return named.join(F.broadcast(order), same).select("file", "part", "place", "raw", *[F.col(f"__o.{f}.text").alias(f) for f in fields])


def batch_name(file: str = "file") -> Column:
    """The batch a file belongs to: what stands behind the last ``_`` of its name."""
    base = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.json$", "")
    return F.element_at(F.split(base, "_"), -1)
