"""Writers. Each writes a folder of parts, as many as the data has tasks, unless it says otherwise.

Exports make one file out of few rows on the driver, on any file system that the session knows.
"""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.text import pystrip

#: Records of one file of a delivery, and the number of its first file.
FILE_RECORDS, FIRST_FILE = 5000, 141


def put(spark: SparkSession, path: str, content: str | bytes) -> None:
    """One file, written by the driver; what was there is replaced."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(content.encode() if isinstance(content, str) else content)
    finally:
        out.close()


def observed(rows: DataFrame, **counted: Column) -> tuple[DataFrame, Observation]:
    """``rows``, and what is counted while they are written; see ``metrics``."""
    seen = Observation()
    return rows.observe(seen, *[c.cast("bigint").alias(n) for n, c in counted.items()]), seen


def metrics(spark: SparkSession, seen: Observation) -> DataFrame:
    """(metric, value) of a run that is over."""
    return spark.createDataFrame(sorted(seen.get.items()), "metric string, value bigint")


def write_arrays(rows: DataFrame, number: str, path: str, per_file: int = FILE_RECORDS, first: int = FIRST_FILE) -> None:
    """Records as files of one JSON array each, ``per_file`` in a file, in the order of ``number``, which counts from 1.

    Files are numbered from ``first`` on, with four digits at least, so a record's file and its place there follow from its
    number alone. A file is made in one task, which its size bounds.
    """
    at = F.floor((F.col(number) - 1) / per_file) + first
    record = F.to_json(F.struct(*[c for c in rows.columns if c != number]), {"ignoreNullFields": "false"})
    parts = rows.select(F.lpad(at.cast("string"), F.greatest(F.lit(4), F.length(at.cast("string"))), F.lit("0")).alias("file"), F.struct(F.col(number).alias("n"), record.alias("r")).alias("x"))
    arrays = parts.groupBy("file").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    value = F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["r"]), ",\n"), F.lit("]"))
    arrays.select(value.alias("value"), "file").write.mode("overwrite").partitionBy("file").text(path)


def write_records(rows: DataFrame, path: str, per_file: int = FILE_RECORDS, mode: str = "overwrite") -> None:
    """Records as lines of JSON, at most ``per_file`` in a file; null columns keep their key."""
    rows.write.mode(mode).option("maxRecordsPerFile", per_file).option("ignoreNullFields", False).json(path)


def append_records(rows: DataFrame, path: str) -> None:
    """Records added to a folder, all of them or none."""
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def write_raw(rows: DataFrame, path: str, raw: str = "raw", mode: str = "overwrite") -> None:
    """Stripped lines as they were read."""
    rows.select(pystrip(raw).alias("value")).write.mode(mode).text(path)


def write_split(rows: DataFrame, flag: Column, yes: str, no: str, raw: str = "raw") -> None:
    """Both sides of a split in two folders; the rows are computed once and held for the two writes."""
    held = rows.withColumn("__flag", F.coalesce(flag, F.lit(False))).persist()
    try:
        write_raw(held.where("__flag"), yes, raw)
        write_raw(held.where("not __flag"), no, raw)
    finally:
        held.unpersist()


def write_table(rows: DataFrame, path: str, sep: str = ",") -> None:
    """A table with a header, separated by commas or by tabs; quotes are doubled inside quotes."""
    rows.write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_list(keys: DataFrame, path: str, *order: Column) -> None:
    """One key on each line, sorted across all files of the folder."""
    keys.orderBy(*order).select(F.col(keys.columns[0]).cast("string")).write.mode("overwrite").text(path)


def export_rows(rows: DataFrame, path: str, most: int = 1_000_000) -> int:
    """One pretty JSON array in one file on the driver, for people; refuses more than ``most`` rows. Returns their number."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows; write a folder instead")
    put(rows.sparkSession, path, json.dumps([r.asDict(recursive=True) for r in found], ensure_ascii=False, indent=2))
    return len(found)


def export_object(row: DataFrame, path: str) -> None:
    """The one row of a report as one pretty JSON object in one file."""
    found = row.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a report has one row")
    put(row.sparkSession, path, json.dumps(found[0].asDict(recursive=True), ensure_ascii=False, indent=2))


def export_report(rows: DataFrame, path: str, most: int = 100_000) -> int:
    """A small report as one file with a header on the driver: tabs for ``.tsv``, a workbook for ``.xlsx``, else commas.

    A workbook needs openpyxl, and without it is refused. An empty report in tabs is an empty line without a header.
    """
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows; write a folder instead")
    if path.endswith(".xlsx"):
        import openpyxl

        book = openpyxl.Workbook()
        for row in ([*rows.columns], *map(list, found)):
            book.active.append(row)
        book.save(path)
        return len(found)
    out = io.StringIO()
    tabs = path.endswith(".tsv")
    if tabs and not found:
        out.write("\n")
    else:
        csv.writer(out, delimiter="\t" if tabs else ",", lineterminator="\n" if tabs else "\r\n").writerows([rows.columns, *found])
    put(rows.sparkSession, path, out.getvalue())
    return len(found)


def export_chart(counts: DataFrame, path: str, title: str, most: int = 2000) -> bool:
    """A bar chart of (value, count), rising upwards; False, and no file, if there is nothing to draw. Needs matplotlib."""
    found = [(r["value"], r["count"]) for r in counts.orderBy("count", "first").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values; a chart can't show them")
    if not found:
        return False
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot

    figure, axes = pyplot.subplots(figsize=(12, max(8, 0.3 * len(found))))
    bars = axes.barh([v for v, _ in found], [c for _, c in found])
    axes.bar_label(bars)
    axes.set_title(title)
    figure.tight_layout()
    figure.savefig(path)
    pyplot.close(figure)
    return True
