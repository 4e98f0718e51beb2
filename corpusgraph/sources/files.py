"""Which files to read, in which order."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Fixed value: how files of earlier samples are called.
SAMPLE_FILE = re.compile(r"PubMed_abstract_sampled_\d+_(\d+)\.json")


def listed(spark: SparkSession, where: str, pattern: str = "*") -> list[str]:
    """The files under a folder that match a glob, by name; any file system the session knows will do."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{where.rstrip('/')}/{pattern}")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted(f.getPath().toString() for f in found or [] if f.isFile())


def json_files(spark: SparkSession, where: str) -> list[str]:
    """A file that ends in ``.json``, or all of them in a folder, by name. Anything else is refused."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        raise FileNotFoundError(where)
    if files.getFileStatus(path).isFile():
        if not where.endswith(".json"):
            raise ValueError(f"{where} does not end in .json")
        return [path.toString()]
    found = listed(spark, where, "*.json")
    if not found:
        raise FileNotFoundError(f"no .json file in {where}")
    return found


def sample_files(spark: SparkSession, where: str) -> tuple[list[str], int]:
    """The files of earlier samples and the number of the next one."""
    numbers = {f: int(m[1]) for f in listed(spark, where, "*.json") if (m := SAMPLE_FILE.fullmatch(f.rpartition("/")[2]))}
    return sorted(numbers, key=numbers.get), max(numbers.values(), default=0) + 1
