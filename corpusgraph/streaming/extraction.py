"""Extraction as a stream: new articles are asked about once, and a restart goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusgraph.operators import extraction as x


#: Finished keys lie in so many buckets by their hash.
BUCKETS = 32


def extract_stream(
    articles: DataFrame, key: str, title: str, abstract: str, place: str, extractor: x.Extractor, system: str, results: str, checkpoint: str,
    at_once: int | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Append the results for a stream of articles to the table at ``results``/results.

    A batch that is tried again overwrites its own folder, so its results come once; keys with a success in an earlier batch
    are left out, as in a batch run. Those keys lie at ``results``/keys by their hash, so a batch reads the keys of its own
    buckets and no results.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        todo = x.tasks(rows, key, title, abstract, place)
        bucket = F.pmod(F.xxhash64("pmid"), F.lit(BUCKETS)).cast("int")
        if number:
            touched = [r["bucket"] for r in todo.select(bucket.alias("bucket")).distinct().collect()]  # at most BUCKETS
            keys = spark.read.schema("pmid string, batch bigint, bucket int").parquet(f"{results}/keys")
            todo = x.pending(todo, keys.where((F.col("batch") < number) & F.col("bucket").isin(touched)))
        x.extract(todo, extractor, system, at_once).write.mode("overwrite").parquet(f"{results}/results/batch={number}")
        done = x.state(spark.read.schema(x.RESULT).parquet(f"{results}/results/batch={number}")).withColumn("bucket", bucket)
        done.write.mode("overwrite").partitionBy("bucket").parquet(f"{results}/keys/batch={number}")

    return articles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
