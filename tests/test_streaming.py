from pyspark.sql import functions as F

from corpusgraph.operators import extraction
from corpusgraph.streaming.extraction import extract_stream


def test_stream_gives_what_a_batch_run_gives(spark, tmp_path, got):
    source, results = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "pmid string, t string, a string, p bigint"
    first = spark.createDataFrame([("1", "a", "b", 1), ("2", "c", None, 2)], schema)
    second = spark.createDataFrame([("2", "c", None, 3), ("3", "d", "e", 4)], schema)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        extract_stream(stream, "pmid", "t", "a", "p", extraction.StubExtractor(), "s", results, str(tmp_path / "c")).awaitTermination()

    for part in (first, second):
        part.write.mode("append").parquet(source)
        run()
    run()  # a restart without new data asks nothing again
    done = spark.read.schema(extraction.RESULT).parquet(f"{results}/results")
    assert got(done, "pmid", "place") == [("1", 1), ("2", 2), ("3", 4)]
    batch = extraction.extract(extraction.tasks(first.unionByName(second.where("pmid = '3'")), "pmid", "t", "a", "p"), extraction.StubExtractor(), "s")
    assert got(extraction.triples(done), "pmid", "raw") == got(extraction.triples(batch), "pmid", "raw")
    assert done.where(F.col("status") != "success").count() == 0
