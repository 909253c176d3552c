import glob

from pyspark.sql import functions as F

from quire.sources import results
from quire.sources.versions import Versions


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "results")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k"}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.sha2((F.col("id") * 1000 + i).cast("string"), 256)), " ")
        docs = spark.range(0, 120, 1, 6).select(F.col("id").alias("job_id"), words.alias("markdown"))
        results.write_results(docs, path, buckets=1)
    finally:
        for name in small:
            spark.conf.unset(name)
    (part,) = Versions(spark, path).latest()[1]
    assert len(glob.glob(f"{path}/{part.folder}/*.parquet")) > 1
    got = results.read_results(spark, path).select("job_id", "markdown")
    assert got.count() == 120 and got.join(docs.select(F.col("job_id").cast("string").alias("job_id"), "markdown"), ["job_id", "markdown"]).count() == 120
