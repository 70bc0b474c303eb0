"""Sinks: insert if absent, overwrite by partition, versioned snapshots, GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def insert_absent(rows: DataFrame, path: str, key: str) -> int:
    """Append rows whose key isn't stored yet, one for a key; the number stored. Running it again stores nothing."""
    spark = rows.sparkSession
    new = rows.filter(F.col(key).isNotNull()).dropDuplicates([key])
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    stored = Observation()
    new.observe(stored, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return stored.get["n"]


def put_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that rows fall into."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def snapshot(rows: DataFrame, root: str, version: str, keep: int = 7) -> list[str]:
    """Write one version and drop all but the newest ``keep``; the versions left, newest last."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{root}/{version}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    for old in names[:-keep]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{old}"), True)
    return names[-keep:]


def features(rows: DataFrame, *properties: str) -> DataFrame:
    """GeoJSON features of rows with lat and lon, one text a row."""
    shape = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    f = F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))
    return rows.filter("lat IS NOT NULL AND lon IS NOT NULL").select(F.to_json(f).alias("feature"))
