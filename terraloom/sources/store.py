"""Feature, scene and chunk tables as Parquet, with last-write-wins upserts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from terraloom.operators.graph import upsert


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the checkpoint folder and read from there: what uses it twice doesn't run it twice, and its size is known.

    Without such a folder, one is made on a single machine; on a cluster
    ``df`` stays as it is.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            return df
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terraloom-"))
        folder = sc.getCheckpointDir()
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert_features(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with ``rows`` (same columns) put in by id; what is written last stays."""
    both = table.withColumn("_seq", F.lit(0)).unionByName(rows.withColumn("_seq", F.lit(1)))
    return upsert(both, ["id"], "_seq").drop("_seq")


def upsert_scenes(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Scenes by id: the payload is the newer one, created_at the older one."""
    both = table.withColumn("_seq", F.lit(0)).unionByName(rows.withColumn("_seq", F.lit(1)))
    return both.groupBy("id").agg(F.max_by("payload", "_seq").alias("payload"), F.min_by("created_at", "_seq").alias("created_at"))


def list_scenes(table: DataFrame) -> DataFrame:
    return table.select("id", "created_at").orderBy(F.desc("created_at"), "id")


def write_features(features: DataFrame, path: str) -> None:
    """Parquet by kind, so that a kind is read alone."""
    features.write.mode("overwrite").partitionBy("kind").parquet(path)


def read_features(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if kind is None else rows.where(F.col("kind") == kind)


#: Vector stores by name; those behind a network need a client that isn't here.
VECTOR_STORES = ("local",)


def vector_store(name: str, spark: SparkSession, path: str):
    """(read, append) of a chunk table with an embedding column."""
    if name not in VECTOR_STORES:
        raise ValueError(f"vector store {name!r} isn't available; one of {', '.join(VECTOR_STORES)}")
    return (lambda: spark.read.parquet(path)), (lambda rows: rows.write.mode("append").parquet(path))


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """A mesh as Wavefront OBJ lines: vertices (vid, x, y, z) in order, then faces (a, b, c) from 0."""
    v = vertices.orderBy("vid").select(F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"), F.lit(0).alias("_p"), F.col("vid").alias("_i"))
    f = faces.select(F.concat_ws(" ", F.lit("f"), *[(F.col(c) + 1).cast("string") for c in "abc"]).alias("value"), F.lit(1).alias("_p"), F.col("a").alias("_i"))
    v.union(f).orderBy("_p", "_i").select("value").write.mode("overwrite").text(path)
