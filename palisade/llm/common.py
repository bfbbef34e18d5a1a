"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def text_name(doc_id: Column, text: Column) -> Column:
    """128 bits for an id with its text; null and empty texts are the same."""
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))), 256), 1, 32))


def rest_of_row(columns: list[str], *but: str) -> Column:
    """An order for rows that agree in the columns named: a hash of all others."""
    return F.sha2(F.to_json(F.struct(F.lit(0).alias(" "), *[F.col(f"`{c}`") for c in columns if c not in but])), 256)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Where that is unset a folder of our own, in
    local mode only: a cluster's machines don't share one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="palisade-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read that. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palisade-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
