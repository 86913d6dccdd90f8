"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and all run on this machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master or ""):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        own = tempfile.mkdtemp(prefix="quillstone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder: cuts lineage, and survives lost executors."""
    at = new_folder(df.sparkSession, label)
    df.write.option("compression", compression).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df less the columns that an operator is about to add: an output column replaces an input column of its name."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


#: Rows that Spark hands to a Python worker at once, at most: texts may be long, and a batch is held on both sides.
BATCH_ROWS = 512


def bounded(df: DataFrame) -> DataFrame:
    """df, after lowering the session's rows per Arrow batch to BATCH_ROWS where it is higher or unlimited."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def plus(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """df's schema with further fields."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.DataType.fromDDL(k)) for n, k in fields)])
