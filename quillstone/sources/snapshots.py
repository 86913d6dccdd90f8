"""A served table: one row a company, laid out in buckets, so that an update rewrites and a look-up reads only the buckets concerned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..operators.groups import shared_folder
from ..operators.verdicts import latest


def bucket_of(company: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(company), F.lit(buckets)).cast("int")


class ServedTable:
    """Rows by company_id under a folder, partitioned by bucket; the row of the latest order column stays. buckets: so many that one is a file of some 100 MB."""

    def __init__(self, spark: SparkSession, path: str, schema: str, order: str = "computed_at", buckets: int = 64):
        self.spark, self.path, self.order, self.buckets = spark, path, order, buckets
        self.schema = StructType.fromDDL(schema)

    def read(self) -> DataFrame:
        """All rows; none before the first upsert."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], StructType([*self.schema.fields]).add("bucket", IntegerType()))
        return self.spark.read.schema(StructType([*self.schema.fields]).add("bucket", IntegerType())).parquet(self.path)

    def upsert(self, rows: DataFrame) -> None:
        """Takes in rows: a company's latest by the order column stays, old ones included. Only the buckets of these companies are read and written; rows of null company_id are left out."""
        shared_folder(self.spark)  # for checkpoints
        names = self.schema.names
        new = rows.where(F.col("company_id").isNotNull()).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).withColumn("bucket", bucket_of(F.col("company_id"), self.buckets)).checkpoint()
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most as many numbers as there are buckets
        if not touched:
            return
        old = self.read().where(F.col("bucket").isin(touched))
        merged = latest(old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))), ["company_id"], self.order, "_new").select(*names, "bucket").checkpoint()  # cut off from the files that are replaced
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def of(self, company: str) -> DataFrame:
        """The row of a company, if any: its bucket alone is listed and read."""
        number = self.spark.range(1).select(bucket_of(F.lit(company), self.buckets)).first()[0]
        return self.read().where((F.col("bucket") == number) & (F.col("company_id") == company)).drop("bucket")
