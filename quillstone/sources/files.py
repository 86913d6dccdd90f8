"""Files in and out: the CSV template of ad-hoc batches, the CSV report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATE = "transaction_id string, date string, description string, amount string, vendor_name string, tax_code string, account_code string, invoice_number string, type string, currency_code string"


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the template, typed; bad marks those whose date or amount can't be read, which callers set aside."""
    rows = spark.read.csv(path, schema=TEMPLATE, header=True, escape='"')
    typed = rows.withColumn("date", F.try_to_date("date", "yyyy-MM-dd")).withColumn("amount", F.col("amount").try_cast("decimal(12,2)"))
    return typed.withColumn("bad", F.col("date").isNull() | F.col("amount").isNull() | F.col("transaction_id").isNull())


#: The report's columns: as operators name them, and as readers see them.
REPORT = {"contact": "Contact", "transaction": "Transaction", "date": "Date", "amount": "Amount", "status": "Status", "duplicate_of": "Duplicate Of", "action": "Action", "severity": "Severity", "confidence": "Confidence", "reason": "Reason"}


def report_lines(report: DataFrame) -> DataFrame:
    """(company_id, section, place, contact, line): the report as lines of text. A section opens with its title and the columns, and ends in a blank line.

    The title is led by a byte order mark, as spreadsheets need one to read currency signs."""
    row = F.to_csv(F.struct(*REPORT), {"escape": '"', "emptyValue": "", "nullValue": ""})
    body = report.select("company_id", "section", F.lit(2).alias("place"), "contact", row.alias("line"))
    title = F.concat(F.lit("\ufeff"), F.col("section"), F.lit(" — "), F.col("n"), F.lit(" issue(s)"))
    head = report.groupBy("company_id", "section").agg(F.count(F.lit(1)).alias("n"))
    around = head.select("company_id", "section", F.explode(F.array(*(F.struct(F.lit(p).alias("place"), t.alias("line")) for p, t in ((0, title), (1, F.lit(",".join(REPORT.values()))), (3, F.lit("")))))).alias("x"))
    return body.unionByName(around.select("company_id", "section", "x.place", F.lit("").alias("contact"), "x.line"))


def write_report(report: DataFrame, path: str) -> None:
    """A folder for each company and section with a file of text in it, rows by contact."""
    rows = report_lines(report).repartition("company_id", "section").sortWithinPartitions("company_id", "section", "place", "contact", "line")
    rows.select("company_id", "section", "line").write.partitionBy("company_id", "section").text(path)
