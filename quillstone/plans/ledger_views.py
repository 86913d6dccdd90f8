"""The test tables seen as a ledger: orders as sales documents with lines, lineitem as bills without lines, payments derived from both.

One text serves Spark and DuckDB, which differ in how they name tables and add days. Rules never see these tables: they take the
frames that the functions below return.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import small

AS_OF = date(2001, 12, 31)
COMPANY = "co1"

_VIEWS = {
    "v_line": """SELECT l_orderkey AS ord, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS INT) AS line_no,
       l_suppkey AS supp, CAST(l_shipdate AS DATE) AS ship, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount, l_linestatus AS ls,
       CASE p_type WHEN 'ECONOMY' THEN '200' WHEN 'MEDIUM' THEN '260' WHEN 'SMALL' THEN '429' WHEN 'LARGE' THEN '710' WHEN 'STANDARD' THEN '461' ELSE '473' END AS account_code,
       CASE WHEN l_tax = 0 AND l_discount = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'OUTPUT2' WHEN l_returnflag = 'N' THEN 'NONE' ELSE 'INPUT2' END AS tax_code,
       p_name AS description
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "v_sales": """SELECT o_orderkey AS seq, concat('O', o_orderkey) AS transaction_id, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
       concat('C', o_custkey) AS contact_id, c_name AS vendor_name, CASE WHEN o_orderkey % 10 = 0 THEN 'ACCRECCREDIT' ELSE 'ACCREC' END AS type,
       CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'O' THEN 'AUTHORISED' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'DRAFT' ELSE 'SUBMITTED' END END AS status,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('INV-', o_orderkey % 8) END AS invoice_number, concat('PO-', o_orderkey % 5) AS reference,
       CAST(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice WHEN o_orderkey % 23 = 0 THEN 10.00 ELSE 0.00 END AS DECIMAL(12,2)) AS amount_due,
       CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_attachments
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "v_bills": """SELECT ord * 100 + line_no AS seq, concat('L', ord, '-', line_no) AS transaction_id, ship AS date, amount, concat('S', supp) AS contact_id, s_name AS vendor_name,
       'ACCPAY' AS type, CASE ls WHEN 'F' THEN 'PAID' ELSE 'AUTHORISED' END AS status, account_code, tax_code, description,
       CASE ord % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_attachments
FROM v_line JOIN {supplier} ON supp = s_suppkey""",
    "v_bank": """SELECT concat('BR', o_orderkey) AS transaction_id, 'RECEIVE' AS type, concat('C', o_custkey) AS contact_id, {day:CAST(o_orderdate AS DATE):CAST(o_orderkey % 45 AS INT)} AS date, CAST(CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS DECIMAL(12,2)) AS amount, o_orderkey AS seq, o_orderkey % 4 = 0 AS reconciled, concat('ACC', o_orderkey % 3) AS bank_account
FROM {orders}
UNION ALL
SELECT concat('BS', ord, '-', line_no), 'SPEND', concat('S', supp), {day:ship:CAST(ord % 45 AS INT)}, CAST(CASE WHEN ord % 6 = 1 THEN amount ELSE amount + 1 END AS DECIMAL(12,2)), 1000000000 + ord * 100 + line_no, ord % 4 = 0, concat('ACC', ord % 3) FROM v_line""",
    "docs": """SELECT s.seq, s.transaction_id, s.date, s.amount, s.contact_id, s.vendor_name, s.type, s.status, s.invoice_number, s.reference, s.amount_due, f.account_code, f.tax_code, f.description, s.has_attachments
FROM v_sales s LEFT JOIN v_line f ON f.ord = s.seq AND f.line_no = 1
UNION ALL
SELECT seq, transaction_id, date, amount, contact_id, vendor_name, type, status, CAST(NULL AS VARCHAR(9)), CAST(NULL AS VARCHAR(9)), CAST(NULL AS DECIMAL(12,2)), account_code, tax_code, description, has_attachments FROM v_bills""",
    "lines": """SELECT s.seq, s.transaction_id, l.line_no, l.account_code, l.tax_code, l.amount, l.description FROM v_sales s JOIN v_line l ON l.ord = s.seq
UNION ALL
SELECT seq, transaction_id, CAST(NULL AS INT), account_code, tax_code, amount, description FROM v_bills
UNION ALL
SELECT d.seq, d.transaction_id, CAST(NULL AS INT), d.account_code, d.tax_code, d.amount, d.description FROM v_sales v JOIN docs d ON d.transaction_id = v.transaction_id WHERE NOT EXISTS (SELECT 1 FROM v_line l WHERE l.ord = v.seq)""",
}

#: v_line as Spark plans it well: the same rows, numbered within ord itself, so that what groups or joins lines by ord needs no second exchange, and each column is dealt once, as it is read.
_SPARK_LINE = """SELECT ord, CAST(row_number() OVER (PARTITION BY ord ORDER BY l_linenumber, l_partkey, supp, l_shipdate, l_extendedprice, l_quantity) AS INT) AS line_no,
       supp, CAST(l_shipdate AS DATE) AS ship, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount, ls,
       CASE p_type WHEN 'ECONOMY' THEN '200' WHEN 'MEDIUM' THEN '260' WHEN 'SMALL' THEN '429' WHEN 'LARGE' THEN '710' WHEN 'STANDARD' THEN '461' ELSE '473' END AS account_code, tax_code, description
FROM (SELECT l_orderkey AS ord, l_linenumber, l_partkey, l_suppkey AS supp, l_shipdate, l_extendedprice, l_quantity, l_linestatus AS ls, p_type,
       CASE WHEN l_tax = 0 AND l_discount = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'OUTPUT2' WHEN l_returnflag = 'N' THEN 'NONE' ELSE 'INPUT2' END AS tax_code, p_name AS description
       FROM {lineitem} JOIN {part} ON l_partkey = p_partkey)"""

#: Chart of accounts and tax rates of the derived codes.
ACCOUNTS = [("200", "Sales", "REVENUE"), ("260", "Other Revenue", "OTHERINCOME"), ("429", "General Expenses", "EXPENSE"), ("461", "Printing & Stationery", "EXPENSE"), ("473", "Repairs and Maintenance", "EXPENSE"), ("710", "Office Equipment", "FIXED")]
TAXES = [("OUTPUT2", "20", False, True), ("INPUT2", "20", True, False), ("NONE", "0", True, True)]


def _sql(name: str, table, day, views: dict[str, str] = _VIEWS) -> str:
    text = views[name]
    for t in ("lineitem", "part", "orders", "customer", "supplier"):
        text = text.replace("{" + t + "}", table(t))
    while (a := text.find("{day:")) >= 0:
        e = text.index("}", a)
        d, _, n = text[a + 5 : e].partition(":")
        text = text[:a] + day(d, n) + text[e + 1 :]
    return text


def duckdb_prelude() -> str:
    """WITH clause of all views, and coa and taxes, for the oracle SQL."""
    parts = [f"{n} AS ({_sql(n, lambda t: t, lambda d, k: f'({d} + {k})')})" for n in _VIEWS]
    parts.append("coa(code, name, type) AS (VALUES " + ", ".join(f"('{c}', '{n}', '{t}')" for c, n, t in ACCOUNTS) + ")")
    parts.append("taxes(code, rate, expenses, revenue) AS (VALUES " + ", ".join(f"('{c}', '{r}', {e}, {v})" for c, r, e, v in TAXES) + ")")
    return "WITH " + ",\n".join(parts) + "\n"


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    needs = {"v_line": [], "v_sales": [], "v_bills": ["v_line"], "v_bank": ["v_line"]}[name]
    text = lambda n: _sql(n, lambda t: f"parquet.`{sf_dir}/{t}.parquet`", lambda d, k: f"date_add({d}, {k})", _VIEWS | {"v_line": _SPARK_LINE})
    head = "WITH " + ", ".join(f"{n} AS ({text(n)})" for n in needs) if needs else ""
    return spark.sql(f"{head} {text(name)}")


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "v_line")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales documents with their lines as an array; header codes are the first line's."""
    head = _view(spark, sf_dir, "v_sales")
    # the first line's codes are aggregates of their own: who reads no lines gathers none, as Spark then drops the array
    codes = [F.min_by(c, "line_no").alias(c) for c in ("account_code", "tax_code", "description")]
    lines = line_rows(spark, sf_dir).groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("line_no", "account_code", "tax_code", "amount", "description"))).alias("line_items"), *codes)
    return _txn(head.join(lines, head["seq"] == lines["ord"], "left").drop("ord"))


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase documents without lines: rules on lines fall back to their headers."""
    kind = "array<struct<line_no:int,account_code:string,tax_code:string,amount:decimal(12,2),description:string>>"
    plain = _view(spark, sf_dir, "v_bills").select("*", *(F.lit(None).cast(k).alias(n) for n, k in (("invoice_number", "string"), ("reference", "string"), ("amount_due", "decimal(12,2)"), ("line_items", kind))))
    return _txn(plain)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).unionByName(bills(spark, sf_dir))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank receipts and payments, header only and without codes."""
    kind = "array<struct<line_no:int,account_code:string,tax_code:string,amount:decimal(12,2),description:string>>"
    empty = (("vendor_name", "string"), ("status", "string"), ("invoice_number", "string"), ("reference", "string"), ("amount_due", "decimal(12,2)"), ("account_code", "string"), ("tax_code", "string"), ("description", "string"), ("has_attachments", "boolean"), ("line_items", kind))
    plain = _view(spark, sf_dir, "v_bank")
    return _txn(plain.select("*", *(F.lit(None).cast(k).alias(n) for n, k in empty)), "reconciled", "bank_account")


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and bank in one, whose lines are dealt and numbered once for bills and payments: a line gives the bill of each supplier of its number, and a payment."""
    part, ord_, no = F.col("part"), F.col("ord"), F.col("line_no")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    lines = line_rows(spark, sf_dir).withColumn("part", F.explode(F.array(F.lit("L"), F.lit("BS"))))
    rows = lines.join(s, (part == "L") & (F.col("supp") == F.col("s_suppkey")), "left").where((part == "BS") | F.col("s_suppkey").isNotNull())
    bill = part == "L"
    own = lambda c, kind="string": F.when(bill, c).cast(kind)
    paid = F.when(ord_ % 6 == 1, F.col("amount")).otherwise(F.col("amount") + 1).cast("decimal(12,2)")
    seq = ord_ * 100 + no
    columns = {
        "seq": F.when(bill, seq).otherwise(seq + 1000000000),
        "transaction_id": F.concat(part, ord_.cast("string"), F.lit("-"), no.cast("string")),
        "date": F.when(bill, F.col("ship")).otherwise(F.date_add("ship", (ord_ % 45).cast("int"))),
        "amount": F.when(bill, F.col("amount")).otherwise(paid),
        "contact_id": F.concat(F.lit("S"), F.col("supp").cast("string")),
        "vendor_name": own(F.col("s_name")),
        "type": F.when(bill, "ACCPAY").otherwise("SPEND"),
        "status": own(F.when(F.col("ls") == "F", "PAID").otherwise("AUTHORISED")),
        "account_code": own(F.col("account_code")),
        "tax_code": own(F.col("tax_code")),
        "description": own(F.col("description")),
        "has_attachments": own(F.when(ord_ % 3 == 0, True).when(ord_ % 3 == 1, False), "boolean"),
        "reconciled": F.when(~bill, ord_ % 4 == 0),
        "bank_account": F.when(~bill, F.concat(F.lit("ACC"), (ord_ % 3).cast("string"))),
    }
    sold = sales(spark, sf_dir)
    empty = (F.lit(None).cast(sold.schema[c].dataType).alias(c) for c in ("invoice_number", "reference", "amount_due", "line_items"))
    spent = _txn(rows.select(*(c.alias(n) for n, c in columns.items()), *empty), "reconciled", "bank_account")
    return sold.unionByName(spent, allowMissingColumns=True).unionByName(bank(spark, sf_dir).where("type = 'RECEIVE'"))


def _txn(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.lit(COMPANY).alias("company_id"), "seq", "transaction_id", "date", "amount", "contact_id", "vendor_name", "type", "status", "invoice_number", "reference", "amount_due", "account_code", "tax_code", "description", "has_attachments", F.lit(None).cast("decimal(12,2)").alias("amount_paid"), F.lit(None).cast("decimal(12,2)").alias("allocated_amount"), F.lit(None).cast("date").alias("posted_date"), F.date_add("date", 30).alias("due_date"), "line_items", *more)


def accounts(spark: SparkSession) -> DataFrame:
    return small(spark, [(COMPANY, *a) for a in ACCOUNTS], "company_id string, code string, name string, type string")


def tax_rates(spark: SparkSession) -> DataFrame:
    return small(spark, [(COMPANY, *t) for t in TAXES], "company_id string, code string, rate string, applies_to_expenses boolean, applies_to_revenue boolean")
