"""Sources, reshaping, column functions, streaming and fixes over the test ledger, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ..functions import classify as Z
from ..functions import dates as T
from ..functions import text as X
from ..functions.similarity import name_similarity
from ..operators import contact_rules as C
from ..operators import documents as D
from ..operators import flag_ops as O
from ..operators import kpis as K
from ..operators import scored_rules as G
from ..operators import verdicts as S
from ..operators.groups import connected, shared_folder
from ..sources import files as W
from ..sources import mirror as M
from ..sources import reports as R
from ..streaming import ingest as I
from . import ledger_views as V
from .kpi_queries import _SECTIONS, _sections, _t
from .rule_queries import PRELUDE, contacts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def source(name: str, sql: str | None = None, prelude: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql:
            text = sql.lstrip()
            SQL[name] = text if not prelude else PRELUDE + text if text[:4].upper() != "WITH" else PRELUDE.rstrip() + ",\n" + text[5:]
        return f

    return add


def _folder(s, label: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(s)}/{label}-{uuid.uuid4().hex}"


def _raw(entity, df, ident, json):
    return df.select(F.lit(V.COMPANY).alias("company_id"), F.lit(entity).alias("entity"), ident.cast("string").alias("source_id"), F.to_json(json).alias("raw_json"), F.timestamp_seconds(F.lit(0)).alias("synced_ts"))


def raw_documents(s, d):
    """Sales as invoices and credit notes, payments for some, and rows that aren't JSON."""
    v = V.sales(s, d)
    items = F.transform("line_items", lambda x: F.struct(x["account_code"].alias("AccountCode"), x["tax_code"].alias("TaxType"), x["amount"].cast("string").alias("LineAmount"), x["description"].alias("Description")))
    day = F.concat(F.lit("/Date("), F.unix_date("date").cast("bigint") * 86400000, F.lit("+0000)/"))
    when = F.when(F.col("seq") % 2 == 0, day).otherwise(F.concat(F.col("date").cast("string"), F.lit("T00:00:00")))
    status = F.when(F.col("seq") % 31 == 0, "VOIDED").otherwise(F.concat(F.lit(" "), F.lower("status")))
    common = [when.alias("Date"), status.alias("Status"), F.struct(F.col("contact_id").alias("ContactID"), F.when(F.col("seq") % 37 > 0, F.col("vendor_name")).alias("Name")).alias("Contact"), F.col("amount").cast("string").alias("Total"), F.when(F.col("seq") % 4 > 0, F.col("reference")).alias("Reference"), items.alias("LineItems")]
    inv = _raw("invoices", v.where("type = 'ACCREC'"), F.col("transaction_id"), F.struct(F.col("transaction_id").alias("InvoiceID"), F.col("type").alias("Type"), F.col("invoice_number").alias("InvoiceNumber"), F.col("amount_due").cast("string").alias("AmountDue"), *common))
    cn = _raw("credit_notes", v.where("type = 'ACCRECCREDIT'"), F.col("transaction_id"), F.struct(F.col("transaction_id").alias("CreditNoteID"), F.col("invoice_number").alias("CreditNoteNumber"), F.col("amount_due").cast("string").alias("RemainingCredit"), *common))
    pay = _raw("payments", v.where("seq % 3 = 0"), F.col("transaction_id"), F.struct(F.when(F.col("seq") % 2 == 0, "true").otherwise("false").alias("IsReconciled"), F.struct(F.col("transaction_id").alias("InvoiceID")).alias("Invoice")))
    junk = v.where("seq % 50 = 0").select(F.lit(V.COMPANY), F.lit("invoices"), F.col("transaction_id"), F.lit("[1, 2]"), F.timestamp_seconds(F.lit(0)))
    return inv.union(cn).union(pay).union(junk)


_P1 = """SELECT s.transaction_id, CAST(s.date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount, coalesce(CASE WHEN s.seq % 4 > 0 THEN reference END, f.description, CASE WHEN s.seq % 37 > 0 THEN vendor_name ELSE 'Unknown Vendor' END || ' — ' || type) AS description, CASE WHEN s.seq % 37 > 0 THEN vendor_name ELSE 'Unknown Vendor' END AS vendor_name, type, status, coalesce(invoice_number, '') AS invoice_number, CAST(amount_due AS DOUBLE) AS amount_due, coalesce(f.account_code, '') AS account_code, coalesce(f.n, 0) AS n_lines, s.seq % 6 = 0 AS reconciled
FROM v_sales s LEFT JOIN (SELECT l.ord, l.account_code, l.description, c.n FROM v_line l JOIN (SELECT ord, count(*) AS n FROM v_line GROUP BY 1) c ON c.ord = l.ord WHERE line_no = 1) f ON f.ord = s.seq WHERE s.seq % 31 > 0"""


@source("s01_s02_p01_documents", _P1, prelude=True)
def p01(s, d):
    t = M.documents(raw_documents(s, d))
    return t.select("transaction_id", F.col("date").cast("string").alias("date"), F.col("amount").cast("double").alias("amount"), "description", "vendor_name", "type", "status", F.coalesce("invoice_number", F.lit("")).alias("invoice_number"), F.col("amount_due").cast("double").alias("amount_due"), F.coalesce("account_code", F.lit("")).alias("account_code"), F.greatest(F.coalesce(F.size("line_items"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), "reconciled")


@source("p02_bank_transactions", "SELECT transaction_id, CAST(date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount, contact_id, type, reconciled, bank_account FROM v_bank WHERE seq % 5 > 0", prelude=True)
def p02(s, d):
    b = V.bank(s, d)
    j = F.struct(F.col("transaction_id").alias("BankTransactionID"), F.when(F.col("seq") % 5 > 0, F.lower("type")).otherwise("SPEND-OVERPAYMENT").alias("Type"), F.col("date").cast("string").alias("Date"), F.col("amount").cast("string").alias("Total"), F.struct(F.col("contact_id").alias("ContactID")).alias("Contact"), F.col("reconciled").cast("string").alias("IsReconciled"), F.struct(F.col("bank_account").alias("AccountID")).alias("BankAccount"))
    t = M.bank(_raw("bank_transactions", b, F.col("transaction_id"), j))
    return t.select("transaction_id", F.col("date").cast("string").alias("date"), F.col("amount").cast("double").alias("amount"), "contact_id", "type", "reconciled", "bank_account")


@source("p03_journals", "SELECT concat('J', ord) AS transaction_id, CAST(min(ship) AS VARCHAR) AS date, CAST(max(amount) AS DOUBLE) AS amount, CAST(count(*) AS BIGINT) AS n_lines FROM v_line WHERE ord % 2 = 0 GROUP BY ord", prelude=True)
def p03(s, d):
    g = V.line_rows(s, d).groupBy("ord").agg(F.min("ship").alias("day"), F.collect_list(F.struct(F.col("account_code").alias("AccountCode"), F.lit(" ").alias("Description"), (-F.col("amount")).cast("string").alias("NetAmount"))).alias("JournalLines"))
    j = F.struct(F.concat(F.lit("J"), "ord").alias("JournalID"), F.col("day").cast("string").alias("JournalDate"), F.when(F.col("ord") % 2 == 0, "ManJournal").otherwise("ACCREC").alias("SourceType"), "JournalLines")
    t = M.journals(_raw("journals", g, F.col("ord"), j))
    return t.select("transaction_id", F.col("date").cast("string").alias("date"), F.col("amount").cast("double").alias("amount"), F.size("line_items").cast("long").alias("n_lines"))


@source("p04_accounts", "SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'BANK' WHEN 1 THEN 'EXPENSE' ELSE 'CURRLIAB' END AS type, CASE s_suppkey % 3 WHEN 1 THEN 'P&L' ELSE 'Balance Sheet' END AS statement FROM supplier WHERE s_suppkey % 7 > 0")
def p04(s, d):
    v = _t(s, d, "supplier")
    kind = F.get(F.array(F.lit("bank"), F.lit("expense "), F.lit("Currliab")), (F.col("s_suppkey") % 3).cast("int"))
    return M.accounts(_raw("accounts", v, F.col("s_suppkey"), F.struct(F.when(F.col("s_suppkey") % 7 > 0, F.concat(F.lit(" "), "s_suppkey")).alias("Code"), F.col("s_name").alias("Name"), kind.alias("Type")))).drop("company_id")


@source("p05_tax_rates", "SELECT concat('T', n_nationkey) AS code, CAST(CAST(CASE n_nationkey % 3 WHEN 0 THEN n_nationkey + 1 WHEN 1 THEN 5 ELSE 0 END AS DECIMAL(9,2)) AS VARCHAR) AS rate, CASE n_nationkey % 2 WHEN 0 THEN 'true' ELSE 'false' END AS expenses, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'true' END AS revenue FROM nation")
def p05(s, d):
    n = _t(s, d, "nation")
    k = F.col("n_nationkey")
    j = F.struct(F.concat(F.lit("T"), k).alias("TaxType"), F.when(k % 3 == 0, (k + 1).cast("string")).otherwise("0").alias("EffectiveRate"), F.when(k % 3 == 1, "5.000").alias("DisplayTaxRate"), F.when(k % 2 == 0, "True").otherwise("no").alias("CanApplyToExpenses"), F.when(k % 5 == 0, "?").otherwise("1").alias("CanApplyToRevenue"))
    return M.tax_rates(_raw("tax_rates", n, k, j)).select("code", "rate", F.col("applies_to_expenses").cast("string").alias("expenses"), F.coalesce(F.col("applies_to_revenue").cast("string"), F.lit("")).alias("revenue"))


@source("p06_contact_defaults", "SELECT concat('C', c_custkey) AS contact_id, CASE WHEN c_custkey % 3 > 0 THEN '200' ELSE '' END AS sales_account, CASE WHEN c_custkey % 5 > 0 THEN 'OUTPUT2' ELSE '' END AS sales_tax FROM customer WHERE c_custkey % 15 > 0")
def p06(s, d):
    c = contacts(s, d).where("is_customer")
    j = F.struct(F.col("contact_id").alias("ContactID"), F.col("name").alias("Name"), F.coalesce("sales_account", F.lit(" ")).alias("SalesDefaultAccountCode"), F.col("sales_tax").alias("AccountsReceivableTaxType"))
    return M.contact_defaults(_raw("contacts", c, F.col("contact_id"), j)).select("contact_id", F.coalesce("sales_account", F.lit("")).alias("sales_account"), F.coalesce("sales_tax", F.lit("")).alias("sales_tax"))


@source("p06_contact_vat", "SELECT concat('C', c_custkey) AS contact_id, concat('GB', c_custkey % 50) AS vat FROM customer WHERE c_custkey % 4 > 0")
def p06v(s, d):
    c = contacts(s, d).where("is_customer")
    return M.contact_vat(_raw("contacts", c, F.col("contact_id"), F.struct(F.col("contact_id").alias("ContactID"), F.col("vat").alias("TaxNumber")))).drop("company_id")


@source("p07_payroll_names", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Ann ' || s_suppkey ELSE s_name END AS name FROM supplier")
def p07(s, d):
    v = _t(s, d, "supplier")
    even = F.col("s_suppkey") % 2 == 0
    return M.payroll_names(_raw("payroll_employees", v, F.col("s_suppkey"), F.struct(F.when(even, " Ann").alias("FirstName"), F.when(even, F.col("s_suppkey").cast("string")).alias("LastName"), F.col("s_name").alias("Name")))).select("name")


@source("s03_s04_first_row", "SELECT 'co1' AS company_id, min(n_name) FILTER (n_nationkey = 3) AS name, true AS has FROM nation")
def s03(s, d):
    n = _t(s, d, "nation")
    raw = _raw("organisation", n, F.col("n_nationkey"), F.struct(F.col("n_name").alias("Name"))).withColumn("synced_ts", F.timestamp_seconds(F.abs(F.col("source_id").cast("int") - 3)))
    one = M.first_row(raw, "organisation", "struct<Name:string>").select("company_id", F.col("j.Name").alias("name"))
    return one.join(M.has_documents(raw.withColumn("entity", F.lit("invoices"))).withColumn("has", F.lit(True)), "company_id")


@source("s09_h18_trial_balance", "SELECT concat('id', s_suppkey) AS account_id, CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal ELSE 0 END - CASE WHEN s_suppkey % 2 = 1 THEN s_acctbal ELSE 0 END AS DOUBLE) AS balance FROM supplier")
def s09(s, d):
    v = _t(s, d, "supplier").select("s_suppkey", "s_name", F.format_number("s_acctbal", 2).alias("m"))
    cell = lambda value, ident=None: F.struct(value.alias("Value"), F.array(F.struct(F.lit("account").alias("Id"), (ident if ident is not None else F.lit("")).alias("Value"))).alias("Attributes"))
    even = F.col("s_suppkey") % 2 == 0
    label = F.concat("s_name", F.lit(" ("), "s_suppkey", F.lit(")"))
    row = F.struct(F.lit("Row").alias("RowType"), F.lit(None).cast("string").alias("Title"), F.array(cell(label, F.concat(F.lit("id"), "s_suppkey")), cell(F.lit("1")), cell(F.lit("2")), cell(F.when(even, F.col("m")).otherwise("")), cell(F.when(~even, F.col("m")).otherwise(""))).alias("Cells"))
    section = F.struct(F.lit("Section").alias("RowType"), F.lit("Assets").alias("Title"), F.array(row).alias("Rows"))
    reports = v.select(F.lit(V.COMPANY).alias("company_id"), F.to_json(F.struct(F.array(section).alias("Rows"))).alias("report_json"))
    return R.trial_balance(reports).select("account_id", "code", "name", F.col("balance").cast("double").alias("balance"))


@source("s10_k25_statutory_filings", "SELECT concat('co', s_suppkey % 10) AS company_id, concat(1990 + s_suppkey % 7, '-12-31') AS period_end, CAST(arg_max(-round(s_acctbal * 1000), s_suppkey) AS DOUBLE) AS value FROM supplier GROUP BY 1, 2")
def s10(s, d):
    v = _t(s, d, "supplier")
    year = F.concat(1990 + F.col("s_suppkey") % 7, F.lit("-12-31"))
    ns = 'xmlns:ix="http://www.xbrl.org/2013/inlineXBRL" xmlns:xbrli="http://www.xbrl.org/2003/instance"'
    xml = F.concat(F.lit(f'<html {ns}><xbrli:context id="c1"><xbrli:period><xbrli:instant>'), year, F.lit('</xbrli:instant></xbrli:period></xbrli:context><p><ix:nonFraction name="core:Equity" contextRef="c1">1</ix:nonFraction><ix:nonFraction name="core:NetAssetsLiabilities" contextRef="c1" sign="-" scale="3">'), F.format_number("s_acctbal", 3), F.lit("</ix:nonFraction></p></html>"))
    docs = v.select(F.concat(F.lit("co"), F.col("s_suppkey") % 10).alias("company_id"), F.col("s_suppkey").alias("filed_on"), xml.alias("document"))
    return R.filings(docs).select("company_id", F.col("period_end").cast("string").alias("period_end"), F.round(F.col("value").cast("double")).alias("value"))


@source("s11_csv_template", "SELECT concat('O', o_orderkey) AS transaction_id, CASE WHEN o_orderkey % 9 > 0 THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) ELSE -1 END AS amount, o_orderkey % 9 = 0 AS bad FROM orders")
def s11(s, d):
    at = _folder(s, "template")
    o = _t(s, d, "orders")
    cols = {"transaction_id": F.concat(F.lit("O"), "o_orderkey"), "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "description": F.lit('said "so", twice'), "amount": F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice").cast("decimal(12,2)").cast("string")).otherwise("n/a")}
    o.select(*(v.alias(k) for k, v in cols.items()), *(F.lit("").alias(c.split()[0]) for c in W.TEMPLATE.split(", ")[4:])).write.mode("overwrite").csv(at, header=True, escape='"')
    return W.read_template(s, at).select("transaction_id", F.coalesce(F.col("amount").cast("double"), F.lit(-1.0)).alias("amount"), "bad")


@source("t01_streaming_upsert", "SELECT CAST(user_id AS VARCHAR) AS source_id, arg_max(event_type, ts) AS raw_json FROM events GROUP BY 1")
def t01(s, d):
    base = _folder(s, "stream")
    e = _t(s, d, "events").select(F.lit(V.COMPANY).alias("company_id"), F.lit("events").alias("entity"), F.col("user_id").cast("string").alias("source_id"), F.col("event_type").alias("raw_json"), F.col("ts").alias("updated_ts"))
    for k in range(2):  # two landings, the second repeating some of the first
        (e if k else e.where("hour(updated_ts) < 12")).write.mode("overwrite").json(f"{base}/landing/{k}")
        I.start(s, f"{base}/landing/*", f"{base}/state", f"{base}/checkpoint").awaitTermination()
    return I.current(s, f"{base}/state").select("source_id", "raw_json")


@source("t02_watermark_advance", "SELECT user_id AS company_id, event_type AS entity, CAST(max(ts) FILTER (event_id % 3 > 0) AS VARCHAR) AS watermark FROM events GROUP BY 1, 2 HAVING max(ts) FILTER (event_id % 3 > 0) IS NOT NULL")
def t02(s, d):
    e = _t(s, d, "events").select(F.col("user_id").alias("company_id"), F.col("event_type").alias("entity"), F.col("ts").alias("started"), F.when(F.col("event_id") % 3 == 0, "timeout").alias("error"))
    state = e.select("company_id", "entity").distinct().withColumn("watermark", F.lit(None).cast("timestamp"))
    return I.advanced(state, e).where("watermark is not null").select("company_id", "entity", F.date_format("watermark", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("watermark"))


SQL["t02_watermark_advance"] = SQL["t02_watermark_advance"].replace("CAST(max(ts) FILTER (event_id % 3 > 0) AS VARCHAR)", "strftime(max(ts) FILTER (event_id % 3 > 0), '%Y-%m-%d %H:%M:%S.%f')")


@source("h26_connection_health", "SELECT user_id AS company_id, CASE WHEN bool_or(coalesce(event_id % 40 = 0, false)) THEN 'true' WHEN bool_or(event_id % 3 > 0 AND event_id % 40 > 0) THEN 'false' ELSE '' END AS needs FROM events GROUP BY 1")
def h26(s, d):
    e = _t(s, d, "events").select(F.col("user_id").alias("company_id"), F.when(F.col("event_id") % 40 == 0, "auth").when(F.col("event_id") % 3 == 0, "timeout").alias("error"))
    return I.connection_health(e).select("company_id", F.coalesce(F.col("needs_reconnect").cast("string"), F.lit("")).alias("needs"))


# --- column functions --------------------------------------------------------------


@source("x03_x04_company_names", r"""WITH w AS (SELECT s_suppkey, list_filter(string_split(trim(regexp_replace(lower('The ' || s_name || ' Trading Co. Ltd'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x NOT IN ('the', 'co', 'ltd')) AS l FROM supplier)
SELECT s_suppkey, array_to_string(l, ' ') AS plain, array_to_string(list_filter(l, lambda x: x <> 'trading'), ' ') AS core FROM w""")
def x03(s, d):
    v = _t(s, d, "supplier").select("s_suppkey", X.company_name(F.concat(F.lit("The "), "s_name", F.lit(" Trading Co. Ltd"))).alias("plain"))
    return v.withColumn("core", X.distinctive_name("plain"))


@source("x05_name_similarity", "SELECT s_suppkey, 1.0 AS same, 0.0 AS nothing FROM supplier")
def x05(s, d):
    v = _t(s, d, "supplier")
    return v.select("s_suppkey", F.round(name_similarity("s_name", F.concat(F.lit("THE "), "s_name", F.lit(" Limited"))), 6).alias("same"), name_similarity("s_name", F.lit("")).alias("nothing"))


#: The common subsequence of two texts of at most 62 characters by bits, and the similarity of two names without fillers.
_BITS = "map_from_entries(list_transform(list_distinct(string_split({a}, '')), lambda ch: (ch, list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = ch THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT)))"
_COMMON = "(length({a}) - bit_count(list_reduce(list_prepend((1::BIGINT << length({a})) - 1, list_transform(string_split({b}, ''), lambda ch: coalesce(({bits})[ch], 0))), lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length({a})) - 1))))"


def _common(a: str, b: str) -> str:
    return _COMMON.format(a=a, b=b, bits=_BITS.format(a=a))


@source("x05_similar_names", f"""WITH n AS (SELECT s_suppkey AS k, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS a, concat('customer ', reverse(lpad(CAST(s_suppkey * 7 AS VARCHAR), 9, '0'))) AS b FROM supplier),
w AS (SELECT *, array_to_string(list_sort(string_split(a, ' ')), ' ') AS p, array_to_string(list_sort(string_split(b, ' ')), ' ') AS q FROM n)
SELECT k AS s_suppkey, round(2 * greatest({_common('a', 'b')}, {_common('p', 'q')}) / (length(a) + length(b))::DOUBLE, 6) AS similar FROM w""")
def x05_similar(s, d):
    v = _t(s, d, "supplier")
    other = F.concat(F.lit("The Customer-"), F.reverse(F.lpad((F.col("s_suppkey") * 7).cast("string"), 9, "0")), F.lit(" Ltd"))
    return v.select("s_suppkey", F.round(name_similarity("s_name", other), 6).alias("similar"))


@source("x06_trigrams", "SELECT s_suppkey, CAST(len(list_distinct(list_transform(range(1, length(replace(s_name, ' ', '')) - 1), lambda i: substr(replace(s_name, ' ', ''), i, 3)))) AS INT) AS n FROM supplier")
def x06(s, d):
    return _t(s, d, "supplier").select("s_suppkey", F.size(X.trigrams("s_name")).alias("n"))


@source("x07_phones", "SELECT s_suppkey, '20' || lpad(CAST(s_suppkey AS VARCHAR), 8, '7') AS phone FROM supplier")
def x07(s, d):
    digits = F.concat(F.lit("20"), F.lpad(F.col("s_suppkey").cast("string"), 8, "7"))
    return _t(s, d, "supplier").select("s_suppkey", X.phone(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "+44 (").otherwise("0("), digits, F.lit(")"))).alias("phone"))


@source("x08_no_vat", "SELECT n_nationkey, n_nationkey % 4 IN (0, 2) AS none FROM nation")
def x08(s, d):
    codes = F.array(F.lit(" no vat "), F.lit("INPUT2"), F.lit("Outside Scope"), F.lit(""))
    return _t(s, d, "nation").select("n_nationkey", X.no_vat(F.get(codes, F.col("n_nationkey") % 4)).alias("none"))


_PHONES = ("concat('+44 (20) 79-', lpad(CAST(c_custkey AS STRING), 6, '0'))", "concat('0', c_custkey * 1237, ' ext')", "concat('00', c_custkey % 5000)", "concat('44', lpad(CAST(c_custkey AS STRING), 8, '3'))", "concat('tel. ', c_acctbal, '/', c_custkey)", "CAST(NULL AS STRING)")


@source("x07_phone_forms", "WITH t AS (SELECT c_custkey, CASE c_custkey % 6 " + " ".join(f"WHEN {k} THEN {p.replace('STRING', 'VARCHAR')}" for k, p in enumerate(_PHONES)) + r""" END AS t FROM customer), d AS (SELECT c_custkey, regexp_replace(coalesce(t, ''), '\D', '', 'g') AS d FROM t),
b AS (SELECT c_custkey, ltrim(CASE WHEN length(d) > 10 AND d LIKE '44%' THEN substr(d, 3) ELSE d END, '0') AS b FROM d) SELECT c_custkey, CASE WHEN length(b) >= 6 THEN b ELSE '' END AS phone FROM b""")
def x07_forms(s, d):
    text = F.expr("CASE c_custkey % 6 " + " ".join(f"WHEN {k} THEN {p}" for k, p in enumerate(_PHONES)) + " END")
    return _t(s, d, "customer").select("c_custkey", F.coalesce(X.phone(text), F.lit("")).alias("phone"))


_CODES = (" no vat ", "INPUT2", "Outside Scope", "", "N O N E", "no tax!", "x outside the uk", "NoTax", "nonesuch")


@source("x08_code_forms", "WITH t AS (SELECT o_orderkey, concat(CASE o_orderkey % 9 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CODES)) + " END, CASE WHEN o_orderkey % 7 = 0 THEN substr(o_orderpriority, 3, 3) ELSE '' END) AS t FROM orders) SELECT o_orderkey, upper(replace(t, ' ', '')) IN ('NONE', 'NOTAX', 'NOVAT') OR contains(upper(t), 'OUTSIDE') AS none FROM t")
def x08_forms(s, d):
    code = F.concat(F.get(F.array(*map(F.lit, _CODES)), (F.col("o_orderkey") % 9).cast("int")), F.when(F.col("o_orderkey") % 7 == 0, F.substring("o_orderpriority", 3, 3)).otherwise(""))
    return _t(s, d, "orders").select("o_orderkey", X.no_vat(code).alias("none"))


@source("x17_slugs_of_parts", "SELECT p_partkey, trim(regexp_replace(lower(concat(' ', p_name, ' / ', p_type, '__É#', p_partkey * 7919 % 1000, '!')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def x17_parts(s, d):
    return _t(s, d, "part").select("p_partkey", X.slug(F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_type", F.lit("__É#"), (F.col("p_partkey") * 7919 % 1000).cast("string"), F.lit("!"))).alias("slug"))


@source("x10_phrases", r"SELECT p_partkey, coalesce(regexp_extract(lower(p_name), '\b(widget|small|ring|bolt)s?\b', 1), '') AS found FROM part")
def x10(s, d):
    return _t(s, d, "part").select("p_partkey", X.phrase(F.concat("p_name", F.lit("s")), ("ring", "widget", "bolt", "small")).alias("found"))


SQL["x10_phrases"] = r"SELECT p_partkey, coalesce(regexp_extract(lower(p_name || 's'), '\b(widget|small|bolt|ring)s?\b', 1), '') AS found FROM part"


@source("x14_x16_labels", "SELECT s_suppkey, s_name AS name, CAST(s_suppkey AS VARCHAR) AS code, CASE WHEN s_suppkey % 2 = 0 THEN '£' ELSE 'EUR ' END AS symbol, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS money FROM supplier")
def x14(s, d):
    v = _t(s, d, "supplier")
    label = F.concat(F.lit("  "), "s_name", F.lit(" ("), "s_suppkey", F.lit(")"))
    return v.select("s_suppkey", X.label_name(label).alias("name"), X.label_code(label).alias("code"), X.currency_symbol(F.when(F.col("s_suppkey") % 2 == 0, "gbp").otherwise("eur")).alias("symbol"), X.money("s_acctbal").alias("money"))


@source("x17_slugs", "SELECT s_suppkey, 'supplier-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS slug FROM supplier")
def x17(s, d):
    return _t(s, d, "supplier").select("s_suppkey", X.slug(F.concat(F.lit("** "), "s_name", F.lit("!"))).alias("slug"))


@source("x19_codes_in_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 1000 BETWEEN 400 AND 599 THEN CAST(o_orderkey % 1000 AS VARCHAR) ELSE '450' END AS code FROM orders")
def x19(s, d):
    return _t(s, d, "orders").select("o_orderkey", X.code_in_text(F.concat(F.lit("move 12345 to "), F.col("o_orderkey") % 1000, F.lit(" or 450, not 399"))).alias("code"))


@source("xm_amounts", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN -CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) WHEN 1 THEN CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) ELSE 0 END AS value FROM supplier")
def xm(s, d):
    v = _t(s, d, "supplier")
    t = F.format_number("s_acctbal", 2)
    return v.select("s_suppkey", X.amount(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("("), t, F.lit(")"))).when(F.col("s_suppkey") % 3 == 1, t).otherwise("n/a")).cast("double").alias("value"))


@source("xd_dates", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), y AS (SELECT *, make_date(year(d), 2, CAST(day(last_day(make_date(year(d), 2, 1))) AS INT)) AS e FROM o)
SELECT o_orderkey, CAST(d AS VARCHAR) AS parsed, CAST(CASE WHEN e >= d THEN e ELSE last_day(make_date(year(d) + 1, 2, 1)) END AS VARCHAR) AS next_end, CAST(CASE WHEN e <= d THEN e ELSE last_day(make_date(year(d) - 1, 2, 1)) END AS VARCHAR) AS last_end, CAST(day(last_day(d)) AS INT) AS days FROM y""")
def xd(s, d):
    o = _t(s, d, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/Date("), F.unix_date("d").cast("bigint") * 86400000 + 3600000, F.lit(")/"))).otherwise(F.concat(F.col("d").cast("string"), F.lit("T10:00:00")))
    p = T.parse(text)
    return o.select("o_orderkey", p.cast("string").alias("parsed"), T.next_year_end(p, 2, 29).cast("string").alias("next_end"), T.last_year_end(p, 2, 29).cast("string").alias("last_end"), T.days_in_month(p).alias("days"))


@source("xd5_whole_months", "SELECT o_orderkey, CAST(greatest((year(e) - year(d)) * 12 + month(e) - month(d) - CASE WHEN day(e) < day(d) AND NOT (d = last_day(d) AND e = last_day(e)) THEN 1 ELSE 0 END, 0) AS INT) AS months FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 700 AS INT) - 50 AS e FROM orders)")
def xd5(s, d):
    o = _t(s, d, "orders").withColumn("d", F.col("o_orderdate").cast("date")).withColumn("e", F.date_add("d", (F.col("o_orderkey") % 700 - 50).cast("int")))
    return o.select("o_orderkey", T.whole_months("d", "e").alias("months"))


# --- documents, fixes ----------------------------------------------------------------


@source("p08_payment_state", """SELECT transaction_id, CASE WHEN amount_due <= 0.005 THEN 'paid' WHEN amount_due < amount THEN 'part_paid' ELSE 'unpaid' END AS payment_status, NOT (amount_due <= 0.005 OR amount_due < amount) AS editable FROM v_sales""", prelude=True)
def p08(s, d):
    return D.payment_state(V.sales(s, d).withColumn("reconciled", F.lit(False))).select("transaction_id", "payment_status", "editable")


@source("p10_p11_titles_links", "SELECT transaction_id, vendor_name || ' has a missing tax issue' AS title, 'https://books.example/' || CASE WHEN type = 'ACCRECCREDIT' THEN 'credit-notes' WHEN type = 'ACCREC' THEN 'invoices' ELSE 'bills' END || '/' || transaction_id AS link, CASE type WHEN 'ACCREC' THEN 'Invoice' WHEN 'ACCPAY' THEN 'Bill' ELSE 'Sales credit note' END AS label FROM docs", prelude=True)
def p10(s, d):
    return V.documents(s, d).select("transaction_id", D.title(F.lit("missing_tax"), "vendor_name").alias("title"), D.link("https://books.example/").alias("link"), D.label().alias("label"))


@source("f01_f03_universe", "SELECT CASE WHEN type LIKE 'ACCREC%' THEN 'sales' ELSE 'purchases' END AS side, count(*) AS n FROM docs WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-06-30' AND date >= DATE '1997-02-01' GROUP BY 1", prelude=True)
def f01(s, d):
    rows = D.not_before(D.in_period(V.documents(s, d), date(1996, 1, 1), date(1999, 6, 30)), date(1997, 2, 1))
    return rows.groupBy(D.side().alias("side")).agg(F.count(F.lit(1)).alias("n"))


_FIX = """SELECT transaction_id AS document_id, CASE seq % 5 WHEN 0 THEN CASE WHEN seq % 2 = 0 THEN 'void_duplicate' ELSE 'review_possible_duplicate' END WHEN 1 THEN 'approve_document' WHEN 2 THEN 'correct_tax_code' WHEN 3 THEN 'manual_review' ELSE 'deferred' END AS strategy,
CASE seq % 5 WHEN 0 THEN CASE WHEN seq % 2 = 0 THEN 'VOIDED' ELSE '' END WHEN 1 THEN 'AUTHORISED' WHEN 2 THEN 'INPUT' WHEN 3 THEN '' ELSE '429' END AS value FROM docs"""


@source("l05_fix_suggestions", _FIX, prelude=True)
def l05(s, d):
    rules = F.array(*map(F.lit, ("duplicate_bill", "unapproved_bill", "sales_tax_on_bills", "old_unpaid_bill", "wrong_category")))
    rows = V.documents(s, d).select("company_id", F.col("transaction_id").alias("document_id"), F.get(rules, (F.col("seq") % 5).cast("int")).alias("primary_rule"), F.when(F.col("seq") % 2 == 0, False).alias("likely_original"), F.lit("x").alias("dup_of_id"), F.lit(None).cast("string").alias("suggested_code"), F.lit("move it to 429 please").alias("steps"))
    return D.fixes(rows).select("document_id", "strategy", F.coalesce("value", F.lit("")).alias("value"))


@source("m01_p09_group_flags", """WITH f AS (SELECT transaction_id, 0 AS o, 'missing_tax' AS t FROM docs WHERE seq % 5 = 0 UNION ALL SELECT transaction_id, 1, 'prepayment_review' FROM docs WHERE seq % 2 = 0 UNION ALL SELECT transaction_id, 2, 'capital_item_review' FROM docs WHERE seq % 7 = 0),
g AS (SELECT *, max(CASE WHEN t = 'capital_item_review' THEN 1 ELSE 0 END) OVER (PARTITION BY transaction_id) AS cap FROM f)
SELECT transaction_id AS document_id, coalesce(string_agg(t, ',' ORDER BY o) FILTER (NOT (cap = 1 AND t = 'prepayment_review')), '') AS rules, count(*) FILTER (cap = 1 AND t = 'prepayment_review') AS n_superseded FROM g GROUP BY 1""", prelude=True)
def m01(s, d):
    docs = V.documents(s, d).select("company_id", "transaction_id", "seq")
    made = [docs.where(f"seq % {k} = 0").selectExpr("company_id", "transaction_id", f"'{t}' AS issue_type", "'medium' AS severity", "1 AS line_no") for k, t in ((5, "missing_tax"), (2, "prepayment_review"), (7, "capital_item_review"))]
    return S.grouped(O.superseded(O.union(made))).select("document_id", F.array_join("rule_ids", ",").alias("rules"), "n_superseded")


@source("x12_outgoing_categories", "SELECT n_nationkey, CASE WHEN n_nationkey % 9 = 8 THEN 'credit_cards' ELSE ['vat', 'paye_nic', 'loans_other', 'suppliers', 'corporation_tax', 'pension', 'net_wages', 'suppliers'][CAST(n_nationkey % 9 + 1 AS INT)] END AS category FROM nation")
def x12(s, d):
    names = F.array(*map(F.lit, ("UK VAT due", "NIC", "Innovation technician fund", "Trade Creditors", "Odd", "Nest pension", "Net Wages", "Innovation grant", "Card")))
    codes = F.array(*map(F.lit, ("1", "1", "1", "1", " 830 ", "1", "1", "800", "1")))
    k = (F.col("n_nationkey") % 9).cast("int")
    return _t(s, d, "nation").select("n_nationkey", Z.outgoing_category(F.get(names, k), F.get(codes, k), F.when(k == 8, "CreditCard")).alias("category"))


@source("x20_vendor_accounts", "SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN '437' WHEN c_mktsegment = 'FURNITURE' THEN '461' ELSE '' END AS account FROM customer")
def x20(s, d):
    return _t(s, d, "customer").select("c_custkey", F.coalesce(Z.vendor_account("c_mktsegment", {"furniture": "461", "machine": "437", "furn": "999"}), F.lit("")).alias("account"))


@source("x21_event_status", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'delivered' WHEN 1 THEN 'bounced' WHEN 2 THEN 'complained' WHEN 3 THEN 'failed' ELSE '' END AS status FROM events")
def x21(s, d):
    names = F.array(*map(F.lit, (" Open", "HARDBOUNCE", "spam", "failed", "queued", "")))
    return _t(s, d, "events").select("event_id", F.coalesce(Z.event_status(F.get(names, (F.col("event_id") % 6).cast("int"))), F.lit("")).alias("status"))


@source("m09_bulk_action", "SELECT concat('O', o_orderkey) AS document_id, o_orderkey % 2 = 0 AS ok, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'not found' END AS error FROM orders WHERE o_orderkey % 5 = 0")
def m09(s, d):
    o = _t(s, d, "orders").select(F.lit(V.COMPANY).alias("company_id"), F.concat(F.lit("O"), "o_orderkey").alias("document_id"), F.col("o_orderkey").alias("k"))
    return S.bulk(o.where("k % 2 = 0"), o.where("k % 5 = 0").drop("k"), "dismiss").drop("company_id")


@source("m10_settings_merge", "SELECT n_nationkey AS company_id, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'kept' END AS b FROM nation")
def m10(s, d):
    n = _t(s, d, "nation").withColumnRenamed("n_nationkey", "company_id")
    old = n.select("company_id", F.when(F.col("company_id") % 3 == 0, F.create_map(F.lit("a"), F.lit("old"))).otherwise(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept"))).alias("config"))
    new = n.where("company_id % 2 = 0").select("company_id", F.create_map(F.lit("a"), F.lit("new")).alias("config"))
    return S.settings_merged(old, new).select("company_id", F.col("config")["a"].alias("a"), F.coalesce(F.col("config")["b"], F.lit("")).alias("b"))


@source("m13_delivery_events", """WITH l AS (SELECT event_id AS log_id, CASE WHEN event_id % 2 = 0 THEN concat('m', event_id) END AS message_id, concat('U', user_id, '@x') AS email, ts AS created_at FROM events WHERE event_id % 4 < 3),
e AS (SELECT CASE WHEN event_id % 8 = 3 THEN concat('m', event_id - 1) END AS message_id, concat('u', user_id, '@x') AS email, ts AS t0, event_id AS k, CASE WHEN event_id % 3 = 0 THEN 'bounced' ELSE 'delivered' END AS status FROM events WHERE event_id % 4 = 3 AND event_id % 5 > 0),
h AS (SELECT coalesce(a.id, b.id) AS log_id, t0, k, status FROM e LEFT JOIN (SELECT message_id, arg_max(log_id, (created_at, log_id)) AS id FROM l WHERE message_id IS NOT NULL GROUP BY 1) a ON a.message_id = e.message_id LEFT JOIN (SELECT lower(email) AS mail, arg_max(log_id, (created_at, log_id)) AS id FROM l GROUP BY 1) b ON b.mail = lower(e.email)),
f AS (SELECT log_id, arg_max(status, (t0, k)) AS status FROM h WHERE log_id IS NOT NULL GROUP BY 1) SELECT l.log_id, coalesce(f.status, 'sent') AS status FROM l LEFT JOIN f USING (log_id)""")
def m13(s, d):
    e = _t(s, d, "events")
    log = e.where("event_id % 4 < 3").selectExpr("event_id AS log_id", "CASE WHEN event_id % 2 = 0 THEN concat('m', event_id) END AS message_id", "concat('U', user_id, '@x') AS email", "ts AS created_at", "'sent' AS status")
    events = e.where("event_id % 4 = 3").selectExpr("CASE WHEN event_id % 8 = 3 THEN concat('m', event_id - 1) END AS message_id", "concat('u', user_id, '@x') AS email", "struct(ts, event_id) AS at", "CASE WHEN event_id % 5 > 0 THEN CASE WHEN event_id % 3 = 0 THEN 'bounced' ELSE 'delivered' END END AS status")
    return S.delivered(log, events).select("log_id", "status")


@source("j16_a22_note_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS notes, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0) AS files FROM customer")
def j16(s, d):
    o = _t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return S.with_counts(_t(s, d, "customer").select("c_custkey"), o, o.where("o_orderkey % 3 = 0"), ["c_custkey"])


@source("k24_contact_defaults_list", """WITH c AS (SELECT concat('C', c_custkey) AS contact_id, c_custkey AS k FROM customer WHERE c_custkey % 13 > 0 UNION ALL SELECT concat('S', s_suppkey), s_suppkey FROM supplier WHERE s_suppkey % 13 > 0),
m AS (SELECT *, CASE WHEN k % 11 = 0 THEN 0 ELSE (k % 3 = 0)::INT + (k % 5 = 0)::INT END AS n FROM c) SELECT contact_id, CAST(n AS INT) AS n_missing, (SELECT count(*) FROM m WHERE n > 0) AS company_missing FROM m""")
def k24(s, d):
    c = contacts(s, d)
    return S.default_list(c.select("company_id", "contact_id"), C.missing_defaults(c), c.where("k % 13 = 0")).drop("company_id")


@source("p14_year_ends", """SELECT o_orderkey, CAST(CASE WHEN make_date(year(d), 3, 31) <= d THEN make_date(year(d), 3, 31) ELSE make_date(year(d) - 1, 3, 31) END AS VARCHAR) AS last_completed, CAST(CASE WHEN make_date(year(d), 3, 31) >= d THEN make_date(year(d), 3, 31) ELSE make_date(year(d) + 1, 3, 31) END AS VARCHAR) AS next FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def p14(s, d):
    o = _t(s, d, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", T.last_year_end("d", 3, 31).cast("string").alias("last_completed"), T.next_year_end("d", 3, 31).cast("string").alias("next"))


@source("x_d7_month_spine", "SELECT n_nationkey, string_agg(CAST(last_day(make_date(2023, k, 1)) AS VARCHAR), ',' ORDER BY k) AS ends FROM nation, range(1, 13) r(k) GROUP BY 1")
def xd7(s, d):
    return _t(s, d, "nation").select("n_nationkey", F.array_join(F.transform(T.year_month_ends(F.lit(date(2023, 12, 31))), lambda m: m.cast("string")), ",").alias("ends"))


def _stub(pdf):
    """A stand-in for a model: widgets go to 461, rings to an account that doesn't exist, the rest to 200, more or less surely."""
    import pandas as pd

    text = pdf["description"]
    code = text.map(lambda t: "461" if "widget" in t else "999" if "ring" in t else "200")
    return pd.DataFrame({"suggested_code": code, "confidence": text.map(lambda t: 0.95 if "red" in t else 0.85)})


@source("r37_l01_wrong_category", """WITH x AS (SELECT d.transaction_id, d.type LIKE 'ACCREC%' AS sale, d.account_code AS code, CASE WHEN description LIKE '%widget%' THEN '461' WHEN description LIKE '%ring%' THEN '999' ELSE '200' END AS s, CASE WHEN description LIKE '%red%' THEN 0.95 ELSE 0.85 END AS conf FROM docs d),
y AS (SELECT *, CASE WHEN sale THEN coalesce(code IN ('200', '260'), false) ELSE coalesce(code IN ('429', '461', '473'), false) END AS ok FROM x WHERE s <> '999' AND s <> coalesce(code, '') AND CASE WHEN sale THEN s = '200' ELSE s = '461' END)
SELECT transaction_id, CASE WHEN ok THEN 'medium' ELSE 'high' END AS severity, s AS suggested_code FROM y WHERE conf >= CASE WHEN ok THEN 0.9 ELSE 0.8 END""", prelude=True)
def r37(s, d):
    return G.wrong_category(V.documents(s, d), V.accounts(s), _stub).select("transaction_id", "severity", "suggested_code")


@source("r38_l02_anomaly", """WITH m AS (SELECT contact_id, quantile_cont(CAST(amount AS DOUBLE), 0.5) AS mid FROM docs WHERE amount > 0 GROUP BY 1 HAVING count(*) >= 4)
SELECT transaction_id, CASE WHEN transaction_id LIKE '%1%' THEN 0.9 ELSE 0.8 END AS confidence FROM docs JOIN m USING (contact_id) WHERE amount >= 4 * mid AND amount >= 100 AND transaction_id NOT LIKE '%7%'""", prelude=True)
def r38(s, d):
    import pandas as pd

    stub = lambda pdf: pd.DataFrame({"sure": pdf["transaction_id"].map(lambda t: 0.5 if "7" in t else 0.9 if "1" in t else 0.8)})
    return G.anomalies(V.documents(s, d), stub).select("transaction_id", "confidence")


@source("a18_contact_groups", """WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey - 1 AS b FROM supplier WHERE s_suppkey % 9 > 0 UNION ALL SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 9 = 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS id, least(min(b), a) AS group_id FROM r GROUP BY a""")
def a18(s, d):
    k = F.col("s_suppkey")
    e = _t(s, d, "supplier").select(F.lit(V.COMPANY).alias("company_id"), k.alias("a"), F.when(k % 9 > 0, k - 1).otherwise(k).alias("b"))
    return connected(e).select("id", "group_id")


@source("h30_not_annotated", "SELECT concat('O', o_orderkey) AS document_id FROM orders WHERE o_orderkey % 2 > 0 AND o_orderkey % 3 > 0 AND o_orderkey % 5 > 0")
def h30(s, d):
    o = _t(s, d, "orders").select(F.lit(V.COMPANY).alias("company_id"), F.concat(F.lit("O"), "o_orderkey").alias("document_id"), (F.col("o_orderkey") % 2 == 0).alias("resolved"), (F.col("o_orderkey") % 3 == 0).alias("dismissed"), F.col("o_orderkey").alias("k"))
    return G.not_annotated(o, o.where("k % 5 = 0")).select("document_id")


@source("k23_snapshot", None)
def k23(s, d):
    profit = K.profitability(_sections(s, d))
    label = lambda t, v: s.createDataFrame([(V.COMPANY, t, 0, v)], "company_id string, label string, pos int, value double").withColumn("value", F.col("value").cast("decimal(18,2)"))
    position = K.position(label("Total Current Assets", 900.0).union(label("Total Current Liabilities", 300.0)))
    cash = s.createDataFrame([(V.COMPANY, 80.0)], "company_id string, score double")
    out = K.snapshot(profit, position, cash, K.bank_reconciliation(V.bank(s, d)))
    return out.select("period", *(F.col(c).cast("double").alias(c) for c in ("income", "gross", "net", "tax", "working_capital", "current_ratio", "cash_score")), "bank_unreconciled")


SQL["k23_snapshot"] = PRELUDE.rstrip() + f""",
s AS ({_SECTIONS}), t AS (SELECT period, coalesce(sum(value) FILTER (part = 'income'), 0) AS income, coalesce(sum(value) FILTER (part = 'cogs'), 0) AS cogs, coalesce(sum(value) FILTER (part = 'expenses'), 0) AS expenses, coalesce(sum(value) FILTER (part = 'other'), 0) AS other FROM s GROUP BY 1 ORDER BY 1 DESC LIMIT 1),
n AS (SELECT period, CAST(income AS DOUBLE) AS income, CAST(income - cogs AS DOUBLE) AS gross, CAST(income - cogs - expenses + other AS DOUBLE) AS net FROM t)
SELECT *, CAST(CASE WHEN net <= 0 THEN 0 WHEN net <= 50000 THEN round(net * 0.19, 2) WHEN net >= 250000 THEN round(net * 0.25, 2) ELSE round(net * 0.25 - (250000 - net) * 0.015, 2) END AS DOUBLE) AS tax, CAST(600 AS DOUBLE) AS working_capital, CAST(3 AS DOUBLE) AS current_ratio, CAST(80 AS DOUBLE) AS cash_score, (SELECT count(*) FROM v_bank WHERE NOT reconciled) AS bank_unreconciled FROM n"""
