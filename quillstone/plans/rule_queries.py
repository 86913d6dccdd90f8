"""The audit rules over the test ledger, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contact_classes as N
from ..operators import contact_rules as C
from ..operators import document_rules as D
from ..operators import duplicate_rules as U
from ..operators import flag_ops as O
from ..operators import line_rules as L
from ..operators.base import Settings
from . import ledger_views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PRELUDE = V.duckdb_prelude()
ID = ("transaction_id", "issue_type", "severity")


def rule(name: str, sql: str | None, *cols: str):
    """Registers a query under a name; cols are what it returns."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = (lambda s, d: f(s, d).select(*(_plain(c) for c in cols))) if cols else f
        if sql:
            text = PRELUDE + sql if sql.lstrip()[:4].upper() != "WITH" else PRELUDE.rstrip() + ",\n" + sql.lstrip()[5:]
            swaps = ", ".join(f"{_SQL_PLAIN[c]} AS {c}" for c in cols if c in _SQL_PLAIN)
            SQL[name] = f"SELECT * REPLACE ({swaps}) FROM ({text})" if swaps else text
        return f

    return add


#: How nulls of numbers, booleans and dates are shown, so that results compare alike whatever reads them.
_SQL_PLAIN = {"line_no": "CAST(coalesce(line_no, 0) AS INT)", "likely_original": "coalesce(CAST(likely_original AS VARCHAR), '')", "age_days": "coalesce(age_days, -1)", "last_date": "coalesce(CAST(last_date AS VARCHAR), '')", "average": "CAST(average AS DOUBLE)"}


def _plain(c: str):
    col = F.col(c)
    return {"line_no": F.coalesce(col, F.lit(0)), "age_days": F.coalesce(col, F.lit(-1)), "average": col.cast("double")}.get(c, F.coalesce(col.cast("string"), F.lit("")) if c in _SQL_PLAIN else col).alias(c)


EMPTY_TAX = "coalesce(trim(tax_code), '') = ''"


@rule("r01_missing_tax", f"SELECT transaction_id, 'missing_tax' AS issue_type, 'critical' AS severity, min(line_no) AS line_no FROM lines WHERE {EMPTY_TAX} GROUP BY 1", *ID, "line_no")
def r01(s, d):
    return D.missing_tax(V.documents(s, d))


@rule("r02_invalid_tax_code", f"""WITH f AS (SELECT transaction_id, line_no, upper(trim(tax_code)) AS code, row_number() OVER (PARTITION BY transaction_id ORDER BY line_no) AS k FROM lines
WHERE transaction_id NOT IN (SELECT transaction_id FROM lines WHERE {EMPTY_TAX}) AND upper(trim(tax_code)) NOT IN ('OUTPUT2', 'INPUT2'))
SELECT transaction_id, 'invalid_tax_code' AS issue_type, 'critical' AS severity, line_no, code AS current_code FROM f WHERE k = 1""", *ID, "line_no", "current_code")
def r02(s, d):
    return D.invalid_tax_code(V.documents(s, d), V.tax_rates(s).where("code <> 'NONE'"))


@rule("r03_missing_vendor", "SELECT transaction_id, 'missing_vendor' AS issue_type, 'critical' AS severity FROM docs WHERE seq % 97 = 0", *ID)
def r03(s, d):
    return D.missing_vendor(V.documents(s, d).withColumn("vendor_name", F.when(F.col("seq") % 97 != 0, F.col("vendor_name"))))


@rule("r04_06_no_number", """SELECT transaction_id, CASE WHEN status IN ('AUTHORISED', 'PAID') THEN CASE WHEN type LIKE 'ACCREC%' THEN 'invoice_or_direct_booking' ELSE 'bill_or_direct_booking' END ELSE 'missing_invoice_number' END AS issue_type, 'medium' AS severity
FROM docs WHERE invoice_number IS NULL""", *ID)
def r04(s, d):
    return D.no_number(V.documents(s, d))


@rule("r07_future_dated", "SELECT transaction_id, 'future_dated' AS issue_type, 'medium' AS severity FROM docs WHERE date > DATE '2001-06-30'", *ID)
def r07(s, d):
    return D.future_dated(V.documents(s, d), date(2001, 6, 30))


@rule("r08_old_unpaid", """SELECT transaction_id, CASE WHEN type = 'ACCREC' THEN 'old_unpaid_invoice' ELSE 'old_unpaid_bill' END AS issue_type, 'high' AS severity
FROM docs WHERE type <> 'ACCRECCREDIT' AND status IN ('AUTHORISED', 'SUBMITTED') AND coalesce(amount_due, amount) > 0 AND date + 30 <= DATE '2001-12-30'""", *ID)
def r08(s, d):
    return D.old_unpaid(V.documents(s, d), V.AS_OF)


@rule("r09_invalid_status", "SELECT transaction_id, 'invalid_status_combo' AS issue_type, 'high' AS severity FROM docs WHERE status = 'PAID' AND amount_due > 0", *ID)
def r09(s, d):
    return D.invalid_status(V.documents(s, d))


@rule("r10_old_credits", "SELECT transaction_id, 'old_unsettled_sales_credit' AS issue_type, 'high' AS severity FROM docs WHERE type = 'ACCRECCREDIT' AND coalesce(amount_due, amount) > 0 AND date <= DATE '2001-12-31' - 60", *ID)
def r10(s, d):
    return D.old_credits(V.documents(s, d), V.AS_OF)


@rule("r11_unapproved", "SELECT transaction_id, CASE WHEN type LIKE 'ACCREC%' THEN 'unapproved_invoice' ELSE 'unapproved_bill' END AS issue_type, 'medium' AS severity FROM docs WHERE status IN ('DRAFT', 'SUBMITTED') AND date <= DATE '2001-12-31'", *ID)
def r11(s, d):
    return D.unapproved(V.documents(s, d), V.AS_OF)


@rule("r12_low_cost_fixed_asset", "SELECT transaction_id, 'low_cost_fixed_asset' AS issue_type, 'medium' AS severity, line_no, account_code AS current_code FROM lines WHERE transaction_id NOT IN (SELECT transaction_id FROM docs WHERE type = 'ACCRECCREDIT') AND account_code = '710' AND amount > 0 AND amount < 10000", *ID, "line_no", "current_code")
def r12(s, d):
    return L.low_cost_assets(V.documents(s, d), V.accounts(s))


_NOT_CAPITAL = r"\b(annual maintenance|spare part|consumable|maintenance|insurance|servicing|service|repair|spares|fuel|amc)s?\b"


@rule("r13_capital_item_review", f"""SELECT transaction_id, 'capital_item_review' AS issue_type, 'medium' AS severity, CAST(NULL AS INT) AS line_no, account_code AS current_code FROM v_bills
WHERE account_code IN ('461', '473') AND amount > 500 AND NOT regexp_matches(lower(concat_ws(' ', description, vendor_name)), '{_NOT_CAPITAL}')""", *ID, "line_no", "current_code")
def r13(s, d):
    return L.capital_review(V.documents(s, d), V.accounts(s))


#: A trade's catalogue from the tables: parts that last, those that are used up, and some suppliers.
_CATALOGUE = """SELECT DISTINCT 'capital' AS kind, p_name AS phrase FROM {part} WHERE p_name LIKE '%gear' OR p_name LIKE '%gizmo'
UNION ALL SELECT DISTINCT 'capital', split_part(p_name, ' ', 1) FROM {part} WHERE p_name LIKE 'small %' UNION ALL SELECT DISTINCT 'capital', split_part(p_name, ' ', 2) FROM {part} WHERE p_name LIKE '% widget'
UNION ALL SELECT DISTINCT 'exclusion', p_name FROM {part} WHERE p_name = 'old bolt' UNION ALL SELECT DISTINCT 'exclusion', split_part(p_name, ' ', 1) FROM {part} WHERE p_name LIKE 'hot %'
UNION ALL SELECT DISTINCT 'supplier', s_name FROM {supplier} WHERE s_suppkey % 7 = 0"""


@rule("r13_phrase_catalogue", f"""WITH k AS ({_CATALOGUE.format(part='part', supplier='supplier')}),
h AS (SELECT transaction_id, kind, phrase, strpos(' ' || lower(CASE WHEN kind = 'supplier' THEN vendor_name ELSE concat_ws(' ', description, vendor_name) END) || ' ', ' ' || lower(phrase) || ' ') AS place FROM v_bills, k WHERE account_code IN ('429', '461', '473') AND amount > 500 AND place > 0),
f AS (SELECT transaction_id, kind, phrase FROM h QUALIFY row_number() OVER (PARTITION BY transaction_id, kind ORDER BY place, length(phrase) DESC, phrase) = 1),
w AS (SELECT transaction_id, max(CASE WHEN kind = 'capital' THEN phrase END) AS capital, max(CASE WHEN kind = 'exclusion' THEN phrase END) AS exclusion, max(CASE WHEN kind = 'supplier' THEN lower(phrase) END) AS supplier FROM f GROUP BY 1)
SELECT b.transaction_id, 'capital_item_review' AS issue_type, 'medium' AS severity, b.account_code AS current_code, coalesce(capital, supplier, 'account') AS reason FROM v_bills b LEFT JOIN w USING (transaction_id)
WHERE account_code IN ('429', '461', '473') AND amount > 500 AND exclusion IS NULL AND (account_code IN ('461', '473') OR capital IS NOT NULL OR supplier IS NOT NULL)""", *ID, "current_code", "reason")
def r13_catalogue(s, d):
    table = lambda t: f"parquet.`{d}/{t}.parquet`"
    return L.capital_review(V.documents(s, d), V.accounts(s), catalogue=s.sql(_CATALOGUE.format(part=table("part"), supplier=table("supplier"))))


_TERMS = """WITH p AS (SELECT seq, transaction_id, amount, account_code, CASE WHEN seq % 3 = 0 THEN make_date(year(date), 3, 15) ELSE date END AS s, CASE WHEN seq % 3 = 0 THEN make_date(year(date) + 1, 3, 14) ELSE CAST(date + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) END AS e
FROM v_bills WHERE account_code IN ('429', '461', '473') AND amount > 250),
q AS (SELECT *, make_date(year(s), 12, 31) AS y FROM p),
r AS (SELECT *, (year(e) - year(y)) * 12 + month(e) - month(y) - CASE WHEN day(e) < day(y) AND e <> last_day(e) THEN 1 ELSE 0 END AS a, round_even((date_diff('day', s, e) + 1) / 30.44, 0) AS t FROM q)"""


@rule("r14_prepayment_review", f"""{_TERMS}
SELECT transaction_id, 'prepayment_review' AS issue_type, 'medium' AS severity, account_code AS current_code FROM r WHERE e > y AND a >= 1""", *ID, "current_code")
def r14(s, d):
    return L.prepayments(_termed(s, d), V.accounts(s))


def _termed(s, d):
    text = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("Licence 15 Mar "), F.year("date"), F.lit(" to 14 Mar "), F.year("date") + 1)).otherwise("Annual renewal")
    return V.bills(s, d).withColumn("description", text)


def _half_even(n: str, d: str) -> str:
    """SQL of n / d, both whole and above 0, rounded half even without fractions."""
    return f"((2 * {n} + {d}) // (2 * {d}) - CASE WHEN (2 * {n} + {d}) % (2 * {d}) = 0 AND (2 * {n} + {d}) // (2 * {d}) % 2 = 1 THEN 1 ELSE 0 END)"


@rule("r14_releases", f"""{_TERMS},
b AS (SELECT *, CAST(amount * 100 AS BIGINT) AS c, CAST(t AS BIGINT) AS m, CAST(least(a, t) AS BIGINT) AS k FROM r WHERE e > y AND a >= 1),
h AS (SELECT *, CAST({_half_even('c * k', 'm')} AS DECIMAL(18,2)) / 100 AS prepaid, CAST({_half_even('c', 'm')} AS DECIMAL(18,2)) / 100 AS monthly FROM b),
g AS (SELECT *, unnest(range(1, CAST(a AS BIGINT) + 1)) AS n FROM h)
SELECT transaction_id, CAST(n AS INT) AS n, strftime(last_day(CAST(y + INTERVAL (n) MONTH AS DATE)), '%b %Y') AS month, CAST(CAST(monthly AS DECIMAL(12,2)) AS VARCHAR) AS release, CAST(CAST(CASE WHEN n = a THEN 0 ELSE greatest(prepaid - monthly * n, 0) END AS DECIMAL(12,2)) AS VARCHAR) AS remaining FROM g""")
def r14_releases(s, d):
    return L.releases(_termed(s, d), V.accounts(s)).select("transaction_id", "n", "month", F.col("release").cast("string").alias("release"), F.col("remaining").cast("string").alias("remaining"))


@rule("r15_unusual_payment", """WITH b AS (SELECT *, count(*) OVER (PARTITION BY contact_id) AS n FROM v_bills),
u AS (SELECT account_code AS c, sum(amount) AS t, count(*) AS k FROM v_bills WHERE account_code IN ('429', '461', '473') GROUP BY 1 HAVING count(*) >= 3)
SELECT transaction_id, 'unusual_payment' AS issue_type, 'medium' AS severity, CASE WHEN seq % 101 = 0 THEN CASE WHEN n = 1 THEN 'unidentified_supplier' ELSE 'unclear_description' END WHEN amount >= 1000 AND n <= 2 THEN 'one_off_supplier' ELSE 'large_vs_account' END AS reason
FROM b LEFT JOIN u ON c = account_code WHERE seq % 101 = 0 OR (amount >= 1000 AND n <= 2) OR amount * k >= 1.8 * t""", *ID, "reason")
def r15(s, d):
    return L.unusual_payments(V.bills(s, d).withColumn("description", F.when(F.col("seq") % 101 == 0, "Direct  debit").otherwise(F.col("description"))), V.accounts(s), Settings(account_multiple=1.8))


@rule("r16_non_payroll_payment", "SELECT transaction_id, 'non_payroll_payment' AS issue_type, 'medium' AS severity FROM v_bills WHERE vendor_name NOT IN (SELECT s_name FROM supplier WHERE s_suppkey % 3 = 0)", *ID)
def r16(s, d):
    names = s.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 3 = 0").select(F.lit(V.COMPANY).alias("company_id"), F.upper("s_name").alias("name"))
    return D.non_payroll(V.bills(s, d).withColumn("type", F.lit("SPEND")), names)


@rule("r17_amount_outlier", """WITH m AS (SELECT contact_id, quantile_cont(CAST(amount AS DOUBLE), 0.5) AS mid FROM docs WHERE amount > 0 GROUP BY 1 HAVING count(*) >= 4),
c AS (SELECT contact_id, account_code, count(*) AS n, min(seq) AS o FROM docs WHERE amount > 0 AND account_code IS NOT NULL GROUP BY 1, 2),
t AS (SELECT contact_id, account_code, row_number() OVER (PARTITION BY contact_id ORDER BY n DESC, o) AS k FROM c)
SELECT transaction_id, 'amount_outlier' AS issue_type, 'medium' AS severity, t.account_code AS current_code FROM docs JOIN m USING (contact_id) LEFT JOIN t ON t.contact_id = docs.contact_id AND k = 1 WHERE amount >= 4 * mid AND amount >= 100""", *ID, "current_code")
def r17(s, d):
    return L.outliers(V.documents(s, d))


LOOSE = Settings(duplicate_days_window=3, duplicate_require_same_amount=False, duplicate_min_confidence=0)


@rule("r18a_duplicates_same_contact", """WITH g AS (SELECT contact_id, type, date - lag(date) OVER (PARTITION BY contact_id, type ORDER BY date) AS gap FROM (SELECT DISTINCT contact_id, type, date FROM v_sales)),
c AS (SELECT contact_id, type, quantile_cont(gap, 0.5) AS cad FROM g WHERE gap > 0 GROUP BY 1, 2),
n AS (SELECT contact_id, type FROM v_sales GROUP BY 1, 2 HAVING count(*) >= 3),
k AS (SELECT c.* FROM c JOIN n USING (contact_id, type)),
p AS (SELECT a.transaction_id AS ai, b.transaction_id AS bi, a.type, b.date - a.date AS days, a.amount = b.amount AS same_amount, coalesce(a.invoice_number = b.invoice_number, false) AS same_no, a.reference = b.reference AS same_ref,
  coalesce(a.invoice_number <> b.invoice_number, false) AS other_no, (a.status = 'PAID' OR (a.amount_due = 0 AND a.amount > 0)) AS ap, (b.status = 'PAID' OR (b.amount_due = 0 AND b.amount > 0)) AS bp, cad
  FROM v_sales a JOIN v_sales b ON a.contact_id = b.contact_id AND a.type = b.type AND (a.date < b.date OR (a.date = b.date AND a.seq < b.seq)) AND b.date - a.date <= 3 LEFT JOIN k ON k.contact_id = a.contact_id AND k.type = a.type),
q AS (SELECT *, same_amount AND NOT same_no AND CASE WHEN cad IS NOT NULL THEN days >= 0.75 * cad ELSE days >= 14 END AS rec FROM p WHERE (same_ref OR same_no) AND NOT (ap AND bp AND type <> 'ACCRECCREDIT')),
t AS (SELECT *, CASE WHEN same_no THEN 1.0 WHEN rec THEN 0.45 WHEN NOT same_amount THEN 0.65 WHEN other_no THEN CASE WHEN days = 0 THEN 0.95 ELSE 0.7 END WHEN same_ref THEN 0.9 ELSE 0.75 END AS conf, CASE WHEN ap <> bp THEN ap ELSE true END AS first FROM q),
u AS (SELECT ai AS transaction_id, bi AS dup_of_id, conf, type, first FROM t UNION ALL SELECT bi, ai, conf, type, NOT first FROM t)
SELECT transaction_id, CASE WHEN type = 'ACCRECCREDIT' THEN 'duplicate_credit_note' ELSE 'duplicate_invoice' END AS issue_type, CASE WHEN conf >= 0.9 THEN 'high' ELSE 'medium' END AS severity, dup_of_id, CAST(conf AS DOUBLE) AS confidence, CASE WHEN conf >= 0.9 THEN first END AS likely_original FROM u""", *ID, "dup_of_id", "confidence", "likely_original")
def r18a(s, d):
    return U.same_contact(V.sales(s, d), LOOSE)


@rule("r18b_duplicates_cross_contact", """WITH p AS (SELECT a.transaction_id AS ai, b.transaction_id AS bi, b.date - a.date AS days, lower(a.description) = lower(b.description) AS same_text, a.status = 'PAID' AS ap, b.status = 'PAID' AS bp
  FROM v_bills a JOIN v_bills b ON a.amount = b.amount AND a.contact_id <> b.contact_id AND (a.date < b.date OR (a.date = b.date AND a.seq < b.seq)) AND b.date - a.date <= 30 AND CAST(substr(a.contact_id, 2) AS INT) % 3 = CAST(substr(b.contact_id, 2) AS INT) % 3),
q AS (SELECT *, round((50 + CASE WHEN days = 0 THEN 15 ELSE 8 END + CASE WHEN same_text THEN 10 ELSE 0 END) / 100.0, 2) AS score, CASE WHEN ap <> bp THEN ap ELSE true END AS first FROM p WHERE NOT (ap AND bp)),
u AS (SELECT ai AS transaction_id, bi AS dup_of_id, score, first FROM q UNION ALL SELECT bi, ai, score, NOT first FROM q)
SELECT transaction_id, 'duplicate_bill' AS issue_type, 'medium' AS severity, dup_of_id, CAST(score AS DOUBLE) AS confidence, first AS likely_original FROM u WHERE score >= 0.5""", *ID, "dup_of_id", "confidence", "likely_original")
def r18b(s, d):
    b = V.bills(s, d)
    vat = b.select("company_id", "contact_id").distinct().withColumn("vat", F.concat(F.lit("GB"), F.substring("contact_id", 2, 9).cast("int") % 3))
    return U.cross_contact(b, vat, Settings(duplicate_days_window=30), least_score=0.5)


def _first(where: str, issue: str, severity: str, code: str, extra: str = "") -> str:
    return f"""WITH f AS (SELECT transaction_id, line_no, {code} AS code{extra}, row_number() OVER (PARTITION BY transaction_id ORDER BY line_no) AS k FROM lines WHERE {where})
SELECT transaction_id, '{issue}' AS issue_type, '{severity}' AS severity, line_no, code AS current_code FROM f WHERE k = 1"""


@rule("r19_purchase_tax_missing", _first("account_code IN ('429', '461', '473') AND tax_code = 'NONE'", "purchase_tax_missing", "medium", "tax_code"), *ID, "line_no", "current_code")
def r19(s, d):
    return L.purchase_tax_missing(V.documents(s, d), V.accounts(s))


@rule("r20_sales_tax_missing", _first("account_code IN ('200', '260') AND tax_code = 'NONE'", "sales_tax_missing", "medium", "tax_code"), *ID, "line_no", "current_code")
def r20(s, d):
    return L.sales_tax_missing(V.documents(s, d), V.accounts(s))


@rule("r21_sales_tax_on_bills", _first("transaction_id LIKE 'L%' AND tax_code = 'OUTPUT2' AND account_code NOT IN ('200', '260')", "sales_tax_on_bills", "high", "tax_code"), *ID, "line_no", "current_code")
def r21(s, d):
    return L.sales_tax_on_bills(V.documents(s, d), V.accounts(s), V.tax_rates(s))


@rule("r22_purchase_tax_on_invoices", _first("transaction_id LIKE 'O%' AND tax_code = 'INPUT2' AND account_code IN ('200', '260')", "purchase_tax_on_invoices", "high", "tax_code"), *ID, "line_no", "current_code")
def r22(s, d):
    return L.purchase_tax_on_invoices(V.documents(s, d), V.accounts(s), V.tax_rates(s))


def _several(code: str, issue: str) -> str:
    return f"""WITH x AS (SELECT d.contact_id, l.*, {code} AS code FROM lines l JOIN docs d USING (transaction_id) WHERE {code} IS NOT NULL),
c AS (SELECT contact_id, code, count(*) AS n, min((seq, coalesce(line_no, 0))) AS o FROM x GROUP BY 1, 2),
t AS (SELECT contact_id, code, row_number() OVER (PARTITION BY contact_id ORDER BY n DESC, o) AS k, count(*) OVER (PARTITION BY contact_id) AS vals FROM c),
f AS (SELECT x.transaction_id, x.line_no, x.code, t.code AS top, row_number() OVER (PARTITION BY x.transaction_id ORDER BY x.line_no) AS k FROM x JOIN t ON t.contact_id = x.contact_id AND t.k = 1 AND vals >= 2 WHERE x.code <> t.code)
SELECT transaction_id, '{issue}' AS issue_type, 'medium' AS severity, line_no, code AS current_code, top AS suggested_code FROM f WHERE k = 1"""


@rule("r23_multi_tax_code_supplier", _several("l.tax_code", "multi_tax_code_supplier"), *ID, "line_no", "current_code", "suggested_code")
def r23(s, d):
    return L.several_tax_codes(V.documents(s, d))


def _defaults(s, d):
    return V.documents(s, d).select("company_id", "contact_id").distinct().selectExpr("*", "'200' AS sales_account", "'output2' AS sales_tax", "'429' AS purchase_account", "'INPUT2' AS purchase_tax")


@rule("r24_unexpected_tax_code", "SELECT transaction_id, 'unexpected_tax_code' AS issue_type, 'medium' AS severity, tax_code AS current_code, CASE WHEN type LIKE 'ACCREC%' THEN 'OUTPUT2' ELSE 'INPUT2' END AS suggested_code FROM docs WHERE tax_code IS NOT NULL AND tax_code <> CASE WHEN type LIKE 'ACCREC%' THEN 'OUTPUT2' ELSE 'INPUT2' END", *ID, "current_code", "suggested_code")
def r24(s, d):
    return L.unexpected_tax(V.documents(s, d), _defaults(s, d))


@rule("r25_multi_account_supplier", _several("l.account_code", "multi_account_supplier"), *ID, "line_no", "current_code", "suggested_code")
def r25(s, d):
    return L.several_accounts(V.documents(s, d))


@rule("r26_unexpected_account", "SELECT transaction_id, 'unexpected_account' AS issue_type, 'medium' AS severity, account_code AS current_code, CASE WHEN type LIKE 'ACCREC%' THEN '200' ELSE '429' END AS suggested_code FROM docs WHERE account_code IS NOT NULL AND account_code <> CASE WHEN type LIKE 'ACCREC%' THEN '200' ELSE '429' END", *ID, "current_code", "suggested_code")
def r26(s, d):
    return L.unexpected_account(V.documents(s, d), _defaults(s, d))


@rule("r27_wrong_direction_account", "SELECT transaction_id, 'wrong_direction_account' AS issue_type, 'high' AS severity, account_code AS current_code FROM docs JOIN coa ON account_code = code WHERE CASE WHEN docs.type LIKE 'ACCREC%' THEN coa.type NOT IN ('REVENUE', 'OTHERINCOME') ELSE coa.type <> 'EXPENSE' END", *ID, "current_code")
def r27(s, d):
    return L.wrong_direction(V.documents(s, d), V.accounts(s))


@rule("r28_misallocated_item", _first("account_code = '429' AND amount >= 100", "misallocated_item", "medium", "account_code"), *ID, "line_no", "current_code")
def r28(s, d):
    return L.misallocated(V.documents(s, d), V.accounts(s))


@rule("r29_undocumented_bill", "SELECT transaction_id, 'undocumented_bill' AS issue_type, 'medium' AS severity FROM v_bills WHERE has_attachments = false AND amount >= 1000", *ID)
def r29(s, d):
    return D.undocumented(V.documents(s, d), Settings(undocumented_min=1000))


@rule("r30_opening_balance_postings", "SELECT transaction_id, 'opening_balance_difference' AS issue_type, 'high' AS severity, account_code AS current_code FROM docs WHERE account_code = '710'", *ID, "current_code")
def r30(s, d):
    return D.opening_balance_postings(V.documents(s, d), V.accounts(s), Settings(historical_code="710"))


def _direct(table: str, bank: str, issue: str, doc_type: str) -> str:
    return f"""WITH m AS (SELECT d.transaction_id, b.transaction_id AS bi, row_number() OVER (PARTITION BY d.transaction_id ORDER BY b.seq) AS k FROM {table} d JOIN v_bank b ON b.contact_id = d.contact_id AND b.type = '{bank}' AND b.date - d.date BETWEEN 0 AND 30 AND abs({'coalesce(d.amount_due, d.amount)' if table == 'v_sales' else 'd.amount'} - b.amount) <= 0.01
WHERE d.type = '{doc_type}' AND d.status IN ('AUTHORISED', 'SUBMITTED')) SELECT transaction_id, '{issue}' AS issue_type, 'medium' AS severity, bi AS dup_of_id FROM m WHERE k = 1"""


@rule("r31_bill_direct_payment", _direct("v_bills", "SPEND", "bill_direct_payment", "ACCPAY"), *ID, "dup_of_id")
def r31(s, d):
    return U.bills_paid_directly(V.bills(s, d), V.bank(s, d))


@rule("r32_invoice_direct_deposit", _direct("v_sales", "RECEIVE", "invoice_direct_deposit", "ACCREC"), *ID, "dup_of_id")
def r32(s, d):
    return U.invoices_paid_directly(V.sales(s, d), V.bank(s, d))


@rule("r31_match_details", """WITH m AS (SELECT d.transaction_id, d.date AS d_date, d.amount, b.transaction_id AS bank_id, b.date AS b_date, b.amount AS b_amount, row_number() OVER (PARTITION BY d.transaction_id ORDER BY b.seq) AS k FROM v_bills d JOIN v_bank b ON b.contact_id = d.contact_id AND b.type = 'SPEND' AND b.date - d.date BETWEEN 0 AND 30 AND abs(d.amount - b.amount) <= 0.01
WHERE d.status IN ('AUTHORISED', 'SUBMITTED')) SELECT transaction_id, CAST(d_date AS VARCHAR) AS document_date, CAST(amount AS DOUBLE) AS amount_due, bank_id, CAST(b_date AS VARCHAR) AS bank_date, CAST(b_amount AS DOUBLE) AS bank_amount, CAST(b_date - d_date AS INT) AS days_apart FROM m WHERE k = 1""")
def r31_details(s, d):
    rows = U.direct_matches(V.bills(s, d), V.bank(s, d), "ACCPAY", "SPEND", 30)
    return rows.select("transaction_id", F.col("document_date").cast("string").alias("document_date"), F.col("amount_due").cast("double").alias("amount_due"), "bank_id", F.col("bank_date").cast("string").alias("bank_date"), F.col("bank_amount").cast("double").alias("bank_amount"), "days_apart")


@rule("r33_missing_accrual", """WITH x AS (SELECT account_code AS a, date, amount FROM v_bills WHERE account_code IN ('429', '461', '473') AND month(date) NOT IN (3, 4, CAST(account_code AS INT) % 7 + 6) AND NOT (account_code = '461' AND date BETWEEN DATE '1998-12-01' AND DATE '1998-12-31')),
m AS (SELECT a, month(date) - 1 AS m, sum(amount) AS s FROM x WHERE year(date) = 1998 AND amount > 0 GROUP BY 1, 2),
t AS (SELECT a, count(*) AS n, round_even(sum(s) / count(*), 2) AS average FROM m GROUP BY 1),
gap AS (SELECT a, k, k - row_number() OVER (PARTITION BY a ORDER BY k) AS isl FROM t, range(0, 11) r(k) WHERE n >= 8 AND NOT EXISTS (SELECT 1 FROM m WHERE m.a = t.a AND m.m = k)),
runs AS (SELECT a, min(k) AS k, count(*) AS run FROM gap GROUP BY a, isl),
f AS (SELECT a FROM t WHERE n >= 8 AND NOT EXISTS (SELECT 1 FROM m WHERE m.a = t.a AND m.m = 11))
SELECT a AS account, CASE WHEN run >= 2 THEN 'large_gap' ELSE 'missing_month' END AS reason, CASE WHEN run >= 2 THEN 'high' ELSE 'medium' END AS severity, '1998-' || lpad(CAST(k + 1 AS VARCHAR), 2, '0') AS month, CAST(run AS INT) AS run, CAST(average AS DECIMAL(18,2)) AS average FROM runs JOIN t USING (a)
UNION ALL SELECT a, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.a = f.a AND x.date > DATE '1998-12-31' AND x.amount > 0) THEN 'post_year_cutoff' ELSE 'final_month_missing' END, 'high', '1998-12', 1, CAST(average AS DECIMAL(18,2)) FROM f JOIN t USING (a)""", "account", "reason", "severity", "month", "run", "average")
def r33(s, d):
    return L.accruals(accrual_bills(s, d), V.accounts(s), date(1998, 12, 31))


def accrual_bills(s, d):
    """Bills with months that lack an account's."""
    acct = F.col("account_code")
    return V.bills(s, d).where(~F.month("date").isin(3, 4) & (F.month("date") != acct.cast("int") % 7 + 6) & ~((acct == "461") & F.col("date").between(date(1998, 12, 1), date(1998, 12, 31))))


def contacts(s: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers as contacts."""
    c = s.read.parquet(f"{d}/customer.parquet").selectExpr("concat('C', c_custkey) AS contact_id", "c_name AS name", "c_custkey AS k", "true AS is_customer", "false AS is_supplier")
    v = s.read.parquet(f"{d}/supplier.parquet").selectExpr("concat('S', s_suppkey)", "s_name", "s_suppkey", "false", "true")
    return c.union(v).selectExpr(f"'{V.COMPANY}' AS company_id", "contact_id", "name", "k", "is_customer", "is_supplier", "k % 11 = 0 AS is_archived", "CASE WHEN k % 4 > 0 THEN concat('GB', k % 50) END AS vat", "CASE WHEN k % 3 > 0 THEN '200' END AS sales_account", "CASE WHEN k % 5 > 0 THEN 'OUTPUT2' END AS sales_tax", "CASE WHEN k % 3 > 0 THEN '429' END AS purchase_account", "CASE WHEN k % 5 > 0 THEN 'INPUT2' END AS purchase_tax")


_CONTACTS = """WITH contacts AS (SELECT concat('C', c_custkey) AS contact_id, c_custkey AS k, 'sales' AS side FROM customer WHERE c_custkey % 11 > 0 UNION ALL SELECT concat('S', s_suppkey), s_suppkey, 'purchase' FROM supplier WHERE s_suppkey % 11 > 0)"""


@rule("r34_duplicate_contact", None, "contact_id", "partner_id", "similarity", "confidence", "vat_status", "severity", "is_split")
def r34(s, d):
    return C.duplicate_contacts(contacts(s, d))


#: Similarity of all pairs of these names, none with fillers: the common subsequence by bits, of the names and of their words in order, both of which are at most 62 characters.
_SIMILAR = """WITH c AS (SELECT concat('C', c_custkey) AS contact_id, c_name AS name, c_custkey AS k, true AS cust FROM customer WHERE c_custkey % 11 > 0 UNION ALL SELECT concat('S', s_suppkey), s_name, s_suppkey, false FROM supplier WHERE s_suppkey % 11 > 0),
n AS (SELECT contact_id, cust, CASE WHEN k % 4 > 0 THEN concat('GB', k % 50) END AS vat, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS p FROM c),
f AS (SELECT *, array_to_string(list_sort(string_split(p, ' ')), ' ') AS q, replace(p, ' ', '') AS squeezed FROM n),
b AS (SELECT *, list_distinct(list_transform(range(1, length(squeezed) - 1), lambda i: substr(squeezed, i, 3))) AS grams,
  map_from_entries(list_transform(list_distinct(string_split(p, '')), lambda ch: (ch, list_sum(list_transform(range(1, length(p) + 1), lambda i: CASE WHEN substr(p, i, 1) = ch THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT))) AS pb,
  map_from_entries(list_transform(list_distinct(string_split(q, '')), lambda ch: (ch, list_sum(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN substr(q, i, 1) = ch THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT))) AS qb FROM f),
pairs AS (SELECT x.contact_id AS a, y.contact_id AS b, x.p AS ap, y.p AS bp, x.q AS aq, y.q AS bq, x.pb AS apb, x.qb AS aqb, x.vat AS av, y.vat AS bv, x.cust <> y.cust AS is_split FROM b x JOIN b y ON x.contact_id < y.contact_id AND list_has_any(x.grams, y.grams)),
s AS (SELECT *, greatest(2 * (length(ap) - bit_count(list_reduce(list_prepend((1::BIGINT << length(ap)) - 1, list_transform(string_split(bp, ''), lambda ch: coalesce(apb[ch], 0))), lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(ap)) - 1)))),
  2 * (length(aq) - bit_count(list_reduce(list_prepend((1::BIGINT << length(aq)) - 1, list_transform(string_split(bq, ''), lambda ch: coalesce(aqb[ch], 0))), lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(aq)) - 1))))) / (length(ap) + length(bp))::DOUBLE AS r FROM pairs),
l AS (SELECT *, 0.85 * r + 0.15 * r AS sim FROM s WHERE 0.85 * r + 0.15 * r >= 0.7)"""


@rule("r34_contact_classes", _SIMILAR + """, e AS (SELECT a, b, ap, bp, av, bv, is_split, sim FROM l UNION ALL SELECT b, a, bp, ap, bv, av, is_split, sim FROM l),
t1 AS (SELECT a, least(a, min(b)) AS c FROM e GROUP BY a), t2 AS (SELECT e.a, least(e.a, min(c)) AS c FROM e JOIN t1 ON t1.a = e.b GROUP BY e.a), t3 AS (SELECT e.a, least(e.a, min(c)) AS c FROM e JOIN t2 ON t2.a = e.b GROUP BY e.a), top AS (SELECT e.a, least(e.a, min(c)) AS class_id FROM e JOIN t3 ON t3.a = e.b GROUP BY e.a),
best AS (SELECT *, count(*) OVER (PARTITION BY a) AS n_links, row_number() OVER (PARTITION BY a ORDER BY sim DESC, bp, b) AS nth, CASE WHEN coalesce(av, '') = '' OR coalesce(bv, '') = '' THEN 'unknown' WHEN av = bv THEN 'match' ELSE 'mismatch' END AS vat_status FROM e),
z AS (SELECT *, CASE vat_status WHEN 'match' THEN least(sim + 0.1, 1.0) WHEN 'mismatch' THEN sim * 0.4 ELSE sim END AS conf FROM best WHERE nth = 1)
SELECT a AS contact_id, class_id, n_links, b AS partner_id, round(sim, 4) AS similarity, round(conf, 4) AS confidence, vat_status, CASE WHEN is_split OR vat_status = 'mismatch' THEN 'low' WHEN conf >= 0.85 THEN 'high' ELSE 'medium' END AS severity, is_split FROM z JOIN top USING (a)""", "contact_id", "class_id", "n_links", "partner_id", "similarity", "confidence", "vat_status", "severity", "is_split")
def r34_classes(s, d):
    return N.contact_classes(contacts(s, d))


@rule("r35_contact_defaults", _CONTACTS + """ SELECT contact_id, concat_ws(',', CASE WHEN k % 3 = 0 THEN side || '_account' END, CASE WHEN k % 5 = 0 THEN side || '_tax' END) AS missing FROM contacts WHERE k % 3 = 0 OR k % 5 = 0""")
def r35(s, d):
    return C.missing_defaults(contacts(s, d)).select("contact_id", F.array_join("missing", ",").alias("missing"))


@rule("r36_inactive_contact", _CONTACTS + """, a AS (SELECT contact_id, max(date) AS last_date FROM docs GROUP BY 1) SELECT contact_id, last_date, CAST(DATE '2001-12-31' - last_date AS INT) AS age_days FROM contacts LEFT JOIN a USING (contact_id) WHERE last_date IS NULL OR DATE '2001-12-31' - last_date >= 180""", "contact_id", "last_date", "age_days")
def r36(s, d):
    return C.inactive_contacts(contacts(s, d), V.documents(s, d), V.AS_OF)


@rule("r40_pre_ledger_validation", """SELECT transaction_id, concat_ws(',', CASE WHEN date > DATE '1999-12-31' THEN 'date' END, CASE WHEN invoice_number IS NULL THEN 'invoice_number' END, CASE WHEN tax_code IS NULL THEN 'tax_code' END) AS errors,
CASE WHEN date > DATE '1999-12-31' OR invoice_number IS NULL OR tax_code IS NULL THEN 'blocked' ELSE 'passed' END AS status FROM docs WHERE transaction_id LIKE 'O%'""")
def r40(s, d):
    return D.pre_ledger_errors(V.sales(s, d), date(1999, 12, 31)).select("transaction_id", F.array_join("errors", ",").alias("errors"), "status")


@rule("r41_capital_not_registered", f"""WITH f AS (SELECT * FROM v_bills WHERE account_code IN ('461', '473') AND amount > 500 AND NOT regexp_matches(lower(concat_ws(' ', description, vendor_name)), '{_NOT_CAPITAL}')),
r AS (SELECT amount + 0.5 AS price, date + 7 AS bought FROM v_bills WHERE seq % 5 = 0)
SELECT transaction_id, 'capital_item_review' AS issue_type, 'medium' AS severity FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE abs(r.price - f.amount) <= 1 AND abs(r.bought - f.date) <= 30)""", *ID)
def r41(s, d):
    b = V.bills(s, d)
    register = b.where("seq % 5 = 0").selectExpr("company_id", "amount + 0.5 AS price", "date_add(date, 7) AS bought")
    return O.not_registered(L.capital_review(b, V.accounts(s)), b, register)


@rule("r42_supersede", """WITH f AS (SELECT transaction_id, 'prepayment_review' AS issue_type FROM docs WHERE seq % 2 = 0 UNION ALL SELECT transaction_id, 'low_cost_fixed_asset' FROM docs WHERE seq % 3 = 0 UNION ALL SELECT transaction_id, 'missing_tax' FROM docs WHERE seq % 5 = 0 UNION ALL SELECT transaction_id, 'capital_item_review' FROM docs WHERE seq % 7 = 0),
r AS (SELECT *, CASE issue_type WHEN 'capital_item_review' THEN 1 WHEN 'low_cost_fixed_asset' THEN 2 WHEN 'prepayment_review' THEN 3 END AS k FROM f), t AS (SELECT *, min(k) OVER (PARTITION BY transaction_id) AS top FROM r)
SELECT transaction_id, issue_type, CASE WHEN k > top THEN CASE top WHEN 1 THEN 'capital_item_review' WHEN 2 THEN 'low_cost_fixed_asset' END END AS superseded_by FROM t""", "transaction_id", "issue_type", "superseded_by")
def r42(s, d):
    docs = V.documents(s, d).select("company_id", "transaction_id", "seq")
    made = [docs.where(f"seq % {k} = 0").selectExpr("company_id", "transaction_id", f"'{t}' AS issue_type") for k, t in ((2, "prepayment_review"), (3, "low_cost_fixed_asset"), (5, "missing_tax"), (7, "capital_item_review"))]
    return O.superseded(O.union(made))
