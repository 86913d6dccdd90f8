"""KPIs and verdict handling over the test ledger, each with its SQL for DuckDB."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import kpis as K
from ..operators import verdicts as S
from . import ledger_views as V
from .rule_queries import PRELUDE

QUERIES: dict = {}
SQL: dict[str, str] = {}


def kpi(name: str, sql: str | None = None, prelude: bool = True, money: str = ""):
    """Registers a query and its SQL; money names decimal columns, which both sides show as doubles so that any reader compares them alike."""
    shown = money.split()

    def add(f):
        QUERIES[name] = (lambda s, d: f(s, d).withColumns({c: F.col(c).cast("double") for c in shown})) if shown else f
        if sql:
            text = sql.lstrip()
            text = text if not prelude else PRELUDE + text if text[:4].upper() != "WITH" else PRELUDE.rstrip() + ",\n" + text[5:]
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in shown)}) FROM ({text})" if shown else text
        return f

    return add


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


_SECTIONS = """SELECT strftime(date, '%Y-%m') AS period, CASE l.account_code WHEN '200' THEN 'income' WHEN '260' THEN 'other' WHEN '473' THEN 'cogs' ELSE 'expenses' END AS part, l.amount AS value FROM lines l JOIN docs d USING (transaction_id) WHERE l.account_code <> '710'"""


def _sections(s, d):
    rows = V.documents(s, d).select("company_id", F.date_format("date", "yyyy-MM").alias("period"), "account_code", "amount", "line_items")
    items = F.when(F.size("line_items") > 0, F.transform("line_items", lambda x: F.struct(x["account_code"].alias("a"), x["amount"].alias("v")))).otherwise(F.array(F.struct(F.col("account_code").alias("a"), F.col("amount").alias("v"))))
    rows = rows.select("company_id", "period", F.explode(items).alias("x")).where("x.a <> '710'")
    title = F.when(F.col("x.a") == "200", "Income").when(F.col("x.a") == "260", "Plus Other Income").when(F.col("x.a") == "473", "Less Cost of Sales").otherwise("Less Operating Expenses")
    return rows.select("company_id", "period", title.alias("title"), F.col("x.v").alias("value"))


@kpi("k01_profitability", f"""WITH s AS ({_SECTIONS}), t AS (SELECT period, coalesce(sum(value) FILTER (part = 'income'), 0) AS income, coalesce(sum(value) FILTER (part = 'cogs'), 0) AS cogs, coalesce(sum(value) FILTER (part = 'expenses'), 0) AS expenses, coalesce(sum(value) FILTER (part = 'other'), 0) AS other FROM s GROUP BY 1)
SELECT period, CAST(income AS DECIMAL(18,2)) AS income, CAST(cogs AS DECIMAL(18,2)) AS cogs, CAST(income - cogs AS DECIMAL(18,2)) AS gross, CAST(expenses AS DECIMAL(18,2)) AS expenses, CAST(other AS DECIMAL(18,2)) AS other, CAST(income - cogs - expenses + other AS DECIMAL(18,2)) AS net FROM t""", money="income cogs gross expenses other net")
def k01(s, d):
    return K.profitability(_sections(s, d)).drop("company_id")


def _money(name: str, t: str = "decimal(18,2)") -> str:
    return f"CAST({name} AS {t})"


@kpi("k02_financial_position", """WITH c AS (SELECT c_nationkey AS n, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS ca FROM customer GROUP BY 1), l AS (SELECT s_nationkey AS n, sum(CAST(s_acctbal AS DECIMAL(18,2))) AS cl FROM supplier GROUP BY 1)
SELECT concat('co', c.n) AS company_id, CAST(ca AS DECIMAL(18,2)) AS current_assets, CAST(coalesce(cl, 0) AS DECIMAL(18,2)) AS current_liabilities, CAST(ca - coalesce(cl, 0) AS DECIMAL(18,2)) AS working_capital, round(CAST(ca AS DOUBLE) / CAST(cl AS DOUBLE), 4) AS current_ratio, CAST(ca - coalesce(cl, 0) AS DECIMAL(18,2)) AS net_assets FROM c LEFT JOIN l USING (n) WHERE cl IS NOT NULL""", prelude=False, money="current_assets current_liabilities working_capital net_assets")
def k02(s, d):
    ca = _t(s, d, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("v"))
    cl = _t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).alias("v"))
    both = ca.join(cl.withColumnRenamed("v", "w"), "n")
    label = lambda text, v, pos: both.select(F.concat(F.lit("co"), "n").alias("company_id"), F.lit(text).alias("label"), F.lit(pos).alias("pos"), v.cast("decimal(18,2)").alias("value"))
    rows = label("Total Current Assets", F.col("v") - 5, 0).union(label("Total Current Assets", F.col("v"), 1)).union(label("Total Current Liabilities", F.col("w"), 2)).union(label("Total Net Assets", F.col("v") - F.col("w"), 3))
    return K.position(rows).drop("cash_ratio", "debt_ratio")


@kpi("k03_corporation_tax", """WITH p AS (SELECT c_custkey, CAST(c_acctbal * 40 AS DECIMAL(18,2)) AS profit FROM customer)
SELECT c_custkey, profit, CAST(round(CASE WHEN profit <= 0 THEN 0 WHEN profit <= 50000 THEN profit * CAST(0.19 AS DECIMAL(4,2)) WHEN profit >= 250000 THEN profit * CAST(0.25 AS DECIMAL(4,2)) ELSE profit * CAST(0.25 AS DECIMAL(4,2)) - (250000 - profit) * CAST(0.015 AS DECIMAL(4,3)) END, 2) AS DECIMAL(18,2)) AS tax FROM p""", prelude=False, money="profit tax")
def k03(s, d):
    rows = _t(s, d, "customer").select("c_custkey", (F.col("c_acctbal") * 40).cast("decimal(18,2)").alias("profit"))
    return rows.withColumn("tax", K.corporation_tax("profit"))


@kpi("k04_directors_loans", """SELECT CAST(s_suppkey AS VARCHAR) AS code, 'Directors Loan ' || s_name AS name, CAST(s_acctbal - 5000 AS DECIMAL(18,2)) AS balance, CAST(s_acctbal - 5000 AS DECIMAL(18,2)) > 0 AS overdrawn FROM supplier WHERE s_suppkey % 4 = 0""", prelude=False, money="balance")
def k04(s, d):
    rows = _t(s, d, "supplier")
    label = F.concat(F.when(F.col("s_suppkey") % 4 == 0, "Directors Loan ").otherwise("Sundry "), "s_name", F.lit(" ("), "s_suppkey", F.lit(")"))
    tb = rows.select(F.lit(V.COMPANY).alias("company_id"), label.alias("label"), F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal") - 5000).cast("decimal(18,2)").alias("debit"), F.when(F.col("s_acctbal") <= 5000, 5000 - F.col("s_acctbal")).cast("decimal(18,2)").alias("credit"))
    return K.directors_loans(tb).drop("company_id")


@kpi("k05_bank_reconciliation", """SELECT count(*) AS total, count(*) FILTER (NOT reconciled) AS unreconciled, CAST(sum(amount) FILTER (NOT reconciled) AS DECIMAL(18,2)) AS unreconciled_value, CAST(max(date) FILTER (reconciled) AS VARCHAR) AS last_reconciled, CAST(max(date) AS VARCHAR) AS most_recent FROM v_bank""", money="unreconciled_value")
def k05(s, d):
    return K.bank_reconciliation(V.bank(s, d)).drop("company_id").withColumn("last_reconciled", F.col("last_reconciled").cast("string")).withColumn("most_recent", F.col("most_recent").cast("string"))


def _gl(s, d):
    return V.bank(s, d).groupBy("company_id", "bank_account").agg(F.sum(F.when(F.col("type") == "RECEIVE", F.col("amount")).otherwise(-F.col("amount"))).cast("decimal(18,2)").alias("balance"))


_GL = "gl AS (SELECT bank_account, CAST(sum(CASE WHEN type = 'RECEIVE' THEN amount ELSE -amount END) AS DECIMAL(18,2)) AS balance, CAST(sum(CASE WHEN NOT reconciled AND type = 'RECEIVE' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS received, CAST(sum(CASE WHEN NOT reconciled AND type = 'SPEND' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS spent, count(*) FILTER (NOT reconciled AND type = 'RECEIVE') AS nr, count(*) FILTER (NOT reconciled AND type = 'SPEND') AS ns FROM v_bank GROUP BY 1)"


@kpi("k05b_k08_bank_balance_gaps", f"WITH {_GL} SELECT bank_account, balance, CAST(balance + received - spent AS DECIMAL(18,2)) AS statement, CAST(received - spent AS DECIMAL(18,2)) AS gap FROM gl WHERE abs(received - spent) > 0.01 AND bank_account <> 'ACC2'", money="balance statement gap")
def k05b(s, d):
    gl = _gl(s, d)
    statement = K.reconciliation_summary(gl, V.bank(s, d)).select("company_id", "bank_account", "statement")
    return K.balance_gaps(gl, statement, excluded=("ACC2",)).drop("company_id")


@kpi("k06_reconciliation_summary", f"WITH {_GL} SELECT bank_account, balance, received, spent, CAST(balance + received - spent AS DECIMAL(18,2)) AS statement FROM gl", money="balance received spent statement")
def k06(s, d):
    return K.reconciliation_summary(_gl(s, d), V.bank(s, d)).drop("company_id")


@kpi("k07_unreconciled_accounts", f"WITH {_GL} SELECT bank_account, nr AS received, ns AS spent FROM gl WHERE nr + ns > 0")
def k07(s, d):
    return K.unreconciled_accounts(V.bank(s, d)).drop("company_id")


@kpi("k09_opening_differences", """WITH l AS (SELECT concat('co', o_custkey % 50) AS company_id, make_date(year(o_orderdate), 12, 31) AS period_end, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS ledger FROM orders GROUP BY 1, 2)
SELECT company_id, CAST(period_end AS VARCHAR) AS period_end, CAST(ledger + year(period_end) % 3 AS DECIMAL(18,2)) AS filed, CAST(ledger AS DECIMAL(18,2)) AS ledger, CAST(year(period_end) % 3 AS DECIMAL(18,2)) AS difference FROM l WHERE year(period_end) % 3 >= 1""", prelude=False, money="filed ledger difference")
def k09(s, d):
    o = _t(s, d, "orders")
    ledger = o.groupBy(F.concat(F.lit("co"), F.col("o_custkey") % 50).alias("company_id"), F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("period_end")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("value"))
    filed = ledger.select("company_id", "period_end", F.explode(F.array(F.struct(F.lit("filing").alias("source"), (F.col("value") + 9).alias("value")), F.struct(F.lit("manual").alias("source"), (F.col("value") + F.year("period_end") % 3).alias("value")))).alias("f")).select("company_id", "period_end", "f.*")
    return K.opening_differences(filed, ledger).select("company_id", F.col("period_end").cast("string").alias("period_end"), F.col("filed").cast("decimal(18,2)").alias("filed"), "ledger", "difference")


@kpi("k10_late_transactions", "SELECT transaction_id, CAST(date + CAST(seq % 400 AS INT) AS VARCHAR) AS posted_date FROM docs WHERE date <= DATE '1998-12-31' AND date + CAST(seq % 400 AS INT) > DATE '1998-12-31'")
def k10(s, d):
    docs = V.documents(s, d).withColumn("posted_date", F.date_add("date", (F.col("seq") % 400).cast("int")))
    return K.late_documents(docs, date(1998, 12, 31)).select("transaction_id", F.col("posted_date").cast("string").alias("posted_date"))


_OUT = ", ".join(f"({i}, '{k}', {w})" for i, (k, w) in enumerate(K.OUTGOINGS.items()))
_CASH = f"""WITH c AS (SELECT concat('co', c_nationkey) AS company_id, CAST(sum(c_acctbal) / 20 AS DECIMAL(18,2)) AS cash FROM customer GROUP BY 1),
k(ord, category, weight) AS (VALUES {_OUT}), l AS (SELECT concat('co', s_nationkey) AS company_id, s_suppkey % 8 AS ord, greatest(sum(CAST(s_acctbal AS DECIMAL(18,2))), 0) AS owed FROM supplier GROUP BY 1, 2),
g AS (SELECT c.company_id, cash, k.ord, category, weight, CAST(CASE WHEN k.ord = 6 THEN greatest(coalesce(owed, 0), 1000) ELSE coalesce(owed, 0) END AS DECIMAL(18,2)) AS amount FROM c CROSS JOIN k LEFT JOIN l ON l.company_id = c.company_id AND l.ord = k.ord),
w AS (SELECT *, CAST(sum(amount) OVER (PARTITION BY company_id ORDER BY ord) AS DECIMAL(18,2)) AS cumulative FROM g)"""


def _outgoings(s, d):
    cash = _t(s, d, "customer").groupBy(F.concat(F.lit("co"), "c_nationkey").alias("company_id")).agg((F.sum("c_acctbal") / 20).cast("decimal(18,2)").alias("cash"))
    names = F.array(*(F.lit(k) for k in K.OUTGOINGS))
    owed = _t(s, d, "supplier").select(F.concat(F.lit("co"), "s_nationkey").alias("company_id"), F.get(names, (F.col("s_suppkey") % 8).cast("int")).alias("category"), F.col("s_acctbal").cast("decimal(18,2)").alias("owed"))
    return K.outgoings(owed, cash, cash.select("company_id", F.lit(1000).cast("decimal(18,2)").alias("tax")))


@kpi("k11_cash_outgoings", _CASH + " SELECT company_id, category, amount, cumulative, cash >= cumulative AS can_pay FROM w", prelude=False, money="amount cumulative")
def k11(s, d):
    return _outgoings(s, d).select("company_id", "category", "amount", "cumulative", "can_pay")


@kpi("k11_cash_score", _CASH + """, p AS (SELECT company_id, weight, amount, least(amount, greatest(greatest(cash, 0) - (cumulative - amount), 0)) AS paid FROM w),
t AS (SELECT company_id, round(sum(CASE WHEN amount > 0 THEN weight * (CAST(paid AS DOUBLE) / CAST(amount AS DOUBLE)) END) / sum(CASE WHEN amount > 0 THEN weight END) * 100, 1) AS score, CAST(sum(weight * amount) AS DECIMAL(18,2)) AS weighted_outgoings FROM p GROUP BY 1)
SELECT company_id, coalesce(score, 100.0) AS score, CASE WHEN coalesce(score, 100) >= 75 THEN 'strong' WHEN score >= 50 THEN 'moderate' WHEN score >= 25 THEN 'weak' ELSE 'critical' END AS rating, weighted_outgoings FROM t""", prelude=False, money="weighted_outgoings")
def k11s(s, d):
    return K.cash_score(_outgoings(s, d))


_MONTHS = "WITH m AS (SELECT strftime(date, '%Y-%m') AS period, CAST(sum(amount) AS DECIMAL(18,2)) AS sales FROM v_sales GROUP BY 1)"


def _monthly(s, d):
    return V.sales(s, d).groupBy("company_id", F.date_format("date", "yyyy-MM").alias("period")).agg(F.sum("amount").cast("decimal(18,2)").alias("sales"))


def _target(basis: str, expr: str, percent: int = 0):
    @kpi(f"k12_sales_target_{basis}", _MONTHS + f", t AS (SELECT period, sales, {expr} AS base FROM m) SELECT period, sales, round(base * {1 + percent / 100}, 2) AS target, round(CAST(sales AS DOUBLE) - round(base * {1 + percent / 100}, 2), 2) AS variance FROM t", money="sales")
    def run(s, d):
        return K.sales_targets(_monthly(s, d), basis, percent, 50000.0).drop("company_id")


_target("previous_month", "CAST(lag(sales) OVER (ORDER BY period) AS DOUBLE)", 10)
_target("same_month_last_year", "CAST(lag(sales, 12) OVER (ORDER BY period) AS DOUBLE)")
_target("average_3", "round(CAST(sum(sales) OVER (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS DOUBLE) / count(*) OVER (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 2)")
_target("average_12", "round(CAST(sum(sales) OVER (ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS DOUBLE) / count(*) OVER (ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 2)")
_target("manual", "50000.0")


@kpi("k12_chart_latest", _MONTHS + " SELECT period, sales FROM m ORDER BY period DESC LIMIT 5", money="sales")
def k12c(s, d):
    return K.latest_periods(_monthly(s, d)).drop("company_id")


@kpi("k11_movements", _MONTHS + " SELECT period, sales AS balance, CAST(sales - lag(sales) OVER (ORDER BY period) AS DECIMAL(18,2)) AS movement FROM m", money="balance movement")
def k11m(s, d):
    return K.movements(_monthly(s, d).withColumnRenamed("sales", "balance")).select("period", "balance", F.col("movement").cast("decimal(18,2)").alias("movement"))


_ITEMS = """WITH i AS (SELECT transaction_id AS item_id, amount, CASE WHEN seq % 7 > 0 THEN date END AS s, CASE WHEN seq % 7 > 0 THEN CAST(date + INTERVAL (seq % 20 + 1) MONTH AS DATE) END AS e FROM v_bills WHERE account_code = '429'),
m AS (SELECT *, CAST(greatest(round_even(date_diff('day', s, e) / 30.44, 0), 1) AS INT) AS months FROM i),
n AS (SELECT *, CAST(round(amount / months, 3) AS DECIMAL(18,3)) AS monthly FROM (SELECT * REPLACE (CAST(amount AS DECIMAL(18,6)) AS amount) FROM m)),
b AS (SELECT *, CAST(CASE WHEN months IS NULL THEN amount ELSE amount - monthly * least(greatest((1998 - year(s)) * 12 + 13 - month(s), 0), months) END AS DECIMAL(18,3)) AS balance FROM n)"""


def _schedule(s, d):
    b = V.bills(s, d).where("account_code = '429'")
    start = F.when(F.col("seq") % 7 > 0, F.col("date"))
    return K.prepayment_schedule(b.select("company_id", F.col("transaction_id").alias("item_id"), "amount", start.alias("start"), F.add_months(start, (F.col("seq") % 20 + 1).cast("int")).alias("end")), date(1998, 12, 31))


@kpi("k13_prepayment_balances", _ITEMS + " SELECT item_id, coalesce(months, 0) AS months, balance FROM b", money="balance")
def k13(s, d):
    return _schedule(s, d).groupBy("item_id").agg(F.coalesce(F.max("months"), F.lit(0)).alias("months"), F.max("balance").alias("balance"))


@kpi("k13_schedule_totals", _ITEMS + ", g AS (SELECT monthly, last_day(make_date(1998, k, 1)) AS month FROM b, range(1, 13) r(k) WHERE last_day(make_date(1998, k, 1)) BETWEEN last_day(s) AND last_day(e)) SELECT CAST(month AS VARCHAR) AS month, CAST(sum(monthly) AS DECIMAL(18,3)) AS released, count(*) AS items FROM g GROUP BY 1", money="released")
def k13t(s, d):
    return K.schedule_totals(_schedule(s, d)).select(F.col("month").cast("string").alias("month"), "released", "items")


# --- verdicts --------------------------------------------------------------------

_RULES = (("missing_tax", 5), ("duplicate_bill", 3), ("future_dated", 7))
_VERDICTS = "v AS MATERIALIZED (SELECT seq, concat('co', seq % 4) AS company_id, transaction_id AS document_id, type, contact_id, amount, amount_due, date AS ran_at, list_filter([" + ", ".join(f"CASE WHEN seq % {k} = 0 THEN '{r}' END" for r, k in _RULES) + "], lambda x: x IS NOT NULL) AS rule_ids, seq % 13 = 0 AS resolved, seq % 17 = 0 AS dismissed, seq % 19 = 0 AS marked_ok, seq % 23 = 0 AS auto_cleared, CASE WHEN seq % 29 = 0 THEN date + 900 END AS snoozed_until FROM docs)"
_OPEN = "NOT resolved AND NOT dismissed AND NOT marked_ok AND NOT auto_cleared"
_AWAKE = _OPEN + " AND (snoozed_until IS NULL OR snoozed_until <= DATE '2001-12-31')"


def verdicts(s, d):
    on = lambda k: F.col("seq") % k == 0
    ids = F.filter(F.array(*(F.when(on(k), F.lit(r)) for r, k in _RULES)), lambda x: x.isNotNull())
    return V.documents(s, d).select("seq", F.concat(F.lit("co"), F.col("seq") % 4).alias("company_id"), F.col("transaction_id").alias("document_id"), "type", "contact_id", "amount", "amount_due", F.col("date").alias("ran_at"), ids.alias("rule_ids"), on(13).alias("resolved"), on(17).alias("dismissed"), on(19).alias("marked_ok"), on(23).alias("auto_cleared"), F.when(on(29), F.date_add("date", 900)).alias("snoozed_until"))


def _score(a: str, t: str) -> str:
    return f"CAST(greatest(0, least(100, round_even(CAST(({a} - {t}) * 100 AS DOUBLE) / {a}, 0))) AS INT)"


@kpi("k14_bookkeeping_health", f"WITH {_VERDICTS}, t AS (SELECT company_id, count(*) AS audited, count(*) FILTER (NOT resolved AND NOT dismissed AND len(rule_ids) > 0) AS open FROM v GROUP BY 1) SELECT company_id, audited, open, {_score('audited', 'open')} AS score FROM t")
def k14(s, d):
    v = verdicts(s, d)
    audits = v.groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).select("company_id", F.explode(F.array("n", F.col("n") - 5)).alias("audited"))
    return S.bookkeeping_health(v, audits)


@kpi("k15_panorama", f"WITH {_VERDICTS}, o AS (SELECT * FROM v WHERE {_OPEN} AND len(rule_ids) > 0), t AS (SELECT company_id, count(*) AS documents FROM v GROUP BY 1), n AS (SELECT company_id, count(*) AS open FROM o GROUP BY 1), r AS (SELECT company_id, rule_ids[1] AS rule, count(*) AS k, min(seq) AS m FROM o GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY k DESC, m) AS p FROM r) SELECT t.company_id, documents, open, {_score('documents', 'open')} AS score, rule AS top_rule FROM t JOIN n USING (company_id) JOIN f ON f.company_id = t.company_id AND p = 1")
def k15(s, d):
    return S.panorama(verdicts(s, d))


@kpi("k16_top_issues", f"WITH {_VERDICTS}, r AS (SELECT company_id, rule_ids[1] AS rule, count(*) AS n, min(seq) AS m, arg_min(document_id, (seq, document_id)) AS sample FROM v WHERE {_OPEN} AND len(rule_ids) > 0 GROUP BY 1, 2), f AS (SELECT *, CAST(row_number() OVER (PARTITION BY company_id ORDER BY n DESC, m) AS INT) AS place FROM r) SELECT company_id, place, rule, n, sample FROM f WHERE place <= 2")
def k16(s, d):
    return S.top_issues(verdicts(s, d), 2)


@kpi("k17_issue_stats", f"WITH {_VERDICTS}, x AS (SELECT company_id, unnest(rule_ids) AS rule FROM v WHERE {_AWAKE}) SELECT company_id, rule, count(*) AS documents FROM x GROUP BY 1, 2")
def k17(s, d):
    return S.issue_stats(verdicts(s, d), V.AS_OF)


@kpi("k18_feed_page", f"WITH {_VERDICTS} SELECT document_id, CAST(ran_at AS VARCHAR) AS ran_at FROM v WHERE {_AWAKE} AND list_contains(rule_ids, 'duplicate_bill') AND lower(document_id) LIKE '%1%' ORDER BY v.ran_at DESC, document_id LIMIT 50 OFFSET 100")
def k18(s, d):
    rows = S.feed(verdicts(s, d), V.AS_OF, "duplicate_bill", "1", skip_bank=True)
    return S.page(rows, 50, 100).select("document_id", F.col("ran_at").cast("string").alias("ran_at"))


@kpi("k18_feed_totals", f"WITH {_VERDICTS} SELECT company_id, count(*) AS total, CAST(sum(coalesce(amount_due, amount, 0)) AS DECIMAL(18,2)) AS total_value FROM v WHERE {_AWAKE} AND len(rule_ids) > 0 GROUP BY 1", money="total_value")
def k18t(s, d):
    return S.feed_totals(S.feed(verdicts(s, d), V.AS_OF))


@kpi("k19_status_counts", f"WITH {_VERDICTS} SELECT company_id, count(*) FILTER (len(rule_ids) > 0) AS blocked, count(*) FILTER (len(rule_ids) = 0) AS passed FROM v GROUP BY 1")
def k19(s, d):
    v = verdicts(s, d).select("company_id", F.when(F.size("rule_ids") > 0, "blocked").otherwise("passed").alias("status"))
    return v.groupBy("company_id").pivot("status", ["blocked", "passed"]).agg(F.count(F.lit(1)))


@kpi("k20_firm_summary", """WITH c AS (SELECT concat('f', c_custkey % 7) AS firm_id, c_custkey AS k, c_acctbal FROM customer) SELECT firm_id, count(*) AS companies, count(*) FILTER (k % 3 > 0) AS with_snapshot, count(*) FILTER (k % 3 > 0 AND k % 5 = 0) AS failed, count(*) FILTER (k % 3 > 0 AND c_acctbal / 10000 < 0.2) AS cash_tight FROM c GROUP BY 1""", prelude=False)
def k20(s, d):
    c = _t(s, d, "customer").select(F.concat(F.lit("f"), F.col("c_custkey") % 7).alias("firm_id"), F.col("c_custkey").alias("company_id"), "c_acctbal")
    return S.firm_summary(c.drop("c_acctbal"), c.where("company_id % 3 > 0").select("company_id", (F.col("company_id") % 5 > 0).alias("ok"), (F.col("c_acctbal") / 10000).alias("cash_ratio")))


@kpi("k21_score_alerts", """WITH h AS (SELECT user_id, arg_max(CAST(floor(value) AS INT) % 100, (ts, event_id)) AS was FROM events GROUP BY 1), n AS (SELECT DISTINCT user_id, CAST(user_id * 7 % 100 AS INT) AS score FROM events)
SELECT user_id AS company_id, score, was, CASE WHEN score < 40 THEN 'critical' WHEN score < 70 THEN 'watch' ELSE 'info' END AS level FROM n JOIN h USING (user_id) WHERE score < was""", prelude=False)
def k21(s, d):
    e = _t(s, d, "events")
    h = e.select(F.col("user_id").alias("company_id"), F.struct("ts", "event_id").alias("recorded_at"), (F.floor("value").cast("int") % 100).alias("score"))
    return S.score_alerts(e.select(F.col("user_id").alias("company_id"), (F.col("user_id") * 7 % 100).cast("int").alias("score")).distinct(), h)


_LABELS = "CASE r WHEN 'missing_tax' THEN 'Missing tax code (any document)' WHEN 'duplicate_bill' THEN 'Duplicate bills' ELSE 'Future-dated documents' END"


@kpi("k22_s12_report", f"""WITH {_VERDICTS}, o AS (SELECT * FROM v WHERE {_OPEN}), x AS (SELECT *, unnest(rule_ids) AS r FROM o)
SELECT company_id, document_id AS transaction_id, {_LABELS} AS section, coalesce(contact_id, '') AS contact, CASE WHEN seq % 2 = 0 THEN concat('N', seq) WHEN seq % 3 = 0 THEN 'ref' ELSE '' END AS transaction, CAST(ran_at AS VARCHAR) AS date,
concat(CASE WHEN seq % 5 = 0 THEN 'EUR ' ELSE '£' END, format('{{:,.2f}}', CAST(amount AS DOUBLE))) AS amount, CASE WHEN seq % 2 = 0 THEN 'PAID' ELSE '' END AS status, CASE WHEN r = 'duplicate_bill' THEN 'N1' ELSE '' END AS duplicate_of,
CASE WHEN r <> 'duplicate_bill' THEN '' WHEN seq % 2 = 0 THEN 'KEEP (original)' ELSE 'VOID (duplicate)' END AS action, 'Medium' AS severity, CASE WHEN r = 'duplicate_bill' THEN '45%' ELSE '' END AS confidence, CASE WHEN seq % 2 = 0 THEN 'say "so", then' ELSE '' END AS reason FROM x""")
def k22(s, d):
    even = F.col("seq") % 2 == 0
    v = verdicts(s, d).withColumns({"vendor_name": F.col("contact_id"), "invoice_number": F.when(even, F.concat(F.lit("N"), "seq")), "reference": F.when(F.col("seq") % 3 == 0, "ref"), "display_number": F.lit(""), "date": F.col("ran_at"), "currency_code": F.when(F.col("seq") % 5 == 0, " eur"), "doc_status": F.when(even, "PAID")})
    dup = F.col("issue_type") == "duplicate_bill"
    flags = v.select("company_id", F.col("document_id").alias("transaction_id"), F.explode("rule_ids").alias("issue_type"), even.alias("even"))
    flags = flags.withColumns({"severity": F.lit("medium"), "confidence": F.when(dup, 0.45), "dup_of_number": F.when(dup, "N1"), "likely_original": F.when(dup, F.col("even")), "reason": F.when(F.col("even"), 'say "so", then')})
    return S.report(v, flags)


_OLD = "old AS MATERIALIZED (SELECT * FROM v WHERE seq % 5 < 4), new AS MATERIALIZED (SELECT company_id, document_id, ['old_unpaid_bill', 'missing_tax'] AS n_ids FROM v WHERE seq % 3 = 0)"


def _runs(s, d):
    v = verdicts(s, d)
    return v.where("seq % 5 < 4"), v.where("seq % 3 = 0").select("company_id", "document_id", F.array(F.lit("old_unpaid_bill"), F.lit("missing_tax")).alias("rule_ids"))


def _merge_sql(ids: str) -> str:
    return f"""WITH {_VERDICTS}, {_OLD}, j AS (SELECT coalesce(old.company_id, new.company_id) AS company_id, coalesce(old.document_id, new.document_id) AS document_id, rule_ids, n_ids, coalesce(resolved, false) AS resolved, coalesce(dismissed, false) AS dismissed, coalesce(marked_ok, false) AS marked_ok, coalesce(auto_cleared, false) AS auto_cleared FROM old FULL JOIN new ON old.document_id = new.document_id)
SELECT company_id, document_id, array_to_string(CASE WHEN resolved OR dismissed OR marked_ok OR n_ids IS NULL THEN rule_ids ELSE {ids} END, ',') AS rules, resolved, dismissed, marked_ok, CASE WHEN n_ids IS NOT NULL AND NOT (resolved OR dismissed OR marked_ok) THEN false ELSE auto_cleared END AS auto_cleared FROM j"""


def _shown(df):
    return df.select("company_id", "document_id", F.array_join("rule_ids", ",").alias("rules"), "resolved", "dismissed", "marked_ok", "auto_cleared")


@kpi("m02_merge_full", _merge_sql("n_ids"))
def m02(s, d):
    return _shown(S.merged(*_runs(s, d)))


@kpi("m02_merge_scoped", _merge_sql("list_concat(list_filter(coalesce(rule_ids, []), lambda x: x <> 'missing_tax' AND x <> 'old_unpaid_bill'), n_ids)"))
def m02s(s, d):
    return _shown(S.merged(*_runs(s, d), ("missing_tax", "old_unpaid_bill")))


@kpi("m03_auto_clear", f"WITH {_VERDICTS}, {_OLD} SELECT company_id, document_id, array_to_string(rule_ids, ',') AS rules, resolved, dismissed, marked_ok, auto_cleared OR (seq % 2 = 0 AND seq % 3 > 0 AND NOT resolved AND NOT dismissed AND NOT marked_ok) AS auto_cleared FROM old")
def m03(s, d):
    old, new = _runs(s, d)
    return _shown(S.cleared(old, verdicts(s, d).where("seq % 2 = 0"), new))


@kpi("m04_strip_duplicates", f"WITH {_VERDICTS} SELECT company_id, document_id, array_to_string(CASE WHEN resolved OR dismissed OR marked_ok THEN rule_ids ELSE list_filter(rule_ids, lambda x: x <> 'duplicate_bill') END, ',') AS rules, resolved, dismissed, marked_ok, auto_cleared OR (NOT resolved AND NOT dismissed AND NOT marked_ok AND len(list_filter(rule_ids, lambda x: x <> 'duplicate_bill')) = 0) AS auto_cleared FROM v")
def m04(s, d):
    return _shown(S.without_types(verdicts(s, d)))


@kpi("m07_insert_if_absent", f"WITH {_VERDICTS} SELECT company_id, document_id FROM v WHERE seq % 3 = 0 AND seq % 5 = 4")
def m07(s, d):
    old, new = _runs(s, d)
    return S.inserted(old, new).select("company_id", "document_id")


@kpi("m08_action_states", """WITH a AS (SELECT user_id % 50 AS company_id, user_id AS document_id, ts AS t0, CASE event_id % 6 WHEN 0 THEN 'resolve' WHEN 1 THEN 'dismiss' WHEN 2 THEN 'mark_ok' WHEN 3 THEN 'snooze' WHEN 4 THEN 'restore' END AS action, event_id AS until FROM events),
t AS (SELECT company_id, document_id, max(t0) FILTER (action = 'restore') AS w, max(t0) FILTER (action = 'resolve') AS r, max(t0) FILTER (action = 'dismiss') AS d, max(t0) FILTER (action = 'mark_ok') AS m, max(t0) FILTER (action = 'snooze') AS s, arg_max(until, t0) FILTER (action = 'snooze') AS u FROM a GROUP BY 1, 2)
SELECT company_id, document_id, coalesce(r > w, r IS NOT NULL) AS resolved, coalesce(d > w, d IS NOT NULL) AS dismissed, coalesce(m > w, m IS NOT NULL) AS marked_ok, coalesce(CASE WHEN coalesce(s > w, s IS NOT NULL) THEN u END, -1) AS snoozed_until FROM t""", prelude=False)
def m08(s, d):
    e = _t(s, d, "events")
    names = F.array(*map(F.lit, ("resolve", "dismiss", "mark_ok", "snooze", "restore", "view")))
    a = e.select((F.col("user_id") % 50).alias("company_id"), F.col("user_id").alias("document_id"), F.col("ts").alias("at"), F.get(names, (F.col("event_id") % 6).cast("int")).alias("action"), F.col("event_id").alias("until"))
    return S.states(a).withColumn("snoozed_until", F.coalesce("snoozed_until", F.lit(-1)))


@kpi("s13_upsert_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1", prelude=False)
def s13(s, d):
    return S.latest(_t(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], "ts", "event_id").select("user_id", "event_type", "value")


@kpi("s14_prune_missing", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)", prelude=False)
def s14(s, d):
    return S.pruned(_t(s, d, "customer"), _t(s, d, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name")


@kpi("m11_organisations", "SELECT c_custkey AS tenant_id, CASE WHEN c_custkey % 2 > 0 THEN 'add' WHEN c_custkey % 3 > 0 AND c_custkey % 4 = 0 THEN 'deactivate' ELSE 'reactivate' END AS change FROM customer WHERE (c_custkey % 2 > 0 AND c_custkey % 4 > 0) OR (c_custkey % 2 = 0 AND ((c_custkey % 3 > 0 AND c_custkey % 4 = 0) OR (c_custkey % 3 = 0 AND c_custkey % 4 > 0)))", prelude=False)
def m11(s, d):
    c = _t(s, d, "customer").select(F.col("c_custkey").alias("tenant_id"))
    return S.organisations(c.where("tenant_id % 2 = 0").withColumn("active", F.col("tenant_id") % 3 > 0), c.where("tenant_id % 4 > 0"))


@kpi("m12_tenant_access", "SELECT s_suppkey AS user_id, c_custkey AS company_id FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE s_suppkey % 5 = 0 OR (s_suppkey * 31 + c_custkey) % 4 = 0", prelude=False)
def m12(s, d):
    c = _t(s, d, "customer").select(F.col("c_nationkey").alias("firm_id"), F.col("c_custkey").alias("company_id"))
    u = _t(s, d, "supplier").select(F.col("s_nationkey").alias("firm_id"), F.col("s_suppkey").alias("user_id"), (F.col("s_suppkey") % 5 == 0).alias("is_owner"))
    tasks = 4 * int(s.conf.get("spark.sql.shuffle.partitions"))
    grants = u.join(c.repartition(tasks, "company_id"), "firm_id").where((F.col("user_id") * 31 + F.col("company_id")) % 4 == 0).select("user_id", "company_id")
    return S.accessible(c, u, grants)
