"""What is read back: nested reports, balances by two keys, ids from names, pages by key, keyed stream state and served snapshots, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import document_rules as D
from ..operators import entity_verdicts as E
from ..operators import kpis as K
from ..operators import verdicts as S
from ..operators.groups import shared_folder
from ..sources import reports as R
from ..sources.snapshots import ServedTable
from ..streaming import keyed
from . import kpi_queries as P
from . import ledger_views as V
from .rule_queries import PRELUDE

QUERIES: dict = {}
SQL: dict[str, str] = {}
_t = P._t


def served(name: str, sql: str, prelude: bool = False):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql if not prelude else PRELUDE + sql if sql[:4] != "WITH" else PRELUDE.rstrip() + ",\n" + sql[5:]
        return f

    return add


# --- reports ----------------------------------------------------------------------------
@served("s09_nested_report", """WITH c AS (SELECT r_name AS company_id, n_name, n_nationkey, c_custkey, c_name, c_custkey % 3 AS part FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT company_id, CASE WHEN part = 0 THEN n_name ELSE concat('part ', part) END AS title, c_name AS label, CAST(c_custkey AS VARCHAR) AS value,
  concat_ws('.', 0, dense_rank() OVER (PARTITION BY company_id ORDER BY n_nationkey) - 1, 0, dense_rank() OVER (PARTITION BY company_id, n_nationkey ORDER BY part) - 1, row_number() OVER (PARTITION BY company_id, n_nationkey, part ORDER BY c_custkey) - 1) AS place FROM c""")
def s09_nested(s, d):
    """A report for each region with customers five levels down: every row, its nearest title and its place."""
    c = _t(s, d, "customer").join(_t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cell = lambda v: F.struct(v.cast("string").alias("Value"))
    c = c.select("r_name", "n_nationkey", "n_name", (F.col("c_custkey") % 3).alias("part"), "c_custkey", F.struct(F.lit("Row").alias("RowType"), F.array(cell(F.col("c_name")), cell(F.col("c_custkey"))).alias("Cells")).alias("row"))

    def nested(rows, keys: list[str], order: str, title):
        """Rows of a level under a section of their keys."""
        listed = F.transform(F.sort_array(F.collect_list(F.struct(order, F.to_json("row").alias("row")))), lambda x: x["row"])
        section = F.concat(F.lit('{"RowType":"Section","Title":"'), title, F.lit('","Rows":['), F.array_join(listed, ","), F.lit("]}"))
        return rows.groupBy(*keys).agg(section.alias("json")).withColumn("row", F.from_json("json", "variant"))

    parts = nested(c, ["r_name", "n_nationkey", "n_name", "part"], "c_custkey", F.when(F.col("part") == 0, "").otherwise(F.concat(F.lit("part "), F.col("part").cast("string"))))
    blank = nested(parts, ["r_name", "n_nationkey", "n_name"], "part", F.lit(""))
    nations = nested(blank, ["r_name", "n_nationkey", "n_name"], "n_nationkey", F.col("n_name"))
    regions = nested(nations, ["r_name"], "n_nationkey", F.col("r_name"))
    reports = regions.select(F.col("r_name").alias("company_id"), F.concat(F.lit('{"Rows":['), "json", F.lit("]}")).alias("report_json"))
    found = R.rows(reports)
    return found.select("company_id", "title", F.get("cells", F.lit(0))["Value"].alias("label"), F.get("cells", F.lit(1))["Value"].alias("value"), F.array_join(F.col("pos").cast("array<string>"), ".").alias("place"))


# --- balances by code, else by id ---------------------------------------------------------
_BALANCES = """WITH k AS (SELECT s_suppkey AS k, s_acctbal, concat('co', s_nationkey % 5) AS company_id FROM supplier),
b AS (SELECT k, company_id, concat('9', k) AS code, CASE k % 6 WHEN 0 THEN 'Trade creditors' WHEN 1 THEN 'VAT' WHEN 2 THEN 'Bank' WHEN 3 THEN 'Pension' WHEN 4 THEN 'Loan' ELSE 'Sales' END AS name, CASE k % 6 WHEN 2 THEN 'BANK' WHEN 5 THEN 'REVENUE' ELSE 'CURRLIAB' END AS type,
  CAST(CASE WHEN k % 4 = 0 THEN s_acctbal + 1 WHEN k % 4 = 1 THEN s_acctbal WHEN k % 4 = 2 THEN -s_acctbal ELSE 0 END AS DECIMAL(18,2)) AS balance, CASE k % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'code' WHEN 2 THEN 'id' ELSE '' END AS found_by FROM k)"""


def _balances(s, d):
    """Accounts that the trial balance has by code (twice, with another balance first), by code only, by id only, and not at all."""
    v = _t(s, d, "supplier").withColumn("company_id", F.concat(F.lit("co"), (F.col("s_nationkey") % 5).cast("string"))).withColumn("k", F.col("s_suppkey"))
    kind = F.col("k") % 6
    name = F.element_at(F.array(*map(F.lit, ("Trade creditors", "VAT", "Bank", "Pension", "Loan", "Sales"))), (kind + 1).cast("int"))
    code, ident = F.concat(F.lit("9"), "k"), F.concat(F.lit("id-"), "k")
    accounts = v.select("company_id", F.concat(F.lit(" "), code).alias("code"), ident.alias("account_id"), name.alias("name"), F.when(kind == 2, "BANK").when(kind == 5, "REVENUE").otherwise("CURRLIAB").alias("type"), F.lit("").alias("klass"), F.lit("").alias("bank_type"), F.lit("").alias("system"))
    accounts = accounts.union(accounts.where("code like '%1'")).union(accounts.withColumn("code", F.lit(" ")))  # repeats, and blank codes
    how, money = F.col("k") % 4, F.col("s_acctbal").cast("decimal(18,2)")
    row = lambda c, i, b, n: F.struct(c.alias("code"), i.alias("account_id"), b.cast("decimal(18,2)").alias("balance"), F.array(F.lit(0), F.lit(n)).alias("pos"))
    none = F.lit("")
    rows = F.when(how == 0, F.array(row(code, ident, money, 1), row(code, none, money + 1, 2), row(none, ident, money * 9, 3))).when(how == 1, F.array(row(code, none, money, 1))).when(how == 2, F.array(row(none, ident, -money, 1))).otherwise(F.array())
    return K.account_balances(accounts, v.select("company_id", F.explode(rows).alias("r")).select("company_id", "r.*"))


@served("j11_account_balances", _BALANCES + " SELECT company_id, code, name, CAST(balance AS DOUBLE) AS balance, found_by FROM b")
def j11(s, d):
    return _balances(s, d).select("company_id", "code", "name", F.col("balance").cast("double").alias("balance"), F.coalesce("found_by", F.lit("")).alias("found_by"))


@served("k11_outgoings_from_ledger", _BALANCES + """, owed AS (SELECT company_id, CASE name WHEN 'Trade creditors' THEN 'suppliers' WHEN 'VAT' THEN 'vat' WHEN 'Pension' THEN 'pension' ELSE 'loans_other' END AS category, -balance AS owed FROM b WHERE type = 'CURRLIAB'),
c AS (SELECT company_id, sum(CASE WHEN type = 'BANK' THEN balance ELSE 0 END) AS cash FROM b GROUP BY 1), o(category, ord) AS (VALUES ('suppliers', 0), ('net_wages', 1), ('paye_nic', 2), ('pension', 3), ('credit_cards', 4), ('vat', 5), ('corporation_tax', 6), ('loans_other', 7)),
g AS (SELECT c.company_id, cash, category, ord, greatest(coalesce((SELECT sum(owed) FROM owed w WHERE w.company_id = c.company_id AND w.category = o.category), 0), 0) AS amount FROM c, o)
SELECT company_id, category, CAST(amount AS DOUBLE) AS amount, CAST(sum(amount) OVER (PARTITION BY company_id ORDER BY ord) AS DOUBLE) AS cumulative, cash >= sum(amount) OVER (PARTITION BY company_id ORDER BY ord) AS can_pay FROM g""")
def k11_ledger(s, d):
    cash, owed = K.cash_and_liabilities(_balances(s, d))
    return K.outgoings(owed, cash).select("company_id", "category", F.col("amount").cast("double").alias("amount"), F.col("cumulative").cast("double").alias("cumulative"), "can_pay")


# --- ids from names -----------------------------------------------------------------------
_NAMED = "sha1(unhex('" + uuid.UUID(S.PRE_LEDGER).hex + "') || CAST(transaction_id AS BLOB))"


@served("m07_pre_ledger_ids", f"""WITH x AS (SELECT transaction_id, {_NAMED} AS h FROM v_sales WHERE date > DATE '2001-06-30' OR invoice_number IS NULL OR NOT EXISTS (SELECT 1 FROM v_line WHERE ord = seq AND line_no = 1 AND tax_code IS NOT NULL)),
y AS (SELECT transaction_id AS original_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3), substr(h, 21, 12)) AS document_id FROM x)
SELECT document_id, original_id FROM y WHERE substr(document_id, 1, 1) <> '0'""", prelude=True)
def m07_ids(s, d):
    """Blocked checks of sales that aren't in the ledger yet, less those that an earlier check has left (ids that begin with 0)."""
    checked = D.pre_ledger_errors(V.sales(s, d), datetime(2001, 6, 30).date())
    new = S.pre_ledger(checked)
    return S.inserted(new.where("document_id like '0%'"), new).select("document_id", "original_id")


# --- pages --------------------------------------------------------------------------------
@served("k18_feed_after", f"WITH {P._VERDICTS} SELECT document_id, CAST(ran_at AS VARCHAR) AS ran_at FROM v WHERE {P._AWAKE} AND len(rule_ids) > 0 AND (ran_at < DATE '1997-06-01' OR ran_at = DATE '1997-06-01' AND document_id > 'L2') ORDER BY v.ran_at DESC, document_id LIMIT 100", prelude=True)
def k18_after(s, d):
    rows = S.page_after(S.feed(P.verdicts(s, d), V.AS_OF), 100, datetime(1997, 6, 1).date(), "L2")
    return rows.select("document_id", F.col("ran_at").cast("string").alias("ran_at"))


_LOG = f"WITH {P._VERDICTS}, log AS (SELECT company_id, document_id, CAST(ran_at AS VARCHAR) AS ran_at, CASE WHEN len(rule_ids) > 0 THEN 'blocked' WHEN seq % 5 = 0 THEN 'skipped' ELSE 'passed' END AS status FROM v WHERE type = 'ACCPAY')"


def _log(s, d, **asked):
    v = P.verdicts(s, d)
    results = v.select("company_id", "document_id", "ran_at", F.when(F.size("rule_ids") > 0, "blocked").when(F.col("seq") % 5 == 0, "skipped").otherwise("passed").alias("status"), F.when(F.col("type") == "ACCPAY", "Post_Ledger").otherwise("preview").alias("kind"))
    return S.log_page(results, 60, kind=" post_ledger", **asked)


@served("k19_log_page", _LOG + " SELECT company_id, document_id, ran_at, status FROM log WHERE status = 'passed' AND (ran_at < '1998-01-05' OR ran_at = '1998-01-05' AND document_id > 'L3') ORDER BY log.ran_at DESC, document_id LIMIT 60", prelude=True)
def k19_page(s, d):
    rows, _ = _log(s, d, status="Passed", at=datetime(1998, 1, 5).date(), ident="L3")
    return rows.select("company_id", "document_id", F.col("ran_at").cast("string").alias("ran_at"), "status")


@served("k19_log_counts", _LOG + " SELECT company_id, count(*) AS \"all\", count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'passed') AS passed, CAST(0 AS BIGINT) AS unavailable, count(*) FILTER (status = 'skipped') AS skipped FROM log GROUP BY 1", prelude=True)
def k19_counts(s, d):
    return _log(s, d, status="passed")[1]


_PANORAMA = f"""WITH {P._VERDICTS}, w AS (SELECT concat('co', seq % 6) AS company_id, seq, rule_ids, seq % 7 = 0 AS contact FROM v WHERE {P._OPEN} AND len(rule_ids) > 0),
c AS (SELECT concat('co', r_regionkey) AS company_id, r_name AS name, r_regionkey AS k FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'co5', 'africa again', 5),
n AS (SELECT company_id, count(*) AS trapped, count(*) FILTER (NOT contact) AS open_documents, count(*) FILTER (contact) AS open_contacts FROM w GROUP BY 1), r AS (SELECT company_id, rule_ids[1] AS rule, count(*) AS m, min(seq) AS o FROM w GROUP BY 1, 2),
t AS (SELECT company_id, rule AS top_rule FROM r QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY m DESC, o) = 1), a AS (SELECT concat('co', seq % 6) AS company_id, count(*) AS documents, count(*) FILTER (seq % 7 = 0) AS contacts, max(date) AS last FROM docs WHERE seq % 6 <> 3 GROUP BY 1)
SELECT row_number() OVER (ORDER BY score NULLS LAST, lower(name)) AS place, * REPLACE (coalesce(score, -1) AS score) FROM (SELECT c.company_id, name, CASE WHEN documents > 0 THEN {P._score('(documents + contacts)', 'coalesce(trapped, 0)')} END AS score, coalesce(trapped, 0) AS trapped, coalesce(open_documents, 0) AS open_documents, coalesce(open_contacts, 0) AS open_contacts,
  coalesce(documents, 0) AS documents, coalesce(contacts, 0) AS contacts, coalesce(CAST(last AS VARCHAR), '') AS last_audit, coalesce(top_rule, '') AS top_rule FROM c LEFT JOIN n USING (company_id) LEFT JOIN t USING (company_id) LEFT JOIN a USING (company_id))"""


@served("k15_panorama_split", _PANORAMA.replace("CASE WHEN documents > 0 THEN", "CASE WHEN documents + contacts > 0 THEN"), prelude=True)
def k15_split(s, d):
    """Active companies of a reader's with their verdicts on documents and contacts apart; one was never audited to the end, one has no verdicts."""
    company = F.concat(F.lit("co"), (F.col("seq") % 6).cast("string"))
    region = _t(s, d, "region").select(F.concat(F.lit("co"), "r_regionkey").alias("company_id"), F.col("r_name").alias("name"), (F.col("r_regionkey") != 2).alias("active"))
    companies = region.union(s.createDataFrame([("co5", "africa again", True), ("co9", "not allowed", True)], region.schema))
    v = P.verdicts(s, d).withColumn("company_id", company).withColumn("document_type", F.when(F.col("seq") % 7 == 0, "Contact"))
    docs = V.documents(s, d).groupBy(company.alias("company_id")).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("seq") % 7 == 0).alias("contacts"), F.max("date").alias("completed_at"))
    audits = docs.withColumn("status", F.when(F.col("company_id") == "co3", "failed").otherwise("completed"))
    audits = audits.unionByName(audits.withColumn("documents", F.lit(1)).withColumn("contacts", F.lit(0)))  # a narrower run counts for nothing
    found = E.company_panorama(companies, v, audits, companies.where("company_id <> 'co9'"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("score"), F.lower("name")))  # six rows
    return found.select(place.cast("long").alias("place"), "company_id", "name", F.coalesce("score", F.lit(-1)).alias("score"), "trapped", "open_documents", "open_contacts", "documents", "contacts", F.coalesce(F.col("last_audit").cast("string"), F.lit("")).alias("last_audit"), F.coalesce("top_rule", F.lit("")).alias("top_rule"))


# --- state and snapshots ------------------------------------------------------------------
@served("t06_keyed_state", "SELECT CAST(user_id AS VARCHAR) AS source_id, arg_max(event_type, ts) AS raw_json, CASE WHEN max(event_id % 2) = 0 THEN 'first' ELSE 'second' END AS seen FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def t06(s, d):
    """Two landings of changes through the state store: the second brings odd events, and some even ones again as late versions."""
    base = f"{shared_folder(s)}/keyed-{uuid.uuid4().hex}"
    e = _t(s, d, "events").where("user_id is not null").select(F.lit(V.COMPANY).alias("company_id"), F.lit("events").alias("entity"), F.col("user_id").cast("string").alias("source_id"), F.col("event_type").alias("raw_json"), F.col("ts").alias("updated_ts"), "event_id")
    for k in range(2):
        part = e.where(F.col("event_id") % 2 == k).drop("event_id").withColumn("pulled_ts", F.lit(datetime(2030, 1, 1 + k)))
        again = e.where("event_id % 10 = 0").drop("event_id").withColumn("pulled_ts", F.lit(datetime(2030, 1, 1))) if k else part.limit(0)
        part.union(again).write.json(f"{base}/landing/{k}", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        keyed.start(s, f"{base}/landing/*", f"{base}/checkpoint").awaitTermination()
    state = keyed.current(s, f"{base}/checkpoint")
    return state.select("source_id", "raw_json", F.when(F.col("seen") < F.lit(datetime(2030, 1, 2)), "first").otherwise("second").alias("seen"))


_SNAP = f"""WITH s AS (SELECT concat('co', d.seq % 4) AS company_id, strftime(date, '%Y-%m') AS period, CASE l.account_code WHEN '200' THEN 'income' WHEN '260' THEN 'other' WHEN '473' THEN 'cogs' ELSE 'expenses' END AS part, l.amount AS value FROM lines l JOIN docs d USING (transaction_id) WHERE l.account_code <> '710'),
t AS (SELECT company_id, period, coalesce(sum(value) FILTER (part = 'income'), 0) AS income, coalesce(sum(value) FILTER (part = 'cogs'), 0) AS cogs, coalesce(sum(value) FILTER (part = 'expenses'), 0) AS expenses, coalesce(sum(value) FILTER (part = 'other'), 0) AS other FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY period DESC) = 1),
pos AS (SELECT company_id, sum(a) AS ca, sum(l) AS cl FROM (SELECT concat('co', c_nationkey % 4) AS company_id, CAST(c_acctbal AS DECIMAL(18,2)) AS a, 0 AS l FROM customer UNION ALL SELECT concat('co', s_nationkey % 4), 0, CAST(s_acctbal AS DECIMAL(18,2)) FROM supplier) GROUP BY 1),
bank AS (SELECT concat('co', seq % 4) AS company_id, count(*) FILTER (NOT reconciled) AS n FROM v_bank GROUP BY 1), cash AS ({P.SQL['k11_cash_score']}),
n AS (SELECT company_id, period, CAST(income AS DOUBLE) AS income, CAST(income - cogs AS DOUBLE) AS gross, CAST(income - cogs - expenses + other AS DOUBLE) AS net FROM t)
SELECT company_id, 'ok' AS status, period, income, gross, net, CAST(CASE WHEN net <= 0 THEN 0 WHEN net <= 50000 THEN round(net * 0.19, 2) WHEN net >= 250000 THEN round(net * 0.25, 2) ELSE round(net * 0.25 - (250000 - net) * 0.015, 2) END AS DOUBLE) AS tax,
  CAST(ca - cl AS DOUBLE) AS working_capital, round(CAST(ca AS DOUBLE) / CAST(cl AS DOUBLE), 4) AS current_ratio, score AS cash_score, n.n AS bank_unreconciled FROM n JOIN pos USING (company_id) LEFT JOIN cash USING (company_id) JOIN bank n USING (company_id)"""
_SHOWN = ("income", "gross", "net", "tax", "working_capital", "current_ratio", "cash_score")
_TABLE = "company_id string, computed_at timestamp, status string, period string, " + ", ".join(f"{c} double" for c in _SHOWN) + ", bank_unreconciled long"


@served("k23_served_snapshots", _SNAP.replace("n.n AS bank_unreconciled", "bank.n AS bank_unreconciled").replace("JOIN bank n USING", "JOIN bank USING"), prelude=True)
def k23_served(s, d):
    """Snapshots of four companies from the other KPIs, served by a table: a failed run goes in first, then the whole one, which replaces it; at last an older one that comes late."""
    at = f"{shared_folder(s)}/snapshots-{uuid.uuid4().hex}"
    own = lambda df: df.withColumn("company_id", F.concat(F.lit("co"), (F.col("seq") % 4).cast("string")))
    profit = K.profitability(_by_company(own(V.documents(s, d))))
    money = lambda c: F.col(c).cast("decimal(18,2)")
    nation = lambda c: F.concat(F.lit("co"), (F.col(c) % 4).cast("string")).alias("company_id")
    assets = _t(s, d, "customer").groupBy(nation("c_nationkey")).agg(F.sum(money("c_acctbal")).alias("value")).withColumn("label", F.lit("Total Current Assets"))
    debts = _t(s, d, "supplier").groupBy(nation("s_nationkey")).agg(F.sum(money("s_acctbal")).alias("value")).withColumn("label", F.lit(" total current liabilities"))
    position = K.position(assets.unionByName(debts).withColumn("pos", F.lit(0))).select("company_id", "working_capital", "current_ratio")
    cash = K.cash_score(P._outgoings(s, d)).select("company_id", "score")
    snap = K.snapshot(profit, position, cash, K.bank_reconciliation(own(V.bank(s, d))))
    rows = snap.select("company_id", F.lit(datetime(2002, 1, 2)).alias("computed_at"), F.lit("ok").alias("status"), "period", *(F.col(c).cast("double").alias(c) for c in _SHOWN), "bank_unreconciled").checkpoint()  # a row a company, read by three upserts
    table = ServedTable(s, at, _TABLE, buckets=8)
    companies = rows.select("company_id")
    blank = [F.lit(None).alias(c) for c in ("period", *_SHOWN, "bank_unreconciled")]
    table.upsert(companies.select("company_id", F.lit(datetime(2002, 1, 1)).alias("computed_at"), F.lit("failed").alias("status"), *blank))
    table.upsert(rows)
    table.upsert(companies.where("company_id > 'co1'").select("company_id", F.lit(datetime(2001, 12, 31)).alias("computed_at"), F.lit("late").alias("status"), *blank))
    return table.read().select("company_id", "status", "period", *_SHOWN, "bank_unreconciled")


def _by_company(docs):
    items = F.when(F.size("line_items") > 0, F.transform("line_items", lambda x: F.struct(x["account_code"].alias("a"), x["amount"].alias("v")))).otherwise(F.array(F.struct(F.col("account_code").alias("a"), F.col("amount").alias("v"))))
    rows = docs.select("company_id", F.date_format("date", "yyyy-MM").alias("period"), F.explode(items).alias("x")).where("x.a <> '710'")
    title = F.when(F.col("x.a") == "200", "Income").when(F.col("x.a") == "260", "Plus Other Income").when(F.col("x.a") == "473", "Less Cost of Sales").otherwise("Less Operating Expenses")
    return rows.select("company_id", "period", title.alias("title"), F.col("x.v").alias("value"))
