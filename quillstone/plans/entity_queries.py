"""Verdicts on contacts and accounts, logs and summaries over the test ledger, each with its SQL for DuckDB."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import entity_verdicts as E
from . import kpi_queries as K
from . import ledger_views as V
from .rule_queries import PRELUDE, contacts

QUERIES: dict = {}
SQL: dict[str, str] = {}
_USERS = ("resolved", "dismissed", "marked_ok", "auto_cleared")


def entity(name: str, sql: str, prelude: bool = False):
    def add(f):
        QUERIES[name] = f
        SQL[name] = PRELUDE.rstrip() + ",\n" + sql[5:] if prelude else sql
        return f

    return add


#: Contacts with made-up flags: two rules, in the order of the rules, of which the second names a partner.
_FLAGS = """c AS (SELECT concat('C', c_custkey) AS contact_id, c_custkey AS k FROM customer UNION ALL SELECT concat('S', s_suppkey), s_suppkey FROM supplier),
f AS (SELECT CASE WHEN k % 31 > 0 THEN contact_id END AS contact_id, 0 AS ord, 'duplicate_contact' AS rule, concat('P', k + 1) AS partner FROM c WHERE k % 2 = 0 UNION ALL SELECT contact_id, 1, 'inactive_contact', '' FROM c WHERE k % 3 = 0)"""


def _flags(s, d):
    c = contacts(s, d).select("company_id", "contact_id", "k")
    one = c.where("k % 2 = 0").selectExpr("company_id", "CASE WHEN k % 31 > 0 THEN contact_id ELSE ' ' END AS contact_id", "0 AS emit_ord", "'duplicate_contact' AS issue_type", "'high' AS severity", "concat('P', k + 1) AS partner_id", "'two of a kind' AS message")
    two = c.where("k % 3 = 0").selectExpr("company_id", "contact_id", "1 AS emit_ord", "'inactive_contact' AS issue_type", "'medium' AS severity", "CAST(NULL AS STRING) AS partner_id", "'' AS message")
    return one.union(two)


@entity("m05_contact_verdicts", f"WITH {_FLAGS} SELECT contact_id AS document_id, string_agg(rule, ',' ORDER BY ord) AS rules, string_agg(partner, ',' ORDER BY ord) FILTER (partner <> '') IS NOT NULL AS has_partner, CASE WHEN min(ord) = 0 THEN 'two of a kind' ELSE '' END AS messages FROM f WHERE contact_id IS NOT NULL GROUP BY 1")
def m05(s, d):
    v = E.entity_verdicts(_flags(s, d), "contact_id", "CONTACT")
    return v.select("document_id", F.array_join("rule_ids", ",").alias("rules"), F.exists("flagged", lambda f: f["partner_id"].isNotNull()).alias("has_partner"), "messages")


def _old_contacts(s, d):
    on = lambda k: F.col("k") % k == 0
    return contacts(s, d).where("k % 5 < 4").select("company_id", F.col("contact_id").alias("document_id"), F.array(F.lit("contact_defaults")).alias("rule_ids"), on(7).alias("resolved"), on(11).alias("dismissed"), on(13).alias("marked_ok"), on(17).alias("auto_cleared"))


@entity("m05_contacts_merged", f"""WITH {_FLAGS}, n AS (SELECT contact_id, string_agg(rule, ',' ORDER BY ord) AS ids FROM f WHERE contact_id IS NOT NULL GROUP BY 1),
o AS (SELECT contact_id, k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 AS decided, k % 17 = 0 AS gone FROM c WHERE k % 5 < 4)
SELECT coalesce(o.contact_id, n.contact_id) AS document_id, CASE WHEN decided OR ids IS NULL THEN 'contact_defaults' ELSE ids END AS rules, CASE WHEN ids IS NOT NULL AND NOT coalesce(decided, false) THEN false ELSE gone END AS auto_cleared FROM o FULL JOIN n ON o.contact_id = n.contact_id""")
def m05m(s, d):
    return E.contacts_merged(_old_contacts(s, d), _flags(s, d)).select("document_id", F.array_join("rule_ids", ",").alias("rules"), "auto_cleared")


@entity("m06_accounts_merged", """WITH p AS (SELECT concat('A', p_partkey) AS id, p_partkey AS k FROM part)
SELECT id AS document_id, CASE WHEN k % 4 = 3 OR k % 3 = 0 AND k % 7 > 0 THEN 'missing_accrual' ELSE 'old_rule' END AS rules, k % 4 < 3 AND k % 3 > 0 AND k % 7 > 0 AS auto_cleared FROM p WHERE k % 4 < 3 OR k % 3 = 0""")
def m06(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("A"), "p_partkey").alias("id"), F.col("p_partkey").alias("k"))
    old = p.where("k % 4 < 3").select(F.lit(V.COMPANY).alias("company_id"), F.col("id").alias("document_id"), F.array(F.lit("old_rule")).alias("rule_ids"), (F.col("k") % 7 == 0).alias("resolved"), F.lit(False).alias("dismissed"), F.lit(False).alias("marked_ok"), F.lit(False).alias("auto_cleared"))
    flags = p.where("k % 3 = 0").select(F.lit(V.COMPANY).alias("company_id"), F.col("id").alias("account_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("emit_ord"), F.lit("missing_accrual").alias("issue_type"), F.lit("high").alias("severity"), F.lit(None).cast("string").alias("partner_id"), F.lit("no accrual").alias("message"))
    return E.accounts_merged(old, flags).select("document_id", F.array_join("rule_ids", ",").alias("rules"), "auto_cleared")


@entity("m14_score_history", f"WITH {K._VERDICTS}, t AS (SELECT company_id, count(*) AS audited, count(*) FILTER (NOT resolved AND NOT dismissed AND len(rule_ids) > 0) AS open FROM v GROUP BY 1) SELECT company_id, 50 AS score, 'before' AS recorded FROM t UNION ALL SELECT company_id, {K._score('audited', 'open')}, 'now' FROM t WHERE audited > 0", True)
def m14(s, d):
    v = K.verdicts(s, d)
    audits = v.groupBy("company_id").agg(F.count(F.lit(1)).alias("audited"))
    from ..operators.verdicts import bookkeeping_health

    now = bookkeeping_health(v, audits).select("company_id", "score", F.lit("now").alias("recorded"))
    before = audits.select("company_id", F.lit(50).alias("score"), F.lit("before").alias("recorded"))
    none = audits.select(F.lit("co9").alias("company_id"), F.lit(None).cast("int").alias("score"), F.lit("now").alias("recorded"))
    return E.log_appended(before, now.union(none), "score")


@entity("f11_vat_gate", f"WITH {K._VERDICTS}, x AS (SELECT company_id, document_id, CASE WHEN seq % 2 = 0 THEN 'sales_tax_missing' ELSE 'old_unpaid_bill' END AS issue_type FROM v) SELECT company_id, document_id, issue_type FROM x WHERE NOT (company_id = 'co0' AND issue_type = 'sales_tax_missing')", True)
def f11(s, d):
    flags = K.verdicts(s, d).select("company_id", "document_id", F.when(F.col("seq") % 2 == 0, "sales_tax_missing").otherwise("old_unpaid_bill").alias("issue_type"))
    return E.vat_gated(flags, s.createDataFrame([("co0", False), ("co1", True), ("co2", None)], "company_id string, vat_registered boolean"))


@entity("f13_name_search", "SELECT concat('C', c_custkey) AS contact_id FROM customer WHERE lower(c_name) LIKE '%r#00000001%' UNION ALL SELECT concat('S', s_suppkey) FROM supplier WHERE lower(s_name) LIKE '%r#00000001%'")
def f13(s, d):
    return E.named(contacts(s, d), " R#00000001 ").select("contact_id")


def _typed(s, d):
    return K.verdicts(s, d).withColumn("document_type", F.when(F.col("seq") % 5 == 0, "contact").otherwise("INVOICE")).withColumn("flagged", F.transform("rule_ids", lambda r: F.struct(r.alias("issue_type"), F.when(r.startswith("old"), "high").otherwise("medium").alias("severity"))))


_AUDITS = "a AS (SELECT company_id, count(*) AS documents, 10 AS contacts, max(ran_at) AS done FROM v GROUP BY 1)"


def _audits(s, d):
    a = K.verdicts(s, d).groupBy("company_id").agg(F.count(F.lit(1)).alias("documents"), F.max("ran_at").alias("completed_at"))
    return a.select("company_id", F.explode(F.array("documents", F.col("documents") - 7)).alias("documents"), F.lit(10).cast("long").alias("contacts"), "completed_at")


@entity("k17_health_stats", f"WITH {K._VERDICTS}, {_AUDITS}, t AS (SELECT company_id, count(*) AS total, count(*) FILTER ({K._OPEN}) AS open, count(*) FILTER ({K._OPEN} AND seq % 5 > 0) AS open_documents, count(*) FILTER ({K._OPEN} AND seq % 5 = 0) AS open_contacts, count(*) FILTER (resolved) AS resolved, count(*) FILTER (dismissed) AS dismissed FROM v GROUP BY 1) SELECT company_id, total, open, open_documents, open_contacts, resolved, dismissed, documents, CAST(contacts AS BIGINT) AS contacts, CAST(greatest(0, least(100, ((documents + contacts - open) * 100) // (documents + contacts))) AS INT) AS score FROM t JOIN a USING (company_id)", True)
def k17h(s, d):
    return E.health_stats(_typed(s, d), _audits(s, d))


@entity("k17_severity_stats", f"WITH {K._VERDICTS}, x AS (SELECT DISTINCT company_id, document_id, CASE WHEN r LIKE 'old%' THEN 'high' ELSE 'medium' END AS severity FROM (SELECT company_id, document_id, unnest(rule_ids) AS r FROM v WHERE {K._OPEN})) SELECT company_id, severity, count(*) AS verdicts FROM x GROUP BY 1, 2", True)
def k17s(s, d):
    return E.severity_stats(_typed(s, d))


@entity("k16_company_summary", f"WITH {K._VERDICTS}, {_AUDITS}, t AS (SELECT company_id, count(*) FILTER ({K._OPEN}) AS trapped, count(*) FILTER (resolved AND ran_at >= DATE '1998-07-01' - 90) AS resolved, count(*) FILTER (dismissed AND ran_at >= DATE '1998-07-01' - 90) AS dismissed FROM v GROUP BY 1) SELECT company_id, documents, CAST(contacts AS BIGINT) AS contacts, CAST(done AS VARCHAR) AS last_audit, trapped, resolved, dismissed, {K._score('(documents + contacts)', 'trapped')} AS score FROM t JOIN a USING (company_id)", True)
def k16s(s, d):
    return E.company_summary(_typed(s, d), _audits(s, d), date(1998, 7, 1), 90).withColumn("last_audit", F.col("last_audit").cast("string"))


@entity("xd9_month_labels", "SELECT DISTINCT strftime(o_orderdate, '%b %Y') AS long_label, strftime(o_orderdate, '%b-%y') AS short_label FROM orders")
def xd9(s, d):
    long_label, short_label = E.month_labels("o_orderdate")
    return s.read.parquet(f"{d}/orders.parquet").select(long_label.alias("long_label"), short_label.alias("short_label")).distinct()


@entity("k21_notification_feed", """WITH n AS (SELECT concat('C', c_custkey) AS company_id, c_custkey % 101 AS score, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 7 % 101 END AS was, DATE '1996-01-01' + CAST(c_custkey % 800 AS INT) AS "at" FROM customer),
f AS (SELECT 'alert' AS kind, CASE WHEN score < was THEN 'score_drop' ELSE 'low_score' END AS type, CASE WHEN score < 40 THEN 'critical' WHEN score < 70 THEN 'watch' ELSE 'info' END AS severity, company_id, '' AS id, "at" FROM n WHERE score < 70 OR coalesce(score < was, false)
UNION ALL SELECT 'event', 'org_connected', 'info', concat('C', o_custkey), CAST(o_orderkey AS VARCHAR), CAST(o_orderdate AS DATE) FROM orders)
SELECT kind, type, severity, company_id, id, CAST("at" AS VARCHAR) AS "at" FROM f ORDER BY f."at" DESC, kind, company_id, id LIMIT 200""")
def k21_feed(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").selectExpr("concat('C', c_custkey) AS company_id", "c_name AS name", "c_custkey AS k", "c_custkey % 101 AS score", "date_add(DATE'1996-01-01', CAST(c_custkey % 800 AS INT)) AS at")
    late = c.selectExpr("company_id", "DATE'1995-12-31' AS recorded_at", "CASE WHEN k % 3 > 0 THEN k * 7 % 101 END AS score")
    early = c.selectExpr("company_id", "DATE'1995-06-30' AS recorded_at", "100 AS score")
    e = s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS id", "'org_connected' AS type", "'info' AS severity", "'connected' AS title", "concat('C', o_custkey) AS company_id", "CAST(o_orderdate AS DATE) AS at")
    feed = E.notification_feed(c, late.union(early), e, 200)
    return feed.select("kind", "type", "severity", "company_id", F.coalesce("id", F.lit("")).alias("id"), F.col("at").cast("string").alias("at"))
