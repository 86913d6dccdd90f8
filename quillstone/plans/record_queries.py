"""Single verdicts, annotations, fix suggestions and a run's context over the test ledger, each with its SQL for DuckDB."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import records as R
from . import kpi_queries as K
from . import ledger_views as V
from .rule_queries import PRELUDE

QUERIES: dict = {}
SQL: dict[str, str] = {}
_DAY = date(1996, 6, 30)


def record(name: str, sql: str, prelude: bool = True):
    def add(f):
        QUERIES[name] = f
        SQL[name] = PRELUDE.rstrip() + ",\n" + sql[5:] if prelude else sql
        return f

    return add


_KIND = "CASE WHEN seq % 11 = 0 THEN 'pre_ledger' ELSE 'post_ledger' END AS kind, CASE WHEN len(rule_ids) > 0 THEN 'blocked' ELSE 'passed' END AS status"


def _verdicts(s, d):
    return K.verdicts(s, d).withColumns({"kind": F.when(F.col("seq") % 11 == 0, "pre_ledger").otherwise("post_ledger"), "status": F.when(F.size("rule_ids") > 0, "blocked").otherwise("passed"), "verdict_id": F.concat(F.lit("v"), "seq")})


@record("h16_trapped", f"WITH {K._VERDICTS}, k AS (SELECT *, {_KIND} FROM v) SELECT company_id, document_id FROM k WHERE kind = 'post_ledger' AND status = 'blocked' AND NOT marked_ok AND NOT auto_cleared AND NOT dismissed AND (snoozed_until IS NULL OR snoozed_until <= DATE '1996-06-30')")
def h16(s, d):
    return R.trapped(_verdicts(s, d), _DAY, include_resolved=True).select("company_id", "document_id")


@record("h16_found", f"WITH {K._VERDICTS} SELECT company_id, document_id FROM v WHERE seq % 3 = 0 AND seq % 4 < 2")
def h16_found(s, d):
    v = _verdicts(s, d)
    asked = v.where("seq % 3 = 0").select(F.when(F.col("seq") % 4 < 2, F.col("company_id")).otherwise("another").alias("company_id"), "verdict_id")
    return R.found(v, asked).select("company_id", "document_id")


@record("h16_blocked", f"WITH {K._VERDICTS}, k AS (SELECT *, {_KIND} FROM v) SELECT company_id, document_id, kind = 'post_ledger' AND status = 'blocked' AS blocked FROM k UNION ALL SELECT 'co7', document_id, false FROM k WHERE seq % 2 = 0")
def h16_blocked(s, d):
    v = _verdicts(s, d)
    asked = v.select("company_id", "document_id").union(v.where("seq % 2 = 0").select(F.lit("co7"), "document_id"))
    return R.blocked(asked, v)


@record("h17_recorded", f"""WITH {K._VERDICTS} SELECT document_id, 'old' AS document_type, '' AS recorded_by, '' AS ledger, '' AS error_msgs FROM v WHERE seq % 4 = 0
UNION ALL SELECT document_id, type, CASE WHEN seq % 3 = 0 THEN 'himself' WHEN seq % 5 > 0 THEN 'user' ELSE '' END, CASE WHEN seq % 7 > 0 THEN 'main' ELSE '' END, CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 2 = 0 THEN 'broken' ELSE '' END FROM v""")
def h17(s, d):
    v = K.verdicts(s, d)
    said = F.when(F.col("seq") % 3 == 0, F.create_map(F.lit("recorded_by_user_id"), F.lit("himself"), F.lit("error_msgs"), F.lit(""))).when(F.col("seq") % 2 == 0, F.create_map(F.lit("error_msgs"), F.lit("broken")))
    new = v.select("company_id", "document_id", F.col("type").alias("document_type"), F.lit("post_ledger").alias("kind"), F.lit("blocked").alias("status"), said.alias("result"), F.when(F.col("seq") % 5 > 0, "user").alias("user_id"), F.when(F.col("seq") % 7 > 0, "main").alias("target_ledger"))
    old = v.where("seq % 4 = 0").select("company_id", "document_id", F.lit("old").alias("document_type"))
    log = R.recorded(old.withColumn("result", F.lit(None).cast("map<string,string>")).withColumns({c: F.lit(None).cast("string") for c in ("kind", "status", "error_msgs")}), new)
    got = lambda k: F.coalesce(F.try_element_at("result", F.lit(k)), F.lit(""))
    return log.select("document_id", "document_type", got("recorded_by_user_id").alias("recorded_by"), got("target_ledger").alias("ledger"), F.coalesce("error_msgs", F.lit("")).alias("error_msgs"))


@record("h28_context", "WITH c AS (SELECT p_brand AS code, p_retailprice AS price, p_partkey % 3 = 0 AS active, p_partkey AS k FROM part WHERE p_partkey % 10 > 0) SELECT code, arg_min(k, (NOT active, k)) AS k, bool_or(active) AS active FROM c GROUP BY 1", False)
def h28(s, d):
    p = s.read.parquet(f"{d}/part.parquet").selectExpr("'co1' AS company_id", "CASE WHEN p_partkey % 10 > 0 THEN concat(' ', p_brand) ELSE ' ' END AS code", "p_partkey % 3 = 0 AS active", "p_partkey AS k")
    people = s.createDataFrame([("co1", "C1"), ("co1", " ")], "company_id string, contact_id string")
    return R.context(p, V.tax_rates(s).withColumn("active", F.lit(True)), people).accounts.select("code", "k", "active")


@record("h37_fix_requests", f"WITH {K._VERDICTS} SELECT document_id, coalesce(rule_ids[1], CASE WHEN seq % 2 = 0 THEN type ELSE 'unknown' END) AS primary_rule, coalesce(contact_id, '') AS vendor_name, CASE WHEN seq % 5 = 0 THEN 'EUR' ELSE 'GBP' END AS currency_code, CASE WHEN len(rule_ids) > 0 THEN '429' ELSE '' END AS current_code FROM v")
def h37(s, d):
    none = F.lit(None).cast("string")
    flagged = F.transform("rule_ids", lambda r: F.struct(r.alias("issue_type"), F.lit("429").alias("current_code"), none.alias("suggested_code")))
    v = K.verdicts(s, d).withColumns({"flagged": F.when(F.col("seq") % 3 > 0, flagged).otherwise(F.transform(flagged, lambda f: f.withField("issue_type", F.lit(" ")))), "document_type": F.when(F.col("seq") % 2 == 0, F.col("type")), "vendor_name": F.col("contact_id"), "invoice_number": none, "reference": none, "currency_code": F.when(F.col("seq") % 5 == 0, "EUR").when(F.col("seq") % 5 == 1, "")})
    return R.fix_requests(v).select("document_id", "primary_rule", "vendor_name", "currency_code", "current_code")


@record("h37_suggestions", """WITH x AS (SELECT transaction_id AS document_id, seq FROM docs)
SELECT document_id, CASE WHEN seq % 4 = 0 THEN 'recode' ELSE 'manual_review' END AS strategy, CASE WHEN seq % 4 = 0 THEN 7 ELSE 0 END AS minutes, CASE WHEN seq % 4 = 0 THEN 2 ELSE 0 END AS n_steps, CASE WHEN seq % 4 = 0 THEN '429' ELSE '' END AS code_update,
CASE WHEN seq % 2 = 1 THEN '' WHEN seq % 3 = 0 THEN '200' WHEN seq % 3 = 1 THEN '461' WHEN seq % 4 = 0 THEN '473' ELSE '' END AS account FROM x""")
def h37s(s, d):
    full = '{"fix_strategy": "recode", "human_steps": ["open it", "move to 473"], "estimated_minutes": 7.5, "field_updates": {"AccountCode": 429}}'
    raw = F.when(F.col("seq") % 4 == 0, full).when(F.col("seq") % 4 == 1, '{"human_steps": "no list", "estimated_minutes": "soon", "field_updates": [1]}').when(F.col("seq") % 4 == 2, "not json")
    rows = V.documents(s, d).select("company_id", F.col("transaction_id").alias("document_id"), F.when(F.col("seq") % 2 == 0, "wrong_category").otherwise("missing_tax").alias("primary_rule"), F.when(F.col("seq") % 3 == 0, "200").otherwise("").alias("suggested_code"), F.when(F.col("seq") % 3 == 1, "Oak Furniture").otherwise("Other").alias("vendor_name"), raw.alias("raw"))
    return R.suggestions(rows, {"furniture": "461"}).select("document_id", "strategy", "minutes", F.size("steps").alias("n_steps"), F.coalesce(F.try_element_at("updates", F.lit("AccountCode")), F.lit("")).alias("code_update"), F.coalesce("account", F.lit("")).alias("account"))


@record("h44_annotations", "WITH x AS (SELECT transaction_id, seq FROM docs) SELECT transaction_id, seq % 5 = 0 OR seq % 5 = 4 AS readable, CASE WHEN seq % 5 = 0 THEN 'fine' ELSE '' END AS summary FROM x")
def h44(s, d):
    k = F.col("seq") % 5
    raw = F.when(k == 0, '{"summary": "fine", "confidence": 0.5, "more": [1]}').when(k == 1, '{"summary": "fine", "confidence": "high"}').when(k == 2, "[1, 2]").when(k == 3, '{"summary": ').otherwise("{}")
    a = R.annotation("raw")
    return V.documents(s, d).select("transaction_id", raw.alias("raw")).select("transaction_id", a.isNotNull().alias("readable"), F.coalesce(a["summary"], F.lit("")).alias("summary"))


def _attempts(s, d):
    """Every event as an attempt to write to its user: some have no user, and some fail."""
    e = s.read.parquet(f"{d}/events.parquet")
    user = F.when(F.col("event_id") % 11 > 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return e.select(user.alias("user_id"), F.concat(F.lit(" User"), F.col("user_id").cast("string"), F.lit("@Mail.EXAMPLE ")).alias("recipient_email"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 3 > 0).alias("ok"), F.lit("email").alias("channel"), F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("detail"), F.col("event_id").cast("string").alias("provider_message_id"), F.col("ts").cast("timestamp").alias("at"))


@record("h40_activity_log", "SELECT concat('f', user_id % 5) AS firm_id, event_type AS type, CASE WHEN event_id % 4 = 0 THEN 'warning' ELSE 'info' END AS severity, concat('event ', event_id) AS title, coalesce(concat('co', user_id), '') AS company_id FROM events WHERE event_id % 9 > 0 UNION ALL SELECT 'f0', 'started', 'info', r_name, '' FROM region", prelude=False)
def h40(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    log = s.read.parquet(f"{d}/region.parquet").select(F.lit("f0").alias("firm_id"), F.lit("started").alias("type"), F.lit("info").alias("severity"), F.col("r_name").alias("title"))
    events = e.select(F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")).alias("firm_id"), F.when(F.col("event_id") % 9 > 0, F.col("event_type")).otherwise(" ").alias("type"), F.when(F.col("event_id") % 4 == 0, "warning").alias("severity"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"), F.concat(F.lit("co"), F.col("user_id").cast("string")).alias("company_id"))
    return R.events_recorded(log, events).select("firm_id", "type", "severity", "title", F.coalesce("company_id", F.lit("")).alias("company_id"))


@record("h41_send_log", "SELECT coalesce(CASE WHEN event_id % 11 > 0 THEN concat('u', user_id) END, '') AS user_id, coalesce(concat('user', user_id, '@mail.example'), '') AS recipient_email, event_type AS kind, CASE WHEN event_id % 5 > 0 AND event_id % 3 > 0 THEN 'sent' ELSE 'failed' END AS status, CASE WHEN event_id % 5 > 0 AND event_id % 3 > 0 THEN '' ELSE concat('d', event_id) END AS error FROM events", prelude=False)
def h41(s, d):
    a = _attempts(s, d)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return R.sends_recorded(R.sends_recorded(a.limit(0).select("user_id"), a.where("provider_message_id % 2 = 0")), a.where("provider_message_id % 2 = 1")).select(text("user_id"), text("recipient_email"), "kind", "status", text("error"))


@record("h41_user_status", """WITH a AS (SELECT concat('u', user_id) AS user_id, ts, CASE WHEN event_id % 5 > 0 AND event_id % 3 > 0 THEN 'sent' ELSE 'failed' END AS s FROM events WHERE event_id % 11 > 0 AND user_id IS NOT NULL),
l AS (SELECT user_id, arg_max(s, (ts, s = 'failed')) AS s FROM a GROUP BY 1) SELECT concat('u', c_custkey) AS user_id, coalesce(s, 'unknown') AS email_status FROM customer LEFT JOIN l ON l.user_id = concat('u', c_custkey)""", prelude=False)
def h41_users(s, d):
    users = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"), F.lit("unknown").alias("email_status"))
    return R.users_marked(users, _attempts(s, d))
