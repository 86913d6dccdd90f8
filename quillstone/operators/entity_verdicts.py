"""Verdicts on contacts and accounts, logs that only grow, and the summaries that are read from verdicts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .verdicts import KEY, cleared, is_open, merged, score

#: Rules that only apply to companies that are registered for VAT.
VAT_RULES = ("purchase_tax_missing", "sales_tax_missing")


def entity_verdicts(flags: DataFrame, id_col: str, kind: str) -> DataFrame:
    """One verdict for each contact or account: (company_id, document_id, document_type, flagged, rule_ids, messages).

    flags: company_id, id_col, issue_type, severity, partner_id, message, and emit_ord, the order in which rules gave them. Flags of a blank id
    are left out; all flags of an id stay, in order, with the partners that they name; each rule's id is listed once."""
    named = flags.where(F.trim(F.coalesce(F.col(id_col), F.lit(""))) != "")
    item = F.struct("emit_ord", "issue_type", "severity", "partner_id", "message")
    rows = named.groupBy("company_id", F.trim(id_col).alias("document_id")).agg(F.sort_array(F.collect_list(item)).alias("flagged"))
    ids = F.array_distinct(F.transform("flagged", lambda f: f["issue_type"]))
    messages = F.array_join(F.filter(F.transform("flagged", lambda f: f["message"]), lambda m: F.coalesce(m, F.lit("")) != ""), " | ")
    return rows.select(*KEY, F.lit(kind).alias("document_type"), "flagged", ids.alias("rule_ids"), messages.alias("messages"))


def contacts_merged(old: DataFrame, flags: DataFrame) -> DataFrame:
    """Contact verdicts after a run: flagged contacts take this run's rules, unless a user decided on them; the others stay."""
    return merged(old, entity_verdicts(flags, "contact_id", "CONTACT"))


def accounts_merged(old: DataFrame, flags: DataFrame) -> DataFrame:
    """Account verdicts after a run: as for contacts, and accounts that are flagged no more are cleared, unless a user decided on them."""
    new = entity_verdicts(flags, "account_id", "ACCOUNT")
    return cleared(merged(old, new), old, new)


def vat_gated(flags: DataFrame, companies: DataFrame) -> DataFrame:
    """Flags less those of VAT_RULES for companies known not to be registered. companies: company_id, vat_registered (null: unknown, so they stay)."""
    out = companies.where(~F.col("vat_registered")).select("company_id").distinct().withColumn("unregistered", F.lit(True))
    rows = flags.join(out, "company_id", "left")
    return rows.where(~(F.coalesce("unregistered", F.lit(False)) & F.col("issue_type").isin(*VAT_RULES))).drop("unregistered")


def named(rows: DataFrame, search: str | None, column: str = "name") -> DataFrame:
    """Rows whose name contains the search text in any case; all of them without one."""
    text = (search or "").strip().lower()
    return rows.where(F.contains(F.lower(column), F.lit(text))) if text else rows


def log_appended(log: DataFrame, rows: DataFrame, required: str) -> DataFrame:
    """A log (scores, activity, sent mail) with the new rows behind it; rows that lack what is required aren't recorded. Columns that the rows lack are null."""
    return log.unionByName(rows.where(F.col(required).isNotNull()), allowMissingColumns=True)


def health_stats(verdicts: DataFrame, audits: DataFrame) -> DataFrame:
    """One row a company: totals, open verdicts split into documents and contacts, decided ones, and the blended score of the widest audit.

    verdicts: KEY, document_type, rule_ids and the users' decisions; audits: company_id, documents, contacts."""
    o, contact = is_open(), F.upper(F.coalesce("document_type", F.lit(""))) == "CONTACT"
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    counts = verdicts.groupBy("company_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(o).alias("open"), F.count_if(o & ~contact).alias("open_documents"), F.count_if(o & contact).alias("open_contacts"), F.count_if(on("resolved")).alias("resolved"), F.count_if(on("dismissed")).alias("dismissed"))
    widest = audits.groupBy("company_id").agg(F.coalesce(F.max("documents"), F.lit(0)).alias("documents"), F.coalesce(F.max("contacts"), F.lit(0)).alias("contacts"))
    rows = counts.join(widest, "company_id", "left").fillna(0, ["documents", "contacts"])
    return rows.withColumn("score", score(F.col("documents") + F.col("contacts"), F.col("open"), truncate=True))


def company_panorama(companies: DataFrame, verdicts: DataFrame, audits: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """One row for each active company, the worst score first, those never audited last, ties by name: name, score, open verdicts in total and of documents and contacts, what was audited, the last audit, the commonest first rule.

    companies: company_id, name, active; verdicts: KEY, document_type, rule_ids, seq and the users' decisions; audits: company_id, documents, contacts, completed_at, status, of which completed ones count, the widest for
    the score; allowed: the company_ids that a reader may see (all without it). Of rules that are equally common the one seen first counts."""
    shown = companies.where("active").select("company_id", "name")
    if allowed is not None:
        shown = shown.join(allowed.select("company_id").distinct(), "company_id", "left_semi")
    o = verdicts.where(is_open() & (F.size("rule_ids") > 0))
    contact = F.upper(F.coalesce("document_type", F.lit(""))) == "CONTACT"
    counts = o.groupBy("company_id").agg(F.count(F.lit(1)).alias("trapped"), F.count_if(~contact).alias("open_documents"), F.count_if(contact).alias("open_contacts"))
    top = o.groupBy("company_id", F.get("rule_ids", F.lit(0)).alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("o")).groupBy("company_id").agg(F.max_by("rule", F.struct("n", -F.col("o"))).alias("top_rule"))
    widest = audits.where("status = 'completed'").groupBy("company_id").agg(F.max("documents").alias("documents"), F.max("contacts").alias("contacts"), F.max("completed_at").alias("last_audit"))
    rows = shown.join(widest, "company_id", "left").join(counts, "company_id", "left").join(top, "company_id", "left").fillna(0, ["documents", "contacts", "trapped", "open_documents", "open_contacts"])
    rows = rows.withColumn("score", score(F.col("documents") + F.col("contacts"), F.col("trapped")))
    return rows.select("company_id", "name", "score", "trapped", "open_documents", "open_contacts", "documents", "contacts", "last_audit", "top_rule").orderBy(F.asc_nulls_last("score"), F.lower("name"))


def severity_stats(verdicts: DataFrame) -> DataFrame:
    """Open verdicts by severity: each counts once for every severity among its flags. verdicts: KEY, flagged (array of structs with severity)."""
    each = verdicts.where(is_open()).select("company_id", F.explode(F.array_distinct(F.transform("flagged", lambda f: F.coalesce(f["severity"], F.lit("medium"))))).alias("severity"))
    return each.groupBy("company_id", "severity").agg(F.count(F.lit(1)).alias("verdicts"))


def company_summary(verdicts: DataFrame, audits: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """One row a company: trapped verdicts, those resolved and dismissed within the days before as_of, the blended score, the last audit.

    verdicts: KEY, ran_at and the users' decisions; audits: company_id, documents, contacts, completed_at. days are held between 1 and 365."""
    recent = F.col("ran_at") >= F.date_sub(F.lit(as_of), max(1, min(365, days)))
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    counts = verdicts.groupBy("company_id").agg(F.count_if(is_open()).alias("trapped"), F.count_if(on("resolved") & recent).alias("resolved"), F.count_if(on("dismissed") & recent).alias("dismissed"))
    widest = audits.groupBy("company_id").agg(F.max("documents").alias("documents"), F.max("contacts").alias("contacts"), F.max("completed_at").alias("last_audit"))
    rows = widest.join(counts, "company_id", "left").fillna(0, ["documents", "contacts", "trapped", "resolved", "dismissed"])
    return rows.withColumn("score", score(F.col("documents") + F.col("contacts"), F.col("trapped")))


def month_labels(day: Column | str) -> tuple[Column, Column]:
    """A date's month as `Jan 2024` and as `Jan-24`."""
    return F.date_format(day, "MMM yyyy"), F.date_format(day, "MMM-yy")


def notification_feed(now: DataFrame, history: DataFrame, events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest alerts and events: (kind, type, severity, title, company_id, id, at), newest first, those without a time last.

    now: company_id, name, score, at. A score below its last record (history: company_id, recorded_at, score) is a drop; one below 70 is low;
    a good score that didn't fall gives no alert, nor does an unknown one. events: id, type, severity, title, company_id, at. The limit is the page that readers ask for."""
    last = history.groupBy("company_id").agg(F.max_by("score", "recorded_at").alias("was"))
    rows = now.where(F.col("score").isNotNull()).join(last, "company_id", "left")
    fell = F.coalesce(F.col("score") < F.col("was"), F.lit(False))
    level = F.when(F.col("score") < 40, "critical").when(F.col("score") < 70, "watch").otherwise("info")
    title = F.when(fell, F.concat_ws(" ", "name", F.lit("fell from"), "was", F.lit("to"), "score")).otherwise(F.concat_ws(" ", "name", F.lit("is at"), "score"))
    alerts = rows.where(fell | (level != "info")).select(F.lit("alert").alias("kind"), F.when(fell, "score_drop").otherwise("low_score").alias("type"), level.alias("severity"), title.alias("title"), "company_id", F.lit(None).cast("string").alias("id"), "at")
    told = events.select(F.lit("event").alias("kind"), "type", "severity", "title", "company_id", F.col("id").cast("string").alias("id"), "at")
    return alerts.union(told).orderBy(F.desc_nulls_last("at"), "kind", "company_id", "id").limit(limit)
