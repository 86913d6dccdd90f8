"""Verdicts: one row for each document with its flags, and how runs and users change them. Tables are frames; nothing is updated in place."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import name_id
from .catalog import label

# Fixed value: the namespace of ids of documents that aren't in the ledger yet.
PRE_LEDGER = "9b6f7e2a-1c3d-4e5f-8a9b-0c1d2e3f4a5b"
KEY = ["company_id", "document_id"]
USER = ("resolved", "dismissed", "marked_ok")
DUPLICATES = ("duplicate_invoice", "duplicate_bill", "duplicate_credit_note")


def grouped(flags: DataFrame) -> DataFrame:
    """One verdict a document: active and superseded flags in the order of rules, its rule ids, its first rule."""
    item = F.struct("rule_ord", "issue_type", "severity", F.coalesce("line_no", F.lit(0)).alias("line_no"))
    hidden = F.col("superseded_by").isNotNull()
    rows = flags.groupBy("company_id", F.col("transaction_id").alias("document_id")).agg(F.sort_array(F.collect_list(F.when(~hidden, item))).alias("flagged"), F.count_if(hidden).alias("n_superseded"))
    ids = F.array_distinct(F.transform("flagged", lambda f: f["issue_type"]))
    return rows.select(*KEY, F.when(F.size("flagged") > 0, "blocked").otherwise("passed").alias("status"), "flagged", ids.alias("rule_ids"), F.get(ids, F.lit(0)).alias("primary_rule"), "n_superseded")


def touched(prefix: str = "") -> Column:
    """Whether a user has decided on a verdict."""
    out = F.lit(False)
    for c in USER:
        out = out | F.coalesce(F.col(prefix + c), F.lit(False))
    return out


def merged(old: DataFrame, new: DataFrame, evaluated_types: tuple | None = None) -> DataFrame:
    """Verdicts after a run. Rows that a user decided stay as they are; others take the new rule ids, or, of a run of some
    rules only, keep their other ids and take the new ones behind them. old: KEY, rule_ids, resolved, dismissed, marked_ok, auto_cleared; new: KEY, rule_ids."""
    n = new.select(*KEY, F.col("rule_ids").alias("n_ids"))
    rows = old.join(n, KEY, "full")
    kept = F.coalesce("rule_ids", F.array().cast("array<string>"))
    if evaluated_types is not None:
        kept = F.filter(kept, lambda r: ~r.isin(*evaluated_types))
    ids = F.when(touched() | F.col("n_ids").isNull(), F.col("rule_ids")).when(F.lit(evaluated_types is None), F.col("n_ids")).otherwise(F.array_distinct(F.concat(kept, F.col("n_ids"))))
    flagged_again = F.col("n_ids").isNotNull() & ~touched()
    cleared = F.when(flagged_again, F.lit(False)).otherwise(F.coalesce("auto_cleared", F.lit(False)))
    return rows.select(*KEY, ids.alias("rule_ids"), *(F.coalesce(c, F.lit(False)).alias(c) for c in USER), cleared.alias("auto_cleared"))


def cleared(old: DataFrame, evaluated: DataFrame, flagged: DataFrame) -> DataFrame:
    """Verdicts with auto_cleared set where a run looked at the document and flagged it no more; decided ones stay. evaluated, flagged: KEY."""
    gone = evaluated.select(*KEY).distinct().join(flagged.select(*KEY).distinct(), KEY, "left_anti").withColumn("g", F.lit(True))
    rows = old.join(gone, KEY, "left")
    return rows.withColumn("auto_cleared", F.when(F.coalesce("g", F.lit(False)) & ~touched(), F.lit(True)).otherwise(F.coalesce("auto_cleared", F.lit(False)))).drop("g")


def without_types(old: DataFrame, types: tuple = DUPLICATES) -> DataFrame:
    """Strips some rules from untouched verdicts; those left without any are cleared."""
    left = F.filter("rule_ids", lambda r: ~r.isin(*types))
    return old.withColumn("auto_cleared", F.coalesce("auto_cleared", F.lit(False)) | (~touched() & (F.size(left) == 0))).withColumn("rule_ids", F.when(touched(), F.col("rule_ids")).otherwise(left))


def inserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows whose key isn't there yet."""
    return new.join(old.select(*KEY), KEY, "left_anti")  # no distinct(): repeats on that side change nothing, and a table of them in memory would


def states(actions: DataFrame) -> DataFrame:
    """Folds user actions into states: KEY, at, action (resolve, dismiss, mark_ok, snooze, restore), until. The latest action of each kind since the last restore counts."""
    wiped = F.max(F.when(F.col("action") == "restore", F.col("at")))
    last = lambda a: F.max(F.when(F.col("action") == a, F.col("at")))
    s = actions.groupBy(*KEY).agg(wiped.alias("w"), *(last(a).alias(a) for a in ("resolve", "dismiss", "mark_ok", "snooze")), F.max_by(F.col("until"), F.when(F.col("action") == "snooze", F.col("at"))).alias("until"))
    on = lambda a: F.coalesce(F.col(a) > F.col("w"), F.col(a).isNotNull())
    return s.select(*KEY, on("resolve").alias("resolved"), on("dismiss").alias("dismissed"), on("mark_ok").alias("marked_ok"), F.when(on("snooze"), F.col("until")).alias("snoozed_until"))


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The latest row of each key: an upsert's result over the union of old and new rows."""
    cols = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*cols), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"r.{c}").alias(c) for c in cols))


def pruned(state: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """State less the rows that a full refresh didn't bring."""
    return state.join(incoming.select(*keys), keys, "left_semi")


def organisations(known: DataFrame, live: DataFrame) -> DataFrame:
    """(tenant_id, change): add, deactivate or reactivate; nothing at all if no live tenant is listed. known: tenant_id, active."""
    l_ = live.select("tenant_id").distinct().withColumn("live", F.lit(True))
    rows = known.join(l_, "tenant_id", "full").withColumn("change", F.when(F.col("active").isNull(), "add").when(F.col("active") & F.col("live").isNull(), "deactivate").when(~F.col("active") & F.col("live"), "reactivate"))
    any_live = l_.limit(1).select(F.lit(1).alias("any"))
    return rows.where("change is not null").join(any_live, F.lit(True), "left_semi").select("tenant_id", "change")


def accessible(companies: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, company_id) that a user may see: owners all of their firm's companies, others those granted that are their firm's."""
    owners, others = users.where("is_owner").select("firm_id", "user_id"), users.where(~F.col("is_owner")).select("firm_id", "user_id")
    tasks = 4 * int(companies.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a firm's product is made in many tasks, whatever the files and the number of firms
    own = companies.select("firm_id", "company_id").repartition(tasks, "company_id")
    all_ = owners.join(own, "firm_id").select("user_id", "company_id")
    # a grant meets its company by id, and the firm is compared behind: grants that come dealt by company are so neither dealt again to be counted once, nor to be joined. No firm's product is made for those who
    # see a part; a grant counts once, copies of users and companies as often as they are listed
    mine = own.withColumnRenamed("firm_id", "own_firm")
    granted = grants.select("user_id", "company_id").distinct().join(mine, "company_id").join(others.withColumnRenamed("firm_id", "user_firm"), "user_id").where("own_firm = user_firm").select("user_id", "company_id")
    return all_.union(granted)


# --- what is read from verdicts -------------------------------------------------


def is_open(as_of: date | None = None) -> Column:
    """Not decided, not cleared; with a date, not snoozed beyond it either."""
    o = ~touched() & ~F.coalesce("auto_cleared", F.lit(False))
    return o if as_of is None else o & (F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= F.lit(as_of)))


def score(audited: Column, trapped: Column, truncate: bool = False) -> Column:
    """Share of clean documents, 0 to 100, rounded half even or cut; null if nothing was audited."""
    x = (audited - trapped).cast("decimal(18,0)") * 100 / F.nullif(audited, F.lit(0)).cast("decimal(18,0)")
    return F.when(audited > 0, F.greatest(F.lit(0), F.least(F.lit(100), (F.floor(x) if truncate else F.bround(x, 0)).cast("int"))))


def bookkeeping_health(verdicts: DataFrame, audits: DataFrame) -> DataFrame:
    """The score from the widest audit and the verdicts neither resolved nor dismissed. audits: company_id, audited."""
    open_ = ~F.coalesce("resolved", F.lit(False)) & ~F.coalesce("dismissed", F.lit(False)) & (F.size("rule_ids") > 0)
    n = verdicts.groupBy("company_id").agg(F.count_if(open_).alias("open"))
    a = audits.groupBy("company_id").agg(F.max("audited").alias("audited"))
    return a.join(n, "company_id", "left").select("company_id", "audited", F.coalesce("open", F.lit(0)).alias("open"), score(F.col("audited"), F.coalesce("open", F.lit(0))).alias("score"))


def panorama(verdicts: DataFrame) -> DataFrame:
    """Per company: documents, open ones, the score, the commonest first rule (of equals the one seen first)."""
    o = is_open() & (F.size("rule_ids") > 0)
    rows = verdicts.groupBy("company_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(o).alias("open"))
    top = verdicts.where(o).groupBy("company_id", F.get("rule_ids", F.lit(0)).alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("o")).groupBy("company_id").agg(F.max_by("rule", F.struct("n", -F.col("o"))).alias("top_rule"))
    return rows.join(top, "company_id", "left").select("company_id", "documents", "open", score(F.col("documents"), F.col("open")).alias("score"), "top_rule")


def top_issues(verdicts: DataFrame, n: int = 3) -> DataFrame:
    """Per company the n commonest first rules with a sample document."""
    c = verdicts.where(is_open() & (F.size("rule_ids") > 0)).groupBy("company_id", F.get("rule_ids", F.lit(0)).alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("o"), F.min_by("document_id", F.struct("seq", "document_id")).alias("sample"))
    w = Window.partitionBy("company_id").orderBy(F.desc("n"), "o")  # a row for each rule of a company
    return c.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("company_id", "place", "rule", "n", "sample")


def issue_stats(verdicts: DataFrame, as_of: date) -> DataFrame:
    """Open documents by rule: each counts once for every rule that it breaks."""
    return verdicts.where(is_open(as_of)).select("company_id", F.explode(F.array_distinct("rule_ids")).alias("rule")).groupBy("company_id", "rule").agg(F.count(F.lit(1)).alias("documents"))


def feed(verdicts: DataFrame, as_of: date, rule: str | None = None, search: str | None = None, skip_bank: bool = False) -> DataFrame:
    """Open verdicts, perhaps of one rule, with part of an id, without bank lines."""
    rows = verdicts.where(is_open(as_of) & (F.size("rule_ids") > 0))
    if rule:
        rows = rows.where(F.array_contains("rule_ids", rule))
    if search:
        rows = rows.where(F.lower("document_id").contains(search.lower()))
    if skip_bank:
        rows = rows.where(~F.upper(F.coalesce("type", F.lit(""))).isin("SPEND", "RECEIVE"))
    return rows


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of a feed, newest run first."""
    return rows.orderBy(F.desc("ran_at"), "document_id").offset(offset).limit(limit)


def page_after(rows: DataFrame, limit: int, at: datetime | None = None, ident: str | None = None, id_col: str = "document_id") -> DataFrame:
    """The page of a feed behind the row (at, ident), newest run first, ids in order within a run; the first page without them.

    A key instead of an offset: the condition reaches the scan, and Spark keeps only limit rows a task, however deep the page. Rows never run come last; behind one of them at is None and ident its id."""
    ident_after = F.col(id_col) > F.lit(ident)
    if ident is None:
        behind = F.lit(True)
    elif at is None:
        behind = F.col("ran_at").isNull() & ident_after
    else:
        behind = (F.col("ran_at") <= F.lit(at)) & ((F.col("ran_at") < F.lit(at)) | ident_after) | F.col("ran_at").isNull()
    return rows.where(behind).orderBy(F.desc_nulls_last("ran_at"), id_col).limit(limit)


def log_page(results: DataFrame, limit: int, status: str | None = None, kind: str | None = None, at: datetime | None = None, ident: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of all recorded verdicts, of one status or kind if asked for, and the counts of each status (whatever status is asked for). results: company_id, document_id, status, kind, ran_at."""
    asked = results.where(F.lower("kind") == kind.strip().lower()) if kind else results
    counts = asked.groupBy("company_id").agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.col("status") == s).alias(s) for s in ("blocked", "passed", "unavailable", "skipped")))
    rows = asked.where(F.lower("status") == status.strip().lower()) if status else asked
    return page_after(rows, limit, at, ident), counts


def pre_ledger(checked: DataFrame) -> DataFrame:
    """Verdicts on documents that aren't in the ledger yet, as they are inserted: document_id follows from the document's own id, so that a repeated check meets the same row. checked: company_id, transaction_id, errors, status."""
    named = checked.where(F.col("status") == "blocked")
    return named.select("company_id", name_id(PRE_LEDGER, "transaction_id").alias("document_id"), F.lit("pre_ledger").alias("kind"), "status", "errors", F.col("transaction_id").alias("original_id"))


def feed_totals(rows: DataFrame) -> DataFrame:
    """Count and value of a feed: what is due, else the amount."""
    return rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("total"), F.sum(F.coalesce("amount_due", "amount", F.lit(0))).cast("decimal(18,2)").alias("total_value"))


def report(verdicts: DataFrame, flags: DataFrame) -> DataFrame:
    """A row for each open document and check, as the report lists them: section (the check's label) and ten columns, all as text.

    transaction is the number, else the reference, else the display number; amounts carry their currency; blanks stand for what is unknown.
    verdicts: KEY, the users' decisions, vendor_name, invoice_number, reference, display_number, date, amount, currency_code, doc_status;
    flags: company_id, transaction_id, issue_type, severity, confidence, dup_of_number, likely_original, reason."""
    mine = ("vendor_name", "invoice_number", "reference", "display_number", "date", "amount", "currency_code", "doc_status")
    rows = flags.select("company_id", "transaction_id", "issue_type", "severity", "confidence", "dup_of_number", "likely_original", "reason").join(verdicts.where(is_open()).select("company_id", F.col("document_id").alias("transaction_id"), *mine), ["company_id", "transaction_id"])
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    currency = F.upper(F.trim(F.coalesce(full("currency_code"), F.lit("GBP"))))
    symbol = F.when(currency == "GBP", "£").otherwise(F.concat(currency, F.lit(" ")))
    return rows.select(
        "company_id", label("issue_type").alias("section"), "transaction_id",
        text(F.col("vendor_name")).alias("contact"), F.coalesce(full("invoice_number"), full("reference"), full("display_number"), F.lit("")).alias("transaction"),
        text(F.col("date")).alias("date"), text(F.concat(symbol, F.format_number("amount", 2))).alias("amount"), text(F.col("doc_status")).alias("status"),
        text(F.col("dup_of_number")).alias("duplicate_of"), F.when(F.col("likely_original"), "KEEP (original)").when(~F.col("likely_original"), "VOID (duplicate)").otherwise("").alias("action"),
        F.initcap(text(F.col("severity"))).alias("severity"), text(F.concat(F.bround(F.col("confidence") * 100, 0).cast("int"), F.lit("%"))).alias("confidence"), text(F.col("reason")).alias("reason"),
    )


def score_alerts(now: DataFrame, history: DataFrame) -> DataFrame:
    """Companies whose score fell below its last record. history: company_id, recorded_at, score."""
    last = history.groupBy("company_id").agg(F.max_by("score", "recorded_at").alias("was"))
    rows = now.join(last, "company_id").where("score < was")
    return rows.select("company_id", "score", "was", F.when(F.col("score") < 40, "critical").when(F.col("score") < 70, "watch").otherwise("info").alias("level"))


def firm_summary(companies: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row a firm: companies, those with a snapshot, failed, tight on cash. snapshots: company_id, ok, cash_ratio."""
    rows = companies.join(snapshots.withColumn("has", F.lit(True)), "company_id", "left")
    return rows.groupBy("firm_id").agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.col("has").isNotNull()).alias("with_snapshot"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("cash_ratio") < 0.2).alias("cash_tight"))


# --- lists, settings and events -----------------------------------------------------


def bulk(verdicts: DataFrame, asked: DataFrame, action: str) -> DataFrame:
    """(company_id, document_id, ok, error) for every asked row: each stands alone; rows that aren't there fail, unknown actions fail all."""
    known = verdicts.select(*KEY).distinct().withColumn("there", F.lit(True))
    rows = asked.join(known, KEY, "left")
    error = F.when(F.lit(action not in ("dismiss", "snooze", "mark_ok", "restore", "resolve")), "unknown action").when(F.col("there").isNull(), "not found")
    return rows.select(*KEY, error.isNull().alias("ok"), F.coalesce(error, F.lit("")).alias("error"))


def settings_merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """(company_id, config) where new entries of a company's map replace old ones of their key. old, new: company_id, config map<string,string>."""
    both = old.select("company_id", F.col("config").alias("o")).join(new.select("company_id", F.col("config").alias("n")), "company_id", "full")
    empty = F.create_map().cast("map<string,string>")
    o, n = F.coalesce("o", empty), F.coalesce("n", empty)
    return both.select("company_id", F.map_concat(F.map_filter(o, lambda k, _: ~F.array_contains(F.map_keys(n), k)), n).alias("config"))


def delivered(log: DataFrame, events: DataFrame) -> DataFrame:
    """The send log after delivery events: an event meets the row of its message id, else the recipient's latest row; the last event counts.

    log: log_id, message_id, email, created_at, status; events: message_id, email, at, status (null: in passing)."""
    e = events.where("status is not null")
    by_id = log.where("message_id is not null").groupBy("message_id").agg(F.max_by("log_id", F.struct("created_at", "log_id")).alias("id1"))
    by_mail = log.groupBy(F.lower("email").alias("mail")).agg(F.max_by("log_id", F.struct("created_at", "log_id")).alias("id2"))
    hit = e.join(by_id, "message_id", "left").join(by_mail, F.lower(e["email"]) == F.col("mail"), "left").select(F.coalesce("id1", "id2").alias("log_id"), "at", F.col("status").alias("new"))
    last = hit.where("log_id is not null").groupBy("log_id").agg(F.max_by("new", "at").alias("new"))
    return log.join(last, "log_id", "left").select("log_id", "message_id", "email", "created_at", F.coalesce("new", "status").alias("status"))


def with_counts(items: DataFrame, notes: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Items with how many notes and files they have."""
    n = notes.groupBy(*keys).agg(F.count(F.lit(1)).alias("notes"))
    f = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"))
    return items.join(n, keys, "left").join(f, keys, "left").withColumn("notes", F.coalesce("notes", F.lit(0))).withColumn("files", F.coalesce("files", F.lit(0)))


def default_list(contacts: DataFrame, missing: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(company_id, contact_id, n_missing, company_missing): contacts less dismissed ones, with what they lack, and how many of the company lack something."""
    left = contacts.join(dismissed.select("company_id", "contact_id").distinct(), ["company_id", "contact_id"], "left_anti").join(missing, ["company_id", "contact_id"], "left")
    rows = left.select("company_id", "contact_id", F.coalesce(F.size("missing"), F.lit(0)).alias("n_missing"))
    total = rows.groupBy("company_id").agg(F.count_if(F.col("n_missing") > 0).alias("company_missing"))
    return rows.join(total, "company_id")
