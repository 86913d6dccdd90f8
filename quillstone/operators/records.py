"""Reading and writing of single verdicts, annotations and fix suggestions that come as JSON, and what a run over a company needs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import vendor_account
from ..functions.text import blank, code_in_text, strip
from .base import CompanySettings, Settings
from .verdicts import KEY

#: Rules whose fix is another account.
RECODED = ("wrong_category", "wrong_direction_account", "unexpected_account", "multi_account_supplier")
ANNOTATION = "summary string, priority string, confidence double"


@dataclass(frozen=True)
class AuditContext:
    """What rules take beside documents, each a frame with company_id: rules join it, so one run serves any number of companies."""

    accounts: DataFrame
    tax_rates: DataFrame
    contacts: DataFrame
    settings: Settings | CompanySettings = Settings()
    employees: DataFrame | None = None
    companies: DataFrame | None = None
    catalogue: DataFrame | None = None

    def payroll(self, settings: Settings | CompanySettings) -> DataFrame:
        """(company_id, name): employees of the payroll, and names that the settings add."""
        if isinstance(settings, CompanySettings):
            named = settings.frame.select(F.col("cfg_co").alias("company_id"), F.explode("cfg.payroll_names").alias("name"))
        else:
            named = self.accounts.select("company_id").distinct().select("company_id", F.explode(settings.value("payroll_names")).alias("name"))
        return named if self.employees is None else self.employees.select("company_id", "name").union(named)


def context(accounts: DataFrame, tax_rates: DataFrame, contacts: DataFrame, configs: DataFrame | None = None, employees: DataFrame | None = None, companies: DataFrame | None = None, catalogue: DataFrame | None = None) -> AuditContext:
    """Context of a run: accounts and rates without a code and contacts without an id are left out, active ones come first where a code repeats.

    accounts, tax_rates: company_id, code, active and more; contacts: company_id, contact_id and more; configs: company_id, config (settings as JSON, as they are stored); employees: company_id, name;
    companies: company_id, vat_registered, ignore_before; catalogue: phrases of capital items (kind, phrase)."""
    coded = lambda df: one_of(df.where(~blank("code")).withColumn("code", strip("code")), ["company_id", "code"])
    settings = Settings() if configs is None else CompanySettings(configs)
    return AuditContext(coded(accounts), coded(tax_rates), contacts.where(~blank("contact_id")), settings, employees, companies, catalogue)


def one_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: an active one if there is any, else the least by the other columns."""
    rest = [c for c in df.columns if c not in (*keys, "active")]
    best = F.min(F.struct((~F.coalesce("active", F.lit(True))).alias("off"), *rest)).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest), (~F.col("r.off")).alias("active"))


def trapped(verdicts: DataFrame, as_of: date, include_resolved: bool = False, include_dismissed: bool = False) -> DataFrame:
    """Blocked verdicts on posted documents that are left to act on, perhaps with resolved or dismissed ones; marked, cleared and snoozed ones never show.

    verdicts: KEY, kind, status, resolved, dismissed, marked_ok, auto_cleared, snoozed_until."""
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    keep = off("marked_ok") & off("auto_cleared") & (F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= F.lit(as_of)))
    if not include_resolved:
        keep = keep & off("resolved")
    if not include_dismissed:
        keep = keep & off("dismissed")
    return verdicts.where((F.col("kind") == "post_ledger") & (F.col("status") == "blocked") & keep)


def found(verdicts: DataFrame, asked: DataFrame) -> DataFrame:
    """Verdicts that are asked for by id, within the asker's company only. asked: company_id, verdict_id."""
    return verdicts.join(asked.select("company_id", "verdict_id"), ["company_id", "verdict_id"], "left_semi")  # no distinct(): repeats of what is asked change nothing, and a table of them in memory would


def blocked(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each asked document with whether any verdict on it as posted is blocked, whatever users decided. asked: KEY."""
    have = verdicts.where((F.col("kind") == "post_ledger") & (F.col("status") == "blocked")).select(*KEY).distinct().withColumn("b", F.lit(True))
    return asked.join(have, KEY, "left").select(*KEY, F.coalesce("b", F.lit(False)).alias("blocked"))


def recorded(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """The log of verdicts with new decisions behind it. The decision's map is kept as it came; who recorded it and the target ledger are added
    unless it names them itself. decisions: KEY, document_type, kind, status, result map<string,string>, user_id, target_ledger."""
    result = F.coalesce("result", F.create_map().cast("map<string,string>"))
    for key, column in (("recorded_by_user_id", "user_id"), ("target_ledger", "target_ledger")):
        result = F.when(F.col(column).isNull() | F.map_contains_key(result, key), result).otherwise(F.map_concat(result, F.create_map(F.lit(key), F.col(column))))
    rows = decisions.withColumn("result", result).drop("user_id", "target_ledger")
    rows = rows.withColumn("error_msgs", F.nullif(F.try_element_at("result", F.lit("error_msgs")), F.lit("")))
    return log.unionByName(rows, allowMissingColumns=True)


def annotation(raw: Column | str, schema: str = ANNOTATION) -> Column:
    """An annotation from its JSON: null for null, blank or broken text, for anything but an object, and where a field has another type."""
    c = F.col(raw) if isinstance(raw, str) else raw
    parsed = F.from_json(c, f"{schema}, bad_json string", {"columnNameOfCorruptRecord": "bad_json"})
    return F.when(c.rlike(r"^\s*\{") & parsed["bad_json"].isNull(), parsed.dropFields("bad_json"))


def primary_rule(flagged: Column | str = "flagged", rule_ids: Column | str = "rule_ids", document_type: Column | str = "document_type") -> Column:
    """The rule that a fix is asked for: the first flag's, else the first id, else the document's type, else unknown."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    text = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(text(F.get(c(flagged), F.lit(0))["issue_type"]), text(F.get(c(rule_ids), F.lit(0))), text(c(document_type)), F.lit("unknown"))


def fix_requests(verdicts: DataFrame) -> DataFrame:
    """What a fix is asked with: KEY, primary_rule, the document's fields (blank where unknown, money in GBP unless it says so) and the first flag's codes.

    verdicts: KEY, document_type, rule_ids, flagged (array of structs with issue_type, current_code, suggested_code), vendor_name, invoice_number, currency_code, reference."""
    first = F.get("flagged", F.lit(0))
    plain = [F.coalesce(c, F.lit("")).alias(c) for c in ("vendor_name", "invoice_number", "reference")]
    return verdicts.select(*KEY, primary_rule().alias("primary_rule"), *plain, F.coalesce(F.nullif("currency_code", F.lit("")), F.lit("GBP")).alias("currency_code"), F.coalesce(first["current_code"], F.lit("")).alias("current_code"), F.coalesce(first["suggested_code"], F.lit("")).alias("suggested_code"))


def suggestions(answers: DataFrame, vendors: dict[str, str] | None = None) -> DataFrame:
    """Fix suggestions from a scorer's JSON, with defaults for what is missing or of another type: KEY, strategy, action, steps, rationale, minutes, updates, target, account.

    account is set for rules of RECODED: the suggested code, else the vendor's by the company's map, else the first code in the steps.
    answers: the columns of fix_requests and raw. Rows without a JSON object give the defaults."""
    raw = F.when(F.col("raw").rlike(r"^\s*\{"), F.col("raw"))
    text = lambda k: F.get_json_object(raw, f"$.{k}")
    given = lambda k, default: F.coalesce(F.nullif(text(k), F.lit("")), F.lit(default))
    steps = F.coalesce(F.when(text("human_steps").startswith("["), F.from_json(text("human_steps"), "array<string>")), F.array().cast("array<string>"))
    updates = F.when(text("field_updates").startswith("{"), F.from_json(text("field_updates"), "map<string,string>"))
    rows = answers.select("*", given("fix_strategy", "manual_review").alias("strategy"), given("xero_action", "").alias("action"), steps.alias("steps"), given("rationale", "").alias("rationale"), F.coalesce(text("estimated_minutes").try_cast("double").cast("int"), F.lit(0)).alias("minutes"), updates.alias("updates"), F.nullif(text("target_transaction_id"), F.lit("")).alias("target"))
    code = F.coalesce(F.nullif(strip("suggested_code"), F.lit("")), vendor_account("vendor_name", vendors or {}), code_in_text(F.array_join("steps", " ")))
    return rows.select(*KEY, "strategy", "action", "steps", "rationale", "minutes", "updates", "target", F.when(F.col("primary_rule").isin(*RECODED), code).alias("account"))


def events_recorded(log: DataFrame, events: DataFrame) -> DataFrame:
    """An activity log with new events behind it: firm_id, type, severity (info if unknown), title, detail, actor_email, company_id, at. Events without a type or a title aren't recorded; what they don't say is null."""
    fields = {"firm_id": "string", "type": "string", "severity": "string", "title": "string", "detail": "string", "actor_email": "string", "company_id": "string", "at": "timestamp"}
    given = lambda c: F.col(c) if c in events.columns else F.lit(None)
    rows = events.select(*(F.coalesce(given(c).cast(k), F.lit("info") if c == "severity" else F.lit(None).cast(k)).alias(c) for c, k in fields.items()))
    return log.unionByName(rows.where(~blank("type") & ~blank("title")), allowMissingColumns=True)


def sends_recorded(log: DataFrame, attempts: DataFrame) -> DataFrame:
    """A send log with a row for each attempt behind it. attempts: user_id, recipient_email, kind, ok, channel, detail, provider_message_id, at. The address is stored trimmed in lower case; a detail is an error only where the attempt failed."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    rows = attempts.select("user_id", F.lower(strip("recipient_email")).alias("recipient_email"), "channel", "kind", F.when(ok, "sent").otherwise("failed").alias("status"), F.col("channel").alias("provider"), "provider_message_id", F.when(~ok, F.col("detail")).alias("error"), "at")
    return log.unionByName(rows, allowMissingColumns=True)


def users_marked(users: DataFrame, attempts: DataFrame) -> DataFrame:
    """users with email_status as the last attempt to write to each left it (of attempts at one time a failed one counts); users nobody wrote to keep theirs. users: user_id, email_status and more."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    last = attempts.where(F.col("user_id").isNotNull()).groupBy(F.col("user_id").alias("s_user")).agg(F.max_by(F.when(ok, "sent").otherwise("failed"), F.struct("at", ~ok)).alias("s_status"))
    rows = users.join(last, F.col("user_id") == F.col("s_user"), "left")
    return rows.select(*[F.coalesce("s_status", "email_status").alias(c) if c == "email_status" else F.col(c) for c in users.columns])
