"""Rules that look at one document at a time: tax codes, numbers, status, age, attachments."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, has_any, squeezed, strip, upper
from .base import CREDITS, DRAFTS, MONEY_OUT, OPEN, PURCHASES, SALES, Settings, days_old, flags, is_credit, is_listed, kind, lines, outstanding


def missing_tax(txn: DataFrame) -> DataFrame:
    """A line without a tax code: one flag for each document, at its first such line."""
    empty = lines(txn).where(blank("tax")).groupBy("company_id", "transaction_id").agg(F.min("line_no").alias("line_no"))
    return flags(empty, "missing_tax", "critical", line_no=F.col("line_no"))


def invalid_tax_code(txn: DataFrame, rates: DataFrame) -> DataFrame:
    """The first line whose code is no tax rate of the company; only for documents without blank codes, and companies with rates."""
    allowed = rates.where(~blank("code")).select(F.col("company_id").alias("r_co"), upper("code").alias("r_code")).distinct()
    rows = lines(txn).join(allowed.select("r_co").distinct(), F.col("company_id") == F.col("r_co"), "left_semi").withColumn("code", upper("tax"))
    known = rows.join(allowed, (F.col("company_id") == F.col("r_co")) & (F.col("code") == F.col("r_code")), "left")
    docs = known.groupBy("company_id", "transaction_id").agg(F.bool_or(F.col("code") == "").alias("any_blank"), F.min(F.when(F.col("r_code").isNull(), F.struct(F.coalesce("line_no", F.lit(0)).alias("k"), "line_no", "code"))).alias("f"))
    return flags(docs.where(~F.col("any_blank") & F.col("f").isNotNull()), "invalid_tax_code", "critical", line_no=F.col("f.line_no"), current_code=F.col("f.code"))


def missing_vendor(txn: DataFrame) -> DataFrame:
    return flags(txn.where(blank("vendor_name")), "missing_vendor", "critical")


def no_number(txn: DataFrame) -> DataFrame:
    """Documents without a number: directly booked if approved, by side; else the number is missing."""
    settled = upper("status").isin("AUTHORISED", "PAID")
    issue = F.when(settled & kind().isin(*SALES), "invoice_or_direct_booking").when(settled & kind().isin(*PURCHASES), "bill_or_direct_booking").otherwise("missing_invoice_number")
    return flags(txn.where(blank("invoice_number")), issue, "medium")


def future_dated(txn: DataFrame, as_of: date) -> DataFrame:
    return flags(txn.where(F.col("date") > F.lit(as_of)), "future_dated", "medium")


def old_unpaid(txn: DataFrame, as_of: date, settings: Settings = Settings()) -> DataFrame:
    """Open documents with something owing, a threshold of days past their due date (else their date), or past their date by old_unpaid_age_basis. What isn't sales counts as a bill."""
    sales = kind().isin(*SALES)
    age = days_old(F.when(settings.value("old_unpaid_age_basis") == "due_date", F.coalesce("due_date", "date")).otherwise(F.col("date")), as_of)
    limit = F.when(sales, settings.value("old_unpaid_invoice_days")).otherwise(settings.value("old_unpaid_bill_days"))
    hit = settings.joined(txn).where(~is_credit() & (blank("status") | upper("status").isin(*OPEN)) & (outstanding() > 0) & (age >= limit))
    return flags(hit, F.when(sales, "old_unpaid_invoice").otherwise("old_unpaid_bill"), "high", reason=F.concat(age.cast("string"), F.lit(" days")))


def invalid_status(txn: DataFrame) -> DataFrame:
    """Paid with a balance, or approved with more settled than it amounts to."""
    settled = F.coalesce("amount_paid", F.lit(0)) + F.coalesce("allocated_amount", F.lit(0))
    wrong = ((upper("status") == "PAID") & (F.col("amount_due") > 0)) | ((upper("status") == "AUTHORISED") & (settled > F.col("amount")))
    return flags(txn.where(wrong), "invalid_status_combo", "high")


def old_credits(txn: DataFrame, as_of: date, settings: Settings = Settings()) -> DataFrame:
    hit = settings.joined(txn).where(is_credit() & (outstanding() > 0) & (days_old("date", as_of) >= settings.value("old_credit_days")))
    return flags(hit, F.when(kind() == CREDITS[0], "old_unsettled_sales_credit").otherwise("old_unsettled_purchase_credit"), "high")


def unapproved(txn: DataFrame, as_of: date, settings: Settings = Settings()) -> DataFrame:
    """Drafts and submitted documents of the threshold's age; those dated ahead aren't old."""
    hit = settings.joined(txn).where(upper("status").isin(*DRAFTS) & (days_old(F.coalesce("posted_date", "date"), as_of) >= settings.value("unapproved_days")))
    return flags(hit, F.when(kind().isin(*SALES), "unapproved_invoice").otherwise("unapproved_bill"), "medium")


def undocumented(txn: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Bills and payments known to have no attachment; unknown isn't none."""
    ignored = settings.value("undocumented_ignored_contacts")
    hit = settings.joined(txn.where(kind().isin("ACCPAY", *MONEY_OUT) & F.col("has_attachments").eqNullSafe(F.lit(False))))
    hit = hit.where((F.abs("amount") >= settings.value("undocumented_min")) & (~settings.value("undocumented_tax_only") | ~blank("tax_code")))
    hit = hit.where(~is_listed(upper("contact_id"), ignored) & ~is_listed(upper("vendor_name"), ignored))
    return flags(hit, "undocumented_bill", "medium")


def opening_balance_postings(txn: DataFrame, accounts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents posted to the historical adjustment account, by code or by name."""
    named = accounts.where(has_any("name", ("historical adjustment", "opening balance"))).select(F.col("company_id").alias("a_co"), strip("code").alias("a_code")).distinct()
    rows = txn.withColumn("acct", strip("account_code")).join(named, (F.col("company_id") == F.col("a_co")) & (F.col("acct") == F.col("a_code")), "left")
    hit = settings.joined(rows).where((F.col("acct") != "") & ((F.col("acct") == settings.value("historical_code")) | F.col("a_code").isNotNull()))
    return flags(hit, "opening_balance_difference", "high", current_code=F.col("acct"))


def non_payroll(txn: DataFrame, names: DataFrame) -> DataFrame:
    """Payments to payees that no employee of the company is named like; companies without names get no flags. names: company_id, name."""
    listed = names.select(F.col("company_id").alias("n_co"), squeezed("name").alias("n_name")).where("n_name <> ''").distinct()
    paid = txn.where(kind() == "SPEND").join(listed.select("n_co").distinct(), F.col("company_id") == F.col("n_co"), "left_semi").withColumn("payee", squeezed("vendor_name"))
    return flags(paid.join(listed, (F.col("company_id") == F.col("n_co")) & (F.col("payee") == F.col("n_name")), "left_anti"), "non_payroll_payment", "medium")


def pre_ledger_errors(txn: DataFrame, as_of: date) -> DataFrame:
    """One document as it is entered: an array of the fields that are missing or wrong."""
    tests = [("amount", F.col("amount").isNull() | (F.col("amount") <= 0)), ("vendor_name", blank("vendor_name")), ("date", F.col("date").isNull() | (F.col("date") > F.lit(as_of))), ("invoice_number", blank("invoice_number")), ("tax_code", blank("tax_code"))]
    errors = F.filter(F.array(*(F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests)), lambda e: e.isNotNull())
    return txn.select("company_id", "transaction_id", errors.alias("errors"), F.when(F.size(errors) > 0, "blocked").otherwise("passed").alias("status"))
