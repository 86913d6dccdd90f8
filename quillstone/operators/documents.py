"""What is shown and suggested for a document: payment state, titles, links, payloads, fixes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, code_in_text, strip, upper
from .base import CREDITS, SALES, kind


def payment_state(txn: DataFrame) -> DataFrame:
    """(payment_status, editable, why_not): settled at the bank, paid, part paid, unpaid or unknown; what is settled, reconciled or closed can't be edited."""
    due = F.col("amount_due")
    paid = F.coalesce("amount_paid", F.lit(0)) + F.coalesce("allocated_amount", F.lit(0))
    status = F.when(kind().isin("SPEND", "RECEIVE"), "settled").when(due.isNull(), "unknown").when(due <= 0.005, "paid").when((paid > 0) | (due < F.col("amount")), "part_paid").otherwise("unpaid")
    why = F.when(F.coalesce("reconciled", F.lit(False)), "reconciled").when(upper("status").isin("VOIDED", "DELETED"), "closed").when(status == "paid", "paid").when(status == "part_paid", "part paid")
    return txn.select("company_id", "transaction_id", status.alias("payment_status"), why.isNull().alias("editable"), F.coalesce(why, F.lit("")).alias("why_not"))


def label(col: str = "type") -> Column:
    """How a document type is called."""
    t = upper(col)
    names = {"ACCREC": "Invoice", "ACCPAY": "Bill", "ACCRECCREDIT": "Sales credit note", "ACCPAYCREDIT": "Purchase credit note", "RECEIVE": "Receipt", "SPEND": "Payment", "MANJOURNAL": "Journal"}
    out = F.lit("Document")
    for k, v in names.items():
        out = F.when(t == k, v).otherwise(out)
    return out


def link(base: str, type_col: str = "type", id_col: str = "transaction_id") -> Column:
    """Where a document is opened: by its type, credit notes before what their types start with."""
    t = upper(type_col)
    path = F.when(t.isin(*CREDITS), "credit-notes").when(t.startswith("ACCREC"), "invoices").when(t.startswith("ACCPAY"), "bills").when(t.isin("SPEND", "RECEIVE"), "bank").otherwise("documents")
    return F.concat(F.lit(base.rstrip("/") + "/"), path, F.lit("/"), F.col(id_col))


def title(rule: Column | str, vendor: Column | str) -> Column:
    """A verdict's headline from its first rule, in words."""
    words = F.replace(F.col(rule) if isinstance(rule, str) else rule, F.lit("_"), F.lit(" "))
    return F.concat(strip(vendor), F.lit(" has a "), words, F.lit(" issue"))


def fixes(flagged: DataFrame) -> DataFrame:
    """(strategy, field, value, minutes) for verdicts by their first rule. flagged: company_id, document_id, primary_rule, likely_original, dup_of_id, suggested_code, steps.

    Duplicates: the copy is voided, or the partner if this is the original; undecided ones are reviewed. Codes take the suggestion. What people must decide is left to them; anything else
    takes the suggestion, or the account number in the steps."""
    r = F.col("primary_rule")
    dup = r.isin("duplicate_invoice", "duplicate_bill", "duplicate_credit_note")
    has = ~blank("suggested_code")
    s = lambda strategy, field, value, minutes: F.struct(F.lit(strategy).alias("strategy"), F.lit(field).cast("string").alias("field"), (value if isinstance(value, Column) else F.lit(value)).cast("string").alias("value"), F.lit(minutes).alias("minutes"))
    pick = (
        F.when(dup & F.col("likely_original").isNull(), s("review_possible_duplicate", None, None, 3))
        .when(dup & F.col("likely_original"), s("void_duplicate", "target", F.col("dup_of_id"), 2))
        .when(dup, s("void_duplicate", "Status", "VOIDED", 2))
        .when(r.isin("unapproved_invoice", "unapproved_bill"), s("approve_document", "Status", "AUTHORISED", 2))
        .when(r == "purchase_tax_missing", s("add_purchase_tax", "TaxType", "INPUT", 3))
        .when(r == "sales_tax_missing", s("add_sales_tax", "TaxType", "OUTPUT", 3))
        .when((r == "multi_tax_code_supplier") & has, s("standardise_tax_code", "TaxType", F.col("suggested_code"), 2))
        .when((r == "unexpected_tax_code") & has, s("correct_tax_code", "TaxType", F.col("suggested_code"), 2))
        .when((r == "multi_account_supplier") & has, s("standardise_account", "AccountCode", F.col("suggested_code"), 2))
        .when(r == "future_dated", s("correct_date", "Date", "today", 2))
        .when(r == "sales_tax_on_bills", s("correct_tax_code", "TaxType", "INPUT", 2))
        .when(r == "purchase_tax_on_invoices", s("correct_tax_code", "TaxType", "OUTPUT", 2))
        .when(r.isin("old_unpaid_invoice", "old_unpaid_bill", "old_unsettled_sales_credit", "old_unsettled_purchase_credit", "opening_balance_difference", "invoice_or_direct_booking", "bill_or_direct_booking"), s("manual_review", None, None, 10))
        .when(r.isin("duplicate_contact", "contact_defaults", "inactive_contact"), s("manual_review", None, None, 5))
        .otherwise(s("deferred", "AccountCode", F.coalesce(F.when(has, F.col("suggested_code")), code_in_text("steps")), 5))
    )
    return flagged.select("company_id", "document_id", pick.alias("f")).select("company_id", "document_id", "f.*")


def in_period(txn: DataFrame, low: date | None, high: date | None) -> DataFrame:
    """Documents of a period, both ends included; undated ones stay."""
    inside = F.lit(True)
    if low:
        inside = inside & (F.col("date") >= F.lit(low))
    if high:
        inside = inside & (F.col("date") <= F.lit(high))
    return txn.where(F.col("date").isNull() | inside)


def not_before(txn: DataFrame, floor: date | None) -> DataFrame:
    return txn.where(F.col("date") >= F.lit(floor)) if floor else txn


def side(col: str = "type") -> Column:
    """Which of a company's ledgers a document belongs to."""
    return F.when(kind(col).isin("SPEND", "RECEIVE"), "bank").when(kind(col) == "MANJOURNAL", "journals").when(kind(col).isin(*SALES), "sales").otherwise("purchases")
