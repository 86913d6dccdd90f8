"""The mirrored ledger: raw JSON documents by company and entity, parsed with fixed schemas and reshaped into transactions.

raw tables have company_id, entity, source_id, raw_json, synced_ts; text that is no JSON object is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse
from ..functions.text import blank, strip, upper

_LINE = "struct<AccountCode:string,TaxType:string,LineAmount:string,TaxAmount:string,Description:string>"
DOCUMENT = f"struct<InvoiceID:string,CreditNoteID:string,BankTransactionID:string,Type:string,Status:string,Date:string,DueDate:string,UpdatedDateUTC:string,InvoiceNumber:string,CreditNoteNumber:string,Reference:string,Contact:struct<ContactID:string,Name:string>,Total:string,TotalTax:string,AmountPaid:string,AmountDue:string,AmountCredited:string,RemainingCredit:string,CurrencyCode:string,HasAttachments:boolean,IsReconciled:string,BankAccount:struct<AccountID:string,Code:string,Name:string>,LineItems:array<{_LINE}>>"
JOURNAL = "struct<JournalID:string,JournalDate:string,SourceType:string,JournalLines:array<struct<AccountCode:string,AccountType:string,Description:string,NetAmount:string>>>"
ACCOUNT = "struct<AccountID:string,Code:string,Name:string,Type:string,Class:string,TaxType:string>"
TAX_RATE = "struct<TaxType:string,Name:string,EffectiveRate:string,DisplayTaxRate:string,CanApplyToExpenses:string,CanApplyToRevenue:string>"
CONTACT = "struct<ContactID:string,Name:string,TaxNumber:string,IsCustomer:string,IsSupplier:string,SalesDefaultAccountCode:string,PurchasesDefaultAccountCode:string,AccountsReceivableTaxType:string,AccountsPayableTaxType:string>"
EMPLOYEE = "struct<FirstName:string,LastName:string,Name:string>"
PAYMENT = "struct<IsReconciled:string,Invoice:struct<InvoiceID:string>,CreditNote:struct<CreditNoteID:string>>"
BALANCE_TYPES = ("BANK", "CURRENT", "CURRLIAB", "FIXED", "INVENTORY", "NONCURRENT", "PREPAYMENT", "TERMLIAB", "LIABILITY", "EQUITY")
MONEY = "decimal(12,2)"


def read(raw: DataFrame, entity: str, schema: str, company: str | None = None) -> DataFrame:
    """Rows of an entity (of one company, or all), parsed: company_id, source_id, synced_ts, j. A table partitioned by entity is pruned to it."""
    rows = raw.where(F.col("entity") == entity)
    if company is not None:
        rows = rows.where(F.col("company_id") == company)
    # a generator, which later filters don't pass: else each of them, and each column, would parse the text anew
    parsed = F.explode(F.array(F.when(F.col("raw_json").rlike(r"^\s*\{"), F.from_json("raw_json", schema)))).alias("j")
    return rows.select("company_id", "source_id", "synced_ts", parsed).where("j is not null")


def first_row(raw: DataFrame, entity: str, schema: str) -> DataFrame:
    """The one row of a singleton entity for each company: the one synced first."""
    rows = read(raw, entity, schema)
    return rows.groupBy("company_id").agg(F.min_by("j", F.struct("synced_ts", "source_id")).alias("j"))


def has_documents(raw: DataFrame) -> DataFrame:
    """Companies that have any invoice or credit note."""
    return raw.where(F.col("entity").isin("invoices", "credit_notes")).select("company_id").distinct()


def truth(c: Column | str) -> Column:
    """True, false or unknown from booleans written as text."""
    low = F.lower(strip(c))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def reconciled_ids(raw: DataFrame) -> DataFrame:
    """Documents that a reconciled payment settles: company_id, document_id."""
    p = read(raw, "payments", PAYMENT).where(truth("j.IsReconciled"))
    return p.select("company_id", F.explode(F.array("j.Invoice.InvoiceID", "j.CreditNote.CreditNoteID")).alias("document_id")).where("document_id is not null").distinct()


def _money(c: str) -> Column:
    return F.col(c).try_cast(MONEY)


def _items() -> Column:
    return F.transform("j.LineItems", lambda x: F.struct(x["AccountCode"].alias("account_code"), x["TaxType"].alias("tax_code"), x["LineAmount"].try_cast(MONEY).alias("amount"), x["TaxAmount"].try_cast(MONEY).alias("tax_amount"), x["Description"].alias("description")))


def _given(*cols: str) -> Column:
    """The first that isn't blank; null if none."""
    return F.coalesce(*(F.when(~blank(c), strip(c)) for c in cols))


def documents(raw: DataFrame) -> DataFrame:
    """Invoices, bills and credit notes as transactions, deleted and voided ones and those without an id left out."""
    rows = read(raw, "invoices", DOCUMENT).unionByName(read(raw, "credit_notes", DOCUMENT))
    ident = _given("j.InvoiceID", "j.CreditNoteID")
    kind = F.when(~blank("j.Type"), upper("j.Type")).when(F.col("j.CreditNoteID").isNotNull(), "ACCRECCREDIT")
    first = F.get("j.LineItems", F.lit(0))
    vendor = F.coalesce(_given("j.Contact.Name"), F.lit("Unknown Vendor"))
    purchase = kind.isin("ACCPAY", "ACCPAYCREDIT")
    reference = F.coalesce(_given("j.Reference"), F.when(purchase, _given("j.InvoiceNumber", "j.CreditNoteNumber")))
    told = F.coalesce(_given("j.Reference"), F.when(~blank(first["Description"]), strip(first["Description"])), F.concat(vendor, F.lit(" — "), F.coalesce(kind, F.lit(""))))
    rows = rows.where(ident.isNotNull() & ~upper("j.Status").isin("DELETED", "VOIDED"))
    out = rows.select(
        "company_id", ident.alias("transaction_id"), parse("j.Date").alias("date"), F.substring(told, 1, 1000).alias("description"), F.coalesce(_money("j.Total"), F.lit(0)).cast(MONEY).alias("amount"), vendor.alias("vendor_name"), _given("j.Contact.ContactID").alias("contact_id"), reference.alias("reference"),
        first["TaxType"].alias("tax_code"), first["AccountCode"].alias("account_code"), _given("j.InvoiceNumber", "j.CreditNoteNumber").alias("invoice_number"), parse("j.DueDate").alias("due_date"), parse("j.UpdatedDateUTC").alias("posted_date"), upper("j.Status").alias("status"),
        _money("j.AmountPaid").alias("amount_paid"), _money("j.AmountCredited").alias("allocated_amount"), F.coalesce(_money("j.AmountDue"), _money("j.RemainingCredit")).alias("amount_due"), F.col("j.HasAttachments").alias("has_attachments"), _money("j.TotalTax").alias("tax_total"), F.coalesce(_given("j.CurrencyCode"), F.lit("GBP")).alias("currency_code"), kind.alias("type"), _items().alias("line_items"),
    )
    paid = reconciled_ids(raw).withColumnRenamed("document_id", "transaction_id").withColumn("reconciled", F.lit(True))
    return out.join(paid, ["company_id", "transaction_id"], "left").withColumn("reconciled", F.coalesce("reconciled", F.lit(False)))


def bank(raw: DataFrame) -> DataFrame:
    """Receipts and payments of known contacts as transactions."""
    rows = read(raw, "bank_transactions", DOCUMENT).where(upper("j.Type").isin("RECEIVE", "SPEND") & ~blank("j.Contact.ContactID") & ~blank("j.BankTransactionID"))
    first = F.get("j.LineItems", F.lit(0))
    return rows.select("company_id", strip("j.BankTransactionID").alias("transaction_id"), parse("j.Date").alias("date"), _money("j.Total").alias("amount"), strip("j.Contact.ContactID").alias("contact_id"), F.coalesce(_given("j.Contact.Name"), F.lit("Unknown Vendor")).alias("vendor_name"), upper("j.Type").alias("type"), upper("j.Status").alias("status"), truth("j.IsReconciled").alias("reconciled"), F.col("j.BankAccount.AccountID").alias("bank_account"), first["AccountCode"].alias("account_code"), first["TaxType"].alias("tax_code"), _items().alias("line_items"))


def journals(raw: DataFrame) -> DataFrame:
    """Manual journals with lines: described by their first narration, as large as their largest line."""
    rows = read(raw, "journals", JOURNAL).where((upper("j.SourceType") == "MANJOURNAL") & (F.size("j.JournalLines") > 0))
    told = F.get(F.filter(F.transform("j.JournalLines", lambda x: strip(x["Description"])), lambda t: t != ""), F.lit(0))
    most = F.array_max(F.transform("j.JournalLines", lambda x: F.abs(F.coalesce(x["NetAmount"].try_cast("decimal(18,4)"), F.lit(0)))))
    items = F.transform("j.JournalLines", lambda x: F.struct(x["AccountCode"].alias("account_code"), F.lit(None).cast("string").alias("tax_code"), x["NetAmount"].try_cast(MONEY).alias("amount"), F.lit(None).cast(MONEY).alias("tax_amount"), x["Description"].alias("description")))
    return rows.select("company_id", F.col("j.JournalID").alias("transaction_id"), parse("j.JournalDate").alias("date"), F.coalesce(told, F.lit("Manual journal")).alias("description"), F.bround(most, 2).cast(MONEY).alias("amount"), F.lit("MANJOURNAL").alias("type"), items.alias("line_items"))


def accounts(raw: DataFrame) -> DataFrame:
    rows = read(raw, "accounts", ACCOUNT).where(~blank("j.Code") & ~blank("j.Name"))
    return rows.select("company_id", strip("j.Code").alias("code"), strip("j.Name").alias("name"), upper("j.Type").alias("type"), F.when(upper("j.Type").isin(*BALANCE_TYPES), "Balance Sheet").otherwise("P&L").alias("statement"))


def tax_rates(raw: DataFrame) -> DataFrame:
    """Rates as text of two places: the effective one, unless it is 0 or missing, else the displayed one, else 0."""
    rate = F.coalesce(F.nullif(F.col("j.EffectiveRate").try_cast("decimal(9,4)"), F.lit(0)), F.col("j.DisplayTaxRate").try_cast("decimal(9,4)"), F.lit(0))
    return read(raw, "tax_rates", TAX_RATE).where(~blank("j.TaxType")).select("company_id", strip("j.TaxType").alias("code"), strip("j.Name").alias("name"), F.bround(rate, 2).cast("decimal(9,2)").cast("string").alias("rate"), truth("j.CanApplyToExpenses").alias("applies_to_expenses"), truth("j.CanApplyToRevenue").alias("applies_to_revenue"))


def contact_defaults(raw: DataFrame) -> DataFrame:
    """Contacts with at least one default code."""
    cols = {"sales_account": "SalesDefaultAccountCode", "purchase_account": "PurchasesDefaultAccountCode", "sales_tax": "AccountsReceivableTaxType", "purchase_tax": "AccountsPayableTaxType"}
    rows = read(raw, "contacts", CONTACT).select("company_id", F.col("j.ContactID").alias("contact_id"), *(_given(f"j.{v}").alias(k) for k, v in cols.items()))
    return rows.where(F.coalesce(*cols).isNotNull() & ~blank("contact_id"))


def contact_vat(raw: DataFrame) -> DataFrame:
    return read(raw, "contacts", CONTACT).where(~blank("j.TaxNumber") & ~blank("j.ContactID")).select("company_id", F.col("j.ContactID").alias("contact_id"), strip("j.TaxNumber").alias("vat"))


def payroll_names(raw: DataFrame) -> DataFrame:
    name = F.concat_ws(" ", _given("j.FirstName"), _given("j.LastName"))
    return read(raw, "payroll_employees", EMPLOYEE).select("company_id", F.when(name != "", name).otherwise(strip("j.Name")).alias("name")).where("name <> ''")
