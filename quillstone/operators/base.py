"""What all rules share: the flag's columns, document types, line views, account lookups, settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import strip, upper

# Document, account and status codes.
SALES, PURCHASES, CREDITS = ("ACCREC", "ACCRECCREDIT"), ("ACCPAY", "ACCPAYCREDIT"), ("ACCRECCREDIT", "ACCPAYCREDIT")
MONEY_IN, MONEY_OUT = ("RECEIVE",), ("SPEND",)
OPEN, DRAFTS = ("AUTHORISED", "SUBMITTED"), ("DRAFT", "SUBMITTED")
REVENUE_TYPES = ("REVENUE", "OTHERINCOME", "SALES")
EXPENSE_TYPES = ("EXPENSE", "DIRECTCOSTS", "OVERHEADS", "DEPRECIATN", "CURRENTASSET", "FIXEDASSET", "INVENTORY", "PREPAYMENT", "ASSET", "LIABILITY")
PURE_EXPENSE = ("EXPENSE", "OVERHEADS", "DIRECTCOSTS")

DOC = ["company_id", "transaction_id"]
FLAG = {"company_id": "string", "transaction_id": "string", "issue_type": "string", "severity": "string", "line_no": "int", "current_code": "string", "suggested_code": "string", "confidence": "double", "dup_of_id": "string", "likely_original": "boolean", "reason": "string"}


#: Values that a setting may have, where only some make sense.
CHOICES = {"old_unpaid_age_basis": ("due_date", "invoice_date")}


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows whose size Spark knows when it plans, and so broadcasts: from a plain list it takes the size for boundless, and deals whatever is joined with it."""
    fields = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], schema=to_arrow_schema(fields)), fields)


@dataclass(frozen=True)
class Settings:
    """Thresholds and lists of the rules; unknown names and bad values are ignored by of()."""

    old_unpaid_invoice_days: int = 1
    old_unpaid_bill_days: int = 1
    old_unpaid_age_basis: str = "due_date"
    old_credit_days: int = 60
    unapproved_days: int = 0
    inactive_days: int = 180
    duplicate_days_window: int = 0
    duplicate_require_same_amount: bool = True
    duplicate_require_exact_reference: bool = True
    duplicate_also_check_paid: bool = False
    duplicate_min_confidence: float = 0.9
    bill_direct_window_days: int = 30
    invoice_direct_window_days: int = 30
    outlier_min_count: int = 4
    outlier_multiple: float = 4
    outlier_min_amount: float = 100
    name_similarity: float = 0.7
    low_cost_limit: float = 10000
    capital_min: float = 500
    prepayment_min: float = 250
    misallocated_min: float = 100
    opening_difference_min: float = 1
    bank_tolerance: float = 0.01
    undocumented_min: float = 0
    undocumented_tax_only: bool = False
    year_end_month: int = 12
    year_end_day: int = 31
    large_payment: float = 1000
    one_off_max: int = 2
    account_min_count: int = 3
    account_multiple: float = 3
    historical_code: str = "840"
    monitored_accounts: tuple = ()
    ignored_contacts: tuple = ()
    undocumented_ignored_contacts: tuple = ()
    ignored_accounts: tuple = ()
    vague_codes: tuple = ()
    account_whitelist: tuple = ()
    disabled_rules: tuple = field(default=())
    payroll_names: tuple = ()
    excluded_bank_accounts: tuple = ()
    least_model_confidence: float = 0.8

    @classmethod
    def of(cls, values: dict | None) -> Settings:
        good = {}
        values = dict(values or {})
        if "overdue_days" in values:  # an older name for both
            for k in ("old_unpaid_invoice_days", "old_unpaid_bill_days"):
                values.setdefault(k, values["overdue_days"])
        for k, f in cls.__dataclass_fields__.items():
            if k not in values:
                continue
            v = values[k]
            try:
                if f.type == "bool":
                    good[k] = v if isinstance(v, bool) else str(v).strip().lower() in ("1", "true", "yes", "on")
                elif f.type == "tuple":
                    good[k] = tuple(str(x).strip() for x in (v.split(",") if isinstance(v, str) else v) if str(x).strip())
                elif f.type == "str":
                    if (text := str(v).strip()) and text.lower() in CHOICES.get(k, (text.lower(),)):
                        good[k] = text.lower() if k in CHOICES else text
                else:
                    x = float(v)
                    if x != x or x in (float("inf"), float("-inf")) or x < 0:
                        continue
                    good[k] = int(x) if f.type == "int" else x
            except (TypeError, ValueError):
                continue
        return cls(**good)

    def as_json(self) -> str:
        """All settings as a JSON object, lists as arrays."""
        return json.dumps({k: list(v) if isinstance(v, tuple) else v for k in self.__dataclass_fields__ for v in (getattr(self, k),)})

    def joined(self, rows: DataFrame) -> DataFrame:
        """rows ready for value(): these settings hold for all companies, so nothing is added."""
        return rows

    def value(self, name: str) -> Column:
        """A setting as a column of rows that went through joined(); a list is an array."""
        v = getattr(self, name)
        return F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, tuple) else F.lit(v)


class CompanySettings:
    """Settings of any number of companies as a frame that rules join by company_id: thresholds are columns, and one plan serves all companies.

    configs: company_id, config (a JSON object as it is stored). Unknown names and bad values are ignored, as by Settings.of; a company without a config, or with none that
    can be read, has the defaults. Of several configs of a company the least text counts.
    """

    def __init__(self, configs: DataFrame):
        raw = configs.groupBy(F.col("company_id").alias("cfg_co")).agg(F.min("config").alias("config")).select("cfg_co", F.from_json("config", "map<string,string>").alias("raw"))
        self.frame = raw.select("cfg_co", F.struct(*(self._coerced(name, f.type).alias(name) for name, f in Settings.__dataclass_fields__.items())).alias("cfg"))

    @staticmethod
    def _coerced(name: str, kind: str) -> Column:
        v = F.trim(F.col("raw")[name])
        if name in ("old_unpaid_invoice_days", "old_unpaid_bill_days"):
            v = F.coalesce(v, F.trim(F.col("raw")["overdue_days"]))
        if kind == "bool":
            return F.when(v.isNotNull(), F.lower(v).isin("1", "true", "yes", "on"))
        if kind == "tuple":
            listed = F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.split(v, ","))
            return F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != "")
        if kind == "str":
            return F.when((v != "") & (F.lower(v).isin(*CHOICES[name]) if name in CHOICES else F.lit(True)), F.lower(v) if name in CHOICES else v)
        x = v.try_cast("double")
        good = F.when((x >= 0) & ~F.isnan(x) & (x < float("inf")), x)
        return good.cast("int") if kind == "int" else good

    def joined(self, rows: DataFrame) -> DataFrame:
        """rows with their company's settings as cfg; Spark broadcasts the frame where it is small."""
        return rows.join(self.frame, F.col("company_id") == F.col("cfg_co"), "left").drop("cfg_co")

    def value(self, name: str) -> Column:
        return F.coalesce(F.col("cfg")[name], Settings().value(name))

    def least(self, name: str) -> float:
        """The least value of a number over all companies, defaults included."""
        own = self.frame.select(F.min(F.col("cfg")[name])).first()[0]
        return min(getattr(Settings(), name), own if own is not None else getattr(Settings(), name))


def is_listed(x: Column | str, names: Column) -> Column:
    """Whether an upper-case text is on a list of settings, in any case."""
    return F.array_contains(F.transform(names, lambda n: F.upper(n)), F.col(x) if isinstance(x, str) else x)


def flags(rows: DataFrame, issue: Column | str, severity: Column | str, **more: Column | str) -> DataFrame:
    """Rows as flags; columns that aren't given are null."""
    given = {"issue_type": issue, "severity": severity} | more
    cols = []
    for name, kind in FLAG.items():
        v = given.get(name)
        if name in DOC and v is None:
            v = F.col(name)
        cols.append((F.lit(v) if isinstance(v, str) else v if v is not None else F.lit(None)).cast(kind).alias(name))
    return rows.select(*cols)


def kind(col: str = "type") -> Column:
    return upper(col)


def is_credit() -> Column:
    return kind().isin(*CREDITS)


def outstanding() -> Column:
    """What a document still owes: amount_due, else amount less what was paid and allocated."""
    return F.coalesce("amount_due", F.col("amount") - F.coalesce("amount_paid", F.lit(0)) - F.coalesce("allocated_amount", F.lit(0)))


def is_paid() -> Column:
    return F.coalesce((upper("status") == "PAID") | ((F.col("amount_due") == 0) & (F.col("amount") > 0)), F.lit(False))


def lines(txn: DataFrame, *carry: str) -> DataFrame:
    """A row for each line; a document without lines gives one row of its header's codes and amount, its line_no null."""
    keep = [c for c in dict.fromkeys((*DOC, "seq", "type", "contact_id", "vendor_name", *carry))]
    l_ = F.posexplode_outer("line_items").alias("l_pos", "l")
    rows = txn.select(*keep, F.coalesce(F.size("line_items") > 0, F.lit(False)).alias("l_has"), F.col("account_code").alias("h_account"), F.col("tax_code").alias("h_tax"), F.col("amount").alias("h_amount"), F.col("description").alias("h_text"), l_)
    pick = lambda field, head: F.when(F.col("l_has"), F.col(f"l.{field}")).otherwise(F.col(head))
    return rows.select(*keep, F.when(F.col("l_has"), F.col("l_pos") + 1).cast("int").alias("line_no"), pick("account_code", "h_account").alias("account"), pick("tax_code", "h_tax").alias("tax"), pick("amount", "h_amount").alias("line_amount"), pick("description", "h_text").alias("line_text"))


def with_account(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds acct (stripped code), account_name and account_type; of accounts that share a code, the last by name and type counts."""
    # a chart of accounts has a row for each account: Spark broadcasts it when its size is below the session's threshold
    coa = accounts.groupBy(F.col("company_id").alias("a_co"), strip("code").alias("a_code")).agg(F.max(F.struct("name", "type")).alias("a"))
    acct = strip("account")
    return rows.join(coa, (F.col("company_id") == F.col("a_co")) & (acct == F.col("a_code")), "left").select(*rows.columns, acct.alias("acct"), F.col("a.name").alias("account_name"), upper("a.type").alias("account_type"))


def first_line(rows: DataFrame, *cols: str) -> DataFrame:
    """The first of each document's rows by line_no, as one row with the named columns."""
    best = F.min(F.struct("line_no", *cols)).alias("f")
    return rows.groupBy(*DOC).agg(best).select(*DOC, F.col("f.line_no").alias("line_no"), *(F.col(f"f.{c}").alias(c) for c in cols))


def dominant(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, top_<value> and n_values: the most frequent value of each group (of equals the first by seq and line), and how many differ.

    A row's place (seq, then line) is one number, as rows are counted by hash only where what is kept for a group has a fixed width: a struct would have them sorted first. Rows without a seq stand first, and lose ties."""
    long = lambda c: F.col(c).cast("decimal(20,0)")
    width, unplaced = F.lit(Decimal(1 << 32)), F.lit(Decimal(-(10**19)))  # below any seq
    place = F.coalesce(long("seq"), unplaced) * width + F.coalesce("line_no", F.lit(0)).cast("decimal(10,0)")
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("o"))
    without = F.col("o") < F.lit(Decimal(-(1 << 95) - (1 << 40)))  # a long times the width, and a line, are never below
    late = F.col("o") + F.when(without, F.lit(Decimal(10**30))).otherwise(F.lit(Decimal(0)))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -late)).alias(f"top_{value}"), F.count(F.lit(1)).alias("n_values"))


def days_old(d: Column | str, as_of: date) -> Column:
    return F.datediff(F.lit(as_of), d)
