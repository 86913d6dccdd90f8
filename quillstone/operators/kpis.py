"""Financial KPIs over long, typed frames; money is decimal, and is rounded where a figure is shown."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import year_month_ends
from ..functions.classify import outgoing_category
from ..functions.text import has_any, label_code, label_name, strip, upper

MONEY = "decimal(18,2)"
# Types of liability accounts.
LIABILITY_TYPES = ("CURRLIAB", "TERMLIAB", "LIABILITY", "PAYGLIABILITY")
#: Outgoings in the order in which cash pays them, with their weight in the score: short-term ones count threefold.
OUTGOINGS = {"suppliers": 3, "net_wages": 3, "paye_nic": 3, "pension": 3, "credit_cards": 3, "vat": 3, "corporation_tax": 1, "loans_other": 1}
BASES = ("none", "previous_month", "average_3", "average_6", "average_12", "same_month_last_year", "budget", "manual")


def profitability(sections: DataFrame) -> DataFrame:
    """(company_id, period, income, cogs, gross, expenses, other, net) from section totals: company_id, period, title, value.

    Titles say what a section is: Income..., Less Cost..., Less Operating..., Plus Other..."""
    t = F.lower(F.trim("title"))
    part = F.when(t.startswith("income") | t.startswith("revenue"), "income").when(t.startswith("less cost"), "cogs").when(t.startswith("plus"), "other").when(t.startswith("less"), "expenses")
    of = lambda p: F.coalesce(F.sum(F.when(F.col("part") == p, F.col("value"))), F.lit(0)).cast(MONEY).alias(p)
    sums = sections.withColumn("part", part).groupBy("company_id", "period").agg(*map(of, ("income", "cogs", "expenses", "other")))
    gross = F.col("income") - F.col("cogs")
    return sums.select("company_id", "period", "income", "cogs", gross.cast(MONEY).alias("gross"), "expenses", "other", (gross - F.col("expenses") + F.col("other")).cast(MONEY).alias("net"))


def position(labels: DataFrame) -> DataFrame:
    """Working capital, ratios and net assets from balance sheet labels: company_id, label, pos, value. The last of equal labels counts; a ratio over 0 is null."""
    last = labels.groupBy("company_id", F.lower(F.trim("label")).alias("l")).agg(F.max_by("value", "pos").alias("v"))
    get = lambda *names: F.coalesce(*(F.nullif(F.max(F.when(F.col("l") == n, F.col("v"))), F.lit(0)) for n in names), F.lit(0)).cast(MONEY)
    s = last.groupBy("company_id").agg(get("total current assets").alias("ca"), get("total current liabilities").alias("cl"), get("total assets").alias("a"), get("total liabilities").alias("tl"), get("net assets", "total net assets").alias("na"), get("total bank", "bank").alias("cash"))
    ratio = lambda x, y: F.round(F.col(x).cast("double") / F.nullif(F.col(y), F.lit(0)).cast("double"), 4)
    return s.select("company_id", F.col("ca").alias("current_assets"), F.col("cl").alias("current_liabilities"), (F.col("ca") - F.col("cl")).cast(MONEY).alias("working_capital"), ratio("ca", "cl").alias("current_ratio"), ratio("cash", "cl").alias("cash_ratio"), ratio("tl", "a").alias("debt_ratio"), F.col("na").alias("net_assets"))


def corporation_tax(profit: Column | str) -> Column:
    """19 % up to 50,000, 25 % from 250,000, marginal relief between; nothing on a loss."""
    p = (F.col(profit) if isinstance(profit, str) else profit).cast("decimal(18,2)")
    relief = p * F.lit("0.25").cast("decimal(4,2)") - (F.lit(250000) - p) * 3 / 200
    tax = F.when(p <= 0, F.lit(0)).when(p <= 50000, p * F.lit("0.19").cast("decimal(4,2)")).when(p >= 250000, p * F.lit("0.25").cast("decimal(4,2)")).otherwise(relief)
    return F.round(tax, 2).cast(MONEY)


def directors_loans(balances: DataFrame) -> DataFrame:
    """Trial balance rows that are a director's loan account: company_id, label "Name (code)", debit, credit. Overdrawn: a debit balance."""
    rows = balances.where(has_any("label", ("director", "dla")) & has_any("label", ("loan", "dla", "current account")))
    balance = (F.coalesce("debit", F.lit(0)) - F.coalesce("credit", F.lit(0))).cast(MONEY)
    return rows.select("company_id", label_code("label").alias("code"), label_name("label").alias("name"), balance.alias("balance"), (balance > 0).alias("overdrawn"))


def bank_reconciliation(bank: DataFrame) -> DataFrame:
    """One row a company: all lines, those unreconciled and their value, and the latest dates."""
    open_ = ~F.coalesce("reconciled", F.lit(False))
    return bank.groupBy("company_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(open_).alias("unreconciled"), F.coalesce(F.sum(F.when(open_, F.abs("amount"))), F.lit(0)).cast(MONEY).alias("unreconciled_value"), F.max(F.when(~open_, F.col("date"))).alias("last_reconciled"), F.max("date").alias("most_recent"))


def unreconciled_accounts(bank: DataFrame) -> DataFrame:
    """Open receipts and payments by bank account; accounts without any are left out."""
    open_ = ~F.coalesce("reconciled", F.lit(False))
    rows = bank.groupBy("company_id", "bank_account").agg(F.count_if(open_ & (F.col("type") == "RECEIVE")).alias("received"), F.count_if(open_ & (F.col("type") == "SPEND")).alias("spent"))
    return rows.where("received + spent > 0")


def reconciliation_summary(ledger: DataFrame, bank: DataFrame) -> DataFrame:
    """Ledger balance, open receipts and payments of each bank account, and the statement balance they imply. ledger: company_id, bank_account, balance."""
    open_ = bank.where(~F.coalesce("reconciled", F.lit(False)) & ~F.coalesce("status", F.lit("")).isin("VOIDED", "DELETED"))
    sums = open_.groupBy("company_id", "bank_account").agg(F.sum(F.when(F.col("type") == "RECEIVE", F.col("amount")).otherwise(0)).alias("received"), F.sum(F.when(F.col("type") == "SPEND", F.col("amount")).otherwise(0)).alias("spent"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast(MONEY)
    return ledger.join(sums, ["company_id", "bank_account"], "left").select("company_id", "bank_account", z("balance").alias("balance"), z("received").alias("received"), z("spent").alias("spent"), (z("balance") + z("received") - z("spent")).cast(MONEY).alias("statement"))


def balance_gaps(ledger: DataFrame, statements: DataFrame, tolerance: float = 0.01, excluded: tuple = (), marked: DataFrame | None = None) -> DataFrame:
    """Accounts whose statement differs from the ledger, and whether that is accepted. marked: company_id, bank_account."""
    rows = ledger.join(statements, ["company_id", "bank_account"]).withColumn("gap", (F.col("statement") - F.col("balance")).cast(MONEY)).where(F.abs("gap") > tolerance)
    if excluded:
        rows = rows.where(~F.col("bank_account").isin(*excluded))
    if marked is not None:
        rows = rows.join(marked.select("company_id", "bank_account").distinct(), ["company_id", "bank_account"], "left_anti")
    return rows.select("company_id", "bank_account", "balance", "statement", "gap")


def opening_differences(filed: DataFrame, ledger: DataFrame, least: float = 1) -> DataFrame:
    """Net assets as filed (manual entries first) against the ledger's, by period: filed: company_id, period_end, source, value."""
    rank = F.when(F.col("source") == "manual", 0).otherwise(1)
    one = filed.groupBy("company_id", "period_end").agg(F.min_by("value", F.struct(rank, "source")).alias("filed"))
    rows = one.join(ledger.select("company_id", "period_end", F.col("value").alias("ledger")), ["company_id", "period_end"]).withColumn("difference", (F.col("filed") - F.col("ledger")).cast(MONEY))
    return rows.where(F.abs("difference") >= least)


def late_documents(docs: DataFrame, period_end: date, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Documents dated up to a period's end but posted after it, newest posting first; a page if a limit is given."""
    rows = docs.where((F.col("date") <= F.lit(period_end)) & (F.col("posted_date") > F.lit(period_end)))
    return rows if limit is None else rows.orderBy(F.desc_nulls_last("posted_date"), "transaction_id").offset(offset).limit(limit)


def outgoings(liabilities: DataFrame, cash: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """Expected outgoings by category in the order of payment, and whether cash covers each with all before it.

    liabilities: company_id, category, owed; cash: company_id, cash; estimates: company_id, tax (the larger of it and the booked tax counts)."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("category"), F.lit(i).alias("ord"), F.lit(w).alias("weight")) for i, (k, w) in enumerate(OUTGOINGS.items())))).alias("k")
    grid = cash.select("company_id", "cash", kinds).select("company_id", "cash", "k.*")
    sums = liabilities.groupBy("company_id", "category").agg(F.greatest(F.sum("owed"), F.lit(0)).cast(MONEY).alias("owed"))
    rows = grid.join(sums, ["company_id", "category"], "left").withColumn("amount", F.coalesce("owed", F.lit(0)).cast(MONEY))
    if estimates is not None:
        rows = rows.join(estimates, "company_id", "left").withColumn("amount", F.when(F.col("category") == "corporation_tax", F.greatest("amount", F.coalesce("tax", F.lit(0)))).otherwise(F.col("amount")).cast(MONEY))
    up_to = Window.partitionBy("company_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)  # eight rows a company
    rows = rows.withColumn("cumulative", F.sum("amount").over(up_to).cast(MONEY))
    return rows.select("company_id", "category", "ord", "weight", "cash", "amount", "cumulative", (F.col("cash") >= F.col("cumulative")).alias("can_pay"))


def cash_score(rows: DataFrame) -> DataFrame:
    """0 to 100 from outgoings(): weighted coverage of what is owed when cash is spent in order; 100 if nothing is."""
    left = F.greatest(F.greatest("cash", F.lit(0)) - (F.col("cumulative") - F.col("amount")), F.lit(0))
    covered = F.least("amount", left).cast("double") / F.col("amount").cast("double")
    owed = F.when(F.col("amount") > 0, F.col("weight"))
    s = rows.groupBy("company_id").agg(F.sum(F.when(F.col("amount") > 0, F.col("weight") * covered)).alias("x"), F.sum(owed).alias("w"), F.sum(F.col("weight") * F.col("amount")).cast(MONEY).alias("weighted_outgoings"))
    score = F.coalesce(F.round(F.col("x") / F.col("w") * 100, 1), F.lit(100.0))
    return s.select("company_id", score.alias("score"), F.when(score >= 75, "strong").when(score >= 50, "moderate").when(score >= 25, "weak").otherwise("critical").alias("rating"), "weighted_outgoings")


def movements(balances: DataFrame) -> DataFrame:
    """Change of each period's balance from the one before: company_id, period, balance."""
    w = Window.partitionBy("company_id").orderBy("period")
    return balances.select("company_id", "period", "balance", (F.col("balance") - F.lag("balance").over(w)).alias("movement"))


def sales_targets(sales: DataFrame, basis: str = "average_3", percent: float = 0, manual: float | None = None) -> DataFrame:
    """A target and variance for each period: sales: company_id, period, sales (and budget, for that basis). Early periods that lack history have none."""
    w = Window.partitionBy("company_id").orderBy("period")  # a row for each month of a company
    base = {
        "none": lambda: F.lit(None), "manual": lambda: F.lit(manual), "budget": lambda: F.col("budget"), "previous_month": lambda: F.lag("sales").over(w), "same_month_last_year": lambda: F.lag("sales", 12).over(w),
    }.get(basis) or (lambda: F.round(F.avg("sales").over(w.rowsBetween(-int(basis.rpartition("_")[2]), -1)), 2))
    target = base().cast("double") * (1 if basis == "budget" else 1 + percent / 100)
    rows = sales.withColumn("target", F.round(target, 2))
    return rows.select("company_id", "period", "sales", "target", F.round(F.col("sales").cast("double") - F.col("target"), 2).alias("variance"))


def latest_periods(rows: DataFrame, n: int = 5) -> DataFrame:
    """The last n periods of each company, as charts show them."""
    w = Window.partitionBy("company_id").orderBy(F.desc("period"))
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def prepayment_schedule(items: DataFrame, year_end: date) -> DataFrame:
    """A row for each item and month of the year in which it is released, and its balance carried forward.

    items: company_id, item_id, amount, start, end (both null: unscheduled, and the whole amount is carried). Months are days over 30.44,
    one at least; the monthly part is rounded half up to three places."""
    e = F.lit(year_end)
    months = F.greatest(F.rint(F.datediff("end", "start") / 30.44), F.lit(1)).cast("int")
    rows = items.withColumn("months", months).withColumn("monthly", F.round(F.col("amount") / F.col("months"), 3).cast("decimal(18,3)"))
    gone = (F.year(e) - F.year("start")) * 12 + F.month(e) - F.month("start") + 1
    released = F.least(F.greatest(gone, F.lit(0)), F.col("months"))
    balance = F.when(F.col("months").isNull(), F.col("amount")).otherwise(F.col("amount") - F.col("monthly") * released)
    rows = rows.withColumn("balance", F.round(balance, 3).cast("decimal(18,3)"))
    cells = F.filter(year_month_ends(e), lambda m: (m >= F.last_day("start")) & (m <= F.last_day("end")))
    return rows.select("company_id", "item_id", "amount", "months", "monthly", "balance", F.explode_outer(cells).alias("month"))


def schedule_totals(schedule: DataFrame) -> DataFrame:
    """What each month of a prepayment_schedule releases."""
    return schedule.where("month is not null").groupBy("company_id", "month").agg(F.sum("monthly").cast("decimal(18,3)").alias("released"), F.count(F.lit(1)).alias("items"))


def account_balances(accounts: DataFrame, trial: DataFrame) -> DataFrame:
    """accounts with balance and found_by: the trial balance's by code, else by the account's id, else 0 (found_by code, id or null).

    accounts: company_id, code, account_id and more; trial: company_id, code, account_id, balance, pos. Accounts of blank code are left out; of accounts that share a code the last by name and id stays. Of trial rows that share a
    code, and of those that share an id, the last by pos counts, so that an account has one row whatever repeats."""
    clean = accounts.withColumn("code", strip("code")).withColumn("account_id", strip("account_id")).where("code <> ''")
    rest = [c for c in clean.columns if c not in ("company_id", "code")]
    one = clean.groupBy("company_id", "code").agg(F.max(F.struct(*sorted(rest, key=lambda c: (c != "name", c != "account_id")))).alias("r")).select("company_id", "code", *(F.col(f"r.{c}").alias(c) for c in rest))
    look = lambda key, name: trial.where(strip(key) != "").groupBy(F.col("company_id").alias(f"{name}_co"), strip(key).alias(f"{name}_key")).agg(F.max_by("balance", "pos").alias(name))
    by_code, by_id = look("code", "by_code"), look("account_id", "by_id")
    rows = one.join(by_code, (F.col("company_id") == F.col("by_code_co")) & (F.col("code") == F.col("by_code_key")), "left").join(by_id, (F.col("company_id") == F.col("by_id_co")) & (F.col("account_id") == F.col("by_id_key")), "left")
    found = F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_id").isNotNull(), "id")
    return rows.select(*one.columns, F.coalesce("by_code", "by_id", F.lit(0)).cast(MONEY).alias("balance"), found.alias("found_by"))


def cash_and_liabilities(balances: DataFrame, disregarded: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(company_id, cash) over bank accounts that aren't disregarded, and (company_id, code, category, owed) of liabilities: what outgoings() takes. A liability's credit balance is owed.

    balances: account_balances() with name, type, klass, bank_type, system."""
    bank = upper("type") == "BANK"
    cash = balances.groupBy("company_id").agg(F.coalesce(F.sum(F.when(bank & ~F.col("code").isin(*disregarded), F.col("balance"))), F.lit(0)).cast(MONEY).alias("cash"))
    owing = balances.where(~bank & (upper("type").isin(*LIABILITY_TYPES) | (upper("klass") == "LIABILITY")))
    return cash, owing.select("company_id", "code", outgoing_category("name", "code", "bank_type", "system").alias("category"), (-F.col("balance")).cast(MONEY).alias("owed"))


def snapshot(profit: DataFrame, position_: DataFrame, cash: DataFrame, bank: DataFrame) -> DataFrame:
    """One row a company with the promoted figures of the other KPIs; companies without a profit and loss have none.

    profit: profitability() rows, of which the last period counts; position_, cash (cash_score()) and bank (bank_reconciliation()) may lack companies."""
    last = profit.groupBy("company_id").agg(F.max_by(F.struct("income", "gross", "net", "period"), "period").alias("p"))
    rows = last.join(position_, "company_id", "left").join(cash, "company_id", "left").join(bank, "company_id", "left")
    return rows.select("company_id", "p.period", "p.income", "p.gross", "p.net", corporation_tax(F.col("p.net")).alias("tax"), "working_capital", "current_ratio", F.col("score").alias("cash_score"), F.col("unreconciled").alias("bank_unreconciled"))
