"""Rules on lines, accounts and tax codes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import next_year_end, period, whole_months
from ..functions.text import blank, contact_key, has_any, no_vat, payee_key, phrase, strip, upper
from .base import DOC, EXPENSE_TYPES, MONEY_IN, MONEY_OUT, PURCHASES, PURE_EXPENSE, REVENUE_TYPES, SALES, Settings, dominant, first_line, flags, is_credit, is_listed, kind, lines, small, with_account
from .medians import exact_medians
from .phrases import found

# Words in names and codes.
NO_TAX_BY_NATURE = ("wage", "salary", "salaries", "payroll", "employer ni", "national insurance", "paye", "director remuneration", "pension", "depreciat", "amortis", "corporation tax", "income tax", "donation", "rates", "grant", "dividend")
OUTPUT_WORDS = ("OUTPUT", "SALES", "ZERORATEDSUPPLIES", "EXEMPTOUTPUT", "GSTONIMPORTS")
INPUT_WORDS = ("INPUT", "PURCHASE", "BASEXCLUSIVE", "EXEMPTINPUT")
VAGUE = ("uncategorised", "uncategorized", "unapplied", "unspecified", "general expense", "general expenses", "sundry", "miscellaneous", "misc expense", "suspense", "to be allocated", "ask my accountant", "other expense", "other debtor", "other creditor")
GENERIC = ("payment", "transfer", "online", "bank", "misc", "miscellaneous", "chq", "cheque", "tfr", "bacs", "dd", "direct debit", "card", "cash", "sundry", "expense")
REVIEWED_NAMES = ("repair", "maintenance", "printing", "stationery")
NOT_CAPITAL = ("repair", "servicing", "service", "maintenance", "amc", "annual maintenance", "fuel", "insurance", "spare part", "spares", "consumable")
CAPITAL_SUPPLIERS = ("currys", "ikea", "john lewis", "screwfix", "toolstation", "wickes", "b&q", "rs components", "costco", "dell", "hp", "apple", "lenovo", "canon", "ricoh", "xerox", "cisco", "siemens", "bosch", "jcb", "ford", "mercedes", "volkswagen", "toyota")
#: Words for things that last; a parameter of capital_review, as trades differ.
CAPITAL_WORDS = ("laptop", "computer", "server", "printer", "monitor", "furniture", "desk", "chair", "machine", "machinery", "equipment", "vehicle", "van", "car", "tool", "phone", "camera", "refurbishment", "installation", "software licence")


def low_cost_assets(txn: DataFrame, accounts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every line on a fixed-asset account below the limit; credit notes aside."""
    rows = settings.joined(with_account(lines(txn.where(~is_credit())), accounts))
    hit = rows.where(F.col("account_type").isin("FIXED", "FIXEDASSET") & (F.abs("line_amount") > 0) & (F.abs("line_amount") < settings.value("low_cost_limit")))
    return flags(hit, "low_cost_fixed_asset", "medium", line_no=F.col("line_no"), current_code=F.col("acct"))


def capital_catalogue(spark: SparkSession, words: tuple = CAPITAL_WORDS) -> DataFrame:
    """(kind, phrase): the catalogue that capital_review takes where none is given."""
    kinds = (("capital", words), ("exclusion", NOT_CAPITAL), ("supplier", CAPITAL_SUPPLIERS))
    return small(spark, [(kind, w) for kind, phrases in kinds for w in phrases], "kind string, phrase string")


def capital_review(txn: DataFrame, accounts: DataFrame, settings: Settings = Settings(), words: tuple = CAPITAL_WORDS, catalogue: DataFrame | None = None) -> DataFrame:
    """Every large line of expense that may be a purchase of something lasting: by account, by a phrase, or by supplier; upkeep isn't.

    catalogue: (kind, phrase) with the kinds capital, exclusion and supplier, for a trade's own phrases; words are the capital ones where it isn't given. The reason is the capital phrase found, else
    the supplier, else account."""
    rows = with_account(lines(txn.where(kind().isin("ACCPAY", "SPEND", "MANJOURNAL")), "description", "reference"), accounts)
    rows = settings.joined(rows.where(F.col("account_type").isin(*PURE_EXPENSE)))
    codes = settings.value("monitored_accounts")
    rows = rows.where(F.abs("line_amount") > settings.value("capital_min")).withColumn("watched", F.when(F.size(codes) > 0, is_listed(F.upper("acct"), codes)).otherwise(has_any("account_name", REVIEWED_NAMES)))
    key = [*DOC, "line_no"]
    both = F.array(F.struct(F.concat_ws(" ", "description", "reference", "vendor_name", "line_text").alias("text"), F.lit(False).alias("name")), F.struct(F.col("vendor_name").alias("text"), F.lit(True).alias("name")))
    texts = rows.select(*key, F.explode(both).alias("x")).select(*key, "x.text", "x.name")
    hits = found(texts, [*key, "name"], catalogue if catalogue is not None else capital_catalogue(txn.sparkSession, words)).where(F.col("name") == (F.col("kind") == "supplier"))
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("phrase"))).alias(k)
    hits = hits.groupBy(*[F.col(k).alias(f"p_{k}") for k in key]).agg(of("capital"), of("exclusion"), of("supplier"))
    same = (F.col("company_id") == F.col("p_company_id")) & (F.col("transaction_id") == F.col("p_transaction_id")) & F.col("line_no").eqNullSafe(F.col("p_line_no"))
    hit = rows.join(hits, same, "left").where(F.col("exclusion").isNull())
    hit = hit.where(F.coalesce("watched", F.lit(False)) | F.col("capital").isNotNull() | F.col("supplier").isNotNull())
    return flags(hit, "capital_item_review", "medium", line_no=F.col("line_no"), current_code=F.col("acct"), reason=F.coalesce("capital", "supplier", F.lit("account")))


def _prepaid(txn: DataFrame, accounts: DataFrame, settings: Settings) -> DataFrame:
    """Every large line of expense whose term runs past the year-end by a whole month: year_end, months after it and in total, the prepaid part."""
    rows = settings.joined(with_account(lines(txn.where(~is_credit()), "date", "description", "reference"), accounts).where(F.col("account_type").isin(*PURE_EXPENSE)))
    rows = rows.where(F.abs("line_amount") > settings.value("prepayment_min"))
    rows = rows.withColumn("p", period(F.concat_ws(" ", "line_text", "description", "reference"), "date")).where("p.start is not null")
    rows = rows.withColumn("year_end", next_year_end("p.start", settings.value("year_end_month"), settings.value("year_end_day"))).withColumn("after", whole_months("year_end", "p.end"))
    rows = rows.withColumn("total", F.greatest(F.rint(F.datediff("p.end", "p.start") / 30.44), F.lit(1)))
    hit = rows.where((F.col("p.end") > F.col("year_end")) & (F.col("after") >= 1))
    prepaid = F.bround(F.col("line_amount") * F.least(F.col("after"), F.col("total")).cast("decimal(10,0)") / F.col("total").cast("decimal(10,0)"), 2)
    return hit.withColumn("prepaid", prepaid.cast("decimal(12,2)"))


def prepayments(txn: DataFrame, accounts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every large line of expense whose term runs past the year-end by a whole month: with the prepaid part."""
    return flags(_prepaid(txn, accounts, settings), "prepayment_review", "medium", line_no=F.col("line_no"), current_code=F.col("acct"), reason=F.col("prepaid").cast("string"))


def releases(txn: DataFrame, accounts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(company_id, transaction_id, line_no, n, month, release, remaining): what is released of each prepayment in the months after the year-end.

    Each month takes the line's amount over all its months; the last one leaves nothing, and none less than nothing. Months are labelled `Jan 2024`."""
    rows = _prepaid(txn, accounts, settings).withColumn("release", F.bround(F.col("line_amount") / F.col("total").cast("decimal(10,0)"), 2).cast("decimal(12,2)"))
    each = rows.select(*DOC, "line_no", "year_end", "after", "prepaid", "release", F.explode(F.sequence(F.lit(1), F.col("after").cast("int"))).alias("n"))
    left = F.when(F.col("n") == F.col("after"), F.lit(0)).otherwise(F.greatest(F.col("prepaid") - F.col("release") * F.col("n"), F.lit(0)))
    return each.select(*DOC, "line_no", "n", F.date_format(F.add_months("year_end", F.col("n")), "MMM yyyy").alias("month"), "release", left.cast("decimal(12,2)").alias("remaining"))


def unusual_payments(txn: DataFrame, accounts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Payments of unclear purpose, large ones to rare payees, and lines far above their account's mean; the first reason that holds.

    The mean is over all payment lines of the account, of which there must be account_min_count."""
    paid = txn.where(kind().isin("ACCPAY", "SPEND")).withColumn("payee", payee_key())
    seen = paid.groupBy(F.col("company_id").alias("s_co"), F.col("payee").alias("s_payee")).agg(F.count(F.lit(1)).alias("n_seen"))
    texts = F.concat_ws(" ", "description", "reference", F.array_join(F.transform("line_items", lambda x: x["description"]), " "))
    unclear = (F.regexp_replace(texts, r"(?U)\s", "") == "") | F.lower(F.regexp_replace(strip("description"), r"(?U)\s+", " ")).isin(*GENERIC)
    known = settings.joined(paid.join(seen, (F.col("company_id") == F.col("s_co")) & (F.col("payee") == F.col("s_payee"))))
    large = (F.abs(F.coalesce("amount", F.lit(0))) >= settings.value("large_payment")) & (F.col("n_seen") <= settings.value("one_off_max"))
    reason = F.when(unclear & (F.col("n_seen") == 1), "unidentified_supplier").when(unclear, "unclear_description").when(large, "one_off_supplier")
    rows = with_account(lines(paid), accounts).where((F.col("acct") != "") & F.col("account_type").isin(*PURE_EXPENSE) & F.col("line_amount").isNotNull())
    usual = rows.groupBy(F.col("company_id").alias("u_co"), F.col("acct").alias("u_acct")).agg(F.sum(F.abs("line_amount")).alias("total"), F.count(F.lit(1)).alias("n")).where(F.col("total") > 0)
    above = settings.joined(rows.join(usual, (F.col("company_id") == F.col("u_co")) & (F.col("acct") == F.col("u_acct")))).where(F.col("n") >= settings.value("account_min_count"))
    above = above.where(F.abs("line_amount") * F.col("n") >= F.col("total") * settings.value("account_multiple").cast("decimal(6,2)"))
    first = first_line(above, "acct")
    all_ = known.select(*DOC, reason.alias("why")).join(first, DOC, "left").withColumn("r", F.coalesce("why", F.when(F.col("acct").isNotNull(), "large_vs_account"))).where("r is not null")
    return flags(all_, "unusual_payment", "medium", line_no=F.when(F.col("why").isNull(), F.col("line_no")), current_code=F.when(F.col("why").isNull(), F.col("acct")), reason=F.col("r"))


def _tax_missing(txn: DataFrame, accounts: DataFrame, types: tuple, issue: str, exempt: tuple, settings: Settings) -> DataFrame:
    rows = with_account(lines(txn), accounts).where((F.col("acct") != "") & F.col("account_type").isin(*types) & no_vat("tax"))
    if exempt:
        rows = rows.where(~has_any("account_name", exempt))
    rows, contacts = settings.joined(rows), settings.value("ignored_contacts")
    rows = rows.where(~is_listed(F.upper("acct"), settings.value("ignored_accounts")) & ~is_listed(upper("contact_id"), contacts) & ~is_listed(upper("vendor_name"), contacts))
    return flags(first_line(rows.withColumn("code", strip("tax")), "code"), issue, "medium", line_no=F.col("line_no"), current_code=F.col("code"))


def purchase_tax_missing(txn: DataFrame, accounts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return _tax_missing(txn, accounts, EXPENSE_TYPES, "purchase_tax_missing", NO_TAX_BY_NATURE, settings)


def sales_tax_missing(txn: DataFrame, accounts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return _tax_missing(txn, accounts, REVENUE_TYPES, "sales_tax_missing", (), settings)


def _wrong_side(txn: DataFrame, accounts: DataFrame, rates: DataFrame, types: tuple, flag_col: str, words: tuple, issue: str) -> DataFrame:
    """The first line whose code can't apply to the document's side: by the rate's flag, and where that is unknown by the code's words."""
    side = rates.groupBy(F.col("company_id").alias("t_co"), upper("code").alias("t_code")).agg(F.min(flag_col).alias("applies"))
    rows = with_account(lines(txn.where(kind().isin(*types))), accounts).withColumn("code", upper("tax")).where("code <> ''")
    rows = rows.join(side, (F.col("company_id") == F.col("t_co")) & (F.col("code") == F.col("t_code")), "left")
    worded = F.lit(False)
    for w in words:
        worded = worded | F.col("code").contains(w)
    revenue = F.coalesce(F.col("account_type"), F.lit("")).isin(*REVENUE_TYPES)
    account_fits = ~revenue if flag_col == "applies_to_expenses" else revenue | (F.coalesce(F.col("account_type"), F.lit("")) == "")
    hit = rows.where(account_fits & F.when(F.col("applies").isNotNull(), ~F.col("applies")).otherwise(worded))
    return flags(first_line(hit, "code"), issue, "high", line_no=F.col("line_no"), current_code=F.col("code"))


def sales_tax_on_bills(txn: DataFrame, accounts: DataFrame, rates: DataFrame) -> DataFrame:
    return _wrong_side(txn, accounts, rates, PURCHASES + MONEY_OUT, "applies_to_expenses", OUTPUT_WORDS, "sales_tax_on_bills")


def purchase_tax_on_invoices(txn: DataFrame, accounts: DataFrame, rates: DataFrame) -> DataFrame:
    return _wrong_side(txn, accounts, rates, SALES + MONEY_IN, "applies_to_revenue", INPUT_WORDS, "purchase_tax_on_invoices")


def _several_codes(txn: DataFrame, value: str, issue: str, code, settings: Settings | None = None) -> DataFrame:
    """Contacts whose lines carry two codes or more: their documents, at the first line that isn't the contact's usual code.

    A document travels as one row with the codes of its lines; rows that repeat a document count as one."""
    item = lambda n, c: F.struct(n.cast("int").alias("line_no"), code(c).alias("code"))
    items = F.when(F.size("line_items") > 0, F.transform("line_items", lambda x, i: item(i + 1, x[f"{value}_code"]))).otherwise(F.array(item(F.lit(None), F.col(f"{value}_code"))))
    docs = txn.select(*DOC, "seq", "vendor_name", contact_key().alias("who"), F.filter(items, lambda x: x["code"] != "").alias("items")).where(F.size("items") > 0)
    if settings is not None:
        docs, skip = settings.joined(docs), settings.value("account_whitelist")
        docs = docs.where(~is_listed(F.upper("who"), skip) & ~is_listed(upper("vendor_name"), skip))
    usual = dominant(docs.select("company_id", "who", "seq", F.explode("items").alias("x")).select("company_id", "who", "seq", "x.*"), ["company_id", "who"], "code").where("n_values >= 2")
    odd = docs.join(usual, ["company_id", "who"]).select(*DOC, "top_code", F.get(F.filter("items", lambda x: x["code"] != F.col("top_code")), F.lit(0)).alias("x")).where("x is not null")
    # dealt first, as a document has one row here but for repeats: nothing to combine, and so nothing to sort, before
    first = first_line(odd.select(*DOC, "x.*", "top_code").repartition(*DOC), "code", "top_code")
    return flags(first, issue, "medium", line_no=F.col("line_no"), current_code=F.col("code"), suggested_code=F.col("top_code"))


def several_tax_codes(txn: DataFrame) -> DataFrame:
    return _several_codes(txn, "tax", "multi_tax_code_supplier", upper)


def several_accounts(txn: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return _several_codes(txn, "account", "multi_account_supplier", strip, settings)


def _unexpected(txn: DataFrame, defaults: DataFrame, value: str, sales: str, purchases: str, issue: str, code) -> DataFrame:
    known = defaults.select(F.col("company_id").alias("d_co"), F.col("contact_id").alias("d_id"), F.col(sales).alias("d_s"), F.col(purchases).alias("d_p"))
    rows = txn.join(known, (F.col("company_id") == F.col("d_co")) & (F.col("contact_id") == F.col("d_id")))
    expected = F.when(kind().isin(*SALES, *MONEY_IN), F.col("d_s")).when(kind().isin(*PURCHASES, *MONEY_OUT), F.col("d_p"))
    rows = rows.select(*DOC, code(expected).alias("want"), code(value).alias("have"))
    return flags(rows.where("want <> '' and have <> '' and want <> have"), issue, "medium", current_code=F.col("have"), suggested_code=F.col("want"))


def unexpected_tax(txn: DataFrame, defaults: DataFrame) -> DataFrame:
    """Header tax codes that differ from the contact's default for the side, in any case."""
    return _unexpected(txn, defaults, "tax_code", "sales_tax", "purchase_tax", "unexpected_tax_code", upper)


def unexpected_account(txn: DataFrame, defaults: DataFrame) -> DataFrame:
    return _unexpected(txn, defaults, "account_code", "sales_account", "purchase_account", "unexpected_account", strip)


def wrong_direction(txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """Header accounts of a type that doesn't belong to the document's side."""
    rows = with_account(txn.where(kind().isin(*SALES, *PURCHASES)).withColumn("account", F.col("account_code")), accounts).where(F.col("account_type") != "")
    fits = F.when(kind().isin(*SALES), F.col("account_type").isin(*REVENUE_TYPES)).otherwise(F.col("account_type").isin(*EXPENSE_TYPES))
    return flags(rows.where(~fits), "wrong_direction_account", "high", current_code=F.col("acct"))


def misallocated(txn: DataFrame, accounts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The first line of some size on an account for things nobody sorted."""
    vague = F.coalesce(has_any("account_name", VAGUE), F.lit(False)) | is_listed(F.upper("acct"), settings.value("vague_codes"))
    rows = settings.joined(with_account(lines(txn), accounts)).where((F.col("acct") != "") & (F.abs("line_amount") >= settings.value("misallocated_min")) & vague)
    return flags(first_line(rows, "acct"), "misallocated_item", "medium", line_no=F.col("line_no"), current_code=F.col("acct"))


def outliers(txn: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents of some multiple of their contact's exact median, which takes a number of documents; with the contact's usual account."""
    rows = txn.where(F.col("amount") > 0).withColumn("who", contact_key())
    usual = exact_medians(rows, ["company_id", "who"], "amount")
    coded = dominant(rows.where(~blank("account_code")).select("company_id", "who", "seq", F.lit(0).alias("line_no"), strip("account_code").alias("code")), ["company_id", "who"], "code")
    rows = settings.joined(rows.join(usual, ["company_id", "who"])).where(F.col("n") >= settings.value("outlier_min_count"))
    hit = rows.where((F.col("amount") >= settings.value("outlier_multiple") * F.col("mid")) & (F.col("amount") >= settings.value("outlier_min_amount"))).join(coded, ["company_id", "who"], "left")
    # without a usual account the document's own is blank too; that it is read here as well lets Spark deal and number the lines once for both
    code = F.coalesce("top_code", F.nullif(strip("account_code"), F.lit("")))
    return flags(hit, "amount_outlier", "medium", confidence=F.lit(0.85), current_code=code, reason=F.round(F.col("amount").cast("double") / F.col("mid"), 2).cast("string"))


def accruals(txn: DataFrame, accounts: DataFrame, year_end: date, predefined: tuple = ()) -> DataFrame:
    """Expense accounts that lack months of the year up to year_end: (company_id, account, reason, severity, month, run, average).

    An account recurs if eight of the twelve months have positive lines, or by its name. Gaps before the last month count for the former:
    runs of two or more are large gaps. An empty last month counts for both: if nothing follows, as not yet accrued."""
    words = predefined or ("light & heat", "light and heat", "heat", "heating", "electricity", "electric", "gas", "rates", "water", "accountancy", "accounting", "audit", "software", "subscription", "telephone", "internet", "broadband", "phone", "mobile", "rent", "insurance")
    low = F.trunc(F.add_months(F.lit(year_end), -11), "month")
    rows = with_account(lines(txn.where(F.col("date") >= low), "date"), accounts).where(F.col("account_type").isin(*PURE_EXPENSE) & (F.col("line_amount") > 0))
    after = rows.where(F.col("date") > F.lit(year_end)).select("company_id", "acct").distinct().withColumn("after", F.lit(True))
    rows = rows.where(F.col("date") <= F.lit(year_end))
    idx = (F.year("date") * 12 + F.month("date") - F.year(low) * 12 - F.month(low)).cast("int")
    months = rows.groupBy("company_id", "acct", idx.alias("m")).agg(F.sum("line_amount").alias("spent"))
    accs = months.groupBy("company_id", "acct").agg(F.sort_array(F.collect_set("m")).alias("have"), F.sum("spent").alias("total"))
    named = accounts.where(upper("type").isin(*PURE_EXPENSE) & (phrase("name", words, plural=False) != "")).select("company_id", strip("code").alias("acct")).distinct().withColumn("named", F.lit(True))
    both = accs.join(named, ["company_id", "acct"], "full").withColumn("have", F.coalesce("have", F.array().cast("array<int>"))).withColumn("regular", F.size("have") >= 8)
    both = both.join(after, ["company_id", "acct"], "left").where(F.col("regular") | F.coalesce("named", F.lit(False)))
    missing = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda m: ~F.array_contains("have", m))
    spine = both.select("company_id", "acct", "regular", F.coalesce("after", F.lit(False)).alias("after"), "total", F.size("have").alias("n_have"), F.posexplode(missing).alias("pos", "m"))
    runs = spine.groupBy("company_id", "acct", "regular", "after", "total", "n_have", (F.col("m") - F.col("pos")).alias("island")).agg(F.min("m").alias("start"), F.max("m").alias("last"), F.count(F.lit(1)).alias("run"))
    final = F.col("last") == 11
    runs = runs.where(F.col("regular") | final)
    inner = F.when(final, F.col("run") - 1).otherwise(F.col("run"))
    pieces = runs.select("company_id", "acct", "total", "n_have", F.explode(F.filter(F.array(
        F.when(F.col("regular") & (inner > 0), F.struct(F.when(inner >= 2, "large_gap").otherwise("missing_month").alias("reason"), F.when(inner >= 2, "high").otherwise("medium").alias("severity"), F.col("start").alias("m"), inner.cast("int").alias("run"))),
        F.when(final, F.struct(F.when(F.col("after"), "post_year_cutoff").otherwise("final_month_missing").alias("reason"), F.lit("high").alias("severity"), F.lit(11).alias("m"), F.lit(1).alias("run"))),
    ), lambda x: x.isNotNull())).alias("g"))
    return pieces.select("company_id", F.col("acct").alias("account"), "g.reason", "g.severity", F.date_format(F.add_months(low, F.col("g.m")), "yyyy-MM").alias("month"), "g.run", F.bround(F.col("total") / F.when(F.col("n_have") > 0, F.col("n_have")), 2).cast("decimal(18,2)").alias("average"))
