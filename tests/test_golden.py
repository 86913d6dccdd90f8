"""Small cases with known answers, and what rules do with nulls, empty tables and ties."""

import itertools
import os
import random
import re
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.functions import dates, similarity, text
from quillstone.operators import base, catalog, contact_rules, document_rules, duplicate_rules, kpis, line_rules, records, verdicts
from quillstone.operators.base import Settings, lines
from quillstone.sources import mirror
from quillstone.plans import rule_queries
from quillstone.sources import files, reports
from quillstone.streaming import ingest

TXN = "company_id string, seq long, transaction_id string, date date, amount decimal(12,2), contact_id string, vendor_name string, type string, status string, invoice_number string, reference string, amount_due decimal(12,2), account_code string, tax_code string, description string, has_attachments boolean, amount_paid decimal(12,2), allocated_amount decimal(12,2), posted_date date, due_date date, line_items array<struct<line_no:int,account_code:string,tax_code:string,amount:decimal(12,2),description:string>>"
FIELDS = [f.split()[0] for f in TXN.split(", ")]
COA = [("co", "400", "Insurance", "EXPENSE"), ("co", "200", "Sales", "REVENUE")]


def txn(spark, *rows):
    base = {f: None for f in FIELDS} | {"company_id": "co", "type": "ACCPAY", "status": "AUTHORISED", "vendor_name": "V", "contact_id": "c1", "date": date(2024, 1, 1), "amount": Decimal("100.00")}
    made = [base | {"seq": k, "transaction_id": f"t{k}"} | r for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in made], TXN)


@pytest.fixture(scope="module")
def coa(spark):
    return spark.createDataFrame(COA, "company_id string, code string, name string, type string")


def test_lines_fall_back_to_the_header_only_without_lines(spark):
    rows = lines(txn(spark, {"account_code": "1", "line_items": []}, {"account_code": "2", "line_items": None}, {"account_code": "3", "line_items": [(1, None, "T", Decimal("5"), "x")]})).orderBy("transaction_id").collect()
    assert [(r.line_no, r.account) for r in rows] == [(None, "1"), (None, "2"), (1, None)]


def test_invalid_tax_needs_rates_and_no_blanks(spark):
    t = txn(spark, {"tax_code": "ODD"}, {"tax_code": ""}, {"line_items": [(1, "1", None, Decimal("1"), ""), (2, "1", "ODD", Decimal("1"), "")]})
    rates = spark.createDataFrame([("co", "INPUT2")], "company_id string, code string")
    assert [r.transaction_id for r in document_rules.invalid_tax_code(t, rates).collect()] == ["t0"]
    assert document_rules.invalid_tax_code(t, rates.limit(0)).count() == 0
    assert {(r.transaction_id, r.line_no) for r in document_rules.missing_tax(t).collect()} == {("t1", None), ("t2", 1)}


def test_duplicates_same_number_and_recurring(spark):
    t = txn(spark, {"type": "ACCREC", "invoice_number": "A"}, {"type": "ACCREC", "invoice_number": "A"}, {"type": "ACCREC", "invoice_number": "B", "date": date(2024, 1, 20)})
    out = duplicate_rules.same_contact(t, Settings(duplicate_days_window=30, duplicate_min_confidence=0)).collect()
    assert {(r.transaction_id, r.dup_of_id, r.confidence) for r in out if r.confidence == 1.0} == {("t0", "t1", 1.0), ("t1", "t0", 1.0)}
    assert {r.confidence for r in out if "t2" in (r.transaction_id, r.dup_of_id)} == {0.45}
    assert duplicate_rules.same_contact(t.limit(0)).count() == 0


def test_cross_contact_by_name(spark):
    t = txn(spark, {"vendor_name": "Acme Widgets Ltd", "contact_id": "a", "reference": "R1"}, {"vendor_name": "ACME Widgets Limited", "contact_id": "b", "reference": "R1"}, {"vendor_name": "Zebra", "contact_id": "z"})
    assert {(r.transaction_id, r.dup_of_id) for r in duplicate_rules.cross_contact(t).collect()} == {("t0", "t1"), ("t1", "t0")}


def test_missing_month_golden(spark, coa):
    months = [m for m in range(1, 12)]
    t = txn(spark, *({"date": date(2024, m, 5), "account_code": "400", "amount": Decimal("1000.00")} for m in months))
    out = line_rules.accruals(t, coa, date(2024, 12, 31)).collect()
    assert [(r.account, r.reason, r.month, r.average) for r in out] == [("400", "final_month_missing", "2024-12", Decimal("1000.00"))]
    later = t.union(txn(spark, {"date": date(2025, 1, 9), "account_code": "400"}))
    assert [r.reason for r in line_rules.accruals(later, coa, date(2024, 12, 31)).collect()] == ["post_year_cutoff"]


def test_profitability_golden(spark):
    rows = [("co", p, t, Decimal(v)) for t, a, b in (("Income", "1000", "1200"), ("Less Cost of Sales", "400", "500"), ("Less Operating Expenses", "200", "250")) for p, v in (("Jan", a), ("Feb", b))]
    out = kpis.profitability(spark.createDataFrame(rows, "company_id string, period string, title string, value decimal(18,2)")).collect()
    assert {(r.period, r.net) for r in out} == {("Jan", Decimal("400.00")), ("Feb", Decimal("450.00"))}


def test_schedule_golden(spark):
    items = spark.createDataFrame([("co", "i", Decimal("263.50"), date(2025, 11, 1), date(2027, 1, 31)), ("co", "u", Decimal("10"), None, None)], "company_id string, item_id string, amount decimal(12,2), start date, end date")
    out = kpis.prepayment_schedule(items, date(2026, 6, 30)).collect()
    one = [r for r in out if r.item_id == "i"]
    assert (one[0].months, one[0].monthly, one[0].balance, len(one)) == (15, Decimal("17.567"), Decimal("122.964"), 8)
    assert [(r.balance, r.month) for r in out if r.item_id == "u"] == [(Decimal("10.000"), None)]


def test_corporation_tax(spark):
    df = spark.createDataFrame([(Decimal(x),) for x in ("-5", "50000", "100000", "250000")], "p decimal(18,2)").select(kpis.corporation_tax("p").alias("t"))
    assert [r.t for r in df.collect()] == [Decimal("0.00"), Decimal("9500.00"), Decimal("22750.00"), Decimal("62500.00")]


def test_periods_in_text():
    d = pd.Timestamp
    assert dates.period_of("cover 01/10/2024 to 30/09/2025", None) == (d(2024, 10, 1), d(2025, 9, 30))
    assert dates.period_of("Jan 2024 - Mar 2024", None) == (d(2024, 1, 1), d(2024, 3, 31))
    assert dates.period_of("annual licence", d(2024, 2, 1)) == (d(2024, 2, 1), d(2025, 1, 31))
    assert dates.period_of("31/31/2024 lunch", d(2024, 2, 1)) is None and dates.period_of(None, None) is None


def test_text_functions(spark):
    df = spark.createDataFrame([("  A b ", "Acme (12) Trading (400)", "+44 (0)20 7946 0000", "(1,234.50)")], "a string, l string, p string, m string")
    r = df.select(text.strip("a").alias("s"), text.label_code("l").alias("c"), text.label_name("l").alias("n"), text.phone("p").alias("p"), text.amount("m").alias("m"), text.strip(F.lit(None)).alias("e")).first()
    assert (r.s, r.c, r.n, r.m, r.e) == ("A b", "400", "Acme (12) Trading", Decimal("-1234.50"), "")
    assert r.p.endswith("2079460000")


def test_similarity_is_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for a, b in (("kitten", "sitting"), ("", "x"), ("abcabc", "cbacba"), ("same", "same")):
        assert similarity.common(a, b) == slow(a, b)
    assert similarity.ratio("b a", "a b") == 1.0


def test_contacts(spark):
    c = spark.createDataFrame([("co", "1", "Acme Ltd", None, True, False, False), ("co", "2", "ACME Limited", None, True, False, False), ("co", "3", "Acme", "GB1", True, False, True), ("co", "4", None, None, True, True, False)], "company_id string, contact_id string, name string, vat string, is_customer boolean, is_supplier boolean, is_archived boolean")
    out = contact_rules.duplicate_contacts(c).collect()
    assert {(r.contact_id, r.partner_id, r.severity) for r in out} == {("1", "2", "high"), ("2", "1", "high")}
    vats = spark.createDataFrame([("co", "1", "Basket Case", "GB1", True, False, False), ("co", "2", "Basket Cased", "GB2", True, False, False), ("co", "3", "Riverside Bakery", "GB3", True, False, False), ("co", "4", "Riverdale Bakers", "gb3", True, False, False)], c.schema)
    out = contact_rules.duplicate_contacts(vats).collect()
    assert {(r.contact_id, r.vat_status, r.severity) for r in out if r.contact_id in "12"} == {("1", "mismatch", "low"), ("2", "mismatch", "low")}
    assert [r.confidence for r in out] == sorted((r.confidence for r in out), reverse=True)


def _duplicates_by_brute_force(contacts):
    from quillstone.functions.text import FILLERS, SUFFIXES

    plain = lambda n: " ".join(w for w in re.sub(r"[\W_]+", " ", n.lower()).split() if w not in SUFFIXES)
    core = lambda n: " ".join(w for w in n.split() if w not in FILLERS) or n
    grams = lambda n: {s[i : i + 3] for s in [n.replace(" ", "")] for i in range(max(1, len(s) - 2))}
    live = [(i, plain(n), (v or "").strip().upper(), c, s) for i, n, v, c, s, archived in contacts if n and plain(n) and not archived]
    found = set()
    for (i, a, v, ac, asu), (j, b, w, bc, bs) in itertools.permutations(live, 2):
        if grams(a) & grams(b):
            raw = 0.85 * similarity.ratio(core(a), core(b)) + 0.15 * similarity.ratio(a, b)
            vat = "unknown" if not (v and w) else "match" if v == w else "mismatch"
            conf = {"unknown": raw, "match": min(raw + 0.1, 1.0), "mismatch": raw * 0.4}[vat]
            split = (ac and not asu and bs and not bc) or (asu and not ac and bc and not bs)
            if raw >= 0.7:
                found.add((i, j, *(float(Decimal(str(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for x in (raw, conf)), vat, "low" if split or vat == "mismatch" else "high" if conf >= 0.85 else "medium", split))
    return found


def _shown_duplicates(df):
    rows = [(r.contact_id, r.partner_id, round(r.similarity, 4), round(r.confidence, 4), r.vat_status, r.severity, r.is_split) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_duplicate_contacts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(contact_rules, "BLOCK", 16)  # groups of a trigram in several blocks
    rng = random.Random(4)
    words = ["acme", "acmee", "apex", "north", "northern", "river", "rivers", "services", "group", "ltd", "limited", "12", "ab"]
    made = [(str(i), " ".join(rng.choice(words).title() for _ in range(rng.randint(1, 4))), rng.choice([None, "", "GB1", "gb1", "GB2"]), rng.random() < 0.6, rng.random() < 0.6, rng.random() < 0.1) for i in range(160)]
    made += [("n1", None, None, True, False, False), ("n2", "  ", None, True, False, False), ("n3", "Ltd", None, True, False, False)]
    got = contact_rules.duplicate_contacts(spark.createDataFrame([("co", *m) for m in made], "company_id string, contact_id string, name string, vat string, is_customer boolean, is_supplier boolean, is_archived boolean"))
    want = _duplicates_by_brute_force(made)
    assert len(want) > 1000 and _shown_duplicates(got) == want


def test_duplicate_contacts_are_scored_by_blocks_not_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(contact_rules, "BLOCK", 16)
    made = [(f"{side}{i}", f"{name} {i // 3:04d}", ["GB1", None, " gb1 "][i % 3], side == "C", side == "S", i == 5) for side, name in (("C", "Customer"), ("S", "Supplier")) for i in range(60)]
    made += [(f"T{i}", "Twice " + "long " * 20, None, True, True, False) for i in range(40)]
    got = contact_rules.duplicate_contacts(spark.createDataFrame([("co", *m) for m in made], "company_id string, contact_id string, name string, vat string, is_customer boolean, is_supplier boolean, is_archived boolean"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert _shown_duplicates(got) == _duplicates_by_brute_force(made)
    rows = got.collect()
    assert [(-r.confidence, r.company_id, r.contact_id, r.partner_id) for r in rows] == sorted((-r.confidence, r.company_id, r.contact_id, r.partner_id) for r in rows)


def test_duplicate_contacts_query_covers_customers_and_suppliers(spark):
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    made = [(r.contact_id, r.name, r.vat, r.is_customer, r.is_supplier, r.is_archived) for r in rule_queries.contacts(spark, data).collect()]
    want = _duplicates_by_brute_force(made)
    assert {i[0] for i, *_ in want} == {"C", "S"}
    assert _shown_duplicates(rule_queries.QUERIES["r34_duplicate_contact"](spark, data)) == want


def test_anomalies_are_scored_as_found_without_finding_them_again(spark):
    from quillstone.operators import scored_rules

    rows = [("co", f"t{i}", i, date(2001, 1, 1), Decimal(a), "c1", "v", "429") for i, a in enumerate((100, 100, 100, 100, 100, 900))] + [("co", "t5", 9, date(2001, 1, 2), Decimal(950), "c1", "v", None)]
    docs = spark.createDataFrame(rows, "company_id string, transaction_id string, seq long, date date, amount decimal(12,2), contact_id string, vendor_name string, account_code string")

    def scorer(part):
        assert list(part) == ["company_id", "transaction_id", "current_code", "reason"]
        return part.assign(sure=[0.9 if r == "9.0" else 0.85 for r in part["reason"]])

    out = scored_rules.anomalies(docs, scorer)
    assert sorted((r.transaction_id, r.confidence, r.current_code, r.reason, r.line_no, r.likely_original) for r in out.collect()) == [("t5", 0.85, "429", "9.5", None, None), ("t5", 0.9, "429", "9.0", None, None)]  # not each with each


def test_cross_contact_names_are_not_scored_where_vat_numbers_decide(spark):
    rows = [(f"t{i}", i, f"c{i}", name) for i, name in enumerate(("Acme", "Zebra", "Acme Ltd", "Acme"))]
    docs = spark.createDataFrame(rows, "transaction_id string, seq long, contact_id string, vendor_name string").selectExpr("'co' AS company_id", "*", "DATE '2001-01-01' AS date", "CAST(10 AS DECIMAL(12,2)) AS amount", "'ACCPAY' AS type", "'x' AS invoice_number", "'y' AS reference", "'AUTHORISED' AS status", "CAST(10 AS DECIMAL(12,2)) AS amount_due", "CAST(NULL AS DATE) AS posted_date", "'d' AS description")
    vat = spark.createDataFrame([("co", "c0", "1"), ("co", "c1", "1"), ("co", "c2", "2")], "company_id string, contact_id string, vat string")
    out = duplicate_rules.cross_contact(docs, vat)
    got = {(r.transaction_id, r.dup_of_id) for r in out.collect()}
    assert got == {("t0", "t1"), ("t1", "t0"), ("t0", "t3"), ("t3", "t0"), ("t2", "t3"), ("t3", "t2")}  # equal numbers, else alike names
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and not re.search(r"lower\((coalesce\()?a_vendor", plan)


def test_phrases_split_each_text_once(spark):
    from quillstone.operators import phrases

    texts = spark.createDataFrame([(1, "A new laptop -- bag"), (2, ""), (3, None), (4, " -- "), (5, "LAPTOPS")], "id long, text string")
    out = phrases.found(texts, ["id"], spark.createDataFrame([("capital", "laptop"), ("exclusion", "new")], "kind string, phrase string"))
    assert sorted(map(tuple, out.collect())) == [(1, "capital", "laptop"), (1, "exclusion", "new"), (5, "capital", "laptop")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract_all\(lower\(text", plan)) == 1


def test_settings_ignore_what_is_bad():
    s = Settings.of({"overdue_days": "7", "capital_min": "x", "unknown": 1, "duplicate_also_check_paid": "yes", "vague_codes": [" 1 ", ""], "low_cost_limit": float("inf")})
    assert (s.old_unpaid_bill_days, s.capital_min, s.duplicate_also_check_paid, s.vague_codes, s.low_cost_limit) == (7, 500, True, ("1",), 10000)


def test_scores_and_states(spark):
    df = spark.createDataFrame([(8, 1), (0, 0), (8, 9)], "a long, t long").select(verdicts.score(F.col("a"), F.col("t")).alias("r"), verdicts.score(F.col("a"), F.col("t"), True).alias("c"))
    assert [(r.r, r.c) for r in df.collect()] == [(88, 87), (None, None), (0, 0)]
    acts = spark.createDataFrame([("co", "d", 1, "resolve", None), ("co", "d", 2, "restore", None), ("co", "d", 3, "snooze", 9)], "company_id string, document_id string, at int, action string, until int")
    r = verdicts.states(acts).first()
    assert (r.resolved, r.snoozed_until) == (False, 9)


def test_net_assets_from_filings():
    ns = 'xmlns:ix="i" xmlns:x="x"'
    doc = f'<h {ns}><x:context id="a"><x:instant>2023-12-31</x:instant></x:context><ix:nonFraction name="c:Equity" contextRef="a">5</ix:nonFraction><ix:nonFraction name="c:NetAssetsLiabilities" contextRef="a" sign="-" scale="3">1,2</ix:nonFraction></h>'
    assert reports.net_assets(doc) == {"2023-12-31": Decimal("-12000")}
    assert reports.net_assets("<broken") == {} and reports.net_assets(None) == {}


def test_stream_keeps_the_latest(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = lambda v, t: spark.createDataFrame([("co", "e", "1", v, t)], "company_id string, entity string, source_id string, raw_json string, updated_ts string").selectExpr("* except (updated_ts)", "cast(updated_ts as timestamp) updated_ts")
    for k, (v, t) in enumerate((("new", "2024-01-02"), ("old", "2024-01-01"))):
        rows(v, t).write.json(f"{at}/in/{k}")
        ingest.start(spark, f"{at}/in/*", f"{at}/state", f"{at}/cp").awaitTermination()
    assert [r.raw_json for r in ingest.current(spark, f"{at}/state").collect()] == ["new"]
    ingest.compacted(spark, f"{at}/state", f"{at}/small")
    assert spark.read.parquet(f"{at}/small").count() == 1
    rows("newest", "2024-01-03").write.json(f"{at}/in/2")
    ingest.start(spark, f"{at}/in/*", f"{at}/state", f"{at}/cp").awaitTermination()
    assert [r.raw_json for r in ingest.current(spark, f"{at}/state", f"{at}/small").collect()] == ["newest"]
    ingest.compacted(spark, f"{at}/state", f"{at}/next", f"{at}/small")
    assert [(r.raw_json, r.upto) for r in spark.read.parquet(f"{at}/next").collect()] == [("newest", 2)]
    spark.createDataFrame([], ingest.RAW).withColumn("upto", F.lit(0)).write.parquet(f"{at}/empty")
    assert [r.raw_json for r in ingest.current(spark, f"{at}/state", f"{at}/empty").collect()] == ["newest"]


def test_one_entity_fails_alone(spark, tmp_path):
    at = f"file://{tmp_path}"
    row = [("co", "good", "1", "{}", datetime(2024, 1, 1))]
    spark.createDataFrame(row, ingest.RAW).write.json(f"{at}/in/good")
    spark.createDataFrame(row, ingest.RAW).write.json(f"{at}/in/bad")
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "bad").write_text("a file where a folder should be")
    ended = ingest.outcomes(ingest.start_each(spark, ["good", "bad"], f"{at}/in", f"{at}/state", f"{at}/cp"), "co", datetime(2024, 1, 2))
    assert {(company, entity): error is None for company, entity, _, error in ended} == {("co", "good"): True, ("co", "bad"): False}
    assert ingest.current(spark, f"{at}/state/good").count() == 1


def test_report_has_ten_columns_and_a_mark(spark, tmp_path):
    v = spark.createDataFrame([("co", "d1", "Ann", "N1", date(2024, 1, 2), Decimal("1234.50")), ("co", "d2", None, "", None, None)], "company_id string, document_id string, vendor_name string, invoice_number string, date date, amount decimal(12,2)")
    v = v.withColumns({c: F.lit(None).cast("boolean") for c in ("resolved", "dismissed", "marked_ok", "auto_cleared")} | {c: F.lit(None).cast("string") for c in ("reference", "display_number", "currency_code", "doc_status")})
    f = spark.createDataFrame([("co", "d1", "duplicate_bill", "high", 0.285, "N2", True, "a, b"), ("co", "d2", "odd_rule", None, None, None, None, None)], "company_id string, transaction_id string, issue_type string, severity string, confidence double, dup_of_number string, likely_original boolean, reason string")
    files.write_report(verdicts.report(v, f), f"{tmp_path}/r")
    text = {p.parent.name: p.read_text("utf-8").split("\n") for p in tmp_path.rglob("part-*.txt")}
    head = ",".join(files.REPORT.values())
    assert text["section=Duplicate bills"][:4] == ["\ufeffDuplicate bills — 1 issue(s)", head, 'Ann,N1,2024-01-02,"£1,234.50",,N2,KEEP (original),High,28%,"a, b"', ""]
    assert text["section=Odd Rule"][2] == ",,,,,,,,,"
    assert files.report_lines(verdicts.report(v, f.limit(0))).count() == 0


def test_annotations_and_suggestions_from_odd_json(spark):
    raws = [None, "", "nope", "[1]", "3", '{"confidence": "x"}', '{"summary": null}', '{"summary": "s", "confidence": 1}']
    rows = spark.createDataFrame([(n, r) for n, r in enumerate(raws)], "n int, raw string")
    assert [r.a is not None for r in rows.select("n", records.annotation("raw").alias("a")).orderBy("n").collect()] == [False] * 6 + [True] * 2
    asked = rows.selectExpr("'co' AS company_id", "string(n) AS document_id", "'wrong_category' AS primary_rule", "CAST(NULL AS STRING) AS suggested_code", "CAST(NULL AS STRING) AS vendor_name", "raw")
    out = records.suggestions(asked).collect()
    assert {(r.strategy, r.minutes, r.updates, r.target, r.account) for r in out} == {("manual_review", 0, None, None, None)} and len(out) == len(raws)


def test_settings_belong_to_rules_of_the_catalogue():
    assert {r for r, _ in catalog.TUNES.values()} <= {r[1] for r in catalog.RULES}
    assert len({r[1] for r in catalog.RULES}) == len(catalog.RULES)
    assert set(catalog.TUNES) | {"historical_code", "disabled_rules"} == set(Settings.__dataclass_fields__)


def test_terms_of_far_dates_and_repeated_texts(spark):
    rows = [(i, t, s) for i, (t, s) in enumerate(3 * [("annual licence", date(9998, 2, 23)), ("annual licence", date(9999, 2, 23)), ("annual licence", date(2024, 2, 29)), ("Feb 2024 to Feb 2024", None), (None, date(2024, 1, 1)), ("lunch", None)])]
    got = spark.createDataFrame(rows, "i int, t string, s date").select("i", dates.period("t", "s").alias("p")).collect()
    want = [(date(9998, 2, 23), date(9999, 2, 22)), None, (date(2024, 2, 29), date(2025, 2, 27)), (date(2024, 2, 1), date(2024, 2, 29)), None, None]
    assert {r.i: (r.p.start, r.p.end) if r.p and r.p.start else None for r in got} == {i: want[i % 6] for i in range(18)}


def test_strip_takes_white_space_of_any_kind(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    df = spark.createDataFrame([(f"{c} a{c}b \n{c}",) for c in spaces] + [("",), (" \n",), (None,), ("​a\x1c",)], "t string").select(text.strip("t").alias("x"))
    assert [r.x for r in df.collect()] == [f"a{c}b" for c in spaces] + ["", "", "", "​a\x1c"]
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString(), "strip is on every key of every rule: no pattern is run for it"


def test_raw_documents_are_parsed_once(spark):
    raw = spark.range(5).selectExpr("'co' AS company_id", "'bank_transactions' AS entity", "CAST(id AS string) AS source_id", "CASE WHEN id < 3 THEN to_json(struct(concat('B', id) AS BankTransactionID, 'spend' AS Type, '7.5' AS Total, struct('S1' AS ContactID) AS Contact)) WHEN id = 3 THEN '[1]' END AS raw_json", "timestamp_seconds(0) AS synced_ts")
    df = mirror.bank(raw)
    assert sorted((r.transaction_id, r.type, float(r.amount)) for r in df.collect()) == [(f"B{i}", "SPEND", 7.5) for i in range(3)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1, "filters and columns share one parse"


def _usual_by_brute_force(rows):
    """The most frequent code of each contact and how many differ; of equals the first place, those without a seq last."""
    found = {}
    for who in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == who]
        place = lambda c: min((-(1 << 70) if seq is None else seq, line or 0) for _, _, seq, line, code in mine if code == c)
        last = lambda p: (p[0] == -(1 << 70), *p)
        codes = sorted({r[4] for r in mine}, key=lambda c: (-sum(r[4] == c for r in mine), last(place(c))))
        found[who] = codes[0], len(codes)
    return found


def test_usual_values_are_counted_without_sorting_rows(spark):
    rng = random.Random(9)
    rows = [("co", f"w{rng.randint(0, 60)}", rng.choice([None, -(1 << 63) + 1, -5, 0, 3, 4, (1 << 63) - 1]), rng.choice([None, 1, 2, 2147483647]), rng.choice("abcd")) for _ in range(500)]
    rows = [r for k, r in enumerate(rows) if all(o[1:4] != r[1:4] for o in rows[:k])]  # places of their own
    rows = [r for k, r in enumerate(rows) if not any(o[1:3] == r[1:3] and (o[3] or 0) == (r[3] or 0) for o in rows[:k])]
    df = spark.createDataFrame(rows, "company_id string, who string, seq long, line_no int, code string")
    out = base.dominant(df, ["company_id", "who"], "code")
    assert {r.who: (r.top_code, r.n_values) for r in out.collect()} == _usual_by_brute_force(rows)
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    assert " HashAggregate" in next(x for x in plan if "partial_min" in x)


def test_lines_of_the_ledger_are_dealt_once(spark):
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    from quillstone.plans import ledger_views

    plan = ledger_views.sales(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - plan.count("Exchange hashpartitioning(seq") == 1  # the lines by their order: for their numbers, their lists and the join


def test_codes_of_repeated_documents_give_one_flag(spark):
    lines = "array<struct<line_no:int,account_code:string,tax_code:string,amount:decimal(12,2),description:string>>"
    row = lambda i, seq, codes, header=None: ("co", i, seq, "c1", "Acme", "ACCPAY", header, header, Decimal(1), "x", [(9, c, c, Decimal(1), "x") for c in codes] if codes is not None else None)
    txn = spark.createDataFrame([row("d1", 1, ["a", "a", "b"]), row("d1", 1, ["a", "a", "b"]), row("d2", 2, None, " a "), row("d3", 3, [" ", None, "B"]), row("d4", 4, [], "b"), row("d5", 5, None, None)], f"company_id string, transaction_id string, seq long, contact_id string, vendor_name string, type string, account_code string, tax_code string, amount decimal(12,2), description string, line_items {lines}")
    got = line_rules.several_accounts(txn).collect()
    assert sorted((r.transaction_id, r.line_no, r.current_code, r.suggested_code) for r in got if r.transaction_id != "d4") == [("d1", 3, "b", "a"), ("d3", 3, "B", "a")]
    assert [(r.line_no, r.current_code) for r in got if r.transaction_id == "d4"] == [(None, "b")]
