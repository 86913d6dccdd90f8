"""Ids from names, medians, nested reports, balances by two keys, pages by key, keyed stream state, served snapshots."""

import json
import os
import random
import re
import statistics
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstone.functions.ids import name_id
from quillstone.operators import kpis, medians, records, verdicts
from quillstone.plans import served_queries
from quillstone.sources import reports
from quillstone.sources.snapshots import ServedTable
from quillstone.streaming import keyed


def at(n):
    return datetime(2024, 1, 1) + timedelta(minutes=n)


def test_ids_equal_uuid5(spark):
    names = ["", "a", "日本 x", " L1-2", "é" * 300, "A" * 100_000, None, "\x00"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(name_id(verdicts.PRE_LEDGER, "n")).collect()]
    assert got == [None if n is None else str(uuid.uuid5(uuid.UUID(verdicts.PRE_LEDGER), n)) for n in names]


def test_medians_are_exact_in_any_range(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None, f"c{i % 40}"]), rnd.choice([1.0, 2.0, round(rnd.uniform(-5000, 5000), 2), round(rnd.uniform(0, 5), 2)])) for i in range(2000)] + [("z", None), ("one", 3.25)]
    df = spark.createDataFrame(rows, "k string, x double").select("k", F.col("x").cast("decimal(12,2)").alias("x"))
    groups = {}
    for k, x in rows:
        if x is not None:
            groups.setdefault(k, []).append(x)
    for width in (1, 700, 1 << 16):
        monkeypatch.setattr(medians, "RANGE", width)
        got = {r.k: (r.n, round(r.mid, 6)) for r in medians.exact_medians(df, ["k"], "x").collect()}
        assert got == {k: (len(v), round(statistics.median(v), 6)) for k, v in groups.items()}
    assert medians.exact_medians(df.limit(0), ["k"], "x").count() == 0


def test_reports_of_any_depth_and_of_odd_shape(spark):
    row = lambda *v: {"RowType": "Row", "Cells": [{"Value": x} for x in v]}
    deep = row("at the bottom", 5)
    for k in range(40):
        deep = {"RowType": "Section", "Title": f"t{k}" if k % 2 == 0 else "", "Rows": [row(f"above {k}"), deep, "not a row", None]}
    texts = [json.dumps({"Rows": [deep, row("last")]}), "[1, 2]", "{broken", None, "", '{"Rows": 5}', '{"Rows": [{"Cells": ["x", {"Value": null, "Attributes": [3, {"Id": "account", "Value": "g"}]}]}]}', "[" * 5000]
    got = reports.rows(spark.createDataFrame(list(enumerate(texts)), "n int, report_json string")).orderBy("n", "pos").collect()
    first = [r for r in got if r.n == 0]
    assert [r.cells[0].Value for r in first] == [f"above {k}" for k in range(39, -1, -1)] + ["at the bottom", "last"]
    bottom = first[-2]
    assert len(bottom.pos) == 41 and bottom.title == "t0" and bottom.cells[1].Value == "5" and first[0].title is None
    assert [(r.n, [c.Value for c in r.cells], r.cells[1].Attributes[0].Value) for r in got if r.n] == [(6, [None, None], "g")]


def test_balances_by_code_then_by_id(spark):
    accounts = spark.createDataFrame([("c", "1", "a", "One", "BANK"), ("c", " 2 ", "b", "Two", "CURRLIAB"), ("c", "3", "x", "Three", "BANK"), ("c", "4", None, "Four", "BANK"), ("c", " ", "q", "Blank", "BANK"), ("d", "1", "a", "Other", "BANK"), ("c", "3", "x", "Thrice", "BANK")], "company_id string, code string, account_id string, name string, type string")
    trial = spark.createDataFrame([("c", "1", "a", 5.0, 1), ("c", "1", "z", 6.0, 2), ("c", "", "b", 7.0, 3), ("c", None, "b", 8.0, 4), ("c", "2x", "x", 9.0, 5), ("d", "9", "zz", 1.0, 1)], "company_id string, code string, account_id string, balance double, pos int")
    got = {(r.company_id, r.code): (r.name, float(r.balance), r.found_by) for r in kpis.account_balances(accounts, trial).collect()}
    assert got == {("c", "1"): ("One", 6.0, "code"), ("c", "2"): ("Two", 8.0, "id"), ("c", "3"): ("Thrice", 9.0, "id"), ("c", "4"): ("Four", 0.0, None), ("d", "1"): ("Other", 0.0, None)}


def test_pages_by_key_make_the_whole_feed(spark):
    rnd = random.Random(2)
    rows = [(f"d{rnd.randrange(60):02d}-{k}", rnd.choice([None, at(1), at(1), at(rnd.randrange(5))])) for k in range(83)]
    df = spark.createDataFrame(rows, "document_id string, ran_at timestamp")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or at(0)).timestamp(), r[0]))
    got, key = [], (None, None)
    while page := [tuple(r) for r in verdicts.page_after(df, 10, *key).collect()]:
        got += page
        key = page[-1][1], page[-1][0]
    assert got == want
    assert "TakeOrderedAndProject" in verdicts.page_after(df, 10, at(3), "d1")._jdf.queryExecution().executedPlan().toString()


def landed(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"company_id": "c", "entity": e, "source_id": i, "raw_json": j, "updated_ts": str(at(u)), "pulled_ts": str(at(p))}) for e, i, j, u, p in rows))


def test_keyed_state_equals_the_batch_result(spark, tmp_path):
    rnd = random.Random(3)
    every = []
    for batch in range(4):
        rows = [(rnd.choice("ab"), rnd.randrange(12), f"v{rnd.randrange(1000)}", rnd.randrange(30), batch * 100) for _ in range(25)]
        rows += rnd.sample(every, min(5, len(every)))  # arrives again
        landed(tmp_path / "in", f"{batch}.json", rows)
        every += rows
        keyed.start(spark, str(tmp_path / "in"), str(tmp_path / "checkpoint")).awaitTermination()  # a query of its own each time: it starts again from the checkpoint
    best, seen = {}, {}
    for e, i, j, u, p in every:
        best[e, str(i)] = max(best.get((e, str(i)), (at(-1), at(-1), "")), (at(u), at(p), j))
        seen[e, str(i)] = max(seen.get((e, str(i)), at(-1)), at(p))
    got = {(r.entity, r.source_id): (r.updated_ts, r.raw_json, r.seen) for r in keyed.current(spark, str(tmp_path / "checkpoint")).collect()}
    assert got == {k: (v[0], v[2], seen[k]) for k, v in best.items()}
    left = {(r.entity, r.source_id) for r in keyed.current(spark, str(tmp_path / "checkpoint"), refreshed=at(300)).collect()}
    assert left == {k for k, t in seen.items() if t >= at(300)} != set(got)


def test_a_served_table_replaces_rows_and_reads_one_bucket(spark, tmp_path):
    table = ServedTable(spark, str(tmp_path / "snapshots"), "company_id string, computed_at timestamp, status string", buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "company_id string, computed_at timestamp, status string, more int")
    assert table.read().count() == 0 == table.of("a").count()
    table.upsert(rows(("a", at(1), "ok", 1), ("b", at(1), "ok", 1), (None, at(1), "nobody", 1)))
    before = set(table.read().inputFiles())
    table.upsert(rows(("a", at(2), "failed", 1), ("b", at(0), "late", 1), ("a", at(1), "ok", 1)).where("company_id = 'a'"))
    table.upsert(rows(("b", at(0), "late", 1), ("c", at(5), "first", 1), ("c", at(5), "first", 1)))
    table.upsert(rows(("x", at(0), "none", 1)).limit(0))
    assert sorted(map(tuple, table.read().select("company_id", "status").collect())) == [("a", "failed"), ("b", "ok"), ("c", "first")]
    one = table.of("a")
    assert [r.status for r in one.collect()] == ["failed"] and len(one.inputFiles()) <= 4 and before
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_access_by_grants_makes_no_product_of_a_firm(spark):
    companies = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (None, 30)], "firm_id int, company_id int")
    users = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, False), (None, 4, False), (1, 5, None)], "firm_id int, user_id int, is_owner boolean")
    grants = spark.createDataFrame([(2, 10), (2, 10), (2, 20), (3, 20), (4, 30), (5, 10), (9, 10)], "user_id int, company_id int")
    df = verdicts.accessible(companies, users, grants)
    assert sorted(map(tuple, df.collect())) == [(1, 10), (1, 11), (2, 10), (3, 20)]
    joins = re.findall(r"Join \w+, (.*)", df._jdf.queryExecution().optimizedPlan().toString())
    assert [j.count("=") for j in joins].count(1) == 2, "owners by firm, grants by user"
    assert sum("firm_id" in j and "company_id" not in j for j in joins) == 1, "only owners meet all companies of their firm"


def test_reports_leave_python_in_parts(spark, monkeypatch):
    """Of a large report no list of all its rows is made; other columns come with every row."""
    taken = []
    monkeypatch.setattr(reports, "_cell", lambda c: taken.append(c) or {"Value": c["Value"], "Attributes": None})
    report = json.dumps({"Rows": [{"RowType": 7, "Cells": [{"Value": str(k)}]} for k in range(9)]})
    walk = reports._walked(report)
    assert next(walk)["row_type"] == "7" and len(taken) == 1
    monkeypatch.undo()
    monkeypatch.setattr(reports, "AT_ONCE", 4)
    df = spark.createDataFrame([(1, report, "a"), (2, None, "b"), (3, "[]", "c"), (4, report, None)], "n int, report_json string, more string").coalesce(1)
    got = [(r.n, r.more, r.pos, r.row_type, r.cells[0].Value) for r in reports.rows(df).collect()]
    assert got == [(n, more, [k], "7", str(k)) for n, more in ((1, "a"), (4, None)) for k in range(9)]


def test_snapshots_are_computed_once(spark, monkeypatch):
    """What three upserts read of the snapshots comes from a checkpoint, not from the ledger each time."""
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    plans = []
    plain = ServedTable.upsert
    monkeypatch.setattr(ServedTable, "upsert", lambda table, rows: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), plain(table, rows)))
    assert served_queries.QUERIES["k23_served_snapshots"](spark, data).count() == 4
    assert len(plans) == 3 and not any("l_orderkey" in p for p in plans)


def test_keys_to_look_up_are_not_made_distinct(spark):
    """Repeats and nulls among the keys that are there change nothing, and no table of them is built in memory."""
    rows = spark.createDataFrame([("co", "a", "v1"), ("co", "b", "v2"), ("co", "b", "v2"), (None, "c", "v3"), ("co", None, None)], "company_id string, document_id string, verdict_id string")
    there = rows.where("document_id = 'b' or document_id is null or company_id is null")
    outs = verdicts.inserted(there, rows), verdicts.pruned(rows, there, verdicts.KEY), records.found(rows, there)
    assert [sorted((r.document_id or "") for r in out.collect()) for out in outs] == [["", "a", "c"], ["b", "b"], ["b", "b"]]
    assert not any("Aggregate" in out._jdf.queryExecution().executedPlan().toString() for out in outs)
