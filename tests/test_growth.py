"""What keeps queries in proportion to their input and their output."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from quillstone.operators import verdicts
from quillstone.plans import ledger_views, registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_grants_that_come_dealt_give_each_pair_once(spark):
    companies = spark.range(40).select((F.col("id") % 3).cast("int").alias("firm_id"), F.col("id").alias("company_id"))
    users = spark.range(30).select((F.col("id") % 3).cast("int").alias("firm_id"), F.col("id").alias("user_id"), (F.col("id") % 5 == 0).alias("is_owner"))
    listed = users.crossJoin(companies.select("company_id")).where("(user_id + company_id) % 4 = 0").select("user_id", "company_id")
    grants = listed.union(listed).repartition(16, "company_id")
    df = verdicts.accessible(companies, users, grants)
    want = [(u, c) for u in range(30) for c in range(40) if u % 3 == c % 3 and (u % 5 == 0 or (u + c) % 4 == 0)]
    assert sorted(map(tuple, df.collect())) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_many_grants_are_not_dealt(spark):
    df = registry.queries()["m12_tenant_access"](spark, DATA)
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())
    assert dealt and all("user_id" not in d for d in dealt), dealt


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_outliers_and_usual_accounts_deal_lines_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()["r17_amount_outlier"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    dealt = [x for x in plan.splitlines() if re.search(r"Exchange hashpartitioning\(ord#", x)]
    assert len([x for x in dealt if "ReusedExchange" not in x]) == 2, "bills' lines and sales' lines"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_documents_and_bank_in_one_deal_lines_twice(spark):
    """Bills and payments come of one numbering of the lines, sales' lines of another."""
    apart = ledger_views.documents(spark, DATA).unionByName(ledger_views.bank(spark, DATA), allowMissingColumns=True)
    one = ledger_views.everything(spark, DATA).select(apart.columns)
    assert one.schema.simpleString() == apart.schema.simpleString()
    assert apart.exceptAll(one).isEmpty() and one.exceptAll(apart).isEmpty()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = ledger_views.everything(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(re.findall(r"(?<!, )Exchange hashpartitioning\(ord#", plan)) == 2
