"""What is done with flags: union of rules, suppression, precedence, the asset register."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: An item's review outranks lower-valued findings on the same document: the first of these that is present demotes the others.
PRECEDENCE = ("capital_item_review", "low_cost_fixed_asset", "prepayment_review", "unusual_payment")


def union(parts: list[DataFrame]) -> DataFrame:
    """All rules' flags; emit_ord gives the order of rules."""
    return reduce(DataFrame.unionByName, [p.withColumn("rule_ord", F.lit(k)) for k, p in enumerate(parts)])


def without_rules(flags: DataFrame, disabled: tuple) -> DataFrame:
    return flags.where(~F.col("issue_type").isin(*disabled)) if disabled else flags


def superseded(flags: DataFrame) -> DataFrame:
    """Adds superseded_by: the highest rule of PRECEDENCE on the document, for its lower ones."""
    rank = F.coalesce(*(F.when(F.col("issue_type") == t, F.lit(k)) for k, t in enumerate(PRECEDENCE)))
    w = Window.partitionBy("company_id", "transaction_id")
    top = F.min(rank).over(w)
    return flags.withColumn("superseded_by", F.when(rank > top, F.element_at(F.array(*map(F.lit, PRECEDENCE)), top + 1)))


def not_registered(flags: DataFrame, docs: DataFrame, register: DataFrame, money: float = 1, days: int = 30) -> DataFrame:
    """Capital reviews less those whose document an asset of the register matches: price within money, bought within days.

    register: company_id, price, bought. Matched by price bucket, so that no pair of a large register and many flags is made in vain."""
    wide = int(money) + 1
    hits = flags.join(docs.select("company_id", "transaction_id", F.abs("amount").alias("m_amount"), F.col("date").alias("m_date")), ["company_id", "transaction_id"])
    hits = hits.withColumn("m_bucket", F.floor(F.col("m_amount") / wide))
    own = register.select(F.col("company_id").alias("r_co"), F.col("price").alias("r_price"), F.col("bought").alias("r_date"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col("price") / wide) + k)).alias("r_bucket"))
    on = (F.col("company_id") == F.col("r_co")) & (F.col("m_bucket") == F.col("r_bucket")) & (F.abs(F.col("m_amount") - F.col("r_price")) <= money) & (F.abs(F.datediff("m_date", "r_date")) <= days)
    return hits.join(own, on, "left_anti").drop("m_amount", "m_date", "m_bucket")
