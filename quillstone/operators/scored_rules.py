"""Rules whose judgement comes from a scorer that callers pass in (a model, a service, a stub); Spark dedupes what it sees and guards what it says."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import strip
from .base import EXPENSE_TYPES, PURCHASES, REVENUE_TYPES, SALES, flags, kind, with_account
from .line_rules import outliers

#: Takes vendor, description, type, code; gives suggested_code, confidence, in the rows' order.
Scorer = Callable[[pd.DataFrame], pd.DataFrame]
CHUNK = 10


def _scored(facts: DataFrame, scorer: Scorer, columns: dict[str, str], seen: list[str] | None = None) -> DataFrame:
    """Facts with the scorer's columns; it sees CHUNK rows at once, of the columns seen (all if not given). The facts' own columns pass by it as they are."""
    seen = seen or facts.columns
    types = StructType.fromDDL(", ".join(f"{k} {v}" for k, v in columns.items()))
    schema = StructType([*facts.schema.fields, *types.fields])
    said_as = to_arrow_schema(types)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            shown = part.select(seen).to_pandas()
            said = [scorer(shown.iloc[at : at + CHUNK].reset_index(drop=True))[list(columns)] for at in range(0, len(shown), CHUNK)]
            new = pa.Table.from_pandas(pd.concat(said, ignore_index=True), schema=said_as, preserve_index=False)  # once a batch, as joining each chunk costs more than most answers
            yield pa.RecordBatch.from_arrays([*part.columns, *(new[c].combine_chunks() for c in columns)], names=[*part.schema.names, *columns])

    return facts.mapInArrow(run, schema)


def wrong_category(docs: DataFrame, accounts: DataFrame, scorer: Scorer, least: float = 0.8, least_if_right_side: float = 0.9) -> DataFrame:
    """Documents that a scorer would post elsewhere. Documents alike in vendor, description, type and code are asked about once.

    A suggestion counts if it is sure enough, names an account of the company other than the present one, and fits the document's side;
    where the present account fits the side already, it must be surer."""
    rows = with_account(docs.where(kind().isin(*SALES, *PURCHASES)).withColumn("account", F.col("account_code")), accounts)
    rows = rows.select("company_id", "transaction_id", F.lower(strip("vendor_name")).alias("vendor"), F.lower(strip("description")).alias("description"), kind().alias("type"), F.col("acct").alias("code"), F.coalesce("account_type", F.lit("")).alias("have_type"))
    facts = rows.select("company_id", "vendor", "description", "type", "code", "have_type").distinct()
    said = _scored(facts, scorer, {"suggested_code": "string", "confidence": "double"})
    coa = accounts.groupBy(F.col("company_id").alias("s_co"), strip("code").alias("s_code")).agg(F.max(F.upper(strip("type"))).alias("s_type"))
    known = said.join(coa, (F.col("company_id") == F.col("s_co")) & (strip("suggested_code") == F.col("s_code")))
    fits = lambda c: F.when(F.col("type").isin(*SALES), F.col(c).isin(*REVENUE_TYPES)).otherwise(F.col(c).isin(*EXPENSE_TYPES))
    good = known.where((F.col("s_code") != F.col("code")) & fits("s_type") & (F.col("confidence") >= F.when(fits("have_type"), least_if_right_side).otherwise(least)))
    keys = ["company_id", "vendor", "description", "type", "code", "have_type"]
    hit = rows.join(good.select(*keys, "s_code", "confidence"), keys)
    return flags(hit, "wrong_category", F.when(fits("have_type"), "medium").otherwise("high"), current_code=F.col("code"), suggested_code=F.col("s_code"), confidence=F.col("confidence"))


def anomalies(docs: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None, least: float = 0.8) -> DataFrame:
    """Amount outliers that a scorer confirms with enough confidence; all of them without a scorer. The scorer gives confidence for transaction_id, current_code, reason."""
    found = outliers(docs)
    if scorer is None:
        return found
    said = _scored(found, scorer, {"sure": "double"}, ["company_id", "transaction_id", "current_code", "reason"])  # no join with what was found, which would find it twice
    return said.where(F.col("sure") >= least).withColumn("confidence", F.col("sure")).drop("sure")


def not_annotated(verdicts: DataFrame, annotations: DataFrame) -> DataFrame:
    """Verdicts neither resolved nor dismissed that have no annotation yet."""
    left = verdicts.where(~F.coalesce("resolved", F.lit(False)) & ~F.coalesce("dismissed", F.lit(False)))
    return left.join(annotations.select("company_id", "document_id").distinct(), ["company_id", "document_id"], "left_anti")
