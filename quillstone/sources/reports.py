"""Report trees (profit and loss, balance sheet, trial balance, bank summary) as rows of cells, and filings as periods."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import amount, label_code, label_name

_PAIR = T.StructType().add("Id", T.StringType()).add("Value", T.StringType())
_CELL = T.StructType().add("Value", T.StringType()).add("Attributes", T.ArrayType(_PAIR))
_FLAT = T.ArrayType(T.StructType().add("pos", T.ArrayType(T.IntegerType())).add("title", T.StringType()).add("row_type", T.StringType()).add("cells", T.ArrayType(_CELL)))

#: Rows of a report that leave Python at once.
AT_ONCE = 4096


def _walked(document: str | None) -> Iterator[dict]:
    """Rows with cells of a report's JSON in their order, sections in sections to any depth: their place (a number for each level), the title of the nearest section that has one, type and cells. None where it isn't a report."""
    try:
        report = json.loads(document or "")
    except (ValueError, RecursionError):
        return
    stack = [((), "", report)] if isinstance(report, dict) else []
    while stack:
        pos, title, at = stack.pop()
        own = at.get("Title")
        title = str(own) if own not in (None, "") else title
        cells = at.get("Cells")
        if pos and isinstance(cells, list):
            yield {"pos": list(pos), "title": title or None, "row_type": _text(at.get("RowType")), "cells": [_cell(c) for c in cells]}
        below = at.get("Rows")
        below = below if isinstance(below, list) else []
        stack += [((*pos, k), title, below[k]) for k in range(len(below) - 1, -1, -1) if isinstance(below[k], dict)]


def flat_rows(document: str | None) -> list[dict]:
    """All rows of a report at once."""
    return list(_walked(document))


def _text(v: object) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v)


def _cell(c: object) -> dict:
    c = c if isinstance(c, dict) else {}
    attributes = c.get("Attributes")
    return {"Value": _text(c.get("Value")), "Attributes": [{"Id": _text(a.get("Id")), "Value": _text(a.get("Value"))} for a in attributes if isinstance(a, dict)] if isinstance(attributes, list) else None}


def rows(reports: DataFrame, json_col: str = "report_json") -> DataFrame:
    """Every row of the reports, at any depth: the reports' other columns, pos (an array that orders rows), title of its section, row_type, cells. Spark's JSON functions need a schema of fixed depth, hence a Python walk.

    Reports are read one after another, and their rows leave in batches of AT_ONCE: beside the texts of a batch, a task holds one report's tree."""
    keep = [c for c in reports.columns if c != json_col]
    row = _FLAT.elementType

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(row)
        for batch in batches:
            for k in range(batch.num_rows):
                found = _walked(batch.column(len(keep))[k].as_py())
                while some := list(islice(found, AT_ONCE)):
                    same = pa.array([k] * len(some), pa.int32())
                    made = pa.Table.from_pylist(some, schema=kinds).combine_chunks()
                    yield pa.RecordBatch.from_arrays([*(batch.column(n).take(same) for n in range(len(keep))), *(made.column(f.name).combine_chunks() for f in kinds)], names=[*keep, *row.names])

    return reports.select(*keep, json_col).mapInArrow(walk, T.StructType([*(reports.schema[c] for c in keep), *row.fields]))


def section_totals(reports: DataFrame) -> DataFrame:
    """(company_id, period, title, value): the first summary row of each titled section, by the header's periods."""
    r = rows(reports)
    head = r.where("row_type = 'Header'").groupBy("company_id").agg(F.min_by("cells", "pos").alias("h"))
    total = r.where("row_type = 'SummaryRow' and title <> ''").groupBy("company_id", "title").agg(F.min_by("cells", "pos").alias("c"))
    cells = total.join(head, "company_id").select("company_id", "title", "h", F.posexplode("c").alias("n", "cell")).where("n > 0")
    return cells.select("company_id", F.get("h", F.col("n"))["Value"].alias("period"), "title", amount("cell.Value").alias("value"))


def trial_balance(reports: DataFrame) -> DataFrame:
    """(company_id, pos, account_id, code, name, debit, credit, balance) of trial balance rows; year-to-date columns where there are any."""
    r = rows(reports).where("row_type = 'Row'")
    label = F.get("cells", F.lit(0))
    ident = F.get(F.filter(label["Attributes"], lambda x: F.lower(x["Id"]) == "account"), F.lit(0))["Value"]
    at = lambda k: amount(F.get("cells", F.lit(k))["Value"])
    wide = F.size("cells") >= 5
    debit, credit = F.when(wide, at(3)).otherwise(at(1)), F.when(wide, at(4)).otherwise(at(2))
    return r.select("company_id", "pos", ident.alias("account_id"), label_code(label["Value"]).alias("code"), label_name(label["Value"]).alias("name"), debit.alias("debit"), credit.alias("credit"), (debit - credit).cast("decimal(18,2)").alias("balance"))


def bank_summary(reports: DataFrame) -> DataFrame:
    """(company_id, account_id, name, closing) of bank summary rows, totals left out."""
    r = rows(reports).where("row_type = 'Row'")
    label = F.get("cells", F.lit(0))
    return r.select("company_id", F.get(F.filter(label["Attributes"], lambda x: F.lower(x["Id"]) == "accountid"), F.lit(0))["Value"].alias("account_id"), label["Value"].alias("name"), amount(F.element_at("cells", -1)["Value"]).alias("closing"))


# The concepts of net assets in filings, the preferred one first.
NET_ASSETS = ("NetAssetsLiabilities", "NetAssetsLiabilitiesIncludingPensionAssetLiability", "Equity", "ShareholderFunds")


def net_assets(document: str | None) -> dict[str, Decimal]:
    """Net assets by period end from an inline XBRL document; the preferred concept wins, else the one that stands first."""
    try:
        root = ET.fromstring(document or "")
    except ET.ParseError:
        return {}
    name = lambda e: e.tag.rpartition("}")[2]
    ends: dict[str, str] = {}
    for c in root.iter():
        if name(c) == "context":
            found = [e.text.strip() for e in c.iter() if name(e) in ("instant", "endDate") and e.text]
            if found:
                ends[c.get("id", "")] = found[0]
    best: dict[str, tuple[int, Decimal]] = {}
    for f in root.iter():
        concept = f.get("name", "").rpartition(":")[2]
        end = ends.get(f.get("contextRef", ""))
        if name(f) != "nonFraction" or concept not in NET_ASSETS or end is None:
            continue
        text = "".join(f.itertext()).strip().replace(",", "")
        negative = f.get("sign") == "-" or text.startswith("(")
        try:
            value = Decimal(text.strip("()")) * Decimal(10) ** int(f.get("scale") or 0)
        except (InvalidOperation, ValueError):
            continue
        rank = 0 if concept == NET_ASSETS[0] else 1
        if end not in best or rank < best[end][0]:
            best[end] = rank, -value if negative else value
    return {k: v for k, (_, v) in best.items()}


@F.pandas_udf(T.ArrayType(T.StructType().add("period_end", T.StringType()).add("value", T.StringType())))
def _filing(documents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in documents:
        yield pd.Series([[{"period_end": k, "value": str(v)} for k, v in sorted(net_assets(d).items())] for d in part])


def filings(documents: DataFrame, xml_col: str = "document") -> DataFrame:
    """(company_id, period_end, source, value) of filed accounts: of several filings of a period, the latest filed counts. documents: company_id, filed_on, xml."""
    r = documents.select("company_id", "filed_on", F.explode(_filing(xml_col)).alias("f")).select("company_id", F.to_date("f.period_end").alias("period_end"), F.col("f.value").cast("decimal(18,2)").alias("value"), "filed_on")
    return r.groupBy("company_id", "period_end").agg(F.max_by("value", "filed_on").alias("value")).withColumn("source", F.lit("filing"))
