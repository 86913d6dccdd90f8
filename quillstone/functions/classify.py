"""Classifiers by words and codes: outgoings, delivery events, a vendor's usual account."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, upper

# Words in names of liability accounts by category, in the order in which they are tried; words that count only whole; codes.
OUTGOING_WORDS = {
    "credit_cards": ("credit card",),
    "vat": ("vat", "sales tax", "gst"),
    "paye_nic": ("paye", "p.a.y.e", "nic", "national insurance", "employee tax", "payg"),
    "net_wages": ("net wage", "wages payable", "net pay", "salary payable", "payroll payable"),
    "pension": ("pension", "superannuation", "nest", "auto enrol"),
    "corporation_tax": ("corporation tax", "corp tax", "income tax payable", "company tax"),
    "suppliers": ("accounts payable", "trade payable", "trade creditor", "creditor", "unpaid expense", "supplier"),
}
WHOLE_WORDS = {"vat", "gst", "nic", "paye", "payg", "p.a.y.e", "corp tax"}
OUTGOING_CODES = {"800": "suppliers", "801": "suppliers", "814": "net_wages", "820": "vat", "825": "paye_nic", "830": "corporation_tax"}
# What delivery events mean; events that aren't listed change nothing.
EVENTS = {"delivered": ("delivered", "delivery", "open", "click"), "bounced": ("bounce", "bounced", "hard_bounce", "hardbounce", "dropped"), "complained": ("complained", "complaint", "spamreport", "spam"), "failed": ("failed",)}


def outgoing_category(name: Column | str, code: Column | str, bank_type: Column | str | None = None, system: Column | str | None = None) -> Column:
    """A liability account's category: by its metadata, then its name, then its code; else loans_other."""
    low = F.lower(strip(name))
    out = F.lit("loans_other")
    for k, v in OUTGOING_CODES.items():
        out = F.when(strip(code) == k, v).otherwise(out)
    for category, words in reversed(OUTGOING_WORDS.items()):
        pattern = "|".join(rf"\b{re.escape(w)}\b" if w in WHOLE_WORDS else re.escape(w) for w in words)
        out = F.when(low.rlike(pattern), category).otherwise(out)
    if system is not None:
        out = F.when(upper(system) == "ACCPAY", "suppliers").otherwise(out)
    return out if bank_type is None else F.when(upper(bank_type) == "CREDITCARD", "credit_cards").otherwise(out)


def event_status(event: Column | str) -> Column:
    """A delivery event's status; null for events in passing."""
    e = F.lower(strip(event))
    out = F.lit(None).cast("string")
    for status, names in EVENTS.items():
        out = F.when(e.isin(*names), status).otherwise(out)
    return out


def vendor_account(vendor: Column | str, words: dict[str, str]) -> Column:
    """The account of the first word, in the map's order, that a vendor's name contains; null if none. The map is a company's own."""
    low = F.lower(strip(vendor))
    out = F.lit(None).cast("string")
    for w, code in reversed(words.items()):
        out = F.when(low.contains(w), code).otherwise(out)
    return out
