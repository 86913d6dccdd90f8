"""Column functions on text: white space, keys, names, codes, keywords."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a company name's comparison leaves out, and words that say little.
SUFFIXES = ("pvt", "ltd", "limited", "private", "inc", "incorporated", "llc", "llp", "plc", "co", "company", "corp", "corporation", "the")
FILLERS = ("agency", "club", "group", "holdings", "services", "service", "solutions", "solution", "consulting", "consultancy", "consultants", "partners", "associates", "enterprises", "enterprise", "trading", "ventures", "industries")

#: White space of any kind in Unicode.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Text less white space of any kind at both ends; null becomes empty."""
    return F.trim(F.coalesce(_c(col).cast("string"), F.lit("")), F.lit(WHITE))


def upper(col: Column | str) -> Column:
    return F.upper(strip(col))


def blank(col: Column | str) -> Column:
    return strip(col) == ""


def contact_key(contact: Column | str = "contact_id", vendor: Column | str = "vendor_name") -> Column:
    """The contact's id, else name: and the vendor's name in lower case."""
    return F.when(blank(contact), F.concat(F.lit("name:"), F.lower(strip(vendor)))).otherwise(strip(contact))


def payee_key(contact: Column | str = "contact_id", vendor: Column | str = "vendor_name") -> Column:
    return F.lower(F.when(blank(contact), strip(vendor)).otherwise(strip(contact)))


def squeezed(col: Column | str) -> Column:
    """Lower case, white space in single spaces."""
    return F.lower(F.regexp_replace(strip(col), r"(?U)\s+", " "))


def company_name(col: Column | str) -> Column:
    """Lower case words of letters and digits, without legal suffixes."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*SUFFIXES) & (w != "")), " ")


def distinctive_name(name: Column | str) -> Column:
    """A company_name without fillers; whole if nothing is left."""
    kept = F.filter(F.split(_c(name), " "), lambda w: ~w.isin(*FILLERS))
    return F.when(F.size(kept) == 0, _c(name)).otherwise(F.array_join(kept, " "))


def trigrams(col: Column | str) -> Column:
    """Distinct runs of three characters, spaces removed; the whole text if it is shorter."""
    s = F.replace(_c(col), F.lit(" "), F.lit(""))
    return F.when(F.length(s) < 3, F.array(s)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3)))))


def phone(col: Column | str) -> Column:
    """Digits without the country code 44 and a leading 0; null under six."""
    digits = F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"\D", "")
    local = F.when((F.length(digits) > 10) & digits.startswith("44"), F.substring(digits, 3, 99)).otherwise(digits)
    bare = F.regexp_replace(local, r"^0+", "")
    return F.when(F.length(bare) >= 6, bare)


def no_vat(col: Column | str) -> Column:
    """Whether a tax code says no VAT or outside the scope; a blank code doesn't."""
    c = F.replace(upper(col), F.lit(" "), F.lit(""))
    return c.isin("NONE", "NOTAX", "NOVAT") | c.contains("OUTSIDE")


def has_any(col: Column | str, words: Iterable[str]) -> Column:
    """Whether the lower-case text contains one of the words."""
    low = F.lower(F.coalesce(_c(col), F.lit("")))
    found = F.lit(False)
    for w in words:
        found = found | low.contains(w)
    return found


def phrase(col: Column | str, phrases: Iterable[str], plural: bool = True) -> Column:
    """The first whole-word phrase in a text, in lower case, longest first; empty if none."""
    ordered = sorted(phrases, key=lambda p: (-len(p), p))
    pattern = r"(?i)\b(" + "|".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in ordered) + ")" + ("s?" if plural else "") + r"\b"
    return F.lower(F.regexp_extract(F.coalesce(_c(col), F.lit("")), pattern, 1))


def currency_symbol(code: Column | str) -> Column:
    c = upper(code)
    return F.when((c == "") | (c == "GBP"), F.lit("£")).otherwise(F.concat(c, F.lit(" ")))


def money(col: Column | str) -> Column:
    return _c(col).cast("decimal(18,2)").cast("string")


def label_code(col: Column | str) -> Column:
    """The code in the last brackets of "Name (code)"; empty if there is none."""
    return F.trim(F.regexp_extract(strip(col), r"^.*\(([^()]*)\)$", 1))


def label_name(col: Column | str) -> Column:
    s = strip(col)
    return F.when(label_code(s) == "", s).otherwise(F.trim(F.regexp_extract(s, r"^(.*)\([^()]*\)$", 1)))


def slug(col: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(col)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def code_in_text(col: Column | str, low: int = 400, high: int = 599) -> Column:
    """The first number of three or four digits within bounds; null if there is none."""
    numbers = F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(r"\b(\d{3,4})\b"), 1)
    return F.get(F.filter(numbers, lambda n: n.cast("int").between(low, high)), F.lit(0))


def amount(col: Column | str) -> Column:
    """A number written with commas, or in brackets when negative; 0 if it is none."""
    s = F.replace(strip(col), F.lit(","), F.lit(""))
    negative = s.startswith("(") & s.endswith(")")
    value = F.regexp_replace(s, r"^\(|\)$", "").try_cast("decimal(18,2)")
    return F.coalesce(F.when(negative, -value).otherwise(value), F.lit(0)).cast("decimal(18,2)")
