"""Secret scan: base patterns, and literals that an assignment-aware lexer ties to sensitive names.

The lexer looks at every assignment operator of a text (source code, INI, YAML, JSON, .env, keyword arguments), reads the
name to its left and the expression to its right, and keeps name-literal pairs. Constants propagate: where the right side names
another constant (``password = PREFIX + "x"``, ``${DB_PASS}``), its literals count for the sensitive target too. A literal is
scored by how sensitive its target's name is and by how much it looks like a generated or chosen secret. Values may stand in brackets (lists,
tuples), on the line after an open bracket or a YAML block mark, and as defaults of look-ups (``getenv("X", "default")``).

The work grows in proportion to the text: unquoted values of a run without blanks reach to its end for the run's first operator, and to the next operator for
those behind it; each definition is followed once, from the most sensitive name that reaches it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, plus, without

#: Fixed patterns of the base kinds: name, pattern, group that must be long enough, least length.
BASE = (
    ("assign", re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
LITERAL = "literal"
KINDS = ("assign", "access", "hex", LITERAL)

#: Name words and how sensitive they are; pairs of adjoining words; words that say the value is only about a secret.
WORDS = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.8, "secret": 1.0, "secrets": 0.9, "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.5, "bearer": 0.9, "authorization": 0.7, "salt": 0.5, "pin": 0.5, "otp": 0.6, "cookie": 0.5, "signature": 0.5}
PAIRS = {("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("auth", "key"): 0.9, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("account", "key"): 0.8, ("master", "key"): 0.9, ("shared", "key"): 0.8, ("client", "secret"): 1.0}
ABOUT = {"file", "path", "url", "uri", "name", "id", "count", "len", "length", "type", "field", "label", "expiry", "expires", "ttl", "limit", "max", "min", "size", "hint", "policy", "regex", "pattern", "placeholder", "reset", "prompt", "index"}
PLACEHOLDER = re.compile(r"(?i)^(change_?me|example|sample|dummy|test|none|null|nil|true|false|undefined|string|str|int|redacted|password|secret|token|x+|\*+|\.+|-+|0+|todo|tbd|your[_ -].*|<.*>|\[.*\]|\{.*\})$")
LOOKUPS = {"getenv", "environ", "env", "get", "config", "input", "getpass", "prompt", "require", "import", "open", "read"}
#: Pairs of adjoining words written as one, and the words of names that the scores don't list in the plural.
JOINED = {a + b: s for (a, b), s in PAIRS.items()}

OPERATOR = re.compile(r"[:=]")
STRING = re.compile(r"\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)'|`((?:\\.|[^`\\\n])*)`", re.DOTALL)
BARE = re.compile(r"[^\s,;'\"`(){}\[\]<>#&|]+")
BLOCK = re.compile(r"[ \t]*[|>][+-]?[ \t]*\r?\n[ \t]+")
LINE = re.compile(r"[^\r\n]*[^\s]")
BLANKS, ANY_BLANKS = re.compile(r"[ \t]*"), re.compile(r"\s*")
IDENT = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_]\w*)*")
HOLE = re.compile(r"\$\{(\w+)\}|\$(\w+)|%(\w+)%|\{(\w+)\}")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
THRESHOLD = 0.45


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS) of the base patterns, leftmost and non-overlapping per kind."""
    found = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), k))
    return found


#: No longer word is known.
LONGEST = max(map(len, [*WORDS, *JOINED]))


def word_score(word: str) -> float:
    """Of one word of a name, in the singular or plural, or of two words written as one."""
    shortest = min(len(word), max(3, len(word.rstrip("s"))))
    return max((max(WORDS.get(word[:n], 0.0), JOINED.get(word[:n], 0.0)) for n in range(shortest, min(len(word), LONGEST) + 1)), default=0.0)


def name_score(name: str) -> float:
    """0 to 1: how sensitive a target name is."""
    words = [w.lower() for w in PARTS.findall(name)]
    pairs_of = ((a, b.removesuffix("s")) for a, b in zip(words, words[1:], strict=False))
    best = max([word_score(w) for w in words] + [PAIRS.get(p, 0.0) for p in pairs_of], default=0.0)
    return best * (0.2 if words and words[-1] in ABOUT else 1.0)


def literal_score(value: str) -> float:
    """0 to 1: how much a literal looks like a secret."""
    if len(value) < 6 or PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    spaced = value.count(" ") > 3
    return (0.4 + 0.25 * (entropy >= 2.5) + 0.2 * mixed + 0.15 * (n >= 16)) * (0.4 if spaced else 1.0)


def _name_before(text: str, at: int) -> tuple[str, int]:
    """The name that ends before position at, less quotes and brackets around it, and where it starts."""
    e = at
    while e and text[e - 1] in " \t":
        e -= 1
    while e and text[e - 1] in "\"'`])":
        e -= 1
    s = e
    while s and (text[s - 1].isalnum() or text[s - 1] in "_$.-"):
        s -= 1
    return text[s:e].strip(".-"), s


class Runs:
    """Where unquoted values end. Positions must be asked for in ascending order of their operators."""

    def __init__(self, text: str, operators: list[int]):
        self.text, self.operators, self.end = text, operators, 0

    def value(self, at: int, operator: int) -> tuple[int, int] | None:
        """The unquoted value from at: to the end of its run for the run's first operator, to the next operator for others."""
        if at < self.end and operator < self.end:
            k = bisect_left(self.operators, at)
            to = min(self.end, self.operators[k] if k < len(self.operators) else self.end)
            return (at, to) if to > at else None
        m = BARE.match(self.text, at)
        if m is None:
            return None
        self.end = max(self.end, m.end())
        return at, m.end()


Term = tuple[str, int, int, str]


def _string(m: re.Match) -> Term:
    g = m.lastindex or 3
    return "lit", m.start(g), m.end(g), m[g]


def _listed(text: str, at: int) -> list[Term]:
    """Literals of a list or tuple whose bracket was before position at, until it closes, nests or assigns."""
    terms: list[Term] = []
    while True:
        at = ANY_BLANKS.match(text, at).end()
        if at < len(text) and text[at] == ",":
            at += 1
        elif m := STRING.match(text, at):
            terms.append(_string(m))
            at = m.end()
        elif (m := BARE.match(text, at)) and not OPERATOR.search(m[0]):
            terms.append(("bare", m.start(), m.end(), m[0]))
            at = m.end()
        else:  # a literal that an operator follows is a key, not an element
            return terms[:-1] if terms and at < len(text) and text[at] in ":=" else terms


def _default(text: str, at: int) -> list[Term]:
    """The default of a look-up whose bracket was before position at: a literal behind its first argument."""
    m = STRING.match(text, ANY_BLANKS.match(text, at).end()) or IDENT.match(text, ANY_BLANKS.match(text, at).end())
    at = ANY_BLANKS.match(text, m.end() if m else at).end()
    if m and at < len(text) and text[at] == "," and (found := STRING.match(text, ANY_BLANKS.match(text, at + 1).end())):
        return [_string(found)]
    return []


def _terms(text: str, operator: int, at: int, runs: Runs) -> list[Term]:
    """The right side from position at: (what: lit, bare or ref; start; end; value), joined by + or by standing side by side."""
    terms: list[Term] = []
    n, blanks = len(text), BLANKS
    if text[operator] == ":" and (m := BLOCK.match(text, at)):
        return [("bare", line.start(), line.end(), line[0])] if (line := LINE.match(text, m.end())) else []
    while True:
        at = blanks.match(text, at).end()
        while at < n and text[at] == "(":
            blanks = ANY_BLANKS
            at = blanks.match(text, at + 1).end()
        if at < n and text[at] in "[{" and not terms:
            return _listed(text, at + 1)
        if m := STRING.match(text, at):
            terms.append(_string(m))
            at = m.end()
            if blanks is ANY_BLANKS and not terms[1:] and text[(k := ANY_BLANKS.match(text, at).end()) : k + 1] == ",":
                return terms + _listed(text, k + 1)
        elif m := IDENT.match(text, at):
            if m.end() < n and text[m.end()] in "\"'" and len(m[0]) <= 2:  # prefixes of strings: b"", f"", rb""
                at = m.end()
                continue
            if m.end() < n and text[m.end()] == "(":
                if m[0].rpartition(".")[2].lower() in LOOKUPS:
                    return terms + _default(text, m.end() + 1)
                at, blanks = m.end() + 1, ANY_BLANKS
                continue
            b = runs.value(at, operator)
            if b and b[1] > m.end() and text[m.end()] != "+":
                terms.append(("bare", *b, text[b[0] : b[1]]))
                at = b[1]
            else:
                terms.append(("ref", m.start(), m.end(), m[0]))
                at = m.end()
        elif b := runs.value(at, operator):
            terms.append(("bare", *b, text[b[0] : b[1]]))
            at = b[1]
        else:
            return terms
        e = at
        while e < n and text[e] in " \t)":
            e += 1
        if e < n and text[e] == "+":
            at = e + 1
        elif e < n and text[e] in "\"'" and terms[-1][0] == "lit":
            at = e
        elif blanks is ANY_BLANKS and terms[-1][0] == "lit" and (k := ANY_BLANKS.match(text, at).end()) < n and text[k] in "\"'":
            at = k
        else:
            return terms


def pairs(text: str) -> list[tuple[str, list[tuple[str, int, int, str]]]]:
    """Name-literal pairs of a text in order: the target name, and the terms assigned to it."""
    found = []
    operators = [m.start() for m in OPERATOR.finditer(text)]
    runs = Runs(text, operators)
    for at in operators:
        end = at + 1
        if end < len(text) and text[end] in "=>:":  # ==, =>, ::, := and their like
            if text[end] == ">":
                end += 1
            else:
                continue
        left = at - 1 if at and text[at - 1] == ":" else at
        if at and text[at - 1] in "=!<>~+-*/":
            continue
        name, start = _name_before(text, left)
        if not name or not name[0].isalpha() and name[0] not in "_$":
            continue
        names = [name]
        back = start
        while back and text[back - 1] in " \t":
            back -= 1
        if text[at] == "=" and back and text[back - 1] == ":":  # an annotation: password: str = "..."
            names.append(_name_before(text, back - 1)[0])
        if terms := _terms(text, at, end, runs):
            found += [(x, terms) for x in names if x]
    return found


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants."""
    if ":" not in text and "=" not in text:
        return []
    all_pairs = pairs(text)
    targets = [(s, i) for i, (name, _) in enumerate(all_pairs) if (s := name_score(name.rpartition(".")[2])) > 0]
    if not targets:
        return []
    known: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(all_pairs):
        known.setdefault(name, []).append(i)
    spans: dict[tuple[int, int], float] = {}

    seen: set[int] = set()
    for score, first in sorted(targets, reverse=True):  # the most sensitive first: a definition's first visit counts
        todo = [first]
        while todo:
            i = todo.pop()
            if i in seen:
                continue
            seen.add(i)
            for what, start, end, value in all_pairs[i][1]:
                refs = [next(filter(None, h)) for h in HOLE.findall(value)] if what != "ref" else [value]
                for ref in refs:  # the last definition before this use, else the first one
                    if places := known.get(ref):
                        todo.append(places[max(0, bisect_left(places, i) - 1)])
                if what == "ref" or refs and what != "lit":
                    continue
                worth = score * literal_score(value)
                if what == "bare" and not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
                    worth = 0.0
                if worth >= THRESHOLD:
                    spans[start, end] = max(worth, spans.get((start, end), 0.0))
    return sorted(spans)


def scan(text: str | None) -> tuple[list[int], str, str]:
    """Counts of the base kinds, the base spans and all spans as kind:start:end, comma-joined."""
    base = sorted(base_spans(text or ""))
    counts = [sum(k == i for *_, k in base) for i in range(3)]
    every = base
    if more := literal_spans(text or ""):
        starts, ends = [a for a, *_ in base], list(accumulate((b for _, b, _ in base), max))
        covered = lambda s, e: (k := bisect_right(starts, s)) > 0 and ends[k - 1] >= e
        every = sorted(base + [(s, e, 3) for s, e in more if not covered(s, e)])
    show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)
    return counts, show(base), show(every)


def secret_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_assign, n_access, n_hex (long; base patterns only), base_spans and spans (string; with literals tied to sensitive names) to every row.

    Null and empty texts: counts 0 and empty strings. Long texts are scanned whole. Repeated rows: each is scanned. Spans that
    tie on their start come in the order of KINDS. Other columns pass through; input columns of the five names are replaced.
    An empty table gives an empty table.
    """
    new = ["n_assign", "n_access", "n_hex", "base_spans", "spans"]
    kept = without(docs, [n for n in new if n != text_col])
    schema = plus(kept, *((n, "long") for n in new[:3]), *((n, "string") for n in new[3:]))
    place = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column(place)]
            extra = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([r[k] for r in rows], pa.string()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *new])

    return bounded(kept).mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
