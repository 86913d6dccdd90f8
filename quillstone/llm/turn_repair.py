"""Conversation structure repair: window-derived faults, and a fold over each conversation's turns that finds the cheapest edits.

A conversation's roles should read `(s?(ua)+)?` by their initials. The fold carries four (cost, audit) structs, one for each state that a
prefix can end in: nothing yet, behind a system turn, behind a user turn, behind an assistant turn. Each turn is kept, given another role or
deleted, and empty turns may be inserted before any and at the end; `least` over the structs picks the cheapest edits and, among those, the audit that is
least by ASCII. That is right for prefixes: of two audits of one state, one cost and the same turns, neither starts with the other, as more inserts cost more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that don't make a text, and ends of sentences.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Costs of edits; TRUNCATED is added where a truncated turn stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copy, gone): turns damaged by crc32 of `conv_id:turn` modulo 20, null values as one space.

    0 drops the turn (gone), 1 empties its text, 2 removes its ends of sentences, 3 repeats it (copy 1), 4 makes it a user's.
    """
    kind = F.crc32(F.concat(F.coalesce(F.col(f"`{conv_col}`").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(f"`{turn_col}`").cast("string"), F.lit(" ")))) % 20
    text, role = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (text_col, role_col))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, f"[{ENDS}]", "")).otherwise(text)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    named = F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn")
    return turns.select(*named, F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copy"), (kind == 0).alias("gone"))


def flagged(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, copy, gone) with pos, initial, fault (blank, duplicate, truncated or null), illegal and fresh (the first of its turn number).

    Turns follow turn (nulls first), then role, text and copy. All windows lie within a conversation, so they share one exchange.
    """
    rows = turns.repartition("conv_id").withColumn("initial", F.substring("role", 1, 1))
    order = Window.partitionBy("conv_id", "gone").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    rows = rows.select("*", F.row_number().over(order).alias("pos"), F.lag("initial").over(order).alias("before"), F.lag("turn").over(order).alias("turn_before"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("pos")) > 1
    rows = rows.select("*", seen.alias("seen"), F.rtrim("text", F.lit(BLANKS)).alias("bare"))
    fault = F.when(F.col("bare") == "", "blank").when(F.col("seen"), "duplicate").when(~F.right("bare", F.lit(1)).isin(*ENDS), "truncated")
    illegal = ~F.concat("before", "initial").isin("su", "ua", "au")
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    return rows.select("conv_id", "turn", "role", "text", "gone", "pos", "initial", fault.alias("fault"), F.coalesce(illegal, F.lit(False)).alias("illegal"), fresh.alias("fresh"))


def _state(cost: int, audit: str) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("c"), F.lit(audit).alias("a"))


def _after(state: Column, cost: Column | int, edit: Column | str) -> Column:
    """state after an edit; null if state can't be reached."""
    edit = F.lit(edit) if isinstance(edit, str) else edit
    return F.when(state.isNotNull(), F.struct((state["c"] + cost).alias("c"), F.concat(state["a"], edit).alias("a")))


def _with_inserts(s: Column) -> Column:
    """States of s with up to two turns inserted behind it; a third would only lead back to where one or two have been."""
    u = F.least(s["u"], *[_after(s[x], INSERT, "I") for x in "esa"])
    a = F.least(s["a"], _after(s["u"], INSERT, "I"), *[_after(s[x], 2 * INSERT, "II") for x in "es"])
    return F.struct(s["e"].alias("e"), s["s"].alias("s"), u.alias("u"), a.alias("a"))


def _edited(s: Column, turn: Column) -> Column:
    """States behind one more turn, from states with inserts."""
    stays = turn["fault"].isNull() | (turn["fault"] == "truncated")
    extra = F.when(turn["fault"].isNull(), F.lit(0)).otherwise(F.lit(TRUNCATED))

    def said(state: Column, initial: str) -> Column:
        own = turn["initial"] == initial
        return F.when(stays, _after(state, extra + F.when(own, F.lit(0)).otherwise(F.lit(REROLE)), F.when(own, "K").otherwise("R")))

    deleted = {x: _after(s[x], DELETE, "D") for x in "esua"}
    system = F.when(stays & (turn["initial"] == "s"), _after(s["e"], extra, "K"))
    u = F.least(deleted["u"], *[said(s[x], "u") for x in "esa"])
    return F.struct(deleted["e"].alias("e"), F.least(deleted["s"], system).alias("s"), u.alias("u"), F.least(deleted["a"], said(s["u"], "a")).alias("a"))


def cheapest(turns: Column) -> Column:
    """(c, a): cost and audit of the cheapest edits of an ordered array of (initial, fault) structs."""
    none = F.when(F.lit(False), _state(0, ""))
    start = F.struct(_state(0, "").alias("e"), none.alias("s"), _state(INSERT, "I").alias("u"), _state(2 * INSERT, "II").alias("a"))
    fold = lambda s, t: F.transform(F.array(_edited(s, t)), _with_inserts)[0]  # noqa: E731  # through an array, so that each state is computed once
    return F.aggregate(turns, start, fold, lambda s: F.least(s["e"], s["a"]))


def repaired(turns: Column, audit: Column) -> Column:
    """The turns (role, text) that stay or are inserted, by the audit. Roles but a leading system's alternate, so a place gives the role of what isn't kept."""
    parts = F.split(audit, "(?<=[KRD])")  # a part for each turn, with the inserts before it, and one for the end
    made = lambda t, part: F.transform(F.filter(F.split(part, ""), lambda e: e.isin("K", "R", "I")), lambda e: F.struct(e.alias("edit"), t["role"].alias("role"), F.when(e == "I", "").otherwise(t["text"]).alias("text")))
    kept = F.flatten(F.zip_with(turns, parts, made))
    led = F.when((F.get(kept, F.lit(0))["edit"] == "K") & F.get(kept, F.lit(0))["role"].startswith("s"), 1).otherwise(0)
    role = lambda t, i, led: F.when(t["edit"] == "K", t["role"]).when((i - led) % 2 == 0, "user").otherwise("assistant")
    known = F.array(F.struct(kept.alias("kept"), led.alias("led")))  # through an array, so that it is computed once
    return F.transform(known, lambda x: F.transform(x["kept"], lambda t, i: F.struct(role(t, i, x["led"]).alias("role"), t["text"].alias("text"))))[0]


def repairs(turns: DataFrame) -> DataFrame:
    """A row for each conv_id of turns (conv_id, turn, role, text, copy, gone): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    gaps counts turn numbers missing between the least and the largest; illegal counts neighbours whose roles' initials aren't su, ua or au; repaired is the
    array of (role, text) after the edits. Each turn's first fault counts. Turns of null conv_id are one conversation; null turn numbers come first and make no gap; conversations without turns left have zeros,
    an empty audit and no repaired turns; an empty table gives an empty table. A conversation is one value of the result, so its turns meet in one task, as its repaired text must.
    """
    there = ~F.col("gone")
    of = lambda fault: F.count_if(there & (F.col("fault") == fault)).alias(fault)
    number = F.when(there, F.col("turn"))
    listed = F.collect_list(F.when(there, F.struct("pos", "initial", "fault", "role", "text")))
    gaps = F.coalesce(F.max(number) - F.min(number) + 1 - F.count_if(there & F.col("fresh")), F.lit(0)).cast("long")
    grouped = flagged(turns).groupBy("conv_id").agg(gaps.alias("gaps"), of("blank"), of("duplicate"), of("truncated"), F.count_if(there & F.col("illegal")).alias("illegal"), F.sort_array(listed).alias("turns"))
    best = grouped.withColumn("best", cheapest(F.col("turns")))
    return best.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.c").alias("cost"), F.col("best.a").alias("audit"), repaired(F.col("turns"), F.col("best.a")).alias("repaired"))


def digests(found: DataFrame) -> DataFrame:
    """repairs' rows with repaired_sha256, of lines `role:text`, instead of repaired."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")


def _sql() -> str:
    """digests(repairs(damaged(conversations))) in DuckDB SQL: a recursive walk over turns with the four states as (cost and audit, lines)."""
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384)))"
    after = lambda s, cost, edit, line: f"CASE WHEN {s} IS NOT NULL THEN {{'k': lpad((left({s}.k, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({s}.k, 10) || {edit}, 'o': {s}.o || {line}}} END"
    one = lambda *states: f"list_min([{', '.join(states)}])"
    user, reply = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    stays = "(fault IS NULL OR fault = 'truncated')"
    extra = f"(CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END)"

    def said(s: str, initial: str, role: str) -> str:
        kept = after(s, extra, "'K'", "chr(10) || role || ':' || text")
        other = after(s, f"{extra} + {REROLE}", "'R'", f"{role} || text")
        return f"CASE WHEN {stays} THEN CASE WHEN initial = '{initial}' THEN {kept} ELSE {other} END END"

    inserted_u = one("u", *[after(s, INSERT, "'I'", user) for s in "esa"])
    inserted_a = one("a", after("u", INSERT, "'I'", reply), *[after(s, 2 * INSERT, "'II'", f"{user} || {reply}") for s in "es"])
    gone = {s: after(s, DELETE, "'D'", "''") for s in "esua"}
    system = f"CASE WHEN {stays} AND initial = 's' THEN {after('e', extra, "'K'", "chr(10) || role || ':' || text")} END"
    edited = f"{gone['e']} AS e, {one(gone['s'], system)} AS s, {one(gone['u'], *[said(s, 'u', user) for s in 'esa'])} AS u, {one(gone['a'], said('u', 'a', reply))} AS a"
    nothing = "NULL::STRUCT(k VARCHAR, o VARCHAR)"
    return f"""WITH RECURSIVE
keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({crc}, 4294967295) % 20 AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[{ENDS}]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE kind != 0),
placed AS (SELECT *, substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER w AS pos, lag(substr(role, 1, 1)) OVER w AS before FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
flagged AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, coalesce(before || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM flagged GROUP BY conv_id),
folded AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'k': '000000000', 'o': ''}} AS e, {nothing} AS s, {nothing} AS u, {nothing} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT f.conv_id, t.pos, {edited} FROM (SELECT conv_id, pos, e, s, {inserted_u} AS u, {inserted_a} AS a FROM folded) f JOIN flagged t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.pos = f.pos + 1
),
ended AS (SELECT conv_id, {one("e", inserted_a)} AS best FROM folded QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, left(best.k, 9)::BIGINT AS cost, substr(best.k, 10) AS audit, sha256(substr(best.o, 2)) AS repaired_sha256 FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


SQL = _sql()
