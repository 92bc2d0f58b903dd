"""Conversation structure repair: the cheapest edits that give a legal sequence of roles.

Rows of a conversation are taken by turn (nulls first; ties by role, then text). Windows
flag each row's first fault: blank (no character but white space), duplicate (role and text
seen earlier in the conversation), truncated (its last character isn't a full stop,
exclamation or question mark). The role initials of a repaired conversation match
``(s?(ua)+)?``. Keep costs 0, Rerole to user or assistant 2, Delete 3 (required for blank
and duplicate rows), Insert an empty row 2; a truncated row that stays adds 1.

The sorted rows are collected as structs, and ``aggregate()`` folds them with four structs
(cost, audit), one for each state: nothing yet, after the system row, after a user, after an
assistant. A state's next struct is the ``least`` of what leads to it, so that ties go to the
ASCII-least audit. That is exact: insertions are made just before a row's own edit, so no
two audits of the same rows are prefixes of each other, and their order stays whatever
follows. An audit also fixes the state, and with it the roles and texts.

Scale: one shuffle by conversation for windows and lists. A conversation of over
``SEGMENT`` rows is folded in segments from each of the four states, and the segments'
results are folded in turn, so that audits aren't copied once a row. The hash is of a
conversation's whole repaired text, which has to fit one row.

Cases: null conv_ids are one conversation; a null role or text is one space, and so are a
null conv_id and turn in ``damaged``; repeated rows are rows of their own; a conversation
without rows has zeros, an empty audit and the hash of the empty string; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith.llm import common

SEGMENT = 256
WHITE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1  # costs
FAR = 1 << 40  # cost of a state that can't be reached
STATES = ("start", "s", "u", "a")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy (0; 1 for a repetition; null for a conversation's dropped rows), damaged by a hash of their place."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(what == 4, "user").otherwise(space("role"))
    none = F.lit(None).cast("int")
    copies = F.when(what == 0, F.array(none)).when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def flagged(rows: DataFrame) -> DataFrame:
    """rows with their place, initial, fault (blank, duplicate, truncated or null) and whether their initial may not follow the one before."""
    there = F.col("copy").isNotNull()
    in_order = Window.partitionBy("conv_id", "there").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    same = Window.partitionBy("conv_id", "there", "role", "text").orderBy("place")
    rows = rows.withColumn("there", there).withColumn("place", F.row_number().over(in_order)).withColumn("initial", F.substring("role", 1, 1))
    before = F.lag("initial").over(in_order)
    rows = rows.withColumn("illegal", before.isNotNull() & ~F.concat(before, F.col("initial")).isin("su", "ua", "au"))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(bare == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", fault)


def _plus(state: Column, cost, letters: str) -> Column:
    return F.struct((state["c"] + cost).alias("c"), F.concat(state["a"], F.lit(letters)).alias("a"))


def _begin(state: str) -> Column:
    """The four structs of one that stands in a state."""
    return F.struct(*(F.struct(F.lit(0 if s == state else FAR).cast("long").alias("c"), F.lit("").alias("a")).alias(s) for s in STATES))


def _bound(value: Column, use) -> Column:
    """use(value), where value is a lambda's variable: Spark repeats a column's expression at each use."""
    return F.transform(F.array(value), use)[0]


def _step(acc: Column, row: Column) -> Column:
    """The four structs after a row. Insertions come before the row's edit."""
    start, s, u, a = (acc[x] for x in STATES)
    stay = F.when(row["fault"].isin("blank", "duplicate"), FAR).when(row["fault"] == "truncated", TRUNCATED).otherwise(0).cast("long")
    keep = lambda initial: stay + F.when(row["initial"] == initial, 0).otherwise(FAR)

    def after(before_u: Column, before_a: Column, to_u: Column) -> Column:
        out = {
            "start": _plus(start, DELETE, "D"),
            "s": F.least(_plus(s, DELETE, "D"), _plus(start, keep("s"), "K")),
            "u": F.least(_plus(before_u, DELETE, "D"), _plus(to_u, keep("u"), "K"), _plus(to_u, stay + REROLE, "R")),
            "a": F.least(_plus(before_a, DELETE, "D"), _plus(before_u, keep("a"), "K"), _plus(before_u, stay + REROLE, "R")),
        }
        return F.struct(*(out[x].alias(x) for x in STATES))

    before_u = F.least(u, _plus(start, INSERT, "I"), _plus(s, INSERT, "I"), _plus(a, INSERT, "I"))
    with_a = lambda bu, ba: _bound(F.least(start, s, ba), lambda to_u: after(bu, ba, to_u))
    return _bound(before_u, lambda bu: _bound(F.least(a, _plus(bu, INSERT, "I")), lambda ba: with_a(bu, ba)))


def _fold(rows: Column, begin: Column) -> Column:
    return F.aggregate(rows, begin, _step)


def _join(acc: Column, maps: Column) -> Column:
    """The four structs after a segment. maps: what it makes of each state it may begin in."""

    def to(x: str) -> Column:
        ways = [F.struct((acc[e]["c"] + maps[e][x]["c"]).alias("c"), F.concat(acc[e]["a"], maps[e][x]["a"]).alias("a")) for e in STATES]
        return F.least(*ways).alias(x)

    return F.struct(*(to(x) for x in STATES))


def cheapest(rows: Column, segment: int = SEGMENT) -> Column:
    """The cheapest (c, a) of an array of rows with initial and fault."""
    parts = F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(segment)), lambda at: F.slice(rows, at, F.lit(segment)))
    folded = F.transform(parts, lambda part: F.struct(*(_fold(part, _begin(e)).alias(e) for e in STATES)))
    ends = F.when(F.size(rows) <= segment, _fold(rows, _begin("start"))).otherwise(F.aggregate(folded, _begin("start"), _join))
    return _bound(ends, lambda e: F.least(e["start"], e["a"], _plus(e["u"], INSERT, "I"), _plus(e["s"], 2 * INSERT, "II")))


def repaired(rows: Column, audit: Column) -> Column:
    """The rows (role, text) that an audit leaves, as an array."""
    edits = F.regexp_extract_all(audit, F.lit("I*[KRD]"), F.lit(0))
    blank = F.struct(F.lit("I").alias("edit"), F.lit("").alias("role"), F.lit("").alias("text"))
    own = lambda row, edit: F.struct(F.right(edit, F.lit(1)).alias("edit"), row["role"].alias("role"), row["text"].alias("text"))
    made = lambda row, edit: F.concat(F.array_repeat(blank, F.length(edit) - 1), F.filter(F.array(own(row, edit)), lambda x: x["edit"] != "D"))
    tail = F.array_repeat(blank, F.length(audit) - F.length(F.rtrim(audit, F.lit("I"))))
    out = F.concat(F.flatten(F.zip_with(rows, edits, made)), tail)

    def named(items: Column) -> Column:
        first = F.get(items, F.lit(0))
        system = F.when((first["edit"] == "K") & (F.substring(first["role"], 1, 1) == "s"), 1).otherwise(0)
        role = lambda x, k: F.when(x["edit"] == "K", x["role"]).when((k - system) % 2 == 0, "user").otherwise("assistant")
        return F.transform(items, lambda x, k: F.struct(role(x, k).alias("role"), x["text"].alias("text")))

    return _bound(out, named)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, faults, illegal, cost, audit and turns (the repaired rows) of each conversation. rows: as ``damaged`` gives them."""
    rows = flagged(rows.repartition("conv_id"))  # one shuffle for windows and lists
    of = lambda test: F.count(F.when(F.col("there") & test, 1))
    turn = F.when(F.col("there"), F.col("turn"))
    item = F.when(F.col("there"), F.struct("place", "initial", "fault", "role", "text"))
    grouped = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.size(F.collect_set(turn)), F.lit(0)).cast("long").alias("gaps"),
        *(of(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")),
        of(F.col("illegal")).alias("illegal"),
        F.array_sort(F.collect_list(item)).alias("rows"),
    )
    best = grouped.withColumn("best", cheapest(F.col("rows"), segment))
    return best.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.c").alias("cost"), F.col("best.a").alias("audit"), repaired(F.col("rows"), F.col("best.a")).alias("turns")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair(damaged(common.table(spark, sf_dir, "conversations")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.select(*found.columns[:-1], F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))


#: DuckDB SQL. A state is its cost in six digits before its audit, so that least() takes the cheaper, then the ASCII-least.
_FAR = 500_000


def _sql_plus(x: str, k: object, letters: str) -> str:
    return f"(lpad(CAST(CAST({x}[1:6] AS INT) + {k} AS VARCHAR), 6, '0') || {x}[7:] || '{letters}')"


def _sql_keep(initial: str) -> str:
    return f"least(stay + CASE WHEN initial = '{initial}' THEN 0 ELSE {_FAR} END, {_FAR})"


#: crc32 of a text x, bit by bit.
_SQL_CRC = "xor(list_reduce(list_transform(range(1, octet_length(encode(x)) + 1), lambda i: CAST(('0x' || hex(encode(x))[2 * i - 1:2 * i]) AS BIGINT)), lambda c, b: list_reduce(range(0, 8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)), 4294967295), 4294967295)"
_SQL_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL = f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS x FROM conversations),
hurt AS (SELECT *, {_SQL_CRC} % 20 AS k FROM raw),
rows0 AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hurt WHERE k <> 0),
placed AS (SELECT *, row_number() OVER o AS place, role[1:1] AS initial, lag(role[1:1]) OVER o AS before FROM rows0 WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
bare AS (SELECT *, rtrim(text, {_SQL_WHITE}) AS b, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth FROM placed),
faults AS MATERIALIZED (SELECT *, CASE WHEN b = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN b[-1:] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM bare),
costs AS MATERIALIZED (SELECT conv_id, place, CASE WHEN fault IN ('blank', 'duplicate') THEN {_FAR} WHEN fault = 'truncated' THEN 1 ELSE 0 END AS stay, initial FROM faults),
convs AS MATERIALIZED (SELECT DISTINCT conv_id FROM conversations),
fold(conv_id, place, z, s, u, a) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '000000', '{_FAR}', '{_FAR}', '{_FAR}' FROM convs
  UNION ALL
  SELECT conv_id, place, {_sql_plus('z', 3, 'D')}, least({_sql_plus('s', 3, 'D')}, {_sql_plus('z', _sql_keep("s"), 'K')}),
    least({_sql_plus('bu', 3, 'D')}, {_sql_plus('tu', _sql_keep("u"), 'K')}, {_sql_plus('tu', 'stay + 2', 'R')}),
    least({_sql_plus('ba', 3, 'D')}, {_sql_plus('bu', _sql_keep("a"), 'K')}, {_sql_plus('bu', 'stay + 2', 'R')})
  FROM (SELECT *, least(z, s, ba) AS tu FROM (SELECT *, least(a, {_sql_plus('bu', 2, 'I')}) AS ba FROM (
    SELECT f.conv_id, c.place, c.stay, c.initial, z, s, u, a, least(u, {_sql_plus('z', 2, 'I')}, {_sql_plus('s', 2, 'I')}, {_sql_plus('a', 2, 'I')}) AS bu FROM fold f JOIN costs c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.place = f.place + 1)))),
best AS (SELECT conv_id, CAST(best[1:6] AS BIGINT) AS cost, best[7:] AS audit FROM (SELECT conv_id, place, least(z, a, {_sql_plus('u', 2, 'I')}, {_sql_plus('s', 4, 'II')}) AS best, row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) AS r FROM fold) WHERE r = 1),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS j FROM best WHERE audit <> ''),
numbered AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS place FROM letters),
made AS (SELECT n.conv_id, n.j, n.edit, f.role, f.text, row_number() OVER (PARTITION BY n.conv_id ORDER BY n.j) - 1 AS k, first_value(n.edit = 'K' AND f.initial = 's') OVER (PARTITION BY n.conv_id ORDER BY n.j) AS system
  FROM numbered n LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.place = n.place AND n.edit <> 'I' WHERE n.edit <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - CASE WHEN system THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired FROM made GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""
