"""Conversation structure repair by weighted CYK parsing over spans of turns.

The repaired roles must spell (s?(ua)+)?. The grammar is in Chomsky normal form: a nonterminal (p, q) stands for a span
that takes the automaton of that language from state p to state q, so (p, q) -> (p, r) (r, q), and a single turn gives
(p, q) by keeping, reroling or deleting it. Insertions, which need no turn, are closed over on both sides of each turn. A
cell has the least (cost, audit) of its span. Equal costs never come with an audit that begins another, as what follows
would be insertions, which cost; so the least of two parts makes the least of the whole.

Spans are combined bottom-up by length within runs of FAN leaves; the cells of these are the leaves of the next level, up
to one cell for a block of BLOCK turns, and on to one for the conversation. Blocks are cut wherever a sorted partition is,
so a long conversation is read, parsed and rewritten by many tasks; only the cells of its blocks meet in one.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, met_by_key, stored

#: States: 0 at the start, 1 after s, 2 after u, 3 after a; conversations end in 0 or 3.
MOVES = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLOCK, FAN = 64, 8

#: Bytes of text at which a block ends early.
BLOCK_BYTES = 4 << 20

Cell = dict[tuple[int, int], tuple[int, str]]


def combined(left: Cell, right: Cell) -> Cell:
    out: Cell = {}
    for (p, r), (c, a) in left.items():
        for q in range(4):
            if (r, q) in right:
                d, b = right[r, q]
                found = (c + d, a + b)
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def _closure() -> Cell:
    """Cells of no turn at all: insertions only."""
    one: Cell = {(p, p): (0, "") for p in range(4)} | {m: (INSERT, "I") for role in "ua" for m in MOVES[role]}
    while (more := combined(one, one)) != one:
        one = more
    return one


CLOSURE = _closure()
NONTERMINALS = sorted(combined({m: (0, "") for role in "s" for m in MOVES[role]} | {(p, p): (0, "") for p in range(4)}, CLOSURE))


@lru_cache(maxsize=None)
def _turn(symbol: str) -> Cell:
    """Cells of one turn. symbol: its role's initial (s, u, a or x), upper case if truncated, or d if it has to go."""
    cost = TRUNCATED if symbol.isupper() else 0
    own: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if symbol != "d":
        own |= {m: (REROLE + cost, "R") for role in "ua" for m in MOVES[role]}
        own |= {m: (cost, "K") for m in MOVES.get(symbol.lower(), ())}
    return combined(combined(CLOSURE, own), CLOSURE)


def parse(leaves: list[Cell]) -> Cell:
    """CYK over the leaves: the cell of each span from those of all its splits, by span length."""
    n = len(leaves)
    spans: dict[tuple[int, int], Cell] = {(i, i + 1): leaf for i, leaf in enumerate(leaves)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            best: Cell = {}
            for k in range(i + 1, i + size):
                for key, found in combined(spans[i, k], spans[k, i + size]).items():
                    if key not in best or found < best[key]:
                        best[key] = found
            spans[i, i + size] = best
    return spans[0, n] if n else CLOSURE


@lru_cache(maxsize=50_000)
def _run(symbols: str) -> Cell:
    return parse([_turn(s) for s in symbols])


class Levels:
    """Cells of a growing sequence, at most FAN - 1 waiting on each level."""

    def __init__(self):
        self.levels: list[list[Cell]] = []

    def add(self, cell: Cell, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(cell)
        if len(self.levels[level]) == FAN:
            self.add(parse(self.levels[level]), level + 1)
            self.levels[level] = []

    def whole(self) -> Cell:
        out: list[Cell] = []
        for level in self.levels:
            if level or out:
                out = [parse(level + out)]
        return out[0] if out else CLOSURE


def block_cells(symbols: str) -> Cell:
    levels = Levels()
    for i in range(0, len(symbols), FAN):
        levels.add(_run(symbols[i : i + FAN]))
    return levels.whole()


def best_of(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in ENDS if (0, q) in cell)


def segments(audit: str, sizes: list[int]) -> list[str]:
    """The audit cut at the blocks' ends; insertions between two blocks go with the later one, those at the end with the
    last."""
    out, at = [], 0
    for k, n in enumerate(sizes):
        end = at
        while n:
            n -= audit[end] != "I"
            end += 1
        end = len(audit) if k == len(sizes) - 1 else end
        out.append(audit[at:end])
        at = end
    return out


def rewritten(turns: list[tuple[str, str]], edits: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """(role, text) of the turns after the edits, and the state they lead to. A kept turn keeps its whole role; a new
    role is user, or assistant after a user."""
    out, i = [], 0
    for edit in edits:
        role, text = ("", "") if edit == "I" else turns[i]
        i += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = next(q for p, q in MOVES[role[0]] if p == state)
        out.append((role, text if edit != "I" else ""))
    return out, state


# Tables

_BLANK, _LAST = r"[^\x20\x09-\x0D]", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$"
_ROWS = "array<struct<role:string,text:string>>"
_CELLS = "array<struct<cost:bigint,audit:string>>"
_STATS = "n long, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long, first_turn long, last_turn long"
_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")


def faults(rows: DataFrame, used: list[DataFrame] | None = None) -> DataFrame:
    """rows with has_word, cut (its last character that isn't blank ends no sentence) and again (an earlier turn of the
    conversation has its role and text). Nulls in role and text count as one space. Rows that are equal even in the turn
    are told apart later, where they lie side by side."""
    filled = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    last = F.regexp_extract("text", _LAST, 1)
    known = stored(filled.withColumns({"digest": F.sha2("text", 256), "has_word": F.col("text").rlike(_BLANK), "cut": ~last.isin(".", "!", "?")}), "turns", used)
    at = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    first = stored(known.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("n"), F.min(at).alias("first_at")).where("n > 1"), "repeats", used)
    met = met_by_key(known, first, ["conv_id", "role", "digest"])
    return met.select("conv_id", "turn", "role", "text", "has_word", "cut", F.coalesce(F.col("first_at") < at, F.lit(False)).alias("again"))


def blocks(rows: DataFrame, size: int = BLOCK, used: list[DataFrame] | None = None) -> DataFrame:
    """Runs of up to `size` consecutive turns of one conversation, in the order of turn (nulls first), role and text: their
    turns, cells, counts and what the counts of a neighbour need. `at` orders the blocks of a conversation."""
    order = ["conv_id", "turn", "role"]
    placed = faults(rows, used).repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())

    def cut(batches):
        number, own, held, before = 0, [], 0, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                conv, turn, role, text, has_word, cut_, again, part = row
                if own and (own[0][0] != conv or len(own) == size or held >= BLOCK_BYTES):
                    out.append(_block(own, (own[0][7] << 40) + number))
                    number, own, held = number + 1, [], 0
                again = again or before == (conv, turn, role, text)
                before = (conv, turn, role, text)
                own.append((conv, turn, role, text, has_word, cut_, again, part))
                held += len(text)
            yield from _frames(out)
        if own:
            yield from _frames([_block(own, (own[0][7] << 40) + number)])

    id_type = placed.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "at", *(s.split()[0] for s in _STATS.split(", ")), "cells", "rows"]
    arrow = _arrow_types(placed.sparkSession, f"conv_id {id_type}, at long, {_STATS}, cells {_CELLS}, rows {_ROWS}")

    def _frames(out):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=names)

    return placed.mapInArrow(cut, f"conv_id {id_type}, at long, {_STATS}, cells {_CELLS}, rows {_ROWS}")


def _arrow_types(spark, ddl: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [to_arrow_type(f.dataType) for f in StructType.fromDDL(ddl)]


def _block(own: list[tuple], at: int) -> tuple:
    symbols, kinds = [], []
    for _, _, role, _, has_word, cut, again, _ in own:
        kind = "blank" if not has_word else "duplicate" if again else "truncated" if cut else ""
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        symbols.append("d" if kind in ("blank", "duplicate") else initial.upper() if kind else initial)
        kinds.append(kind)
    initials = [r[2][:1] for r in own]
    turns = [r[1] for r in own if r[1] is not None]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    cell = block_cells("".join(symbols))
    stats = (len(own), *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, initials[0], initials[-1], min(turns, default=None), max(turns, default=None), len(set(turns)), own[0][1], own[-1][1])
    cells = [{"cost": cell[nt][0], "audit": cell[nt][1]} if nt in cell else None for nt in NONTERMINALS]
    return (own[0][0], at, *stats, cells, [{"role": r[2], "text": r[3]} for r in own])


def plans(cut: DataFrame) -> DataFrame:
    """From blocks(): a row a block with its segment of the audit and the state before it, and in the row of each
    conversation's last block, where cost isn't null, what is known of the whole conversation. The cells of one
    conversation, not its turns, come to one task, which holds a few on each level and the audit."""
    light = cut.drop("rows").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    id_type = cut.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, at long, edits string, state int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    names, arrow = [s.split()[0] for s in schema.split(", ")], _arrow_types(cut.sparkSession, schema)
    columns = light.columns

    def fold(batches):
        conv, levels, ats, sizes, total = None, None, [], [], {}
        for batch in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(columns, values))
                if levels is None or row["conv_id"] != conv:
                    if levels is not None:
                        out += _planned(conv, levels, ats, sizes, total)
                    conv, levels, ats, sizes, total = row["conv_id"], Levels(), [], [], {}
                levels.add({nt: (c["cost"], c["audit"]) for nt, c in zip(NONTERMINALS, row["cells"]) if c is not None})
                ats.append(row["at"])
                sizes.append(row["n"])
                _count(total, row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=names)
        if levels is not None:
            out = _planned(conv, levels, ats, sizes, total)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=names)

    return light.mapInArrow(fold, schema)


def _count(total: dict, row: dict) -> None:
    """Adds a block's counts to those of the blocks before it."""
    if total:
        total["illegal"] += total["last"] + row["first"] not in LEGAL
        total["turns"] -= row["first_turn"] is not None and row["first_turn"] == total["last_turn"]
    for k in _COUNTS:
        total[k] = total.get(k, 0) + row[k]
    for k, choose in (("least", min), ("most", max)):
        total[k] = choose((v for v in (total.get(k), row[k]) if v is not None), default=None)
    total["last"], total["last_turn"] = row["last"], row["last_turn"]


def _planned(conv, levels: Levels, ats: list[int], sizes: list[int], total: dict) -> list[tuple]:
    cost, audit = best_of(levels.whole())
    gaps = 0 if total["least"] is None else total["most"] - total["least"] + 1 - total["turns"]
    made, odd, out = 0, len(audit.replace("D", "")) % 2, []
    for at, edits in zip(ats, segments(audit, sizes)):
        state = 0 if not made else 1 if odd and made == 1 else 3 if (made - odd) % 2 == 0 else 2  # an odd number of turns starts with s
        out.append([conv, at, edits, state, *[None] * 7])
        made += len(edits.replace("D", ""))
    out[-1][4:] = [gaps, *(total[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost, audit]
    return [tuple(r) for r in out]


def repaired_turns(cut: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, at, i, role and text of the turns after the repair, in the order of (at, i) within a conversation."""
    joined = cut.select("conv_id", "at", "rows").join(planned.select("at", "edits", "state").hint("merge"), "at").select("conv_id", "at", "rows", "edits", "state")
    schema = f"conv_id {cut.schema['conv_id'].dataType.simpleString()}, at long, i int, role string, text string"
    names, arrow = [s.split()[0] for s in schema.split(", ")], _arrow_types(cut.sparkSession, schema)

    def write(batches):
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                conv, at, rows, edits, state = values
                out = [(conv, at, i, role, text) for i, (role, text) in enumerate(rewritten([(r["role"], r["text"]) for r in rows], edits, state)[0])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=names)

    return joined.mapInArrow(write, schema)


def digests(cut: DataFrame, planned: DataFrame) -> DataFrame:
    """sha256 of each conversation's repaired turns, `role:text` joined by newlines. One hash has to read its turns one
    after the other, so the blocks of a conversation pass through one task, which holds a block at a time. The edits of a
    block come in a row of their own right before it, so the turns travel once."""
    none = lambda kind: F.lit(None).cast(kind)
    edits = planned.select("conv_id", "at", F.lit(False).alias("is_block"), "edits", "state", none(_ROWS).alias("rows"))
    turns = cut.select("conv_id", "at", F.lit(True).alias("is_block"), none("string").alias("edits"), none("int").alias("state"), "rows")
    both = edits.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "at", "is_block")
    schema = f"conv_id {cut.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    arrow = _arrow_types(cut.sparkSession, schema)

    def hashed(batches):
        conv, sha, begun, todo = None, None, False, ("", 0)
        frame = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=["conv_id", "repaired_sha256"])
        for batch in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if sha is None or values[0] != conv:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha, begun = values[0], hashlib.sha256(), False
                if not values[2]:
                    todo = values[3:5]
                    continue
                for role, text in rewritten([(r["role"], r["text"]) for r in values[5]], *todo)[0]:
                    sha.update((("\n" if begun else "") + f"{role}:{text}").encode())
                    begun = True
            if out:
                yield frame(out)
        if sha is not None:
            yield frame([(conv, sha.hexdigest())])

    return both.mapInArrow(hashed, schema)


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv_id with REPORT for each conversation of rows (conv_id, turn, role, text).

    gaps counts the missing turns between the smallest and the largest; blank, duplicate and truncated the first fault of
    each turn; illegal the neighbours whose role initials don't follow each other. Nulls in role and text count as one
    space, a null turn comes first and a null conv_id is a conversation; turns that are equal in turn, role and text are
    duplicates, and those that share only the turn go by role and text; texts of any length stay whole; other columns are
    dropped; an empty table gives no rows.
    """
    used: list[DataFrame] = []
    cut = stored(blocks(rows, size, used), "blocks")
    for df in used:
        dropped(df)
    planned = stored(plans(cut), "plans")
    whole = planned.where(F.col("cost").isNotNull()).drop("at", "edits", "state")
    sha = digests(cut, planned)
    return whole.alias("w").join(sha.alias("s").hint("merge"), F.col("w.conv_id").eqNullSafe(F.col("s.conv_id"))).select("w.conv_id", *REPORT)


# The query's own damage


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns after the damage that the hash of `conv_id:turn` deals: dropped, emptied, without sentence ends, repeated, or
    said by the user; nulls are one space."""
    blank = lambda c: F.coalesce(c, F.lit(" "))
    name = F.concat_ws(":", blank(F.col("conv_id").cast("string")), blank(F.col("turn").cast("string")))
    dealt = conversations.select("conv_id", "turn", blank(F.col("role")).alias("role"), blank(F.col("text")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return dealt.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """repair() of the damaged turns, for every conversation there was: one without turns has zeros, an empty audit and
    the hash of nothing."""
    got = repair(damaged(conversations))
    zero = {c: F.coalesce(f"g.{c}", F.lit(0)) for c in REPORT[:6]} | {"audit": F.coalesce("g.audit", F.lit("")), "repaired_sha256": F.coalesce("g.repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    all_ids = conversations.select("conv_id").distinct().alias("c")
    return all_ids.join(got.alias("g").hint("merge"), F.col("c.conv_id").eqNullSafe(F.col("g.conv_id")), "left").select("c.conv_id", *(v.cast("long" if k in REPORT[:6] else "string").alias(k) for k, v in zero.items()))


def _oracle() -> str:
    """The automaton row by row: the least (cost, audit) that reaches each state, with the text that it leaves."""
    closure = ", ".join(f"({p}, {q}, {c}, '{a}')" for (p, q), (c, a) in sorted(CLOSURE.items()))
    moves = ", ".join(f"('{role}', {p}, {q})" for role, ms in MOVES.items() for p, q in ms)
    said = "list_transform(range(length(i.a)), lambda k: CASE WHEN (greatest(d.q, 1) + k) % 2 = 1 THEN 'user:' ELSE 'assistant:' END)"
    crc = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"
    return rf"""WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
dealt AS (SELECT *, {crc} % 20 AS kind FROM named),
r AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM dealt WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, left(role, 1) AS x, left(lag(role) OVER w, 1) AS y
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
closure(p, q, c, a) AS (VALUES {closure}), moves(x, p, q) AS (VALUES {moves}),
edits AS MATERIALIZED (SELECT conv_id, i, p, p AS q, {DELETE} AS c, 'D' AS a, NULL AS said FROM f, (SELECT unnest([0, 1, 2, 3]) AS p)
  UNION ALL SELECT conv_id, i, p, q, CAST(fault = 't' AS INTEGER), 'K', role || ':' || text FROM f JOIN moves USING (x) WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, i, p, q, {REROLE} + CAST(fault = 't' AS INTEGER), 'R', CASE m.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text FROM f, moves m WHERE m.x <> 's' AND fault NOT IN ('b', 'd')),
steps AS MATERIALIZED (SELECT conv_id, i, p, q, min(struct_pack(c := c, a := a, said := said)) AS e FROM edits GROUP BY ALL),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, struct_pack(c := 0, a := '', said := []::VARCHAR[]) AS m FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i, q, min(m) FROM (
    SELECT d.conv_id, s.i, s.q, struct_pack(c := d.m.c + i.c + s.e.c, a := d.m.a || i.a || s.e.a, said := list_concat(d.m.said, {said}, CASE WHEN s.e.said IS NULL THEN [] ELSE [s.e.said] END)) AS m
    FROM dp d JOIN closure i ON d.q = i.p JOIN steps s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND s.i = d.i + 1 AND s.p = i.q) GROUP BY conv_id, i, q),
ends AS (SELECT d.conv_id, min(struct_pack(c := d.m.c + i.c, a := d.m.a || i.a, said := list_concat(d.m.said, {said}))) AS m
  FROM dp d JOIN closure i ON d.q = i.p JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM d.conv_id AND z.n = d.i WHERE i.q IN (0, 3) GROUP BY d.conv_id),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (i > 1 AND y || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(m.c, 0) AS BIGINT) AS cost, coalesce(m.a, '') AS audit, sha256(coalesce(array_to_string(m.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE = _oracle()
