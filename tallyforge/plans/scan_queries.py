"""Texts of scanned pages over blocks made of the turns of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import blocks
from ..sources.driver_tables import table


def _block(pos, id_, kind, text=None, selected=None, row=None, col=None, is_key=False, children=(), values=()):
    lit = lambda x: x if not isinstance(x, (str, int, bool, type(None))) else F.lit(x)
    ids = lambda xs: F.array(*map(lit, xs)).cast("array<string>")
    parts = {"pos": lit(pos).cast("long"), "id": lit(id_), "kind": F.lit(kind), "text": lit(text).cast("string"), "selected": lit(selected).cast("boolean"), "row": lit(row).cast("int"), "col": lit(col).cast("int"), "is_key": F.lit(is_key), "children": ids(children), "values": ids(values)}
    return F.struct(*(c.alias(k) for k, c in parts.items()))


def block_texts(spark, sf_dir):
    """A conversation is a page: its turns are the lines and the rows of a table with check boxes, below an empty row."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), "turn", "role", "text")
    n = F.col("turn")
    name = lambda what: F.concat(F.lit(what), n.cast("string"))
    cells = [_block(100 * n + k, name(f"cell{k}-"), "CELL", row=n + 2, col=k, children=[name(c) for c in below]) for k, below in ((1, ("role-",)), (2, ("turn-", "size-", "none-")), (3, ("box-",)))]
    words = [_block(100 * n + 10, name("role-"), "WORD", F.col("role")), _block(100 * n + 11, name("turn-"), "WORD", name("T")), _block(100 * n + 12, name("size-"), "WORD", F.length("text").cast("string")), _block(100 * n + 13, name("box-"), "SELECTION_ELEMENT", selected=F.col("role") == "user"), _block(100 * n + 14, name("line-"), "LINE", F.col("text"))]
    own = turns.select("document_id", F.inline(F.array(*cells, *words)))
    pages = turns.groupBy("document_id").agg(F.count("*").alias("n"), F.flatten(F.collect_list(F.array(*(name(f"cell{k}-") for k in (1, 2, 3))))).alias("cells"))
    keys = [_block(-9, "k1", "KEY_VALUE_SET", is_key=True, children=["w1", "w2"], values=["gone", "v1"]), _block(-8, "v1", "KEY_VALUE_SET", children=["w3"]), _block(-7, "w1", "WORD", "Turns"), _block(-6, "w2", "WORD", "said"), _block(-5, "w3", "WORD", F.col("n").cast("string")), _block(-4, "k2", "KEY_VALUE_SET", is_key=True, children=["w1"]), _block(-3, "k3", "KEY_VALUE_SET", is_key=True)]
    rest = pages.select("document_id", F.inline(F.array(*keys, _block(-1, "table", "TABLE").withField("children", F.col("cells")))))
    return blocks.block_texts(own.unionByName(rest))


def expense_texts(spark, sf_dir):
    """Four turns are a receipt: their texts the lines, their roles and sizes the items."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.floor(F.col("turn") / 4).cast("int").alias("receipt"), "turn", "role", "text")
    n = F.col("turn").cast("long")
    field = lambda part, pos, kind, label, value: F.struct(F.lit(part).alias("part"), n.alias("item"), (100 * n + pos).alias("pos"), F.lit(kind).alias("type"), F.lit(label).alias("label"), value.cast("string").alias("value"))
    even = F.when(n % 2 == 0, n)
    made = [field("line", 1, None, None, F.col("text")), field("summary", 2, "OTHER", "Role", F.col("role")), field("summary", 3, "TURN", "x", even), field("item", 4, "NOTE", None, even), field("item", 5, "PRICE", None, F.lit("0")), field("item", 6, "PRICE", None, F.length("text")), field("item", 7, "EXPENSE_ROW", None, F.col("text")), field("item", 8, "ITEM", None, F.concat(F.lit(" "), "role"))]
    return blocks.expense_texts(turns.select("document_id", "receipt", F.inline(F.array(*made))))


NAMES = (block_texts, expense_texts)


def oracle_sql():
    return {
        "block_texts": """SELECT conv_id AS document_id, concat_ws(chr(10) || chr(10), string_agg(text, chr(10) ORDER BY turn) FILTER (text <> ''),
  '--- TABLES ---' || chr(10) || '|  |  |  |' || chr(10) || string_agg('| ' || role || ' | T' || turn || ' ' || length(text) || ' | ' || CASE role WHEN 'user' THEN '[X]' ELSE '[ ]' END || ' |', chr(10) ORDER BY turn),
  '--- FORM FIELDS ---' || chr(10) || 'Turns said: ' || count(*) || chr(10) || 'Turns: ') AS text FROM conversations GROUP BY conv_id""",
        "expense_texts": """WITH r AS (SELECT conv_id, turn // 4 AS receipt, concat_ws(chr(10) || chr(10), string_agg(trim(text), chr(10) ORDER BY turn) FILTER (trim(text) <> ''),
  '--- EXPENSE SUMMARY FIELDS ---' || chr(10) || string_agg('Role: ' || role || CASE WHEN turn % 2 = 0 THEN chr(10) || 'TURN: ' || turn ELSE '' END, chr(10) ORDER BY turn),
  '--- LINE ITEMS ---' || chr(10) || '| ITEM | PRICE | NOTE |' || chr(10) || string_agg('| ' || role || ' | ' || length(text) || ' | ' || CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) ELSE '' END || ' |', chr(10) ORDER BY turn)) AS text FROM conversations GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY receipt) AS i FROM r)
SELECT conv_id AS document_id, string_agg(CASE WHEN c > 1 THEN '=== EXPENSE DOCUMENT ' || i || ' ===' || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY receipt) AS text FROM n GROUP BY conv_id""",
    }
