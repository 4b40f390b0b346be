"""Texts of scanned pages from the blocks and fields that a reader found on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of line items that come first, in this order (fixed values).
ITEM_COLUMNS = ("ITEM", "PRODUCT_CODE", "QUANTITY", "UNIT_PRICE", "PRICE")
WHOLE_ROW = "EXPENSE_ROW"


def _in_order(at: str | list[str], value: str, sep: str) -> Column:
    keys = [at] if isinstance(at, str) else at
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, F.col(value).alias("_v")))), lambda x: x["_v"]), sep)


def _texts(blocks: DataFrame) -> DataFrame:
    """document_id, id, said: the words and check boxes below each cell, key or value, in their order."""
    leaves = blocks.where("kind in ('WORD', 'SELECTION_ELEMENT')").select("document_id", F.col("id").alias("child"), F.when(F.col("kind") == "WORD", F.nullif("text", F.lit(""))).otherwise(F.when(F.col("selected"), "[X]").otherwise("[ ]")).alias("leaf"))
    below = blocks.where("kind in ('CELL', 'KEY_VALUE_SET')").select("document_id", "id", F.posexplode("children").alias("at", "child"))
    met = below.join(leaves.hint("merge"), ["document_id", "child"]).where("leaf is not null")
    return met.groupBy("document_id", "id").agg(F.trim(_in_order("at", "leaf", " ")).alias("said"))


def _tables(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """document_id, tables: the grids of a document, a row a line; the last of several cells in one place counts."""
    own = blocks.where("kind = 'TABLE'").select("document_id", F.col("pos").alias("table"), F.posexplode("children").alias("at", "id"))
    cells = blocks.where("kind = 'CELL'").select("document_id", "id", F.coalesce("row", F.lit(1)).alias("row"), F.coalesce("col", F.lit(1)).alias("col")).join(texts.hint("merge"), ["document_id", "id"], "left")
    met = own.join(cells.hint("merge"), ["document_id", "id"]).groupBy("document_id", "table", "row", "col").agg(F.coalesce(F.max_by("said", "at"), F.lit("")).alias("said"))
    grids = met.groupBy("document_id", "table").agg(F.max("row").alias("rows"), F.max("col").alias("cols"), F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "said"))).alias("cells")).where("rows > 0 and cols > 0")
    cell = lambda r, c: F.coalesce(F.col("cells")[F.struct(r.alias("row"), c.alias("col"))], F.lit(""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), F.col("cols")), lambda c: cell(r, c)), " | "), F.lit(" |"))
    drawn = grids.withColumn("grid", F.array_join(F.transform(F.sequence(F.lit(1), F.col("rows")), line), "\n"))
    return drawn.groupBy("document_id").agg(_in_order("table", "grid", "\n\n").alias("tables"))


def _forms(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """document_id, forms: `key: value` of each key with a text, the last value that is there."""
    keys = blocks.where("kind = 'KEY_VALUE_SET' and is_key").join(texts.hint("merge"), ["document_id", "id"]).where("said <> ''").select("document_id", "pos", "said", "values")
    found = keys.select("document_id", "pos", F.posexplode("values").alias("at", "id")).join(blocks.select("document_id", "id").hint("merge"), ["document_id", "id"])
    values = found.join(texts.hint("merge"), ["document_id", "id"], "left").groupBy("document_id", "pos").agg(F.max_by(F.coalesce("said", F.lit("")), "at").alias("value"))
    told = keys.join(values.hint("merge"), ["document_id", "pos"], "left").withColumn("line", F.concat("said", F.lit(": "), F.coalesce("value", F.lit(""))))
    return told.groupBy("document_id").agg(_in_order("pos", "line", "\n").alias("forms"))


def _sections(*parts: tuple[str, str]) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.when(F.col(c).rlike(r"\S"), F.concat(F.lit(head), F.col(c))) for head, c in parts))), "\n\n")


def block_texts(blocks: DataFrame) -> DataFrame:
    """document_id and text of each document: its lines, its tables as grids, and its form fields.

    blocks: document_id, pos (in the reader's order), id (one a document), kind (LINE, WORD, SELECTION_ELEMENT, TABLE, CELL,
    KEY_VALUE_SET), text, selected, row, col, is_key, children and values (ids). Ids that name no block, blocks of other
    kinds and null ids say nothing; a cell outside the grid goes; a document of no text has an empty one. What belongs
    together meets in joins on (document, id); only a table's cells and a document's sections are gathered.
    """
    blocks = blocks.select("document_id", "pos", "id", "kind", "text", "selected", "row", "col", "is_key", "children", "values")
    texts = _texts(blocks)
    lines = blocks.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == "LINE") & (F.col("text") != ""), F.struct("pos", "text")))), lambda x: x["text"]), "\n").alias("lines"))
    met = lines.join(_tables(blocks, texts).hint("merge"), "document_id", "left").join(_forms(blocks, texts).hint("merge"), "document_id", "left")
    return met.select("document_id", _sections(("", "lines"), ("--- TABLES ---\n", "tables"), ("--- FORM FIELDS ---\n", "forms")).alias("text"))


def expense_texts(fields: DataFrame) -> DataFrame:
    """document_id and text of each document: of every receipt on it the lines, the summary fields and the items as a grid.

    fields: document_id, receipt (its number on the page), part (line, summary or item), item (number of the line item),
    pos, type, label, value. A summary field is named by its type, or if that is OTHER or blank by its label; an item's
    fields by their type, known columns first, then others as they come; the last of several values counts. Blank values
    and the whole row go. Several receipts of a page are numbered; one without content has no text but its number.
    """
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    kind, label = text("type"), text("label")
    name = F.when((kind != "") & (F.upper(kind) != "OTHER"), kind).when(label != "", label).when(kind != "", kind).otherwise("OTHER")
    named = fields.select("document_id", "receipt", "part", "item", "pos", "type", "label", "value").withColumns({"value": text("value"), "name": F.when(F.col("part") == "summary", name).otherwise(F.when(kind != "", kind).otherwise("OTHER"))})
    said = lambda part, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("part") == part) & (F.col("value") != ""), F.struct("pos", c.alias("v"))))), lambda x: x["v"]), "\n")
    cell = F.when((F.col("part") == "item") & (F.col("value") != "") & (F.col("name") != WHOLE_ROW), F.struct("item", "pos", "name", "value"))
    own = named.groupBy("document_id", "receipt").agg(said("line", F.col("value")).alias("lines"), said("summary", F.concat_ws(": ", "name", "value")).alias("summary"), F.array_sort(F.collect_list(cell)).alias("cells"))
    names, items = F.transform("cells", lambda x: x["name"]), F.array_distinct(F.transform("cells", lambda x: x["item"]))
    first = F.filter(F.array(*map(F.lit, ITEM_COLUMNS)), lambda c: F.array_contains(names, c))
    own = own.withColumns({"cols": F.array_union(first, names), "ids": items})
    at = lambda i, c: F.coalesce(F.try_element_at(F.filter("cells", lambda x: (x["item"] == i) & (x["name"] == c)), F.lit(-1))["value"], F.lit(""))
    row = lambda values: F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
    grid = F.concat_ws("\n", row(F.col("cols")), F.transform("ids", lambda i: row(F.transform("cols", lambda c: at(i, c)))))
    own = own.withColumn("items", F.when(F.size("cells") > 0, grid)).withColumn("text", _sections(("", "lines"), ("--- EXPENSE SUMMARY FIELDS ---\n", "summary"), ("--- LINE ITEMS ---\n", "items")))
    each = own.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("receipt", "text"))).alias("rs"))
    several = F.size("rs") > 1
    parts = F.filter(F.transform("rs", lambda x, i: F.when(x["text"] != "", F.when(several, F.concat(F.lit("=== EXPENSE DOCUMENT "), i + 1, F.lit(" ===\n"), x["text"])).otherwise(x["text"]))), lambda x: x.isNotNull())
    return each.select("document_id", F.array_join(parts, "\n\n").alias("text"))
