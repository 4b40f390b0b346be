"""Texts of blocks and expense fields: known pages and odd ones."""

from tallyforge.sources import blocks

BLOCKS = "document_id long, pos long, id string, kind string, text string, selected boolean, row int, col int, is_key boolean, children array<string>, values array<string>, said string"
FIELDS = "document_id long, receipt int, part string, item int, pos int, type string, label string, value string, name string"


def block(doc, pos, id_, kind, text=None, selected=None, row=None, col=None, is_key=None, children=None, values=None):
    return (doc, pos, id_, kind, text, selected, row, col, is_key, children, values, "x")


def test_lines_tables_and_forms(spark):
    rows = [
        block(1, 2, "l2", "LINE", "Second line"), block(1, 1, "l1", "LINE", "First line", children=["w1"]), block(1, 3, "l3", "LINE", ""), block(1, 4, "p", "PAGE", "page"),
        block(1, 5, "t", "TABLE", children=["c11", "c12", "c22", "gone", "c22b", "c0", None]),
        block(1, 6, "c11", "CELL", row=1, col=1, children=["w1", "w2", "wx"]), block(1, 7, "c12", "CELL", row=1, col=2, children=["s1"]), block(1, 8, "c22", "CELL", row=2, col=2, children=["s2", "w2"]), block(1, 9, "c22b", "CELL", row=2, col=2, children=["w1"]), block(1, 9, "c0", "CELL", row=0, col=1, children=["w1"]),
        block(1, 10, "w1", "WORD", "Unit"), block(1, 11, "w2", "WORD", "price"), block(1, 12, "wx", "WORD", ""), block(1, 13, "s1", "SELECTION_ELEMENT", selected=True), block(1, 14, "s2", "SELECTION_ELEMENT"),
        block(1, 20, "t2", "TABLE", children=["d"]), block(1, 21, "d", "CELL", children=[]), block(1, 22, "t3", "TABLE"), block(1, 23, "t4", "TABLE", children=["w1"]),
        block(1, 30, "k", "KEY_VALUE_SET", is_key=True, children=["w1", "w2"], values=["v", "v2", "none"]), block(1, 31, "v", "KEY_VALUE_SET", is_key=False, children=["w2"]), block(1, 32, "v2", "KEY_VALUE_SET", children=["w1", "s2"]), block(1, 33, "k2", "KEY_VALUE_SET", is_key=True, children=["w1"]), block(1, 34, "k3", "KEY_VALUE_SET", is_key=True, children=["wx"], values=["v"]),
        block(2, 1, "a", "LINE", "Only"), block(2, 2, "c11", "CELL", children=["w1"]), block(3, 1, "w1", "WORD", "loose"), block(None, 1, "a", "LINE", "no page"),
    ]
    got = {r["document_id"]: r["text"] for r in blocks.block_texts(spark.createDataFrame(rows, BLOCKS).repartition(4)).collect()}
    assert got == {1: "First line\nSecond line\n\n--- TABLES ---\n| Unit price | [X] |\n|  | Unit |\n\n|  |\n\n--- FORM FIELDS ---\nUnit price: Unit [ ]\nUnit: ", 2: "Only", 3: "", None: "no page"}
    assert blocks.block_texts(spark.createDataFrame([], BLOCKS)).count() == 0


def test_expense_fields(spark):
    rows = [
        (1, 1, "line", None, 1, None, None, "SHOP", "x"), (1, 1, "line", None, 0, None, None, "Receipt", "x"),
        (1, 1, "summary", None, 2, "TOTAL", "Total", " 12.00 ", "x"), (1, 1, "summary", None, 3, "OTHER", "Casier", "Ana", "x"), (1, 1, "summary", None, 4, "other", "", "B", "x"), (1, 1, "summary", None, 5, None, None, "C", "x"), (1, 1, "summary", None, 6, "DATE", None, "  ", "x"),
        (1, 1, "item", 1, 7, "PRICE", None, "5", "x"), (1, 1, "item", 1, 8, "VAT", None, "1", "x"), (1, 1, "item", 1, 9, "ITEM", None, "Bread", "x"), (1, 1, "item", 1, 10, "PRICE", None, "6", "x"), (1, 1, "item", 2, 11, "EXPENSE_ROW", None, "Milk 6", "x"), (1, 1, "item", 3, 12, None, "l", "odd", "x"), (1, 1, "item", 4, 13, "ITEM", None, None, "x"),
        (2, 1, "line", None, 1, None, None, "A", "x"), (2, 2, "summary", None, 1, "TOTAL", None, "", "x"), (2, 3, "line", None, 1, None, None, "B", "x"),
    ]
    got = {r["document_id"]: r["text"] for r in blocks.expense_texts(spark.createDataFrame(rows, FIELDS).repartition(4)).collect()}
    assert got[1] == "Receipt\nSHOP\n\n--- EXPENSE SUMMARY FIELDS ---\nTOTAL: 12.00\nCasier: Ana\nother: B\nOTHER: C\n\n--- LINE ITEMS ---\n| ITEM | PRICE | VAT | OTHER |\n| Bread | 6 | 1 |  |\n|  |  |  | odd |"
    assert got[2] == "=== EXPENSE DOCUMENT 1 ===\nA\n\n=== EXPENSE DOCUMENT 3 ===\nB"
    assert blocks.expense_texts(spark.createDataFrame([], FIELDS)).count() == 0
