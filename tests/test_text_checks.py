"""Reverse charge by VAT keys, marks and what was read."""

from tallyforge.operators import text_checks

HEAD = "# Bezeichnung Bestandsnr. MwSt. Kennz. Preis €\n  Description Stock ID VAT Key Price €\n"
CASES = [
    (HEAD + "001 Car KL94218 M 7.208,00\nTotal netto EUR 7.208,00", True, (False, "key")),
    (HEAD + "001 Papers KL94218 I 159,00\n002 Handling KL94218 I 299,00\nTotal netto EUR 835,00", False, (True, "key")),
    (HEAD + "001 Handling KL94218 e 299,00\nTotal netto", None, (True, "key")),
    ("MwSt. Kennz.\nVAT Key\nPreis €\n001\nHandling\nKL94218\n| I ;\n159,00\nTotal netto EUR", None, (True, "key")),
    ("MwSt. Kennz. / VAT Key\n001 Car KL94218 M 7.208,00\nReverse charge applies", None, (False, "key")),
    ("Invoice section I\nNo table of keys here", False, (False, "model")),
    ("Stock ID VAT Key PriceEUR\nFS10577 M\n9.382,50\nM = Margin scheme\nI = Intra-community - Reverse charge applies", True, (False, "key")),
    ("vat key\nTotal before\nFS10577 M\nSumme netto 5\nFS1057 I 9,00", True, (False, "key")),
    ("vat key\nnothing to read\nReverse charge", True, (True, "model")),
    ("vat key\nnothing to read\nReverse charge", None, (False, "model")),
    ("vat key\n" + "x\n" * 119 + "I 5,00", None, (True, "key")),
    ("vat key\n" + "x\n" * 120 + "I 5,00", None, (False, "model")),
    ("Se aplică TAXAREA INVERSĂ", None, (True, "marker")),
    ("some reverse-charge\r\nlines", False, (True, "marker")),
    (None, True, (True, "model")),
    ("", None, (False, "model")),
    ("MWSTKENNZEICHNUNG\rAB123 M", None, (False, "key")),
]


def test_cases(spark):
    rows = [(i, text, model, "x") for i, (text, model, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "document_id int, text string, model boolean, keys string").repartition(3)
    got = {r["document_id"]: (r["reverse_charge"], r["said_by"]) for r in text_checks.reverse_charge(df).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(CASES)}
    assert text_checks.reverse_charge(df.limit(0)).count() == 0
