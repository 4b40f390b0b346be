"""Known cases of repaired lines, partner imports, vehicles and declarations."""

import datetime

from pyspark.sql import functions as F

from tallyforge.operators import declarations, line_checks, partners, vehicles

LINE = "document_id int, line_no int, name string, kind string, um string, vat string, vat_amount double, quantity double, unit_price double, total double"


def test_line_repairs(spark):
    rows = [
        (1, 1, "Motorină", None, "L", "NINETEEN", 85.15, 9.69, 41.84, 405.45),  # 21 % labelled 19, litres and price swapped
        (2, 1, "x", None, "buc", "TWENTYONE", None, 1.0, 121.0, 121.0),  # gross by its document
        (3, 1, "x", None, "buc", None, None, None, None, None),
        (4, 1, "x", None, "buc", "NINETEEN", 7.0, 1.0, 100.0, 100.0),  # no rate fits
    ]
    fixed = line_checks.repair_vat_rate(spark.createDataFrame(rows, LINE))
    docs = spark.createDataFrame([(2, 121.0, 21.0), (3, None, None)], "document_id int, total_amount double, doc_vat double")
    got = {r.document_id: r for r in line_checks.repair_fuel_swap(line_checks.lines_to_net(docs, fixed)).collect()}
    assert (got[1].vat, got[1].quantity, got[1].unit_price) == ("TWENTYONE", 50.63, 8.0081)
    assert (got[2].total, got[2].vat_amount, got[2].unit_price) == (100.0, 21.0, 100.0)
    assert got[3].total is None and got[4].vat == "NINETEEN"
    scores = line_checks.document_scores(docs, line_checks.line_checks(spark.createDataFrame(rows, LINE)))
    assert {r.document_id: r.score for r in scores.collect()} == {2: 1.0, 3: 0.2}


def test_partner_import(spark):
    have = spark.createDataFrame([(1, "Ana SRL", "RO12", "7", "RO", "COMPANY", "Iași"), (2, "Bob", None, None, "DE", "COMPANY", None), (3, "Same", "RO99", None, "RO", "COMPANY", None), (4, "Same", "99", None, "RO", "COMPANY", None)], "partner_id int, name string, tax_id string, supplier_code string, country string, kind string, city string")
    rows = [(1, "Ana", "ro12", None, None, None, None), (2, "Other", "RO55", "007", None, None, None), (3, "bob", "X1", None, "de", None, "Ulm"), (4, "Same", "RO99", None, None, None, None), (5, " ", None, None, None, None, None), (6, "New", "RO77", "8", None, None, "A"), (7, "New two", "RO 77", None, None, None, None), (8, "Pop", "123", None, None, "PF", None)]
    got = partners.match_partners(spark.createDataFrame(rows, "row_no int, name string, tax_id string, code string, country string, kind string, city string"), have, "supplier")
    out = {r.row_no: (r.partner_id, r.match_source, r.error) for r in got.collect()}
    assert out[1] == (1, "identification", None) and out[2] == (1, "code", "other identifier on file") and out[3] == (2, "name", None)
    assert out[4][2] == "identifier of several partners" and out[5][2] == "name missing" and out[8][2] == "not 13 digits"
    merged = {(r.partner_id, r.first_row): r for r in partners.merge_partners(have, got, "supplier").collect()}
    assert merged[1, None].name == "Ana" and merged[1, None].city == "Iași" and merged[2, None].tax_id == "X1"
    assert (merged[None, 6].name, merged[None, 6].code, merged[None, 6].city) == ("New two", "8", "A") and len(merged) == 5


def test_empty_imports(spark):
    rows = spark.createDataFrame([], "row_no int, name string, tax_id string, code string, country string, kind string, city string")
    have = spark.createDataFrame([(1, "Ana", None, None, None, None, None)], "partner_id int, name string, tax_id string, supplier_code string, country string, kind string, city string")
    got = partners.match_partners(rows, have, "supplier")
    assert got.count() == 0 and partners.merge_partners(have, got, "supplier").first().outcome == "kept"


def test_attached_and_answers(spark):
    cars = spark.createDataFrame([(1, 1, "WVWZZZ1KZ00000012"), (2, 2, "WVWZZZ1KZ00000012")], "tenant int, vehicle_id int, vin string")
    docs = spark.createDataFrame([(1, 1, "wvwzzz1kz00000012", None), (2, 2, "WVWZZZ1KZ00000013", 2), (3, 1, None, None)], "document_id int, tenant int, vin string, vehicle_id int")
    assert {r.document_id: (r.vehicle_id, r.needs_review) for r in vehicles.attach_documents(docs, cars).collect()} == {1: (1, False), 2: (2, True), 3: (None, False)}
    sent = spark.createDataFrame([(1, "SUBMITTED", "AIC", datetime.date(2024, 1, 30), None), (2, "INFIRMING", "TTN", datetime.date(2024, 1, 30), "OLDCODE0001"), (3, "SUBMITTED", "TTN", None, None)], "declaration_id int, status string, operation string, transport_date date, uit string")
    answers = spark.createDataFrame([(1, 1, "stare=nok"), (1, 2, '{"stare":"ok","UIT":"abc1234567"}'), (2, 1, "stare: respins")], "declaration_id int, answered_at int, body string")
    out = {r.declaration_id: (r.status, r.uit, r.valid_to_date) for r in declarations.declaration_status(sent, answers).collect()}
    assert out == {1: ("CONFIRMED", "ABC1234567", datetime.date(2024, 2, 14)), 2: ("CONFIRMED", "OLDCODE0001", None), 3: ("SUBMITTED", None, None)}
    assert spark.range(1).select(declarations.operation_of_origin(F.lit("ro"))).first()[0] == "TTN"
