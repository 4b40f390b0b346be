"""Readers and writers of exchanged files, on small fixtures."""

import pytest

from tallyforge.sources import files


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("encoding, sep", [("utf-8", ";"), ("utf-8-sig", ","), ("utf-16", "\t"), ("windows-1250", ";")])
def test_catalogue(spark, tmp_path, encoding, sep):
    lines = [["Cod", "Denumire articol", "Număr identificare"], ["1", f'"Ță{sep} ""x"""', " RO12 "], ["2", '"two\nlines"', ""]]
    (tmp_path / "a.csv").write_bytes("\n".join(sep.join(r) for r in lines).encode(encoding) if encoding != "windows-1250" else "\n".join(sep.join(r) for r in lines).replace("Ț", "Ţ").encode(encoding))
    got = files.read_catalogue(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["cod", "denumirearticol", "numaridentificare"]
    out = rows(got.select("cod", files.pick(got, "articol", "Denumire Articol"), files.pick_identification(got)).orderBy("cod"))
    assert out[0][1].replace("Ţ", "Ț") == f'Ță{sep} "x"' and out[0][2] == "RO12"
    assert out[1][1] == "two\nlines" and out[1][2] is None


def test_named_separator(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sep=|\ncod|nume\n1|a;b\n")
    assert rows(files.read_catalogue(spark, str(tmp_path / "a.csv"))) == [("1", "a;b")]


def test_partner_xml_round_trip(spark, tmp_path):
    have = spark.createDataFrame([("401.1", "A & B <x>", "RO1", None), ("401.2", "Ștefan", None, "DE")], "analytic string, name string, tax_id string, country string")
    files.write_partner_xml(have.coalesce(1), str(tmp_path / "p"))
    got = files.read_partner_xml(spark, str(tmp_path / "p"))
    assert sorted(rows(got.select("cod", "denumire", "codfiscal", "tara"))) == [("401.1", "A & B <x>", "RO1", "RO"), ("401.2", "Ștefan", None, "DE")]
    (tmp_path / "bad.xml").write_text("<!DOCTYPE x [<!ENTITY a 'b'>]><R><Linie><Cod>&a;</Cod></Linie></R>")
    with pytest.raises(ValueError):
        files.read_partner_xml(spark, str(tmp_path / "bad.xml"))


def test_rates(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<DataSet><Body><Cube date="2024-01-05"><Rate currency="EUR">4.97</Rate><Rate currency="HUF" multiplier="100">1.31</Rate><Rate currency="XXX">-</Rate></Cube></Body></DataSet>')
    got = {c: (str(d), round(r, 6)) for c, d, r in rows(files.read_rates_xml(spark, str(tmp_path / "r.xml")))}
    assert got == {"EUR": ("2024-01-05", 4.97), "HUF": ("2024-01-05", 0.0131)}
    (tmp_path / "r.json").write_text('{"date":"2024-01-05T10:00","currency":"100JPY","value":3.2}\n{"error":"none"}\n{"date":"2024-01-06","currency":"usd","value":"4.5"}\n')
    got = {c: (str(d), round(r, 6)) for c, d, r in rows(files.read_rates_json(spark, str(tmp_path / "r.json")))}
    assert got == {"JPY": ("2024-01-05", 0.032), "USD": ("2024-01-06", 4.5)}


def test_chart_of_accounts(spark, tmp_path):
    (tmp_path / "c.txt").write_text("Clasa 1 - Capital\n10. Capital si rezerve\n\n101. Capital\n1012. Capital subscris varsat (P)\nnoise\nClasa 2 - Imobilizari\n20. Necorporale\n")
    got = {c: (d, x) for c, d, x in rows(files.read_chart_of_accounts(spark, str(tmp_path / "c.txt")))}
    assert got["1012"] == ("Capital subscris varsat", "Clasa 1 - Capital > 10. Capital si rezerve > 101. Capital > 1012. Capital subscris varsat")
    assert got["20"] == ("Necorporale", "Clasa 2 - Imobilizari > 20. Necorporale") and len(got) == 4


def test_logistics_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Parc auto\n;;\nNr;Serie Șasiu;Masă;Locație\n1;wvwzzz1kz00000012;1.5 kg;Iași\n2;short;1;x\n3;WVWZZZ1KZ00000013;;\n")
    assert rows(files.read_logistics_sheet(spark, str(tmp_path / "s.csv")).orderBy("row_number")) == [("WVWZZZ1KZ00000012", 1.5, "Iași", 4), ("WVWZZZ1KZ00000013", None, None, 6)]
    (tmp_path / "n.csv").write_text("a;b\n")
    with pytest.raises(ValueError):
        files.read_logistics_sheet(spark, str(tmp_path / "n.csv"))


def test_events_hashes_and_flat_list(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"phase":"ocr","ms":5}\nbroken\n{"phase":"ai","ms":7}\n')
    assert sorted(rows(files.read_metric_events(spark, str(tmp_path / "m.jsonl"), "phase string, ms long"))) == [("ai", 7), ("ocr", 5)]
    assert files.content_hashes(spark, str(tmp_path / "m.jsonl")).first().length == 52
    one = spark.createDataFrame([("Invoice", 'A"1', "2024-01-05", "V", "1", None, "2", "RON", 1.0, 0.19, 1.19)], ", ".join(f"{c} {'double' if c in ('net', 'vat', 'total') else 'string'}" for c in files.FLAT_COLUMNS))
    files.write_flat_invoices(one.coalesce(1), str(tmp_path / "f"))
    text = next((tmp_path / "f").glob("*.csv")).read_text().splitlines()
    assert text[0].startswith('"Tip";"Numar"') and text[1] == '"Invoice";"A""1";"2024-01-05";"V";"1";"";"2";"RON";"1.0";"0.19";"1.19"'
