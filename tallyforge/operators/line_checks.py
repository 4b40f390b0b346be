"""Checks and repairs of extracted lines: rates, products, fuel, gross lines, and the scores that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: VAT rates by label, and words and kinds that mark fuel and its unit (fixed values).
VAT_RATES = {"ZERO": 0, "FIVE": 5, "NINE": 9, "ELEVEN": 11, "NINETEEN": 19, "TWENTYONE": 21}
FUEL_WORDS, FUEL_KIND, LITRES = "motorin|benzin|diesel|gpl|carburant|combustibil", "COMBUSTIBILI", ("LITRU", "LITRI", "L")
FUEL_PRICE_MAX = 25.0
#: Scores of fields whose checks all passed, or one failed.
PASSED, FAILED = 0.97, 0.2


def tolerance(x: Column) -> Column:
    return F.greatest(F.lit(0.02), F.abs(x) * 0.01)


def close(a: Column, b: Column) -> Column:
    """Within two hundredths or one percent of the larger."""
    return F.abs(a - b) <= F.greatest(tolerance(a), tolerance(b))


def rate_of(label: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in VAT_RATES.items() for x in (kv[0], float(kv[1])))), label)


def _cents(x: Column, places: int = 2) -> Column:
    return F.floor(x * 10**places + F.lit(0.5)) / 10**places


def _fits(total: Column, vat: Column, rate: Column) -> Column:
    """The VAT follows from the total as a net or as a gross amount."""
    return close(total * rate / 100, vat) | close(total * rate / (rate + 100), vat)


def is_fuel_by_litre(name: Column, kind: Column, unit: Column) -> Column:
    fuel = F.coalesce(F.lower(name).rlike(FUEL_WORDS), F.lit(False)) | F.coalesce(F.upper(kind) == FUEL_KIND, F.lit(False))
    return fuel & F.coalesce(F.upper(unit).isin(*LITRES), F.lit(False))


def repair_vat_rate(lines: DataFrame) -> DataFrame:
    """A label that doesn't reproduce the VAT goes to the one positive rate that does; with none or several it stays."""
    total, vat = F.abs("total"), F.abs("vat_amount")
    hits = F.filter(F.array(*(F.when(_fits(total, vat, F.lit(float(r))), F.lit(k)) for k, r in VAT_RATES.items() if r)), lambda x: x.isNotNull())
    wrong = (total > 0) & (vat > 0) & ~F.coalesce(_fits(total, vat, rate_of(F.col("vat"))), F.lit(False))
    return lines.withColumn("vat", F.when(wrong & (F.size(hits) == 1), F.element_at(hits, 1)).otherwise(F.col("vat")))


def lines_to_net(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Gross lines become net: by their own VAT if it fits the gross reading only, without a VAT by the document, whose
    lines add up to its total and not to its total less VAT. documents: document_id, total_amount, doc_vat."""
    sums = lines.groupBy("document_id").agg(F.sum(F.col("total").cast("decimal(18,2)")).cast("double").alias("line_sum"))
    room = tolerance(F.col("total_amount"))
    gross_doc = (F.col("total_amount") > 0) & (F.col("doc_vat") > room) & (F.abs(F.col("line_sum") - F.col("total_amount")) <= room) & (F.abs(F.col("line_sum") - (F.col("total_amount") - F.col("doc_vat"))) > room)
    marked = documents.join(sums, "document_id").where(gross_doc).select("document_id", F.lit(True).alias("gross_doc"))
    rate, total, vat = rate_of(F.col("vat")), F.col("total"), F.abs("vat_amount")
    off_net, off_gross = F.abs(vat - F.abs(total * rate / 100)), F.abs(vat - F.abs(total * rate / (rate + 100)))
    own = (off_gross <= tolerance(vat)) & (off_gross <= off_net) & (off_net > tolerance(vat))
    gross = (rate > 0) & (total != 0) & F.when(vat > 0, own).otherwise(F.coalesce("gross_doc", F.lit(False)))
    got = lines.join(marked, "document_id", "left").withColumn("gross", F.coalesce(gross, F.lit(False)))
    net = _cents(total / (rate / 100 + 1))
    return got.withColumns({"total": F.when(F.col("gross"), net).otherwise(total), "vat_amount": F.when(F.col("gross"), _cents(total - net)).otherwise(F.col("vat_amount")), "unit_price": F.when(F.col("gross"), _cents(F.col("unit_price") / (rate / 100 + 1))).otherwise(F.col("unit_price"))}).drop("gross", "gross_doc")


def repair_fuel_swap(lines: DataFrame) -> DataFrame:
    """A price above 25 a litre next to a quantity that could be a price: the quantity was the gross price."""
    total, q, price = F.col("total"), F.col("quantity"), F.col("unit_price")
    litres = _cents((total + F.abs(F.coalesce("vat_amount", F.lit(0.0)))) / q)
    unit = _cents(total / litres, 4)
    swapped = is_fuel_by_litre(F.col("name"), F.col("kind"), F.col("um")) & (total > 0) & (price > FUEL_PRICE_MAX) & (q > 0) & (q <= FUEL_PRICE_MAX)
    ok = F.coalesce(swapped & (litres > 0) & (unit > 0) & (unit <= FUEL_PRICE_MAX), F.lit(False))
    return lines.withColumns({"quantity": F.when(ok, litres).otherwise(q), "unit_price": F.when(ok, unit).otherwise(price)})


def receipt_accounts(lines: DataFrame) -> DataFrame:
    """Fuel of receipts goes to 6022 with half of its VAT deductible."""
    fuel = F.coalesce(F.lower("name").rlike(FUEL_WORDS), F.lit(False)) | F.coalesce(F.upper("kind") == FUEL_KIND, F.lit(False))
    return lines.withColumns({"account": F.when(fuel, "6022").otherwise(F.col("account")), "deductibility": F.when(fuel, "PARTIAL_50").otherwise(F.col("deductibility"))})


def line_checks(lines: DataFrame) -> DataFrame:
    """A row for each line and rule that can be judged: document_id, line_no, field, rule, passed."""
    rate, total, vat, q, price = rate_of(F.col("vat")), F.col("total"), F.col("vat_amount"), F.col("quantity"), F.col("unit_price")
    rules = (
        ("vat_amount", "vat = total * rate", F.when(rate == 0, close(F.lit(0.0), vat)).otherwise(_fits(total, vat, rate))),
        ("total", "quantity * unit_price = total", F.when((q != 0) & (price != 0), close(q * price, total))),
        ("unit_price", "fuel price plausible", F.when(is_fuel_by_litre(F.col("name"), F.col("kind"), F.col("um")) & (price > 0), price <= FUEL_PRICE_MAX)),
    )
    judged = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"), p.alias("passed")) for f, r, p in rules))
    return lines.select("document_id", "line_no", F.explode(F.filter(judged, lambda x: x.passed.isNotNull())).alias("c")).select("document_id", "line_no", "c.*")


def document_checks(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Totals and VAT against the lines, and parties that must differ; same columns as of lines, without a line_no."""
    dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    sums = lines.groupBy("document_id").agg(dec("total").alias("line_sum"), dec("vat_amount").alias("line_vat"))
    total, line_sum, line_vat = F.col("total_amount"), F.col("line_sum"), F.coalesce("line_vat", F.lit(0.0))
    rules = (
        ("total_amount", "total = lines or lines + vat", close(total, line_sum) | close(total, line_sum + line_vat)),
        ("vat_amount", "vat = vat of lines", F.when(line_vat != 0, close(F.col("doc_vat"), line_vat))),
        ("buyer_tax_id", "parties differ", F.when((F.col("vendor_key") != "") & (F.col("buyer_key") != ""), F.col("vendor_key") != F.col("buyer_key"))),
    )
    judged = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"), p.alias("passed")) for f, r, p in rules))
    got = documents.join(sums, "document_id", "left").select("document_id", F.explode(F.filter(judged, lambda x: x.passed.isNotNull())).alias("c"))
    return got.select("document_id", F.lit(None).cast("int").alias("line_no"), "c.*")


def field_scores(checks: DataFrame) -> DataFrame:
    """The least score of each field, lines apart."""
    return checks.groupBy("document_id", "line_no", "field").agg(F.min(F.when(F.col("passed"), PASSED).otherwise(FAILED)).alias("score"), F.count("*").alias("n_checks"))


def document_scores(documents: DataFrame, checks: DataFrame) -> DataFrame:
    """The share of checks that passed, to three decimals; documents without any check are degenerate, at most 0.2."""
    got = checks.groupBy("document_id").agg(F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed"))
    ratio = F.floor(F.col("n_passed") * 1000 / F.col("n_checks") + F.lit(0.5)) / 1000
    return documents.select("document_id").join(got, "document_id", "left").select("document_id", F.coalesce("n_checks", F.lit(0)).alias("n_checks"), F.coalesce("n_passed", F.lit(0)).alias("n_passed"), F.coalesce(ratio, F.lit(FAILED)).alias("score"))


def line_confidence(checks: DataFrame, lines: DataFrame) -> DataFrame:
    """Each line: 0.2 if a check failed, 0.97 if all passed, 0.7 if none could be made. Lines that share a number share it."""
    worst = checks.where("line_no is not null").groupBy("document_id", "line_no").agg(F.min("passed").alias("ok"))
    return lines.select("document_id", "line_no").join(worst, ["document_id", "line_no"], "left").select("document_id", "line_no", F.when(F.col("ok"), PASSED).when(~F.col("ok"), FAILED).otherwise(0.7).alias("confidence"))
