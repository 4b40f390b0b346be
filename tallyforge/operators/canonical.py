"""Canonical documents, lines and references from extracted JSON, and how payments are split over invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as n
from ..functions.money import reference_key

#: Names under which extractors give a field; the first one present counts, even if it is empty (fixed values).
NUMBER = ("document_number", "invoice_number", "receipt_number", "contract_number")
DATE = ("document_date", "invoice_date", "issue_date", "contract_date", "date")
TOTAL = ("total_amount", "total_value", "grand_total", "total", "amount")
VAT = ("vat_amount", "total_vat", "tva")
NET = ("net_amount", "net_total", "subtotal")
LINE_NET, LINE_PRICE, LINE_VAT = ("net_amount", "line_total", "total", "valoare"), ("unit_price", "unitPrice", "pret"), ("vat_amount", "tva")
REFERENCE, REFERENCE_AMOUNT = ("number", "document_number", "invoice_number", "reference"), ("amount", "payment_amount", "paid_amount")


def _is_object(v: Column) -> Column:
    """Only an object can be read as a struct; what is in it is not looked at."""
    return F.try_variant_get(v, "$", "struct<x:variant>").isNotNull()


def texts_of(v: Column, path: str, names: tuple[str, ...], many: bool = False) -> Column:
    """The named fields as texts, of an object or of each element of an array, read in one go. A path that isn't there costs
    Spark an exception, a field of a struct that isn't there costs nothing."""
    fields = f"struct<{','.join(f'{name}:string' for name in names)}>"
    return F.try_variant_get(v, path, f"array<{fields}>" if many else fields)


def first_text(x: Column, names: tuple[str, ...]) -> Column:
    """The first of the named fields that is there, of what texts_of has read."""
    return F.coalesce(*(x[name] for name in names))


def parsed(raw: DataFrame) -> DataFrame:
    """raw documents with their JSON parsed once, as v: the object `result`, else `data`, else the object itself; what is no
    object, or no JSON, is an empty one."""
    whole = raw.withColumn("_json", F.try_parse_json("fields_json"))
    inner = whole.withColumn("_in", F.try_variant_get("_json", "$", "struct<result:variant,data:variant>"))
    result, data = F.col("_in.result"), F.col("_in.data")
    found = F.when(_is_object(result), result).when(_is_object(data), data).when(F.col("_in").isNotNull(), F.col("_json")).otherwise(F.parse_json(F.lit("{}")))
    return inner.withColumn("v", found).drop("_json", "_in")


def canonical_documents(docs: DataFrame, own: Column) -> DataFrame:
    """Number, date, currency, direction and amounts: a total of 0 or more, a VAT up to it, and the stated net or what the
    VAT leaves of the total. docs come from parsed(); own is the tenant's tax id."""
    read = docs.select("*", texts_of(F.col("v"), "$", (*NUMBER, *DATE, *TOTAL, *VAT, *NET, "vendor_ein", "buyer_ein", "currency", "direction")).alias("_texts"))
    of = lambda *names: first_text(F.col("_texts"), names)
    text = lambda *names: F.trim(F.coalesce(of(*names), F.lit("")))
    vendor, buyer = n.tax_id_compare(text("vendor_ein")), n.tax_id_compare(text("buyer_ein"))
    got = read.select("document_id", text(*NUMBER).alias("number"), n.parse_date(of(*DATE)).alias("document_date"), n.currency_code(of("currency")).alias("currency"), n.direction(of("direction"), vendor, buyer, own).alias("direction"), n.money_positive(of(*TOTAL)).alias("total"), n.money_positive(of(*VAT)).alias("vat"), n.money_positive(of(*NET)).alias("net"))
    got = got.withColumn("vat", F.least("total", "vat"))
    return got.withColumn("net", F.when(F.col("net") > 0, F.col("net")).otherwise(F.greatest(F.lit(0.0), n._round2(F.col("total") - F.col("vat")))))


def exploded(docs: DataFrame, of: Column, at: str, name: str) -> DataFrame:
    """document_id with each element and its place. A plain explode lets Spark filter on the array's size first, and so
    make the array, and all that it is made of, once more for that filter."""
    return docs.select("document_id", F.posexplode_outer(of).alias(at, name)).where(F.col(at).isNotNull())


def canonical_lines(docs: DataFrame) -> DataFrame:
    """One row a line: a quantity of 0 or none is 1; the stated net, else quantity by price; the stated price, else net by
    quantity; no VAT is 0; a line without a name is `Articol n`."""
    texts = texts_of(F.col("v"), "$.line_items", ("quantity", *LINE_PRICE, *LINE_NET, *LINE_VAT, "name", "description"), many=True)
    at = exploded(docs, texts, "i", "x")
    signed = lambda *names: n.money_signed(first_text(F.col("x"), names))
    quantity = signed("quantity")
    at = at.select("document_id", F.col("i"), F.when(F.coalesce(quantity, F.lit(0.0)) == 0, 1.0).otherwise(quantity).alias("quantity"), signed(*LINE_PRICE).alias("price"), signed(*LINE_NET).alias("net"), F.coalesce(signed(*LINE_VAT), F.lit(0.0)).alias("vat"), n.text_of(first_text(F.col("x"), ("name", "description"))).alias("name"))
    net = F.coalesce("net", n._round2(F.col("quantity") * F.coalesce("price", F.lit(0.0))))
    at = at.withColumn("net", net)
    return at.select("document_id", (F.col("i") + 1).alias("line_no"), F.coalesce("name", F.concat(F.lit("Articol "), F.col("i") + 1)).alias("name"), "quantity", F.coalesce("price", n._round2(F.col("net") / F.col("quantity"))).alias("unit_price"), "net", "vat")


def canonical_references(docs: DataFrame) -> DataFrame:
    """Distinct numbers that a document refers to, in order: structured ones (texts or objects with an amount) win over
    plain lists and single fields; lists with commas are split."""
    fields = "struct<referenced_invoices:array<variant>,referenced_numbers:array<string>,invoice_reference:string,reference_number:string>"
    read = docs.select("document_id", F.try_variant_get("v", "$", fields).alias("_f"))
    of = lambda name: F.col(f"_f.{name}")
    amount = lambda t: F.nullif(n.money_positive(first_text(t, REFERENCE_AMOUNT)), F.lit(0.0))
    known = F.transform(of("referenced_invoices"), lambda x: F.struct(x.alias("x"), texts_of(x, "$", (*REFERENCE, *REFERENCE_AMOUNT)).alias("t")))
    from_objects = F.transform(known, lambda k: F.when(k["t"].isNotNull(), F.struct(F.trim(first_text(k["t"], REFERENCE)).alias("number"), amount(k["t"]).alias("amount"))).otherwise(F.struct(F.trim(F.try_variant_get(k["x"], "$", "string")).alias("number"), F.lit(None).cast("double").alias("amount"))))
    plain = F.concat(F.coalesce(of("referenced_numbers"), F.array().cast("array<string>")), F.array(of("invoice_reference"), of("reference_number")))
    split = F.flatten(F.transform(F.filter(plain, lambda x: x.isNotNull()), lambda x: F.split(x, ",")))
    from_plain = F.transform(split, lambda x: F.struct(F.trim(x).alias("number"), F.lit(None).cast("double").alias("amount")))
    found = F.filter(F.coalesce(from_objects, from_plain), lambda r: F.coalesce(r["number"] != "", F.lit(False)))
    any_ = of("referenced_invoices").isNotNull() | of("referenced_numbers").isNotNull() | of("invoice_reference").isNotNull() | of("reference_number").isNotNull()
    docs = read.select("document_id", F.when(any_, found).alias("_found"))
    rows = exploded(docs, F.col("_found"), "ord", "r").groupBy("document_id", "r.number").agg(F.min("ord").alias("ord"), F.min_by("r.amount", "ord").alias("amount"))
    return rows.select("document_id", "ord", "number", reference_key(F.col("number")).alias("key"), "amount")


def resolved_references(references: DataFrame, invoices: DataFrame) -> DataFrame:
    """References met with the invoices of their key: of several the newest, then the largest id; never the document
    itself. invoices: invoice_id, key, document_date."""
    newest = references.join(invoices, "key").where("invoice_id <> document_id")
    return newest.groupBy("document_id", "ord", "amount").agg(F.max_by("invoice_id", F.struct("document_date", "invoice_id")).alias("invoice_id"))


def _nearest(a: Column, b: Column) -> Column:
    """a / b in whole cents, half toward plus infinity."""
    twice = 2 * a + b
    return F.floor((twice - F.pmod(twice, 2 * b)) / (2 * b)).cast("long")


def payment_edges(payments: DataFrame, references: DataFrame) -> DataFrame:
    """Amounts, in cents, that a payment gives to each invoice: stated ones stay; what is left goes to the others in
    order, each an equal part of what remains, rounded, and the last one the rest.

    payments: document_id, cents; references: document_id, ord, invoice_id, cents (null: not stated). The references of
    one payment are gathered, never those of an invoice.
    """
    own = references.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "invoice_id", "cents"))).alias("refs"))
    met = payments.join(own, "document_id").withColumn("left", F.col("cents") - F.aggregate("refs", F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["cents"], F.lit(0))))
    missing = F.size(F.filter("refs", lambda r: r["cents"].isNull())).cast("long")
    begin = F.struct(F.col("left").alias("rest"), missing.alias("k"), F.array().cast("array<struct<invoice_id:bigint,cents:bigint>>").alias("out"))

    def give(a: Column, r: Column) -> Column:
        own_part = F.coalesce(r["cents"], F.when(a["k"] == 1, a["rest"]).otherwise(_nearest(a["rest"], a["k"])))
        open_ = r["cents"].isNull()
        return F.struct(F.when(open_, a["rest"] - own_part).otherwise(a["rest"]).alias("rest"), F.when(open_, a["k"] - 1).otherwise(a["k"]).alias("k"), F.array_append(a["out"], F.struct(r["invoice_id"].alias("invoice_id"), own_part.alias("cents"))).alias("out"))

    return met.select("document_id", F.explode(F.aggregate("refs", begin, give, lambda a: a["out"])).alias("e")).select("document_id", "e.invoice_id", "e.cents")


def open_items(invoices: DataFrame, edges: DataFrame) -> DataFrame:
    """Outstanding cents of each invoice after the payments that name it."""
    paid = edges.groupBy("invoice_id").agg(F.sum("cents").alias("paid"), F.count("*").alias("n_payments"))
    return invoices.join(paid, "invoice_id", "left").select("invoice_id", "cents", F.coalesce("paid", F.lit(0)).alias("paid"), (F.col("cents") - F.coalesce("paid", F.lit(0))).alias("outstanding"), F.coalesce("n_payments", F.lit(0)).alias("n_payments"))
