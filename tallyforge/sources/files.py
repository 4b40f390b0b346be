"""Files that users exchange: delimited catalogues, partner XML, rate feeds, charts of accounts, logistics sheets, metric
events, and the exports of the same kinds."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.normalise import ascii_fold, text_of, vin_or_null

#: Currencies that JSON feeds quote for a hundred units (fixed values).
PER_HUNDRED = ("HUF", "JPY", "KRW", "IDR", "ISK")
#: Letters of windows-1250 by those of ISO-8859-1 in their places.
WINDOWS_1250 = {chr(b): x for b in range(128, 256) if (x := bytes([b]).decode("windows-1250", "ignore")) and x != chr(b)}
#: Headers of identification numbers, and what else makes a header one (fixed values).
IDENTIFICATION = ("taxid", "cui", "cif", "ein", "codfiscal", "cnp", "cuicnp", "cnpcui", "cuicnpidextern", "cifcnp", "codfiscalcnp", "identificator", "idextern", "numaridentificare", "identificationnumber", "vatnumber")
IDENTIFICATION_PARTS = ("codfiscal", "identific", "vatnumber", "cui", "cif", "cnp")
#: Columns of the flat invoice list, and of the sheet with weights (fixed values).
FLAT_COLUMNS = {"type": "Tip", "number": "Numar", "date": "Data", "vendor": "Furnizor", "vendor_tax_id": "CUI furnizor", "buyer": "Client", "buyer_tax_id": "CUI client", "currency": "Moneda", "net": "Baza", "vat": "TVA", "total": "Total"}
SHEET_COLUMNS = {"vin": "seriesasiu", "weight": "masa", "city": "locatie"}
PARTNER_TAGS = {"analytic": "Cod", "name": "Denumire", "tax_id": "Cod_fiscal", "country": "Tara", "city": "Localitate", "address": "Adresa", "iban": "Cont_banca", "bank": "Banca", "phone": "Tel", "email": "Email", "code": "Guid_cod"}


def header_key(name: str) -> str:
    """Without diacritics, lower case, letters and digits only."""
    bare = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]", "", bare.lower())


def normalise_headers(df: DataFrame) -> DataFrame:
    """Columns by their keys; of columns with one key the last counts, those without a key go."""
    keys = {header_key(c): c for c in df.columns}
    return df.select(*(F.col(f"`{c}`").alias(k) for k, c in keys.items() if k))


def pick(df: DataFrame, *names: str) -> Column:
    """The first value that isn't blank among the columns of these names; null if there is none."""
    return F.coalesce(F.lit(None).cast("string"), *(text_of(F.col(k)) for k in map(header_key, names) if k in df.columns))


def pick_identification(df: DataFrame) -> Column:
    """An identification number: from its known headers first, then from any header that looks like one."""
    like = [c for c in df.columns if "tip" not in c and any(part in c for part in IDENTIFICATION_PARTS)]
    return pick(df, *IDENTIFICATION, *like)


def _sniff(spark: SparkSession, path: str, lines: int = 1) -> tuple[str, str, bool]:
    """Encoding, separator and whether a first line only names the separator, from the first lines of one file."""
    head = spark.read.format("binaryFile").load(path).orderBy("path").select(F.substring("content", 1, 4096).alias("head")).first()
    raw = bytes(head["head"]) if head else b""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        encoding = "UTF-16"
    elif len(raw) > 8 and sum(b == 0 for b in raw[1:2048:2]) > min(len(raw), 2048) / 8:
        encoding = "UTF-16LE"
    else:
        try:
            raw.decode("utf-8")
            encoding = "UTF-8"
        except UnicodeDecodeError as e:
            encoding = "UTF-8" if e.start >= len(raw) - 3 and len(raw) == 4096 else "windows-1250"
    first = raw.decode(encoding, "replace").lstrip("﻿​").splitlines()[:lines] or [""]
    named = re.fullmatch(r"sep=(.)\s*", first[0], re.I)
    if named:
        return encoding, named[1], True
    votes = {sep: "\n".join(first).count(sep) for sep in (";", ",", "\t")}
    best = max(votes, key=votes.get)
    return encoding, best if votes[best] else ",", False


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files of one layout, all columns text, by normalised headers. Encoding and separator come from the first
    file; a first line sep=x is skipped. Quoted fields may hold separators, doubled quotes and line ends."""
    encoding, sep, named = _sniff(spark, path)
    recode = WINDOWS_1250 if encoding == "windows-1250" else {}
    got = spark.read.option("sep", sep).option("encoding", "ISO-8859-1" if recode else encoding).option("quote", '"').option("escape", '"').option("multiLine", True).option("ignoreLeadingWhiteSpace", True)
    if not named:
        return _recoded(got.option("header", True).csv(path), recode)
    rows = got.csv(path).where(~F.coalesce(F.lower("_c0").rlike("^\ufeff?sep="), F.lit(False)))
    names = rows.first()
    if names is None:
        return rows
    body = rows.where(~F.struct(*rows.columns).eqNullSafe(F.struct(*map(F.lit, names))))
    return _recoded(body.toDF(*(name or f"_{i}" for i, name in enumerate(names))), recode)


def _recoded(df: DataFrame, recode: dict[str, str]) -> DataFrame:
    """Spark doesn't read windows-1250, so it is read as another encoding of single bytes and its letters put right."""
    if recode:
        table = str.maketrans(recode)
        df = df.select(*(F.translate(F.col(f"`{c}`"), "".join(recode), "".join(recode.values())).alias(c.translate(table)) for c in df.columns))
    return normalise_headers(df)


def read_partner_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each Linie, text columns by normalised tags. Files that declare a DOCTYPE or entities are refused."""
    declared = spark.read.text(path).where(F.col("value").rlike(r"(?i)<!(DOCTYPE|ENTITY)"))
    if not declared.isEmpty():
        raise ValueError("the XML declares a DOCTYPE or entities")
    return normalise_headers(spark.read.option("rowTag", "Linie").option("inferSchema", False).option("nullValue", "").xml(path))


def read_rates_xml(spark: SparkSession, path: str) -> DataFrame:
    """currency, rate_date and rate of one unit from daily feeds; rates that aren't above 0 go."""
    rate = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_currency", T.StringType()), T.StructField("_multiplier", T.StringType())])
    cube = T.StructType([T.StructField("_date", T.StringType()), T.StructField("Rate", T.ArrayType(rate))])
    rows = spark.read.schema(cube).option("rowTag", "Cube").xml(path).select("_date", F.explode("Rate").alias("r"))
    value = F.col("r._VALUE").try_cast("double") / F.coalesce(F.col("r._multiplier").try_cast("double"), F.lit(1.0))
    return rows.select(F.upper("r._currency").alias("currency"), F.to_date("_date").alias("rate_date"), value.alias("rate")).where("rate > 0")


def read_rates_json(spark: SparkSession, path: str) -> DataFrame:
    """The same from JSON lines of one quotation each; some currencies are quoted for a hundred units."""
    rows = spark.read.schema("date string, currency string, value string, error string").json(path).where("error is null")
    currency = F.regexp_replace(F.upper(F.trim("currency")), "^100", "")
    value = F.col("value").try_cast("double") / F.when(currency.isin(*PER_HUNDRED), 100).otherwise(1)
    return rows.select(currency.alias("currency"), F.to_date(F.substring("date", 1, 10)).alias("rate_date"), value.alias("rate")).where("rate > 0")


def read_chart_of_accounts(spark: SparkSession, path: str) -> DataFrame:
    """code, description and the path of headings above each group, subgroup and account of outlines in text files. A
    file is one window: an outline has some hundreds of lines."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "raw"))
    t = F.trim("raw")
    level = F.when(t.startswith("Clasa "), 0).when(t.rlike(r"^\d{1,2}\.\s+\S"), 1).when(t.rlike(r"^\d{3}\.\s+\S"), 2).when(t.rlike(r"^\d{4}\.\s+\S"), 3)
    code = F.regexp_extract(t, r"^(\d{1,4})\.", 1)
    described = F.regexp_extract(t, r"^\d{1,4}\.\s+(.+)$", 1)
    description = F.when(level == 3, F.trim(F.regexp_replace(described, r"\s*\([AP/]+\)$", ""))).otherwise(described)
    rows = text.select("file", "line", t.alias("t"), level.alias("level"), code.alias("code"), description.alias("description")).where("level is not null")
    above = Window.partitionBy("file").orderBy("line")
    label = F.when(F.col("level") == 0, F.col("t")).otherwise(F.concat_ws(". ", "code", "description"))
    heads = [F.coalesce(F.last(F.when(F.col("level") == i, label), True).over(above), F.lit("")) for i in range(3)]
    path_ = F.when(F.col("level") == 1, F.array(heads[0], label)).when(F.col("level") == 2, F.array(heads[0], heads[1], label)).otherwise(F.array(*heads, label))
    return rows.select("*", F.array_join(path_, " > ").alias("context")).where("level > 0").select("code", "description", "context")


def read_logistics_sheet(spark: SparkSession, path: str) -> DataFrame:
    """vin, weight_kg, city and row_number from one delimited sheet whose header is among its first 30 rows; rows without
    a VIN go. Sheets are read whole, as their header's place decides what follows."""
    _, sep, _ = _sniff(spark, path, 30)
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "raw")).select((F.col("n") + 1).alias("row_number"), F.transform(F.split("raw", re.escape(sep)), lambda x: F.regexp_replace(F.trim(x), '^"|"$', "")).alias("cells"))
    keys = F.transform("cells", lambda x: F.regexp_replace(ascii_fold(x), "[^a-z0-9]", ""))
    places = [F.array_position(keys, k) for k in SHEET_COLUMNS.values()]
    header = rows.where(F.col("row_number") <= 30).select("row_number", *(p.cast("int").alias(f"at_{c}") for c, p in zip(SHEET_COLUMNS, places))).where(" and ".join(f"at_{c} > 0" for c in SHEET_COLUMNS)).orderBy("row_number").first()
    if header is None:
        raise ValueError("no row names all of " + ", ".join(SHEET_COLUMNS))
    cell = lambda c: F.get("cells", F.lit(header[f"at_{c}"] - 1))
    weight = F.regexp_replace(F.regexp_replace(cell("weight"), r"(?i)\s|kg", ""), ",", ".").try_cast("double")
    got = rows.where(F.col("row_number") > header["row_number"]).select(vin_or_null(cell("vin")).alias("vin"), F.when(weight > 0, weight).alias("weight_kg"), text_of(cell("city")).alias("city"), "row_number")
    return got.where("vin is not null")


def read_metric_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; what is no JSON is skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_flat_invoices(invoices: DataFrame, path: str) -> None:
    """The flat list: eleven columns, all quoted, separated by semicolons."""
    invoices.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in FLAT_COLUMNS.items())).write.mode("overwrite").option("sep", ";").option("quoteAll", True).option("escape", '"').option("header", True).option("emptyValue", "").csv(path)


def write_partner_xml(partners: DataFrame, path: str, root: str = "Furnizori") -> None:
    """Partners as Linie records; blanks are empty tags and the country is RO unless stated."""
    values = {c: F.coalesce(F.col(c).cast("string"), F.lit("RO" if c == "country" else "")) if c in partners.columns else F.lit("RO" if c == "country" else "") for c in PARTNER_TAGS}
    partners.select(*(v.alias(PARTNER_TAGS[c]) for c, v in values.items())).write.mode("overwrite").option("rootTag", root).option("rowTag", "Linie").option("declaration", 'version="1.0" encoding="UTF-8"').xml(path)
