"""Documents that may have been entered twice, by the fields that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import written

#: Scores of equal fields in thousandths: number (invoice, other), amount, near amount, date, near date, partner, similar
#: name, currency, several of them in an invoice; and the least scores of the bands (fixed values).
NUMBER, AMOUNT, NEAR_AMOUNT, DATE, NEAR_DATE, PARTNER, NAME, CURRENCY, SEVERAL = (500, 400), 300, 150, 150, 50, 150, 105, 50, 100
BANDS = (("high", 850), ("medium", 700), ("low", 600))
FIELDS = ("type", "number", "cents", "document_date", "partner_id", "name", "currency")
ID = "document_id"

#: Classes with one key up to which all their pairs are looked at.
SMALL = 50

#: Keys of which each pair in a band has one, with what tells apart the classes of a key that too many have. Amounts that
#: differ by less than 1.00 share one of two steps of 2.00; similar names share a word or six letters in a row.
KEYS = (
    (("type", "number"), (("partner_id",), ("document_date",), ("step",), ("half_step",), ("token",))),
    (("type", "cents", "document_date"), (("partner_id",), ("currency",), ("token",))),
    (("type", "partner_id", "cents"), (("currency",), ("document_date",), ("number",))),
    (("type", "partner_id", "document_date", "currency", "step"), ()),
    (("type", "partner_id", "document_date", "currency", "half_step"), ()),
)


def similar_names(a: Column, b: Column) -> Column:
    """Equal, one inside the other if both have more than five letters, or two common words that are 60 % of the fewer."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    common = F.size(F.array_intersect(words(a), words(b)))
    long = (F.length(a) > 5) & (F.length(b) > 5)
    inside = F.when(F.length(a) < F.length(b), b.contains(a)).otherwise(a.contains(b))
    return F.coalesce((a != "") & (b != "") & ((a == b) | long & inside | (common >= 2) & (common * 10 >= F.least(F.size(words(a)), F.size(words(b))) * 6)), F.lit(False))


def _tokens(name: Column) -> Column:
    letters = F.when(F.length(name) > 5, F.transform(F.sequence(F.lit(1), F.length(name) - 5), lambda i: F.substring(name, i, F.lit(6)))).otherwise(F.array(name))
    return F.array_distinct(F.filter(F.concat(F.split(name, r"\s+"), letters), lambda w: w != ""))


def _met(classes: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Classes whose key others have too, with their number and the smallest of them."""
    sizes = classes.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n"), F.min(ID).alias("least")).where("n > 1")
    return classes.join(sizes.hint("merge"), list(key))


def _pairs(met: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """All pairs of the few that share a key; of many, each with the smallest."""
    few = met.where(F.col("n") <= SMALL).groupBy(*key).agg(F.array_sort(F.collect_set(ID)).alias("ids"))
    each = few.select("ids", F.explode("ids").alias("a")).select("a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b"))
    return each.union(met.where((F.col("n") > SMALL) & (F.col(ID) != F.col("least"))).select(F.col("least").alias("a"), F.col(ID).alias("b")))


def duplicate_documents(documents: DataFrame) -> DataFrame:
    """a, b, score, band, a_copies, b_copies: pairs of documents of one type that score in a band, in thousandths of one.

    Documents equal in all FIELDS are one class, named by its smallest document and counted as copies. A class whose key
    SMALL others or fewer have is compared with each of them. Of a key that more have, as a partner's fixed monthly fee
    has, each class is paired with the smallest one, and with all of those that share another field as well, so a group
    of many equals comes out as a star and what stands out in it as pairs. documents: document_id and FIELDS; nulls, an
    amount of 0 and empty names equal nothing; a null document_id is no document; other columns are dropped.
    """
    keyed = documents.where(F.col(ID).isNotNull()).groupBy(*FIELDS).agg(F.min(ID).alias(ID), F.count("*").alias("copies"))
    amount = F.nullif("cents", F.lit(0))
    classes = written(keyed.withColumns({"cents": amount, "step": F.floor(F.col("cents") / 200), "half_step": F.floor((F.col("cents") + 100) / 200)}), "classes")
    pairs = []
    for key, finer in KEYS:
        met = written(_met(classes.select(ID, *dict.fromkeys((*key, *FIELDS, "step", "half_step"))), key), "shared")
        pairs.append(_pairs(met, key))
        many = met.where(F.col("n") > SMALL).drop("n", "least")
        if not finer or many.isEmpty():
            continue
        for more in finer:
            wide = many.withColumn("token", F.explode(_tokens(F.col("name")))) if more == ("token",) else many
            pairs.append(_pairs(_met(wide, (*key, *more)), (*key, *more)))
    found = pairs[0]
    for more in pairs[1:]:
        found = found.union(more)
    found = written(found.distinct(), "candidates")
    side = lambda x: classes.select(F.col(ID).alias(x), *(F.col(c).alias(f"{x}_{c}") for c in (*FIELDS, "copies")))
    scored = found.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").withColumn("score", _score()).where(F.col("score") >= BANDS[-1][1])
    band = F.when(F.col("score") >= BANDS[0][1], BANDS[0][0]).when(F.col("score") >= BANDS[1][1], BANDS[1][0]).otherwise(BANDS[2][0])
    return scored.select("a", "b", (F.col("score") / 1000).alias("score"), band.alias("band"), "a_copies", "b_copies")


def _score() -> Column:
    same = lambda c: F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))
    points = lambda ok, n: F.when(ok, n).otherwise(0)
    invoice = F.col("a_type") == "Invoice"
    near_date = ~same("document_date") & ~invoice & F.coalesce(F.abs(F.datediff("a_document_date", "b_document_date")) <= 7, F.lit(False))
    named = F.col("a_type").isin("Invoice", "Receipt")
    partner = same("partner_id") & named
    name = ~partner & named & similar_names(F.col("a_name"), F.col("b_name"))
    exact = points(same("number"), 1) + points(same("cents"), 1) + points(same("document_date"), 1) + points(partner | name, 1) + points(same("currency"), 1)
    close = F.when(same("cents"), AMOUNT).when(F.abs(F.col("a_cents") - F.col("b_cents")) < 100, NEAR_AMOUNT).otherwise(0)
    whole = F.when(same("number"), F.when(invoice, NUMBER[0]).otherwise(NUMBER[1])).otherwise(0) + close + F.when(same("document_date"), DATE).when(near_date, NEAR_DATE).otherwise(0)
    return F.least(whole + F.when(partner, PARTNER).when(name, NAME).otherwise(0) + points(same("currency"), CURRENCY) + points(invoice & (exact >= 3), SEVERAL), F.lit(1000))
