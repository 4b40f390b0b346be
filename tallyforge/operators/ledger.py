"""Double-entry journal: entries of invoices, receipts, contracts and dispositions, and what is summed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, round2
from ..functions.normalise import valid_account


def non_deductible(vat: Column, deductibility: Column) -> Column:
    """The part of the VAT that is a cost: none, what half leaves, or all."""
    return F.when(deductibility == "FULL", F.lit(0).cast(MONEY)).when(deductibility == "PARTIAL_50", (vat - round2(vat / 2)).cast(MONEY)).otherwise(vat)


#: Accounts that keep the document's own amounts, whatever the rounding (fixed values).
PROTECTED = r"^(401|404|408|411|4426|4427|462|5121|5124|5311)(\\.|$)"


def money(amount: Column, rate: Column) -> Column:
    """An amount in RON, two decimals, half toward plus infinity."""
    return F.floor((amount * rate + F.lit(2.0**-52)) * 100 + F.lit(0.5)) / 100


#: Columns of documents that may be missing, with what holds then. net, vat and total are the stated amounts: with a
#: stated net they count and the lines are checked against them, else the sums of the lines do; total and vat also hold for
#: documents without lines. ref_direction is the direction of the invoice that a payment refers to, if one was found.
OPTIONAL = {
    "currency": ("string", "RON"), "number": ("string", "-"), "net": (MONEY, None), "vat": (MONEY, None), "total": (MONEY, None),
    "is_advance": ("boolean", False), "receipt_type": ("string", None), "payment_method": ("string", "cash"), "account_code": ("string", None),
    "reverse_charge": ("boolean", False), "vat_payer": ("boolean", True), "ref_direction": ("string", None),
    "n_references": ("int", 0), "n_stated": ("int", 0), "stated_total": (MONEY, None),
}
KINDS = ("Invoice", "Receipt", "Contract", "Payment Disposition", "Collection Disposition")
CASH, BANK, BANK_FOREIGN, PAYABLE, RECEIVABLE = "5311", "5121", "5124", "401", "411"
DEDUCTED, COLLECTED, PAID_AHEAD, GOT_AHEAD, SELLER, GOODS, SERVICES, SALES = "4426", "4427", "409", "419", "462", "371", "628", "707"
VAT_RATE = 21  # where no line has a rate
LINE = "array<struct<pos:int,net:decimal(14,2),vat:decimal(14,2),deductibility:string,account:string,vat_rate:int>>"


def _entry(account, amount: Column) -> Column:
    """A debit, or a credit if the amount is negative: so a negative amount moves to the other side."""
    return F.struct((F.lit(account) if isinstance(account, str) else account).alias("account"), amount.cast(MONEY).alias("amount"))


def _some(*parts: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, e) for c, e in parts)))


def _gathered(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Approved documents with their lines in order as `ls`, one row each. Lines of other documents go before any are gathered:
    lines are dealt by document once, as they are, and what is gathered of them there stays where it is."""
    known = documents.withColumns({c: F.lit(v).cast(t) for c, (t, v) in OPTIONAL.items() if c not in documents.columns})
    live = known.where("review_status = 'APPROVED'").select("document_id", "type", "direction", "document_date", "rate", *OPTIONAL)
    rate = F.col("vat_rate") if "vat_rate" in lines.columns else F.lit(None)
    ids = live.select("document_id").distinct().hint("shuffle_hash")
    own = lines.join(ids, "document_id", "left_semi").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("pos", "net", "vat", "deductibility", "account", rate.cast("int").alias("vat_rate")))).alias("ls"), F.sum("net").alias("lines_net"), F.sum("vat").alias("lines_vat"))
    at = F.transform("ls", lambda x, i: F.struct((i + 1).alias("pos"), x["net"].alias("net"), x["vat"].alias("vat"), x["deductibility"].alias("deductibility"), x["account"].alias("account"), x["vat_rate"].alias("vat_rate")))
    return live.join(own.withColumn("ls", at), "document_id", "left").withColumn("n", F.coalesce(F.size("ls"), F.lit(0)))


def draft_entries(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """One row for each approved document, with its amounts and its entries in RON before balancing.

    Outgoing invoices and receipts: 411, or what the money went to, for the total; a line's own account if it is one of
    class 7 or 4, else 707, or 419 for an advance; 4427 for the VAT. Incoming: 401 or the money's account; each line's
    account, else 628, or 409 for an advance, with what of its VAT can't be deducted; 4426 for the rest; with reverse charge
    4426 and 4427 for the VAT, or for the net by the first rate of a line above 0, else 21. A line without VAT takes a share
    of the document's. Who pays no VAT deducts and collects none. Money is 5311, or 5121 at a bank, 5124 in another
    currency. Receipts of payments move the total between that and 401 or 411; dispositions between 5311 and 401 or 411, or
    with no reference the document's account, or 409 or 419 for an advance. Contracts debit each line's account, else 371,
    and owe the total on 462. A document without lines has one line with its stated amounts.
    """
    d = _gathered(documents, lines)
    bare, stated = F.col("n") == 0, F.col("net").isNotNull()
    zero = F.lit(0).cast(MONEY)
    or0 = lambda c: F.coalesce(c, zero)
    vat = F.when(bare | stated, or0(F.col("vat"))).otherwise(F.col("lines_vat"))
    net = F.when(stated, F.col("net")).when(bare, or0(F.col("total")) - or0(F.col("vat"))).otherwise(F.col("lines_net"))
    total = F.when(stated | bare, or0(F.col("total"))).otherwise(F.col("lines_net") + F.col("lines_vat"))
    d = d.withColumns({"doc_net": net.cast("double"), "doc_vat": vat.cast("double"), "doc_total": total.cast("double")})
    kind = F.col("type")
    paid = (kind == "Receipt") & F.coalesce((F.col("receipt_type") == "payment_receipt") | F.col("ref_direction").isNotNull(), F.lit(False))
    way = F.when(paid, F.coalesce("ref_direction", "direction", F.lit("outgoing"))).otherwise(F.col("direction"))
    money_at = F.when(F.col("payment_method") == "bank", F.when(F.col("currency") != "RON", BANK_FOREIGN).otherwise(BANK)).otherwise(CASH)
    one = F.struct(F.lit(1).alias("pos"), F.col("doc_net").cast(MONEY).alias("net"), F.col("doc_vat").cast(MONEY).alias("vat"), F.lit("FULL").alias("deductibility"), F.when(kind == "Receipt", F.col("account_code")).alias("account"), F.lit(None).cast("int").alias("vat_rate"))
    d = d.withColumns({"paid": paid, "way": way, "money_at": money_at, "all": money(F.col("doc_total"), F.col("rate")), "lx": F.when(bare, F.array(one)).otherwise(F.col("ls")).cast(LINE)})
    rate, payer, ahead, zero = F.col("rate"), F.col("vat_payer"), F.col("is_advance"), F.lit(0.0)

    def taxed(x: Column) -> Column:
        own, n = x["vat"].cast("double"), x["net"].cast("double")
        share = F.when((F.col("doc_vat") > 0) & (F.col("doc_net") > 0), F.col("doc_vat") * n / F.col("doc_net")).otherwise(zero)
        of = F.when(own == 0, share).otherwise(own)
        part = F.when(~payer, zero).when(x["deductibility"] == "FULL", of).when(x["deductibility"] == "PARTIAL_50", of / 2).otherwise(zero)
        return F.struct(n.alias("net"), own.alias("own"), of.alias("vat"), part.alias("part"), x["account"].alias("account"))

    d = d.withColumn("tx", F.transform("lx", taxed))
    deducted = F.aggregate("tx", F.lit(0).cast("decimal(28,6)"), lambda a, x: (a + x["part"].cast("decimal(18,6)")).cast("decimal(28,6)")).cast("double")
    first_rate = F.get(F.filter("lx", lambda x: x["vat_rate"] > 0), F.lit(0))["vat_rate"]
    reverse = F.when(F.col("doc_vat") != 0, F.col("doc_vat")).otherwise(F.col("doc_net") * F.coalesce(first_rate, F.lit(VAT_RATE)) / 100)
    d = d.withColumns({"deducted": deducted, "reverse_vat": F.when(F.col("reverse_charge") & payer & (kind == "Invoice"), reverse)})
    sale = F.when(kind == "Receipt", F.col("money_at"))
    whole = F.col("all")
    revenue = lambda x: F.when(ahead, GOT_AHEAD).when(x["account"].rlike("^[47]"), x["account"]).otherwise(SALES)
    cost = lambda x: F.when(ahead, PAID_AHEAD).otherwise(F.coalesce(x["account"], F.lit(SERVICES)))
    sold = F.concat(
        F.array(_entry(F.coalesce(sale, F.lit(RECEIVABLE)), whole)),
        F.transform("tx", lambda x: _entry(revenue(x), -money(F.when(payer, x["net"]).otherwise(x["net"] + x["own"]), rate))),
        _some((payer & (F.col("doc_vat") > 0), _entry(COLLECTED, -money(F.col("doc_vat"), rate)))),
    )
    bought = F.concat(
        F.array(_entry(F.coalesce(sale, F.lit(PAYABLE)), -whole)),
        F.transform("tx", lambda x: _entry(cost(x), money(x["net"] + x["vat"] - x["part"], rate))),
        _some((F.col("deducted") > 0, _entry(DEDUCTED, money(F.col("deducted"), rate))), *((F.col("reverse_vat").isNotNull(), _entry(a, sign * money(F.col("reverse_vat"), rate))) for a, sign in ((DEDUCTED, 1), (COLLECTED, -1)))),
    )
    incoming = F.col("way") == "incoming"
    payment = F.when(incoming, F.array(_entry(PAYABLE, whole), _entry(F.col("money_at"), -whole))).otherwise(F.array(_entry(F.col("money_at"), whole), _entry(RECEIVABLE, -whole)))
    contract = F.array_append(F.transform("tx", lambda x: _entry(F.coalesce(x["account"], F.lit(GOODS)), money(x["net"] + x["own"], rate))), _entry(SELLER, -whole))
    other = lambda own, early: F.when(F.col("ref_direction").isNotNull(), own).otherwise(F.coalesce("account_code", F.when(ahead, early).otherwise(own)))
    paid_out, got_in = F.array(_entry(other(PAYABLE, PAID_AHEAD), whole), _entry(CASH, -whole)), F.array(_entry(CASH, whole), _entry(other(RECEIVABLE, GOT_AHEAD), -whole))
    entries = F.when(F.col("paid"), payment).when(kind.isin("Invoice", "Receipt"), F.when(incoming, bought).otherwise(sold)).when(kind == "Contract", contract).when(kind == "Payment Disposition", paid_out).when(kind == "Collection Disposition", got_in)
    return d.withColumn("entries", F.coalesce(entries, F.array().cast("array<struct<account:string,amount:decimal(14,2)>>"))).drop("tx", "ls", "deducted", "reverse_vat")


def _errors(need_lines: bool) -> Column:
    """What keeps a document out of the ledger, in the order in which it is looked at."""
    kind, n = F.col("type"), F.col("n")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    sold = (kind == "Invoice") | (kind == "Receipt") & ~F.col("paid")
    gap = F.col("lines_net").cast("double") - F.col("doc_net")
    gross = F.when(kind == "Contract", F.col("lines_net") + F.col("lines_vat")).cast("double") - F.col("doc_total")
    stated = F.coalesce(F.col("stated_total").cast("double"), F.lit(0.0)) - F.col("doc_total")
    all_stated = (F.col("n_references") > 0) & (F.col("n_stated") == F.col("n_references"))
    bad = F.exists("lx", lambda x: x["account"].isNotNull() & ~valid_account(x["account"])) | kind.endswith("Disposition") & ~valid_account(F.col("account_code"))
    rules = [
        ("no date", F.col("document_date").isNull()),
        ("no total", F.col("doc_total") <= 0),
        ("no direction", kind.isin("Invoice", "Receipt") & F.col("way").isNull()),
        ("no number", kind.isin("Invoice", "Contract") & F.col("number").isNull()),
        ("no lines", sold & (n == 0) if need_lines else F.lit(False)),
        ("lines off", sold & (n > 0) & (F.abs(gap) > 0.05)),
        ("not a purchase", (kind == "Contract") & ~is_(F.col("direction") == "incoming")),
        ("lines off", (kind == "Contract") & (n > 0) & (F.abs(gross) > 0.05)),
        ("references over total", (F.col("n_stated") > 0) & (stated > 0.01)),
        ("references off total", all_stated & (stated < -0.01)),
        ("bad account", bad),
    ]
    found = F.array_compact(F.array(*(F.when(is_(c), name) for name, c in rules)))
    late = F.array_compact(F.array(F.when(F.col("rate").isNull(), "no rate"), F.when(is_(F.abs("gap") > 0.01), "unbalanced")))
    return F.when(~kind.isin(*KINDS), F.array().cast("array<string>")).when(F.size(found) > 0, found).otherwise(late)


def _warnings() -> Column:
    lines = lambda c: F.coalesce(F.size(F.filter("lx", c)), F.lit(0)) > 0
    rules = [
        ("no entries for this type", ~F.col("type").isin(*KINDS)),
        ("payment without its invoice", F.col("paid") & F.col("ref_direction").isNull()),
        ("rest is shared", (F.col("n_references") > 1) & (F.col("n_stated") < F.col("n_references"))),
        ("lines without account", (F.col("n") > 0) & lines(lambda x: x["account"].isNull())),
    ]
    return F.array_compact(F.array(*(F.when(c, name) for name, c in rules)))


def balanced_entries(drafts: DataFrame, need_lines: bool = True) -> DataFrame:
    """Drafts with their entries that aren't 0, errors and warnings. A difference of up to 0.05 goes to the document's last
    unprotected entry that can bear it: taken from the larger side, else added to the other. gap is what the sides still
    differ by. Invoices and independent receipts without lines are an error, or with need_lines=False have the one line."""
    some = drafts.withColumn("entries", F.filter("entries", lambda e: F.coalesce(F.abs(e["amount"]) > 0.004, F.lit(True))))
    diff = F.aggregate("entries", F.lit(0).cast("decimal(24,2)"), lambda a, e: (a + e["amount"]).cast("decimal(24,2)"))
    some = some.withColumn("diff", diff)
    sign = F.when(F.col("diff") > 0, 1).otherwise(-1)
    last = lambda fits: F.array_max(F.transform("entries", lambda e, i: F.when(~e["account"].rlike(PROTECTED) & fits(e["amount"] * sign), i)))
    borne = F.when((F.col("diff") != 0) & (F.abs("diff") <= 0.05), F.coalesce(last(lambda x: x >= F.abs("diff")), last(lambda x: x < 0)))
    some = some.withColumn("borne", borne)
    even = F.transform("entries", lambda e, i: F.struct(e["account"].alias("account"), (e["amount"] - F.when(i == F.col("borne"), F.col("diff")).otherwise(F.lit(0))).cast(MONEY).alias("amount")))
    some = some.withColumns({"entries": F.when(F.col("borne").isNull(), F.col("entries")).otherwise(even), "gap": F.when(F.col("borne").isNull(), F.col("diff")).otherwise(F.lit(0)).cast("double")})
    return some.withColumns({"errors": _errors(need_lines), "warnings": _warnings()}).drop("diff", "borne", "lx")


def posting_status(balanced: DataFrame) -> DataFrame:
    """POSTED, ERROR with the first reason, or NONE for a type without entries, for each approved document."""
    n = F.when(F.size("errors") == 0, F.size("entries")).otherwise(0).cast("long")
    status = F.when(F.size("errors") > 0, "ERROR").when(n > 0, "POSTED").otherwise("NONE")
    return balanced.select("document_id", status.alias("status"), F.get("errors", F.lit(0)).alias("error"), n.alias("n_entries"))


def posting_messages(balanced: DataFrame) -> DataFrame:
    """A row for each error and warning of each document."""
    all_ = F.concat(*(F.transform(c, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("message"))) for c, kind in (("errors", "error"), ("warnings", "warning"))))  # noqa: B023
    return balanced.select("document_id", F.explode_outer(all_).alias("m")).where("m is not null").select("document_id", "m.kind", "m.message").distinct()


def journal(documents: DataFrame, lines: DataFrame, need_lines: bool = True) -> DataFrame:
    """Balanced entries in RON of the documents without errors, with their posting keys; documents carry their rate. A filter
    on the errors would be pushed below the columns that they are made of, and make all of these again for itself."""
    posted = balanced_entries(draft_entries(documents, lines), need_lines).withColumn("entries", F.when(F.size("errors") == 0, F.col("entries")))
    kind, sided = F.col("type"), F.when(F.col("way") == "incoming", "IN").otherwise("OUT")
    source = F.when(kind == "Contract", "CONTRACT_PURCHASE").when(kind.isin("Invoice", "Receipt"), F.concat_ws("_", F.upper(kind), sided)).otherwise(F.upper(F.replace(kind, F.lit(" "), F.lit("_"))))
    rows = posted.select("document_id", "document_date", source.alias("source"), F.posexplode_outer("entries").alias("at", "e")).where("e is not null")
    key = F.concat_ws(":", F.lit("DOC"), "document_id", "source", F.date_format("document_date", "yyyy-MM-dd"), "at")
    zero, amount = F.lit(0).cast(MONEY), F.col("e.amount")
    return rows.select("document_id", "document_date", key.alias("posting_key"), "e.account", F.greatest(amount, zero).alias("debit"), F.greatest((-amount).cast(MONEY), zero).alias("credit"))


def balances(entries: DataFrame, *by: str) -> DataFrame:
    """Debit, credit, balance and number of entries by the given columns."""
    got = entries.groupBy(*by).agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.count("*").alias("n_entries"))
    return got.select(*by, F.col("d").cast("double").alias("debit"), F.col("c").cast("double").alias("credit"), (F.col("d") - F.col("c")).cast("double").alias("balance"), "n_entries")


def line_totals(lines: DataFrame) -> DataFrame:
    total = lambda c: F.sum(c).cast("double")
    return lines.groupBy("document_id").agg(total("net").alias("net"), total("vat").alias("vat"), total(F.col("net") + F.col("vat")).alias("total"), F.count("*").alias("n_lines"))


def vat_breakdown(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """Net, VAT and what of it can't be deducted by rate and deductibility, in each currency."""
    met = lines.join(documents.select("document_id", "currency").hint("merge"), "document_id")
    return met.groupBy("currency", "vat_rate", "deductibility").agg(F.sum("net").cast("double").alias("net"), F.sum("vat").cast("double").alias("vat"), F.sum(non_deductible(F.col("vat"), F.col("deductibility"))).cast("double").alias("non_deductible"))
