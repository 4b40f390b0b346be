"""Secret scans with DataFrame functions only.

Fixed rules find assignments, access keys and long hexadecimal runs; two character Markov models, one of random
strings and one of ordinary identifiers, add every other long token whose log-likelihood ratio is high.
Positions are code points, ends exclusive. No rule matches a line break, so texts are worked on line by line: what a
span costs grows with its line, not with its text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # runs of AKIA[A-Z0-9]+ of 16 and more: a shorter run holds no longer one
HEX = r"[0-9a-f]{32,}"
#: Tokens that the models judge, and those that teach the model of ordinary identifiers.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
TOKEN = r"[A-Za-z0-9+/_-]+"
KINDS = ("assign", "access", "hex", "markov")
MASK = "[SECRET]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: The labelled sample comes from at most so many documents.
SAMPLE_DOCS = 4000
#: A token is a secret if the ratio reaches so many nats for each pair of neighbouring characters.
RATIO = 2.4

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


#: Entries of a running sum that are gathered at once, so that appending doesn't copy a long array again and again.
CHUNK = 256


def _empty() -> Column:
    return F.array().cast(SPAN)


def _placed(items: Column, gap, n, make) -> Column:
    """make(item, start, end) of all items as one array; items lie one after another, each of n(item) characters after
    gap(item) others. make gives an array of spans."""
    long0 = F.lit(0).cast("long")

    def chunk(k: Column) -> Column:
        def add(a: Column, x: Column) -> Column:
            start = a["at"] + gap(x)
            end = start + n(x)
            return F.struct(end.alias("at"), F.concat(a["out"], make(x, start, end)).alias("out"))

        return F.aggregate(F.slice(items, k * CHUNK + 1, CHUNK), F.struct(long0.alias("at"), _empty().alias("out")), add)

    chunks = F.transform(F.sequence(F.lit(0), F.greatest((F.size(items) - 1) / CHUNK, F.lit(0)).cast("int")), chunk)

    def shifted(a: Column, c: Column) -> Column:
        moved = F.transform(c["out"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + a["at"]).alias("end")))
        return F.struct((a["at"] + c["at"]).alias("at"), F.array_append(a["out"], moved).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    return F.flatten(F.aggregate(chunks, F.struct(long0.alias("at"), none.alias("out")), shifted, lambda a: a["out"]))


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, judge=None) -> Column:
    """Matches of pattern as spans. What split() leaves between matches and the matches themselves give positions
    by a running sum of lengths. least: code points that the group must have; judge: a further test of the match."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits

    def entry(hit: Column, value: Column) -> Column:
        ok = F.length(value) >= least
        return F.struct(F.length(hit).cast("long").alias("n"), (ok & judge(hit) if judge else ok).alias("ok"))

    hits = F.zip_with(hits, values, entry)
    both = F.zip_with(F.transform(gaps, lambda g: F.length(g).cast("long")), hits, lambda g, h: F.struct(g.alias("gap"), h["n"].alias("n"), h["ok"].alias("ok")))

    def make(x: Column, start: Column, end: Column) -> Column:
        return F.when(F.coalesce(x["ok"], F.lit(False)), F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))).otherwise(_empty())

    found = _placed(both, lambda x: x["gap"], lambda x: F.coalesce(x["n"], F.lit(0).cast("long")), make)
    return F.when(text.rlike(pattern), found).otherwise(_empty())


def _chars(token: Column) -> Column:
    return F.filter(F.split(token, ""), lambda c: c != "")


def _pairs(token: Column) -> Column:
    """Cell of each pair of neighbouring characters in the square table of the alphabet."""
    places = F.transform(_chars(token), lambda c: F.greatest(F.instr(F.lit(ALPHABET), c), F.lit(1)) - 1)
    n = F.size(places)
    return F.zip_with(F.slice(places, 1, F.greatest(n - 1, F.lit(0))), F.slice(places, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a * len(ALPHABET) + b)


#: Ordinary strings that prose doesn't show (fixed values).
SERIES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "01234567890123456789")


def _identifiers(word: Column) -> Column:
    """What a word shows in names in code: itself, in capitals, and its seams with a next one."""
    head, tail = F.substring(word, 1, 1), F.right(word, F.lit(1))
    seams = (F.concat(tail, F.lit(sep), head) for sep in "_-/")
    return F.array(word, F.upper(word), *seams, F.concat(F.upper(tail), F.lit("_"), F.upper(head)), F.concat(tail, F.upper(head), F.lower(F.substring(word, 2, 1))))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log ratios of the two models' character transitions.

    The labelled sample: values that the fixed rules find in at most sample_docs documents are random; their other
    words, and these joined as identifiers and paths are, are ordinary, and so are letters and digits in series and
    runs of one character. The random model is an even mixture of what it has seen and the uniform one.
    """
    sample = bounded_sample(docs.select("doc_id"), "doc_id", sample_docs).distinct()
    text = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text")
    found = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    both = text.select(F.explode(F.array(F.struct(found.alias("w"), F.lit(1).alias("secret")), F.struct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("w"), F.lit(0).alias("secret")))).alias("x"))
    tokens = both.select(F.explode("x.w").alias("w"), F.col("x.secret").alias("secret")).where(F.length("w") >= F.when(F.col("secret") == 1, 8).otherwise(3)).groupBy("w").agg(F.max("secret").alias("secret"))
    forms = tokens.select("secret", F.explode(F.when(F.col("secret") == 1, F.array("w")).otherwise(_identifiers(F.col("w")))).alias("w"))
    counts = forms.select("secret", F.explode(_pairs(F.col("w"))).alias("pair")).groupBy("secret", "pair").count()
    size = len(ALPHABET)
    seen = [[0] * size**2, [0] * size**2]
    for r in counts.collect():  # at most two rows for each pair of the alphabet
        seen[r["secret"]][r["pair"]] = r["count"]
    rows = [sum(seen[0][a * size : a * size + size]) for a in range(size)]
    for series in SERIES:
        for x, y in zip(series, series[1:]):
            seen[0][ALPHABET.index(x) * size + ALPHABET.index(y)] += max(1, rows[ALPHABET.index(x)] // 10)
    for a in range(size):
        seen[0][a * size + a] += max(1, rows[a] // 10)
    every = sum(seen[0]) + 0.05 * size
    single = [(sum(seen[0][b::size]) + 0.05) / every for b in range(size)]  # stands in where a character has few successors
    out = []
    for a in range(size):
        plain, random = sum(seen[0][a * size : a * size + size]), sum(seen[1][a * size : a * size + size])
        for b in range(size):
            p = (seen[1][a * size + b] + 1 / size) / (random + 1)
            q = (seen[0][a * size + b] + single[b]) / (plain + 1)
            out.append(round(math.log(0.5 * p + 0.5 / size) - math.log(q), 6))
    return out


def _ratio(token: Column, table: Column) -> Column:
    """Nats for each pair of neighbouring characters; tokens have two characters or more."""
    return F.aggregate(_pairs(token), F.lit(0.0), lambda total, p: total + F.element_at(table, p + 1)) / (F.length(token) - 1)


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _line_spans(line: Column, table: Column, threshold: float) -> Column:
    """base and all: the spans of one line, sorted by start, then kind."""
    base = F.array_sort(F.concat(_spans(line, ASSIGN, 0, 2, 8), _spans(line, ACCESS, 1), _spans(line, HEX, 2)))
    more = _spans(line, CANDIDATE, 3, judge=lambda token: _ratio(token, table) >= threshold)

    def free(both: Column) -> Column:
        return F.filter(both["more"], lambda m: ~F.exists(both["base"], lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))

    both = F.struct(base.alias("base"), more.alias("more"))  # transform() of one element names it, so it is made once
    return F.element_at(F.transform(F.array(both), lambda x: F.struct(x["base"].alias("base"), F.array_sort(F.concat(x["base"], free(x))).alias("all"))), 1)


def _table(ratios: list[float]) -> Column:
    return F.from_json(F.lit(str(ratios)), "array<double>")


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def with_spans(docs: DataFrame, ratios: list[float], threshold: float = RATIO) -> DataFrame:
    """doc_id, base_spans, all_spans of each row of docs, sorted by start, then kind. The models' spans overlap no base
    span.

    A null text is an empty one and has no spans; long texts go line by line; rows are scanned one by one, so repeated
    rows and null or clashing other columns don't matter; an empty table stays empty.
    """
    table = _table(ratios)
    lines = F.transform(F.split(_text("text"), "\n", -1), lambda line: F.struct((F.length(line) + 1).cast("long").alias("n"), _line_spans(line, table, threshold).alias("s")))
    of = lambda field: _placed(F.col("lines"), lambda x: F.lit(0).cast("long"), lambda x: x["n"], lambda x, start, end: F.transform(x["s"][field], lambda s: F.struct((s["start"] + start).alias("start"), s["kind"].alias("kind"), (s["end"] + start).alias("end"))))
    return docs.select("doc_id", lines.alias("lines")).select("doc_id", of("base").alias("base_spans"), of("all").alias("all_spans"))


def spans_text(col: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """One row for each row of docs: counts of the fixed rules, a digest of their spans and all spans, as with_spans
    gives them."""
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    got = with_spans(docs, ratios)
    return got.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text("base_spans"), 256).alias("base_sha256"), spans_text("all_spans").alias("spans"))


def redact(docs: DataFrame, ratios: list[float], mask: str = MASK) -> DataFrame:
    """docs with every span in text replaced by the mask; overlapping spans become one.

    Null texts stay null and empty ones empty; long texts are masked line by line; repeated rows are masked alike; all
    other columns stay as they are, whatever their names, but n_chars follows a masked text; an empty table stays
    empty.
    """
    table = _table(ratios)
    begin = lambda: F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def masked(line: Column, spans: Column) -> Column:
        def add(a: Column, s: Column) -> Column:
            gap = F.substring(line, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
            new = s["start"] >= a["at"]
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(new, F.concat(a["out"], F.array(gap, F.lit(mask)))).otherwise(a["out"]).alias("out"))

        rest = lambda a: F.array_join(F.array_append(a["out"], F.substring(line, (a["at"] + 1).cast("int"), F.length(line))), "")
        return F.when(F.size(spans) > 0, F.aggregate(spans, begin(), add, rest)).otherwise(line)

    clean = F.array_join(F.transform(F.split("text", "\n", -1), lambda line: masked(line, _line_spans(line, table, RATIO)["all"])), "\n")
    before = _fresh(docs, "text_before")
    got = docs.withColumn(before, F.col("text")).withColumn("text", clean)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col("text") == F.col(before), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return got.select(docs.columns)
