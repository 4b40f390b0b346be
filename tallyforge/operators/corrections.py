"""Reviewers' corrections of extracted fields, by paths like line_items[2].quantity."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields whose texts are numbers, and what a correction of lines or of the kind of deal takes back (fixed values).
NUMERIC = re.compile("amount|price|quantity|rate|total|mileage|exchange", re.I)
REVIEWED = "vehicle_cost_categories_reviewed"
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")

#: An index may lie so far beyond the end of a list; what is between is filled with nulls.
FARTHEST = 1000

LOG = "array<struct<field:string,old_value:string,new_value:string,applied:boolean>>"
_LOG_NAMES = ("field", "old_value", "new_value", "applied")
_LOG_TYPES = (pa.string(), pa.string(), pa.string(), pa.bool_())
_json = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


@lru_cache(10_000)
def path_parts(path: str) -> tuple[str | int, ...]:
    return tuple(int(p) if p.isdigit() else p for p in re.sub(r"\[(\d+)\]", r".\1", path).split(".") if p)


@lru_cache(10_000)
def is_numeric(field: str) -> bool:
    return NUMERIC.search(field) is not None


def read_path(root, path: str):
    for part in path_parts(path):
        if isinstance(root, dict):
            root = root.get(str(part))
        elif isinstance(root, list) and isinstance(part, int) and part < len(root):
            root = root[part]
        else:
            return None
    return root


def write_path(root: dict, path: str, value) -> bool:
    """Sets what the path names and makes what is missing on the way: lists before indexes, else objects. False, and
    nothing changes, where the way leads through a text or a number, or an index is out of reach."""
    parts = path_parts(path)
    if not parts:
        return False
    at, made = root, []
    for i, part in enumerate(parts):
        if isinstance(at, list):
            if not isinstance(part, int) or part > len(at) + FARTHEST:
                break
        elif not isinstance(at, dict):
            break
        key = part if isinstance(at, list) else str(part)
        here = at.get(key) if isinstance(at, dict) else at[key] if key < len(at) else None
        if i == len(parts) - 1:
            made.append((at, key, value))
            for box, k, v in made:
                if isinstance(box, list) and k >= len(box):
                    box.extend([None] * (k + 1 - len(box)))
                box[k] = v
            return True
        if here is None:
            here = [] if isinstance(parts[i + 1], int) else {}
            made.append((at, key, here))
        at = here
    return False


def coerced(field: str, value: str | None):
    """Numbers in numeric fields (a comma is a point), true and false, and JSON lists and objects; other texts stay."""
    if value is None:
        return None
    t = value.strip()
    if is_numeric(field) and _NUMBER.fullmatch(t.replace(",", ".", 1)):
        n = float(t.replace(",", ".", 1))
        if abs(n) != float("inf"):
            return int(n) if n.is_integer() and abs(n) < 1e15 else n
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    if (t[:1], t[-1:]) in (("[", "]"), ("{", "}")):
        try:
            return json.loads(t)
        except ValueError:
            return value
    return value


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else _json(value)


def corrected(fields: str, corrections: list[tuple[str, str | None]]) -> tuple[str, list[tuple]]:
    """The JSON object after the corrections in order, and for each its field, old and new value and whether it took."""
    try:
        root = json.loads(fields)
    except ValueError:
        root = None
    log = []
    for field, value in corrections:
        new = coerced(field or "", value)
        old = read_path(root, field or "")
        took = isinstance(root, dict) and write_path(root, field or "", new)
        if took and (field == "vehicle_transaction" or field == "line_items" or field.startswith("line_items[")):
            root[REVIEWED] = False
        log.append((field, _text(old), _text(new), took))
    return (_text(root) if isinstance(root, dict) else fields), log


def apply_corrections(documents: DataFrame, corrections: DataFrame) -> DataFrame:
    """document_id, fields_json after its corrections in the order of (at, correction_id), and their log, for each document.

    documents: document_id, fields_json, review_status; corrections: document_id, correction_id, at, field, value (texts).
    Approved documents and those without data aren't changed, and their corrections are logged as not applied, as is one
    whose path leads through a text. Corrections of no document, and of null ids, are dropped. A document's corrections,
    made by hand, are gathered; hot documents don't arise.
    """

    @F.arrow_udf(f"fields_json string, log {LOG}")
    def run(fields: pa.Array, closed: pa.Array, items: pa.Array) -> pa.Array:
        """Texts and logs of a batch. The corrections of all rows come and go as flat columns and the places where each row's
        begin; making an object of each of them would cost more than the corrections."""
        flat, sizes = items.flatten(), [n or 0 for n in items.value_lengths().to_pylist()]
        pairs = list(zip(flat.field("field").to_pylist(), flat.field("value").to_pylist()))
        texts, log, ends = [], [], [0]
        for text, shut, n in zip(fields.to_pylist(), closed.to_pylist(), sizes):
            own = pairs[ends[-1] : ends[-1] + n]
            done, made = (text, [(f, None, v, False) for f, v in own]) if shut or not n else corrected(text, own)
            texts.append(done)
            log += made
            ends.append(len(log))
        columns = zip(*log) if log else ((),) * len(_LOG_NAMES)
        logs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _LOG_TYPES)], names=_LOG_NAMES)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), logs)], names=("fields_json", "log"))

    made = F.sort_array(F.collect_list(F.struct("at", "correction_id", "field", "value")))
    own = corrections.groupBy("document_id").agg(F.transform(made, lambda c: F.struct(c["field"].alias("field"), c["value"].alias("value"))).alias("items"))
    met = documents.select("document_id", "fields_json", "review_status").join(own, "document_id", "left")
    closed = F.coalesce(F.col("review_status") == "APPROVED", F.lit(False)) | F.col("fields_json").isNull()
    kept = closed | F.col("items").isNull()
    got = met.select("document_id", "fields_json", kept.alias("kept"), run(F.when(~kept, F.col("fields_json")), closed, "items").alias("r"))
    return got.select("document_id", F.when(F.col("kept"), F.col("fields_json")).otherwise(F.col("r.fields_json")).alias("fields_json"), "r.log")
