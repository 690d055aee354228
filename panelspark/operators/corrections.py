"""The correction log: normalising, last write wins, replay, diffs, shapes, and patching JSON by path."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.lexicons import FIELD_ALIASES, REQUIRED_FIELDS


def canonical_field(field: Column) -> Column:
    """The canonical key of a field or one of its aliases; null for an unknown one."""
    pairs = [(alias, name) for name, aliases in FIELD_ALIASES.items() for alias in (name, *aliases)]
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(table, F.trim(field))


def normalised(log: DataFrame) -> DataFrame:
    """log(doc_id, seq, ts, op, path, field, value, new_value): op defaults to replace, new_value goes before value, aliases are resolved; items without a path and a known field are dropped, and so are empty required fields."""
    out = log.withColumns({"op": F.coalesce("op", F.lit("replace")), "value": F.coalesce("new_value", "value"), "field": canonical_field(F.col("field"))})
    empty_required = F.coalesce(F.col("field").isin(REQUIRED_FIELDS) & (F.coalesce("value", F.lit("")) == "") & (F.col("op") != "unset"), F.lit(False))
    return out.where((F.col("path").isNotNull() | F.col("field").isNotNull()) & ~empty_required).drop("new_value")


def target_path(field: Column, line: Column, path: Column) -> Column:
    """Where a correction goes: its path, a row's field, or the document's; line 0 counts as none."""
    return F.coalesce(path, F.when(line > 0, F.concat(F.lit("test_rows.line_"), line.cast("string"), F.lit("."), field)), F.concat(F.lit("document_info."), field))


def last_writes(log: DataFrame) -> DataFrame:
    """Per document and path the last item in the order of (ts, seq)."""
    item = F.struct("op", "value", "ts")
    return log.groupBy("doc_id", "path").agg(F.max_by(item, F.struct("ts", "seq")).alias("l"), F.count("*").alias("n_items")).select("doc_id", "path", "l.op", "l.value", "l.ts", "n_items")


def replay(base: DataFrame, log: DataFrame) -> DataFrame:
    """base(doc_id, path, value) with the last writes applied: set or unset what is there, add what isn't."""
    last = last_writes(log).select("doc_id", "path", "op", F.col("value").alias("new"))
    both = base.join(last, ["doc_id", "path"], "full_outer")
    value = F.when(F.col("op").isNull(), F.col("value")).when(F.col("op") == "unset", F.lit(None)).otherwise(F.col("new"))
    return both.where(F.coalesce(F.col("op") != "unset", F.lit(True))).select("doc_id", "path", value.alias("value"))


def diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Long forms (key, path, value) of two versions: added, removed, modified or unchanged."""
    both = a.withColumnRenamed("value", "old").join(b.withColumnRenamed("value", "new"), [key, "path"], "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return both.withColumn("change", kind)


def change_op(old: Column, new: Column) -> Column:
    """The op that a user's edit means: unset when cleared, set otherwise, none if nothing changed."""
    a, b = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    return F.when(a == b, F.lit(None)).when(b == "", "unset").otherwise("set")


def shape_of(payload: Column) -> Column:
    """array, object, string, number, null or invalid."""
    head = F.substring(F.trim(payload), 1, 1)
    ok = F.try_parse_json(payload).isNotNull()
    return F.when(~ok, "invalid").when(head == "[", "array").when(head == "{", "object").when(head == '"', "string").when(F.trim(payload) == "null", "null").otherwise("number")


def migrated(payload: Column) -> Column:
    """An object becomes an array of it; arrays stay, so a second run changes nothing."""
    return F.when(shape_of(payload) == "object", F.concat(F.lit("["), payload, F.lit("]"))).otherwise(payload)


def running_state(log: DataFrame) -> DataFrame:
    """Each item with how many came before on its path, and the value it replaced."""
    w = W.partitionBy("doc_id", "path").orderBy("ts", "seq")
    return log.withColumn("before", F.lag("value").over(w)).withColumn("nth", F.row_number().over(w).cast("long"))


def _segments(path: str) -> list:
    import re

    parts = [p for p in re.split(r"[./]", re.sub(r"\[(\d+)\]", r".\1", path)) if p]
    return [int(p) if p.isdigit() else p for p in parts]


def patch(doc, op: str, path: str, value, splice: bool = False):
    """Sets, unsets or appends at one path of a JSON value: lists grow with null, missing keys are made, a wrong container is left alone.

    An unset list item becomes null; with ``splice`` it is taken out, as clients do.
    """
    parts = _segments(path)
    if not parts:
        return doc
    node = doc
    for here, then in zip(parts[:-1], parts[1:], strict=True):
        fresh = [] if isinstance(then, int) else {}
        if isinstance(here, int):
            if not isinstance(node, list) or (op == "unset" and here >= len(node)):
                return doc
            while len(node) <= here:
                node.append(None)
        elif not isinstance(node, dict) or (op == "unset" and here not in node):
            return doc
        if (node[here] if isinstance(here, int) else node.get(here)) is None and op != "unset":
            node[here] = fresh
        node = node[here]
    last = parts[-1]
    if isinstance(last, int) != isinstance(node, list) or not isinstance(node, list | dict):
        return doc
    if op == "unset":
        if isinstance(node, dict):
            node.pop(last, None)
        elif last < len(node):
            if splice:
                del node[last]
            else:
                node[last] = None
        return doc
    old = node.get(last) if isinstance(node, dict) else node[last] if last < len(node) else None
    if op == "append" and not isinstance(old, list | None):
        return doc
    if isinstance(node, list):
        while len(node) <= last:
            node.append(None)
    node[last] = [*(old or []), value] if op == "append" else value
    return doc


#: What clients call an operation, and what it is; anything else sets.
CLIENT_OPS = {"unset": "unset", "remove": "unset", "append": "append"}


def patched(docs: DataFrame, log: DataFrame, client: bool = False) -> DataFrame:
    """docs(doc_id, json) with log(doc_id, ts, seq, op, path, value as JSON) applied in order. A document's items go with it as one array.

    ``client``: operations have their client names, and a removed list item closes up.
    """
    items = log.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "op", "path", "value"))).alias("items"))

    @F.pandas_udf("string")
    def apply(document: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, items in zip(document, lists, strict=True):
            doc = json.loads(text) if text else {}
            for item in items if items is not None else []:
                op = CLIENT_OPS.get(item["op"], "set") if client else item["op"]
                doc = patch(doc, op, item["path"], json.loads(item["value"]) if item["value"] is not None else None, client)
            out.append(json.dumps(doc, sort_keys=True, ensure_ascii=False))
        return pd.Series(out)

    return docs.join(items, "doc_id", "left").select("doc_id", apply("json", "items").alias("json"))
