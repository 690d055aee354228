"""Training examples from label exports, and examples made from templates."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import lexicons as L

_RESULT = "struct<from_name:string,type:string,value:struct<choices:array<string>,text:array<string>,start:int,end:int,labels:array<string>,rectanglelabels:array<string>,x:double,y:double>>"
TASK = f"struct<id:long,data:struct<text:string,page:int,y:double,is_bold:boolean>,annotations:array<struct<result:array<{_RESULT}>>>>"


def tasks(exports: DataFrame) -> DataFrame:
    """exports(content), each one task or a list of tasks in JSON -> a row a task; what can't be read is left out."""
    one = F.from_json("content", TASK)
    many = F.from_json("content", f"array<{TASK}>")
    lists = F.when(F.ltrim("content").startswith("["), many).otherwise(F.array(one))
    return exports.select(F.explode(lists).alias("t")).select("t.*").where("data.text is not null")


def line_labels(tasks: DataFrame, default: str = "JUNK") -> DataFrame:
    """id, text, page, role: a task's first choice, else its first box's label, else the default."""
    results = F.flatten(F.transform("annotations", lambda a: a["result"]))
    labels = F.flatten(F.array(F.flatten(F.transform(results, lambda r: F.coalesce(r["value"]["choices"], F.array().cast("array<string>")))), F.flatten(F.transform(results, lambda r: F.coalesce(r["value"]["rectanglelabels"], F.array().cast("array<string>"))))))
    return tasks.select("id", F.col("data.text").alias("text"), F.coalesce("data.page", F.lit(1)).alias("page"), F.coalesce(F.get(labels, 0), F.lit(default)).alias("role"))


def span_examples(tasks: DataFrame) -> DataFrame:
    """id, token, start, tag: white-space tokens of a task's text with B, I or O by the labelled spans that they overlap."""
    results = F.flatten(F.transform("annotations", lambda a: a["result"]))
    spans = F.filter(results, lambda r: r["value"]["labels"].isNotNull())
    text = F.col("data.text")
    words = F.filter(F.split(text, " "), lambda w: w.isNotNull())
    # where each token begins: the lengths before it, and a blank each
    begin = F.aggregate(words, F.array(F.lit(0)), lambda acc, w: F.array_append(acc, F.element_at(acc, -1) + F.length(w) + 1))
    each = tasks.select("id", spans.alias("spans"), F.posexplode(F.arrays_zip(words.alias("w"), begin.alias("b"))).alias("place", "t")).where("t.w <> ''")
    start, end = F.col("t.b"), F.col("t.b") + F.length("t.w")
    hit = F.get(F.filter("spans", lambda s: (s["value"]["start"] < end) & (s["value"]["end"] > start)), 0)
    label = F.get(hit["value"]["labels"], 0)
    tag = F.when(label.isNull(), "O").when(start <= hit["value"]["start"], F.concat(F.lit("B-"), label)).otherwise(F.concat(F.lit("I-"), label))
    return each.select("id", F.col("t.w").alias("token"), start.alias("start"), tag.alias("tag"))


def from_templates(templates: DataFrame, values: DataFrame, each: int) -> DataFrame:
    """templates(template_no, template), values(value_no, name, unit) -> text: each value set in ``each`` of the templates, by number.

    A join on the numbers that a value is due, not of all with all.
    """
    n = templates.count()
    due = values.withColumn("template_no", F.explode(F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: (F.col("value_no") + i) % n)))
    text = F.replace(F.replace("template", F.lit("{name}"), F.col("name")), F.lit("{unit}"), F.col("unit"))
    return due.join(templates, "template_no").select("value_no", "template_no", text.alias("text"))


def _words(text: str) -> list[tuple[int, int]]:
    """Where the white-space tokens of a text lie."""
    return [m.span() for m in re.finditer(r"\S+", text)]


def _name_before_number(text: str, words: list[tuple[int, int]]) -> int:
    """Where a name ends that no pattern found: one to three tokens, the first all letters, the next one a number or a bound; 0 without one."""
    if len(words) < 2 or not text[: words[0][1]].isalpha():
        return 0
    numbers = [i for i in range(1, min(4, len(words))) if text[words[i][0]] in "0123456789<>"]
    return words[numbers[0] - 1][1] if numbers else 0


def rule_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, label) of a row's parts by rules, stage by stage: name, flags, values, units, ranges. A stage leaves what earlier ones took."""
    named = next((m.span(1) for p in L.SPLIT_NAMES if (m := re.search(p, text, re.I))), None)
    if named is None and (end := _name_before_number(text, _words(text))):
        named = (0, end)
    out = [(*named, "TEST_NAME")] if named else []
    taken = bytearray(len(text))
    for label, patterns in L.SPLIT_STAGES.items():
        for start, end, _ in out:
            taken[start:end] = b"\1" * (end - start)
        out += [(*m.span(), label) for p in patterns for m in re.finditer(p, text, re.I) if 1 not in taken[m.start() : m.end()]]
    return sorted(out, key=lambda s: s[0])


def rule_tags(text: str) -> list[str]:
    """B, I or O of each white-space token: of a type only the first token is B."""
    words = _words(text)
    ends = [end for _, end in words]
    tags, began = ["O"] * len(words), {}
    for start, end, label in rule_spans(text):
        i = bisect_right(ends, start)  # the first token that reaches beyond the span's start
        while i < len(words) and words[i][0] < end:
            if tags[i] == "O":
                first = began.setdefault(label, i)
                tags[i] = ("I-" if first < i else "B-") + label
                began[label] = min(first, i)
            i += 1
    return tags


def tagged_by_rule(rows: DataFrame) -> DataFrame:
    """Adds ``tags``: what rule_tags() says of each row's text."""

    @F.pandas_udf("array<string>")
    def tags(text: pd.Series) -> pd.Series:
        return text.fillna("").str.strip().map(rule_tags)

    return rows.withColumn("tags", tags("text"))
