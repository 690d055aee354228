"""Jobs, results and golden records: counts, pages, groups, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.lexicons import FILE_KINDS, JOB_STATUSES


def latest_status(events: DataFrame) -> DataFrame:
    """Job events (id, status, ts): a row a job with its last status."""
    return events.groupBy("id").agg(F.max_by("status", "ts").alias("status"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def status_counts(jobs: DataFrame) -> DataFrame:
    """Counts by status, zero where there are none; unknown statuses and log keys don't count."""
    domain = jobs.sparkSession.createDataFrame([(s,) for s in JOB_STATUSES], "status string")
    counted = jobs.where(~F.col("id").cast("string").endswith(":logs")).groupBy("status").agg(F.count("*").alias("n"))
    return domain.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def page(rows: DataFrame, order: list[Column], number: int, size: int, most: int = 200) -> DataFrame:
    """One page of an ordered listing, with the total and if there is a next one; order must end in a unique column."""
    size = max(1, min(size, most))
    total = rows.agg(F.count("*").alias("total"))
    found = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return found.crossJoin(F.broadcast(total)).withColumn("has_next", F.col("total") > number * size)


def matching(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows in which any of the columns contains the text, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower())
    return rows.where(hit)


def artifact_groups(files: DataFrame) -> DataFrame:
    """files(rid, file_name, stage, modified, needs_review) -> a row a result: the newest file, its stages, if it is canonical."""
    return files.groupBy("rid").agg(F.max_by("file_name", F.struct("modified", "file_name")).alias("newest"), F.bool_or(F.col("stage") == "canonical").alias("has_canonical"), F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages"), F.bool_or("needs_review").alias("needs_review"), F.count("*").alias("n_files"), F.max("modified").alias("modified"))


def first_source(*sources: DataFrame, key: str = "rid") -> DataFrame:
    """Of several sources the first that has a row for a key."""
    every = [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    out = every[0]
    for s in every[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    rank = F.row_number().over(W.partitionBy(key).orderBy("_priority"))
    return out.withColumn("_r", rank).where("_r = 1").drop("_r", "_priority")


def retained(log: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return log.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def newest_first(jobs: DataFrame, n: int) -> DataFrame:
    """The n newest jobs by the first time that is known of updated, started, created and completed (texts), as ``at``; unknown last."""
    at = F.coalesce(*(F.col(c).try_cast("timestamp") for c in ("updated_at", "started_at", "created_at", "completed_at")))
    return jobs.withColumn("at", at).orderBy(F.col("at").desc_nulls_last(), F.col("id")).limit(n)


def golden_list(golden: DataFrame, n: int) -> DataFrame:
    """The n last promoted records; one without a time is the oldest."""
    return golden.orderBy(F.coalesce("promoted_at", F.lit("")).desc(), "rid").limit(n)


def is_servable(folder: Column, name: Column, folders: tuple[str, ...] = ("inbox", "outbox", "golden")) -> Column:
    """If a file may be served: from a known folder, its name without a path."""
    return folder.isin(*folders) & ~name.contains("/") & ~name.contains("\\") & ~name.contains("..") & (name != "")


def shape_stats(files: DataFrame) -> DataFrame:
    """Log files (content) -> how many were scanned, are lists, need migration, can't be read."""
    first = F.substring(F.ltrim("content"), 1, 1)
    valid = F.get_json_object("content", "$").isNotNull()
    kind = F.when(~F.coalesce(valid, F.lit(False)), "errors").when(first == "[", "lists").otherwise("to_migrate")
    counted = files.agg(F.count("*").alias("scanned"), *(F.count(F.when(kind == k, 1)).alias(k) for k in ("lists", "to_migrate", "errors")))
    return counted.unpivot([], ["scanned", "lists", "to_migrate", "errors"], "kind", "n")


def last_events(log: DataFrame, n: int) -> DataFrame:
    """Of each kind the n last events (a ring of n places)."""
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.col("seq").desc()))
    return log.withColumn("place", place).where(F.col("place") <= n)


def file_kind(name: Column) -> Column:
    """What reads a file, by its ending; null where nothing does."""
    out = F.lit(None).cast("string")
    for ending, kind in FILE_KINDS.items():
        out = F.when(name.endswith(ending), kind).otherwise(out)
    return out


def job_id(name: Column) -> Column:
    """The debug files' variant of result_id(): only the longest of the two suffixes goes."""
    return F.when(name.endswith(".03_compose.debug"), F.regexp_replace(name, "[.]03_compose[.]debug$", "")).otherwise(F.regexp_replace(name, "[.]debug$", ""))
