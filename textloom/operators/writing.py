"""Safe writes planned as tables: conflict decisions, paths, backups, retention, clean-up, last write of each format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import output_path

KEPT_BACKUPS = 5
STRATEGIES = ("prompt", "overwrite", "skip", "smart-merge")


def conflict_action(exists: Column, strategy: Column, interactive: Column) -> Column:
    """create, overwrite, skip, merge, ask or error. A strategy that isn't known counts as prompt."""
    known = F.when(strategy.isin(*STRATEGIES), strategy).otherwise("prompt")
    return F.when(~exists, "create").when(known == "overwrite", "overwrite").when(known == "skip", "skip").when(~interactive, "error").when(known == "smart-merge", "merge").otherwise("ask")


def write_status(skipped: Column, merged: Column, is_new: Column, backup: Column) -> Column:
    return F.when(skipped, "skipped").when(merged, "merged").when(is_new, "new").when(backup, "backup").otherwise("overwritten")


def planned_writes(requests: DataFrame, overrides: DataFrame, existing: DataFrame) -> DataFrame:
    """Requests (format, strategy, interactive) with their path and action. Overrides (format, override) and existing (path) are looked up by key."""
    out = requests.join(overrides.dropDuplicates(["format"]), "format", "left").withColumn("path", output_path(F.col("format"), F.col("override"))).drop("override")
    out = out.join(existing.select("path", F.lit(True).alias("found")).dropDuplicates(["path"]), "path", "left")
    exists = F.coalesce("found", F.lit(False))
    return out.select("format", "path", exists.alias("exists"), "strategy", "interactive", conflict_action(exists, F.col("strategy"), F.col("interactive")).alias("action"))


def not_generated(existing: DataFrame, requested: DataFrame) -> DataFrame:
    """Existing outputs whose format isn't being generated."""
    return existing.join(requested.select("format").distinct(), "format", "left_anti")


def expired_backups(backups: DataFrame, file: str, mtime: str, tie: str, keep: int = KEPT_BACKUPS) -> DataFrame:
    """Backups beyond the newest ``keep`` of each file."""
    order = Window.partitionBy(file).orderBy(F.desc(mtime), F.desc(tie))
    return backups.withColumn("age_rank", F.row_number().over(order)).where(F.col("age_rank") > keep)


def cleanup_counts(files: DataFrame, mtime: Column, now: Column, oldest: str = "interval 24 hours") -> DataFrame:
    """Files to delete (strictly older), to keep, and to skip because their time lies ahead."""
    age = now - mtime
    return files.agg(F.count_if(age > F.expr(oldest)).alias("deleted"), F.count_if((age <= F.expr(oldest)) & (mtime <= now)).alias("kept"), F.count_if(mtime > now).alias("skipped"))


def last_write(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The last row of each key. One aggregation: partial results meet, not rows."""
    latest = F.max_by(F.struct(*values), F.col(order)).alias("v")
    return rows.groupBy(key).agg(F.max(order).alias(order), latest).select(key, order, *[F.col(f"v.{v}").alias(v) for v in values])
