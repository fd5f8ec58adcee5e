"""Catalogues and audits of tables: coverage, duplicates, uniqueness, samples, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_catalog(rows: DataFrame, name: str, value: str, file: str, kind: str) -> DataFrame:
    """(name, occurrences, files, non_empty, kinds): of each field name, rows, files, rows with a value, and kinds of document."""
    filled = F.coalesce(F.trim(F.col(value)) != "", F.lit(False))
    return rows.groupBy(name).agg(F.count("*").alias("occurrences"), F.countDistinct(file).alias("files"), F.count_if(filled).alias("non_empty"), F.countDistinct(kind).alias("kinds"))


def coverage(rows: DataFrame, name: str, value: str, file: str, spine: DataFrame) -> DataFrame:
    """(name, files, coverage): of how many files of the spine each field has a value, and their share, rounded to 4."""
    total = spine.select(F.countDistinct(file).alias("_total"))
    some = rows.filter(F.trim(F.col(value)) != "").join(spine.select(file).distinct(), file, "left_semi")
    counted = some.groupBy(name).agg(F.countDistinct(file).alias("files"))
    return counted.join(F.broadcast(total)).select(name, "files", F.round(F.col("files") / F.col("_total"), 4).alias("coverage"))


def property_catalog(df: DataFrame, label: str) -> DataFrame:
    """(table_name, property, filled): how many rows have each column, in one aggregate."""
    row = df.agg(*(F.count(c).alias(c) for c in df.columns))
    return row.unpivot([], row.columns, "property", "filled").select(F.lit(label).alias("table_name"), "property", "filled")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t, df in tables.items()])


def duplicate_groups(df: DataFrame, value: Column, row_id: str, most: int) -> DataFrame:
    """(value, rows, first_id): the `most` values with the most rows beyond one, ties by value: a report, so the limit is its purpose."""
    groups = df.groupBy(value.alias("value")).agg(F.countDistinct(row_id).alias("rows"), F.min(row_id).alias("first_id")).filter((F.col("rows") > 1) & F.col("value").isNotNull())
    return groups.orderBy(F.desc("rows"), "value").limit(most)


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows): keys that aren't unique, or null; an empty result proves the constraint."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter((F.col("rows") > 1) | null)


def readiness(rows: DataFrame, file: str, name: str, needs: dict[str, tuple[str, ...]]) -> DataFrame:
    """(rule, ready, missing): for how many files each rule has all the fields that it needs, and for how many not."""
    all_names = sorted({n for v in needs.values() for n in v})
    present = rows.groupBy(file).agg(*(F.bool_or(F.coalesce(F.col(name) == n, F.lit(False))).alias(f"_{n}") for n in all_names))
    per_rule = present.agg(*(F.count_if(reduce(lambda a, b: a & b, [F.col(f"_{n}") for n in v])).alias(k) for k, v in needs.items()), F.count("*").alias("_all"))
    stacked = per_rule.unpivot(["_all"], list(needs), "rule", "ready")
    return stacked.select("rule", "ready", (F.col("_all") - F.col("ready")).alias("missing"))


def outcomes(checks: DataFrame, rule: str, status: str) -> DataFrame:
    """(rule, passed, violated, unavailable, violation_rate): of each rule, rounded to 4; null without an available row."""
    agg = checks.groupBy(rule).agg(F.count_if(F.col(status) == "NORMAL").alias("passed"), F.count_if(F.col(status) == "TRIGGERED").alias("violated"), F.count_if(F.col(status) == "UNAVAILABLE").alias("unavailable"))
    known = F.col("passed") + F.col("violated")
    return agg.withColumn("violation_rate", F.when(known > 0, F.round(F.col("violated") / known, 4)))


def seeded_sample(df: DataFrame, row_id: str, seed: int, size: int) -> DataFrame:
    """`size` rows without replacement, the same for the same seed: the smallest digests of seed and id. Null ids aren't drawn."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))
    return df.filter(F.col(row_id).isNotNull()).withColumn("_d", digest).orderBy("_d", row_id).limit(size).drop("_d")


def quota_sample(df: DataFrame, row_id: str, stratum: str, seed: int, quotas: dict[str, int]) -> DataFrame:
    """Rows of each listed stratum up to its quota, by digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))
    only = df.filter(F.col(stratum).isin(*quotas) & F.col(row_id).isNotNull()).withColumn("_d", digest)
    parts = [only.filter(F.col(stratum) == k).orderBy("_d", row_id).limit(n) for k, n in quotas.items()]  # a top-k of each, never a sort of a stratum in one task
    return reduce(lambda a, b: a.unionByName(b), parts).drop("_d")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with the rows of changes merged in by key, the last by `order` winning in each; columns that a change has null keep
    the base's value. Both sides first give one row for each key."""
    pick = lambda df: df.groupBy(*keys).agg(*(F.max_by(c, F.struct(F.col(order), F.col(c).cast("string"))).alias(c) for c in df.columns if c not in keys))
    old, new = pick(base), pick(changes.select(*base.columns))
    rest = [c for c in base.columns if c not in keys]
    new = new.withColumnsRenamed({c: f"_{c}" for c in rest})
    return old.join(new, keys, "full").select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in rest))


def top_patches(df: DataFrame, keys: list[str], values: str, k: int) -> DataFrame:
    """(keys, score): the mean of the k largest absolute deviations of an array from the profile of its places.

    The profile - mean and deviation of every place over all rows - has as many rows as the arrays have places.
    """
    cells = df.select(*keys, F.posexplode(values).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    stats = cells.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = cells.join(stats, "pos").withColumn("z", F.when(F.col("s") > 0, F.abs((F.col("x") - F.col("m")) / F.col("s"))).otherwise(0.0))
    # only the k largest of a key are kept, by a window that ends at k
    ranked = z.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("z"), "pos"))).filter(F.col("r") <= k)
    return ranked.groupBy(*keys).agg(F.avg("z").alias("score"))
