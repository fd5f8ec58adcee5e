"""Identifiers shared between files: links through a value, identities behind it, group scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.scores import GROUP_LADDER, at_least, at_most
from tamis.functions.similarity import add_text_similarity
from tamis.session import durable


def profile(rows: DataFrame, file: str, name: str, value: str, document: str) -> DataFrame:
    """(file, name, value, documents): each different value of a named field in a file, with its number of documents."""
    some = rows.filter(F.trim(F.col(value)) != "")
    return some.groupBy(file, name, value).agg(F.countDistinct(document).alias("documents"))


def shared_values(prof: DataFrame, file: str, value: str) -> DataFrame:
    """(value, files): values that more than one file has. Aggregated on the value, so no pairs are made."""
    return prof.groupBy(value).agg(F.countDistinct(file).alias("files")).filter("files > 1")


def group_scores(prof: DataFrame, file: str, name: str, value: str, group: str, identity: str) -> DataFrame:
    """(value, identities, score): for each value of `group`, the number of different identities of the files that have it, and its ladder."""
    own = prof.filter(F.col(name) == group).select(file, value).distinct()
    who = prof.filter(F.col(name) == identity).select(F.col(file), F.col(value).alias("_who"))
    agg = own.join(who, file).groupBy(value).agg(F.countDistinct("_who").alias("identities"))
    return agg.select(value, "identities", at_most(F.col("identities"), GROUP_LADDER, 0.6).alias("score"))


def linked_names(prof: DataFrame, file: str, name: str, value: str, shared: str, label: str, block: int = 500) -> DataFrame:
    """(file, value, linked, least, score): for each file with a value of `shared` that others have too, the other files of the value with
    labels, and how alike the least like of them is: two files are as alike as the most alike pair of their labels.

    The score is the ladder of the least, 0 where no other file has a label, null where the file has none. Files with the same labels count
    as one before any pair is made; the different ones of a value are held against each other in blocks of about `block`, each pair of
    blocks a key of the join, so the work grows with the square of a value's different sets of labels, over many tasks.
    """
    prof = durable(prof.filter(F.col(name).isin(shared, label)))
    own = prof.filter(F.col(name) == shared).select(file, value).distinct()
    own = own.join(shared_values(own, file, value).select(value), value)
    labels = prof.filter(F.col(name) == label).select(F.col(file), F.col(value).alias("_label")).distinct()
    # files with the same labels, by two hashes of them and their number, stand behind the first of them
    print_of = ["_h", "_g", "_n"]
    sets = labels.groupBy(file).agg(F.bit_xor(F.xxhash64("_label")).alias("_h"), F.bit_xor(F.xxhash64(F.lit(1), "_label")).alias("_g"), F.count("*").alias("_n"))
    first = sets.groupBy(*print_of).agg(F.min(file).alias("_set"))
    members = durable(own.join(sets.join(first, print_of).select(file, "_set"), file, "left"))
    groups = members.filter("_set IS NOT NULL").groupBy(value, "_set").agg(F.count("*").alias("_files"))
    size = groups.groupBy(value).agg(F.sum("_files").alias("_all"), F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    placed = groups.join(size, value).withColumn("_at", F.pmod(F.xxhash64("_set"), "_parts").cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    a = placed.select(value, F.col("_set").alias("_a"), F.col("_at").alias("_i"), others.alias("_j"))
    b = placed.select(value, F.col("_set").alias("_b"), F.col("_at").alias("_j"), others.alias("_i"))
    pairs = a.join(b, [value, "_i", "_j"]).filter("_a <> _b").select(value, "_a", "_b")
    of = lambda at, out: labels.select(F.col(file).alias(at), F.col("_label").alias(out))
    rated = add_text_similarity(pairs.join(of("_a", "_x"), "_a").join(of("_b", "_y"), "_b").select(value, F.col("_a").alias("_left"), F.col("_b").alias("_right"), "_x", "_y"), "_x", "_y", "_s")
    least = rated.groupBy(value, "_left", "_right").agg(F.max("_s").alias("_s")).groupBy(value, F.col("_left").alias("_set")).agg(F.min("_s").alias("_s"))
    known = groups.join(size.select(value, "_all"), value).join(least, [value, "_set"], "left").select(value, "_set", (F.col("_all") - 1).alias("_linked"), F.coalesce("_s", F.when(F.col("_files") > 1, 1.0)).alias("least"))
    rows = members.join(known, [value, "_set"], "left").join(size.select(value, "_all"), value, "left")
    linked = F.coalesce("_linked", "_all", F.lit(0))
    score = F.when(F.col("_set").isNotNull(), F.when(linked > 0, at_least(F.col("least"))).otherwise(0.0))
    return rows.select(file, value, linked.alias("linked"), "least", score.alias("score"))


def links_between(prof: DataFrame, file: str, name: str, value: str, shared: str) -> DataFrame:
    """(file, hub, value): each file with a value that others have, linked to the first of them: a star, not all pairs."""
    own = prof.filter(F.col(name) == shared).select(file, value).distinct()
    hubs = own.groupBy(value).agg(F.min(file).alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return own.join(hubs, value).filter(F.col(file) != F.col("hub")).select(file, "hub", value)
