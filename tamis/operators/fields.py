"""Long field rows into documents, and back: last and first wins, wide rows, canonical and combined fields, transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import text as T

#: Statuses of a field that carries no value, other names of document types and of fields.
UNUSABLE = ("MISSING", "INVALID FORMAT", "ABSENT DU TEMPLATE", "OPTIONAL MISSING")
DOC_TYPES = {"BULLETIN_DE_SALAIRE": "BULLETIN_SALAIRE", "ATTESTATION_DE_TRAVAIL": "ATTESTATION_TRAVAIL"}
FIELD_NAMES = {"cin_numero": "CIN", "cin": "CIN", "net_a_payer": "NET_A_PAYER", "nom_employe": "NOM_EMPLOYE"}


def latest(df: DataFrame, keys: list[str], order: str = "loaded_at", same: tuple[str, ...] = (), ties: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each key: the last by `order`, nulls first. Null keys are keys.

    Rows that tie in order are taken by the smallest hash of `ties`, by default of all other columns, so the choice doesn't
    depend on where they lie; with no ties at all, such rows must be equal. `same` names columns that are the same in all rows
    of a key: filters on them, and on the keys, reach the scan, and rows of a null key spread by them. With both given, only
    the columns that a query needs are read and moved. Copies are dropped before the exchange where they lie together.
    """
    others = [c for c in df.columns if c not in keys] if ties is None else ties
    w = Window.partitionBy(*keys, *same).orderBy(F.col(order).desc_nulls_last(), *([F.xxhash64(*others)] if others else []))
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def earliest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the first by `order`, nulls last."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last(), F.xxhash64(*[c for c in df.columns if c not in keys]))
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def usable(status: Column, normalized: Column, raw: Column) -> Column:
    """The normalised value, else the raw one; null where the status says that there is none."""
    return F.when(~F.coalesce(F.replace(T.upper_words(status), F.lit("_"), F.lit(" ")).isin(*UNUSABLE), F.lit(False)), F.coalesce(normalized, raw))


def canonical(c: Column, names: dict[str, str]) -> Column:
    """The canonical name of a name, itself in upper case where it has no other."""
    u = F.upper(F.trim(c))
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k.upper(), v)])
    return F.coalesce(table[u], u)


def document_type(c: Column) -> Column:
    """The canonical type of a document: upper words joined by _, and their other names resolved."""
    u = F.replace(T.upper_words(c), F.lit(" "), F.lit("_"))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in DOC_TYPES.items() for x in kv])[u], u)


def wide(fields: DataFrame, keys: list[str], name: str, value: str, columns: dict[str, str], order: str | None = None) -> DataFrame:
    """One row for each key with a column for each listed field name: a conditional aggregate, so one shuffle on the keys and
    no list of values first. With `order` the last value wins, else the greatest. Absent fields are null."""
    only = fields.filter(F.col(name).isin(*columns.values()))
    pick = lambda n: F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.col(order))) if order else F.max(F.when(F.col(name) == n, F.col(value)))
    return only.groupBy(*keys).agg(*(pick(n).alias(out) for out, n in columns.items()))


def first_of_alias(fields: DataFrame, keys: list[str], name: str, value: str, order: str, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row for each key with a column for each group of aliases: the first non-blank value whose name is in the group."""
    def pick(names: tuple[str, ...]) -> Column:
        fits = F.col(name).isin(*names) & (F.trim(F.col(value)) != "")
        return F.min_by(F.when(fits, F.col(value)), F.when(fits, F.col(order)))

    return fields.groupBy(*keys).agg(*(pick(names).alias(out) for out, names in aliases.items()))


def combined_name(fields: DataFrame, keys: list[str], name: str, value: str, confidence: str, parts: tuple[str, str]) -> DataFrame:
    """(keys, full_name, confidence) of documents that have both parts: family name, then given name; the least confidence."""
    pick = lambda n, c: F.max(F.when(F.col(name) == n, F.col(c)))
    both = fields.filter(F.col(name).isin(*parts)).groupBy(*keys).agg(pick(parts[0], value).alias("_a"), pick(parts[1], value).alias("_b"), F.min(confidence).alias("confidence"))
    return both.filter((F.trim("_a") != "") & (F.trim("_b") != "")).select(*keys, T.clean_spaces(F.concat_ws(" ", "_a", "_b")).alias("full_name"), "confidence")


def numbered_transactions(df: DataFrame, doc_id: str, items: str) -> DataFrame:
    """One row for each element of an array of structs, with its place from 1 and an id made of both."""
    out = df.select(F.col(doc_id), F.posexplode(items).alias("_at", "_item"))
    return out.select(doc_id, (F.col("_at") + 1).alias("tx_idx"), F.format_string("%s__TX%03d", F.col(doc_id), F.col("_at") + 1).alias("transaction_id"), "_item.*")


def view_of(fields: DataFrame, keys: list[str], name: str, value: str, whitelist: tuple[str, ...]) -> DataFrame:
    """(keys, view): the listed fields with a value as one JSON object, names in order; documents without any give no row."""
    some = fields.filter(F.col(name).isin(*whitelist) & F.col(value).isNotNull()).groupBy(*keys, name).agg(F.max(value).alias(value))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col(value).alias("v"))))
    return some.groupBy(*keys).agg(F.to_json(F.map_from_entries(pairs)).alias("view"))


def unpivoted(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, property, value): columns as rows, values as text."""
    typed = df.select(*keys, *(F.col(c).cast("string").alias(c) for c in columns))
    return typed.unpivot(keys, columns, "property", "value")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
