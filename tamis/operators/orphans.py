"""References to rows that don't exist, found key by key before any row is moved.

References are pre-aggregated by key and period, then by key, with their number and earliest load. An anti-join of these keys
with the targets that exist in time leaves the keys that are bad for at least one row; no key gathers rows there, since each is one
row. The rows of bad keys are then picked: by broadcast while the bad keys are few, their number being counted; beyond that
the `HEAVY` heaviest of them by broadcast, a list of fixed length, and the rest by a shuffled join. Both parts are united.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.session import durable, table

#: Length of the list of heavy keys: the bound of what is broadcast.
HEAVY = 1000
#: A key with fewer rows than this is never worth a broadcast of its own.
HEAVY_ROWS = 5000
#: Bad keys that are broadcast as a whole: about 10 MB of keys.
FEW_KEYS = 100_000
PLACEHOLDER = "DOSSIER_UNKNOWN"


@dataclass(frozen=True)
class Reference:
    table: str
    column: str
    row_id: str
    target: str
    target_key: str


#: The references of the dossier tables.
DOSSIER_REFERENCES = (
    Reference("dossier_document", "dossier_id", "doc_id", "dossier", "dossier_id"),
    Reference("champ", "doc_id", "champ_id", "dossier_document", "doc_id"),
    Reference("txn", "doc_id", "transaction_id", "dossier_document", "doc_id"),
    Reference("champ", "nom", "champ_id", "ref_champ", "nom"),
)


def not_blank(c: Column) -> Column:
    """Not null, and at least one character that isn't white space of any kind."""
    return F.coalesce(c.rlike(r"[^\s\p{Z}]"), F.lit(False))


def reference_rows(tables: dict[str, DataFrame], references=DOSSIER_REFERENCES, placeholder: str = PLACEHOLDER) -> DataFrame:
    """(table_nom, colonne, cible, ligne_id, cle, charge) of every reference; one scan for each referring table."""
    out = None
    for name in dict.fromkeys(r.table for r in references):
        own = [r for r in references if r.table == name]
        entries = [F.struct(F.lit(r.column).alias("colonne"), F.lit(f"{r.target}.{r.target_key}").alias("cible"), F.col(r.row_id).cast("string").alias("ligne_id"), F.col(r.column).cast("string").alias("cle")) for r in own]
        part = tables[name].select(F.lit(name).alias("table_nom"), F.explode(F.array(*entries)).alias("r"), F.col("loaded_at").alias("charge")).select("table_nom", "r.*", "charge")
        out = part if out is None else out.unionByName(part)
    return out.filter(not_blank(F.col("cle")) & (F.col("cle") != placeholder))


def target_rows(tables: dict[str, DataFrame], references=DOSSIER_REFERENCES) -> DataFrame:
    """(cible, cle, cible_charge, cible_supprimee): one row for each key that can be referred to."""
    out = None
    for target, key in dict.fromkeys((r.target, r.target_key) for r in references):
        part = tables[target].filter(F.col(key).isNotNull()).groupBy(F.lit(f"{target}.{key}").alias("cible"), F.col(key).cast("string").alias("cle")).agg(F.min("loaded_at").alias("cible_charge"), F.max(F.col("supprime_at").isNotNull()).alias("cible_supprimee"))
        out = part if out is None else out.unionByName(part)
    return out


def motif(charge: str = "charge") -> Column:
    return F.when(F.col("cible_supprimee").isNull(), "ABSENT").when(F.col("cible_supprimee"), "SUPPRIME").when(F.col("cible_charge") > F.col(charge), "TARDIF")


def reference_keys(refs: DataFrame) -> DataFrame:
    """(cible, cle, n, premiere): every key that is referred to, with its number of rows and its earliest load, aggregated by period first."""
    per_period = refs.groupBy("cible", "cle", F.date_format("charge", "yyyy-MM").alias("periode")).agg(F.count("*").alias("n"), F.min("charge").alias("premiere"))
    return per_period.groupBy("cible", "cle").agg(F.sum("n").alias("n"), F.min("premiere").alias("premiere"))


def bad_keys(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """(cible, cle, n, cible_charge, cible_supprimee): keys that are absent, deleted, or later than their earliest reference."""
    key = ["cible", "cle"]
    keys = reference_keys(refs)
    good = targets.filter(~F.col("cible_supprimee"))
    late = F.coalesce(F.col("g.cible_charge") > F.col("k.premiere"), F.lit(False))
    bad = keys.alias("k").join(good.alias("g"), (F.col("k.cible") == F.col("g.cible")) & (F.col("k.cle") == F.col("g.cle")) & ~late, "left_anti")
    return bad.select(*key, "n").join(targets, key, "left")


def heaviest(keys: DataFrame, heavy: int = HEAVY, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The `heavy` keys with the most rows, as a driver-side list of at most that length."""
    top = keys.filter(F.col("n") >= heavy_rows).orderBy(F.desc("n"), "cible", "cle").limit(heavy)
    return keys.sparkSession.createDataFrame([(r.cible, r.cle) for r in top.select("cible", "cle").collect()], "cible STRING, cle STRING")


def heavy_keys(refs: DataFrame, heavy: int = HEAVY, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """heaviest() of all keys that are referred to."""
    return heaviest(reference_keys(refs), heavy, heavy_rows)


def orphans(refs: DataFrame, targets: DataFrame, heavy: int = HEAVY, heavy_rows: int = HEAVY_ROWS, few_keys: int = FEW_KEYS) -> DataFrame:
    """(table_nom, ligne_id, colonne, motif, periode): one row for each reference that has no row in time.

    ABSENT: no such key. SUPPRIME: its row is deleted. TARDIF: its earliest row is later than the referring one.
    Null, blank and placeholder keys are no references. Repeated rows (same id and key) count once with their
    earliest load; a row with a null load is never TARDIF and has a null period; null row ids form one row per key.
    """
    key = ["cible", "cle"]
    bad = durable(bad_keys(refs, targets))
    if bad.count() <= few_keys:
        rows = refs.join(F.broadcast(bad.drop("n")), key)
    else:
        hot = heaviest(bad, heavy, heavy_rows)
        by_broadcast = refs.join(F.broadcast(bad.drop("n").join(F.broadcast(hot), key)), key)
        by_shuffle = refs.join(F.broadcast(hot), key, "left_anti").join(bad.drop("n"), key)
        rows = by_broadcast.unionByName(by_shuffle)
    # a copy that is itself in time can't be the earliest of a late reference, so it may go before the grouping
    once = rows.filter(motif().isNotNull()).groupBy("table_nom", "colonne", "ligne_id", "cle", "cible_charge", "cible_supprimee").agg(F.min("charge").alias("charge"))
    return once.select("table_nom", "ligne_id", "colonne", motif().alias("motif"), F.date_format("charge", "yyyy-MM").alias("periode")).distinct()


def dossier_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in ("dossier", "dossier_document", "champ", "txn", "ref_champ")}


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan counts for each table, column, reason and period."""
    return found.groupBy("table_nom", "colonne", "motif", "periode").agg(F.count("*").alias("nb"))
