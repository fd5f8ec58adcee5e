"""Blocks of text with places on a page: labels and their values, rows, transactions.

A page is read with the plans of one document at a time: every join has the document as its equality key, so its size is
that of a page, and pages spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.functions import values as V

BLOCK = "text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, score DOUBLE"
#: Labels of the fields of each document type, in lower words; and patterns that find a value anywhere.
LABELS = {
    "CIN": {"cin_numero": ("numero d identifiant", "n d identifiant"), "nom": ("nom",), "prenom": ("prenom",), "date_naissance": ("date de naissance", "ne le"), "lieu_naissance": ("lieu de naissance",), "adresse": ("adresse",), "nationalite": ("nationalite",), "sexe": ("sexe",)},
    "QUITTANCE": {"nom_abonne": ("nom de l abonne", "abonne", "client"), "adresse": ("adresse",), "ville": ("ville",), "date_facture": ("date de facture", "date facture"), "net_a_payer": ("net a payer",)},
    "RIB": {"banque": ("banque",), "titulaire": ("titulaire", "titulaire du compte"), "rib": ("rib",), "iban": ("iban",)},
    "RELEVE_BANCAIRE": {"banque": ("banque",), "titulaire": ("titulaire",), "adresse": ("adresse",), "rib": ("rib",), "solde_ouverture": ("solde initial", "ancien solde", "solde d ouverture"), "solde_cloture": ("solde final", "nouveau solde", "solde de cloture"), "total_credits": ("total credits",), "total_debits": ("total debits",)},
    "BULLETIN_SALAIRE": {"nom_employe": ("nom",), "prenom_employe": ("prenom",), "employeur": ("employeur", "societe"), "poste": ("poste", "fonction"), "periode": ("periode", "mois"), "salaire_brut": ("salaire brut", "brut"), "net_a_payer": ("net a payer",)},
    "ATTESTATION_TRAVAIL": {"nom": ("nom", "m", "mme"), "cin": ("cin",), "employeur": ("employeur", "societe"), "poste": ("poste", "en qualite de"), "date_embauche": ("date d embauche", "depuis le"), "salaire_mensuel": ("salaire mensuel",)},
}
PATTERNS = {"cin_numero": r"\b([A-Z]{1,2}\d{5,8})\b", "cin": r"\b([A-Z]{1,2}\d{5,8})\b", "iban": r"\b(MA\d{2}[0-9 ]{20,30})\b", "rib": r"\b(\d{3} ?\d{3} ?\d{16} ?\d{2})\b", "date_embauche": r"(\d{1,2}[/.-]\d{1,2}[/.-]\d{4})"}
AMOUNT = r"^-?\d{1,3}(?:[ .]?\d{3})*(?:[.,]\d{2})$"
DAY = r"^\d{1,2}[/.-]\d{1,2}(?:[/.-]\d{2,4})?$"


def blocks(pages: DataFrame, doc_id: str = "doc_id", items: str = "blocks") -> DataFrame:
    """(doc_id, block_idx, text, norm, x0, y0, x1, y1, xc, yc, score): one row for each block that has a text."""
    rows = pages.select(F.col(doc_id).alias("doc_id"), F.posexplode(items).alias("block_idx", "b")).select("doc_id", "block_idx", "b.*")
    rows = rows.filter(F.trim("text") != "")
    return rows.withColumns({"norm": T.lower_words(F.col("text")), "xc": (F.col("x0") + F.col("x1")) / 2, "yc": (F.col("y0") + F.col("y1")) / 2})


def labelled_values(block: DataFrame, labels: DataFrame, same_row: float = 12.0, below: float = 60.0) -> DataFrame:
    """(doc_id, field_name, raw_value, confidence, method): for each label of a document the nearest block to its right in the same row,
    else the nearest below; else what follows a colon in the label's own block.

    labels: (doc_id, field_name, label). The first label by place counts. A block that is a label itself is no value.
    """
    named = block.join(labels.withColumnRenamed("doc_id", "_doc"), (F.col("doc_id") == F.col("_doc")) & ((F.col("norm") == F.col("label")) | F.startswith(F.col("norm"), F.concat("label", F.lit(" "))) & F.col("text").contains(":"))).drop("_doc")
    first = Window.partitionBy("doc_id", "field_name").orderBy((F.col("norm") != F.col("label")).cast("int"), "yc", "xc", "block_idx")
    named = named.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    is_label = labels.select(F.col("doc_id"), F.col("label").alias("norm")).distinct()
    values = block.join(is_label, ["doc_id", "norm"], "left_anti").select("doc_id", F.struct("text", "score", "x0", "y0", "xc", "yc", F.col("block_idx").alias("i")).alias("v"))
    near = named.join(values, "doc_id").filter(F.col("v.i") != F.col("block_idx"))
    right = (F.abs(F.col("v.yc") - F.col("yc")) <= same_row) & (F.col("v.x0") >= F.col("x1") - 3)
    under = (F.col("v.y0") >= F.col("y1") - 3) & (F.col("v.y0") - F.col("y1") <= below) & (F.abs(F.col("v.xc") - F.col("xc")) <= 120)
    cost = F.when(right, F.struct(F.lit(0).alias("k"), (F.col("v.x0") - F.col("x1")).alias("d"), F.col("v.i").alias("i"))).when(under, F.struct(F.lit(1).alias("k"), (F.col("v.y0") - F.col("y1")).alias("d"), F.col("v.i").alias("i")))
    best = near.withColumn("cost", cost).filter("cost IS NOT NULL").groupBy("doc_id", "field_name").agg(F.min_by(F.struct("v.text", "v.score", "cost.k"), "cost").alias("b"))
    inline = F.nullif(F.trim(F.regexp_extract("text", r":\s*(.+)$", 1)), F.lit(""))
    out = named.join(best, ["doc_id", "field_name"], "left")
    raw = F.coalesce(inline, F.col("b.text"))
    method = F.when(inline.isNotNull(), "INLINE").when(F.col("b.k") == 0, "RIGHT").when(F.col("b.k") == 1, "BELOW")
    return out.select("doc_id", "field_name", T.without_leading_signs(raw).alias("raw_value"), F.when(inline.isNotNull(), F.col("score")).otherwise(F.col("b.score")).alias("confidence"), method.alias("method")).filter("raw_value IS NOT NULL")


def pattern_values(block: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, field_name, raw_value, confidence, method): the first block that matches a field's pattern; patterns: (doc_id, field_name, pattern)."""
    joined = block.join(patterns, "doc_id").withColumn("raw_value", F.expr("nullif(regexp_extract(upper(text), pattern, 1), '')"))
    best = joined.filter("raw_value IS NOT NULL").groupBy("doc_id", "field_name").agg(F.min_by(F.struct("raw_value", "score"), "block_idx").alias("b"))
    return best.select("doc_id", "field_name", F.col("b.raw_value").alias("raw_value"), F.col("b.score").alias("confidence"), F.lit("PATTERN").alias("method"))


def extract_fields(pages: DataFrame, doc_type: str = "doc_type", rules=LABELS) -> DataFrame:
    """(doc_id, field_name, raw_value, confidence, status, method): all fields of each page's type.

    A field comes from its label, else from its pattern, else it is MISSING with a null value; a value found by pattern is TO_REVIEW.
    Pages of a type without rules give one row with field_name null and status NOT_IMPLEMENTED. doc_id is unique.
    """
    spark = pages.sparkSession
    flat = [(t, f, label, PATTERNS.get(f)) for t, fields in rules.items() for f, labels in fields.items() for label in labels]
    rule = F.broadcast(spark.createDataFrame(flat, "doc_type STRING, field_name STRING, label STRING, pattern STRING"))  # fixed rules
    typed = pages.select("doc_id", F.col(doc_type).alias("doc_type"))
    wanted = typed.join(rule, "doc_type")
    block = blocks(pages)
    by_label = labelled_values(block, wanted.select("doc_id", "field_name", "label"))
    by_pattern = pattern_values(block, wanted.filter("pattern IS NOT NULL").select("doc_id", "field_name", "pattern").distinct())
    best = by_label.unionByName(by_pattern).groupBy("doc_id", "field_name").agg(F.min_by(F.struct("raw_value", "confidence", "method"), (F.col("method") == "PATTERN").cast("int")).alias("b"))
    all_fields = wanted.select("doc_id", "field_name").distinct().join(best, ["doc_id", "field_name"], "left")
    status = F.when(F.col("b").isNull(), "MISSING").when(F.col("b.method") == "PATTERN", "TO_REVIEW").otherwise("EXTRACTED")
    found = all_fields.select("doc_id", "field_name", "b.raw_value", "b.confidence", status.alias("status"), F.col("b.method").alias("method"))
    other = typed.filter(~F.coalesce(F.col("doc_type").isin(*rules), F.lit(False))).select("doc_id", F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("string").alias("raw_value"), F.lit(None).cast("double").alias("confidence"), F.lit("NOT_IMPLEMENTED").alias("status"), F.lit(None).cast("string").alias("method"))
    return found.unionByName(other)


def page_rows(block: DataFrame, gap: float = 8.0) -> DataFrame:
    """block with row_idx: blocks in the same line, a new one beginning where the middle lies more than `gap` below the block before."""
    from tamis.operators.series import gap_clusters

    return gap_clusters(block, "doc_id", ["yc", "xc", "block_idx"], "yc", gap).withColumnRenamed("cluster", "row_idx")


def transactions(block: DataFrame, gap: float = 8.0) -> DataFrame:
    """(doc_id, tx_idx, date, libelle, montant, sens): lines of a statement that have a day and an amount and aren't balances or totals.

    The amounts' columns are told apart by the widest gap between their right edges: the left side is debit. A page whose
    amounts make one column has null directions.
    """
    from tamis.operators.series import largest_gap

    lines = page_rows(block, gap)
    is_amount, is_day = F.regexp_replace("text", r"\s", "").rlike(AMOUNT), F.trim("text").rlike(DAY)
    kind = F.when(is_day, "day").when(is_amount, "amount").otherwise("text")
    lines = lines.withColumn("kind", kind)
    pick = lambda k, c, o: F.min_by(F.when(F.col("kind") == k, F.col(c)), F.when(F.col("kind") == k, F.col(o)))
    words = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("xc", "text"))))  # the blocks of one line
    rows = lines.groupBy("doc_id", "row_idx").agg(pick("day", "text", "xc").alias("date"), F.max_by(F.when(F.col("kind") == "amount", F.col("text")), F.when(F.col("kind") == "amount", F.col("xc"))).alias("amount"), F.max(F.when(F.col("kind") == "amount", F.col("x1"))).alias("edge"), F.concat_ws(" ", F.transform(words, lambda w: w["text"])).alias("libelle"))
    rows = rows.filter(F.col("date").isNotNull() & F.col("amount").isNotNull() & ~T.upper_words(F.col("libelle")).rlike(r"\b(SOLDE|TOTAL)\b"))
    split = largest_gap(rows, "doc_id", "edge", 5.0).select("doc_id", "threshold")
    order = Window.partitionBy("doc_id").orderBy("row_idx")
    out = rows.join(split, "doc_id", "left").withColumn("tx_idx", F.row_number().over(order))
    side = F.when(F.col("threshold").isNotNull(), F.when(F.col("edge") <= F.col("threshold"), "D").otherwise("C"))
    return out.select("doc_id", "tx_idx", "date", "libelle", V.amount(F.col("amount")).alias("montant"), side.alias("sens"))


def bounding_box(block: DataFrame) -> DataFrame:
    """(doc_id, x0, y0, x1, y1, confidence): the box around all blocks of a document and their mean score."""
    return block.groupBy("doc_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(F.avg("score"), 4).alias("confidence"))


def after_anchor(block: DataFrame, anchor: str, accept: Column, within: int) -> DataFrame:
    """(doc_id, text): the first block that fits among the `within` blocks after the first one whose norm holds the anchor."""
    start = block.filter(F.contains("norm", F.lit(anchor))).groupBy("doc_id").agg(F.min("block_idx").alias("_at"))
    near = block.join(start, "doc_id").filter(F.col("block_idx").between(F.col("_at") + 1, F.col("_at") + within) & accept)
    return near.groupBy("doc_id").agg(F.min_by("text", "block_idx").alias("text"))
