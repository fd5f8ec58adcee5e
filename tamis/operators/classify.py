"""Scoring of texts by weighted keywords, with a margin between the best two."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords of document types with their weights, and of banks.
TYPE_KEYWORDS = {
    "CIN": {"carte nationale d identite": 4.0, "carte d identite": 3.0, "numero d identifiant": 3.0, "date de naissance": 0.75, "lieu de naissance": 0.75},
    "RELEVE_BANCAIRE": {
        "releve de compte bancaire": 5.0, "releve de compte": 4.0, "solde depart": 3.0, "nouveau solde": 3.0, "solde final": 2.5, "total des mouvements": 3.0, "total mouvements": 2.5,
    },
    "RIB": {
        "releve d identite bancaire": 5.0, "identite bancaire": 4.0, "references bancaires": 3.0, "intitule du compte": 2.5, "titulaire du compte": 2.0, "code banque": 1.5, "code swift": 2.0, "bic": 1.0, "iban": 1.0,
    },
    "BULLETIN_SALAIRE": {
        "bulletin de paie": 5.0, "bulletin de salaire": 5.0, "salaire brut": 2.5, "salaire net imposable": 2.5, "net a payer": 1.5, "cotisation cnss": 1.5, "retenues": 1.0, "gains": 1.0,
    },
    "ATTESTATION_TRAVAIL": {"attestation de travail": 5.0, "nous soussignes": 2.5, "nous soussigne": 2.5, "certifions que": 2.0, "date d embauche": 1.5, "poste occupe": 1.5},
    "QUITTANCE": {
        "avis de facturation": 4.0, "periode de consommation": 2.5, "date limite de paiement": 1.5, "net a payer": 1.0, "lydec": 3.0, "amendis": 3.0, "maroc telecom": 3.0, "electricite": 0.75, "consommation": 0.75,
    },
}
BANK_KEYWORDS = {"CIH": ("cih bank", "cihmamc", "cih"), "ATTIJARI": ("attijariwafa", "attijari", "bcmamamc")}
LEAST_SCORE, LEAST_MARGIN = 2.0, 0.75


def keyword_scores(text: Column, rules: dict[str, dict[str, float]]) -> dict[str, Column]:
    """The sum of the weights of a class's keywords that a normalised text contains, for each class."""
    return {k: reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(w)), F.lit(x)).otherwise(0.0) for w, x in words.items()]) for k, words in rules.items()}


def classify(df: DataFrame, text: str, rules=TYPE_KEYWORDS, least: float = LEAST_SCORE, margin: float = LEAST_MARGIN) -> DataFrame:
    """df with doc_class, class_score, class_margin and class_confidence.

    UNKNOWN, with a confidence of 0, where the best score is below `least` or leads by less than `margin`; of equal scores the
    first class by name leads. Null texts are UNKNOWN with scores of 0. An expression over one row: no shuffle.
    """
    scores = keyword_scores(F.coalesce(F.col(text), F.lit("")), rules)
    ranked = F.array_sort(F.array(*(F.struct((-s).alias("s"), F.lit(k).alias("k")) for k, s in sorted(scores.items()))))
    out = df.withColumn("_r", ranked).withColumn("class_score", -F.col("_r")[0]["s"]).withColumn("class_margin", F.round(F.col("_r")[1]["s"] - F.col("_r")[0]["s"], 4))
    total = F.aggregate("_r", F.lit(0.0), lambda a, x: a - x["s"])
    confidence = F.round(F.col("class_score") / F.greatest(total, F.col("class_score"), F.lit(1.0)), 4)
    known = (F.col("class_score") >= least) & (F.col("class_margin") >= margin)
    return out.withColumn("class_confidence", F.when(known, confidence).otherwise(0.0)).withColumn("doc_class", F.when(known, F.col("_r")[0]["k"]).otherwise("UNKNOWN")).drop("_r")


def detect_bank(text: Column, rules: dict[str, tuple[str, ...]] = BANK_KEYWORDS) -> Column:
    """struct(bank, confidence) of a normalised text: the bank with the most keywords in it; UNKNOWN with a confidence of 0 where none has
    one, or two have as many."""
    hits = {k: reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words]) for k, words in rules.items()}
    ranked = F.array_sort(F.array(*(F.struct((-n).alias("n"), F.lit(k).alias("k")) for k, n in sorted(hits.items()))))
    total = reduce(lambda a, b: a + b, hits.values())
    sure = (ranked[0]["n"] < 0) & (ranked[0]["n"] < ranked[1]["n"])
    return F.struct(F.when(sure, ranked[0]["k"]).otherwise("UNKNOWN").alias("bank"), F.when(sure, F.round(-ranked[0]["n"] / total, 4)).otherwise(0.0).alias("confidence"))


def best_template(doc_type: Column, visual: Column, bank: Column, by_bank: dict[str, dict[str, str]], single: dict[str, str]) -> Column:
    """A template of a document type: what the visual comparison found, else the bank's, else the type's only one; null without any."""
    pairs = [F.when((doc_type == t) & (bank == b), F.lit(x)) for t, banks in by_bank.items() for b, x in banks.items()]
    pairs += [F.when(doc_type == t, F.lit(x)) for t, x in single.items()]
    return F.coalesce(F.nullif(visual, F.lit("")), *pairs)


def route(template: Column, certain: Column, otherwise: str = "A_VERIFIER") -> Column:
    """The folder of a document: its template, if there is one and it is certain."""
    return F.when(F.coalesce((F.trim(template) != "") & certain, F.lit(False)), template).otherwise(otherwise)
