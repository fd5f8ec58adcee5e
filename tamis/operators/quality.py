"""Completeness and quality: statuses of fields, documents and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.functions import values as V

#: Documents that a file should hold, fields that a document of each type must have, and the least confidence of a read value.
EXPECTED = {"CIN": 1, "QUITTANCE": 1, "RIB": 1, "RELEVE_BANCAIRE": 3, "BULLETIN_SALAIRE": 3, "ATTESTATION_TRAVAIL": 1}
REQUIRED = {
    "CIN": ("cin_numero", "nom", "prenom", "date_naissance", "adresse"),
    "QUITTANCE": ("nom_abonne", "adresse", "ville"),
    "RIB": ("banque", "titulaire", "rib"),
    "RELEVE_BANCAIRE": ("banque", "titulaire", "adresse", "rib", "solde_ouverture", "solde_cloture", "total_credits", "total_debits", "transactions"),
    "BULLETIN_SALAIRE": ("nom_employe", "prenom_employe", "employeur", "poste", "periode", "salaire_brut", "net_a_payer"),
    "ATTESTATION_TRAVAIL": ("nom", "cin", "employeur", "poste", "date_embauche"),
}
LEAST_CONFIDENCE = 0.70
#: The kind of each field, by which it is normalised and validated; other fields are free text without a test.
KINDS = {
    "cin": ("cin_numero", "cin"),
    "rib": ("rib",),
    "identifier": ("iban",),
    "name": ("nom", "prenom", "nom_abonne", "titulaire", "nom_employe", "prenom_employe"),
    "date": ("date_naissance", "date_embauche", "date_facture", "date_solde_ouverture", "date_solde_cloture"),
    "period": ("periode",),
    "amount": (
        "net_a_payer", "salaire_mensuel", "salaire_base_mensuel", "salaire_brut", "cotisation_cnss_base", "cotisation_cnss_montant", "cotisation_amo_base", "cotisation_amo_montant",
        "salaire_net_imposable", "solde_ouverture", "solde_cloture", "total_credits", "total_debits",
    ),
    "percent": ("cotisation_cnss_taux", "cotisation_amo_taux"),
    "flag": ("cachet_present",),
    "sex": ("sexe",),
    "address": ("adresse",),
    "bank": ("banque",),
    "text": ("ville", "employeur", "poste", "anciennete", "lieu_naissance", "nationalite"),
}


def valid_cin(c: Column) -> Column:
    return c.rlike(r"^[A-Z]{1,2}\d{5,8}$")


def valid_identifier(c: Column) -> Column:
    return c.rlike("^[A-Z0-9]+$")


def valid_rib(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def valid_name(c: Column) -> Column:
    return (F.length(F.trim(c)) >= 2) & ~c.rlike(r"\d")


def valid_text(c: Column, least: int = 2) -> Column:
    return F.length(F.trim(c)) >= least


def valid_date(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.try_to_date(c, "yyyy-M-d").isNotNull()


def valid_period(c: Column) -> Column:
    return c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")


def valid_number(c: Column) -> Column:
    return c.try_cast("double").isNotNull()


def valid_flag(c: Column) -> Column:
    return F.lower(c).isin("true", "false")


def valid_sex(c: Column) -> Column:
    return c.isin("M", "F")


def valid_transactions(c: Column) -> Column:
    """A list of transactions (date, libelle, montant, sens) is valid if it isn't empty and every element has an amount and a direction."""
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda t: t.isNotNull() & t["montant"].isNotNull() & F.coalesce(t["sens"].isin("D", "C"), F.lit(False))), F.lit(False))


_VALIDATORS = {
    "cin": valid_cin, "rib": valid_rib, "identifier": valid_identifier, "name": valid_name, "date": valid_date, "period": valid_period, "amount": valid_number, "percent": valid_number,
    "flag": valid_flag, "sex": valid_sex, "address": valid_text, "bank": valid_text, "text": valid_text,
}
_NORMALISERS = {
    "cin": T.identifier, "rib": T.digits, "identifier": T.identifier, "name": T.person_name, "address": T.address, "date": lambda c: F.date_format(V.iso_date(c), "yyyy-MM-dd"), "period": V.period,
    "amount": lambda c: V.amount(c).cast("string"), "percent": lambda c: V.amount(c).cast("string"), "flag": lambda c: V.flag(c).cast("string"), "sex": V.sex, "bank": T.bank, "text": T.free_text,
}


def _by_kind(name: Column, functions: dict, value: Column, otherwise: Column) -> Column:
    return reduce(lambda e, k: e.when(name.isin(*KINDS[k]), functions[k](value)), list(functions)[1:], F.when(name.isin(*KINDS[next(iter(functions))]), functions[next(iter(functions))](value))).otherwise(otherwise)


def valid_value(name: Column, value: Column) -> Column:
    """Is a normalised value, as text, valid for its field? Fields without a kind always are."""
    return F.coalesce(_by_kind(name, _VALIDATORS, value, F.lit(True)), F.lit(False))


def normalised_value(name: Column, raw: Column) -> Column:
    """The raw value in the form of its field's kind, as text; null where it has none."""
    return _by_kind(name, _NORMALISERS, raw, T.free_text(raw))


def normalisation_status(status: Column, raw: Column, normalised: Column) -> Column:
    """ABSENT_DU_TEMPLATE, MISSING without a raw value, NORMALIZED, or NORMALIZATION_FAILED."""
    absent = F.coalesce(status == "ABSENT_DU_TEMPLATE", F.lit(False))
    return F.when(absent, "ABSENT_DU_TEMPLATE").when(raw.isNull(), "MISSING").when(normalised.isNotNull(), "NORMALIZED").otherwise("NORMALIZATION_FAILED")


def is_required(doc_type: Column, name: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [(doc_type == t) & name.isin(*names) for t, names in REQUIRED.items()]), F.lit(False))


def field_status(status: Column, raw: Column, value: Column, valid: Column, confidence: Column, required: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """The validation status of a field, the first that holds: ABSENT_DU_TEMPLATE; without a normalised value INVALID_FORMAT if there is a
    raw one, else MISSING or, if it isn't required, OPTIONAL_MISSING; INVALID_FORMAT; TO_REVIEW; LOW_CONFIDENCE; VALID.

    status is that of the extraction. A null confidence counts as 0, a null validity as invalid.
    """
    was = lambda s: F.coalesce(status == s, F.lit(False))
    empty = F.when(raw.isNotNull(), "INVALID_FORMAT").when(required, "MISSING").otherwise("OPTIONAL_MISSING")
    filled = F.when(~F.coalesce(valid, F.lit(False)), "INVALID_FORMAT").when(was("TO_REVIEW"), "TO_REVIEW").when(F.coalesce(confidence, F.lit(0.0)) < least, "LOW_CONFIDENCE").otherwise("VALID")
    return F.when(was("ABSENT_DU_TEMPLATE"), "ABSENT_DU_TEMPLATE").when(value.isNull(), empty).otherwise(filled)


def document_status(fields: DataFrame, keys: list[str], status: str, required: str, doc_type: str | None = None) -> DataFrame:
    """(keys, n_fields, n_missing, n_invalid, n_low, n_review, n_optional_invalid, document_status): a document is INCOMPLETE with a
    required field missing, INVALID with one of a wrong format, TO_REVIEW with one of low confidence or to review or an optional one of a
    wrong format, else VALID. Of a doc_type without required fields it is NOT_IMPLEMENTED."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    must, s = F.col(required), F.col(status)
    agg = fields.groupBy(*keys, *([doc_type] if doc_type else [])).agg(
        F.count("*").alias("n_fields"),
        count(must & (s == "MISSING")).alias("n_missing"),
        count(must & (s == "INVALID_FORMAT")).alias("n_invalid"),
        count(must & (s == "LOW_CONFIDENCE")).alias("n_low"),
        count(must & (s == "TO_REVIEW")).alias("n_review"),
        count(~must & (s == "INVALID_FORMAT")).alias("n_optional_invalid"),
    )
    ladder = F.when(F.col("n_missing") > 0, "INCOMPLETE").when(F.col("n_invalid") > 0, "INVALID").when(F.col("n_low") + F.col("n_review") + F.col("n_optional_invalid") > 0, "TO_REVIEW").otherwise("VALID")
    if doc_type:
        ladder = F.when(F.coalesce(F.col(doc_type).isin(*REQUIRED), F.lit(False)), ladder).otherwise("NOT_IMPLEMENTED")
    return agg.withColumn("document_status", ladder)


def normalisation_roll_up(fields: DataFrame, keys: list[str], name: str, status: str) -> DataFrame:
    """(keys, status, n_normalised, missing, absent, failed): TO_REVIEW with a field that couldn't be normalised, else OK; the names of the
    fields by status, in order, each once."""
    named = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col(status) == s, F.col(name)))), "|")  # bounded by the field names
    failed = F.count_if(F.col(status) == "NORMALIZATION_FAILED")
    return fields.groupBy(*keys).agg(
        F.when(failed > 0, "TO_REVIEW").otherwise("OK").alias("status"),
        F.count_if(F.col(status) == "NORMALIZED").alias("n_normalised"),
        named("MISSING").alias("missing"),
        named("ABSENT_DU_TEMPLATE").alias("absent"),
        named("NORMALIZATION_FAILED").alias("failed"),
    )


def extraction_roll_up(fields: DataFrame, keys: list[str], name: str, raw: str, status: str, required: str) -> DataFrame:
    """(keys, status, missing, to_review): INCOMPLETE with a required field without a raw value that the template has, TO_REVIEW with a
    required one to review, else OK."""
    must = F.col(required)
    absent = F.coalesce(F.col(status) == "ABSENT_DU_TEMPLATE", F.lit(False))
    missing, review = must & F.col(raw).isNull() & ~absent, must & F.coalesce(F.col(status) == "TO_REVIEW", F.lit(False))
    named = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col(name)))), "|")
    ladder = F.when(F.count_if(missing) > 0, "INCOMPLETE").when(F.count_if(review) > 0, "TO_REVIEW").otherwise("OK")
    return fields.groupBy(*keys).agg(ladder.alias("status"), named(missing).alias("missing"), named(review).alias("to_review"))


def completeness(docs: DataFrame, file: str, kind: str, expected: dict[str, int] = EXPECTED) -> DataFrame:
    """(file, n_documents, missing, extra, complete): expected and observed numbers of documents by kind.

    missing and extra list the kinds with too few or too many, by name; kinds that aren't expected are extra. One aggregate on the
    file; nothing is joined.
    """
    counts = {k: F.count_if(F.col(kind) == k) for k in sorted(expected)}
    agg = docs.groupBy(file).agg(F.count("*").alias("n_documents"), F.count_if(~F.coalesce(F.col(kind).isin(*expected), F.lit(False))).alias("_other"), *(c.alias(f"_{k}") for k, c in counts.items()))
    named = lambda test: F.concat_ws("|", *(F.when(test(F.col(f"_{k}"), expected[k]), F.lit(k)) for k in sorted(expected)))
    missing = named(lambda c, n: c < n)
    extra = F.concat_ws("|", *(F.when(F.col(f"_{k}") > expected[k], F.lit(k)) for k in sorted(expected)), F.when(F.col("_other") > 0, F.lit("AUTRE")))
    return agg.select(file, "n_documents", missing.alias("missing"), extra.alias("extra"), (missing == "").alias("complete"))


def status_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(step, status, n): how many rows have each status in each of the columns."""
    parts = [df.groupBy(F.coalesce(F.col(c), F.lit("NULL")).alias("status")).agg(F.count("*").alias("n")).select(F.lit(c).alias("step"), "status", "n") for c in columns]
    return reduce(lambda a, b: a.unionByName(b), parts)
