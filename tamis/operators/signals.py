"""Signals of a file, set at a time: every check is a frame (file, check, score, critical), a null score is an unavailable check, and a
signal is the greatest available score.

Business rules hold a file's statements, payslips and transactions together; the intra signal holds the documents of a file against a
reference document, field by field; the inter signal holds files against each other through the identifiers that they share. Results
per file come from aggregates on the file, so a file of any number of rows costs its rows; comparisons of texts are made between
different values, in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.functions import values as V
from tamis.functions.scores import AMOUNT_LADDER, DATE_LADDER, at_least, at_most, relative_difference
from tamis.functions.similarity import add_employer_similarity, add_text_similarity
from tamis.operators import network
from tamis.operators.compare import medoids
from tamis.session import durable

#: Rules in their order, amounts that may differ, least likeness of an employer and a label.
SCORED_RULES = (
    "THREE_CONSECUTIVE_PERIODS",
    "ONE_SALARY_TRANSFER_PER_MONTH",
    "SALARY_AMOUNT_MATCH",
    "SALARY_LABEL_EMPLOYER",
    "TRANSACTION_TOTALS",
    "BALANCE_EQUATION",
    "BALANCE_CHAINING",
)
DIAGNOSTIC_RULES = ("NON_NEGATIVE_BALANCE",)
TOLERANCE, LEAST_EMPLOYER = 1.0, 0.75


@dataclass(frozen=True)
class FieldRule:
    """How a field's values must agree, and the document types that have it, the most trusted first."""

    kind: str
    critical: bool
    documents: tuple[str, ...]


#: The rules of the fields inside a file.
FIELD_RULES = {
    "CIN": FieldRule("exact", True, ("CIN", "ATTESTATION_TRAVAIL")),
    "RIB": FieldRule("exact", True, ("RIB", "RELEVE_BANCAIRE")),
    "IBAN": FieldRule("exact", True, ("RIB", "RELEVE_BANCAIRE")),
    "BANQUE": FieldRule("exact", True, ("RIB", "RELEVE_BANCAIRE")),
    "NOM_COMPLET": FieldRule("text", True, ("CIN", "ATTESTATION_TRAVAIL", "RIB", "QUITTANCE", "RELEVE_BANCAIRE", "BULLETIN_SALAIRE")),
    "EMPLOYEUR": FieldRule("text", False, ("ATTESTATION_TRAVAIL", "BULLETIN_SALAIRE")),
    "POSTE": FieldRule("text", False, ("ATTESTATION_TRAVAIL", "BULLETIN_SALAIRE")),
    "DATE_EMBAUCHE": FieldRule("date", False, ("ATTESTATION_TRAVAIL", "BULLETIN_SALAIRE")),
    "ADRESSE": FieldRule("address", False, ("CIN", "QUITTANCE", "RELEVE_BANCAIRE", "RIB")),
}
SALARY_CHECKS = ("SALAIRE_M1", "SALAIRE_M2", "SALAIRE_M3")
INTER_CHECKS = ("CIN_MULTIPLE_NAMES", "RIB_MULTIPLE_IDENTITIES", "IBAN_MULTIPLE_IDENTITIES", "NAME_MULTIPLE_CIN")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _check(df: DataFrame, file: str, check: Column | str, score: Column, critical: Column | None = None) -> DataFrame:
    name = F.lit(check) if isinstance(check, str) else check
    return df.select(file, name.alias("check"), score.cast("double").alias("score"), F.coalesce(critical if critical is not None else F.lit(False), F.lit(False)).alias("critical"))


# --- business rules


def with_transactions(statements: DataFrame, txns: DataFrame, doc: str = "doc_id") -> DataFrame:
    """statements with n_salaries, salary, salary_label, debits, credits and unusable of their transactions.

    A salary is a credit that is marked as one or whose label holds the word SALAIRE; its amount and label are null unless there is
    exactly one. unusable counts rows without an amount or a direction. A statement without rows has an empty list: sums of 0.
    txns: (doc, libelle, montant, sens, est_salaire).
    """
    sign = V.direction(F.col("sens"))
    salary = (F.coalesce("est_salaire", F.lit(False)) | F.coalesce(F.contains(T.upper_words(F.col("libelle")), F.lit("SALAIRE")), F.lit(False))) & F.coalesce(sign == "C", F.lit(False))
    rows = txns.filter(F.col(doc).isNotNull()).select(doc, salary.alias("_salary"), sign.alias("_sign"), "montant", "libelle")
    side = lambda s: F.round(F.sum(F.when(F.col("_sign") == s, F.abs("montant"))), 2)
    sums = rows.groupBy(doc).agg(
        F.count_if("_salary").alias("n_salaries"),
        F.max(F.when(F.col("_salary"), F.col("montant"))).alias("_amount"),
        F.max(F.when(F.col("_salary"), F.col("libelle"))).alias("_label"),
        side("D").alias("debits"),
        side("C").alias("credits"),
        F.count_if(F.col("montant").isNull() | F.col("_sign").isNull()).alias("unusable"),
    )
    joined = statements.join(sums, doc, "left")
    one = F.col("n_salaries") == 1
    return joined.select(
        *statements.columns,
        F.coalesce("n_salaries", F.lit(0)).alias("n_salaries"),
        F.when(one, F.col("_amount")).alias("salary"),
        F.when(one, F.col("_label")).alias("salary_label"),
        F.coalesce("debits", F.lit(0.0)).alias("debits"),
        F.coalesce("credits", F.lit(0.0)).alias("credits"),
        F.coalesce("unusable", F.lit(0)).alias("unusable"),
    )


def _strict(df: DataFrame, file: str, rule: str, bad: Column, off: Column) -> DataFrame:
    """A rule over rows of a file: unavailable as soon as one row is, else 1 with a row that is off."""
    agg = df.groupBy(file).agg(F.bool_or(F.coalesce(bad, F.lit(False))).alias("_bad"), F.bool_or(F.coalesce(off, F.lit(False))).alias("_off"))
    return _check(agg, file, rule, F.when(~F.col("_bad"), F.col("_off").cast("double")))


def three_periods(statements: DataFrame, payslips: DataFrame, file: str = "dossier_id") -> DataFrame:
    """Exactly three statements and three payslips of the same three consecutive months; unavailable with other numbers or an unknown period."""
    side = lambda df, n: df.select(file, F.lit(n).alias("_s"), "period")
    of = lambda n, c: F.when(F.col("_s") == n, c)
    p = F.col("period")
    per = lambda n: [
        F.count(of(n, F.lit(1))).alias(f"_n{n}"),
        F.count(of(n, p)).alias(f"_k{n}"),
        F.countDistinct(of(n, p)).alias(f"_d{n}"),
        F.min(of(n, p)).alias(f"_min{n}"),
        F.max(of(n, p)).alias(f"_max{n}"),
    ]
    agg = side(statements, 1).unionByName(side(payslips, 2)).groupBy(file).agg(*per(1), *per(2))
    full = reduce(lambda a, b: a & b, [F.col(f"_{c}{n}") == 3 for c in "nk" for n in (1, 2)])
    good = reduce(lambda a, b: a & b, [(F.col(f"_d{n}") == 3) & (F.col(f"_max{n}") - F.col(f"_min{n}") == 2) for n in (1, 2)]) & (F.col("_min1") == F.col("_min2"))
    return _check(agg, file, "THREE_CONSECUTIVE_PERIODS", F.when(full, (~good).cast("double")))


def one_salary(statements: DataFrame, file: str = "dossier_id") -> DataFrame:
    return _strict(statements, file, "ONE_SALARY_TRANSFER_PER_MONTH", F.lit(False), F.col("n_salaries") != 1)


def salary_amount(statements: DataFrame, payslips: DataFrame, file: str = "dossier_id", tolerance: float = TOLERANCE) -> DataFrame:
    """Net pay against the salary transfer of the same month; of several documents of a month the last counts. No common month: unavailable."""
    last = lambda df, *c: df.filter("period IS NOT NULL").groupBy(file, "period").agg(F.max_by(F.struct(*c), F.col("ordinal")).alias("_v"))
    s = last(statements, "n_salaries", "salary").select(file, "period", "_v.*")
    b = last(payslips, "net").select(file, "period", "_v.net")
    both = s.join(b, [file, "period"])
    return _strict(both, file, "SALARY_AMOUNT_MATCH", F.col("net").isNull() | (F.col("n_salaries") != 1) | F.col("salary").isNull(), F.abs(F.col("net") - F.col("salary")) > tolerance)


def reference_employer(employers: DataFrame, file: str = "dossier_id", employer: str = "employer", order: str = "ordinal") -> DataFrame:
    """(file, employer): the name that most documents have, of equal ones the first seen."""
    words = T.upper_words(F.col(employer))
    counts = employers.withColumn("_e", words).filter("_e <> ''").groupBy(file, "_e").agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(file).agg(F.min_by("_e", F.struct(-F.col("_n"), "_first", "_e")).alias("employer"))


def salary_employer(statements: DataFrame, employers: DataFrame, file: str = "dossier_id", least: float = LEAST_EMPLOYER) -> DataFrame:
    """The label of every statement's only salary must be like the file's employer."""
    rows = statements.select(file, "n_salaries", F.coalesce(T.upper_words(F.col("salary_label")), F.lit("")).alias("_label"))
    rated = add_employer_similarity(rows.join(reference_employer(employers, file), file), "_label", "employer", "_like")
    like = F.when(F.col("_label") == "", 0.0).otherwise(F.col("_like"))
    return _strict(rated, file, "SALARY_LABEL_EMPLOYER", F.col("n_salaries") != 1, like < least)


def transaction_totals(statements: DataFrame, file: str = "dossier_id", tolerance: float = TOLERANCE) -> DataFrame:
    bad = (F.col("unusable") > 0) | F.col("total_debits").isNull() | F.col("total_credits").isNull()
    off = (F.abs(F.col("total_debits") - F.col("debits")) > tolerance) | (F.abs(F.col("total_credits") - F.col("credits")) > tolerance)
    return _strict(statements, file, "TRANSACTION_TOTALS", bad, off)


def balance_equation(statements: DataFrame, file: str = "dossier_id", tolerance: float = TOLERANCE) -> DataFrame:
    gap = F.col("solde_cloture") - (F.col("solde_ouverture") + F.col("total_credits") - F.col("total_debits"))
    return _strict(statements, file, "BALANCE_EQUATION", gap.isNull(), F.abs(gap) > tolerance)


def balance_chaining(statements: DataFrame, file: str = "dossier_id", tolerance: float = TOLERANCE) -> DataFrame:
    """Each statement opens with what the one before closed with; statements without a period or balance are left out, not fatal."""
    from tamis.operators.series import adjacent_breaks

    rows = statements.withColumn("_open", F.when(F.col("period").isNotNull(), F.col("solde_ouverture")))
    return _check(adjacent_breaks(rows, file, ["period", "ordinal"], "_open", "solde_cloture", tolerance), file, "BALANCE_CHAINING", F.col("score"))


def negative_balance(statements: DataFrame, file: str = "dossier_id") -> DataFrame:
    """A balance below 0; for diagnosis, in no score."""
    o, c = F.col("solde_ouverture"), F.col("solde_cloture")
    return _strict(statements, file, "NON_NEGATIVE_BALANCE", o.isNull() | c.isNull(), (o < 0) | (c < 0))


#: Rules by name, each from (statements with transactions, payslips, employers, file).
RULES = {
    "THREE_CONSECUTIVE_PERIODS": lambda s, p, e, f: three_periods(s, p, f),
    "ONE_SALARY_TRANSFER_PER_MONTH": lambda s, p, e, f: one_salary(s, f),
    "SALARY_AMOUNT_MATCH": lambda s, p, e, f: salary_amount(s, p, f),
    "SALARY_LABEL_EMPLOYER": lambda s, p, e, f: salary_employer(s, e, f),
    "TRANSACTION_TOTALS": lambda s, p, e, f: transaction_totals(s, f),
    "BALANCE_EQUATION": lambda s, p, e, f: balance_equation(s, f),
    "BALANCE_CHAINING": lambda s, p, e, f: balance_chaining(s, f),
    "NON_NEGATIVE_BALANCE": lambda s, p, e, f: negative_balance(s, f),
}


def rule_checks(statements: DataFrame, payslips: DataFrame, employers: DataFrame, file: str = "dossier_id", rules: tuple[str, ...] = SCORED_RULES + DIAGNOSTIC_RULES) -> DataFrame:
    """(file, check, score, critical) of the named rules; a file gives no row for a rule whose documents it lacks altogether."""
    return _union([RULES[r](statements, payslips, employers, file) for r in rules])


# --- roll-up


def roll_up(spine: DataFrame, checks: DataFrame, names: tuple[str, ...], file: str = "dossier_id", diagnostic: tuple[str, ...] = ()) -> DataFrame:
    """(file, score, n_checks, n_available, n_anomalies, n_critical, anomalies) of every file of the spine.

    The score is the greatest available one, rounded to 4, null where no check is available; diagnostic checks count nowhere but in
    n_checks. anomalies lists the checks above 0 in the order of names. Each file has each check once at most.
    """
    scored = F.when(~F.col("check").isin(*diagnostic), F.col("score")) if diagnostic else F.col("score")
    found = F.array_sort(F.collect_set(F.when(scored > 0, F.col("check"))))  # bounded by the number of checks
    agg = checks.groupBy(file).agg(
        F.round(F.max(scored), 4).alias("score"),
        F.count(scored).alias("n_available"),
        F.count_if(F.coalesce(scored > 0, F.lit(False))).alias("n_anomalies"),
        F.count_if("critical").alias("n_critical"),
        found.alias("_found"),
    )
    listed = F.array_join(F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains("_found", n)), "|")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = spine.select(file).filter(F.col(file).isNotNull()).distinct().join(agg, file, "left")
    return rows.select(file, "score", F.lit(len(names)).alias("n_checks"), zero("n_available"), zero("n_anomalies"), zero("n_critical"), F.coalesce(listed, F.lit("")).alias("anomalies"))


def intra_status(score: Column) -> Column:
    return F.when(score.isNull(), "UNAVAILABLE").when(score > 0, "ANOMALY_DETECTED").otherwise("NO_ANOMALY_DETECTED")


def inter_status() -> Column:
    return F.when(F.col("n_available") == 0, "UNAVAILABLE").when(F.col("n_critical") > 0, "CRITICAL_NETWORK_ANOMALY").when(F.col("n_anomalies") > 0, "NETWORK_ANOMALY_DETECTED").otherwise("NO_NETWORK_ANOMALY")


# --- inside a file


def _by_field(of) -> Column:
    """An expression that depends on the field: of(name, rule) for each rule."""
    return F.coalesce(*(F.when(F.col("field") == name, of(name, rule)) for name, rule in FIELD_RULES.items()))


def usable_records(records: DataFrame, file: str = "dossier_id") -> DataFrame:
    """(file, field, doc, value, p) of records (file, field, doc, doc_type, value) whose field has a rule that takes the document's type; p
    is the place of the type in the rule's order of trust. Null and empty values and null documents are no records."""
    place = _by_field(lambda _, r: F.nullif(F.array_position(F.lit(list(r.documents)), F.col("doc_type")), F.lit(0)))
    rows = records.filter((F.col("value") != "") & F.col("doc").isNotNull()).withColumn("p", place)
    return rows.filter("p IS NOT NULL").select(file, "field", "doc", "value", "p")


def exact_checks(records: DataFrame, file: str = "dossier_id") -> DataFrame:
    """Checks of the fields that must be equal: every document against the value that most have, by letters and digits only.

    Of values with as many rows, that of the most trusted type counts, then of the first document. Available with two documents.
    """
    names = [n for n, r in FIELD_RULES.items() if r.kind == "exact"]
    rows = usable_records(records.filter(F.col("field").isin(*names)), file).withColumn("id", F.coalesce(T.identifier(F.col("value")), F.lit("")))
    votes = rows.filter("id <> ''").groupBy(file, "field", "id").agg(F.count("*").alias("n"), F.min(F.struct("p", "doc")).alias("b"))
    ref = votes.groupBy(file, "field").agg(F.min_by(F.struct("id", "b.doc"), F.struct(-F.col("n"), "b.p", "b.doc", "id")).alias("r")).select(file, "field", F.col("r.id").alias("ref"), F.col("r.doc").alias("ref_doc"))
    off = F.bool_or((F.col("doc") != F.col("ref_doc")) & (F.col("id") != F.col("ref")))
    agg = rows.join(ref, [file, "field"]).groupBy(file, "field").agg(F.countDistinct("doc").alias("docs"), off.alias("off"))
    score = F.when(F.col("docs") > 1, F.col("off").cast("double"))
    return _check(agg, file, F.col("field"), score, score > 0)


def date_score(reference: Column, other: Column) -> Column:
    """The ladder of the days between two dates; a text that is no date is as far as can be."""
    day = lambda c: F.coalesce(*(F.try_to_date(F.trim(c), f) for f in ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy")))
    return F.coalesce(at_most(F.abs(F.datediff(day(reference), day(other))), DATE_LADDER), F.lit(1.0))


def text_checks(records: DataFrame, file: str = "dossier_id", block: int = 500) -> DataFrame:
    """Checks of the fields that must be alike - texts, addresses, dates: every document against the medoid of the most trusted type."""
    names = [n for n, r in FIELD_RULES.items() if r.kind != "exact"]
    rows = usable_records(records.filter(F.col("field").isin(*names)), file)
    kind = lambda k: F.col("field").isin(*(n for n, r in FIELD_RULES.items() if r.kind == k))
    # texts and addresses are compared by their words, so writings with the same words count as one before any pair is made
    words = F.when(kind("date"), F.col("value")).when(kind("address"), T.address_words(F.col("value"))).otherwise(T.upper_words(F.col("value")))
    units = rows.withColumn("value", words).groupBy(file, "field", "doc", "value").agg(F.min("p").alias("p"), F.count("*").alias("n"))

    def similarity(pairs: DataFrame) -> DataFrame:
        plain = lambda c: F.regexp_replace(F.col(c), "[^A-Z0-9]+", " ")  # of a date too
        rated = add_text_similarity(pairs.withColumns({"_x": plain("a"), "_y": plain("b")}), "_x", "_y", "s", numbers=kind("address"))
        return rated.withColumn("w", F.when(kind("date"), date_score(F.col("a"), F.col("b"))).otherwise(at_least(F.col("s"))))

    found = medoids(units, [file, "field"], similarity, block)
    score = F.when(F.col("docs") > 1, F.coalesce("worst", F.lit(0.0)))
    return _check(found, file, F.col("field"), score, _by_field(lambda _, r: F.lit(r.critical)) & (score > 0))


def salary_checks(payslips: DataFrame, transfers: DataFrame, spine: DataFrame, file: str = "dossier_id") -> DataFrame:
    """(file, check, score, critical, reason) of SALAIRE_M1 to M3: the only payslip of a month's slot against the only salary transfer of
    its slot and period. reason is OK or why the check is unavailable, the first that holds.

    payslips: (file, slot, period, net); transfers: (file, slot, period, amount). Both sides are aggregated before they are joined.
    """
    slots = spine.select(file).filter(F.col(file).isNotNull()).distinct().withColumn("slot", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    pay = payslips.groupBy(file, "slot").agg(F.count("*").alias("_n"), F.max("period").alias("period"), F.max("net").alias("net"))
    moved = transfers.groupBy(file, "slot", "period").agg(F.count("*").alias("_m"), F.max("amount").alias("amount"))
    both = slots.join(pay, [file, "slot"], "left").join(moved, [file, "slot", "period"], "left")
    n, m = F.coalesce("_n", F.lit(0)), F.coalesce("_m", F.lit(0))
    period = F.nullif(F.col("period").cast("string"), F.lit(""))
    reason = F.when(n == 0, "NO_PAYSLIP").when(n > 1, "SEVERAL_PAYSLIPS").when(period.isNull(), "NO_PERIOD").when(F.col("net").isNull(), "NO_NET").when(m == 0, "NO_TRANSFER").when(m > 1, "SEVERAL_TRANSFERS")
    reason = reason.when(F.col("amount").isNull(), "NO_AMOUNT").otherwise("OK")
    score = F.when(F.col("reason") == "OK", at_most(relative_difference(F.col("amount"), F.col("net")), AMOUNT_LADDER))
    named = both.withColumn("reason", reason)
    return named.select(file, F.concat(F.lit("SALAIRE_M"), "slot").alias("check"), score.alias("score"), F.lit(False).alias("critical"), "reason")


def intra_checks(records: DataFrame, payslips: DataFrame, transfers: DataFrame, spine: DataFrame, file: str = "dossier_id") -> DataFrame:
    return _union([exact_checks(records, file), text_checks(records, file), salary_checks(payslips, transfers, spine, file).drop("reason")])


# --- between files


def shared_identity_check(prof: DataFrame, shared: str, check: str, identity: str = "CIN", file: str = "dossier_id", name: str = "name", value: str = "value") -> DataFrame:
    """(file, check, score, critical, linked, unresolved): does a file share a value with a file of an altogether other identity?

    The score is 1 with a file that shares a value of `shared` and has none of the file's values of `identity`, else 0; null without
    the one or the other in the file itself. linked counts such files, unresolved those without an identity, by value shared.

    Files with the same identities count as one before anything is paired. A file's others are all of a value less those that
    have one of its identities, so the value is held against counts: different identities are never paired with each other.
    """
    prof = durable(prof.filter(F.col(name).isin(shared, identity)).select(file, name, value).distinct())
    own = prof.filter(F.col(name) == shared).select(file, value)
    ids = prof.filter(F.col(name) == identity).select(file, F.col(value).alias("_c"))
    print_of = ["_h", "_g", "_n"]
    sets = ids.groupBy(file).agg(F.bit_xor(F.xxhash64("_c")).alias("_h"), F.bit_xor(F.xxhash64(F.lit(1), "_c")).alias("_g"), F.count("*").alias("_n"))
    first = sets.groupBy(*print_of).agg(F.min(file).alias("_set"))
    members = durable(own.join(sets.join(first, print_of).select(file, "_set"), file, "left"))
    groups = members.filter("_set IS NOT NULL").groupBy(value, "_set").agg(F.count("*").alias("_files"))
    totals = members.groupBy(value).agg(F.count("_set").alias("_all"), F.count_if(F.col("_set").isNull()).alias("_none"))
    of_set = first.join(ids.withColumnRenamed(file, "_set"), "_set").select("_set", "_c")
    by_id = groups.select(value, "_set").join(of_set, "_set")
    akin = by_id.join(by_id.select(value, "_c", F.col("_set").alias("_other")), [value, "_c"]).select(value, "_set", "_other").distinct()
    same = akin.join(groups.select(value, F.col("_set").alias("_other"), "_files"), [value, "_other"]).groupBy(value, "_set").agg(F.sum("_files").alias("_same"))
    rated = members.filter("_set IS NOT NULL").join(same, [value, "_set"]).join(totals, value)
    agg = rated.groupBy(file).agg(F.sum(F.col("_all") - F.col("_same")).alias("linked"), F.sum("_none").alias("unresolved"))
    both = own.select(file).distinct().join(sets.select(file, F.lit(True).alias("_known")), file, "left").join(agg, file, "left")
    score = F.when(F.col("_known"), (F.coalesce("linked", F.lit(0)) > 0).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(file, F.lit(check).alias("check"), score.alias("score"), F.coalesce(score > 0, F.lit(False)).alias("critical"), zero("linked"), zero("unresolved"))


def _files_with(prof: DataFrame, names: tuple[str, ...], file: str, name: str) -> DataFrame:
    """Files that have a value of each of the names."""
    return prof.filter(F.col(name).isin(*names)).groupBy(file).agg(F.countDistinct(name).alias("_k")).filter(F.col("_k") == len(names)).select(file)


def name_group_check(prof: DataFrame, label: str = "NOM", identity: str = "CIN", file: str = "dossier_id", name: str = "name", value: str = "value") -> DataFrame:
    """How many identities stand behind each of a file's names, over all files that have it: the ladder of the most. Null without both."""
    groups = network.group_scores(prof, file, name, value, label, identity).select(value, "score")
    own = prof.filter(F.col(name) == label).select(file, value).distinct().join(_files_with(prof, (label, identity), file, name), file)
    agg = own.join(groups, value).groupBy(file).agg(F.max("score").alias("score"))
    return _check(agg, file, "NAME_MULTIPLE_CIN", F.col("score"))


def linked_name_check(prof: DataFrame, shared: str = "CIN", label: str = "NOM", file: str = "dossier_id", name: str = "name", value: str = "value") -> DataFrame:
    """How unlike the names of a file are to those of a file with the same identifier: the most unlike file, by the best pair of names."""
    rated = network.linked_names(prof, file, name, value, shared, label).groupBy(file).agg(F.max("score").alias("score"))
    both = _files_with(prof, (shared, label), file, name).join(rated, file, "left")
    score = F.coalesce("score", F.lit(0.0))
    return _check(both, file, "CIN_MULTIPLE_NAMES", score, score >= 1.0)


def inter_checks(prof: DataFrame, file: str = "dossier_id", name: str = "name", value: str = "value") -> DataFrame:
    """The four checks between files, of a profile (file, name, value) with the names CIN, RIB, IBAN and NOM, values normalised."""
    prof = durable(prof.select(file, name, value).distinct())
    bank = lambda n: shared_identity_check(prof, n, f"{n}_MULTIPLE_IDENTITIES", "CIN", file, name, value).select(file, "check", "score", "critical")
    return _union([linked_name_check(prof, "CIN", "NOM", file, name, value), bank("RIB"), bank("IBAN"), name_group_check(prof, "NOM", "CIN", file, name, value)])

