"""Queries of the signals of a file - business rules, inside a file, between files - on the dossier tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import scores
from tamis.functions import text as T
from tamis.functions import values as V
from tamis.operators import fields
from tamis.operators import signals as S
from tamis.plans.dossier import _IDENT, _ONCE, _UPPER, champ, known, txn
from tamis.session import durable, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _ONCE + ", " + sql.strip()
        return f

    return add


def _spine(spark, d):
    return table(spark, d, "dossier").select("dossier_id").filter(F.col("dossier_id").isNotNull()).distinct()


# --- business rules

_STATEMENT = ("solde_ouverture", "solde_cloture", "total_credits", "total_debits", "periode", "date_solde_cloture", "date_solde_ouverture")


def _statements(spark, d):
    rows = known(champ(spark, d)).filter((F.col("doc_type") == "RELEVE_BANCAIRE") & F.col("doc_id").isNotNull())
    wide = fields.wide(rows, ["dossier_id", "doc_id"], "nom_source", "valeur_normalisee", {c: c for c in _STATEMENT}, "champ_id")
    period = F.coalesce(*(V.period_number(F.col(c)) for c in _STATEMENT[4:]))
    wide = wide.select("dossier_id", "doc_id", F.col("doc_id").alias("ordinal"), period.alias("period"), *(V.amount_comma_decimal(F.col(c)).alias(c) for c in _STATEMENT[:4]))
    return S.with_transactions(wide, known(txn(spark, d)).select("doc_id", "libelle", "montant", "sens", "est_salaire"))


def _payslips(spark, d):
    rows = known(champ(spark, d)).filter((F.col("doc_type") == "BULLETIN_SALAIRE") & F.col("doc_id").isNotNull())
    wide = fields.wide(rows, ["dossier_id", "doc_id"], "nom_source", "valeur_normalisee", {"net": "net_a_payer", "periode": "periode"}, "champ_id")
    return wide.select("dossier_id", "doc_id", F.col("doc_id").alias("ordinal"), V.period_number(F.col("periode")).alias("period"), V.amount_comma_decimal(F.col("net")).alias("net"))


def _employers(spark, d):
    rows = known(champ(spark, d)).filter((F.col("nom_source") == "employeur") & F.col("doc_type").isin("BULLETIN_SALAIRE", "ATTESTATION_TRAVAIL") & F.col("doc_id").isNotNull())
    return rows.select("dossier_id", F.col("doc_id").alias("ordinal"), F.col("valeur_normalisee").alias("employer"))


def _rules(spark, d, rules=S.SCORED_RULES + S.DIAGNOSTIC_RULES):
    frames = durable(_statements(spark, d)) if len(rules) > 1 else _statements(spark, d)
    checks = S.rule_checks(frames, _payslips(spark, d), _employers(spark, d), rules=rules)
    return checks.select("dossier_id", "check", "score")


def _pick(names):
    return ", ".join(f"arg_max(valeur_normalisee, champ_id) FILTER (nom_source = '{c}') AS {c}" for c in names)


def _index(c):
    return f"try_cast(substr({c}, 1, 4) AS INT) * 12 + try_cast(substr({c}, 6, 2) AS INT)"


_FILES = "dossier_id <> 'DOSSIER_UNKNOWN' AND doc_id IS NOT NULL"
_SIGN = "CASE WHEN " + _UPPER.format("sens") + " IN ('C', 'CR', 'CREDIT', 'CREDITS') THEN 'C' WHEN " + _UPPER.format("sens") + " IN ('D', 'DB', 'DEBIT', 'DEBITS') THEN 'D' END"
_RULES = (
    f"s0 AS (SELECT dossier_id, doc_id, {_pick(_STATEMENT)} FROM ch WHERE {_FILES} AND doc_type = 'RELEVE_BANCAIRE' AND nom_source IN {_STATEMENT} GROUP BY dossier_id, doc_id), "
    "s1 AS (SELECT dossier_id, doc_id, "
    + ", ".join(f"try_cast({c} AS DOUBLE) AS {c}" for c in _STATEMENT[:4])
    + f", coalesce({_index('periode')}, {_index('date_solde_cloture')}, {_index('date_solde_ouverture')}) AS period FROM s0), "
    f"t0 AS (SELECT doc_id, montant, {_SIGN} AS s, coalesce(est_salaire, false) OR coalesce(contains({_UPPER.format('libelle')}, 'SALAIRE'), false) AS pay FROM tx WHERE {_FILES}), "
    "t1 AS (SELECT doc_id, count(*) FILTER (pay AND s = 'C') AS n_sal, max(montant) FILTER (pay AND s = 'C') AS sal, round(sum(abs(montant)) FILTER (s = 'D'), 2) AS dr, "
    "round(sum(abs(montant)) FILTER (s = 'C'), 2) AS cr, count(*) FILTER (montant IS NULL OR s IS NULL) AS bad FROM t0 GROUP BY doc_id), "
    "st AS (SELECT s1.*, coalesce(n_sal, 0) AS n_sal, CASE WHEN n_sal = 1 THEN sal END AS sal, coalesce(dr, 0) AS dr, coalesce(cr, 0) AS cr, coalesce(bad, 0) AS bad FROM s1 LEFT JOIN t1 USING (doc_id)), "
    f"p0 AS (SELECT dossier_id, doc_id, {_pick(('net_a_payer', 'periode'))} FROM ch WHERE {_FILES} AND doc_type = 'BULLETIN_SALAIRE' AND nom_source IN ('net_a_payer', 'periode') GROUP BY dossier_id, doc_id), "
    f"ps AS (SELECT dossier_id, doc_id, try_cast(net_a_payer AS DOUBLE) AS net, {_index('periode')} AS period FROM p0)"
)


def _strict(rule, bad, off, rows="st"):
    return f"{_RULES} SELECT dossier_id, '{rule}' AS \"check\", CASE WHEN bool_or({bad}) THEN NULL WHEN bool_or(coalesce({off}, false)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM {rows} GROUP BY dossier_id"


_SIDE = "count(*) FILTER (k = {0}) AS n{0}, count(period) FILTER (k = {0}) AS f{0}, list_sort(list(DISTINCT period) FILTER (k = {0})) AS l{0}"
_BOTH_SIDES = "SELECT dossier_id, 1 AS k, period FROM st UNION ALL SELECT dossier_id, 2, period FROM ps"


@query(
    f"{_RULES}, u AS (SELECT dossier_id, {_SIDE.format(1)}, {_SIDE.format(2)} FROM ({_BOTH_SIDES}) GROUP BY dossier_id) "
    "SELECT dossier_id, 'THREE_CONSECUTIVE_PERIODS' AS \"check\", CASE WHEN n1 = 3 AND n2 = 3 AND f1 = 3 AND f2 = 3 "
    "THEN CASE WHEN l1 = l2 AND len(l1) = 3 AND l1[2] = l1[1] + 1 AND l1[3] = l1[2] + 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END AS score FROM u"
)
def a1_three_periods(spark, d):
    return _rules(spark, d, ("THREE_CONSECUTIVE_PERIODS",))


@query(_strict("ONE_SALARY_TRANSFER_PER_MONTH", "false", "n_sal <> 1"))
def a2_one_salary_rule(spark, d):
    return _rules(spark, d, ("ONE_SALARY_TRANSFER_PER_MONTH",))


_LAST = "{0} AS (SELECT * FROM {1} WHERE period IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dossier_id, period ORDER BY doc_id DESC) = 1)"


@query(
    _strict("SALARY_AMOUNT_MATCH", "net IS NULL OR n_sal <> 1 OR sal IS NULL", "abs(net - sal) > 1.0", "ls JOIN lp USING (dossier_id, period)").replace(
        " SELECT dossier_id, 'SALARY", f", {_LAST.format('ls', 'st')}, {_LAST.format('lp', 'ps')} SELECT dossier_id, 'SALARY"
    )
)
def a3_salary_amount(spark, d):
    return _rules(spark, d, ("SALARY_AMOUNT_MATCH",))


@query()
def a4_salary_employer(spark, d):
    return _rules(spark, d, ("SALARY_LABEL_EMPLOYER",))


@query(
    f"m AS (SELECT dossier_id, {_UPPER.format('valeur_normalisee')} AS e, count(*) AS n, min(doc_id) AS f FROM ch WHERE {_FILES} AND nom_source = 'employeur' AND doc_type IN ('BULLETIN_SALAIRE', 'ATTESTATION_TRAVAIL') "
    "AND valeur_normalisee IS NOT NULL GROUP BY 1, 2) SELECT dossier_id, e AS employer FROM m WHERE e <> '' QUALIFY row_number() OVER (PARTITION BY dossier_id ORDER BY n DESC, f, e) = 1"
)
def a4_reference_employer(spark, d):
    return S.reference_employer(_employers(spark, d))


@query(_strict("TRANSACTION_TOTALS", "bad > 0 OR total_debits IS NULL OR total_credits IS NULL", "abs(total_debits - dr) > 1.0 OR abs(total_credits - cr) > 1.0"))
def a5_transaction_totals(spark, d):
    return _rules(spark, d, ("TRANSACTION_TOTALS",))


_GAP = "solde_cloture - (solde_ouverture + total_credits - total_debits)"


@query(_strict("BALANCE_EQUATION", f"({_GAP}) IS NULL", f"abs({_GAP}) > 1.0"))
def a6_equation_rule(spark, d):
    return _rules(spark, d, ("BALANCE_EQUATION",))


@query(
    f"{_RULES}, g AS (SELECT dossier_id, solde_ouverture - lag(solde_cloture) OVER (PARTITION BY dossier_id ORDER BY period, doc_id) AS x FROM st WHERE period IS NOT NULL AND solde_ouverture IS NOT NULL AND solde_cloture IS NOT NULL), "
    "a AS (SELECT dossier_id, count(x) AS n, count(*) FILTER (abs(x) > 1.0) AS k FROM g GROUP BY dossier_id) "
    "SELECT dossier_id, 'BALANCE_CHAINING' AS \"check\", CASE WHEN n > 0 THEN CASE WHEN k > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM (SELECT DISTINCT dossier_id FROM st) LEFT JOIN a USING (dossier_id)"
)
def a7_chaining_rule(spark, d):
    return _rules(spark, d, ("BALANCE_CHAINING",))


@query(_strict("NON_NEGATIVE_BALANCE", "solde_ouverture IS NULL OR solde_cloture IS NULL", "solde_ouverture < 0 OR solde_cloture < 0"))
def a8_negative_balance(spark, d):
    return _rules(spark, d, ("NON_NEGATIVE_BALANCE",))


@query()
def a9_business_signal(spark, d):
    checks = _rules(spark, d).withColumn("critical", F.lit(False))
    return S.roll_up(_spine(spark, d), checks, S.SCORED_RULES + S.DIAGNOSTIC_RULES, diagnostic=S.DIAGNOSTIC_RULES)


# --- inside a file

_FIELDS = {
    "cin_numero": "CIN",
    "cin": "CIN",
    "rib": "RIB",
    "iban": "IBAN",
    "banque": "BANQUE",
    "nom_complet_construit": "NOM_COMPLET",
    "employeur": "EMPLOYEUR",
    "poste": "POSTE",
    "date_embauche": "DATE_EMBAUCHE",
    "adresse": "ADRESSE",
}


def _records(spark, d):
    rows = known(champ(spark, d)).filter(F.col("nom_source").isin(*_FIELDS) & F.col("valeur_normalisee").isNotNull())
    return rows.select("dossier_id", fields.canonical(F.col("nom_source"), _FIELDS).alias("field"), F.col("doc_id").alias("doc"), "doc_type", F.col("valeur_normalisee").alias("value"))


def _month_payslips(spark, d):
    rows = known(champ(spark, d)).filter((F.col("doc_type") == "BULLETIN_SALAIRE") & F.col("doc_id").isNotNull() & F.col("nom_source").isin("net_a_payer", "periode"))
    wide = fields.wide(rows, ["dossier_id", "doc_id"], "nom_source", "valeur_normalisee", {"net": "net_a_payer", "period": "periode"})
    return wide.filter("net IS NOT NULL AND period IS NOT NULL").select("dossier_id", T.month_slot(F.col("doc_id")).alias("slot"), "period", F.col("net").try_cast("double").alias("net"))


def _transfers(spark, d):
    rows = known(txn(spark, d)).filter("est_salaire")
    return rows.select("dossier_id", F.substring("mois_dossier", 2, 1).try_cast("int").alias("slot"), F.col("periode").alias("period"), F.col("montant").alias("amount"))


_EXACT = {n: r.documents for n, r in S.FIELD_RULES.items() if r.kind == "exact"}
_CASE = "CASE " + " ".join(f"WHEN nom_source IN {tuple(k for k, v in _FIELDS.items() if v == n) or ('',)}".replace(",)", ")") + f" THEN '{n}'" for n in _EXACT) + " END"
_PLACE = "CASE " + " ".join(f"WHEN field = '{n}' THEN list_position({list(t)}, doc_type)" for n, t in _EXACT.items()) + " END"


@query(
    f"r0 AS (SELECT dossier_id, {_CASE} AS field, doc_id, doc_type, coalesce({_IDENT.format('valeur_normalisee')}, '') AS id FROM ch WHERE {_FILES} AND valeur_normalisee <> ''), "
    f"r AS (SELECT *, {_PLACE} AS p FROM r0 WHERE field IS NOT NULL AND {_PLACE} > 0), "
    "v AS (SELECT dossier_id, field, id, count(*) AS n FROM r WHERE id <> '' GROUP BY 1, 2, 3), "
    "ref AS (SELECT r.dossier_id, r.field, r.id, r.doc_id FROM r JOIN v USING (dossier_id, field, id) QUALIFY row_number() OVER (PARTITION BY r.dossier_id, r.field ORDER BY n DESC, p, r.doc_id, r.id) = 1), "
    "c AS (SELECT r.dossier_id, r.field, count(DISTINCT r.doc_id) AS docs, bool_or(r.doc_id <> ref.doc_id AND r.id <> ref.id) AS off FROM r JOIN ref USING (dossier_id, field) GROUP BY 1, 2) "
    "SELECT dossier_id, field AS \"check\", CASE WHEN docs > 1 THEN CASE WHEN off THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score, docs > 1 AND off AS critical FROM c"
)
def a10_exact_checks(spark, d):
    return S.exact_checks(_records(spark, d))


@query()
def a12_text_checks(spark, d):
    return S.text_checks(_records(spark, d))


@query(
    "sp AS (SELECT DISTINCT dossier_id, slot FROM dossier, (VALUES (1), (2), (3)) AS x(slot) WHERE dossier_id IS NOT NULL), "
    f"b0 AS (SELECT dossier_id, doc_id, max(valeur_normalisee) FILTER (nom_source = 'net_a_payer') AS net, max(valeur_normalisee) FILTER (nom_source = 'periode') AS period FROM ch WHERE {_FILES} AND doc_type = 'BULLETIN_SALAIRE' GROUP BY 1, 2), "
    "b AS (SELECT dossier_id, try_cast(nullif(regexp_extract(doc_id, '(?i)_M([123])(?:_|$)', 1), '') AS INT) AS slot, count(*) AS n, max(period) AS period, max(try_cast(net AS DOUBLE)) AS net FROM b0 WHERE net IS NOT NULL AND period IS NOT NULL GROUP BY 1, 2), "
    "t AS (SELECT dossier_id, try_cast(substr(mois_dossier, 2, 1) AS INT) AS slot, periode AS period, count(*) AS m, max(montant) AS amount FROM tx WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND est_salaire GROUP BY 1, 2, 3), "
    "j AS (SELECT dossier_id, slot, b.net, t.amount, CASE WHEN coalesce(n, 0) = 0 THEN 'NO_PAYSLIP' WHEN n > 1 THEN 'SEVERAL_PAYSLIPS' WHEN coalesce(b.period, '') = '' THEN 'NO_PERIOD' WHEN b.net IS NULL THEN 'NO_NET' "
    "WHEN coalesce(m, 0) = 0 THEN 'NO_TRANSFER' WHEN m > 1 THEN 'SEVERAL_TRANSFERS' WHEN t.amount IS NULL THEN 'NO_AMOUNT' ELSE 'OK' END AS reason FROM sp LEFT JOIN b USING (dossier_id, slot) LEFT JOIN t USING (dossier_id, slot, period)), "
    "z AS (SELECT *, CASE WHEN reason = 'OK' THEN abs(amount - net) / greatest(abs(net), 1.0) END AS x FROM j) "
    "SELECT dossier_id, 'SALAIRE_M' || slot AS \"check\", reason, CASE WHEN x IS NULL THEN NULL WHEN x <= 0.02 THEN 0.0::DOUBLE WHEN x <= 0.05 THEN 0.25 WHEN x <= 0.10 THEN 0.5 WHEN x <= 0.20 THEN 0.75 ELSE 1.0 END AS score FROM z"
)
def jn2_salary_checks(spark, d):
    return S.salary_checks(_month_payslips(spark, d), _transfers(spark, d), _spine(spark, d)).select("dossier_id", "check", "reason", "score")


@query()
def a14_intra_signal(spark, d):
    spine = _spine(spark, d)
    checks = S.intra_checks(durable(_records(spark, d)), _month_payslips(spark, d), _transfers(spark, d), spine)
    out = S.roll_up(spine, checks, (*S.FIELD_RULES, *S.SALARY_CHECKS))
    return out.withColumn("status", S.intra_status(F.col("score")))


# --- between files


def _profile(spark, d):
    rows = known(champ(spark, d)).filter(F.col("nom_source").isin("cin_numero", "cin", "rib", "iban", "nom_complet_construit") & F.col("valeur_normalisee").isNotNull())
    name = F.when(F.col("nom_source") == "nom_complet_construit", "NOM").otherwise(fields.canonical(F.col("nom_source"), _FIELDS))
    value = F.when(F.col("nom_source") == "nom_complet_construit", T.upper_words(F.col("valeur_normalisee"))).otherwise(T.identifier(F.col("valeur_normalisee")))
    return rows.select("dossier_id", name.alias("name"), value.alias("value")).filter("value <> ''").distinct()


_PV = (
    "pv AS (SELECT DISTINCT dossier_id, CASE nom_source WHEN 'nom_complet_construit' THEN 'NOM' WHEN 'rib' THEN 'RIB' WHEN 'iban' THEN 'IBAN' ELSE 'CIN' END AS name, "
    f"CASE nom_source WHEN 'nom_complet_construit' THEN {_UPPER.format('valeur_normalisee')} ELSE {_IDENT.format('valeur_normalisee')} END AS value FROM ch "
    "WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND nom_source IN ('cin_numero', 'cin', 'rib', 'iban', 'nom_complet_construit') AND valeur_normalisee IS NOT NULL), "
    "cins AS (SELECT dossier_id, list(value) AS l FROM pv WHERE name = 'CIN' AND value <> '' GROUP BY dossier_id)"
)
_SHARED = (
    _PV + ", own AS (SELECT dossier_id, value FROM pv WHERE name = '{0}' AND value <> ''), "
    "lk AS (SELECT o.dossier_id, b.l AS theirs, a.l AS ours FROM own o JOIN own x ON o.value = x.value AND o.dossier_id <> x.dossier_id JOIN cins a ON a.dossier_id = o.dossier_id LEFT JOIN cins b ON b.dossier_id = x.dossier_id), "
    "s AS (SELECT dossier_id, count(*) FILTER (theirs IS NOT NULL AND NOT list_has_any(ours, theirs)) AS linked, count(*) FILTER (theirs IS NULL) AS unresolved FROM lk GROUP BY dossier_id) "
    "SELECT o.dossier_id, '{0}_MULTIPLE_IDENTITIES' AS \"check\", CASE WHEN c.l IS NOT NULL THEN CASE WHEN coalesce(linked, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score, "
    "coalesce(linked, 0) > 0 AS critical, coalesce(linked, 0) AS linked, coalesce(unresolved, 0) AS unresolved FROM (SELECT DISTINCT dossier_id FROM own) o LEFT JOIN cins c USING (dossier_id) LEFT JOIN s USING (dossier_id)"
)


@query(_SHARED.format("RIB"))
def jn5_rib_identities(spark, d):
    return S.shared_identity_check(_profile(spark, d), "RIB", "RIB_MULTIPLE_IDENTITIES")


@query(_SHARED.format("IBAN"))
def jn5_iban_identities(spark, d):
    return S.shared_identity_check(_profile(spark, d), "IBAN", "IBAN_MULTIPLE_IDENTITIES")


@query(
    _PV + ", n AS (SELECT dossier_id, value FROM pv WHERE name = 'NOM' AND value <> '' AND dossier_id IN (SELECT dossier_id FROM cins)), "
    "k AS (SELECT n.dossier_id, n.value, count(DISTINCT c.value) AS k FROM n JOIN n o ON n.value = o.value JOIN pv c ON c.dossier_id = o.dossier_id AND c.name = 'CIN' AND c.value <> '' GROUP BY 1, 2) "
    "SELECT dossier_id, 'NAME_MULTIPLE_CIN' AS \"check\", max(CASE WHEN k <= 1 THEN 0.0::DOUBLE WHEN k = 2 THEN 0.25 WHEN k = 3 THEN 0.5 ELSE 0.6 END) AS score FROM k GROUP BY dossier_id"
)
def a16_name_groups(spark, d):
    return S.name_group_check(_profile(spark, d)).select("dossier_id", "check", "score")


@query()
def jn7_linked_names(spark, d):
    return S.linked_name_check(_profile(spark, d)).select("dossier_id", "check", "score")


@query()
def a15_inter_signal(spark, d):
    out = S.roll_up(_spine(spark, d), S.inter_checks(_profile(spark, d)), S.INTER_CHECKS)
    return out.withColumn("status", S.inter_status())


# --- fusion


@query()
def a23_fused_signals(spark, d):
    """The signals of every file, fused: an absent or unavailable signal counts 0, the band goes by the score before it is rounded."""
    part = lambda df, name: df.select("dossier_id", F.col("score").alias(name))
    rows = part(a9_business_signal(spark, d), "business").join(part(a14_intra_signal(spark, d), "intra"), "dossier_id").join(part(a15_inter_signal(spark, d), "inter"), "dossier_id")
    x = scores.weighted_sum({c: scores.FUSION_WEIGHTS[c] for c in ("business", "intra", "inter")})
    return rows.select("dossier_id", "business", "intra", "inter", F.round(x, 4).alias("score"), scores.band(x, list(scores.FUSION_BANDS), "AUTO").alias("band"))

