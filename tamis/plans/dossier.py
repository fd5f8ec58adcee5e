"""Queries of the relational operators on the dossier tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tamis.functions import scores, similarity
from tamis.functions import text as T
from tamis.functions import values as V
from tamis.operators import audit, compare, fields, mutate, network, quality, series
from tamis.session import table

UNKNOWN = "DOSSIER_UNKNOWN"
QUERIES: dict = {}
SQL: dict[str, str] = {}

_ONCE = """WITH ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY champ_id ORDER BY loaded_at DESC) AS rk FROM champ) WHERE rk = 1),
tx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY loaded_at DESC) AS rk FROM txn) WHERE rk = 1),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) AS rk FROM dossier_document) WHERE rk = 1)
"""
#: Accents off, upper case, words of A-Z and 0-9.
_UPPER = "trim(regexp_replace(upper(strip_accents({0})), '[^A-Z0-9]+', ' ', 'g'))"
_IDENT = "nullif(regexp_replace(upper(strip_accents({0})), '[^A-Z0-9]', '', 'g'), '')"


def query(sql: str | None = None, once: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (_ONCE + (", " if sql.lstrip().startswith("WITH ") else "") + sql.lstrip().removeprefix("WITH ")) if once else sql
        return f

    return add


# Rows loaded again have the values of the first load, so the attributes of a row are the same in all of its copies: filters on
# them reach the scan, and only the columns of a query are read.


def champ(spark, d):
    """The fields, loaded again or not, once each."""
    return fields.latest(table(spark, d, "champ").drop("evidence_texts"), ["champ_id"], same=("nom_source", "doc_type", "dossier_id"), ties=())


def txn(spark, d):
    return fields.latest(table(spark, d, "txn"), ["transaction_id"], same=("dossier_id", "est_salaire"), ties=())


def documents(spark, d):
    return fields.latest(table(spark, d, "dossier_document"), ["doc_id"])


def known(df):
    """Only rows of a file: the placeholder isn't one. For results per file, and where a query's SQL has the same filter;
    the queries named ..._all keep every row."""
    return df.filter(F.col("dossier_id") != UNKNOWN)


def every(df):
    return df


def _identifiers(spark, d):
    rows = known(champ(spark, d)).filter(F.col("nom_source").isin("cin_numero", "cin", "rib", "iban"))
    return rows.withColumn("name", fields.canonical(F.col("nom_source"), fields.FIELD_NAMES)).withColumn("value", T.identifier(F.col("valeur"))).filter("value IS NOT NULL")


_IDS = "ids AS (SELECT *, CASE WHEN nom_source IN ('cin_numero', 'cin') THEN 'CIN' ELSE upper(nom_source) END AS name, " + _IDENT.format("valeur") + " AS value FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND nom_source IN ('cin_numero', 'cin', 'rib', 'iban') AND " + _IDENT.format("valeur") + " IS NOT NULL)"

_STATEMENT = {c: c for c in ("solde_ouverture", "solde_cloture", "total_credits", "total_debits", "date_solde_cloture")}


def _statements(spark, d, only=known):
    rows = only(champ(spark, d)).filter(F.col("doc_type") == "RELEVE_BANCAIRE")
    wide = fields.wide(rows, ["dossier_id", "doc_id"], "nom_source", "valeur_normalisee", _STATEMENT).filter(F.col("doc_id").isNotNull())
    return wide.withColumns({c: F.col(c).try_cast("double") for c in list(_STATEMENT)[:4]} | {"period": V.period_index(F.substring("date_solde_cloture", 1, 7))})


_ST = """st AS (SELECT dossier_id, doc_id, """ + ", ".join(f"try_cast(max(CASE WHEN nom_source = '{c}' THEN valeur_normalisee END) AS DOUBLE) AS {c}" for c in list(_STATEMENT)[:4]) + """,
  max(CASE WHEN nom_source = 'date_solde_cloture' THEN valeur_normalisee END) AS date_solde_cloture,
  try_cast(substr(max(CASE WHEN nom_source = 'date_solde_cloture' THEN valeur_normalisee END), 1, 4) AS INT) * 12 + try_cast(substr(max(CASE WHEN nom_source = 'date_solde_cloture' THEN valeur_normalisee END), 6, 2) AS INT) AS period
  FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND doc_type = 'RELEVE_BANCAIRE' AND doc_id IS NOT NULL AND nom_source IN ('solde_ouverture', 'solde_cloture', 'total_credits', 'total_debits', 'date_solde_cloture') GROUP BY dossier_id, doc_id)"""


@query("SELECT champ_id, nom, valeur FROM ch")
def snk7_latest_fields(spark, d):
    return champ(spark, d).select("champ_id", "nom", "valeur")


@query("SELECT champ_id, count(*) AS rows FROM champ GROUP BY champ_id HAVING count(*) > 1 OR champ_id IS NULL", once=False)
def snk8_key_violations(spark, d):
    return audit.key_violations(table(spark, d, "champ"), ["champ_id"])


@query("WITH " + _ST + " SELECT dossier_id, doc_id, solde_ouverture, solde_cloture, total_credits, total_debits, period FROM st")
def prj1_wide_statements(spark, d, only=known):
    return _statements(spark, d, only).select("dossier_id", "doc_id", "solde_ouverture", "solde_cloture", "total_credits", "total_debits", "period")


@query("WITH " + _ST + """, p AS (SELECT dossier_id, solde_ouverture AS o, lag(solde_cloture) OVER (PARTITION BY dossier_id ORDER BY period NULLS FIRST, doc_id) AS b FROM st WHERE solde_ouverture IS NOT NULL AND solde_cloture IS NOT NULL),
a AS (SELECT dossier_id, count(b) AS pairs, count(*) FILTER (abs(b - o) > 1.0) AS breaks FROM p GROUP BY dossier_id)
SELECT s.dossier_id, coalesce(pairs, 0) AS pairs, coalesce(breaks, 0) AS breaks, CASE WHEN pairs > 0 THEN CASE WHEN breaks > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM (SELECT DISTINCT dossier_id FROM st) s LEFT JOIN a USING (dossier_id)""")
def w1_balance_chaining(spark, d):
    return series.adjacent_breaks(_statements(spark, d), "dossier_id", ["period", "doc_id"], "solde_ouverture", "solde_cloture")


_EQ = """eq AS (SELECT dossier_id, CASE WHEN solde_ouverture IS NULL OR solde_cloture IS NULL OR total_credits IS NULL OR total_debits IS NULL THEN 'UNAVAILABLE'
  WHEN abs(solde_ouverture + total_credits - total_debits - solde_cloture) > 1.0 THEN 'TRIGGERED' ELSE 'NORMAL' END AS status FROM st)"""


@query("WITH " + _ST + ", " + _EQ + """ SELECT dossier_id, CASE WHEN bool_or(status = 'UNAVAILABLE') THEN 'UNAVAILABLE' WHEN bool_or(status = 'TRIGGERED') THEN 'TRIGGERED' ELSE 'NORMAL' END AS status,
  CASE WHEN NOT bool_or(status = 'UNAVAILABLE') THEN CASE WHEN bool_or(status = 'TRIGGERED') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM eq GROUP BY dossier_id""")
def a6_balance_equation(spark, d):
    s = _statements(spark, d).withColumn("expected", F.col("solde_ouverture") + F.col("total_credits") - F.col("total_debits"))
    status = F.when(F.col("expected").isNull() | F.col("solde_cloture").isNull(), "UNAVAILABLE").when(F.abs(F.col("expected") - F.col("solde_cloture")) > 1.0, "TRIGGERED").otherwise("NORMAL")
    return compare.roll_up(s.select("dossier_id", status.alias("status")), "dossier_id")


_SUMS = """sm AS (SELECT doc_id, coalesce(round(sum(CASE WHEN sens = 'D' THEN abs(montant) END), 2), 0) AS debits, coalesce(round(sum(CASE WHEN sens = 'C' THEN abs(montant) END), 2), 0) AS credits,
  count(*) FILTER (NOT coalesce(sens IN ('C', 'D') AND montant IS NOT NULL, false)) AS unusable FROM tx GROUP BY doc_id)"""
_TOT = """tot AS (SELECT st.dossier_id, st.doc_id, CASE WHEN total_debits IS NULL OR total_credits IS NULL OR coalesce(unusable, 0) > 0 THEN 'UNAVAILABLE'
  WHEN abs(total_debits - coalesce(debits, 0)) > 1.0 OR abs(total_credits - coalesce(credits, 0)) > 1.0 THEN 'TRIGGERED' ELSE 'NORMAL' END AS status FROM st LEFT JOIN sm USING (doc_id))"""


@query("WITH " + _ST + ", " + _SUMS + ", " + _TOT + " SELECT doc_id, status FROM tot")
def a5_declared_totals(spark, d, only=known):
    sums = compare.signed_totals(txn(spark, d).filter(F.col("doc_id").isNotNull()), "doc_id", "montant", "sens")
    return compare.declared_against(_statements(spark, d, only), sums, "doc_id", {"total_debits": "debits", "total_credits": "credits"})


@query("""WITH b AS (SELECT dossier_id, try_cast(substr(valeur_normalisee, 1, 4) AS INT) * 12 + try_cast(substr(valeur_normalisee, 6, 2) AS INT) AS p FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND doc_type = 'BULLETIN_SALAIRE' AND nom_source = 'periode'),
a AS (SELECT dossier_id, count(*) AS rows, count(DISTINCT p) AS periods, count(*) FILTER (p IS NULL) AS u, max(p) - min(p) AS span FROM b GROUP BY dossier_id)
SELECT dossier_id, rows, periods, CASE WHEN rows <> 3 OR u > 0 THEN 'UNAVAILABLE' WHEN periods = 3 AND span = 2 THEN 'CONSECUTIVE' ELSE 'BROKEN' END AS status FROM a""")
def a1_consecutive_periods(spark, d):
    rows = known(champ(spark, d)).filter((F.col("doc_type") == "BULLETIN_SALAIRE") & (F.col("nom_source") == "periode"))
    return series.consecutive(rows.withColumn("p", V.period_index(F.col("valeur_normalisee"))), "dossier_id", "p")


@query("""WITH l AS (SELECT DISTINCT dossier_id, substr(valeur_normalisee, 1, 7) AS p FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND nom_source = 'periode'),
r AS (SELECT DISTINCT dossier_id, substr(valeur_normalisee, 1, 7) AS p FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND nom_source = 'date_solde_cloture'),
s AS (SELECT dossier_id, p, count(*) AS n FROM (SELECT * FROM l UNION ALL SELECT * FROM r) WHERE p IS NOT NULL GROUP BY dossier_id, p)
SELECT k.dossier_id, coalesce(e.equal, true) AS equal FROM (SELECT dossier_id FROM l UNION SELECT dossier_id FROM r) k LEFT JOIN (SELECT dossier_id, min(n) = 2 AS equal FROM s GROUP BY dossier_id) e USING (dossier_id)""")
def jn3_same_periods(spark, d):
    rows = known(champ(spark, d)).withColumn("p", F.substring("valeur_normalisee", 1, 7))
    return series.same_sets(rows.filter(F.col("nom_source") == "periode"), rows.filter(F.col("nom_source") == "date_solde_cloture"), "dossier_id", "p")


@query("""SELECT doc_id, count(*) AS n_transactions, count(*) FILTER (est_salaire) AS n_salaries, count(*) FILTER (sens = 'C' AND NOT est_salaire) AS n_other_credits,
  CASE WHEN count(*) FILTER (est_salaire) = 1 THEN 'NORMAL' ELSE 'TRIGGERED' END AS status FROM tx WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND doc_id IS NOT NULL GROUP BY doc_id""")
def a2_one_salary_per_statement(spark, d, only=known):
    rows = only(txn(spark, d)).filter(F.col("doc_id").isNotNull())
    pay = F.coalesce(F.col("est_salaire"), F.lit(False))
    agg = rows.groupBy("doc_id").agg(F.count("*").alias("n_transactions"), F.count_if(pay).alias("n_salaries"), F.count_if((F.col("sens") == "C") & ~F.col("est_salaire")).alias("n_other_credits"))
    return agg.withColumn("status", F.when(F.col("n_salaries") == 1, "NORMAL").otherwise("TRIGGERED"))


@query("""WITH l AS (SELECT dossier_id, try_cast(nullif(regexp_extract(doc_id, '(?i)_M([123])(?:_|$)', 1), '') AS INT) AS slot, count(*) AS n, max(try_cast(valeur_normalisee AS DOUBLE)) AS a FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND doc_type = 'BULLETIN_SALAIRE' AND nom_source = 'net_a_payer' GROUP BY 1, 2),
r AS (SELECT dossier_id, try_cast(substr(mois_dossier, 2, 1) AS INT) AS slot, count(*) AS m, max(montant) AS b FROM tx WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND est_salaire GROUP BY 1, 2),
j AS (SELECT dossier_id, slot, CASE WHEN n IS NULL THEN 'LEFT_MISSING' WHEN n > 1 THEN 'LEFT_SEVERAL' WHEN m IS NULL THEN 'RIGHT_MISSING' WHEN m > 1 THEN 'RIGHT_SEVERAL' WHEN a IS NULL THEN 'LEFT_VALUE' WHEN b IS NULL THEN 'RIGHT_VALUE' ELSE 'OK' END AS reason, a, b FROM l FULL JOIN r USING (dossier_id, slot)),
k AS (SELECT dossier_id, slot, reason, CASE WHEN reason = 'OK' THEN a END AS net, CASE WHEN reason = 'OK' THEN b END AS transfer FROM j),
z AS (SELECT *, abs(transfer - net) / greatest(abs(net), 1.0) AS x FROM k)
SELECT dossier_id, slot, net, transfer, reason, CASE WHEN x IS NULL THEN NULL WHEN x <= 0.02 THEN 0.0::DOUBLE WHEN x <= 0.05 THEN 0.25 WHEN x <= 0.10 THEN 0.5 WHEN x <= 0.20 THEN 0.75 ELSE 1.0 END AS score FROM z""")
def jn2_salary_match(spark, d):
    net = known(champ(spark, d)).filter((F.col("doc_type") == "BULLETIN_SALAIRE") & (F.col("nom_source") == "net_a_payer")).select("dossier_id", T.month_slot(F.col("doc_id")).alias("slot"), F.col("valeur_normalisee").try_cast("double").alias("net"))
    pay = known(txn(spark, d)).filter("est_salaire").select("dossier_id", F.substring("mois_dossier", 2, 1).try_cast("int").alias("slot"), F.col("montant").alias("transfer"))
    return compare.amount_scores(compare.unique_match(net, pay, ["dossier_id", "slot"], "net", "transfer"), "transfer", "net")


_PRIORITY = ("CIN", "ATTESTATION_TRAVAIL", "RIB", "RELEVE_BANCAIRE")


def _priority(c):
    """The place of a document type in the order of trust, after all others where it has none."""
    return F.coalesce(F.nullif(F.array_position(F.lit(list(_PRIORITY)), c), F.lit(0)) - 1, F.lit(len(_PRIORITY)))


_MAJ = "maj AS (SELECT dossier_id, name, value, count(*) AS votes, min(struct_pack(p := coalesce(list_position(['CIN', 'ATTESTATION_TRAVAIL', 'RIB', 'RELEVE_BANCAIRE'], doc_type) - 1, 4), d := doc_id)) AS best FROM ids WHERE doc_id IS NOT NULL GROUP BY dossier_id, name, value), ref AS (SELECT dossier_id, name, value, votes FROM (SELECT *, row_number() OVER (PARTITION BY dossier_id, name ORDER BY votes DESC, best.p, best.d, value) AS r FROM maj) WHERE r = 1)"


@query("WITH " + _IDS + ", " + _MAJ + " SELECT dossier_id, name, value, votes FROM ref")
def a11_majority_reference(spark, d):
    return compare.majority_reference(_identifiers(spark, d).filter(F.col("doc_id").isNotNull()), ["dossier_id", "name"], "value", _priority(F.col("doc_type")), "doc_id")


@query("WITH " + _IDS + ", " + _MAJ + """ SELECT i.dossier_id, i.name, min(r.value) AS reference, count(DISTINCT doc_id) AS compared, count(*) FILTER (i.value <> r.value) AS different,
  CASE WHEN count(DISTINCT doc_id) > 1 THEN CASE WHEN count(*) FILTER (i.value <> r.value) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM ids i JOIN ref r USING (dossier_id, name) WHERE i.doc_id IS NOT NULL GROUP BY i.dossier_id, i.name""")
def a10_exact_consistency(spark, d):
    return compare.exact_consistency(_identifiers(spark, d).filter(F.col("doc_id").isNotNull()), ["dossier_id", "name"], "value", _priority(F.col("doc_type")), "doc_id")


@query()
def jn9_medoid_reference(spark, d):
    rows = known(champ(spark, d)).filter(F.col("nom_source").isin("titulaire", "nom_abonne") & F.col("doc_id").isNotNull()).withColumn("value", T.upper_words(F.col("valeur")))
    return compare.medoid_reference(rows, ["dossier_id"], "value", _priority(F.col("doc_type")), "doc_id")


def _name_pairs(spark, d):
    rows = known(champ(spark, d)).filter(F.col("nom_source").isin("titulaire", "nom_abonne")).withColumn("value", T.upper_words(F.col("valeur")))
    return fields.wide(rows, ["dossier_id"], "nom_source", "value", {"a": "titulaire", "b": "nom_abonne"}).filter("a <> '' AND b <> ''")


_WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"


@query("WITH p AS (SELECT dossier_id, max(CASE WHEN nom_source = 'titulaire' THEN " + _UPPER.format("valeur") + " END) AS a, max(CASE WHEN nom_source = 'nom_abonne' THEN " + _UPPER.format("valeur") + " END) AS b FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND nom_source IN ('titulaire', 'nom_abonne') GROUP BY dossier_id), w AS (SELECT dossier_id, " + _WORDS.format("a") + " AS x, " + _WORDS.format("b") + " AS y FROM p WHERE a <> '' AND b <> '') SELECT dossier_id, round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) AS containment, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM w")
def s19_set_similarity(spark, d):
    p = _name_pairs(spark, d)
    return p.select("dossier_id", F.round(similarity.containment(F.col("a"), F.col("b")), 6).alias("containment"), F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query()
def s19_text_similarity(spark, d):
    return similarity.add_text_similarity(_name_pairs(spark, d), "a", "b").withColumn("score", scores.at_least(F.col("similarity")))


@query()
def s20_employer_similarity(spark, d):
    employer = known(champ(spark, d)).filter(F.col("nom_source") == "employeur").groupBy("dossier_id").agg(F.max(T.upper_words(F.col("valeur"))).alias("employer"))
    pay = known(txn(spark, d)).filter("est_salaire").select("dossier_id", "transaction_id", T.upper_words(F.col("libelle")).alias("label"))
    return similarity.add_employer_similarity(pay.join(employer, "dossier_id"), "label", "employer")


def _profile(spark, d):
    return network.profile(_identifiers(spark, d), "dossier_id", "name", "value", "doc_id")


_PROF = _IDS + ", own AS (SELECT DISTINCT dossier_id, value FROM ids WHERE name = '{0}'), who AS (SELECT DISTINCT dossier_id, value AS w FROM ids WHERE name = '{1}')"


@query("WITH " + _PROF.format("RIB", "CIN") + ", g AS (SELECT value, count(DISTINCT w) AS identities FROM own JOIN who USING (dossier_id) GROUP BY value) SELECT value, identities, CASE WHEN identities <= 1 THEN 0.0::DOUBLE WHEN identities <= 2 THEN 0.25 WHEN identities <= 3 THEN 0.5 ELSE 0.6 END AS score FROM g")
def a16_group_scores(spark, d):
    return network.group_scores(_profile(spark, d), "dossier_id", "name", "value", "RIB", "CIN")


@query("WITH " + _PROF.format("CIN", "CIN") + ", h AS (SELECT value, min(dossier_id) AS hub FROM own GROUP BY value HAVING count(*) > 1) SELECT dossier_id, hub, value FROM own JOIN h USING (value) WHERE dossier_id <> hub")
def jn4_identifier_links(spark, d):
    return network.links_between(_profile(spark, d), "dossier_id", "name", "value", "CIN")


def _names_and_identifiers(spark, d):
    names = known(champ(spark, d)).filter(F.col("nom_source").isin("titulaire", "nom_abonne")).withColumn("name", F.lit("NOM")).withColumn("value", T.upper_words(F.col("valeur")))
    both = _identifiers(spark, d).select("dossier_id", "name", "value", "doc_id").unionByName(names.select("dossier_id", "name", "value", "doc_id"))
    return network.profile(both, "dossier_id", "name", "value", "doc_id")


@query()
def jn4_same_cin_names(spark, d):
    return network.linked_names(_names_and_identifiers(spark, d), "dossier_id", "name", "value", "CIN", "NOM")


@query("WITH " + _IDS + ", own AS (SELECT DISTINCT dossier_id, " + _UPPER.format("valeur") + " AS value FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND nom_source IN ('titulaire', 'nom_abonne')), g AS (SELECT o.value, count(DISTINCT i.value) AS identities FROM own o JOIN ids i USING (dossier_id) WHERE i.name = 'CIN' AND o.value <> '' GROUP BY o.value) SELECT value, identities, CASE WHEN identities <= 1 THEN 0.0::DOUBLE WHEN identities <= 2 THEN 0.25 WHEN identities <= 3 THEN 0.5 ELSE 0.6 END AS score FROM g")
def jn6_same_name_cins(spark, d):
    return network.group_scores(_names_and_identifiers(spark, d), "dossier_id", "name", "value", "NOM", "CIN")


@query("WITH p AS (SELECT dossier_id, name, value, count(DISTINCT doc_id) AS documents FROM ids GROUP BY dossier_id, name, value) SELECT * FROM p".replace("WITH p", "WITH " + _IDS + ", p"))
def a17_profiles(spark, d):
    return _profile(spark, d)


@query("SELECT nom_source, count(*) AS occurrences, count(DISTINCT dossier_id) AS files, count(*) FILTER (trim(valeur) <> '') AS non_empty, count(DISTINCT doc_type) AS kinds FROM ch GROUP BY nom_source")
def a27_field_catalog(spark, d):
    return audit.field_catalog(champ(spark, d), "nom_source", "valeur", "dossier_id", "doc_type")


@query("SELECT nom_source, count(DISTINCT dossier_id) AS files, round(count(DISTINCT dossier_id) / (SELECT count(DISTINCT dossier_id) FROM dossier), 4) AS coverage FROM ch WHERE trim(valeur) <> '' AND dossier_id IN (SELECT dossier_id FROM dossier) GROUP BY nom_source")
def a29_coverage(spark, d):
    return audit.coverage(champ(spark, d), "nom_source", "valeur", "dossier_id", table(spark, d, "dossier"))


@query(" UNION ALL ".join(f"SELECT 'dossier_document' AS table_name, '{c}' AS property, count({c}) AS filled FROM dossier_document" for c in ("dossier_id", "doc_id", "doc_ordinal", "doc_type", "template_id", "original_path", "ocr_path", "extraction_status", "normalization_status", "validation_status", "mois_dossier", "loaded_at", "supprime_at")), once=False)
def a28_property_catalog(spark, d):
    return audit.property_catalog(table(spark, d, "dossier_document"), "dossier_document")


_TABLES = ("dossier", "dossier_document", "champ", "txn", "lien_dossier", "documents")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES), once=False)
def a37_table_counts(spark, d):
    return audit.table_counts({t: table(spark, d, t) for t in _TABLES})


@query("WITH " + _IDS + ", g AS (SELECT value, count(DISTINCT dossier_id) AS rows, min(dossier_id) AS first_id FROM ids WHERE name = 'RIB' GROUP BY value HAVING count(DISTINCT dossier_id) > 1) SELECT * FROM g ORDER BY rows DESC, value LIMIT 50")
def a30_duplicate_identifiers(spark, d):
    return audit.duplicate_groups(_identifiers(spark, d).filter(F.col("name") == "RIB"), F.col("value"), "dossier_id", 50)


_NEEDS = {"CHAINING": ("solde_ouverture", "solde_cloture"), "TOTALS": ("total_credits", "total_debits"), "SALARY": ("net_a_payer", "periode"), "IDENTITY": ("cin_numero", "cin")}


@query("WITH f AS (SELECT dossier_id, " + ", ".join(f"bool_or(coalesce(nom_source = '{n}', false)) AS {n}" for n in sorted({x for v in _NEEDS.values() for x in v})) + " FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND trim(valeur) <> '' GROUP BY dossier_id) " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({' AND '.join(v)}) AS ready, count(*) - count(*) FILTER ({' AND '.join(v)}) AS missing FROM f" for k, v in _NEEDS.items()))
def a31_readiness(spark, d):
    return audit.readiness(known(champ(spark, d)).filter(F.trim("valeur") != ""), "dossier_id", "nom_source", _NEEDS)


@query("WITH " + _ST + ", " + _EQ + ", " + _SUMS + ", " + _TOT + """, al AS (SELECT 'EQUATION' AS rule, status FROM eq UNION ALL SELECT 'TOTALS', status FROM tot)
SELECT rule, count(*) FILTER (status = 'NORMAL') AS passed, count(*) FILTER (status = 'TRIGGERED') AS violated, count(*) FILTER (status = 'UNAVAILABLE') AS unavailable,
 CASE WHEN count(*) FILTER (status <> 'UNAVAILABLE') > 0 THEN round(count(*) FILTER (status = 'TRIGGERED') / count(*) FILTER (status <> 'UNAVAILABLE'), 4) END AS violation_rate FROM al GROUP BY rule""")
def a32_outcomes(spark, d):
    s = _statements(spark, d).withColumn("expected", F.col("solde_ouverture") + F.col("total_credits") - F.col("total_debits"))
    status = F.when(F.col("expected").isNull() | F.col("solde_cloture").isNull(), "UNAVAILABLE").when(F.abs(F.col("expected") - F.col("solde_cloture")) > 1.0, "TRIGGERED").otherwise("NORMAL")
    checks = s.select(F.lit("EQUATION").alias("rule"), status.alias("status")).unionByName(a5_declared_totals(spark, d).select(F.lit("TOTALS").alias("rule"), "status"))
    return audit.outcomes(checks, "rule", "status")


_EXPECTED = sorted(quality.EXPECTED.items())


@query("WITH c AS (SELECT dossier_id, count(*) AS n_documents, count(*) FILTER (NOT coalesce(doc_type IN (" + ", ".join(f"'{k}'" for k, _ in _EXPECTED) + "), false)) AS other, " + ", ".join(f"count(*) FILTER (doc_type = '{k}') AS {k}" for k, _ in _EXPECTED) + " FROM dd WHERE dossier_id <> 'DOSSIER_UNKNOWN' GROUP BY dossier_id) SELECT dossier_id, n_documents, concat_ws('|', " + ", ".join(f"CASE WHEN {k} < {n} THEN '{k}' END" for k, n in _EXPECTED) + ") AS missing, concat_ws('|', " + ", ".join(f"CASE WHEN {k} > {n} THEN '{k}' END" for k, n in _EXPECTED) + ", CASE WHEN other > 0 THEN 'AUTRE' END) AS extra, concat_ws('|', " + ", ".join(f"CASE WHEN {k} < {n} THEN '{k}' END" for k, n in _EXPECTED) + ") = '' AS complete FROM c")
def a18_completeness(spark, d):
    return quality.completeness(known(documents(spark, d)), "dossier_id", "doc_type")


def _field_statuses(spark, d):
    n, v = F.col("nom_source"), F.col("valeur_normalisee")
    required = quality.is_required(F.col("doc_type"), n)
    status = quality.field_status(F.col("validation_status"), F.col("valeur"), v, quality.valid_value(n, v), F.col("confidence_ocr"), required)
    return champ(spark, d).select("champ_id", "doc_id", "doc_type", n, status.alias("status"), required.alias("required"))


_MUST = " OR ".join(
    f"(doc_type = '{t}' AND nom_source IN ({', '.join(repr(n) for n in names)}))"
    for t, names in (
        ("CIN", ("cin_numero", "nom", "prenom", "date_naissance", "adresse")), ("QUITTANCE", ("nom_abonne", "adresse", "ville")), ("RIB", ("banque", "titulaire", "rib")),
        ("RELEVE_BANCAIRE", ("banque", "titulaire", "adresse", "rib", "solde_ouverture", "solde_cloture", "total_credits", "total_debits", "transactions")),
        ("BULLETIN_SALAIRE", ("nom_employe", "prenom_employe", "employeur", "poste", "periode", "salaire_brut", "net_a_payer")), ("ATTESTATION_TRAVAIL", ("nom", "cin", "employeur", "poste", "date_embauche")),
    )
)
_FS = f"""fs AS (SELECT champ_id, doc_id, doc_type, nom_source, coalesce({_MUST}, false) AS must, CASE WHEN validation_status = 'ABSENT_DU_TEMPLATE' THEN 'ABSENT_DU_TEMPLATE'
  WHEN valeur_normalisee IS NULL THEN CASE WHEN valeur IS NOT NULL THEN 'INVALID_FORMAT' WHEN coalesce({_MUST}, false) THEN 'MISSING' ELSE 'OPTIONAL_MISSING' END
  WHEN NOT coalesce(CASE WHEN nom_source IN ('cin_numero', 'cin') THEN regexp_matches(valeur_normalisee, '^[A-Z]{{1,2}}\\d{{5,8}}$') WHEN nom_source = 'rib' THEN regexp_matches(valeur_normalisee, '^[0-9]+$') WHEN nom_source = 'iban' THEN regexp_matches(valeur_normalisee, '^[A-Z0-9]+$')
    WHEN nom_source IN ('nom', 'prenom', 'nom_abonne', 'titulaire', 'nom_employe', 'prenom_employe') THEN length(trim(valeur_normalisee)) >= 2 AND NOT regexp_matches(valeur_normalisee, '\\d')
    WHEN nom_source IN ('date_naissance', 'date_embauche', 'date_facture', 'date_solde_ouverture', 'date_solde_cloture') THEN regexp_matches(valeur_normalisee, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') AND try_strptime(valeur_normalisee, '%Y-%m-%d') IS NOT NULL
    WHEN nom_source = 'periode' THEN regexp_matches(valeur_normalisee, '^\\d{{4}}-(0[1-9]|1[0-2])$')
    WHEN nom_source IN ('net_a_payer', 'salaire_mensuel', 'salaire_brut', 'solde_ouverture', 'solde_cloture', 'total_credits', 'total_debits') THEN try_cast(valeur_normalisee AS DOUBLE) IS NOT NULL
    WHEN nom_source = 'cachet_present' THEN lower(valeur_normalisee) IN ('true', 'false') WHEN nom_source = 'sexe' THEN valeur_normalisee IN ('M', 'F')
    WHEN nom_source IN ('adresse', 'ville', 'banque', 'employeur', 'poste', 'anciennete', 'lieu_naissance', 'nationalite') THEN length(trim(valeur_normalisee)) >= 2 ELSE true END, false) THEN 'INVALID_FORMAT'
  WHEN validation_status = 'TO_REVIEW' THEN 'TO_REVIEW' WHEN coalesce(confidence_ocr, 0) < 0.7 THEN 'LOW_CONFIDENCE' ELSE 'VALID' END AS status FROM ch)"""


@query("WITH " + _FS + " SELECT champ_id, status FROM fs")
def s26_field_status(spark, d):
    return _field_statuses(spark, d).select("champ_id", "status")


@query("WITH " + _FS + """, a AS (SELECT doc_id, doc_type, count(*) AS n_fields, count(*) FILTER (must AND status = 'MISSING') AS n_missing, count(*) FILTER (must AND status = 'INVALID_FORMAT') AS n_invalid, count(*) FILTER (must AND status = 'LOW_CONFIDENCE') AS n_low,
  count(*) FILTER (must AND status = 'TO_REVIEW') AS n_review, count(*) FILTER (NOT must AND status = 'INVALID_FORMAT') AS n_optional_invalid FROM fs WHERE doc_id IS NOT NULL GROUP BY doc_id, doc_type)
SELECT *, CASE WHEN doc_type IS NULL OR doc_type NOT IN ('CIN', 'QUITTANCE', 'RIB', 'RELEVE_BANCAIRE', 'BULLETIN_SALAIRE', 'ATTESTATION_TRAVAIL') THEN 'NOT_IMPLEMENTED' WHEN n_missing > 0 THEN 'INCOMPLETE' WHEN n_invalid > 0 THEN 'INVALID' WHEN n_low + n_review + n_optional_invalid > 0 THEN 'TO_REVIEW' ELSE 'VALID' END AS document_status FROM a""")
def a19_document_status(spark, d):
    return quality.document_status(_field_statuses(spark, d).filter(F.col("doc_id").isNotNull()), ["doc_id"], "status", "required", "doc_type")


_NAMED = "coalesce(array_to_string(list_sort(list(DISTINCT nom_source) FILTER ({0})), '|'), '')"


@query("SELECT doc_id, CASE WHEN count(*) FILTER (valeur IS NOT NULL AND valeur_normalisee IS NULL) > 0 THEN 'TO_REVIEW' ELSE 'OK' END AS status, count(*) FILTER (valeur IS NOT NULL AND valeur_normalisee IS NOT NULL) AS n_normalised, " + _NAMED.format("valeur IS NULL") + " AS missing, '' AS absent, " + _NAMED.format("valeur IS NOT NULL AND valeur_normalisee IS NULL") + " AS failed FROM ch WHERE doc_id IS NOT NULL GROUP BY doc_id")
def a20_normalisation(spark, d):
    rows = champ(spark, d).filter(F.col("doc_id").isNotNull())
    status = quality.normalisation_status(F.col("validation_status"), F.col("valeur"), F.col("valeur_normalisee"))
    return quality.normalisation_roll_up(rows.select("doc_id", "nom_source", status.alias("status")), ["doc_id"], "nom_source", "status")


@query(f"WITH x AS (SELECT doc_id, nom_source, coalesce({_MUST}, false) AND valeur IS NULL AND coalesce(validation_status, '') <> 'ABSENT_DU_TEMPLATE' AS m, coalesce(({_MUST}) AND validation_status = 'TO_REVIEW', false) AS r FROM ch WHERE doc_id IS NOT NULL) SELECT doc_id, CASE WHEN bool_or(m) THEN 'INCOMPLETE' WHEN bool_or(r) THEN 'TO_REVIEW' ELSE 'OK' END AS status, " + _NAMED.format("m") + " AS missing, " + _NAMED.format("r") + " AS to_review FROM x GROUP BY doc_id")
def a21_extraction(spark, d):
    rows = champ(spark, d).filter(F.col("doc_id").isNotNull()).withColumn("must", quality.is_required(F.col("doc_type"), F.col("nom_source")))
    return quality.extraction_roll_up(rows, ["doc_id"], "nom_source", "valeur", "validation_status", "must")


@query()
def s24_normalised_values(spark, d):
    """Every different raw value in the form of its field."""
    rows = table(spark, d, "champ").filter(F.col("valeur").isNotNull()).select("nom_source", "valeur").distinct()
    return rows.withColumn("normalised", quality.normalised_value(F.col("nom_source"), F.col("valeur")))


@query("SELECT 'dossier_document' AS table_name, doc_id AS row_id, dossier_id AS reference FROM dd WHERE dossier_id IS NOT NULL AND dossier_id NOT IN (SELECT dossier_id FROM dossier WHERE dossier_id IS NOT NULL) UNION ALL SELECT 'champ', champ_id, doc_id FROM ch WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM dossier_document WHERE doc_id IS NOT NULL)")
def jn12_orphans(spark, d):
    """Documents of no file, the placeholder's among them, and fields of no document: anti-joins on the key."""
    files = table(spark, d, "dossier").select("dossier_id").filter(F.col("dossier_id").isNotNull()).distinct()
    docs = table(spark, d, "dossier_document").select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    a = documents(spark, d).filter(F.col("dossier_id").isNotNull()).join(files, "dossier_id", "left_anti").select(F.lit("dossier_document").alias("table_name"), F.col("doc_id").alias("row_id"), F.col("dossier_id").alias("reference"))
    b = champ(spark, d).filter(F.col("doc_id").isNotNull()).join(docs, "doc_id", "left_anti").select(F.lit("champ").alias("table_name"), F.col("champ_id").alias("row_id"), F.col("doc_id").alias("reference"))
    return a.unionByName(b)


@query("SELECT DISTINCT date_operation, CASE WHEN regexp_matches(regexp_replace(date_operation, '\\s', '', 'g'), '^\\d{2}/\\d{2}$') THEN regexp_replace(date_operation, '\\s', '', 'g') ELSE strftime(try_strptime(date_operation, '%d/%m/%Y'), '%Y-%m-%d') END AS partial FROM txn WHERE date_operation IS NOT NULL", once=False)
def s12_partial_dates(spark, d):
    rows = table(spark, d, "txn").filter(F.col("date_operation").isNotNull()).select("date_operation").distinct()
    return rows.withColumn("partial", V.partial_date(F.col("date_operation")))


_INTRA_CHANGES = {"cin_numero": "valeur || 'X'", "titulaire": "valeur || ' X'", "adresse": "valeur || ' LOT 99'", "employeur": "valeur || ' SARL'", "poste": "'DIRECTEUR'", "date_embauche": "'2020-01-01'"}
_LLM_CHANGES = {"poste": "'PHARMACIEN'", "salaire_mensuel": "'2500'"}


def _mutated_sql(changes):
    names = ", ".join(f"'{n}'" for n in changes)
    case = "CASE nom_source " + " ".join(f"WHEN '{n}' THEN {c}" for n, c in changes.items()) + " END"
    return f"SELECT champ_id, r = 1 AS mutated, CASE WHEN r = 1 THEN {case} ELSE valeur END AS valeur FROM (SELECT *, row_number() OVER (PARTITION BY dossier_id, nom_source ORDER BY champ_id, valeur) AS r FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND nom_source IN ({names}))"


def _mutated(spark, d, changes):
    rows = known(champ(spark, d)).filter(F.col("nom_source").isin(*changes))
    return mutate.mutate_each(rows, "dossier_id", "nom_source", "valeur", "champ_id", {n: F.expr(c) for n, c in changes.items()}).select("champ_id", "mutated", "valeur")


@query(_mutated_sql(_INTRA_CHANGES))
def m2_intra_mutations(spark, d):
    return _mutated(spark, d, _INTRA_CHANGES)


@query(_mutated_sql(_LLM_CHANGES))
def m4_semantic_mutations(spark, d):
    return _mutated(spark, d, _LLM_CHANGES)


_STEPS = ("extraction_status", "normalization_status", "validation_status")


@query(" UNION ALL ".join(f"SELECT '{c}' AS step, coalesce({c}, 'NULL') AS status, count(*) AS n FROM dd GROUP BY 2" for c in _STEPS))
def a22_status_counts(spark, d):
    return quality.status_counts(documents(spark, d), list(_STEPS))


@query("SELECT DISTINCT valeur, " + _UPPER.format("valeur") + " AS upper_words, lower(" + _UPPER.format("valeur") + ") AS lower_words, " + _IDENT.format("valeur") + " AS identifier, nullif(regexp_replace(valeur, '[^0-9]', '', 'g'), '') AS digits FROM champ WHERE nom_source IN ('titulaire', 'employeur', 'rib', 'cin') AND valeur IS NOT NULL", once=False)
def s1_normalise_text(spark, d):
    v = F.col("valeur")
    rows = table(spark, d, "champ").filter(F.col("nom_source").isin("titulaire", "employeur", "rib", "cin") & v.isNotNull()).select("valeur").distinct()
    return rows.select("valeur", T.upper_words(v).alias("upper_words"), T.lower_words(v).alias("lower_words"), T.identifier(v).alias("identifier"), T.digits(v).alias("digits"))


_CLEAN = "nullif(trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g')), '')"


@query("SELECT DISTINCT valeur, " + _CLEAN.format("regexp_replace(upper(strip_accents(valeur)), '[^A-Z'' -]', ' ', 'g')") + " AS person_name, " + _CLEAN.format("regexp_replace(upper(strip_accents(valeur)), '[^A-Z0-9''./, -]', ' ', 'g')") + " AS address FROM champ WHERE nom_source IN ('titulaire', 'adresse') AND valeur IS NOT NULL", once=False)
def s6_normalise_names(spark, d):
    v = F.col("valeur")
    rows = table(spark, d, "champ").filter(F.col("nom_source").isin("titulaire", "adresse") & v.isNotNull()).select("valeur").distinct()
    return rows.select("valeur", T.person_name(v).alias("person_name"), T.address(v).alias("address"))


@query("""WITH v AS (SELECT DISTINCT valeur FROM champ WHERE nom_source IN ('net_a_payer', 'salaire_brut', 'solde_cloture') AND valeur IS NOT NULL),
k AS (SELECT valeur, regexp_replace(valeur, '[^0-9,.+-]', '', 'g') AS k FROM v),
n AS (SELECT *, length(k) - length(replace(k, ',', '')) AS nc, length(k) - length(replace(k, '.', '')) AS nd, CASE WHEN contains(k, ',') THEN length(k) - (length(k) - instr(reverse(k), ',') + 1) END AS ac,
 CASE WHEN instr(reverse(k), ',') < instr(reverse(k), '.') THEN replace(replace(k, '.', ''), ',', '.') ELSE replace(k, ',', '') END AS lastdec,
 CASE WHEN contains(k, '.') THEN replace(left(k, length(k) - instr(reverse(k), '.')), '.', '') || '.' || right(k, instr(reverse(k), '.') - 1) ELSE k END AS dots FROM k)
SELECT valeur,
 round(try_cast(nullif(CASE WHEN nc > 0 AND nd > 0 THEN lastdec WHEN nc > 0 THEN CASE WHEN nc = 1 AND ac = 2 THEN replace(k, ',', '.') ELSE replace(k, ',', '') END WHEN nd > 1 THEN dots ELSE k END, '') AS DOUBLE), 2) AS two_digits,
 round(try_cast(nullif(CASE WHEN nc > 0 AND nd > 0 THEN lastdec WHEN nc > 0 THEN CASE WHEN nc = 1 AND ac BETWEEN 1 AND 2 THEN replace(k, ',', '.') ELSE replace(k, ',', '') END WHEN nd > 1 THEN dots ELSE k END, '') AS DOUBLE), 2) AS short_decimal,
 try_cast(nullif(CASE WHEN nc > 0 AND nd > 0 THEN lastdec ELSE replace(k, ',', '.') END, '') AS DOUBLE) AS comma_decimal FROM n""", once=False)
def s14_amounts(spark, d):
    v = F.col("valeur")
    rows = table(spark, d, "champ").filter(F.col("nom_source").isin("net_a_payer", "salaire_brut", "solde_cloture") & v.isNotNull()).select("valeur").distinct()
    return rows.select("valeur", V.amount(v).alias("two_digits"), V.amount_short_decimal(v).alias("short_decimal"), V.amount_comma_decimal(v).alias("comma_decimal"))


@query("""WITH v AS (SELECT DISTINCT valeur, regexp_replace(valeur, '[\\s_]', '', 'g') AS s FROM champ WHERE nom_source IN ('date_naissance', 'date_embauche', 'date_facture') AND valeur IS NOT NULL),
f AS (SELECT valeur, s, regexp_replace(regexp_extract(s, '(\\d{1,2}[/.\\-]\\d{1,2}[/.\\-]\\d{4})', 1), '[.-]', '/', 'g') AS e FROM v)
SELECT valeur, strftime(coalesce(CASE WHEN regexp_full_match(s, '\\d{1,2}[/.-]\\d{1,2}[/.-]\\d{4}') THEN try_strptime(regexp_replace(s, '[.-]', '/', 'g'), '%d/%m/%Y') END, CASE WHEN regexp_full_match(s, '\\d{4}[/-]\\d{1,2}[/-]\\d{1,2}') THEN try_strptime(replace(s, '/', '-'), '%Y-%m-%d') END, CASE WHEN e <> '' THEN try_strptime(e, '%d/%m/%Y') END), '%Y-%m-%d') AS iso FROM f""", once=False)
def s11_dates(spark, d):
    v = F.col("valeur")
    rows = table(spark, d, "champ").filter(F.col("nom_source").isin("date_naissance", "date_embauche", "date_facture") & v.isNotNull()).select("valeur").distinct()
    return rows.select("valeur", F.date_format(V.iso_date(v), "yyyy-MM-dd").alias("iso"))


@query("""WITH v AS (SELECT DISTINCT valeur, trim(valeur) AS s FROM champ WHERE nom_source = 'periode' AND valeur IS NOT NULL),
p AS (SELECT valeur, coalesce(nullif(regexp_extract(s, '^(\\d{1,2})[/. -](\\d{4})$', 1), ''), nullif(regexp_extract(s, '^(\\d{4})[/. -](\\d{1,2})(?:[/. -]\\d{1,2})?$', 2), ''), nullif(regexp_extract(s, '^\\d{1,2}[/.-](\\d{1,2})[/.-](\\d{4})$', 1), '')) AS m,
 coalesce(nullif(regexp_extract(s, '^(\\d{1,2})[/. -](\\d{4})$', 2), ''), nullif(regexp_extract(s, '^(\\d{4})[/. -](\\d{1,2})(?:[/. -]\\d{1,2})?$', 1), ''), nullif(regexp_extract(s, '^\\d{1,2}[/.-](\\d{1,2})[/.-](\\d{4})$', 2), '')) AS y FROM v)
SELECT valeur, CASE WHEN try_cast(m AS INT) BETWEEN 1 AND 12 THEN y || '-' || lpad(try_cast(m AS INT)::VARCHAR, 2, '0') END AS period, CASE WHEN try_cast(m AS INT) BETWEEN 1 AND 12 THEN y::INT * 12 + m::INT END AS period_index FROM p""", once=False)
def s13_periods(spark, d):
    v = F.col("valeur")
    rows = table(spark, d, "champ").filter((F.col("nom_source") == "periode") & v.isNotNull()).select("valeur").distinct()
    return rows.select("valeur", V.period(v).alias("period"), V.period_index(V.period(v)).alias("period_index"))


@query("SELECT DISTINCT libelle, regexp_matches(" + _UPPER.format("libelle") + ", '\\b(SALAIRE|PAIE|PAYE)\\b') AS salary, nullif(trim(regexp_extract(" + _UPPER.format("libelle") + ", '\\b(?:SALAIRE|PAIE|PAYE)\\b(.*)$', 1)), '') AS payer FROM txn WHERE libelle IS NOT NULL", once=False)
def s30_salary_labels(spark, d):
    v = F.col("libelle")
    return table(spark, d, "txn").filter(v.isNotNull()).select("libelle").distinct().select("libelle", T.salary_label(v).alias("salary"), T.label_tail(v).alias("payer"))


@query("SELECT doc_id, CASE replace(" + _UPPER.format("doc_type") + ", ' ', '_') WHEN 'BULLETIN_DE_SALAIRE' THEN 'BULLETIN_SALAIRE' WHEN 'ATTESTATION_DE_TRAVAIL' THEN 'ATTESTATION_TRAVAIL' ELSE replace(" + _UPPER.format("doc_type") + ", ' ', '_') END AS doc_type, try_cast(nullif(regexp_extract(doc_id, '(?i)_M([123])(?:_|$)', 1), '') AS INT) AS slot FROM dd")
def prj3_document_kinds(spark, d):
    return documents(spark, d).select("doc_id", fields.document_type(F.col("doc_type")).alias("doc_type"), T.month_slot(F.col("doc_id")).alias("slot"))


@query("WITH p AS (SELECT dossier_id, doc_id, max(CASE WHEN nom_source = 'nom' THEN valeur END) AS a, max(CASE WHEN nom_source = 'prenom' THEN valeur END) AS b, min(confidence_ocr) AS confidence FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND nom_source IN ('nom', 'prenom') GROUP BY dossier_id, doc_id) SELECT dossier_id, doc_id, " + _CLEAN.format("concat_ws(' ', a, b)") + " AS full_name, confidence FROM p WHERE trim(a) <> '' AND trim(b) <> ''")
def prj8_full_names(spark, d, only=known):
    return fields.combined_name(only(champ(spark, d)), ["dossier_id", "doc_id"], "nom_source", "valeur", "confidence_ocr", ("nom", "prenom"))


@query("""SELECT dossier_id, arg_min(valeur, champ_id) FILTER (nom_source IN ('titulaire', 'nom_abonne') AND trim(valeur) <> '') AS holder, arg_min(valeur, champ_id) FILTER (nom_source IN ('cin_numero', 'cin') AND trim(valeur) <> '') AS cin FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' GROUP BY dossier_id""")
def prj15_alias_fields(spark, d):
    return fields.first_of_alias(known(champ(spark, d)), ["dossier_id"], "nom_source", "valeur", "champ_id", {"holder": ("titulaire", "nom_abonne"), "cin": ("cin_numero", "cin")})


@query("WITH v AS (SELECT dossier_id, doc_id, nom_source, max(valeur_normalisee) AS v FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND nom_source IN ('titulaire', 'rib', 'employeur', 'poste', 'net_a_payer', 'periode') AND valeur_normalisee IS NOT NULL GROUP BY 1, 2, 3) SELECT dossier_id, doc_id, '{' || string_agg(to_json(nom_source)::VARCHAR || ':' || to_json(v)::VARCHAR, ',' ORDER BY nom_source) || '}' AS view FROM v GROUP BY dossier_id, doc_id")
def prj12_document_views(spark, d, only=known):
    return fields.view_of(only(champ(spark, d)), ["dossier_id", "doc_id"], "nom_source", "valeur_normalisee", ("titulaire", "rib", "employeur", "poste", "net_a_payer", "periode"))


@query("SELECT doc_id, property, value FROM (SELECT doc_id, doc_type, template_id, mois_dossier FROM dd) UNPIVOT INCLUDE NULLS (value FOR property IN (doc_type, template_id, mois_dossier))")
def a28_unpivoted(spark, d):
    return fields.unpivoted(documents(spark, d), ["doc_id"], ["doc_type", "template_id", "mois_dossier"])


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY dossier_id, nom_source = 'net_a_payer' ORDER BY champ_id, valeur) AS r FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND nom_source IN ('net_a_payer', 'periode'))
SELECT champ_id, CASE WHEN nom_source = 'net_a_payer' AND r = 1 THEN '500.00' ELSE valeur END AS valeur, nom_source = 'net_a_payer' AND r = 1 AS mutated FROM m""")
def m1_mutated_fields(spark, d):
    rows = known(champ(spark, d)).filter(F.col("nom_source").isin("net_a_payer", "periode"))
    return mutate.mutate_first(rows, "dossier_id", "nom_source", "valeur", "champ_id", ("net_a_payer",), F.lit("500.00")).select("champ_id", "valeur", "mutated")


@query("""WITH pr AS (SELECT dossier_id AS target, donor FROM (SELECT dossier_id, lag(dossier_id) OVER (ORDER BY dossier_id) AS donor FROM (SELECT DISTINCT dossier_id FROM dossier WHERE dossier_id IS NOT NULL)) WHERE donor IS NOT NULL AND substr(dossier_id, length(dossier_id)) = '0'),
g AS (SELECT dossier_id AS donor, max(valeur) AS given FROM ch WHERE nom_source = 'rib' AND dossier_id <> 'DOSSIER_UNKNOWN' GROUP BY dossier_id)
SELECT champ_id, coalesce(given, valeur) AS valeur FROM ch LEFT JOIN pr ON ch.dossier_id = pr.target LEFT JOIN g USING (donor) WHERE nom_source = 'rib' AND dossier_id <> 'DOSSIER_UNKNOWN'""")
def m3_borrowed_fields(spark, d, only=known):
    pairs = mutate.predecessors(table(spark, d, "dossier"), "dossier_id").filter(F.substring("target", -1, 1) == "0")
    rows = only(champ(spark, d)).filter(F.col("nom_source") == "rib")
    return mutate.borrow_from_donor(rows, pairs, "dossier_id", "nom_source", "valeur", ("rib",)).select("champ_id", "valeur")


@query("""SELECT dossier_id, arg_max(coalesce(validation_status, ''), coalesce(loaded_at, '1900-01-01'::TIMESTAMP)) AS validation_status FROM (SELECT dossier_id, validation_status, loaded_at FROM dossier WHERE validation_status IS NOT NULL) GROUP BY dossier_id""", once=False)
def snk7_upsert(spark, d):
    rows = table(spark, d, "dossier").select("dossier_id", "validation_status", "loaded_at").filter(F.col("validation_status").isNotNull())
    old = rows.filter(F.col("loaded_at") < F.lit("2025-06-01").cast("timestamp_ntz"))
    new = rows.filter(F.col("loaded_at") >= F.lit("2025-06-01").cast("timestamp_ntz"))
    return audit.upsert(old, new, ["dossier_id"], "loaded_at").select("dossier_id", "validation_status")


@query("SELECT DISTINCT d.dossier_id, coalesce(p.n, 0) AS identifiers FROM dossier d LEFT JOIN (SELECT dossier_id, count(DISTINCT name || ':' || value) AS n FROM ids GROUP BY dossier_id) p USING (dossier_id) WHERE d.dossier_id IS NOT NULL".replace("SELECT DISTINCT", "WITH " + _IDS + " SELECT DISTINCT", 1))
def src10_profile_spine(spark, d):
    """Every file, also one without any identifier."""
    counts = _identifiers(spark, d).groupBy("dossier_id").agg(F.countDistinct(F.concat_ws(":", "name", "value")).alias("identifiers"))
    spine = table(spark, d, "dossier").filter(F.col("dossier_id").isNotNull()).select("dossier_id").distinct()
    return spine.join(counts, "dossier_id", "left").select("dossier_id", F.coalesce("identifiers", F.lit(0)).alias("identifiers"))


@query("WITH p AS (SELECT dossier_id, doc_id, try_cast(max(CASE WHEN nom_source = 'net_a_payer' THEN valeur_normalisee END) AS DOUBLE) AS net, max(CASE WHEN nom_source = 'periode' THEN valeur_normalisee END) AS periode FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND doc_type = 'BULLETIN_SALAIRE' AND doc_id IS NOT NULL GROUP BY 1, 2) SELECT * FROM p WHERE net IS NOT NULL AND periode IS NOT NULL")
def src8_payslips(spark, d, only=known):
    rows = only(champ(spark, d)).filter((F.col("doc_type") == "BULLETIN_SALAIRE") & F.col("doc_id").isNotNull())
    both = fields.wide(rows, ["dossier_id", "doc_id"], "nom_source", "valeur_normalisee", {"net": "net_a_payer", "periode": "periode"})
    return both.withColumn("net", F.col("net").try_cast("double")).filter("net IS NOT NULL AND periode IS NOT NULL")


@query("WITH p AS (SELECT dossier_id, doc_id, max(CASE WHEN nom_source = 'date_solde_cloture' THEN valeur_normalisee END) AS c, max(CASE WHEN nom_source = 'date_solde_ouverture' THEN valeur_normalisee END) AS o FROM ch WHERE dossier_id <> 'DOSSIER_UNKNOWN' AND doc_type = 'RELEVE_BANCAIRE' AND doc_id IS NOT NULL AND nom_source IN ('date_solde_cloture', 'date_solde_ouverture') GROUP BY 1, 2) SELECT dossier_id, doc_id, coalesce(CASE WHEN regexp_matches(c, '^\\d{4}-(0[1-9]|1[0-2])-\\d{2}$') THEN c[1:7] END, CASE WHEN regexp_matches(o, '^\\d{4}-(0[1-9]|1[0-2])-\\d{2}$') THEN o[1:7] END) AS periode FROM p")
def prj5_statement_periods(spark, d, only=known):
    rows = only(champ(spark, d)).filter((F.col("doc_type") == "RELEVE_BANCAIRE") & F.col("doc_id").isNotNull())
    both = fields.wide(rows, ["dossier_id", "doc_id"], "nom_source", "valeur_normalisee", {"c": "date_solde_cloture", "o": "date_solde_ouverture"})
    of = lambda c: F.when(F.col(c).rlike(r"^\d{4}-(0[1-9]|1[0-2])-\d{2}$"), V.period(F.col(c)))
    return both.select("dossier_id", "doc_id", F.coalesce(of("c"), of("o")).alias("periode"))


@query("WITH c AS (SELECT doc_id, CASE upper(trim(nom_source)) WHEN 'CIN_NUMERO' THEN 'CIN' ELSE upper(trim(nom_source)) END AS name, champ_id, valeur FROM ch WHERE doc_id IS NOT NULL AND dossier_id <> 'DOSSIER_UNKNOWN' AND valeur IS NOT NULL) SELECT doc_id, name, arg_min(valeur, champ_id) AS valeur FROM c GROUP BY doc_id, name")
def prj7_canonical_fields(spark, d, only=known):
    rows = only(champ(spark, d)).filter(F.col("doc_id").isNotNull() & F.col("valeur").isNotNull()).select("doc_id", fields.canonical(F.col("nom_source"), fields.FIELD_NAMES).alias("name"), "champ_id", "valeur")
    return rows.groupBy("doc_id", "name").agg(F.min_by("valeur", "champ_id").alias("valeur"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tx_idx, transaction_id)::INT AS place, printf('%s__TX%03d', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tx_idx, transaction_id)) AS made_id, transaction_id FROM tx WHERE doc_id IS NOT NULL AND dossier_id <> 'DOSSIER_UNKNOWN'")
def prj10_transaction_ids(spark, d, only=known):
    from pyspark.sql import Window

    rows = only(txn(spark, d)).filter(F.col("doc_id").isNotNull()).select("doc_id", "tx_idx", "transaction_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("tx_idx", "transaction_id"))
    return rows.select("doc_id", place.alias("place"), "transaction_id").withColumn("made_id", F.format_string("%s__TX%03d", F.col("doc_id"), F.col("place")))


@query("SELECT DISTINCT sens, CASE WHEN " + _UPPER.format("sens") + " IN ('C', 'CR', 'CREDIT') THEN 'C' WHEN " + _UPPER.format("sens") + " IN ('D', 'DB', 'DEBIT') THEN 'D' END AS direction FROM txn WHERE sens IS NOT NULL", once=False)
def s17_directions(spark, d):
    return table(spark, d, "txn").filter(F.col("sens").isNotNull()).select("sens").distinct().select("sens", V.direction(F.col("sens")).alias("direction"))


@query("SELECT DISTINCT nom_source, valeur, CASE WHEN nom_source = 'cachet_present' THEN CASE WHEN " + _UPPER.format("valeur") + " IN ('TRUE', 'OUI', 'YES', '1', 'VRAI', 'PRESENT') THEN 'true' WHEN " + _UPPER.format("valeur") + " IN ('FALSE', 'NON', 'NO', '0', 'FAUX', 'ABSENT') THEN 'false' END ELSE CASE WHEN " + _UPPER.format("valeur") + " IN ('M', 'MASCULIN', 'HOMME', 'MALE') THEN 'M' WHEN " + _UPPER.format("valeur") + " IN ('F', 'FEMININ', 'FEMME', 'FEMALE') THEN 'F' END END AS parsed FROM champ WHERE nom_source IN ('cachet_present', 'sexe') AND valeur IS NOT NULL", once=False)
def s18_flags(spark, d):
    v = F.col("valeur")
    rows = table(spark, d, "champ").filter(F.col("nom_source").isin("cachet_present", "sexe") & v.isNotNull()).select("nom_source", "valeur").distinct()
    return rows.withColumn("parsed", F.when(F.col("nom_source") == "cachet_present", V.flag(v).cast("string")).otherwise(V.sex(v)))


@query("SELECT nom_source, count(*) AS n, round(avg(confidence_ocr), 4) AS mean_confidence, count(*) FILTER (confidence_ocr BETWEEN 0 AND 1) AS usable FROM ch GROUP BY nom_source")
def a26_mean_confidence(spark, d):
    return champ(spark, d).groupBy("nom_source").agg(F.count("*").alias("n"), F.round(F.avg("confidence_ocr"), 4).alias("mean_confidence"), F.count(scores.unit_score(F.col("confidence_ocr"))).alias("usable"))


@query("WITH s AS (SELECT doc_id, doc_type, list(DISTINCT nom_source) AS l FROM ch WHERE doc_id IS NOT NULL AND trim(valeur) <> '' AND doc_type IN ('RIB', 'QUITTANCE') GROUP BY doc_id, doc_type), r AS (SELECT doc_id, doc_type, list_sort(list_filter(CASE doc_type WHEN 'RIB' THEN ['banque', 'rib', 'titulaire'] ELSE ['adresse', 'nom_abonne', 'ville'] END, lambda n: NOT list_contains(l, n))) AS m FROM s) SELECT doc_id, array_to_string(m, '|') AS missing FROM r")
def set3_missing_fields(spark, d):
    need = {"RIB": ["banque", "rib", "titulaire"], "QUITTANCE": ["adresse", "nom_abonne", "ville"]}
    rows = champ(spark, d).filter(F.col("doc_id").isNotNull() & (F.trim("valeur") != "") & F.col("doc_type").isin(*need))
    has = {n: F.bool_or(F.col("nom_source") == n).alias(n) for v in need.values() for n in v}
    agg = rows.groupBy("doc_id", "doc_type").agg(*has.values())
    listed = {t: F.concat_ws("|", *(F.when(~F.coalesce(F.col(n), F.lit(False)), F.lit(n)) for n in v)) for t, v in need.items()}
    return agg.select("doc_id", F.when(F.col("doc_type") == "RIB", listed["RIB"]).otherwise(listed["QUITTANCE"]).alias("missing"))


@query("WITH " + _PROF.format("RIB", "CIN") + ", h AS (SELECT value FROM own GROUP BY value HAVING count(*) > 1) SELECT DISTINCT dossier_id, 'INTER_' || dossier_id || '_RIB' AS signal_id, value AS evidence, 'DOSSIER_LIE' AS role FROM own JOIN h USING (value)")
def snk9_signal_edges(spark, d):
    from tamis.sources.sinks import result_edges

    own = _profile(spark, d).filter(F.col("name") == "RIB").select("dossier_id", "value").distinct()
    shared = own.join(network.shared_values(own, "dossier_id", "value").select("value"), "value")
    results = shared.select("dossier_id", F.array("value").alias("values"), F.lit("RIB").alias("check"))
    edges = result_edges(results, "dossier_id", "check", "values", "DOSSIER_LIE").distinct()
    return edges.select("dossier_id", F.concat(F.lit("INTER_"), "signal_id").alias("signal_id"), "evidence", "role")


@query("SELECT champ_id, json_object('nom', nom_source, 'valeur', valeur)::VARCHAR AS evidence FROM ch WHERE nom_source = 'rib' AND valeur IS NOT NULL")
def s40_evidence_json(spark, d):
    rows = champ(spark, d).filter((F.col("nom_source") == "rib") & F.col("valeur").isNotNull())
    return rows.select("champ_id", F.to_json(F.struct(F.col("nom_source").alias("nom"), "valeur")).alias("evidence"))


@query("SELECT doc_id, CASE WHEN template_id IS NULL OR trim(template_id) = '' OR extraction_status <> 'OK' THEN 'A_VERIFIER' ELSE template_id END AS route FROM dd WHERE extraction_status IS NOT NULL")
def snk4_routes(spark, d):
    from tamis.operators.classify import route

    return documents(spark, d).filter(F.col("extraction_status").isNotNull()).select("doc_id", route(F.col("template_id"), F.col("extraction_status") == "OK").alias("route"))


@query("SELECT DISTINCT dossier_id, (upper(trim(dossier_id)) = 'D_TEST' OR upper(trim(dossier_id)) LIKE '%\\_D\\_TEST' ESCAPE '\\' OR upper(trim(dossier_id)) LIKE 'TEST\\_%' ESCAPE '\\') AS is_test FROM dossier_document WHERE dossier_id IS NOT NULL", once=False)
def prj11_test_ids(spark, d):
    u = F.upper(F.trim("dossier_id"))
    rows = table(spark, d, "dossier_document").filter(F.col("dossier_id").isNotNull()).select("dossier_id").distinct()
    return rows.withColumn("is_test", (u == "D_TEST") | F.endswith(u, F.lit("_D_TEST")) | F.startswith(u, F.lit("TEST_")))


# results per document or row also over the rows of the placeholder, which the keys spread; a result per file has none for it
_KNOWN = "dossier_id <> 'DOSSIER_UNKNOWN'"
for _f in (prj1_wide_statements, a5_declared_totals, a2_one_salary_per_statement, src8_payslips, prj5_statement_periods, prj7_canonical_fields, prj10_transaction_ids, prj8_full_names, prj12_document_views, m3_borrowed_fields):
    QUERIES[f"{_f.__name__}_all"] = partial(_f, only=every)
    SQL[f"{_f.__name__}_all"] = SQL[_f.__name__].replace(_KNOWN, "true")


@query(SQL["m1_mutated_fields"] + " UNION ALL SELECT champ_id, valeur, false FROM ch WHERE nom_source IN ('net_a_payer', 'periode') AND coalesce(dossier_id, 'DOSSIER_UNKNOWN') = 'DOSSIER_UNKNOWN'", once=False)
def m1_mutated_fields_all(spark, d):
    """A row without a file stays as it is."""
    rest = champ(spark, d).filter(F.col("nom_source").isin("net_a_payer", "periode") & (F.coalesce("dossier_id", F.lit(UNKNOWN)) == UNKNOWN))
    return m1_mutated_fields(spark, d).unionByName(rest.select("champ_id", "valeur", F.lit(False).alias("mutated")))
