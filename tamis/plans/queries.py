"""Queries of the core: the general problems, and the relational operators on the dossier and star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import orphans as O
from tamis.operators import shred as S
from tamis.plans import dossier, generic, signals
from tamis.session import table


def _shredded(spark, d, *levels):
    return S.shred(table(spark, d, "dossier_brut"), wanted=levels or None)


def p2_found(spark, d):
    key = F.coalesce(F.col("vals")[F.when(F.col("niveau") == "document", "doc_id").when(F.col("niveau") == "field", "field_name").otherwise("libelle")], F.lit(""))
    return _shredded(spark, d).select(F.col("record_id").alias("raw_id"), "niveau", F.col("pos1").alias("doc_pos"), F.col("pos2").alias("field_pos"), F.col("pos3").alias("tx_pos"), key.alias("cle")).distinct()


def _raw(df):
    return df.withColumnRenamed("record_id", "raw_id")


def p2_documents(spark, d, rest=None):
    cols = {c: c for c in ("dossier_id", "doc_id", "doc_type", "template_id")} | {"classification_status": "classification.status"}
    return _raw(S.level_table(_shredded(spark, d, "document"), "document", ["doc_pos"], cols, rest))


def p2_documents_all(spark, d):
    """p2_documents with a map of all other leaves."""
    return p2_documents(spark, d, "others")


def p2_fields(spark, d):
    cols = {c: c for c in ("field_name", "raw_value", "normalized_value", "status", "confidence")} | {"evidence_texts": "evidence.texts"}
    out = _raw(S.level_table(_shredded(spark, d, "field"), "field", ["doc_pos", "field_pos"], cols, "others"))
    return out.withColumn("confidence", F.col("confidence").try_cast("double"))


def p2_transactions(spark, d, rest=None):
    cols = {c: c for c in ("date", "libelle", "montant", "sens")}
    out = _raw(S.level_table(_shredded(spark, d, "transaction"), "transaction", ["doc_pos", "field_pos", "tx_pos"], cols, rest))
    return out.withColumn("montant", F.col("montant").try_cast("double"))


def p2_transactions_all(spark, d):
    """p2_transactions with a map of all other leaves."""
    return p2_transactions(spark, d, "others")


def p6_found(spark, d):
    t = O.dossier_tables(spark, d)
    return O.orphans(O.reference_rows(t), O.target_rows(t))


def p6_report(spark, d):
    return O.orphan_report(p6_found(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_documents, p2_documents_all, p2_fields, p2_transactions, p2_transactions_all, p6_found, p6_report)} | dossier.QUERIES | signals.QUERIES | generic.QUERIES
SQL: dict[str, str] = dossier.SQL | signals.SQL | generic.SQL

_P6 = """
WITH refs AS (
  SELECT 'dossier_document' AS table_nom, doc_id AS ligne_id, 'dossier_id' AS colonne, dossier_id AS cle, min(loaded_at) AS charge FROM dossier_document GROUP BY doc_id, dossier_id
  UNION ALL SELECT 'champ', champ_id, 'doc_id', doc_id, min(loaded_at) FROM champ GROUP BY champ_id, doc_id
  UNION ALL SELECT 'txn', transaction_id, 'doc_id', doc_id, min(loaded_at) FROM txn GROUP BY transaction_id, doc_id
  UNION ALL SELECT 'champ', champ_id, 'nom', nom, min(loaded_at) FROM champ GROUP BY champ_id, nom),
targets AS (
  SELECT 'dossier_document' AS table_nom, 'dossier_id' AS colonne, dossier_id AS cle, min(loaded_at) AS t_charge, bool_or(supprime_at IS NOT NULL) AS supprime FROM dossier GROUP BY dossier_id
  UNION ALL SELECT 'champ', 'nom', nom, min(loaded_at), bool_or(supprime_at IS NOT NULL) FROM ref_champ GROUP BY nom
  UNION ALL SELECT t.n, 'doc_id', doc_id, min(loaded_at), bool_or(supprime_at IS NOT NULL) FROM dossier_document, (VALUES ('champ'), ('txn')) AS t(n) GROUP BY t.n, doc_id),
found AS (
  SELECT DISTINCT r.table_nom, r.ligne_id, r.colonne,
    CASE WHEN t.cle IS NULL THEN 'ABSENT' WHEN t.supprime THEN 'SUPPRIME' WHEN t.t_charge > r.charge THEN 'TARDIF' END AS motif,
    strftime(r.charge, '%Y-%m') AS periode
  FROM refs r LEFT JOIN targets t USING (table_nom, colonne, cle)
  WHERE r.cle IS NOT NULL AND regexp_matches(r.cle, '[^\\s\\p{Z}]') AND r.cle <> 'DOSSIER_UNKNOWN')
"""
SQL["p6_found"] = _P6 + "SELECT * FROM found WHERE motif IS NOT NULL"
SQL["p6_report"] = _P6 + "SELECT table_nom, colonne, motif, periode, count(*) AS nb FROM found WHERE motif IS NOT NULL GROUP BY ALL"

_LIST = "CASE json_type({0}, '$.{1}') WHEN 'ARRAY' THEN json_extract({0}, '$.{1}[*]') WHEN 'OBJECT' THEN [json_extract({0}, '$.{1}')] ELSE CAST([] AS JSON[]) END"
_TX = "CASE WHEN coalesce(json_type(o, '$.normalized_value'), 'NULL') <> 'NULL' THEN " + _LIST.format("o", "normalized_value") + " ELSE " + _LIST.format("o", "raw_value") + " END"
SQL["p2_found"] = (
    "WITH d AS (SELECT raw_id, CAST(payload AS JSON) AS o FROM dossier_brut WHERE json_valid(payload)), "
    "dl AS (SELECT raw_id, " + _LIST.format("o", "documents") + " AS l FROM d WHERE json_type(o) = 'OBJECT'), "
    "docs AS (SELECT * FROM (SELECT raw_id, unnest(l) AS o, generate_subscripts(l, 1) AS dp FROM dl) WHERE json_type(o) = 'OBJECT'), "
    "fl AS (SELECT raw_id, dp, " + _LIST.format("o", "fields") + " AS l FROM docs), "
    "flds AS (SELECT * FROM (SELECT raw_id, dp, unnest(l) AS o, generate_subscripts(l, 1) AS fp FROM fl) WHERE json_type(o) = 'OBJECT'), "
    "tl AS (SELECT raw_id, dp, fp, " + _TX + " AS l FROM flds WHERE json_extract_string(o, '$.field_name') = 'transactions'), "
    "txs AS (SELECT * FROM (SELECT raw_id, dp, fp, unnest(l) AS o, generate_subscripts(l, 1) AS tp FROM tl) WHERE json_type(o) = 'OBJECT') "
    "SELECT DISTINCT raw_id, 'document' AS niveau, CAST(dp AS INT) AS doc_pos, 0 AS field_pos, 0 AS tx_pos, coalesce(json_extract_string(o, '$.doc_id'), '') AS cle FROM docs "
    "UNION SELECT raw_id, 'field', CAST(dp AS INT), CAST(fp AS INT), 0, coalesce(json_extract_string(o, '$.field_name'), '') FROM flds "
    "UNION SELECT raw_id, 'transaction', CAST(dp AS INT), CAST(fp AS INT), CAST(tp AS INT), coalesce(json_extract_string(o, '$.libelle'), '') FROM txs"
)

_CTE = SQL["p2_found"].split("SELECT DISTINCT raw_id")[0]
SQL["p2_documents"] = _CTE + "SELECT raw_id, CAST(dp AS INT) AS doc_pos, json_extract_string(o, '$.dossier_id') AS dossier_id, json_extract_string(o, '$.doc_id') AS doc_id, json_extract_string(o, '$.doc_type') AS doc_type, json_extract_string(o, '$.template_id') AS template_id, json_extract_string(o, '$.classification.status') AS classification_status FROM docs"
SQL["p2_transactions"] = _CTE + "SELECT raw_id, CAST(dp AS INT) AS doc_pos, CAST(fp AS INT) AS field_pos, CAST(tp AS INT) AS tx_pos, json_extract_string(o, '$.date') AS date, json_extract_string(o, '$.libelle') AS libelle, try_cast(json_extract_string(o, '$.montant') AS DOUBLE) AS montant, json_extract_string(o, '$.sens') AS sens FROM txs"
