"""Queries pN_ of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.llm.addresses import address_classes, class_pairs
from tamis.llm.encode import encode_corpus
from tamis.llm.entities import COMPANY, PERSON, link_names
from tamis.llm.groups import consolidate
from tamis.llm.leaks import find_leaks, remove_leaks
from tamis.llm.lists import UNMATCHED, entries_within, map_to_list
from tamis.llm.pieces import split_oversized
from tamis.session import durable, table


def _entities(spark, d):
    names = _fields(spark, d, "titulaire", "nom_abonne", "employeur").select(F.when(F.col("nom_source") == "employeur", COMPANY).otherwise(PERSON).alias("famille"), "valeur")
    return link_names(names, _fields(spark, d, "prenom", "prenom_employe"))


def p1_entities(spark, d):
    return _entities(spark, d).select("famille", F.col("value").alias("valeur"), "entity_id")


def p1_found(spark, d):
    pairs = class_pairs(durable(_entities(spark, d)), "entity_id", keep=["famille"])
    return pairs.select("famille", F.col("value_a").alias("valeur_a"), F.col("value_b").alias("valeur_b"))


def p3_found(spark, d):
    pairs = table(spark, d, "lien_dossier")
    return consolidate(pairs, "dossier_id_a", "dossier_id_b").select(F.col("v").alias("dossier_id"), F.col("r").alias("groupe_id"))


def _fields(spark, d, *sources):
    return table(spark, d, "champ").filter(F.col("nom_source").isin(*sources))


def p4_places(spark, d):
    return address_classes(_fields(spark, d, "adresse")).select(F.col("value").alias("adresse"), "place_id")


def p4_found(spark, d):
    classes = durable(address_classes(_fields(spark, d, "adresse")))
    return class_pairs(classes, "place_id").select(F.col("value_a").alias("adresse_a"), F.col("value_b").alias("adresse_b"))


def p5_mapped(spark, d):
    found = map_to_list(_fields(spark, d, "banque", "poste"), table(spark, d, "ref_liste"))
    return found.select(F.col("row_id").alias("champ_id"), F.col("kind").alias("nom_source"), F.col("value").alias("valeur"), F.col("code").alias("ref_code"), F.round("score", 4).alias("score"))


def p5_found(spark, d):
    return p5_mapped(spark, d).select("champ_id", "ref_code").distinct()


def p5_unmatched(spark, d):
    rows = p5_mapped(spark, d).filter(F.col("ref_code") == UNMATCHED).select("champ_id", "nom_source", "valeur").distinct()
    return rows.groupBy("nom_source", "valeur").agg(F.count("*").alias("nb"))


def p5_candidates(spark, d):
    """Every entry that an automaton reaches from a value, by different value."""
    values = _fields(spark, d, "banque", "poste").select(F.col("valeur").alias("champ_id"), "nom_source", "valeur").distinct()
    found = entries_within(values, table(spark, d, "ref_liste"))
    return found.select(F.col("kind").alias("nom_source"), F.col("value").alias("valeur"), F.col("code").alias("ref_code"), F.round("score", 4).alias("score"))


def p7_ids(spark, d):
    return encode_corpus(table(spark, d, "documents"))


def p8_found(spark, d):
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_leaks(spark, d):
    return find_leaks(table(spark, d, "documents"), table(spark, d, "item_eval"))


def p8_clean(spark, d):
    return remove_leaks(table(spark, d, "documents"), table(spark, d, "item_eval"))


def p9_pieces(spark, d):
    return split_oversized(table(spark, d, "documents"))


def p9_found(spark, d):
    return p9_pieces(spark, d).filter(F.col("n_pieces") > 1).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_entities, p3_found, p4_found, p4_places, p5_found, p5_mapped, p5_unmatched, p5_candidates, p7_ids, p8_found, p8_leaks, p8_clean, p9_pieces, p9_found)}
SQL: dict[str, str] = {}

SQL["p3_found"] = """
WITH RECURSIVE e AS (
  SELECT dossier_id_a AS a, dossier_id_b AS b FROM lien_dossier WHERE dossier_id_a <> dossier_id_b
  UNION SELECT dossier_id_b, dossier_id_a FROM lien_dossier WHERE dossier_id_a <> dossier_id_b),
reach(v, r) AS (SELECT a, a FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON reach.v = e.a)
SELECT v AS dossier_id, min(r) AS groupe_id FROM reach GROUP BY v
"""

_RUNS = "SELECT {0}, unnest(CASE WHEN len(w) >= 12 THEN list_transform(range(1, len(w) - 10), lambda i: list_aggregate(w[i:i + 11], 'string_agg', ' ')) ELSE CAST([] AS VARCHAR[]) END) AS run FROM (SELECT {0}, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM {1} WHERE text IS NOT NULL)"
SQL["p8_found"] = "WITH i AS (" + _RUNS.format("item_id", "item_eval") + "), d AS (" + _RUNS.format("doc_id", "documents") + ") SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)"
