import math

import pytest
from pyspark.sql import functions as F

from tamis.functions import values as V
from tamis.operators import audit, calibration, classify, compare, fields, layout, mutate, network, quality, series


def test_neighbours(spark):
    df = spark.createDataFrame([("a", 1, 10.0, 20.0), ("a", 2, 20.5, 30.0), ("a", 3, 45.0, 50.0), ("b", 1, 1.0, 2.0), ("c", 1, None, 2.0), ("c", 2, 5.0, 6.0), ("d", 2, 30.0, 1.0), ("d", 1, 1.0, 31.0)], "k STRING, p INT, o DOUBLE, c DOUBLE")
    got = {r.k: (r.pairs, r.breaks, r.score) for r in series.adjacent_breaks(df, "k", ["p"], "o", "c").collect()}
    assert got == {"a": (2, 1, 1.0), "b": (0, 0, None), "c": (0, 0, None), "d": (1, 0, 0.0)}  # a difference of exactly 1 is none


def test_consecutive_and_same_sets(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 4), ("c", 1), ("c", 1), ("c", 2), ("d", 1), ("d", None), ("d", 3), ("e", 1)], "k STRING, p INT")
    assert {r.k: r.status for r in series.consecutive(df, "k", "p").collect()} == {"a": "CONSECUTIVE", "b": "BROKEN", "c": "BROKEN", "d": "UNAVAILABLE", "e": "UNAVAILABLE"}
    other = spark.createDataFrame([("a", 3), ("a", 2), ("a", 1), ("b", 1), ("f", 9)], "k STRING, p INT")
    got = {r.k: r.equal for r in series.same_sets(df, other, "k", "p").collect()}
    assert got["a"] is True and got["b"] is False and got["f"] is False


def test_clusters_and_gaps(spark):
    df = spark.createDataFrame([("p", i, y) for i, y in enumerate([0.0, 6.0, 12.0, 18.0, 40.0])] + [("q", 9, 1.0), ("q", 10, None)], "k STRING, i INT, y DOUBLE")
    assert [r.cluster for r in series.gap_clusters(df.filter("k = 'p'"), "k", ["y"], "y", 10).orderBy("i").collect()] == [0, 0, 0, 0, 1]
    got = {r.i: r.cluster for r in series.mean_clusters(df, "k", "y", "i").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 9: 0}  # means of 0, 3 and 6: 12 is 9 away, 18 is 12 away
    gap = series.largest_gap(df, "k", "y").collect()
    assert [(r.k, r.gap, r.threshold, r.below, r.above) for r in gap] == [("p", 22.0, 29.0, 4, 1)]
    assert series.mean_clusters(df.limit(0), "k", "y", "i").count() == 0


def test_unique_match(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("y", 2.0), ("v", None)], "k STRING, a DOUBLE")
    b = spark.createDataFrame([("x", 2.0), ("z", 1.0), ("v", 1.0)], "k STRING, b DOUBLE")
    got = {r.k: (r.a, r.b, r.reason) for r in compare.unique_match(a, b, ["k"], "a", "b").collect()}
    assert got == {"x": (1.0, 2.0, "OK"), "y": (None, None, "LEFT_SEVERAL"), "z": (None, None, "LEFT_MISSING"), "v": (None, None, "LEFT_VALUE")}


def test_totals_and_dominance_of_unavailable(spark):
    tx = spark.createDataFrame([("a", -5.0, "D"), ("a", 3.0, "C"), ("b", None, "C"), ("c", 1.0, None)], "k STRING, m DOUBLE, s STRING")
    sums = compare.signed_totals(tx, "k", "m", "s")
    d = spark.createDataFrame([("a", 5.5, 3.0), ("b", 0.0, 0.0), ("c", 0.0, 0.0), ("d", 0.0, 2.0), ("e", None, 0.0)], "k STRING, dd DOUBLE, dc DOUBLE")
    got = {r.k: r.status for r in compare.declared_against(d, sums, "k", {"dd": "debits", "dc": "credits"}).collect()}
    assert got == {"a": "NORMAL", "b": "UNAVAILABLE", "c": "UNAVAILABLE", "d": "TRIGGERED", "e": "UNAVAILABLE"}
    checks = spark.createDataFrame([("f", "TRIGGERED"), ("f", "UNAVAILABLE"), ("g", "TRIGGERED"), ("g", "NORMAL"), ("h", "NORMAL")], "k STRING, status STRING")
    assert {r.k: r.score for r in compare.roll_up(checks, "k").collect()} == {"f": None, "g": 1.0, "h": 0.0}
    s = compare.signal(spark.createDataFrame([("f", "A", None), ("f", "B", 0.25), ("g", "A", None)], "k STRING, c STRING, s DOUBLE"), "k", "c", "s")
    assert {r.k: (r.score, r.n_available, r.triggered) for r in s.collect()} == {"f": (0.25, 1, "B"), "g": (None, 0, "")}


def test_references(spark):
    rows = spark.createDataFrame([("f", "d1", "CIN", "X"), ("f", "d2", "RIB", "Y"), ("f", "d3", "RIB", "Y"), ("g", "d4", "RIB", "B"), ("g", "d5", "CIN", "A"), ("h", "d6", "CIN", "Z"), ("h", "d7", "CIN", None)], "k STRING, d STRING, t STRING, v STRING")
    priority = F.when(F.col("t") == "CIN", 0).otherwise(1)
    assert {r.k: (r.v, r.votes) for r in compare.majority_reference(rows, ["k"], "v", priority, "d").collect()} == {"f": ("Y", 2), "g": ("A", 1), "h": ("Z", 1)}
    assert {r.k: (r.compared, r.different, r.score) for r in compare.exact_consistency(rows, ["k"], "v", priority, "d").collect()} == {"f": (3, 1, 1.0), "g": (2, 1, 1.0), "h": (1, 0, None)}
    names = spark.createDataFrame([("f", "d1", "CIN", "EL ALAMI NADIA"), ("f", "d2", "RIB", "NADIA EL ALAMI"), ("f", "d3", "RIB", "OMAR TAZI"), ("g", "d4", "RIB", "SEUL"), ("h", "d5", "CIN", " ")], "k STRING, d STRING, t STRING, v STRING")
    got = {r.k: (r.reference, r.score) for r in compare.medoid_reference(names, ["k"], "v", priority, "d").collect()}
    assert got == {"f": ("EL ALAMI NADIA", 1.0), "g": ("SEUL", None)}


def test_medoid_among_more_than_twenty_values(spark):
    # 25 values with many rows that aren't alike, and one with a single row that holds a word of each
    words = [chr(97 + i) * 6 for i in range(25)]
    rows = [("f", f"d{i:02}{k}", "CIN", w) for i, w in enumerate(words) for k in range(2)] + [("f", "z", "CIN", " ".join(words)), ("g", "y", "CIN", "SEUL")]
    names = spark.createDataFrame(rows, "k STRING, d STRING, t STRING, v STRING")
    for extra in ({}, {"block": 4}):
        got = {r.k: (r.reference, r.score) for r in compare.medoid_reference(names, ["k"], "v", F.lit(0), "d", **extra).collect()}
        assert got == {"f": (" ".join(words), 0.0), "g": ("SEUL", None)}


def test_shared_identifiers(spark):
    rows = [("D1", "RIB", "r1", "a"), ("D1", "CIN", "c1", "a"), ("D2", "RIB", "r1", "b"), ("D2", "CIN", "c2", "b"), ("D3", "RIB", "r2", "c"), ("D4", "RIB", "r2", "d"), ("D3", "CIN", "c1", "c"), ("D4", "CIN", "c1", "d"), ("D5", "RIB", "r3", "e"), ("D6", "RIB", "r3", "f"), ("D7", "RIB", " ", "g"), ("D8", "RIB", None, "h")]
    prof = network.profile(spark.createDataFrame(rows, "f STRING, n STRING, v STRING, d STRING"), "f", "n", "v", "d")
    assert {r.v: r.score for r in network.group_scores(prof, "f", "n", "v", "RIB", "CIN").collect()} == {"r1": 0.25, "r2": 0.0}
    assert sorted((r.f, r.hub) for r in network.links_between(prof, "f", "n", "v", "RIB").collect()) == [("D2", "D1"), ("D4", "D3"), ("D6", "D5")]


def test_names_of_all_files_with_the_same_identifier(spark):
    from difflib import SequenceMatcher

    files = {"D1": ("c", ["NADIA ALAMI"]), "D2": ("c", ["NADIA ALAMI"]), "D3": ("c", ["OMAR TAZI", "SAMIR BENNIS"]), "D4": ("c", ["SAMIR BENNISS", "NADIA ALAMI"]), "D5": ("c", []), "E1": ("e", ["A B"]), "E2": ("e", []), "F1": ("f", ["A B"]), "G1": ("g", ["HIND X"]), "G2": ("g", ["X HIND"])}
    rows = [r for f, (c, names) in files.items() for r in [(f, "CIN", c, "d"), *((f, "NOM", n, "d") for n in names)]]
    prof = network.profile(spark.createDataFrame(rows, "f STRING, n STRING, v STRING, d STRING"), "f", "n", "v", "d")

    def alike(a, b):
        x, y = set(a.split()), set(b.split())
        return round(max(len(x & y) / min(len(x), len(y)), len(x & y) / len(x | y), SequenceMatcher(None, " ".join(sorted(a.split())), " ".join(sorted(b.split()))).ratio()), 6)

    want = {}
    for f, (c, names) in files.items():
        others = [files[g] for g in files if g != f and files[g][0] == c]
        best = [max(alike(a, b) for a in names for b in o) for _, o in others if names and o]
        if others:
            want[f] = (sum(bool(o) for _, o in others), min(best, default=None))
    for extra in ({}, {"block": 1}):
        got = {r.f: r for r in network.linked_names(prof, "f", "n", "v", "CIN", "NOM", **extra).collect()}
        assert {f: (r.linked, r.least) for f, r in got.items()} == want and want["D3"][1] < 0.6 < want["D4"][1]
        assert (got["D5"].score, got["E1"].score, got["E2"].score, got["G1"].score, got["D1"].score) == (None, 0.0, None, 0.0, 1.0)


def test_registered_queries_of_names_behind_identifiers(spark, sf):
    import __spark_entry__ as e

    assert e.queries()["jn4_same_cin_names"](spark, sf).columns == ["dossier_id", "value", "linked", "least", "score"]
    assert e.queries()["jn6_same_name_cins"](spark, sf).count() > 0


def test_fields(spark):
    rows = spark.createDataFrame([("d", "a", "1", 1), ("d", "a", "2", 2), ("d", "b", None, 3), ("d", "z", "x", 4), ("e", "b", " ", 1), ("e", "b", "5", 2)], "k STRING, n STRING, v STRING, p INT")
    assert {r.k: (r.A, r.B) for r in fields.wide(rows, ["k"], "n", "v", {"A": "a", "B": "b"}, "p").collect()} == {"d": ("2", None), "e": (None, "5")}
    assert {r.k: r.x for r in fields.first_of_alias(rows, ["k"], "n", "v", "p", {"x": ("a", "b")}).collect()} == {"d": "1", "e": "5"}
    assert fields.latest(rows, ["k"], "p").count() == 2 and {r.v for r in fields.latest(rows, ["k"], "p").collect()} == {"x", "5"}
    assert {r.v for r in fields.earliest(rows, ["k"], "p").collect()} == {"1", " "}
    u = spark.createDataFrame([("INVALID_FORMAT", "n", "r"), ("VALID", None, "r"), (None, "n", "r")], "s STRING, n STRING, r STRING").select(fields.usable(F.col("s"), F.col("n"), F.col("r")).alias("x"))
    assert [r.x for r in u.collect()] == [None, "r", "n"]
    names = spark.createDataFrame([("d", "nom", "ALAMI", 0.9), ("d", "prenom", "Nadia ", 0.7), ("e", "nom", "X", 0.9)], "k STRING, n STRING, v STRING, c DOUBLE")
    assert [(r.k, r.full_name, r.confidence) for r in fields.combined_name(names, ["k"], "n", "v", "c", ("nom", "prenom")).collect()] == [("d", "ALAMI Nadia", 0.7)]
    tx = spark.createDataFrame([("d", [("x",), ("y",)]), ("e", []), ("f", None)], "doc_id STRING, items ARRAY<STRUCT<libelle: STRING>>")
    assert [(r.tx_idx, r.transaction_id, r.libelle) for r in fields.numbered_transactions(tx, "doc_id", "items").orderBy("tx_idx").collect()] == [(1, "d__TX001", "x"), (2, "d__TX002", "y")]
    assert [r.view for r in fields.view_of(rows.filter("k = 'd'"), ["k"], "n", "v", ("a", "z")).collect()] == ['{"a":"2","z":"x"}']


def test_quality(spark):
    docs = spark.createDataFrame([("f", t) for t in ["CIN", "CIN", "RIB", "QUITTANCE", "RELEVE_BANCAIRE", "AUTRE", None]], "f STRING, t STRING")
    r = quality.completeness(docs, "f", "t").first()
    assert (r.n_documents, r.missing, r.extra, r.complete) == (7, "ATTESTATION_TRAVAIL|BULLETIN_SALAIRE|RELEVE_BANCAIRE", "CIN|AUTRE", False)
    rows = [
        ("EXTRACTED", "bk 123456", "BK123456", 0.9, True), ("EXTRACTED", "x", "bk", 0.9, True), ("MISSING", None, None, 0.9, True), ("MISSING", None, None, 0.9, False), ("EXTRACTED", "?", None, 0.9, True), ("EXTRACTED", "?", None, 0.9, False),
        ("EXTRACTED", "x", "BK123456", 0.69, True), ("EXTRACTED", "x", "BK123456", None, True), ("TO_REVIEW", "x", "BK123456", 0.1, True), ("TO_REVIEW", "x", "bk", 0.9, True), ("ABSENT_DU_TEMPLATE", "x", "BK123456", 0.9, True), (None, "x", "BK123456", 0.7, True),
    ]
    vals = spark.createDataFrame(rows, "e STRING, raw STRING, v STRING, c DOUBLE, r BOOLEAN")
    st = vals.select(quality.field_status(F.col("e"), F.col("raw"), F.col("v"), quality.valid_value(F.lit("cin"), F.col("v")), F.col("c"), F.col("r")).alias("s"))
    assert [x.s for x in st.collect()] == ["VALID", "INVALID_FORMAT", "MISSING", "OPTIONAL_MISSING", "INVALID_FORMAT", "INVALID_FORMAT", "LOW_CONFIDENCE", "LOW_CONFIDENCE", "TO_REVIEW", "INVALID_FORMAT", "ABSENT_DU_TEMPLATE", "VALID"]
    kept = [("a", "MISSING", True), ("a", "INVALID_FORMAT", True), ("b", "INVALID_FORMAT", True), ("c", "LOW_CONFIDENCE", True), ("d", "VALID", True), ("e", "INVALID_FORMAT", False), ("f", "LOW_CONFIDENCE", False), ("f", "OPTIONAL_MISSING", False)]
    rolled = quality.document_status(spark.createDataFrame([(k, "CIN", s, r) for k, s, r in kept] + [("g", "AUTRE", "MISSING", True), ("h", None, "VALID", False)], "k STRING, t STRING, s STRING, r BOOLEAN"), ["k"], "s", "r", "t")
    assert {r.k: r.document_status for r in rolled.collect()} == {"a": "INCOMPLETE", "b": "INVALID", "c": "TO_REVIEW", "d": "VALID", "e": "TO_REVIEW", "f": "VALID", "g": "NOT_IMPLEMENTED", "h": "NOT_IMPLEMENTED"}


def test_normalised_and_valid_values(spark):
    rows = [("cin", "bk 123-456", "BK123456"), ("rib", " 12 34x", "1234"), ("iban", "ma12 34", "MA1234"), ("nom", " el  Alami2", "EL ALAMI"), ("date_facture", "7/1/2024", "2024-01-07"), ("periode", "3/2024", "2024-03"), ("net_a_payer", "1 234,50 DH", "1234.5"), ("cachet_present", "oui", "true"), ("sexe", "masculin", "M"), ("banque", "Attijari wafa-bank", "ATTIJARIWAFA BANK"), ("banque", "Autre banque", "AUTRE BANQUE"), ("poste", " médecin ", "MEDECIN"), ("adresse", "n°5, Rue é", None), ("date_facture", "jamais", None), ("autre", "né", "NE"), ("nom", None, None)]
    df = spark.createDataFrame(rows, "n STRING, raw STRING, expected STRING").withColumn("v", quality.normalised_value(F.col("n"), F.col("raw")))
    got = df.withColumn("ok", quality.valid_value(F.col("n"), F.col("v"))).collect()
    assert all(r.v == r.expected for r in got if r.n != "adresse") and all(r.ok for r in got if r.v is not None) and not any(r.ok for r in got if r.v is None)
    bad = spark.createDataFrame([("cin", "K1"), ("rib", "1a"), ("iban", "ma1"), ("nom", "A"), ("nom", "AB1"), ("date_facture", "2024-13-01"), ("periode", "2024-13"), ("net_a_payer", "x"), ("cachet_present", "peut-être"), ("sexe", "X"), ("ville", "A")], "n STRING, v STRING")
    assert not any(r[0] for r in bad.select(quality.valid_value(F.col("n"), F.col("v"))).collect())
    tx = spark.createDataFrame([([("01/02", "x", 1.0, "D")],), ([("01/02", "x", None, "D")],), ([("01/02", "x", 1.0, "Z")],), ([],), (None,), ([None],)], "t ARRAY<STRUCT<date: STRING, libelle: STRING, montant: DOUBLE, sens: STRING>>")
    assert [r[0] for r in tx.select(quality.valid_transactions(F.col("t"))).collect()] == [True, False, False, False, False, False]


def test_roll_ups_of_normalisation_and_extraction(spark):
    rows = [("a", "cin", "x", "X", "EXTRACTED", True), ("a", "nom", None, None, "MISSING", True), ("a", "rib", "?", None, "EXTRACTED", False), ("b", "cin", "x", "X", "TO_REVIEW", True), ("b", "iban", None, None, "ABSENT_DU_TEMPLATE", True), ("c", "cin", "x", "X", None, True)]
    df = spark.createDataFrame(rows, "k STRING, n STRING, raw STRING, v STRING, e STRING, r BOOLEAN")
    norm = df.withColumn("s", quality.normalisation_status(F.col("e"), F.col("raw"), F.col("v")))
    assert {r.k: tuple(r)[1:] for r in quality.normalisation_roll_up(norm, ["k"], "n", "s").collect()} == {"a": ("TO_REVIEW", 1, "nom", "", "rib"), "b": ("OK", 1, "", "iban", ""), "c": ("OK", 1, "", "", "")}
    assert {r.k: tuple(r)[1:] for r in quality.extraction_roll_up(df, ["k"], "n", "raw", "e", "r").collect()} == {"a": ("INCOMPLETE", "nom", ""), "b": ("TO_REVIEW", "", "cin"), "c": ("OK", "", "")}


def test_banks_months_and_document_types(spark):
    df = spark.createDataFrame([("cih bank agence",), ("attijariwafa bank",), ("cih et attijari",), ("rien",), ("",)], "t STRING").select(classify.detect_bank(F.col("t")).alias("b"))
    assert [(r.b.bank, r.b.confidence) for r in df.collect()] == [("CIH", 1.0), ("ATTIJARI", 1.0), ("UNKNOWN", 0.0), ("UNKNOWN", 0.0), ("UNKNOWN", 0.0)]
    p = spark.createDataFrame([("Février 2024",), ("2024/3",), ("11-2023",), ("du 01/02/2024",), ("août",), ("déc. 2025",), ("",), (None,)], "t STRING").select(V.period_in_words(F.col("t")).alias("p"), V.partial_date(F.col("t")).alias("d"))
    assert [r.p for r in p.collect()] == ["2024-02", "2024-03", "2023-11", "2024-02", None, "2025-12", None, None]
    d = spark.createDataFrame([("05/02",), ("0 5/02 ",), ("5/2/2024",), ("x",)], "t STRING").select(V.partial_date(F.col("t")).alias("d"))
    assert [r.d for r in d.collect()] == ["05/02", "05/02", "2024-02-05", None]
    k = spark.createDataFrame([("Bulletin de salaire",), ("RELEVÉ_BANCAIRE",), ("cin",), ("autre chose",), (None,)], "t STRING").select(fields.document_type(F.col("t")).alias("k"))
    assert [r.k for r in k.collect()] == ["BULLETIN_SALAIRE", "RELEVE_BANCAIRE", "CIN", "AUTRE_CHOSE", None]


def test_predecessors_over_gaps_and_ranges(spark):
    ids = sorted({f"D{n * n:05}" for n in range(60)} | {"A", "zz"})
    got = {r.target: r.donor for r in mutate.predecessors(spark.createDataFrame([(i,) for i in ids + ids[:5]] + [(None,)], "i STRING").repartition(4), "i").collect()}
    assert got == dict(zip(ids[1:], ids))
    assert mutate.predecessors(spark.createDataFrame([], "i STRING"), "i").count() == 0


def test_classification(spark):
    df = spark.createDataFrame([("attestation de travail nous soussignes date d embauche",), ("carte d identite numero d identifiant date de naissance",), ("releve de compte",), ("",), (None,), ("bulletin de paie attestation de travail",)], "t STRING")
    got = classify.classify(df, "t").collect()
    assert [r.doc_class for r in got] == ["ATTESTATION_TRAVAIL", "CIN", "RELEVE_BANCAIRE", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert [r.class_confidence for r in got] == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0] and got[5].class_score == 5.0


def test_audit(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "b"), (None, "c")], "i INT, v STRING")
    assert [(r.value, r.rows) for r in audit.duplicate_groups(df, F.col("v"), "i", 5).collect()] == [("a", 2)]
    assert sorted((str(r.i), r.rows) for r in audit.key_violations(df, ["i"]).collect()) == [("3", 2), ("None", 1)]
    assert {r.property: r.filled for r in audit.property_catalog(df, "t").collect()} == {"i": 4, "v": 5}
    assert audit.seeded_sample(df, "i", 1, 2).collect() == audit.seeded_sample(df.repartition(3), "i", 1, 2).collect()
    base = spark.createDataFrame([(1, "x", "p", 1), (2, "y", "q", 1)], "k INT, a STRING, b STRING, t INT")
    new = spark.createDataFrame([(1, None, "P", 2), (3, "z", "r", 2), (3, "Z", "r", 3)], "k INT, a STRING, b STRING, t INT")
    assert sorted((r.k, r.a, r.b) for r in audit.upsert(base, new, ["k"], "t").collect()) == [(1, "x", "P"), (2, "y", "q"), (3, "Z", "r")]
    assert audit.outcomes(spark.createDataFrame([("r", "NORMAL"), ("r", "TRIGGERED"), ("r", "UNAVAILABLE"), ("q", "UNAVAILABLE")], "k STRING, s STRING"), "k", "s").orderBy("k").collect()[1].violation_rate == 0.5
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "k INT, v ARRAY<DOUBLE>")
    assert math.isclose({r.k: r.score for r in audit.top_patches(vec, ["k"], "v", 1).collect()}[4], 2 / math.sqrt(2))


@pytest.mark.parametrize("seed", [1, 2])
def test_calibration_against_pairs(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 1), rnd.randint(0, 12) / 10) for _ in range(300)] + [(None, 1.0), (1, None)]
    df = spark.createDataFrame(rows, "y INT, s DOUBLE")
    known = [(y, s) for y, s in rows if y is not None and s is not None]
    pos, neg = [s for y, s in known if y], [s for y, s in known if not y]
    area = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert math.isclose(calibration.auc(df, "y", "s").first().auc, area, abs_tol=1e-6)
    j, t = max((round(sum(p >= t for p in pos) / len(pos) - sum(n >= t for n in neg) / len(neg), 6), t) for t in {s for _, s in known})
    got = calibration.youden(df, "y", "s").first()
    assert (got.threshold, got.j) == (t, j)
    c = calibration.confusion(df.withColumn("p", (F.col("s") > 0.6).cast("int")), "y", "p").first()
    assert c.tp == sum(p > 0.6 for p in pos) and c.tn == sum(n <= 0.6 for n in neg)


def test_mutations(spark):
    df = spark.createDataFrame([("f", "a", "1", 1), ("f", "a", "2", 2), ("g", "b", "3", 1)], "k STRING, n STRING, v STRING, p INT")
    assert sorted((r.v, r.mutated) for r in mutate.mutate_first(df, "k", "n", "v", "p", ("a",), F.lit("X")).collect()) == [("2", False), ("3", False), ("X", True)]
    pairs = spark.createDataFrame([("f", "h")], "target STRING, donor STRING")
    more = df.unionByName(spark.createDataFrame([("h", "a", "9", 1)], df.schema))
    assert sorted(r.v for r in mutate.borrow_from_donor(more, pairs, "k", "n", "v", ("a",)).collect()) == ["3", "9", "9", "9"]


B = lambda text, x, y: (text, x - 50.0, y - 10.0, x + 50.0, y + 10.0, 0.97)


def page(spark, doc_type, blocks, doc_id="d"):
    return spark.createDataFrame([(doc_id, doc_type, blocks)], f"doc_id STRING, doc_type STRING, blocks ARRAY<STRUCT<{', '.join(': '.join(c.split()) for c in layout.BLOCK.split(', '))}>>")


def test_extraction_of_an_identity_card(spark):
    pairs = [("Numéro d'identifiant", "J049505"), ("Nom", "EL ALAMI"), ("Prénom", "NADIA"), ("Date de naissance", "12/03/1998"), ("Adresse", "10 RUE EXEMPLE CASABLANCA")]
    blocks = [b for i, (k, v) in enumerate(pairs) for b in (B(k, 100, 100 + 50 * i), B(v, 300, 100 + 50 * i))]
    got = {r.field_name: (r.raw_value, r.status) for r in layout.extract_fields(page(spark, "CIN", blocks)).collect()}
    assert got["cin_numero"] == ("J049505", "EXTRACTED") and got["nom"] == ("EL ALAMI", "EXTRACTED") and got["adresse"][0] == "10 RUE EXEMPLE CASABLANCA"
    assert got["sexe"] == (None, "MISSING")
    few = {r.field_name: (r.raw_value, r.status, r.method) for r in layout.extract_fields(page(spark, "CIN", [B("carte j049505", 100, 100), B("Sexe : F", 100, 150)])).collect()}
    assert few["cin_numero"] == ("J049505", "TO_REVIEW", "PATTERN") and few["sexe"] == ("F", "EXTRACTED", "INLINE")
    below = {r.field_name: r.raw_value for r in layout.extract_fields(page(spark, "CIN", [B("Nom", 100, 100), B("TAZI", 100, 130)])).collect()}
    assert below["nom"] == "TAZI"
    assert [r.status for r in layout.extract_fields(page(spark, "AUTRE", [])).collect()] == ["NOT_IMPLEMENTED"]


def test_transactions_of_a_statement(spark):
    def line(y, day, label, amount, x):
        return [B(day, 60, y), B(label, 250, y), B(amount, x, y)]

    blocks = [*line(100, "01/02", "ACHAT CARTE", "120,50", 500), *line(140, "05/02", "VIR SALAIRE", "12 400,00", 700), *line(180, "28/02", "SOLDE FINAL", "9,00", 700), B("TEXTE", 100, 220)]
    got = [(r.tx_idx, r.date, r.libelle, r.montant, r.sens) for r in layout.transactions(layout.blocks(page(spark, "RELEVE_BANCAIRE", blocks))).orderBy("tx_idx").collect()]
    assert got == [(1, "01/02", "ACHAT CARTE", 120.5, "D"), (2, "05/02", "VIR SALAIRE", 12400.0, "C")]
    block = layout.blocks(page(spark, "X", blocks))
    assert layout.bounding_box(block).first().confidence == 0.97
    assert layout.after_anchor(block, "achat", F.col("text").rlike(layout.AMOUNT), 3).first().text == "120,50"


def test_templates_and_routes(spark):
    df = spark.createDataFrame([("RIB", "V1", "CIH"), ("RIB", "", "CIH"), ("RIB", None, "X"), ("CIN", None, None), (None, None, None)], "t STRING, v STRING, b STRING")
    t = classify.best_template(F.col("t"), F.col("v"), F.col("b"), {"RIB": {"CIH": "RIB_CIH"}}, {"CIN": "CIN_1"})
    assert [r.x for r in df.select(t.alias("x")).collect()] == ["V1", "RIB_CIH", None, "CIN_1", None]
    assert [r.x for r in df.select(classify.route(t, F.lit(True)).alias("x")).collect()] == ["V1", "RIB_CIH", "A_VERIFIER", "CIN_1", "A_VERIFIER"]


def test_operators_on_empty_tables(spark):
    e = spark.createDataFrame([], "k STRING, n STRING, v STRING, d STRING, p INT, x DOUBLE, y INT")
    assert series.adjacent_breaks(e, "k", ["p"], "x", "x").count() == series.consecutive(e, "k", "p").count() == series.gap_clusters(e, "k", ["p"], "x", 1).count() == series.largest_gap(e, "k", "x").count() == 0
    assert compare.unique_match(e, e.withColumnRenamed("x", "z"), ["k"], "x", "z").count() == compare.medoid_reference(e, ["k"], "v", F.lit(0), "d").count() == compare.exact_consistency(e, ["k"], "v", F.lit(0), "d").count() == 0
    prof = network.profile(e, "k", "n", "v", "d")
    assert network.links_between(prof, "k", "n", "v", "A").count() == 0
    assert calibration.confusion(e, "y", "p").first().precision is None and calibration.auc(e, "y", "x").first().auc is None
    assert quality.completeness(e, "k", "n").count() == audit.field_catalog(e, "n", "v", "k", "d").count() == audit.seeded_sample(e, "k", 1, 5).count() == 0


def test_rows_of_the_placeholder_are_in_the_results_per_document(spark, sf):
    import __spark_entry__ as e
    from tamis.plans.dossier import UNKNOWN
    from tamis.session import table

    q = e.queries()
    unknown = lambda name: table(spark, sf, name).filter((F.col("dossier_id") == UNKNOWN) & F.col("doc_id").isNotNull())
    want = {r.doc_id for r in unknown("txn").select("doc_id").distinct().collect()}
    assert want and want <= {r.doc_id for r in q["a2_one_salary_per_statement_all"](spark, sf).collect()}
    assert {r.doc_id for r in unknown("champ").filter("valeur IS NOT NULL").select("doc_id").distinct().collect()} <= {r.doc_id for r in q["prj7_canonical_fields_all"](spark, sf).collect()}
    assert q["prj1_wide_statements_all"](spark, sf).filter(F.col("dossier_id") == UNKNOWN).count() > 0
    assert q["m1_mutated_fields_all"](spark, sf).exceptAll(q["m1_mutated_fields"](spark, sf)).filter("mutated").count() == 0
