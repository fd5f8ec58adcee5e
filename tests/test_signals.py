"""Golden scenarios of the signals, and brute force over random profiles."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tamis.functions import scores
from tamis.operators import signals as S

REC = "dossier_id STRING, field STRING, doc STRING, doc_type STRING, value STRING"
PAY, MOVE = "dossier_id STRING, slot INT, period STRING, net DOUBLE", "dossier_id STRING, slot INT, period STRING, amount DOUBLE"
CIN, ATT, RIB, REL, BUL, QUI = "CIN", "ATTESTATION_TRAVAIL", "RIB", "RELEVE_BANCAIRE", "BULLETIN_SALAIRE", "QUITTANCE"

COHERENT = [
    ("CIN", "d1", CIN, "BK123456"), ("CIN", "d2", ATT, "BK 123456"), ("RIB", "d3", RIB, "001122"), ("RIB", "d4", REL, "001122"), ("IBAN", "d3", RIB, "MA11"), ("IBAN", "d4", REL, "MA11"),
    ("BANQUE", "d3", RIB, "CIH"), ("BANQUE", "d4", REL, "cih"), ("NOM_COMPLET", "d1", CIN, "EL ALAMI NADIA"), ("NOM_COMPLET", "d2", ATT, "NADIA EL ALAMI"), ("EMPLOYEUR", "d2", ATT, "COOPER PHARMA"), ("EMPLOYEUR", "d5", BUL, "COOPER PHARMA"),
    ("POSTE", "d2", ATT, "MEDECIN"), ("POSTE", "d5", BUL, "MEDECIN"), ("DATE_EMBAUCHE", "d2", ATT, "2020-01-01"), ("DATE_EMBAUCHE", "d5", BUL, "2020-01-01"), ("ADRESSE", "d1", CIN, "10 RUE DES ORANGERS CASABLANCA"), ("ADRESSE", "d6", QUI, "10 RUE DES ORANGERS CASABLANCA"),
]


def variant(field, doc, value):
    return [(f, d, t, value if (f, d) == (field, doc) else v) for f, d, t, v in COHERENT]


#: name: (records, net and transfer, {check: (score, critical)})
INTRA = {
    "COHERENT": (COHERENT, (12400, 12400), {}),
    "CIN": (variant("CIN", "d2", "BK123457"), (1, 1), {"CIN": (1.0, True)}),
    "RIB": (variant("RIB", "d4", "001123"), (1, 1), {"RIB": (1.0, True)}),
    "IBAN": (variant("IBAN", "d4", "MA12"), (1, 1), {"IBAN": (1.0, True)}),
    "BANQUE": (variant("BANQUE", "d4", "ATTIJARI"), (1, 1), {"BANQUE": (1.0, True)}),
    "NOM_100": (variant("NOM_COMPLET", "d2", "XXXX ZZZZ"), (1, 1), {"NOM_COMPLET": (1.0, True)}),
    "EMPLOYEUR_100": (variant("EMPLOYEUR", "d5", "AUTRE SOCIETE"), (1, 1), {"EMPLOYEUR": (1.0, False)}),
    "POSTE_100": (variant("POSTE", "d5", "PLOMBIER"), (1, 1), {"POSTE": (1.0, False)}),
    "ADRESSE_100": (variant("ADRESSE", "d6", "11 RUE DES ORANGERS CASABLANCA"), (1, 1), {"ADRESSE": (1.0, False)}),
    "DATE_025": (variant("DATE_EMBAUCHE", "d5", "2020-01-16"), (1, 1), {"DATE_EMBAUCHE": (0.25, False)}),
    "DATE_060": (variant("DATE_EMBAUCHE", "d5", "30/04/2020"), (1, 1), {"DATE_EMBAUCHE": (0.6, False)}),
    "DATE_100": (variant("DATE_EMBAUCHE", "d5", "2021-02-04"), (1, 1), {"DATE_EMBAUCHE": (1.0, False)}),
    "DATE_TEXT": (variant("DATE_EMBAUCHE", "d5", "bientôt"), (1, 1), {"DATE_EMBAUCHE": (1.0, False)}),
    "SALAIRE_03": (COHERENT, (10000, 9700), {"SALAIRE_M1": (0.25, False)}),
    "SALAIRE_08": (COHERENT, (10000, 9200), {"SALAIRE_M1": (0.5, False)}),
    "SALAIRE_15": (COHERENT, (10000, 8500), {"SALAIRE_M1": (0.75, False)}),
    "SALAIRE_25": (COHERENT, (10000, 7500), {"SALAIRE_M1": (1.0, False)}),
    "RIB_SALAIRE15": (variant("RIB", "d4", "9"), (10000, 8500), {"RIB": (1.0, True), "SALAIRE_M1": (0.75, False)}),
    "CIN_ABSENTE": ([r for r in COHERENT if r[:2] != ("CIN", "d2")], (1, 1), {"CIN": (None, False)}),
}


@pytest.fixture(scope="module")
def intra(spark):
    recs = [(k, *r) for k, (rs, _, _) in INTRA.items() for r in rs]
    pay = [(k, 1, "2025-01", float(n)) for k, (_, (n, _), _) in INTRA.items()]
    move = [(k, 1, "2025-01", float(m)) for k, (_, (_, m), _) in INTRA.items()]
    spine = spark.createDataFrame([(k,) for k in INTRA] + [("EMPTY",), (None,)], "dossier_id STRING")
    checks = S.intra_checks(spark.createDataFrame(recs, REC), spark.createDataFrame(pay, PAY), spark.createDataFrame(move, MOVE), spine)
    rolled = S.roll_up(spine, checks, (*S.FIELD_RULES, *S.SALARY_CHECKS)).withColumn("status", S.intra_status(F.col("score")))
    by = {}
    for r in checks.collect():
        by.setdefault(r.dossier_id, {})[r.check] = (r.score, r.critical)
    return by, {r.dossier_id: r for r in rolled.collect()}


@pytest.mark.parametrize("name", INTRA)
def test_intra_scenarios(intra, name):
    checks, rolled = intra
    expected = INTRA[name][2]
    for check in S.FIELD_RULES:
        if check != "CIN" or name != "CIN_ABSENTE":
            assert checks[name][check] == expected.get(check, (0.0, False)), check
    assert checks[name]["SALAIRE_M1"] == expected.get("SALAIRE_M1", (0.0, False)) and checks[name]["SALAIRE_M2"] == (None, False)
    got = rolled[name]
    assert got.score == max([s for s, _ in expected.values() if s is not None], default=0.0)
    assert got.n_checks == 12 and got.n_available == (10 if name != "CIN_ABSENTE" else 9) and got.n_critical == sum(c for _, c in expected.values())
    assert got.anomalies == "|".join(k for k in (*S.FIELD_RULES, *S.SALARY_CHECKS) if (expected.get(k, (0,))[0] or 0) > 0)
    assert got.status == ("ANOMALY_DETECTED" if got.score > 0 else "NO_ANOMALY_DETECTED")


def test_a_file_without_anything_is_unavailable(intra):
    _, rolled = intra
    got = rolled["EMPTY"]
    assert (got.score, got.n_available, got.status, got.anomalies) == (None, 0, "UNAVAILABLE", "") and None not in rolled


def similarity(a, b):
    x, y = set(a.split()), set(b.split())
    return max(len(x & y) / min(len(x), len(y)), len(x & y) / len(x | y), SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio())


def test_text_checks_equal_brute_force_in_blocks_of_any_size(spark):
    rnd = random.Random(5)
    words = ["ALAMI", "ALAOUI", "NADIA", "NADIYA", "KARIM", "EL", "BENNANI", "BENANI"]
    rows = [("f%d" % f, "NOM_COMPLET", "d%d" % rnd.randint(0, 6), rnd.choice([CIN, ATT, RIB, BUL]), " ".join(rnd.sample(words, rnd.randint(1, 3)))) for f in range(12) for _ in range(rnd.randint(1, 12))]
    rows = [(f, n, d, [CIN, ATT, RIB, BUL, CIN, RIB, REL][int(d[1])], v) for f, n, d, _, v in rows]
    order = list(S.FIELD_RULES["NOM_COMPLET"].documents)
    expected = {}
    for f in {r[0] for r in rows}:
        own = [(d, order.index(t), v) for g, _, d, t, v in rows if g == f]
        best = min(p for _, p, _ in own)
        mean = lambda c: (lambda s: round(sum(s) / len(s), 9) if s else 1.0)([round(similarity(c[2], v), 6) for d, _, v in own if d != c[0]])  # noqa: B023, E731
        ref = min((c for c in own if c[1] == best), key=lambda c: (-mean(c), c[0], c[2]))
        ladder = lambda s: 0.0 if s >= 0.95 else 0.25 if s >= 0.85 else 0.6 if s >= 0.7 else 1.0
        worst = max((ladder(round(similarity(ref[2], v), 6)) for d, _, v in own if d != ref[0]), default=0.0)
        expected[f] = worst if len({d for d, _, _ in own}) > 1 else None
    df = spark.createDataFrame(rows + [("f0", "NOM_COMPLET", None, CIN, "X"), ("f0", "NOM_COMPLET", "d0", CIN, None), ("f0", "AUTRE", "d0", CIN, "X"), (None, "POSTE", "d0", ATT, "X")], REC)
    for block in (500, 2):
        got = {r.dossier_id: r.score for r in S.text_checks(df, block=block).collect() if r.check == "NOM_COMPLET"}
        assert got == expected
    assert S.text_checks(df.limit(0)).count() == 0 and S.exact_checks(df.limit(0)).count() == 0


# --- between files

BASE = {"CIN": "BK1", "NOM": "NADIA EL ALAMI", "RIB": "R1", "IBAN": "I1"}
OTHER = {"CIN": "ZZ9", "NOM": "OUSSAMA TAZI", "RIB": "R9", "IBAN": "I9"}
#: name: (what the target has instead of OTHER, files beside the base, score, {check: score}, status)
INTER = {
    "CLEAN_REPEAT": (BASE, [], 0.0, {}, "NO_NETWORK_ANOMALY"),
    "CIN_NAME_100": ({"CIN": "BK1"}, [], 1.0, {"CIN_MULTIPLE_NAMES": 1.0}, "CRITICAL_NETWORK_ANOMALY"),
    "CIN_NAME_060": ({"CIN": "BK1", "NOM": "NADYA ELALAMY"}, [], None, {}, None),
    "RIB_DIFFERENT_CIN": ({"RIB": "R1"}, [], 1.0, {"RIB_MULTIPLE_IDENTITIES": 1.0}, "CRITICAL_NETWORK_ANOMALY"),
    "IBAN_DIFFERENT_CIN": ({"IBAN": "I1"}, [], 1.0, {"IBAN_MULTIPLE_IDENTITIES": 1.0}, "CRITICAL_NETWORK_ANOMALY"),
    "NAME_2_CIN": ({"NOM": BASE["NOM"]}, [], 0.25, {"NAME_MULTIPLE_CIN": 0.25}, "NETWORK_ANOMALY_DETECTED"),
    "NAME_3_CIN": ({"NOM": BASE["NOM"]}, [{"NOM": BASE["NOM"], "CIN": "A1"}], 0.5, {"NAME_MULTIPLE_CIN": 0.5}, "NETWORK_ANOMALY_DETECTED"),
    "NAME_4_CIN": ({"NOM": BASE["NOM"]}, [{"NOM": BASE["NOM"], "CIN": "A1"}, {"NOM": BASE["NOM"], "CIN": "A2"}], 0.6, {"NAME_MULTIPLE_CIN": 0.6}, "NETWORK_ANOMALY_DETECTED"),
    "IBAN_ABSENT": ({"IBAN": None}, [], 0.0, {"IBAN_MULTIPLE_IDENTITIES": None}, "NO_NETWORK_ANOMALY"),
    "COMBINED": ({"RIB": "R1", "NOM": BASE["NOM"]}, [], 1.0, {"RIB_MULTIPLE_IDENTITIES": 1.0, "NAME_MULTIPLE_CIN": 0.25}, "CRITICAL_NETWORK_ANOMALY"),
    "LINKED_WITHOUT_CIN": ({"RIB": "R7"}, [{"RIB": "R7"}], 0.0, {}, "NO_NETWORK_ANOMALY"),
}


def _own(scenario, name, value):
    """Values of a scenario that no other scenario has: another prefix, or one more word in all of its names."""
    return f"{value} Z{list(INTER).index(scenario)}" if name == "NOM" else f"{scenario}{value}"


@pytest.fixture(scope="module")
def inter(spark):
    rows = []
    for s, (change, anchors, *_) in INTER.items():
        files = {"base": BASE, "target": OTHER | change} | {f"anchor{i}": a for i, a in enumerate(anchors)}
        rows += [(f"{s}/{f}", n, _own(s, n, v)) for f, vs in files.items() for n, v in vs.items() if v]
    checks = S.inter_checks(spark.createDataFrame(rows, "dossier_id STRING, name STRING, value STRING")).collect()
    spine = spark.createDataFrame([(f"{s}/target",) for s in INTER] + [("nothing",)], "dossier_id STRING")
    again = spark.createDataFrame(checks, "dossier_id STRING, check STRING, score DOUBLE, critical BOOLEAN")
    rolled = S.roll_up(spine, again, S.INTER_CHECKS).withColumn("status", S.inter_status()).collect()
    return {(r.dossier_id, r.check): r.score for r in checks}, {r.dossier_id: r for r in rolled}


@pytest.mark.parametrize("name", INTER)
def test_inter_scenarios(inter, name):
    checks, rolled = inter
    change, _, score, per_check, status = INTER[name]
    if score is None:  # a graded name: by the similarity itself
        like = similarity(_own(name, "NOM", change["NOM"]), _own(name, "NOM", BASE["NOM"]))
        score = next((s for t, s in scores.TEXT_LADDER if like >= t), 1.0)
        per_check, status = {"CIN_MULTIPLE_NAMES": score}, "CRITICAL_NETWORK_ANOMALY" if score == 1 else "NETWORK_ANOMALY_DETECTED"
    for c in S.INTER_CHECKS:
        assert checks.get((f"{name}/target", c)) == per_check.get(c, 0.0), c
    got = rolled[f"{name}/target"]
    assert (got.score, got.status) == (score, status) and rolled["nothing"].status == "UNAVAILABLE"


def test_shared_identities_equal_brute_force(spark):
    rnd = random.Random(6)
    files = {f"f{i}": ({f"r{rnd.randint(0, 6)}" for _ in range(rnd.randint(0, 2))}, {f"c{rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 3))}) for i in range(60)}
    rows = [(f, n, v) for f, (rs, cs) in files.items() for n, vs in (("RIB", rs), ("CIN", cs)) for v in vs]
    got = {r.dossier_id: (r.score, r.linked) for r in S.shared_identity_check(spark.createDataFrame(rows, "dossier_id STRING, name STRING, value STRING"), "RIB", "X").collect()}
    for f, (rs, cs) in files.items():
        linked = sum(len(rs & o) for g, (o, c) in files.items() if g != f and c and not c & cs)
        assert got.get(f) == (None if not rs else ((1.0 if linked else 0.0) if cs else None, linked if cs else 0))
    a = spark.createDataFrame([("A", "RIB", "r"), ("A", "CIN", "c1"), ("B", "RIB", "r"), ("B", "CIN", "c1"), ("B", "CIN", "c2")], "dossier_id STRING, name STRING, value STRING")
    assert {r.dossier_id: r.score for r in S.shared_identity_check(a, "RIB", "X").collect()} == {"A": 0.0, "B": 0.0}


# --- business rules


def _file(change=None):
    """Three statements, three payslips, their transactions and employers, coherent; change(parts) alters them."""
    st = [["S1", 24301, 1000.0, 1500.0, 5000.0, 4500.0], ["S2", 24302, 1500.0, 2000.0, 5000.0, 4500.0], ["S3", 24303, 2000.0, 2500.0, 5000.0, 4500.0]]
    pay = [["P1", 24301, 5000.0], ["P2", 24302, 5000.0], ["P3", 24303, 5000.0]]
    tx = [[s, label, amount, sign, pay_] for s in ("S1", "S2", "S3") for label, amount, sign, pay_ in (("VIR SALAIRE COOPER PHARMA", 5000.0, "C", None), ("RETRAIT", -4000.0, "D", False), ("ACHAT", 500.0, "D", False))]
    emp = [["P1", "Cooper Pharma"], ["P2", "COOPER PHARMA"], ["P3", "Coper"]]
    parts = {"st": st, "pay": pay, "tx": tx, "emp": emp}
    if change:
        change(parts)
    return parts


def _set(part, row, col, value):
    return lambda p: p[part][row].__setitem__(col, value)


def _all_from(col_row):
    def change(p):
        for r in p["st"][1:]:
            r[2] += 100
            r[3] += 100

    return change


CASES = {
    "GOOD": (None, {}),
    "D9001": (_set("pay", 2, 1, 25199), {"THREE_CONSECUTIVE_PERIODS": 1.0}),
    "D9002": (lambda p: p["tx"].append(["S1", "VIR SALAIRE COOPER PHARMA", 0.0, "C", None]), {"ONE_SALARY_TRANSFER_PER_MONTH": 1.0, "SALARY_AMOUNT_MATCH": None, "SALARY_LABEL_EMPLOYER": None}),
    "D9003": (_set("pay", 0, 2, 5100.0), {"SALARY_AMOUNT_MATCH": 1.0}),
    "D9004": (lambda p: [r.__setitem__(1, "VIR SALAIRE EMPLOYEUR INCONNU") for r in p["tx"] if "SALAIRE" in r[1]], {"SALARY_LABEL_EMPLOYER": 1.0}),
    "D9005": (lambda p: p["tx"].pop(2), {"TRANSACTION_TOTALS": 1.0}),
    "D9006": (_set("st", 2, 3, 2600.0), {"BALANCE_EQUATION": 1.0}),
    "D9007": (_all_from(1), {"BALANCE_CHAINING": 1.0}),
    "NO_PERIOD": (_set("st", 0, 1, None), {"THREE_CONSECUTIVE_PERIODS": None}),
    "BAD_SIGN": (lambda p: p["tx"].append(["S1", "?", 1.0, "X", False]), {"TRANSACTION_TOTALS": None}),
    # an unusable statement makes a rule unavailable, also where another one breaks it
    "DOMINATES": (lambda p: (_set("st", 2, 3, 9000.0)(p), _set("st", 0, 2, None)(p)), {"BALANCE_EQUATION": None, "BALANCE_CHAINING": 0.0, "NON_NEGATIVE_BALANCE": None}),
    "NEGATIVE": (lambda p: [r.__setitem__(2, r[2] - 3000) or r.__setitem__(3, r[3] - 3000) for r in p["st"]], {"NON_NEGATIVE_BALANCE": 1.0}),
    "TOLERANCE": (_set("pay", 0, 2, 5001.0), {}),
}


def test_business_rules(spark):
    parts = {k: _file(c) for k, (c, _) in CASES.items()}
    st = spark.createDataFrame([(k, f"{k}{r[0]}", r[0], *r[1:]) for k, p in parts.items() for r in p["st"]], "dossier_id STRING, doc_id STRING, ordinal STRING, period INT, solde_ouverture DOUBLE, solde_cloture DOUBLE, total_credits DOUBLE, total_debits DOUBLE")
    pay = spark.createDataFrame([(k, r[0], r[1], r[2]) for k, p in parts.items() for r in p["pay"]], "dossier_id STRING, ordinal STRING, period INT, net DOUBLE")
    tx = spark.createDataFrame([(f"{k}{r[0]}", *r[1:]) for k, p in parts.items() for r in p["tx"]], "doc_id STRING, libelle STRING, montant DOUBLE, sens STRING, est_salaire BOOLEAN")
    emp = spark.createDataFrame([(k, *r) for k, p in parts.items() for r in p["emp"]], "dossier_id STRING, ordinal STRING, employer STRING")
    checks = S.rule_checks(S.with_transactions(st, tx), pay, emp)
    got = {}
    for r in checks.collect():
        got.setdefault(r.dossier_id, {})[r.check] = r.score
    for k, (_, expected) in CASES.items():
        assert got[k] == {r: expected.get(r, 0.0) for r in (*S.SCORED_RULES, *S.DIAGNOSTIC_RULES)}, k
    rolled = {r.dossier_id: r for r in S.roll_up(st.select("dossier_id"), checks, (*S.SCORED_RULES, *S.DIAGNOSTIC_RULES), diagnostic=S.DIAGNOSTIC_RULES).collect()}
    assert rolled["NEGATIVE"].score == 0.0 and rolled["D9006"].score == 1.0 and rolled["D9002"].n_available == 5
    empty = S.rule_checks(S.with_transactions(st.limit(0), tx.limit(0)), pay.limit(0), emp.limit(0))
    assert empty.count() == 0


def test_fixed_grades(spark):
    df = spark.createDataFrame([("TRÈS_FORTE",), ("très forte",), ("MOYENNE",), ("?",), (None,)], "g STRING")
    assert [r[0] for r in df.select(scores.grade_probability(F.col("g"))).collect()] == [0.9, 0.9, 0.4, 0.4, 0.4]
