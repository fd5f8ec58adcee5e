import datetime as dt

from pyspark.sql import functions as F

from tamis.functions import scores, similarity
from tamis.functions import text as T
from tamis.functions import values as V


def column(spark, values, f, kind="STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalisers(spark):
    assert column(spark, ["Éléonore  d'Août", "éa", "", None, "a b"], T.upper_words) == ["ELEONORE D AOUT", "EA", "", None, "A B"]
    assert column(spark, [" bk-12 34.5 ", "!!", None], T.identifier) == ["BK12345", None, None]
    assert column(spark, ["El  Alami-Benali 3", "12"], T.person_name) == ["EL ALAMI-BENALI", None]
    assert column(spark, [" : _ valeur"], T.without_leading_signs) == ["valeur"]
    assert column(spark, ["ﬁn ½"], lambda c: T.fold_compatible(c)) == ["fin 1/2"]
    assert column(spark, ["D1_RELEVE_BANCAIRE_M2", "D1_m3_x", "D1_M4", "D1_RELEVE_M2X", None], T.month_slot) == [2, 3, None, None, None]
    assert column(spark, ["VIR SALAIRE ACME", "PAYER", "virement paie", None], T.salary_label) == [True, False, True, False]
    assert column(spark, ["VIR SALAIRE  Acmé SA"], T.label_tail) == ["ACME SA"]


def test_three_amount_parsers(spark):
    raw = ["12,345", "1.234,56", "1,234.56", "1.234.567", "12,5", "1 234,50 DH", "abc", "", None, "-7,25"]
    assert column(spark, raw, V.amount) == [12345.0, 1234.56, 1234.56, 1234.57, 125.0, 1234.5, None, None, None, -7.25]
    assert column(spark, raw, V.amount_short_decimal)[:5] == [12345.0, 1234.56, 1234.56, 1234.57, 12.5]
    assert column(spark, raw, V.amount_comma_decimal)[:5] == [12.345, 1234.56, 1234.56, None, 12.5]


def test_dates_periods_and_words(spark):
    assert column(spark, ["7/1/2024", "07-01-2024", "2024-01-07", "le 07.01.2024 à", "31/02/2024", None], V.iso_date) == [dt.date(2024, 1, 7)] * 4 + [None, None]
    assert column(spark, ["01/2025", "2025-1", "13/2025", "31/01/2025", "x", None], V.period) == ["2025-01", "2025-01", None, "2025-01", None, None]
    assert column(spark, ["2024-12", "2025-01"], V.period_index) == [2024 * 12 + 12, 2025 * 12 + 1]
    assert column(spark, ["Crédit", "d", "x", None], V.direction) == ["C", "D", None, None]
    assert column(spark, ["Oui", "FAUX", "peut-être"], V.flag) == [True, False, None]
    assert column(spark, ["Masculin", "f", ""], V.sex) == ["M", "F", None]


def test_ladders_at_their_edges(spark):
    assert column(spark, [0.95, 0.85, 0.70, 0.69, None], scores.at_least, "DOUBLE") == [0.0, 0.25, 0.60, 1.0, None]
    assert column(spark, [0, 31, 365, 366], lambda c: scores.at_most(c, scores.DATE_LADDER), "INT") == [0.0, 0.25, 0.60, 1.0]
    assert column(spark, [0.02, 0.05, 0.1, 0.2, 0.21], lambda c: scores.at_most(c, scores.AMOUNT_LADDER), "DOUBLE") == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert column(spark, [5.0, 50.0, 95.0, None], lambda c: scores.anchored(c, F.lit(10.0), F.lit(90.0), F.lit(50.0)), "DOUBLE") == [0.0, 0.5, 1.0, None]
    assert column(spark, [50.0, -1.0], lambda c: scores.anchored(c, F.lit(None).cast("double"), F.lit(90.0), F.lit(50.0)), "DOUBLE") == [0.5, 0.0]
    assert column(spark, [[1.0, 5.0, 3.0, 2.0]], lambda c: scores.top_mean(c, 3), "ARRAY<DOUBLE>") == [10 / 3]
    assert column(spark, [1.5, 0.25, -0.1], scores.unit_score, "DOUBLE") == [None, 0.25, None]


def test_noisy_or_and_fusion(spark):
    df = spark.createDataFrame([("FAIBLE",), ("TRES FORTE",), ("?",)], "g STRING")
    p = scores.grade_probability(F.col("g"))
    assert round(df.agg(scores.noisy_or(p).alias("x")).first().x, 6) == round(1 - 0.8 * 0.1 * 0.6, 6)
    assert df.limit(0).agg(scores.noisy_or(p).alias("x")).first().x == 0.0
    row = spark.createDataFrame([(0.5, None)], "a DOUBLE, b DOUBLE").select(scores.weighted_sum({"a": 0.2, "b": 0.8}).alias("s"), scores.band(scores.weighted_sum({"a": 0.2}), [(0.1, "M"), (0.2, "H")], "L").alias("n")).first()
    assert (row.s, row.n) == (0.1, "M")


def test_sequence_ratio_is_not_symmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "a STRING, b STRING")
    assert [r.x for r in df.select(similarity.seq_ratio("a", "b").alias("x")).collect()] == [0.25, 0.5, None]


def test_text_similarity(spark):
    rows = [("EL ALAMI NADIA", "NADIA EL ALAMI"), ("A B", "A B C"), ("RUE 10", "RUE 12"), ("", "A"), (None, "A"), ("KARIM ALAOUI", "KARIM ALAOUY")]
    df = spark.createDataFrame(rows, "a STRING, b STRING")
    got = {(r.a, r.b): r.similarity for r in similarity.add_text_similarity(df, "a", "b").collect()}
    assert got[rows[0]] == got[rows[1]] == 1.0 and got[rows[3]] == got[rows[4]] == 0.0 and 0.9 < got[rows[5]] < 1
    assert similarity.add_text_similarity(df, "a", "b", numbers=True).filter("a = 'RUE 10'").first().similarity == 0.0
    emp = spark.createDataFrame([("VIR SALAIRE COOPER PHARMA", "COOPER PHARMA"), ("VIR X", "ACME")], "l STRING, e STRING")
    assert [r.similarity >= 0.75 for r in similarity.add_employer_similarity(emp, "l", "e").orderBy("e").collect()] == [False, True]
