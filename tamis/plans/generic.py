"""Queries of the operators on the star schema, the events, the embeddings and the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import scores
from tamis.functions import text as T
from tamis.operators import audit, calibration, classify, compare, series
from tamis.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _seconds(c):
    """Seconds since 1970 of a timestamp without zone, the same in every session time zone."""
    day = F.unix_date(F.to_date(c)).cast("double") * 86400
    return day + F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), F.col(c)).cast("double")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 86400 THEN 1 ELSE 0 END AS s FROM e)
SELECT user_id, event_id, sum(s) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g""")
def w3_gap_clusters(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", _seconds("ts").alias("t"))
    return series.gap_clusters(e, "user_id", ["t", "event_id"], "t", 86400.0).select("user_id", "event_id", F.col("cluster").cast("bigint").alias("cluster"))


@query()
def w4_mean_clusters(spark, d):
    return series.mean_clusters(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query("""WITH v AS (SELECT user_id, value::DOUBLE AS x FROM events WHERE value IS NOT NULL), p AS (SELECT user_id, x, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS nx FROM v),
b AS (SELECT user_id, nx - x AS gap, (x + nx) / 2 AS threshold FROM p WHERE nx - x >= 5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY nx - x DESC, x) = 1)
SELECT user_id, round(gap, 6) AS gap, round(threshold, 6) AS threshold, count(*) FILTER (x <= threshold) AS below, count(*) FILTER (x > threshold) AS above FROM v JOIN b USING (user_id) GROUP BY user_id, gap, threshold""")
def w6_largest_gap(spark, d):
    return series.largest_gap(table(spark, d, "events"), "user_id", "value").withColumns({"gap": F.round("gap", 6), "threshold": F.round("threshold", 6)})


@query("""WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM c GROUP BY pos),
z AS (SELECT vec_id, pos, CASE WHEN s > 0 THEN abs((x - m) / s) ELSE 0 END AS z FROM c JOIN s USING (pos)), r AS (SELECT vec_id, z FROM z QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, pos) <= 3)
SELECT vec_id, round(avg(z), 4) AS score FROM r GROUP BY vec_id""")
def s32_top_patches(spark, d):
    return audit.top_patches(table(spark, d, "embeddings"), ["vec_id"], "embedding", 3).select("vec_id", F.round("score", 4).alias("score"))


@query("""SELECT user_id, round(max(CASE WHEN 90.0 > 10.0 THEN least(greatest((value - 10.0) / 80.0, 0), 1) END), 6) AS score, count(*) FILTER (least(greatest((value - 10.0) / 80.0, 0), 1) > 0.5) AS suspects, arg_max(event_id, struct_pack(v := value, e := -event_id)) AS worst FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def a25_anchored_scores(spark, d):
    e = table(spark, d, "events").filter(F.col("value").isNotNull()).withColumn("s", scores.anchored(F.col("value").cast("double"), F.lit(10.0), F.lit(90.0), F.lit(50.0)))
    return e.groupBy("user_id").agg(F.round(F.max("s"), 6).alias("score"), F.count_if(F.col("s") > 0.5).alias("suspects"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("worst"))


_GRADE = "CASE event_type WHEN 'view' THEN 0.20 WHEN 'click' THEN 0.40 WHEN 'purchase' THEN 0.70 WHEN 'error' THEN 0.90 ELSE 0.40 END"
_GRADES = {"view": 0.20, "click": 0.40, "purchase": 0.70, "error": 0.90}


@query(f"WITH e AS (SELECT user_id, {_GRADE}::DOUBLE AS p FROM (SELECT DISTINCT user_id, event_type FROM events)) SELECT user_id, round(1 - product(1 - p), 3) AS score FROM e GROUP BY user_id")
def a24_noisy_or(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type").distinct()
    return e.groupBy("user_id").agg(F.round(scores.noisy_or(scores.grade_probability(F.col("event_type"), _GRADES)), 3).alias("score"))


_WEIGHTS = {"purchases": 0.5, "errors": 0.3, "views": 0.2}


@query("""WITH f AS (SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 1.0 END AS purchases, least(count(*) FILTER (event_type = 'error') / 10.0, 1.0) AS errors, least(count(*) FILTER (event_type = 'view') / 20.0, 1.0) AS views FROM events GROUP BY user_id),
s AS (SELECT user_id, coalesce(purchases, 0) * 0.5 + errors * 0.3 + views * 0.2 AS x FROM f)
SELECT user_id, round(x, 4) AS score, CASE WHEN x >= 0.75 THEN 'HIGH' WHEN x >= 0.55 THEN 'MIDDLE' ELSE 'LOW' END AS band FROM s""")
def a23_weighted_fusion(spark, d):
    n = lambda t: F.count_if(F.col("event_type") == t)
    f = table(spark, d, "events").groupBy("user_id").agg(F.when(n("purchase") > 0, 1.0).alias("purchases"), F.least(n("error") / 10.0, F.lit(1.0)).alias("errors"), F.least(n("view") / 20.0, F.lit(1.0)).alias("views"))
    x = scores.weighted_sum(_WEIGHTS)
    return f.select("user_id", F.round(x, 4).alias("score"), scores.band(x, [(0.55, "MIDDLE"), (0.75, "HIGH")], "LOW").alias("band"))


def _labelled(spark, d):
    return table(spark, d, "events").select(F.when(F.col("event_type").isin("purchase", "error"), 1).otherwise(0).alias("y"), F.round("value", 1).alias("s"))


_LAB = "l AS (SELECT CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS y, round(value, 1) AS s FROM events WHERE value IS NOT NULL)"


@query(f"WITH {_LAB}, c AS (SELECT count(*) FILTER (y = 1 AND s > 50) AS tp, count(*) FILTER (y = 0 AND s > 50) AS fp, count(*) FILTER (y = 1 AND s <= 50) AS fn, count(*) FILTER (y = 0 AND s <= 50) AS tn FROM l) SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c")
def a35_confusion(spark, d):
    rows = _labelled(spark, d).withColumn("p", (F.col("s") > 50).cast("int"))
    return calibration.confusion(rows, "y", "p")


_CURVE = f"WITH {_LAB}, c AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM l GROUP BY s), t AS (SELECT s AS threshold, p, n, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS positives, sum(n) OVER () AS negatives FROM c)"


@query(_CURVE + " SELECT threshold, round(tp / positives - fp / negatives, 6) AS j FROM t ORDER BY j DESC, threshold DESC LIMIT 1")
def a35_youden(spark, d):
    return calibration.youden(_labelled(spark, d), "y", "s")


@query(_CURVE + " SELECT round(sum(n * (tp - p) + 0.5 * n * p) / (max(positives) * max(negatives)), 6) AS auc FROM t")
def a35_auc(spark, d):
    return calibration.auc(_labelled(spark, d), "y", "s")


@query(f"WITH {_LAB} SELECT round(quantile_cont(s, 0.9), 6) AS value FROM l WHERE y = 0")
def a35_p90(spark, d):
    return calibration.percentile_of(_labelled(spark, d).filter("y = 0"), "s", 0.9)


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s34_json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT p_partkey FROM part ORDER BY md5('42:' || p_partkey::VARCHAR), p_partkey LIMIT 100")
def smp1_seeded_sample(spark, d):
    return audit.seeded_sample(table(spark, d, "part").select("p_partkey"), "p_partkey", 42, 100)


@query("""SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id::VARCHAR), event_id) AS r FROM events) WHERE (event_type = 'error' AND r <= 15) OR (event_type IN ('view', 'click') AND r <= 25)""")
def smp1_quota_sample(spark, d):
    return audit.quota_sample(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type", 42, {"error": 15, "view": 25, "click": 25})


_KEYWORDS = """kw(k, word, w) AS (VALUES ('CIN', 'carte nationale d identite', 4.0), ('CIN', 'carte d identite', 3.0), ('CIN', 'numero d identifiant', 3.0), ('CIN', 'date de naissance', 0.75), ('CIN', 'lieu de naissance', 0.75),
('RELEVE_BANCAIRE', 'releve de compte bancaire', 5.0), ('RELEVE_BANCAIRE', 'releve de compte', 4.0), ('RELEVE_BANCAIRE', 'solde depart', 3.0), ('RELEVE_BANCAIRE', 'nouveau solde', 3.0), ('RELEVE_BANCAIRE', 'solde final', 2.5),
('RELEVE_BANCAIRE', 'total des mouvements', 3.0), ('RELEVE_BANCAIRE', 'total mouvements', 2.5), ('RIB', 'releve d identite bancaire', 5.0), ('RIB', 'identite bancaire', 4.0), ('RIB', 'references bancaires', 3.0),
('RIB', 'intitule du compte', 2.5), ('RIB', 'titulaire du compte', 2.0), ('RIB', 'code banque', 1.5), ('RIB', 'code swift', 2.0), ('RIB', 'bic', 1.0), ('RIB', 'iban', 1.0), ('BULLETIN_SALAIRE', 'bulletin de paie', 5.0),
('BULLETIN_SALAIRE', 'bulletin de salaire', 5.0), ('BULLETIN_SALAIRE', 'salaire brut', 2.5), ('BULLETIN_SALAIRE', 'salaire net imposable', 2.5), ('BULLETIN_SALAIRE', 'net a payer', 1.5), ('BULLETIN_SALAIRE', 'cotisation cnss', 1.5),
('BULLETIN_SALAIRE', 'retenues', 1.0), ('BULLETIN_SALAIRE', 'gains', 1.0), ('ATTESTATION_TRAVAIL', 'attestation de travail', 5.0), ('ATTESTATION_TRAVAIL', 'nous soussignes', 2.5), ('ATTESTATION_TRAVAIL', 'nous soussigne', 2.5),
('ATTESTATION_TRAVAIL', 'certifions que', 2.0), ('ATTESTATION_TRAVAIL', 'date d embauche', 1.5), ('ATTESTATION_TRAVAIL', 'poste occupe', 1.5), ('QUITTANCE', 'avis de facturation', 4.0), ('QUITTANCE', 'periode de consommation', 2.5),
('QUITTANCE', 'date limite de paiement', 1.5), ('QUITTANCE', 'net a payer', 1.0), ('QUITTANCE', 'lydec', 3.0), ('QUITTANCE', 'amendis', 3.0), ('QUITTANCE', 'maroc telecom', 3.0), ('QUITTANCE', 'electricite', 0.75), ('QUITTANCE', 'consommation', 0.75))"""
_LOWER = "trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {_KEYWORDS}, d AS (SELECT doc_id, {_LOWER} AS t FROM documents), s AS (SELECT doc_id, k, sum(CASE WHEN contains(t, word) THEN w ELSE 0 END)::DOUBLE AS v FROM d, kw GROUP BY doc_id, k),
r AS (SELECT doc_id, k, v, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, k) AS r, sum(v) OVER (PARTITION BY doc_id) AS total FROM s),
b AS (SELECT doc_id, max(total) AS total, max(CASE WHEN r = 1 THEN k END) AS k, max(CASE WHEN r = 1 THEN v END) AS v1, max(CASE WHEN r = 2 THEN v END) AS v2 FROM r GROUP BY doc_id),
c AS (SELECT *, v1 >= 2.0 AND round(v1 - v2, 4) >= 0.75 AS known FROM b)
SELECT doc_id, CASE WHEN known THEN k ELSE 'UNKNOWN' END AS doc_class, v1 AS class_score, round(v1 - v2, 4) AS class_margin, CASE WHEN known THEN round(v1 / greatest(total, v1, 1.0), 4) ELSE 0.0 END AS class_confidence FROM c""")
def s27_keyword_classes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.lower_words(F.col("text")).alias("norm"))
    return classify.classify(docs, "norm").select("doc_id", "doc_class", "class_score", "class_margin", "class_confidence")


@query(f"""WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents), h AS (SELECT doc_id, contains(t, 'cih bank')::INT + contains(t, 'cihmamc')::INT + contains(t, 'cih')::INT AS c, contains(t, 'attijariwafa')::INT + contains(t, 'attijari')::INT + contains(t, 'bcmamamc')::INT AS a FROM d)
SELECT doc_id, CASE WHEN c > a THEN 'CIH' WHEN a > c THEN 'ATTIJARI' ELSE 'UNKNOWN' END AS bank, CASE WHEN c <> a THEN round(greatest(a, c) / (a + c), 4) ELSE 0.0 END AS confidence FROM h""")
def s28_bank_keywords(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(T.lower_words(F.col("text")), F.lit("")).alias("norm"))
    return docs.select("doc_id", classify.detect_bank(F.col("norm")).alias("b")).select("doc_id", "b.bank", "b.confidence")


@query("""WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY l_orderkey), j AS (SELECT o_orderkey, o_totalprice AS r, v FROM orders LEFT JOIN s ON o_orderkey = l_orderkey), x AS (SELECT o_orderkey, abs(v - r) / greatest(abs(r), 1.0) AS x FROM j)
SELECT o_orderkey, CASE WHEN x IS NULL THEN NULL WHEN x <= 0.02 THEN 0.0::DOUBLE WHEN x <= 0.05 THEN 0.25 WHEN x <= 0.10 THEN 0.5 WHEN x <= 0.20 THEN 0.75 ELSE 1.0 END AS score FROM x""")
def s22_amount_ladder(spark, d):
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    joined = table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(sums, "o_orderkey", "left")
    return compare.amount_scores(joined, "v", "o_totalprice").select("o_orderkey", "score")


@query("""WITH j AS (SELECT l_orderkey, l_linenumber, abs(datediff('day', o_orderdate::DATE, l_shipdate::DATE)) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN n IS NULL THEN NULL WHEN n <= 0 THEN 0.0::DOUBLE WHEN n <= 31 THEN 0.25 WHEN n <= 365 THEN 0.6 ELSE 1.0 END AS score FROM j""")
def s23_date_ladder(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(o, "l_orderkey")
    days = F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")))
    return rows.select("l_orderkey", "l_linenumber", scores.at_most(days, scores.DATE_LADDER).alias("score"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders), t AS (SELECT o_custkey AS k, 'TOTAL' AS c, CASE WHEN max(o_totalprice) > 400000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM c GROUP BY 1 UNION ALL SELECT o_custkey, 'COUNT', CASE WHEN count(*) >= 5 THEN CASE WHEN count(*) > 15 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END END FROM c GROUP BY 1)
SELECT k AS custkey, round(max(s), 4) AS score, count(*) AS n_checks, count(s) AS n_available, coalesce(string_agg(CASE WHEN s > 0 THEN c END, '|' ORDER BY c), '') AS triggered FROM t GROUP BY k""")
def a9_signal(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.max("o_totalprice").alias("m"), F.count("*").alias("n"))
    total = o.select("custkey", F.lit("TOTAL").alias("check"), F.when(F.col("m") > 400000, 1.0).otherwise(0.0).alias("s"))
    count = o.select("custkey", F.lit("COUNT").alias("check"), F.when(F.col("n") >= 5, F.when(F.col("n") > 15, 0.6).otherwise(0.0)).alias("s"))
    return compare.signal(total.unionByName(count), "custkey", "check", "s")
