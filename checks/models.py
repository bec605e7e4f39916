"""Models, scoring, explanation and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.history import as_of
from checks.parsing import now
from checks.registry import ANOMALIES, LABELLED_SCORES, query
from checks.windows import parsed_lines
from logvane.functions import scalar
from logvane.operators import dbscan, ensemble, evaluate, explain, gmm, iforest, vectors
from logvane.plans import alerting, scoring, training
from logvane.session import stage
from logvane.sources import derived

EPS, MIN_SAMPLES = 1.1771501004695892, 6
EMB = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"


def embeddings(spark, sf):
    return derived.read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


@query(
    "scale_population",
    f"""WITH c AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM ({EMB})), s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS d FROM c GROUP BY dim)
 SELECT vec_id AS id, CAST(dim AS INTEGER) AS dim, round((v - m) / CASE WHEN d > 0 THEN d ELSE 1 END, 6) AS scaled FROM c JOIN s USING (dim)""",
)
def scale_population(spark, sf):
    rows = embeddings(spark, sf)
    z = vectors.scaled(F.col("features"), vectors.fit_scaler(rows))
    return rows.select("id", F.posexplode(z).alias("dim", "z")).select("id", "dim", F.round("z", 6).alias("scaled"))


CENTRES = f"SELECT label, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(v) AS m FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM ({EMB})) GROUP BY label, dim) GROUP BY label"


@query(
    "nearest_centroid",
    f"""SELECT vec_id AS id, arg_min(c.label, list_distance(x, c))::BIGINT AS nearest, round(min(list_distance(x, c)), 6) AS distance,
 CASE WHEN min(list_distance(x, c)) <= 2 * 0.45 THEN arg_min(c.label, list_distance(x, c))::BIGINT ELSE -1 END AS cluster FROM ({EMB}) e, ({CENTRES}) c GROUP BY vec_id""",
)
def nearest_centroid(spark, sf):
    rows = embeddings(spark, sf)
    means = dbscan.centroids(rows.withColumnRenamed("label", "cluster")).collect()
    found = dbscan.with_nearest(rows, [(r["cluster"], list(r["centroid"])) for r in means])
    return found.select("id", "nearest", F.round("distance", 6).alias("distance"), dbscan.assigned(0.45).cast("long").alias("cluster"))


DBSCAN_SQL = f"""WITH RECURSIVE near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ({EMB}) a, ({EMB}) b WHERE list_distance(a.x, b.x) <= {EPS}),
 core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
 edge AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
 reach(id, label) AS (SELECT id, id FROM core UNION SELECT e.b, r.label FROM reach r JOIN edge e ON e.a = r.id WHERE r.label < e.b),
 cores AS (SELECT id, min(label) AS label FROM reach GROUP BY id),
 labels AS (SELECT vec_id AS id, coalesce((SELECT label FROM cores c WHERE c.id = e.vec_id), (SELECT min(c.label) FROM near n JOIN cores c ON c.id = n.b WHERE n.a = e.vec_id), -1) AS cluster FROM embeddings e)"""


def clustered(spark, sf):
    return dbscan.dbscan(embeddings(spark, sf), EPS, MIN_SAMPLES, block=128)


@query("dbscan_labels", f"{DBSCAN_SQL} SELECT id, cluster FROM labels")
def dbscan_labels(spark, sf):
    return clustered(spark, sf).select("id", "cluster")


@query("dbscan_summary", f"{DBSCAN_SQL} SELECT count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS clusters, count_if(cluster = -1)::BIGINT AS noise FROM labels")
def dbscan_summary(spark, sf):
    return dbscan.summary(clustered(spark, sf))


@query(
    "cluster_centroids",
    f"{DBSCAN_SQL} SELECT cluster, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS mean FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM labels l JOIN ({EMB}) e ON e.vec_id = l.id WHERE cluster >= 0) GROUP BY ALL",
)
def cluster_centroids(spark, sf):
    means = dbscan.centroids(clustered(spark, sf))
    return means.select("cluster", F.posexplode("centroid").alias("dim", "m")).select("cluster", "dim", F.round("m", 6).alias("mean"))


# model outputs computed from events, to check what is made of them
OUTPUTS = "SELECT event_id AS id, (value - 50) / 100 AS decision, CASE WHEN event_id % 7 = 0 THEN -1 ELSE event_id % 3 END AS cluster, value / 40 AS distance, -value / 5 AS log_likelihood FROM events"
SCORES = f"SELECT id, 1 / (1 + exp(10 * decision)) AS a, CASE WHEN cluster = -1 THEN 0.9::DOUBLE ELSE least(distance / 5, 1) END AS b, CASE WHEN cluster = -1 THEN 0.9::DOUBLE ELSE least(distance / 10, 1) END AS b10, 1 / (1 + exp(0.5 * (log_likelihood + 10))) AS c FROM ({OUTPUTS})"


def outputs(spark, sf):
    return spark.sql(OUTPUTS.replace("FROM events", "FROM {events}"), events=derived.read_table(spark, sf, "events"))


def scores(spark, sf, scale=ensemble.SERVING_DISTANCE):
    return outputs(spark, sf).select(
        "id",
        ensemble.forest_score(F.col("decision")).alias("a"),
        ensemble.cluster_score(F.col("cluster"), F.col("distance"), scale).alias("b"),
        ensemble.mixture_score(F.col("log_likelihood")).alias("c"),
    )


def three():
    return F.col("a"), F.col("b"), F.col("c")


@query("dbscan_score", f"SELECT id, round(b, 9) AS serving, round(b10, 9) AS trained FROM ({SCORES})")
def dbscan_score(spark, sf):
    both = scores(spark, sf).join(scores(spark, sf, ensemble.ENSEMBLE_DISTANCE).select("id", F.col("b").alias("b10")), "id")
    return both.select("id", F.round("b", 9).alias("serving"), F.round("b10", 9).alias("trained"))


@query("ensemble_blend", f"SELECT id, round(0.5::DOUBLE * a + 0.3::DOUBLE * b + 0.2::DOUBLE * c, 9) AS risk_score FROM ({SCORES})")
def ensemble_blend(spark, sf):
    return scores(spark, sf).select("id", F.round(ensemble.blend(three()), 9).alias("risk_score"))


@query("model_agreement", f"SELECT id, CASE WHEN s < 0.1 THEN 'high' WHEN s < 0.2 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT id, sqrt(((a - m) ** 2 + (b - m) ** 2 + (c - m) ** 2) / 3) AS s FROM (SELECT *, (a + b + c) / 3 AS m FROM ({SCORES})))")
def model_agreement(spark, sf):
    return scores(spark, sf).select("id", ensemble.agreement(three()).alias("confidence"))


@query(
    "risk_decision",
    f"""SELECT id, CASE WHEN risk_score >= 0.8 THEN 'high' WHEN risk_score >= 0.6 THEN 'medium' WHEN risk_score >= 0.4 THEN 'low' ELSE 'normal' END AS risk_level,
 CASE WHEN risk_score >= 0.8 THEN 'high' WHEN risk_score >= 0.6 THEN 'medium' WHEN risk_score >= 0.4 THEN 'low' ELSE 'high' END AS confidence,
 CASE WHEN risk_score >= 0.8 THEN 'BLOCK_IP' WHEN risk_score >= 0.6 THEN 'REQUIRE_MFA' WHEN risk_score >= 0.4 THEN 'MONITOR' ELSE 'NO_ACTION' END AS recommended_action, risk_score >= 0.4 AS is_anomaly FROM ({ANOMALIES})""",
)
def risk_decision(spark, sf):
    return derived.anomalies(spark, sf).select("id", alerting.risk_decision().alias("d")).select("id", "d.*")


MIX = gmm.Mixture(np.array([0.5, 0.3, 0.2]), np.array([[20.0, 6.0], [60.0, 12.0], [120.0, 18.0]]), np.array([np.diag([100.0, 9.0]), np.diag([400.0, 16.0]), np.diag([900.0, 25.0])]))
LOG_PARTS = ", ".join(
    f"ln({w}) - 0.5 * ((value - {m[0]}) ** 2 / {c[0][0] + gmm.RIDGE} + (h - {m[1]}) ** 2 / {c[1][1] + gmm.RIDGE}) - ln(2 * pi() * sqrt({c[0][0] + gmm.RIDGE} * {c[1][1] + gmm.RIDGE}))"
    for w, m, c in zip(MIX.weights, MIX.means, MIX.covariances, strict=True)
)
# the far tail has densities below any double, so the parts are added as logarithms
LOG_DENSITY = "list_max(p) + ln(list_sum(list_transform(p, lambda x: exp(x - list_max(p)))))"


@query("gmm_score_diag", f"SELECT event_id AS id, round(1 / (1 + exp(0.5 * ({LOG_DENSITY} + 10))), 6) AS score FROM (SELECT event_id, [{LOG_PARTS}] AS p FROM (SELECT event_id, value::DOUBLE AS value, hour(ts)::DOUBLE AS h FROM events))")
def gmm_score_diag(spark, sf):
    rows = value_hour(spark, sf)
    scored = gmm.with_log_likelihood(rows, MIX)
    return scored.select("id", F.round(ensemble.mixture_score(F.col("log_likelihood")), 6).alias("score"))


def value_hour(spark, sf):
    return derived.read_table(spark, sf, "events").select(F.col("event_id").alias("id"), F.array("value", F.hour("ts").cast("double")).alias("features"))


NAMES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
ITEM = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
CELLS = f"SELECT k, {ITEM}, unnest([{', '.join(NAMES)}]) AS v, unnest([0, 1, 2, 3]) AS i, unnest([{', '.join(repr(n) for n in NAMES)}]) AS name FROM (SELECT *, row_number() OVER () AS k FROM lineitem)"


def items(spark, sf):
    table = derived.spread(derived.read_table(spark, sf, "lineitem"))
    return table.withColumns({"features": F.array(*NAMES), "id": F.col("l_orderkey") * 8 + F.col("l_linenumber")})


def names_of(top):
    return F.array_join(F.transform(top, lambda t: t["name"]), ",")


@query(
    "importance_row",
    f"""SELECT {ITEM}, string_agg(name, ',' ORDER BY round(dev, 9) DESC, i DESC) AS important FROM (SELECT *, abs(v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-10) AS dev FROM ({CELLS}) WINDOW w AS (PARTITION BY k)) GROUP BY k, {ITEM}""",
)
def importance_row(spark, sf):
    deviations = F.transform(explain.own_deviation(F.col("features")), lambda x: F.round(x, 9))
    return items(spark, sf).select(*ITEM.split(", "), names_of(explain.top_features(deviations, NAMES)).alias("important"))


SCALED_CELLS = f"SELECT *, abs(v - avg(v) OVER (PARTITION BY i)) / stddev_pop(v) OVER (PARTITION BY i) AS dev FROM ({CELLS})"


def item_deviations(spark, sf):
    rows = items(spark, sf)
    z = explain.scaled_deviation(vectors.scaled(F.col("features"), vectors.fit_scaler(rows)))
    return rows.withColumn("deviations", F.transform(z, lambda x: F.round(x, 9)))


@query("importance_scaled", f"SELECT {ITEM}, string_agg(name, ',' ORDER BY round(dev, 9) DESC, i DESC) AS important FROM ({SCALED_CELLS}) GROUP BY k, {ITEM}")
def importance_scaled(spark, sf):
    top = explain.top_features(F.col("deviations"), NAMES)
    return item_deviations(spark, sf).select(*ITEM.split(", "), names_of(top).alias("important"))


@query("global_importance", f"SELECT name AS feature, round(avg(dev), 6) AS importance, CAST(row_number() OVER (ORDER BY avg(dev) DESC) AS INTEGER) AS rank FROM ({SCALED_CELLS}) GROUP BY name")
def global_importance(spark, sf):
    found = explain.global_importance(item_deviations(spark, sf), "deviations", NAMES)
    return found.withColumn("importance", F.round("importance", 6))


REASON_ROWS = """SELECT event_id AS id, CAST(hour(ts) AS INTEGER) AS hour_of_day, user_id % 3 = 0 AS is_weekend, event_id % 2 = 0 AS is_business_hours, cast(event_id % 97 as double) / 8 + 0.01 AS login_attempts_per_minute,
 cast(event_id % 53 as double) / 4 + 0.01 AS requests_per_second, cast(event_id % 101 as double) / 100 AS failed_auth_rate, cast(event_id % 5 = 0 as double) AS error_rate_5xx, event_id % 4 = 0 AS is_known_ip, event_id % 6 <> 0 AS is_known_country,
 cast(event_id % 2003 as double) + 0.2 AS geographic_distance_km, user_id % 10 = 0 AS is_privileged_user, event_id % 11 = 0 AS is_sensitive_endpoint, cast(event_id % 9 as double) AS payload_entropy, cast(event_id * 7 % 100000 as double) AS time_since_last_activity_sec"""
TEXTS = (
    "CASE WHEN hour_of_day <= 5 THEN printf('Activity at unusual hour (%d:00)', hour_of_day) END",
    "CASE WHEN is_weekend AND NOT is_business_hours THEN 'Weekend activity outside business hours' END",
    "CASE WHEN login_attempts_per_minute > 5 THEN printf('High login attempt rate (%.1f/min) - potential brute force', login_attempts_per_minute) END",
    "CASE WHEN requests_per_second > 10 THEN printf('High request rate (%.1f/sec) - potential DDoS', requests_per_second) END",
    "CASE WHEN failed_auth_rate > 0.5 THEN printf('High failed authentication rate (%.0f%%)', failed_auth_rate * 100) END",
    "CASE WHEN error_rate_5xx > 0 THEN 'Server error detected (5xx status code)' END",
    "CASE WHEN NOT is_known_ip THEN 'Unknown/untrusted IP address' END",
    "CASE WHEN NOT is_known_country THEN 'Request from unusual country' END",
    "CASE WHEN geographic_distance_km > 1000 THEN printf('Large geographic distance from typical location (%.0f km)', geographic_distance_km) END",
    "CASE WHEN is_privileged_user THEN 'Privileged user access (root/admin)' END",
    "CASE WHEN is_sensitive_endpoint THEN 'Access to sensitive endpoint' END",
    "CASE WHEN payload_entropy > 7 THEN 'High payload entropy - potential encrypted/malicious content' END",
    "CASE WHEN time_since_last_activity_sec > 86400 THEN 'First activity in >24 hours - dormant account activation' END",
)


# the features that deviate most, as the rows name them; one name may stand twice
TOPS = ("payload_entropy", "is_known_ip", "bytes_transferred", "hour_of_day")
TOP_NAMES = "[" + ", ".join(f"(['{"', '".join(TOPS)}'])[CAST((id + {k} * (id % 3)) % 4 AS INTEGER) + 1]" for k in range(4)) + "]"


def reason_sql(rules: str) -> str:
    found = f"SELECT id, {rules} AS r FROM (SELECT id, list_filter([{', '.join(TEXTS)}], lambda t: t IS NOT NULL) AS told FROM ({REASON_ROWS} FROM events))"
    return f"SELECT id, array_to_string(CASE WHEN len(r) = 0 THEN ['Pattern deviates from normal behavior (ensemble detection)'] ELSE r[1:5] END, '; ') AS reasons FROM ({found})"


@query("reasons", reason_sql("told"))
def reasons(spark, sf):
    return reason_rows(spark, sf).select("id", F.array_join(explain.reasons(), "; ").alias("reasons"))


def reason_rows(spark, sf):
    return spark.sql(REASON_ROWS + " FROM {events}", events=derived.read_table(spark, sf, "events"))


ANOMALOUS = f"list_transform(list_filter(list_transform(range(3), lambda i: CASE WHEN i = 0 OR NOT list_contains(({TOP_NAMES})[1:i], ({TOP_NAMES})[i + 1]) THEN ({TOP_NAMES})[i + 1] END), lambda t: t IS NOT NULL), lambda t: 'Anomalous ' || replace(t, '_', ' '))"


@query("reasons_with_top", reason_sql(f"list_concat(told, {ANOMALOUS})"))
def reasons_with_top(spark, sf):
    """The rules' reasons, then the three features that deviate most, each once."""
    names = F.array(*[F.lit(t) for t in TOPS])
    top = F.array(*[F.struct(F.get(names, ((F.col("id") + k * (F.col("id") % 3)) % 4).cast("int")).alias("name")) for k in range(4)])
    rows = reason_rows(spark, sf).withColumn("top", top)
    return rows.select("id", F.array_join(explain.reasons(F.col("top")), "; ").alias("reasons"))


L = f"({LABELLED_SCORES})"


@query(
    "split_stratified",
    f"SELECT id, label, CASE WHEN r < 0.6 THEN 'train' WHEN r < 0.8 THEN 'validation' ELSE 'test' END AS split FROM (SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '-42'), id) - 1) / count(*) OVER (PARTITION BY label) AS r FROM {L})",
)
def split_stratified(spark, sf):
    return evaluate.stratified_split(derived.labelled_scores(spark, sf)).select("id", "label", "split")


SPLIT = f"SELECT *, CASE WHEN r < 0.6 THEN 'train' WHEN r < 0.8 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '-42'), id) - 1) / count(*) OVER (PARTITION BY label) AS r FROM {L})"
PAIRS = (("train", "validation"), ("train", "test"), ("validation", "test"))


@query(
    "leakage_intersect",
    f"WITH s AS ({SPLIT}) "
    + " UNION ALL ".join(
        f"SELECT '{a}-{b}' AS pair, count(*) AS shared FROM (SELECT score FROM s WHERE split = '{a}' INTERSECT SELECT score FROM s WHERE split = '{b}')"
        for a, b in PAIRS
    ),
)
def leakage_intersect(spark, sf):
    """What the parts of the whole table's split have in common: here, scores."""
    split = stage(evaluate.stratified_split(derived.labelled_scores(spark, sf)))
    parts = {name: split.filter(F.col("split") == name) for name, _ in evaluate.SHARES}
    return evaluate.overlap(parts, ["score"])


@query("union_stack", "SELECT event_id, value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events")
def union_stack(spark, sf):
    events = derived.read_table(spark, sf, "events").select("event_id", "value", "event_type")
    stacked = evaluate.stack_labelled(events.filter("event_type <> 'error'"), events.filter("event_type = 'error'"))
    return stacked.drop("event_type")


@query("baseline_majority", f"SELECT label, round(n / sum(n) OVER (), 9) AS accuracy FROM (SELECT label, count(*) AS n FROM {L} GROUP BY label) ORDER BY n DESC, label LIMIT 1")
def baseline_majority(spark, sf):
    return evaluate.majority(derived.labelled_scores(spark, sf)).withColumn("accuracy", F.round("accuracy", 9))


CONF = f"SELECT count_if(label = 0 AND NOT p)::BIGINT AS tn, count_if(label = 0 AND p)::BIGINT AS fp, count_if(label = 1 AND NOT p)::BIGINT AS fn, count_if(label = 1 AND p)::BIGINT AS tp FROM (SELECT label, score >= 0.6 AS p FROM {L})"


@query(
    "confusion_metrics",
    f"SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(fp / (fp + tn), 9) AS fpr, round(fn / (fn + tp), 9) AS fnr FROM ({CONF})",
)
def confusion_metrics(spark, sf):
    found = evaluate.confusion(derived.labelled_scores(spark, sf), F.col("score") >= 0.6)
    return found.select("tn", "fp", "fn", "tp", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")])


ROC = f"SELECT (sum(r) - any_value(n1) * (any_value(n1) + 1) / 2) / (any_value(n1) * any_value(n0)) AS roc_auc FROM (SELECT label, avg(rn) OVER (PARTITION BY score) AS r, count_if(label = 1) OVER () AS n1, count_if(label = 0) OVER () AS n0 FROM (SELECT *, row_number() OVER (ORDER BY score) AS rn FROM {L})) WHERE label = 1"
PR = f"""SELECT sum((rec - coalesce(prec_rec, 0)) * (p + coalesce(prev_p, 1)) / 2) AS pr_auc FROM (SELECT p, rec, lag(p) OVER (ORDER BY score DESC) AS prev_p, lag(rec) OVER (ORDER BY score DESC) AS prec_rec FROM
 (SELECT score, tp / (tp + fp) AS p, tp / max(tp) OVER () AS rec FROM (SELECT score, sum(a) OVER w AS tp, sum(b) OVER w AS fp FROM (SELECT score, count_if(label = 1)::DOUBLE AS a, count_if(label = 0)::DOUBLE AS b FROM {L} GROUP BY score) WINDOW w AS (ORDER BY score DESC))))"""


@query("roc_auc", f"SELECT round(roc_auc, 9) AS roc_auc FROM ({ROC})")
def roc_auc(spark, sf):
    return evaluate.roc_auc(derived.labelled_scores(spark, sf)).withColumn("roc_auc", F.round("roc_auc", 9))


@query("pr_auc", f"SELECT round(pr_auc, 9) AS pr_auc FROM ({PR})")
def pr_auc(spark, sf):
    return evaluate.pr_auc(derived.labelled_scores(spark, sf)).withColumn("pr_auc", F.round("pr_auc", 9))


@query(
    "evaluation_report",
    f"SELECT 'all' AS dataset, tn + fp + fn + tp AS n_samples, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round((SELECT roc_auc FROM ({ROC})), 9) AS roc_auc, round((SELECT pr_auc FROM ({PR})), 9) AS pr_auc FROM ({CONF})",
)
def evaluation_report(spark, sf):
    found = evaluate.report(derived.labelled_scores(spark, sf), 0.6, "all")
    return found.select("dataset", "n_samples", *[F.round(c, 9).alias(c) for c in ("accuracy", "roc_auc", "pr_auc")])


@query(
    "model_vs_baseline",
    f"SELECT round((tp + tn) / (tp + tn + fp + fn) - greatest(tn + fp, tp + fn) / (tp + tn + fp + fn), 9) AS accuracy_gain, round(2 * tp / (2 * tp + fp + fn), 9) AS f1_gain FROM ({CONF})",
)
def model_vs_baseline(spark, sf):
    rows = derived.labelled_scores(spark, sf)
    gain = evaluate.gain_over_majority(evaluate.confusion(rows, F.col("score") >= 0.6), rows)
    return gain.select(*[F.round(c, 9).alias(c) for c in gain.columns])


# what a stored record without these features counts as
DEFAULT_CELLS = (
    "CAST(hour(ts) AS DOUBLE)", "2.0", "CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END", "1.0", "0.5", "0.5", "5.0", "3.0", "0.05",
    "0.02", "0.01", "10.0", "1.0", "1.0", "round(ln(1001), 9)", "60.0", "300.0", "value", "0.0", "0.0", "1.0",
)


@query(
    "json_features_defaults",
    "SELECT event_id AS id, " + ", ".join(f"({cell})::DOUBLE AS f{i}" for i, cell in enumerate(DEFAULT_CELLS)) + " FROM events",
)
def json_features_defaults(spark, sf):
    events = derived.read_table(spark, sf, "events")
    stored = F.to_json(F.struct(F.hour("ts").alias("hour_of_day"), (F.col("event_id") % 2 == 0).alias("is_weekend"), F.col("value").alias("payload_entropy")))
    rows = training.matrix_from_json(events.select(F.col("event_id").alias("id"), stored.alias("parsed_fields")))
    return rows.select("id", *[F.round(F.col("features")[i], 9).alias(f"f{i}") for i in range(len(DEFAULT_CELLS))])


@query("iforest_fit_score")
def iforest_fit_score(spark, sf):
    rows = items(spark, sf).select("id", "features")
    n = rows.count()
    forest = iforest.Forest.collect(iforest.grow_forest(rows, 100), min(iforest.SAMPLE, n))
    scored = iforest.with_forest_score(rows, forest)
    offset = scored.agg(F.percentile_approx("if_raw", 0.03, 100_000)).first()[0]
    return scored.select("id", ensemble.forest_score(F.col("if_raw") - offset).alias("isolation_forest_score"))


@query("gmm_fit_score")
def gmm_fit_score(spark, sf):
    rows = value_hour(spark, sf)
    mixture = gmm.fit_mixture(rows, k=3)
    return gmm.with_log_likelihood(rows, mixture).select("id", ensemble.mixture_score(F.col("log_likelihood")).alias("gmm_score"))


@query("gmm_bic")
def gmm_bic(spark, sf):
    rows = value_hour(spark, sf)
    return gmm.bic(rows, gmm.fit_mixture(rows, k=3))


def stored_features(spark, sf):
    """The `logs` table a retraining reads: feature JSON and a risk score for every event."""
    rows = scoring.feature_rows(parsed_lines(spark, sf), auth_rule="extended")
    fields = F.to_json(F.struct(*[F.col(n) for n in scalar.FEATURE_NAMES]))
    return rows.select(
        F.col("line_id").alias("id"),
        F.col("timestamp").cast("timestamp_ntz").alias("created_at"),
        fields.alias("parsed_fields"),
        (F.pmod(F.xxhash64("line_id"), F.lit(1000)) / 1000).alias("risk_score"),
    )


_models: dict[tuple[str, str], ensemble.Models] = {}


def trained(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        _models[key] = training.retrain(
            stage(stored_features(spark, sf)),
            as_of(),
            "v1",
            min_rows=100,  # the smallest tables have fewer than the job's 1 000
        )
    return _models[key]


@query("retrain_job")
def retrain_job(spark, sf):
    models = trained(spark, sf)
    cells = [(k, float(v)) for k, v in sorted(models.notes.items())]
    return spark.createDataFrame([*cells, ("offset", models.offset)], "name string, value double")


@query("score_pipeline")
def score_pipeline(spark, sf):
    """Raw lines of all sources to scored and explained events."""
    found = scoring.analyze(derived.lines(spark, sf), trained(spark, sf), now(), F.lit(2024), auth_rule="extended")
    return found.select(
        "log_id", "line_id", "source", "source_ip", "event_type", "isolation_forest_score", "dbscan_score", "gmm_score", "risk_score", "risk_level", "confidence", "recommended_action", "is_anomaly",
        F.array_join("reasons", "; ").alias("reasons"),
    )
