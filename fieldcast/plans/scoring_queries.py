"""Queries on forecasts, scores, covariograms, residual tests and moments, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast.functions import vectors as V
from fieldcast.operators import archive as A
from fieldcast.operators import covariogram as C
from fieldcast.operators import moments as G
from fieldcast.operators import scoring as S
from fieldcast.operators import whiteness as T
from fieldcast.plans.archive_queries import CUT_EV, CUT_LI, gap_calendar
from fieldcast.plans.panels import event_panel, fixed, item_panel, table, trajectory, with_sql
from fieldcast.sources.stages import stored

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(df, *cols):
    return df.withColumns({c: fixed(c, 6) for c in cols})


H = 4
_M = "round(sqrt(avg(e * e)) + 3e-8, 6) AS rmse, round(avg(abs(e)) + 3e-8, 6) AS mae, round(avg(e) + 3e-8, 6) AS bias, round(sqrt(greatest(avg(e * e) - avg(e) * avg(e), 0)) + 3e-8, 6) AS ubrmse"
_METRICS = ("rmse", "mae", "bias", "ubrmse")
_SPLIT = f"CASE WHEN date < DATE '{CUT_EV}' THEN 'train' ELSE 'test' END"
#: Origins are the observed test days; pe has the errors of persistence, ce those of climatology.
_PE = f""", og AS (SELECT field, date FROM ev_cal WHERE observed AND date >= DATE '{CUT_EV}'),
ld AS (SELECT unnest(generate_series(1, {H})) AS lead),
pe AS (SELECT a.field, a.date AS origin, CAST(lead AS INT) AS lead, a.pixel, CAST(a.date + CAST(lead AS INT) AS DATE) AS target, a.value AS pred, b.value AS value, a.value - b.value AS e
 FROM ev a JOIN og USING (field, date), ld, ev b WHERE b.field = a.field AND b.pixel = a.pixel AND b.date = a.date + CAST(lead AS INT)),
cm AS (SELECT field, pixel, avg(value) AS pred FROM ev WHERE date < DATE '{CUT_EV}' GROUP BY ALL),
ce AS (SELECT o.field, o.date AS origin, CAST(lead AS INT) AS lead, b.pixel, cm.pred - b.value AS e FROM og o, ld, ev b JOIN cm USING (field, pixel) WHERE b.field = o.field AND b.date = o.date + CAST(lead AS INT))"""


def _origins(spark, sf, p):
    return A.split_by_date(A.calendar(p), CUT_EV).where("observed and split = 'test'")


def persistence_errors(spark, sf):
    p = event_panel(spark, sf)
    return S.with_truth(S.persistence(p, _origins(spark, sf, p), H), p)


def climatology_errors(spark, sf):
    p = event_panel(spark, sf)
    return S.with_truth(S.climatology(p, A.split_by_date(A.calendar(p), CUT_EV), _origins(spark, sf, p), H), p)


@query(with_sql("ev ev_days ev_cal", _PE + f" SELECT 'persistence' AS variant, lead, {_M}, count(DISTINCT (field, origin)) AS n_origins FROM pe GROUP BY lead"))
def horizon_scores(spark, sf):
    """Persistence of a masked daily panel scored by lead: the flagship query."""
    return _r(S.horizon_scores(persistence_errors(spark, sf)), *_METRICS)


@query(with_sql("ev ev_days ev_cal", _PE + f" SELECT 'climatology' AS variant, lead, {_M}, count(DISTINCT (field, origin)) AS n_origins FROM ce GROUP BY lead"))
def climatology_scores(spark, sf):
    return _r(S.horizon_scores(climatology_errors(spark, sf)), *_METRICS)


@query(with_sql("ev ev_days ev_cal", _PE + f""", sc AS (SELECT 'persistence' AS variant, lead, {_M}, count(DISTINCT (field, origin)) AS n_origins FROM pe GROUP BY lead UNION ALL SELECT 'climatology', lead, {_M}, count(DISTINCT (field, origin)) FROM ce GROUP BY lead)
SELECT sc.*, rank FROM sc JOIN (SELECT variant, row_number() OVER (ORDER BY ubrmse NULLS LAST, variant) AS rank FROM sc WHERE lead = 1) USING (variant)"""))
def compare_methods(spark, sf):
    return _r(S.compare_methods([S.horizon_scores(persistence_errors(spark, sf)), S.horizon_scores(climatology_errors(spark, sf))]), *_METRICS)


@query(with_sql("ev ev_days ev_cal", _PE + f" SELECT field, 'persistence' AS variant, lead, pixel, {_M}, count(e) AS n FROM pe GROUP BY field, lead, pixel"))
def pixel_errors(spark, sf):
    return _r(S.pixel_errors(persistence_errors(spark, sf)), *_METRICS)


@query(with_sql("ev ev_days ev_cal", _PE + """, px AS (SELECT field, lead, pixel, unnest([{'metric': 'rmse', 'score': a}, {'metric': 'mae', 'score': b}]) AS x FROM (SELECT field, lead, pixel, round(sqrt(avg(e * e)), 9) AS a, round(avg(abs(e)), 9) AS b FROM pe GROUP BY field, lead, pixel))
SELECT field, 'persistence' AS variant, lead, x.metric AS metric, arg_min(pixel, (x.score, pixel)) AS best, arg_max(pixel, (x.score, -pixel)) AS worst FROM px GROUP BY field, lead, x.metric"""))
def extreme_pixels(spark, sf):
    return S.extreme_pixels(S.pixel_errors(persistence_errors(spark, sf)))


@query(with_sql("ev ev_days ev_cal", _PE + """, f AS (SELECT lead, target, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(e) AS bias, sqrt(greatest(avg(e * e) - avg(e) * avg(e), 0)) AS ubrmse FROM pe GROUP BY ALL)
SELECT lead, count(*) AS n_frames, round(avg(rmse) + 3e-8, 6) AS rmse, round(avg(mae) + 3e-8, 6) AS mae, round(avg(bias) + 3e-8, 6) AS bias, round(avg(ubrmse) + 3e-8, 6) AS ubrmse FROM f GROUP BY lead"""))
def sequence_scores(spark, sf):
    return _r(S.sequence_scores(persistence_errors(spark, sf), ["lead"]), *_METRICS)


@query(with_sql("ev ev_days ev_cal", _PE + " SELECT lead, round(1 - sum(e * e) / (var_pop(value) * count(value) + 1e-12) + 3e-8, 6) AS r2, round(avg(0.5 * (ln(greatest(100.0, 1e-8) * 6.283185307179586) + e * e / 100.0)) + 3e-8, 6) AS nll, round(covar_pop(pred, value) / (stddev_pop(pred) * stddev_pop(value) + 1e-12) + 3e-8, 6) AS similarity FROM pe GROUP BY lead"))
def fit_measures(spark, sf):
    e = persistence_errors(spark, sf)
    got = e.groupBy("lead").agg(S.r_squared(F.col("value"), F.col("error")).alias("r2"), S.gaussian_nll(F.col("error"), F.lit(100.0)).alias("nll"), S.centred_correlation(F.col("pred"), F.col("value")).alias("similarity"))
    return _r(got, "r2", "nll", "similarity")


@query(with_sql("ev ev_days ev_cal", _PE + " SELECT 'persistence' AS variant, lead, round(avg((abs(e) <= 1.96 * (10 + lead))::INT) + 3e-8, 6) AS coverage, round(avg(1.96 * (10 + lead)) + 3e-8, 6) AS half_width FROM pe GROUP BY lead"))
def interval_coverage(spark, sf):
    return _r(S.interval_coverage(persistence_errors(spark, sf), F.lit(10.0) + F.col("lead"), 1.96), "coverage", "half_width")


@query(with_sql("ev ev_days ev_cal", _PE + """, px AS (SELECT field, pixel, lead, sqrt(avg(e * e)) AS rmse FROM pe GROUP BY ALL),
sl AS (SELECT field, pixel, max(rmse) FILTER (lead = 1) AS rmse1, regr_slope(rmse, lead) AS slope FROM px GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY round(rmse1, 9) DESC NULLS LAST, pixel) AS rank FROM sl),
mv AS (SELECT field, pixel, avg(abs(value - pred)) AS move1 FROM pe WHERE lead = 1 GROUP BY ALL)
SELECT field, pixel, round(rmse1 + 3e-8, 6) AS rmse1, round(slope + 3e-8, 6) AS slope, rank, round(move1 + 3e-8, 6) AS move1, CASE WHEN move1 > 0.5 * rmse1 THEN 'event' WHEN abs(slope) < 0.1 * rmse1 THEN 'representation' ELSE 'dynamics' END AS verdict FROM tp LEFT JOIN mv USING (field, pixel) WHERE rank <= 5"""))
def worst_pixels(spark, sf):
    return _r(S.worst_pixels(persistence_errors(spark, sf), event_panel(spark, sf)), "rmse1", "slope", "move1")


@query(with_sql("ev ev_days ev_cal", _PE + """, s AS (SELECT lead, avg(e) AS bias FROM pe GROUP BY lead)
SELECT 'persistence' AS variant, 0.25 AS encode_bias, round(max(bias) FILTER (lead = 1) - 0.25 + 3e-8, 6) AS dynamics_bias, round(regr_slope(bias, lead) + 3e-8, 6) AS drift, CASE WHEN 0.25 >= abs(max(bias) FILTER (lead = 1) - 0.25) THEN 'encode' ELSE 'dynamics' END AS binding FROM s"""))
def bias_attribution(spark, sf):
    encode = spark.range(1).select(F.lit(0.25).alias("encode_bias"))
    return _r(S.bias_attribution(S.horizon_scores(persistence_errors(spark, sf)), encode), "dynamics_bias", "drift")


@query(with_sql("ev ev_days ev_cal", _PE + " SELECT field, pixel, round(avg(e * e) + 3e-8, 6) AS variance, round(avg(e) + 3e-8, 6) AS bias FROM ce WHERE lead = 1 GROUP BY ALL"))
def representation_variance(spark, sf):
    e = climatology_errors(spark, sf).where("lead = 1").withColumnRenamed("error", "residual")
    return _r(S.representation_variance(e), "variance", "bias")


@query(with_sql("ev ev_days ev_cal", _PE + """, d AS (SELECT field, target, 1 - sum(e * e) / (var_pop(value) * count(value) + 1e-12) AS r2, sum(e * e) AS ss, count(*) AS n FROM pe WHERE lead = 1 GROUP BY ALL)
SELECT field, round(quantile_cont(r2, 0.5) + 3e-8, 6) AS r2, round(sqrt(sum(ss) / sum(n)) + 3e-8, 6) AS rmse FROM d GROUP BY field"""))
def reconstruction_quality(spark, sf):
    e = persistence_errors(spark, sf).where("lead = 1").select("field", F.col("target").alias("date"), "value", F.col("error").alias("residual"))
    return _r(S.reconstruction(e), "r2", "rmse")


@query(with_sql("ev ev_days ev_cal", _PE + " SELECT field, round(sqrt(avg(e * e) FILTER (lead <= 2)) + 3e-8, 6) AS fit_rmse, round(sqrt(avg(e * e) FILTER (lead > 2)) + 3e-8, 6) AS holdout_rmse, round(sqrt(avg(e * e) FILTER (lead > 2)) - sqrt(avg(e * e) FILTER (lead <= 2)) + 3e-8, 6) AS gap FROM pe GROUP BY field"))
def holdout_errors(spark, sf):
    e = persistence_errors(spark, sf).select("field", F.col("error").alias("residual"), F.when(F.col("lead") <= 2, "fit").otherwise("holdout").alias("part"))
    return _r(S.holdout_errors(e), "fit_rmse", "holdout_rmse", "gap")


@query("SELECT p_partkey, round(2.0 * pow(rho, h) + 0.5 * CASE WHEN abs(rho - 1) < 1e-6 THEN h ELSE (pow(rho, h) - 1) / (rho - 1) END + 3e-8, 6) AS bound FROM (SELECT p_partkey, 0.9 + (p_size % 5) * 0.05 AS rho, 1 + p_partkey % 6 AS h FROM part)")
def open_loop_bound(spark, sf):
    rho, h = F.lit(0.9) + (F.col("p_size") % 5) * 0.05, 1 + F.col("p_partkey") % 6
    return table(spark, sf, "part").select("p_partkey", fixed(S.open_loop_bound(rho, F.lit(2.0), F.lit(0.5), h), 6).alias("bound"))


_REQ = "rq AS (SELECT DISTINCT CAST(0 AS BIGINT) AS field, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 700 AS INT) AS origin FROM orders)"


@query(with_sql("li gap_days gap_cal", f""", {_REQ},
dd AS (SELECT field, date AS origin, observed, min(observed::INT) OVER w = 1 AND count(*) OVER w = 3 AS ok, date < DATE '{CUT_LI}' AS train, max(date) OVER (PARTITION BY field) AS last FROM gap_cal WINDOW w AS (PARTITION BY field ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
rr AS (SELECT field, origin, last, CASE WHEN observed IS NULL THEN 'not on the calendar' WHEN NOT observed THEN 'not observed' WHEN NOT ok THEN 'fewer than 3 observed days behind' WHEN train THEN 'in training' END AS reason FROM rq LEFT JOIN dd USING (field, origin))
SELECT field, origin, reason, coalesce(reason IS NULL AND origin + 6 <= last, false) AS scoreable FROM rr"""))
def validate_origins(spark, sf):
    day = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 700).cast("int"))
    req = table(spark, sf, "orders").select(F.lit(0).cast("long").alias("field"), day.alias("origin")).distinct()
    return S.validate_origins(req, A.split_by_date(gap_calendar(spark, sf), CUT_LI), 3, 6).withColumn("scoreable", F.coalesce("scoreable", F.lit(False)))


@query(with_sql("ev ev_days ev_cal", """, o AS (SELECT field, date, row_number() OVER (PARTITION BY field ORDER BY date) - 1 AS nth, count(*) OVER (PARTITION BY field) AS m FROM ev_cal WHERE observed),
pk AS (SELECT DISTINCT field, CAST(round_even(i * (m - 1) / greatest(least(8, m) - 1, 1), 0) AS BIGINT) AS nth FROM (SELECT DISTINCT field, m FROM o), (SELECT unnest(generate_series(0, 7)) AS i) WHERE i < least(8, m))
SELECT field, date FROM o SEMI JOIN pk USING (field, nth)"""))
def evenly_spaced_origins(spark, sf):
    return S.evenly_spaced(A.calendar(event_panel(spark, sf)).where("observed").select("field", "date"), 8)


@query(with_sql("li gap_days gap_cal", """, o AS (SELECT field, date AS origin FROM gap_cal WHERE observed), l AS (SELECT field, origin, origin + CAST(lead AS INT) AS target FROM o, (SELECT unnest(generate_series(1, 3)) AS lead)),
w AS (SELECT l.field, origin, count(date) = count(*) AS complete FROM l LEFT JOIN (SELECT field, date FROM gap_cal WHERE observed) s ON s.field = l.field AND s.date = l.target GROUP BY l.field, origin)
SELECT field, arg_max(origin, (complete, origin)) AS origin, bool_or(complete) AS complete FROM w GROUP BY field"""))
def latest_complete_origin(spark, sf):
    cal = gap_calendar(spark, sf)
    return S.latest_complete_origin(S.add_leads(cal.where("observed").select("field", F.col("date").alias("origin")), 3), cal)


@query(with_sql("ev ev_days ev_cal", " SELECT field, origin, rank FROM (SELECT field, date AS origin, row_number() OVER (PARTITION BY field ORDER BY abs(date - DATE '2024-01-11'), date) AS rank FROM ev_cal WHERE observed) WHERE rank <= 3"))
def nearest_origins(spark, sf):
    cal = A.calendar(event_panel(spark, sf)).where("observed").select("field", F.col("date").alias("origin"))
    return S.nearest_origins(cal, F.lit("2024-01-11").cast("date"))


@query(with_sql("ev ev_days ev_cal", _PE + ", s AS (SELECT field, lead, avg(e * e) AS score FROM pe GROUP BY ALL) SELECT field, round(min(score) + 3e-8, 6) AS score, arg_min(lead, (score, lead)) AS lead FROM s GROUP BY field"))
def best_lead(spark, sf):
    s = persistence_errors(spark, sf).groupBy("field", "lead").agg(F.avg(F.col("error") * F.col("error")).alias("score"))
    return _r(S.best_by(s, ["field"], "lead", "score"), "score")


@query(with_sql("ev ev_days ev_cal", _PE + """, s AS (SELECT lead AS "order", sqrt(avg(e * e)) AS score FROM pe GROUP BY ALL), r AS (SELECT sqrt(avg(e * e)) AS reference FROM ce)
SELECT arg_min("order", (score, "order")) AS best_order, round(min(score) + 3e-8, 6) AS best_score, count(*) FILTER (score < reference) AS n_better, round(max(score) - min(score) + 3e-8, 6) AS spread FROM s, r"""))
def ablation_summary(spark, sf):
    rmse = F.sqrt(F.avg(F.col("error") * F.col("error")))
    s = persistence_errors(spark, sf).groupBy(F.col("lead").alias("order")).agg(rmse.alias("score"))
    return _r(S.ablation_summary(s, climatology_errors(spark, sf).agg(rmse.alias("reference"))), "best_score", "spread")


_VMAX = 2
_V = """, z AS (SELECT date, pixel, row, col, value - avg(value) OVER (PARTITION BY pixel) AS z FROM li),
of AS (SELECT * FROM (VALUES {0}) t(bin, dr, dc, dist)),
ps AS (SELECT a.date, bin, dist, a.pixel, b.pixel AS other, a.z AS za, b.z AS zb FROM z a, of, z b WHERE b.date = a.date AND b.row = a.row + dr AND b.col = a.col + dc),
pr AS (SELECT bin, 0 AS u, date, pixel, other, dist, za * zb AS p FROM ps UNION ALL SELECT a.bin, CAST(u AS INT), a.date, a.pixel, a.other, a.dist, 0.5 * (a.za * b.zb + a.zb * b.za) FROM ps a, (SELECT unnest(generate_series(1, 2)) AS u), ps b WHERE b.pixel = a.pixel AND b.other = a.other AND b.date = a.date + CAST(u AS INT)),
tm AS (SELECT CAST(u AS INT) AS u, avg(a.z * b.z) AS t FROM z a, (SELECT unnest(generate_series(0, 2)) AS u), z b WHERE b.pixel = a.pixel AND b.date = a.date + CAST(u AS INT) GROUP BY u)"""
_OFFS = C.offsets([1.0, 2.0, 3.0])
_VSQL = _V.format(", ".join(f"({b}, {r}, {c}, CAST({d!r} AS DOUBLE))" for b, r, c, d in _OFFS))


def _centred(spark, sf):
    p = stored(item_panel(spark, sf), "panel")
    return stored(C.centred(p, "anomaly", p.select("field", "pixel").distinct()), "centred")


@query(with_sql("li", _VSQL + """, cv AS (SELECT bin, u, avg(p) AS cov FROM pr GROUP BY ALL), sz AS (SELECT bin, count(*) AS n_pairs, avg(dist) AS h FROM (SELECT DISTINCT bin, pixel, other, dist FROM pr WHERE u = 0) GROUP BY bin)
SELECT CAST(0 AS BIGINT) AS field, bin, u, round(h + 3e-8, 6) AS h, n_pairs, round(cv.cov + 3e-8, 6) AS cov, round(c0.t + 3e-8, 6) AS c0, round(tm.t + 3e-8, 6) AS temporal, round(sp.cov + 3e-8, 6) AS spatial, round(cv.cov * c0.t / (sp.cov * tm.t) + 3e-6, 4) AS ratio, round(cv.cov / c0.t + 3e-8, 6) AS corr
FROM cv JOIN sz USING (bin) JOIN tm USING (u) JOIN (SELECT bin, cov FROM cv WHERE u = 0) sp USING (bin), (SELECT t FROM tm WHERE u = 0) c0 WHERE n_pairs >= 4"""))
def covariogram(spark, sf):
    got = C.covariogram(_centred(spark, sf), C.offset_table(spark, [1.0, 2.0, 3.0]), _VMAX, min_pairs=4)
    return _r(got, "h", "cov", "c0", "temporal", "spatial", "corr").withColumn("ratio", fixed("ratio", 4))


@query(with_sql("li", _VSQL + " SELECT bin, u, date, count(*) AS n, round(avg(p) + 3e-8, 6) AS m FROM pr GROUP BY ALL"))
def product_series(spark, sf):
    """Mean lagged products of each day, over all pair groups."""
    series = C.product_series(_centred(spark, sf), C.offset_table(spark, [1.0, 2.0, 3.0]), _VMAX, groups=1)
    return _r(series.where("kind = 'pair'").select("bin", "u", "date", "n", "m"), "m")


@query(with_sql("li", _VSQL + """, bl AS (SELECT DATE '1995-01-01' + CAST(k * 60 AS INT) AS s, DATE '1995-01-01' + CAST(k * 60 + 60 AS INT) AS e FROM (SELECT unnest(generate_series(0, 59)) AS k)),
pd AS (SELECT bin, u, avg(m) AS c FROM (SELECT bin, u, date, avg(p) AS m FROM pr JOIN bl ON date >= s AND date + u < e GROUP BY ALL) GROUP BY ALL),
td AS (SELECT u, avg(m) AS t FROM (SELECT CAST(u AS INT) AS u, a.date, avg(a.z * b.z) AS m FROM z a, (SELECT unnest(generate_series(0, 2)) AS u), z b, bl WHERE b.pixel = a.pixel AND b.date = a.date + CAST(u AS INT) AND a.date >= s AND a.date + CAST(u AS INT) < e GROUP BY ALL) GROUP BY u)
SELECT CAST(0 AS BIGINT) AS field, pd.bin, pd.u, round(pd.c - z0.c * td.t / greatest(t0.t, 1e-30) + 3e-6, 4) + 0.0 AS contrast FROM pd JOIN pd z0 ON z0.bin = pd.bin AND z0.u = 0 JOIN td ON td.u = pd.u, (SELECT t FROM td WHERE u = 0) t0 WHERE pd.u > 0"""))
def separability_contrasts(spark, sf):
    """Contrasts over blocks of 60 days."""
    series = C.product_series(_centred(spark, sf), C.offset_table(spark, [1.0, 2.0, 3.0]), _VMAX, groups=1)
    blocks = spark.sql("select date_add(date'1995-01-01', cast(id * 60 as int)) as start, date_add(date'1995-01-01', cast(id * 60 + 60 as int)) as end from range(60)")
    return C.contrasts(series, blocks).withColumn("contrast", fixed("contrast", 4) + 0.0)


@query(None)
def separability_verdict(spark, sf):
    """The bootstrap test of the whole archive; its size and power are tested on made-up fields."""
    series = C.product_series(_centred(spark, sf), C.offset_table(spark, [1.0, 2.0, 3.0]), _VMAX, groups=8)
    got = C.separability_test(series, [1, 2], replicates=60)
    return spark.createDataFrame([tuple(got[k] for k in ("statistic", "dof", "p_value", "reject", "max_ratio_deviation", "temporal_correlation"))], "statistic double, dof int, p_value double, reject boolean, max_ratio_deviation double, temporal_correlation double")


R = 4
_W = f"w AS (SELECT CAST(0 AS BIGINT) AS field, vec_id AS t, list_transform(embedding[1:{R}], lambda x: round(CAST(x AS DOUBLE), 6)) AS w FROM embeddings)"
_E = f", e AS (SELECT field, t, i, w[i + 1] - lag(w[i + 1]) OVER (PARTITION BY field, i ORDER BY t) AS x FROM w, (SELECT CAST(unnest(generate_series(0, {R - 1})) AS INT) AS i))"


@query(f"WITH {_W}{_E} SELECT field, t, i, round(x + 3e-8, 6) + 0.0 AS x FROM e WHERE x IS NOT NULL")
def one_step_differences(spark, sf):
    return T.differences(trajectory(spark, sf, R)).select("field", "t", F.posexplode("e").alias("i", "x")).withColumn("x", fixed("x", 6) + 0.0)


_RHO = f"""{_E}, zz AS (SELECT field, i, t, x - avg(x) OVER (PARTITION BY field, i) AS z, var_pop(x) OVER (PARTITION BY field, i) AS v, count(x) OVER (PARTITION BY field, i) AS n FROM e WHERE x IS NOT NULL),
lg AS (SELECT field, i, v, n, k, z * lag(z, CAST(k AS INT)) OVER (PARTITION BY field, i, k ORDER BY t) AS p FROM zz, (SELECT unnest(generate_series(1, 5)) AS k)),
rho AS (SELECT field, i, CAST(k AS INT) AS k, any_value(n) AS n, sum(p) / (any_value(n) * any_value(v)) AS rho FROM lg GROUP BY field, i, k)"""


@query(f"WITH {_W}{_RHO} SELECT field, k, round(avg(abs(rho)) + 3e-8, 6) AS mean_abs, round(1.96 / sqrt(max(n)) + 3e-8, 6) AS band FROM rho GROUP BY field, k")
def residual_autocorrelation(spark, sf):
    return _r(T.residual_autocorrelation(T.autocorrelation(T.differences(trajectory(spark, sf, R)), 5)), "mean_abs", "band")


@query(f"WITH {_W}{_RHO} SELECT field, i, round(max(n) * (max(n) + 2) * sum(rho * rho / (n - k)) + 3e-7, 5) AS statistic FROM rho GROUP BY field, i")
def ljung_box(spark, sf):
    lb = T.ljung_box(T.autocorrelation(T.differences(trajectory(spark, sf, R)), 5), 5)
    return lb.select("field", "i", fixed("statistic", 5).alias("statistic"))


@query("""WITH p AS (SELECT o_orderkey, (CAST(round(o_totalprice * 100) AS BIGINT) % 997) / 9970.0 AS p FROM orders), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS k FROM p),
l AS (SELECT max(p) FILTER (p <= 0.05 * k / m) AS last FROM r) SELECT o_orderkey, round(p + 3e-8, 6) AS p, coalesce(p <= last, false) AS reject FROM r, l""")
def step_up_rejections(spark, sf):
    p = (F.pmod(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(997)) / 9970.0).alias("p")
    tests = table(spark, sf, "orders").select("o_orderkey", p, F.lit(1).alias("g"))
    return _r(T.benjamini_hochberg(tests, ["g"], F.col("p")).select("o_orderkey", "p", "reject"), "p")


@query(None)
def whiteness_verdict(spark, sf):
    """Ljung-Box by component, the portmanteau and the verdict; tested against NumPy."""
    e = T.differences(trajectory(spark, sf, R))
    return T.whiteness_verdict(T.ljung_box(T.autocorrelation(e, 5), 5), T.portmanteau(e, 5))


@query(f"WITH {_W} SELECT field, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(w[i + 1] * w[j + 1]) + 3e-8, 6) + 0.0 AS value FROM w, (SELECT unnest(generate_series(0, {R - 1})) AS i), (SELECT unnest(generate_series(0, {R - 1})) AS j) GROUP BY ALL")
def gram_matrix(spark, sf):
    m = G.moments(trajectory(spark, sf, R), ["field"], "w")
    return G.cells(m, ["field"], "xx", R).withColumn("value", fixed("value", 6) + 0.0)


@query("SELECT vec_id, round(list_dot_product(a, b) + 3e-8, 6) AS dot, round(list_dot_product(a, a) + 3e-8, 6) AS norm2, round(a[1] * b[2] + 3e-8, 6) AS outer01, round(a[3] + b[3] + 3e-8, 6) AS sum2 FROM (SELECT vec_id, list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[4:6], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)")
def vector_functions(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.head(F.col("embedding"), 3).alias("a"), F.transform(F.slice("embedding", 4, 3), lambda x: x.cast("double")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return _r(e.select("vec_id", V.dot(a, b).alias("dot"), V.norm2(a).alias("norm2"), V.outer(a, b)[1].alias("outer01"), V.add(a, b)[2].alias("sum2")), "dot", "norm2", "outer01", "sum2")
