"""Queries that fit, filter, forecast and decode on panels, with SQL for the parts that SQL can say."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldcast.functions.vectors import dot
from fieldcast.operators import archive as A
from fieldcast.operators import dynamics as Y
from fieldcast.operators import filtering as K
from fieldcast.operators import raster as R
from fieldcast.operators import scoring as S
from fieldcast.operators import state as X
from fieldcast.operators import subspace as B
from fieldcast.plans.archive_queries import CUT_LI
from fieldcast.plans.panels import block_panel, fixed, item_panel, table, trajectory, weather_record, with_sql
from fieldcast.sources.stages import stored

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CENTRES, LENGTH, NOISE, LAGS = [(2.0, 2.0), (2.0, 7.0), (7.0, 2.0), (7.0, 7.0)], 3.0, 0.5, 3
_PHI = ", ".join(f"exp(-0.5 * ((col - {a}) * (col - {a}) + (row - {b}) * (row - {b})) / {LENGTH**2})" for a, b in CENTRES)
_BASIS = f"bs AS (SELECT DISTINCT field, pixel, [{_PHI}] AS phi FROM li)"


def _basis(spark, sf, offset: float | None = 25.0):
    return _rbf(item_panel(spark, sf), offset)


def _rbf(pixels, offset):
    grid = pixels.select("field", "pixel", "row", "col").distinct()
    phi = X.rbf_features(F.col("col").cast("double"), F.col("row").cast("double"), CENTRES, LENGTH)
    return grid.select("field", "pixel", phi.alias("phi"), F.lit(offset).alias("offset"))


@query(with_sql("li", f", {_BASIS} SELECT field, pixel, CAST(j - 1 AS INT) AS j, round(phi[j] + 3e-8, 6) AS v FROM bs, (SELECT CAST(unnest(generate_series(1, 4)) AS INT) AS j)"))
def rbf_basis(spark, sf):
    return _basis(spark, sf).select("field", "pixel", F.posexplode("phi").alias("j", "v")).withColumn("v", fixed("v", 6))


@query(with_sql("li", f", {_BASIS}, m AS (SELECT field, j, max(abs(phi[j])) AS top FROM bs, (SELECT unnest(generate_series(1, 4)) AS j) GROUP BY ALL) SELECT field, count(*) AS n, count(*) FILTER (top <= 0.9) AS n_dead, round(count(*) FILTER (top <= 0.9) / count(*) + 3e-8, 6) AS share, round(min(top) + 3e-8, 6) AS smallest FROM m GROUP BY field"))
def shaded_columns(spark, sf):
    return X.shaded(_basis(spark, sf), 0.9).withColumns({c: fixed(c, 6) for c in ("share", "smallest")})


@query(with_sql("li", f", {_BASIS} SELECT field, date, CAST(j - 1 AS INT) AS i, round(sum(phi[j] * (value - 25)) + 3e-7, 5) + 0.0 AS v, count(*) AS n FROM li JOIN bs USING (field, pixel), (SELECT CAST(unnest(generate_series(1, 4)) AS INT) AS j) GROUP BY ALL"))
def frame_moments(spark, sf):
    """The right-hand sides of all frames' ridge regressions."""
    pixels = stored(item_panel(spark, sf), "panel")
    got = pixels.join(_rbf(pixels, 25.0), ["field", "pixel"]).withColumn("y", F.col("value") - F.col("offset"))
    m = X.cross_moments(got, ["field", "date"], "phi", "y", len(CENTRES))
    return m.select("field", "date", "n", F.posexplode("xy").alias("i", "v")).withColumn("v", fixed("v", 5) + 0.0)


def _panel(spark, sf):
    """The block archive and its basis, worked out once for all that a query does with them."""
    pixels = stored(block_panel(spark, sf), "panel")
    return pixels, stored(_rbf(pixels, 25.0), "basis")


def _states(panel, cov=False):
    return X.solve_states(*panel, NOISE, cov, len(CENTRES))


@query(None)
def state_extraction(spark, sf):
    """State vectors of all frames; tested against NumPy."""
    return _states(_panel(spark, sf))


_BLOCKS = "lb AS (SELECT CAST(pixel // 100 AS BIGINT) AS field, date, pixel, CAST(pixel % 100 // 10 AS INT) AS row, CAST(pixel % 10 AS INT) AS col, value FROM li)"
_BB = _BASIS.replace("bs AS", "bb AS").replace("FROM li", "FROM lb")


@query(with_sql("li", f", {_BLOCKS}, {_BB} SELECT field, date, CAST(j - 1 AS INT) AS i, count(*) AS n_valid, round(sum(phi[j] * (value - 25)) + 3e-7, 5) + 0.0 AS v FROM lb JOIN bb USING (field, pixel), (SELECT CAST(unnest(generate_series(1, 4)) AS INT) AS j) GROUP BY ALL HAVING count(*) >= 2"))
def state_equations(spark, sf):
    """The left sides of the states' normal equations, (F'F + noise I) w: the SQL has the right sides, F'(y - offset)."""
    (pixels, basis), r = _panel(spark, sf), len(CENTRES)
    got = pixels.join(_states((pixels, basis)), ["field", "date"]).join(basis, ["field", "pixel"])
    phi, w = [F.col("phi")[i] for i in range(r)], [F.first(F.col("w")[i]) for i in range(r)]
    left = [sum((F.sum(phi[i] * phi[j]) * w[j] for j in range(r)), w[i] * NOISE) for i in range(r)]
    rows = got.groupBy("field", "date").agg(F.count("*").alias("n_valid"), F.array(*left).alias("left")).where("n_valid >= 2")
    return rows.select("field", "date", F.posexplode("left").alias("i", "v"), "n_valid").withColumn("v", fixed("v", 5) + 0.0)


@query("""WITH w AS (SELECT CAST(label AS BIGINT) AS field, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, round(CAST(embedding[1] AS DOUBLE), 6) AS a, round(CAST(embedding[2] AS DOUBLE), 6) AS b FROM embeddings),
d AS (SELECT field, a, b, lag(a) OVER v AS a1, lag(b) OVER v AS b1, lead(a) OVER v AS ya, lead(b) OVER v AS yb FROM w WINDOW v AS (PARTITION BY field ORDER BY t)), k AS (SELECT * FROM d WHERE a1 IS NOT NULL AND ya IS NOT NULL)
SELECT field, j, i, round(v + 3e-8, 6) + 0.0 AS v FROM (SELECT field, unnest([0, 0, 0, 0, 1, 1, 1, 1]) AS i, unnest([0, 1, 2, 3, 0, 1, 2, 3]) AS j, unnest([sum(ya * a), sum(ya * b), sum(ya * a1), sum(ya * b1), sum(yb * a), sum(yb * b), sum(yb * a1), sum(yb * b1)]) AS v FROM k GROUP BY field)""")
def memory_equations(spark, sf):
    """The left sides of a memory model's normal equations, A (XX' + mu I): the SQL has the right sides, YX'."""
    w = trajectory(spark, sf, 2, per_field=True).withColumn("observed", F.lit(True))
    design, mu = stored(Y.delay_line(w, 2), "design"), 0.5
    fit = Y.fit_table(design, mu=mu).select("field", "a")
    gram = design.groupBy("field").agg(F.array(*[F.array(*[F.sum(F.col("x")[p] * F.col("x")[q]) + (mu if p == q else 0.0) for q in range(4)]) for p in range(4)]).alias("g"))
    a = lambda i, p: F.col("a")[(p // 2) * 4 + i * 2 + p % 2]  # noqa: E731  row i, place p of the blocks side by side
    cells = [F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), sum((a(i, p) * F.col("g")[p][j] for p in range(1, 4)), a(i, 0) * F.col("g")[0][j]).alias("v")) for i in range(2) for j in range(4)]
    return fit.join(gram, "field").select("field", F.explode(F.array(*cells)).alias("c")).select("field", "c.j", "c.i", (fixed("c.v", 6) + 0.0).alias("v"))


@query(with_sql("li", f", {_BASIS}, w AS (SELECT DISTINCT CAST(0 AS BIGINT) AS field, CAST(vec_id AS BIGINT) AS t, list_transform(embedding[1:4], lambda x: round(CAST(x AS DOUBLE), 6)) AS w FROM embeddings) SELECT field, t, pixel, round(list_dot_product(phi, w) + 25 + 3e-8, 6) AS pred FROM bs JOIN w USING (field)"))
def decoded_states(spark, sf):
    w = trajectory(spark, sf, 4)
    return X.decode(w, _basis(spark, sf), ["t"], 4).withColumn("pred", fixed("pred", 6))


@query(None)
def state_residuals(spark, sf):
    """Representation variance of each pixel by the states' reconstruction."""
    pixels, basis = panel = _panel(spark, sf)
    return S.representation_variance(X.residuals(pixels, _states(panel), basis))


def _weights(spark, sf, panel=None):
    """The states of all fields on the calendar of the item archive, as a stored stage."""
    panel = panel or _panel(spark, sf)
    return stored(X.on_calendar(_states(panel), A.calendar(panel[0]), len(CENTRES)), "weights")


@query(None)
def subspace_projection(spark, sf):
    w = _weights(spark, sf)
    return B.projected(w.select("field", "t", "w"), B.subspace_rows(w.where("observed"), 0.9, least=2, most=3)).select("field", "t", "z", "complement")


_DL = f"""w AS (SELECT CAST(0 AS BIGINT) AS field, vec_id AS t, round(CAST(embedding[1] AS DOUBLE), 6) AS a, vec_id % 7 <> 0 AS observed FROM embeddings)"""


@query(f"""WITH {_DL}, l AS (SELECT field, t, a AS x0, lag(a) OVER v AS x1, lag(a, 2) OVER v AS x2, lead(a, 2) OVER v AS y, min(observed::INT) OVER s = 1 AND count(*) OVER s = 5 AS ok FROM w
WINDOW v AS (PARTITION BY field ORDER BY t), s AS (PARTITION BY field ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT field, t, x0, x1, x2, y FROM l WHERE ok""")
def delay_line(spark, sf):
    w = trajectory(spark, sf, 1).withColumn("observed", F.col("t") % 7 != 0)
    d = Y.delay_line(w, 3, 2)
    return d.select("field", "t", *[F.col("x")[i].alias(f"x{i}") for i in range(3)], F.col("y")[0].alias("y"))


def _models(spark, sf, w):
    return stored(Y.fit_table(Y.delay_line(w, LAGS), mu=1.0).withColumns({"r": F.lit(NOISE), "rho": F.lit(1.0)}), "models")


@query(None)
def memory_operator(spark, sf):
    """The blocks of the memory model in long form."""
    fit = Y.fit_table(Y.delay_line(_weights(spark, sf), LAGS), mu=1.0)
    at = lambda d, m: (F.floor(F.col("at") / d) % m).cast("int")
    cells = fit.select("field", "k", F.posexplode("a").alias("at", "value"))
    return cells.select("field", at(F.col("k") * F.col("k"), 10**6).alias("lag"), at(F.col("k"), F.col("k")).alias("i"), at(1, F.col("k")).alias("j"), "value")


@query(None)
def memory_depth_sweep(spark, sf):
    return Y.memory_sweep(_weights(spark, sf), 4)


@query(None)
def horizon_family(spark, sf):
    from fieldcast.operators import horizons as H

    rows = H.horizon_rows(H.horizon_design(_weights(spark, sf), LAGS, 3), LAGS, 3, criterion="holdout", mu=1.0, holdout=0.2)
    return rows.select("field", "lead", "nu", F.col("score").alias("error"), "defect", "map")


@query(None)
def emission_fit(spark, sf):
    """Weather measures from states: hold-out R squared by channel."""
    w = _weights(spark, sf).where("observed").join(weather_record(spark, sf).drop("field"), "date")
    got = Y.emission_rows(w.select("field", "t", "w", F.array("ta", "rs").alias("y")))
    return got.select("field", F.posexplode("r2").alias("channel", "r2"), "usable")


@query(None)
def filtered_states(spark, sf):
    w = _weights(spark, sf)
    return K.filtered(w.select("field", F.col("t").cast("long").alias("t"), "observed", "w"), _models(spark, sf, w))


def rolling(spark, sf, horizon: int = 3, panel=None):
    w = _weights(spark, sf, panel)
    rows = w.select("field", F.col("t").cast("long").alias("t"), "observed", "w")
    return w, K.rolling_forecasts(rows, _models(spark, sf, w), None, horizon, K.VARIANTS[:1])


@query(None)
def rolling_forecasts(spark, sf):
    return rolling(spark, sf)[1]


@query(None)
def end_to_end_scores(spark, sf):
    """Archive, states, memory model, filter, rolling forecasts, decoding and scores by lead, beside persistence."""
    pixels, basis = panel = _panel(spark, sf)
    w, f = rolling(spark, sf, panel=panel)
    days = w.select("field", "t", "date", "observed", F.when(F.col("date") < F.lit(CUT_LI).cast("date"), "train").otherwise("test").alias("split"))
    origins = days.where("observed and split = 'test'")
    own = f.where("valid").join(origins.select("field", F.col("t").alias("origin"), "date"), ["field", "origin"]).select("field", "variant", F.col("date").alias("origin"), "lead", "w")
    late = pixels.where(F.col("date") >= F.lit(CUT_LI).cast("date"))  # has all origins and targets
    scores = S.horizon_scores(X.forecast_errors(own, basis, late, ["variant"], len(CENTRES)))
    return S.compare_methods([scores, S.horizon_scores(S.with_truth(S.persistence(late, origins, 3), late))])


@query(None)
def memory_ablation(spark, sf):
    """Memory orders 1 to 3, fitted on the training days and scored from shared test origins, with their models' facts."""
    from fieldcast.operators import operational as O

    split = F.when(F.col("date") < F.lit(CUT_LI).cast("date"), "train").otherwise("test")
    pixels, basis = panel = _panel(spark, sf)
    w = _weights(spark, sf, panel).withColumn("split", split)
    forecasts, models = (stored(x, "orders") for x in O.order_forecasts(w, [1, 2, 3], 3, 1.0, NOISE))
    facts = O.model_facts(models, 3, ["field", "order"]).groupBy("order").agg(*[F.avg(c).alias(c) for c in ("rho", "gain", "norm_budget", "last_ratio")], F.max("n_parameters").alias("n_parameters"))
    latent = O.latent_scores(forecasts, w, ["order"])
    late = pixels.where(F.col("date") >= F.lit(CUT_LI).cast("date"))  # has all targets
    return O.ablation_scores(forecasts, basis, late, len(CENTRES)).join(latent, ["order", "lead"]).join(facts, "order")


def _requested(pixels):
    """The last three days with frames of each field, and one day past its calendar, which has none."""
    days = A.calendar(pixels).where("observed").select("field", "date")
    last = days.withColumn("nth", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("date")))).where("nth <= 3")
    past = days.groupBy("field").agg(F.date_add(F.max("date"), 5).alias("date"))
    return last.select("field", "date").unionByName(past).withColumnRenamed("date", "origin")


@query(with_sql("li", f""", {_BLOCKS}, d AS (SELECT DISTINCT field, date FROM lb), n AS (SELECT field, date, row_number() OVER (PARTITION BY field ORDER BY date DESC) AS nth, max(date) OVER (PARTITION BY field) AS last FROM d),
q AS (SELECT field, date AS origin, last FROM n WHERE nth <= 3 UNION ALL SELECT DISTINCT field, last + 5, last FROM n)
SELECT field, origin, CASE WHEN origin > last THEN 'not observed' WHEN (SELECT count(*) FROM d WHERE d.field = q.field AND d.date BETWEEN q.origin - 2 AND q.origin) < 3 THEN 'fewer than 3 observed days behind' END AS reason,
NOT (origin > last) AND (SELECT count(*) FROM d WHERE d.field = q.field AND d.date BETWEEN q.origin - 2 AND q.origin) = 3 AND origin + 3 <= last AS scoreable FROM q"""))
def requested_origins(spark, sf):
    """Which requested days can be forecast from, and why the others cannot."""
    from fieldcast.operators import operational as O

    pixels = stored(block_panel(spark, sf), "panel")
    got = O.checked_requests(_requested(pixels), A.calendar(pixels), LAGS, 3)
    return got.select("field", "origin", "reason", "scoreable")


@query(None)
def operational_forecast(spark, sf):
    """Forecasts of the requested days from stored models, over windows of 30 days."""
    from fieldcast.operators import operational as O

    pixels, basis = panel = _panel(spark, sf)
    models = _models(spark, sf, _weights(spark, sf, panel))
    got = O.operational_forecasts(_requested(pixels), pixels, basis, models, NOISE, LAGS, 3)
    return got.select("field", "variant", "origin", "lead", "w", "cov_trace")


@query(None)
def requested_maps(spark, sf):
    """Requested days from forecast to maps: bands of the forecasts' own covariances, representation variance, errors where there is a
    frame, nodata outside the mask."""
    from fieldcast.operators import operational as O

    pixels, basis = panel = _panel(spark, sf)
    w = _weights(spark, sf, panel)
    models = _models(spark, sf, w)
    got = stored(O.operational_forecasts(_requested(pixels), pixels, basis, models, NOISE, LAGS, 3, covariances=True), "requested")
    rep = S.representation_variance(X.residuals(pixels, w.where("observed"), basis))
    return O.requested_maps(got, pixels, basis, NOISE, repvar=rep, units="items").drop("tags")


@query(None)
def kernel_observer_scores(spark, sf):
    """The kernel-observer baseline: centres by k-means, bandwidth by marginal likelihood, a one-step operator, scores."""
    from fieldcast.operators.observers import choose_bandwidth, kernel_centres

    pixels = item_panel(spark, sf)
    grid = pixels.select("field", "pixel", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y")).distinct()
    centres = kernel_centres(grid, 4)
    # The bandwidth's likelihood takes the first twelve frames of a field.
    nth = F.row_number().over(Window.partitionBy("field").orderBy("date"))
    frames = pixels.select("field", "date").distinct().withColumn("nth", nth).where("nth <= 12").drop("nth")
    length, noise = choose_bandwidth(pixels.join(frames, ["field", "date"]), grid, centres, [1.5, 3.0, 6.0], [1.0, 50.0])
    basis = grid.select("field", "pixel", X.rbf_features(F.col("x"), F.col("y"), centres, length).alias("phi"), F.lit(25.0).alias("offset"))
    states = X.on_calendar(X.solve_states(pixels, basis, noise), A.calendar(pixels), len(centres))
    k = len(centres)
    fit = Y.fit_table(Y.delay_line(states, 1), mu=1.0)
    op = fit.select("field", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice("a", i * k + 1, k)).alias("a"))
    ahead = states.where("observed").join(op, "field").select("field", F.col("date").alias("day"), F.transform("a", lambda r: dot(r, F.col("w"))).alias("w"), F.lit("kernel observer").alias("variant"), F.lit(1).alias("lead"))
    pred = X.decode(ahead, basis, ["variant", "day", "lead"]).withColumnRenamed("day", "origin")
    return S.horizon_scores(S.with_truth(pred, pixels))


@query(with_sql("li", ", g AS (SELECT DISTINCT field, pixel, row, col FROM li), m AS (SELECT field, max(row) AS h, max(col) AS w FROM g GROUP BY field) SELECT field, pixel, row, col, round(coalesce(col * 2.0 / nullif(w, 0) - 1, -1) + 3e-8, 6) AS x, round(coalesce(row * 2.0 / nullif(h, 0) - 1, -1) + 3e-8, 6) AS y FROM g JOIN m USING (field)"))
def index_coordinates(spark, sf):
    grid = item_panel(spark, sf).select("field", "pixel", "row", "col").distinct()
    return R.index_coordinates(grid).withColumns({c: fixed(c, 6) for c in ("x", "y")})


@query("SELECT label, k, round(energy + 3e-8, 6) AS energy FROM (SELECT label, k, sum(s) OVER (PARTITION BY label ORDER BY k) / sum(s) OVER (PARTITION BY label) AS energy FROM (SELECT label, CAST(vec_id % 8 AS INT) AS k, sum(pow(round(CAST(embedding[1] AS DOUBLE), 6), 2)) AS s FROM embeddings GROUP BY ALL))")
def cumulative_energy(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 8).cast("int").alias("k"), F.pow(F.round(F.col("embedding")[0].cast("double"), 6), 2).alias("s"))
    s = e.groupBy("label", "k").agg(F.sum("s").alias("s"))
    w = Window.partitionBy("label")
    return s.select("label", "k", fixed(F.sum("s").over(w.orderBy("k")) / F.sum("s").over(w), 6).alias("energy"))


@query("SELECT label, min(k) AS k FROM (SELECT label, k, sum(s) OVER (PARTITION BY label ORDER BY k) / sum(s) OVER (PARTITION BY label) AS share FROM (SELECT label, CAST(vec_id % 8 AS INT) AS k, sum(pow(round(CAST(embedding[1] AS DOUBLE), 6), 2)) AS s FROM embeddings GROUP BY ALL)) WHERE share >= 0.8 - 1e-12 GROUP BY label")
def energy_rank(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 8).cast("int").alias("k"), F.pow(F.round(F.col("embedding")[0].cast("double"), 6), 2).alias("s"))
    return S.first_reaching(e.groupBy("label", "k").agg(F.sum("s").alias("energy")), ["label"], 0.8)


@query("SELECT CAST(label AS BIGINT) AS field, round(max(sqrt(list_dot_product(w, w))) + 3e-8, 6) AS largest FROM (SELECT label, list_transform(embedding[1:4], lambda x: round(CAST(x AS DOUBLE), 6)) AS w FROM embeddings) GROUP BY label")
def largest_norms(spark, sf):
    return S.largest_norms(trajectory(spark, sf, 4, per_field=True), "w").withColumn("largest", fixed("largest", 6))


@query("SELECT p_partkey, CASE WHEN lower(trim(p_type)) LIKE 'lst%' OR lower(trim(p_type)) = 'land surface temperature' THEN 'lst' ELSE 'ndvi' END AS key FROM part")
def modality_keys(spark, sf):
    from fieldcast.functions.modality import resolve

    return table(spark, sf, "part").select("p_partkey", resolve(F.col("p_type")).alias("key"))


@query(None)
def error_budget(spark, sf):
    """What representation and truncation cost against persistence, through the memory models' own gain; the parts are tested one by
    one."""
    from fieldcast.operators import operational as O

    pixels, basis = panel = _panel(spark, sf)
    w = _weights(spark, sf, panel)
    seen = w.where("observed")
    left = stored(B.projected(seen.select("field", "t", "w"), B.subspace_rows(seen, 0.9, least=2, most=3)).select("field", "t", F.col("complement").alias("w")), "complement")
    origins = seen.select("field", "date")
    now = S.with_truth(S.persistence(pixels, origins, 1), pixels).agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))
    gain = O.model_facts(_models(spark, sf, w), 3, ["field"]).agg(F.avg("gain")).first()[0]
    return S.error_budget(X.residuals(pixels, seen, basis), B.decoded_drift(left, basis), now, gain or 1.0)
