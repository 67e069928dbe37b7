"""Queries of memory kernels, horizon families, sensors and forecast variants. SQL holds the right sides of normal equations
against the left sides of what was fitted."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast.operators import archive as A
from fieldcast.operators import dynamics as Y
from fieldcast.operators import filtering as K
from fieldcast.operators import horizons as H
from fieldcast.operators import kernels as R
from fieldcast.operators import state as X
from fieldcast.plans.archive_queries import CUT_LI
from fieldcast.plans.model_queries import CENTRES, LAGS, NOISE, _panel, _weights
from fieldcast.plans.panels import fixed, trajectory, weather_record
from fieldcast.sources.stages import stored

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TRACK = """w AS (SELECT CAST(label AS BIGINT) AS field, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t,
round(CAST(embedding[1] AS DOUBLE), 6) AS a, round(CAST(embedding[2] AS DOUBLE), 6) AS b, round(CAST(embedding[3] AS DOUBLE), 6) AS u, round(CAST(embedding[4] AS DOUBLE), 6) AS v FROM embeddings)"""


def _track(spark, sf):
    """Two components of the embeddings as states of a field, the next two as an input and a measure."""
    w = trajectory(spark, sf, 4, per_field=True)
    return w.select("field", "t", F.slice("w", 1, 2).alias("w"), F.slice("w", 3, 1).alias("u"), F.slice("w", 4, 1).alias("v"), F.lit(True).alias("observed"))


@query(f"""WITH {_TRACK}, d AS (SELECT field, a, b, u, lag(a) OVER o AS a1, lag(b) OVER o AS b1, lead(u) OVER o AS u1, lead(a) OVER o AS y1, lead(b) OVER o AS z1, lead(a, 2) OVER o AS y2, lead(b, 2) OVER o AS z2 FROM w WINDOW o AS (PARTITION BY field ORDER BY t)),
k AS (SELECT * FROM d WHERE a1 IS NOT NULL AND y2 IS NOT NULL)
SELECT field, lead, i, j, round(v + 3e-8, 6) + 0.0 AS v FROM (
SELECT field, 1 AS lead, unnest([0, 0, 0, 0, 0, 1, 1, 1, 1, 1]) AS i, unnest([0, 1, 2, 3, 4, 0, 1, 2, 3, 4]) AS j, unnest([sum(y1 * a), sum(y1 * b), sum(y1 * a1), sum(y1 * b1), sum(y1 * u), sum(z1 * a), sum(z1 * b), sum(z1 * a1), sum(z1 * b1), sum(z1 * u)]) AS v FROM k GROUP BY field
UNION ALL SELECT field, 2, unnest([0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1]), unnest([0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, 5]), unnest([sum(y2 * a), sum(y2 * b), sum(y2 * a1), sum(y2 * b1), sum(y2 * u), sum(y2 * u1), sum(z2 * a), sum(z2 * b), sum(z2 * a1), sum(z2 * b1), sum(z2 * u), sum(z2 * u1)]) FROM k GROUP BY field)""")
def horizon_equations(spark, sf):
    """The left sides of the shrunk maps' normal equations, G (ZZ' + mu I) + nu (G - T) P: the SQL has the right sides, YZ'."""
    mu, lags, horizon = 0.5, 2, 2
    design = stored(H.horizon_design(_track(spark, sf), lags, horizon, "u"), "design")
    family = H.horizon_rows(design, lags, horizon, mu=mu, grid=(0.5, 1.0, 2.0, 4.0))
    z = F.concat("x", "u")
    gram = design.groupBy("field").agg(F.array(*[F.array(*[F.sum(z[p] * z[q]) + (mu if p == q else 0.0) for q in range(6)]) for p in range(6)]).alias("g"))
    both = family.join(gram, "field")
    out = None
    for h in range(1, horizon + 1):
        g = lambda i, p: F.col("map")[i * 4 + p] if p < 4 else F.col("inputs")[i * h + p - 4]  # noqa: B023, E731
        pull = lambda i, j: F.col("nu") * (F.col("map")[i * 4 + j] - F.col("target")[i * 4 + j]) if j < 4 else F.lit(0.0)
        cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), sum((g(i, p) * F.col("g")[p][j] for p in range(4 + h)), pull(i, j)).alias("v")) for i in range(2) for j in range(4 + h)]
        part = both.where(F.col("lead") == h).select("field", "lead", F.explode(F.array(*cells)).alias("c"))
        out = part if out is None else out.unionByName(part)
    return out.select("field", "lead", "c.i", "c.j", (fixed("c.v", 6) + 0.0).alias("v"))


@query(f"""WITH {_TRACK}, k AS (SELECT * FROM (SELECT field, a, b, lag(a) OVER o AS a1, lead(a) OVER o AS y, lead(b) OVER o AS z FROM w WINDOW o AS (PARTITION BY field ORDER BY t)) WHERE a1 IS NOT NULL AND y IS NOT NULL)
SELECT field, i, j, round(v + 3e-8, 6) + 0.0 AS v FROM (SELECT field, unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j, unnest([sum((y - a) * a), sum((y - a) * b), sum((z - b) * a), sum((z - b) * b)]) AS v FROM k GROUP BY field)""")
def kernel_equations(spark, sf):
    """The left sides of the normal equations of a reduced-rank kernel's first block, (A_0 - I)(WW' + mu I), fitted by steps: the SQL
    has the right sides, (Y - W) W'."""
    mu = 0.5
    design = stored(Y.delay_line(_track(spark, sf), 2), "design")
    fit = R.fit_kernels(design, "reduced", mu, rank=1)
    gram = design.groupBy("field").agg(F.array(*[F.array(*[F.sum(F.col("x")[p] * F.col("x")[q]) + (mu if p == q else 0.0) for q in range(2)]) for p in range(2)]).alias("g"))
    step = lambda i, p: F.col("a")[i * 2 + p] - float(i == p)
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (step(i, 0) * F.col("g")[0][j] + step(i, 1) * F.col("g")[1][j]).alias("v")) for i in range(2) for j in range(2)]
    return fit.join(gram, "field").select("field", F.explode(F.array(*cells)).alias("c")).select("field", "c.i", "c.j", (fixed("c.v", 6) + 0.0).alias("v"))


@query(f"""WITH {_TRACK} SELECT field, j, round(v + 3e-8, 6) + 0.0 AS v, n FROM (SELECT field, unnest([0, 1]) AS j, unnest([sum(v * a), sum(v * b)]) AS v, count(*) AS n FROM w GROUP BY field)""")
def emission_equations(spark, sf):
    """The left sides of the emission's normal equations, C (WW' + mu I): the SQL has the right sides, YW'."""
    mu = 0.5
    rows = _track(spark, sf)
    fit = Y.emission_rows(rows.select("field", "t", "w", F.col("v").alias("y")), mu)
    gram = rows.groupBy("field").agg(F.array(*[F.array(*[F.sum(F.col("w")[p] * F.col("w")[q]) + (mu if p == q else 0.0) for q in range(2)]) for p in range(2)]).alias("g"))
    cells = [F.struct(F.lit(j).alias("j"), (F.col("c")[0] * F.col("g")[0][j] + F.col("c")[1] * F.col("g")[1][j]).alias("v")) for j in range(2)]
    return fit.join(gram, "field").select("field", "n", F.explode(F.array(*cells)).alias("x")).select("field", "x.j", (fixed("x.v", 6) + 0.0).alias("v"), "n")


def _days(spark, sf, panel=None):
    """The block archive's days with states and their covariances, an input (rain) and two weather measures as anomalies."""
    k = len(CENTRES)
    pixels, basis = panel or _panel(spark, sf)
    states = X.on_calendar(X.solve_states(pixels, basis, NOISE, True, k), A.calendar(pixels), k, True)
    weather = weather_record(spark, sf).drop("field")
    mean = weather.agg(*[x.alias(f"{c}_{n}") for c in ("ta", "rs") for n, x in (("m", F.avg(c)), ("s", F.stddev(c)))])
    scaled = weather.crossJoin(F.broadcast(mean)).select("date", F.array(F.col("precip") / 10).alias("u"), F.array(*[(F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s") for c in ("ta", "rs")]).alias("m"))
    rows = states.join(scaled, "date", "left").withColumn("u", F.coalesce("u", F.array(F.lit(0.0))))
    return stored(rows.select("field", F.col("t").cast("long").alias("t"), "date", "observed", "w", "cov", "u", "m"), "weather-days")


def _sensor_models(spark, rows):
    """A memory model of each field from its training days, held by rails on their tail, with its weather sensor."""
    train = rows.where(F.col("date") < F.lit(CUT_LI).cast("date"))
    kernels = R.fit_kernels(Y.delay_line(train, LAGS, 1, "u"), "modal", mu=1.0)
    held = R.railed(kernels, 3, R.tail_moments(H.horizon_design(train, LAGS, 3, "u")))
    sensor = Y.emission_rows(train.where("observed and m is not null").select("field", "t", "w", F.col("m").alias("y")), mu=1.0).select("field", "c", "s", "usable")
    # A sensor without skill on the held out days is left out.
    both = held.join(sensor, "field", "left").withColumns({x: F.when(F.col("usable"), F.col(x)) for x in ("c", "s")})
    return stored(both.drop("usable").withColumns({"r": F.lit(NOISE), "start": F.lit(NOISE), "meets": F.lit(True), "inflation": F.lit(0.1)}), "sensor-models")


@query(None)
def forecast_variants(spark, sf):
    """Recursive and direct forecasts, with and without weather, from one filter pass: covariances of frames by day, rails, sensors
    and a horizon family as model rows. Tested against a plain loop in test_filtering."""
    rows = _days(spark, sf)
    models = _sensor_models(spark, rows)
    train = rows.where(F.col("date") < F.lit(CUT_LI).cast("date"))
    family = H.horizon_rows(H.horizon_design(train, LAGS, 3, "u"), LAGS, 3, models, mu=1.0)
    return K.rolling_forecasts(rows.drop("date"), models, None, 3, K.VARIANTS, family=family).select("field", "variant", "origin", "lead", "w", "cov_trace", "valid")


@query(None)
def horizon_coverage(spark, sf):
    """By how much iterated forecasts' errors exceed the direct covariance, by field and lead."""
    rows = _weights(spark, sf).withColumn("u", F.array().cast("array<double>"))
    family = stored(H.horizon_rows(H.horizon_design(rows, LAGS, 3), LAGS, 3, criterion="likelihood", mu=1.0), "family")
    facts = family.select("field", "lead", "nu", "score", "defect", "relative", "normalised")
    return facts.join(H.coverage(family), ["field", "lead"])


@query(None)
def railed_models(spark, sf):
    """Each field's modal memory model with its profile's half-lives, held by rails."""
    w = _weights(spark, sf)
    kernels = stored(R.fit_kernels(Y.delay_line(w, LAGS), "modal", mu=1.0), "kernels")
    held = R.railed(kernels, 3, R.tail_moments(H.horizon_design(w, LAGS, 3)))
    half = R.memory_profile(kernels).groupBy("field").agg(F.max("half_life").alias("half_life"))
    return held.join(half, "field").select("field", "blend", "gain", "radius", "error", "error_persistence", "half_life")


@query(None)
def weather_information(spark, sf):
    """How much of a state's variance one weather update takes away, on days without a frame's help."""
    rows = _days(spark, sf)
    models = _sensor_models(spark, rows)
    days = rows.where("observed")
    k = F.col("k")
    # The newest block of the lifted covariance.
    at = K.states_at(rows.drop("date"), models, days.select("field", "t")).join(models.select("field", "k", "lags"), "field")
    cell = lambda i: F.col("cov")[(F.floor(i / k) * k * F.col("lags") + i % k).cast("int")]
    top = at.select("field", "t", F.transform(F.sequence(F.lit(0), k * k - 1), cell).alias("cov"))
    sensor = Y.emission_rows(days.where("m is not null").select("field", "t", "w", F.col("m").alias("y")), mu=1.0)
    return Y.information_gain(sensor, top).drop("cov")


@query(None)
def excitation_rank(spark, sf):
    rows = _days(spark, sf)
    return Y.excitation(Y.delay_line(rows, 1, 1, "u").select("field", "x", "u"))


@query(None)
def input_response_maps(spark, sf):
    """What a unit of rain does to each pixel in a day."""
    panel = _panel(spark, sf)
    rows = _days(spark, sf, panel)
    return Y.response_maps(R.fit_kernels(Y.delay_line(rows, LAGS, 1, "u"), "full", mu=1.0), panel[1])


def _mode_report(spark, sf):
    from fieldcast.operators.modes import augmented_basis

    pixels, basis = _panel(spark, sf)
    train = pixels.where(F.col("date") < F.lit(CUT_LI).cast("date")).select("field", "date").distinct()
    # Fields of a few pixels cannot hold more modes than pixels; what is left of so few is noise.
    return augmented_basis(pixels, basis, train, most=32)


@query(None)
def mode_counts(spark, sf):
    """Reconstruction of held out days by the number of empirical modes; tested against NumPy in test_modes."""
    return _mode_report(spark, sf)[1]


@query(None)
def augmented_bases(spark, sf):
    """The basis with its modes, climatology and held out variance of each pixel."""
    return _mode_report(spark, sf)[0]


WIDE, DEEP, AHEAD = 64, 7, 6


def _wide(spark, sf):
    """All 64 components of the embeddings as the states of each label, every fifth day without a frame."""
    w = trajectory(spark, sf, WIDE, per_field=True)
    return stored(w.withColumn("observed", F.col("t") % 5 != 4), "wide")


@query(None)
def wide_filtered_states(spark, sf):
    """The filter at the width of whole states: 64 components and a memory of seven days, a lifted state of 448."""
    rows = _wide(spark, sf)
    models = R.fit_kernels(Y.delay_line(rows.withColumn("observed", F.lit(True)), DEEP), "modal", mu=1.0)
    return K.filtered(rows, stored(models.withColumn("r", F.lit(0.01)), "wide-models")).select("field", "t", "w", "cov_trace")


@query(None)
def wide_horizon_family(spark, sf):
    """Six leads of that width by generalised cross-validation, a row of 832 by 832 moments a field."""
    rows = _wide(spark, sf).withColumn("observed", F.lit(True))
    return H.horizon_rows(H.horizon_design(rows, DEEP, AHEAD), DEEP, AHEAD, mu=1.0).select("field", "lead", "nu", "score", "defect", "relative", "normalised", "trace_direct", "trace_iterated")


def _forecast_errors(spark, sf, horizon: int = 3):
    """Decoded forecasts of all test origins with their truth and the standard deviation of their own covariance, the noise and the
    pixel's representation variance on the training days; and the residuals of all frames."""
    from fieldcast.operators import scoring as S
    from fieldcast.plans.model_queries import _models

    pixels, basis = panel = _panel(spark, sf)
    w = _weights(spark, sf, panel)
    cut = F.lit(CUT_LI).cast("date")
    rows = w.select("field", F.col("t").cast("long").alias("t"), "observed", "w")
    origins = w.where(F.col("observed") & (F.col("date") >= cut)).select("field", F.col("t").cast("long").alias("nth"), F.col("date").alias("origin"))
    f = K.rolling_forecasts(rows, _models(spark, sf, w.where(F.col("date") < cut)), None, horizon, K.VARIANTS[:1], covariances=True)
    f = stored(f.where("valid").withColumnRenamed("origin", "nth").join(origins, ["field", "nth"]).select("field", "variant", "origin", "lead", "w", "cov"), "test-forecasts")
    states = w.where("observed").select("field", "date", "w")
    left = X.residuals(pixels, states, basis)
    rep = S.representation_variance(X.residuals(pixels.where(F.col("date") < cut), states, basis)).select("field", "pixel", F.col("variance").alias("rep"))
    own = stored(basis.join(rep, ["field", "pixel"], "left"), "basis")
    errors = X.forecast_errors(f, own, pixels.where(F.col("date") >= cut), ["variant"], len(CENTRES), NOISE)
    return errors.withColumn("sigma", F.sqrt(F.col("variance") + F.coalesce("rep", F.lit(0.0)))), left


@query(None)
def forecast_coverage(spark, sf):
    """How often 90 % intervals of the forecasts' own variance hold the truth, by lead, and the likelihood under that variance."""
    from fieldcast.operators import scoring as S

    sigma = F.col("sigma")
    more = [S.gaussian_nll(F.col("error"), sigma * sigma).alias("nll"), S.r_squared(F.col("value"), F.col("error")).alias("r2")]
    return S.interval_coverage(_forecast_errors(spark, sf)[0], sigma, S.interval_z(0.9), more=more)


@query(None)
def forecast_bias_attribution(spark, sf):
    """The forecasts' bias at the first lead, parted into that of the reconstruction of frames and that of the dynamics."""
    from fieldcast.operators import scoring as S

    errors, left = _forecast_errors(spark, sf)
    encode = left.where(F.col("date") >= F.lit(CUT_LI).cast("date")).agg((-F.avg("residual")).alias("encode_bias"))
    return S.bias_attribution(S.horizon_scores(errors), encode)


@query(None)
def reconstruction_gap(spark, sf):
    """Reconstruction of training frames against later ones, the offset being the training days' climatology."""
    from fieldcast.operators import scoring as S

    pixels, own = _panel(spark, sf)
    early = F.col("date") < F.lit(CUT_LI).cast("date")
    basis = X.climatology_offset(pixels, pixels.where(early).select("field", "date").distinct(), own)
    left = X.residuals(pixels, X.solve_states(pixels, basis, NOISE), basis)
    return S.holdout_errors(left.withColumn("part", F.when(early, "fit").otherwise("holdout")))
