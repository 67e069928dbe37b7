"""Work that must not grow faster than its input, seen in plans and on small tables."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from fieldcast.operators import raster as R
from fieldcast.operators import state as X
from fieldcast.operators import whiteness as T

DAY = dt.date(2021, 3, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_alignment_shuffles_cells_and_not_neighbours(spark):
    """No sum over a target's neighbours after a join, and the same bits in any order of the rows."""
    rng = np.random.default_rng(0)
    rows = [(f, DAY + dt.timedelta(d), i, j, float(rng.random())) for f in range(2) for d in range(300) for i in range(4) for j in range(4) if rng.random() < 0.7]
    source = spark.createDataFrame(rows, "field long, date date, row int, col int, value double")
    grid = spark.createDataFrame([(f, i, j) for f in range(2) for i in range(10) for j in range(10)], "field long, row int, col int")
    to, affine = (30.0, 0, 0.0, 0, -30.0, 0.0), (90.0, 0, -20.0, 0, -90.0, 40.0)
    got = R.aligned(source, grid, to, affine, "cubic")
    assert "sum(" not in plan(got)
    key = lambda r: (r.field, r.date, r.row, r.col)
    one, two = (sorted(R.aligned(s, grid, to, affine, "cubic").collect(), key=key) for s in (source.repartition(7), source.orderBy(F.desc("value"))))
    assert one and one == two


def test_short_vectors_are_multiplied_as_columns(spark):
    basis = spark.createDataFrame([(0, p, [1.0 * p, 2.0, -1.0], 0.5) for p in range(5)], "field long, pixel long, phi array<double>, offset double")
    w = spark.createDataFrame([(0, t, [0.5, 1.0 * t, 3.0]) for t in range(7)], "field long, t long, w array<double>")
    short, plain = X.decode(w, basis, ["t"], 3), X.decode(w, basis, ["t"])
    assert "lambda" not in plan(short) and "lambda" in plan(plain)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, plain.collect())) and short.count() == 35
    got = basis.withColumn("y", F.col("pixel") * 1.5)
    a, b = (X.cross_moments(got, ["field"], "phi", "y", r).first() for r in (3, None))
    assert "Python" not in plan(X.cross_moments(got, ["field"], "phi", "y", 3)) and np.allclose(a.xy, b.xy) and (a.n, a.yy, a.sy) == (b.n, b.yy, b.sy)


def test_step_up_of_one_large_group_is_many_tasks(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, None if i % 50 == 7 else float(np.round(rng.random() ** 3, 3))) for g in (1, 2) for i in range(400)]
    tests = spark.createDataFrame(rows, "g long, i long, p double")
    got = T.benjamini_hochberg(tests, ["g"], F.col("p"), 0.2)
    assert "row_number" not in plan(got)
    for g in (1, 2):
        own = sorted((-1.0 if p is None else p, i) for h, i, p in rows if h == g)
        last = max((p for n, (p, _) in enumerate(own, 1) if 0 <= p <= 0.2 * n / len(own)), default=-1.0)
        assert {r.i for r in got.where(f"g = {g} and reject").collect()} == {i for p, i in own if 0 <= p <= last} != set()
    whole = T.benjamini_hochberg(tests, [], F.col("p"), 0.2)
    assert whole.columns == ["g", "i", "p", "reject"] and whole.count() == 800


def test_a_series_goes_to_a_tile_and_not_to_each_pair(spark, monkeypatch):
    """Tiles of any size give the same sums, and no join has the series of both pixels in a row."""
    from fieldcast.operators import covariogram as C

    rng = np.random.default_rng(3)
    rows = [("a", DAY + dt.timedelta(t), i * 7 + j, i, j, float(rng.standard_normal())) for t in range(40) for i in range(9) for j in range(7) if rng.random() < 0.8]
    z = spark.createDataFrame(rows, "field string, date date, pixel long, row int, col int, z double")
    offs = C.offset_table(spark, [1.0, 2.0, 3.0])
    got = []
    for size in (32, 4):
        monkeypatch.setattr(C, "TILE", size)
        s = C.product_series(z, offs, 2, groups=3)
        got.append(sorted((r.bin, r.u, r.g, r.date, round(r.m, 9), r.n) for r in s.where("kind = 'pair'").collect()))
    assert "za" not in plan(s) and "FlatMapCoGroupsInPandas" in plan(s)
    own = {(r[1], r[3], r[4]): r[5] for r in rows}
    places = {(r[3], r[4]) for r in rows}
    day = DAY + dt.timedelta(5)
    for b in (0, 1):
        want = [own[day, i, j] * own[day, i + p, j + q] for c, p, q, _ in C.offsets([1.0, 2.0, 3.0]) if c == b for i, j in places if (day, i, j) in own and (day, i + p, j + q) in own]
        mine = [r for r in got[0] if r[:2] == (b, 0) and r[3] == day]
        assert sum(r[5] for r in mine) == len(want) and abs(sum(r[4] * r[5] for r in mine) - sum(want)) < 1e-6
    assert got[0] == got[1]


def test_a_field_of_one_block_is_marked_and_means_do_not_hang_on_order(spark):
    from fieldcast.operators import modes as M

    rng = np.random.default_rng(4)
    rows = [("a", DAY + dt.timedelta(t), p, float(rng.standard_normal())) for t in range(30) for p in range(6)]
    pixels = spark.createDataFrame(rows, "field string, date date, pixel long, value double")
    basis = spark.createDataFrame([("a", p, [1.0, float(p)]) for p in range(6)], "field string, pixel long, phi array<double>")
    days = M._days(pixels, 0.2)
    one, two = (M._blocks(x, basis, days, True).first() for x in (pixels.repartition(5), pixels.orderBy("value")))
    assert one.whole and one == two and np.isclose(one.offset[2], np.mean([v for _, d, p, v in rows if p == 2 and d < DAY + dt.timedelta(24)]))


def test_copies_of_pixels_are_counted_before_a_broadcast(spark, tmp_path):
    """A basis whose file is small may be broadcast; its copies for each part of the rows, which are many times that, may not."""
    path, was = str(tmp_path / "basis"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.range(2000).selectExpr("0L AS field", "id AS pixel", "array(1.0D, 2.0D) AS phi", "0.5D AS offset").coalesce(1).write.parquet(path)
    basis = spark.read.parquet(path)
    w = spark.createDataFrame([(0, t, [0.5, 1.0 * t]) for t in range(40)], "field long, t long, w array<double>")
    size = int(str(basis._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(4 * size))
        got = X.decode(w, basis, ["t"], 2)
        assert "BroadcastHashJoin" not in plan(got) and "SortMergeJoin" in plan(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got.count() == 80000 and got.agg(F.sum("pred")).first()[0] == 2000 * (40 * 1.0 + 2 * sum(range(40)))


def _archive(spark):
    """(forecasts, basis, truth) with days without a frame, null values, a pixel of no basis and forecasts of no value."""
    rng = np.random.default_rng(6)
    basis = [(f, p, rng.standard_normal(3).tolist(), None if p == 3 else 0.5 * p) for f in (0, 1) for p in range(6)]
    truth = [(f, DAY + dt.timedelta(t), p, None if rng.random() < 0.1 else float(rng.standard_normal())) for f in (0, 1) for t in range(9) if t != 4 for p in range(7) if rng.random() < 0.8]
    half = rng.standard_normal((3, 2))
    made = [(f, o, DAY + dt.timedelta(t), h, None if t == 2 and h == 1 else rng.standard_normal(3).tolist(), (half @ half.T * (t + h)).ravel().tolist()) for f in (0, 1) for o in (1, 2) for t in range(8) for h in (1, 2)]
    return (
        spark.createDataFrame(made, "field long, order int, date date, lead int, w array<double>, cov array<double>"),
        spark.createDataFrame(basis, "field long, pixel long, phi array<double>, offset double"),
        spark.createDataFrame(truth, "field long, date date, pixel long, value double"),
    )


def test_only_pixels_with_a_value_are_decoded(spark):
    """The same errors as from whole decoded maps, and no copies of the basis in the plan of the scores of memory orders."""
    from fieldcast.operators import operational as O
    from fieldcast.operators import scoring as S

    forecasts, basis, truth = _archive(spark)
    own = forecasts.withColumnRenamed("date", "origin")
    want = S.with_truth(X.decode(own.withColumnRenamed("origin", "day"), basis, ["order", "day", "lead"]).withColumnRenamed("day", "origin"), truth)
    key, cols = ("field", "order", "origin", "lead", "target", "pixel"), ("pred", "value", "error")
    held = {tuple(r[k] for k in key): [r[c] for c in cols] for r in want.collect()}
    for r in (3, None):
        got = {tuple(x[k] for k in key): [x[c] for c in cols] for x in X.forecast_errors(own, basis, truth, ["order"], r).collect()}
        assert got.keys() == held.keys() and len(got) > 200 and all(np.allclose(got[k], held[k]) for k in got)
    scores = O.ablation_scores(forecasts, basis, truth)
    assert "xxhash64" not in plan(scores)
    assert sorted(tuple(np.round(r[2:], 9)) for r in scores.collect()) == sorted(tuple(np.round(r[2:], 9)) for r in S.horizon_scores(want, ("order",)).collect())


def test_the_whole_chain_decodes_no_maps(spark, monkeypatch):
    from fieldcast.plans import model_queries as Q

    monkeypatch.setattr(X, "decode", None)
    got = Q.end_to_end_scores(spark, "/root/testdata/sf0.001")
    assert "xxhash64" not in plan(got) and {r.lead for r in got.collect() if r.variant == "recursive"} == {1, 2, 3}


def test_variance_of_decoded_values_alone(spark):
    """As subspace.bands has it for whole maps, with columns of the basis kept."""
    from fieldcast.operators import subspace as B

    forecasts, basis, truth = _archive(spark)
    own = forecasts.where("w is not null").withColumnRenamed("date", "origin")
    held = {(r.field, r.order, r.origin, r.lead, r.pixel): r.variance for r in B.bands(basis, own, ["order", "origin", "lead"], 0.3).collect()}
    for r in (3, None):
        rows = X.forecast_errors(own, basis.withColumn("rep", F.col("pixel") * 2.0), truth, ["order"], r, 0.3).collect()
        assert len(rows) > 200 and all(np.isclose(x.variance, held[x.field, x.order, x.origin, x.lead, x.pixel]) and x.rep == 2 * x.pixel for x in rows)


def test_coverage_and_bias_of_forecasts_decode_no_maps(spark, monkeypatch):
    from fieldcast.operators import subspace as B
    from fieldcast.plans import dynamics_queries as D

    monkeypatch.setattr(X, "decode", None)
    monkeypatch.setattr(B, "bands", None)
    got = D.forecast_coverage(spark, "/root/testdata/sf0.001")
    assert "xxhash64" not in plan(got) and [r.lead for r in got.orderBy("lead").collect() if 0 < r.coverage <= 1] == [1, 2, 3]
    assert "xxhash64" not in plan(D.forecast_bias_attribution(spark, "/root/testdata/sf0.001"))


def test_drift_of_what_a_subspace_leaves_out_is_not_decoded(spark):
    """The budget of the latent sums is that of decoded maps, for fields of several pixels, with gaps and with a single day."""
    from fieldcast.operators import scoring as S
    from fieldcast.operators import subspace as B

    rng = np.random.default_rng(8)
    basis = spark.createDataFrame([(f, p, rng.standard_normal(3).tolist(), 0.0) for f in (0, 1, 2) for p in range(4 + 3 * f)], "field long, pixel long, phi array<double>, offset double")
    left = spark.createDataFrame([(f, t, rng.standard_normal(3).tolist()) for f, days in ((0, range(0, 5000, 300)), (1, (3, 4, 9)), (2, (7,))) for t in days], "field long, t long, w array<double>")
    resid, now = spark.createDataFrame([(1.0,), (2.0,)], "residual double"), spark.createDataFrame([(3.0,)], "rmse double")
    drift = B.decoded_drift(left, basis)
    one, two = (S.error_budget(resid, x, now, 1.5).first() for x in (drift, X.decode(left, basis, ["t"]).withColumnRenamed("pred", "part")))
    assert "xxhash64" not in plan(drift) and np.allclose(one[:-1], two[:-1]) and one[-1] == two[-1] and one.truncation > 0
    assert tuple(B.decoded_drift(left.where("field = 2"), basis).first())[0] is None and tuple(B.decoded_drift(left.where("false"), basis).first()) == (None, None)


def test_a_calendar_is_no_join(spark):
    """The days of a span are many more rows than Spark takes them for; joined to frames, those of all fields went through the driver."""
    from fieldcast.operators import archive as A

    day = lambda t: DAY + dt.timedelta(t)
    frames = spark.createDataFrame([("a", day(0), 1, 1.0), ("a", day(0), 2, None), ("a", day(3), 1, 2.0), ("b", day(5), 1, 1.0), (None, day(2), 1, 1.0)], "field string, date date, pixel int, value double")
    got = A.calendar(frames)
    assert "Join" not in plan(got.where("observed"))
    assert {(r.field, r.date): (r.t, r.observed) for r in got.collect()} == {("a", day(t)): (t, t in (0, 3)) for t in range(4)} | {("b", day(5)): (0, True), (None, day(2)): (0, False)}
    cut = A.calendar(frames.where("field = 'a'"), F.lit(day(-1)), F.lit(day(2)))
    assert sorted(map(tuple, cut.collect())) == [("a", day(t), t + 1, t == 0) for t in range(-1, 3)]
    marked = spark.createDataFrame([("a", day(0), True), ("a", day(1), False), ("a", day(2), None), ("a", day(3), True)], "field string, date date, observed boolean")
    assert [r.observed for r in A.calendar(marked).orderBy("date").collect()] == [True, False, False, True]
