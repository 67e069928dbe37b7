"""Basis with empirical modes: what a basis cannot express of the training frames, by a block range finder, and how many modes to
take by reconstruction of days that they were not fitted to.

Anomalies lie in blocks of pixels by all days. Everything is sums over blocks: subspace iteration on the days' side, where a
field's matrix is days by modes, then one pass that scores every number of modes from moments. Pixels never leave their
blocks but as the modes' values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.sources.stages import stored

#: Numbers of modes that are tried, up to the most that is asked for. Fixed values.
COUNTS = (0, 4, 8, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512)
#: Passes of the subspace iteration, and directions beside those that are wanted.
PASSES, SPARE = 6, 8
#: Cells of a block, about.
CELLS = 1 << 20
#: Parts in which the sums of all tasks meet before they meet in one.
MEET = 64


def _summed(blocks: DataFrame, state: DataFrame | None, f: Callable[[object], np.ndarray]) -> DataFrame:
    """(field, v): the sum of f(block) over a field's blocks. A block is a row of blocks, with the columns of the field's row of state.
    A task adds its blocks up first; then what tasks have meets in two steps."""
    kind = dict(blocks.dtypes)["field"]
    schema = f"field {kind}, v array<double>"

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for x in frames:
            for r in x.itertuples():
                v = f(r)
                if r.field in held:
                    held[r.field] += v
                else:
                    held[r.field] = v
        yield pd.DataFrame(list(held.items()), columns=["field", "v"])

    def total(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"field": x["field"].iloc[:1], "v": [np.sum(np.stack(x["v"].to_numpy()), axis=0)]})

    rows = blocks if state is None else blocks.join(state, "field")
    parts = rows.mapInPandas(task, schema).withColumn("_meet", F.pmod(F.spark_partition_id(), F.lit(MEET)))
    return parts.groupBy("field", "_meet").applyInPandas(total, schema).groupBy("field").applyInPandas(total, schema)


def _days(train: DataFrame, holdout: float) -> DataFrame:
    """(field, date, t, n_days, cut): days numbered from 0 by date; those from cut on are held out."""
    w = Window.partitionBy("field")
    own = train.select("field", "date").distinct()
    own = own.select("field", "date", (F.row_number().over(w.orderBy("date")) - 1).alias("t"), F.count("*").over(w).cast("int").alias("n_days"))
    cut = F.greatest(F.lit(2), F.least(F.rint(F.col("n_days") * (1.0 - holdout)), F.col("n_days") - 2)) if holdout else F.col("n_days")
    return own.withColumn("cut", cut.cast("int"))


def _blocks(pixels: DataFrame, basis: DataFrame, days: DataFrame, climatology: bool) -> DataFrame:
    """(field, block, whole, n_days, cut, pixel, offset, phi, a): whether it is all of its field, anomalies a of a block's pixels on all days, phi of each pixel, row by row. The
    offset of a pixel is its mean over the days before cut; a cell without a value counts as its offset."""
    cells = pixels.where("value is not null").select("field", "date", "pixel", "value").join(days, ["field", "date"])
    size = basis.groupBy("field").agg(F.count("*").alias("pixels")).join(days.select("field", "n_days", "cut").distinct(), "field")
    many = F.greatest(F.lit(1), F.ceil(F.col("pixels") * F.col("n_days") / CELLS))
    at = F.pmod(F.xxhash64("pixel"), many).alias("block")
    own = basis.select("field", "pixel", "phi").join(size, "field").select("field", at, (many == 1).alias("whole"), "pixel", "phi", "n_days", "cut")
    dealt = cells.select("field", "pixel", "t", "value").join(size, "field").select("field", at, "pixel", "t", "value")
    kinds = dict(own.dtypes)
    schema = f"field {kinds['field']}, block long, whole boolean, n_days int, cut int, pixel array<{kinds['pixel']}>, offset array<double>, phi array<double>, a array<double>"

    def build(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])
        p = p.sort_values("pixel").reset_index(drop=True)
        place, cut = {x: i for i, x in enumerate(p["pixel"])}, int(p["cut"].iloc[0])
        a = np.full((len(p), int(p["n_days"].iloc[0])), np.nan)
        if len(c):
            i = c["pixel"].map(place).to_numpy()
            some = ~pd.isna(i)
            a[i[some].astype(int), c["t"].to_numpy()[some]] = c["value"].to_numpy(float)[some]
        # By place, so that the order of the rows changes nothing.
        seen = ~np.isnan(a)
        n = seen[:, :cut].sum(1)
        offset = np.where(seen, a, 0.0)[:, :cut].sum(1) / np.maximum(n, 1) if climatology else np.zeros(len(p))
        a = np.where(seen, a - offset[:, None], 0.0)
        return pd.DataFrame([(p["field"].iloc[0], int(p["block"].iloc[0]), bool(p["whole"].iloc[0]), a.shape[1], cut, p["pixel"].to_numpy(), offset, np.stack(p["phi"].to_numpy()).ravel(), a.ravel())], columns=[x.split()[0] for x in schema.split(", ")])

    return own.groupBy("field", "block").cogroup(dealt.groupBy("field", "block")).applyInPandas(build, schema)


def _block(r) -> tuple[np.ndarray, np.ndarray]:
    """(phi, anomalies) of a block row."""
    n = len(r.pixel)
    return np.asarray(r.phi).reshape(n, -1), np.asarray(r.a).reshape(n, -1)


def _left(r, phi: np.ndarray, a: np.ndarray) -> np.ndarray:
    """What the basis leaves of the anomalies of the days that modes are fitted to."""
    cut = int(r.cut)
    return a[:, :cut] - phi @ np.asarray(r.coef).reshape(phi.shape[1], -1)[:, :cut]


def _range(blocks: DataFrame, ridge: float, most: int, seed: int) -> DataFrame:
    """(field, n_days, cut, r, coef, v, s2, total, phi_v): for each field the ridge's coefficients of all days, and the leading days' side
    singular vectors v (cut by q) of what the basis leaves of the days before cut, with the squares s2 of their singular
    values, total the sum of all, and phi' X v.

    Subspace iteration on X'X from a seeded start; with few days it has all directions and is exact at once.
    """
    kind = dict(blocks.dtypes)["field"]

    def products(r) -> np.ndarray:
        phi, a = _block(r)
        return np.concatenate([(phi.T @ phi).ravel(), (phi.T @ a).ravel()])

    sizes = blocks.groupBy("field").agg(F.first("n_days").alias("n_days"), F.first("cut").alias("cut"), F.first(F.size("phi") / F.size("pixel")).cast("int").alias("r"))
    head = f"field {kind}, n_days int, cut int, r int, gram array<double>, cross array<double>, coef array<double>, z array<double>"

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for x in f.itertuples():
                v, r, n, cut = np.asarray(x.v), int(x.r), int(x.n_days), int(x.cut)
                gram, cross = v[: r * r].reshape(r, r), v[r * r :].reshape(r, n)
                coef = np.linalg.solve(gram + ridge * np.eye(r), cross)
                wide = min(cut, most + SPARE)
                z = np.eye(cut) if wide == cut else np.linalg.qr(np.random.default_rng(seed).standard_normal((cut, wide)))[0]
                out.append((x.field, n, cut, r, gram.ravel(), cross.ravel(), coef.ravel(), z.ravel()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in head.split(", ")])

    several = blocks.where("not whole")
    state = stored(_summed(several, None, products).join(sizes, "field").mapInPandas(begin, head), "range")

    def power(r) -> np.ndarray:
        phi, a = _block(r)
        x = _left(r, phi, a)
        y = x @ np.asarray(r.z).reshape(x.shape[1], -1)
        return np.concatenate([(x.T @ y).ravel(), [(x * x).sum()]])

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["z"] = [np.linalg.qr(np.asarray(v)[:-1].reshape(int(cut), -1))[0].ravel() for v, cut in zip(f["v"], f["cut"], strict=True)]
            yield f.drop(columns="v")[[c.split()[0] for c in head.split(", ")]]

    parts = several.drop("n_days", "offset", "block", "cut")
    need = lambda: state.select("field", "cut", "coef", "z")
    for _ in range(PASSES):
        state = stored(_summed(parts, need(), power).join(state, "field").mapInPandas(turn, head), "range")

    def end(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for x in f.itertuples():
                cut, r = int(x.cut), int(x.r)
                w, z = np.asarray(x.v)[:-1].reshape(cut, -1), np.asarray(x.z).reshape(cut, -1)
                s2, u = np.linalg.eigh(z.T @ w)
                order = np.argsort(-s2)[:most]
                order = order[s2[order] > 1e-12 * max(s2.max(), 1e-300)]
                v = z @ u[:, order]
                left = np.asarray(x.cross).reshape(r, -1)[:, :cut] - np.asarray(x.gram).reshape(r, r) @ np.asarray(x.coef).reshape(r, -1)[:, :cut]
                out.append((x.field, int(x.n_days), cut, r, x.gram, x.coef, v.ravel(), s2[order], float(x.v[-1]), (left @ v).ravel()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in tail.split(", ")])

    tail = f"field {kind}, n_days int, cut int, r int, gram array<double>, coef array<double>, v array<double>, s2 array<double>, total double, phi_v array<double>"

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The same steps for fields of one block, which need nothing from elsewhere."""
        for f in frames:
            for r in f.itertuples():
                first = pd.DataFrame([(r.field, products(r), r.n_days, r.cut, len(r.phi) // len(r.pixel))], columns=["field", "v", "n_days", "cut", "r"])
                own = next(begin(iter([first])))
                told = lambda: power(SimpleNamespace(pixel=r.pixel, phi=r.phi, a=r.a, cut=r.cut, coef=own["coef"].iloc[0], z=own["z"].iloc[0]))  # noqa: B023, E731
                for _ in range(PASSES):
                    own = next(turn(iter([own.assign(v=[told()])])))
                yield next(end(iter([own.assign(v=[told()])])))

    apart = blocks.where("whole").select("field", "n_days", "cut", "pixel", "phi", "a").mapInPandas(alone, tail)
    return stored(_summed(parts, need(), power).join(state, "field").mapInPandas(end, tail).unionByName(apart), "range")


def _shapes(r, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(to, off, back): a block's orthonormal modes are (X v to - phi off) back, with the directions X v / s freed from what the basis can
    express and then made orthonormal in their order. All from the field's own numbers."""
    k, q = int(r.r), len(r.s2)
    s = np.sqrt(np.asarray(r.s2))
    phi_d = np.asarray(r.phi_v).reshape(k, q) / s
    gram = np.asarray(r.gram).reshape(k, k)
    off = np.linalg.solve(gram + ridge * np.eye(k), phi_d)
    h = np.eye(q) - phi_d.T @ off - off.T @ phi_d + off.T @ gram @ off
    back = np.linalg.inv(np.linalg.cholesky((h + h.T) / 2 + 1e-14 * np.eye(q))).T
    return np.diag(1 / s), off, back


def _modes_of(r, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phi, anomalies, orthonormal modes) of a block row with its field's numbers."""
    phi, a = _block(r)
    if not len(r.s2):
        return phi, a, np.zeros((len(phi), 0))
    to, off, back = _shapes(r, ridge)
    x = _left(r, phi, a)
    return phi, a, (x @ (np.asarray(r.v).reshape(x.shape[1], -1) @ to) - phi @ off) @ back


def _scored(blocks: DataFrame, state: DataFrame, ridge: float, counts: tuple[int, ...]) -> DataFrame:
    """(field, q, rmse_fit, rmse_holdout, explained, scale): for each number of modes the root mean square error of days' round trips
    through the basis and so many modes, from one pass of moments; scale is what the modes are multiplied by."""
    kind = dict(blocks.dtypes)["field"]

    def products(r) -> np.ndarray:
        phi, a, m = _modes_of(r, ridge)
        s = np.hstack([phi, m])
        return np.concatenate([(s.T @ s).ravel(), (s.T @ a).ravel(), (a * a).sum(0), [len(a)]])

    schema = f"field {kind}, q int, rmse_fit double, rmse_holdout double, explained double, scale double"

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for x in f.itertuples():
                k, top, n, cut, v = int(x.r), len(x.s2), int(x.n_days), int(x.cut), np.asarray(x.v2)
                size = k + top
                gram, cross, own, pixels = v[: size * size].reshape(size, size), v[size * size : size * (size + n)].reshape(size, n), v[-n - 1 : -1], v[-1]
                for q in sorted({min(c, top) for c in counts}):
                    scale = float(np.sqrt(np.trace(gram[:k, :k]) / max(q, 1)))
                    d = np.r_[np.ones(k), np.full(q, scale)]
                    g, c = gram[: k + q, : k + q] * np.outer(d, d), cross[: k + q] * d[:, None]
                    coef = np.linalg.solve(g + ridge * np.eye(k + q), c)
                    rest = np.maximum(own - 2 * (coef * c).sum(0) + (coef * (g @ coef)).sum(0), 0)
                    rmse = lambda e: float(np.sqrt(e.mean() / pixels)) if len(e) else float("nan")  # noqa: B023, E731
                    out.append((x.field, q, rmse(rest[:cut]), rmse(rest[cut:]), float(np.sum(x.s2[:q]) / max(x.total, 1e-30)), scale))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    got = _summed(blocks.drop("n_days", "offset", "block", "cut"), state.drop("total", "n_days"), products).withColumnRenamed("v", "v2")
    return stored(got.join(state, "field").mapInPandas(solve, schema), "scores")


def _per_pixel(blocks: DataFrame, state: DataFrame, chosen: DataFrame, ridge: float, variance: bool) -> DataFrame:
    """(field, pixel, phi, offset, modes, variance): a row for each pixel. variance: mean square of what the round trip leaves on the days
    held out, if these are asked for."""
    kinds = dict(blocks.dtypes)
    schema = f"field {kinds['field']}, pixel {kinds['pixel'][6:-1]}, phi array<double>, offset double, modes array<double>, variance double"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = blocks.drop("n_days", "cut", "block").join(state.drop("total"), "field").join(chosen, "field")

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                phi, a, m = _modes_of(r, ridge)
                m = m[:, : int(r.q)] * r.scale
                var = np.full(len(phi), np.nan)
                if variance:
                    held = a[:, int(r.cut) :]
                    var = ((held - np.hstack([phi, m]) @ np.asarray(r.back).reshape(-1, held.shape[1])) ** 2).mean(1)
                yield pd.DataFrame({"field": r.field, "pixel": r.pixel, "phi": list(phi), "offset": r.offset, "modes": list(m), "variance": var})[names]

    return rows.mapInPandas(task, schema)


def _held_coefficients(blocks: DataFrame, state: DataFrame, chosen: DataFrame, ridge: float) -> DataFrame:
    """chosen with back: the coefficients of the days held out on the basis with its modes."""
    kind = dict(blocks.dtypes)["field"]

    def products(r) -> np.ndarray:
        phi, a, m = _modes_of(r, ridge)
        s = np.hstack([phi, m[:, : int(r.q)] * r.scale])
        return np.concatenate([(s.T @ s).ravel(), (s.T @ a[:, int(r.cut) :]).ravel()])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for x in f.itertuples():
                n, v = int(x.r) + int(x.q), np.asarray(x.v2)
                out.append((x.field, int(x.q), x.scale, np.linalg.solve(v[: n * n].reshape(n, n) + ridge * np.eye(n), v[n * n :].reshape(n, -1)).ravel()))
            yield pd.DataFrame(out, columns=["field", "q", "scale", "back"])

    both = state.drop("total", "n_days").join(chosen, "field")
    got = _summed(blocks.drop("n_days", "offset", "block", "cut"), both, products).withColumnRenamed("v", "v2")
    return got.join(both.select("field", "r", "q", "scale"), "field").mapInPandas(solve, f"field {kind}, q int, scale double, back array<double>")


def augmented_basis(
    pixels: DataFrame, basis: DataFrame, train: DataFrame, most: int = 96, select: str = "holdout", energy: float = 0.999, ridge: float = 1e-2, holdout: float = 0.2,
    climatology: bool = True, seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(basis, report): a basis with a climatology as offset and empirical modes behind phi, from the training days alone.

    basis: (field, pixel, phi, offset, variance), phi with the modes, made orthogonal to what it had and of its mean size; variance
    of a pixel is what the held out days' round trip leaves. report: (field, q, rmse_fit, rmse_holdout, explained, chosen,
    gap, binding), a row for each number of modes tried up to `most`; gap is the held out error over the fitted one, binding
    says that the most that was tried won.

    select "holdout": the number with the least error on the last `holdout` of a field's training days, with offset and modes
    from the days before them; equal errors: the smaller. "energy": the first that spans so much of what the basis leaves, `most`
    at most; its error on held out days is reported too. The basis then comes from all training days. Fields need four days.
    """
    if select not in ("holdout", "energy"):
        raise ValueError(f"select {select!r} is neither holdout nor energy")
    tried = tuple(sorted({c for c in COUNTS if c <= most} | {most}))
    held = stored(_blocks(pixels, basis, _days(train, holdout), climatology), "blocks")
    first = _range(held, ridge, most, seed)
    every = stored(_blocks(pixels, basis, _days(train, 0.0), climatology), "blocks")
    last = _range(every, ridge, most, seed)
    if select == "energy":
        # As many modes as reach the energy on all training days, a number that need not be one of those tried.
        reach = F.transform(F.sequence(F.lit(1), F.size("s2")), lambda i: F.aggregate(F.slice("s2", 1, i), F.lit(0.0), lambda a, b: a + b) / F.greatest("total", F.lit(1e-30)))
        wanted = last.select("field", F.when(F.size("s2") > 0, F.least(F.size("s2"), F.size(F.filter(reach, lambda e: e < energy)) + 1)).otherwise(0).alias("want"))
        counts = tuple(sorted({*tried, *[r.want for r in wanted.select("want").distinct().collect()]}))
    else:
        counts = tried
    scores = _scored(held, first, ridge, counts)
    if select == "holdout":
        best = scores.groupBy("field").agg(F.min(F.struct("rmse_holdout", "q")).alias("b")).select("field", F.col("b.q").alias("want"))
    else:
        best = wanted
    top = scores.groupBy("field").agg(F.max("q").alias("top"))
    met = scores.join(best, "field").join(top, "field").withColumn("want", F.least("want", "top"))
    report = met.select(
        "field", "q", "rmse_fit", "rmse_holdout", "explained", (F.col("q") == F.col("want")).alias("chosen"),
        (F.col("rmse_holdout") / F.greatest("rmse_fit", F.lit(1e-12))).alias("gap"), ((F.col("want") == F.col("top")) & (F.col("top") == most) & (F.col("q") == F.col("want"))).alias("binding"),
    )
    picked = met.where("q = want").select("field", "q", "scale")
    spread = _per_pixel(held, first, _held_coefficients(held, first, picked, ridge), ridge, True).select("field", "pixel", "variance")
    norm = last.select("field", F.expr("aggregate(sequence(0, r - 1), 0D, (s, i) -> s + gram[i * r + i])").alias("size"), F.size("s2").alias("have"))
    count = F.least("q", "have")
    final = picked.join(norm, "field").select("field", count.cast("int").alias("q"), F.sqrt(F.col("size") / F.greatest(count, F.lit(1))).alias("scale"))
    made = _per_pixel(every, last, final, ridge, False).drop("variance").join(spread, ["field", "pixel"])
    return made.select("field", "pixel", F.concat("phi", "modes").alias("phi"), "offset", "variance"), report
