"""Preference-model fits: one distributed fit, many small per-user fits, bootstrap, calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom import constants as c
from prefloom.functions.hashing import coin
from prefloom.functions.vectors import dot, literal
from prefloom.session import landed

CUTS = c.RATING_LEVELS - 1
# Thresholds enter as features scaled by this factor, so the ridge penalty on them all but vanishes.
THRESHOLD_SCALE = 100.0
# Rows of one task of a distributed fit.
TASK_ROWS = 1 << 16
# Tasks whose sums the driver adds up itself; those of more are merged in two levels before.
DIRECT = 16


@dataclass(frozen=True)
class PreferenceModel:
    """Utility weights and, when ratings were seen, ordered thresholds."""

    weights: tuple[float, ...]
    thresholds: tuple[float, ...] | None
    objective: float


def ordered(thresholds) -> tuple[float, ...]:
    """Strictly increasing thresholds with the minimum gap."""
    out: list[float] = []
    for t in thresholds:
        out.append(float(t) if not out else max(float(t), out[-1] + c.MIN_THRESHOLD_GAP))
    return tuple(out)


def _expanded(ratings: DataFrame, head: Column, scale: float) -> DataFrame:
    """Four binary rows per rating: value above level k, with -scale in the k-th threshold slot."""
    slots = [F.array(*[F.lit(-scale if j == k else 0.0) for j in range(CUTS)]) for k in range(CUTS)]
    level = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("k"), s.alias("slot")) for k, s in enumerate(slots)]))
    rows = ratings.select("*", level.alias("level"))
    return rows.withColumn("features", F.concat(head, F.col("level.slot"))).withColumn(
        "label", (F.col("value") > F.col("level.k")).cast("double")
    )


def collapsed(rows: DataFrame, *keys: str) -> DataFrame:
    """Events that agree in ``keys`` as one row with their summed weight ``w``, which no objective tells apart."""
    return rows.groupBy(*keys).agg(F.sum("w").alias("w"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores, or over more tasks where a task would get more than ``TASK_ROWS``."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks)


def training_rows(pairs: DataFrame | None, ratings: DataFrame | None) -> DataFrame:
    """Weighted binary rows whose logistic loss is the joint objective.

    ``pairs`` has x, y and w; ``ratings`` has x, value and w (multiplicities). Every source has
    the mean loss of its own rows and both sources count equally.
    """
    parts = []
    sources = [s for s in (pairs, ratings) if s is not None]
    share = 1.0 / len(sources)
    with_cuts = ratings is not None
    if pairs is not None:
        total = pairs.agg(F.sum("w")).first()[0] or 1.0
        head = F.concat("x", literal([0.0] * CUTS)) if with_cuts else F.col("x")
        parts.append(pairs.select(head.alias("features"), F.col("y").alias("label"), (F.col("w") * (share / total)).alias("weight")))
    if ratings is not None:
        total = ratings.agg(F.sum("w")).first()[0] or 1.0
        rows = _expanded(ratings, F.col("x"), THRESHOLD_SCALE)
        parts.append(rows.select("features", "label", (F.col("w") * (share / (total * CUTS))).alias("weight")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.filter(F.col("weight") > 0).withColumn("features", array_to_vector("features"))


def fit_joint(pairs: DataFrame | None, ratings: DataFrame | None, l2: float = c.L2, iterations: int = 100) -> PreferenceModel:
    """Distributed fit of pairwise choices and ratings as one weighted logistic regression.

    Only the coefficient vector returns to the driver; gradients are tree-aggregated. Events that are alike become one
    row, and rows are spread over tasks of bounded size once, as every iteration passes over them.
    """
    pairs = None if pairs is None else collapsed(pairs, "x", "y")
    ratings = None if ratings is None else collapsed(ratings, "x", "value")
    rows = spread(training_rows(pairs, ratings)).persist()
    try:
        fit = LogisticRegression(
            featuresCol="features", labelCol="label", weightCol="weight", fitIntercept=False,
            standardization=False, regParam=l2, elasticNetParam=0.0, maxIter=iterations, tol=1e-7,
        ).fit(rows)
        coefficients = fit.coefficients.toArray()
        objective = float(fit.summary.objectiveHistory[-1])
    finally:
        rows.unpersist()
    if ratings is None:
        return PreferenceModel(tuple(coefficients.tolist()), None, objective)
    weights = coefficients[:-CUTS]
    return PreferenceModel(tuple(weights.tolist()), ordered(coefficients[-CUTS:] * THRESHOLD_SCALE), objective)


def fit_bradley_terry(pairs: DataFrame, l2: float = c.L2) -> PreferenceModel:
    return fit_joint(pairs, None, l2)


def calibrate_thresholds(ratings: DataFrame) -> tuple[float, ...]:
    """Thresholds for fixed utilities as a binomial GLM with the utility as offset.

    ``ratings`` has utility and value. A value range without both sides of a level has no finite
    optimum; the smoothed starting cutpoints are used then.
    """
    from prefloom.operators.metrics import initial_cutpoints

    summary = ratings.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    if summary["low"] > 1 or summary["high"] < c.RATING_LEVELS:
        return ordered(initial_cutpoints(ratings.withColumn("_all", F.lit(1)), ["_all"]).first()["cutpoints"])
    rows = _expanded(ratings, F.array().cast("array<double>"), 1.0).withColumn("features", array_to_vector("features"))
    fit = GeneralizedLinearRegression(
        family="binomial", link="logit", offsetCol="utility", fitIntercept=False, featuresCol="features", labelCol="label", maxIter=50,
    ).fit(rows.select("features", "label", "utility"))
    return ordered(fit.coefficients.toArray())


def multiplicity(seed: str, member: int, *group: str) -> Column:
    """How often a group is drawn into a bootstrap member.

    Independent Poisson(1) counts from a hash: the distributed form of drawing as many groups
    as there are with replacement. Sources are re-weighted by their sampled rows afterwards.
    """
    u = coin(F.lit(f"{seed}:{member}"), *group)
    out, cumulative, mass = F.lit(0.0), 0.0, float(np.exp(-1.0))
    k = 0
    while 1.0 - cumulative > 1e-16 and mass > 0.0:  # every count a hash fraction can reach
        cumulative += mass
        out = out + (u >= cumulative).cast("double")
        k += 1
        mass /= k
    return out


def _member_rows(pairs: DataFrame | None, ratings: DataFrame | None, draws: list[list[Column]]) -> DataFrame:
    """x, target, rated, w: one row per event with its weight in every member."""
    parts = []
    for rows, rated, target, own in ((pairs, False, "y", draws[0]), (ratings, True, "value", draws[1])):
        if rows is not None:
            w = F.array(*[F.col("w") * m for m in own])
            parts.append(rows.select("x", F.col(target).cast("double").alias("target"), F.lit(rated).alias("rated"), w.alias("w")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _partial(beta: np.ndarray, scale: np.ndarray, cuts: int):
    """Loss, gradient and curvature of all members over the rows of a task.

    ``beta`` has a row per member; ``scale`` a weight per source and member.
    """
    members, size = beta.shape
    d = size - cuts

    def run(batches):
        loss, gradient, curvature = np.zeros(members), np.zeros((members, size)), np.zeros((members, size, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            w = batch["w"].flatten().to_numpy(zero_copy_only=False).reshape(-1, members)
            target, rated = np.asarray(batch["target"]), np.asarray(batch["rated"])
            for source, own in ((0, ~rated), (1, rated)):
                if not own.any():
                    continue
                a, t, v = x[own], target[own], w[own] * scale[source]
                utility, bends = a @ beta[:, :d].T, np.zeros((len(a), members))
                for k in range(cuts) if source else (-1,):
                    s = utility - beta[:, d + k] if source else utility
                    y = (t > k + 1)[:, None] if source else t[:, None]
                    p = 0.5 * (1.0 + np.tanh(0.5 * s))
                    loss += (v * (np.logaddexp(0.0, s) - y * s)).sum(axis=0)
                    pull, bend = v * (p - y), v * p * (1.0 - p)
                    gradient[:, :d] += pull.T @ a
                    if source:
                        gradient[:, d + k] -= pull.sum(axis=0)
                    bends += bend
                    if source:
                        cross = bend.T @ a
                        curvature[:, :d, d + k] -= cross
                        curvature[:, d + k, :d] -= cross
                        curvature[:, d + k, d + k] += bend.sum(axis=0)
                # the levels of a rating share its row, so their curvature is one product
                for m in range(members):
                    curvature[m, :d, :d] += (a * bends[:, m, None]).T @ a
        flat = np.concatenate([loss[:, None], gradient, curvature.reshape(members, -1)], axis=1)
        yield pa.RecordBatch.from_pydict({"member": np.arange(members), "part": np.full(members, TaskContext.get().partitionId() % 32), "sums": flat.tolist()})

    return run


def _added(rows):
    total = rows["sums"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1).sum(axis=0)
    return pa.table({"member": rows["member"].slice(0, 1), "part": rows["part"].slice(0, 1), "sums": [total.tolist()]})


def fit_members(rows: DataFrame, dimensions: int, l2: float = c.L2, steps: int = 40, tolerance: float = 1e-12) -> list[PreferenceModel]:
    """All members of an ensemble by Newton's method, one pass over the rows for a step of all of them.

    ``rows`` are :func:`_member_rows`. Tasks add up loss, gradient and curvature of every member, which are merged in
    two levels where tasks are many; only these sums, whose size is the number of parameters squared, reach the driver. A member
    whose loss would rise halves its step. The objective is that of :func:`fit_joint`.
    """
    rows = spread(rows).persist()
    schema = "member bigint, part bigint, sums array<double>"
    try:
        members, tasks = len(rows.first()["w"]), rows.rdd.getNumPartitions()
        sums = [F.array(*[F.sum(F.when(F.col("rated") == rated, F.col("w")[m])) for m in range(members)]) for rated in (False, True)]
        totals = np.array([[t or 0.0 for t in side] for side in rows.agg(*sums).first()])
        cuts = CUTS if totals[1].any() else 0
        share = 1.0 / np.maximum((totals > 0).sum(axis=0), 1)
        with np.errstate(divide="ignore"):
            scale = np.where(totals > 0, share / totals, 0.0)
        scale[1] /= CUTS
        size = dimensions + cuts
        ridge = np.concatenate([np.full(dimensions, l2), np.full(cuts, l2 / THRESHOLD_SCALE**2)])

        def evaluate(beta):
            partial = rows.mapInArrow(_partial(beta, scale, cuts), schema)
            if tasks > DIRECT:
                partial = partial.groupBy("member", "part").applyInArrow(_added, schema).groupBy("member").applyInArrow(_added, schema)
            flat = np.zeros((members, 1 + size + size * size))
            for r in partial.collect():
                flat[r["member"]] += r["sums"]
            loss = flat[:, 0] + 0.5 * (beta**2) @ ridge
            return loss, flat[:, 1:1 + size] + beta * ridge, flat[:, 1 + size:].reshape(members, size, size) + np.diag(ridge)

        beta = np.zeros((members, size))
        loss, gradient, curvature = evaluate(beta)
        length, done = np.ones(members), np.zeros(members, bool)
        for _ in range(steps):
            move = np.array([np.linalg.solve(h, g) for h, g in zip(curvature, gradient)]) * length[:, None]
            move[done] = 0.0
            new = evaluate(beta - move)
            better = new[0] <= loss
            done |= better & (loss - new[0] < tolerance) | (length < 1e-6)
            beta[better] -= move[better]
            loss = np.where(better, new[0], loss)
            gradient[better], curvature[better] = new[1][better], new[2][better]
            length = np.where(better, 1.0, length / 2)
            if done.all():
                break
    finally:
        rows.unpersist()
    return [
        PreferenceModel(tuple(b[:dimensions].tolist()), ordered(b[dimensions:]) if cuts and totals[1][m] else None, float(loss[m]))
        for m, b in enumerate(beta)
    ]


def bootstrap(
    pairs: DataFrame | None, ratings: DataFrame | None, primary: PreferenceModel | None, seed: str, members: int = c.ENSEMBLE_MEMBERS
) -> list[PreferenceModel]:
    """The primary fit and refits on resampled pair and image groups, all refits in one.

    Without a ``primary`` the fit on all rows is one more member.
    """
    refits = range(1, members)
    plain = [F.lit(1.0)] if primary is None else []
    group = [F.least("left_id", "right_id").cast("string"), F.greatest("left_id", "right_id").cast("string")]
    draws = [
        plain + [multiplicity(seed, m, *group) for m in refits],
        plain + [multiplicity(seed + "r", m, F.col("image_id").cast("string")) for m in refits],
    ]
    if not draws[0]:
        return [primary]
    # events of a drawn group that are alike are drawn together
    pairs = None if pairs is None else collapsed(pairs, "x", "y", "left_id", "right_id")
    ratings = None if ratings is None else collapsed(ratings, "x", "value", "image_id")
    rows = landed(_member_rows(pairs, ratings, draws))
    head = rows.select(F.size("x")).first()
    fitted = fit_members(rows, head[0])
    return fitted if primary is None else [primary, *fitted]


def ensemble_scores(embeddings: DataFrame, ensemble: list[PreferenceModel], beta: float = 1.0) -> DataFrame:
    """Mean and spread of the members' utilities and the upper-confidence acquisition score."""
    scores = F.array(*[dot(F.col("vector"), literal(m.weights)) for m in ensemble])
    n = float(len(ensemble))
    mean = F.aggregate("scores", F.lit(0.0), lambda s, x: s + x) / n
    rows = embeddings.withColumn("scores", scores).withColumn("mean_utility", mean)
    deviation = F.sqrt(F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.pow(x - F.col("mean_utility"), 2)) / n)
    rows = rows.withColumn("utility_std", deviation).drop("scores")
    return rows.withColumn("acquisition", F.col("mean_utility") + F.lit(beta) * F.col("utility_std"))


# -- many small users ----------------------------------------------------------

USER_MODEL = "user_id bigint, weights array<double>, thresholds array<double>, objective double, pairs bigint, ratings bigint"


def _newton(x, y, z, v, l2: float, steps: int = 40, weight=None, floor: float = 0.0):
    """Joint objective of one user by Newton's method. Returns parameters and objective.

    ``weight`` holds how often each pair and each rating counts; ``floor`` is the ridge on thresholds.
    """
    d = x.shape[1] if len(x) else z.shape[1]
    cuts = CUTS if len(z) else 0
    ridge = np.concatenate([np.full(d, l2), np.full(cuts, floor)])  # weights only, unless a floor is set
    wx, wz = weight or (np.ones(len(x)), np.ones(len(z)))
    share = 1.0 / max(int(wx.sum() > 0) + int(wz.sum() > 0), 1)
    # rows that a member does not draw add nothing to its sums
    x, y, wx = x[wx > 0], y[wx > 0], wx[wx > 0]
    z, v, wz = z[wz > 0], v[wz > 0], wz[wz > 0]
    wx = wx * (share / wx.sum()) if len(wx) else wx
    wz = wz * (share / (wz.sum() * cuts)) if len(wz) else wz
    above = (v[:, None] > np.arange(1, cuts + 1)).astype(float)
    level = np.arange(d, d + cuts)

    def evaluate(beta):
        total = 0.5 * float(ridge @ beta**2)
        gradient, hessian = ridge * beta, np.diag(ridge)
        if len(wx):
            s = x @ beta[:d]
            total += float(np.sum(wx * (np.logaddexp(0.0, s) - y * s)))
            p = 0.5 * (1.0 + np.tanh(0.5 * s))
            gradient[:d] += x.T @ (wx * (p - y))
            hessian[:d, :d] += (x * (wx * p * (1.0 - p))[:, None]).T @ x
        if len(wz):
            s = (z @ beta[:d])[:, None] - beta[d:]
            total += float(np.sum(wz[:, None] * (np.logaddexp(0.0, s) - above * s)))
            p = 0.5 * (1.0 + np.tanh(0.5 * s))
            pull, bend = wz[:, None] * (p - above), wz[:, None] * p * (1.0 - p)
            gradient[:d] += z.T @ pull.sum(axis=1)
            gradient[d:] -= pull.sum(axis=0)
            # the levels of a rating share its row, so their curvature is one product
            hessian[:d, :d] += (z * bend.sum(axis=1)[:, None]).T @ z
            cross = z.T @ bend
            hessian[:d, d:] -= cross
            hessian[d:, :d] -= cross.T
            hessian[level, level] += bend.sum(axis=0)
        return total, gradient, hessian

    beta = np.zeros(d + cuts)
    value, gradient, hessian = evaluate(beta)
    for _ in range(steps):
        direction = np.linalg.solve(hessian, gradient)
        scale = 1.0
        while scale > 1e-6:
            trial = evaluate(beta - scale * direction)
            if trial[0] <= value:
                break
            scale *= 0.5
        beta = beta - scale * direction
        if value - trial[0] < 1e-13:
            value = trial[0]
            break
        value, gradient, hessian = trial
    return beta, value


def _fit_user_members(key, pairs, ratings):
    """The user's fit with the weights and thresholds of its bootstrap members."""
    row = _fit_user(key, pairs, ratings)
    row["ensemble_weights"], row["ensemble_thresholds"] = None, None
    if not len(row):
        return row
    pairs, ratings = pairs.sort_values("id"), ratings.sort_values("id")
    x, z = (np.array(f["x"].tolist(), dtype=float) if len(f) else np.empty((0, 0)) for f in (pairs, ratings))
    y, v = pairs["y"].to_numpy(dtype=float), ratings["value"].to_numpy(dtype=float)
    draws = [np.array(f["m"].tolist(), dtype=float) if len(f) else None for f in (pairs, ratings)]
    count = next(len(m[0]) for m in draws if m is not None)
    weights, thresholds = [], []
    for m in range(count):
        weight = tuple(np.empty(0) if draw is None else draw[:, m] for draw in draws)
        beta, _ = _newton(x, y, z, v, c.L2, weight=weight, floor=c.L2 / THRESHOLD_SCALE**2)
        cuts = CUTS if len(z) else 0
        weights.append(beta[:len(beta) - cuts].tolist())
        thresholds.append(list(ordered(beta[len(beta) - cuts:])) if cuts and weight[1].sum() else None)
    row["ensemble_weights"], row["ensemble_thresholds"] = [weights], [thresholds]
    return row


def _fit_user(key, pairs, ratings):
    x = np.array(pairs["x"].tolist(), dtype=float) if len(pairs) else np.empty((0, 0))
    z = np.array(ratings["x"].tolist(), dtype=float) if len(ratings) else np.empty((0, 0))
    if not len(x) and not len(z):
        return pd.DataFrame({"user_id": [], "weights": [], "thresholds": [], "objective": [], "pairs": [], "ratings": []})
    order_p, order_r = np.argsort(pairs["id"].to_numpy()), np.argsort(ratings["id"].to_numpy())
    y = pairs["y"].to_numpy(dtype=float)
    v = ratings["value"].to_numpy(dtype=float)
    beta, value = _newton(x[order_p] if len(x) else x, y[order_p], z[order_r] if len(z) else z, v[order_r], c.L2)
    cuts = CUTS if len(z) else 0
    d = len(beta) - cuts
    thresholds = list(ordered(beta[d:])) if cuts else None
    return pd.DataFrame({
        "user_id": [key[0]], "weights": [beta[:d].tolist()], "thresholds": [thresholds], "objective": [value],
        "pairs": [len(x)], "ratings": [len(z)],
    })


def fit_users(pairs: DataFrame, ratings: DataFrame, seed: str | None = None, members: int = c.ENSEMBLE_MEMBERS) -> DataFrame:
    """One joint model per user, in parallel over users; with a ``seed`` also its bootstrap members.

    Inputs are training windows: the event limit per stream bounds what one task holds. Large
    segments use :func:`fit_joint` instead.
    """
    p = pairs.select("user_id", "id", "x", "y")
    r = ratings.select("user_id", "id", "x", F.col("value").cast("double").alias("value"))
    if seed is None:
        return p.groupBy("user_id").cogroup(r.groupBy("user_id")).applyInPandas(_fit_user, USER_MODEL)
    group = [F.col("user_id").cast("string"), F.least("left_id", "right_id").cast("string"), F.greatest("left_id", "right_id").cast("string")]
    image = [F.col("user_id").cast("string"), F.col("image_id").cast("string")]
    drawn = lambda name, of: F.array(*[multiplicity(name, m, *of) for m in range(1, members)]).alias("m")
    p = pairs.select("user_id", "id", "x", "y", drawn(seed, group))
    r = ratings.select("user_id", "id", "x", F.col("value").cast("double").alias("value"), drawn(seed + "r", image))
    schema = f"{USER_MODEL}, ensemble_weights array<array<double>>, ensemble_thresholds array<array<double>>"
    return p.groupBy("user_id").cogroup(r.groupBy("user_id")).applyInPandas(_fit_user_members, schema)


def with_user_thresholds(models: DataFrame, ratings: DataFrame) -> DataFrame:
    """``models`` (user_id, weights, thresholds) with missing thresholds fitted to fixed utilities.

    ``ratings`` has user_id, x and value of a training window. Every level is a logistic shift with
    the utility as offset, found by Newton's method with a step bound; a level that all ratings of a
    user lie on one side of has its half-count estimate. Users without ratings keep NULL.
    """
    open_ = models.filter("thresholds IS NULL AND weights IS NOT NULL").select("user_id", "weights")
    rows = ratings.join(open_, "user_id").select("user_id", dot(F.col("x"), F.col("weights")).alias("u"), F.col("value").cast("double").alias("value"))

    def levels(group):
        import pandas as pd

        u, v = group["u"].to_numpy(), group["value"].to_numpy()
        cuts = []
        for k in range(1, c.RATING_LEVELS):
            above = (v > k).astype(float)
            share = (above.sum() + 0.5) / (len(v) + 1.0)
            t = -float(np.log(share / (1 - share)))
            for _ in range(60 if 0 < above.sum() < len(v) else 0):
                p = 1.0 / (1.0 + np.exp(-np.clip(u - t, -50, 50)))
                step = float((p - above).sum() / max((p * (1 - p)).sum(), 1e-9))
                t += min(max(step, -2.0), 2.0)
                if abs(step) < 1e-12:
                    break
            cuts.append(t)
        return pd.DataFrame({"user_id": [group["user_id"].iloc[0]], "_fitted": [list(ordered(cuts))]})

    fitted = rows.groupBy("user_id").applyInPandas(levels, "user_id bigint, _fitted array<double>")
    return models.join(fitted, "user_id", "left").withColumn("thresholds", F.coalesce("thresholds", "_fitted")).drop("_fitted")
