"""Particle swarm operators over a swarm table.

Swarm schema: ``pid, sid, x ARRAY<DOUBLE>, v ARRAY<DOUBLE>, cost, pbest_x, pbest_cost,
nbest_x, nbest_cost, gbest_x, gbest_cost``. The swarm is small (one row per particle);
the expensive step is the fitness, a distributed job over the training rows that scores
every distinct decoded particle of the iteration at once.

Randomness: ``r1``/``r2``/initial draws are seeded hashes of (iteration, particle, dim),
so a re-run (or a lost task) reproduces the same swarm.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tuneforge.functions.hashing import hash_uniform
from tuneforge.operators.candidates import params_struct
from tuneforge.operators.space import SearchSpace
from tuneforge.session import cut_lineage

# ---- fixed values: default swarm coefficients of the reference ----
DEFAULT_OPTIONS = {"c1": 1.49618, "c2": 1.49618, "w": 0.7298}
# ---- end of fixed values ----

INF = float("inf")
_SCHEMA_COLS = ["pid", "sid", "x", "v", "cost", "pbest_x", "pbest_cost", "nbest_x", "nbest_cost", "gbest_x", "gbest_cost"]
MAX_SWARM = 100_000
#: Particles of one cell in a search for neighbours; smaller swarms are one list.
CELL_ROWS = 64


def swarm_init(spark: SparkSession, space: SearchSpace, n_particles: int, seed: int) -> DataFrame:
    """Positions uniform inside the bounds, velocities uniform in [0, 1)."""
    if not 1 <= n_particles <= MAX_SWARM:
        raise ValueError(f"n_particles must be in [1, {MAX_SWARM}]")
    pid = F.col("pid")
    x = [F.lit(d.lo) + hash_uniform(seed, F.lit("x"), pid, F.lit(j)) * F.lit(d.hi - d.lo) for j, d in enumerate(space.dims)]
    v = [hash_uniform(seed, F.lit("v"), pid, F.lit(j)) for j in range(space.n_dims)]
    arr_null = F.lit(None).cast("array<double>")
    dbl_null = F.lit(None).cast("double")
    return spark.range(n_particles).select(
        F.col("id").alias("pid"), F.lit(0).alias("sid"), F.array(*x).alias("x"), F.array(*v).alias("v"),
        dbl_null.alias("cost"), arr_null.alias("pbest_x"), dbl_null.alias("pbest_cost"),
        arr_null.alias("nbest_x"), dbl_null.alias("nbest_cost"), arr_null.alias("gbest_x"), dbl_null.alias("gbest_cost"),
    )


def clean_cost(c: Column, decimals: int = 9) -> Column:
    """Costs compare at 1e-9 resolution; NaN/inf become NULL (a failed trial never wins)."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(INF)), F.lit(None).cast("double")).otherwise(F.round(c, decimals))


def swarm_evaluate(swarm: DataFrame, space: SearchSpace, fitness: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Decode, fit each distinct decoded point once, join the cost back to every particle."""
    dec = swarm.drop("cost").withColumn("params", params_struct(space, F.col("x"), with_defaults=False))
    uniq = dec.groupBy("params").agg(F.min("pid").alias("trial_id"))
    costs = fitness(uniq)
    by_params = uniq.join(costs, "trial_id", "left").select("params", clean_cost(F.col("cost")).alias("cost"))
    # both sides are swarm-sized (bounded by n_particles)
    out = dec.join(by_params, "params", "left").drop("params")
    return out.select(*_SCHEMA_COLS)


def personal_best(swarm: DataFrame) -> DataFrame:
    """Keep each particle's lowest cost so far (strict improvement)."""
    better = F.col("cost").isNotNull() & (F.col("pbest_cost").isNull() | (F.col("cost") < F.col("pbest_cost")))
    return swarm.withColumn("pbest_x", F.when(better, F.col("x")).otherwise(F.col("pbest_x"))).withColumn(
        "pbest_cost", F.when(better, F.col("cost")).otherwise(F.col("pbest_cost"))
    )


def global_best(swarm: DataFrame) -> DataFrame:
    """Best personal best of the swarm (ties -> lowest pid); replaces the running best only on
    strict improvement. Also sets the neighbourhood best to it (global topology)."""
    g = (
        swarm.filter(F.col("pbest_cost").isNotNull())
        .groupBy("sid")
        .agg(F.min(F.struct(F.col("pbest_cost").alias("c"), F.col("pid").alias("p"), F.col("pbest_x").alias("px"))).alias("_g"))
    )
    sw = swarm.join(g, "sid", "left")   # one row per swarm
    improve = F.col("_g").isNotNull() & (F.col("gbest_cost").isNull() | (F.col("_g.c") < F.col("gbest_cost")))
    sw = sw.withColumn("gbest_x", F.when(improve, F.col("_g.px")).otherwise(F.col("gbest_x"))).withColumn(
        "gbest_cost", F.when(improve, F.col("_g.c")).otherwise(F.col("gbest_cost"))
    )
    sw = sw.withColumn("nbest_x", F.col("gbest_x")).withColumn("nbest_cost", F.col("gbest_cost"))
    return sw.select(*_SCHEMA_COLS)


def _distance(a: Column, b: Column, p: float) -> Column:
    """Sum of the p-th powers of the differences: in the order of the p-norm."""
    if p == 2:
        terms = F.zip_with(a, b, lambda u, v: (u - v) * (u - v))
    else:
        terms = F.zip_with(a, b, lambda u, v: F.pow(F.abs(u - v), F.lit(float(p))))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def _count_up_to(values: str, limit: Column) -> Column:
    return F.size(F.filter(values, lambda c: c <= limit))


def local_best(swarm: DataFrame, k: int = 3, p: float = 2.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Best personal best among each particle's ``k`` nearest particles (itself included),
    distance = p-norm of current positions, ties by pid.

    Swarms of up to ``cell_rows`` particles are ranked in one list a swarm. Larger ones are cut into cells of
    the position space (``_nearest_by_cells``); both give the same neighbours."""
    found = swarm.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
    if (found["n"] or 0) <= cell_rows:
        members = swarm.groupBy("sid").agg(
            F.collect_list(F.struct(F.col("pid").alias("pid"), F.col("x").alias("x"),
                                    F.col("pbest_cost").alias("c"), F.col("pbest_x").alias("px"))).alias("_m")
        )
        sw = swarm.join(members, "sid")   # one row per swarm, list bounded by cell_rows
        ranked = F.array_sort(F.transform(F.col("_m"), lambda m: F.struct(
            _distance(F.col("x"), m["x"], p).alias("d"), m["pid"].alias("pid"), F.coalesce(m["c"], F.lit(INF)).alias("c"), m["px"].alias("px"))))
        neigh = F.slice(ranked, 1, int(k))
        best = F.array_min(F.transform(neigh, lambda n: F.struct(n["c"].alias("c"), n["pid"].alias("pid"), n["px"].alias("px"))))
        sw = sw.withColumn("_b", best)
    else:
        sw = swarm.join(_nearest_by_cells(swarm, k, p, found["n"], found["d"], cell_rows), ["sid", "x"])
    ok = F.col("_b.c") < F.lit(INF)
    sw = sw.withColumn("nbest_x", F.when(ok, F.col("_b.px"))).withColumn("nbest_cost", F.when(ok, F.col("_b.c")))
    return sw.select(*_SCHEMA_COLS)


def _nearest_by_cells(swarm: DataFrame, k: int, p: float, n: int, d: int, cell_rows: int) -> DataFrame:
    """``(sid, x, _b)``: the best of the k nearest particles of each distinct position.

    Each axis is cut at quantiles into so many ranges that a cell holds about ``cell_rows`` particles. A
    position takes its candidates from its own cell and those around it, and is done if its k-th
    distance is less than that to the border of these cells; the others look ``ring`` = 2, 4, ... cells far, at
    last everywhere. Of the particles at one position only the k least pids can be anyone's neighbours, so a
    swarm that has met in one place is k rows."""
    g = max(1, int((n / cell_rows) ** (1.0 / d)))
    axes = [F.element_at("x", j + 1) for j in range(d)]
    probs = [i / g for i in range(1, g)]
    cuts = swarm.groupBy("sid").agg(*[(F.percentile_approx(a, probs, 1000) if probs else F.array().cast("array<double>")).alias(f"cuts{j}") for j, a in enumerate(axes)])
    # the k least pids of a position, in two steps: a position that many share is not sorted in one task
    own = swarm.select("sid", "x", "pid", F.coalesce("pbest_cost", F.lit(INF)).alias("c"), F.col("pbest_x").alias("px"))
    for keys in ([*("sid", "x"), F.pmod("pid", F.lit(64))], ["sid", "x"]):
        own = own.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("pid"))).where(F.col("_r") <= k).drop("_r")
    placed = own.join(cuts, "sid")   # one row per swarm
    for j, a in enumerate(axes):
        placed = placed.withColumn(f"cell{j}", _count_up_to(f"cuts{j}", a))
    cell_cols, cut_cols = [f"cell{j}" for j in range(d)], [f"cuts{j}" for j in range(d)]
    placed = cut_lineage(placed)
    members = placed.select("sid", *cell_cols, F.col("x").alias("mx"), "pid", "c", "px")
    open_ = placed.select("sid", "x", *cell_cols, *cut_cols).distinct()
    done, ring = [], 1
    while True:
        everywhere = ring >= g
        reach = open_
        for j in range(d):
            around = F.sequence(F.greatest(F.col(f"cell{j}") - ring, F.lit(0)), F.least(F.col(f"cell{j}") + ring, F.lit(g - 1)))
            reach = reach.withColumn(f"to{j}", F.explode(around))
        # how far the nearest cell that is not looked at lies, along any axis
        gaps = []
        for j, a in enumerate(axes):
            at, cut = F.col(f"cell{j}"), F.col(f"cuts{j}")
            gaps.append(F.when(at - ring > 0, a - F.element_at(cut, F.greatest(at - ring, F.lit(1)))).otherwise(F.lit(INF)))
            gaps.append(F.when(at + ring < g - 1, F.element_at(cut, F.least(at + ring + 1, F.lit(max(g - 1, 1)))) - a).otherwise(F.lit(INF)))
        reach = reach.select("sid", "x", *[F.col(f"to{j}").alias(f"cell{j}") for j in range(d)])
        pairs = reach.join(members, ["sid", *cell_cols]).select("sid", "x", _distance(F.col("x"), F.col("mx"), p).alias("dist"), "pid", "c", "px")
        near = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("sid", "x").orderBy("dist", "pid"))).where(F.col("_r") <= k)
        best = near.groupBy("sid", "x").agg(F.min(F.struct("c", "pid", "px")).alias("_b"), F.max("dist").alias("far"), F.count(F.lit(1)).alias("m"))
        if everywhere:
            done.append(best.select("sid", "x", "_b"))
            break
        gap = F.least(*gaps)
        tried = cut_lineage(open_.withColumn("gap", F.when(gap < INF, F.pow(gap, F.lit(float(p)))).otherwise(F.lit(INF))).join(best, ["sid", "x"]))
        sure = (F.col("m") == k) & (F.col("far") < F.col("gap")) | (F.col("gap") == INF)
        done.append(tried.where(sure).select("sid", "x", "_b"))
        open_ = tried.where(~sure).select("sid", "x", *cell_cols, *cut_cols)
        if open_.isEmpty():
            break
        ring *= 2
    return reduce(DataFrame.unionByName, done)


def swarm_move(
    swarm: DataFrame,
    space: SearchSpace,
    iteration: int,
    seed: int,
    options: dict | None = None,
    boundary: str = "periodic",
) -> DataFrame:
    """``v' = w v + c1 r1 (pbest - x) + c2 r2 (nbest - x)``, ``x' = x + v'`` kept inside the bounds.

    ``boundary='periodic'`` wraps a coordinate that left ``[lo, hi]`` around the interval
    (below: ``hi - mod(lo - x, hi - lo)``, above: ``lo + mod(x - hi, hi - lo)``);
    ``'nearest'`` clamps it.
    """
    o = dict(DEFAULT_OPTIONS, **(options or {}))
    w, c1, c2 = F.lit(float(o["w"])), F.lit(float(o["c1"])), F.lit(float(o["c2"]))
    pid = F.col("pid")
    new_v, new_x = [], []
    for j, d in enumerate(space.dims):
        x = F.element_at("x", j + 1)
        v = F.element_at("v", j + 1)
        pb = F.coalesce(F.element_at("pbest_x", j + 1), x)
        nb = F.coalesce(F.element_at("nbest_x", j + 1), x)
        r1 = hash_uniform(seed, F.lit("r1"), F.lit(iteration), pid, F.lit(j))
        r2 = hash_uniform(seed, F.lit("r2"), F.lit(iteration), pid, F.lit(j))
        vn = w * v + c1 * r1 * (pb - x) + c2 * r2 * (nb - x)
        xn = x + vn
        lo, hi = F.lit(d.lo), F.lit(d.hi)
        if d.hi <= d.lo:
            xb = lo
        elif boundary == "periodic":
            rng = F.lit(d.hi - d.lo)
            xb = F.when(xn < lo, hi - (lo - xn) % rng).when(xn > hi, lo + (xn - hi) % rng).otherwise(xn)
        elif boundary == "nearest":
            xb = F.least(F.greatest(xn, lo), hi)
        else:
            raise ValueError(f"unknown boundary strategy {boundary!r}")
        new_v.append(vn)
        new_x.append(xb)
    # one projection: both arrays must read the pre-move x and v
    rest = [c for c in _SCHEMA_COLS if c not in ("x", "v")]
    out = swarm.select(*rest, F.array(*new_x).alias("x"), F.array(*new_v).alias("v"))
    return out.select(*_SCHEMA_COLS)


def elite_retention(swarm: DataFrame, space: SearchSpace, elite: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """For stochastic fitness: a particle whose decoded point equals the elite's never reports a
    cost above the elite cost; the elite moves only on a strictly lower *measured* cost.

    ``elite`` is a one-row table ``(sid, elite_params, elite_x, elite_cost)`` or None.
    Returns (swarm with adjusted ``cost`` and ``raw_cost``, new elite).
    """
    dec = params_struct(space, F.col("x"), with_defaults=False)
    sw = swarm.withColumn("raw_cost", F.col("cost")).withColumn("_p", dec)
    measured = (
        sw.filter(F.col("raw_cost").isNotNull())
        .groupBy("sid")
        .agg(F.min(F.struct(F.col("raw_cost").alias("c"), F.col("pid").alias("pid"), F.col("_p").alias("p"), F.col("x").alias("x"))).alias("_m"))
    )
    if elite is None:
        new_elite = measured.select("sid", F.col("_m.p").alias("elite_params"), F.col("_m.x").alias("elite_x"), F.col("_m.c").alias("elite_cost"))
        return sw.drop("_p"), new_elite
    sw = sw.join(elite, "sid", "left")
    same = F.col("_p") == F.col("elite_params")
    adj = F.when(same & F.col("elite_cost").isNotNull() & (F.col("raw_cost").isNull() | (F.col("raw_cost") > F.col("elite_cost"))), F.col("elite_cost")).otherwise(F.col("raw_cost"))
    sw = sw.withColumn("cost", adj)
    ne = elite.join(measured, "sid", "full")
    better = F.col("_m").isNotNull() & (F.col("elite_cost").isNull() | (F.col("_m.c") < F.col("elite_cost")))
    new_elite = ne.select(
        "sid",
        F.when(better, F.col("_m.p")).otherwise(F.col("elite_params")).alias("elite_params"),
        F.when(better, F.col("_m.x")).otherwise(F.col("elite_x")).alias("elite_x"),
        F.when(better, F.col("_m.c")).otherwise(F.col("elite_cost")).alias("elite_cost"),
    )
    return sw.drop("_p", "elite_params", "elite_x", "elite_cost"), new_elite
