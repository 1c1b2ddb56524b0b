"""DuckDB oracle SQL, one statement per registered query (independent re-derivation)."""

from __future__ import annotations

from tuneforge.functions.hashing import hash_uniform_sql as U
from tuneforge.operators.space import SearchSpace
from tuneforge.sources.fixtures import lineitem_planted_sql

LI = lineitem_planted_sql()


def h32(seed, key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', CAST({key} AS VARCHAR))), 1, 8))::BIGINT)"


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def decode_sql(space: SearchSpace, pos_cols: list[str]) -> list[str]:
    out = []
    for d, p in zip(space.dims, pos_cols):
        if d.is_categorical:
            out.append(f"list_extract({sql_list(d.categories)}, CAST(round_even({p}, 0) AS INTEGER) + 1) AS {d.name}")
        elif d.decimals == 0:
            out.append(f"CAST(round_even({p}, 0) AS BIGINT) AS {d.name}")
        else:
            out.append(f"round_even({p}, {d.decimals}) AS {d.name}")
    return out


def grid_digits_sql(space: SearchSpace, index: str) -> list[str]:
    """Encoded grid point columns ``p0..`` of a grid index (mixed radix, last dim fastest)."""
    cards = space.cardinalities
    cols = []
    for j, d in enumerate(space.dims):
        stride = 1
        for c in cards[j + 1:]:
            stride *= c
        digit = f"(({index} // {stride}) % {cards[j]})"
        if d.is_categorical:
            cols.append(f"CAST({digit} AS DOUBLE) AS p{j}")
        else:
            cols.append(f"round_even({d.lo!r}::DOUBLE + CAST({digit} AS DOUBLE) * {d.step!r}::DOUBLE, {d.decimals}) AS p{j}")
    return cols


def q_load_features() -> str:
    return f"""WITH {LI}
    SELECT key, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3,
           round(reg, 6) AS label, split FROM li"""


def q_train_test_split() -> str:
    return f"""WITH {LI}
    SELECT key, CASE WHEN {U(21, 'key')} < 0.1 THEN 'test'
                     WHEN {U(22, 'key')} < 0.25 THEN 'val' ELSE 'train' END AS split
    FROM li"""


def q_stratified_split() -> str:
    return f"""WITH {LI},
    s1 AS (SELECT key, cls,
                  row_number() OVER (PARTITION BY cls ORDER BY {h32(31, 'key')}, key) AS rn,
                  count(*) OVER (PARTITION BY cls) AS n FROM li),
    t1 AS (SELECT key, cls, CASE WHEN rn <= round(0.1 * n) THEN 'test' ELSE 'train' END AS split FROM s1),
    s2 AS (SELECT key, cls,
                  row_number() OVER (PARTITION BY cls ORDER BY {h32(32, 'key')}, key) AS rn,
                  count(*) OVER (PARTITION BY cls) AS n FROM t1 WHERE split = 'train')
    SELECT t1.key, t1.cls,
           CASE WHEN t1.split = 'test' THEN 'test' WHEN s2.rn <= round(0.15 * s2.n) THEN 'val' ELSE 'train' END AS split
    FROM t1 LEFT JOIN s2 ON t1.key = s2.key"""


def _minmax(cols_exprs: list[tuple[str, str]]) -> str:
    aggs = ", ".join(f"min({e}) AS mn{i}, max({e}) AS mx{i}" for i, (_, e) in enumerate(cols_exprs))
    return aggs


def q_min_max_scale() -> str:
    cols = [("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"), ("l_discount", "l_discount"),
            ("l_tax", "l_tax"), ("const", "1.0::DOUBLE")]
    sel = ", ".join(
        f"round(({e} - mn{i}) / CASE WHEN mx{i} > mn{i} THEN mx{i} - mn{i} ELSE 1.0 END, 6) AS s{i}"
        for i, (_, e) in enumerate(cols)
    )
    return f"""WITH {LI},
    st AS (SELECT {_minmax(cols)} FROM li WHERE split <> 'test')
    SELECT key, split, {sel} FROM li, st"""


def q_scale_target() -> str:
    return f"""WITH {LI},
    st AS (SELECT min(reg) AS mn, max(reg) AS mx FROM li WHERE split <> 'test')
    SELECT key, split, round((reg - mn) / CASE WHEN mx > mn THEN mx - mn ELSE 1.0 END, 6) AS y_scaled FROM li, st"""


def q_grid_enumerate() -> str:
    return f"""WITH {LI},
    top AS (SELECT CAST(ceil(max(reg)) AS BIGINT) AS a FROM li WHERE split = 'train'),
    card AS (SELECT a, CAST(ceil((a + 0.000001) / 0.1) AS BIGINT) AS na,
                    CAST(ceil((5 * a + 0.000001) / 1.0) AS BIGINT) AS nb FROM top),
    g AS (SELECT range AS trial_id, na, nb FROM card, range(na * nb))
    SELECT trial_id, round(round_even(CAST(trial_id // nb AS DOUBLE) * 0.1, 1), 6) AS a,
           CAST(round_even(CAST(trial_id % nb AS DOUBLE) * 1.0, 0) AS BIGINT) AS b
    FROM g"""


MLP_SPACE = SearchSpace.default("mlp", "binary classification")


def q_random_candidates() -> str:
    total = MLP_SPACE.total
    dec = ", ".join(decode_sql(MLP_SPACE, [f"p{j}" for j in range(MLP_SPACE.n_dims)]))
    return f"""WITH {LI},
    r AS (SELECT key, least(CAST(floor({U(41, 'key')} * {float(total)}) AS BIGINT), {total - 1}) AS grid_index FROM li),
    p AS (SELECT key, grid_index, {", ".join(grid_digits_sql(MLP_SPACE, 'grid_index'))} FROM r)
    SELECT key, grid_index, {dec} FROM p"""


def hashed_positions_sql(space: SearchSpace, seed0: int, key: str = "key") -> list[str]:
    return [
        f"({d.lo!r}::DOUBLE + {U(seed0 + j, key)} * {float(d.hi - d.lo)!r}::DOUBLE) AS p{j}"
        for j, d in enumerate(space.dims)
    ]


def q_decode_candidates() -> str:
    dec = ", ".join(decode_sql(MLP_SPACE, [f"p{j}" for j in range(MLP_SPACE.n_dims)]))
    return f"""WITH {LI},
    p AS (SELECT key, {", ".join(hashed_positions_sql(MLP_SPACE, 50))} FROM li)
    SELECT key, {dec}, CAST(12 AS BIGINT) AS batch_size, CAST(50 AS BIGINT) AS epochs,
           'binary_crossentropy' AS loss, 'auto' AS mode, true AS shuffle
    FROM p"""


def q_dedupe_candidates() -> str:
    from tuneforge.plans.catalog import DEDUPE_SPACE

    space = SearchSpace.from_dict(DEDUPE_SPACE)
    dec = ", ".join(decode_sql(space, [f"p{j}" for j in range(space.n_dims)]))
    names = ", ".join(space.names)
    return f"""WITH {LI},
    p AS (SELECT key, {", ".join(hashed_positions_sql(space, 60))} FROM li),
    d AS (SELECT key, {dec} FROM p)
    SELECT {names}, min(key) AS first_key, count(*) AS n_positions FROM d GROUP BY {names}"""


# ---------------------------------------------------------------- prediction and scoring
def _values(cands, fields):
    rows = ", ".join("(" + ", ".join([str(c["trial_id"])] + [f"{float(c[f])!r}::DOUBLE" for f in fields]) + ")" for c in cands)
    return f"(VALUES {rows}) AS c(trial_id, {', '.join(fields)})"


def _reg_pred(label="reg", split="'val'"):
    from tuneforge.plans.catalog import REG_CANDS

    where = f"WHERE li.split = {split}" if split else ""
    return f"""pr AS (SELECT c.trial_id, li.key, li.split, li.{label} AS label,
                         c.a * (li.l_quantity / 50.0::DOUBLE) + c.b * li.l_discount AS score
                  FROM li, {_values(REG_CANDS, ['a', 'b'])} {where})"""


def _cls_pred(split="'val'", ties=False):
    from tuneforge.plans.catalog import CLS_CANDS

    where = f"WHERE li.split = {split}" if split else ""
    p = "1.0::DOUBLE / (1.0::DOUBLE + exp(-(c.a * (li.l_quantity / 50.0::DOUBLE) + c.b * li.l_discount + c.c)))"
    if ties:
        p = f"round({p}, 1)"
    return f"""pr AS (SELECT c.trial_id, li.key, li.split, li.cls AS label, {p} AS score
                  FROM li, {_values(CLS_CANDS, ['a', 'b', 'c'])} {where})"""


def _auc_sql(src="pr", alias="auc", extra_where=""):
    return f"""(SELECT trial_id, sum(pos * (coalesce(nb, 0) + 0.5 * neg)) / (max(P) * max(N)) AS {alias} FROM (
        SELECT *, sum(neg) OVER (PARTITION BY trial_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb,
               sum(pos) OVER (PARTITION BY trial_id) AS P, sum(neg) OVER (PARTITION BY trial_id) AS N
        FROM (SELECT trial_id, score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
                     CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS neg
              FROM {src} {extra_where} GROUP BY trial_id, score) d) e GROUP BY trial_id)"""


def q_predict():
    return f"WITH {LI}, {_reg_pred()} SELECT trial_id, key, round(score, 6) AS pred FROM pr"


def q_predict_proba():
    return f"WITH {LI}, {_cls_pred()} SELECT trial_id, key, round(score, 6) AS proba FROM pr"


def q_score_rmse():
    return f"WITH {LI}, {_reg_pred()} SELECT trial_id, round(sqrt(avg(pow(label - score, 2))), 6) AS cost FROM pr GROUP BY trial_id"


def q_score_accuracy():
    return f"""WITH {LI}, {_cls_pred()}
    SELECT trial_id, round(1.0 - avg(CASE WHEN label = (CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END) THEN 1.0 ELSE 0.0 END), 6) AS cost
    FROM pr GROUP BY trial_id"""


def q_score_accuracy_rounded():
    return f"""WITH {LI}, {_reg_pred(label='cls')}
    SELECT trial_id, round(1.0 - avg(CASE WHEN label = round_even(score, 0) THEN 1.0 ELSE 0.0 END), 6) AS cost
    FROM pr GROUP BY trial_id"""


def q_roc_curve():
    return f"""WITH {LI}, {_cls_pred(ties=True)},
    d AS (SELECT trial_id, score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
                 CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS neg FROM pr GROUP BY trial_id, score),
    e AS (SELECT *, sum(pos) OVER (PARTITION BY trial_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                 sum(neg) OVER (PARTITION BY trial_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
                 sum(pos) OVER (PARTITION BY trial_id) AS P, sum(neg) OVER (PARTITION BY trial_id) AS N FROM d)
    SELECT trial_id, round(score, 6) AS threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM e"""


def q_score_auc():
    return f"""WITH {LI}, {_cls_pred(ties=True)}, a AS {_auc_sql()}
    SELECT trial_id, round(auc, 6) AS auc, round(1.0 - auc, 6) AS cost FROM a"""


def q_score_auc_distinct():
    return f"""WITH {LI}, {_cls_pred()}, a AS {_auc_sql(src="(SELECT trial_id, label, round(score, 9) AS score FROM pr)")}
    SELECT trial_id, round(auc, 6) AS auc FROM a"""


def q_score_holdout():
    return f"""WITH {LI}, {_cls_pred(split=None)},
    v AS {_auc_sql(extra_where="WHERE split = 'val'")},
    best AS (SELECT trial_id, round(1.0 - auc, 9) AS val_cost FROM v ORDER BY round(1.0 - auc, 9), trial_id LIMIT 1),
    t AS {_auc_sql(src="(SELECT * FROM pr WHERE split = 'test' AND trial_id IN (SELECT trial_id FROM best))", alias="test_auc")}
    SELECT t.trial_id, round(best.val_cost, 6) AS val_cost, round(t.test_auc, 6) AS test_auc FROM t JOIN best USING (trial_id)"""


# ---------------------------------------------------------------- swarm and search
W, C1, C2 = 0.7298, 1.49618, 1.49618


def _val_rows_sql(label="reg", name="val", split="'val'"):
    return f"{name} AS (SELECT key, {label} AS label, l_quantity / 50.0::DOUBLE AS x1, l_discount AS x2 FROM li WHERE split = {split})"


def _cost_agg(kind="rmse"):
    score = "(p.a * r.x1 + p.b * r.x2)"
    if kind == "mae":
        return f"avg(abs(r.label - {score}))"
    return f"sqrt(avg(pow(r.label - {score}, 2)))"


def pso_sql(space_dict, n, seed, iters, local_k=None, kind="rmse", elite=False, noisy=None, move_last=False):
    """CTE chain simulating the swarm for ``iters`` iterations (2-D linear-scorer space).

    Produces CTEs ``n{t}`` (state after evaluation + bests of iteration t) and, when
    ``move_last``, ``s{iters}`` (positions after the last move)."""
    space = SearchSpace.from_dict(space_dict)
    D = space.n_dims
    xs = ", ".join(f"{d.lo!r}::DOUBLE + {U(seed, chr(39) + 'x' + chr(39), 'pid', str(j))} * {float(d.hi - d.lo)!r}::DOUBLE AS x{j}" for j, d in enumerate(space.dims))
    vs = ", ".join(f"{U(seed, chr(39) + 'v' + chr(39), 'pid', str(j))} AS v{j}" for j in range(D))
    nulls = ", ".join([f"NULL::DOUBLE AS pb{j}" for j in range(D)] + ["NULL::DOUBLE AS pbc"] + [f"NULL::DOUBLE AS gb{j}" for j in range(D)] + ["NULL::DOUBLE AS gbc"])
    ctes = [f"s0 AS (SELECT range AS pid, {xs}, {vs}, {nulls} FROM range({n}))"]
    X = ", ".join(f"x{j}" for j in range(D))
    V = ", ".join(f"v{j}" for j in range(D))
    PB = ", ".join(f"pb{j}" for j in range(D))
    GB = ", ".join(f"gb{j}" for j in range(D))
    dec = ", ".join(decode_sql(space, [f"x{j}" for j in range(D)]))
    names = space.names
    on = " AND ".join(f"d.{nm} = c.{nm}" for nm in names)
    for t in range(iters):
        ctes.append(f"d{t} AS (SELECT *, {dec} FROM s{t})")
        rows = "val"
        if noisy is not None:
            nseed, frac = noisy
            ctes.append(f"vs{t} AS (SELECT * FROM val WHERE {U(nseed, str(t), 'key')} < {frac})")
            rows = f"vs{t}"
        ctes.append(f"""c{t} AS (SELECT p.{names[0]} AS a, p.{names[1]} AS b, round({_cost_agg(kind)}, 9) AS cost
                     FROM (SELECT DISTINCT {names[0]} AS a, {names[1]} AS b FROM d{t}) p, {rows} r GROUP BY p.a, p.b)""")
        ctes.append(f"e{t} AS (SELECT d.*, c.cost AS cost FROM d{t} d LEFT JOIN c{t} c ON d.{names[0]} = c.a AND d.{names[1]} = c.b)")
        src = f"e{t}"
        if elite:
            ctes.append(f"em{t} AS (SELECT cost AS mc, pid AS mpid, {names[0]} AS ma, {names[1]} AS mb FROM e{t} WHERE cost IS NOT NULL ORDER BY cost, pid LIMIT 1)")
            if t == 0:
                ctes.append(f"ea{t} AS (SELECT e.*, e.cost AS raw_cost FROM e{t} e)")
                ctes.append(f"el{t} AS (SELECT ma AS ea, mb AS eb, mc AS ec FROM em{t})")
            else:
                ctes.append(f"""ea{t} AS (SELECT e.* REPLACE (CASE WHEN e.{names[0]} = el.ea AND e.{names[1]} = el.eb AND el.ec IS NOT NULL
                                      AND (e.cost IS NULL OR e.cost > el.ec) THEN el.ec ELSE e.cost END AS cost), e.cost AS raw_cost
                              FROM e{t} e LEFT JOIN el{t - 1} el ON true)""")
                ctes.append(f"""el{t} AS (SELECT CASE WHEN m.mc IS NOT NULL AND (o.ec IS NULL OR m.mc < o.ec) THEN m.ma ELSE o.ea END AS ea,
                                      CASE WHEN m.mc IS NOT NULL AND (o.ec IS NULL OR m.mc < o.ec) THEN m.mb ELSE o.eb END AS eb,
                                      CASE WHEN m.mc IS NOT NULL AND (o.ec IS NULL OR m.mc < o.ec) THEN m.mc ELSE o.ec END AS ec
                              FROM el{t - 1} o FULL JOIN em{t} m ON true)""")
            src = f"ea{t}"
        better = "(cost IS NOT NULL AND (pbc IS NULL OR cost < pbc))"
        pbs = ", ".join(f"CASE WHEN {better} THEN x{j} ELSE pb{j} END AS pb{j}" for j in range(D))
        raw = ", raw_cost" if elite else ""
        ctes.append(f"p{t} AS (SELECT pid, {X}, {V}, cost{raw}, {pbs}, CASE WHEN {better} THEN cost ELSE pbc END AS pbc, {GB}, gbc FROM {src})")
        ctes.append(f"m{t} AS (SELECT pbc AS mc, {', '.join(f'pb{j} AS m{j}' for j in range(D))} FROM p{t} WHERE pbc IS NOT NULL ORDER BY pbc, pid LIMIT 1)")
        imp = "(m.mc IS NOT NULL AND (p.gbc IS NULL OR m.mc < p.gbc))"
        gbs = ", ".join(f"CASE WHEN {imp} THEN m.m{j} ELSE p.gb{j} END AS gb{j}" for j in range(D))
        ctes.append(f"g{t} AS (SELECT p.pid, {', '.join('p.x%d' % j for j in range(D))}, {', '.join('p.v%d' % j for j in range(D))}, p.cost{', p.raw_cost' if elite else ''}, "
                    f"{', '.join('p.pb%d' % j for j in range(D))}, p.pbc, {gbs}, CASE WHEN {imp} THEN m.mc ELSE p.gbc END AS gbc FROM p{t} p LEFT JOIN m{t} m ON true)")
        if local_k:
            dist = " + ".join(f"(i.x{j} - j.x{j}) * (i.x{j} - j.x{j})" for j in range(D))
            ctes.append(f"""nn{t} AS (SELECT i.pid, j.pid AS jpid, j.pbc AS jc, {', '.join(f'j.pb{q} AS j{q}' for q in range(D))},
                          row_number() OVER (PARTITION BY i.pid ORDER BY ({dist}), j.pid) AS rk FROM g{t} i, g{t} j)""")
            ctes.append(f"""nb{t} AS (SELECT pid, jc AS nbc, {', '.join(f'j{q} AS nb{q}' for q in range(D))} FROM
                          (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY coalesce(jc, 'inf'::DOUBLE), jpid) AS r2
                           FROM nn{t} WHERE rk <= {local_k}) z WHERE r2 = 1)""")
            ctes.append(f"n{t} AS (SELECT g.*, {', '.join(f'nb.nb{j}' for j in range(D))}, nb.nbc FROM g{t} g JOIN nb{t} nb USING (pid))")
        else:
            ctes.append(f"n{t} AS (SELECT *, {', '.join(f'gb{j} AS nb{j}' for j in range(D))}, gbc AS nbc FROM g{t})")
        if t < iters - 1 or move_last:
            vn = ", ".join(
                f"{W!r}::DOUBLE * v{j} + {C1!r}::DOUBLE * {U(seed, chr(39) + 'r1' + chr(39), str(t), 'pid', str(j))} * (coalesce(pb{j}, x{j}) - x{j})"
                f" + {C2!r}::DOUBLE * {U(seed, chr(39) + 'r2' + chr(39), str(t), 'pid', str(j))} * (coalesce(nb{j}, x{j}) - x{j}) AS vn{j}"
                for j in range(D))
            ctes.append(f"mv{t} AS (SELECT *, {vn} FROM n{t})")
            xb = []
            for j, d in enumerate(space.dims):
                lo, hi, rng = f"{d.lo!r}::DOUBLE", f"{d.hi!r}::DOUBLE", f"{float(d.hi - d.lo)!r}::DOUBLE"
                xn = f"(x{j} + vn{j})"
                xb.append(f"CASE WHEN {xn} < {lo} THEN {hi} - ({lo} - {xn}) % {rng} WHEN {xn} > {hi} THEN {lo} + ({xn} - {hi}) % {rng} ELSE {xn} END AS x{j}")
            ctes.append(f"s{t + 1} AS (SELECT pid, {', '.join(xb)}, {', '.join(f'vn{j} AS v{j}' for j in range(D))}, {PB}, pbc, {GB}, gbc FROM mv{t})")
    return ",\n".join(ctes)


def _swarm_with(space_dict, n, seed, iters, **kw):
    return f"WITH {LI}, {_val_rows_sql()},\n{pso_sql(space_dict, n, seed, iters, **kw)}\n"


def q_swarm_init():
    from tuneforge.plans.catalog import SWARM_SPACE

    return _swarm_with(SWARM_SPACE, 8, 5, 1) + "SELECT pid, round(x0, 6) AS x0, round(x1, 6) AS x1, round(v0, 6) AS v0, round(v1, 6) AS v1, round(cost, 6) AS cost FROM n0"


def q_swarm_evaluate():
    from tuneforge.plans.catalog import COARSE_SPACE

    return _swarm_with(COARSE_SPACE, 20, 6, 1) + "SELECT pid, a, b, round(cost, 6) AS cost FROM d0 JOIN (SELECT pid, cost FROM e0) USING (pid)"


def q_swarm_move():
    from tuneforge.plans.catalog import SWARM_SPACE

    return _swarm_with(SWARM_SPACE, 8, 5, 1, move_last=True) + "SELECT pid, round(x0, 6) AS x0, round(x1, 6) AS x1, round(v0, 6) AS v0, round(v1, 6) AS v1 FROM s1"


def q_personal_best():
    from tuneforge.plans.catalog import SWARM_SPACE

    return _swarm_with(SWARM_SPACE, 8, 5, 3) + "SELECT pid, round(pb0, 6) AS pb0, round(pb1, 6) AS pb1, round(pbc, 6) AS pbest_cost FROM n2"


def q_global_best():
    from tuneforge.plans.catalog import SWARM_SPACE

    sel = " UNION ALL ".join(
        f"SELECT {t} AS iteration, round(gb0, 6) AS best_x0, round(gb1, 6) AS best_x1, round(gbc, 6) AS best_cost FROM n{t} WHERE pid = 0"
        for t in range(3))
    return _swarm_with(SWARM_SPACE, 8, 5, 3) + sel


def q_local_best():
    from tuneforge.plans.catalog import SWARM_SPACE

    return _swarm_with(SWARM_SPACE, 8, 5, 3, local_k=3) + "SELECT pid, round(nb0, 6) AS nb0, round(nb1, 6) AS nb1, round(nbc, 6) AS nbest_cost FROM n2"


def q_search_trace():
    from tuneforge.plans.catalog import SWARM_SPACE

    sel = " UNION ALL ".join(
        f"SELECT {t} AS iteration, pid, round(x0, 6) AS x0, round(x1, 6) AS x1, round(cost, 6) AS cost, round(gbc, 6) AS best_cost FROM n{t}"
        for t in range(4))
    return _swarm_with(SWARM_SPACE, 8, 5, 4) + sel


def q_search_pso():
    from tuneforge.plans.catalog import SWARM_SPACE

    space = SearchSpace.from_dict(SWARM_SPACE)
    return _swarm_with(SWARM_SPACE, 5, 0, 10) + (
        f"SELECT round(gbc, 6) AS best_cost, round_even(gb0, 2) AS a, round_even(gb1, 1) AS b, CAST(50 AS BIGINT) AS attempts, "
        f"CAST({space.total} AS BIGINT) AS total_combinations FROM n9 WHERE pid = 0")


def q_custom_objective():
    from tuneforge.plans.catalog import SWARM_SPACE

    sel = " UNION ALL ".join(f"SELECT {t} AS iteration, round(min(gbc), 6) AS best_cost FROM n{t}" for t in range(3))
    return _swarm_with(SWARM_SPACE, 6, 3, 3, kind="mae") + sel


def q_elite_retention():
    from tuneforge.plans.catalog import COARSE_SPACE

    sel = " UNION ALL ".join(f"SELECT {t} AS iteration, pid, round(raw_cost, 6) AS raw_cost, round(cost, 6) AS cost FROM n{t}" for t in range(4))
    return _swarm_with(COARSE_SPACE, 6, 8, 4, elite=True, noisy=(77, 0.5)) + sel


def _grid_cte():
    return f"""{_val_rows_sql()},
    top AS (SELECT CAST(ceil(max(reg)) AS BIGINT) AS ta FROM li WHERE split = 'train'),
    card AS (SELECT ta, CAST(ceil((ta + 0.000001) / 0.1) AS BIGINT) AS na,
                    CAST(ceil((5 * ta + 0.000001) / 1.0) AS BIGINT) AS nb FROM top),
    g AS (SELECT range AS trial_id, round_even(round_even(CAST(range // nb AS DOUBLE) * 0.1, 1), 1) AS a,
                 CAST(round_even(round_even(CAST(range % nb AS DOUBLE) * 1.0, 0), 0) AS BIGINT) AS b FROM card, range(na * nb)),
    gc AS (SELECT p.trial_id, p.a, p.b, round({_cost_agg()}, 9) AS cost FROM g p, val r GROUP BY p.trial_id, p.a, p.b)"""


def q_search_grid():
    return f"WITH {LI}, {_grid_cte()} SELECT trial_id, round(a, 6) AS a, b, round(cost, 6) AS cost FROM gc"


def q_search_random():
    return f"""WITH {LI}, {_grid_cte()},
    ri AS (SELECT range AS trial_id, least(CAST(floor({U(9, 'range')} * CAST(na * nb AS DOUBLE)) AS BIGINT), na * nb - 1) AS grid_index FROM card, range(20))
    SELECT ri.trial_id, ri.grid_index, round(gc.a, 6) AS a, gc.b, round(gc.cost, 6) AS cost FROM ri JOIN gc ON ri.grid_index = gc.trial_id"""


def q_select_best():
    return f"WITH {LI}, {_grid_cte()} SELECT trial_id, round(a, 6) AS a, b, round(cost, 6) AS cost FROM gc ORDER BY cost, trial_id LIMIT 1"


def q_leaderboard():
    return f"""WITH {LI}, {_grid_cte()}
    SELECT CAST(row_number() OVER (ORDER BY cost, trial_id) AS INTEGER) AS rank, trial_id, round(a, 6) AS a, b, round(cost, 6) AS cost
    FROM gc ORDER BY cost, trial_id LIMIT 10"""


def q_rebuild_best():
    return f"""WITH {LI}, {_grid_cte()}, {_val_rows_sql(name='tst', split="'test'")},
    best AS (SELECT * FROM gc ORDER BY cost, trial_id LIMIT 1)
    SELECT p.trial_id, round(p.a, 6) AS a, p.b, round(p.cost, 6) AS val_cost, round({_cost_agg()}, 6) AS test_cost
    FROM best p, tst r GROUP BY p.trial_id, p.a, p.b, p.cost"""


def q_failed_trials():
    return f"""WITH {LI},
    val AS (SELECT key, reg - 0.75::DOUBLE AS label, l_quantity / 50.0::DOUBLE AS x1, l_discount AS x2 FROM li WHERE split = 'val'),
    g AS (SELECT range AS trial_id, list_extract(['squared', 'gamma'], CAST(range // 121 AS INTEGER) + 1) AS objective,
                 round_even(round_even(0.5::DOUBLE + CAST((range // 11) % 11 AS DOUBLE) * 0.1::DOUBLE, 1), 1) AS a,
                 CAST(round_even(CAST(range % 11 AS DOUBLE), 0) AS BIGINT) AS b FROM range(242)),
    c AS (SELECT p.trial_id, p.objective, p.a, p.b,
                 sqrt(avg(pow(r.label - CASE WHEN p.objective = 'gamma' THEN exp(p.a * r.x1 + p.b * r.x2) ELSE p.a * r.x1 + p.b * r.x2 END, 2))) AS cost,
                 min(r.label) AS min_label
          FROM g p, val r GROUP BY p.trial_id, p.objective, p.a, p.b)
    SELECT trial_id, objective, round(a, 6) AS a, b,
           CASE WHEN (objective = 'gamma' AND min_label <= 0) OR cost IS NULL OR isnan(cost) OR isinf(cost) THEN 'failed' ELSE 'ok' END AS status,
           CASE WHEN (objective = 'gamma' AND min_label <= 0) OR cost IS NULL OR isnan(cost) OR isinf(cost) THEN NULL ELSE round(cost, 6) END AS cost
    FROM c"""


# ---------------------------------------------------------------- boosted trees
LAM, MCW, RHO = 1.0, 1.0, 1.5


def _kind_sql(obj):
    from tuneforge.operators.trees import OBJECTIVES

    return OBJECTIVES[obj]


def boost_sql(name, seed=13, rounds=None):
    """CTE chain re-deriving the level-wise booster for one fixed tree case."""
    from tuneforge.plans.catalog import TREE_CASES, tree_case_cands

    obj, _, depth, R, _, label, score = TREE_CASES[name]
    ctes, R2 = boost_sql_cands(tree_case_cands(name), label, score, seed=seed)
    return ctes, R2, depth


def boost_sql_cands(cands, label, score, seed=13, n_bins=None):
    """Generic booster CTE chain: per-candidate objective, learning rate, depth, rounds, subsample.

    CTEs: ``f{t}`` raw scores after t rounds, ``b{t}_{L}`` chosen splits, ``lf{t}`` leaves,
    ``vc{t}`` validation cost after round t (only candidates still boosting)."""
    from tuneforge.plans.catalog import TREE_BINS
    from tuneforge.operators.trees import OBJECTIVES

    B = n_bins or TREE_BINS
    R = max(int(c["n_estimators"]) for c in cands)
    D = max(int(c["max_depth"]) for c in cands)
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    mm = ", ".join(f"min({c}) AS mn{j}, max({c}) AS mx{j}" for j, c in enumerate(feats))
    bins = ", ".join(
        f"CASE WHEN mx{j} > mn{j} THEN CAST(greatest(0, least({B - 1}, floor(({c} - mn{j}) / (mx{j} - mn{j}) * {float(B)}))) AS INTEGER) ELSE 0 END AS b{j}"
        for j, c in enumerate(feats))
    rb = " UNION ALL ".join(f"SELECT key, {j} AS j, b{j} AS b FROM rws" for j in range(len(feats)))
    cvals = ", ".join(
        f"({c['trial_id']}, '{OBJECTIVES[c['objective']]}', {float(c['learning_rate'])!r}::DOUBLE, {float(c['subsample'])!r}::DOUBLE, "
        f"{int(c['max_depth'])}, {int(c['n_estimators'])})" for c in cands)
    ml = "least(greatest(m, 1e-6), 1 - 1e-6)"
    base = f"CASE c.kind WHEN 'squared' THEN m WHEN 'logistic' THEN ln({ml} / (1.0 - {ml})) ELSE ln(m) END"
    p = "(1.0::DOUBLE / (1.0::DOUBLE + exp(-f.f)))"
    e1, e2 = f"exp({1.0 - RHO!r}::DOUBLE * f.f)", f"exp({2.0 - RHO!r}::DOUBLE * f.f)"
    g = (f"CASE c.kind WHEN 'squared' THEN f.f - r.label WHEN 'logistic' THEN {p} - r.label "
         f"WHEN 'gamma' THEN 1.0::DOUBLE - r.label * exp(-f.f) ELSE -r.label * {e1} + {e2} END")
    h = (f"CASE c.kind WHEN 'squared' THEN 1.0::DOUBLE WHEN 'logistic' THEN greatest({p} * (1.0::DOUBLE - {p}), 1e-16::DOUBLE) "
         f"WHEN 'gamma' THEN r.label * exp(-f.f) ELSE -r.label * {1.0 - RHO!r}::DOUBLE * {e1} + {2.0 - RHO!r}::DOUBLE * {e2} END")
    binof = "CASE b.j " + " ".join(f"WHEN {j} THEN r.b{j}" for j in range(len(feats))) + " END"
    ctes = [
        f"bx AS (SELECT {mm} FROM li WHERE split = 'train')",
        f"rws AS (SELECT key, split, {label} AS label, {bins} FROM li, bx)",
        f"rb AS ({rb})",
        f"cand AS (SELECT * FROM (VALUES {cvals}) AS t(trial_id, kind, lr, ss, depth, nest))",
        "st AS (SELECT avg(label) AS m FROM rws WHERE split = 'train')",
        f"f0 AS (SELECT r.key, c.trial_id, {base} AS f FROM rws r, cand c, st)",
    ]
    pred = f"CASE c.kind WHEN 'squared' THEN f.f WHEN 'logistic' THEN {p} ELSE exp(f.f) END"
    for t in range(R):
        samp = f"(c.ss >= 1.0 OR {U(seed, 'c.trial_id', str(t), 'r.key')} < c.ss)"
        ctes.append(f"gh{t} AS (SELECT f.key, f.trial_id, {g} AS g, {h} AS h FROM f{t} f JOIN rws r USING (key) JOIN cand c USING (trial_id) "
                    f"WHERE r.split = 'train' AND c.nest > {t} AND {samp})")
        ctes.append(f"n{t}_0 AS (SELECT key, trial_id, 0 AS node FROM f{t})")
        for L in range(D):
            ctes.append(f"""h{t}_{L} AS (SELECT gh.trial_id, n.node, rb.j, rb.b, sum(gh.g) AS G, sum(gh.h) AS H
                FROM gh{t} gh JOIN n{t}_{L} n USING (key, trial_id) JOIN rb USING (key) JOIN cand c USING (trial_id)
                WHERE c.depth > {L} GROUP BY gh.trial_id, n.node, rb.j, rb.b)""")
            ctes.append(f"""s{t}_{L} AS (SELECT *, GT - GL AS GR, HT - HL AS HR,
                    round(GL * GL / (HL + {LAM}::DOUBLE) + (GT - GL) * (GT - GL) / ((HT - HL) + {LAM}::DOUBLE) - GT * GT / (HT + {LAM}::DOUBLE), 9) AS gain
                FROM (SELECT *, sum(G) OVER (PARTITION BY trial_id, node, j ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS GL,
                             sum(H) OVER (PARTITION BY trial_id, node, j ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS HL,
                             sum(G) OVER (PARTITION BY trial_id, node, j) AS GT, sum(H) OVER (PARTITION BY trial_id, node, j) AS HT
                      FROM h{t}_{L}) z)""")
            ctes.append(f"""b{t}_{L} AS (SELECT trial_id, node, j, b FROM (
                    SELECT *, row_number() OVER (PARTITION BY trial_id, node ORDER BY gain DESC, j, b) AS rn
                    FROM s{t}_{L} WHERE HL >= {MCW} AND HR >= {MCW} AND gain > 0) z WHERE rn = 1)""")
            ctes.append(f"""n{t}_{L + 1} AS (SELECT n.key, n.trial_id,
                    2 * n.node + CASE WHEN b.j IS NOT NULL AND {binof} > b.b THEN 1 ELSE 0 END AS node
                FROM n{t}_{L} n JOIN rws r USING (key) LEFT JOIN b{t}_{L} b ON b.trial_id = n.trial_id AND b.node = n.node)""")
        ctes.append(f"""lf{t} AS (SELECT gh.trial_id, n.node, -sum(gh.g) / (sum(gh.h) + {LAM}::DOUBLE) * max(c.lr) AS w
                FROM gh{t} gh JOIN n{t}_{D} n USING (key, trial_id) JOIN cand c USING (trial_id) GROUP BY gh.trial_id, n.node)""")
        ctes.append(f"""f{t + 1} AS (SELECT f.key, f.trial_id, f.f + coalesce(lf.w, 0.0::DOUBLE) AS f
                FROM f{t} f JOIN n{t}_{D} n USING (key, trial_id) LEFT JOIN lf{t} lf ON lf.trial_id = n.trial_id AND lf.node = n.node)""")
        if score == "auc":
            ctes.append(f"""vc{t} AS (SELECT trial_id, {t} AS round, 1.0 - sum(pos * (coalesce(nb, 0) + 0.5 * neg)) / (max(P) * max(N)) AS val_cost
                FROM (SELECT *, sum(neg) OVER (PARTITION BY trial_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb,
                             sum(pos) OVER (PARTITION BY trial_id) AS P, sum(neg) OVER (PARTITION BY trial_id) AS N
                      FROM (SELECT f.trial_id, {pred} AS score, CAST(sum(CASE WHEN r.label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
                                   CAST(sum(CASE WHEN r.label = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS neg
                            FROM f{t + 1} f JOIN rws r USING (key) JOIN cand c USING (trial_id)
                            WHERE r.split = 'val' AND c.nest > {t} GROUP BY f.trial_id, {pred}) d) e
                GROUP BY trial_id)""")
            continue
        if score == "rmse":
            vc = f"sqrt(avg(pow(r.label - {pred}, 2)))"
        else:
            vc = f"1.0 - avg(CASE WHEN r.label = (CASE WHEN {pred} > 0.5 THEN 1.0 ELSE 0.0 END) THEN 1.0 ELSE 0.0 END)"
        ctes.append(f"vc{t} AS (SELECT f.trial_id, {t} AS round, {vc} AS val_cost FROM f{t + 1} f JOIN rws r USING (key) "
                    f"JOIN cand c USING (trial_id) WHERE r.split = 'val' AND c.nest > {t} GROUP BY f.trial_id)")
    return ctes, R


def _model_sql(name):
    ctes, R, depth = boost_sql(name)
    splits = " UNION ALL ".join(
        f"SELECT trial_id, {t} AS round, {L} AS level, node, j AS feature, b AS bin, NULL::DOUBLE AS leaf_value FROM b{t}_{L}"
        for t in range(R) for L in range(depth))
    leaves = " UNION ALL ".join(
        f"SELECT trial_id, {t} AS round, {depth} AS level, node, NULL::INTEGER AS feature, NULL::INTEGER AS bin, w AS leaf_value FROM lf{t}"
        for t in range(R))
    return f"""WITH {LI},
    {", ".join(ctes)},
    m AS ({splits} UNION ALL {leaves})
    SELECT m.trial_id, CAST(m.round AS INTEGER) AS round, CAST(m.level AS INTEGER) AS level, CAST(m.node AS BIGINT) AS node,
           CAST(m.feature AS INTEGER) AS feature, CAST(m.bin AS INTEGER) AS bin, round(m.leaf_value, 6) AS leaf_value,
           round(v.val_cost, 6) AS cost
    FROM m JOIN vc{R - 1} v USING (trial_id)"""


def q_boosted_stump_round():
    return _model_sql("boosted_stump_round")


def q_objective_squared():
    return _model_sql("objective_squared")


def q_objective_logistic():
    return _model_sql("objective_logistic")


def q_objective_gamma():
    return _model_sql("objective_gamma")


def q_objective_tweedie():
    return _model_sql("objective_tweedie")


def q_row_subsample():
    return _model_sql("row_subsample")


def q_boosted_depth2():
    return _model_sql("boosted_depth2")


def q_shrinkage_step():
    ctes, R, _ = boost_sql("shrinkage_step")
    sel = " UNION ALL ".join(f"SELECT trial_id, CAST(round AS INTEGER) AS round, round(val_cost, 6) AS val_cost FROM vc{t}" for t in range(R))
    return f"WITH {LI}, {', '.join(ctes)} {sel}"


def q_early_stopping():
    from tuneforge.plans.catalog import ES_PATIENCE

    ctes, R, _ = boost_sql("early_stopping")
    allv = " UNION ALL ".join(f"SELECT trial_id, round, val_cost FROM vc{t}" for t in range(R))
    return f"""WITH {LI}, {', '.join(ctes)},
    h AS ({allv}),
    rbest AS (SELECT *, min(round(val_cost, 9)) OVER (PARTITION BY trial_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM h),
    imp AS (SELECT *, CASE WHEN prev_best IS NULL OR round(val_cost, 9) < prev_best THEN round END AS imp_round FROM rbest),
    br AS (SELECT *, max(imp_round) OVER (PARTITION BY trial_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_round_so_far FROM imp),
    stop AS (SELECT trial_id, coalesce(min(CASE WHEN round - best_round_so_far >= {ES_PATIENCE} THEN round END), max(round)) AS stop_round FROM br GROUP BY trial_id),
    fin AS (SELECT br.trial_id, br.best_round_so_far AS best_round FROM br JOIN stop ON br.trial_id = stop.trial_id AND br.round = stop.stop_round)
    SELECT fin.trial_id, round(h.val_cost, 6) AS cost, CAST(fin.best_round AS INTEGER) AS best_round
    FROM fin JOIN h ON h.trial_id = fin.trial_id AND h.round = fin.best_round"""


def q_fit_boosted_trees():
    """Flagship: grid search of the booster, every grid candidate fitted in one batch."""
    from tuneforge.plans.catalog import FLAGSHIP_SPACE, flagship_candidates

    cands = flagship_candidates()
    ctes, R = boost_sql_cands(cands, "reg_positive", "rmse", seed=13)
    last = " UNION ALL ".join(f"SELECT v.trial_id, v.val_cost FROM vc{t} v JOIN cand c USING (trial_id) WHERE c.nest = {t + 1}" for t in range(R))
    return f"""WITH {LI}, {', '.join(ctes)}, fin AS ({last})
    SELECT c.trial_id, CASE c.kind WHEN 'squared' THEN 'reg:linear' ELSE 'reg:tweedie' END AS objective,
           CAST(c.depth AS BIGINT) AS max_depth, round(c.lr, 6) AS learning_rate, CAST(c.nest AS BIGINT) AS n_estimators,
           round(round(fin.val_cost, 9), 6) AS cost
    FROM cand c JOIN fin USING (trial_id)"""


def q_quantile_bin():
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    probs = "[" + ", ".join(f"{i / 32!r}" for i in range(1, 32)) + "]"
    cuts = ", ".join(f"list_distinct(quantile_disc({c}, {probs})) AS c{j}" for j, c in enumerate(feats))
    bins = " UNION ALL ".join(f"SELECT {j} AS feature, len(list_filter(c{j}, lambda c: c < {c_})) AS bin FROM li, cuts" for j, c_ in enumerate(feats))
    return f"""WITH {LI}, cuts AS (SELECT {cuts} FROM li WHERE split = 'train')
    SELECT CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, count(*) AS n_rows FROM ({bins}) AS b GROUP BY feature, bin"""


def q_gbdt_leaf_wise():
    """The queue of leaf gains played over the splits of a level-wise derivation."""
    from tuneforge.plans.catalog import LEAF_WISE

    ctes, _ = boost_sql_cands([dict(c, max_depth=min(c["max_depth"], 3)) for c in LEAF_WISE], "reg_positive", "rmse", seed=13)
    every = " UNION ALL ".join(
        f"SELECT s.trial_id, {1 << L} + s.node AS n, s.j, s.b, gain, GL, HL, GR, HR FROM s0_{L} s JOIN b0_{L} b ON b.trial_id = s.trial_id AND b.node = s.node AND b.j = s.j AND b.b = s.b" for L in range(3))
    full = ", ".join(f"({c['trial_id']}, {c['max_depth']})" for c in LEAF_WISE)
    return f"""WITH {LI}, {', '.join(ctes)}, sp AS ({every}),
    full_depth(trial_id, d) AS (VALUES {full}),
    p1 AS (SELECT trial_id, 1 AS n FROM sp WHERE n = 1),
    p2 AS (SELECT trial_id, sp.n FROM sp JOIN p1 USING (trial_id) WHERE sp.n IN (2, 3) QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY gain DESC, sp.n) = 1),
    p3 AS (SELECT sp.trial_id, sp.n FROM sp JOIN p2 ON p2.trial_id = sp.trial_id WHERE (sp.n IN (2, 3) AND sp.n <> p2.n) OR sp.n IN (2 * p2.n, 2 * p2.n + 1)
           QUALIFY row_number() OVER (PARTITION BY sp.trial_id ORDER BY gain DESC, sp.n) = 1),
    chosen AS (SELECT * FROM p1 UNION ALL SELECT trial_id, n FROM p2 UNION ALL SELECT * FROM p3),
    cs AS (SELECT sp.* FROM sp JOIN chosen USING (trial_id, n)),
    ends AS (SELECT trial_id, 2 * n AS n, GL AS g, HL AS h FROM cs UNION ALL SELECT trial_id, 2 * n + 1, GR, HR FROM cs),
    leaf AS (SELECT e.trial_id, e.n, -g / (h + {LAM}::DOUBLE) * lr AS w FROM ends e JOIN cand USING (trial_id) WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.trial_id = e.trial_id AND cs.n = e.n)),
    lv AS (SELECT trial_id, n, w, CASE WHEN n < 2 THEN 0 WHEN n < 4 THEN 1 WHEN n < 8 THEN 2 ELSE 3 END AS l FROM leaf)
    SELECT trial_id, CAST(CASE WHEN n < 2 THEN 0 WHEN n < 4 THEN 1 ELSE 2 END AS INTEGER) AS level, CAST(CASE WHEN n < 2 THEN n - 1 WHEN n < 4 THEN n - 2 ELSE n - 4 END AS BIGINT) AS node,
           CAST(j AS INTEGER) AS feature, CAST(b AS INTEGER) AS bin, NULL::DOUBLE AS leaf_value FROM cs
    UNION ALL SELECT trial_id, CAST(d AS INTEGER), CAST((n - (1 << l)) << (d - l) AS BIGINT), NULL, NULL, round(w, 6) FROM lv JOIN full_depth USING (trial_id)"""


# ---------------------------------------------------------------- support vector models
def _svm_rows_sql(label="cls"):
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    mm = ", ".join(f"min({c}) AS mn{j}, max({c}) AS mx{j}" for j, c in enumerate(feats))
    xs = ", ".join(f"({c} - mn{j}) / CASE WHEN mx{j} > mn{j} THEN mx{j} - mn{j} ELSE 1.0 END AS x{j}" for j, c in enumerate(feats))
    return f"""smm AS (SELECT {mm} FROM li WHERE split = 'train'),
    sv AS (SELECT key, split, {label} AS label, {xs} FROM li, smm)"""


def hinge_sql(kind, label, steps=None, lr=None, p="", train="r.split = 'train'", held="r.split = 'val'", rows=True):
    """Steps as CTEs ``ws{p}{t}`` over the rows of ``train``; ``dv{p}``: scores of the rows of ``held``."""
    from tuneforge.operators.svm import SVR_EPSILON
    from tuneforge.plans.catalog import SVM_CANDS, SVM_LR, SVM_STEPS

    steps = SVM_STEPS if steps is None else steps
    lr = SVM_LR if lr is None else lr
    cv = ", ".join(f"({c['trial_id']}, {float(c['C'])!r}::DOUBLE)" for c in SVM_CANDS)
    ctes = [*[_svm_rows_sql(label)] * rows,
            f"nt{p} AS (SELECT count(*) AS n FROM sv r WHERE {train})",
            f"ws{p}0 AS (SELECT trial_id, C, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3, 0.0::DOUBLE AS b "
            f"FROM (VALUES {cv}) AS t(trial_id, C))"]
    f = "(((w.w0 * r.x0 + w.w1 * r.x1) + w.w2 * r.x2) + w.w3 * r.x3 + w.b)"
    for t in range(steps):
        eta = lr / (1.0 + t)
        if kind == "svc":
            cond, coef = f"(r.label * 2.0 - 1.0) * {f} < 1.0", "(r.label * 2.0 - 1.0)"
        else:
            cond, coef = f"abs({f} - r.label) > {SVR_EPSILON!r}", f"sign({f} - r.label)"
        sums = ", ".join(f"coalesce(sum(CASE WHEN {cond} THEN {coef} * r.x{j} END), 0.0) AS s{j}" for j in range(4))
        ctes.append(f"ag{p}{t} AS (SELECT w.trial_id, {sums}, coalesce(sum(CASE WHEN {cond} THEN {coef} END), 0.0) AS sb "
                    f"FROM ws{p}{t} w, sv r WHERE {train} GROUP BY w.trial_id)")
        lam = "(1.0 / (w.C * ntr.n))"
        if kind == "svc":
            upd = ", ".join(f"w.w{j} - {eta!r} * ({lam} * w.w{j} - a.s{j} / ntr.n) AS w{j}" for j in range(4))
            ub = f"w.b - {eta!r} * (-a.sb / ntr.n) AS b"
        else:
            upd = ", ".join(f"w.w{j} - {eta!r} * ({lam} * w.w{j} + a.s{j} / ntr.n) AS w{j}" for j in range(4))
            ub = f"w.b - {eta!r} * (a.sb / ntr.n) AS b"
        ctes.append(f"ws{p}{t + 1} AS (SELECT w.trial_id, w.C, {upd}, {ub} FROM ws{p}{t} w JOIN ag{p}{t} a USING (trial_id), nt{p} ntr)")
    ctes.append(f"dv{p} AS (SELECT w.trial_id, r.key, r.label, {f} AS score FROM ws{p}{steps} w, sv r WHERE {held})")
    return ",\n".join(ctes), steps


def q_svm_linear_steps():
    ctes, T = hinge_sql("svc", "cls")
    return f"""WITH {LI}, {ctes},
    ac AS (SELECT trial_id, 1.0 - avg(CASE WHEN label = (CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END) THEN 1.0 ELSE 0.0 END) AS cost FROM dv GROUP BY trial_id)
    SELECT w.trial_id, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3, round(b, 6) AS b, round(ac.cost, 6) AS cost
    FROM ws{T} w JOIN ac USING (trial_id)"""


def q_svr_steps():
    ctes, T = hinge_sql("svr", "reg")
    return f"""WITH {LI}, {ctes},
    ac AS (SELECT trial_id, sqrt(avg(pow(label - score, 2))) AS cost FROM dv GROUP BY trial_id)
    SELECT w.trial_id, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3, round(b, 6) AS b, round(ac.cost, 6) AS cost
    FROM ws{T} w JOIN ac USING (trial_id)"""


def q_rff_features():
    from tuneforge.plans.catalog import RFF_GAMMA, RFF_M, RFF_SEED

    om = " UNION ALL ".join(
        f"SELECT {m} AS m, {j} AS j, sqrt(2.0 * {RFF_GAMMA!r}) * sqrt(-2.0 * ln(1.0 - {U(RFF_SEED, chr(39) + 'w1' + chr(39), str(m), str(j))})) "
        f"* cos(2.0 * pi() * {U(RFF_SEED, chr(39) + 'w2' + chr(39), str(m), str(j))}) AS om"
        for m in range(RFF_M) for j in range(4))
    ph = " UNION ALL ".join(f"SELECT {m} AS m, 2.0 * pi() * {U(RFF_SEED, chr(39) + 'b' + chr(39), str(m))} AS ph" for m in range(RFF_M))
    return f"""WITH {LI}, {_svm_rows_sql()},
    om AS ({om}), ph AS ({ph}),
    w AS (SELECT ph.m, ph.ph, max(CASE WHEN om.j = 0 THEN om.om END) AS o0, max(CASE WHEN om.j = 1 THEN om.om END) AS o1,
                 max(CASE WHEN om.j = 2 THEN om.om END) AS o2, max(CASE WHEN om.j = 3 THEN om.om END) AS o3
          FROM ph JOIN om USING (m) GROUP BY ph.m, ph.ph)
    SELECT CAST(w.m AS INTEGER) AS m, round(sum(sqrt(2.0 / {RFF_M}) * cos((((w.o0 * r.x0 + w.o1 * r.x1) + w.o2 * r.x2) + w.o3 * r.x3) + w.ph)), 6) AS z_sum
    FROM w, sv r WHERE r.split = 'train' GROUP BY w.m"""


def q_poly_features():
    from tuneforge.operators.svm import poly_coefficients, poly_monomials
    from tuneforge.plans.catalog import POLY_DEGREE, POLY_GAMMA

    monos = poly_monomials(4, POLY_DEGREE)
    coefs = poly_coefficients(monos, POLY_DEGREE, POLY_GAMMA)
    terms = []
    for m, (alpha, c) in enumerate(zip(monos, coefs)):
        e = f"{float(c)!r}::DOUBLE"
        for j, a in enumerate(alpha):
            for _ in range(a):
                e = f"({e} * r.x{j})"
        terms.append(f"SELECT {m} AS m, round(sum({e}), 6) AS z_sum FROM sv r WHERE r.split = 'train'")
    return f"WITH {LI}, {_svm_rows_sql()} SELECT CAST(m AS INTEGER) AS m, z_sum FROM ({' UNION ALL '.join(terms)})"


def q_svm_probability():
    from tuneforge.plans.catalog import SVM_FOLD_SEED, SVM_FOLDS

    fold = f"floor({U(SVM_FOLD_SEED, chr(39) + 'fold' + chr(39), 'r.key')} * {float(SVM_FOLDS)})"
    each = [hinge_sql("svc", "cls", p=f"_{k}_", train=f"r.split = 'train' AND {fold} <> {k}", held=f"r.split = 'train' AND {fold} = {k}", rows=k == 0)[0]
            for k in range(SVM_FOLDS)]
    ctes = ", ".join(each) + ", dv AS (" + " UNION ALL ".join(f"SELECT * FROM dv_{k}_" for k in range(SVM_FOLDS)) + ")"
    out = [f"""cn AS (SELECT trial_id, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS np, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS nn FROM dv GROUP BY trial_id)""",
           "pl0 AS (SELECT trial_id, 0.0::DOUBLE AS A, ln((nn + 1.0) / (np + 1.0)) AS B, (np + 1.0) / (np + 2.0) AS hi, 1.0 / (nn + 2.0) AS lo FROM cn)"]
    for s in range(2):
        tt = "CASE WHEN d.label = 1 THEN p.hi ELSE p.lo END"
        pr = "(1.0 / (1.0 + exp(p.A * d.score + p.B)))"
        out.append(f"""pg{s} AS (SELECT p.trial_id, sum(d.score * ({tt} - {pr})) AS gA, sum({tt} - {pr}) AS gB,
                        sum(d.score * d.score * ({pr} * (1.0 - {pr}))) AS hAA, sum(d.score * ({pr} * (1.0 - {pr}))) AS hAB,
                        sum({pr} * (1.0 - {pr})) AS hBB FROM pl{s} p JOIN dv d USING (trial_id) GROUP BY p.trial_id)""")
        haa, hbb = "(g.hAA + 1e-12)", "(g.hBB + 1e-12)"
        det = f"({haa} * {hbb} - g.hAB * g.hAB)"
        out.append(f"""pl{s + 1} AS (SELECT p.trial_id, p.A - ({hbb} * g.gA - g.hAB * g.gB) / {det} AS A,
                        p.B - (-g.hAB * g.gA + {haa} * g.gB) / {det} AS B, p.hi, p.lo FROM pl{s} p JOIN pg{s} g USING (trial_id))""")
    return f"WITH {LI}, {ctes}, {', '.join(out)} SELECT trial_id, round(A, 6) AS A, round(B, 6) AS B FROM pl2"


def q_save_search():
    return f"""WITH {LI}, {_grid_cte()},
    best AS (SELECT * FROM gc ORDER BY cost, trial_id LIMIT 1)
    SELECT 'linear' AS estimator, 'regression' AS task, 'Grid' AS selection_type,
           (SELECT count(*) FROM gc) AS attempts, (SELECT count(*) FROM gc) AS total_combinations,
           round(a, 6) AS a, b, round(cost, 4) AS best_cost FROM best"""


def q_fit_gbdt():
    """gbdt grid search (binary classification, AUC); early stopping on: cost = best round."""
    from tuneforge.plans.catalog import gbdt_candidates

    cands = gbdt_candidates()
    ctes, R = boost_sql_cands(cands, "cls", "auc", seed=13)
    allv = " UNION ALL ".join(f"SELECT trial_id, round, val_cost FROM vc{t}" for t in range(R))
    return f"""WITH {LI}, {', '.join(ctes)},
    h AS ({allv}),
    b AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY round(val_cost, 9), round) AS rn FROM h)
    SELECT c.trial_id, round(c.lr, 6) AS learning_rate, CAST(c.depth AS BIGINT) AS max_depth,
           CAST(c.nest AS BIGINT) AS n_estimators, round(c.ss, 6) AS subsample, round(round(b.val_cost, 9), 6) AS cost
    FROM cand c JOIN b USING (trial_id) WHERE b.rn = 1"""


def q_predict_boosted():
    ctes, R, _ = boost_sql("boosted_depth2")
    return f"""WITH {LI}, {', '.join(ctes)}
    SELECT f.trial_id, f.key, round(f.f, 6) AS pred FROM f{R} f JOIN rws r USING (key) WHERE r.split = 'test'"""


def q_regression_walkthrough():
    from tuneforge.plans.catalog import WALK_SPACE, flagship_candidates

    ctes, R = boost_sql_cands(flagship_candidates(WALK_SPACE), "(reg - tmn) / (tmx - tmn)", "rmse", seed=13)
    ctes[0] = ctes[0].replace(" FROM li", ", min(reg) AS tmn, max(reg) AS tmx FROM li")
    last = " UNION ALL ".join(f"SELECT v.trial_id, v.val_cost FROM vc{t} v JOIN cand c USING (trial_id) WHERE c.nest = {t + 1}" for t in range(R))
    final = " UNION ALL ".join(f"SELECT f.key, f.trial_id, f.f FROM f{t + 1} f JOIN cand c USING (trial_id) WHERE c.nest = {t + 1}" for t in range(R))
    return f"""WITH {LI}, {', '.join(ctes)}, fin AS ({last}), ff AS ({final}),
    best AS (SELECT trial_id, val_cost FROM fin ORDER BY round(val_cost, 9), trial_id LIMIT 1)
    SELECT CAST(c.trial_id AS BIGINT) AS trial_id, CAST(c.depth AS BIGINT) AS max_depth, round(c.lr, 6) AS learning_rate, CAST(c.nest AS BIGINT) AS n_estimators,
           round(round(max(b.val_cost), 9), 6) AS cost, count(*) AS n_test, round(sqrt(avg(pow(li.reg - (ff.f * (tmx - tmn) + tmn), 2))), 6) AS test_rmse
    FROM ff JOIN best b USING (trial_id) JOIN cand c USING (trial_id) JOIN li USING (key), bx WHERE li.split = 'test' GROUP BY c.trial_id, c.depth, c.lr, c.nest"""


def q_rebuild_boosted():
    from tuneforge.plans.catalog import flagship_candidates

    cands = flagship_candidates()
    ctes, R = boost_sql_cands(cands, "reg_positive", "rmse", seed=13)
    last = " UNION ALL ".join(f"SELECT v.trial_id, v.val_cost FROM vc{t} v JOIN cand c USING (trial_id) WHERE c.nest = {t + 1}" for t in range(R))
    final = " UNION ALL ".join(f"SELECT f.key, f.trial_id, f.f FROM f{t + 1} f JOIN cand c USING (trial_id) WHERE c.nest = {t + 1}" for t in range(R))
    return f"""WITH {LI}, {', '.join(ctes)}, fin AS ({last}), ff AS ({final}),
    best AS (SELECT trial_id FROM fin ORDER BY round(val_cost, 9), trial_id LIMIT 1)
    SELECT CAST(ff.trial_id AS BIGINT) AS trial_id, r.split,
           round(sqrt(avg(pow(r.label - CASE c.kind WHEN 'squared' THEN ff.f ELSE exp(ff.f) END, 2))), 6) AS cost
    FROM ff JOIN best USING (trial_id) JOIN cand c USING (trial_id) JOIN rws r USING (key)
    WHERE r.split IN ('val', 'test') GROUP BY ff.trial_id, r.split"""
