"""SQL of the derived relations (sources/bindings.py), for the twins of the queries."""

WILSON = """greatest(0.0, least(1.0, (({k}) / ({n}) + 1.645*1.645/(2*({n})) - 1.645*sqrt((({k})/({n}))*(1-({k})/({n}))/({n}) + 1.645*1.645/(4*({n})*({n}))))/(1 + 1.645*1.645/({n}))))"""


def wilson(k: str, n: str) -> str:
    k, n = f"cast({k} as double)", f"cast({n} as double)"
    return WILSON.format(k=k, n=n)


TIERS = "tiers(k, tier, samples, in_price, out_price) as (values (0,'small',5,1,5),(1,'mid',2,3,15),(2,'large',1,5,25))"


def obs(name: str = "obs", salt: int = 0) -> str:
    """The observations and what they need, as common table expressions."""
    return f"""{name}_raw as (
    select o_orderkey as rec_idx, k, tier, samples, samples * out_price as cost,
           cast(floor(cast(o_orderkey*{7919 + salt} + k*104729 as double)/13) as bigint) % (samples+1) as agree,
           cast(floor(cast(o_orderkey*{15487 + salt} + k*32453 as double)/17) as bigint) % 20 as u
    from orders, tiers
), {name}_lab as (
    select *, u < 13 + 3*k + case when agree = samples then 3 else 0 end as correct, {wilson('agree', 'samples')} as score from {name}_raw
), {name} as (
    select rec_idx, k, tier, samples, cast(cost as bigint) as cost, score, correct,
           case when rec_idx % 13 = 0 then null when (rec_idx*5+k) % 29 = 0 then not correct else correct end as true_correct,
           (rec_idx + k) % 53 = 0 as timed_out,
           coalesce(case when rec_idx % 13 = 0 then null when (rec_idx*5+k) % 29 = 0 then not correct else correct end, correct) as truth,
           k = 2 as is_last, rec_idx % 41 = 0 as cache_hit, rec_idx % 3 <> 0 as cache_correct,
           rec_idx % 97 = 0 as contaminated, rec_idx % 89 = 0 as oracle_unsound, rec_idx % 83 = 0 as oracle_inconclusive, rec_idx % 5 < 2 as shadow
    from {name}_lab
)"""


OBS = f"with {TIERS}, {obs()}"

CANDIDATES = """with cand as (
    select user_id as problem_id, event_id as idx, event_type as behaviour, event_type <> 'error' as verified,
           cast(strlen(props) as bigint) as bytes, event_id % 11 as complexity, event_type || '  ' || chr(10) || props as source from events
)"""

#: Replay of one threshold vector over obs: the accepting tier and its outcome, a cache hit first.
REPLAY = """acc as (
    select rec_idx, min(k) as a from obs where is_last or score >= case k when 0 then {t0} else {t1} end group by rec_idx
), rep as (
    select o.rec_idx, case when o.cache_hit then 'cache' else o.tier end as accepted_at, case when o.cache_hit then o.cache_correct else o.correct end as correct,
           case when o.cache_hit then o.cache_correct else o.truth end as true_correct,
           cast(case when o.cache_hit then 0 else (select sum(p.cost) from tiers_cost p where p.k <= o.k) end as bigint) as cost, acc.a, o.cache_hit,
           o.contaminated, o.oracle_unsound, o.shadow
    from obs o join acc on acc.rec_idx = o.rec_idx and acc.a = o.k
)"""
TIERS_COST = "tiers_cost as (select k, cast(samples * out_price as bigint) as cost from tiers)"


def replay(t0: float, t1: float) -> str:
    return f"{OBS}, {TIERS_COST}, {REPLAY.format(t0=f'cast({t0} as double)', t1=f'cast({t1} as double)')}"


def grid_points(where: str, by: str = "", source: str = "obs", pre: str = "") -> str:
    """Risk of every threshold vector over the observations that `where` keeps; `by` groups them. pre: tables that source needs."""
    b = f"{by}, " if by else ""
    on_by = f" and p.{by} = g.{by}" if by else ""
    return f"""{OBS}, {TIERS_COST}, {pre}levels as (select i, round(i * 0.1, 3)::double as v from range(11) t(i)),
grid as (select a.i * 11 + b.i as grid_idx, a.v as t0, b.v as t1 from levels a, levels b),
used as (select * from {source} where {where}),
wide as (
    select {b}rec_idx, max(score) filter (k=0) as s0, max(score) filter (k=1) as s1,
           [bool_or(not correct) filter (k=0), bool_or(not correct) filter (k=1), bool_or(not correct) filter (k=2)] as w,
           [bool_or(not truth) filter (k=0), bool_or(not truth) filter (k=1), bool_or(not truth) filter (k=2)] as t,
           bool_or(cache_hit) as hit, bool_or(cache_correct) as cc
    from used group by {b}rec_idx
), points as (
    select {b}grid_idx, t0, t1, cast(count(*) as bigint) as n,
           cast(count(*) filter (case when hit then not cc when s0 >= t0 then w[1] when s1 >= t1 then w[2] else w[3] end) as bigint) as bad,
           cast(count(*) filter (case when hit then not cc when s0 >= t0 then t[1] when s1 >= t1 then t[2] else t[3] end) as bigint) as bad_true,
           cast(sum(case when hit then 0 when s0 >= t0 then 25 when s1 >= t1 then 55 else 80 end) as bigint) as cost
    from wide, grid group by {b}grid_idx, t0, t1
)"""


def p_values(alpha: float, source: str = "points", by: str = "") -> str:
    """ranked: the points with risk, p and the rank in which they are tested."""
    b = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    return f"""heads as (select distinct n, bad, ceil(cast(n as double) * (cast(bad as double) / n)) as up from {source}),
tails as (
    select n, bad, sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(cast({alpha} as double)) + (n - i) * ln(1 - cast({alpha} as double)))) as cdf
    from (select n, bad, unnest(range(0, cast(up as bigint) + 1)) as i from heads) group by n, bad
), priced as (
    select x.*, cast(x.bad as double) / x.n as risk,
      case when cast(x.bad as double) / x.n >= {alpha} then 1.0 else least(1.0,
        exp(-x.n * (case when x.bad = 0 then 0 else (cast(x.bad as double)/x.n) * ln((cast(x.bad as double)/x.n)/cast({alpha} as double)) end
                    + case when x.bad = x.n then 0 else (1-cast(x.bad as double)/x.n) * ln((1-cast(x.bad as double)/x.n)/(1-cast({alpha} as double))) end)),
        2.718281828459045 * tails.cdf) end as p
    from {source} x join tails on tails.n = x.n and tails.bad = x.bad
), ranked as (select *, cast(row_number() over ({part}order by t0 + t1 desc, t0 desc, t1 desc) as bigint) as test_rank from priced)"""


def certificate(alpha: float, delta: float, method: str = "fixed-sequence", where: str = "not contaminated and not oracle_unsound and shadow") -> str:
    ok = f"max(cast(p > {delta} as int)) over (order by test_rank rows unbounded preceding) = 0" if method == "fixed-sequence" else f"p <= cast({delta} as double) / (select count(*) from priced)"
    first = "test_rank" if method == "fixed-sequence" else "grid_idx"
    return f"""{grid_points(where)}, {p_values(alpha)}, tested as (select *, {ok} as certified from ranked),
chosen as (select * from tested order by certified desc, case when certified then cast(cost as double) else risk end, case when certified then {first} else grid_idx end limit 1)
select (select bool_or(certified) from tested) as valid, cast({alpha} as double) as alpha, cast({delta} as double) as delta, '{method}' as method, n as n_calibration,
       (select cast(count(*) filter (certified) as bigint) from tested) as n_certified, t0 as tau0, t1 as tau1, bad, round(risk, 9) as empirical_risk,
       round(cast(bad_true as double) / n, 9) as realized_risk, round(p, 9) as p_value, round(cast(cost as double) / n, 9) as expected_cost,
       certified and cast(bad_true as double) / n > {alpha} + 1e-9 as nominal_only
from chosen"""


#: Tables of a sweep: what is left of each cell (pattern, rho, seed), the draws off it, and both as streams of observations.
SWEEP = """cells(pattern, rho, seed, label) as (values {cells}), eps(epsilon) as (values {eps}),
base as (select *, score >= {tau0} as served from obs where k = 0 and not contaminated and not oracle_unsound), total as (select count(*) as n from base),
placed as (
    select pattern, rho, seed, rec_idx, truth, row_number() over (partition by pattern, rho, seed order by
        case pattern when 'easy-first' then -cast(truth as int) when 'cheap-accept' then -cast(served as int) else 0 end, case pattern when 'uniform' then 0.0 else -score end,
        case pattern when 'uniform' then cast('0x' || substr(sha256(label || rec_idx), 1, 12) as bigint) else 0 end, rec_idx) - 1 as p
    from base, cells
), residual as (select pattern, rho, seed, rec_idx, truth from placed, total where p >= least(round(rho * n), n - 1)),
sizes as (select pattern, rho, seed, count(*) as m, avg(cast(truth as int)) as accuracy from residual group by all),
drawn as (
    select pattern, rho, seed, epsilon, rec_idx, row_number() over (partition by pattern, rho, seed, epsilon order by
        cast('0x' || substr(sha256('shadow-' || seed || '-' || rho || '-' || epsilon || '-' || pattern || '-' || rec_idx), 1, 12) as bigint), rec_idx) as p
    from residual, eps where epsilon > 0
), shadow as (select * from drawn join sizes using (pattern, rho, seed) where p <= greatest(1, round(epsilon * m))),
streams as (
    select 'full' as cell, rec_idx from base
    union all select 'left ' || pattern || ' ' || rho || ' ' || seed, rec_idx from residual
    union all select 'drawn ' || pattern || ' ' || rho || ' ' || seed || ' ' || epsilon, rec_idx from shadow
), streamed as (select cell, obs.* from obs join streams using (rec_idx)), """


def sweep(cells: list[tuple[str, float, int]], eps: list[float], alpha: float, delta: float, tau0: float) -> str:
    """Everything up to the table swept, the rows of a sweep."""
    rows = ", ".join(f"('{p}', cast({r} as double), cast({s} as bigint), 'draw-{s}-{r}-')" for p, r, s in cells)
    pre = SWEEP.format(cells=rows, eps=", ".join(f"(cast({e} as double))" for e in eps), tau0=f"cast({tau0} as double)")
    return f"""{grid_points('true', 'cell', 'streamed', pre)}, {p_values(alpha, by='cell')},
tested as (select *, max(cast(p > {delta} as int)) over (partition by cell order by test_rank rows unbounded preceding) = 0 as certified from ranked),
chosen as (select * from (select *, row_number() over (partition by cell order by certified desc, case when certified then cast(cost as double) else risk end, case when certified then test_rank else grid_idx end) as rn,
    count(*) filter (certified) over (partition by cell) as n_certified from tested) where rn = 1),
joined as (
    select z.*, e.epsilon, c.n as n_calibration, c.certified, c.n_certified, c.t0, c.t1, c.risk, cast(l.bad_true as double) / l.n as deployed, cast(ceil(ln(cast({delta} as double)) / ln(1 - cast({alpha} as double))) as bigint) as needed
    from sizes z, eps e join chosen c on c.cell = case when e.epsilon = 0 then 'full' else 'drawn ' || pattern || ' ' || rho || ' ' || seed || ' ' || epsilon end
    join points l on l.cell = 'left ' || pattern || ' ' || rho || ' ' || seed and l.grid_idx = c.grid_idx
), swept as (
    select pattern, rho, seed, epsilon, cast(m as bigint) as n_residual, cast(case when epsilon > 0 then n_calibration else 0 end as bigint) as n_shadow, cast(n_calibration as bigint) as n_calibration,
        round((select avg(cast(truth as int)) from base), 9) as tier0_accuracy_d, round(accuracy, 9) as tier0_accuracy, m >= 2 and n_calibration >= 2 and certified as certified,
        cast(case when m >= 2 and n_calibration >= 2 then n_certified else 0 end as bigint) as n_certified, case when m >= 2 and n_calibration >= 2 then t0 end as tau0, case when m >= 2 and n_calibration >= 2 then t1 end as tau1,
        case when m >= 2 and n_calibration >= 2 then round(risk, 9) end as calibrated_risk, case when m >= 2 and n_calibration >= 2 then round(deployed, 9) end as deployed_risk,
        case when m >= 2 and n_calibration >= 2 then round(deployed - risk, 9) end as risk_gap, n_calibration < needed as underpowered,
        case when m < 2 or n_calibration < 2 then 'too few records: no certificate tried' when n_calibration < needed then 'calibrated on ' || n_calibration || ' records, at least ' || needed || ' are needed' else '' end as note
    from joined
)"""
