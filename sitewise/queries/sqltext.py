"""Repeated pieces of the reference SQL."""


def AUC(source: str, by: str, y: str, p: str, name: str = "auc") -> str:
    """CTE with the rank-sum AUROC per group (NULL for one class); ``by`` may be a list."""
    return f"""{name} as (
      select {by}, case when n1 * n0 = 0 then null else (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) end as auc from (
        select {by}, sum({y})::double as n1, sum(1 - {y})::double as n0, sum(case when {y} = 1 then mr end) as r1 from (
          select {by}, {y}, rank() over (partition by {by} order by {p}) + (count(*) over (partition by {by}, {p}) - 1) / 2.0::double as mr
          from {source}) group by {by}))"""


def METRICS(source: str, by: str, y: str, p: str, name: str = "metrics") -> str:
    """CTEs with all metrics per group."""
    clipped = f"greatest(least({p}, 1 - 1e-15::double), 1e-15::double)"
    return f"""{AUC(source, by, y, p, name + '_auc')}, {name} as (
      select s.*, a.auc from (
        select {by}, count({y}) as count, sum({y})::bigint as outcome, sum({y}) / sum({p}) as smr,
          avg(({y} - {p}) * ({y} - {p})) as mse, avg(abs({y} - {p})) as mae,
          avg(-({y} * ln({clipped}) + (1 - {y}) * ln(1 - {clipped}))) as logloss
        from {source} group by {by}) s join {name}_auc a using ({by}))"""


ROUNDED = "count, outcome, round(smr, 6) as smr, round(mse, 6) as mse, round(mae, 6) as mae, round(logloss, 6) as logloss, round(auc, 6) as auc"


def UNIFORM(key: str, seed: str | int) -> str:
    """Hash uniform of an SQL text key."""
    return f"(('0x' || substr(md5({key} || '|' || {seed!r}), 1, 8))::bigint / 4294967296.0::double)" if isinstance(seed, str) else f"(('0x' || substr(md5({key} || '|{seed}'), 1, 8))::bigint / 4294967296.0::double)"


def STANDARD(source: str, features: list[str], by: str | None = None) -> str:
    """Select list of mean-imputed features, centred and scaled by the population SD (by group)."""
    over = f"over (partition by {by})" if by else "over ()"
    parts = []
    for f in features:
        filled = f"coalesce({f}, {f}_m, 0)"
        parts.append(f"case when {f}_s > 0 then ({filled} - coalesce({f}_m, 0)) / {f}_s else {filled} - coalesce({f}_m, 0) end as {f}")
    means = ", ".join(f"avg({f}) {over} as {f}_m" for f in features)
    sds = ", ".join(f"stddev_pop(coalesce({f}, {f}_m, 0)) {over} as {f}_s" for f in features)
    others = ", ".join(parts)
    return f"select * exclude ({', '.join(features)}), {others} from (select *, {sds} from (select *, {means} from {source}))"


def _solved(k: int, keys: str) -> str:
    """Select of the solution d0.. of a symmetric system, upper triangle a{i}_{j} and right side r{i}, by elimination and back substitution."""
    names = [f"a{i}_{j}" for i in range(k) for j in range(i, k)] + [f"r{i}" for i in range(k)]
    text = "sums"
    for p in range(k):
        changed = {f"a{i}_{j}": f"a{i}_{j} - a{p}_{i} * a{p}_{j} / a{p}_{p}" for i in range(p + 1, k) for j in range(i, k)}
        changed |= {f"r{i}": f"r{i} - a{p}_{i} * r{p} / a{p}_{p}" for i in range(p + 1, k)}
        text = f"(select {keys}, {', '.join(f'{changed.get(n, n)} as {n}' for n in names)} from {text})"
    for p in reversed(range(k)):
        rest = "".join(f" - a{p}_{j} * d{j}" for j in range(p + 1, k))
        text = f"(select *, (r{p}{rest}) / a{p}_{p} as d{p} from {text})"
    return text


def FIT(source: str, features: list[str], name: str = "fit", by: str = "model", c: str = "1.0::double", steps: int = 16) -> str:
    """CTEs of the penalised logistic models of all groups of rows (by, y, features): (by, n_rows, n_pos, m1.., s1.., b0..), b0.. NULL for one class.

    Newton steps from 0 as a recursive table: each joins the coefficients to the standardised rows, sums gradient and curvature and solves the
    system.  ``c``, the inverse penalty, may be an expression of ``by``.  Needs ``with recursive``.
    """
    k = len(features) + 1
    coef = [f"b{i}" for i in range(k)]
    z = ["1.0::double", *(f"z{i}" for i in range(1, k))]
    means = ", ".join(f"coalesce(avg({f}), 0)::double as m{i}, sqrt(var_pop({f}) * count({f}) / count(*)) as v{i}" for i, f in enumerate(features, 1))
    scales = ", ".join(f"m{i}, case when v{i} > 0 then v{i} else 1 end::double as s{i}" for i in range(1, k))
    rows = ", ".join(f"coalesce(({f} - m{i}) / s{i}, 0) as z{i}" for i, f in enumerate(features, 1))
    linear = " + ".join(f"b{i} * {z[i]}" for i in range(k))
    penalty = lambda i: f" + b{i} / ({c})" if i else ""
    gradient = [f"sum({z[i]} * (p - y)){penalty(i)} as r{i}" for i in range(k)]
    curve = [f"sum({z[i]} * {z[j]} * p * (1 - p)){f' + 1 / ({c})' if i == j and i else ''} as a{i}_{j}" for i in range(k) for j in range(i, k)]
    keys = f"{by}, it, {', '.join(coef)}"
    return f"""{name}_stats as materialized (select {by}, n_rows, n_pos, {scales} from (
        select {by}, count(*) as n_rows, sum(y)::bigint as n_pos, {means} from {source} group by {by})),
      {name}_rows as materialized (select {by}, y, {rows} from {source} join {name}_stats using ({by})),
      {name}_steps as (
        select {by}, 0 as it, {', '.join(f'0.0::double as {b}' for b in coef)} from {name}_stats where n_pos > 0 and n_pos < n_rows
        union all
        select {by}, it + 1, {', '.join(f'b{i} - d{i}' for i in range(k))} from (
          with sums as (select {keys}, {', '.join(gradient + curve)} from (
            select *, 1 / (1 + exp(-({linear}))) as p from {name}_steps join {name}_rows using ({by}) where it < {steps}) group by {keys})
          select * from {_solved(k, keys)})),
      {name} as (select s.*, {', '.join(coef)} from {name}_stats s left join {name}_steps t on s.{by} = t.{by} and it = {steps})"""


def PROBABILITY(features: list[str]) -> str:
    """Probability of a row next to the columns of its model."""
    return f"1 / (1 + exp(-(b0 + {' + '.join(f'b{i} * coalesce(({f} - m{i}) / s{i}, 0)' for i, f in enumerate(features, 1))})))"


def rounded_metrics(digits: int = 4) -> str:
    return "count, outcome, " + ", ".join(f"round({m}, {digits}) as {m}" for m in ("smr", "mse", "mae", "logloss", "auc"))
