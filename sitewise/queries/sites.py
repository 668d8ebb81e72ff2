"""Site summaries, metrics, preparation and fixed-coefficient scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.scalar import flag, r6
from sitewise.operators import metrics as M
from sitewise.operators import prep, summary
from sitewise.operators.joins import paired_delta
from sitewise.operators.matrix import score_matrix
from sitewise.operators.models import score, score_rescaled
from sitewise.operators.ranking import exact_quantiles, ordered_positions
from sitewise.plans.offset_source import severity_rows
from sitewise.queries.registry import query
from sitewise.queries.series import rounded
from sitewise.queries.sqltext import AUC, METRICS, ROUNDED, STANDARD

FEATURES = ["x1", "x2", "x3", "x4"]
METRIC_NAMES = ("smr", "mse", "mae", "logloss", "auc")

# --- sizes and rates


@query("site_sizes", "select site, count(*) as n from stay group by site", "stay")
def site_sizes(fr):
    return summary.site_sizes(fr.stay, "site")


@query(
    "site_threshold_counts",
    """select count(*) as sites, min(n) as smallest, max(n) as largest, count(*) filter (n >= 500) as sites_ge_500, count(*) filter (n >= 600) as sites_ge_600,
         count(*) filter (n >= 700) as sites_ge_700 from (select site, count(*) as n from stay group by site)""",
    "stay",
)
def site_threshold_counts(fr):
    return summary.size_overview(fr.stay, "site", (500, 600, 700))


@query("largest_site", "select site, count(*) as n from stay group by site order by n desc, site limit 1", "stay")
def largest_site(fr):
    return summary.largest_site(fr.stay, "site")


@query("outcome_rate", "select site, count(*) as n, round(avg(y), 6) as rate from stay group by site", "stay")
def outcome_rate(fr):
    return summary.outcome_rate(fr.stay, ["site"], "y").withColumn("rate", r6("rate"))


@query(
    "sites_by_mortality",
    "select site, rate, row_number() over (order by rate, site)::int as place from (select site, round(avg(y), 6) as rate from stay group by site)",
    "stay",
)
def sites_by_mortality(fr):
    """Axis position of each site when sorted by outcome rate."""
    rates = summary.outcome_rate(fr.stay, ["site"], "y").select("site", r6("rate").alias("rate"))
    placed = ordered_positions(rates, (), [F.col("rate"), F.col("site")], "place")
    return placed.withColumn("place", F.col("place").cast("int"))


@query("top_sites", "select site, count(*) as n from stay group by site order by n desc, site limit 5", "stay")
def top_sites(fr):
    return summary.site_sizes(fr.stay, "site").orderBy(F.col("n").desc(), "site").limit(5)


@query(
    "site_correlation",
    "select round(corr(n, rate), 6) as n_rate, round(corr(mean_price, rate), 6) as price_rate, round(corr(mean_balance, mean_price), 6) as balance_price from siteinfo",
    "siteinfo",
)
def site_correlation(fr):
    pairs = {"n_rate": ("n", "rate"), "price_rate": ("mean_price", "rate"), "balance_price": ("mean_balance", "mean_price")}
    return fr.siteinfo.agg(*[F.round(F.corr(a, b), 6).alias(name) for name, (a, b) in pairs.items()])


# --- descriptive tables

CONTINUOUS = ("x1", "x2", "x3", "x4")


@query(
    "table_one_continuous",
    " union all ".join(
        f"select kind, '{c}' as variable, count({c}) as n, count(*) - count({c}) as missing, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as sd from feat group by kind"
        for c in CONTINUOUS
    ),
    "feat",
)
def table_one_continuous(fr):
    table = summary.continuous_table(fr.feat, ["kind"], CONTINUOUS)
    return table.withColumns({"mean": r6("mean"), "sd": r6("sd")})


CATEGORICAL = ("status", "kind", "y")


@query(
    "table_one_categorical",
    " union all ".join(
        f"""select grp, '{c}' as variable, coalesce({c}::varchar, 'None') as level, count(*) as n,
              round(100.0::double * count(*) / sum(count(*)) over (partition by grp), 6) as pct from stay group by grp, 3"""
        for c in CATEGORICAL
    ),
    "stay",
)
def table_one_categorical(fr):
    return summary.categorical_table(fr.stay, ["grp"], CATEGORICAL).withColumn("pct", r6("pct"))


@query(
    "table_one_quantiles",
    " union all ".join(
        f"""select kind, '{c}' as variable, {", ".join(f"round(quantile_cont({c}::double, {q}), 6) as {n}" for q, n in ((0.25, 'q1'), (0.5, 'median'), (0.75, 'q3')))}
            from feat group by kind"""
        for c in CONTINUOUS
    ),
    "feat",
)
def table_one_quantiles(fr):
    """Exact interpolated quartiles of groups of any size."""
    return rounded(summary.quartile_table(fr.feat, ["kind"], CONTINUOUS), "kind", "variable")


@query(
    "curve_summary",
    """select disch_h, n, round(mean, 6) as mean, round(mean - 1.96::double * sd / sqrt(n), 6) as lower,
         round(mean + 1.96::double * sd / sqrt(n), 6) as upper from (
         select disch_h, count(balance) as n, avg(balance) as mean, stddev_samp(balance) as sd from stay group by 1)""",
    "stay",
)
def curve_summary(fr):
    """Mean and interval at each step."""
    return rounded(summary.curve(fr.stay, ["disch_h"], "balance"), "disch_h", "n")


EDGES = [float(e) for e in range(0, 96, 4)] + [1000.0]


@query(
    "histogram_fixed_edges",
    f"""with edges as (select unnest(range(0, {len(EDGES) - 1}))::int as bin, unnest({EDGES[:-1]})::double as lo, unnest({EDGES[1:]})::double as hi),
        binned as (select bin, lo, hi, count(id) as n from edges left join stay
          on disch_h >= lo and (disch_h < hi or (bin = {len(EDGES) - 2} and disch_h = hi)) group by 1, 2, 3)
        select bin, lo, hi, n, round(n / (sum(n) over () * (hi - lo)), 6) as density from binned""",
    "stay",
)
def histogram_fixed_edges(fr):
    return summary.histogram(fr.stay, "disch_h", EDGES).withColumn("density", r6("density"))


# --- metrics of scored rows


@query("auroc_overall", f"with one as (select 1 as g, y, p from pred), {AUC('one', 'g', 'y', 'p')} select round(auc, 6) as auc from auc", "pred")
def auroc_overall(fr):
    """One group of all rows: cut at score quantiles, no single-task ordering."""
    return M.evaluate(fr.pred, [], "y", "p").select(r6("auc").alias("auc"))


@query("auroc_by_site", f"with {AUC('pred', 'site', 'y', 'p')} select site, round(auc, 6) as auc from auc", "pred")
def auroc_by_site(fr):
    return M.evaluate(fr.pred, ["site"], "y", "p").select("site", r6("auc").alias("auc"))


@query("smr_by_site", "select site, round(sum(y) / sum(p), 6) as smr from pred group by site", "pred")
def smr_by_site(fr):
    return M.smr(fr.pred, ["site"], "y", "p").withColumn("smr", r6("smr"))


@query("error_by_site", "select site, round(avg((y - p) * (y - p)), 6) as mse, round(avg(abs(y - p)), 6) as mae from pred group by site", "pred")
def error_by_site(fr):
    return rounded(M.errors(fr.pred, ["site"], "y", "p"), "site")


@query(
    "logloss_by_site",
    """select site, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as logloss from (
         select site, y, greatest(least(p, 1 - 1e-15::double), 1e-15::double) as q from pred) group by site""",
    "pred",
)
def logloss_by_site(fr):
    return rounded(M.log_loss(fr.pred, ["site"], "y", "p"), "site")


@query(
    "r2_score",
    """select site, round(1 - sum((p2 - p) * (p2 - p)) / sum((p2 - m) * (p2 - m)), 6) as r2
       from (select *, avg(p2) over (partition by site) as m from pred) group by site""",
    "pred",
)
def r2_score(fr):
    return M.r2(fr.pred, ["site"], F.col("p2"), F.col("p")).withColumn("r2", r6("r2"))


@query("site_metrics", f"with {METRICS('pred', 'site', 'y', 'p')} select site, {ROUNDED} from metrics", "pred")
def site_metrics(fr):
    """All metrics of all sites from one pass over (site, score) counts."""
    return rounded(M.evaluate(fr.pred, ["site"], "y", "p"), "site", "count", "outcome")


@query("score_direct", f"with scored as (select p.hospitalid as site, (p.hospitaldischargestatus is not distinct from 'Expired')::int as y, a.predictedhospitalmortality::double as p from patient p join apache a using (patientunitstayid) where a.apacheversion = 'IVa' and a.predictedhospitalmortality not in ('', '-1')), {METRICS('scored', 'site', 'y', 'p')} select site, {ROUNDED} from metrics", "patient apache")
def score_direct(fr):
    """A severity score that already is a probability, evaluated per site."""
    return rounded(direct_metrics(fr), "site", "count", "outcome")


def direct_metrics(fr):
    """Metrics per site of the severity score's own probability."""
    risk = F.col("predictedhospitalmortality").try_cast("double")
    scores = severity_rows(fr.apache).select("patientunitstayid", risk.alias("p")).filter("p > 0")
    rows = fr.patient.join(scores, "patientunitstayid").select(
        F.col("hospitalid").alias("site"), flag(F.col("hospitaldischargestatus") == "Expired").alias("y"), "p"
    )
    return M.evaluate(rows, ["site"])


DELTA_SQL = f"""{METRICS('pred', 'site', 'y', 'p', 'before')}, {METRICS('pred', 'site', 'y', 'p2', 'after')},
  delta as (select b.site, b.auc, b.smr, a.auc as auc_norm, a.smr as smr_norm, a.auc - b.auc as auc_diff, a.smr - b.smr as smr_diff
    from before b join after a using (site))"""


def deltas(fr):
    before, after = (M.evaluate(fr.pred, ["site"], "y", p) for p in ("p", "p2"))
    return paired_delta(before, after, "site", ["auc", "smr"])


@query("metric_delta", f"with {DELTA_SQL} select site, round(columns(* exclude (site)), 6) from delta", "pred")
def metric_delta(fr):
    """Metrics of two scores side by side with their differences."""
    return rounded(deltas(fr), "site")


@query(
    "improvement_share",
    f"with {DELTA_SQL} select round(avg(auc_diff), 6) as mean_delta, count(*) filter (auc_diff > 0) as improved, round(avg((auc_diff > 0)::int), 6) as share_improved from delta",
    "pred",
)
def improvement_share(fr):
    return rounded(summary.improvement(deltas(fr), "auc_diff"), "improved")


@query(
    "improvement_quantiles",
    f"with {DELTA_SQL} select round(avg(auc_diff), 6) as mean, round(quantile_cont(auc_diff, 0.25), 6) as q25, round(quantile_cont(auc_diff, 0.75), 6) as q75 from delta",
    "pred",
)
def improvement_quantiles(fr):
    """Mean change with its quartiles."""
    changes = deltas(fr)
    quartiles = exact_quantiles(changes, [], "auc_diff", (0.25, 0.75), ("q25", "q75"))
    mean = changes.agg(F.avg("auc_diff").alias("mean"))
    return rounded(quartiles.withColumn("mean", mean.scalar()))


@query(
    "funnel_outliers",
    f"""with {METRICS('pred', 'site', 'y', 'p')} select site, count, outcome, round(smr, 6) as smr, round(1 + 1.96::double * sqrt(count) / count, 6) as upper,
          round(1 - 1.96::double * sqrt(count) / count, 6) as lower,
          (smr > 1 + 1.96::double * sqrt(count) / count or smr < 1 - 1.96::double * sqrt(count) / count)::int as outside from metrics where outcome >= 10""",
    "pred",
)
def funnel_outliers(fr):
    """Sites outside the limits for their size."""
    marked = M.funnel_outliers(M.evaluate(fr.pred, ["site"], "y", "p"))
    return rounded(marked.select("site", "count", "outcome", "smr", "upper", "lower", "outside"), "site", "count", "outcome", "outside")


@query(
    "funnel_limits",
    """select n, round(1 + 1.96::double * sqrt(n) / n, 6) as upper, round(1 - 1.96::double * sqrt(n) / n, 6) as lower
       from (select unnest(range(10, (select max(n) from (select count(*) as n from pred group by site))::bigint, 10)) as n)""",
    "pred",
)
def funnel_limits(fr):
    """Limits for all sizes up to the largest site, in steps of ten."""
    largest = summary.site_sizes(fr.pred, "site").agg(F.max("n")).first()[0]
    return rounded(M.funnel_limits(fr.spark, last=largest or 0), "n")


# --- preparation


@query(
    "impute_mean",
    "select id, " + ", ".join(f"round(coalesce({f}, avg({f}) over (partition by site), 0), 6) as {f}" for f in FEATURES) + " from feat",
    "feat",
)
def impute_mean(fr):
    """Missing values by the site mean, 0 where a site never measured."""
    return rounded(prep.impute_mean(fr.feat, FEATURES, ["site"]).select("id", *FEATURES), "id")


def _round_features(source: str) -> str:
    return "select id, " + ", ".join(f"round({f}, 6) as {f}" for f in FEATURES) + f" from ({source})"


@query("standardize", _round_features(STANDARD("feat", FEATURES)), "feat")
def standardize(fr):
    """Mean imputation and population scaling over all rows."""
    return rounded(prep.standardize(fr.feat, FEATURES).select("id", *FEATURES), "id")


# --- fixed coefficients

CENTRE = (150000.0, 4500.0, 3.0, 5.0)
SPREAD = (80000.0, 3000.0, 2.0, 3.0)


def nation_models(fr, key: str = "model_id"):
    """Model table with fixed coefficients, one per nation."""
    return fr.nationmodel.select(
        F.col("model_id").alias(key),
        F.array(*map(F.lit, CENTRE)).alias("mean"),
        F.array(*map(F.lit, SPREAD)).alias("scale"),
        F.col("b").alias("intercept"),
        F.array("w1", "w2", "w3", "w4").alias("coef"),
    )


def linear_sql(features=FEATURES) -> str:
    terms = " + ".join(f"w{i} * coalesce(({f} - {CENTRE[i - 1]}::double) / {SPREAD[i - 1]}::double, 0)" for i, f in enumerate(features, 1))
    return f"1 / (1 + exp(-(b + {terms})))"


@query("score_linear", f"select id, round({linear_sql()}, 6) as p from feat join nationmodel on model_id = site", "feat nationmodel")
def score_linear(fr):
    """Probability of each row under the model of its site."""
    return score(fr.feat, nation_models(fr, "site"), "site", FEATURES).select("id", r6("p").alias("p"))


RESCALED = "1 / (1 + exp(-(b + w1 * x1 + w2 * x2 + w3 * x3 + w4 * x4)))"


def rescaled_sql(source: str) -> str:
    return f"""with scaled as ({STANDARD(source, FEATURES, 'site')}), scored as (select site, y, {RESCALED} as p from scaled, (select * from nationmodel where model_id = 7) m),
      {METRICS('scored', 'site', 'y', 'p')} select site, {ROUNDED} from metrics"""


@query("renormalize_by_site", rescaled_sql("feat"), "feat nationmodel")
def renormalize_by_site(fr):
    """Imputer and scaler refitted per site, coefficients kept."""
    model = nation_models(fr).filter("model_id = 7")
    scored = score_rescaled(fr.feat, model, ["site"], FEATURES, keep_imputer=False)
    return rounded(M.evaluate(scored, ["site"]), "site", "count", "outcome")


FILLED = "(select id, site, y, " + ", ".join(f"coalesce({f}, {c}::double) as {f}" for f, c in zip(FEATURES, CENTRE)) + " from feat)"


@query("rescale_by_site", rescaled_sql(FILLED), "feat nationmodel")
def rescale_by_site(fr):
    """Scaler refitted per site, imputation means of the training set kept."""
    model = nation_models(fr).filter("model_id = 7")
    scored = score_rescaled(fr.feat, model, ["site"], FEATURES, keep_imputer=True)
    return rounded(M.evaluate(scored, ["site"]), "site", "count", "outcome")


MATRIX_SQL = f"""scored as (select model_id * 100 + site as pair, model_id, site, y, {linear_sql()} as p from feat, nationmodel),
  {AUC('scored', 'pair', 'y', 'p')}, matrix as (select pair // 100 as train_site, pair % 100 as test_site, auc from auc)"""


def matrix(fr):
    rows = fr.feat.withColumnRenamed("site", "test_site")
    return score_matrix(rows, nation_models(fr), FEATURES).select("train_site", "test_site", "auc")


@query("perf_matrix", f"with {MATRIX_SQL} select train_site, test_site, round(auc, 6) as auc from matrix", "feat nationmodel")
def perf_matrix(fr):
    """Every model on every site, long form."""
    return rounded(matrix(fr), "train_site", "test_site")


@query("offdiag_variance", f"with {MATRIX_SQL} select train_site, round(var_pop(auc), 6) as variance from matrix where train_site <> test_site group by 1", "feat nationmodel")
def offdiag_variance(fr):
    return rounded(M.off_diagonal_variance(matrix(fr), "train_site", "test_site"), "train_site")


@query(
    "site_distance",
    f"""with {MATRIX_SQL} select a.train_site as site_i, a.test_site as site_j, round(1 - least(a.auc, b.auc), 6) as distance
        from matrix a join matrix b on a.train_site = b.test_site and a.test_site = b.train_site where a.train_site < a.test_site""",
    "feat nationmodel",
)
def site_distance(fr):
    """Symmetric distance of two sites from both directions of the matrix."""
    return rounded(M.site_distance(matrix(fr)), "site_i", "site_j")
