"""Written tables and models, read back."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sitewise.functions.scalar import r6
from sitewise.operators import prep
from sitewise.operators.metrics import evaluate
from sitewise.operators.pooled import assemble, fit_pooled_logistic, predict
from sitewise.operators.summary import outcome_rate
from sitewise.queries.registry import query
from sitewise.queries.sites import FEATURES
from sitewise.queries.sqltext import FIT, METRICS, PROBABILITY, STANDARD
from sitewise.sources import tables


@query("csv_roundtrip", "select id, site, y, round(x1, 6) as x1, x3, x4 from feat", "feat")
def csv_roundtrip(fr):
    """Compressed CSV written, then read with its schema; missing values survive."""
    rows = fr.feat.select("id", "site", "y", r6("x1").alias("x1"), "x3", "x4")
    return tables.read_matrix(fr.spark, tables.write_matrix(rows), rows.schema)


FOLD_SQL = "folded as (select (l_orderkey % 5)::int as fold, (l_returnflag = 'R')::int as y, l_quantity / 51 as p from lineitem)"


def fold_scores(fr):
    rows = fr.lineitem.select(
        (F.col("l_orderkey") % 5).cast("int").alias("fold"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_quantity") / 51).alias("p"),
    )
    return evaluate(rows, ["fold"])


@query("cv_summary_write", f"with {FOLD_SQL}, {METRICS('folded', 'fold', 'y', 'p')} select 'l2' as model, round(avg(auc), 6) as auc, round(avg(smr), 6) as smr from metrics")
def cv_summary_write(fr):
    """Mean of fold metrics per model, written as CSV and read back."""
    path = tables.write_cv_summary(fold_scores(fr).withColumn("model", F.lit("l2")))
    back = tables.read_matrix(fr.spark, path, "model string, auc double, smr double")
    return back.withColumns({"auc": r6("auc"), "smr": r6("smr")})


@query("cv_mean", f"with {FOLD_SQL}, {METRICS('folded', 'fold', 'y', 'p')} select round(avg(auc), 6) as auc_cv, round(avg(smr), 6) as smr_cv from metrics")
def cv_mean(fr):
    return fold_scores(fr).agg(r6(F.avg("auc")).alias("auc_cv"), r6(F.avg("smr")).alias("smr_cv"))


@query("materialize", "select site, count(*) as n, round(avg(y), 6) as rate from stay group by site", "stay")
def materialize(fr):
    """Table written and read back."""
    return tables.materialize(outcome_rate(fr.stay, ["site"], "y").withColumn("rate", r6("rate")))


def complete(fr):
    """Standardised model inputs without missing values."""
    return prep.standardize(fr.feat, FEATURES).select("id", "site", "y", *FEATURES)


@query("assemble_vector", f"select id, y, {', '.join(f'round({f}, 6) as {f}' for f in FEATURES)} from ({STANDARD('feat', FEATURES)})", "feat")
def assemble_vector(fr):
    """Feature vectors as Spark's estimators read them, taken apart again."""
    vectors = assemble(complete(fr), FEATURES).withColumn("v", vector_to_array("features"))
    return vectors.select("id", "y", *[r6(F.get("v", F.lit(i))).alias(f) for i, f in enumerate(FEATURES)])


@query(
    "model_roundtrip",
    f"""with recursive src as (select 0 as model, y, {', '.join(FEATURES)} from feat), {FIT('src', FEATURES)},
      scored as (select site, {PROBABILITY(FEATURES)} as p from feat, fit) select site, count(*) as n, count(*) as agree, round(avg(p), 3) as p from scored group by site""",
    "feat",
)
def model_roundtrip(fr):
    """Pooled model saved, loaded and applied: mean probability per site under the loaded model, and how many rows the fitted one gives the same."""
    rows = complete(fr)
    model = fit_pooled_logistic(rows, "y", FEATURES)
    again = tables.load_model(tables.save_model(model, fr.spark))
    both = predict(model, rows, "p_fitted").join(predict(again, rows, "p_loaded").select("id", "p_loaded"), "id")
    agree = F.count_if(F.col("p_fitted") == F.col("p_loaded"))
    return both.groupBy("site").agg(F.count(F.lit(1)).alias("n"), agree.alias("agree"), F.round(F.avg("p_loaded"), 3).alias("p"))
