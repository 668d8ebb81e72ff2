"""Trained models: pooled, per site, by fold, left-out sites, transfers and learning curves."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sitewise.functions.scalar import neglog_complement
from sitewise.operators import linear, models, nested, pooled, resample, summary
from sitewise.operators.boosting import Boosting, boosted, boosted_folds, fold_sets
from sitewise.operators.joins import group_join, member_rows, other_rows, paired_delta
from sitewise.operators.matrix import family_matrix, score_matrix
from sitewise.operators.metrics import evaluate
from sitewise.operators.nested import UPTO, WITHOUT, TrainingSets
from sitewise.plans.offset_source import severity_rows
from sitewise.queries.registry import query
from sitewise.queries.sinks import complete
from sitewise.queries.resampling import place_sql
from sitewise.queries.sites import FEATURES, direct_metrics, rounded
from sitewise.queries.sqltext import FIT, METRICS, PROBABILITY, UNIFORM, rounded_metrics
from sitewise.session import durable, side_by_side
from sitewise.sources import tables

INVERSE_PENALTIES = [10.0 ** (-4 + 8 * i / 9) for i in range(10)]
#: Sizes of the experiments: replicates of site and patient additions and of the spread curves, stays that join at a time,
#: rows of a curve's test set (half of a site with fewer than twice as many).
ORDERS, SPREADS, PATIENTS, LOCAL, TESTED = 100, 50, 500, 100, 500
#: A thousand trees of depth 9, as the experiments have them.
TREES = Boosting()
#: Sites held out of the site additions; sites of the spread curves.
HELD_OUT, SPREAD_SITES = (7, 2, 11), (7, 2, 11, 18)


#: Digits that results of iterative fits keep.
DIGITS = 4
INPUTS = ", ".join(FEATURES)
WEIGHTS = ", ".join(f"round(b{i}, {DIGITS}) + 0 as {w}" for i, w in enumerate(("intercept", *(f"w_{f}" for f in FEATURES))))


def kept_digits(df: DataFrame, *keep: str) -> DataFrame:
    """All columns but those to keep to ``DIGITS`` digits, without a negative zero."""
    return df.select(*[F.col(c) if c in keep else (F.round(F.col(c).cast("double"), DIGITS) + 0.0).alias(c) for c in df.columns])


def kept_metrics(df: DataFrame, *by: str) -> DataFrame:
    return kept_digits(df, *by, "count", "outcome")


def weights(fitted: DataFrame, *by: str) -> DataFrame:
    """Model table with one column per coefficient."""
    own = [F.get("coef", F.lit(i)).alias(f"w_{f}") for i, f in enumerate(FEATURES)]
    return kept_digits(fitted.select(*by, "n_rows", "n_pos", "intercept", *own), *by, "n_rows", "n_pos")


def SCORED(rows: str, on: str, columns: str, fit: str = "fit", features: list[str] = FEATURES, name: str = "scored", p: str = "p") -> str:
    """CTE with the probability of rows under the model whose number is ``on``."""
    return f"{name} as (select {columns}, {PROBABILITY(features)} as {p} from {rows} join {fit} on model = {on})"


def EVALUATED(by: str, source: str = "scored") -> str:
    return f"{METRICS(source, by, 'y', 'p')} select {by}, {rounded_metrics(DIGITS)} from metrics"


def FOLDED(k: int, by: str, seed: int, source: str = "feat") -> str:
    return f"folded as (select * exclude (position), ((position - 1) % {k})::int as fold from ({place_sql(source, by, 'id', seed)}))"


LEFT_OUT = f"src as (select m.site as model, r.y, {INPUTS} from feat r, (select distinct site from feat) m where r.site <> m.site), {FIT('src', FEATURES)}"
OUT_OF_FOLD = f"src as (select h as model, y, {INPUTS} from folded, range(5) r(h) where fold <> h), {FIT('src', FEATURES)}"
PENALTY_VALUES = ", ".join(f"({i}, {c!r}::double)" for i, c in enumerate(INVERSE_PENALTIES))
PENALTIES = f"""{FOLDED(3, 'y', 17)}, grid_c as (select * from (values {PENALTY_VALUES}) t(c_index, c)),
  tried as (select c_index * 3 + h as model, y, {INPUTS} from folded, grid_c, range(3) r(h) where fold <> h),
  {FIT('tried', FEATURES, 'tried_fit', c="(select c from grid_c where c_index = model // 3)")},
  right_ as (select c_index, fold, avg(((p > 0.5)::int = y)::int) as accuracy from (
    select c_index, fold, y, {PROBABILITY(FEATURES)} as p from folded, grid_c join tried_fit on model = c_index * 3 + fold) group by 1, 2),
  means as (select c_index, round(avg(accuracy), 12) as accuracy from right_ group by 1),
  penalties as (select c_index, accuracy, c, (c_index = first_value(c_index) over (order by accuracy desc, c_index))::int as best from means join grid_c using (c_index)),
  chosen as (select c from penalties where best = 1)"""
CHOSEN = "(select c from chosen)"


def feat(fr) -> DataFrame:
    """Model inputs, written once: the fits below read them several times."""
    return durable(fr.feat.select("id", "site", "y", "admit", *FEATURES), "feat")


def one_model(rows: DataFrame) -> DataFrame:
    """Model table with the single model of all rows."""
    return models.fit_logistic(rows.withColumn("model", F.lit(0)), "model", "y", FEATURES)


@query(
    "pooled_logistic",
    f"""with recursive src as (select 0 as model, y, {INPUTS} from feat), {FIT('src', FEATURES)}
      select unnest(['x1', 'x2', 'x3', 'x4']) as feature, round(unnest([b1, b2, b3, b4]), 3) + 0 as weight from fit""",
    "feat",
)
def pooled_logistic(fr):
    """One L2 logistic model of all rows, fitted by Spark's estimator; weights per feature."""
    rows = durable(complete(fr), "complete")
    found = pooled.coefficients(rows, pooled.fit_pooled_logistic(rows, "y", FEATURES), FEATURES)
    return found.withColumn("weight", F.round("weight", 3) + 0.0)


@query("boosted_trees")
def boosted_trees(fr):
    """Boosted trees of four folds, missing values and all; metrics per site on the fifth, which they have not seen."""
    rows = resample.folds(feat(fr), ["id"], 71017).withColumn("model", F.lit(0)).withColumn("train", F.col("fold") != 0)
    return evaluate(boosted(rows, "model", ["id"], "y", FEATURES, "train", TREES).filter("not train"), ["site"])


@query("site_trees")
def site_trees(fr):
    """Boosted trees of each site alone, measured on its own rows as the retrained models are."""
    rows = feat(fr).withColumn("train", F.lit(True))
    return evaluate(boosted(rows, "site", ["id"], "y", FEATURES, "train", TREES), ["site"])


def penalty_search(rows: DataFrame, k: int = 3) -> DataFrame:
    """Accuracy of ten penalties in stratified folds (c_index, c, accuracy, best); every (penalty, fold) is one set of a joint fit."""
    folded = durable(resample.folds(rows, ["id"], 17, k, by=["y"]), "folded")
    sets = [(0, WITHOUT, fold) for _ in INVERSE_PENALTIES for fold in range(k)]
    fitted = nested.fit_sets(folded, "y", FEATURES, F.array("fold"), TrainingSets.of(sets), c=np.repeat(INVERSE_PENALTIES, k))
    asked = folded.withColumn("c_index", F.explode(F.sequence(F.lit(0), F.lit(len(INVERSE_PENALTIES) - 1))))
    scored = models.score(asked.withColumn("model", F.col("c_index") * k + F.col("fold")), fitted, "model", FEATURES)
    right = F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("int"))
    # equal accuracies must stay equal whatever the order of their sums
    means = scored.groupBy("c_index", "fold").agg(right.alias("accuracy")).groupBy("c_index").agg(F.round(F.avg("accuracy"), 12).alias("accuracy"))
    table = durable(means.withColumn("c", F.get(F.array(*map(F.lit, INVERSE_PENALTIES)), F.col("c_index"))), "penalties")
    best = table.orderBy(F.col("accuracy").desc(), "c_index").limit(1).select(F.col("c_index").alias("b"))
    return table.withColumn("best", (F.col("c_index") == best.scalar()).cast("int"))


def chosen_penalty(rows: DataFrame) -> float:
    return penalty_search(rows).filter("best = 1").first()["c"]


@query("logistic_cv", f"with recursive {PENALTIES} select c_index, c, round(accuracy, 6) as accuracy, best from penalties", "feat")
def logistic_cv(fr):
    """Accuracy of ten penalties in three stratified folds."""
    return penalty_search(feat(fr)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "logistic_cv_refit",
    f"with recursive {PENALTIES}, src as (select 0 as model, y, {INPUTS} from feat), {FIT('src', FEATURES, c=CHOSEN)} select model, n_rows, n_pos, {WEIGHTS}, {CHOSEN} as c from fit",
    "feat",
)
def logistic_cv_refit(fr):
    """Model of all rows at the penalty that the search chose."""
    rows = feat(fr)
    c = chosen_penalty(rows)
    fitted = models.fit_logistic(rows.withColumn("model", F.lit(0)), "model", "y", FEATURES, c=c)
    return weights(fitted, "model").withColumn("c", F.lit(c))


@query("site_models", f"with recursive {FIT('feat', FEATURES, by='site')} select site, n_rows, n_pos, {WEIGHTS} from fit", "feat")
def site_models(fr):
    """One model per site from one joint fit."""
    return weights(models.fit_logistic(feat(fr), "site", "y", FEATURES), "site")


@query(
    "site_retrain",
    f"""with recursive {PENALTIES}, src as (select site as model, y, {INPUTS} from feat), {FIT('src', FEATURES, c=CHOSEN)},
      {SCORED('feat', 'site', 'site, y')}, {EVALUATED('site')}""",
    "feat",
)
def site_retrain(fr):
    """Metrics per site of the site's own model, at the penalty chosen over all rows and on its own rows; one class, no probability."""
    rows = feat(fr)
    fitted = models.fit_logistic(rows, "site", "y", FEATURES, c=chosen_penalty(rows))
    return kept_metrics(evaluate(models.score(rows, fitted, "site", FEATURES), ["site"]), "site")


@query(
    "site_cv",
    f"""with recursive {FOLDED(5, 'site', 345)}, src as (select site * 5 + h as model, y, {INPUTS} from folded, range(5) r(h) where fold <> h), {FIT('src', FEATURES)},
      {SCORED('folded', 'site * 5 + fold', 'site, fold, y')}, {EVALUATED('site, fold')}""",
    "feat",
)
def site_cv(fr):
    """Five-fold AUROC within each site; every (site, fold) is one training set."""
    rows = durable(resample.folds(feat(fr), ["id"], 345, 5, by=["site"]), "folded")
    cells = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("model", F.col("site") * 5 + F.col("held"))
    fitted = models.fit_logistic(cells.filter("held <> fold"), "model", "y", FEATURES)
    scored = models.score(cells.filter("held = fold"), fitted, "model", FEATURES)
    return kept_metrics(evaluate(scored, ["site", "fold"]), "site", "fold")


def out_of_fold(rows: DataFrame, features: list[str], k: int = 5, written: bool = False) -> DataFrame:
    """Rows (.., fold) with their probability under the model of the other folds; they are written first, unless they are ``written``."""
    rows = rows if written else durable(rows, "folded")
    fitted = nested.fit_sets(rows, "y", features, F.array("fold"), TrainingSets.of([(0, WITHOUT, fold) for fold in range(k)]))
    return models.score(rows, fitted.withColumnRenamed("model", "fold"), "fold", features)


@query("cv_metrics", f"with recursive {FOLDED(5, '', 71017)}, {OUT_OF_FOLD}, {SCORED('folded', 'fold', 'fold, y')}, {EVALUATED('fold')}", "feat")
def cv_metrics(fr):
    """Out-of-fold predictions of all rows; AUROC and ratio per fold."""
    return kept_metrics(evaluate(out_of_fold(resample.folds(feat(fr), ["id"], 71017), FEATURES), ["fold"]), "fold")


@query("cv_summary_models")
def cv_summary_models(fr):
    """Logistic model and boosted trees over the same five folds: means of the fold metrics, written as CSV and read back."""
    rows = durable(resample.folds(feat(fr), ["id"], 71017).select("id", "y", "fold", *FEATURES), "folded")
    grown = lambda: boosted_folds(*fold_sets(rows, "fold", 5, ["id"], "y", FEATURES), TREES)
    trees, logistic = side_by_side(fr.spark, grown, lambda: out_of_fold(rows, FEATURES, written=True))
    scored = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("model"), "fold", "y", "p") for name, df in (("l2", logistic), ("trees", trees))])
    path = tables.write_cv_summary(evaluate(scored, ["model", "fold"]).select("model", "auc", "smr"))
    return tables.read_matrix(fr.spark, path, "model string, auc double, smr double")


@query(
    "stratified_cv",
    f"""with recursive {FOLDED(5, 'y', 5)}, {OUT_OF_FOLD}, {SCORED('folded', 'fold', 'fold, y')}, {METRICS('scored', 'fold', 'y', 'p')}
      select round(avg(auc), {DIGITS}) as auc, round(avg(smr), {DIGITS}) as smr from metrics""",
    "feat",
)
def stratified_cv(fr):
    """Mean AUROC and ratio of five folds with equal outcome rates."""
    scored = out_of_fold(resample.folds(feat(fr), ["id"], 5, by=["y"]), FEATURES)
    return kept_digits(evaluate(scored, ["fold"]).agg(F.avg("auc").alias("auc"), F.avg("smr").alias("smr")))


@query(
    "severity_cv",
    f"""with recursive severe as (select f.id, f.y, acutephysiologyscore::double as apsiii from feat f
        left join (select * from apache where apacheversion = 'IVa') on patientunitstayid = f.id), {FOLDED(5, '', 71017, 'severe')},
      src as (select h as model, y, apsiii from folded, range(5) r(h) where fold <> h), {FIT('src', ['apsiii'])},
      {SCORED('folded', 'fold', 'fold, y', features=['apsiii'])}, {EVALUATED('fold')}""",
    "feat apache",
)
def severity_cv(fr):
    """Out-of-fold metrics of a model whose only input is the severity score."""
    scores = severity_rows(fr.apache).select(F.col("patientunitstayid").alias("id"), F.col("acutephysiologyscore").alias("apsiii"))
    rows = fr.feat.select("id", "y").join(scores, "id", "left")
    return kept_metrics(evaluate(out_of_fold(resample.folds(rows, ["id"], 71017), ["apsiii"]), ["fold"]), "fold")


@query(
    "perf_matrix_fixed_size",
    f"""with recursive train as (select * from ({place_sql('feat', 'site', 'id', 18201)}) where position <= 500),
      test as (select * from ({place_sql('feat', 'site', 'id', 18202)}) where position <= 500),
      src as (select site as model, y, {INPUTS} from train), {FIT('src', FEATURES)},
      scored as (select model as train_site, site as test_site, y, {PROBABILITY(FEATURES)} as p from (
          select * from test, fit where site <> model union all select * from train, fit where site = model)), {EVALUATED('train_site, test_site')}""",
    "feat",
)
def perf_matrix_fixed_size(fr):
    """Site models from 500 stays each, tested on 500 other draws per site; the diagonal uses the training draw."""
    rows = feat(fr)
    train = durable(resample.sample_per_group(rows, ["site"], ["id"], 500, 18201), "train")
    test = resample.sample_per_group(rows, ["site"], ["id"], 500, 18202)
    fitted = durable(models.fit_logistic(train, "site", "y", FEATURES), "fitted")
    off = score_matrix(test.withColumnRenamed("site", "test_site"), fitted, FEATURES).filter("train_site <> test_site")
    scored = models.score(train, fitted, "site", FEATURES).select(F.col("site").alias("train_site"), F.col("site").alias("test_site"), "y", "p")
    return kept_metrics(off.unionByName(evaluate(scored, ["train_site", "test_site"])), "train_site", "test_site")


@query("loso_metrics", f"with recursive {LEFT_OUT}, {SCORED('feat', 'site', 'site, y')}, {EVALUATED('site')}", "feat")
def loso_metrics(fr):
    """Each site under a model of all other sites."""
    rows = feat(fr)
    return kept_metrics(evaluate(models.score(rows, left_out_models(rows), "site", FEATURES), ["site"]), "site")


def left_out_models(rows: DataFrame) -> DataFrame:
    """One model per site, trained on the rows of all other sites; ``site`` is the site left out.

    The sites are numbered on the driver, as their models are; no row is read for more than one pass per step.
    """
    sites = sorted((r["site"] for r in rows.select("site").distinct().collect()), key=lambda s: (s is not None, s))
    missing = min((s for s in sites if s is not None), default=0) - 1  # no site's own number
    code = F.coalesce(F.col("site").cast("int"), F.lit(missing))
    sets = TrainingSets.of([(0, WITHOUT, missing if s is None else s) for s in sites])
    fitted = nested.fit_sets(rows, "y", FEATURES, F.array(code), sets)
    names = rows.sparkSession.createDataFrame(list(enumerate(sites)), "model int, site int")
    return names.join(fitted, "model").drop("model")


@query(
    "largest_site_transfer",
    f"""with recursive big as (select site from feat group by site order by count(*) desc, site limit 1),
      src as (select 0 as model, y, {INPUTS} from feat union all select 1, y, {INPUTS} from feat where site = (select site from big)), {FIT('src', FEATURES)},
      {SCORED('feat', '0', 'site, y', name='pooled')}, {SCORED('feat', '1', 'site, y', name='moved')},
      {METRICS('pooled', 'site', 'y', 'p', 'before')}, {METRICS('moved', 'site', 'y', 'p', 'after')}
      select b.site, round(b.auc, {DIGITS}) as auc, round(b.smr, {DIGITS}) as smr, round(a.auc, {DIGITS}) as auc_largest, round(a.smr, {DIGITS}) as smr_largest,
        round(a.auc - b.auc, {DIGITS}) + 0 as auc_diff, round(a.smr - b.smr, {DIGITS}) + 0 as smr_diff
      from before b join after a using (site) where b.site <> (select site from big)""",
    "feat",
)
def largest_site_transfer(fr):
    """Model of the largest site applied to all others, next to the change against the pooled model."""
    rows = feat(fr)
    big = durable(summary.largest_site(rows, "site"), "largest")
    base = evaluate(models.score_one(rows, one_model(rows), FEATURES), ["site"])
    moved = evaluate(models.score_one(rows, one_model(member_rows(rows, big, ["site"])), FEATURES), ["site"])
    return kept_digits(other_rows(paired_delta(base, moved, "site", ["auc", "smr"], "_largest"), big, ["site"]), "site")


@query(
    "single_source_transfer",
    f"""with recursive src as (select site as model, y, {INPUTS} from feat where site <> 7), {FIT('src', FEATURES)},
      scored as (select model as train_site, y, {PROBABILITY(FEATURES)} as p from feat, fit where site = 7), {METRICS('scored', 'train_site', 'y', 'p')}
      select train_site, {rounded_metrics(DIGITS)}, n_rows as n_train from metrics join fit on model = train_site""",
    "feat",
)
def single_source_transfer(fr):
    """Models of each other site tested on one site, with the size of their training set."""
    rows = feat(fr)
    target = 7
    fitted = durable(models.fit_logistic(rows.filter(~F.col("site").eqNullSafe(target)), "site", "y", FEATURES), "fitted")
    pairs = fitted.select(F.col("site").alias("train_site"), F.lit(target).alias("test_site"))
    tests = rows.filter(F.col("site") == target).withColumnRenamed("site", "test_site")
    scored = models.score_pairs(tests, pairs, fitted, FEATURES)
    sizes = fitted.select(F.col("site").alias("train_site"), F.col("n_rows").alias("n_train"))
    found = group_join(evaluate(scored, ["train_site"]), durable(sizes, "sizes"), ["train_site"], spread=["auc"])
    return kept_metrics(found, "train_site", "n_train")


@query(
    "era_transfer",
    f"""with recursive src as (select 0 as model, y, {INPUTS} from feat where year(admit) < 1996), {FIT('src', FEATURES)},
      late as (select 0 as g, * from feat where year(admit) >= 1996), {SCORED('late', '0', 'g, y')}, {METRICS('scored', 'g', 'y', 'p')}
      select {rounded_metrics(DIGITS)} from metrics""",
    "feat",
)
def era_transfer(fr):
    """Model of the earlier years tested on the later ones."""
    rows = feat(fr).withColumn("era", (F.year("admit") >= 1996).cast("int"))
    model = one_model(rows.filter("era = 0"))
    return kept_metrics(evaluate(models.score_one(rows.filter("era = 1"), model, FEATURES)))


@query(
    "source_transfer",
    f"""with recursive sites as (select distinct site as id from feat),
      split as (select id as site from ({place_sql('sites', '', 'id', 3231)}) where position <= floor((select count(*) from sites) / 2)),
      src as (select 0 as model, y, {INPUTS} from feat where site in (select site from split)), {FIT('src', FEATURES)},
      rest as (select * from feat where site not in (select site from split)), {SCORED('rest', '0', 'site, y')}, {EVALUATED('site')}""",
    "feat",
)
def source_transfer(fr):
    """Model of the development sites tested on every other site."""
    rows = feat(fr)
    split = durable(resample.split_sites(rows, "site", 3231), "split")
    train, test = resample.development_rows(rows, split, "site")
    return kept_metrics(evaluate(models.score_one(test, one_model(train), FEATURES), ["site"]), "site")


@query(
    "recalibrate",
    f"""with recursive {LEFT_OUT}, {SCORED('feat', 'site', 'id, site, y', name='moved')}, halves as (select *, -ln(1 - p) as x from moved),
      {FOLDED(2, 'site', 1292, 'halves')}, again_src as (select site as model, y, x from folded where fold = 0), {FIT('again_src', ['x'], 'again')},
      scored as (select site, y, p, 1 / (1 + exp(-(b0 + b1 * (x - m1) / s1))) as p_new from folded join again on model = site where fold = 1),
      {METRICS('scored', 'site', 'y', 'p', 'before')}, {METRICS('scored', 'site', 'y', 'p_new', 'after')}
      select b.site, {", ".join(f"round(b.{m}, {DIGITS}) as {m}, round(a.{m}, {DIGITS}) as {m}_recalibrated, round(a.{m} - b.{m}, {DIGITS}) + 0 as {m}_diff" for m in ("smr", "logloss", "auc"))}
      from before b join after a using (site)""",
    "feat",
)
def recalibrate(fr):
    """Model of all other sites before and after a one-feature recalibration per site, fitted on half of its rows and measured on the rest."""
    rows = feat(fr)
    base = models.score(rows, left_out_models(rows), "site", FEATURES)
    scored = durable(resample.folds(base.withColumn("x", neglog_complement("p")), ["id"], 1292, 2, by=["site"]), "scored")
    fitted = models.fit_logistic(scored.filter("fold = 0"), "site", "y", ["x"])
    again = durable(models.score(scored.filter("fold = 1"), fitted, "site", ["x"], out="p_new"), "recalibrated")
    return kept_digits(paired_delta(evaluate(again, ["site"]), evaluate(again, ["site"], p="p_new"), "site", ["smr", "logloss", "auc"], "_recalibrated"), "site")


def site_info(fr) -> tuple[DataFrame, dict[str, str]]:
    """Sites with enough rows and their features under plain names, with what the names stand for."""
    info = summary.drop_reference_dummies(fr.siteinfo, "numbedscategory", "region")
    info = info.withColumn("teachingstatus", (F.col("teachingstatus") == "t").cast("int")).filter("n >= 500")
    severity = severity_rows(fr.apache).select("patientunitstayid", F.col("apachescore").cast("double").alias("score"))
    means = fr.patient.join(severity, "patientunitstayid").groupBy(F.col("hospitalid").alias("site")).agg(F.avg("score").alias("mean_severity"))
    info = info.join(means, "site", "left")
    named = info.toDF(*[f"c{i}" if c != "site" else c for i, c in enumerate(info.columns)])
    return named, {n: c for n, c in zip(named.columns, info.columns, strict=True) if c != "site"}


@query("site_meta_regression")
def site_meta_regression(fr):
    """Can site features predict how well a model does on a site: weights and r2 of linear fits.

    Measured are the model of all other sites and the severity score's own probability, each by AUROC and by the ratio of outcomes; inputs are all site
    features but size and outcome rate, the outcome rate alone, and the mean severity alone.
    """
    rows = feat(fr)
    targets = ["auc", "smr"]
    by_model = evaluate(models.score(rows, left_out_models(rows), "site", FEATURES), ["site"]).select("site", *[F.col(t).alias(f"{t}_model") for t in targets])
    by_score = direct_metrics(fr).select("site", *[F.col(t).alias(f"{t}_severity") for t in targets])
    named, names = site_info(fr)
    table = durable(named.join(by_model, "site", "left").join(by_score, "site", "left"), "siteinfo")
    code = {c: n for n, c in names.items()}
    measured = [f"{t}_{of}" for of in ("model", "severity") for t in targets]
    sets = {
        "all": [n for n, c in names.items() if c not in ("n", "rate", "mean_severity")], "all and severity": [n for n, c in names.items() if c not in ("n", "rate")],
        "rate": [code["rate"]], "severity": [code["mean_severity"]],
    }
    fits = linear.least_squares(table, measured, sets)
    label = F.element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), F.col("feature"))
    return fits.select(F.split("target", "_")[1].alias("measured"), F.split("target", "_")[0].alias("target"), "inputs", label.alias("feature"), "weight", "r2", "n")


@query(
    "site_rate_regression",
    f"""with {METRICS('pred', 'site', 'y', 'p')}, {METRICS('pred', 'site', 'y', 'p2', 'again')},
      table_ as (select i.rate, i.mean_price, m.auc, m.smr, g.auc as auc2, g.smr as smr2 from siteinfo i join metrics m using (site) join again g using (site)),
      long as (unpivot (unpivot (select rate, mean_price, auc, smr, auc2, smr2 from table_) on rate, mean_price into name feature value x)
        on auc, smr, auc2, smr2 into name target value v)
      select target, feature, feature as inputs, round(regr_slope(v, x) * stddev_pop(x), 6) as weight, round(regr_r2(v, x), 6) as r2, count(*) as n
      from long where v is not null group by target, feature""",
    "pred siteinfo",
)
def site_rate_regression(fr):
    """Each measure of two scores of the sites against one site feature at a time."""
    first = evaluate(fr.pred, ["site"], "y", "p").select("site", "auc", "smr")
    second = evaluate(fr.pred, ["site"], "y", "p2").select("site", F.col("auc").alias("auc2"), F.col("smr").alias("smr2"))
    table = durable(fr.siteinfo.join(first, "site").join(second, "site"), "siteinfo")
    fits = linear.least_squares(table, ["auc", "smr", "auc2", "smr2"], {f: [f] for f in ("rate", "mean_price")})
    return rounded(fits, "target", "feature", "inputs", "n")


# --- curves: nested training sets


def curve_scores(rows: DataFrame, tests: DataFrame, families: int, steps: int, features: list[str] = FEATURES) -> DataFrame:
    """Metrics (family, n) of nested training sets n = 1..steps of each family on that family's test rows.

    ``rows.codes`` has the step at which a row joins each family (0: never); ``tests.family`` names the family that a test row is for.
    """
    # arrays of their own: there may be millions of sets
    count, number = families * steps, np.arange(1, steps + 1, dtype=np.int32)
    sets = TrainingSets(np.repeat(np.arange(families, dtype=np.int32), steps), np.full(count, UPTO, np.int8), np.tile(number, families))
    return family_matrix(tests, nested.fit_sets(rows, "y", features, F.col("codes"), sets), steps, features)


def steps_by(df: DataFrame, key: str, families: int) -> DataFrame:
    """(key, codes) from rows (key, family, first_step); 0 for families a key is not in.  ``families`` entries per key."""
    pairs = F.map_from_entries(F.collect_list(F.struct("family", "first_step"))).alias("m")
    codes = F.transform(F.sequence(F.lit(0), F.lit(families - 1)), lambda f: F.coalesce(F.element_at("m", f), F.lit(0)).cast("int"))
    return df.select(key, F.col("family").cast("int").alias("family"), F.col("first_step").cast("int").alias("first_step")).groupBy(key).agg(pairs).select(key, codes.alias("codes"))


@query(
    "site_addition_curve",
    f"""with recursive sample as (select * from ({place_sql('feat', 'site', 'id', 18201)}) where position <= 500),
      others as (select distinct site as id from sample where site <> {HELD_OUT[0]}),
      joined as (select id as site, row_number() over (order by {UNIFORM("id || '|' || 1", 18201)}, id) as step from others),
      src as (select n::int as model, y, {INPUTS} from sample join joined using (site), (select step as n from joined) where step <= n), {FIT('src', FEATURES)},
      scored as (select model as n, y, {PROBABILITY(FEATURES)} as p from sample, fit where site = {HELD_OUT[0]}), {METRICS('scored', 'n', 'y', 'p')}
      select n, {rounded_metrics(DIGITS)}, 1 as b from metrics""",
    "feat",
)
def site_addition_curve(fr):
    """Sites join the training set one by one; tested on a held-out site."""
    return kept_metrics(_site_additions(fr, HELD_OUT[:1], 1).drop("held_out"), "n", "b")


@query("site_addition_replicates")
def site_addition_replicates(fr):
    """The same in a hundred random orders for each of three held-out sites: mean and interval of AUROC at each step."""
    return summary.curve(_site_additions(fr, HELD_OUT, ORDERS).withColumnRenamed("n", "sites"), ["held_out", "sites"], "auc")


def _site_additions(fr, held_out: tuple[int, ...], b: int) -> DataFrame:
    sample = durable(resample.sample_per_group(feat(fr), ["site"], ["id"], 500, 18201), "sample")
    orders = [
        resample.site_order(sample, "site", h, b, 18201).select("site", (F.col("b") - 1 + i * b).alias("family"), F.col("n").alias("first_step"))
        for i, h in enumerate(held_out)
    ]
    families = len(held_out) * b
    by_site = durable(steps_by(reduce(DataFrame.unionByName, orders), "site", families), "site-steps")
    steps = sample.select("site").distinct().count() - 1
    which = F.array_position(F.array(*map(F.lit, held_out)), F.col("site")) - 1
    tests = sample.filter(F.col("site").isin(*held_out)).withColumn("h", which).withColumn("family", F.explode(F.sequence(F.col("h") * b, (F.col("h") + 1) * b - 1)))
    scores = curve_scores(group_join(sample, by_site, ["site"], spread=["id"]), tests, families, steps)
    named = scores.withColumn("b", (F.col("family") % b + 1).cast("int")).withColumn("held_out", F.get(F.array(*map(F.lit, held_out)), F.floor(F.col("family") / b).cast("int")))
    return named.drop("family")


@query("patient_addition_replicates")
def patient_addition_replicates(fr):
    """Stays of other sites join in blocks of 500, in a hundred random orders; tested on a held-out site."""
    held_out = HELD_OUT[0]
    rows = feat(fr)
    source = rows.filter(~F.col("site").eqNullSafe(held_out))
    steps = max((source.count() - 1) // PATIENTS, 1)  # sets smaller than the whole
    placed = resample.prefix_order(source.select("id"), "id", ORDERS, 9)
    joined = placed.select("id", (F.col("b") - 1).alias("family"), resample.first_step("position", PATIENTS).alias("first_step"))
    train = source.join(steps_by(joined, "id", ORDERS), "id")
    tests = resample.replicate(rows.filter(F.col("site") == held_out), ORDERS).withColumn("family", F.col("b") - 1)
    return summary.curve(curve_scores(train, tests, ORDERS, steps).withColumnRenamed("n", "blocks"), ["blocks"], "auc")


def tested_rows(total: int) -> int:
    return min(TESTED, total // 2)


@query(
    "local_learning_curve",
    f"""with recursive mine as (select * from feat where site = {HELD_OUT[0]}),
      placed as (select *, row_number() over (order by {UNIFORM("id || '|' || 1", 1292)}, id) as position, count(*) over () as total from mine),
      cut as (select *, total - least({TESTED}, total // 2) as last from placed),
      steps as (select greatest((max(last) - 1) // {LOCAL}, 1) as steps from cut),
      src as (select n::int as model, y, {INPUTS} from cut, (select unnest(range(1, steps + 1)) as n from steps) where position <= last and ceil(position / {LOCAL}.0) <= n
        union all select 0, y, {INPUTS} from feat where site <> {HELD_OUT[0]}), {FIT('src', FEATURES)},
      scored as (select model, y, {PROBABILITY(FEATURES)} as p from cut, fit where position > last), {METRICS('scored', 'model', 'y', 'p')}
      select model as n, {rounded_metrics(DIGITS)}, 'local' as trained_on, 1 as b from metrics where model > 0
      union all select unnest([1, steps::int]), {rounded_metrics(DIGITS)}, 'other sites', 1 from metrics, steps where model = 0""",
    "feat",
)
def local_learning_curve(fr):
    """Growing local training sets of one site against the model of all other sites, same test rows."""
    target = HELD_OUT[0]
    rows = feat(fr)
    placed = durable(resample.prefix_order(rows.filter(F.col("site") == target), "id", 1, 1292), "placed")
    total = placed.count()
    last = total - tested_rows(total)
    steps = max((last - 1) // LOCAL, 1)
    train = placed.filter(F.col("position") <= last).withColumn("codes", F.array(resample.first_step("position", LOCAL)))
    tests = placed.filter(F.col("position") > last).withColumn("family", F.lit(0))
    local = curve_scores(train, tests, 1, steps).withColumn("trained_on", F.lit("local"))
    others = one_model(rows.filter(~F.col("site").eqNullSafe(target)))
    moved = evaluate(models.score_one(tests, others, FEATURES), ["family"])
    ends = moved.withColumn("n", F.explode(F.array(F.lit(1), F.lit(steps)))).withColumn("trained_on", F.lit("other sites"))
    both = local.unionByName(ends.select(*local.columns)).withColumn("b", F.lit(1)).drop("family")
    return kept_metrics(both, "n", "b", "trained_on")


@query("spread_learning_curve")
def spread_learning_curve(fr):
    """Local, transferred and recalibrated models of four sites with outcomes spread over the order, in fifty orders each."""
    b = SPREADS
    rows = feat(fr)
    mine = rows.filter(F.col("site").isin(*SPREAD_SITES))
    base = left_out_models(rows)
    scored = durable(models.score(mine, base, "site", FEATURES).withColumn("x", neglog_complement("p")), "spread")
    sizes = {r["site"]: r["n"] for r in mine.groupBy("site").agg(F.count("*").alias("n")).collect()}
    sites = [s for s in SPREAD_SITES if s in sizes]
    lasts = {s: sizes[s] - tested_rows(sizes[s]) for s in sites}
    steps = max(max((last - 1) // LOCAL, 1) for last in lasts.values())
    by_site = lambda values: F.element_at(F.create_map(*[F.lit(v) for s in sites for v in (s, values[s])]), F.col("site"))
    family = by_site({s: i * b for i, s in enumerate(sites)}) + F.col("b") - 1
    replicated = resample.replicate(scored.select("id", "site", "y"), b)
    placed = durable(resample.spread_order(replicated, ["site", "b"], ["id", "b"], "y", 1292).withColumn("family", family).withColumn("last", by_site(lasts)), "placed")
    joins = placed.filter("place < last").select("id", "family", F.ceil((F.col("place") + 1) / LOCAL).alias("first_step"))
    families = len(sites) * b
    train = durable(scored.drop("p").join(steps_by(joins, "id", families), "id"), "spread-train")
    tests = durable(placed.filter("place >= last").select("id", "family").join(scored, "id"), "spread-tests")
    own = curve_scores(train, tests.drop("p"), families, steps).withColumn("trained_on", F.lit("local"))
    again = curve_scores(train, tests.drop("p"), families, steps, ["x"]).withColumn("trained_on", F.lit("recalibrated"))
    given = evaluate(tests, ["family"]).withColumn("n", F.explode(F.array(F.lit(1), F.lit(steps)))).withColumn("trained_on", F.lit("transferred"))
    every = own.unionByName(again).unionByName(given.select(*own.columns))
    site = F.get(F.array(*map(F.lit, sites)), F.floor(F.col("family") / b).cast("int"))
    means = [F.avg(c).alias(c) for c in ("auc", "smr")]
    return every.withColumn("site", site).groupBy("site", "n", "trained_on").agg(F.count("auc").alias("replicates"), *means)
