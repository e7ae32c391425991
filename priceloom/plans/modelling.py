"""Splits, models, feature selection and principal components over the listings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from priceloom.operators.metrics import evaluate
from priceloom.operators.pca import (
    component_regression,
    components_needed,
    explained_variance,
    fit_pca,
    loading_sentences,
    loadings_table,
    pca_projection,
    pca_scores,
)
from priceloom.operators.selection import best_k, feature_selection_path, selection_gains, threshold_step
from priceloom.operators.split import in_test
from priceloom.operators.training import (
    feature_influence,
    fit_model,
    holdout_predictions,
    holdout_quality,
    parameter_sweep,
    ridge_folds,
    score,
    train_model,
)
from priceloom.plans.cleaning import raw_csv, scratch
from priceloom.plans.linear_sql import moments_cte, pca_ctes, scores_sql, selection_ctes, solve_ctes
from priceloom.plans.linear_sql import test_r2 as r2_sql
from priceloom.plans.listing import listings, with_listings
from priceloom.plans.registry import q, query, rounded
from priceloom.plans.statistics import IS_TEST_SQL
from priceloom.plans.workflows import train_all
from priceloom.schema import (
    DISCOUNT_FEATURES,
    DISCOUNT_TARGET,
    LOADING_LABELS,
    NUMERIC,
    PRICE_FEATURES,
    PRICE_TARGET,
    SCENARIOS,
    TASKS,
)
from priceloom.sources.models import load_model, save_model
from priceloom.sources.vectors import read_vectors

_SIDES = f"""train as (select * from listings where not {IS_TEST_SQL}),
test as (select * from listings where {IS_TEST_SQL})"""


def _line_ctes(task, source="train", penalty="0", name="line"):
    features, target = TASKS[task]
    return (f"{_SIDES},\n{moments_cte('train_m', source, features, target)},\n"
            f"{solve_ctes(name, 'train_m', list(range(len(features))), penalty)}")


def _predicted(task):
    return " + ".join(f"w{i} * {c}" for i, c in enumerate(TASKS[task][0])) + " + w"


@query("e1_split", with_listings(f"select product_id, {IS_TEST_SQL} as is_test from listings"))
def e1_split(spark, folder):
    return listings(spark, folder).select("product_id", in_test(F.col("product_id")).alias("is_test"))


def _coefficients_sql(task, penalty="0", digits=4):
    rows = " union all ".join(
        f"select '{c}' as feature, 'coefficient' as kind, {q(f'w{i}', digits)} as value, w{i} > 0 as positive from line"
        for i, c in enumerate(TASKS[task][0]))
    return with_listings(rows, _line_ctes(task, penalty=penalty))


def _coefficients(spark, folder, name, task):
    model = train_model(listings(spark, folder), name, task)
    return rounded(feature_influence(model, TASKS[task][0]), 4)


@query("e3_linear_regression_price", _coefficients_sql("price"))
def e3_linear_regression_price(spark, folder):
    return _coefficients(spark, folder, "Linear Regression", "price")


@query("e11_coefficients_discount", _coefficients_sql("discount"))
def e11_coefficients_discount(spark, folder):
    return _coefficients(spark, folder, "Linear Regression", "discount")


@query("e4_ridge_regression_price", _coefficients_sql("price", "1.0 / n"))
def e4_ridge_regression_price(spark, folder):
    return _coefficients(spark, folder, "Ridge Regression", "price")


def _holdout_sql(task, digits, penalty="0"):
    y = TASKS[task][1]
    return with_listings(f"""
select product_id, {q(y, digits)} as actual, {q(_predicted(task), digits)} as prediction from test, line""",
                         _line_ctes(task, penalty=penalty))


def _holdout(spark, folder, name, task, digits):
    found = holdout_predictions(listings(spark, folder), name, task)
    return rounded(found.select("product_id", "actual", "prediction"), digits)


@query("e9_holdout_price", _holdout_sql("price", 2))
def e9_holdout_price(spark, folder):
    return _holdout(spark, folder, "Linear Regression", "price", 2)


@query("e9_holdout_discount_ridge", _holdout_sql("discount", 4, "1.0 / n"))
def e9_holdout_discount_ridge(spark, folder):
    return _holdout(spark, folder, "Ridge Regression", "discount", 4)


def _quality_sql(task, source="train"):
    y, p = TASKS[task][1], f"({_predicted(task)})"
    return with_listings(f"""
select {q(f'sqrt(avg(({y} - {p}) ^ 2))')} as rmse, {q(f'avg(abs({y} - {p}))')} as mae,
       {q(f'1 - sum(({y} - {p}) ^ 2) / (var_pop({y}) * count(*))')} as r2 from test, line""",
                         _line_ctes(task, source))


@query("e9_holdout_metrics_price", _quality_sql("price"))
def e9_holdout_metrics_price(spark, folder):
    found = holdout_predictions(listings(spark, folder), "Linear Regression", "price")
    return rounded(evaluate(found, "actual", "prediction"))


@query("e9_holdout_metrics_fit_on_all", _quality_sql("discount", "listings"))
def e9_holdout_metrics_fit_on_all(spark, folder):
    found = holdout_predictions(listings(spark, folder), "Linear Regression", "discount", fit_on="all")
    return rounded(evaluate(found, "actual", "prediction"))


@query("e9_saved_model_holdout", _quality_sql("price"))
def e9_saved_model_holdout(spark, folder):
    """A model fitted on the training side is saved, loaded, and judged on the test side."""
    df = listings(spark, folder)
    path = scratch(spark, "models")
    save_model(train_model(df, "Linear Regression", "price"), path, "line")
    return rounded(holdout_quality(load_model(path, "line"), df, "price"))


_ALPHAS = (0.01, 1.0, 100.0)


def _sweep_sql():
    features, y = TASKS["discount"]
    p = f"({_predicted('discount')})"
    lines = [solve_ctes(f"line_{i}", "train_m", list(range(len(features))), f"{alpha} / n")
             for i, alpha in enumerate(_ALPHAS)]
    rows = " union all ".join(f"""
select '{{"alpha": {alpha}}}' as parameters, {q(f'sqrt(avg(({y} - {p}) ^ 2))')} as rmse, {q(f'avg(abs({y} - {p}))')} as mae,
       {q(f'1 - sum(({y} - {p}) ^ 2) / (var_pop({y}) * count(*))')} as r2 from test, line_{i}"""
                              for i, alpha in enumerate(_ALPHAS))
    return with_listings(rows, ",\n".join([_SIDES, moments_cte("train_m", "train", features, y), *lines]))


@query("e7_parameter_sweep", _sweep_sql())
def e7_parameter_sweep(spark, folder):
    settings = [{"alpha": alpha} for alpha in _ALPHAS]
    return rounded(parameter_sweep(listings(spark, folder), "Ridge Regression", "discount", settings))


_FOLDS = 5


def _folds_sql():
    features, y = TASKS["discount"]
    fold = f"('0x' || substring(md5(product_id), 1, 8))::bigint % {_FOLDS}"
    ctes, rows = [], []
    for f in range(_FOLDS):
        ctes.append(f"rest_{f} as (select * from listings where {fold} <> {f}), fold_{f} as (select * from listings where {fold} = {f})")
        ctes.append(moments_cte(f"rest_m{f}", f"rest_{f}", features, y))
        for i, alpha in enumerate(_ALPHAS):
            ctes.append(solve_ctes(f"line_{f}_{i}", f"rest_m{f}", list(range(len(features))), f"{alpha} / n"))
            p = f"({_predicted('discount')})"
            rows.append(f"""
select {alpha}::double as alpha, {f} as fold, count(*) as rows, {q(f'sqrt(avg(({y} - {p}) ^ 2))')} as rmse,
       {q(f'1 - sum(({y} - {p}) ^ 2) / (var_pop({y}) * count(*))')} as r2 from fold_{f}, line_{f}_{i}""")
    return with_listings(" union all ".join(rows), ",\n".join(ctes))


@query("e7_ridge_folds", _folds_sql())
def e7_ridge_folds(spark, folder):
    """Five folds and three penalties from one scan; the SQL solves every fold by itself and predicts row by row."""
    return rounded(ridge_folds(listings(spark, folder), "discount", list(_ALPHAS), _FOLDS))


@query("w1_training_job", f"""
select listings, listings as vectors, rmse as price_rmse, mae as price_mae, r2 as price_r2, true as forest_r2_in_range
from ({_quality_sql("price")}), ({with_listings("select count(*) as listings from listings")})""")
def w1_training_job(spark, folder):
    """From CSV to both models, the statistics and the document vectors."""
    out = scratch(spark, "trained")
    report = train_all(spark, raw_csv(spark, folder), out)
    vectors = read_vectors(spark, f"{out}/vectors").agg(F.count("*").alias("vectors"))
    quality = [F.lit(report["price"][m]).alias(f"price_{m}") for m in ("rmse", "mae", "r2")]
    return rounded(vectors.select(F.lit(report["rows"]).cast("long").alias("listings"), "vectors", *quality,
                                  F.lit(0 < report["discount"]["r2"] <= 1).alias("forest_r2_in_range")))


@query("e8_batch_scoring", with_listings(
    f"select product_id, {q(_predicted('discount'), 4)} as prediction from listings, line",
    _line_ctes("discount", "listings")))
def e8_batch_scoring(spark, folder):
    df = listings(spark, folder)
    model = fit_model(df, "Linear Regression", DISCOUNT_FEATURES, DISCOUNT_TARGET)
    return rounded(score(model, df).select("product_id", "prediction"), 4)


_SCENARIO_ROWS = " union all ".join(
    f"select '{n}' as scenario, {a}::double as actual_price, {d}::double as discounted_price, {g}::double as rating, "
    f"{c}::double as rating_count" for n, a, d, g, c in SCENARIOS)


@query("b23_scenarios", with_listings(
    f"select scenario, {q(_predicted('discount'), 4)} as prediction from ({_SCENARIO_ROWS}), line",
    _line_ctes("discount", "listings")))
def b23_scenarios(spark, folder):
    model = fit_model(listings(spark, folder), "Linear Regression", DISCOUNT_FEATURES, DISCOUNT_TARGET)
    rows = spark.createDataFrame(
        SCENARIOS, "scenario string, actual_price double, discounted_price double, rating double, rating_count double")
    return rounded(score(model, rows).select("scenario", "prediction"), 4)


# Trees are checked by what must hold: all test rows are scored, and they beat the line on the same split.
_TREE_SQL = with_listings("select count(*) as scored, true as beats_line, true as r2_in_range from test", _SIDES)


def _against_line(spark, folder, name, task, overrides=None):
    df = listings(spark, folder)
    line = evaluate(holdout_predictions(df, "Linear Regression", task), "actual", "prediction").first()
    found = holdout_predictions(df, name, task, overrides)
    quality = evaluate(found, "actual", "prediction").select("r2")
    scored = found.agg(F.count("prediction").alias("scored"))
    return scored.crossJoin(F.broadcast(quality)).select(
        "scored", (F.col("r2") > line["r2"]).alias("beats_line"), F.col("r2").between(0, 1).alias("r2_in_range"))


@query("e2_random_forest", _TREE_SQL)
def e2_random_forest(spark, folder):
    """100 trees of unlimited depth, as the training function has them."""
    return _against_line(spark, folder, "Random Forest", "discount", {"n_estimators": 100})


@query("e5_gradient_boosting", _TREE_SQL)
def e5_gradient_boosting(spark, folder):
    return _against_line(spark, folder, "Gradient Boosting", "discount")


@query("e6_e7_named_model", _TREE_SQL)
def e6_e7_named_model(spark, folder):
    return _against_line(spark, folder, "Random Forest", "price", {"n_estimators": 50})


# The two prices make the discount, so they share the importance; tests hold the margin of these tenths.
_IMPORTANCES = {"discounted_price": (1, 0.6), "actual_price": (2, 0.4), "rating": (None, 0.0), "rating_count": (None, 0.0)}


@query("e10_e12_importances", " union all ".join(
    f"select '{c}' as feature, 'importance' as kind, {rank or 'null'}::bigint as rank, {tenths}::double as tenths"
    for c, (rank, tenths) in _IMPORTANCES.items()))
def e10_e12_importances(spark, folder):
    """Importances by feature, in tenths, and the rank of those that reach one."""
    model = train_model(listings(spark, folder), "Random Forest", "discount", {"n_estimators": 100})
    found = feature_influence(model, DISCOUNT_FEATURES)
    above = F.sum((F.col("value") >= 0.1).cast("long")).over(
        Window.partitionBy("kind").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0))
    return found.select("feature", "kind", F.when(F.col("value") >= 0.1, above).alias("rank"),
                        F.round("value", 1).alias("tenths"))


# ── Forward selection ───────────────────────────────────────────────────────

_PATH_CTES = (f"{_SIDES},\n{moments_cte('train_m', 'train', DISCOUNT_FEATURES, DISCOUNT_TARGET)},\n"
              f"{moments_cte('test_m', 'test', DISCOUNT_FEATURES, DISCOUNT_TARGET)},\n"
              f"{selection_ctes(DISCOUNT_FEATURES)}")


@query("e13_forward_selection", with_listings(f"select step, feature_added, {q('r2', 9)} as r2 from path", _PATH_CTES))
def e13_forward_selection(spark, folder):
    return rounded(feature_selection_path(listings(spark, folder)), 9)


@query("e14_selection_gains", with_listings(
    f"select step, feature_added, {q('r2', 9)} as r2, {q('r2 - lag(r2, 1, 0) over (order by step)', 9)} as gain from path",
    _PATH_CTES))
def e14_selection_gains(spark, folder):
    return rounded(selection_gains(feature_selection_path(listings(spark, folder))), 9)


@query("e15_threshold_step", with_listings(f"""
select needed as step, {q('(select r2 from path where step = needed)', 9)} as r2,
       (select string_agg(feature_added, ', ' order by step) from path where step <= needed) as features
from (select coalesce(min(step) filter (r2 >= 0.9), max(step)) as needed from path)""", _PATH_CTES))
def e15_threshold_step(spark, folder):
    return rounded(threshold_step(feature_selection_path(listings(spark, folder))), 9)


# ── Principal components ────────────────────────────────────────────────────

_SCALED = "scaled as materialized (select product_id, discount_percentage as colour, " + ", ".join(
    f"({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) as x{i}" for i, c in enumerate(NUMERIC)
) + " from listings)"
_X = [f"x{i}" for i in range(len(NUMERIC))]
_PCA_CTES = f"{_SCALED},\n{pca_ctes('scaled', _X)}"


def _with_pca(body):
    return with_listings(body, _PCA_CTES).replace("with ", "with recursive ", 1)


@query("e16_pca_scores", _with_pca("select product_id, " + ", ".join(
    q(f"pc{i}", 7) + f' as "PC{i}"' for i in range(1, 6)) + f" from ({scores_sql(_X, 5, 'product_id')})"))
def e16_pca_scores(spark, folder):
    df = listings(spark, folder)
    fitted = fit_pca(df)
    return rounded(pca_scores(df, fitted).select("product_id", *fitted.names), 7)


@query("e17_explained_variance", _with_pca(
    f"select pc, {q('ratio', 8)} as ratio, {q('sum(ratio) over (order by pc)', 8)} as cumulative from components"))
def e17_explained_variance(spark, folder):
    return rounded(explained_variance(spark, fit_pca(listings(spark, folder))), 8)


@query("e18_components_needed", _with_pca(f"""
select min(pc) filter (c >= 0.9) as n_90, min(pc) filter (c >= 0.95) as n_95,
       max(pc) - min(pc) filter (c >= 0.95) as remaining, {q('1 - min(c) filter (c >= 0.95)', 8)} as remaining_share
from (select pc, sum(ratio) over (order by pc) as c from components)"""))
def e18_components_needed(spark, folder):
    return rounded(components_needed(explained_variance(spark, fit_pca(listings(spark, folder)))), 8)


@query("e19_loadings", _with_pca(" union all ".join(
    f"select '{c}' as feature, pc, {q(f'loadings[{i + 1}]', 7)} as loading from components"
    for i, c in enumerate(NUMERIC))))
def e19_loadings(spark, folder):
    return rounded(loadings_table(spark, fit_pca(listings(spark, folder))), 7)


_LONG_LOADINGS = " union all ".join(
    f"select pc, '{c}' as feature, '**{LOADING_LABELS[c]}** (' || printf('%+.2f', loadings[{i + 1}]) || ')' as item, "
    f"loadings[{i + 1}] as loading from components" for i, c in enumerate(NUMERIC))


@query("e20_loading_sentences", _with_pca(f"""
select pc,
       coalesce(string_agg(item, ', ' order by abs(loading) desc, feature) filter (loading > 0.25), 'none above threshold') as rises_with,
       coalesce(string_agg(item, ', ' order by abs(loading) desc, feature) filter (loading < -0.25), 'none above threshold') as falls_with
from ({_LONG_LOADINGS}) group by pc"""))
def e20_loading_sentences(spark, folder):
    return loading_sentences(loadings_table(spark, fit_pca(listings(spark, folder))))


@query("e21_pca_projection", _with_pca(
    f"select product_id, {q('pc1', 7)} as \"PC1\", {q('pc2', 7)} as \"PC2\", colour "
    f"from ({scores_sql(_X, 2, 'product_id, colour')})"))
def e21_pca_projection(spark, folder):
    df = listings(spark, folder)
    return rounded(pca_projection(df, fit_pca(df), "discount_percentage"), 7)


def _regression_ctes(fit_on):
    side = f"where not {IS_TEST_SQL}" if fit_on == "train" else ""
    scaled = "scaled as materialized (select product_id, discount_percentage as y, " + ", ".join(
        f"least(greatest(({c} - lo{i}) / (hi{i} - lo{i}), 0), 1) as x{i}" for i, c in enumerate(NUMERIC)
    ) + " from listings, (select " + ", ".join(
        f"min({c}) as lo{i}, max({c}) as hi{i}" for i, c in enumerate(NUMERIC)) + f" from listings {side}))"
    scores = scores_sql(_X, 5, "product_id, y")
    pcs = [f"pc{i}" for i in range(1, 6)]
    ctes = [scaled, f"fitted as materialized (select * from scaled {side})", pca_ctes("fitted", _X),
            f"scored as materialized ({scores})",
            moments_cte("train_m", f"(select * from scored where not {IS_TEST_SQL})", pcs, "y"),
            moments_cte("test_m", f"(select * from scored where {IS_TEST_SQL})", pcs, "y")]
    ctes += [solve_ctes(f"line{k}", "train_m", list(range(k))) for k in range(1, 6)]
    rows = " union all ".join(
        f"select {k}::bigint as k, (select sum(ratio) from components where pc <= {k}) as cumulative, r2 "
        f"from ({r2_sql(f'line{k}', 'test_m', list(range(k)))})" for k in range(1, 6))
    ctes.append(f"results as materialized ({rows})")
    return ",\n".join(ctes)


def _regression_sql(body, fit_on):
    return with_listings(body, _regression_ctes(fit_on)).replace("with ", "with recursive ", 1)


_RESULT_ROWS = f"select k, {q('cumulative', 7)} as cumulative, {q('r2', 7)} as r2 from results"


@query("e22_component_regression", _regression_sql(_RESULT_ROWS, "train"))
def e22_component_regression(spark, folder):
    return rounded(component_regression(listings(spark, folder)), 7)


@query("e22_component_regression_all", _regression_sql(_RESULT_ROWS, "all"))
def e22_component_regression_all(spark, folder):
    return rounded(component_regression(listings(spark, folder), fit_on="all"), 7)


@query("e23_best_k", _regression_sql(_RESULT_ROWS + " order by round(r2, 4) desc, k limit 1", "all"))
def e23_best_k(spark, folder):
    return rounded(best_k(component_regression(listings(spark, folder), fit_on="all")), 7)
