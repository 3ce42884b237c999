"""Random search over boosting settings with expanding time folds."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from operator import itemgetter

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.aggregates import mean_absolute_error
from tidepanel.operators.models import ForecastSpec, boosting_params, first_rounds, fit, predict, training_layout
from tidepanel.operators.ordered import ordered_index
from tidepanel.operators.split import fold_bounds, number_dates
from tidepanel.plans.prepare import Prepared
from tidepanel.storage import materialise

SEED = 42

# The settings a search draws from, as text so that their hash
# does not depend on how a number is printed.
SEARCH_SPACE = {
    "n_estimators": ("100", "200", "300", "500"),
    "learning_rate": ("0.01", "0.05", "0.1", "0.2"),
    "max_depth": ("3", "4", "5", "6", "8"),
    "min_child_weight": ("1", "3", "5"),
    "subsample": ("0.7", "0.8", "0.9", "1.0"),
    "colsample_bytree": ("0.7", "0.8", "0.9", "1.0"),
    "gamma": ("0", "0.1", "0.2"),
}


def param_grid(spark: SparkSession, space: Mapping[str, Sequence[str]] = SEARCH_SPACE) -> DataFrame:
    """Every combination of the settings, one per row."""
    axes = [
        spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
        for name, values in space.items()
    ]
    return reduce(DataFrame.crossJoin, axes)


def random_candidates(grid: DataFrame, n_iter: int, seed: int = SEED) -> DataFrame:
    """``n_iter`` combinations without replacement: those with the smallest seeded hash."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *grid.columns).cast("binary"))
    return grid.orderBy(draw).limit(n_iter)


@dataclass(frozen=True)
class Search:
    scores: DataFrame  # candidate, fold, the settings, the score
    ranking: DataFrame  # candidate, the settings, the mean score; the best first
    best: dict[str, str]


def search(
    prepared: Prepared,
    base: ForecastSpec,
    candidates: Sequence[Mapping[str, str]],
    n_splits: int = 5,
    unit: str = "date",
    parallelism: int = 4,
    scorer: Callable[[Column, Column], Column] = mean_absolute_error,
    score_name: str = "mae",
    greater_is_better: bool = False,
    table_scorer: Callable[[DataFrame, str, str], DataFrame] | None = None,
) -> Search:
    """Score each candidate on each fold of the train side.

    Every fit is a distributed job over one numbered table, written once in the
    training layout; a fold is a range filter on it, so folds are never copied
    or shuffled. ``parallelism`` fits are in flight at a time. ``unit`` cuts
    folds between dates, or between rows in (group, date) order. ``scorer``
    makes an aggregate of the actual and the predicted column. What needs more than
    one aggregate, or other columns, is a ``table_scorer``: it takes a fold's scored
    rows (all prepared columns) with the names of the actual and the predicted one,
    and gives a table of one row whose first column is the score.

    Boosted candidates that differ only in their rounds are one fit of the most rounds,
    whose first rounds are scored for the others. Where the session schedules fairly
    (``spark.scheduler.mode``), each fit has a pool of its own.
    """
    spark = prepared.rows.sparkSession
    if unit == "row":
        numbered = ordered_index(prepared.train, prepared.keys, "_unit")
    else:
        numbered = number_dates(prepared.train, prepared.spec.date, prepared.spec.grain, "_unit")
    numbered = materialise(training_layout(numbered, prepared.keys), "folds")
    bounds = fold_bounds(numbered.agg((F.max("_unit") + 1).alias("n")), n_splits).collect()

    fits = defaultdict(list)  # parameters without the rounds -> (rounds, candidate, settings)
    for candidate, settings in enumerate(candidates):
        params = {**base.params, **boosting_params(settings)}
        rounds = params.pop("maxIter") if base.kind == "boosted" else None
        fits[tuple(sorted(params.items()))].append((rounds, candidate, settings))

    def score(model, test):
        scored = predict(model, test, prepared.features, "_predicted", base.log_target)
        if table_scorer is not None:
            table = table_scorer(scored, base.label, "_predicted")
        else:
            table = scored.agg(scorer(F.col(base.label), F.col("_predicted")))
        return table.first()[0]

    def run(job):
        place, (params, members), fold = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{place}-{fold.fold}")
        train = numbered.where(F.col("_unit") < fold.test_from)
        test = numbered.where((F.col("_unit") >= fold.test_from) & (F.col("_unit") < fold.test_to))
        most = max(members, key=itemgetter(0))[0] if base.kind == "boosted" else None
        spec = replace(base, params=dict(params) | ({"maxIter": most} if most is not None else {}))
        whole = fit(train, prepared.features, spec, prepared.keys, laid_out=True)
        results = []
        for rounds, candidate, settings in members:
            model = whole if rounds == most else first_rounds(whole, rounds)
            results.append({"candidate": candidate, "fold": fold.fold, **settings, score_name: score(model, test)})
        return results

    jobs = [(place, job, fold) for place, job in enumerate(fits.items()) for fold in bounds]
    with ThreadPoolExecutor(parallelism) as pool:
        results = [row for rows in pool.map(run, jobs) for row in rows]
    scores = spark.createDataFrame(results)
    names = list(candidates[0])
    means = scores.groupBy("candidate", *names).agg(F.avg(score_name).alias(score_name))
    order = F.desc(score_name) if greater_is_better else F.asc(score_name)
    ranking = means.orderBy(order, "candidate")
    best = ranking.first()
    return Search(scores, ranking, {name: best[name] for name in names})


def refit_best(prepared: Prepared, base: ForecastSpec, found: Search) -> Model:
    spec = replace(base, params={**base.params, **boosting_params(found.best)})
    return fit(prepared.train, prepared.features, spec, prepared.keys, prepared.laid_out)
