"""Boosted-tree delay regression on Spark ML, with chronological selection."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, functions as F

from lagline.functions.clock import epoch_seconds
from lagline.models import tuning
from lagline.models.features import CATEGORICAL, FEATURES, with_features
from lagline.operators.lookup import fit_lookup, predict_lookup
from lagline.operators.metrics import error_metrics
from lagline.staging import release, staged

STRIDE = 16  # trees grown between two writes of the rows and their sums
FILE_ROWS = 100_000  # rows of one stored file; Spark ML holds a split's rows as objects
AT_ONCE = 4  # recipes fitted at the same time


@dataclass(frozen=True)
class Recipe:
    """One candidate: tree depth, tree limit and how categories enter the trees.

    `iterations` is a safety limit; with validation rows, they decide when to stop: once the
    `patience` trees after the best one have not improved on it.
    """

    name: str = "reference"
    depth: int = 6
    iterations: int = 1200
    encoding: str = "one_hot"
    learning_rate: float = 0.1
    max_bins: int = 256
    seed: int = 42
    patience: int = 80

    def __post_init__(self):
        if self.encoding not in ("one_hot", "native"):
            raise ValueError("encoding is one_hot or native")


def encoder(recipe: Recipe) -> Pipeline:
    """Index the categories, then one-hot encode them or leave them to the tree splits."""
    names = [f"f_{c}" for c in CATEGORICAL]
    indexed = [f"i_{c}" for c in CATEGORICAL]
    stages = [StringIndexer(inputCols=names, outputCols=indexed, handleInvalid="keep")]
    inputs = indexed
    if recipe.encoding == "one_hot":
        inputs = [f"o_{c}" for c in CATEGORICAL]
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=inputs, dropLast=False))
    stages.append(VectorAssembler(inputCols=[*inputs, "f_minute_of_day"], outputCol="features"))
    return Pipeline(stages=stages)


def fit_trees(training: DataFrame, recipe: Recipe, validation: DataFrame | None = None) -> PipelineModel:
    """Absolute-loss boosting; with `validation` rows it keeps the trees up to their best one.

    Encoders see training rows only. Later trees fit the signs of errors, so labels are in
    units of their own mean absolute deviation while trees grow, and the trees' weights bring
    seconds back.
    """
    train = with_features(training).withColumn("_holdout", F.lit(False))
    rows = train
    if validation is not None:
        rows = rows.unionByName(with_features(validation).withColumn("_holdout", F.lit(True)), allowMissingColumns=True)
    encoding = encoder(recipe).fit(train)
    widest = max(map(len, encoding.stages[0].labelsArray)) + 1  # unseen values share one more slot
    label = F.col("delay_seconds").cast("double")
    middle = training.agg(F.percentile(label, 0.5)).first()[0]
    unit = training.agg(F.avg(F.abs(label - middle))).first()[0] or 1.0
    encoded = encoding.transform(rows).select("features", (label / unit).alias("label"), "_holdout")
    trees, errors = grow(encoded, recipe, max(recipe.max_bins, widest))
    kept = best_size(errors, recipe.patience) if errors else len(trees)
    return PipelineModel(stages=[*encoding.stages, _ensemble(trees[:kept], recipe.learning_rate, unit)])


def grow(encoded: DataFrame, recipe: Recipe, bins: int, opening: int | None = None) -> tuple[list[DecisionTreeRegressionModel], list[float]]:
    """(trees, held-out error after each) of absolute-loss boosting on (features, label, _holdout).

    The first tree fits the labels, each later one the signs of the errors left. One fit grows
    the `opening` trees: all without held-out rows, else a few more than the patience asks for
    at least. After that the sum so far is a column of the rows, and the rows are written again
    after STRIDE trees, so a tree more costs one tree and at most STRIDE predictions however
    many there are. The errors of a stride are one aggregate; growth ends once patience has
    run out. Without held-out rows there are no errors, and all `iterations` trees grow.
    """
    spark = encoded.sparkSession
    own: list[str] = []
    state = staged(encoded, "boosting", own, FILE_ROWS)
    checked = not state.where("_holdout").isEmpty()
    if opening is None:
        opening = recipe.patience + recipe.patience // 4 + 1 if checked else recipe.iterations
    try:
        first = GBTRegressor(
            lossType="absolute", maxDepth=recipe.depth, maxIter=min(opening, recipe.iterations), stepSize=recipe.learning_rate,
            maxBins=bins, seed=recipe.seed, predictionCol="_sum", checkpointInterval=5, cacheNodeIds=False,
        ).fit(state.where("not _holdout"))
        trees: list[DecisionTreeRegressionModel] = list(first.trees)
        errors: list[float] = first.evaluateEachIteration(state.where("_holdout"), "absolute") if checked else []
        state = first.transform(state)
        while len(trees) < recipe.iterations and (not errors or best_size(errors, recipe.patience) + recipe.patience > len(errors)):
            moved, gaps = state, []
            for _ in range(min(STRIDE, recipe.iterations - len(trees))):
                left = F.col("label") - F.col("_sum")
                target = F.when(left < 0, -1.0).otherwise(1.0)
                tree = DecisionTreeRegressor(
                    labelCol="_target", predictionCol="_tree", maxDepth=recipe.depth, maxBins=bins, seed=recipe.seed,
                ).fit(moved.where("not _holdout").select("features", target.alias("_target")))
                trees.append(tree)
                moved = tree.transform(moved).withColumn("_sum", F.col("_sum") + recipe.learning_rate * F.col("_tree")).drop("_tree")
                gaps.append(f"_gap{len(gaps)}")
                moved = moved.withColumn(gaps[-1], F.abs(F.col("label") - F.col("_sum")))
            state = staged(moved, "boosting", own, FILE_ROWS)
            if checked:
                errors += list(state.where("_holdout").agg(*[F.avg(g) for g in gaps]).first())
            state = state.drop(*gaps)
            release(spark, [own.pop(0)])
    finally:
        release(spark, own)
    return trees, errors


def best_size(errors: list[float], patience: int) -> int:
    """Trees up to the first best error that none of the next `patience` improves on."""
    best = 0
    for at, error in enumerate(errors):
        if error < errors[best]:
            best = at
        elif at - best >= patience:
            break
    return best + 1


def _ensemble(trees: list[DecisionTreeRegressionModel], rate: float, unit: float) -> GBTRegressionModel:
    """One model of all trees: the first counts whole, the others by `rate`, in units of `unit`."""
    context = SparkContext._active_spark_context
    package = context._jvm.org.apache.spark.ml.regression
    own = context._gateway.new_array(package.DecisionTreeRegressionModel, len(trees))
    weights = context._gateway.new_array(context._jvm.double, len(trees))
    for k, tree in enumerate(trees):
        own[k], weights[k] = tree._java_obj, unit * (rate if k else 1.0)
    name = GBTRegressor().uid
    return GBTRegressionModel(package.GBTRegressionModel(name, own, weights, trees[0].numFeatures)).setPredictionCol("prediction_boosted")


def tree_count(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def stopped_by(model: PipelineModel, recipe: Recipe) -> str:
    """`validation` if the patience after the last tree kept ran out within the tree limit, else `cap`.

    No tolerance ends a fit: any lower validation error counts as better.
    """
    return "cap" if tree_count(model) + recipe.patience > recipe.iterations else "validation"


def _settled(records: DataFrame, allow_cap: bool) -> DataFrame:
    capped = [r["candidate"] for r in records.where("stopped_by = 'cap'").select("candidate").distinct().collect()]
    if capped and not allow_cap:
        raise ValueError(f"the tree limit, not validation, ended {sorted(capped)}; raise iterations or allow it")
    return records


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Predicted delay and predicted local departure, rounded to the second."""
    kept = rows.columns
    scored = model.transform(with_features(rows)).select(*kept, "prediction_boosted")
    moved = epoch_seconds(F.col("scheduled_time_local").cast("timestamp")) + F.col("prediction_boosted")
    return scored.withColumn(
        "predicted_departure_local", F.timestamp_seconds(F.round(moved).cast("bigint")).cast("timestamp_ntz")
    )


def feature_importance(model: PipelineModel, sample: DataFrame) -> DataFrame:
    """Importance per input feature, its encoded slots added up."""
    trees: GBTRegressionModel = model.stages[-1]
    encoded = model.transform(with_features(sample).limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    weights = trees.featureImportances
    totals = dict.fromkeys(FEATURES, 0.0)
    for attributes in encoded.values():
        for attribute in attributes:
            owner = next(f for f in FEATURES if attribute["name"].split("_", 1)[1].startswith(f))
            totals[owner] += float(weights[attribute["idx"]])
    return sample.sparkSession.createDataFrame(list(totals.items()), "feature string, importance double")


def select_depth(
    training: DataFrame, validation: DataFrame, recipes: list[Recipe], allow_cap: bool = False
) -> tuple[PipelineModel, DataFrame]:
    """Fit every recipe, score the validation rows, keep the lowest mean absolute error.

    Receives no test rows, so selection cannot see them. A fit that ran into its tree limit
    says nothing about the best size, so it is an error unless `allow_cap`.
    """
    records, best, best_mae = [], None, float("inf")
    for recipe, model, mae in _fitted(training, validation, recipes):
        records.append((recipe.name, recipe.depth, tree_count(model), stopped_by(model, recipe), mae))
        if mae < best_mae:
            best, best_mae = model, mae
    spark = training.sparkSession
    schema = "candidate string, depth int, tree_count int, stopped_by string, mae_seconds double"
    return best, _settled(spark.createDataFrame(records, schema), allow_cap)


def _fitted(training: DataFrame, validation: DataFrame, recipes: list[Recipe]) -> list[tuple[Recipe, PipelineModel, float]]:
    """(recipe, model, validation error) in the order given.

    A level of a tree is a short job, so the recipes' jobs share the cluster.
    """

    def fitted(recipe: Recipe) -> tuple[Recipe, PipelineModel, float]:
        model = fit_trees(training, recipe, validation)
        return recipe, model, _mae(score(model, validation))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(training.sparkSession)(fitted), recipes))


def _mae(scored: DataFrame) -> float:
    return scored.agg(F.avg(F.abs(F.col("prediction_boosted") - F.col("delay_seconds")))).first()[0]


def cross_validate(rows: DataFrame, plan: tuning.Plan, recipes: list[Recipe], allow_cap: bool = False) -> DataFrame:
    """One record per fold and recipe; folds train on everything before their window.

    `allow_cap` as in `select_depth`.
    """
    development = tuning.between(rows, plan.train_start, plan.final_training_end_exclusive)
    records = []
    for number, fold in enumerate(plan.folds, 1):
        train, validation = tuning.fold_rows(development, plan, fold)
        if train.isEmpty() or validation.isEmpty():
            raise ValueError("a fold is empty")
        for recipe, model, mae in _fitted(train, validation, recipes):
            records.append((recipe.name, number, tree_count(model), stopped_by(model, recipe), mae))
    schema = "candidate string, fold int, tree_count int, stopped_by string, mae_seconds double"
    return _settled(rows.sparkSession.createDataFrame(records, schema), allow_cap)


def tuned_holdout(
    rows: DataFrame, plan: tuning.Plan, recipes: list[Recipe], minimum_count: int = 20, allow_cap: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(ranking, holdout predictions): rank by folds, refit at the median tree count,
    and only then read the holdout."""
    ranking = tuning.rank_candidates(cross_validate(rows, plan, recipes, allow_cap))
    ranked = {r["candidate"]: r for r in ranking.collect()}  # one row per candidate
    training = tuning.final_training(rows, plan)
    by_name = {r.name: r for r in recipes}
    chosen = next(iter(ranked))

    def refit(name: str) -> PipelineModel:
        recipe = by_name[name]
        sized = Recipe(**{**recipe.__dict__, "iterations": max(1, ranked[name]["final_tree_count"])})
        return fit_trees(training, sized)

    models = {"selected": refit(chosen), "reference": refit("reference")}
    holdout = tuning.holdout_rows(rows, plan)
    if not holdout.select("row_id").intersect(training.select("row_id")).isEmpty():
        raise ValueError("the holdout is empty or shares rows with training")
    scored = predict_lookup(holdout, fit_lookup(training, minimum_count)).withColumnRenamed(
        "prediction_seconds", "prediction_grouped_median"
    )
    for name, model in models.items():
        scored = score(model, scored).withColumnRenamed("prediction_boosted", f"prediction_{name}").drop(
            "predicted_departure_local"
        )
    return ranking, scored


def boosted_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    return error_metrics(scored, keys, "delay_seconds", "prediction_boosted", continuous=True)
