"""Composite jobs (X1-X3): load -> profile -> choose -> split -> search -> predict -> evaluate.

Only schema facts, fold/split cutoffs, search scores and fitted models
pass through the driver; the profile, predictions and metrics stay
DataFrames. The prepared train rows are cached once around the search.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.bundle import Bundle, quote
from fathom.operators import evaluate as E
from fathom.operators import prepare as P
from fathom.operators import profile as D
from fathom.operators import splits as T
from fathom.plans import search as S
from fathom.plans.estimators import LINEAR_KIND, fit_linear, linear_moments
from fathom.plans.registry_models import DEFAULT_SUGGESTION, list_models, lookup
from fathom.session import written
from fathom.sources.tables import load_table

# The plan used when no planner is consulted.
OFFLINE_PLAN = (
    ("select_model", "Select ML model for the task"),
    ("train", "Split data, train model (with optional hyperparameter tuning)"),
    ("evaluate", "Evaluate on test set and generate plots"),
    ("interpret", "Summarize metrics and interpretation"),
)


@dataclass
class RunResult:
    steps: list = field(default_factory=list)
    bundle: Bundle | None = None
    metadata: DataFrame | None = None
    summary: DataFrame | None = None
    suggestion: tuple | None = None
    model: object = None
    best: dict | None = None
    scores: DataFrame | None = None
    predictions: DataFrame | None = None
    metrics: DataFrame | None = None
    interpretation: DataFrame | None = None


def _suggest(task: str, fixed_model: str | None):
    if fixed_model:
        s = lookup(fixed_model)
        if s is None:
            raise ValueError(f"Unknown model '{fixed_model}'. Valid: {list_models(task)}")
        return s
    return DEFAULT_SUGGESTION[task]


@dataclass
class Run:
    """What the stages of one run are given."""
    task: str
    key: list | None
    grid_on: bool
    randomized: bool
    fixed_model: str | None
    parallelism: int
    skip_training: bool = False


def _choose(run: Run, res: RunResult) -> RunResult:
    return replace(res, suggestion=_suggest(run.task, run.fixed_model))


def _train(run: Run, res: RunResult) -> RunResult:
    b, name = res.bundle, res.suggestion[0]
    keys = run.key or list(b.df.columns)
    # written once: read as it is, each pass over the split would hash every row again for each cut
    data = written(T.split_and_folds(b.df, keys, b.target if run.task == "classification" else None), "split")
    train = data.where(F.col("split") == "train")
    model, best, scores = S.search(train, b.features, b.target, name, run.task, S.param_grid(name, run.task, None, run.grid_on),
                                   randomized=run.randomized, parallelism=run.parallelism, key=run.key)
    pred = model.predict(data.where(F.col("split") == "test")).select(
        *keys, F.col(b.target).alias("y_true"), F.col("prediction").alias("y_pred"))
    return replace(res, model=model, best=best, scores=scores, predictions=pred)


def _evaluate(run: Run, res: RunResult) -> RunResult:
    metrics = E.classification_metrics if run.task == "classification" else E.regression_metrics
    return replace(res, metrics=metrics(res.predictions))


def _interpret(run: Run, res: RunResult) -> RunResult:
    return replace(res, interpretation=E.verdict(res.metrics, res.suggestion[0], run.task))


#: Each action of a plan: its function and the fields of the result that it needs; without them it is left out.
STAGES = {
    "select_model": (_choose, ["bundle"]),
    "train": (_train, ["bundle", "suggestion"]),
    "evaluate": (_evaluate, ["suggestion", "predictions"]),
    "interpret": (_interpret, ["suggestion", "metrics"]),
}


def run_stage(action: str, run: Run, res: RunResult) -> RunResult:
    """One stage on its own; unknown actions and stages without their inputs change nothing."""
    name = "_".join((action or "").lower().split())
    if name not in STAGES or (name == "train" and run.skip_training):
        return res
    work, needs = STAGES[name]
    return work(run, res) if all(getattr(res, n) is not None for n in needs) else res


def run_pipeline(spark: SparkSession, data_config: dict, *, task: str = "regression",
                 key: list[str] | None = None, use_tuning: bool = True, randomized: bool = False,
                 skip_training: bool = False, fixed_model: str | None = None,
                 plan: list[tuple[str, str]] | None = None, bundle: Bundle | None = None,
                 parallelism: int = 2) -> RunResult:
    """The whole run for one (table, target, task).

    ``plan`` is a list of (action, description); steps run in its order and
    a plan without ``train`` makes the later steps no-ops. ``key`` names the
    columns that identify a row (default: all columns) for the split order.
    """
    b = bundle or load_table(spark, data_config)
    run = Run(task, key, use_tuning, randomized, fixed_model, parallelism, skip_training)
    actions = list(plan or OFFLINE_PLAN)
    res = RunResult(steps=[text or action for action, text in actions], bundle=b, metadata=P.dataset_metadata(b),
                    summary=D.summary_text(b.df, b.features, b.target, task))
    for action, _ in actions:
        res = run_stage(action, run, res)
    return res


def run_tasks(spark: SparkSession, data_config: dict, tasks: list[dict], **kw) -> DataFrame:
    """One table, several (target, task) runs; a row of metrics + verdict per run.

    The table is loaded and prepared once for each set of features and target,
    not once for each run."""
    loaded: dict = {}
    out = None
    for t in tasks:
        cfg = dict(data_config, target=t["target"])
        if t["target"] not in loaded:
            loaded[t["target"]] = load_table(spark, cfg)
        r = run_pipeline(spark, cfg, task=t["task"], bundle=loaded[t["target"]], **{**kw, **t.get("options", {})})
        row = r.interpretation.select(F.lit(t["target"]).alias("target"), F.lit(t["task"]).alias("task"),
                                      F.lit(r.suggestion[0]).alias("model"), "n", "level", "verdict")
        out = row if out is None else out.unionByName(row)
    return out


def compare_models(spark: SparkSession, bundle: Bundle, models: list[str], task: str = "regression",
                   key: list[str] | None = None, use_tuning: bool = False) -> DataFrame:
    """Several models on the same split, best first (R2 / accuracy)."""
    keys = key or list(bundle.df.columns)
    data = written(T.split_and_folds(bundle.df, keys, bundle.target if task == "classification" else None), "split")
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    grids = {name: S.param_grid(name, task, None, use_tuning) for name in models}
    plain = [name for name in models if name in LINEAR_KIND and not grids[name]]
    # all linear models without a grid are solved from the same moments
    moments = linear_moments(train, bundle.features, bundle.target) if plain else None
    fitted = {name: fit_linear(train, bundle.features, bundle.target, LINEAR_KIND[name], {}, moments) if name in plain
              else S.search(train, bundle.features, bundle.target, name, task, grids[name], key=key)[0] for name in models}
    # one pass over the test rows: a column for each model, then a row
    pred, answers = test, []
    for i, (name, model) in enumerate(fitted.items()):
        pred = model.predict(pred).withColumnRenamed("prediction", f"__model{i}")
        answers.append(F.struct(F.lit(name).alias("model"), F.col(f"__model{i}").alias("y_pred")))
    pred = pred.select(F.col(quote(bundle.target)).alias("y_true"), F.explode(F.array(*answers)).alias("a")).select("y_true", "a.*")
    rows = E.classification_metrics(pred, ["model"]) if task == "classification" else E.regression_metrics(pred, ["model"])
    key_metric = "accuracy" if task == "classification" else "R2"
    return rows.orderBy(F.col(key_metric).desc_nulls_last(), "model")

