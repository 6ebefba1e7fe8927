"""Classification heads on Spark ML, cascades, out-of-fold predictions and experiment grids."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.vectors import cascade, top_label
from sieveline.operators import boosting, linear
from sieveline.operators.splitting import folds
from sieveline.schemas import ABSTAIN, ALL_LABELS, MAIN_SET, SEED
from sieveline.storage import settle


@dataclass(frozen=True)
class Head:
    """A learner and its parameters. ``logreg`` minimises ``|b|^2 / 2 + C * weighted loss``; ``boosted`` is softmax boosting on histograms, its other parameters in ``extra``."""

    kind: str = "logreg"
    c: float = 1.0
    balanced: bool = False
    max_iter: int = 100
    trees: int = 300
    depth: int = 5
    extra: dict = field(default_factory=dict)


def balance_weight(train: DataFrame, label: str) -> dict[str, float]:
    """rows / (labels * rows of the label)."""
    n = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    total = sum(n.values())
    return {k: total / (len(n) * v) for k, v in n.items()}


def _weights(train: DataFrame, label: str, head: Head, weight: str | None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    if head.balanced:
        for k, v in balance_weight(train, label).items():
            w = F.when(F.col(label) == k, w * v).otherwise(w) if not isinstance(w, float) else w
    return train.withColumn("__w", w.cast("double"))


def fit(train: DataFrame, label: str, features: str = "features", head: Head = Head(), weight: str | None = None) -> PipelineModel | boosting.Boosted:
    rows = _weights(train, label, head, weight)
    if head.kind == "boosted":
        return boosting.fit(rows, label, features, boosting.Boosting(rounds=head.trees, depth=head.depth, **head.extra), "__w")
    common = {"featuresCol": features, "labelCol": "__y", "weightCol": "__w"}
    if head.kind == "logreg":
        total = rows.agg(F.sum("__w")).first()[0] or 1.0
        learner = LogisticRegression(family="multinomial", elasticNetParam=0.0, standardization=False, regParam=1.0 / (head.c * total), maxIter=head.max_iter, **common)
    elif head.kind == "forest":
        learner = RandomForestClassifier(numTrees=head.trees, maxDepth=head.depth, seed=SEED, **common)
    else:
        raise ValueError(f"no head of the kind {head.kind}")
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="error")
    return Pipeline(stages=[index, learner]).fit(rows)


def classes(model: PipelineModel | boosting.Boosted) -> list[str]:
    return list(model.labels if isinstance(model, boosting.Boosted) else model.stages[0].labels)


def probabilities(model: PipelineModel | boosting.Boosted, df: DataFrame, labels: Sequence[str] = ALL_LABELS, name: str = "p") -> DataFrame:
    """Adds the model's probabilities in the order of ``labels``; a label that it hasn't learned has 0."""
    learned = classes(model)
    if isinstance(model, boosting.Boosted):
        scored, raw = model.transform(df, name="__raw"), F.col("__raw")
    else:
        scored, raw = model.stages[-1].transform(df), vector_to_array("probability")
    p = F.array(*[raw[learned.index(x)] if x in learned else F.lit(0.0) for x in labels])
    return scored.withColumn(name, p).drop("__raw", "rawPrediction", "probability", "prediction")


def as_predictions(df: DataFrame, key: str = "item_id", probs: str = "p", labels: Sequence[str] = ALL_LABELS) -> DataFrame:
    """The contract: key, the first most probable label in order, its probability, and all of them."""
    p = F.col(probs)
    return df.select(key, top_label(p, labels).alias("pred_label"), F.array_max(p).alias("confidence"), *[p[i].alias(f"p_{x}") for i, x in enumerate(labels)], p.alias("p"))


def merge_subtypes(p: Column, learned: Sequence[str], main: Sequence[str] = MAIN_SET) -> Column:
    """Probabilities of the main labels, and the sum of all others as the last."""
    others = [p[i] for i, x in enumerate(learned) if x not in main]
    return F.array(*[p[list(learned).index(x)] if x in learned else F.lit(0.0) for x in main], sum(others[1:], others[0]) if others else F.lit(0.0))


def fit_cascade(train: DataFrame, label: str, features: str = "features", gate: Head = Head(), kind: Head = Head()) -> Callable[[DataFrame], DataFrame]:
    """A gate that tells main labels from abstention, and a head for the kind fitted on main rows only.

    Returns a function that adds the six probabilities.
    """
    first = fit(train.withColumn("__gate", F.when(F.col(label) == ABSTAIN, "other").otherwise("main")), "__gate", features, gate)
    second = fit(train.where(F.col(label) != ABSTAIN), label, features, kind)

    def apply(df: DataFrame) -> DataFrame:
        rows = probabilities(first, df, ["main", "other"], "__g")
        rows = probabilities(second, rows, MAIN_SET, "__k")
        return rows.withColumn("p", cascade(F.col("__g")[0], F.col("__k"))).drop("__g", "__k")

    return apply


def _specs(heads: dict, weight: str | None, where: Column | None = None) -> dict[str, linear.Spec]:
    w = F.col(weight) if weight else None
    return {name: linear.Spec(h.c, w, where, h.balanced) for name, h in heads.items()}


def _in_order(p: Column, learned: Sequence[str], labels: Sequence[str]) -> Column:
    return F.array(*[p[list(learned).index(x)] if x in learned else F.lit(0.0) for x in labels])


def out_of_fold(df: DataFrame, group: str, label: str, features: str = "features", head: Head = Head(), k: int = 5, weight: str | None = None) -> DataFrame:
    """Every row with probabilities from a model that hasn't seen its group. Linear heads of all folds are fitted and scored together; others one fold after the other."""
    rows = df.join(folds(df, group, label, k), group)
    if head.kind == "logreg":
        rows = settle(rows)
        specs = {str(i): _specs({"": head}, weight, F.col("fold") != i)[""] for i in range(k)}
        models = linear.fit_many(rows, label, specs, features, max_scans=3 * head.max_iter)
        scored = linear.predict([models[str(i)] for i in range(k)], rows, features, F.col("fold"), "__p")
        return scored.withColumn("p", _in_order(F.col("__p"), models["0"].labels, ALL_LABELS)).drop("__p")
    out = None
    for i in range(k):
        part = probabilities(fit(rows.where(F.col("fold") != i), label, features, head, weight), rows.where(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out


def source_weights(source: Column, weights: dict[str, float]) -> Column:
    """A row's weight by its label source, 1 for others."""
    w = F.lit(1.0)
    for k, v in weights.items():
        w = F.when(source == k, F.lit(float(v))).otherwise(w)
    return w


def refit_rows(split: Column) -> Column:
    """Validation rows as training rows, for the last fit."""
    return F.when(split == "val", F.lit("train")).otherwise(split)


def run_grid(df: DataFrame, grid: dict[str, Head], label: str, evaluate: Callable[[DataFrame], DataFrame], split: str = "split", features: str = "features", weight: str | None = None) -> DataFrame:
    """One row of metrics for each head, fitted on training rows and evaluated on validation rows.

    All linear heads of the grid, whatever their C and weights, are fitted and scored in the same scans; forests and boosted heads one after the other.
    """
    rows = settle(df)
    train, val = F.col(split) == "train", rows.where(F.col(split) == "val")
    together = {name: h for name, h in grid.items() if h.kind == "logreg"}
    scored = {}
    if together:
        models = linear.fit_many(rows, label, _specs(together, weight, train), features, max_scans=3 * max(h.max_iter for h in together.values()))
        every = settle(linear.predict([models[name] for name in together], val, features, name="__p"))
        for i, name in enumerate(together):
            scored[name] = every.withColumn("p", _in_order(F.col("__p")[i], models[name].labels, ALL_LABELS)).drop("__p")
    out = None
    for name, head in grid.items():
        mine = scored[name] if name in scored else probabilities(fit(rows.where(train), label, features, head, weight), val)
        one = evaluate(mine.withColumn("pred_label", top_label(F.col("p"), ALL_LABELS))).withColumn("head", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def index_to_label(labels: Sequence[str], column: str, name: str) -> IndexToString:
    return IndexToString(inputCol=column, outputCol=name, labels=list(labels))
