"""Exact AUC and ROC at any size, class balance, vector statistics, contrastive loss, scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import as_table

ROWS_PER_BUCKET = 200_000


def running(df: DataFrame, order: str, sums: list[str], descending: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``df`` with ``<name>_before`` for each name: the sum over all rows before it. ``order`` must be unique.

    No window spans the table: rows are dealt to ranges, whose number follows theirs, and written once with their
    range; sums run within a range, and the ranges' totals are carried in.
    """
    direct = F.desc if descending else F.asc
    made = as_table(df, "to_rank")
    buckets = max(1, -(-made.count() // rows_per_bucket))
    cut = as_table(made.repartitionByRange(buckets, order).withColumn("bucket", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy(direct("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = cut.groupBy("bucket").agg(*[F.sum(s).alias(s) for s in sums])
    carry = totals.select("bucket", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_carry") for s in sums])
    here = Window.partitionBy("bucket").orderBy(direct(order)).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(carry, "bucket").select(
        *df.columns, *[(F.coalesce(F.sum(s).over(here), F.lit(0)) + F.col(f"{s}_carry")).alias(f"{s}_before") for s in sums]
    )


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """``(score, p, n)``: positives and negatives at each distinct score; rows without either value are left out."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return rows.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n")
    )


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """``(auc, positives, negatives)`` of one task, ties counted half; auc is null if a class has no row."""
    ranked = running(by_score(df, score, label), "score", ["n"])
    pairs = F.sum((F.col("p") * (2 * F.col("n_before") + F.col("n"))).cast("decimal(38,0)"))
    both = ranked.agg(pairs.alias("pairs"), F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"))
    whole = 2.0 * F.col("positives").cast("double") * F.col("negatives").cast("double")
    return both.select(F.when(whole > 0, F.col("pairs").cast("double") / F.nullif(whole, F.lit(0.0))).alias("auc"), "positives", "negatives")


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """``(threshold, fpr, tpr)`` at each distinct score: what is positive at this score or above."""
    table = as_table(by_score(df, score, label), "by_score")
    ranked = running(table, "score", ["p", "n"], descending=True)
    whole = table.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    rate = lambda x: (F.col(f"{x}_before") + F.col(x)) / F.nullif(F.col(f"all_{x}"), F.lit(0))
    return ranked.join(F.broadcast(whole)).select(F.col("score").alias("threshold"), rate("n").alias("fpr"), rate("p").alias("tpr"))


def class_balance(df: DataFrame, tasks: list[str]) -> DataFrame:
    """``(task, negatives, positives, pos_weight)`` of each label column; the weight is null without positives."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("label")) for t in tasks])).alias("x")).select("x.*")
    counts = long.where("label is not null").groupBy("task").agg(
        F.sum((F.col("label") != 1).cast("long")).alias("negatives"), F.sum((F.col("label") == 1).cast("long")).alias("positives")
    )
    return counts.withColumn("pos_weight", F.col("negatives") / F.nullif(F.col("positives"), F.lit(0)))


def vector_stats(df: DataFrame, vector: str) -> DataFrame:
    """``(dim, n, mean, variance)`` of each dimension over all rows (population variance)."""
    cells = df.select(F.posexplode(vector).alias("dim", "x"))
    return cells.groupBy("dim").agg(F.count("x").alias("n"), F.avg(F.col("x").cast("double")).alias("mean"), F.var_pop(F.col("x").cast("double")).alias("variance"))


def mean_pool(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``(group, dim, value)``: the mean of a group's vectors that are not all zero."""
    filled = df.where(F.exists(vector, lambda x: x != 0))
    return filled.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def contrastive_losses(df: DataFrame, batch: str, left: str, right: str, temperature: float = 0.07) -> DataFrame:
    """``(batch, n, loss, back)``: cross-entropy of each row's cosine to all partners in its batch against its own, and of each partner's to all rows.

    One matrix of scores a batch serves both directions. Batches are bounded by their construction (ids in blocks), vectors have one length.
    """

    @F.arrow_udf("struct<loss:double,back:double>")
    def both(batches: pa.Array) -> pa.Array:
        out = []
        for rows in batches:
            u, v = (np.stack([x.as_py() for x in rows.values.field(side)]).astype(float) for side in ("u", "v"))
            u, v = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (u, v))
            scores = u @ v.T / temperature
            own = np.diagonal(scores)
            logs = [top + np.log(np.exp(scores - np.expand_dims(top, axis)).sum(axis)) for axis in (1, 0) for top in (scores.max(axis),)]
            out.append({"loss": float((logs[0] - own).mean()), "back": float((logs[1] - own).mean())})
        return pa.array(out, pa.struct([("loss", pa.float64()), ("back", pa.float64())]))

    cells = df.groupBy(batch).agg(F.count("*").alias("n"), F.collect_list(F.struct(F.col(left).alias("u"), F.col(right).alias("v"))).alias("rows"))
    return cells.select(batch, "n", both("rows").alias("x")).select(batch, "n", "x.loss", "x.back")


def weighted_loss(tasks: list[Column], contrast: list[Column], weight: float = 0.1) -> Column:
    """Task losses summed, plus the weighted contrastive losses."""
    return sum(tasks[1:], tasks[0]) + sum((weight * c for c in contrast), F.lit(0.0))


def metric_rollup(df: DataFrame, epoch: str, metric: str, weight: str) -> DataFrame:
    """``(epoch, n, value)``: the mean of a metric weighted by sample counts; null where nothing has weight."""
    rows = df.where(F.col(metric).isNotNull() & F.col(weight).isNotNull())
    return rows.groupBy(epoch).agg(
        F.sum(weight).alias("n"), (F.sum(F.col(metric) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias("value")
    )


def missing_image_ratio(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(1 - F.col("has_image")).alias("missing_ratio"))


def first_batches(df: DataFrame, key: str, batches: int, batch: int) -> DataFrame:
    """At most so many batches of rows, the first in the order of ``key``: a cap on what is evaluated."""
    return df.orderBy(key).limit(batches * batch)


def score_batches(df: DataFrame, make_predict: Callable, inputs: list[str], batch: int = 1024, shapes: list[list[int]] | None = None) -> DataFrame:
    """``df`` with ``prob_good`` and ``prob_best``: a network's two logits through the sigmoid.

    ``make_predict`` builds, once in each worker, a function from numpy arrays of the inputs to an array
    (rows, 2) of logits. ``shapes``: of a row of each input, needed for arrays.
    """
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=shapes)
    scored = df.withColumn("_logits", predict(*inputs))
    sig = lambda i: (1 / (1 + F.exp(-F.get("_logits", F.lit(i)).cast("double"))))
    return scored.select(*df.columns, sig(0).alias("prob_good"), sig(1).alias("prob_best"))


def fit_two_tasks(df: DataFrame, features: list[str], tasks: tuple[str, ...] = ("label_good", "label_best"), rounds: int = 20) -> DataFrame:
    """``df`` with ``prob_<task>``: one class-weighted logistic regression for each label.

    Positives weigh negatives / positives. Feature columns must hold no null.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    weights = {r.task: r.pos_weight or 1.0 for r in class_balance(df, list(tasks)).collect()}
    now = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    for task in tasks:
        weighed = now.withColumn("_w", F.when(F.col(task) == 1, weights.get(task, 1.0)).otherwise(1.0)).withColumn(task, F.col(task).cast("double"))
        made = LogisticRegression(featuresCol="_x", labelCol=task, weightCol="_w", maxIter=rounds, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(weighed)
        now = made.transform(now).withColumn(f"prob_{task.removeprefix('label_')}", vector_to_array("_p")[1]).drop("_p", "_r", "_c")
    return now.drop("_x")
