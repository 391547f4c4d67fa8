"""Evaluation metrics, smoothing, regressions and report figures."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def accuracy(rows: DataFrame, task: str, correct: str) -> DataFrame:
    return rows.groupBy(task).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def centered(acc: Column, baseline: Column, percent: bool = True) -> Column:
    """Accuracy above a random baseline, 1 at most; the baseline in percent or as a fraction."""
    b = baseline * 0.01 if percent else baseline
    return (acc - b) / (1 - b)


def core_metric(rows: DataFrame, baselines: DataFrame, task: str, correct: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accuracy and centred accuracy of each task, their mean); ``baselines``: (task, baseline in percent).

    A task without a baseline is an error, or counts as baseline 0 when not strict.
    """
    acc = accuracy(rows, task, correct).join(baselines, task, "left")
    base = F.coalesce("baseline", F.raise_error(F.lit("task without a baseline")).cast("double")) if strict else F.coalesce("baseline", F.lit(0.0))
    acc = acc.withColumn("centered", centered(F.col("accuracy"), base))
    return acc, acc.agg(F.avg("centered").alias("core"))


def chat_metric(acc: DataFrame, baselines: dict[str, float], task: str = "task") -> DataFrame:
    """Mean centred accuracy over all tasks of ``baselines`` (fractions); null unless every one is there."""
    table = F.element_at(F.create_map(*(F.lit(x) for kv in baselines.items() for x in kv)), F.col(task))
    rows = acc.where(F.col(task).isin(*baselines)).withColumn("centered", centered(F.col("accuracy"), table, percent=False))
    return rows.agg(F.when(F.countDistinct(task) == len(baselines), F.avg("centered")).alias("chat_core"))


def any_correct(rows: DataFrame, task: str, problem: str, correct: str) -> DataFrame:
    """Share of problems with a correct sample."""
    return rows.groupBy(task, problem).agg(F.max(F.col(correct).cast("int")).alias("ok")).groupBy(task).agg(F.avg("ok").alias("accuracy"), F.count("*").alias("n"))


def pass_at_k(rows: DataFrame, problem: str, order: Sequence[str], correct: str, most: int) -> DataFrame:
    """(k, pass_rate) for k from 1 to ``most``: problems with a correct one among the first k samples."""
    place = F.row_number().over(Window.partitionBy(problem).orderBy(*order))
    first = rows.withColumn("__k", place).where(F.col("__k") <= most)
    hit = first.groupBy(problem).agg(F.min(F.when(F.col(correct), F.col("__k"))).alias("first"))
    ks = hit.select(F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"), "first")
    return ks.groupBy("k").agg(F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)).alias("pass_rate"), F.count("*").alias("problems"))


def bits_per_byte(rows: DataFrame, loss: str, size: str, target: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Loss in bits over bytes; tokens without bytes or with an ignored target count nothing, no bytes give infinity."""
    use = F.col(size) > 0
    if target is not None:
        use &= F.col(target) >= 0
    total, count = F.sum(F.when(use, F.col(loss)).otherwise(0.0)), F.sum(F.when(use, F.col(size)).otherwise(0))
    return rows.groupBy(*by).agg(F.when(F.coalesce(count, F.lit(0)) == 0, float("inf")).otherwise(total / (float(np.log(2)) * count)).alias("bpb"))


def advantages(rows: DataFrame, prompt: str, reward: str) -> DataFrame:
    return rows.withColumn("advantage", F.col(reward) - F.avg(reward).over(Window.partitionBy(prompt)))


def mean_reward(rows: DataFrame, prompt: str, reward: str) -> DataFrame:
    return rows.groupBy(prompt).agg(F.avg(reward).alias("m")).agg(F.avg("m").alias("mean_reward"))


def number_stats(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Least, most, mean and sample deviation of the values that aren't 0."""
    c = F.when(F.col(column) > 0, F.col(column))
    return rows.agg(F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_std"))


def compression(rows: DataFrame, by: str, size: str, tokens: str, base: str) -> DataFrame:
    """(by, ratio, base_ratio, diff_percent, better) of bytes to tokens, against another tokenizer."""
    out = rows.groupBy(by).agg((F.sum(size) / F.sum(tokens)).alias("ratio"), (F.sum(size) / F.sum(base)).alias("base_ratio"), ((F.sum(base) - F.sum(tokens)) / F.sum(base) * 100).alias("diff_percent"))
    return out.withColumn("better", F.when(F.col("ratio") > F.col("base_ratio"), "ours").when(F.col("ratio") < F.col("base_ratio"), "base").otherwise("tie"))


def smoothed(rows: DataFrame, by: str, order: str, value: str, beta: float = 0.9) -> DataFrame:
    """(by, order, value, ema): debiased exponential means along each series.

    A mean is a weighted running sum.  Series are cut into blocks over which the weights shrink by
    ``1e-10``, so sums within a block stay in range, and what three blocks before leave over is
    added; what older ones would add is below the precision of a double.
    """
    block = max(1, math.ceil(math.log(1e-10) / math.log(beta)))
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    d = rows.select(by, order, F.col(value).cast("double").alias(value), place.alias("__i"))
    d = d.withColumns({"__b": F.floor(F.col("__i") / block), "__k": F.col("__i") % block})
    run = Window.partitionBy(by, "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    own = F.pow(F.lit(beta), F.col("__k")) * F.sum(F.col(value) * (1 - beta) * F.pow(F.lit(beta), -F.col("__k"))).over(run)
    d = d.withColumn("__own", own)
    along, shrink = Window.partitionBy(by).orderBy("__b"), beta**block
    left = sum((F.coalesce(F.lag("__end", n).over(along), F.lit(0.0)) * shrink ** (n - 1) for n in (1, 2, 3)), F.lit(0.0))
    ends = d.groupBy(by, "__b").agg(F.max_by("__own", "__i").alias("__end")).select(by, "__b", left.alias("__left"))
    total = F.col("__own") + F.col("__left") * F.pow(F.lit(beta), F.col("__k") + 1)
    return d.join(ends, [by, "__b"]).select(by, order, value, (total / (1 - F.pow(F.lit(beta), F.col("__i") + 1))).alias("ema"))


def running_min(rows: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    frame = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_min", F.min(value).over(frame))


def line_fit(rows: DataFrame, x: Column, y: Column, by: Sequence[str] = ()) -> DataFrame:
    """Least squares line and R² of y over x."""
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def power_law(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Exponent and factor of y over x, in logarithms to base 10; values that aren't positive are left out."""
    rows = rows.where((F.col(x) > 0) & (F.col(y) > 0))
    return line_fit(rows, F.log10(x), F.log10(y), by).select(*by, F.col("slope").alias("exponent"), F.pow(F.lit(10.0), "intercept").alias("factor"), "r2")


def _with_means(rows: DataFrame, by: Sequence[str], *means: Column) -> DataFrame:
    """Rows beside their group's means: partial sums go through a shuffle, rows of one group don't meet in a task."""
    if not by:
        return rows.crossJoin(rows.agg(*means))  # one row
    side = rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(*means)
    met = F.lit(True)
    for c in by:
        met &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(side, met).drop(*(f"__{c}" for c in by))


def parabola(rows: DataFrame, x: Column, y: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, c, x_best, y_best): y = a x² + b x + c from the moments, about the mean of x, all combined before the shuffle.

    The best x is the vertex where the curve opens upward, else that of the row with the least y.
    Rows without x or y are left out.
    """
    d = rows.select(*by, x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    d = _with_means(d, by, F.avg("x").alias("m")).withColumn("u", F.col("x") - F.col("m"))
    u, yy = F.col("u"), F.col("y")
    s = d.groupBy(*by, "m").agg(F.count("*").alias("n"), *(F.sum(F.pow(u, F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)), *(F.sum(F.pow(u, F.lit(k)) * yy).alias(f"t{k}") for k in (0, 1, 2)), F.min_by("x", "y").alias("x_least"), F.min("y").alias("y_least"))
    # normal equations of u with sum(u) = 0
    det = F.col("n") * F.col("s2") * F.col("s4") - F.col("n") * F.col("s3") * F.col("s3") - F.pow(F.col("s2"), F.lit(3))
    a = (F.col("n") * F.col("s2") * F.col("t2") - F.col("n") * F.col("s3") * F.col("t1") - F.col("s2") * F.col("s2") * F.col("t0")) / det
    s = s.withColumn("a", a).withColumn("b0", (F.col("t1") - F.col("a") * F.col("s3")) / F.col("s2")).withColumn("c0", (F.col("t0") - F.col("a") * F.col("s2")) / F.col("n"))
    s = s.withColumn("b", F.col("b0") - 2 * F.col("a") * F.col("m")).withColumn("c", F.col("c0") - F.col("b0") * F.col("m") + F.col("a") * F.col("m") * F.col("m"))
    best = F.when(F.col("a") > 0, -F.col("b") / (2 * F.col("a"))).otherwise(F.col("x_least"))
    s = s.withColumn("x_best", best)
    return s.select(*by, "a", "b", "c", "x_best", F.when(F.col("a") > 0, F.col("a") * F.col("x_best") * F.col("x_best") + F.col("b") * F.col("x_best") + F.col("c")).otherwise(F.col("y_least")).alias("y_best"))


def interpolate(rows: DataFrame, by: str, x: str, y: str, at: DataFrame) -> DataFrame:
    """(by, value): y on the line between the neighbours of ``at`` (by, x0); the nearest end beyond them."""
    order = Window.partitionBy(by).orderBy(x)
    seg = rows.select(by, F.col(x).alias("x"), F.col(y).alias("y"), F.lead(x).over(order).alias("xn"), F.lead(y).over(order).alias("yn"), F.row_number().over(order).alias("k"))
    both = seg.join(at, by)
    hit = both.where((F.col("x0") < F.col("xn")) | F.col("xn").isNull()).where((F.col("x0") >= F.col("x")) | (F.col("k") == 1))
    inner = F.col("y") + (F.col("x0") - F.col("x")) / (F.col("xn") - F.col("x")) * (F.col("yn") - F.col("y"))
    return hit.select(by, F.when(F.col("x0") <= F.col("x"), F.col("y")).when(F.col("xn").isNull(), F.col("y")).otherwise(inner).alias("value"))


def ridge(rows: DataFrame, by: str, features: Sequence[str], target: str, penalty: float = 1.0) -> DataFrame:
    """(by, intercept, weights, r2): ridge regression whose intercept isn't penalised.

    Sums of products about the means are combined before the shuffle; only a row of them for each
    group is solved in Python.  Rows with a null among features and target are left out.
    """
    n, names = len(features), [*features, target]
    d = _with_means(rows.select(by, *(F.col(c).cast("double").alias(c) for c in names)).dropna(subset=names), [by], *(F.avg(c).alias(f"__m{k}") for k, c in enumerate(names)))
    off = [F.col(c) - F.col(f"__m{k}") for k, c in enumerate(names)]
    products = [F.sum(off[i] * off[j]) for i in range(n + 1) for j in range(n + 1)]
    sums = d.groupBy(by).agg(F.array(*(F.first(f"__m{k}") for k in range(n + 1))).alias("means"), F.array(*products).alias("products"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, means, flat in zip(pdf[by], pdf["means"], pdf["products"], strict=True):
                s, m = np.array(flat).reshape(n + 1, n + 1), np.array(means)
                w = np.linalg.solve(s[:n, :n] + penalty * np.eye(n), s[:n, n])
                rest = s[n, n] - 2 * w @ s[:n, n] + w @ s[:n, :n] @ w
                out.append((key, m[n] - m[:n] @ w, w.tolist(), 1 - rest / s[n, n] if s[n, n] else None))
            yield pd.DataFrame(out, columns=[by, "intercept", "weights", "r2"])

    return sums.mapInPandas(solve, f"{by} {dict(rows.dtypes)[by]}, intercept double, weights array<double>, r2 double")


def first_known(rows: DataFrame, by: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The first value that isn't null of each column of each group."""
    key = F.struct(*order)
    return rows.groupBy(by).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in columns))


def metric_table(rows: DataFrame, metric: str, stage: str, stages: Sequence[str], value: str) -> DataFrame:
    """A metric a row, a stage a column."""
    return rows.groupBy(metric).pivot(stage, list(stages)).agg(F.first(value))


def report(sections: Sequence[tuple[str, DataFrame]], summary: DataFrame, metric: str, stages: Sequence[str]) -> DataFrame:
    """(line): titled sections of (key, value) rows, then a table with a metric a row and a stage a column, '-' where there is none."""
    parts = [rows.select(F.lit(k).alias("a"), F.monotonically_increasing_id().alias("b"), F.format_string("- %s: %s", F.col("key"), F.coalesce(F.col("value").cast("string"), F.lit("-"))).alias("line")) for k, (_, rows) in enumerate(sections)]
    spark = summary.sparkSession
    heads = [(k, -1, f"## {title}") for k, (title, _) in enumerate(sections)]
    heads += [(len(sections), -3, "## Summary"), (len(sections), -2, "| Metric | " + " | ".join(stages) + " |"), (len(sections), -1, "|" + "---|" * (len(stages) + 1))]
    cells = [F.when(F.col(s).isNull(), "-").otherwise(shown(F.col(s))) for s in stages]
    table = summary.select(F.lit(len(sections)).alias("a"), F.row_number().over(Window.orderBy(metric)).cast("long").alias("b"), F.concat(F.lit("| "), F.concat_ws(" | ", F.col(metric), *cells), F.lit(" |")).alias("line"))
    out = spark.createDataFrame(heads, "a int, b long, line string")
    for part in [*parts, table]:
        out = out.unionByName(part)
    return out.orderBy("a", "b").select("line")


def shown(value: Column, integer: bool = False) -> Column:
    """Numbers as reports show them: integers from 10,000 on with commas, others with four places."""
    return F.when(value >= 10_000, F.format_number(value, 0)).otherwise(value.cast("string")) if integer else F.format_string("%.4f", value.cast("double"))


def slugify(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("-"))


def result_lines(acc: DataFrame, task: str = "task") -> DataFrame:
    """(place, line) of a result file: padded columns, and the mean as a last line."""
    detail = acc.select(F.lit(0).alias("last"), F.col(task).alias("name"), "accuracy", "centered")
    total = acc.agg(F.lit(1).alias("last"), F.lit("CORE").alias("name"), F.lit(None).cast("double").alias("accuracy"), F.avg("centered").alias("centered"))
    line = F.format_string("%-35s, %-10s, %-10s", F.col("name"), F.coalesce(F.format_string("%.6f", "accuracy"), F.lit("")), F.format_string("%.6f", "centered"))
    return detail.union(total).select("last", "name", F.when(F.col("last") == 1, F.format_string("%-35s, %-10s, %-10s", F.lit("CORE"), F.lit(""), F.format_string("%.6f", "centered"))).otherwise(line).alias("line"))


def bloat(files: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Files, lines, characters and about how many tokens of files (path, content) with these suffixes."""
    rows = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))
    lines = F.size(F.split("content", "\n", -1))
    return rows.agg(F.count("*").alias("files"), F.sum(lines).alias("lines"), F.sum(F.length("content")).alias("chars"), F.floor(F.sum(F.length("content")) / 4).alias("tokens"))


def cost(rate: Column, count: Column, hours: Column) -> Column:
    return rate * count * hours


def clock(seconds: Column) -> Column:
    return F.format_string("%dh%dm", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60))


def last_values(lines: DataFrame, keys: dict[str, str]) -> DataFrame:
    """One row of the last match of each pattern's first group in log lines (line_no, value), commas left out."""
    hit = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    return lines.agg(*(F.replace(F.max_by(hit(p), F.when(hit(p).isNotNull(), F.col("line_no"))), F.lit(","), F.lit("")).alias(k) for k, p in keys.items()))


def report_value(lines: DataFrame, key: str) -> DataFrame:
    """What stands after the colon in the last line that contains ``key``."""
    rows = lines.where(F.col("value").contains(key))
    return rows.agg(F.trim(F.split_part(F.max_by("value", "line_no"), F.lit(":"), F.lit(2))).alias("value"))


def sweep_grid(budgets: DataFrame, depths: DataFrame, done: DataFrame) -> DataFrame:
    """Budgets and depths, two short lists, without the runs that are there already."""
    return budgets.crossJoin(depths).join(done, ["budget", "depth"], "left_anti")


def best_tag(rows: DataFrame, tag: str = "tag", step: str = "step") -> DataFrame:
    """(tag, steps, last_step) of checkpoints, and which tag has the largest number in its name."""
    per = rows.groupBy(tag).agg(F.count("*").alias("steps"), F.max(step).alias("last_step"))
    number = F.regexp_extract(F.col(tag), r"(\d+)", 1).cast("int")
    return per.withColumn("largest", F.coalesce(number == F.max(number).over(Window.partitionBy()), F.lit(False)))


def resolve_label(rows: DataFrame, label: str, column: str = "label") -> str:
    """The exact label, else the only one that contains it; anything else is an error."""
    if rows.where(F.col(column) == label).limit(1).count():
        return label
    near = [r[0] for r in rows.where(F.lower(column).contains(label.lower())).select(column).distinct().limit(2).collect()]
    if len(near) != 1:
        raise ValueError(f"{label!r} names {'several' if near else 'no'} tasks")
    return near[0]


def size_table(measured: DataFrame, estimated: DataFrame) -> DataFrame:
    """(name, params, score, delta, percent): both kinds by size, each against the one before."""
    rows = measured.withColumn("kind", F.lit("measured")).unionByName(estimated.withColumn("kind", F.lit("estimated")))
    before = F.lag("score").over(Window.orderBy("params", "name"))
    return rows.select("name", "kind", "params", "score", (F.col("score") - before).alias("delta"), ((F.col("score") - before) / before * 100).alias("percent"))
