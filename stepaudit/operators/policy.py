"""Confusion counts, rates, the threshold gate, coverage and class reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The thresholds that may be chosen, the least flags, the width of a tie.
THRESHOLDS = [0.50, 0.60, 0.70, 0.80, 0.90, 0.95]
LEAST_FLAGS = 20
TIE = 1e-6


def share(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion(predicted: Column, label: Column) -> list[Column]:
    """``tp, fp, fn, tn``; label -1 is the one to flag."""
    bad = label == -1
    tests = {"tp": predicted & bad, "fp": predicted & ~bad, "fn": ~predicted & bad, "tn": ~predicted & ~bad}
    return [F.count_if(t).alias(k) for k, t in tests.items()]


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def exceeds(score: Column, threshold: Column) -> Column:
    """The product's rule: above the threshold and no tie; null and NaN never."""
    return F.coalesce(~F.isnan(score) & (score > threshold) & (F.abs(score - threshold) > TIE), F.lit(False))


def invalid_rows(samples: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Rows that the gate must refuse, with ``reason``: another split, an unknown group, label or score."""
    score = F.col("score")
    reason = (
        F.when(~F.col("split").eqNullSafe("validation"), "not-validation")
        .when(~F.coalesce(F.col("label").isin(-1, 0, 1), F.lit(False)), "label").when(F.col("rule").isNull(), "rule")
        .when(F.isnan(score) | (score < 0) | (score > 1), "score")
    )
    if groups is not None:
        frozen = groups.select(F.col("grp").alias("__g")).distinct()
        samples = samples.join(frozen, F.col("grp") == F.col("__g"), "left")
        reason = F.coalesce(reason, F.when(F.col("__g").isNull(), "unknown-group"))
    return samples.withColumn("reason", reason).where("reason IS NOT NULL").drop("__g")


def gate(samples: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row for each threshold: the model's and the combined counts, ``eligible`` and ``selected``.

    ``samples`` has ``split, grp, subset, label, rule, score``; any row but a valid one of the
    validation split makes it raise (see :func:`invalid_rows`), as does an empty table. One
    aggregation by subset of fixed width counts every policy; only rows by subset are compared with
    the rules' false positives.
    """
    if (bad := invalid_rows(samples, groups).select("reason").first()) is not None:
        raise ValueError(f"only valid validation rows of frozen groups may choose a threshold: {bad.reason}")
    if samples.isEmpty():
        raise ValueError("there are no validation rows")
    subsets = policies(samples)
    sums = [F.sum(c).alias(c) for c in subsets.columns if c not in ("threshold", "subset")]
    fits = F.every((F.col("model_fp") <= F.col("rules_fp")) & (F.col("both_fp") <= F.col("rules_fp"))).alias("fits")
    total = subsets.groupBy("threshold").agg(*sums, fits)
    ok = F.col("fits") & (F.col("model_tp") + F.col("model_fp") >= LEAST_FLAGS)
    for m in ("model", "both"):
        ok &= (F.col(f"{m}_fp") <= F.col("rules_fp")) & (F.col(f"{m}_neutral") <= F.col("rules_neutral"))
    made = total.withColumns({"eligible": ok, "model_recall": share(F.col("model_tp"), F.col("bad"))})
    best = made.where("eligible").agg(F.max(F.struct("model_recall", "threshold")).alias("best"))  # one row
    return made.crossJoin(F.broadcast(best)).withColumn("selected", F.coalesce(F.col("threshold") == F.col("best.threshold"), F.lit(False))).select(
        "threshold", "rules_tp", "rules_fp", "model_tp", "model_fp", "model_neutral", "both_tp", "both_fp", "both_neutral", "model_recall", "eligible", "selected"
    )


def policies(samples: DataFrame) -> DataFrame:
    """Counts by threshold and subset of the policies rules, model and both: tp, fp, neutral and positive fp."""
    at = F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold")
    counted = [F.count_if(F.lit(True)).alias("n")]
    base, by = F.col("rule"), samples.select("subset", "label", "rule", "score", at).withColumn("model", exceeds(F.col("score"), F.col("threshold")))
    for name, flag in (("rules", base), ("model", F.col("model")), ("both", base | F.col("model"))):
        counted += [
            F.count_if(flag & (F.col("label") == -1)).alias(f"{name}_tp"), F.count_if(flag & (F.col("label") != -1)).alias(f"{name}_fp"),
            F.count_if(flag & (F.col("label") == 0)).alias(f"{name}_neutral"), F.count_if(flag & (F.col("label") == 1)).alias(f"{name}_positive"),
        ]
    counted.append(F.count_if(F.col("label") == -1).alias("bad"))
    return by.groupBy("threshold", "subset").agg(*counted)


def baselines(samples: DataFrame) -> DataFrame:
    """Confusion and rates of the policies that need no model: ``rules`` and ``never_flag``."""
    made = samples.select("label", F.explode(F.array(F.struct(F.lit("rules").alias("policy"), F.coalesce("rule", F.lit(False)).alias("flag")),
                                                     F.struct(F.lit("never_flag").alias("policy"), F.lit(False).alias("flag")))).alias("x")).select("label", "x.*")
    return with_rates(made.groupBy("policy").agg(*confusion(F.col("flag"), F.col("label"))))


def measure(samples: DataFrame, predicted: Column) -> DataFrame:
    """``mask, part, steps, flags, false_positives, false_positive_rate`` of neutral, positive and every subset.

    The rate is null where a mask has no row that should stay unflagged.
    """
    flag, bad = F.coalesce(predicted, F.lit(False)), F.col("label") == -1
    aggs = [
        F.count("*").alias("steps"), F.count_if(flag).alias("flags"), F.count_if(flag & ~bad).alias("false_positives"),
        F.try_divide(F.count_if(flag & ~bad).cast("double"), F.count_if(~bad).cast("double")).alias("false_positive_rate"),
    ]
    masks = F.array_compact(F.array(
        F.when(F.col("label") == 0, F.struct(F.lit("label").alias("mask"), F.lit("neutral").alias("part"))),
        F.when(F.col("label") == 1, F.struct(F.lit("label").alias("mask"), F.lit("positive").alias("part"))),
        F.struct(F.lit("subset").alias("mask"), F.col("subset").alias("part")),
    ))
    return samples.withColumn("m", F.explode(masks)).groupBy("m.mask", "m.part").agg(*aggs)


def filled_confusion(samples: DataFrame, groups: DataFrame, predicted: Column) -> DataFrame:
    """Confusion and rates of every frozen group, zeros for those without a sample."""
    counts = samples.groupBy("grp").agg(*confusion(F.coalesce(predicted, F.lit(False)), F.col("label")))
    every = groups.select("grp").distinct().join(counts, "grp", "left")
    return with_rates(every.na.fill(0, ["tp", "fp", "fn", "tn"]))


def first_errors(samples: DataFrame, order: list[str], predicted: Column, n: int = 12) -> DataFrame:
    """The first ``n`` samples, in ``order``, whose prediction is wrong, with ``prediction``."""
    flag = F.coalesce(predicted, F.lit(False))
    wrong = samples.where(flag != (F.col("label") == -1))
    return wrong.withColumn("prediction", F.when(flag, "flag").otherwise("no_flag")).orderBy(*order).limit(n)


def label_counts(samples: DataFrame) -> DataFrame:
    """``what, part, n``: labels (in numeric order), splits and reasons, each counted."""
    parts = F.array_compact(F.array(
        F.struct(F.lit("label").alias("what"), F.col("label").cast("string").alias("part")), F.struct(F.lit("split").alias("what"), F.col("split").alias("part")),
        F.when(F.col("support_reason").isNotNull(), F.struct(F.lit("reason").alias("what"), F.col("support_reason").alias("part"))),
    ))
    return samples.select(F.explode(parts).alias("x")).groupBy("x.what", "x.part").agg(F.count("*").alias("n")).orderBy("what", F.expr("try_cast(part AS INT)"), "part")


def report_totals(report: DataFrame) -> DataFrame:
    """``average, precision, recall, f1, support`` of a class report: macro and weighted means."""
    n, w = F.col("support"), F.sum("support")
    made = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")] + [share(F.sum(F.col(c) * n), w).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    one = report.agg(*made, w.alias("support"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("average"), *[F.col(f"{a}_{c}").alias(c) for c in ("precision", "recall", "f1")], "support") for a in ("macro", "weighted")])).alias("x")).select("x.*")


def accuracy(samples: DataFrame) -> DataFrame:
    """``accuracy, support`` over all samples with a prediction."""
    return samples.agg(share(F.count_if(F.col("label") == F.col("predicted")), F.count("*")).alias("accuracy"), F.count("*").alias("support"))


def coverage(samples: DataFrame) -> DataFrame:
    """Steps, groups, supported and unsupported ones by split, label and subset, and their totals.

    Built as grouping sets; ``label`` and ``subset`` are null in totals. A group with samples of both
    kinds counts on both sides.
    """
    sets = [["split"], ["split", "label"], ["split", "subset"], ["split", "label", "subset"]]
    cols = [F.col(c) for c in ("split", "label", "subset")]
    supported = F.col("support_reason").isNull()
    return samples.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.count("*").alias("steps"), F.count_distinct("grp").alias("groups"), F.count_if(supported).alias("supported"),
        F.count_distinct(F.when(supported, F.col("grp"))).alias("supported_groups"),
        F.count_if(~supported).alias("unsupported"), F.count_distinct(F.when(~supported, F.col("grp"))).alias("unsupported_groups"),
    )


def full_coverage(samples: DataFrame, labels: list[int] | None = None) -> DataFrame:
    """:func:`coverage` with ``reasons`` (a map of the unsupported ones' counts, in their order) and zeros for labels without a sample."""
    sets = [["split"], ["split", "label"], ["split", "subset"], ["split", "label", "subset"]]
    cols = ("split", "label", "subset")
    by = samples.where("support_reason IS NOT NULL").groupingSets([[F.col(c) for c in s] + [F.col("support_reason")] for s in sets], *map(F.col, cols), F.col("support_reason")).agg(F.count("*").alias("n"))
    told = by.groupBy(*cols).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("support_reason", "n")))).alias("reasons"))  # a few reasons a cell
    made = coverage(samples)
    every = F.array(*[F.lit(x) for x in (None, *(labels or [-1, 0, 1]))]).cast("array<int>")
    cells = samples.groupingSets([[F.col("split")], [F.col("split"), F.col("subset")]], F.col("split"), F.col("subset")).agg(F.count("*").alias("n")).select(F.col("split").alias("__s"), F.col("subset").alias("__u"), F.explode(every).alias("__l"))
    told = told.select(*[F.col(c).alias(f"__{c}") for c in cols], "reasons")
    own = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("__s", "split"), ("__l", "label"), ("__u", "subset"))]
    why = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("__s", "__split"), ("__l", "__label"), ("__u", "__subset"))]
    none = F.create_map().cast("map<string,bigint>")
    return cells.join(made, own, "left").join(told, why, "left").select(
        F.col("__s").alias("split"), F.col("__l").alias("label"), F.col("__u").alias("subset"), *[F.coalesce(c, F.lit(0)).alias(c) for c in made.columns[3:]], F.coalesce("reasons", none).alias("reasons")
    )


def class_report(samples: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class of ``label`` against ``predicted``."""
    pairs = samples.select(F.explode(F.array(F.struct(F.col("label").alias("class"), F.lit(True).alias("own"), (F.col("label") == F.col("predicted")).alias("hit")),
                                             F.struct(F.col("predicted").alias("class"), F.lit(False).alias("own"), F.lit(False).alias("hit")))).alias("x")).select("x.*")
    by = pairs.groupBy("class").agg(F.count_if("own").alias("support"), F.count_if(~F.col("own")).alias("predicted"), F.count_if("hit").alias("hits"))
    p, r = share(F.col("hits"), F.col("predicted")), share(F.col("hits"), F.col("support"))
    return by.select("class", "support", p.alias("precision"), r.alias("recall"), share(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"))
