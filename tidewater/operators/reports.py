"""Analyses that put several operators together: calibration quality, captions, coverage, courses of correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages
from . import aggregates, arrays, intervals, labels, models, sequence, stats, triggers, vectors
from .quantiles import exact_quantiles


def audit_session(raw: DataFrame, session: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counts of each code before and after the repair with flags, and the checks of all trials of the repaired stream."""
    mended = triggers.repair(raw, session, order)
    return triggers.audit(triggers.code_counts(raw, mended, "code", [session]), session), triggers.check_trials(triggers.segments(mended, session, order), session, order)


def calibration_events(rows: DataFrame, trials: DataFrame, by: list[str], time: str, text: str, bucket: float = 86400.0) -> DataFrame:
    """Validation and drift messages as events with the trial that follows (strictly later) and its block of 14."""
    v, d = messages.validation(F.col(text)), messages.drift(F.col(text))
    told = rows.select(*by, time, v.alias("v"), d.alias("d")).where("v is not null or d is not null")
    told = told.select(*by, time, F.when(F.col("v").isNotNull(), "validation").otherwise("drift").alias("event_type"), F.col("v.quality").alias("quality"), F.coalesce("v.avg_error", "d.offset_deg").alias("error_deg"), F.col("v.max_error").alias("max_error_deg"), F.col("d.offset_pix").alias("offset_pix"))
    out = intervals.asof(told, trials, by, time, ["trial"], forward=True, strict=True, bucket=bucket)
    return out.withColumn("block", F.floor((F.col("trial") - 1) / 14) + 1)


def calibration_summary(events: DataFrame, by: list[str], bound: float = 1.0) -> DataFrame:
    """By group: validations, drifts, mean and greatest error, how many are beyond ``bound``, counts of the qualities, flags."""
    is_v, is_d = F.col("event_type") == "validation", F.col("event_type") == "drift"
    out = events.groupBy(*by).agg(
        F.count_if(is_v).alias("validations"), F.count_if(is_d).alias("drifts"), F.avg("error_deg").alias("mean_error"), F.max("error_deg").alias("most_error"), F.count_if(F.col("error_deg") > bound).alias("beyond"),
        *[F.count_if(F.col("quality") == q).alias(q.lower()) for q in messages.QUALITIES],
    )
    return aggregates.flags(out, {"no_validation": F.col("validations") == 0, "poor_validation": F.col("poor") > 0, "large_error": F.col("beyond") > 0})


def rating_report(df: DataFrame, rater: str, label: str, labels_: list[str]) -> DataFrame:
    """label, mean and standard deviation over raters of each label's count and share in percent; labels that a rater never
    gave count as 0."""
    n = F.count("*")
    each = df.groupBy(rater).agg(n.alias("n"), *[F.count_if(F.col(label) == v).alias(v) for v in labels_])
    long = each.unpivot([rater, "n"], labels_, label, "count").withColumn("percent", 100 * F.col("count") / F.col("n"))
    return long.groupBy(label).agg(F.count("*").alias("raters"), F.avg("count").alias("mean_count"), F.stddev_samp("count").alias("sd_count"), F.avg("percent").alias("mean_percent"), F.stddev_samp("percent").alias("sd_percent"))


def assignment_report(samples: DataFrame, scene: str, trial: str) -> DataFrame:
    """One row: samples, those with a scene, their share in percent, distinct scenes, mean samples of a trial, least and most."""
    per = samples.where(F.col(scene).isNotNull()).groupBy(trial).agg(F.count("*").alias("c")).agg(F.avg("c").alias("mean_trial"), F.min("c").alias("least_trial"), F.max("c").alias("most_trial"))
    n = F.count("*")
    return samples.agg(n.alias("samples"), F.count(scene).alias("assigned"), (100 * F.count(scene) / n).alias("percent"), F.count_distinct(scene).alias("scenes")).crossJoin(F.broadcast(per))


def kind_coverage(df: DataFrame, by: list[str], class_id: str, area: str) -> DataFrame:
    """by, kind (thing, stuff, ...), n, the share of rows and of area in percent."""
    out = df.withColumn("kind", labels.kind(F.col(class_id))).groupBy(*by, "kind").agg(F.count("*").alias("n"), F.sum(area).alias("__a"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # kinds are four
    return out.withColumns({"percent": 100 * F.col("n") / F.sum("n").over(w), "area_percent": 100 * F.col("__a") / F.sum("__a").over(w)}).drop("__a")


def caption_agreement(df: DataFrame, scene: str, own: Column, key: str, array: str) -> DataFrame:
    """scene, own_mean (cosines of a scene's own captions with all others of it) and rest_mean (of the others with each
    other). Scenes have a few captions each (``vectors.MOST_OF_GROUP``)."""
    vectors.few_of_group(df, [scene], vectors.MOST_OF_GROUP)
    a = df.select(scene, F.col(key).alias("__i"), own.alias("__o"), F.col(array).alias("__a"))
    b = df.select(scene, F.col(key).alias("__j"), own.alias("__p"), F.col(array).alias("__b"))
    pairs = a.join(b, scene).where("__i < __j").withColumn("__c", vectors.cosine(F.col("__a"), F.col("__b")))
    mixed = F.col("__o") != F.col("__p")
    return pairs.groupBy(scene).agg(F.avg(F.when(mixed, F.col("__c"))).alias("own_mean"), F.avg(F.when(~F.col("__o") & ~F.col("__p"), F.col("__c"))).alias("rest_mean"))


def features(df: DataFrame, x: str, low: int, high: int, every: int = 1, name: str = "features") -> DataFrame:
    """A window of a trace, every so many elements, as features."""
    cut = arrays.window(F.col(x), low, high)
    return df.withColumn(name, F.filter(cut, lambda _, i: i % every == 0) if every > 1 else cut)


def encoding(df: DataFrame, key: str, x: str, y: str, fold: str, test_fold: int, share: float = 0.7, alphas: tuple[float, ...] = models.ALPHAS) -> DataFrame:
    """Typical rows only, x on the axes that hold ``share`` of its variance outside of the test fold, then a ridge regression
    of each target."""
    some = stats.typical(df, key, y)
    mean, axes = models.principal_axes(some.where(F.col(fold) != test_fold), x, share)
    return models.encode(some.withColumn("__z", models.projected(F.col(x), mean, axes)), "__z", y, fold, test_fold, alphas)


def similarity_course(df: DataFrame, by: list[str], label: str, x: str, model: DataFrame, width: int, least: int = 1) -> DataFrame:
    """by, t, rho, n: medians of each label's traces, their dissimilarities in stretches of ``width`` elements, and the rank
    correlation of each stretch's matrix with the model's."""
    parts = df.select(*by, label, F.posexplode(x).alias("__pos", "__v"))
    medians = exact_quantiles(parts, "__v", [0.5], [*by, label, "__pos"], count="__n").withColumn("__v", F.col("__q")[0]).where(F.col("__n") >= least)
    cut = medians.groupBy(*by, F.floor(F.col("__pos") / width).alias("t"), label).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__v"))), lambda s: s["__v"]).alias("__x"))
    return vectors.matrix_correlation(vectors.dissimilarity(cut, label, "__x", [*by, "t"]), model, [*by, "t"])


def head_movement(df: DataFrame, by: list[str], run: list[str], order: list[str], axes: list[str], fit: str) -> DataFrame:
    """By run of each group: rows, mean and greatest distance from its begin, and standard deviations of well-fitted rows."""
    moved = sequence.displacement(df, [*by, *run], order, axes, "__d")
    far = moved.groupBy(*by, *run).agg(F.count("*").alias("rows"), F.avg("__d").alias("mean_distance"), F.max("__d").alias("most_distance"))
    return far.join(sequence.stability(df, [*by, *run], axes, fit).drop("n"), [*by, *run], "left")


def accuracy_by_frequency(accuracies: DataFrame, counts: DataFrame, label: str, accuracy: str, n: str) -> DataFrame:
    """One row: rank correlation of labels' accuracies with how frequent they are."""
    return vectors.spearman(accuracies.select(label, accuracy).join(counts.select(label, n), label), accuracy, n)


def agreement_by_subject(df: DataFrame, subject: str, scene: str, own: Column, key: str, array: str) -> DataFrame:
    """subject, scenes, own_mean and rest_mean (means over the subject's scenes), difference: how a subject's captions agree with
    those of others, and others with each other."""
    each = caption_agreement(df, scene, own, key, array)
    of = df.where(own).select(subject, scene).distinct().join(each, scene)
    return of.groupBy(subject).agg(F.count("*").alias("scenes"), F.avg("own_mean").alias("own_mean"), F.avg("rest_mean").alias("rest_mean"), F.avg(F.col("own_mean") - F.col("rest_mean")).alias("difference"))


def recording_statistics(events: DataFrame, movement: DataFrame, by: list[str], kind: str, run: list[str], order: list[str], axes: list[str], first: int = 100) -> DataFrame:
    """by: numbers of events of each kind (a map), runs and how far apart they begin on each axis; groups that lack one of the two have nulls."""
    counts = events.groupBy(*by, kind).agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("events"))  # kinds are few
    return counts.join(sequence.repositioning(movement, by, run, order, axes, first), by, "full_outer")


def median_centred(df: DataFrame, by: list[str], array: str) -> DataFrame:
    """Traces less the elementwise median of their group."""
    middle = aggregates.elementwise_median(df, by, array).drop("n").withColumnRenamed(array, "__m")
    return df.join(middle, by).withColumn(array, F.zip_with(F.col(array).cast("array<double>"), "__m", lambda a, b: a - b)).drop("__m")
