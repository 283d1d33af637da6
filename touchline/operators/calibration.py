"""Temperature calibration and reliability of probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS, LOW, SPAN, LEAST = 50, 0.5, 2.0, 200


def tempered(p: Column, t: Column) -> Column:
    """p ** (1 / t), p kept off 0 and 1."""
    return F.exp(F.ln(F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))) / t)


def by_class(results: DataFrame, *kept: str) -> DataFrame:
    """(class, p, hit) for home, draw and away of each result with probabilities and an outcome, beside ``kept``."""
    entries = F.array(*(F.struct(F.lit(c).alias("class"), F.col(n).alias("p"), (F.col("actual_1x2") == c).alias("hit")) for c, n in zip("HDA", ("prob_home", "prob_draw", "prob_away"), strict=True)))
    ok = F.col("actual_1x2").isin("H", "D", "A") & F.col("prob_home").isNotNull() & F.col("prob_draw").isNotNull() & F.col("prob_away").isNotNull()
    return results.filter(ok).select(*kept, F.inline(entries))


GRID = [round(LOW + SPAN * i / STEPS, 3) for i in range(STEPS + 1)]


def _loss(t: float) -> Column:
    """Cross-entropy of one probability at a temperature."""
    q = F.col("p") if t == 1.0 else tempered(F.col("p"), F.lit(t))
    q = F.least(F.greatest(q, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.when(F.col("hit"), -F.ln(q)).otherwise(-F.ln(1 - q))


def fit_temperatures(results: DataFrame) -> DataFrame:
    """For each class the temperature of least cross-entropy among 51; 1.0 below 200 samples.

    The 51 losses are sums in one aggregation, so no row is multiplied by the grid.
    """
    grid = GRID
    loss = lambda t: F.round(F.avg(_loss(t)), 9)
    sums = by_class(results).groupBy("class").agg(F.count("*").alias("n"), F.array(*(F.struct(loss(t).alias("loss"), F.lit(t).alias("t")) for t in grid)).alias("losses"))
    best = F.array_min("losses")
    return sums.select("class", F.col("n").alias("n_samples"), F.when(F.col("n") < LEAST, F.lit(1.0)).otherwise(best["t"]).alias("temperature"), F.round(best["loss"], 6).alias("loss"))


def reliability(results: DataFrame, buckets: int = 10) -> DataFrame:
    """Mean probability and hit rate in equally wide ranges of the probability."""
    bucket = F.least(F.floor(F.col("p") * buckets), F.lit(buckets - 1)).cast("int")
    grouped = by_class(results).groupBy("class", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("hit").cast("double")).alias("rate"))
    return grouped.select("class", "bucket", F.round((F.col("bucket") + 0.5) / buckets, 3).alias("mid"), "n", F.round("mean_p", 4).alias("mean_p"), F.round("rate", 4).alias("hit_rate"), F.round(F.col("rate") - F.col("mean_p"), 4).alias("gap"))


def calibrated(p: tuple[Column, Column, Column], t: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    """Tempered and normalised to four digits; the rest of the rounding goes to the largest."""
    q = [F.when(b == 1.0, a).otherwise(tempered(a, b)) for a, b in zip(p, t, strict=True)]
    total = q[0] + q[1] + q[2]
    r = [F.bround(x / total, 4) for x in q]
    rest = F.bround(1 - (r[0] + r[1] + r[2]), 4)
    first = (r[0] >= r[1]) & (r[0] >= r[2])
    second = ~first & (r[1] >= r[2])
    return tuple(F.bround(x + F.when(c, rest).otherwise(0.0), 4) for x, c in zip(r, (first, second, ~first & ~second), strict=True))


#: No calibration: what holds before there are samples enough.
IDENTITY = {"t_home": 1.0, "t_draw": 1.0, "t_away": 1.0, "n_samples": 0, "version": "identity", "is_identity": True}
CLASSES = {"H": "home", "D": "draw", "A": "away"}


def identity(version: str = "identity") -> Column:
    """The identity calibration as a struct."""
    return F.struct(*(F.lit(v if k != "version" else version).alias(k) for k, v in IDENTITY.items()))


def walk_forward(results: DataFrame, period: str = "season", least: int = LEAST, version: str = "auto") -> DataFrame:
    """A calibration for each period, fitted on all periods before it: period, t_home, t_draw, t_away, n_samples, version, is_identity.

    One aggregation gives each period's count and its 51 sums of losses for each class; running sums over the
    periods, of which there are few, give the losses of all earlier results, so no result is read twice.
    """
    entries = by_class(results.withColumn("_period", F.col(period)), "_period")
    sums = entries.groupBy("_period", "class").agg(F.count("*").alias("n"), *(F.sum(_loss(t)).alias(f"l{i}") for i, t in enumerate(GRID)))
    # periods without any usable result are there too, or a later one would miss its calibration
    every = results.select(F.col(period).alias("_period")).distinct().withColumn("class", F.explode(F.array(*map(F.lit, CLASSES))))
    sums = sums.withColumnsRenamed({"_period": "_p", "class": "_c"})
    full = every.join(sums, F.col("_period").eqNullSafe(F.col("_p")) & (F.col("class") == F.col("_c")), "left")
    w = Window.partitionBy("class").orderBy(F.asc_nulls_first("_period")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    run = full.select("_period", "class", earlier("n").alias("n"), F.array(*(F.struct(earlier(f"l{i}").cast("double").alias("loss"), F.lit(t).alias("t")) for i, t in enumerate(GRID))).alias("losses"))
    enough = F.col("n") >= least
    mean = F.transform("losses", lambda x: F.struct(F.round(x["loss"] / F.col("n"), 9).alias("loss"), x["t"].alias("t")))
    best = run.select("_period", "class", "n", F.when(enough, F.array_min(F.when(enough, mean))["t"]).otherwise(1.0).alias("t"))
    wide = best.groupBy("_period").agg(*(F.max(F.when(F.col("class") == c, F.col("t"))).alias(f"t_{n}") for c, n in CLASSES.items()), F.max("n").alias("n"))
    few = F.col("n") < least
    same = (F.col("t_home") == 1.0) & (F.col("t_draw") == 1.0) & (F.col("t_away") == 1.0)
    return wide.select(
        F.col("_period").alias(period), "t_home", "t_draw", "t_away", F.when(few, F.lit(0)).otherwise(F.col("n")).cast("long").alias("n_samples"),
        F.when(few, IDENTITY["version"]).otherwise(version).alias("version"), (few | same).alias("is_identity"),
    )


def apply_calibration(results: DataFrame, calibrations: DataFrame, period: str = "season") -> DataFrame:
    """Results with cal_home, cal_draw and cal_away by their period's calibration, and its version.

    A result without all three probabilities has none calibrated; the identity leaves them as they are, and so
    does a period without a calibration.  ``calibrations`` has a row for each period, which is what makes it small.
    """
    names = ("prob_home", "prob_draw", "prob_away")
    own = calibrations.select(F.col(period).alias("_of"), "t_home", "t_draw", "t_away", F.col("version").alias("calibration"), "is_identity")
    out = results.join(own, F.col(period).eqNullSafe(F.col("_of")), "left").withColumn("calibration", F.coalesce("calibration", F.lit(IDENTITY["version"])))
    p, t = tuple(F.col(n) for n in names), tuple(F.col(f"t_{n}") for n in ("home", "draw", "away"))
    whole = p[0].isNotNull() & p[1].isNotNull() & p[2].isNotNull()
    plain = F.coalesce("is_identity", F.lit(True))
    new = {f"cal_{n[5:]}": F.when(whole, F.when(plain, F.col(n)).otherwise(c)) for n, c in zip(names, calibrated(p, t), strict=True)}
    return out.withColumns(new).select(*results.columns, *new, "calibration")
