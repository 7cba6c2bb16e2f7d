"""Features of epochs: moments, spectra by Parseval, peaks, motion and temperature, as plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import ratio
from pulsegrid.functions.ordered import BLOCK, with_neighbours
from pulsegrid.operators.series import KEYS, STREAM

EPOCH = [*KEYS, "epoch"]


def _powers(v: Column) -> list[Column]:
    varies = F.max(v) > F.min(v)
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.when(varies, F.skewness(v)).alias("skew"), F.when(varies, F.kurtosis(v)).alias("kurt")]


def moments(epochs: DataFrame, keys: list[str] = EPOCH) -> DataFrame:
    """Mean, population deviation, extremes, and population skewness and excess kurtosis per epoch and channel; skewness
    and kurtosis are null where the epoch does not vary."""
    v = F.col("value")
    return epochs.groupBy(*keys).agg(*_powers(v))


def sample_moments(epochs: DataFrame, keys: list[str] = EPOCH) -> DataFrame:
    """As `moments`, with skewness and kurtosis corrected for the sample size: null below 3 and 4 readings."""
    m = moments(epochs, keys)
    n = F.col("n").cast("double")
    skew = F.when(F.col("n") >= 3, F.col("skew") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(F.col("n") >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("kurt") + 6))
    return m.withColumn("skew", skew).withColumn("kurt", kurt)


def mean_power(epochs: DataFrame, keys: list[str] = EPOCH) -> DataFrame:
    """Mean power over the bins of the one-sided spectrum, by Parseval's identity: sums only, no transform.

    The index of a reading in its epoch decides the alternating sum that an even length needs."""
    v, i = F.col("value"), F.col("index")
    n, s, q, alt = F.count(v).cast("double"), F.sum(v), F.sum(v * v), F.sum(F.when(F.pmod(i, F.lit(2)) == 0, v).otherwise(-v))
    nyquist = F.when(F.pmod(n, F.lit(2.0)) == 0, alt * alt).otherwise(0.0)
    return epochs.where(v.isNotNull()).groupBy(*keys).agg(((n * q + s * s + nyquist) / 2 / (F.floor(n / 2) + 1)).alias("power"))


def entropy(epochs: DataFrame, keys: list[str] = EPOCH) -> DataFrame:
    """-sum u log2 u over the positive readings, u = value + 1e-10."""
    u = F.col("value") + 1e-10
    return epochs.groupBy(*keys).agg(F.coalesce(-F.sum(F.when(u > 0, u * F.log2(F.when(u > 0, u)))), F.lit(0.0)).alias("entropy"))


def motion(epochs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per stream and epoch of rows with x, y, z: signal magnitude area, mean magnitude, mean change of magnitude,
    summed orientation and mean turning rate per axis. Rows with a missing axis are left out."""
    ok = epochs.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    mag = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    m = ok.withColumn("mag", mag)
    area = F.sum(F.abs("x") + F.abs("y") + F.abs("z")).alias("sma")
    change = ratio(F.max_by("mag", "pos") - F.min_by("mag", "pos"), F.count("*").cast("double") - 1).alias("magnitude_change")
    turns = [F.sum(c).alias(f"turn_{c}") for c in "xyz"]
    rates = [ratio(F.sum(F.abs(c)) - F.min_by(F.abs(F.col(c)), "pos"), F.count("*").cast("double") - 1).alias(f"rate_{c}") for c in "xyz"]
    return m.groupBy(*STREAM, "epoch").agg(area, F.avg("mag").alias("magnitude"), change, *turns, *rates)


def crossings(epochs: DataFrame, keys: list[str] = EPOCH, block: int = BLOCK) -> DataFrame:
    """How often successive readings of an epoch change sign."""
    item = F.when(F.col("value").isNotNull(), F.struct("value"))
    n = with_neighbours(epochs, keys, "pos", item, "_p", "_n", block)
    return n.groupBy(*keys).agg(F.coalesce(F.sum((F.col("value") * F.col("_p.value") < 0).cast("int")), F.lit(0)).alias("crossings"))


def change_rates(epochs: DataFrame, keys: list[str] = EPOCH, block: int = BLOCK) -> DataFrame:
    """Minimum, mean, maximum, population deviation and mean absolute step per epoch; the last is 0 for one reading."""
    item = F.when(F.col("value").isNotNull(), F.struct("value"))
    n = with_neighbours(epochs, keys, "pos", item, "_p", "_n", block)
    v = F.col("value")
    return n.groupBy(*keys).agg(F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), F.coalesce(F.avg(F.abs(v - F.col("_p.value"))), F.lit(0.0)).alias("rate"))


def local_peaks(epochs: DataFrame, keys: list[str] = EPOCH, block: int = BLOCK, valleys: bool = False) -> DataFrame:
    """The local maxima (or minima) of each epoch: (keys, pos of the first reading of the top, value).

    A top of equal readings counts once; the first and last stretch of an epoch are no peaks. Missing readings are
    passed over."""
    v = -F.col("value") if valleys else F.col("value")
    rows = epochs.where(F.col("value").isNotNull()).withColumn("_v", v)
    n = with_neighbours(rows, keys, "pos", F.struct("_v"), "_p", "_n", block)
    changed = n.where(F.col("_p").isNull() | (F.col("_p._v") != F.col("_v"))).drop("_p", "_n")  # first of each stretch
    m = with_neighbours(changed, keys, "pos", F.struct("_v"), "_p", "_n", block)
    return m.where((F.col("_p._v") < F.col("_v")) & (F.col("_n._v") < F.col("_v"))).select(*keys, "pos", "value")


def skin_response(epochs: DataFrame, keys: list[str] = EPOCH, height: float = 0.05) -> DataFrame:
    """Skin conductance per epoch: mean level, number and mean height of peaks of at least `height` (0 where none),
    population variance."""
    level = epochs.groupBy(*keys).agg(F.avg("value").alias("level"), F.var_pop("value").alias("variance"))
    peaks = local_peaks(epochs, keys).where(F.col("value") >= height).groupBy(*keys).agg(F.count("*").alias("responses"), F.avg("value").alias("amplitude"))
    return level.join(peaks, keys, "left").na.fill(0, ["responses", "amplitude"])


def pulse_amplitude(epochs: DataFrame, keys: list[str] = EPOCH) -> DataFrame:
    """Maximum minus minimum per epoch."""
    return epochs.groupBy(*keys).agg((F.max("value") - F.min("value")).alias("amplitude"))


def blood_flow(epochs: DataFrame, keys: list[str] = EPOCH) -> DataFrame:
    """Mean peak minus mean valley per epoch; null where an epoch has no peak or no valley."""
    up = local_peaks(epochs, keys).groupBy(*keys).agg(F.avg("value").alias("up"))
    down = local_peaks(epochs, keys, valleys=True).groupBy(*keys).agg(F.avg("value").alias("down"))
    return epochs.select(*keys).distinct().join(up, keys, "left").join(down, keys, "left").select(*keys, (F.col("up") - F.col("down")).alias("flow"))


def peak_to_peak_rejection(epochs: DataFrame, threshold: float) -> DataFrame:
    """Epochs of a stream in which any channel spans more than `threshold`."""
    span = epochs.groupBy(*EPOCH).agg((F.max("value") - F.min("value")).alias("span"))
    return span.groupBy(*STREAM, "epoch").agg(F.max("span").alias("span")).where(F.col("span") > threshold)


def normality(rows: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """D'Agostino-Pearson test: statistic and p value per group, null below 20 readings or without variation."""
    m = rows.groupBy(*keys).agg(F.count("value").alias("n0"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")).where((F.col("n0") >= 20) & F.col("g1").isNotNull())
    n, g1, g2 = F.col("n0").cast("double"), F.col("g1"), F.col("g2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.ln(w2))
    e, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - e) / F.sqrt(var)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    z2 = ((1 - 2 / (9 * a)) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return m.select(*keys, F.col("n0").alias("n"), k2.alias("k2"), F.exp(-k2 / 2).alias("p"))
