"""Missing session, epoch and user filled from the nearest records of the same stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.columns import entity_key, micros
from pulsegrid.session import written

EPOCH_US = 5_000_000
REACH_US = 60_000_000


def nearest_donors(rows: DataFrame, by: list[str], t: str, donor: Column, carried: list[str], reach: int, deep: bool = False) -> DataFrame:
    """Adds `before` and `after`: structs (t, *carried) of the nearest donors at or before, and at or after, each row; with
    `deep` they have a field `beyond` too, a struct (t, *carried) of the donor behind that one in its block, if there is one.

    Records are blocked by `by` and time buckets as wide as `reach`. A donor within reach lies in the row's own
    bucket or is the last of the bucket before or the first of the bucket after, so windows stay inside a bucket
    and one small row per bucket carries the rest. Donors farther away than `reach` may come out and are for the
    caller to reject. A donor finds itself. Of donors at one instant the one with the smallest carried values is
    taken. Rows with a null key or time find none.
    """
    item = F.struct(F.col(t).alias("t"), *carried)
    spread = -1 - F.pmod(F.xxhash64(*rows.columns), F.lit(4096))  # rows without a time meet nobody: keep them apart
    d = rows.withColumn("_b", F.coalesce(F.floor(F.col(t) / reach), spread)).withColumn("_d", F.when(donor & F.col(t).isNotNull(), item))
    keys = [*by, "_b"]
    ties = [F.col(c).desc_nulls_last() for c in carried]
    up = Window.partitionBy(*keys).orderBy(F.col(t), *ties)
    down = Window.partitionBy(*keys).orderBy(F.col(t).desc(), *ties)
    rank = [F.col(f"_d.{c}") for c in carried]
    last = F.min_by("_d", F.struct(-F.col("_d.t"), *rank)).alias("_last")
    first = F.min_by("_d", F.struct(F.col("_d.t"), *rank)).alias("_first")
    ends = d.where(F.col("_d").isNotNull()).groupBy(*keys).agg(last, first)
    prev = ends.select(*by, (F.col("_b") + 1).alias("_b"), F.col("_last").alias("_prev"))
    following = ends.select(*by, (F.col("_b") - 1).alias("_b"), F.col("_first").alias("_next"))
    inside, alone = d, F.col
    for name, w in (("_in_before", up), ("_in_after", down)):
        given = F.col("_d")
        if deep:
            inside = inside.withColumn("_behind", F.last("_d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
            given = F.when(given.isNotNull(), F.struct("_d.*", F.col("_behind").alias("beyond")))
        inside = inside.withColumn(name, F.last(given, ignorenulls=True).over(w)).drop("_behind")
    if deep:
        none = F.lit(None).cast(d.schema["_d"].dataType).alias("beyond")
        alone = lambda c: F.when(F.col(c).isNotNull(), F.struct(f"{c}.*", none))
    out = inside.join(prev, keys, "left").join(following, keys, "left")
    return out.withColumn("before", F.coalesce("_in_before", alone("_prev"))).withColumn("after", F.coalesce("_in_after", alone("_next"))).drop("_b", "_d", "_in_before", "_in_after", "_prev", "_next")


def _nearer(c: str, reach: int | None) -> Column:
    """The donor of the two that is nearer in time, the earlier one of two equally near; null beyond reach."""
    b, a = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    ok_b = b.isNotNull() & (b <= reach if reach else F.lit(True))
    ok_a = a.isNotNull() & (a <= reach if reach else F.lit(True))
    return F.when(ok_b & (~ok_a | (b <= a)), F.col(f"before.{c}")).when(ok_a, F.col(f"after.{c}"))


def hot_deck_fill(features: DataFrame, reach_us: int = REACH_US, epoch_us: int = EPOCH_US) -> DataFrame:
    """Fills session, epoch and user_id of feature rows from donors of the same stream, each fill marked.

    features: feature_id, stream_id, session, epoch, user_id, ts. Missing: null, or below 1 for session and
    user_id, below 0 for epoch. Result: (feature_id, the three fields as far as known, session_filled,
    epoch_filled, user_filled boolean, session_donor, epoch_donor, user_donor bigint, feature_ids of the donors).

    session: that of the nearest donor in time, at most `reach_us` away (of two equally near the earlier one; of
    donors at one instant the one with the smaller session). epoch: the weighted median of what the epochs of up to
    four near donors of the same stream and session, two on either side, and of the session's first donor come to at
    this row's time, each weighing one over one and its seconds away; its donor is the nearest that says so. user_id: the
    value that more than half of the donors of the same stream and session have; its donor is the first that has it. A session filled first counts for the other two. Rows without stream or ts, or without donors, stay as they are
    and unmarked; repeated rows are rows of their own; an empty table gives an empty result.

    Scale: donors are looked for in blocks of stream (and session) and minute; majorities are counted with
    map-side combine. One stream may hold any share of the rows. The filled sessions, used three times, are written
    to the shared folder once.
    """
    missing_session = F.col("session").isNull() | (F.col("session") < 1)
    rows = features.select(
        "feature_id", entity_key("stream_id").alias("sid"), F.when(~missing_session, F.col("session")).alias("session0"), F.when(F.col("epoch") >= 0, F.col("epoch")).alias("epoch0"),
        F.when(F.col("user_id") >= 1, F.col("user_id")).alias("user0"), micros("ts").alias("t"),
    )
    near = nearest_donors(rows, ["sid"], "t", F.col("session0").isNotNull(), ["session0", "feature_id"], reach_us)
    s = near.select(*rows.columns, _nearer("session0", reach_us).alias("s1"), _nearer("feature_id", reach_us).alias("d1"))
    s = s.select("feature_id", "sid", "t", "epoch0", "user0", "session0", F.coalesce("session0", "s1").alias("session"), F.when(F.col("session0").isNull() & F.col("sid").isNotNull(), F.col("d1")).alias("session_donor"))
    s = written(s, "sessions")

    group = ["sid", "session"]
    votes = s.where(F.col("session").isNotNull() & F.col("user0").isNotNull()).groupBy(*group, "user0").agg(F.count("*").alias("n"), F.min("feature_id").alias("giver"))
    users = votes.groupBy(*group).agg(F.sum("n").alias("all"), F.max(F.struct("n", "user0", "giver")).alias("top")).where(F.col("top.n") * 2 > F.col("all")).select(*group, F.col("top.user0").alias("user1"), F.col("top.giver").alias("giver"))
    far = s.where(F.col("session").isNotNull() & F.col("epoch0").isNotNull() & F.col("t").isNotNull()).groupBy(*group).agg(F.min(F.struct("t", "epoch0", "feature_id")).alias("far"))

    near = nearest_donors(s, group, "t", F.col("epoch0").isNotNull() & F.col("session").isNotNull(), ["epoch0", "feature_id"], reach_us, deep=True)

    def vote(d: str) -> Column:
        away = (F.col("t") - F.col(f"{d}.t")) / 1e6
        says = F.col(f"{d}.epoch0") + F.round(away * 1e6 / epoch_us).cast("bigint")
        return F.when(F.col(f"{d}.t").isNotNull(), F.struct(says.alias("says"), (1 / (1 + F.abs(away))).alias("weight"), F.col(f"{d}.feature_id").alias("donor")))

    asks = F.col("epoch0").isNull() & F.col("t").isNotNull() & F.col("session").isNotNull()
    near = near.join(far, group, "left").withColumn("votes", F.when(asks, F.array_sort(F.array_compact(F.array(*map(vote, ("before", "after", "before.beyond", "after.beyond", "far")))))))
    half = F.aggregate("votes", F.lit(0.0), lambda x, v: x + v["weight"]) / 2
    heard = lambda says: F.aggregate("votes", F.lit(0.0), lambda x, v: x + F.when(v["says"] <= says, v["weight"]).otherwise(0.0))
    near = near.withColumn("nearest", F.get(F.filter("votes", lambda v: heard(v["says"]) >= half), F.lit(0))["says"])
    donor = F.array_max(F.transform(F.filter("votes", lambda v: v["says"] == F.col("nearest")), lambda v: F.struct(v["weight"], -v["donor"])))["col2"] * -1
    nearest = F.col("nearest")
    full = near.join(users, group, "left")
    e1 = F.when(nearest >= 0, nearest)
    return full.select(
        "feature_id", "session", F.coalesce("epoch0", e1).alias("epoch"), F.coalesce("user0", "user1").alias("user_id"),
        (F.col("session0").isNull() & F.col("session").isNotNull()).alias("session_filled"), e1.isNotNull().alias("epoch_filled"), (F.col("user0").isNull() & F.col("user1").isNotNull()).alias("user_filled"),
        "session_donor", F.when(e1.isNotNull(), donor).alias("epoch_donor"), F.when(F.col("user0").isNull() & F.col("user1").isNotNull(), F.col("giver")).alias("user_donor"),
    )


def fills(filled: DataFrame) -> DataFrame:
    """One row per filled value: (feature_id, field, filled string, donor = feature_id of a row that gave it)."""
    parts = (("session", "session_filled", "session_donor"), ("epoch", "epoch_filled", "epoch_donor"), ("user_id", "user_filled", "user_donor"))
    each = [F.struct(F.lit(f).alias("field"), F.when(F.col(flag), F.col(f).cast("string")).alias("filled"), F.col(donor).alias("donor")) for f, flag, donor in parts]
    return filled.select("feature_id", F.inline(F.array(*each))).where(F.col("filled").isNotNull())
