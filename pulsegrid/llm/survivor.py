"""Best representative of each group of duplicate log records, field by field."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import broadcast_if_small, written

GAP_MS = 500
BUCKET_MS = 60_000
FIELDS = ["end_time", "category", "metadata"]
#: Texts that stand for no value, lower-cased and without blanks. Fixed values.
NO_VALUE = ["", "n/a", "{}"]
ROUNDS, CLOSE = 200, 1e-8
PATTERNS = 20_000
#: What is held of facts and origins beforehand. BELIEF is how much the prior specificity weighs against an origin's votes:
#: false facts that everybody states leave no trace, so without it the model could hold any fact for false.
PRIOR, SENSITIVITY, SPECIFICITY, BELIEF = 0.6, 0.8, 0.9, 0.3
UNLISTED = "(unlisted)"


def gap_groups(rows: DataFrame, keys: list[str], t: str, row_id: str, gap: int, bucket: int = BUCKET_MS) -> DataFrame:
    """Adds group_id, the smallest row_id of a chain of rows of one key whose times are at most `gap` apart.

    Rows of one key and time are first combined into one, so a group of copies however large is a few rows. Those are
    chained inside buckets of time; chains go on across buckets through one row per bucket, so a hot key is spread over
    its buckets. The rows themselves are only joined to the ids of their key and time. `gap` must be below `bucket`.
    Rows with a null key or time are dropped.
    """
    ok = F.col(t).isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    times = rows.where(ok).groupBy(*keys, t).agg(F.min(row_id).alias("_id"), F.count("*").alias("_n"))
    d = times.withColumn("_b", F.floor(F.col(t) / bucket))
    inside, across = Window.partitionBy(*keys, "_b").orderBy(t), Window.partitionBy(*keys).orderBy("_b")
    d = d.withColumn("_cut", F.coalesce((F.col(t) - F.lag(t).over(inside) > gap).cast("int"), F.lit(0))).withColumn("_piece", F.sum("_cut").over(inside))
    b = d.groupBy(*keys, "_b").agg(F.min(t).alias("_from"), F.max(t).alias("_to"), F.max("_piece").alias("_last"))
    joined = F.coalesce((F.col("_b") - F.lag("_b").over(across) == 1) & (F.col("_from") - F.lag("_to").over(across) <= gap), F.lit(False))
    b = b.withColumn("_joined", joined)
    # the chain that runs out of a bucket starts in its last piece, unless that is its first and is joined to the bucket before
    own = F.when((F.col("_last") > 0) | ~F.col("_joined"), F.struct("_b", F.col("_last").alias("_piece")))
    b = b.withColumn("_root", F.last(own, ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)))
    b = b.select(*keys, "_b", F.when(F.col("_joined"), F.col("_root")).alias("_root"))
    chain = F.when((F.col("_piece") == 0) & F.col("_root").isNotNull(), F.col("_root")).otherwise(F.struct("_b", "_piece"))
    d = d.join(b, [*keys, "_b"]).withColumn("_chain", chain)
    ids = d.groupBy(*keys, "_chain").agg(F.min("_id").alias("group_id"), F.sum("_n").alias("copies"))
    return rows.join(d.join(ids, [*keys, "_chain"]).select(*keys, t, "group_id", "copies"), [*keys, t])


def copies(log: DataFrame, origins: DataFrame, bucket: int = BUCKET_MS) -> DataFrame:
    """The rows of groups of two or more copies, with what each field holds and the trust in their origin."""
    marker = F.regexp_replace(F.lower(F.trim("marker")), "[\\s-]", "_")
    s, e = F.col("start_time"), F.col("end_time")
    text = {f: F.when(~F.regexp_replace(F.lower(f), "\\s", "").isin(NO_VALUE), F.col(f)) for f in ("category", "metadata")}
    rows = log.select(
        "row_id", "log_key", "session", marker.alias("norm"), F.when(~F.isnan(s), F.round(s * 1000)).cast("bigint").alias("ms"), "marker", "start_time", F.when(~F.isnan(e) & (e >= s), e).alias("end_time"),
        text["category"].alias("category"), text["metadata"].alias("metadata"), "origin", "recorded_at",
    )
    grouped = gap_groups(rows, ["log_key", "session", "norm"], "ms", "row_id", GAP_MS, bucket).where(F.col("copies") > 1)
    trust = origins.where(F.col("origin").isNotNull()).groupBy("origin").agg(F.min("trust").alias("trust"))
    listed = grouped.join(broadcast_if_small(trust), "origin", "left")
    return listed.withColumn("origin", F.when(F.col("trust").isNull(), UNLISTED).otherwise(F.col("origin"))).withColumn("trust", F.coalesce("trust", F.lit(2**31 - 1)))


def claims(c: DataFrame) -> DataFrame:
    """One row per copy, field and fact the copy states: (group_id, field, fact, said, origin, row_id).

    A category or an end time (to a tenth of a second) is one fact; metadata states a fact per entry, or is one fact if
    it has no entries. `fact` is what is compared, `said` how the copy spells it."""
    entries = F.regexp_extract_all(F.col("metadata"), F.lit(r"""["']([^"']+)["']\s*:\s*(["'][^"']*["']|[^,}]*)"""), 0)
    one = lambda fact, said: F.array(F.struct(fact.alias("fact"), said.alias("said")))
    each = F.transform(entries, lambda x: F.struct(F.lower(F.regexp_replace(x, r"""["'\s]""", "")).alias("fact"), F.trim(x).alias("said")))
    end, category, metadata = F.col("end_time"), F.trim("category"), F.trim("metadata")
    per = F.array(
        F.struct(F.lit("end_time").alias("field"), F.when(end.isNotNull(), one(F.format_number(end, 1), end.cast("string"))).alias("facts")),
        F.struct(F.lit("category").alias("field"), F.when(category.isNotNull(), one(F.lower(category), category)).alias("facts")),
        F.struct(F.lit("metadata").alias("field"), F.when(F.size(entries) > 0, each).when(metadata.isNotNull(), one(F.lower(metadata), metadata)).alias("facts")),
    )
    stated = c.select("group_id", "row_id", "origin", F.inline(per)).select("group_id", "field", "origin", "row_id", F.inline("facts"))
    return stated.groupBy("group_id", "field", "origin", "row_id", "fact").agg(F.min("said").alias("said"))


def _log_odds(quality: dict[str, tuple[float, float]], prior: float) -> Column:
    """Posterior log odds of a fact from its votes, an array of (origin, said)."""
    yes = F.create_map(*[x for o, (se, sp) in quality.items() for x in (F.lit(o), F.lit(math.log(se / (1 - sp))))])
    no = F.create_map(*[x for o, (se, sp) in quality.items() for x in (F.lit(o), F.lit(math.log((1 - se) / sp)))])
    return F.aggregate("votes", F.lit(math.log(prior / (1 - prior))), lambda acc, v: acc + F.when(v["said"], F.try_element_at(yes, v["origin"])).otherwise(F.try_element_at(no, v["origin"])))


def _counter(patterns: DataFrame, names: list[str], prior: float) -> Callable[[dict[str, tuple[float, float]]], dict[str, tuple[float, ...]]]:
    """A function from qualities to each origin's expected counts of true facts it states, of true facts, of false facts it
    does not state, and of false facts. With k origins there are at most 3 ** k patterns: up to PATTERNS of them come to
    the driver once, as counts; more stay where they are, and a round is a Spark aggregation."""
    rows = patterns.limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:

        def by_spark(quality: dict[str, tuple[float, float]]) -> dict[str, tuple[float, ...]]:
            scored = patterns.withColumn("p", 1 / (1 + F.exp(-_log_odds(quality, prior)))).select("n", "p", F.explode("votes").alias("v"))
            n, p, s = F.col("n"), F.col("p"), F.col("v.said")
            sums = scored.groupBy("v.origin").agg(F.sum(F.when(s, n * p).otherwise(0.0)), F.sum(n * p), F.sum(F.when(~s, n * (1 - p)).otherwise(0.0)), F.sum(n * (1 - p)))
            return {r[0]: tuple(r[1:]) for r in sums.collect()}

        return by_spark
    voted, said = np.zeros((2, len(rows), len(names)))
    for i, r in enumerate(rows):
        for v in r["votes"]:
            voted[i, names.index(v["origin"])], said[i, names.index(v["origin"])] = 1.0, float(v["said"])
    n = np.array([r["n"] for r in rows], float)

    def by_pattern(quality: dict[str, tuple[float, float]]) -> dict[str, tuple[float, ...]]:
        se, sp = np.array([quality[o] for o in names]).T
        odds = math.log(prior / (1 - prior)) + said @ np.log(se / (1 - sp)) + (voted - said) @ np.log((1 - se) / sp)
        p = 1 / (1 + np.exp(-odds))
        sums = np.stack([(n * p) @ said, (n * p) @ voted, (n * (1 - p)) @ (voted - said), (n * (1 - p)) @ voted], axis=1)
        return dict(zip(names, map(tuple, sums.tolist())))

    return by_pattern


def truth_model(said: DataFrame, rounds: int = ROUNDS, close: float = CLOSE) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Latent truth: which facts hold, and each origin's sensitivity and specificity, by expectation-maximisation.

    An origin that has a value of a field in a group votes on every fact stated there: yes if it states it, no if
    not. Facts with the same votes have the same posterior, so the rounds run over the distinct vote patterns and
    their counts (see _counter). Rounds end when no quality moves by more than `close`, or after
    `rounds`. Result: (group_id, field, fact, p_true) and the qualities.
    """
    voter = said.groupBy("group_id", "field").agg(F.collect_set("origin").alias("voters"))
    yes = said.groupBy("group_id", "field", "fact").agg(F.collect_set("origin").alias("yes"))
    votes = F.transform(F.array_sort("voters"), lambda o: F.struct(o.alias("origin"), F.array_contains("yes", o).alias("said")))
    facts = written(yes.join(voter, ["group_id", "field"]).select("group_id", "field", "fact", votes.alias("votes")), "facts")
    patterns = written(facts.groupBy("votes").agg(F.count("*").alias("n")), "patterns")
    names = sorted(r[0] for r in patterns.select(F.explode("votes.origin")).distinct().collect())
    quality, prior = {o: (SENSITIVITY, SPECIFICITY) for o in names}, PRIOR
    count = _counter(patterns, names, prior)
    for _ in range(rounds if names else 0):
        before = quality
        quality = {o: ((a + SENSITIVITY) / (b + 1), (c + BELIEF * (b + d) * SPECIFICITY) / (d + BELIEF * (b + d))) for o, (a, b, c, d) in count(quality).items()}
        quality = {o: (min(max(se, 1e-4), 1 - 1e-4), min(max(sp, 1e-4), 1 - 1e-4)) for o, (se, sp) in quality.items()}
        if max(abs(x - y) for o in names for x, y in zip(quality[o], before[o])) < close:
            break
    p_true = 1 / (1 + F.exp(-_log_odds(quality, prior))) if names else F.lit(0.5)
    return facts.select("group_id", "field", "fact", p_true.alias("p_true")), quality


def _rank() -> Column:
    """Precedence of copies, the first is the smallest: trust of the origin, then the latest, then the smallest row_id."""
    return F.struct("trust", (-F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(-(2**62)))).alias("age"), "row_id")


def survivors(c: DataFrame) -> DataFrame:
    """The copy whose value survives, per group and field: (group_id, field, row_id, p_true).

    Of the copies that state a value of the field the first by precedence survives: the most trusted origin, then the
    latest recorded_at, then the smallest row_id. The truth model does not decide here: p_true, the mean posterior of
    the surviving value's facts, tells how far it believes the choice. A field that no copy has gives no row.

    A null, blank or 'n/a' text, an empty dictionary and an end before the start are no value. A null or unlisted
    origin is trusted least, a null recorded_at is the oldest. Rows without log, session, marker or start are in no
    group. Repeated rows are copies of each other. An empty log gives no rows.
    """
    said = claims(c)
    facts, _ = truth_model(said)
    judged = said.join(facts, ["group_id", "field", "fact"]).groupBy("group_id", "field", "row_id").agg(F.avg("p_true").alias("p_true"))
    ranked = judged.join(c.select("row_id", _rank().alias("rank")), "row_id")
    top = ranked.groupBy("group_id", "field").agg(F.min(F.struct("rank", "row_id", "p_true")).alias("top"))
    return top.select("group_id", "field", "top.row_id", "top.p_true")


def precedence_records(c: DataFrame) -> DataFrame:
    """One record per group: marker and start of the first copy by precedence, every other field from its survivor."""
    s = survivors(c)
    picked = s.join(c.select("group_id", "row_id", *FIELDS), ["group_id", "row_id"])
    built = picked.groupBy("group_id").agg(*[F.max(F.when(F.col("field") == f, F.col(f))).alias(f) for f in FIELDS])
    return _bases(c).join(built, "group_id", "left").select("group_id", "b.*", *FIELDS, "copies")


def _bases(c: DataFrame) -> DataFrame:
    return c.groupBy("group_id").agg(F.min_by(F.struct("log_key", "session", "marker", "start_time"), _rank()).alias("b"), F.max("copies").alias("copies"))


def surviving_records(c: DataFrame) -> DataFrame:
    """One record per group, built from what the truth model holds for true: (group_id, log_key, session, marker,
    start_time, end_time, category, metadata, copies).

    end_time and category have the most probable fact; metadata keeps every entry judged true (p_true of 0.5 and more),
    in the order of the entries, or the most probable one where none is. Equally probable facts are told apart by the
    precedence of the copies that state them, and a fact is spelled as in the first copy that states it. Marker and
    start have no facts to judge, as the copies of a group agree on them, and are those of the first copy. A field that
    no copy has is null.
    """
    said = written(claims(c), "claims")
    facts, _ = truth_model(said)
    spelled = said.join(c.select("row_id", _rank().alias("rank")), "row_id").groupBy("group_id", "field", "fact").agg(F.min("rank").alias("rank"), F.min_by("said", "rank").alias("said"))
    judged = facts.join(spelled, ["group_id", "field", "fact"]).withColumn("p", F.round("p_true", 6))
    top = F.min_by("said", F.struct((-F.col("p")).alias("p"), "rank", "fact")).alias("top")
    true = F.array_sort(F.collect_list(F.when(F.col("p") >= 0.5, F.struct("fact", "said"))))  # one group's entries
    kept = judged.groupBy("group_id", "field").agg(top, true.alias("true"))
    entries = F.when(F.size("true") > 0, F.array_join(F.col("true.said"), ", ")).otherwise(F.col("top"))
    of = lambda f, v: F.max(F.when(F.col("field") == f, v)).alias(f)
    built = kept.groupBy("group_id").agg(of("end_time", F.col("top").cast("double")), of("category", F.col("top")), of("metadata", F.concat(F.lit("{"), entries, F.lit("}"))))
    return _bases(c).join(built, "group_id", "left").select("group_id", "b.*", *FIELDS, "copies")
