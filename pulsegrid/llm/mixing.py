"""Mixing sources to target shares of the total size in tokens."""

from __future__ import annotations

import array
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.encode import TOKENIZERS, VOCABULARY, encoder
from pulsegrid.session import written

#: Labelled rows that the classifier is fitted and judged on, about; everything else covers all rows.
FIT_ROWS = 4000
#: Of HELD_OUT labelled rows one is kept for judging the classifier.
HELD_OUT = 5
#: Features of the classifier: token ids modulo DIM, as square roots of their shares.
DIM = 128
#: How far a label is believed: the odds that it gives its source over all others together.
LABEL_TRUST = 0.95
#: Rounds of the least squares at most.
ROUNDS = 12
#: Bins in which a source's documents are ordered when rates become whole numbers of copies.
BINS = 4096


def source_name(c: str = "source") -> Column:
    return F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))


def _bag(ids: array.array) -> np.ndarray:
    return np.sqrt(np.bincount(np.frombuffer(ids, np.int32) % DIM, minlength=DIM) / max(1, len(ids)))


def _bags(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    for b in batches:
        bags = []
        for text in b["text"]:
            ids = array.array("i")
            e.encode(text.as_py() or "", ids)
            bags.append(_bag(ids))
        yield pa.RecordBatch.from_arrays([b["label"], b["held"], pa.array(bags, pa.list_(pa.float64()))], ["label", "held", "bag"])


class Classifier(NamedTuple):
    """Weights and intercepts of each source, and of each source how many labelled rows were held out and how many of them
    were told right."""

    weights: np.ndarray
    intercepts: np.ndarray
    held_out: list[int]
    right: list[int]

    def posteriors(self, bags: np.ndarray) -> np.ndarray:
        z = bags @ self.weights.T + self.intercepts
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_classifier(docs: DataFrame, names: list[str], fit_rows: int = FIT_ROWS, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Classifier | None:
    """A multinomial logistic regression on token features, from about `fit_rows` of the documents with a source of
    `names`, chosen by a hash of doc_id; None where there is none. A source without rows has no probability."""
    if not names:
        return None
    index = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(float(i)))])
    labelled = docs.select("doc_id", "text", F.try_element_at(index, source_name()).alias("label")).where(F.col("label").isNotNull())
    share = fit_rows / max(1, labelled.count())
    below = F.xxhash64("doc_id", F.lit("fit")) <= min(2**63 - 1, int(share * 2**64) - 2**63)  # the whole range of the hash, so that no share is rounded away
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    bags = labelled.where(below).select("label", held.alias("held"), "text").mapInArrow(partial(_bags, path=f"{tokenizers}/{vocabulary}"), "label double, held boolean, bag array<double>")
    bags = written(bags.where(F.col("label").isNotNull()), "bags")
    seen = sorted(int(r[0]) for r in bags.where("not held").select("label").distinct().collect())  # one row per source of the targets
    if not seen:
        return None
    weights, intercepts = np.zeros((len(names), DIM)), np.full(len(names), -1e9)
    intercepts[seen] = 0.0
    if len(seen) > 1:
        model = LogisticRegression(family="multinomial", regParam=0.001, maxIter=25).fit(bags.where("not held").select("label", array_to_vector("bag").alias("features")))
        weights[seen], intercepts[seen] = model.coefficientMatrix.toArray()[seen], model.interceptVector.toArray()[seen]
    w = F.array(*[F.array(*map(F.lit, r)) for r in weights[seen].tolist()])
    z = F.transform(F.arrays_zip(w.alias("w"), F.array(*map(F.lit, intercepts[seen].tolist())).alias("b"), F.array(*[F.lit(float(i)) for i in seen]).alias("i")), lambda c: F.struct((F.aggregate(F.zip_with(c["w"], "bag", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y) + c["b"]).alias("z"), c["i"].alias("i")))
    judged = bags.where("held").select("label", F.array_max(z)["i"].alias("told")).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("told")).alias("right"))
    counts = {int(r["label"]): (r["n"], r["right"]) for r in judged.collect()}
    return Classifier(weights, intercepts, [counts.get(i, (0, 0))[0] for i in range(len(names))], [counts.get(i, (0, 0))[1] for i in range(len(names))])


def _sizes(batches: Iterator[pa.RecordBatch], path: str, model: Classifier | None) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    for b in batches:
        sizes, bags = [], []
        for text in b["text"]:
            ids = array.array("i")
            e.encode(text.as_py() or "", ids)
            sizes.append(len(ids))
            bags.append(_bag(ids))
        p = pa.nulls(len(sizes), pa.list_(pa.float64())) if model is None or not sizes else pa.array(list(model.posteriors(np.array(bags))), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], pa.array(sizes, pa.int64()), p], ["doc_id", "source", "tokens", "told"])


def memberships(docs: DataFrame, names: list[str], model: Classifier | None, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source normalised or null, tokens, p): p is the posterior of each source of `names`. It is what the classifier
    tells of the text; where there is a label it is weighed by LABEL_TRUST for the source named. Null for a source
    without target, and without a classifier for a document without source."""
    rows = docs.select("doc_id", source_name().alias("source"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = rows.mapInArrow(partial(_sizes, path=f"{tokenizers}/{vocabulary}", model=model), f"doc_id {kind}, source string, tokens bigint, told array<double>")
    if not names:
        return sized.withColumn("p", F.lit(None).cast("array<double>")).drop("told")
    other = (1 - LABEL_TRUST) / max(1, len(names) - 1)
    weigh = F.zip_with("told", F.array(*map(F.lit, names)), lambda t, n: t * F.when(n == F.col("source"), LABEL_TRUST).otherwise(other))
    whole = F.aggregate(weigh, F.lit(0.0), lambda x, y: x + y)
    known = F.transform(F.array(*map(F.lit, names)), lambda n: (n == F.col("source")).cast("double"))
    p = F.when(F.col("source").isNull(), F.col("told")).when(F.col("source").isin(names), F.when(whole > 0, F.transform(weigh, lambda x: x / whole)).otherwise(known))
    return sized.withColumn("p", p).drop("told")


class Moves(NamedTuple):
    """What has been done to the rates: moves along the memberships, then for each source the factor of its rates, and the
    share of what is left up to the limit that is added."""

    along: list[np.ndarray]
    factor: np.ndarray
    raised: np.ndarray

    def rates(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Memberships, limits and rates of a batch of documents: half the limit at first, and always within 0 and it."""
        m = b["m"].values.to_numpy().reshape(b.num_rows, -1)
        cap = b["cap"].to_numpy()
        x = cap * 0.5
        for move in self.along:
            x = np.clip(x - m @ move, 0.0, cap)
        own = m[:, : len(self.factor)]
        return m, cap, x * (own @ self.factor) + (cap - x) * (own @ self.raised)


def _totals(batches: Iterator[pa.RecordBatch], moves: Moves) -> Iterator[pa.RecordBatch]:
    """Totals of a task's documents by membership, those at the limit, and the products of memberships of those whose rate
    can still move."""
    size = 2 * len(moves.factor)
    got, room, gram = np.zeros(size), np.zeros(size), np.zeros((size, size))
    for b in batches:
        if b.num_rows:
            m, cap, x = moves.rates(b)
            n = b["tokens"].to_numpy().astype(float)
            got += (n * x) @ m
            room += (n * cap) @ m
            gram += (m * (n * ((x > 0) & (x < cap)))[:, None]).T @ m
    flat = np.concatenate([got, room, gram.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "x"])


def _rated(batches: Iterator[pa.RecordBatch], moves: Moves, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rates = moves.rates(b)[2] if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pa.array(rates)], [*names, "rate"])


def fit_rates(members: DataFrame, shares: list[float], rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """Adds `rate` in [0, cap]: rates whose totals by source, and as nearly as the limits allow their expected totals by
    membership too, have the target shares of the largest total that is possible by source.

    Least squares on both kinds of totals by projected gradient. A round is one aggregation over all documents: each task
    sums up its totals and, over the documents whose rate can still move, the products of memberships, with which the
    driver scales the move (a system of two equations a source). Rounds end when the squares sum no longer shrinks by a
    hundredth. Where the limits keep the two kinds from holding together, the totals by source come first: at last the
    rates of a source are lowered by one factor, or raised by one share of what is left, to its total. A rate is worked
    out anew from the moves so far, ROUNDS of a few products each. members: m, first the source as 0 and 1, then the
    posteriors; cap; tokens.
    """
    k = len(shares)
    slim = members.select("m", "cap", "tokens")
    along: list[np.ndarray] = []
    plain = Moves(along, np.ones(k), np.zeros(k))

    def totals() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.zeros(4 * k + 4 * k * k)
        for at, x in slim.mapInArrow(partial(_totals, moves=plain), "at int, x double").groupBy("at").agg(F.sum("x")).collect():
            flat[at] = x
        return flat[: 2 * k], flat[2 * k : 4 * k], flat[4 * k :].reshape(2 * k, 2 * k)

    got, room, gram = totals()
    total = min((r / s for r, s in zip(room, shares) if s > 0), default=0.0)
    if total <= 0:
        return members.withColumn("rate", F.lit(0.0)), 0.0
    goal = total * np.array(shares * 2)
    for _ in range(rounds):
        off = got - goal
        ridge = 1e-3 * max(np.trace(gram), 1e-9) / (2 * k)
        move = np.linalg.solve(gram + ridge * np.eye(2 * k), off)
        bound = np.diag(gram) <= 0  # all its documents are at a limit: move them by its size
        move[bound] = off[bound] / np.maximum(room[bound], 1.0)
        along.append(move)
        before, (got, _, gram) = got, totals()
        if ((got - goal) ** 2).sum() > 0.99 * (off**2).sum():
            if ((got - goal) ** 2).sum() > (off**2).sum():
                along.pop()
                got = before
            break
    own, want = got[:k], goal[:k]
    less = own > want
    factor = np.where(less, want / np.where(own > 0, own, 1.0), 1.0)
    raised = np.where(less, 0.0, (want - own) / np.maximum(room[:k] - own, 1e-9))
    moves = Moves(along, factor, np.clip(raised, 0.0, 1.0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema) + ", rate double"
    return members.mapInArrow(partial(_rated, moves=moves, names=members.columns), schema), total


def _targets(targets: DataFrame) -> tuple[list[str], list[float], list[float]]:
    """Names, caps and shares of the target sources, a short table."""
    rows = targets.where(F.col("source").isNotNull()).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("cap")).orderBy("source").collect()
    whole = sum(r["share"] for r in rows) or 1.0
    return [r["source"] for r in rows], [float(r["cap"]) for r in rows], [r["share"] / whole for r in rows]


def mix(docs: DataFrame, targets: DataFrame, fit_rows: int = FIT_ROWS, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, with_memberships: bool = False) -> DataFrame:
    """How often each document is used: (doc_id, source, guessed, tokens, rate, copies), one row per document used, and with
    `with_memberships` its posteriors p, in the order of the sources' names.

    docs: doc_id, text, source; targets: source, target_share, max_repeats, a short table of sources. The sources'
    tokens come to their target shares of the largest total that the repeats allow, and no document is used more
    often than its source allows. Sources are the same after trimming and lower-casing. Every document belongs to all
    sources by its posteriors (see memberships), and the expected tokens by posterior are led to the same shares as far as
    the caps allow. A document without a source is counted, and capped, as one of a source drawn by its posteriors, by a
    hash of doc_id, and `guessed` is true. Documents of a source without target, and documents without tokens, are not
    used. Shares are scaled to a sum of 1; a share or repeats that are null or not positive are 0. A target source
    without documents makes the mix empty, as its share cannot be reached. Repeated doc_ids are used alike.

    Rates become whole numbers by a hash of doc_id: the fraction of a source's documents with the smallest hashes
    gets one copy more, cut where the tokens come out right, found from token counts in BINS bins a source.
    """
    names, caps, shares = _targets(targets)
    model = fit_classifier(docs, names, fit_rows, tokenizers, vocabulary)
    sized = written(memberships(docs, names, model, tokenizers, vocabulary), "sizes").where(F.col("p").isNotNull() & (F.col("tokens") > 0))
    all_names = F.array(*map(F.lit, names)).cast("array<string>")
    u = (F.xxhash64("doc_id", F.lit("member")).cast("double") + 2.0**63) / 2.0**64
    upto = F.aggregate("p", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))
    place = F.size(F.filter(upto, lambda x: x <= u)) + 1
    drawn = F.element_at(all_names, F.least(place, F.lit(len(names)))) if names else F.lit(None).cast("string")
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in zip(names, caps) for x in kv]), F.col("source")) if names else F.lit(0.0)
    members = sized.select("doc_id", F.coalesce("source", drawn).alias("source"), F.col("source").isNull().alias("guessed"), "tokens", "p").withColumn("cap", cap)
    members = written(members.withColumn("m", F.concat(F.transform(all_names, lambda s: (s == F.col("source")).cast("double")), F.col("p"))), "members")
    rated, _ = fit_rates(members, shares) if names else (members.withColumn("rate", F.lit(0.0)), 0.0)
    rated = written(rated.drop("m", "cap"), "rated").withColumn("base", F.floor("rate")).withColumn("bin", F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(BINS)).cast("int"))
    by = ["source", "guessed"]
    bins = rated.groupBy(*by, "bin").agg(F.sum("tokens").alias("n"), F.sum(F.col("tokens") * (F.col("rate") - F.col("base"))).alias("wanted"), F.sum(F.when(F.col("rate") > F.col("base"), F.col("tokens")).otherwise(0)).alias("open"))
    so_far = F.sum("open").over(Window.partitionBy(*by).orderBy("bin"))
    cuts = bins.withColumn("upto", so_far).withColumn("all", F.sum("wanted").over(Window.partitionBy(*by))).groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("upto") - F.col("open") / 2 <= F.col("all"), F.col("bin"))), F.lit(-1)).alias("cut"))
    extra = ((F.col("bin") <= F.col("cut")) & (F.col("rate") > F.col("base"))).cast("bigint")
    used = rated.join(F.broadcast(cuts), by).withColumn("copies", F.col("base") + extra).where(F.col("copies") > 0)
    return used.select("doc_id", "source", "guessed", "tokens", "rate", "copies", *(["p"] if with_memberships else []))


def reached(used: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares actually reached, per target source: (source, target_share, documents, tokens, share, guessed_tokens,
    most_copies, expected_share = the share by posteriors). `used` is a mix with memberships."""
    names, _, _ = _targets(targets)
    t = targets.where(F.col("source").isNotNull()).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("target_share"))
    n = F.col("tokens") * F.col("copies")
    got = used.groupBy("source").agg(F.count("*").alias("documents"), F.sum(n).alias("tokens"), F.coalesce(F.sum(F.when(F.col("guessed"), n)), F.lit(0)).alias("guessed_tokens"), F.max("copies").alias("most_copies"))
    expected = used.select(n.alias("n"), F.posexplode("p")).groupBy("pos").agg(F.sum(F.col("n") * F.col("col")).alias("expected"))
    name = F.element_at(F.array(*map(F.lit, names)).cast("array<string>"), F.col("pos") + 1) if names else F.lit(None).cast("string")
    out = t.join(got, "source", "left").join(expected.select(name.alias("source"), "expected"), "source", "left").na.fill(0, ["documents", "tokens", "guessed_tokens", "most_copies", "expected"])
    whole, all_expected = F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.sum("expected").over(Window.partitionBy(F.lit(1)))  # one row per target source
    out = out.withColumn("share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)).withColumn("expected_share", F.when(all_expected > 0, F.col("expected") / all_expected).otherwise(0.0))
    return out.drop("expected")
