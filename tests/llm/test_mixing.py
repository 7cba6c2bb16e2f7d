import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import encode as N
from pulsegrid.llm.mixing import fit_classifier, fit_rates, memberships, mix, reached
from pulsegrid.session import written

pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(N.TOKENIZERS), reason="no vocabulary files here")
DOC, TARGET = "doc_id bigint, text string, source string, fit string, tokens string", "source string, target_share double, max_repeats int"
WORDS = {"news": "minister said today vote party market".split(), "code": "def return self import class lambda".split(), "chem": "acid ester mol solvent yield reflux".split()}


def corpus(n, seed=0, spelled=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choices(["news", "code", "chem"], [0.7, 0.25, 0.05])[0]
        text = " ".join(rng.choices(WORDS[s], k=rng.randint(20, 60)))
        label = None if i % 25 == 0 else rng.choice([s, s.upper(), f"{s} "]) if spelled else s
        rows.append((i, text, label, s, "clash"))
    return rows


def test_shares_are_reached_within_the_caps(spark):
    docs = spark.createDataFrame(corpus(3000), DOC)
    targets = spark.createDataFrame([("news", 0.5, 1), ("code", 0.3, 2), ("chem", 0.2, 4)], TARGET)
    used = written(mix(docs, targets, with_memberships=True), "test")
    shares = {r.source: r for r in reached(used, targets).collect()}
    for s, want, cap in (("news", 0.5, 1), ("code", 0.3, 2), ("chem", 0.2, 4)):
        assert shares[s].share == pytest.approx(want, abs=0.01) and shares[s].most_copies <= cap and shares[s].expected_share == pytest.approx(want, abs=0.02)
    assert sum(r.share for r in shares.values()) == pytest.approx(1)
    assert used.count() == used.select("doc_id").distinct().count()
    right = used.where("guessed").join(docs.select("doc_id", F.col("fit").alias("truth")), "doc_id")
    assert right.where("source = truth").count() > 0.9 * right.count() > 0


def test_rows_are_told_apart_and_labels_are_weighed(spark):
    docs = spark.createDataFrame(corpus(800, 1), DOC)
    names = ["chem", "code", "news"]
    model = fit_classifier(docs, names)
    assert sum(model.held_out) > 50 and sum(model.right) > 0.95 * sum(model.held_out)
    p = memberships(docs, names, model).collect()
    truth = {r.doc_id: r.fit for r in docs.collect()}
    got = [(max(zip(r.p, names))[1], truth[r.doc_id]) for r in p if r.source is None]
    assert len(got) == 32 and sum(a == b for a, b in got) >= 30
    assert all(sum(r.p) == pytest.approx(1) for r in p)
    wrong = memberships(spark.createDataFrame([(1, " ".join(WORDS["code"] * 6), "news", "", ""), (2, " ".join(WORDS["news"] * 6), "news", "", "")], DOC), names, model).orderBy("doc_id").collect()
    assert wrong[0].p[1] > 0.1 > wrong[1].p[1] and wrong[1].p[2] > 0.95  # a label that the text contradicts leaves a doubt


def test_no_document_is_used_more_often_than_the_source_it_is_counted_for_allows(spark):
    targets = spark.createDataFrame([(f"s{i}", 1 / 25, 1 + i % 3) for i in range(25)], TARGET)
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("alpha beta gamma delta".split(), k=30)), f"s{i % 25}" if i % 4 else None, "", "") for i in range(1500)], DOC)
    used = mix(docs, targets).collect()
    caps = {f"s{i}": 1 + i % 3 for i in range(25)}
    assert all(r.copies <= caps[r.source] for r in used) and sum(r.guessed for r in used) > 200  # flat posteriors over 25 sources leave nobody without a cap


def test_rates_meet_both_kinds_of_totals(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(4000):
        i, q = rng.randrange(3), rng.uniform(0.3, 1)
        p = [(1 - q) / 2] * 3
        p[i] = q
        rows.append((rng.randint(50, 500), 2.0, [float(i == j) for j in range(3)] + p))
    members = spark.createDataFrame(rows, "tokens bigint, cap double, m array<double>")
    shares = [0.5, 0.3, 0.2]
    rated, total = fit_rates(members, shares)
    got = rated.selectExpr(*[f"sum(tokens * rate * m[{i}]) as s{i}" for i in range(6)], "min(rate) as low", "max(rate) as high").first()
    assert got.low >= 0 and got.high <= 2
    assert [got[i] / total for i in range(3)] == pytest.approx(shares, abs=1e-4)
    only, _ = fit_rates(members, shares, rounds=0)
    apart = only.selectExpr(*[f"sum(tokens * rate * m[{i}]) as s{i}" for i in range(3, 6)]).first()
    assert sum(abs(got[i + 3] / total - s) for i, s in enumerate(shares)) < 0.7 * sum(abs(x / total - s) for x, s in zip(apart, shares))


def test_more_rows_asked_for_than_there_are(spark):
    assert fit_classifier(spark.createDataFrame(corpus(400, 2), DOC), ["chem", "code", "news"], fit_rows=10**9) is not None


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "one two three", "news", "", ""), (2, None, "news", "", ""), (3, "", "code", "", ""), (4, "x y", "other", "", ""), (5, "a b c", None, "", "")], DOC)
    t = lambda *rows: spark.createDataFrame(list(rows), TARGET)
    assert {r.doc_id for r in mix(docs, t(("news", 1.0, 1))).collect()} == {1, 5}
    assert mix(docs, t(("news", 0.5, 1), ("nowhere", 0.5, 1))).count() == 0
    assert mix(docs, t()).count() == 0 and mix(docs.where("false"), t(("news", 1.0, 1))).count() == 0
    assert mix(docs, t(("news", None, None), (None, 1.0, 1))).count() == 0
    assert [r.share for r in reached(mix(docs.where("false"), t(("news", 1.0, 1)), with_memberships=True), t(("news", 1.0, 1))).collect()] == [0.0]
