from pyspark.sql import functions as F

from pulsegrid.operators import logs as L
from pulsegrid.plans import event_queries as Q
from pulsegrid.session import table

LOG = "row_id bigint, log_key string, session int, marker string, category string, start_time double, end_time double"


def test_sets_close_once_at_their_last_trial(spark):
    names = ["nback_trial_1_set_1", "nback_trial_3_set_1", "nback_trial_20_set_1", "nback_trial_20_set_1", "final_test_trial_1_set_1", "final_test_trial_20_set_1", "final_test_trial_60_set_1"]
    log = spark.createDataFrame([(i, "k", 1, m, "Trial Sets", float(i), i + 0.5) for i, m in enumerate(names)], LOG)
    assert {(r.task, r.open_row, r.close_row, r.end_time) for r in L.set_spans(log).collect()} == {("nback", 0, 2, 2.5), ("final_test", 4, 6, 6.5)}


def test_every_category_has_an_indicator_and_every_pose_a_place(spark, data):
    log = table(spark, data, "log_events")
    hot = Q.category_indicators(spark, data)
    ones = hot.select(sum(F.col(f"`{c}`") for c in hot.columns[1:]).alias("n")).groupBy("n").count().collect()
    nulls = log.where("category is null").count()
    assert {r.n: r["count"] for r in ones} == {k: v for k, v in {0: nulls, 1: log.count() - nulls}.items() if v}
    poses = log.where("category = 'Yoga Poses' and log_key is not null")
    assert Q.yoga_schedule(spark, data).count() == poses.count() > 0
