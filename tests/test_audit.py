"""Run log and audit helpers (A3, W1-W3) and the SQL views."""

import os
import tempfile

from pyspark.sql import functions as F

from sombra.functions.sql import register_findings, register_masked_table
from sombra.operators import audit as A
from sombra.operators.mask import MaskRules


def test_eta_progress_and_moving_window(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 41)], "batch_id int, rows_per_s double")
    out = A.moving_speed(df, None, ["batch_id"], "rows_per_s", window=30).orderBy("batch_id").collect()
    assert out[0].speed_30 == 1.0 and out[-1].speed_30 == sum(range(11, 41)) / 30
    r = spark.range(1).select(A.eta(F.lit(7322), F.lit(1.0)).alias("e"), A.eta(F.lit(5), F.lit(0.0)).alias("z"),
                              A.progress(F.lit(3), F.lit(4)).alias("p")).first()
    assert r.e == "2h 02m 02s" and r.z is None and r.p == 0.75


def test_run_log_append(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="sombra-log-"), "log")
    rec = {"run_id": "r1", "batch_id": 1, "phase": "done", "table_name": "t", "tables_done": 1,
           "tables_total": 1, "rows_done": 10, "rows_total": 10, "rows_per_s": 5.0,
           "elapsed_s": 2.0, "finished": True}
    A.append_run_log(spark, path, [rec])
    A.append_run_log(spark, path, [dict(rec, batch_id=2)])
    assert spark.read.parquet(path).count() == 2


def test_audit_summary_counts(spark, key):
    df = spark.createDataFrame([("a@b.com e c@d.com",), ("nada",), ("   ",), (None,)], "t string")
    got = {r.metric: r.value for r in A.audit_summary(df, "t", MaskRules.only("EMAIL"), key).collect()}
    assert got["cells_evaluated"] == 2 and got["cells_changed"] == 1 and got["span_substitutions"] == 2
    assert got["persons_protected"] == 0


def test_sql_views(spark, key):
    people = spark.createDataFrame([(1, "user1@example.com", "texto a@b.com")], "id int, email string, obs string")
    register_masked_table(people, "people_masked", {"email": "EMAIL", "obs": "TEXTO_LIVRE"}, key)
    row = spark.sql("SELECT email, obs FROM people_masked").first()
    assert row.email != "user1@example.com" and "a@b.com" not in row.obs
    register_findings(people, "people_findings", "id", "obs", MaskRules(names=False))
    f = spark.sql("SELECT id, type, value FROM people_findings").collect()
    assert [(r.id, r.type, r.value) for r in f] == [(1, "EMAIL", "a@b.com")]


def test_moving_window_of_a_hot_user_spans_tasks(spark):
    """Equal to the plain window, with one user holding most rows, blocks of 30
    rows, null values and a null user."""
    import random

    from pyspark.sql import Window
    r = random.Random(7)
    rows = [(i, r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, float(r.randrange(99))])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, user string, v double")
    got = A.moving_window(df, "user", ["id"], "v", window=30, block=30)
    w = Window.partitionBy("user").orderBy("id").rowsBetween(-29, 0)
    want = (df.withColumn("sum_30", F.sum("v").over(w)).withColumn("n_30", F.count(F.lit(1)).over(w))
            .withColumn("mean_30", F.avg("v").over(w)))
    assert got.columns == want.columns
    order = lambda d: sorted((tuple(x) for x in d.collect()), key=lambda x: x[0])
    assert order(got) == order(want)
    # the hot user's rows lie in many groups of the window
    placed = A.row_numbers(df, ["user"], ["id"])
    assert placed.where("user = 'hot'").agg(F.countDistinct(F.floor(F.col("_pos") / 30))).first()[0] > 60
    assert placed.where("user = 'hot'").agg(F.countDistinct("_pos"), F.max("_pos") + 1).first()[0] == placed.where("user = 'hot'").count()
    assert A.moving_window(df.limit(0), None, ["id"], "v").collect() == []
