"""Bounds of words and means that lie on a threshold, where two engines may differ."""

import random

from tripleweft.operators import dialogue
from tripleweft.plans.catalog import QUERIES

from pyspark.sql import functions as F

TEXTS = {"la noé est": "correction", "éis là": "question", "noël wait-less": "correction", "le isé butç": "question", "so\n?": "question", "build it?\n": "request", "that\rs not so": "correction", "ok, é": "acknowledgement"}


def test_letters_beyond_ascii_bound_a_word(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", dialogue.user_act(F.col("text")).alias("act")).collect()
    assert {r.text: r.act for r in rows} == TEXTS


def test_user_acts_on_marked_letters(spark, tmp_path):
    """As DuckDB tells them, over texts whose letters are marked."""
    import duckdb

    from tripleweft.plans.catalog import SQL

    g = random.Random(3)
    texts = [" ".join(g.choice(["no", "is", "but", "ok", "build", "de", "why"]) + g.choice(["", "é", "ç", "_", "?", "è"]) for _ in range(2)) for _ in range(400)]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name, of in (("fm21_user_acts", "session, act, need, pressure, level"), ("fm21_focus", "session, act, term, focus")):
        got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).selectExpr(*of.split(", ")).orderBy("session").collect()]
        assert got == con.sql(f"SELECT {of} FROM ({SQL[name]}) ORDER BY 1").fetchall()


def test_a_mean_on_the_threshold_is_not_uncertain(spark, tmp_path):
    """0.052 is not over 0.052, in whatever order the lines come."""
    g = random.Random(5)
    rows = []
    for k in range(40):
        lines = [(k, v / 100, "A") for v in [6] * 200 + [2] * 50 + [5, 5, 6, 5, 5] * 100 + [0, 10, 6, 6, 4] * 10]
        g.shuffle(lines)
        rows += lines
    assert all(sum(round(100 * r[1]) for r in rows[i : i + 800]) * 10 == 52 * 800 for i in range(0, len(rows), 800))
    spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {r.zone for r in QUERIES["fm15_policy_zones"](spark, str(tmp_path)).collect()} == {"stable"}
