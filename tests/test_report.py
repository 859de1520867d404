
from ragtab.functions.text import word_count, words_per_second
from ragtab.operators import report as R

SCHEMA = ("experiment string, verifier string, model string, id long, consistent string, consistent_kind string, "
          "sem_score double, time double, tps double")


def _judged(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_leaderboard_with_verifier_missing_for_one_model(spark):
    rows = [
        ("e", "gemma2", "m1", 1, "True", "str", 0.9, 1.0, 2.0),
        ("e", "gemma2", "m1", 2, "False", "str", 0.1, 3.0, 4.0),
        ("e", "llama3.1", "m1", 1, "True", "str", 0.9, 1.0, 2.0),
        ("e", "llama3.1", "m1", 2, "True", "str", 0.1, 3.0, 4.0),
        ("e", "llama3.1", "m.2", 1, "True", "bool", 0.8, 5.0, 6.0),   # judged by one verifier only
    ]
    b = {r["model"]: r.asDict() for r in R.leaderboard(_judged(spark, rows)).collect()}
    assert b["m1"]["gemma2_accuracy"] == 0.5 and b["m1"]["llama3.1_accuracy"] == 1.0
    assert b["m1"]["sem_accuracy"] == 0.5                      # from the lowest verifier name
    assert b["m1"]["average_accuracy"] == round((0.5 + 1.0 + 0.5) / 3, 6)   # sem_accuracy included
    assert b["m1"]["judge_accuracy"] == 0.75
    assert b["m1"]["time"] == 2.0 and b["m1"]["tps"] == 3.0
    assert b["m.2"]["gemma2_accuracy"] is None                 # absent verifier: skipped, not zero
    assert b["m.2"]["llama3.1_accuracy"] == 0.0                # bare True is not the string 'True'
    assert b["m.2"]["average_accuracy"] == round((0.0 + 1.0) / 2, 6)
    cols = R.leaderboard(_judged(spark, rows)).columns
    assert cols == ["experiment", "model", "time", "tps", "gemma2_accuracy", "llama3.1_accuracy",
                    "sem_accuracy", "average_accuracy", "judge_accuracy"]


def test_filtered_leaderboard_lenient_and_empty_subset(spark):
    rows = [("e", "gemma2", "m1", 1, "True", "bool", 0.9, 1.0, 2.0), ("e", "gemma2", "m1", 2, "False", "str", 0.1, 1.0, 2.0),
            ("e", "llama3.1", "m1", 1, "true", "str", 0.2, 1.0, 2.0)]
    ids = spark.createDataFrame([(1,)], "id long")
    r = R.leaderboard_filtered(_judged(spark, rows), ids).first()
    assert r["gemma2_accuracy"] == 1.0 and r["llama3.1_accuracy"] == 1.0   # lenient counts bare/lower-case true
    assert r["sem_accuracy"] == 0.0                                         # last verifier wins
    empty = spark.createDataFrame([], "id long")
    none = R.leaderboard_filtered(_judged(spark, rows), empty).collect()
    assert [r["model"] for r in none] == ["m1"] and none[0]["gemma2_accuracy"] is None and none[0]["average_accuracy"] is None
    more = rows + [("e", "gemma2", "m2", 2, "True", "str", 0.9, 1.0, 2.0)]
    b = {r["model"]: r for r in R.leaderboard_filtered(_judged(spark, more), ids).collect()}
    assert b["m2"]["gemma2_accuracy"] is None and b["m1"]["gemma2_accuracy"] == 1.0    # no row in the subset: NULL, not gone


def test_sorted_leaderboard_order(spark):
    rows = [("e", "gemma2", m, 1, c, "str", 0.0, 1.0, 1.0) for m, c in [("b", "True"), ("a", "False"), ("c", "False")]]
    got = [r["model"] for r in R.sort_leaderboard(R.leaderboard(_judged(spark, rows))).collect()]
    assert got == ["a", "c", "b"]


def test_word_counts_and_rate(spark):
    df = spark.createDataFrame([("",), ("a\tb",), ("a b",), (None,), ("  x  y ",)], "t string")
    got = [r[0] for r in df.select(word_count("t")).collect()]
    assert got == [0, 2, 2, 0, 2]      # like str.split(): no-break space separates, '' has no word
    r = spark.createDataFrame([("a b", 0.0), ("a b", 2.0)], "t string, s double").select(words_per_second("t", "s")).collect()
    assert r[0][0] is None and r[1][0] == 1.0
