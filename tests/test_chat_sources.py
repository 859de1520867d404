from collections import Counter

from pyspark.sql import functions as F

from ragtab.operators import chat as CH
from ragtab.session import work_path
from ragtab.sources import files as FS


def test_extension_keeps_rows_and_uses_each_row_n_times(spark):
    df = spark.createDataFrame([(i * 7, f"q{i}", f"a{i}", "" if i % 3 else "in") for i in range(50)],
                               "id long, instruction string, output string, input string").repartition(5)
    out = CH.extend_conversations(df, n=3).collect()
    assert len(out) == 50
    uses = Counter()
    for r in out:
        uses.update([r["id"], r["partner_1"], r["partner_2"]])
        assert len(r["conversations"]) == 6
    assert set(uses.values()) == {3}


def test_merge_prompt_drops_empty_input(spark):
    df = spark.createDataFrame([("Q", ""), ("Q", "x"), ("Q", None)], "instruction string, input string")
    got = [r[0] for r in df.select(CH.merge_prompt()).collect()]
    assert got == ["Q", "Q\nYour input is:\nx", "Q"]


def test_chat_template_renders_turns(spark):
    df = spark.createDataFrame([([("human", "hi"), ("gpt", "hello")],)], "c array<struct<`from`:string,value:string>>")
    text = df.select(CH.apply_chat_template(CH.standardize_roles("c"))).first()[0]
    assert text == ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n" + CH.DEFAULT_SYSTEM
                    + "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|>"
                    "<|start_header_id|>assistant<|end_header_id|>\n\nhello<|eot_id|>")


def test_csv_roundtrip_with_commas_quotes_newlines(spark):
    rows = [(1, 'a, "quoted"\nnew line', "x:latest"), (2, "plain", "llama3.1")]
    df = spark.createDataFrame(rows, "id long, question string, model string")
    p = work_path(spark, "csvtest")
    FS.write_qa_csv(df, p, partition_by=("model",))
    back = FS.read_qa_csv(spark, p, "id long, question string").withColumn("model", F.col("model").cast("string"))
    assert sorted(tuple(r) for r in back.select("id", "question", "model").collect()) == sorted(rows)


def test_results_tree_prunes_partitions(spark):
    df = spark.createDataFrame([("e", "gemma2", "x:latest", 1), ("e", "other", "m", 2), ("e", "llama3.1", "m", 3)],
                               "experiment string, verifier string, model string, id long")
    p = work_path(spark, "tree")
    FS.write_results(df, p)
    r = FS.read_results(spark, p, verifiers=["gemma2", "llama3.1"], models=["x:latest", "m"])
    assert sorted(x["id"] for x in r.collect()) == [1, 3]
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "verifier" in plan
    # a second write of the same partition replaces it (idempotent resume)
    FS.write_results(df.where("id = 1"), p)
    assert FS.read_results(spark, p).count() == 3


def test_experiments_scan_skips_notebook_folders(spark):
    df = spark.createDataFrame([("no_rag", "m1", 1), ("x.ipynb_checkpoints", "m1", 2)],
                               "experiment string, model string, id long")
    p = work_path(spark, "exp")
    FS.write_qa_csv(df, p, partition_by=("experiment", "model"))
    got = FS.read_experiments(spark, p, "id long").collect()
    assert [(r["experiment"], r["model"], r["id"]) for r in got] == [("no_rag", "m1", 1)]


def test_tokenizer_length_bound_slot(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "text string")
    counter = lambda texts: [len(t) for t in texts]          # characters as "tokens"
    got = [tuple(r) for r in df.select(*CH.tokenizer_length_bound("text", counter, limit=3)).collect()]
    assert got == [(5, True), (0, False), (0, False)]


def test_dense_positions_are_a_permutation(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id")).repartition(13)
    pos = CH.dense_positions(df, [F.col("k"), F.col("id")], "p", partitions=7)
    rows = sorted((r["k"], r["id"], r["p"]) for r in pos.collect())
    assert [r[2] for r in rows] == list(range(5000))
