"""The splittable CSV reader against Spark's multiLine reader, with splits of a few bytes."""

import random

import pytest

from ragtab.session import work_path
from ragtab.sources import files as FS
from ragtab.sources import quoted_csv as Q

SCHEMA = "id long, question string, response string"


def quoted(x):
    return '"' + x.replace('"', '""') + '"'


def cell(rng):
    x = "".join(rng.choice(['a', 'é', ' ', ',', '"', '""', '\n', '\n\n', "'", 'long text ', '\\']) for _ in range(rng.randrange(12)))
    return quoted(x) if x and (set(x) & set('",\n') or rng.random() < 0.5) else x


def write(spark, files, line="\n"):
    import os

    root = work_path(spark, "csv").removeprefix("file:")
    os.makedirs(root)
    for name, rows in files.items():
        with open(f"{root}/{name}", "w", newline="") as f:
            f.write(line.join(["id,question,response", *rows]) + rng_end(rows) * line)
    return root


def rng_end(rows):
    return len(rows) % 2


def both(spark, path, split):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = Q.read_quoted_csv(spark, path, SCHEMA)
        lines = spark.read.text(path).rdd.getNumPartitions()
        return sorted(map(tuple, df.collect()), key=repr), lines
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def plain(spark, path):
    df = (spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path))
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("split", [23, 64, 1000, 1 << 27])
@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_equals_the_multiline_reader(spark, split, line):
    rng = random.Random(split)
    rows = [f"{i},{cell(rng)},{cell(rng)}" for i in range(120)]
    rows[7] = f"7,{quoted('x' * 300 + chr(10) * 90 + 'y')},z"      # over many splits, some of them without a quote
    rows[8] = "8," + quoted('""\n' * 40) + ","
    path = write(spark, {"a.csv": rows, "b.csv": rows[:3], "c.csv": []}, line)
    got, parts = both(spark, path, split)
    assert got == plain(spark, path)
    assert split > 1000 or parts > 5


def test_header_over_splits_and_open_quote(spark):
    import os

    root = work_path(spark, "csv").removeprefix("file:")
    os.makedirs(root)
    with open(f"{root}/a.csv", "w") as f:
        f.write('id,"question\n' + "x\n" * 30 + '",response\n1,a,b\n\n2,"never closed\n3,c,d\n4,e,f')
    for split in (11, 40, 1 << 20):
        got, _ = both(spark, root, split)
        assert got == plain(spark, root)


def test_results_tree_with_dotted_names_and_notebook_folder(spark):
    """S2, S3, F-stem, P9 through the splittable reader."""
    import os

    root = work_path(spark, "tree").removeprefix("file:")
    for exp, model in (("no_rag", "llama3.1"), ("no_rag", "phi3"), (".ipynb_checkpoints", "phi3")):
        os.makedirs(f"{root}/{exp}/{model}", exist_ok=True)
        with open(f"{root}/{exp}/{model}/x.csv", "w") as f:
            f.write('id,question,response\n1,"a\nb",c\n')
    got = FS.read_experiments(spark, root, SCHEMA).select("experiment", "model", "question").collect()
    assert sorted(map(tuple, got)) == [("no_rag", "llama3.1", "a\nb"), ("no_rag", "phi3", "a\nb")]


def test_other_files_are_not_read_and_small_splits_share_tasks(spark, tmp_path):
    """The allow-lists choose files before any is read; thousands of splits don't become thousands of tasks."""
    rows = [(m, v, i, "a\n\"b\"," * 40) for m in ("m.1", "m2") for v in ("v", "n.ipynb") for i in range(400)]
    FS.write_results_csv(spark.createDataFrame(rows, "model string, verifier string, id long, question string"), str(tmp_path))
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    df = FS.read_results_csv(other, str(tmp_path), "id long, question string", models=["m.1"])
    lines = other.read.text(f"{tmp_path}/*/*.csv").rdd.getNumPartitions()
    assert lines > 300 and df.rdd.getNumPartitions() < lines / 2
    assert sorted(tuple(r) for r in df.select("verifier", "model", "id", "question").collect()) == [("v", "m.1", i, "a\n\"b\"," * 40) for i in range(400)]
    for f in tmp_path.glob("*/m2.csv"):
        f.write_bytes(b"\xff" * 9 + b'"')
    assert df.count() == 400
