
from ragtab.operators import retrieve as RT
from ragtab.operators import route as RO


def test_threshold_acts_after_rerank(spark):
    # first stage: d1 is best (shares most tokens); rerank by Jaccard prefers d2/d3;
    # threshold on the first-stage score then drops d3 although it ranked in the top 3.
    q = spark.createDataFrame([(1, "a b c d")], "id long, question string")
    d = spark.createDataFrame([(1, "a b c d a b c d e f g h i j k", "r1"), (2, "a b c", "r2"),
                               (3, "a z", "r3"), (4, "q", "r4")],
                              "doc_id long, question string, response string")
    hits = RT.retrieve_hits(q, d, advanced=True, threshold=0.6).orderBy("rank").collect()
    assert [h["doc_id"] for h in hits] == [2, 1]
    assert all(h["score"] > 0.6 for h in hits)
    assert hits[0]["rerank_score"] == 0.75


def test_context_is_empty_string_without_hits(spark):
    q = spark.createDataFrame([(1, "nothing shared"), (2, "alpha")], "id long, question string")
    d = spark.createDataFrame([(9, "alpha", "A")], "doc_id long, question string, response string")
    ctx = {r["id"]: r["context"] for r in RT.retrieve(q, d, k=2, as_prompt=True).collect()}
    assert ctx[1] == ""
    assert ctx[2] == "Use the following information to generate your answer:\n- A\n"


def test_missing_key_column_is_reported(spark):
    q = spark.createDataFrame([(1, "x")], "id long, question string")
    d = spark.createDataFrame([(1, "x")], "doc_id long, question string")
    try:
        RT.retrieve_hits(q, d)
    except ValueError as e:
        assert "response" in str(e)
    else:
        raise AssertionError("expected a ValueError")


def test_confusion_includes_unseen_and_predicted_only_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "type string, rtype string")
    long = {(r["type"], r["rtype"]): r["n"] for r in RO.confusion_long(df).collect()}
    assert len(long) == 9 and long[("a", "b")] == 1 and long[("b", "b")] == 0 and long[("c", "a")] == 1
    acc = RO.routing_accuracy(df).first()
    assert acc["n"] == 3 and acc["accuracy"] == round(1 / 3, 6)


def test_route_cascade_order(spark):
    corpus = spark.createDataFrame([(1, "how do I reset my password", "use the portal")],
                                   "doc_id long, question string, response string")
    qs = spark.createDataFrame([(1, "how do I reset my password"), (2, "Is ACME hiring?"),
                                (3, "my network was hacked"), (4, "why is the sky blue"),
                                (5, "acme firewall question")], "id long, question string")
    r = {x["id"]: x["rtype"] for x in RO.route(qs, corpus).collect()}
    assert r == {1: "retrieval", 2: "company_specific", 3: "generic_cyber", 4: "generic_external",
                 5: "company_specific"}


def test_dedupe_questions_option(spark):
    q = spark.createDataFrame([(1, "same text")], "id long, question string")
    d = spark.createDataFrame([(5, "same text", "r5"), (3, "same text", "r3"), (9, "same", "r9")],
                              "doc_id long, question string, response string")
    keep = [h["doc_id"] for h in RT.retrieve_hits(q, d, k=3).orderBy("rank").collect()]
    dedup = [h["doc_id"] for h in RT.retrieve_hits(q, d, k=3, dedupe_questions=True).orderBy("rank").collect()]
    assert keep == [3, 5, 9] and dedup == [3, 9]


def test_judge_prompt_nan_text(spark):
    from ragtab.functions import prompts as P
    df = spark.createDataFrame([(None, "truth")], "a string, b string")
    plain = df.select(P.judge_system("a", "b")).first()[0]
    nan = df.select(P.judge_system("a", "b", nan_text=True)).first()[0]
    assert "A: \n\nB: truth" in plain and "A: nan\n\nB: truth" in nan


def test_route_with_model_short_circuits(spark):
    asked = spark.sparkContext.accumulator(0)

    def scorer(system, prompt, model):
        asked.add(1)
        q = prompt.split(": ", 1)[1].lower()
        if "company" in system.lower() or "acme" in system.lower():
            return "True" if "acme" in q else "False."
        return "TRUE" if ("hack" in q or "network" in q) else "no"

    corpus = spark.createDataFrame([(1, "how do I reset my password", "use the portal")],
                                   "doc_id long, question string, response string")
    qs = spark.createDataFrame([(1, "how do I reset my password"), (2, "Is ACME hiring?"),
                                (3, "my network was hacked"), (4, "why is the sky blue")], "id long, question string")
    r = {x["id"]: x["rtype"] for x in RO.route_with_model(qs, corpus, scorer).collect()}
    assert r == {1: "retrieval", 2: "company_specific", 3: "generic_cyber", 4: "generic_external"}
    assert asked.value == 3 + 2          # company test for 3 questions, cyber test only for the 2 left
