"""Searches and evaluations that run once."""

from pyspark.sql import functions as F

from lodeloom.functions import text as T
from lodeloom.operators import index as search_index
from lodeloom.operators import models, report, retrieval, runners

EMBEDDER = runners.Embedder(lambda c: models.hashed_embedding(c, 64))


def corpus(spark, root):
    rows = [(i, f"Subject {i}", f"{w} problem {i}", f"Answer for {w} {i}", "en", {"queue": w}, f"{w} problem {i}") for i, w in enumerate(["password", "invoice", "router", "password"])]
    docs = spark.createDataFrame(rows, "doc_id long, subject string, body string, response string, language string, aspects map<string,string>, text string")
    return search_index.build_index(spark, docs.withColumn("vector", models.hashed_embedding(F.col("text"), 64)), root)


def tickets(spark):
    rows = [(10, "en", "Help", "my password problem", "A", {"prob_sub": "password problem", "cause": "none"}), (11, "de", None, "", "B", None), (12, None, "S", "invoice problem", None, {})]
    return spark.createDataFrame(rows, "idx long, language string, subject string, body string, answer string, spans map<string,string>")


def test_systems_share_their_searches(spark, tmp_path, monkeypatch):
    index, ran = corpus(spark, f"{tmp_path}/i"), []
    systems = [runners.system(name, embedder=EMBEDDER) for name in runners.SYSTEMS]
    alone = {(r["system"], r["idx"]): r for s in systems for r in runners.run(tickets(spark), s, index).collect()}
    for module in (runners, retrieval):
        for name in ("dense_search", "bm25_search"):
            monkeypatch.setattr(module, name, lambda *a, f=getattr(search_index, name), n=name: ran.append(n) or f(*a))
    got = {(r["system"], r["idx"]): r for r in runners.run_all(tickets(spark), systems, index).collect()}
    assert got == alone and len(got) == 27
    assert sorted(ran) == ["bm25_search", "dense_search", "dense_search"]


def test_hits_are_read_once(spark, tmp_path):
    index = corpus(spark, f"{tmp_path}/i")
    asked = tickets(spark).select(
        F.col("idx").alias("query_id"), F.col("body").alias("text"), models.hashed_embedding(F.col("body"), 64).alias("vector"), "language", F.array("idx").alias("exclude"), "spans",
        F.lit("password").alias("queue"), F.lit("none").alias("intent"), F.lit("Answer for password").alias("answer"),
    )
    out = report.evaluate_hits(asked, retrieval.retrieve(asked, index), {"shared": lambda reply, gold: retrieval.overlap_score(T.tokens(gold), T.tokens(reply))})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # one for each search
    got = {r["query_id"]: r for r in out.collect()}
    assert got[10]["n_hits"] == 3 and got[10]["shared"] == 1.0 and got[10]["intent_at_k"] == round(2 / 3, 4) and got[12]["shared"] == round(2 / 3, 4)


def test_candidates_are_scored_without_responses(spark, tmp_path):
    """What is ranked has no text that a hit only shows: no window's rows hold a response."""
    index = corpus(spark, f"{tmp_path}/i")
    asked = tickets(spark).select(F.col("idx").alias("query_id"), F.col("body").alias("text"), F.lit(None).cast("array<float>").alias("vector"), "language", F.array("idx").alias("exclude"), "spans")
    plan = retrieval.retrieve(asked, index)._jdf.queryExecution().optimizedPlan()

    def walk(node):
        yield node
        for k in range(node.children().size()):
            yield from walk(node.children().apply(k))

    windows = [n for n in walk(plan) if n.nodeName().startswith("Window")]
    assert windows and not any(w.output().apply(k).name() in ("response", "body", "text") for w in windows for k in range(w.output().size()))
