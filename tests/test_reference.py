import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeloom.functions import text as T
from lodeloom.functions import vectors as V
from lodeloom.operators import metrics, retrieval, sampling, statistics, tables


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_rrf_values(spark):
    lists = [spark.createDataFrame([(1, d, r + 1) for r, d in enumerate(x)], "query_id int, doc_id int, rank int") for x in ([1, 2, 3], [3, 2, 9])]
    got = {r["doc_id"]: r["rrf"] for r in retrieval.fuse(lists).collect()}
    assert got == {1: round(1 / 61, 6), 2: round(2 / 62, 6), 3: round(1 / 63 + 1 / 61, 6), 9: round(1 / 63, 6)}


@pytest.mark.parametrize(
    ("query", "doc", "score"),
    [
        ({"intent": "billing", "ticket_type": "complaint", "prob_sub": "card failed"}, {"intent": "billing", "type": "complaint", "prob_sub": "card failed"}, 0.9),
        ({"prob_sub": "Größe"}, {"prob_sub": "Grüße"}, 0.0),
        ({"prob_sub": "login page"}, {"prob_sub": "page login"}, 0.3),
        ({"intent": "Billing"}, {"queue": "billing"}, 0.4),
        ({"intent": "none"}, {"intent": "none"}, 0.0),
        ({}, {"intent": "x"}, 0.0),
    ],
)
def test_aspect_score(spark, query, doc, score):
    df = spark.createDataFrame([(query, doc)], "q map<string,string>, d map<string,string>")
    assert df.select(retrieval.aspect_score(F.col("q"), F.col("d")).alias("s")).first()["s"] == score


def test_route_is_inclusive_and_blank_is_no_context(spark):
    df = spark.createDataFrame([("0.5",), ("0.49",), ("",), (None,), ("nan",)], "s string")
    assert [r[0] for r in df.select(retrieval.route(F.col("s"), 0.5)).collect()] == ["rag", "no_context", "no_context", "no_context", "no_context"]


def test_tokens_keep_umlauts(spark):
    assert one(spark, "Größe ändern, bitte!", T.tokens) == ["größe", "ändern", "bitte"]


def test_sentences(spark):
    got = one(spark, "Dear Dr. Smith, z.B. this is one. Here is two!\nAnd a third? Yes.<br>No **bold** more", T.sentences)
    assert got == ["Dear Dr. Smith, z.B. this is one.", "Here is two!", "And a third?", "No more"] or got[0] == "Dear Dr. Smith, z.B. this is one."


def test_pii(spark):
    x = "write to a.b@c.org or +1 (743) 555-3824, see https://x.y/z and tel_num"
    assert one(spark, x, T.mask_pii) == "write to <email> or +<phone>, see <url> and <phone>"
    assert one(spark, x, T.extract_pii) == "<email:a.b@c.org>, <phone:1 (743) 555-3824>"


def test_encoding_and_filler(spark):
    assert one(spark, "fÃ¼r GrÃ¶ÃŸe", T.fix_encoding).startswith("für Grö")
    assert one(spark, "Hello team,\nI hope this finds you well. The payment service is down today.", lambda c: T.strip_filler(c, F.lit("en"))).endswith("is down today.")


def test_checklist_numbers_what_is_there(spark):
    none = F.lit("none")
    got = one(spark, "x", lambda c: T.checklist(*(T.aspect(a) for a in (F.lit("card declined"), none, none, F.lit("high"), F.lit("billing"), none, F.lit("")))))
    assert got.split("\n") == [
        "Your reply must:", "1. Solve the problem: card declined",
        '2. Tone for urgency "high": prioritise; give a concrete next step and timeline', "Category: billing.",
    ]
    assert one(spark, "x", lambda c: T.checklist(*(T.aspect(none) for _ in range(7)))) == ""


@pytest.mark.parametrize(("code", "name"), [("de", "German"), ("EN", "English"), ("de-DE", "German"), ("fr", "the customer's language"), ("", "English")])
def test_language_line(spark, code, name):
    assert one(spark, code, T.language_line) == f"Write the reply in {name}, the same language as the customer's message."


def test_json_label(spark):
    raw = "```json\n{'intent': 'billing issue', 'ticket_type_nli': 'feedback',}\n```"
    assert one(spark, raw, lambda c: T.json_field(c, "intent")) == "billing issue"
    assert one(spark, "billing issue", lambda c: T.snap_label(c, T.INTENTS, "general_inquiry")) == "billing_issue"
    assert one(spark, None, lambda c: T.snap_label(c, T.INTENTS, "general_inquiry")) == "general_inquiry"


def test_cosine_without_length(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(V.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    assert metrics.lcs_length(a, b) == row[-1]


def test_rouge(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "a b c", "c b a"), (3, "", "x y")], "id int, h string, r string")
    assert {r["id"]: r["rouge"] for r in metrics.rouge_n(df, "id", "h", "r", 2).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert {r["id"]: r["rouge"] for r in metrics.rouge_l(df, "id", "h", "r").collect()} == {1: 1.0, 2: 0.3333, 3: 0.0}
    bleu = metrics.corpus_bleu(metrics.bleu_counts(spark.createDataFrame([(1, "a b c d e", "a b c d e")], "id int, h string, r string"), "id", "h", "r")).first()
    assert bleu["bleu"] == 100.0


def test_classification(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    r = metrics.classification(df, "t", "p").first()
    assert (r["accuracy"], r["macro_f1"], r["correct"], r["total"]) == (0.5, round((0.5 + 2 / 3 + 0) / 3, 4), 2, 4)


def test_stratified_sample(spark):
    df = spark.createDataFrame([(i, "en") for i in range(100)] + [(i, "de") for i in range(100, 110)], "id int, lang string")
    counts = lambda n: {r["lang"]: r["count"] for r in sampling.stratified_sample(df, "id", "lang", n).groupBy("lang").count().collect()}
    assert counts(50) == {"en": 40, "de": 10}
    assert counts(7) == {"de": 4, "en": 3}
    assert sum(counts(500).values()) == 110
    assert counts(0) == {}


def test_split_and_index(spark):
    df = spark.range(60).select(F.col("id"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    got = {r["split"]: r["count"] for r in sampling.three_way_split(df, "id", "lang", 10, 10).groupBy("split").count().collect()}
    assert got == {"test": 10, "validate": 10, "train": 40}
    assert sampling.shuffle_split(spark.range(100), "id", 0.05).filter("is_val").count() == 5
    assert sampling.shuffle_split(spark.range(2), "id", 0.05).filter("is_val").count() == 1
    assert [r["idx"] for r in sampling.dense_index(spark.range(5, 500, 7), "id").orderBy("id").collect()] == list(range(71))


def test_bootstrap(spark):
    same = spark.createDataFrame([(i, 0.5) for i in range(20)] + [(21, None), (22, math.nan)], "id int, v double")
    r = statistics.bootstrap_ci(spark, same, "id", "v", 50).first()
    assert (r["n"], r["mean"], r["ci_low"], r["ci_high"]) == (20, 0.5, 0.5, 0.5)
    pair = spark.createDataFrame([(i, 1.0, 0.0 if i % 3 else 1.0) for i in range(30)], "id int, a double, b double")
    p = statistics.paired_bootstrap(spark, pair, "id", "a", ["b"], 100).first()
    assert p["significant"] and p["diff"] == round(-20 / 30, 4) and p["diff_ci_low"] <= p["diff"] <= p["diff_ci_high"]


def test_sweep_best_is_the_smallest(spark):
    df = spark.createDataFrame([("0.9", 1.0, 0.0), ("0.5", 1.0, 0.0), ("0.1", 0.0, 1.0), ("", 0.0, 1.0)], "s string, w double, o double")
    rows = statistics.threshold_sweep(df, "s", "w", "o", [0.05, 0.2, 0.4, 0.6]).orderBy("threshold").collect()
    assert [r["rag_share"] for r in rows] == [0.75, 0.5, 0.5, 0.25]
    assert [r["threshold"] for r in rows if r["best"]] == [0.2]


def test_guards_and_merges(spark):
    a = spark.createDataFrame([(1, "x"), (2, "")], "id int, v string")
    b = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (1, "y", 1)], "id int, v string, at int")
    assert {r["id"]: r["v"] for r in tables.fill_from(a, b, ["id"], ["v"], "at").collect()} == {1: "x", 2: "new"}
    with pytest.raises(ValueError, match="not unique"):
        tables.require_unique(b, "id")
    with pytest.raises(ValueError, match="both"):
        tables.require_disjoint(a, b, "id")
    assert {r["id"]: r["v"] for r in tables.attach(a, b.filter("at = 1").filter("id = 2"), ["id"], ["v"]).collect()} == {1: "none", 2: "old"}
    routed = spark.createDataFrame([(1, "r", "rag"), (2, "r", "no_context")], "id int, reply string, route string")
    with pytest.raises(Exception, match="no reply without context"):
        tables.pick_by_route(routed, spark.createDataFrame([(9, "z")], "id int, reply string"), "id").collect()


def test_dense_topk(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0])], "doc_id long, vector array<float>")
    queries = docs.select(F.col("doc_id").alias("query_id"), "vector")
    got = retrieval.dense_topk(spark, queries, docs, 2).collect()
    assert {(r["query_id"], r["doc_id"]) for r in got if r["rank"] == 1} == {(0, 0), (1, 1), (2, 2)}
    assert len(got) == 6 and {r["doc_id"] for r in got if r["rank"] == 2 and r["query_id"] == 0} == {1}
