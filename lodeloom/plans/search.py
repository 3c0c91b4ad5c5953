"""Queries on search: the stored index, single and fused lists, whole retrieval, its evaluation, prompts and training examples."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeloom.functions import prompts as P
from lodeloom.functions import text as T
from lodeloom.operators import index as search_index
from lodeloom.operators import metrics, raft, report, retrieval, sampling
from lodeloom.session import delete, shared_dir

from .registry import TICKETS, TOKENS, read, register, tickets

#: Roots of the indexes of this application, by application and data: each is written once.
_INDEXES: dict[tuple[str, str], str] = {}
#: Characters of a retrieved response in a prompt, and words that a prompt may have.
RESPONSE, BUDGET = 1200, 1024


def _index(spark: SparkSession, sf: str) -> search_index.Index:
    """The index of all documents; their vectors are the embeddings of the same number."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        docs = tickets(spark, sf)
        vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
        aspects = F.create_map(F.lit("queue"), F.col("queue"), F.lit("type"), F.col("language"))
        rows = docs.join(vectors, "idx", "left").select(
            F.col("idx").alias("doc_id"), "subject", "body", F.col("body").alias("response"), "language", aspects.alias("aspects"), F.col("body").alias("text"), "vector"
        )
        root = f"{shared_dir(spark)}/lodeloom/index-{uuid.uuid4().hex[:12]}"
        search_index.build_index(spark, rows, root)
        atexit.register(delete, spark, root)
        _INDEXES[key] = root
    return search_index.open_index(spark, _INDEXES[key])


def _dense(spark: SparkSession, sf: str, k: int) -> DataFrame:
    e = read(spark, sf, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search_index.dense_search(queries, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), k)


def _dense_sql(k: int) -> str:
    return f"""(SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0)) WHERE rank <= {k})"""


def _bm25(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The whole texts of every twentieth document as queries."""
    queries = read(spark, sf, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search_index.bm25_search(queries, _index(spark, sf), k)


def _bm25_sql(k: int) -> str:
    words = f"list_filter({TOKENS.format('text')}, lambda t: length(t) >= 2)"
    return f"""(WITH w AS (SELECT doc_id, {words} AS w FROM documents),
    q AS (SELECT DISTINCT doc_id AS query_id, unnest(w) AS term FROM w WHERE doc_id % 20 = 0),
    tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
    post AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w) GROUP BY 1, 2, 3),
    freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 4) AS score
        FROM q JOIN post USING (term) JOIN freq USING (term), tot GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k})"""


@register("SELECT query_id, doc_id, round(score, 4) AS score, rank FROM " + _dense_sql(10))
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, 10).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@register("SELECT query_id, doc_id, score, rank FROM " + _bm25_sql(20))
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, 20).select("query_id", "doc_id", "score", "rank")


@register(f"""WITH w AS (SELECT doc_id, list_filter({TOKENS.format('text')}, lambda t: length(t) >= 2) AS w FROM documents),
t AS (SELECT term, count(*) AS df, sum(tf) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY 1, 2) GROUP BY term)
SELECT (SELECT count(*) FROM w) AS n, (SELECT round(avg(len(w)), 4) FROM w) AS avgdl, count(*) AS terms, sum(df)::BIGINT AS postings, sum(tf)::BIGINT AS tokens,
max(df) AS most, (SELECT count(*) FROM embeddings JOIN documents ON doc_id = vec_id) AS vectors FROM t""")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What the index holds."""
    own = _index(spark, sf)
    n, avgdl = own.totals()
    tokens = own.forward().agg(F.sum("dl").alias("tokens"))
    terms = own.frequencies().agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("most"))
    vectors = own.vectors().agg(F.count("*").alias("vectors"))
    return terms.join(tokens).join(vectors).select(F.lit(n).alias("n"), F.round(F.lit(avgdl), 4).alias("avgdl"), "terms", "postings", "tokens", "most", "vectors")  # one row each


@register(f"""WITH f AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 6) AS rrf, min(rank) FILTER (l = 0) AS r1, min(rank) FILTER (l = 1) AS r2 FROM (
    SELECT query_id, doc_id, rank, 0 AS l FROM {_dense_sql(50)} UNION ALL SELECT query_id, doc_id, rank, 1 FROM {_bm25_sql(50)}) GROUP BY 1, 2)
SELECT query_id, doc_id, rrf, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, r1 NULLS LAST, r2 NULLS LAST, doc_id) AS rank FROM f) WHERE rank <= 20""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    fused = retrieval.fuse([_dense(spark, sf, 50), _bm25(spark, sf, 50)])
    place = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.asc_nulls_last("rank_1"), F.asc_nulls_last("rank_2"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(place)).filter("rank <= 20").select("query_id", "doc_id", "rrf", "rank")


_OVERLAP = """CASE WHEN len(list_distinct({q})) = 0 THEN 0.0 ELSE round(len(list_intersect(list_distinct({q}), list_distinct({d}))) / len(list_distinct({q})), 4) END"""


@register(f"""WITH h AS (SELECT query_id, doc_id, rank, 1 / (60 + rank) AS rrf FROM {_bm25_sql(30)}),
c AS (SELECT h.*, {_OVERLAP.format(q=TOKENS.format("q.text"), d=TOKENS.format("d.text"))} AS base, CASE WHEN q.source = d.source THEN 0.4 ELSE 0.0 END AS a_score
    FROM h JOIN documents q ON q.doc_id = query_id JOIN documents d ON d.doc_id = h.doc_id),
f AS (SELECT *, round(base + 0.1 * a_score, 4) AS final FROM c)
SELECT query_id, doc_id, base, final, rank FROM (SELECT query_id, doc_id, base, final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, base DESC, rrf DESC, doc_id) AS rank FROM f) WHERE rank <= 5""")
def rerank_final(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "source")
    hits = _bm25(spark, sf, 30).select("query_id", "doc_id", (1 / (60 + F.col("rank"))).alias("rrf"))
    # Each text is read once, not once for each pair that it is in.
    docs = docs.select("doc_id", F.array_distinct(F.transform(T.tokens(F.col("text")), lambda t: F.xxhash64(t))).alias("d"), "source")
    asked = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("d").alias("q"), F.col("source").alias("qs"))
    both = retrieval.beside(hits, docs, "doc_id", 30 * asked.count()).join(asked, "query_id")
    maps = [F.create_map(F.lit(k), F.col(c)) for k, c in (("intent", "qs"), ("queue", "source"))]
    scored = both.select("query_id", "doc_id", "rrf", retrieval.overlap_score(F.col("q"), F.col("d")).alias("base"), retrieval.aspect_score(*maps).alias("a_score"))
    return retrieval.rerank(scored, 5).select("query_id", "doc_id", "base", "final", "rank")


# --- whole retrieval ------------------------------------------------------------------


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth document asks; it may not find itself."""
    asked = tickets(spark, sf).filter("idx % 20 = 0")
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    spans = F.create_map(F.lit("intent"), F.col("queue"), F.lit("ticket_type"), F.col("language"))
    return asked.join(vectors, "idx", "left").select(
        F.col("idx").alias("query_id"), F.col("body").alias("text"), "vector", "language", F.array("idx").alias("exclude"), spans.alias("spans"), "subject", "queue"
    )


def _retrieve(spark: SparkSession, sf: str, k: int, **settings) -> DataFrame:
    return retrieval.retrieve(_queries(spark, sf), _index(spark, sf), retrieval.Settings(top_k=k, **settings))


def _retrieve_sql(k: int, same_language: bool = False, rerank: bool = True) -> str:
    """The first k: candidates without the query itself (and other languages), ranked anew, fused, scored by shared words, then aspects."""
    lists = f"(SELECT query_id, doc_id, score, rank, 0 AS l FROM {_dense_sql(50)} WHERE doc_id IN (SELECT doc_id FROM documents) UNION ALL SELECT query_id, doc_id, score, rank, 1 FROM {_bm25_sql(50)})"
    language = "AND d.lang = q.lang" if same_language else ""
    body, base = "substr(d.text, 1, 1000)", "CASE WHEN ce IS NULL THEN dense ELSE ce END"
    judged = "lower(substr(trim(q.lang), 1, 2)) IN ('en', 'de')" if rerank else "false"
    return f"""(WITH h AS (SELECT query_id, h.doc_id, score, l, row_number() OVER (PARTITION BY query_id, l ORDER BY rank) AS rank FROM {lists} h
        JOIN documents q ON q.doc_id = query_id JOIN documents d ON d.doc_id = h.doc_id WHERE h.doc_id <> query_id {language}),
    f AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 6) AS rrf, min(rank) FILTER (l = 0) AS r1, min(rank) FILTER (l = 1) AS r2, coalesce(round(max(score) FILTER (l = 0), 4), 0.0) AS dense FROM h GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, r1 NULLS LAST, r2 NULLS LAST, doc_id) AS place FROM f QUALIFY place <= 50),
    c AS (SELECT p.*, CASE WHEN {judged} THEN {_OVERLAP.format(q=TOKENS.format("q.text"), d=TOKENS.format(body))} END AS ce,
        round(CASE WHEN lower(q.source) = lower(d.source) THEN 0.4::DOUBLE ELSE 0.0 END + CASE WHEN q.lang = d.lang THEN 0.2::DOUBLE ELSE 0.0 END, 4) AS a
        FROM p JOIN documents q ON q.doc_id = query_id JOIN documents d ON d.doc_id = p.doc_id),
    s AS (SELECT *, {base} AS base, round({base} + 0.1 * a, 4) AS final FROM c)
    SELECT query_id, doc_id, dense, rrf, ce AS ce_score, round(a, 3) AS a_score, final, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, base DESC, place) AS rank FROM s) WHERE rank <= {k})"""


@register("SELECT * FROM " + _retrieve_sql(3))
def retrieve_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieve(spark, sf, 3).select("query_id", "doc_id", "dense", "rrf", "ce_score", "a_score", "final", "rank")


@register("SELECT query_id, doc_id, dense, final, rank FROM " + _retrieve_sql(3, same_language=True, rerank=False))
def retrieve_same_language(spark: SparkSession, sf: str) -> DataFrame:
    """Without the scorer, within the query's language."""
    return _retrieve(spark, sf, 3, same_language=True, rerank=False).select("query_id", "doc_id", "dense", "final", "rank")


@register(f"""SELECT h.query_id AS row_idx, rank, q.lang AS query_language, substr(q.text, 1, 40) AS query_subject, h.doc_id AS hit_ticket_idx, d.lang AS hit_language,
substr(d.text, 1, 40) AS hit_subject, d.text AS hit_response, dense, rrf, ce_score, final FROM {_retrieve_sql(5)} h JOIN documents q ON q.doc_id = query_id JOIN documents d ON d.doc_id = h.doc_id""")
def retrieval_hits(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each hit of a batch of tickets."""
    return retrieval.hit_rows(_queries(spark, sf), _retrieve(spark, sf, 5)).drop("a_score")


@register(f"""SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM {_dense_sql(20)}
WHERE score < 0.97 AND query_id <> doc_id) WHERE rank <= 3""")
def neardup_guard(spark: SparkSession, sf: str) -> DataFrame:
    hits = _dense(spark, sf, 20).withColumn("dense", F.col("score"))
    hits = hits.withColumn("gold", F.col("query_id").cast("string")).withColumn("response", F.col("doc_id").cast("string"))
    return retrieval.drop_near_duplicates(hits, "gold", "response", 0.97, 3).select("query_id", "doc_id", "rank")


@register(f"""SELECT query_id, round(sum((q.label = d.label)::INT) / count(*), 4) AS intent_at_k FROM {_dense_sql(3)} h
JOIN embeddings q ON q.vec_id = query_id JOIN embeddings d ON d.vec_id = doc_id GROUP BY query_id""")
def intent_at_k(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("l"))
    hits = _dense(spark, sf, 3).join(labels.select(F.col("vec_id").alias("query_id"), F.col("l").alias("q_intent")), "query_id")
    hits = hits.join(labels.select(F.col("vec_id").alias("doc_id"), F.col("l").alias("d_intent")), "doc_id")
    return retrieval.intent_at_k(hits.withColumn("q_queue", F.lit("")).withColumn("d_queue", F.lit("none")))


@register(f"""SELECT query_id, CASE WHEN score >= 0.5 THEN 'rag' ELSE 'no_context' END AS route FROM {_dense_sql(20)} WHERE rank = 2""")
def crag_route(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, 20).filter("rank = 2").select("query_id", retrieval.route(F.col("score").cast("string"), 0.5).alias("route"))


@register(f"""WITH q AS (SELECT doc_id AS query_id, source, lower(substr(lang, 1, 2)) AS language, substr(text, 1, 120) AS gold FROM documents WHERE doc_id % 20 = 0),
h AS (SELECT h.query_id, h.rank, h.ce_score, q.source, q.gold, q.language, d.source AS ds, d.text FROM {_retrieve_sql(3)} h JOIN q USING (query_id) JOIN documents d ON d.doc_id = h.doc_id),
r AS (SELECT query_id, language, count(*) AS n_hits, round(sum((lower(source) = lower(ds))::INT) / count(*), 4) AS "intent_at_k", max(ce_score) FILTER (rank = 1) AS top1_ce,
    max(round(len(list_intersect(list_distinct({TOKENS.format("gold")}), list_distinct({TOKENS.format("text")}))) / len(list_distinct({TOKENS.format("gold")})), 4)) FILTER (rank = 1) AS top1_overlap FROM h GROUP BY 1, 2)
SELECT q.query_id, q.language, coalesce(n_hits, 0) AS n_hits, intent_at_k, top1_ce, coalesce(top1_overlap, 0.0) AS top1_overlap FROM q LEFT JOIN r USING (query_id)""")
def retrieval_eval(spark: SparkSession, sf: str) -> DataFrame:
    """What is found for each query, held against the query's own class and words."""
    asked = _queries(spark, sf).withColumn("answer", F.substring("text", 1, 120)).withColumn("intent", F.lit("none"))
    shared = lambda reply, gold: retrieval.overlap_score(T.tokens(gold), T.tokens(reply))
    return report.evaluate_hits(asked, _retrieve(spark, sf, 3), {"top1_overlap": shared}).select("query_id", "language", "n_hits", "intent_at_k", "top1_ce", "top1_overlap")


_DRAWS_SQL = """('0x' || substr(md5('42:' || draw::VARCHAR || ':' || slot::VARCHAR), 1, 8))::BIGINT % n"""


@register(f"""WITH e AS ({{eval}}), long AS (SELECT query_id, language, 'intent_at_k' AS metric, intent_at_k AS v FROM e UNION ALL SELECT query_id, language, 'top1_overlap', top1_overlap FROM e),
g AS (SELECT query_id, 'all' AS split, metric, v FROM long UNION ALL SELECT query_id, language, metric, v FROM long),
known AS (SELECT split, metric, v, row_number() OVER (PARTITION BY split, metric ORDER BY query_id) - 1 AS p, count(*) OVER (PARTITION BY split, metric) AS n FROM g WHERE v IS NOT NULL),
d AS (SELECT split, metric, draw, slot, {_DRAWS_SQL} AS p FROM (SELECT DISTINCT split, metric, n FROM known), (SELECT unnest(range(0, 1000)) AS draw), (SELECT unnest(range(0, 10000)) AS slot) s WHERE slot < n),
m AS (SELECT split, metric, draw, avg(v) AS m FROM d JOIN known USING (split, metric, p) GROUP BY 1, 2, 3)
SELECT 'hybrid' AS config, split, metric, n, mean, ci_low, ci_high FROM (SELECT split, metric, round(quantile_cont(m, 0.025), 4) AS ci_low, round(quantile_cont(m, 0.975), 4) AS ci_high FROM m GROUP BY 1, 2)
JOIN (SELECT split, metric, count(*) AS n, round(avg(v), 4) AS mean FROM known GROUP BY 1, 2) USING (split, metric)""")
def retrieval_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Means and intervals of the evaluation, over all queries and for each language."""
    return report.summarise(retrieval_eval(spark, sf), "query_id", ["intent_at_k", "top1_overlap"], "hybrid")


# --- prompts -----------------------------------------------------------------------------


def _prompt_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Queries with what BM25 finds for them: ``docs`` array<struct<subject,response>> of up to three others, best first."""
    docs = tickets(spark, sf).select(F.col("idx").alias("doc_id"), F.struct("subject", F.col("body").alias("response")).alias("doc"))
    few = retrieval.renumber(_bm25(spark, sf, 4).filter("doc_id <> query_id")).filter("rank <= 3")
    asked = with_checklist(tickets(spark, sf).filter("idx % 20 = 0"))
    hits = retrieval.beside(few, docs, "doc_id", 3 * asked.count())
    found = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("docs"))
    none = F.array().cast("array<struct<subject:string,response:string>>")
    return asked.join(found.withColumnRenamed("query_id", "idx"), "idx", "left").withColumn("docs", F.coalesce("docs", none))


def with_checklist(rows: DataFrame) -> DataFrame:
    cause = F.when(F.col("language") == "de", F.col("queue")).otherwise("none")
    todo = T.checklist(
        T.aspect(F.col("subject")), T.aspect(cause), T.aspect(F.lit("none")), T.aspect(T.urgency(F.col("body"))), T.aspect(F.col("queue")), T.aspect(F.col("language")), T.aspect(F.lit("")),
    )
    return rows.withColumn("checklist", todo)


def tiers_sql(tiers: dict[str, list[str]], column: str) -> str:
    cases = []
    for name, words in tiers.items():
        alternatives = "|".join(words).replace("'", "''")
        cases.append(f"WHEN regexp_matches(lower({column}), '{alternatives}') THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE 'low' END"


CHECKLIST_SQL = f"""CASE WHEN len(items) = 0 THEN '' ELSE array_to_string(list_concat(['{T.CHECKLIST_HEAD}'],
list_transform(items, lambda x, i: i::VARCHAR || '. ' || x), ['Category: ' || queue || ' / ' || language || '.']), chr(10)) END"""
ITEMS_SQL = f"""(SELECT idx, subject, body, queue, language, list_filter([
    CASE WHEN trim(subject) <> '' THEN 'Solve the problem: ' || trim(subject) END,
    CASE WHEN language = 'de' THEN 'Address the likely cause: ' || queue END,
    'Tone for urgency "' || u || '": ' || CASE WHEN u IN ('high', 'critical') THEN '{T.TONES[0]}' ELSE '{T.TONES[1]}' END], lambda x: x IS NOT NULL) AS items
    FROM (SELECT *, {tiers_sql(T.URGENCY, 'body')} AS u FROM {TICKETS}))"""
LANGUAGE_SQL = "'Write the reply in ' || CASE language WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'the customer''s language' END || ', the same language as the customer''s message.'"
_TRIES_SQL = f"""(WITH h AS (SELECT query_id AS idx, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM {_bm25_sql(4)} WHERE query_id <> doc_id QUALIFY r <= 3),
    c AS (SELECT idx, r AS n_docs, string_agg('[' || r::VARCHAR || '] Subject: ' || substr(text, 1, 40) || chr(10) || '     Response: ' || substr(text, 1, {RESPONSE}), chr(10))
        OVER (PARTITION BY idx ORDER BY r ROWS UNBOUNDED PRECEDING) AS context FROM h JOIN documents d ON d.doc_id = h.doc_id
        UNION ALL SELECT doc_id, 0, '' FROM documents WHERE doc_id % 20 = 0)
    SELECT idx, n_docs, '{T.PROMPT_HEAD.strip()}' || chr(10) || CASE WHEN length(checklist) > 0 THEN checklist || chr(10) ELSE '' END || chr(10) || 'Context : ' || context || chr(10) || 'Subject : ' || subject
     || chr(10) || 'Message : ' || body || chr(10) || {LANGUAGE_SQL} || chr(10) || '{T.PROMPT_END}' AS prompt FROM (SELECT *, {CHECKLIST_SQL} AS checklist FROM {ITEMS_SQL}) JOIN c USING (idx))"""


def _build(context: F.Column) -> F.Column:
    return T.support_prompt(context, F.col("subject"), F.col("body"), F.col("language"), F.col("checklist"))


@register(f"SELECT idx, prompt FROM {_TRIES_SQL} QUALIFY row_number() OVER (PARTITION BY idx ORDER BY n_docs DESC) = 1")
def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of each query with all that was found for it."""
    return _prompt_rows(spark, sf).select("idx", _build(F.array_join(P.context_lines(F.col("docs"), RESPONSE), "\n")).alias("prompt"))


_COUNT_SQL = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"


@register(f"""SELECT idx, n_docs, {_COUNT_SQL.format("prompt")}::BIGINT AS n_tokens FROM {_TRIES_SQL}
QUALIFY row_number() OVER (PARTITION BY idx ORDER BY CASE WHEN n_docs = 0 THEN 1 WHEN {_COUNT_SQL.format("prompt")} + 16 <= {BUDGET} THEN 0 ELSE 2 END, n_docs DESC) = 1""")
def prompt_budget(spark: SparkSession, sf: str) -> DataFrame:
    """The longest context whose prompt fits the budget less 16 for the wrapper; the bare prompt if none does."""
    fitted = P.fit_prompt(lambda some: _build(F.array_join(P.context_lines(some, RESPONSE), "\n")), F.col("docs"), BUDGET)
    return _prompt_rows(spark, sf).select("idx", fitted.alias("x")).select("idx", "x.n_docs", T.word_count(F.col("x.prompt")).alias("n_tokens"))


# --- distractors and training examples -------------------------------------------------------

_FAR_SQL = """WITH n AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('42:' || vec_id::VARCHAR), vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings),
q AS (SELECT vec_id AS query_id, label, ('0x' || substr(md5('42:distractor:' || vec_id::VARCHAR), 1, 8))::BIGINT % n AS start, n FROM n WHERE vec_id % 20 = 0)
SELECT query_id, vec_id AS doc_id, rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY (pos - start + q.n) % q.n) AS rank FROM q JOIN n ON n.label <> q.label) WHERE rank <= 3"""


@register(_FAR_SQL)
def distractors(spark: SparkSession, sf: str) -> DataFrame:
    """Three records of other labels for each query, drawn from all of them: the first ones after a random place in a random order."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("label"))
    asked = e.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "label")
    return raft.distractors(asked, e, 3).select("query_id", "doc_id", "rank")


_FLAG = "('0x' || substr(md5('42:{}:' || query_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < {}"


@register(f"""WITH n AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
q AS (SELECT doc_id AS query_id, source, ('0x' || substr(md5('42:distractor:' || doc_id::VARCHAR), 1, 8))::BIGINT % n AS start, n FROM n WHERE doc_id % 20 = 0),
far AS (SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (pos - start + q.n) % q.n) AS rank FROM q JOIN n ON n.source <> q.source) WHERE rank <= 3),
near AS (SELECT query_id, h.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM {_retrieve_sql(6)} h JOIN documents q ON q.doc_id = query_id JOIN documents d ON d.doc_id = h.doc_id
    WHERE dense < 0.97 AND trim(q.text) <> trim(d.text)),
f AS (SELECT query_id, {_FLAG.format('aspects', 0.8)} AS with_aspects, {_FLAG.format('flag', 0.2)} AS distractor FROM q),
hits AS (SELECT f.*, doc_id, rank FROM f JOIN far USING (query_id) WHERE distractor UNION ALL SELECT f.*, doc_id, rank FROM f JOIN near USING (query_id) WHERE NOT distractor AND rank <= 3)
SELECT f.query_id::VARCHAR AS idx, f.with_aspects, f.distractor, coalesce(list(doc_id ORDER BY rank) FILTER (doc_id IS NOT NULL), []) AS docs FROM f LEFT JOIN hits ON hits.query_id = f.query_id GROUP BY 1, 2, 3""")
def raft_context(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents go into the context of each training example: found ones that are no copies, or unrelated ones."""
    examples = _raft(spark, sf)
    return examples.select(F.col("query_id").cast("string").alias("idx"), "with_aspects", "distractor", F.transform("docs", lambda d: d["doc_id"]).alias("docs"))


def _raft(spark: SparkSession, sf: str) -> DataFrame:
    asked = _queries(spark, sf).withColumn("answer", F.col("text")).withColumn("intent", F.col("queue"))
    return raft.contexts(asked, _index(spark, sf), retrieval.Settings(top_k=3))


@register()
def raft_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Training examples in the format that is written as JSON lines."""
    asked = _queries(spark, sf).withColumn("answer", F.col("text")).withColumn("intent", F.col("queue"))
    return raft.build_examples(asked, _index(spark, sf), retrieval.Settings(top_k=3), max_tokens=BUDGET)


def _fill_eval() -> None:
    """The summary's SQL is over the evaluation's."""
    from .registry import ORACLE_SQL

    ORACLE_SQL["retrieval_summary"] = ORACLE_SQL["retrieval_summary"].replace("{eval}", ORACLE_SQL["retrieval_eval"])


_fill_eval()

__all__ = ["metrics", "sampling", "tiers_sql", "with_checklist"]
