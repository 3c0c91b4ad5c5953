"""Queries on the operators over tables and texts, with their SQL twins; those on search, aspects and reports are in modules of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeloom.functions import prompts
from lodeloom.functions import text as T
from lodeloom.functions import vectors as V
from lodeloom.operators import aspects, labels, metrics, models, preprocess, report, retrieval, sampling, statistics, tables

from . import reports, search
from .registry import ORACLE_SQL, PAIRS, QUERIES, TICKETS, TOKENS, pairs, read, register, tickets
from .search import CHECKLIST_SQL, ITEMS_SQL, tiers_sql, with_checklist

__all__ = ["ORACLE_SQL", "QUERIES", "reports", "search"]


# --- scans and projections -----------------------------------------------------


@register("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 1000")
def scan_prune(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").filter("n_chars > 1000").select("doc_id", "lang", "n_chars")


@register("SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, count(*) AS n FROM events GROUP BY event_type")
def json_props_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return read(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count("*").alias("n"))


@register("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx_in_source FROM documents")
def renumber_idx(spark: SparkSession, sf: str) -> DataFrame:
    docs = sampling.dense_index(read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return sampling.dense_index(docs, "doc_id", "idx_in_source", ["source"]).select("doc_id", "idx", "idx_in_source")


@register(f"SELECT idx, subject || chr(10) || chr(10) || substr(body, 1, 1800) AS embedding_text, subject || chr(10) || chr(10) || body AS whole_text FROM {TICKETS}")
def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda most: T.embedding_text(F.col("subject"), F.col("body"), most)
    return tickets(spark, sf).select("idx", of(1800).alias("embedding_text"), of(0).alias("whole_text"))


_TAGGED = f"(SELECT *, CASE WHEN idx % 3 = 0 THEN '' ELSE 'a' || (idx % 7)::VARCHAR END AS tag_1, CASE WHEN idx % 2 = 0 THEN 'nan' ELSE 'b' END AS tag_2 FROM {TICKETS})"
_METADATA_SQL = """concat_ws(' | ', CASE WHEN queue <> '' THEN 'Queue: ' || queue END, CASE WHEN language <> '' THEN 'Language: ' || language END,
CASE WHEN tag_1 <> '' OR tag_2 NOT IN ('', 'nan') THEN 'Tags: ' || concat_ws(', ', CASE WHEN tag_1 <> '' THEN tag_1 END, CASE WHEN tag_2 <> 'nan' THEN tag_2 END) END)"""


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("idx")
    return tickets(spark, sf).withColumns({
        "tag_1": F.when(number % 3 == 0, "").otherwise(F.concat(F.lit("a"), (number % 7).cast("string"))), "tag_2": F.when(number % 2 == 0, "nan").otherwise("b"),
    })


@register(f"SELECT idx, {_METADATA_SQL} AS metadata FROM {_TAGGED}")
def metadata_string(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tagged(spark, sf)
    return rows.select("idx", prompts.metadata_string(rows.columns, preprocess.METADATA).alias("metadata"))


@register(
    f"SELECT idx, 'Generate customer support response:' || chr(10) || 'Subject: ' || subject || chr(10) || 'Complaint: ' || body || chr(10) || {_METADATA_SQL} AS input_text,"
    " 'support task: Subject: ' || subject || ' Context: ' || body AS t5_input, '<start_of_turn>user' || chr(10) || 'You are a support agent. Respond to this ticket:'"
    " || chr(10) || 'Subject: ' || subject || chr(10) || 'Message: ' || body || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS instr_input,"
    f" queue AS target_text FROM {_TAGGED}"
)
def model_formats(spark: SparkSession, sf: str) -> DataFrame:
    rows = preprocess.training_inputs(_tagged(spark, sf).withColumn("answer", F.col("queue")))
    return rows.select("idx", "input_text", "t5_input", "instr_input", "target_text")


@register("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::BIGINT AS n_words FROM documents")
def word_count(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


# --- filters ---------------------------------------------------------------------


@register(f"SELECT conv_id, turn FROM {PAIRS} WHERE length(question) > 0 AND length(answer) > 0")
def nonempty_filter(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).filter((F.length("question") > 0) & (F.length("answer") > 0)).select("conv_id", "turn")


@register("SELECT doc_id, n_chars FROM documents WHERE TRY_CAST(doc_id::VARCHAR AS BIGINT) BETWEEN 100 AND 299")
def idx_range(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.id_range(read(spark, sf, "documents"), "doc_id", 100, 299).select("doc_id", "n_chars")


@register(rf"SELECT idx, regexp_matches(lower(body), '{T.PLEASANTRY}') AS pleasantry FROM {TICKETS}")
def pleasantry(spark: SparkSession, sf: str) -> DataFrame:
    return tickets(spark, sf).select("idx", T.is_pleasantry(F.col("body")).alias("pleasantry"))


_CUE = T.ACTION_CUE.removeprefix(r"\b").removesuffix(r"\b")
_EDGES = r"regexp_replace({}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"  # every edge of a word stands twice, so one may be taken up by a match
_BEFORE, _AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


@register(rf"SELECT conv_id * 1000 + turn AS pair_id, regexp_matches(question, '(?i){_BEFORE}{_CUE}{_AFTER}') AS has_action FROM {PAIRS}")
def action_cue(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("pair_id", T.has_action_cue(F.col("question")).alias("has_action"))


# --- joins, guards, upserts ---------------------------------------------------------


@register("SELECT d.doc_id, coalesce(l.quality::VARCHAR, 'none') AS quality, coalesce(l.toxic::VARCHAR, 'none') AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_fill(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels")
    return tables.attach(docs, labels, ["doc_id"], ["quality", "toxic"])


@register("""SELECT o.o_orderkey, CASE WHEN trim(o.o_orderstatus) <> 'O' THEN o.o_orderstatus ELSE l.s END AS status
FROM orders o LEFT JOIN (SELECT l_orderkey, arg_max(l_linestatus, l_linenumber * 10 + (l_linestatus = 'O')::INT) AS s FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey""")
def coalesce_merge(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")).alias("status"))
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("status"), (F.col("l_linenumber") * 10 + (F.col("l_linestatus") == "O").cast("int")).alias("place"))
    return tables.fill_from(orders, lines, ["o_orderkey"], ["status"], "place")


@register(f"""SELECT conv_id, turn, CASE WHEN s >= 0.5 THEN 'rag' ELSE 'no_context' END AS route, CASE WHEN s >= 0.5 THEN answer ELSE question END AS reply
FROM (SELECT *, (turn % 7) / 6.0 AS s FROM {PAIRS})""")
def route_reuse(spark: SparkSession, sf: str) -> DataFrame:
    turns = pairs(spark, sf)
    routed = turns.select("pair_id", "conv_id", "turn", F.col("answer").alias("reply"), retrieval.route((F.col("turn") % 7 / 6.0).cast("string"), 0.5).alias("route"))
    other = turns.select("pair_id", F.col("question").alias("reply"))
    return tables.pick_by_route(routed, other, "pair_id").select("conv_id", "turn", "route", "reply")


@register(f"SELECT t.idx, o.own FROM {TICKETS} t LEFT JOIN (SELECT subject, substr(body, 1, 200) AS b, language, min(idx) AS own FROM {TICKETS} GROUP BY 1, 2, 3) o ON t.subject = o.subject AND substr(t.body, 1, 200) = o.b AND t.language = o.language")
def own_id_lookup(spark: SparkSession, sf: str) -> DataFrame:
    t = tickets(spark, sf).select("idx", "subject", F.substring("body", 1, 200).alias("b"), "language")
    own = tables.first_id(t, ["subject", "b", "language"], "idx").withColumnRenamed("idx", "own")
    return t.join(own, ["subject", "b", "language"], "left").select("idx", "own")


@register("SELECT item_id, count(DISTINCT doc_id) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def leakage_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold the whole text of an item."""
    return tables.leaks(read(spark, sf, "documents"), "doc_id", "text", read(spark, sf, "benchmark"), "item_id", "text")


@register("SELECT idx FROM (SELECT doc_id::VARCHAR AS idx FROM labels WHERE quality = 1 INTERSECT SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1)")
def shared_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that two samples share; a guard raises where there are any."""
    labels = read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("idx"), "quality", "toxic")
    return labels.filter("quality = 1").select("idx").intersect(labels.filter("toxic = 1").select("idx"))


@register("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def rows_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess.rows_by_id(read(spark, sf, "documents").select("doc_id", "n_chars"), read(spark, sf, "labels").filter("quality = 0"), "doc_id")


@register("SELECT vec_id, label, quality FROM embeddings JOIN labels ON doc_id = vec_id")
def gold_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Gold labels beside the vectors of the same number."""
    labels = read(spark, sf, "labels").withColumnRenamed("doc_id", "vec_id")
    vectors = preprocess.rows_by_id(read(spark, sf, "embeddings"), labels, "vec_id")
    return preprocess.gold_labels(vectors, labels, "vec_id", ["quality"]).select("vec_id", "label", "quality")


@register("SELECT source, doc_id FROM (SELECT source, doc_id FROM documents UNION ALL SELECT source, doc_id + 100000 FROM documents WHERE lang = 'en') EXCEPT SELECT source, doc_id FROM documents WHERE lang = 'de'")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Tables one under the other, without the rows of a third."""
    docs = read(spark, sf, "documents").select("source", "doc_id", "lang")
    more = docs.filter("lang = 'en'").withColumn("doc_id", F.col("doc_id") + 100000).drop("lang")
    return docs.unionByName(more, allowMissingColumns=True).select("source", "doc_id").subtract(docs.filter("lang = 'de'").select("source", "doc_id"))


@register("SELECT doc_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT doc_id::VARCHAR FROM labels)")
def resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    return tables.pending(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), "doc_id")


@register("""SELECT source, lang, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY 1, 2
UNION ALL SELECT source, lang, count(*) + 1000 FROM documents WHERE lang = 'en' GROUP BY 1, 2""")
def upsert_label(spark: SparkSession, sf: str) -> DataFrame:
    old = read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return tables.upsert(old, old.filter("lang = 'en'").withColumn("n", F.col("n") + 1000), "lang")


@register("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def keep_last(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").select("user_id", "event_id", "event_type")
    return tables.keep_last(events, ["user_id"], "event_id")


@register("""SELECT doc_id, max(CASE WHEN system = 'S1' THEN v END) AS S1, max(CASE WHEN system = 'S2' THEN v END) AS S2
FROM (SELECT doc_id, 'S1' AS system, quality AS v FROM labels UNION ALL SELECT doc_id, 'S2', toxic FROM labels) GROUP BY doc_id""")
def compare_systems(spark: SparkSession, sf: str) -> DataFrame:
    return tables.compare_systems(_systems(spark, sf), "doc_id", "system", "v", ["S1", "S2"])


@register("SELECT doc_id, 1::BIGINT AS systems FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def system_alignment(spark: SparkSession, sf: str) -> DataFrame:
    one = read(spark, sf, "documents").select("doc_id", F.lit("S1").alias("system"))
    two = read(spark, sf, "labels").select("doc_id", F.lit("S2").alias("system"))
    return tables.aligned(one.unionByName(two), "doc_id", "system")


def _systems(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "labels")
    both = F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.col(c).alias("v")) for s, c in (("S1", "quality"), ("S2", "toxic")))))
    return labels.select("doc_id", both.alias("x")).select("doc_id", "x.system", "x.v")


# --- aggregation ----------------------------------------------------------------------


@register("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def lang_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@register("SELECT event_type, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM events GROUP BY event_type")
def route_share(spark: SparkSession, sf: str) -> DataFrame:
    counts = read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("event_type", F.round(F.col("n") / total, 4).alias("share"))


@register("""SELECT source, coalesce(lang, 'all') AS split, round(avg(n_chars), 4) AS mean, count(n_chars) AS n FROM documents
GROUP BY GROUPING SETS ((source), (source, lang))""")
def metric_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    out = docs.groupingSets([[F.col("source")], [F.col("source"), F.col("lang")]], "source", "lang").agg(
        F.grouping("lang").alias("g"), F.round(F.avg("n_chars"), 4).alias("mean"), F.count("n_chars").alias("n")
    )
    return out.select("source", F.when(F.col("g") == 1, "all").otherwise(F.col("lang")).alias("split"), "mean", "n")


@register("SELECT event_type, round(quantile_cont(value, 0.025), 4) AS low, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.975), 4) AS high FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    at = {"low": 0.025, "p50": 0.5, "high": 0.975}
    return read(spark, sf, "events").groupBy("event_type").agg(*(F.round(F.percentile("value", q), 4).alias(n) for n, q in at.items()))


_F1 = """WITH p AS (SELECT {t} AS t, {p} AS p FROM {src}),
l AS (SELECT t AS label FROM p UNION SELECT p FROM p),
c AS (SELECT label, (SELECT count(*) FROM p WHERE t = label) AS s, (SELECT count(*) FROM p WHERE p.p = label) AS k, (SELECT count(*) FROM p WHERE t = label AND p.p = label) AS tp FROM l),
f AS (SELECT *, CASE WHEN tp > 0 THEN 2.0 * tp / (s + k) ELSE 0 END AS f1 FROM c)
SELECT round(sum(tp) / sum(s), 4) AS accuracy, round(avg(f1), 4) AS macro_f1, round(sum(f1 * s) / sum(s), 4) AS weighted_f1, sum(tp)::BIGINT AS correct, sum(s)::BIGINT AS total FROM f"""


@register(_F1.format(t="quality", p="toxic", src="labels"))
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.classification(read(spark, sf, "labels"), "quality", "toxic")


@register(_F1.format(t="quality", p="(SELECT quality FROM labels GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1)", src="labels"))
def majority_baseline(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "labels").select("quality")
    counts = labels.groupBy("quality").agg(F.count("*").alias("n"))
    top = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "quality"))["quality"].alias("majority"))
    return metrics.classification(labels.join(F.broadcast(top)), "quality", "majority")  # top: one row


@register("""SELECT count(*) AS distinct_labels, arg_min(source, (-n, source)) AS top_label, round(max(n) / sum(n), 4) AS top_share
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def label_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return tables.collapse_stats(read(spark, sf, "documents"), "source")


_DRAW = "('0x' || substr(md5('42:{name}:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0"


@register(f"""SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de,
round(avg(({_DRAW.format(name='distractor')} < 0.2)::INT), 4) AS distractor_share, round(avg(({_DRAW.format(name='aspects')} < 0.8)::INT), 4) AS aspect_share FROM documents""")
def raft_stats(spark: SparkSession, sf: str) -> DataFrame:
    flag = lambda name, p: F.round(F.avg((sampling.unit_draw(42, name, "doc_id") < p).cast("int")), 4)
    return read(spark, sf, "documents").agg(
        F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "de").alias("de"),
        flag("distractor", 0.2).alias("distractor_share"), flag("aspects", 0.8).alias("aspect_share"),
    )


@register("SELECT (sum(CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS filled, count(*) AS total, round(count(quality) / count(*), 4) AS share FROM documents LEFT JOIN labels USING (doc_id)")
def label_coverage(spark: SparkSession, sf: str) -> DataFrame:
    both = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    return both.agg(F.count_if(F.col("quality").isNotNull()).alias("filled"), F.count("*").alias("total"), F.round(F.count("quality") / F.count("*"), 4).alias("share"))


# --- samples and splits -------------------------------------------------------------------

_HASH = "md5('42:' || doc_id::VARCHAR)"


@register(f"""WITH g AS (SELECT lang, count(*) AS size, row_number() OVER (ORDER BY lang) AS i, count(*) OVER () AS k FROM documents GROUP BY lang),
f AS (SELECT *, least(200 // k + (i <= 200 % k)::INT, size) AS first FROM g),
q AS (SELECT lang, first + least(size - first, greatest(greatest(200 - sum(first) OVER (), 0) - coalesce(sum(size - first) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS quota FROM f)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_HASH}, doc_id) AS r FROM documents) JOIN q USING (lang) WHERE r <= quota""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_sample(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 200)


_LEFT = "row_number() OVER (ORDER BY round({n} * size / total - floor({n} * size / total), 9) DESC, lang) <= {n} - sum(floor({n} * size / total)) OVER ()"


@register(f"""WITH g AS (SELECT lang, size::DOUBLE AS size, sum(size) OVER ()::DOUBLE AS total FROM (SELECT lang, count(*) AS size FROM documents GROUP BY lang)),
q AS (SELECT lang, floor(30 * size / total) + ({_LEFT.format(n=30)})::INT AS t, floor(40 * size / total) + ({_LEFT.format(n=40)})::INT AS v FROM g)
SELECT doc_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'validate' ELSE 'train' END AS split
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_HASH}, doc_id) AS r FROM documents) JOIN q USING (lang)""")
def three_way_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.three_way_split(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 30, 40).select("doc_id", "split")


@register(f"SELECT doc_id, row_number() OVER (ORDER BY {_HASH}, doc_id) <= greatest(1, least(round(count(*) OVER () * 0.05), count(*) OVER () - 1)) AS is_val FROM documents")
def shuffle_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.shuffle_split(read(spark, sf, "documents").select("doc_id"), "doc_id", 0.05)


@register(f"SELECT doc_id, {_DRAW.format(name='aspects')} < 0.8 AS with_aspects, {_DRAW.format(name='distractor')} < 0.2 AS distractor FROM documents")
def bernoulli_flags(spark: SparkSession, sf: str) -> DataFrame:
    flag = lambda name, p: (sampling.unit_draw(42, name, "doc_id") < p).alias({"aspects": "with_aspects"}.get(name, name))
    return read(spark, sf, "documents").select("doc_id", flag("aspects", 0.8), flag("distractor", 0.2))


# --- statistics ----------------------------------------------------------------------------

_DRAWS = """pos AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM labels),
d AS (SELECT draw, ('0x' || substr(md5('42:' || draw::VARCHAR || ':' || slot::VARCHAR), 1, 8))::BIGINT % (SELECT count(*) FROM labels) AS p
    FROM (SELECT unnest(range(0, 1000)) AS draw) a, (SELECT unnest(range(0, (SELECT count(*) FROM labels))) AS slot) b)"""


@register(f"""WITH {_DRAWS}, m AS (SELECT draw, avg(quality) AS m FROM d JOIN pos USING (p) GROUP BY draw)
SELECT (SELECT count(*) FROM labels) AS n, (SELECT round(avg(quality), 4) FROM labels) AS mean, round(quantile_cont(m, 0.025), 4) AS ci_low, round(quantile_cont(m, 0.975), 4) AS ci_high FROM m""")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("v"))
    return statistics.bootstrap_ci(spark, labels, "doc_id", "v")


@register(f"""WITH {_DRAWS}, m AS (SELECT draw, avg(toxic - quality) AS m FROM d JOIN pos USING (p) GROUP BY draw),
c AS (SELECT round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM m)
SELECT 'toxic' AS system, (SELECT count(*) FROM labels) AS n, (SELECT round(avg(toxic), 4) FROM labels) AS mean, (SELECT round(avg(toxic - quality), 4) FROM labels) AS diff,
lo AS diff_ci_low, hi AS diff_ci_high, (lo > 0 OR hi < 0) AS significant FROM c""")
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return statistics.paired_bootstrap(spark, labels, "doc_id", "quality", ["toxic"])


@register("""WITH t AS (SELECT unnest([0.05, 0.2, 0.4, 0.6, 0.9]) AS threshold),
r AS (SELECT (doc_id % 100) / 100.0::DOUBLE AS s, quality::DOUBLE AS w, toxic::DOUBLE AS o FROM labels),
m AS (SELECT threshold::DOUBLE AS threshold, round(avg(CASE WHEN s >= threshold::DOUBLE THEN w ELSE o END), 4) AS mean, round(avg((s >= threshold::DOUBLE)::INT), 4) AS rag_share, count(*) AS n FROM r, t GROUP BY threshold)
SELECT *, threshold = (SELECT min(threshold) FROM m WHERE mean = (SELECT max(mean) FROM m)) AS best FROM m""")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "labels").select((F.col("doc_id") % 100 / 100.0).cast("string").alias("s"), F.col("quality").cast("double").alias("w"), F.col("toxic").cast("double").alias("o"))
    return statistics.threshold_sweep(rows, "s", "w", "o", [0.05, 0.2, 0.4, 0.6, 0.9])


# --- search -----------------------------------------------------------------------------------


_JAC = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


@register(f"""WITH t AS (SELECT idx, queue, language, list_distinct({TOKENS.format("body")}) AS w, lead(queue) OVER o AS q2, lead(language) OVER o AS l2, lead(list_distinct({TOKENS.format("body")})) OVER o AS w2
    FROM {TICKETS} WINDOW o AS (ORDER BY idx))
SELECT idx, round(CASE WHEN queue = q2 THEN 0.4 ELSE 0.0 END + CASE WHEN language = l2 THEN 0.2 ELSE 0.0 END + 0.3 * ({_JAC.format(a="w", b="w2")}), 4) AS a_score FROM t WHERE q2 IS NOT NULL""")
def aspect_score(spark: SparkSession, sf: str) -> DataFrame:
    t = tickets(spark, sf)
    rows = sampling.dense_index(t, "idx", "pos")
    after = rows.select((F.col("pos") - 1).alias("pos"), *(F.col(c).alias(f"{c}2") for c in ("queue", "language", "body")))
    both = rows.join(after, "pos")
    q = F.create_map(F.lit("intent"), F.col("queue"), F.lit("ticket_type"), F.col("language"), F.lit("prob_sub"), F.col("body"))
    d = F.create_map(F.lit("queue"), F.col("queue2"), F.lit("type"), F.col("language2"), F.lit("prob_sub"), F.col("body2"))
    return both.select("idx", retrieval.aspect_score(q, d).alias("a_score"))


# --- vectors ---------------------------------------------------------------------------------------


@register("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT a.vec_id, list_transform(range(1, 65), lambda i: (2.0 * a.v[i] + 1.5 * b.v[i]) / 3.5) AS v FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, list_transform(v, lambda x: round(x / (sqrt(list_dot_product(v, v)) + 1e-9), 6)) AS vector FROM m""")
def query_vector_weighted(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("a"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    mean = both.select("vec_id", V.weighted_mean([(F.col("a"), 2.0), (F.col("b"), 1.5)]).alias("m"))
    sized = mean.select("vec_id", "m", (V.norm(F.col("m")) + 1e-9).alias("s"))
    return sized.select("vec_id", F.transform("m", lambda x: V.round_signed(x / F.col("s"), 6)).alias("vector"))


@register("""WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2)
SELECT label, i - 1 AS dim, round(x / (sqrt(sum(x * x) OVER (PARTITION BY label)) + 1e-9), 6) AS x FROM c""")
def centroid(spark: SparkSession, sf: str) -> DataFrame:
    cells = read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    mean = cells.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("label"))) + 1e-9  # a row for each dimension
    return mean.select("label", F.col("dim").cast("long").alias("dim"), F.round(F.col("x") / size, 6).alias("x"))


@register("""WITH a AS (SELECT vec_id // 10 AS key, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 < 3),
s AS (SELECT vec_id // 10 AS key, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 >= 3)
SELECT key, round(avg(best), 4) AS coverage FROM (SELECT a.key, a.vec_id, max(list_cosine_similarity(a.v, s.v)) AS best FROM a JOIN s USING (key) GROUP BY 1, 2) GROUP BY key""")
def coverage_max_cos(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("key"), "vec_id", V.as_double(F.col("embedding")).alias("vector"))
    return metrics.coverage(e.filter("vec_id % 10 < 3").withColumnRenamed("vec_id", "aspect"), e.filter("vec_id % 10 >= 3").select("key", "vector"))


# --- text metrics -----------------------------------------------------------------------------------


def _rouge_sql(n: int, token: str = r"[\p{L}\p{N}_]+") -> str:
    grams = "w" if n == 1 else "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""WITH t AS (SELECT conv_id * 1000 + turn AS pair_id, regexp_extract_all(lower(answer), '{token}') AS h, regexp_extract_all(lower(question), '{token}') AS r FROM {PAIRS}),
h AS (SELECT pair_id, g, count(*) AS n FROM (SELECT pair_id, unnest({grams}) AS g FROM (SELECT pair_id, h AS w FROM t)) GROUP BY 1, 2),
r AS (SELECT pair_id, g, count(*) AS n FROM (SELECT pair_id, unnest({grams}) AS g FROM (SELECT pair_id, r AS w FROM t)) GROUP BY 1, 2),
m AS (SELECT pair_id, sum(least(h.n, r.n)) AS m FROM h JOIN r USING (pair_id, g) GROUP BY pair_id),
s AS (SELECT pair_id, (SELECT sum(n) FROM h WHERE h.pair_id = t.pair_id) AS a, (SELECT sum(n) FROM r WHERE r.pair_id = t.pair_id) AS b FROM t)
SELECT pair_id, coalesce(CASE WHEN m > 0 THEN round(2 * m / (a + b), 4) END, 0.0) AS rouge FROM s LEFT JOIN m USING (pair_id)"""


@register(_rouge_sql(1))
def rouge1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rouge_n(pairs(spark, sf), "pair_id", "answer", "question", 1)


@register(_rouge_sql(2))
def rouge2(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rouge_n(pairs(spark, sf), "pair_id", "answer", "question", 2)


@register(_rouge_sql(1, "[a-z0-9]+"))
def rouge1_ascii(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rouge_n(pairs(spark, sf), "pair_id", "answer", "question", 1, metrics.ascii_tokens)


@register("""WITH a AS (SELECT vec_id // 10 AS key, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 < 3), s AS (SELECT vec_id // 10 AS key, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 >= 3),
m AS (SELECT a.key, a.vec_id AS i, s.vec_id AS j, list_cosine_similarity(a.v, s.v) AS c FROM a JOIN s ON a.key = s.key),
p AS (SELECT key, avg(b) AS p FROM (SELECT key, max(c) AS b FROM m GROUP BY key, i) GROUP BY key), r AS (SELECT key, avg(b) AS r FROM (SELECT key, max(c) AS b FROM m GROUP BY key, j) GROUP BY key)
SELECT key, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM p JOIN r USING (key)""")
def greedy_f1(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("key"), F.col("vec_id").alias("place"), V.as_double(F.col("embedding")).alias("vector"))
    return metrics.greedy_f1(e.filter("place % 10 < 3"), e.filter("place % 10 >= 3"))


@register(f"""WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS pair_id, {TOKENS.format("answer")} AS a, {TOKENS.format("question")} AS b FROM {PAIRS}),
cell AS (SELECT pair_id, unnest(range(1, len(b) + 1)) AS j, unnest(b) AS w FROM t WHERE len(a) > 0),
rows AS (SELECT pair_id, 0 AS i, j, 0::BIGINT AS best FROM cell
    UNION ALL SELECT pair_id, i + 1, j, max(cand) OVER (PARTITION BY pair_id ORDER BY j) FROM (
        SELECT r.pair_id, r.i, r.j, greatest(r.best, CASE WHEN t.a[r.i + 1] = c.w THEN coalesce(lag(r.best) OVER (PARTITION BY r.pair_id ORDER BY r.j), 0) + 1 ELSE 0 END) AS cand
        FROM rows r JOIN t ON t.pair_id = r.pair_id JOIN cell c ON c.pair_id = r.pair_id AND c.j = r.j WHERE r.i < len(t.a))),
m AS (SELECT t.pair_id, max(best) AS m FROM rows r JOIN t ON t.pair_id = r.pair_id WHERE r.i = len(t.a) GROUP BY 1)
SELECT pair_id, CASE WHEN coalesce(m, 0) > 0 THEN round(2 * m / (len(a) + len(b)), 4) ELSE 0.0 END AS rouge FROM t LEFT JOIN m USING (pair_id)""")
def rougeL(spark: SparkSession, sf: str) -> DataFrame:  # noqa: N802  the metric's name
    from lodeloom.session import ship_package

    ship_package(spark)
    return metrics.rouge_l(pairs(spark, sf), "pair_id", "answer", "question")


_BLEU_SQL = f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, {TOKENS.format("answer")} AS h, {TOKENS.format("question")} AS r FROM {PAIRS}),
k AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (SELECT n, id, g, count(*) AS c FROM (SELECT n, id, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i : i + n - 1], ' '))) AS g FROM t, k) GROUP BY 1, 2, 3),
rg AS (SELECT n, id, g, count(*) AS c FROM (SELECT n, id, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i : i + n - 1], ' '))) AS g FROM t, k) GROUP BY 1, 2, 3)
SELECT n, sum(least(hg.c, coalesce(rg.c, 0)))::BIGINT AS matched, sum(hg.c)::BIGINT AS total, (SELECT sum(len(h)) FROM t)::BIGINT AS hyp_len, (SELECT sum(len(r)) FROM t)::BIGINT AS ref_len
FROM hg LEFT JOIN rg USING (n, id, g) GROUP BY n"""


@register(_BLEU_SQL)
def bleu_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bleu_counts(pairs(spark, sf), "pair_id", "answer", "question")


@register(f"""WITH c AS ({_BLEU_SQL}), r AS (SELECT sum(ln(matched / total)) FILTER (matched > 0) AS logs, min(matched) AS least, max(matched / total) FILTER (n = 1) AS p1, max(matched / total) FILTER (n = 4) AS p4,
max(hyp_len) AS h, max(ref_len) AS r, count(*) AS k FROM c)
SELECT round(CASE WHEN least > 0 THEN 100 * CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END * exp(logs / k) ELSE 0 END, 4) AS bleu, round(100 * p1, 4) AS p1, round(100 * p4, 4) AS p4 FROM r""")
def bleu(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.corpus_bleu(bleu_counts(spark, sf))


@register(f"""SELECT 'rouge1' AS metric, 'all' AS split, round(avg(rouge), 4) AS value FROM ({_rouge_sql(1)})
UNION ALL SELECT 'rouge2', 'all', round(avg(rouge), 4) FROM ({_rouge_sql(2)})
UNION ALL SELECT 'rouge1', CASE WHEN pair_id % 2 = 0 THEN 'de' ELSE 'en' END, round(avg(rouge), 4) FROM ({_rouge_sql(1)}) GROUP BY 2
UNION ALL SELECT 'queue_accuracy', 'all', round(avg((pair_id % 3 = pair_id % 4)::INT), 4) FROM (SELECT conv_id * 1000 + turn AS pair_id FROM {PAIRS})
UNION ALL SELECT 'queue_total', 'all', count(*)::DOUBLE FROM {PAIRS}
UNION ALL SELECT 'priority_correct', 'all', sum((pair_id % 2 = pair_id % 3)::INT)::DOUBLE FROM (SELECT conv_id * 1000 + turn AS pair_id FROM {PAIRS})""")
def predictions_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Some of the metrics of predicted replies and labels."""
    n = F.col("pair_id")
    rows = pairs(spark, sf).select(
        "pair_id", F.when(n % 2 == 0, "DE").otherwise("en").alias("language"), F.col("question").alias("answer"), F.col("answer").alias("response_pred"),
        (n % 3).cast("string").alias("queue"), (n % 4).cast("string").alias("queue_pred"), (n % 2).cast("string").alias("priority"), F.concat(F.lit(" "), (n % 3).cast("string")).alias("priority_pred"),
    )
    found = report.evaluate_predictions(rows, "pair_id")
    some = F.col("metric").isin("rouge1") | ((F.col("split") == "all") & F.col("metric").isin("rouge2", "queue_accuracy", "queue_total", "priority_correct"))
    return found.filter(some)


@register(f"""SELECT field, filled, total, round(filled / total, 4) AS share FROM (SELECT 'subject' AS field, count(*) FILTER (trim(subject) <> '') AS filled, count(*) AS total FROM {TICKETS}
UNION ALL SELECT 'queue', count(*) FILTER (queue <> ''), count(*) FROM {TICKETS} UNION ALL SELECT 'cause', count(*) FILTER (idx % 3 = 2), count(*) FROM {TICKETS})""")
def field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    cause = F.when(F.col("idx") % 3 == 0, "None").when(F.col("idx") % 3 == 2, "x")
    return labels.coverage(tickets(spark, sf).withColumn("cause", cause), ["subject", "queue", "cause"])


@register(f"""SELECT idx, subject AS prob_sub, CASE WHEN idx % 4 = 0 THEN '' ELSE queue END AS prob_statement, CASE WHEN idx % 2 = 0 THEN 'billing_issue' ELSE 'general_inquiry' END AS intent, 'product_support' AS ticket_type_nli
FROM (SELECT idx, regexp_replace(subject, '["\\\n'']', '', 'g') AS subject, queue FROM {TICKETS}) WHERE idx % 5 > 0""")
def silver_labels(spark: SparkSession, sf: str) -> DataFrame:
    """What a judge says of the tickets that are not judged yet; the judge here repeats the ticket."""
    rows = tickets(spark, sf).withColumn("subject", F.regexp_replace("subject", "[\"\\\\\n']", ""))
    said = F.concat(
        F.lit('```json\n{"prob_sub": "'), "subject", F.lit('", '), F.when(F.col("idx") % 4 == 0, "").otherwise(F.concat(F.lit('"prob_statement": "'), "queue", F.lit('", '))),
        F.lit('"intent": "'), F.when(F.col("idx") % 2 == 0, "Billing Issue").otherwise("?"), F.lit('",}\n```'),
    )
    judge = lambda df: df.withColumn("generated_answer", said)
    done = rows.filter("idx % 5 = 0").select(F.col("idx").cast("string").alias("idx"))
    return labels.silver_labels(rows, "Extract the fields.", judge, done).select("idx", "prob_sub", "prob_statement", "intent", "ticket_type_nli")



@register(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def tokens_unicode(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@register(f"""WITH t AS (SELECT idx, list_distinct({TOKENS.format("body")}) AS a FROM {TICKETS}), p AS (SELECT x.idx, x.a, y.a AS b FROM t x JOIN t y ON y.idx = x.idx + 1)
SELECT idx, round({_JAC.format(a="a", b="b")}, 4) AS jaccard FROM p""")
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    t = tickets(spark, sf).select("idx", F.array_distinct(T.tokens(F.col("body"))).alias("a"))
    both = t.join(t.select((F.col("idx") - 1).alias("idx"), F.col("a").alias("b")), "idx")
    return both.select("idx", F.round(T.jaccard(F.col("a"), F.col("b")), 4).alias("jaccard"))


# --- text functions ----------------------------------------------------------------------------------


@register(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\n\n+', '. ', 'g'), '[\n]', ' ', 'g')) AS t FROM documents),
m AS (SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(t, '\*\*[^*]+\*\*', '', 'g'), '\s\s+', ' ', 'g')), '([.!?])\s+([A-Za-zÜÖÄ\[*])', '\1' || chr(30) || '\2', 'g'), '([.!?])\s+([A-Za-zÜÖÄ\[*])', '\1' || chr(30) || '\2', 'g') AS t FROM d)
SELECT doc_id, list_filter(list_transform(string_split(t, chr(30)), lambda s: trim(s)), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) >= 2) AS sentences FROM m""")
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("sentences"))


_MASK = (
    f"regexp_replace(regexp_replace(regexp_replace(text, '{T.EMAIL}', '<email>', 'g'), '{T.PHONE}', '<phone>', 'g'), '{T.URL}', '<url>', 'g')"
)


@register(f"SELECT doc_id, {_MASK} AS masked FROM documents")
def pii_mask(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.mask_pii(F.col("text")).alias("masked"))


@register(f"""SELECT doc_id, array_to_string(list_concat(list_transform(regexp_extract_all(text, '{T.EMAIL}'), lambda x: '<email:' || x || '>'),
list_transform(regexp_extract_all(text, '{T.PHONE}'), lambda x: '<phone:' || x || '>')), ', ') AS pii FROM documents""")
def pii_extract(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.extract_pii(F.col("text")).alias("pii"))


@register(rf"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '(?i){T.VERSION}'))) AS versions FROM documents""")
def entity_regex(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.entities(F.col("text")).alias("e")).select("doc_id", "e.versions")




def _found_sql(pattern: str) -> str:
    return "regexp_extract_all(" + _EDGES.format("text") + f", '{pattern}', 1)"


_CODES_SQL = "list_concat(" + ", ".join([
    _found_sql("(?i)" + _BEFORE + r"(?:error|err|code|errno)[:\s#]*(\w+)" + _AFTER), _found_sql(_BEFORE + r"([A-Z]{2,}_[A-Z_]{2,})" + _AFTER),
    "list_transform(" + _found_sql("(?i)" + _BEFORE + r"(HTTP\s*[45]\d{2})" + _AFTER) + r", lambda x: regexp_replace(x, '(\s)\s', '\1', 'g'))",
]) + ")"
_TOOLS_SQL = "list_transform(" + _found_sql("(?i)" + _BEFORE + "(" + "|".join(T.TOOLS) + ")" + _AFTER) + ", lambda x: lower(x))"
_TERMS_SQL = _found_sql("(?i)" + _BEFORE + T.DE_TERMS.removeprefix(r"\b").removesuffix(r"\b") + _AFTER)


@register(f"SELECT doc_id, list_sort(list_distinct({_CODES_SQL})) AS error_codes, list_sort(list_distinct({_TOOLS_SQL})) AS products, list_sort(list_distinct({_TERMS_SQL})) AS de_domain FROM documents")
def entity_bag(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.entities(F.col("text")).alias("e")).select("doc_id", "e.error_codes", "e.products", "e.de_domain")


def _filler_sql(opener: str, filler: str) -> str:
    x = f"trim(regexp_replace(trim(text), '(?im){opener}', '', 'g'))"
    x = f"regexp_replace(regexp_replace({x}, '(?i){filler}', '. ', 'g'), '\\.\\s*\\.', '.', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^[-,.:;\\s]+', ''))"


@register(f"""SELECT doc_id, CASE WHEN length(x) > 10 THEN x ELSE trim(text) END AS text FROM (SELECT doc_id, text,
CASE WHEN lang = 'de' THEN {_filler_sql(T.OPENER_DE, T.FILLER_DE)} ELSE {_filler_sql(T.OPENER_EN, T.FILLER_EN)} END AS x FROM documents)""")
def strip_filler(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.strip_filler(F.col("text"), F.col("lang")).alias("text"))


@register("SELECT page_id, regexp_replace(html, '<br ?/?>', ' ', 'g') AS html FROM pages")
def br_strip(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", T.strip_breaks(F.col("html")).alias("html"))


@register(f"SELECT doc_id, {tiers_sql(T.URGENCY, 'text')} AS urgency FROM documents")
def urgency(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.urgency(F.col("text")).alias("urgency"))


@register(f"SELECT doc_id, {tiers_sql(T.SEVERITY, 'text')} AS severity FROM documents")
def severity(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.severity(F.col("text")).alias("severity"))


@register(f"SELECT idx, {CHECKLIST_SQL} AS checklist FROM {ITEMS_SQL}")
def checklist(spark: SparkSession, sf: str) -> DataFrame:
    return with_checklist(tickets(spark, sf)).select("idx", "checklist")


@register("SELECT doc_id, substr(sha256(text), 1, 12) AS sha FROM documents")
def sha_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("sha"))


@register("SELECT doc_id, length(doc_id::VARCHAR) AS size, row_number() OVER (ORDER BY length(doc_id::VARCHAR), doc_id::VARCHAR) AS place FROM documents")
def id_order(spark: SparkSession, sf: str) -> DataFrame:
    """All ids by length, then as text."""
    ids = sampling.by_id_text(read(spark, sf, "documents").select("doc_id"), "doc_id")
    return ids.select("doc_id", F.length(F.col("doc_id").cast("string")).alias("size"), "place")


@register(f"SELECT idx, subject || chr(10) || 'Severity : ' || {tiers_sql(T.SEVERITY, 'body')} || chr(10) || 'rest' AS prompt FROM {TICKETS} WHERE strpos(subject, chr(10)) = 0")
def inject_severity(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.concat(F.lit("Severity : "), T.severity(F.col("body")), F.lit("\n"))
    t = tickets(spark, sf).filter(F.instr("subject", "\n") == 0)
    return t.select("idx", T.insert_after_first_line(F.concat("subject", F.lit("\nrest")), lines).alias("prompt"))


# --- span clean-up, heads ------------------------------------------------------------------------


def _pleasant_sql(c: str) -> str:
    return f"regexp_matches({c}, '(?i){T.PLEASANTRY}')"


def _swapped_sql(c: str, used: str) -> str:
    """A pleasantry becomes the first sentence of four words that is no pleasantry and is not used."""
    words = "len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> ''))"
    return f"CASE WHEN lower({c}) <> 'none' AND {_pleasant_sql(c)} THEN coalesce(list_filter(r, lambda x: {words} >= 4 AND NOT {_pleasant_sql('x')} AND NOT list_contains({used}, x))[1], 'none') ELSE {c} END"


def _alike_sql(a: str, b: str) -> str:
    return _JAC.format(a=f"list_distinct({TOKENS.format(a)})", b=f"list_distinct({TOKENS.format(b)})") + " > 0.8"


_SPLIT_SQL = r"""trim(regexp_replace(regexp_replace({}, '\n\n+', '. ', 'g'), '[\n]', ' ', 'g'))"""
_MARK_SQL = r"""regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(t, '\*\*[^*]+\*\*', '', 'g'), '\s\s+', ' ', 'g')), '([.!?])\s+([A-Za-zÜÖÄ\[*])', '\1' || chr(30) || '\2', 'g'), '([.!?])\s+([A-Za-zÜÖÄ\[*])', '\1' || chr(30) || '\2', 'g')"""


@register(f"""WITH d AS (SELECT conv_id * 1000 + turn AS pair_id, {_SPLIT_SQL.format('question')} AS t FROM {PAIRS}), m AS (SELECT pair_id, {_MARK_SQL} AS t FROM d),
l AS (SELECT pair_id, list_filter(list_transform(string_split(t, chr(30)), lambda s: trim(s)), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) >= 2) AS r FROM m),
a AS (SELECT pair_id, r, coalesce(r[1], '') AS p0, coalesce(r[2], '') AS c0, coalesce(r[3], '') AS a0 FROM l),
b AS (SELECT *, {_swapped_sql('p0', '[p0]')} AS p1 FROM a), c AS (SELECT *, {_swapped_sql('c0', '[p0, p1]')} AS c1 FROM b), e AS (SELECT *, {_swapped_sql('a0', '[p0, p1, c1]')} AS a1 FROM c),
f AS (SELECT *, CASE WHEN lower(p1) = 'none' THEN '' ELSE p1 END AS p, CASE WHEN lower(c1) = 'none' THEN '' ELSE c1 END AS cc, CASE WHEN lower(a1) = 'none' THEN '' ELSE a1 END AS aa FROM e),
g AS (SELECT *, CASE WHEN {_alike_sql('cc', 'p')} THEN 'none' ELSE c1 END AS c2 FROM f), h AS (SELECT *, CASE WHEN lower(c2) = 'none' THEN '' ELSE c2 END AS cv FROM g),
k AS (SELECT *, CASE WHEN {_alike_sql('aa', 'p')} OR {_alike_sql('aa', 'cv')} OR NOT regexp_matches(aa, '(?i){_BEFORE}{_CUE}{_AFTER}') THEN 'none' ELSE a1 END AS a2,
    concat_ws(' | ', CASE WHEN p <> '' THEN p END, CASE WHEN cv <> '' AND cv <> p THEN cv END) AS told FROM h)
SELECT pair_id, CASE WHEN p1 = '' THEN 'none' ELSE p1 END AS prob_sub, CASE WHEN c2 = '' THEN 'none' ELSE c2 END AS cause, CASE WHEN a2 = '' THEN 'none' ELSE a2 END AS action_taken,
CASE WHEN told <> '' THEN told ELSE 'none' END AS prob_statement FROM k""")
def span_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of each question as its spans and as what may replace them."""
    said = pairs(spark, sf).select("pair_id", T.sentences(F.col("question")).alias("s"))
    spans = said.select("pair_id", "s", *(F.get("s", F.lit(k)).alias(c) for k, c in enumerate(aspects.SPANS)))
    return aspects.clean_spans(spans, dict.fromkeys(aspects.SPANS, "s")).drop("s")


@register()
def heads_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Three heads on the vectors, measured over all held-out rows and by language."""
    n = F.col("vec_id")
    e = read(spark, sf, "embeddings").withColumns({
        "queue": F.col("label").cast("string"), "type": (F.col("label") % 3).cast("string"), "priority": (F.col("label") % 2).cast("string"), "language": F.when(n % 2 == 0, "en").otherwise("de"),
        "part": F.crc32(n.cast("string")) % 4,
    })
    heads = models.train_heads(e.filter("part < 3"), "embedding")
    return models.evaluate_heads(e.filter("part = 3"), "embedding", heads)


@register()
def lr_heads(spark: SparkSession, sf: str) -> DataFrame:
    """A head on the vectors: it learns where the id's crc32 leaves 0 to 2 of 4 and is measured on the others."""
    e = read(spark, sf, "embeddings").withColumn("part", F.crc32(F.col("vec_id").cast("string")) % 4)
    model, names = models.train_head(e.filter("part < 3"), "embedding", "label")
    return models.evaluate_head(models.predict_head(e.filter("part = 3"), "embedding", model, names), "label", "predicted")
