"""Queries on aspects, prompts, systems, reports, preparation of tickets, and round trips through files."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeloom.functions import prompts as P
from lodeloom.functions import text as T
from lodeloom.functions import vocabulary as V
from lodeloom.functions import wording as W
from lodeloom.functions.vectors import norm
from lodeloom.operators import aspects, preprocess, report, runners, sampling, statistics, tables
from lodeloom.session import delete, shared_dir
from lodeloom.sources import files, sinks

from .registry import PAIRS, TICKETS, TOKENS, pairs, read, register, tickets

# --- greetings, encoding, cleaning -----------------------------------------------------

_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@register(f"""SELECT idx, {_WORDS.format('subject')} <= 18 AND regexp_matches(trim(subject), {_quoted('(?i)' + T.PURE_GREETING)}) AS greeting FROM {TICKETS}""")
def pure_greeting(spark: SparkSession, sf: str) -> DataFrame:
    return tickets(spark, sf).select("idx", T.is_pure_greeting(F.col("subject")).alias("greeting"))


_STRIPPED = "regexp_replace(trim(regexp_replace({}, " + _quoted("(?i)" + T.GREETING_PREFIX) + ", '')), '^,+', '')"


@register(f"""SELECT idx, CASE WHEN {_WORDS.format('x')} < 4 THEN subject ELSE upper(substr(x, 1, 1)) || substr(x, 2) END AS subject FROM (SELECT idx, subject, trim({_STRIPPED.format('subject')}) AS x FROM {TICKETS})""")
def strip_greeting(spark: SparkSession, sf: str) -> DataFrame:
    return tickets(spark, sf).select("idx", T.strip_greeting(F.col("subject")).alias("subject"))


def _mended_sql(column: str) -> str:
    for broken, right in T.MOJIBAKE.items():
        column = f"replace({column}, '{broken}', '{right}')"
    return column


_BROKEN = "CASE WHEN idx % 3 = 0 THEN body ELSE replace(replace(body, 'ü', 'Ã¼'), 'é', 'Ã©') END"


@register(f"SELECT idx, {_mended_sql('body')} AS body FROM (SELECT idx, {_BROKEN} AS body FROM {TICKETS})")
def fix_encoding(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.replace(F.replace("body", F.lit("ü"), F.lit("Ã¼")), F.lit("é"), F.lit("Ã©"))
    rows = tickets(spark, sf).withColumn("body", F.when(F.col("idx") % 3 == 0, F.col("body")).otherwise(broken))
    return rows.select("idx", T.fix_encoding(F.col("body")).alias("body"))


_CLEAN = r"trim(regexp_replace(regexp_replace(trim({}), '\s+', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s.,!?;:\-]', '', 'g'))"


@register(f"SELECT idx, {_CLEAN.format('body')} AS body FROM {TICKETS}")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return tickets(spark, sf).select("idx", T.clean_text(F.col("body")).alias("body"))


def _masked_sql(column: str) -> str:
    for pattern, tag in ((T.EMAIL, "<email>"), (T.PHONE, "<phone>"), (T.URL, "<url>"), (r"(?i)\btel_num\b", "<phone>"), (r"(?i)\bacc_num\b", "<account>")):
        column = f"regexp_replace({column}, '{pattern}', '{tag}', 'g')"
    return column


_PII_SQL = f"""array_to_string(list_concat(list_transform(regexp_extract_all(body, '{T.EMAIL}'), lambda x: '<email:' || x || '>'),
list_transform(regexp_extract_all(body, '{T.PHONE}'), lambda x: '<phone:' || x || '>')), ', ')"""


@register(f"""WITH c AS (SELECT idx, {_CLEAN.format(_mended_sql("coalesce(subject, 'NO SUBJECT')"))} AS subject, {_CLEAN.format(_mended_sql('body'))} AS body FROM {TICKETS})
SELECT idx, subject, {_masked_sql('body')} AS body, {_PII_SQL} AS "PII_data", {_masked_sql('body')} AS answer FROM c WHERE length(body) > 0""")
def preprocess_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """Tickets, cleaned and masked (the answer is the body again)."""
    rows = preprocess.preprocess(tickets(spark, sf).withColumn("answer", F.col("body")))
    return rows.select("idx", "subject", "body", "PII_data", "answer")


# --- aspects -----------------------------------------------------------------------------


def _stub(text: Column) -> Column:
    """An embedder that SQL has too: how many words of each length from 1 to 8, at length 1."""
    count = lambda words: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.size(F.filter(words, lambda w: F.least(F.length(w), F.lit(8)) == k)).cast("double"))
    sized = lambda counts: T.let(norm(counts) + 1e-9, lambda n: F.transform(counts, lambda x: x / n))
    return T.let(T.let(T.tokens(text), count), sized)


def _stub_sql(text: str) -> str:
    counts = f"list_transform(range(1, 9), lambda k: len(list_filter({TOKENS.format(text)}, lambda w: least(length(w), 8) = k))::DOUBLE)"
    return f"list_transform({counts}, lambda x: x / (sqrt(list_dot_product({counts}, {counts})) + 1e-9))"


def _stub_centroids() -> dict[str, list[float]]:
    out = {}
    for role, texts in V.ROLE_ANCHORS.items():
        vectors = []
        for text in texts:
            sizes = [min(len(w), 8) for w in text.lower().split()]
            counts = [sizes.count(k) for k in range(1, 9)]
            length = sum(c * c for c in counts) ** 0.5 + 1e-9
            vectors.append([c / length for c in counts])
        mean = [sum(x) / len(vectors) for x in zip(*vectors, strict=True)]
        length = sum(x * x for x in mean) ** 0.5 + 1e-9
        out[role] = [x / length for x in mean]
    return out


_SENTENCES_SQL = r"""WITH d AS (SELECT idx, trim(regexp_replace(regexp_replace(body, '\n\n+', '. ', 'g'), '[\n]', ' ', 'g')) AS t FROM {tickets}),
m AS (SELECT idx, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(t, '\*\*[^*]+\*\*', '', 'g'), '\s\s+', ' ', 'g')), '([.!?])\s+([A-Za-zÜÖÄ\[*])', '\1' || chr(30) || '\2', 'g'), '([.!?])\s+([A-Za-zÜÖÄ\[*])', '\1' || chr(30) || '\2', 'g') AS t FROM d),
l AS (SELECT idx, list_filter(list_transform(string_split(t, chr(30)), lambda s: trim(s)), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) >= 2) AS s FROM m)"""
_ROLES_SQL = f"""{_SENTENCES_SQL.replace('{tickets}', TICKETS)},
e AS (SELECT idx, unnest(s) AS text, unnest(range(1, len(s) + 1)) AS sent_num FROM l),
c AS (SELECT idx, sent_num, text, {_WORDS.format('text')} <= 18 AND regexp_matches(trim(text), {_quoted('(?i)' + T.PURE_GREETING)}) AS pure, trim({_STRIPPED.format('text')}) AS x FROM e),
k AS (SELECT idx, sent_num, CASE WHEN {_WORDS.format('x')} < 4 THEN text ELSE upper(substr(x, 1, 1)) || substr(x, 2) END AS cleaned_text FROM c WHERE NOT pure),
v AS (SELECT *, {_WORDS.format('cleaned_text')} AS words, {_stub_sql('cleaned_text')} AS vec FROM k WHERE {_WORDS.format('cleaned_text')} >= 3),
r AS (SELECT * FROM (VALUES {', '.join(f"('{r}', {V.ROLE_WINDOWS[r][0]}, {V.ROLE_WINDOWS[r][1]}, {c}::DOUBLE[])" for r, c in _stub_centroids().items())}) t(role, low, high, cen)),
s AS (SELECT idx, role, sent_num, cleaned_text, words, list_dot_product(vec, cen) AS cos, round(list_dot_product(vec, cen) + CASE WHEN sent_num BETWEEN low AND high THEN 0.12 ELSE 0.0 END, 4) AS base FROM v, r),
f AS (SELECT *, CASE WHEN role = 'prob_statement' THEN round(base + least(words / 100.0::DOUBLE, 0.08::DOUBLE), 4) ELSE base END AS final_score, role = 'prob_sub' AND sent_num <= 3 AND round(cos, 4) >= 0.15 AS early FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY idx, role, early ORDER BY final_score DESC, sent_num) AS place FROM f),
z AS (SELECT idx, role, sent_num, cleaned_text, row_number() OVER (PARTITION BY idx, role ORDER BY early DESC, final_score DESC, sent_num) AS rank FROM p WHERE NOT early OR place <= 2)"""


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    return aspects.rank_sentences(tickets(spark, sf), "idx", "body", _stub, aspects.anchor_centroids(spark, _stub))


@register(f"{_ROLES_SQL} SELECT idx, role, rank, sent_num::BIGINT AS sent_num FROM z WHERE rank <= 3")
def sentence_roles(spark: SparkSession, sf: str) -> DataFrame:
    return _roles(spark, sf).select("idx", "role", "rank", F.col("sent_num").cast("long").alias("sent_num"))


_FIT = f"{_WORDS.format('trim(cleaned_text)')} >= 4 AND NOT regexp_matches(trim(cleaned_text), {_quoted('(?i)' + T.CLOSING)})"


@register(f"""{_ROLES_SQL}, g AS (SELECT idx, role, trim(cleaned_text) AS t, row_number() OVER (PARTITION BY idx, role ORDER BY rank) AS n FROM z WHERE rank <= 3 AND {_FIT})
SELECT idx, max(t) FILTER (role = 'prob_sub') AS prob_sub, max(t) FILTER (role = 'prob_statement') AS prob_statement, max(t) FILTER (role = 'cause') AS cause,
max(t) FILTER (role = 'action_taken') AS action_taken FROM g WHERE n = 1 GROUP BY idx""")
def best_span(spark: SparkSession, sf: str) -> DataFrame:
    return aspects.best_spans(_roles(spark, sf), "idx").select("idx", "prob_sub", "prob_statement", "cause", "action_taken")


@register(f"""{_SENTENCES_SQL.replace('{tickets}', TICKETS)} SELECT idx, len(s) AS n, round(list_sum(list_transform(range(0, len(s)), lambda i: i / greatest(len(s) - 1, 1))), 4) AS places FROM l WHERE len(s) > 0""")
def sentence_places(spark: SparkSession, sf: str) -> DataFrame:
    """How many sentences a ticket has, and the sum of their places from 0 to 1."""
    rows = tickets(spark, sf).select("idx", aspects.content_sentences(F.col("body")).alias("s")).filter(F.size("s") > 0)
    total = F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["position_pct"]), 4)
    return rows.select("idx", F.size("s").cast("long").alias("n"), total.alias("places"))


@register()
def extract_aspects(spark: SparkSession, sf: str) -> DataFrame:
    rows = aspects.extract_aspects(tickets(spark, sf), "idx", _stub)
    return rows.select("idx", "prob_sub", "prob_statement", "cause", "action_taken", "entities", "urgency")


@register()
def entity_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = tickets(spark, sf)
    return rows.select("idx", aspects.entities(F.col("subject"), F.col("body"), F.col("language")).alias("entities"))


@register(f"""WITH p AS (SELECT conv_id * 1000 + turn AS pair_id, question, answer FROM {PAIRS}), a AS (SELECT pair_id, {_stub_sql('question')} AS v FROM p WHERE pair_id % 3 > 0 AND trim(question) <> ''),
b AS (SELECT pair_id, {_stub_sql('s')} AS v FROM (SELECT pair_id, unnest(string_split(answer, '. ')) AS s FROM p)),
m AS (SELECT a.pair_id, max(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))) AS best FROM a JOIN b ON a.pair_id = b.pair_id GROUP BY 1)
SELECT count(*) AS n, count(CASE WHEN pair_id % 3 > 0 THEN 1 END) AS with_aspects, bool_and((coverage IS NULL) = (pair_id % 3 = 0)) AS sound FROM (SELECT pair_id, best AS coverage FROM p LEFT JOIN m USING (pair_id))""")
def aspect_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with and without aspects: those without have a null coverage and are there."""
    rows = pairs(spark, sf).withColumn("prob_sub", F.when(F.col("pair_id") % 3 > 0, F.col("question")).otherwise("none"))
    out = report.aspect_coverage(rows, "pair_id", "answer", ["prob_sub"], _stub)
    return out.agg(
        F.count("*").alias("n"), F.count(F.when(F.col("pair_id") % 3 > 0, 1)).alias("with_aspects"), F.bool_and(F.col("coverage").isNull() == (F.col("pair_id") % 3 == 0)).alias("sound")
    )


_PARTS = ["prob_sub", "cause", "intent"]
_VALUE = {"prob_sub": "CASE WHEN idx % 4 = 0 THEN '' ELSE trim(subject) END", "cause": "CASE WHEN idx % 3 = 0 THEN 'None' WHEN idx % 3 = 1 THEN NULL ELSE 'x' END", "queue": "trim(queue)"}


def _with_parts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("idx")
    return tickets(spark, sf).withColumn("prob_sub", F.when(n % 4 == 0, "").otherwise(F.col("subject"))).withColumn("cause", F.when(n % 3 == 0, "None").when(n % 3 == 2, "x"))


@register("SELECT ticket_id, k, v FROM (" + " UNION ALL ".join(f"SELECT idx::VARCHAR AS ticket_id, '{k}' AS k, {v} AS v FROM {TICKETS}" for k, v in _VALUE.items()) + ") WHERE v IS NOT NULL AND lower(v) NOT IN ('', 'none', 'nan')")
def ticket_records(spark: SparkSession, sf: str) -> DataFrame:
    """The aspects that each ticket's stored record has."""
    rows = aspects.records(_with_parts(spark, sf), _PARTS, ["queue", "priority"])
    return rows.select("ticket_id", F.explode("aspects").alias("k", "v"))


@register(f"""SELECT idx, 'GIVEN' || chr(10) || 'Subject               : ' || substr(trim(subject), 1, 10) || chr(10) || 'Queue                 : ' || trim(queue) AS context FROM {TICKETS}""")
def context_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = P.labelled_lines(["subject", "queue"], {"queue": "Queue"}, {"subject": 10})
    return tickets(spark, sf).select("idx", F.concat(F.lit("GIVEN\n"), lines).alias("context"))


# --- prompts -------------------------------------------------------------------------------


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@register(f"""SELECT idx, {_sql_text(W.REPLY_HEAD + 'Subject: ')} || subject || {_sql_text(chr(10) + 'Message: ')} || substr(body, 1, 300) || {_sql_text(chr(10) * 2 + 'Support reply:')} AS zero_shot,
{_sql_text(W.TICKET_HEAD + 'Subject: ')} || subject || {_sql_text(chr(10) + 'Message: ')} || body || {_sql_text(chr(10) * 2 + W.AGENT_REPLY)} AS completion,
{_sql_text(W.T5_HEAD + 'Subject: ')} || subject || {_sql_text(chr(10) + 'Message: ')} || body || {_sql_text(chr(10) * 2 + 'Reply:')} AS t5 FROM {TICKETS}""")
def prompts_plain(spark: SparkSession, sf: str) -> DataFrame:
    s, b = F.col("subject"), F.col("body")
    return tickets(spark, sf).select("idx", P.zero_shot(s, b, 300).alias("zero_shot"), P.completion(s, b).alias("completion"), P.t5_instruction(s, b).alias("t5"))


def _spans(rows: DataFrame) -> DataFrame:
    """Every third ticket has no problem, every second no cause."""
    problem = F.when(F.col("idx") % 3 == 0, "none").otherwise(F.col("subject"))
    cause = F.when(F.col("idx") % 2 == 0, "").otherwise(F.col("queue"))
    return rows.withColumn("spans", F.create_map(F.lit("prob_sub"), problem, F.lit("cause"), cause, F.lit("intent"), F.col("queue"), F.lit("entities"), F.lit("Docker")))


_SPANNED = f"(SELECT *, CASE WHEN idx % 3 = 0 THEN 'none' ELSE subject END AS p, CASE WHEN idx % 2 = 0 THEN '' ELSE queue END AS c FROM {TICKETS})"
_LIST_SQL = "concat_ws(' | ', CASE WHEN p NOT IN ('', 'none') THEN 'prob_sub: ' || p END, CASE WHEN c <> '' THEN 'cause: ' || c END, 'intent: ' || queue)"
_MUST_SQL = "'The response MUST directly address: ' || p || '. ' || CASE WHEN c <> '' THEN 'Root cause: ' || c || '. ' ELSE '' END"
_LANGUAGE = "'Write the reply in ' || CASE language WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'the customer''s language' END || ', the same language as the customer''s message.'"


@register(f"""SELECT idx, {_sql_text(T.PROMPT_HEAD)} || {_MUST_SQL} || chr(10) || chr(10) || 'Aspects : ' || {_LIST_SQL} || chr(10) || 'Entities : Docker' || chr(10) || 'Context : [1]' || chr(10)
|| 'Subject : ' || subject || chr(10) || 'Message : ' || body || chr(10) || {_LANGUAGE} || chr(10) || 'Support reply:' AS prompt FROM {_SPANNED}""")
def prompts_slots(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spans(tickets(spark, sf))
    return rows.select("idx", P.slots(F.lit("[1]"), F.col("subject"), F.col("body"), F.col("language"), F.col("spans")).alias("prompt"))


@register(f"""SELECT idx, {_sql_text(W.GUIDED_HEAD)} || CASE WHEN idx % 5 = 0 THEN '{W.NO_EXAMPLES}' ELSE '[Example 1]' || chr(10) || '  Subject : ' || subject || chr(10) || '  Response: ' || queue END
|| {_sql_text(chr(10) * 2 + '---' + chr(10) + 'NEW TICKET:' + chr(10) + 'Subject: ')} || subject || chr(10) || CASE WHEN p <> '' THEN 'Issue: ' || p || chr(10) ELSE '' END
|| CASE WHEN c <> '' THEN 'Root cause: ' || c || chr(10) ELSE '' END || 'Aspects    : ' || {_LIST_SQL} || chr(10) || 'Entities   : Docker' || chr(10) || 'Message: ' || body || {_sql_text(chr(10) * 2 + 'Support reply:')} AS prompt FROM {_SPANNED}""")
def prompts_guided(spark: SparkSession, sf: str) -> DataFrame:
    rows = _spans(tickets(spark, sf))
    one = F.array(F.struct(F.col("subject"), F.col("queue").alias("response")))
    docs = F.when(F.col("idx") % 5 == 0, F.slice(one, 1, 0)).otherwise(one)
    return rows.select("idx", P.guided(docs, F.col("subject"), F.col("body"), F.col("spans")).alias("prompt"))


@register(f"""SELECT idx, {_sql_text(W.CLASSIFY_HEAD + 'intent must be one of: ' + W.INTENT_CHOICE + chr(10) * 2 + 'ticket_type_nli must be one of: ' + W.TYPE_CHOICE + chr(10) * 2 + 'Ticket language: ')} || language
|| chr(10) || 'Subject: ' || subject || chr(10) || 'Key information:' || chr(10) || CASE WHEN idx % 3 = 0 AND idx % 2 = 0 THEN '(see subject)' ELSE concat_ws(chr(10), CASE WHEN idx % 3 <> 0 THEN 'Problem: ' || subject END,
CASE WHEN c <> '' AND NOT (idx % 3 <> 0 AND c = subject) THEN 'Cause: ' || c END) END || {_sql_text(chr(10) * 2 + 'JSON:')} AS classify,
{_sql_text(W.FIELDS_HEAD + 'intent: ' + W.INTENT_CHOICE.replace(' | ', '|') + chr(10) + 'ticket_type_nli: ' + W.TYPE_CHOICE.replace(' | ', '|') + chr(10) * 2 + 'Language: ')} || language || chr(10) || 'Subject: ' || subject
|| chr(10) || 'Body: ' || substr(body, 1, 600) || {_sql_text(chr(10) * 2 + 'JSON:')} AS fields,
json_object('prob_sub', subject, 'prob_statement', '', 'cause', '', 'intent', 'general_inquiry', 'ticket_type_nli', queue)::VARCHAR AS target FROM {_SPANNED}""")
def prompts_labels(spark: SparkSession, sf: str) -> DataFrame:
    """What label models are asked, and the answer that they learn."""
    rows = _spans(tickets(spark, sf))
    problem, none = F.when(F.col("idx") % 3 != 0, F.col("subject")), F.lit("")
    record = F.create_map(F.lit("prob_sub"), F.col("subject"), F.lit("ticket_type_nli"), F.col("queue"))
    return rows.select(
        "idx", P.classify(F.col("subject"), problem, F.try_element_at("spans", F.lit("cause")), none, none, F.col("language")).alias("classify"),
        P.five_fields(F.col("subject"), F.col("body"), F.col("language")).alias("fields"), P.five_fields_target(record).alias("target"),
    )


@register(f"""SELECT idx, CASE WHEN idx % 2 = 0 THEN body ELSE '<bos>' || body END AS once, '<start_of_turn>user' || chr(10) || subject || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || queue || '<end_of_turn>' || chr(10) AS chat FROM {TICKETS}""")
def training_text(spark: SparkSession, sf: str) -> DataFrame:
    """One mark of beginning less, and a training text."""
    rows = tickets(spark, sf)
    marked = F.concat(F.when(F.col("idx") % 2 == 0, "<bos>").otherwise("<bos><bos>"), "body")
    return rows.select("idx", P.strip_bos(marked).alias("once"), P.chat_text(F.col("subject"), F.col("queue")).alias("chat"))


@register(f"""SELECT idx, CASE WHEN language <> 'en' THEN 'n/a' WHEN s >= 0.25 THEN 'positive' WHEN s <= -0.25 THEN 'negative' ELSE 'neutral' END AS sentiment,
CASE WHEN language <> 'en' THEN '' ELSE 'Sentiment: ' || CASE WHEN s >= 0.25 THEN 'positive' WHEN s <= -0.25 THEN 'negative' ELSE 'neutral' END || ' (compound=' || printf('%.3f', s) || ')' || chr(10) END
|| 'Severity : ' || CASE WHEN s <= -0.6 AND sev IN ('low', 'medium') THEN 'high' ELSE sev END || chr(10) AS lines
FROM (SELECT *, ((idx % 21) - 10) / 10.0::DOUBLE AS s, {{severity}} AS sev FROM {TICKETS})""")
def sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Sentiment by a caller's score, and what goes into a prompt."""
    score = ((F.col("idx") % 21) - 10) / 10.0
    lang = F.col("language")
    return tickets(spark, sf).select("idx", P.sentiment(lang, score).alias("sentiment"), P.mood_lines(F.col("body"), lang, score).alias("lines"))


def _list_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@register(f"""WITH w AS (SELECT idx, {TOKENS.format('body')} AS w FROM {TICKETS}), c AS (SELECT idx, lang, len(list_filter(w, lambda x: list_contains(words, x))) AS n FROM w,
(VALUES {', '.join(f"('{k}', {_list_sql(v)})" for k, v in runners.STOPWORDS.items())}) t(lang, words))
SELECT idx, CASE WHEN max(n) > 0 THEN arg_min(lang, (-n, lang)) END AS lang FROM c GROUP BY idx""")
def lang_detect(spark: SparkSession, sf: str) -> DataFrame:
    return tickets(spark, sf).select("idx", runners.detect_language(F.col("body")).alias("lang"))


_REPLIES = """(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'So: {"response": "r' || doc_id || '", "queue": "' || source || '", "priority": "HIGH"} done' WHEN 1 THEN '{"response": "r' || doc_id || '", "priority": "Low"'
    WHEN 2 THEN 'no object at all' ELSE '{"queue": "' || source || '"}' END AS raw, source FROM documents)"""


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    n, text = F.col("doc_id"), F.col("doc_id").cast("string")
    whole = F.concat(F.lit('So: {"response": "r'), text, F.lit('", "queue": "'), "source", F.lit('", "priority": "HIGH"} done'))
    raw = F.when(n % 4 == 0, whole).when(n % 4 == 1, F.concat(F.lit('{"response": "r'), text, F.lit('", "priority": "Low"'))).when(n % 4 == 2, "no object at all")
    return read(spark, sf, "documents").select("doc_id", raw.otherwise(F.concat(F.lit('{"queue": "'), "source", F.lit('"}'))).alias("raw"), "source")


@register(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'r' || doc_id WHEN 1 THEN 'r' || doc_id WHEN 2 THEN 'no object at all' ELSE '' END AS response_pred,
CASE WHEN doc_id % 4 IN (0, 3) THEN source ELSE 'General Inquiry' END AS queue_pred, CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS priority_pred FROM {_REPLIES}""")
def reply_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of whole, cut off, missing and partial objects in models' replies."""
    return _replies(spark, sf).select("doc_id", T.reply_fields(F.col("raw")).alias("x")).select("doc_id", "x.*")


_SAID = ["billing issue", "outage", "data_or_integration", "", "login_or_access now", "xyz"]
_MEANT = ["billing_issue", "service_outage", "data_or_integration", "general_inquiry", "login_or_access", "general_inquiry"]


@register("SELECT doc_id, " + _list_sql(_MEANT) + "[doc_id % 6 + 1] AS intent, CASE WHEN doc_id % 2 = 0 THEN 'complaint' ELSE 'product_support' END AS ticket_type_nli FROM documents")
def label_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Labels from fenced objects with single quotes and a comma too many, snapped to the vocabulary."""
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("doc_id") % 6 + 1).cast("int"))
    kind = F.when(F.col("doc_id") % 2 == 0, "Complaint").otherwise("?!")
    raw = F.concat(F.lit("```json\n{'intent': '"), said, F.lit("', 'ticket_type_nli': '"), kind, F.lit("',}\n```"))
    return read(spark, sf, "documents").select("doc_id", T.label_reply(raw).alias("x")).select("doc_id", "x.*")


# --- systems and reports --------------------------------------------------------------------


@register()
def run_systems(spark: SparkSession, sf: str) -> DataFrame:
    """Every compared system on every twentieth ticket, with the models' defaults."""
    from .search import _index

    rows = _spans(tickets(spark, sf).filter("idx % 20 = 0")).withColumn("answer", F.col("queue"))
    embedder = runners.Embedder(lambda c: runners.hashed_embedding(c, 64))
    return runners.run_all(rows, [runners.system(name, embedder=embedder) for name in runners.SYSTEMS], _index(spark, sf))


_PER_ROW = """(SELECT doc_id::VARCHAR AS idx, lower(substr(lang, 1, 2)) AS language, system, CASE WHEN system = 's2_gemma3' THEN quality WHEN system = 's4_raft_aspect' THEN toxic WHEN system = 's5_raft_noaspect' THEN (doc_id % 5) / 4.0
    WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 3) / 2.0 END::DOUBLE AS "rougeL", CASE WHEN doc_id % 4 = 0 THEN NULL ELSE quality + length(system) / 100.0 END::DOUBLE AS acs
    FROM labels JOIN documents USING (doc_id), (VALUES ('s2_gemma3'), ('s4_raft_aspect'), ('s5_raft_noaspect'), ('s6_gemma3_noaspect')) t(system))"""


def _per_row(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up metrics of four systems on the labelled documents."""
    rows = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    names = F.explode(F.array(*map(F.lit, ["s2_gemma3", "s4_raft_aspect", "s5_raft_noaspect", "s6_gemma3_noaspect"])))
    rows, n = rows.withColumn("system", names), F.col("doc_id")
    value = F.when(F.col("system") == "s2_gemma3", F.col("quality")).when(F.col("system") == "s4_raft_aspect", F.col("toxic")).when(F.col("system") == "s5_raft_noaspect", n % 5 / 4.0)
    value = value.when(n % 7 == 0, None).otherwise(n % 3 / 2.0)
    acs = F.when(n % 4 != 0, F.col("quality") + F.length("system") / 100.0)
    return rows.select(n.cast("string").alias("idx"), F.lower(F.substring("lang", 1, 2)).alias("language"), "system", value.cast("double").alias("rougeL"), acs.cast("double").alias("acs"))


_TABLE_SQL = f"""WITH long AS (SELECT idx, language, system, 'rougeL' AS metric, "rougeL" AS v FROM {_PER_ROW} UNION ALL SELECT idx, language, system, 'acs', acs FROM {_PER_ROW}),
s AS (SELECT *, 'all' AS split FROM long UNION ALL SELECT *, language FROM long),
b AS (SELECT split, metric, idx, v AS base, row_number() OVER (PARTITION BY split, metric ORDER BY length(idx), idx) - 1 AS p, count(*) OVER (PARTITION BY split, metric) AS n FROM s WHERE system = 's2_gemma3' AND v IS NOT NULL),
o AS (SELECT s.system, split, metric, avg(v) AS own FROM b JOIN s USING (split, metric, idx) GROUP BY 1, 2, 3),
f AS (SELECT s.system, split, metric, p, n, base, coalesce(s.v, own) AS v FROM b JOIN s USING (split, metric, idx) JOIN o ON o.system = s.system AND o.split = b.split AND o.metric = b.metric WHERE own IS NOT NULL AND n >= 2),
d AS (SELECT n, draw, ('0x' || substr(md5('42:' || draw::VARCHAR || ':' || slot::VARCHAR), 1, 8))::BIGINT % n AS p
    FROM (SELECT DISTINCT n, unnest(range(0, n)) AS slot FROM b), (SELECT unnest(range(0, 200)) AS draw)),
m AS (SELECT system, split, metric, draw, avg(v) AS m, avg(v - base) AS d FROM f JOIN d USING (n, p) GROUP BY 1, 2, 3, 4),
q AS (SELECT system, split, metric, quantile_cont(m, 0.025) AS a, quantile_cont(m, 0.975) AS z, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM m GROUP BY 1, 2, 3),
w AS (SELECT system, split, metric, count(*) AS n, round(avg(v), 4) AS mean, round(avg(v - base), 4) AS diff FROM f GROUP BY 1, 2, 3),
t AS (SELECT system, split, metric, n, mean, round(a, 4) AS ci_low, round(z, 4) AS ci_high, CASE WHEN system <> 's2_gemma3' THEN 's2_gemma3' END AS vs_baseline, CASE WHEN system <> 's2_gemma3' THEN diff END AS diff,
    CASE WHEN system <> 's2_gemma3' THEN round(lo, 4) END AS diff_ci_low, CASE WHEN system <> 's2_gemma3' THEN round(hi, 4) END AS diff_ci_high, CASE WHEN system <> 's2_gemma3' THEN lo > 0 OR hi < 0 END AS significant FROM w JOIN q USING (system, split, metric))"""
_TABLE_SQL = _TABLE_SQL.replace("range(0, 200)", "range(0, 1000)")


@register(f"{_TABLE_SQL} SELECT * FROM t")
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Means, intervals and paired differences of each system, split and metric."""
    return report.bootstrap_table(_per_row(spark, sf), ["rougeL", "acs"])


@register(f"""{_TABLE_SQL} SELECT a.system AS with_aspects, b.system AS without, a.metric, round(a.mean - b.mean, 4) AS diff, NULL::BOOLEAN AS significant FROM t a JOIN t b ON a.metric = b.metric AND a.split = 'all' AND b.split = 'all'
WHERE (a.system, b.system) IN (('s2_gemma3', 's6_gemma3_noaspect'), ('s4_raft_aspect', 's5_raft_noaspect'))""")
def aspect_contribution(spark: SparkSession, sf: str) -> DataFrame:
    return report.aspect_contribution(report_rows(spark, sf))


@register(f"""SELECT 'S1' AS system, CASE WHEN pair_id % 2 = 0 THEN 'en' ELSE 'de' END AS language, round(avg({_WORDS.format('answer')}), 4) AS mean_words, round(100 * avg({_WORDS.format('answer')}) / avg({_WORDS.format('question')}), 4) AS percent
FROM (SELECT conv_id * 1000 + turn AS pair_id, question, answer FROM {PAIRS}) GROUP BY 2""")
def reply_lengths(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs(spark, sf).select(F.lit("S1").alias("system"), F.when(F.col("pair_id") % 2 == 0, "en").otherwise("de").alias("language"), F.col("answer").alias("reply"), F.col("question").alias("answer"))
    return report.reply_lengths(rows)


@register("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 0 END")
def first_examples(spark: SparkSession, sf: str) -> DataFrame:
    return report.first_examples(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", {"en": 1, "de": 2})


@register("SELECT doc_id, n_chars FROM documents WHERE n_chars IN (SELECT n_chars FROM documents GROUP BY n_chars HAVING count(*) >= 2)")
def several_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report.several_rows(read(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars")


_LOG = "CASE event_id % 4 WHEN 0 THEN ' step ' || event_id || ' loss 1.5 ' WHEN 1 THEN '[RAFT] row ' || event_id WHEN 2 THEN event_id || '/99 [00:01, 3.1it/s] loss' ELSE event_type END"


@register(f"SELECT place, line FROM (SELECT event_id AS place, trim({_LOG}) AS line FROM events) WHERE (contains(line, 'loss') OR starts_with(line, '[RAFT]')) AND place % 4 <> 2 ORDER BY place DESC LIMIT 60")
def trainer_log(spark: SparkSession, sf: str) -> DataFrame:
    n, text = F.col("event_id"), F.col("event_id").cast("string")
    line = F.when(n % 4 == 0, F.concat(F.lit(" step "), text, F.lit(" loss 1.5 "))).when(n % 4 == 1, F.concat(F.lit("[RAFT] row "), text)).when(n % 4 == 2, F.concat(text, F.lit("/99 [00:01, 3.1it/s] loss")))
    return report.trainer_log(read(spark, sf, "events").select(n.alias("place"), line.otherwise(F.col("event_type")).alias("line")))


@register("SELECT round(avg((source = (SELECT min(source) FROM documents))::INT), 4) AS share FROM documents")
def value_share(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("source")
    least = docs.agg(F.min("source")).first()[0]
    return tables.value_share(docs, "source", least or "")


@register("SELECT 0::BIGINT AS n, NULL::DOUBLE AS mean, NULL::DOUBLE AS ci_low, NULL::DOUBLE AS ci_high")
def interval_of_nothing(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "labels").filter("doc_id < 0").select("doc_id", F.col("quality").cast("double").alias("v"))
    return statistics.bootstrap_ci(spark, rows, "doc_id", "v")


@register("""SELECT doc_id, system, v FROM (SELECT doc_id, 'S1' AS system, quality AS v FROM labels UNION ALL SELECT doc_id, 'S2', toxic FROM labels)""")
def label_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns named by system, put back into one long table."""
    wide = read(spark, sf, "labels").withColumnsRenamed({"quality": "S1_response", "toxic": "S2_response"})
    long = wide.unpivot(["doc_id"], ["S1_response", "S2_response"], "system", "v")
    return long.withColumn("system", F.regexp_replace("system", "_response$", ""))


# --- samples and orders -----------------------------------------------------------------------


@register("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 150")
def uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.uniform_sample(read(spark, sf, "documents").select("doc_id"), "doc_id", 150)


@register("SELECT doc_id, least((row_number() OVER (ORDER BY doc_id) - 1) // (SELECT greatest(1, count(*) // 7) FROM documents), 6)::INT AS part FROM documents")
def row_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.row_ranges(read(spark, sf, "documents").select("doc_id"), "doc_id", 7)


@register("SELECT idx, row_number() OVER (ORDER BY n, idx) - 1 AS place FROM (SELECT doc_id::VARCHAR || CASE WHEN doc_id % 50 = 0 THEN 'x' ELSE '' END AS idx, CASE WHEN doc_id % 50 <> 0 THEN doc_id END AS n FROM documents) WHERE n IS NOT NULL")
def numeric_order(spark: SparkSession, sf: str) -> DataFrame:
    """Places of ids that are numbers, in the order of these; others have none."""
    ids = read(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 50 == 0, "x").otherwise("")).alias("idx"))
    numbers = ids.withColumn("n", F.col("idx").try_cast("bigint")).filter("n is not null")
    return sampling.dense_index(numbers, "n", "place").select("idx", "place")


@register("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 75")
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "lang").orderBy("doc_id").limit(75)


@register("""SELECT (SELECT count(*) FROM documents) - floor((SELECT count(*) FROM documents) * 0.8)::BIGINT AS held, (SELECT count(*) FROM documents) AS n, true AS disjoint""")
def training_split(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows are held out of training, and that no row is in two parts."""
    rows = preprocess.training_split(tickets(spark, sf).select("idx", "language"), "idx")
    held = F.count_if(F.col("split") != "train")
    return rows.agg(held.alias("held"), F.count("*").alias("n"), (F.countDistinct("idx") == F.count("*")).alias("disjoint"))


@register(f"SELECT idx AS doc_id, subject, substr(body, 1, 1000) AS body, body AS response, language FROM {TICKETS}")
def index_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What the index shows of each document: bodies cut to 1000 characters."""
    from .search import _index

    return _index(spark, sf).documents().select("doc_id", "subject", "body", "response", "language")


# --- round trips through files ------------------------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lodeloom/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(delete, spark, path)
    return path


_ODD_TEXT = "CASE WHEN doc_id % 3 = 0 THEN 'say \"' || source || '\", ' || chr(10) || lang WHEN doc_id % 3 = 1 THEN '' ELSE source END"


def _odd_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.when(n % 3 == 0, F.concat(F.lit('say "'), "source", F.lit('", \n'), "lang")).when(n % 3 == 1, F.lit(None)).otherwise(F.col("source"))
    return read(spark, sf, "documents").select(n.cast("string").alias("idx"), text.alias("text"))


@register(f"SELECT doc_id::VARCHAR AS idx, {_ODD_TEXT} AS text FROM documents")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes, line ends and missing values through CSV with a mark of UTF-8."""
    path = _place(spark, "csv")
    sinks.write_csv(_odd_rows(spark, sf), path, bom=True)
    return files.read_table(spark, path, ["idx", "text"])


@register(f"SELECT doc_id::VARCHAR AS idx, CASE WHEN doc_id % 3 <> 1 THEN {_ODD_TEXT} END AS text FROM documents")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "jsonl")
    sinks.write_jsonl(_odd_rows(spark, sf), path, ["idx", "text"])
    return files.read_jsonl(spark, path, "idx string, text string")


@register("SELECT doc_id::VARCHAR AS idx, source FROM documents")
def appended_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Rows appended in batches by two runs, of which the second only has the rest to do."""
    path = _place(spark, "batches")
    rows = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("idx"), "source")
    sinks.append_batches(rows.filter("idx % 3 = 0"), path, ["idx", "source"], "idx", 10_000)
    sinks.append_batches(rows, path, ["idx", "source"], "idx", 10_000)
    return files.read_jsonl(spark, path, "idx string, source string")


@register("SELECT doc_id, lang FROM documents")
def write_once(spark: SparkSession, sf: str) -> DataFrame:
    """A sample that is written once: a second write changes nothing."""
    path, docs = _place(spark, "once"), read(spark, sf, "documents").select("doc_id", "lang")
    _, first = sinks.write_once(docs, path)
    kept, second = sinks.write_once(docs.filter("doc_id < 5"), path)
    if first != second:
        raise ValueError("the sample has changed")
    return kept


def _fill_severity() -> None:
    from .registry import ORACLE_SQL
    from .search import tiers_sql

    ORACLE_SQL["sentiment"] = ORACLE_SQL["sentiment"].replace("{severity}", tiers_sql(T.SEVERITY, "trim(body)"))


_fill_severity()
