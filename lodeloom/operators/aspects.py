"""Aspects of tickets: sentences by role, entities, and the clean-up of spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeloom.functions import text as T
from lodeloom.functions import vocabulary as V
from lodeloom.functions.vectors import dot

#: Spans, in the order in which they take up sentences.
SPANS = ["prob_sub", "cause", "action_taken"]
#: Two spans of a higher similarity say the same; a sentence that replaces a span has so many words.
SAME, LEAST_WORDS = 0.8, 4


def _text(c: Column) -> Column:
    return F.trim(T.fix_encoding(F.coalesce(c.cast("string"), F.lit(""))))


def _value(c: Column) -> Column:
    return F.when(F.lower(c) == "none", F.lit("")).otherwise(c)


def _alike(a: Column, b: Column) -> Column:
    return T.jaccard(F.array_distinct(T.tokens(a)), F.array_distinct(T.tokens(b))) > SAME


def _unused(seen: Column) -> Callable[[Column], Column]:
    return lambda s: (T.word_count(s) >= LEAST_WORDS) & ~T.is_pleasantry(s) & ~F.array_contains(seen, s)


def clean_spans(df: DataFrame, ranked: dict[str, str] | None = None) -> DataFrame:
    """``df`` with its spans ``prob_sub, cause, action_taken`` cleaned and ``prob_statement`` filled.

    ``ranked`` names, for a span, a column array<string> of sentences, best
    first. A pleasantry becomes the first of these that has four words, is no
    pleasantry and is no span already. A cause that says what the problem says
    goes, and an action that says what either says or that names no action.
    What goes, or is null or blank, is 'none'. A statement that is null or
    blank becomes the problem and the cause. Other columns stay.
    """
    ranked = ranked or {}
    used = F.array(_text(F.col("prob_sub")))
    now: dict[str, Column] = {}
    out = df
    for span in SPANS:
        own = _text(F.col(span))
        if span in ranked:
            fit = F.filter(
                F.transform(F.coalesce(F.col(ranked[span]), F.array().cast("array<string>")), lambda s: F.trim(F.coalesce(s, F.lit("")))),
                _unused(used),
            )
            other = F.coalesce(T.fix_encoding(F.get(fit, F.lit(0))), F.lit("none"))
        else:
            other = F.lit("none")
        out = out.withColumn(f"_{span}", F.when((F.lower(own) != "none") & T.is_pleasantry(own), other).otherwise(own))
        now[span] = F.col(f"_{span}")
        used = F.array(_text(F.col("prob_sub")), *now.values())
    problem, cause, action = (_value(now[s]) for s in SPANS)
    out = out.withColumn("_cause", F.when(_alike(cause, problem), F.lit("none")).otherwise(now["cause"]))
    drop = _alike(action, problem) | _alike(action, cause) | ~T.has_action_cue(action)
    out = out.withColumn("_action_taken", F.when(drop, F.lit("none")).otherwise(now["action_taken"]))
    both = F.concat_ws(" | ", F.when(problem != "", problem), F.when((cause != "") & (cause != problem), cause))
    said = _text(F.col("prob_statement")) if "prob_statement" in df.columns else F.lit("")
    out = out.withColumn("prob_statement", F.when(said != "", said).when(both != "", both).otherwise(F.lit("none")))
    out = out.withColumns({s: F.when(now[s] == "", F.lit("none")).otherwise(now[s]) for s in SPANS})
    return out.drop(*(f"_{s}" for s in SPANS))


# --- extraction ------------------------------------------------------------------------

#: Added to the similarity of a sentence in its role's window; least similarity of an early sentence; candidates of a role; words that count.
WINDOW_BONUS, EARLY, CANDIDATES, SCOREABLE = 0.12, 0.15, 3, 3
MOST_ENTITIES = 10


def content_sentences(body: Column) -> Column:
    """Sentences in order: number from 1, total, text, text without a greeting before it, whether it is a greeting, place from 0 to 1."""


    def numbered(found: Column) -> Column:
        of = lambda s, pure, i: F.struct(
            (i + 1).alias("sent_num"), F.size(found).alias("total_sents"), s.alias("text"), F.when(pure, s).otherwise(T.strip_greeting(s)).alias("cleaned_text"),
            pure.alias("is_greeting"), (i / F.greatest(F.size(found) - 1, F.lit(1))).alias("position_pct"),
        )
        return F.transform(found, lambda s, i: T.let(T.is_pure_greeting(s), lambda pure: of(s, pure, i)))

    return T.let(T.sentences(body), numbered)


def anchor_centroids(spark: SparkSession, embed: Callable[[Column], Column], anchors: dict[str, list[str]] = V.ROLE_ANCHORS) -> dict[str, list[float]]:
    """The mean of each role's anchor phrases, at length 1. A few dozen phrases come to the driver."""
    rows = spark.createDataFrame([(role, text) for role, texts in anchors.items() for text in texts], "role string, text string")
    found: dict[str, list] = {}
    for r in rows.select("role", embed(F.col("text")).cast("array<double>").alias("v")).collect():
        found.setdefault(r["role"], []).append(r["v"])
    out = {}
    for role, vectors in found.items():
        mean = [sum(x) / len(vectors) for x in zip(*vectors, strict=True)]
        size = sum(x * x for x in mean) ** 0.5 + 1e-9
        out[role] = [x / size for x in mean]
    return out


def rank_sentences(df: DataFrame, key: str, body: str, embed: Callable[[Column], Column], centroids: dict[str, list[float]]) -> DataFrame:
    """``key, role, rank, sent_num, cleaned_text, cos_sim, final_score``: the best three sentences for each role.

    Greetings and sentences of fewer than three words do not count. A sentence's
    score is its similarity to the role's anchors plus a bonus in the role's
    window; longer ones gain a little as problem statements. For the problem's
    subject the first two of the early similar sentences lead, and further early
    ones drop out. Equal scores keep the order of the text.
    """
    rows = df.select(key, F.explode(content_sentences(F.col(body))).alias("s")).select(key, "s.sent_num", "s.cleaned_text", "s.is_greeting")
    words = T.word_count(F.col("cleaned_text"))
    rows = rows.filter(~F.col("is_greeting") & (words >= SCOREABLE)).withColumn("words", words).withColumn("v", embed(F.col("cleaned_text")).cast("array<double>"))
    roles = F.array(*(
        F.struct(F.lit(r).alias("role"), F.lit(V.ROLE_WINDOWS[r][0]).alias("low"), F.lit(V.ROLE_WINDOWS[r][1]).alias("high"), F.array(*map(F.lit, c)).alias("c"))
        for r, c in centroids.items()
    ))
    rows = rows.withColumn("r", F.explode(roles)).withColumn("cos", dot(F.col("v"), F.col("r.c")))
    bonus = F.when(F.col("sent_num").between(F.col("r.low"), F.col("r.high")), WINDOW_BONUS).otherwise(0.0)
    score = F.round(F.col("cos") + bonus, 4)
    longer = F.round(score + F.least(F.col("words") / 100.0, F.lit(0.08)), 4)
    rows = rows.select(
        key, F.col("r.role").alias("role"), "sent_num", "cleaned_text", F.round("cos", 4).alias("cos_sim"),
        F.when(F.col("r.role") == "prob_statement", longer).otherwise(score).alias("final_score"),
    )
    early = (F.col("role") == "prob_sub") & (F.col("sent_num") <= 3) & (F.col("cos_sim") >= EARLY)
    order = [F.desc("final_score"), "sent_num"]
    rows = rows.withColumn("early", early).withColumn("place", F.row_number().over(Window.partitionBy(key, "role", "early").orderBy(*order)))
    rows = rows.filter(~F.col("early") | (F.col("place") <= 2))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key, "role").orderBy(F.desc("early"), *order))).filter(F.col("rank") <= CANDIDATES)
    return rows.select(key, "role", "rank", "sent_num", "cleaned_text", "cos_sim", "final_score")


def best_spans(ranked: DataFrame, key: str) -> DataFrame:
    """``key`` and, for each role, its best sentence of four words or more that is no closing; null if there is none."""
    text = F.trim("cleaned_text")
    fit = ranked.filter((T.word_count(text) >= LEAST_WORDS) & ~text.rlike("(?iu)" + T.CLOSING))
    first = [F.min(F.when(F.col("role") == r, F.struct("rank", text.alias("t"))))["t"].alias(r) for r in (*SPANS, "prob_statement", "urgency")]
    return fit.groupBy(key).agg(*first)


def entities(subject: Column, body: Column, language: Column, stopwords: list[str] | None = None) -> Column:
    """Names of products and systems, the first ten, joined by ``, ``.

    Names with versions, camel case, acronyms and hyphens; capitalised words
    that the body repeats or that look like products; in German, nouns that the
    subject has or the body repeats. Without sentence openers and ``stopwords``;
    the first of equal names (in any case) stays.
    """
    subject, body = F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))
    no = F.array(*(F.lit(x) for x in sorted({*(V.STOPWORDS if stopwords is None else stopwords), *(x.lower() for x in V.OPENERS)})))
    text = F.regexp_replace(F.concat(subject, F.lit(" "), body), "(?iu)" + T.GREETING_PREFIX, " ")
    every = lambda c, p: F.regexp_extract_all(c, F.lit("(?U)" + p), F.lit(0))
    lowered = lambda words: F.transform(words, lambda w: F.lower(F.trim(w)))
    # What stands twice: of the sorted words those that equal the one before.
    repeated = lambda words: T.let(F.array_sort(words), lambda x: F.array_distinct(F.filter(x, lambda w, i: (i > 0) & (w == F.get(x, i - 1)))))
    named = F.concat(*(F.transform(every(text, p), F.trim) for p in V.ENTITY_PATTERNS))
    single = T.let(repeated(lowered(every(body, V.CAPITALISED))), lambda twice: F.filter(F.array_distinct(every(text, V.CAPITALISED)), lambda w: F.array_contains(twice, F.lower(w)) | w.rlike(V.PRODUCT_LIKE)))

    def german(nouns: Column) -> Column:
        kept = lambda twice: T.let(F.split(subject, r"\s+"), lambda own: F.filter(F.array_distinct(nouns), lambda w: F.array_contains(own, w) | F.array_contains(twice, w)))
        return T.let(repeated(nouns), kept)

    found = F.concat(named, single, F.when(language == "de", T.let(every(body, V.GERMAN_NOUN), german)).otherwise(F.array().cast("array<string>")))
    fit = lambda w: (F.length(F.trim(w)) >= 2) & ~T.let(F.lower(F.trim(w)), lambda x: F.array_contains(no, x))

    def first(words: Column) -> Column:
        """Of equal words the first, at most MOST_ENTITIES: one after the other is put behind those that are kept."""
        step = lambda kept, w: F.when((F.size(kept) >= MOST_ENTITIES) | F.exists(kept, lambda k: F.lower(k) == F.lower(w)), kept).otherwise(F.concat(kept, F.array(w)))
        return F.aggregate(words, F.array().cast("array<string>"), step)

    return F.array_join(first(F.filter(F.array_distinct(found), fit)), ", ")


def extract_aspects(df: DataFrame, key: str, embed: Callable[[Column], Column], stopwords: list[str] | None = None) -> DataFrame:
    """``df(key, subject, body, language)`` with ``prob_sub, prob_statement, cause, action_taken, entities, urgency``.

    Encoding is mended; each span is the best sentence for its role, cleaned as
    in ``clean_spans``; a statement that no sentence gives is the problem and
    the cause. A row without a sentence has ``none`` for its spans.
    """
    mended = df.withColumns({c: T.fix_encoding(F.coalesce(c, F.lit(""))) for c in ("subject", "body")})
    ranked = rank_sentences(mended, key, "body", embed, anchor_centroids(df.sparkSession, embed))
    listed = [F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("rank", "cleaned_text")))).alias(f"_r_{r}") for r in SPANS]
    spans = best_spans(ranked, key).drop("urgency").join(ranked.groupBy(key).agg(*listed), key, "full")
    spans = spans.withColumns({f"_r_{r}": F.transform(f"_r_{r}", lambda x: x["cleaned_text"]) for r in SPANS})
    rows = mended.join(spans, key, "left")
    rows = clean_spans(rows, {r: f"_r_{r}" for r in SPANS}).drop(*(f"_r_{r}" for r in SPANS))
    named = entities(F.col("subject"), F.col("body"), F.lower(F.col("language")), stopwords)
    return rows.withColumn("entities", named).withColumn("urgency", T.urgency(F.col("body")))


def aspect_map(columns: list[str], gold: list[str]) -> Column:
    """A map of the aspect columns and gold columns that are there and hold a value."""
    value = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    pairs = [F.struct(F.lit(c).alias("k"), value(c).alias("v")) for c in (*columns, *gold)]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: ~F.lower(x["v"]).isin("", "nan", "none")))


def records(df: DataFrame, aspects: list[str], gold: list[str], language: str = "en") -> DataFrame:
    """``ticket_id, subject, body, response, language, aspects`` of tickets; the id is ticket_id, else idx, else a place in that order; aspects that the table lacks are left out."""
    if "ticket_id" in df.columns:
        number = F.col("ticket_id").cast("string")
    elif "idx" in df.columns:
        number = F.col("idx").cast("string")
    else:
        raise ValueError("tickets need ticket_id or idx: the rows of a table have no order of their own")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
    lang = F.coalesce(F.col("language"), F.lit(language)) if "language" in df.columns else F.lit(language)
    response = F.coalesce(F.col("answer"), F.lit("")) if "answer" in df.columns else F.lit("")
    has = lambda names: [c for c in names if c in df.columns]
    return df.select(number.alias("ticket_id"), text("subject"), text("body"), response.alias("response"), lang.alias("language"), aspect_map(has(aspects), has(gold)).alias("aspects"))
