"""Slots for models, and the systems that are compared: prompts made, replies generated, rows recorded.

A slot is a function on columns or tables that the caller passes in; each has a
default that needs no model. Systems return one long table, so their names are
values and not columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodeloom.functions import prompts as P
from lodeloom.functions import text as T
from lodeloom.functions.vectors import normalize, weighted_mean
from lodeloom.session import keep, ship_package

from .index import Index, bm25_search, dense_search
from .models import hashed_embedding
from .retrieval import Settings, overlap_score, retrieve, route

#: Weights of a query's vector, by part.
QUERY_WEIGHTS = {"prob_sub": 2.0, "prob_statement": 1.5, "cause": 1.0, "subject": 1.0, "body": 1.0}
NO_SUBJECT = "support ticket"


@dataclass
class Embedder:
    """``encode(texts, kind)``: vectors of length 1 of a text column; ``kind`` (query or passage) chooses the prefix."""

    model: Callable[[Column], Column] = hashed_embedding
    query_prefix: str = ""
    passage_prefix: str = ""

    def encode(self, text: Column, kind: str = "passage") -> Column:
        prefix = self.query_prefix if kind == "query" else self.passage_prefix
        whole = F.coalesce(text, F.lit(""))
        return self.model(F.concat(F.lit(prefix), whole) if prefix else whole)


def scorer(query: Column, doc: Column) -> Column:
    """The default re-ranker."""
    return overlap_score(T.tokens(query), T.tokens(doc))


def pair_scorer(predict: Callable[[list[tuple[str, str]]], list[float]]) -> Callable[[Column, Column], Column]:
    """A re-ranker from a function of (query, document) pairs, called on whole batches; 4 places."""

    @F.pandas_udf("double")
    def score(query: pd.Series, doc: pd.Series) -> pd.Series:
        return pd.Series(predict(list(zip(query.fillna(""), doc.fillna(""), strict=True))), dtype="float64").round(4)

    return score


def echo(rows: DataFrame) -> DataFrame:
    """The default generator: the first retrieved response, or nothing."""
    first = F.get(F.col("docs"), F.lit(0))["response"]
    return rows.withColumn("generated_answer", F.coalesce(first, F.lit("")))


def batch_generator(generate: Callable[[list[str]], list[str]], batch: int = 16) -> Callable[[DataFrame], DataFrame]:
    """A generator from a function of a list of prompts, called on ``batch`` of them at a time."""

    def run(rows: DataFrame) -> DataFrame:
        ship_package(rows.sparkSession)

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                prompts, out = frame["prompt"].tolist(), []
                for lo in range(0, len(prompts), batch):
                    out += generate(prompts[lo : lo + batch])
                yield frame.assign(generated_answer=out)

        return rows.mapInPandas(work, StructType([*rows.schema.fields, StructField("generated_answer", StringType())]))

    return run


# Frequent words of the languages that tickets are written in.
STOPWORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ich", "wir", "sie", "ein", "eine", "mit", "für", "auf", "von", "zu", "den", "dem", "bitte", "haben"],
    "en": ["the", "and", "is", "not", "you", "we", "of", "to", "in", "for", "with", "that", "this", "are", "have", "please", "your", "on", "it", "be"],
    "es": ["el", "la", "los", "las", "que", "de", "en", "una", "con", "por", "para", "está", "no", "es", "se", "su", "como", "más", "pero", "del"],
    "fr": ["le", "les", "des", "est", "et", "une", "dans", "que", "pour", "pas", "vous", "nous", "sur", "avec", "sont", "du", "au", "ce", "qui", "je"],
}


def detect_language(text: Column, words: dict[str, list[str]] | None = None) -> Column:
    """The language with most frequent words in the text (ties: by name); null for a text without any."""

    def votes(found: Column) -> Column:
        counted = lambda own: F.size(F.filter(found, lambda w: w.isin(own)))
        return F.array_min(F.array(*(F.struct((-counted(own)).alias("n"), F.lit(k).alias("lang")) for k, own in sorted((words or STOPWORDS).items()))))

    return T.let(T.let(T.tokens(F.coalesce(text, F.lit(""))), votes), lambda best: F.when(best["n"] < 0, best["lang"]))


def with_query_vector(rows: DataFrame, embedder: Embedder, aspect_languages: tuple[str, ...] | None = None) -> DataFrame:
    """``rows(subject, body, language, spans)`` with ``vector``: of subject and body, or, in ``aspect_languages`` where a row has spans, the weighted mean of these, subject and body.

    A missing subject is "support ticket" in a mean; missing and none spans, and a blank body, take no part.
    """
    text = F.concat(F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    rows = rows.withColumn("_plain", text)
    parts = {"_plain": None}
    if aspect_languages:
        known = (F.size(F.coalesce("spans", F.create_map().cast("map<string,string>"))) > 0) & F.substring(F.lower("language"), 1, 2).isin(*aspect_languages)
        part = {name: P.span(F.col("spans"), name) for name in ("prob_sub", "prob_statement", "cause")}
        part = {name: F.when(~F.lower(c).isin("", "none"), c) for name, c in part.items()}
        part["subject"] = F.when(F.length("subject") > 0, F.col("subject")).otherwise(NO_SUBJECT)
        part["body"] = F.when(F.trim(F.coalesce("body", F.lit(""))) != "", F.col("body"))
        rows = rows.withColumns({f"_{name}": F.when(known, c) for name, c in part.items()}).withColumn("_some", known)
        parts |= {f"_{name}": QUERY_WEIGHTS[name] for name in part}
    # A text becomes a row for each of its parts, so an embedder sees one column.
    cells = F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("t")) for p in parts))
    long = rows.withColumn("_x", F.explode(F.filter(cells, lambda x: x["t"].isNotNull())))
    coded = long.select("idx", F.col("_x.part").alias("part"), embedder.encode(F.col("_x.t"), "query").cast("array<double>").alias("v"))
    wide = coded.groupBy("idx").agg(*(F.max(F.when(F.col("part") == p, F.struct("part", "v")))["v"].alias(f"{p}_v") for p in parts))
    weights = [(F.col(f"{p}_v"), w) for p, w in parts.items() if w is not None]
    plain = F.col("_plain_v")
    vector = plain if not weights else F.when(F.col("_subject_v").isNotNull(), normalize(weighted_mean(weights))).otherwise(plain)
    return rows.drop(*parts, "_some").join(wide.select("idx", vector.alias("vector")), "idx")


@dataclass
class System:
    """A system: what its prompt holds, how it retrieves and generates. ``style``: zero_shot, completion, t5, aspects, context or guided."""

    name: str
    style: str = "zero_shot"
    use_aspects: bool = False
    crag: float | None = None
    mood: bool = False
    body_chars: int = 0
    response_chars: int = 1200
    max_tokens: int = 2048
    prompt_style: str = "checklist"
    settings: Settings = field(default_factory=Settings)
    embedder: Embedder = field(default_factory=Embedder)
    aspect_languages: tuple[str, ...] = ("en",)
    generate: Callable[[DataFrame], DataFrame] = echo
    count: Callable[[Column], Column] = T.word_count


_DOCS = "array<struct<subject:string,response:string>>"


def _ready(rows: DataFrame) -> DataFrame:
    """Missing texts are empty, a missing language is English."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("subject", "body", "answer")}
    return rows.withColumns(text).withColumn("language", F.coalesce("language", F.lit("en")))


def _asked(rows: DataFrame, system: System) -> DataFrame:
    coded = with_query_vector(rows, system.embedder, system.aspect_languages if system.use_aspects else None)
    return coded.select(
        F.col("idx").alias("query_id"), F.concat("subject", F.lit("\n"), "body").alias("text"), "vector", "language", F.array("idx").alias("exclude"),
        (F.col("spans") if system.use_aspects else F.lit(None).cast("map<string,string>")).alias("spans"),
    )


def _docs(hits: DataFrame) -> DataFrame:
    """``idx, docs, top_ce_score``: the hits of each row, best first, and the first one's score."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "subject", "response")))
    return hits.groupBy(F.col("query_id").alias("idx")).agg(
        F.transform(listed, lambda x: F.struct(x["subject"].alias("subject"), x["response"].alias("response"))).alias("docs"),
        F.max(F.when(F.col("rank") == 1, F.col("ce_score"))).alias("top_ce_score"),
    )


def _retrieves_alike(a: System, b: System) -> bool:
    aspects = a.use_aspects == b.use_aspects and (not a.use_aspects or a.aspect_languages == b.aspect_languages)
    return aspects and a.settings == b.settings and a.embedder == b.embedder


def run_all(rows: DataFrame, systems: list[System], index: Index | None = None) -> DataFrame:
    """``run`` of every system, in one table. Systems that retrieve alike share their hits, and those with as many candidates the search by words.

    Both are written once under the shared folder: a search meets all documents.
    """
    words, known, out = {}, [], None
    for one in systems:
        docs = None
        if one.style in ("context", "guided") and index is not None:
            docs = next((d for other, d in known if _retrieves_alike(one, other)), None)
            if docs is None:
                asked = keep(_asked(_ready(rows), one), "asked")
                found = [dense_search(asked.select("query_id", "vector"), index.vectors(), one.settings.candidates)]
                if one.settings.hybrid and index.lexical:
                    k = one.settings.candidates
                    if k not in words:
                        words[k] = keep(bm25_search(asked.select("query_id", "text"), index, k), "by-words")
                    found.append(words[k])
                docs = keep(_docs(retrieve(asked, index, one.settings, found)), "hits")
                known.append((one, docs))
        part = run(rows, one, index, docs=docs)
        out = part if out is None else out.unionByName(part)
    return out


def _prompt(system: System) -> Column:
    subject, body, lang = F.col("subject"), P.clip(F.col("body"), system.body_chars), F.col("language")
    spans = F.col("spans") if system.use_aspects else F.create_map().cast("map<string,string>")
    if system.style == "zero_shot":
        return P.zero_shot(subject, body)
    if system.style == "completion":
        return P.completion(subject, body)
    if system.style == "t5":
        return P.t5_instruction(subject, body)
    if system.style == "aspects":
        return P.aspects_only(subject, body, lang, F.col("spans"), style=system.prompt_style)
    if system.style == "guided":
        return P.guided(F.col("docs"), subject, body, spans)
    raise ValueError(f"no such style: {system.style}")


def run(rows: DataFrame, system: System, index: Index | None = None, done: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """``system, idx, language, subject, answer, prompt, generated_answer, length, n_retrieved, n_ctx_used, top_ce_score, route, spans``.

    ``rows(idx, language, subject, body, answer, spans)``; rows whose idx is in
    ``done`` are not run again, whatever its type. With context, the longest
    prefix of the hits that fits is used; with ``crag``, none where the first
    hit's score is below it. Missing texts count as empty, a missing language as
    English. ``docs(idx, docs, top_ce_score)``: hits that are known already.
    """
    rows = _ready(rows)
    if done is not None:
        rows = rows.join(done.select(F.col("idx").cast("string").alias("_done")).distinct(), F.col("idx").cast("string") == F.col("_done"), "left_anti")
    if system.style in ("context", "guided"):
        if index is None:
            raise ValueError(f"{system.name} needs an index")
        docs = _docs(retrieve(_asked(rows, system), index, system.settings)) if docs is None else docs
        rows = rows.join(docs, "idx", "left").withColumn("docs", F.coalesce("docs", F.array().cast(_DOCS))).withColumn("n_retrieved", F.size("docs"))
    else:
        rows = rows.withColumns({"docs": F.array().cast(_DOCS), "n_retrieved": F.lit(0), "top_ce_score": F.lit(None).cast("double")})
    if system.style == "context":
        way = F.lit("rag") if system.crag is None else route(F.col("top_ce_score").cast("string"), system.crag)
        spans = F.col("spans") if system.use_aspects else F.create_map().cast("map<string,string>")
        todo = P.spans_checklist(spans)
        rows = rows.withColumn("route", way).withColumn("_docs", F.when(F.col("route") == "rag", F.col("docs")).otherwise(F.array().cast(_DOCS))).withColumn("_todo", todo)
        lines = lambda some: F.array_join(P.context_lines(some, system.response_chars), "\n")
        body = P.clip(F.col("body"), system.body_chars)
        if system.prompt_style == "slots":
            build = lambda some: P.slots(lines(some), F.col("subject"), body, F.col("language"), spans)
        else:
            build = lambda some: T.support_prompt(lines(some), F.col("subject"), body, F.col("language"), F.col("_todo"))
        rows = rows.withColumn("_fit", P.fit_prompt(build, F.col("_docs"), system.max_tokens, system.count))
        rows = rows.withColumn("prompt", F.col("_fit.prompt")).withColumn("n_ctx_used", F.col("_fit.n_docs").cast("int"))
    else:
        rows = rows.withColumn("route", F.lit("")).withColumn("prompt", _prompt(system)).withColumn("n_ctx_used", F.col("n_retrieved"))
    if system.mood:
        rows = rows.withColumn("prompt", T.insert_after_first_line(F.col("prompt"), P.mood_lines(F.col("body"), F.col("language"))))
    kept = spans_of(rows, system.use_aspects or system.style == "aspects")
    ready = rows.select("idx", "language", "subject", "answer", "prompt", "docs", "n_retrieved", "n_ctx_used", "top_ce_score", "route", kept.alias("spans"))
    out = system.generate(ready).withColumn("length", T.word_count(F.col("generated_answer")))
    return out.select(
        F.lit(system.name).alias("system"), "idx", "language", "subject", "answer", "prompt", "generated_answer", "length", "n_retrieved", "n_ctx_used", "top_ce_score", "route", "spans"
    )


def spans_of(rows: DataFrame, wanted: bool) -> Column:
    """The aspects that are there and not none; an empty map for a system without them."""
    if not wanted or "spans" not in rows.columns:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.coalesce("spans", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & ~F.lower(F.trim(v)).isin("", "none", "nan"))


#: The compared systems.
SYSTEMS = {
    "baseline": {"style": "zero_shot"},
    "rag_only": {"style": "context", "mood": True},
    "aspect_only": {"style": "aspects", "use_aspects": True},
    "rag_aspect": {"style": "context", "use_aspects": True},
    "rag_aspect_crag": {"style": "context", "use_aspects": True, "crag": 0.5},
    "guided_rag": {"style": "guided"},
    "guided_rag_aspect": {"style": "guided", "use_aspects": True},
    "t5_baseline": {"style": "t5"},
    "pt_baseline": {"style": "completion"},
}


def system(name: str, **changes) -> System:
    """One of the compared systems, with some of its settings changed."""
    return System(name, **{**SYSTEMS[name], **changes})
