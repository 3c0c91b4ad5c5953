"""Prompts as column expressions: every style, and the longest one that fits a budget.

``spans`` is a map<string,string> of a ticket's aspects; a missing, blank or
'none' value is no aspect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import wording as W

CORE = ["prob_sub", "prob_statement", "cause", "intent", "ticket_type_nli"]
#: Tokens that a chat template adds around a prompt.
WRAPPER = 16


def _of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def span(spans: Column, key: str) -> Column:
    """An aspect's text; empty if there is none."""
    return _of(F.try_element_at(spans, F.lit(key)))


def _known(c: Column) -> Column:
    return (c != "") & (c != "none")


def clip(c: Column, most: int) -> Column:
    """The first characters; 0 means all."""
    return F.substring(c, 1, most) if most else c


def aspect_list(spans: Column, keys: list[str] | None = None, missing: str = "GENERAL") -> Column:
    """``key: value`` of the aspects in order, joined by `` | ``."""
    named = [F.when(_known(span(spans, k)), F.concat(F.lit(f"{k}: "), span(spans, k))) for k in keys or CORE]
    found = F.concat_ws(" | ", *named)
    return F.when(found == "", F.lit(missing)).otherwise(found)


def _problem(spans: Column) -> Column:
    first = span(spans, "prob_sub")
    return F.when(first != "", first).otherwise(span(spans, "prob_statement"))


def _must(spans: Column) -> Column:
    cause = span(spans, "cause")
    root = F.when(_known(cause), F.concat(F.lit("Root cause: "), cause, F.lit(". "))).otherwise("")
    return F.concat(F.lit("The response MUST directly address: "), _problem(spans), F.lit(". "), root)


def _line(label: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(label), c, F.lit("\n"))).otherwise("")


def spans_checklist(spans: Column) -> Column:
    """The checklist of a map of aspects."""
    get = lambda *keys: T.aspect(*(F.try_element_at(spans, F.lit(k)) for k in keys))
    return T.checklist(
        get("prob_sub", "prob_statement"), get("cause"), get("action_taken"), get("urgency"), get("intent"), get("ticket_type", "ticket_type_nli"), get("entities")
    )


def zero_shot(subject: Column, body: Column, most: int = 0) -> Column:
    """For instructed models, without context."""
    return F.concat(F.lit(W.REPLY_HEAD + "Subject: "), _of(subject), F.lit("\nMessage: "), clip(_of(body), most), F.lit("\n\nSupport reply:"))


def completion(subject: Column, body: Column) -> Column:
    """For models that only continue a text."""
    return F.concat(F.lit(W.TICKET_HEAD + "Subject: "), _of(subject), F.lit("\nMessage: "), _of(body), F.lit("\n\n" + W.AGENT_REPLY))


def t5_instruction(subject: Column, body: Column) -> Column:
    return F.concat(F.lit(W.T5_HEAD + "Subject: "), _of(subject), F.lit("\nMessage: "), _of(body), F.lit("\n\nReply:"))


def aspects_only(subject: Column, body: Column, lang: Column, spans: Column, most: int = 0, style: str = "checklist", compound: Column | None = None) -> Column:
    """Aspects without context, as a checklist or as slots."""
    text = clip(_of(body), most)
    if style == "checklist":
        todo = spans_checklist(spans)
        return F.concat(
            F.lit(W.ASPECT_HEAD), F.when(todo != "", F.concat(todo, F.lit("\n"))).otherwise(""), F.lit("\nSubject  : "), _of(subject), F.lit("\nMessage  : "), text,
            F.lit("\n\n"), T.language_line(lang), F.lit("\nSupport reply:"),
        )
    mood = sentiment(lang, compound)
    felt = F.when(mood == "n/a", "").otherwise(F.concat(F.lit("Sentiment: "), mood, F.lit(" (compound="), _signed(compound), F.lit(")\n")))
    urgency = F.when(span(spans, "urgency") != "", span(spans, "urgency")).otherwise(T.severity(F.trim(_of(body)), compound))
    return F.concat(
        F.lit(W.ASPECT_HEAD), _must(spans), F.lit("\n\nAspects  : "), aspect_list(spans, [*CORE, "entities", "action_taken", "urgency"]), F.lit("\n"),
        _line("Entities   : ", span(spans, "entities")), _line("ActionTaken: ", span(spans, "action_taken")), felt, F.lit("Urgency  : "), urgency,
        F.lit("\nSubject  : "), _of(subject), F.lit("\nMessage  : "), text, F.lit("\n\nSupport reply:"),
    )


def slots(context: Column, subject: Column, body: Column, lang: Column, spans: Column) -> Column:
    """Context and aspects as slots, the older style."""
    return F.concat(
        F.lit(T.PROMPT_HEAD), _must(spans), F.lit("\n\nAspects : "), aspect_list(spans), F.lit("\n"), _line("Entities : ", span(spans, "entities")),
        _line("ActionTaken: ", span(spans, "action_taken")), _line("Urgency  : ", span(spans, "urgency")), F.lit("Context : "), context, F.lit("\nSubject : "), _of(subject),
        F.lit("\nMessage : "), _of(body), F.lit("\n"), T.language_line(lang), F.lit("\n" + T.PROMPT_END),
    )


def guided(docs: Column, subject: Column, body: Column, spans: Column) -> Column:
    """Resolved tickets (``docs`` array<struct<subject,response>>) as examples, then the new one."""
    shown = F.transform(docs, lambda d, i: F.concat(F.lit("[Example "), (i + 1).cast("string"), F.lit("]\n  Subject : "), _of(d["subject"]), F.lit("\n  Response: "), _of(d["response"])))
    problem, cause, listed = _problem(spans), span(spans, "cause"), aspect_list(spans, missing="")
    return F.concat(
        F.lit(W.GUIDED_HEAD), F.when(F.size(docs) > 0, F.array_join(shown, "\n\n")).otherwise(W.NO_EXAMPLES), F.lit("\n\n---\nNEW TICKET:\nSubject: "), _of(subject), F.lit("\n"),
        _line("Issue: ", problem), F.when(_known(cause), F.concat(F.lit("Root cause: "), cause, F.lit("\n"))).otherwise(""), _line("Aspects    : ", listed),
        _line("Entities   : ", span(spans, "entities")), _line("ActionTaken: ", span(spans, "action_taken")), _line("Urgency    : ", span(spans, "urgency")),
        F.lit("Message: "), _of(body), F.lit("\n\nSupport reply:"),
    )


def _subject(c: Column) -> Column:
    return F.when(F.lower(_of(c)).isin("", "nan", "none"), F.lit("(none)")).otherwise(c)


def classify(subject: Column, problem: Column, cause: Column, action: Column, entities: Column, lang: Column) -> Column:
    """Asks for intent and ticket type, from the spans."""
    problem, cause, action, entities = map(_of, (problem, cause, action, entities))
    told = F.concat_ws(
        "\n", F.when(problem != "", F.concat(F.lit("Problem: "), problem)), F.when((cause != "") & (cause != problem), F.concat(F.lit("Cause: "), cause)),
        F.when(action != "", F.concat(F.lit("Action taken: "), action)), F.when(entities != "", F.concat(F.lit("Key entities: "), entities)),
    )
    head = f"{W.CLASSIFY_HEAD}intent must be one of: {W.INTENT_CHOICE}\n\nticket_type_nli must be one of: {W.TYPE_CHOICE}\n\nTicket language: "
    known = F.when(told == "", F.lit("(see subject)")).otherwise(told)
    return F.concat(F.lit(head), lang, F.lit("\nSubject: "), _subject(subject), F.lit("\nKey information:\n"), known, F.lit("\n\nJSON:"))


def five_fields(subject: Column, body: Column, lang: Column, most: int = 600) -> Column:
    """Asks a label model for the five fields of a ticket."""
    narrow = lambda x: x.replace(" | ", "|")
    head = f"{W.FIELDS_HEAD}intent: {narrow(W.INTENT_CHOICE)}\nticket_type_nli: {narrow(W.TYPE_CHOICE)}\n\nLanguage: "
    return F.concat(F.lit(head), lang, F.lit("\nSubject: "), _subject(subject), F.lit("\nBody: "), clip(_of(body), most), F.lit("\n\nJSON:"))


def judge(instruction: str, subject: Column, body: Column, lang: Column, most: int = 700) -> Column:
    """An instruction of the caller's (which fields, in which words), then the ticket."""
    return F.concat(
        F.lit(instruction.rstrip("\n") + "\n\nTicket language: "), lang, F.lit("\nSubject: "), _subject(subject), F.lit("\nBody: "), clip(_of(body), most), F.lit("\n\nJSON:")
    )


def five_fields_target(record: Column) -> Column:
    """The answer to ``five_fields``: a JSON object of the map's fields in order."""
    values = [F.coalesce(F.try_element_at(record, F.lit(k)), F.lit(W.FIELD_DEFAULTS.get(k, ""))).alias(k) for k in W.FIELD_NAMES]
    return F.to_json(F.struct(*values))


def sentiment(lang: Column, compound: Column | None = None) -> Column:
    """``positive``, ``negative`` or ``neutral`` by a score from -1 to 1 of a caller's scorer (none: 0); ``n/a`` for other languages than English."""
    x = F.lit(0.0) if compound is None else F.coalesce(compound, F.lit(0.0))
    english = F.substring(F.lower(F.trim(F.when(F.length(lang) > 0, lang).otherwise("en"))), 1, 2) == "en"
    return F.when(~english, "n/a").when(x >= 0.25, "positive").when(x <= -0.25, "negative").otherwise("neutral")


def _signed(compound: Column | None) -> Column:
    return F.format_string("%.3f", F.lit(0.0) if compound is None else F.coalesce(compound, F.lit(0.0)).cast("double"))


def mood_lines(body: Column, lang: Column, compound: Column | None = None) -> Column:
    """Lines of sentiment and severity to put into a prompt."""
    mood = sentiment(lang, compound)
    felt = F.when(mood == "n/a", "").otherwise(F.concat(F.lit("Sentiment: "), mood, F.lit(" (compound="), _signed(compound), F.lit(")\n")))
    return F.concat(felt, F.lit("Severity : "), T.severity(F.trim(_of(body)), compound), F.lit("\n"))


def context_lines(docs: Column, most: int = 0) -> Column:
    """Numbered subject and response of each of ``docs`` (array<struct<subject,response>>), a response cut to ``most`` characters (0: whole)."""
    return F.transform(
        docs,
        lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Subject: "), _of(d["subject"]), F.lit("\n     Response: "), clip(_of(d["response"]), most)),
    )


def fit_prompt(build: Callable[[Column], Column], docs: Column, most: int, count: Callable[[Column], Column] = T.word_count) -> Column:
    """``struct<n_docs, prompt>``: ``build`` of the longest prefix of ``docs`` whose tokens and WRAPPER are at most ``most``; of none if nothing fits."""
    tries = F.transform(F.sequence(F.size(docs), F.lit(0), F.lit(-1)), lambda n: F.struct(n.alias("n_docs"), build(F.slice(docs, F.lit(1), n)).alias("prompt")))
    first = F.get(F.filter(tries, lambda x: count(x["prompt"]) + WRAPPER <= most), F.lit(0))
    return F.coalesce(first, F.element_at(tries, -1))


def strip_bos(c: Column) -> Column:
    """Without one mark of beginning, which the trainer adds itself."""
    return F.when(F.startswith(c, F.lit(W.BOS)), F.substring(c, len(W.BOS) + 1, 1 << 30)).otherwise(c)


def chat_text(prompt: Column, answer: Column) -> Column:
    """One training text: the user's turn and the model's."""
    return F.concat(F.lit("<start_of_turn>user\n"), prompt, F.lit("<end_of_turn>\n<start_of_turn>model\n"), answer, F.lit("<end_of_turn>\n"))


def labelled_lines(columns: list[str], labels: dict[str, str] | None = None, most: dict[str, int] | None = None) -> Column:
    """A line for each column: its label, padded to 22 and never cut, and its trimmed value, cut where ``most`` says so."""
    lines = []
    for c in columns:
        label = (labels or {}).get(c, c.replace("_", " ").title())
        lines.append(F.concat(F.lit(f"{label:<22}: "), clip(F.trim(_of(c)), (most or {}).get(c, 0))))
    return F.concat_ws("\n", *lines)


def input_formats(subject: Column, body: Column, metadata: Column) -> dict[str, Column]:
    """The inputs of the model families."""
    return {
        "input_text": F.concat(F.lit(W.T5_GENERATE + "Subject: "), subject, F.lit("\nComplaint: "), body, F.lit("\n"), metadata),
        "t5_input": F.concat(F.lit(W.T5_TASK + "Subject: "), subject, F.lit(" Context: "), body),
        "instr_input": F.concat(F.lit(W.TURN_HEAD + "Subject: "), subject, F.lit("\nMessage: "), body, F.lit(W.TURN_END)),
    }


def metadata_string(columns: list[str], named: list[str]) -> Column:
    """``Field: value`` of the named columns that are there and not blank, then the tags, joined by `` | ``."""
    fields = [F.when(F.col(c) != "", F.concat(F.lit(f"{c.capitalize()}: "), F.col(c))) for c in named if c in columns]
    tags = [F.when(~F.col(c).isin("", "nan"), F.col(c)) for c in columns if c.startswith("tag_")]
    joined = F.concat_ws(", ", *tags) if tags else F.lit("")
    return F.concat_ws(" | ", *fields, F.when(joined != "", F.concat(F.lit("Tags: "), joined)))


def masked_labels(ids: Column, prompt_tokens: Column, ignored: int = -100) -> Column:
    """Labels of a training sequence: its ids, those of the prompt ignored by the loss."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_tokens, F.lit(ignored)).otherwise(x))
