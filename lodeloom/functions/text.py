"""Text columns: cleaning, masking, sentences, rules and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------
NULL_SPELLINGS = ["", "none", "nan"]
MISSING_ASPECTS = ["", "none", "n/a", "na", "unknown", "general"]
EMAIL = r"\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b"
PHONE = r"\b(?:\+?\d[\d\s\-().]{7,}\d)\b"
URL = r"https?://\S+|www\.\S+"
MOJIBAKE = {"Ã¼": "ü", "Ã¶": "ö", "Ã¤": "ä", "Ã\u009f": "ß", "Ã\u009c": "Ü", "Ã\u0096": "Ö", "Ã\u0084": "Ä", "Ã©": "é", "Ã¨": "è"}
ABBREVIATIONS = r"\b(Mr|Mrs|Dr|Prof|Sr|Jr|vs|etc|bzw|inkl|ggf|z\.B|d\.h|u\.a)\."
BOUNDARY = r"(?<=[.!?])\s+(?=[A-Za-zÜÖÄ\[\*])"
GREETING_PREFIX = (
    r"^(hello[\s,]*|hi[\s,]*|dear[\s,]*|good\s+(morning|afternoon|evening)[\s,]*|greetings[\s,]*|hey[\s,]*|"
    r"to\s+whom\s+it\s+may\s+concern[\s,]*|customer\s+support[\s,]*|support\s+team[\s,]*|sehr\s+geehrte[rns]?[\s,]*|liebe[rns]?[\s,]*|"
    r"guten\s+(morgen|tag|abend)[\s,]*|hallo[\s,]*|kundensupport[\s,]*|lieber\s+kundensupport[\s,]*|liebes\s+support[\s,]*)"
)
PURE_GREETING = (
    r"^((hello|hi|hey|dear|greetings)[^.!?]{0,40}[.!?]?\s*$|thank\s+you[\s.,!]*$|thanks[\s.,!]*$|best\s+regards[\s.,!]*$|sincerely[\s.,!]*$|"
    r"looking\s+forward\s+to[\s\S]{0,50}$|i\s+look\s+forward[\s\S]{0,50}$|your\s+(prompt\s+)?assistance[\s\S]{0,40}$|"
    r"we\s+(thank|appreciate)[\s\S]{0,40}$|(sehr\s+geehrte[rns]?|liebe[rns]?|hallo)[^.!?]{0,40}[.!?]?\s*$|danke[\s.,!]*$|vielen\s+dank[\s.,!]*$|"
    r"mit\s+freundlichen\s+gr[üu][sz]en[\s\S]{0,30}$|ich\s+hoffe[\s,].{0,60}(gut|well)[\s.,!]*$|ich\s+freue\s+mich[\s,].{0,80}$|"
    r"ich\s+danke\s+ihnen[\s\S]{0,60}$|wir\s+(danken|freuen)[\s\S]{0,60}$)"
)
PLEASANTRY = (
    r"(thank|thanks|appreciate|appreciated|look(ing)?\s+forward|regards|best\s+wishes|sincerely|danke|vielen\s+dank|"
    r"freundliche\s+gr[üu][sß]e|mit\s+freundlichen|ich\s+freue\s+mich)"
)
CLOSING = (
    r"^(thank|danke|vielen|bitte|please|regards|sincerely|ich\s+freue|ich\s+danke|mit\s+freundlichen|looking\s+forward|wir\s+freuen|best\s+regards)"
)
ACTION_CUE = (
    r"\b(tr(y|ied|ies)|attempt(s|ed)?|restart(s|ed|ing)?|reboot(s|ed|ing)?|reinstall(s|ed|ing)?|clear(s|ed|ing)?|updat(e|es|ed|ing)|reset|"
    r"check(s|ed|ing)?|contact(s|ed|ing)?|follow(s|ed|ing)?|ran|run|versucht|neu\s+gestartet|neugestartet|neu\s+installiert|aktualisiert|"
    r"zur[üu]ckgesetzt|[üu]berpr[üu]ft|gepr[üu]ft|kontaktiert)\b"
)
OPENER_EN = r"^(?:dear|hello|hi|good\s+(?:morning|afternoon|evening))\s*[\w\s,.\-]{0,35}[,.]?\s*"
OPENER_DE = r"^(?:sehr\s+geehrte[rs]?|guten\s+(?:morgen|tag|abend)|hallo|liebe[rs]?)\s*[\w\s,.\-]{0,35}[,.]?\s*"
FILLER_EN = (
    r"(?:^|\.\s+)(?:I\s+hope\s+(?:this|you|my)[^.]*\.|I\s+am\s+(?:writing|reaching\s+out)\s+to\s+(?:inform|request|inquire|report)[^.]*\.|"
    r"(?:Thank|Thanks)\s+you\s+for\s+(?:your\s+)?(?:time|support|assistance|help)[^.]*\.|I\s+look\s+forward\s+to[^.]*\.|"
    r"Please\s+do\s+not\s+hesitate\s+to[^.]*\.|Feel\s+free\s+to\s+contact[^.]*\.)"
)
FILLER_DE = (
    r"(?:^|\.\s+)(?:Ich\s+hoffe[^.]*\.|Ich\s+(?:schreibe|wende\s+mich)[^.]*\.|(?:Vielen\s+Dank|Danke)[^.]*\.|"
    r"Mit\s+(?:freundlichen|besten)\s+Grüßen[^.]*\.)"
)
TOOLS = [
    "MySQL", "PostgreSQL", "MongoDB", "Redis", "Kafka", "Docker", "Kubernetes", "AWS", "Azure", "GCP", "Windows", "Linux", "MacOS",
    "Android", "iOS", "Chrome", "Firefox", "Safari", "ClickUp", "Smartsheet", "Airtable", "Zapier", "Alteryx", "Elasticsearch",
    "RapidMiner", "DataRobot", "SendGrid", "Bitbucket", "DocuSign", "Magento", "Shopware", "HubSpot", "Salesforce", "ServiceNow",
    "Zendesk", "Freshdesk", "Intercom", "Jira", "Confluence", "ActiveCampaign", "Databricks", "Snowflake", "Tableau", "Stripe",
    "Twilio", "Cloudflare", "Datadog", "PagerDuty",
]
VERSION = r"\bv?\d+\.\d+(?:\.\d+)?\b"
ERROR_CODES = [(r"\b(?:error|err|code|errno)[:\s#]*(\w+)\b", 1, True), (r"\b[A-Z]{2,}_[A-Z_]{2,}\b", 0, False), (r"\bHTTP\s*[45]\d{2}\b", 0, True)]
DE_TERMS = r"\b(Patientendaten|Sicherheitsma[sß]nahmen|Sicherheitsprotokolle|SaaS-Plattform|Datenschutzrichtlinien|Systemintegration)\b"
URGENCY = {
    "critical": [
        "down", "outage", "offline", "unavailable", "cannot access", "can't access", "cannot login", "can't login", "unable to login",
        "locked out", "security breach", "data loss", "incident", "urgent", "asap", "immediately", "dringend", "sofort", "systemausfall",
        "datenverlust", "sicherheitsverletzung", "unerlaubter zugriff",
    ],
    "high": [
        "error", "failed", "failure", "not working", "crash", "crashing", "timeout", "bug", "broken", "payment", "refund", "invoice",
        "breach", "persists", "fehler", "absturz", "funktioniert nicht", "abgestuerzt", "ausgefallen",
    ],
    "medium": [
        "slow", "latency", "performance", "delay", "integration", "api", "sync", "langsam", "verzogerung", "synchronisation", "optimierung",
    ],
}
SEVERITY = {
    "critical": [
        "down", "outage", "offline", "unavailable", "cannot access", "can't access", "cannot login", "can't login", "unable to login",
        "locked out", "security breach", "data loss", "lost data", "incident", "urgent", "asap", "immediately", "dringend", "sofort",
        "systemausfall", "datenverlust", "sicherheitsverletzung", "unerlaubter zugriff",
    ],
    "high": [
        "error", "failed", "failure", "not working", "doesn't work", "does not work", "crash", "crashing", "timeout", "time out", "bug",
        "broken", "payment", "charged", "refund", "invoice", "billing", "persists", "fehler", "absturz", "funktioniert nicht", "abgestürzt",
        "ausgefallen", "rechnung", "zahlung", "erstattung",
    ],
    "medium": [
        "slow", "latency", "performance", "delay", "integration", "api", "sync", "export", "import", "feature request", "request",
        "how do i", "how to", "langsam", "verzögerung", "synchronisation", "optimierung",
    ],
}
INTENTS = ["performance_issue", "login_or_access", "billing_issue", "feature_request", "service_outage", "general_inquiry", "data_or_integration"]
TICKET_TYPES = ["complaint", "escalation", "feedback", "product_support"]
CHECKLIST_HEAD = "Your reply must:"
CHECKLIST_ITEMS = {
    "problem": "Solve the problem: {}",
    "cause": "Address the likely cause: {}",
    "action": "Acknowledge what the customer already tried: {}; do not suggest it again",
    "urgency": 'Tone for urgency "{}": ',
}
TONES = ("prioritise; give a concrete next step and timeline", "friendly and concise")
PROMPT_HEAD = "Write a concise customer support reply (under 150 words). No markdown headers, bullet points, or invented examples.\n"
PROMPT_END = "Support reply:"
LANGUAGES = {"en": "English", "de": "German"}
OTHER_LANGUAGE = "the customer's language"
# -------------------------------------------------------------------------------

_TOKEN = r"[\p{L}\p{N}_]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` has it in a lambda (which would compute it for every element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_null(c: Column) -> Column:
    """Lower-cased and trimmed; the spellings of a missing value become null."""
    x = F.lower(F.trim(c))
    return F.when(~x.isin(NULL_SPELLINGS), x)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")).cast("long")


def fix_encoding(c: Column) -> Column:
    for broken, right in MOJIBAKE.items():
        c = F.replace(c, F.lit(broken), F.lit(right))
    return c


def embedding_text(subject: Column, body: Column, most: int = 1800) -> Column:
    """Subject, a blank line, the first characters of the body (0: all)."""
    return F.concat(subject, F.lit("\n\n"), F.substring(body, 1, most) if most else body)


def strip_breaks(c: Column) -> Column:
    return F.regexp_replace(c, r"<br ?/?>", " ")


def clean_text(c: Column) -> Column:
    """White space folded; anything but words, white space and plain punctuation deleted."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?U)\s+", " "), r"(?U)[^\w\s.,!?;:\-äöüÄÖÜß]", ""))


def mask_pii(c: Column) -> Column:
    """E-mail, then phone, then URL, then the two placeholders."""
    for pattern, tag in ((EMAIL, "<email>"), (PHONE, "<phone>"), (URL, "<url>"), (r"(?i)\btel_num\b", "<phone>"), (r"(?i)\bacc_num\b", "<account>")):
        c = F.regexp_replace(c, pattern, tag)
    return c


def extract_pii(c: Column) -> Column:
    """``<email:...>`` then ``<phone:...>`` tags of what the text holds, joined by ``, ``."""

    def tagged(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x: F.concat(F.lit(f"<{name}:"), x, F.lit(">")))

    return F.array_join(F.concat(tagged("email", EMAIL), tagged("phone", PHONE)), ", ")


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    """Distinct matches, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group))))


def entities(c: Column) -> Column:
    """Versions, error codes, products and domain terms of a text."""
    codes = F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(c, F.lit(("(?i)" if i else "") + p), F.lit(g)) for p, g, i in ERROR_CODES))))
    products = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(rf"(?i)\b({'|'.join(TOOLS)})\b"), F.lit(1)), F.lower)))
    return F.struct(
        extract_all(c, "(?i)" + VERSION).alias("versions"), codes.alias("error_codes"), products.alias("products"),
        extract_all(c, "(?iu)" + DE_TERMS, 1).alias("de_domain"),
    )


def strip_filler(c: Column, lang: Column) -> Column:
    """Without openers and filler sentences; the trimmed original if 10 characters or fewer would be left."""
    whole = F.trim(c)

    def cleaned(opener: str, filler: str) -> Column:
        x = F.trim(F.regexp_replace(whole, "(?im)" + opener, ""))
        x = F.regexp_replace(F.regexp_replace(x, "(?iu)" + filler, ". "), r"\.\s*\.", ".")
        return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[-,.:;\s]+", ""))

    out = F.when(F.substring(F.lower(lang), 1, 2) == "de", cleaned(OPENER_DE, FILLER_DE)).otherwise(cleaned(OPENER_EN, FILLER_EN))
    return F.when(F.length(out) > 10, out).otherwise(whole)


def sentences(c: Column) -> Column:
    """Sentences of two words or more."""
    x = F.regexp_replace(c, r"<br\s*/?>", " ")
    for pattern, to in ((r"\n{2,}", ". "), (r"\n", " "), (r"\*\*[^*]+\*\*", ""), (r"\s{2,}", " ")):
        x = F.regexp_replace(x, pattern, to)
    x = F.trim(x)
    dot = "\u0001"
    x = F.regexp_replace(x, ABBREVIATIONS, f"$1{dot}")
    for inner in ("z.B", "d.h", "u.a"):  # the dots inside too
        x = F.replace(x, F.lit(inner + dot), F.lit(inner.replace(".", dot) + dot))
    parts = F.transform(F.split(x, BOUNDARY), lambda s: F.trim(F.replace(s, F.lit(dot), F.lit("."))))
    return F.filter(parts, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 2)


def is_pure_greeting(c: Column) -> Column:
    return (word_count(c) <= 18) & F.trim(c).rlike("(?iu)" + PURE_GREETING)


#: Letters whose capital is written with several characters, and their own capital as one: ß has ẞ, others a title case or none.
_SEVERAL = [chr(i) for i in range(0x110000) if len(chr(i).upper()) > 1]
_AS_ONE = ["ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL]


def capital(letter: Column) -> Column:
    """The capital of a letter, as one character."""
    return F.when(letter.isin(_SEVERAL), F.translate(letter, "".join(_SEVERAL), "".join(_AS_ONE))).otherwise(F.upper(letter))


def strip_greeting(c: Column) -> Column:
    """Without a greeting at its start, re-capitalised; as it was if fewer than 4 words are left."""
    x = F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, "(?iu)" + GREETING_PREFIX, "")), r"^,+", ""))
    return F.when(word_count(x) < 4, c).otherwise(F.concat(capital(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x))))


def is_pleasantry(c: Column) -> Column:
    return F.coalesce(c.rlike("(?iu)" + PLEASANTRY), F.lit(False))


def has_action_cue(c: Column) -> Column:
    return F.coalesce(c.rlike("(?iu)" + ACTION_CUE), F.lit(False))


def first_tier(c: Column, tiers: dict[str, list[str]], otherwise: str = "low") -> Column:
    """The first tier of which some keyword occurs in the lower-cased text."""
    out, x = F.lit(otherwise), F.lower(c)
    for name, keywords in reversed(tiers.items()):
        out = F.when(x.rlike("|".join(keywords)), F.lit(name)).otherwise(out)
    return out


def urgency(c: Column) -> Column:
    return first_tier(c, URGENCY)


def severity(c: Column, compound: Column | None = None) -> Column:
    """Keyword tier; a very negative sentiment lifts low and medium to high."""
    tier = first_tier(c, SEVERITY)
    return tier if compound is None else F.when((compound <= -0.6) & tier.isin("low", "medium"), F.lit("high")).otherwise(tier)


def insert_after_first_line(prompt: Column, lines: Column) -> Column:
    at = F.instr(prompt, "\n")
    return F.when(at == 0, F.concat(prompt, F.lit("\n"), lines)).otherwise(
        F.concat(prompt.substr(F.lit(1), at), lines, prompt.substr(at + 1, F.length(prompt)))
    )


def language_line(lang: Column) -> Column:
    code = F.substring(F.lower(F.trim(F.when(F.length(lang) > 0, lang).otherwise("en"))), 1, 2)
    name = F.lit(OTHER_LANGUAGE)
    for k, v in LANGUAGES.items():
        name = F.when(code == k, v).otherwise(name)
    return F.concat(F.lit("Write the reply in "), name, F.lit(", the same language as the customer's message."))


def aspect(*columns: Column) -> Column:
    """First usable value; null if all are missing."""
    return F.coalesce(*(F.when(~F.lower(F.trim(c)).isin(MISSING_ASPECTS), F.trim(c)) for c in columns))


def checklist(problem: Column, cause: Column, action: Column, urgency_: Column, intent: Column, ticket_type: Column, named: Column) -> Column:
    """Numbered instructions from the aspects that are there; empty without any."""
    fill = lambda key, c: F.concat(*(F.lit(p) if i % 2 == 0 else c for i, p in enumerate(_around(CHECKLIST_ITEMS[key]))))
    low = F.lower(urgency_)
    tone = F.when(low.isin("high", "critical"), TONES[0]).otherwise(TONES[1])
    items = F.filter(
        F.array(fill("problem", problem), fill("cause", cause), fill("action", action), F.concat(fill("urgency", low), tone)), lambda x: x.isNotNull()
    )
    numbered = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    category = F.concat_ws(" / ", intent, ticket_type)
    tail = F.concat_ws(
        " ",
        F.when(F.length(category) > 0, F.concat(F.lit("Category: "), category, F.lit("."))),
        F.when(named.isNotNull(), F.concat(F.lit("Mention these products if relevant: "), named, F.lit("."))),
    )
    lines = F.concat_ws("\n", F.lit(CHECKLIST_HEAD), numbered, F.when(F.length(tail) > 0, tail))
    return F.when(F.size(items) == 0, F.lit("")).otherwise(lines)


def _around(template: str) -> list[str]:
    before, after = template.split("{}")
    return [before, "", after]


def support_prompt(context: Column, subject: Column, body: Column, lang: Column, todo: Column) -> Column:
    """Instruction, checklist, context, ticket and reply language."""
    listed = F.when(F.length(todo) > 0, F.concat(todo, F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit(PROMPT_HEAD), listed, F.lit("\nContext : "), context, F.lit("\nSubject : "), subject, F.lit("\nMessage : "), body, F.lit("\n"),
        language_line(lang), F.lit("\n" + PROMPT_END),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def snap_label(raw: Column, vocabulary: list[str], otherwise: str) -> Column:
    """The first label that holds the text or lies in it; a missing text is ``otherwise``."""
    x = F.lower(F.replace(F.coalesce(raw, F.lit("")), F.lit(" "), F.lit("_")))
    labels = F.array(*(F.lit(v) for v in vocabulary))
    hit = F.get(F.filter(labels, lambda v: F.contains(v, x) | F.contains(x, v)), F.lit(0))
    return F.when(x == "", F.lit(otherwise)).otherwise(F.coalesce(hit, F.lit(otherwise)))


def label_reply(raw: Column) -> Column:
    """Intent and ticket type of a model's reply: a field of the object, snapped to the vocabulary.

    A missing field is the default, not the first label.
    """
    of = lambda name, labels, otherwise: snap_label(json_field(raw, name), labels, otherwise).alias(name)
    return F.struct(of("intent", INTENTS, "general_inquiry"), of("ticket_type_nli", TICKET_TYPES, "product_support"))


def reply_fields(raw: Column) -> Column:
    """``response_pred, queue_pred, priority_pred`` of a model's reply: its JSON object, else what looks like the fields, else defaults."""
    whole = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    sound = F.from_json(whole, "response string, queue string, priority string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good = (whole != "") & sound["_bad"].isNull()
    like = lambda name: F.nullif(F.regexp_extract(raw, rf'"{name}"\s*:\s*"([^"]+)"', 1), F.lit(""))
    pick = lambda name, missing, broken: F.when(good, F.coalesce(sound[name], missing)).otherwise(F.coalesce(like(name), broken))
    return F.struct(
        pick("response", F.lit(""), F.substring(raw, 1, 200)).alias("response_pred"), pick("queue", F.lit("General Inquiry"), F.lit("General Inquiry")).alias("queue_pred"),
        F.lower(pick("priority", F.lit("medium"), F.lit("medium"))).alias("priority_pred"),
    )


def json_field(raw: Column, field: str) -> Column:
    """A string field of the object in a reply: fences, single quotes and trailing commas are mended, broken JSON is searched."""
    x = F.regexp_extract(F.regexp_replace(raw, r"```(?:json)?\s*", ""), r"(?s)\{.*\}", 0)
    x = F.replace(F.regexp_replace(x, r",\s*([}\]])", "$1"), F.lit("'"), F.lit('"'))
    found = F.regexp_extract(x, rf'"{field}"\s*:\s*"([^"]*)"', 1)
    return F.coalesce(F.get_json_object(x, f"$.{field}"), F.when(found != "", F.trim(found)))
