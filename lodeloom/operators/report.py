"""Evaluation of retrieval and of whole systems: metrics for each row, paired intervals, report parts.

Systems stand in long form (``system, idx, language, ...``); an evaluation
sample has some hundreds to millions of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lodeloom.functions import text as T
from lodeloom.functions.vectors import cosine
from lodeloom.session import keep

from . import metrics as M
from .resamples import Resamples
from .retrieval import intent_share
from .sampling import by_id_text, dense_index
from .tables import require_unique

BASELINE = "s2_gemma3"
PAIRS = [("s2_gemma3", "s6_gemma3_noaspect"), ("s4_raft_aspect", "s5_raft_noaspect")]
METRICS = ["rouge1", "rouge2", "rougeL", "bertscore_f1", "lang_match", "acs", "aas"]


# --- retrieval -------------------------------------------------------------------------


def evaluate_hits(asked: DataFrame, hits: DataFrame, scorers: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """A row for each query: language, ``n_hits, intent_at_k, top1_ce`` and each scorer of the first response and the answer (0 without hits).

    ``asked(query_id, language, answer, intent, queue)``, ``hits`` as of ``retrieve``.
    """
    code = F.substring(F.lower(F.coalesce("language", F.lit("en"))), 1, 2)
    rows = asked.select("query_id", code.alias("language"), "answer", "intent", "queue")
    asked_by = rows.select("query_id", F.col("intent").alias("q_intent"), F.col("queue").alias("q_queue"))
    both = hits.select(
        "query_id", "rank", F.when(F.col("rank") == 1, F.struct("response", F.col("ce_score").alias("top1_ce"))).alias("first"),
        F.try_element_at("aspects", F.lit("intent")).alias("d_intent"), F.try_element_at("aspects", F.lit("queue")).alias("d_queue"),
    ).join(asked_by, "query_id")
    # Hits are grouped once, as they may be a whole search.
    found = both.groupBy("query_id").agg(F.count("*").alias("n_hits"), intent_share().alias("intent_at_k"), F.max("first").alias("first"))
    out = rows.join(found.select("query_id", "n_hits", "intent_at_k", "first.*"), "query_id", "left")
    scored = [F.when(F.col("n_hits").isNull(), F.lit(0.0)).otherwise(f(F.coalesce("response", F.lit("")), F.coalesce("answer", F.lit("")))).alias(n) for n, f in scorers.items()]
    return out.select("query_id", "language", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "intent_at_k", "top1_ce", *scored)


# --- intervals -------------------------------------------------------------------------


def _in_splits(rows: DataFrame) -> DataFrame:
    """Every row in the split ``all`` and in that of its language, if it has one."""
    own = F.filter(F.array(F.lit("all"), F.when(F.trim("language") != "", F.col("language"))), lambda x: x.isNotNull())
    return rows.withColumn("split", F.explode(own))


def _long(rows: DataFrame, metrics: list[str]) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics)))
    kept = [c for c in rows.columns if c not in metrics]
    return rows.select(*kept, cells.alias("_x")).select(*kept, "_x.metric", "_x.v")


def summarise(per_row: DataFrame, key: str, metrics: list[str], label: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """``config, split, metric, n, mean, ci_low, ci_high`` over all rows and each language.

    Null and NaN values are left out; a metric without values has n 0 and nulls,
    one with a single value an interval of that value.
    """
    kept = keep(per_row.select(key, "language", *metrics), "per-row")  # the rows may be a whole evaluation
    long, on = _in_splits(_long(kept, metrics)), ["split", "metric"]
    known = long.filter(F.col("v").isNotNull() & ~F.isnan("v")).select(*on, key, "v")
    if isinstance(kept.schema[key].dataType, NumericType):
        placed = dense_index(known, key, "pos", on)
    else:
        placed = known.withColumn("pos", F.row_number().over(Window.partitionBy(*on).orderBy(key)).cast("long") - 1)
    sizes = known.groupBy(*on).agg(F.count("*").alias("n"))  # a row for each metric and language
    stored = Resamples(placed.join(F.broadcast(sizes), on).select(*on, "n", "pos", "v"), on, ["v"])
    spread = stored.means(resamples, seed).groupBy(*on).agg(F.round(F.percentile("v", 0.025), 4).alias("ci_low"), F.round(F.percentile("v", 0.975), 4).alias("ci_high"))
    whole = stored.totals().select(*on, "n", F.round(F.col("v") / F.col("n"), 4).alias("mean"))
    out = long.select(*on).distinct().join(whole, on, "left").join(spread, on, "left")
    return out.select(F.lit(label).alias("config"), *on, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean", "ci_low", "ci_high")


def bootstrap_table(per_row: DataFrame, metrics: list[str], baseline: str = BASELINE, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """``system, split, metric, n, mean, ci_low, ci_high, vs_baseline, diff, diff_ci_low, diff_ci_high, significant``.

    ``per_row(system, idx, language, metrics)``. Rows whose baseline value is
    known count, in the order of idx (by length, then as text). A system's
    missing value is its own mean; one without any value, and a base of fewer
    than two rows, give no row. The same draws serve every system, so a
    difference is paired; it is significant where its interval misses 0.
    """
    long = _in_splits(_long(per_row.select("system", F.col("idx").cast("string").alias("idx"), "language", *metrics), metrics))
    long = long.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    base = long.filter((F.col("system") == baseline) & F.col("v").isNotNull()).select("split", "metric", "idx", F.col("v").alias("base"))
    on = ["split", "metric", "idx"]
    systems = long.select("system").distinct()
    asked = base.join(F.broadcast(systems))  # a row for each system
    paired = asked.join(long.select("system", *on, "v"), ["system", *on], "left")
    key = ["system", "split", "metric"]
    own = paired.groupBy(*key).agg(F.avg("v").alias("own"), F.count("*").alias("n")).filter("own is not null and n >= 2")
    filled = paired.join(F.broadcast(own), key).withColumn("v", F.coalesce("v", "own"))  # a row for each system, split and metric
    placed = by_id_text(filled.select(*key, "n", "idx", F.col("v").alias("m"), (F.col("v") - F.col("base")).alias("d")), "idx", "pos", key)
    stored = Resamples(placed.select(*key, "n", (F.col("pos") - 1).alias("pos"), "m", "d"), key, ["m", "d"])
    at = lambda c, q: F.round(F.percentile(c, q), 4)
    spread = stored.means(resamples, seed).groupBy(*key).agg(
        at("m", 0.025).alias("ci_low"), at("m", 0.975).alias("ci_high"), F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi")
    )
    total = lambda c: F.round(F.col(c) / F.col("n"), 4)
    out = stored.totals().select(*key, "n", total("m").alias("mean"), total("d").alias("diff")).join(spread, key)
    other = lambda c: F.when(F.col("system") != baseline, c)
    return out.select(
        "system", "split", "metric", "n", "mean", "ci_low", "ci_high", other(F.lit(baseline)).alias("vs_baseline"), other(F.col("diff")).alias("diff"),
        other(F.round("lo", 4)).alias("diff_ci_low"), other(F.round("hi", 4)).alias("diff_ci_high"), other((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"),
    )


def aspect_contribution(table: DataFrame, pairs: list[tuple[str, str]] = PAIRS, metrics: tuple[str, ...] = ("rougeL", "bertscore_f1", "acs")) -> DataFrame:
    """``with_aspects, without, metric, diff, significant``: what aspects add over all rows.

    The paired difference where one system is the other's baseline, else the
    difference of the means (significant null).
    """
    some = table.filter((F.col("split") == "all") & F.col("metric").isin(*metrics))
    cells = F.array(*(F.struct(F.lit(one).alias("with_aspects"), F.lit(other).alias("without")) for one, other in pairs))
    both = some.withColumn("_x", F.explode(cells)).select("*", "_x.with_aspects", "_x.without")  # the table is read once: it may be a whole bootstrap
    met = both.groupBy("with_aspects", "without", "metric").agg(
        F.max(F.when(F.col("system") == F.col("with_aspects"), F.struct("mean", "vs_baseline", "diff", "significant"))).alias("a"),
        F.max(F.when(F.col("system") == F.col("without"), F.col("mean"))).alias("b"),
    )
    paired = F.col("a.vs_baseline").eqNullSafe(F.col("without"))
    return met.filter(F.col("a").isNotNull() & (paired | F.col("b").isNotNull())).select(
        "with_aspects", "without", "metric",
        F.round(F.when(paired, F.col("a.diff")).otherwise(F.col("a.mean") - F.col("b")), 4).alias("diff"), F.when(paired, F.col("a.significant")).alias("significant"),
    )


# --- systems ---------------------------------------------------------------------------


def load_systems(frames: dict[str, DataFrame]) -> DataFrame:
    """One long table of systems' outputs, each with its name in ``system`` and its reply in ``reply``.

    A repeated idx in a system, and rows that not every system has, raise.
    """
    out = None
    for name, df in frames.items():
        named = df.withColumn("idx", F.trim(F.col("idx").cast("string")))
        require_unique(named, "idx")
        part = named.withColumn("system", F.lit(name)).withColumn("reply", F.coalesce(F.col(reply_column(df.columns, name)).cast("string"), F.lit("")))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    lacking = out.groupBy("idx").agg(F.countDistinct("system").alias("n")).filter(F.col("n") < len(frames)).limit(5).collect()
    if lacking:
        raise ValueError(f"rows that not every system has: {sorted(r['idx'] for r in lacking)}")
    return out


def reply_column(columns: list[str], label: str) -> str:
    """The column of a system's replies: by its label, else ``generated_answer``, else the first that ends in _response."""
    for c in (f"{label}_response", "generated_answer", *(c for c in columns if c.endswith("_response"))):
        if c in columns:
            return c
    raise ValueError(f"{label} has no column of replies among {columns}")


def with_label(df: DataFrame, label: str) -> DataFrame:
    """``prompt, response, length`` under names that begin with the label."""
    return df.withColumnsRenamed({c: f"{label}_{c}" for c in ("prompt", "response", "length") if c in df.columns})


def per_row_metrics(systems: DataFrame, detect: Callable[[Column], Column], embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """``system, idx, language, rouge1, rouge2, rougeL, lang_match, acs, aas, route, top_ce_score`` for each row of ``systems(system, idx, language, reply, answer)``.

    With an embedder, acs and aas are how well the best sentence of a reply
    covers each of its problem and cause, and its action; null without any.
    """
    keyed = systems.withColumn("_key", F.concat_ws("\u001f", "system", F.col("idx").cast("string")))
    code = F.substring(F.lower(F.coalesce("language", F.lit(""))), 1, 2)
    optional = {c: F.col(c) if c in systems.columns else F.lit("") for c in ("route", "top_ce_score")}
    match = F.when((F.trim("reply") == "") | (code == ""), 0.0).otherwise((detect(F.col("reply")) == code).cast("double"))
    out = keyed.select("_key", "system", "idx", code.alias("language"), F.coalesce(match, F.lit(0.0)).alias("lang_match"), *(c.cast("string").alias(n) for n, c in optional.items()))
    for n in (1, 2):
        out = out.join(M.rouge_n(keyed, "_key", "reply", "answer", n).withColumnRenamed("rouge", f"rouge{n}"), "_key")
    out = out.join(M.rouge_l(keyed, "_key", "reply", "answer").withColumnRenamed("rouge", "rougeL"), "_key")
    for name, fields in (("acs", ["prob_sub", "cause"]), ("aas", ["action_taken"])):
        if embed is None or not all(f in systems.columns for f in fields):
            out = out.withColumn(name, F.lit(None).cast("double"))
        else:
            out = out.join(aspect_coverage(keyed, "_key", "reply", fields, embed).withColumnRenamed("coverage", name), "_key", "left")
    return out.select("system", "idx", "language", "rouge1", "rouge2", "rougeL", "lang_match", "acs", "aas", "route", "top_ce_score")


def aspect_coverage(df: DataFrame, key: str, reply: str, fields: list[str], embed: Callable[[Column], Column]) -> DataFrame:
    """``key, coverage``: for every row, the mean over its aspects of the best cosine with a sentence of the reply; null without aspects or sentences."""
    known = F.filter(F.array(*(F.trim(F.coalesce(f, F.lit(""))) for f in fields)), lambda x: ~F.lower(x).isin("", "none", "nan"))
    split = T.sentences(F.coalesce(F.col(reply), F.lit("")))
    said = F.when(F.size(split) > 0, split).when(F.trim(reply) != "", F.array(F.trim(reply))).otherwise(F.array().cast("array<string>"))
    wanted = df.select(key, F.posexplode(known).alias("aspect", "t")).select(key, "aspect", embed(F.col("t")).alias("vector"))
    heard = df.select(key, F.explode(said).alias("t")).select(key, embed(F.col("t")).alias("other"))
    best = wanted.join(heard, key).groupBy(key, "aspect").agg(F.max(cosine(F.col("vector"), F.col("other"))).alias("best"))
    return df.select(key).join(best.groupBy(key).agg(F.round(F.avg("best"), 4).alias("coverage")), key, "left")


def route_shares(systems: DataFrame) -> DataFrame:
    """``system, route, share`` of the rows that were routed, 4 places."""
    routed = systems.filter(F.trim(F.coalesce("route", F.lit(""))) != "")
    counts = routed.groupBy("system", "route").agg(F.count("*").alias("n"))  # a few rows for each system
    return counts.select("system", "route", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("system")), 4).alias("share"))


def reply_lengths(systems: DataFrame) -> DataFrame:
    """``system, language, mean_words, percent``: mean words of replies, and that in percent of the answers' mean."""
    words, gold = T.word_count(F.col("reply")), T.word_count(F.col("answer"))
    out = systems.groupBy("system", F.substring(F.lower("language"), 1, 2).alias("language")).agg(F.avg(words).alias("w"), F.avg(gold).alias("g"))
    return out.select("system", "language", F.round("w", 4).alias("mean_words"), F.round(100 * F.col("w") / F.when(F.col("g") > 0, F.col("g")), 4).alias("percent"))


def first_examples(df: DataFrame, key: str, group: str, counts: dict[str, int]) -> DataFrame:
    """The first rows by key of each group, as many as ``counts`` says; other groups give none. Only that many rows of a group leave a task."""
    parts = None
    for name, n in counts.items():
        part = df.filter(F.col(group) == name).orderBy(key).limit(n)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def several_rows(df: DataFrame, group: str, least: int = 2) -> DataFrame:
    """Rows of groups with at least so many rows."""
    return df.join(df.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(group), group, "left_semi")


def trainer_log(lines: DataFrame, keep: int = 60) -> DataFrame:
    """``place, line``: the last of ``lines(place, line)`` that tell a loss or begin with [RAFT], without progress bars."""
    text = F.trim("line")
    told = lines.select("place", text.alias("line")).filter((F.contains("line", F.lit("loss")) | F.startswith("line", F.lit("[RAFT]"))) & ~F.col("line").rlike(r"\d+/\d+ \[[^\]]*(it/s|s/it)"))
    return told.orderBy(F.desc("place")).limit(keep)


# --- report ----------------------------------------------------------------------------


def interval(mean: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.4f [%.4f, %.4f]", mean, low, high)


def takeaways(table: DataFrame) -> DataFrame:
    """``line``: a sentence for each significant paired difference over all rows; one that says so if there is none."""
    direction = F.when(F.col("diff") > 0, "above").otherwise("below")
    text = F.concat(
        F.lit("- **"), "system", F.lit("** is "), F.format_string("%.4f", F.abs("diff")), F.lit(" "), direction, F.lit(" "), "vs_baseline", F.lit(" on "), "metric",
        F.format_string(" (95%% CI [%.4f, %.4f], n=%d) — significant.", F.col("diff_ci_low"), F.col("diff_ci_high"), F.col("n")),
    )
    found = table.filter("split = 'all' and significant").select(text.alias("line"))
    none = table.agg(F.count_if((F.col("split") == "all") & F.col("significant")).alias("n"), F.countDistinct("system").alias("systems")).filter("n = 0")
    alone = "- Only one system in this report, so there is no paired difference to test."
    nothing = "- No paired difference is significant at this sample size: every CI includes 0."
    return found.unionByName(none.select(F.when(F.col("systems") < 2, alone).otherwise(nothing).alias("line")))


def chart(table: DataFrame, metrics: tuple[str, ...] = ("rougeL", "bertscore_f1", "lang_match"), splits: tuple[str, ...] = ("en", "de")) -> str:
    """An SVG of grouped bars with their intervals, one group for each split; empty without rows.

    The table has a row for each system, split and metric and comes to the driver.
    """
    rows = {(r["metric"], r["split"], r["system"]): r for r in table.select("metric", "split", "system", "mean", "ci_low", "ci_high").collect()}
    systems = sorted({k[2] for k in rows})
    metrics = [m for m in metrics if any(k[0] == m for k in rows)]
    splits = [s for s in splits if any(k[1] == s for k in rows)] or ["all"]
    if not metrics or not systems:
        return ""
    bar, height, wide = 18, 160, max(60, len(splits) * (len(systems) + 1) * 18)
    out = []
    for c, metric in enumerate(metrics):
        left = 30 + c * (wide + 40)
        own = [rows[(metric, s, n)] for s in splits for n in systems if (metric, s, n) in rows]
        top = max([max(r["mean"], r["ci_high"] or 0) for r in own] + [1e-9])
        y = lambda v: 20 + height * (1 - max(0.0, v) / top)  # noqa: E731, B023
        out.append(f'<text x="{left}" y="14">{metric}</text><line x1="{left}" y1="{20 + height}" x2="{left + wide}" y2="{20 + height}" stroke="black"/>')
        for i, split in enumerate(splits):
            for j, system in enumerate(systems):
                r, x = rows.get((metric, split, system)), left + (i * (len(systems) + 1) + j) * bar
                if r:
                    shade = 90 - 60 * j // max(1, len(systems))
                    out.append(f'<rect x="{x}" y="{y(r["mean"]):.1f}" width="{bar - 4}" height="{20 + height - y(r["mean"]):.1f}" fill="hsl(210 50% {shade}%)"><title>{system}</title></rect>')
                    if r["ci_low"] is not None and r["ci_high"] is not None:
                        out.append(f'<line x1="{x + bar // 2 - 2}" x2="{x + bar // 2 - 2}" y1="{y(r["ci_low"]):.1f}" y2="{y(r["ci_high"]):.1f}" stroke="black"/>')
            out.append(f'<text x="{left + i * (len(systems) + 1) * bar}" y="{36 + height}">{split.upper()}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{30 + len(metrics) * (wide + 40)}" height="{height + 50}" font-size="11">{"".join(out)}</svg>'


def evaluate_predictions(df: DataFrame, key: str, truth: str = "answer", predicted: str = "response_pred") -> DataFrame:
    """``metric, split, value`` of predicted replies and labels: ROUGE means and BLEU over all rows and each language with two rows or more, then both labels.

    ``df(key, language, queue, priority, queue_pred, priority_pred)`` with the replies.
    """
    named = df.withColumn("_lang", F.lower(F.substring(F.coalesce("language", F.lit("")), 1, 2)))
    languages = [r["_lang"] for r in named.groupBy("_lang").count().filter("count >= 2").orderBy("_lang").collect() if r["_lang"]]
    out = None
    for split in ["all", *languages]:
        rows = named if split == "all" else named.filter(F.col("_lang") == split)
        parts = [M.rouge_n(rows, key, predicted, truth, n).agg(F.lit(f"rouge{n}").alias("metric"), F.round(F.avg("rouge"), 4).alias("value")) for n in (1, 2)]
        parts.append(M.rouge_l(rows, key, predicted, truth).agg(F.lit("rougeL").alias("metric"), F.round(F.avg("rouge"), 4).alias("value")))
        bleu = M.corpus_bleu(M.bleu_counts(rows, key, predicted, truth))
        parts.append(bleu.unpivot([], ["bleu", "p1", "p4"], "metric", "value").withColumn("metric", F.when(F.col("metric") == "bleu", "bleu").otherwise(F.concat(F.lit("bleu_"), "metric"))))
        for part in parts:
            part = part.select("metric", F.lit(split).alias("split"), F.col("value").cast("double").alias("value"))
            out = part if out is None else out.unionByName(part)
    clean = lambda c: F.lower(F.trim(c)) if c.startswith("priority") else F.trim(c)
    for label in ("queue", "priority"):
        pairs = named.select(clean(label).alias("t"), clean(f"{label}_pred").alias("p"))
        scores = M.classification(pairs, "t", "p").select(*(F.col(c).cast("double").alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "correct", "total")))
        long = scores.unpivot([], scores.columns, "metric", "value")
        out = out.unionByName(long.select(F.concat(F.lit(f"{label}_"), "metric").alias("metric"), F.lit("all").alias("split"), "value"))
    return out


def markdown_table(rows: list, metrics: list[str], split: str) -> list[str]:
    """A row for each system, ``mean [low, high]`` for each metric; a dash where there is none."""
    own = {(r["system"], r["metric"]): r for r in rows if r["split"] == split}
    if not own:
        return ["_(no rows)_"]
    named = [m for m in metrics if any(k[1] == m for k in own)]
    out = ["| System | " + " | ".join(named) + " |", "|---" * (len(named) + 1) + "|"]
    for system in sorted({k[0] for k in own}):
        cells = [own.get((system, m)) for m in named]
        out.append(f"| {system} | " + " | ".join("—" if r is None else f"{r['mean']:.4f} [{r['ci_low']:.4f}, {r['ci_high']:.4f}]" for r in cells) + " |")
    return out


def results_markdown(table: DataFrame, systems: DataFrame | None = None, title: str = "Results", metrics: list[str] = METRICS) -> str:
    """The whole report: tables over all rows and by language, takeaways, what aspects add, aspect coverage, routes, examples.

    What comes to the driver has a row for each system, split and metric, and a few examples.
    """
    rows = table.collect()
    splits = sorted({r["split"] for r in rows} - {"all"})
    out = [f"# {title}", "", f"Systems: {', '.join(sorted({r['system'] for r in rows}))}", "", "## Overall", "", *markdown_table(rows, metrics, "all"), ""]
    for split in splits:
        out += [f"## {split.upper()}", "", *markdown_table(rows, metrics, split), ""]
    out += ["## Takeaways", "", *sorted(r["line"] for r in takeaways(table).collect()), ""]
    added = aspect_contribution(table).orderBy("with_aspects", "metric").collect()
    if added:
        verdict = {True: ", significant", False: ", not significant", None: ""}
        out += ["## Aspect contribution", "", *(f"- {r['with_aspects']} − {r['without']} on {r['metric']}: {r['diff']:+.4f}{verdict[r['significant']]}." for r in added), ""]
    out += ["## Aspect coverage", "", *markdown_table(rows, ["acs", "aas"], "all"), ""]
    if systems is not None:
        if "route" in systems.columns:
            shares = route_shares(systems).orderBy("system", "route").collect()
            out += ["## Routes", "", *(f"- `{r['system']}`: {r['route']} {r['share']:.0%}" for r in shares), ""]
        first = systems.agg(F.min("system")).first()[0]
        chosen = first_examples(systems.filter(F.col("system") == first).withColumn("_lang", F.lower(F.substring("language", 1, 2))), "idx", "_lang", {"en": 1, "de": 2})
        shown = systems.join(F.broadcast(chosen.select("idx")), "idx").orderBy("idx", "system").collect()  # three rows of each system
        out += ["## Examples", ""]
        for idx in dict.fromkeys(r["idx"] for r in shown):
            own = [r for r in shown if r["idx"] == idx]
            out += [f"#### Ticket `{idx}` ({own[0]['language']})", f"**Gold answer:** {own[0]['answer']}", "", *(x for r in own for x in (f"**{r['system']}:** {r['reply']}", ""))]
    return "\n".join(out)


def run_steps(steps: list[tuple[str, Callable[[], None]]], status: Callable[[dict], None], done: set[str] | None = None) -> list[str]:
    """Run named steps in order, each once: those done before are passed over; ``status`` is told what runs, has ended or failed.

    The first failure is told and raised.
    """
    ended = list(done or ())
    for name, work in steps:
        if name in ended:
            continue
        status({"step": name, "state": "running", "done": ended})
        try:
            work()
        except Exception as e:
            status({"step": name, "state": "failed", "done": ended, "error": str(e)})
            raise
        ended.append(name)
        status({"step": name, "state": "done", "done": ended})
    return ended
