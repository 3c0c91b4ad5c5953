"""Small tests of the training-data operators against brute force."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeloom.llm import decontaminate, html, html_costs, language, minhash, packing, quality, rules, suffixes, tokenstore, warc
from lodeloom.llm import words as w
from lodeloom.llm.components import components
from lodeloom.llm.store import CLEANUP, Scratch
from lodeloom.llm.tokens import Encoder, vocabulary

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "word", "two words", "ünï çødé ✓ 𝔘 text", "a  b\t\tc \x0b d", "x" * 5000, "rep " * 400]


def split(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]


def prose(seed, n, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


def corpus():
    """Odd texts, exact and near copies, shared passages, repeated rows."""
    texts = list(ODD)
    base = prose(1, 120)
    texts += [base, base, base.upper()]
    r = random.Random(5)
    for k in range(12):
        ws = base.split()
        for _ in range(1 + k % 3):
            ws[r.randrange(len(ws))] = f"new{k}"
        texts.append(" ".join(ws))
    passage = prose(2, 70)
    texts += [f"{prose(10 + k, 40)} {passage} {prose(50 + k, 30)}" for k in range(6)]
    texts += [prose(100 + k, 60 + k) for k in range(10)]
    rows = [(i, t, ["en", "de"][i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).withColumn("score", F.lit("clash")).withColumn("node", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# words ------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té,.", max_size=20)), max_size=8), st.integers(1, 5))
def test_words_and_shingles(texts, k):
    data, at = w.raw(pa.array(texts, pa.string()))
    words = w.Words(data, at)
    assert words.counts.tolist() == [len(split(t)) for t in texts]
    got, got_at = w.shingles(words.h, words.at, k)
    names = {}
    for i, t in enumerate(texts):
        ws = split(t)
        expected = [tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)] or ([tuple(ws)] if ws else [])
        own = got[got_at[i] : got_at[i + 1]].tolist()
        assert len(own) == len(expected)
        for h, s in zip(own, expected, strict=True):
            assert names.setdefault(h, s) == s
    assert len(set(names.values())) == len(names)


# 1 ------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_min_cut_is_minimal(data):
    n = data.draw(st.integers(1, 6))
    terminals = data.draw(st.lists(st.integers(-9, 9), min_size=n, max_size=n))
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(0, 6)), max_size=9))
    edges = [e for e in edges if e[0] != e[1]]
    cost = lambda side: sum(-t if (t < 0 and s) else t if (t > 0 and not s) else 0 for t, s in zip(terminals, side, strict=True)) + sum(c for u, v, c in edges if side[u] != side[v])
    best = min(cost(s) for s in itertools.product([False, True], repeat=n))
    sides = [s for s in itertools.product([False, True], repeat=n) if cost(s) == best]
    largest = [any(s[u] for s in sides) for u in range(n)]  # of cuts of least cost the union of their source sides is one too
    assert html.min_cut(terminals, edges) == largest
    assert html._flow_cut(terminals, edges) == largest


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li></ul></nav><div class="cookie-notice">We use cookies to make this page better for all.</div>
<main><article><h1>Title &amp; more</h1><p>First  paragraph
with <b>bold</b> text, long enough to read.<br>Next line &copy; 2020.</p><div class="ad">Buy this very good thing now, it is cheap and good.</div>
<p>Second paragraph, with a <a href="x">link</a> inside it.</p></article><section id="comments"><p>Nice article, thank you for writing it, dear author.</p></section></main>
<aside class="sidebar"><p>Related stories that you might like to read later today.</p></aside><form><label>Name</label><input></form><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    expected = "Title & more First paragraph with bold text, long enough to read. Next line © 2020. Second paragraph, with a link inside it."
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extract_main_text(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, expected, len(expected)), (1, expected, len(expected)), (2, "", 0)]


def test_broken_markup_is_linear():
    assert html.main_text("<p>unclosed <b>bold text of a page. <div>more of it here.</div>") == "unclosed bold text of a page. more of it here."
    assert html.main_text("<div>" * 5000 + "<p>Deep text is still here.</p>") == "Deep text is still here."
    html.main_text('<p title="' * 20000 + "<!--")


def test_no_markup_is_left():
    long = "Many words of prose stand here and they go on. " * 8
    page = lambda x: html.main_text(f"<nav><a href='/'>Home</a></nav><article><h1>T</h1><p>{x}</p></article>")
    assert page('See <img alt="a < b" src=x> and <a title="<b>x</b>" href="/?q=">this</a>, a > b.') == "T See and this, a > b."
    assert page("a &lt; b, 1 < 2 <!-- <p>no</p> --><![CDATA[x &lt; y]]><? php > ?>end.") == "T a < b, 1 < 2 x &lt; y ?>end."
    assert page('Lost <a href="foo>quote</a> and <a href="bar">found</a>.') == "T Lost quote and found."
    assert html.main_text("plain a <b c") == "plain a <b c"
    assert html.main_text("<p>Cut off here. <a hre") == "Cut off here."
    assert html.main_text(f"<article><p>{long}</p><div class='legal'><p>{long}</p></div></article>") == f"{long}{long}".strip()
    assert html.main_text(f"<nav><a href='/'>Home</a></nav><div class='related-work'><p>{long}</p></div>") == long.strip()
    assert html.main_text(f"<article><p>{long}</p><div class='comments'><p>{long}</p></div></article>") == long.strip()


def test_marked_pages_that_taught_nothing():
    weights, wrong, total = html_costs.trained(), 0, 0
    for source, content in html_costs.marked_pages(150, 77):
        page = html.parse(source)
        side = html.min_cut(*html.graph(page, weights))
        wrong += sum(s != (b.text in content) for b, s in zip(page.blocks, side, strict=False))
        total += len(page.blocks)
    assert total > 2000 and wrong < 0.01 * total


@pytest.mark.parametrize(
    "source",
    ["<p>x</p>" + "<![CDATA[" * 20000, "".join(f'<div class="{["x", "ad"][i % 2]}">word{i} and more</div>' for i in range(20000)), "<p>t</p>" + "<svg>" * 20000,
     "<a " * 20000 + ">", '<a x="<a" ' * 20000 + ">", "".join(f"<p>w{i}</p>" if i % 3 else f"<a href=x>link{i}</a><p></p>" for i in range(20000))],
    ids=["cdata", "blocks", "raw", "tags", "quotes", "links"],
)
def test_hostile_pages_end(source):
    began = time.process_time()
    html.main_text(source)
    assert time.process_time() - began < 5


def test_pages_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, n_chars int")
    got = html.extract_main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 0


# 2 ------------------------------------------------------------------------------------


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = language.train([b"abc", b"xyz"], ["a", "b"], steps=1, units=3)
    for part in net.parts():
        part[...] = part.astype(np.float64)
    x = rng.integers(97, 103, (5, 4))
    real = np.ones((5, 4), np.float32)
    real[3:, 1] = 0
    x[3:, 1] = language.PAD
    y = np.array([0, 1, 1, 0])
    _, grads = language.loss_and_gradients(net, x, real, y)
    for part, grad in zip(net.parts(), grads, strict=True):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in part.shape) if part.shape[0] != 257 else (int(rng.integers(97, 103)), int(rng.integers(part.shape[1])))
            old, h = part[at], 1e-2
            part[at] = old + h
            up, _ = language.loss_and_gradients(net, x, real, y)
            part[at] = old - h
            down, _ = language.loss_and_gradients(net, x, real, y)
            part[at] = old
            assert abs((up - down) / (2 * h) - grad[at]) < 2e-3


def test_pooled_probabilities_are_those_of_the_network():
    rng = np.random.default_rng(4)
    net = language.train([b"abcabc", b"xyzxyz", b"uvw"], ["a", "b", "c"], steps=3, units=5)
    texts = [bytes(rng.integers(1, 256, n, dtype=np.uint8)) for n in (0, 1, 5, language.SEGMENT, language.SEGMENT + 1, 3 * language.SEGMENT, 1000, 2)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = language.pooled(net, np.frombuffer(b"".join(texts), np.uint8), offsets)
    for t, row in zip(texts, got, strict=True):
        total = np.zeros(3)
        for lo in range(0, len(t), language.SEGMENT):
            x = np.frombuffer(t[lo : lo + language.SEGMENT], np.uint8).astype(np.int64)[:, None]
            real = np.ones(x.shape, np.float32)
            ahead, _ = language._forward(net.ahead, x, real)
            back, _ = language._forward(net.back, x[::-1], real)
            total += language._softmax(np.concatenate([ahead, back[::-1]], axis=2) @ net.out + net.bias).sum(axis=(0, 1))
        assert np.allclose(row, total / max(len(t), 1), atol=2e-5)


def test_languages_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, score string")
    got = language.identify(spark, none)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == 0
    untaught = language.identify(spark, spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")).first()
    assert (untaught["lang_pred"], untaught["score"]) == ("und", 0.0)


def test_language_held_out(spark):
    r = random.Random(3)
    speak = {"aa": "the of and to in that ing er on ".split(), "bb": "der die und ein sch ung keit zu ".split()}
    rows = [(i, " ".join(r.choice(speak[k]) + r.choice(speak[k]) for _ in range(40)), k) for i in range(240) for k in [["aa", "bb"][i % 2]]]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (None, "the of and", None), (5, rows[5][1], rows[5][2])]
    got = language.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    truth = dict((i, k) for i, _, k in rows[:240])
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 30 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) / len(out) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1000, 1001)} == {("und", 0.0)}
    assert all(0 <= r["score"] <= 1 for r in got)


# 3 ------------------------------------------------------------------------------------


def base_rules(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = {i + k for i in range(len(ws) - 2) if tri[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, docs, empty):
    got = {r["doc_id"]: r for r in rules.host_rules(spark, docs).collect()}
    for i, text, *_ in corpus():
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_rules(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert rules.host_rules(spark, empty).count() == 0


def test_bad_host_takes_its_documents_down(spark):
    good = prose(1, 80)
    rows = [(i, "short", "bad") for i in range(60)] + [(100, good, "bad"), (101, good, None)] + [(200 + i, prose(i, 80), "good") for i in range(60)]
    got = {r["doc_id"]: r["kept"] for r in rules.host_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[100] and got[101] and all(got[200 + i] for i in range(60))


# 4 ------------------------------------------------------------------------------------


def test_the_index_finds_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(2)
    items = decontaminate.read_items([(k, prose(40 + k, 9, 10**6)) for k in range(5)], 5)
    group = decontaminate.Group(9, items)
    prints = []
    for _ in range(600):
        bits = np.unpackbits(group.prints[rng.integers(5)].view(np.uint8))
        bits[rng.choice(256, rng.integers(0, 80), replace=False)] ^= 1
        prints.append(np.packbits(bits).view(np.uint64))
    prints = np.array(prints)
    window, item, bits = group.near(prints)
    apart = np.bitwise_count(prints[:, None, :] ^ group.prints[None]).sum(axis=2)
    expected = {(i, k): int(d) for (i, k), d in np.ndenumerate(apart) if d <= decontaminate.RADIUS}
    assert dict(zip(zip(window.tolist(), item.tolist(), strict=True), bits.tolist(), strict=True)) == expected
    assert 100 < len(expected) < 600


def test_fingerprints_are_signs_of_sums():
    run = np.random.default_rng(3).integers(0, 2**63, 60, dtype=np.uint64)
    got = decontaminate.fingerprints(run, np.array([0, 7, 8, 41]), 19)
    for row, start in zip(got, [0, 7, 8, 41], strict=True):
        for k in range(4):
            bits = [[int(b) for b in np.unpackbits(np.array([x]).view(np.uint8))] for x in w.mix(run[start : start + 19] + np.uint64(2 * k + 1))]
            signs = [int(sum(1 if b else -1 for b in column) > 0) for column in zip(*bits, strict=True)]
            assert np.unpackbits(row[k : k + 1].view(np.uint8)).tolist() == signs


def weighted(a, b, k=5):
    grams = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) or Counter([tuple(x)])
    a, b = grams(a), grams(b)
    return sum((a & b).values()) / sum((a | b).values())


def test_decontamination_against_all_windows(spark, empty):
    clean = lambda t: [x for x in (re.sub(r"[!-/:-@\[-`{-~]", "", y) for y in (t or "").lower().split()) if x]
    items = [(k, prose(500 + k, 12 + 3 * k)) for k in range(12)] + [(90, None), (91, ""), (92, "only three words")]
    r = random.Random(1)
    rows = [(i, t) for i, t in enumerate(ODD)]
    for k, item in items[:12]:
        ws = item.split()
        rows.append((100 + k, f"{prose(900 + k, 50)} {item.upper()} {prose(950 + k, 20)}"))
        edge = list(ws)
        edge[0] = "changed"
        rows.append((200 + k, f"{prose(800 + k, r.randrange(40))} {' '.join(edge)} {prose(850 + k, 10)}"))
        half = ws[: len(ws) // 2]
        rows.append((300 + k, f"{prose(700 + k, 30)} {' '.join(half)} {prose(750 + k, 30)}"))
    rows += [(400, " ".join(items[8][1].split()[1:])), (401, "x only three words y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(spark, docs, bench).collect()}
    exact, near = set(), set()
    for i, t in rows:
        ws = clean(t)
        for k, item in items:
            iw = clean(item)
            if not iw or not ws:
                continue
            if len(ws) >= len(iw):
                s = max(weighted(iw, ws[p : p + len(iw)]) for p in range(len(ws) - len(iw) + 1))
            else:
                s = weighted(iw, ws) if 100 * len(ws) >= 75 * len(iw) else 0
            if s >= 0.8:
                (exact if s == 1 else near).add((i, k))
    assert got == exact | near
    left = decontaminate.drop_contaminated(spark, docs, bench)
    assert {x["doc_id"] for x in left.collect()} == {i for i, _ in rows} - {i for i, _ in got}
    assert decontaminate.contaminated(spark, empty, bench).count() == 0
    assert decontaminate.contaminated(spark, docs, bench.limit(0)).count() == 0


def test_decontamination_in_several_passes_and_with_clashing_names(spark, monkeypatch):
    items = [(k, prose(500 + k, 20 + k % 3)) for k in range(30)] + [(3, "another text of item three that has enough words to be found")]
    rows = [(k, f"{prose(900 + k, 30)} {t} {prose(300 + k, 9)}", "a", "b") for k, (_, t) in enumerate(items)] + [(99, None, "a", "b"), (None, items[0][1], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lower string, _LOWER string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontaminate.contaminated(spark, docs, bench).collect(), key=str)
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 7)
    assert sorted(decontaminate.contaminated(spark, docs, bench).collect(), key=str) == whole and len(whole) == 32
    left = decontaminate.drop_contaminated(spark, docs, bench)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(99, None, "a", "b")]
    assert decontaminate.drop_contaminated(spark, docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.drop_contaminated(spark, docs.limit(0), bench).count() == 0


def near_copies(n, before):
    """Items of n words, texts that hold one with as many changed words as 80 percent allows, and which is where."""
    items, rows, where = [(k, prose(6000 * n + k, n, 10**6)) for k in range(60)], [], set()
    for k, item in items:
        for j in range(6):
            ws, (middle, end) = item.split(), divmod((n - 4) // 9, 5)
            for q in range(middle):
                ws[10 + (17 * q + j) % (n - 20)] = "new"  # in five shingles
            for q in range(end):
                ws[-1 - q] = f"end{q}"  # one more
            where.add((len(rows), k))
            rows.append((len(rows), f"{before(k, j)} {' '.join(ws)} {prose(99 * k + j, 30 + 7 * j + k, 10**6)}"))
    return items, rows, where


def found(spark, items, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = decontaminate.contaminated(spark, docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(80 <= 100 * x["similarity"] < 90 for x in got)
    return {(x["doc_id"], x["item_id"]) for x in got}


@pytest.mark.parametrize("n", [33, 150])
def test_items_at_the_start_of_longer_texts(spark, n):
    items, rows, where = near_copies(n, lambda k, j: "")
    assert found(spark, items, rows) == where


@pytest.mark.parametrize("n", [24, 50])
def test_near_copies_at_the_threshold_are_all_found(spark, n):
    items, rows, where = near_copies(n, lambda k, j: prose(77 * k + j, 11 * j + k + 1, 10**6))
    assert found(spark, items, rows) == where


# 5 ------------------------------------------------------------------------------------


def repeated_words(rows, least):
    count = Counter()
    where = {}
    for i, t in rows:
        ws = split(t)
        for p in range(len(ws) - least + 1):
            g = tuple(ws[p : p + least])
            count[g] += 1
            where.setdefault(g, []).append((i, p))
    out = {}
    for g, places in where.items():
        if count[g] > 1:
            for i, p in places:
                out.setdefault(i, set()).update(range(p, p + least))
    return out


@pytest.mark.parametrize(("least", "gram"), [(50, 8), (12, 4)])
def test_repeated_passages(spark, docs, empty, least, gram):
    rows = [(i, t) for i, t, *_ in corpus()]
    got = {}
    for r in suffixes.repeated_passages(spark, docs, least, gram).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    assert got == repeated_words(rows, least)
    assert suffixes.repeated_passages(spark, empty).count() == 0


def test_remove_repeats_keeps_one(spark, docs):
    left = suffixes.remove_repeats(spark, docs)
    assert left.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in left.collect()]
    before = {i: t for i, t, *_ in corpus()}
    kept = dict(rows)
    assert all(kept.get(i, "gone") == before[i] for i in (0, 1, 2, 3, 9, 30, 35))
    assert 10 not in kept
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.collect())


def windows_of(rows, least):
    """Each repeated window's words: all of them, and those of which an earlier occurrence exists."""
    where = {}
    for i, t in sorted(rows):
        ws = split(t)
        for p in range(len(ws) - least + 1):
            where.setdefault(tuple(ws[p : p + least]), []).append((i, p))
    often = [places for places in where.values() if len(places) > 1]
    words = lambda some: {(i, q) for i, p in some for q in range(p, p + least)}
    return words(x for places in often for x in places), words(x for places in often for x in places[1:])


def marked_words(spark, rows, least=suffixes.LEAST):
    got = suffixes.repeated_spans(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least).collect()
    words = lambda c: {(r["doc_id"], q) for r in got for s in r[c] for q in range(s["start"], s["stop"])}
    return words("spans"), words("later")


def test_one_of_many_copies_is_first(spark):
    rows = [(i, f"{prose(2000 + i, 30, 10**6)} {prose(3, 52)} {prose(3000 + i, 30, 10**6)}") for i in random.Random(8).sample(range(300), 300)]
    spans, later = marked_words(spark, rows)
    assert (spans, later) == windows_of(rows, 50)
    assert {i for i, _ in spans} - {i for i, _ in later} == {0}


def test_passages_that_end_in_a_frequent_line(spark):
    line = prose(4, 20)
    rows = [(i, f"{prose(4000 + i // 2 if i < 80 else 4000 + i, 30, 10**6)} {line} {prose(5000 + i, 30, 10**6)}") for i in range(400)]
    spans, later = marked_words(spark, rows)
    assert (spans, later) == windows_of(rows, 50)
    assert {i for i, _ in spans} == set(range(80))


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_mixed_passages_whatever_way_they_are_compared(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST", most)
    r = random.Random(11)
    chunks = [prose(9000 + k, r.randrange(3, 26), 10**6) for k in range(25)]
    rows = []
    for i in range(90):
        parts = [r.choice(chunks) if r.random() < 0.7 else prose(9100 + 50 * i + j, r.randrange(1, 9), 10**6) for j in range(r.randrange(1, 9))]
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, f"{rows[4][1]} {rows[4][1]}"), (-5, rows[6][1].upper())]
    spans, later = marked_words(spark, rows, 12)
    assert (spans, later) == windows_of(rows, 12) and len(later) > 500


def test_compared_suffixes_tell_the_later_of_equal_documents(spark):
    text = prose(9, 70, 10**6)
    rows = [(1, f"{text} {prose(10, 9)}"), (1, f"x {text}"), (1, f"{text} {prose(10, 9)}"), (None, text)]
    got = suffixes.repeated_spans(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((len(r["spans"]), len(r["later"])) for r in got) == [(1, 0), (1, 1)]


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    frame = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    table = Scratch(spark, "test").keep(frame, "counts")
    end = time.time() + 10  # executors delete files after the write's end
    while (new := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not new and spark.conf.get(CLEANUP, None) == setting
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, frame.collect())) and table.count() == 7


def test_only_the_spans_of_a_search_for_repeats_stay_on_disk(spark):
    made = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffixes, "Scratch", lambda *a: made.append(Scratch(*a)) or made[-1])
        rows = [(i, f"{prose(6000 + i, 30, 10**6)} {prose(5, 52)}") for i in range(9)]
        got = suffixes.repeated_spans(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert [p.name for p in Path(made[0].root).iterdir()] == ["spans"]
    assert sorted(len(r["later"]) for r in got.collect()) == [0] + [1] * 8


# 6 ------------------------------------------------------------------------------------


def test_quality(spark, empty):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        text = prose(i, 60 + r.randrange(200), 5000)
        rows.append((i, text if good else " ".join(x + r.choice(["%%%", "$$$", "###"]) for x in text.split())))
        labels.append((i, int(good)))
    rows += [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "null id"), rows[3]]
    labels += [(5000, 1), (None, 0), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash"))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.quality_scores(spark, docs, known).collect()
    assert len(got) == len(rows)
    truth = dict(labels[:300])
    out = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert len(out) > 60 and sum(x["predicted"] == truth[x["doc_id"]] for x in out) / len(out) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got if x["doc_id"] is not None)
    assert {x["score"] for x in quality.quality_scores(spark, docs, known.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(spark, empty, known).count() == 0
    assert quality.keep_good(spark, docs, known).columns == docs.columns


def test_quadratic_score_is_the_log_density_difference():
    rng = np.random.default_rng(1)
    d = len(quality.NAMES)
    x = {0: rng.normal(0, 1, (400, d)), 1: rng.normal(0.5, 2, (900, d))}
    model = quality.fit({k: (float(len(v)), np.concatenate([v.sum(axis=0), (v.T @ v).ravel()])) for k, v in x.items()})
    probe = rng.normal(0, 1, (5, d))
    log = []
    for k in (0, 1):
        cov = np.linalg.inv(model.factors[k]) @ np.linalg.inv(model.factors[k]).T
        z = probe - model.means[k]
        log.append(model.log_priors[k] - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("nd,de,ne->n", z, np.linalg.inv(cov), z))
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(log[0] - log[1])))


def plain_statistics(text):
    """The statistics of one text, counted one by one."""
    raw, size = text.encode(), max(len(text.encode()), 1)
    ws = [x for x in re.split(rb"[\x20\x09-\x0D]+", raw) if x]
    low = [x.lower() for x in ws]
    runs = [tuple(low[i : i + 3]) for i in range(len(low) - 2)] or ([tuple(low)] if low else [])
    lines = [x for x in raw.split(b"\n") if x]
    marked = [re.sub(rb"[\x20\x09-\x0D]", b"_", x) for x in lines]
    n, symbols = max(len(ws), 1), b"#*$%&<>=@^~_{}[]\\+"
    share = lambda chars: np.sqrt(sum(b in chars for b in raw) / size)
    return {
        "words": np.log1p(len(ws)), "word_length": np.log1p(sum(map(len, ws)) / n), "distinct_words": len(set(low)) / n * np.log1p(len(ws)),
        "repeated_lines": np.sqrt((len(lines) - len(set(marked))) / (len(lines) + 4)), "repeated_runs": np.sqrt((len(runs) - len(set(runs))) / (len(runs) + 40)),
        "line_words": np.log1p(len(ws) / max(len(lines), 1)), "end_symbols": np.sqrt(sum(x[-1] in symbols + b"|" for x in ws) / n), "upper": share(bytes(range(65, 91))),
        "digits": share(b"0123456789"), "symbols": share(symbols), "stops": share(b".,;:"), "other_marks": share(b"!?\"'()/-`"), "pipes": share(b"|"),
    }


def test_statistics_one_by_one():
    texts = [t or "" for t in ODD] + [t for _, t, *_ in corpus() if t] + ["A|B# c*\nA|B# c*\n\n  \nx y x y x y", "\n\n", "ß ß|\u00a0x", "9 9 9\n9 9 9"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for t, row in zip(texts, got, strict=True):
        expected = plain_statistics(t)
        assert np.allclose(row, [expected[n] for n in quality.NAMES], atol=1e-9), t[:40]


# 7 and 10 -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aé,.'!% \n\t 　Z9_", max_size=30))
def test_encoder_is_the_tokenizer(text):
    encode = test_encoder_is_the_tokenizer.__dict__.setdefault("e", Encoder(vocabulary()))
    assert np.frombuffer(encode.encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["ab", "Zé", " ", "\n", "\n", ".", "'s", "'", "(", "9", "\r", "\n\n", "x²", "µ", "ǅ", "مر"]), max_size=14))
def test_encoder_on_lines_of_words(parts):
    text = "a " + "".join(parts)
    encode = test_encoder_is_the_tokenizer.__dict__.setdefault("e", Encoder(vocabulary()))
    assert np.frombuffer(encode.encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("slots", "pool"), [(1 << 8, 100_000), (1 << 12, 30_000), (1 << 6, 50)])
def test_encoder_forgets_within_its_memory(monkeypatch, slots, pool):
    from lodeloom.llm import tokens

    monkeypatch.setattr(tokens, "SLOTS", slots)
    monkeypatch.setattr(tokens, "POOL", pool)
    own, r = Encoder(vocabulary()), random.Random(3)
    texts = [None, ""] + [
        " ".join("".join(r.choice("abcdé.1") for _ in range(r.randrange(1, 12))) for _ in range(60)) + (" " + "long" * 40) * (k % 3) for k in range(40)
    ]
    for some in (texts, texts[::-1], texts[5:9]):
        ids, counts = own.encode_rows(pa.array(some, pa.string()))
        expected = [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
        assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [x for own_ids in expected for x in own_ids]
        assert own.known < slots * tokens.FULL and own.used <= pool


@pytest.mark.parametrize("white", ["\u00a0", "\u3000", "\u2003", "\u0085", "\x1c", "\u1680", "\t", " ", "é", "\u2010"])
def test_encoder_beside_white_space(white):
    own = test_encoder_is_the_tokenizer.__dict__.setdefault("e", Encoder(vocabulary()))
    for text in (f"ab{white} cd", f"ab {white}cd", f"ab {white} cd", f"{white} ab", f"ab {white}", f" {white}", white):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, docs, empty, ids, capacity):
    got = packing.best_two_fit(spark, docs, capacity).toPandas()
    texts = {i: ids(t) for i, t, *_ in corpus()}
    for doc, own in got.groupby("doc_id"):
        own = own.sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(texts[doc])
        assert (own.length[1:] == capacity).all() and own.start.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()]
        assert own.ids_crc32.tolist() == [crc(texts[doc][a : a + n]) for a, n in zip(own.start, own.length, strict=True)]
    assert set(got.doc_id) == set(texts)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()] and own.length.sum() <= capacity
    assert packing.best_two_fit(spark, empty, capacity).count() == 0


def best_two_fit_one_by_one(lengths, capacity):
    """Sequences filled one after the other from a list of single pieces."""
    left, out = sorted(lengths), []
    while left:
        own, gap = [], capacity
        while fits := [n for n in left if n <= gap]:
            own.append(fits[-1])
            left.remove(fits[-1])
            gap -= fits[-1]
        while gap and len(own) > 1:
            room = gap + min(own)
            pairs = [(a + b, -a, b) for i, a in enumerate(left) for j, b in enumerate(left) if i != j and a + b <= room]
            if not pairs or max(pairs)[0] <= min(own):
                break
            total, a, b = max(pairs)
            smallest = min(own)
            own.remove(smallest)
            for n in (-a, b):
                left.remove(n)
                own.append(n)
            left = sorted([*left, smallest])
            gap = room - total
        out.append(tuple(sorted(own)))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_patterns_are_those_of_packing_one_by_one(lengths):
    got = [tuple(sorted(n for n, k in p.items() for _ in range(k))) for p, times in packing.fill(np.bincount(lengths, minlength=41), 40) for _ in range(times)]
    assert sorted(got) == best_two_fit_one_by_one(lengths, 40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
def test_patterns_use_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65)
    patterns = packing.fill(counts, 64)
    used = Counter()
    for pattern, times in patterns:
        assert sum(n * k for n, k in pattern.items()) <= 64 and times > 0
        for n, k in pattern.items():
            used[n] += k * times
    assert used == Counter(lengths)
    assert sum(t for _, t in patterns) <= 1.25 * -(-sum(lengths) // 64) + max(sum(x > 32 for x in lengths), 1)


def test_two_fit_swaps_the_smallest():
    # Greedy 60 + 30 leaves 10 of 100; 30 is swapped for 22 + 18, which leave none.
    patterns = packing.fill(np.bincount([60, 30, 22, 18], minlength=101), 100)
    assert ({60: 1, 22: 1, 18: 1}, 1) in patterns


def test_token_store(spark, docs, empty, ids, tmp_path):
    got = sorted(tokenstore.store_tokens(spark, docs).collect())
    before = 0
    for r, (i, t, *_) in zip(got, corpus(), strict=True):
        own = ids(t)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, before, len(own), crc(own))
        before += len(own)
    root = str(tmp_path / "store")
    tokenstore.write_store(spark, docs, root)
    assert {r["doc_id"]: list(r["ids"]) for r in tokenstore.read_ids(spark, root).collect()} == {i: ids(t) for i, t, *_ in corpus()}
    chunks = spark.read.parquet(f"{root}/raw/kind=chunk")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert tokenstore.store_tokens(spark, empty).count() == 0


def test_damaged_store_raises(spark, docs, tmp_path):
    root = str(tmp_path / "store")
    tokenstore.write_store(spark, docs, root)
    chunks = spark.read.parquet(f"{root}/raw/kind=chunk").collect()
    first, *rest = [(bytes(r["key"]), bytes(r["content"])) for r in chunks]
    spark.createDataFrame([(first[0], first[1][:-2] + b"\1\1"), *rest], "key binary, content binary").write.mode("overwrite").parquet(f"{root}/raw/kind=chunk")
    with pytest.raises(Exception, match="digest"):
        tokenstore.read_digests(spark, root).collect()
    spark.createDataFrame(rest, "key binary, content binary").write.mode("overwrite").parquet(f"{root}/raw/kind=chunk")
    with pytest.raises(Exception, match="not all there"):
        tokenstore.read_digests(spark, root).collect()


@pytest.mark.parametrize("harm", ["lost", "twice", "swapped", "renamed", "shortened", "file"])
def test_altered_recipes_raise(spark, docs, tmp_path, harm):
    root = str(tmp_path / "store")
    tokenstore.write_store(spark, docs, root)
    recipes = spark.read.parquet(f"{root}/recipes")
    rows = sorted((r.asDict() for r in recipes.collect()), key=lambda r: (r["part"], r["local_start"]))
    one, other = rows[12], rows[14]
    if harm == "lost":
        rows.remove(one)
    elif harm == "twice":
        rows.append(dict(one))
    elif harm == "swapped":
        for k in ("n_tokens", "n_chunks", "root", "digests", "ends"):
            one[k], other[k] = other[k], one[k]
    elif harm == "renamed":
        one["doc_id"] = 10**6
    elif harm == "shortened":
        one["ends"] = [x - 1 for x in one["ends"]]
    else:
        rows = [r for r in rows if r["part"] != rows[-1]["part"]]
    spark.createDataFrame(rows, recipes.schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/altered")
    spark.read.parquet(f"{root}/altered").write.mode("overwrite").parquet(f"{root}/recipes")
    for read in (tokenstore.read_digests, tokenstore.read_ids):
        with pytest.raises(Exception, match="recipe|manifest"):
            read(spark, root).collect()


def test_altered_manifest_raises(spark, docs, tmp_path):
    root = str(tmp_path / "store")
    tokenstore.write_store(spark, docs, root)
    rows = [tuple(r) for r in spark.read.schema(tokenstore.MANIFEST).parquet(f"{root}/manifest").collect()]
    spark.createDataFrame(rows[1:], tokenstore.MANIFEST).write.mode("overwrite").parquet(f"{root}/manifest")
    with pytest.raises(ValueError, match="head"):
        tokenstore.read_digests(spark, root)


def test_wide_ids_are_read_as_written(spark, docs, ids, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    monkeypatch.setattr(tokenstore, "NARROW", 10)
    tokenstore.write_store(spark, docs, root)
    assert {r["doc_id"]: list(r["ids"]) for r in tokenstore.read_ids(spark, root).collect()} == {i: ids(t) for i, t, *_ in corpus()}


@given(st.integers(0, 70))
def test_tree_is_the_merkle_root(n):
    leaves, tree = [bytes([k]) for k in range(n)], tokenstore.Tree()
    for leaf in leaves:
        tree.add(leaf)
    assert tree.root() == tokenstore.merkle(leaves)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=50), min_size=1, max_size=6))
def test_crc_of_parts(parts):
    after = [sum(map(len, parts[i + 1 :])) for i in range(len(parts))]
    terms = tokenstore.crc_before(np.array([zlib.crc32(p) for p in parts]), np.array(after))
    assert np.bitwise_xor.reduce(terms) == zlib.crc32(b"".join(parts))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30000), st.lists(st.integers(1, 30000), max_size=40))
def test_chunk_ends(n, proposed):
    ends = tokenstore.cuts(sorted(x for x in set(proposed) if x <= n), n)
    sizes = np.diff([0, *ends])
    assert ends[-1] == n and (sizes <= tokenstore.MOST).all() and (sizes > 0).all()


# 8 ------------------------------------------------------------------------------------


def test_archive_round_trip(spark):
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(["<p>a</p>", "<p>b\r\n\r\nWARC/1.1\r\n</p>", "<p>a</p>", None, "", "ünï\n\n1 2 3"])]
    rows += [(77, None, "<p>a</p>"), (78, "http://with space/\n", "x" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    got = {r["page_id"]: r for r in warc.archive_pages(spark, pages).collect()}
    best = {}
    for i, _, t in rows:
        best[t or ""] = max(best.get(t or "", -1), i)
    for i, _, t in rows:
        raw = (t or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if best[t or ""] == i else ("revisit", best[t or ""]))
    small = {r["page_id"]: r["record_type"] for r in warc.archive_pages(spark, pages, min_bytes=5).collect()}
    assert small[3] == small[4] == "response" and small[0] == "revisit"
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_records_of_equal_pages_and_no_ids(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (None, "u", "same"), (None, "v", "other")], "page_id long, url string, html string")
    got = warc.archive_pages(spark, pages).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == Counter(
        [(1, "response", None), (1, "revisit", 1), (None, "revisit", 1), (None, "response", None)]
    )


def test_foreign_archives_keep_their_bytes(spark, tmp_path):
    body = "Größe".encode("latin-1") + bytes(range(256))
    fields = b"1 0 org\nURL IP-address Archive-date Content-type Archive-length\n"
    blocks = [("filedesc://f.arc", fields), ("http://h/a", b"HTTP/1.1 200 OK\r\n\r\n" + body), ("http://h/b", b"HTTP/1.0 404 No\r\nX: y\r\n\r\n" + body), ("dns:h", b"1.2.3.4")]
    raw = b"".join(f"{u} 1.2.3.4 2001 text/html {len(b)}\n".encode() + b + b"\n" for u, b in blocks)
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0.arc").write_bytes(raw)
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), Scratch(spark, "foreign"))
    got = {r["url"]: r for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    kinds = {u: got[u]["record_type"] for u, _ in blocks[1:]}
    assert kinds["dns:h"] == "resource" and sorted([kinds["http://h/a"], kinds["http://h/b"]]) == ["response", "revisit"]
    assert [bytes(r["payload"]) for r in got.values() if r["record_type"] == "response"] == [body]
    assert {r["payload_digest"] for u, r in got.items() if u != "dns:h"} == {warc.sha1_32(body)} and got["dns:h"]["date"] == "2001-01-01T00:00:00Z"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    fields = f"{version} 0 org\n{' '.join(warc.ARC_FIELDS[version])}\n".encode()
    line = lambda url, block: warc.arc_line(version, url, "1.2.3.4", "20010203040506", "text/html", block, 0, "f.arc").encode() + b"\n" + block + b"\n"
    raw = line("filedesc://f.arc", fields) + line("http://a b/", b"HTTP/1.1 200 OK\r\n\r\nhello\n\nx") + line("dns:h", b"1.2.3.4")
    got = list(warc.parse_arc(gzip.compress(raw)))
    assert [(r["URL"], r["block"], r["version"]) for r in got[1:]] == [("http://a b/", b"HTTP/1.1 200 OK\r\n\r\nhello\n\nx", version), ("dns:h", b"1.2.3.4", version)]
    assert warc.iso_date(got[1]["Archive-date"]) == "2001-02-03T04:05:06Z"
    with pytest.raises(ValueError, match="within a record"):
        list(warc.parse_arc(raw[:-4]))


# 9 ------------------------------------------------------------------------------------


def true_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        ws = split(t)
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_minhash(spark, docs, empty):
    got = {r["doc_id"]: r for r in minhash.minhash_dedup(spark, docs, 4).collect()}
    expected = true_components([(i, t) for i, t, *_ in corpus()], 4)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == expected
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert minhash.minhash_dedup(spark, empty).count() == 0
    kept = minhash.keep_one_of_each(spark, docs, 4)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in expected.items() if i == c}


def test_chain_of_near_copies_and_null_ids(spark):
    """Links only between neighbours: the bucket's centre does not reach all members."""
    base = prose(77, 100, 5000).split()
    rows = []
    for k in range(40):
        for p in range(3 * k, 3 * k + 3):
            base[p % 100] = f"v{p}"
        rows.append((k * 3 % 40, " ".join(base)))
    rows += [(None, rows[0][1]), (50, rows[0][1]), (50, rows[0][1])]
    got = minhash.minhash_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    expected = true_components([(i, t) for i, t in rows if i is not None], 4)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {i: c for i, (_, c) in expected.items()}
    assert len(got) == len(rows) and [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}


# pipeline -----------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = prose(321, 30)
    good = [(i, prose(i, 120, 3000), "en", "s", 0) for i in range(60)]
    junk = [(100 + i, " ".join(x + "%%%" for x in prose(200 + i, 80).split()), "en", "s", 0) for i in range(30)]
    passage = prose(555, 60)
    extra = [(200, good[0][1], "en", "s", 0), (201, f"{prose(60, 60, 3000)} {item} {prose(61, 60, 3000)}", "en", "s", 0)]
    extra += [(210 + k, f"{prose(70 + k, 70, 3000)} {passage} {prose(80 + k, 70, 3000)}", "en", "s", 0) for k in range(2)]
    spark.createDataFrame(good + junk + extra, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    ids_of = [set(x) for x in seen]
    assert not ids_of[0] & {i for i, *_ in junk} and {i for i, *_ in good} <= ids_of[0]
    assert 200 in ids_of[0] and ids_of[1] == ids_of[0] - {200}
    assert ids_of[2] == ids_of[1] and sum(passage in t for t in seen[2].values()) == 1 and sum(passage in t for t in seen[1].values()) == 2
    assert ids_of[3] == ids_of[2] - {201}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids_of[3]


def without_repeats(rows, least):
    """Texts as words, without those of windows that an earlier document or place has."""
    seen, later = {}, {}
    for i, t in sorted(rows):
        ws = split(t)
        for p in range(len(ws) - least + 1):
            if seen.setdefault(tuple(ws[p : p + least]), (i, p)) != (i, p):
                later.setdefault(i, set()).update(range(p, p + least))
    return {i: [x for p, x in enumerate(split(t)) if p not in later.get(i, ())] for i, t in rows}


def test_pipeline_against_brute_force(spark, tmp_path, ids):
    import corpus_pipeline

    items = [(k, prose(7000 + k, 14 + 3 * k, 10**6)) for k in range(6)]
    passage = prose(8000, 75, 10**6)
    rows = [(i, t) for i, t, *_ in corpus() if t and len(t.split()) > 20]
    rows += [(500 + k, f"{prose(8100 + k, 30)} {item} {prose(8200 + k, 30)}") for k, item in items[:4]]
    rows += [(600 + k, f"{prose(8300 + k, 40)} {passage} {prose(8400 + k, 40)} {passage if k == 2 else ''}") for k in range(4)]
    near = items[4][1].split()
    near[3] = "other"
    rows += [(700, " ".join([prose(8500, 30), *near])), (701, passage), (702, prose(8600, 5000, 10**5))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    classes = true_components(rows, 5)  # all labels are 1: nothing is rejected
    kept = [(i, t) for i, t in rows if classes[i][1] == i]
    assert 5 < len(kept) < len(rows)
    cut = {i: ws for i, ws in without_repeats(kept, 50).items() if ws}
    assert 701 in dict(kept) and sum(map(len, cut.values())) < sum(len(split(t)) for _, t in kept) - 200
    clean = lambda ws: [x for x in (re.sub(r"[!-/:-@\[-`{-~]", "", y) for y in ws) if x]

    def dirty(ws):
        ws = clean(ws)
        for _, item in items:
            iw = clean(split(item))
            if any(weighted(iw, ws[p : p + len(iw)]) >= 0.8 for p in range(len(ws) - len(iw) + 1)):
                return True
        return False

    left = {i for i, ws in cut.items() if not dirty(ws)}
    assert set(packed.doc_id) == left and {500, 501, 502, 503} & set(cut) and not {500, 501, 502, 503} & left
    # Lengths of the pieces: of the texts that are left, as the pipeline's own third stage writes them.
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {i: split(t) for i, t in texts.items()} == {i: cut[i] for i in left}
    lengths = [n for t in texts.values() for _, n in packing.cut(len(ids(t)), 2048)]
    got = sorted(tuple(sorted(own.length)) for _, own in packed.groupby("sequence_id"))
    assert got == best_two_fit_one_by_one(lengths, 2048)


STAGES = {
    "quality": lambda spark, docs, bench, labels: quality.keep_good(spark, docs, labels),
    "near": lambda spark, docs, bench, labels: minhash.keep_one_of_each(spark, docs),
    "repeats": lambda spark, docs, bench, labels: suffixes.remove_repeats(spark, docs),
    "bench": lambda spark, docs, bench, labels: decontaminate.drop_contaminated(spark, docs, bench),
}
CLASH = ["later", "_hash", "text_hash", "stats", "lower", "_LOWER", "of", "_of", "node", "component", "component_id", "f1", "n", "copies", "kept", "label", "score", "spans"]


@pytest.mark.parametrize("stage", STAGES)
def test_stages_with_clashing_names_nulls_and_empty_tables(spark, stage):
    rows = [*corpus(), *corpus()[:4], corpus()[20], (None, prose(1, 120), "en", "s", 5), (None, None, None, None, None)]
    bench = spark.createDataFrame([(1, prose(102, 62)), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    plain = spark.createDataFrame(rows, DOC).repartition(3)
    wide = plain.select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASH))
    got = STAGES[stage](spark, wide, bench, labels)
    assert got.schema.names == wide.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in wide.schema]
    found = got.collect()
    assert all(r[c] == f"{c}{'-' if r['doc_id'] is None else r['doc_id']}" for r in found for c in CLASH)
    key = lambda r: str(tuple(r)[:5])
    assert sorted(map(key, found)) == sorted(map(key, STAGES[stage](spark, plain, bench, labels).collect()))
    assert STAGES[stage](spark, wide.limit(0), bench, labels).count() == 0
    if stage in ("bench", "quality"):
        assert STAGES[stage](spark, plain, bench.limit(0), labels.limit(0)).count() == len(rows)
