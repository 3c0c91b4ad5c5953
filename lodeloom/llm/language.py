"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on bounded
excerpts of labelled documents. It labels every byte of every whole text; a
document's probabilities are the mean over its bytes. Texts are read in
segments of SEGMENT bytes, each from a fresh state on both sides, so time and
memory are in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as w
from .store import prepare

#: Units in each direction; bytes read from one state.
UNITS, SEGMENT = 8, 128
#: Learning sample: about this many documents of each language, and excerpts of each.
SAMPLE_DOCS, EXCERPTS, EXCERPT = 400, 3, 64
STEPS, BATCH, RATE = 300, 128, 0.02
#: Segments that are read at once.
TOGETHER = 2048
PAD = 256
UNKNOWN = "und"


@dataclass
class Direction:
    """Input rows for each byte (gates z, r and candidate c), recurrent weights of the gates and of the candidate."""

    x: np.ndarray
    u: np.ndarray
    v: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.x, self.u, self.v]


@dataclass
class Network:
    langs: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # (2 * units, langs)
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.ahead.parts(), *self.back.parts(), self.out, self.bias]


def _direction(rng: np.random.Generator, units: int) -> Direction:
    f = np.float32
    return Direction(
        rng.normal(0, 0.3, (257, 3 * units)).astype(f),
        rng.normal(0, units**-0.5, (units, 2 * units)).astype(f),
        rng.normal(0, units**-0.5, (units, units)).astype(f),
    )


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * a) + 0.5


def _forward(d: Direction, x: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, N, units) along axis 0 and what the way back needs; padding holds the state at 0."""
    t, n, h = len(x), x.shape[1], d.v.shape[0]
    states, kept = np.empty((t, n, h), np.float32), []
    state = np.zeros((n, h), np.float32)
    for k in range(t):
        a = d.x[x[k]]
        gates = _sigmoid(a[:, : 2 * h] + state @ d.u)
        z, r = gates[:, :h], gates[:, h:]
        q = r * state
        c = np.tanh(a[:, 2 * h :] + q @ d.v)
        new = (state + z * (c - state)) * real[k][:, None]
        kept.append((state, z, r, q, c))
        states[k] = state = new
    return states, kept


def _backward(d: Direction, x: np.ndarray, real: np.ndarray, kept: list, grad: np.ndarray) -> list[np.ndarray]:
    """Gradients of x, u, v by backpropagation through time; grad is that of the states."""
    t, n, h = grad.shape
    gx, gu, gv = (np.zeros_like(p) for p in d.parts())
    inputs = np.empty((t, n, 3 * h), np.float32)
    carry = np.zeros((n, h), np.float32)
    for k in range(t - 1, -1, -1):
        state, z, r, q, c = kept[k]
        g = (grad[k] + carry) * real[k][:, None]
        gc = g * z * (1 - c * c)
        gz = g * (c - state) * z * (1 - z)
        gq = gc @ d.v.T
        gr = gq * state * r * (1 - r)
        gates = np.concatenate([gz, gr], axis=1)
        gu += state.T @ gates
        gv += q.T @ gc
        carry = g * (1 - z) + gq * r + gates @ d.u.T
        inputs[k, :, : 2 * h], inputs[k, :, 2 * h :] = gates, gc
    np.add.at(gx, x.ravel(), inputs.reshape(-1, 3 * h))
    gx[PAD] = 0
    return [gx, gu, gv]


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def loss_and_gradients(net: Network, x: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over real positions of x (T, N) and its gradients, in the order of ``parts``."""
    h = net.ahead.v.shape[0]
    ahead, kept_a = _forward(net.ahead, x, real)
    back, kept_b = _forward(net.back, x[::-1], real[::-1])
    both = np.concatenate([ahead, back[::-1]], axis=2)
    p = _softmax(both @ net.out + net.bias)
    total = max(real.sum(), 1)
    rows = np.arange(x.shape[1])
    loss = -(np.log(p[:, rows, label] + 1e-9) * real).sum() / total
    p[:, rows, label] -= 1
    g = (p * real[:, :, None] / total).astype(np.float32)
    g_out, g_bias = np.einsum("tnh,tnl->hl", both, g, optimize=True), g.sum(axis=(0, 1))
    g_states = g @ net.out.T
    ga = _backward(net.ahead, x, real, kept_a, g_states[:, :, :h])
    gb = _backward(net.back, x[::-1], real[::-1], kept_b, g_states[::-1, :, h:])
    return float(loss), [*ga, *gb, g_out, g_bias]


def train(texts: list[bytes], labels: list[str], seed: int = 11, steps: int = STEPS, units: int = UNITS) -> Network:
    """Adam over random batches that hold all languages alike."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    f = np.float32
    net = Network(
        langs, _direction(rng, units), _direction(rng, units), rng.normal(0, 0.3, (2 * units, len(langs))).astype(f), np.zeros(len(langs), f)
    )
    if len(langs) < 2:
        return net
    x = np.full((EXCERPT, len(texts)), PAD, dtype=np.int64)
    for i, t in enumerate(texts):
        x[: len(t[:EXCERPT]), i] = np.frombuffer(t[:EXCERPT], np.uint8)
    y = np.array([langs.index(k) for k in labels])
    by = [np.flatnonzero(y == k) for k in range(len(langs))]
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(k, max(1, BATCH // len(langs))) for k in by])
        some = x[:, pick]
        _, grads = loss_and_gradients(net, some, (some != PAD).astype(f), y[pick])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 1.5 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(net.parts(), grads, first, second, strict=True):
            g = g / max(1.0, size)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def _run_direction(d: Direction, out: np.ndarray, x: np.ndarray, real: np.ndarray, backwards: bool, logits: np.ndarray) -> None:
    """Add one direction's share of the logits of all positions."""
    n, h = x.shape[1], d.v.shape[0]
    table, u = d.x.copy(), 0.5 * d.u
    table[:, : 2 * h] *= 0.5
    state = np.zeros((n, h), np.float32)
    order = range(len(x) - 1, -1, -1) if backwards else range(len(x))
    for k in order:
        a = table.take(x[k], axis=0)
        gates = a[:, : 2 * h]
        gates += state @ u
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        c = a[:, 2 * h :]
        c += (gates[:, h:] * state) @ d.v
        np.tanh(c, out=c)
        c -= state
        c *= gates[:, :h]
        state = state + c
        if real is not None:
            state *= real[k][:, None]
        logits[k] += state @ out


def segment_sums(net: Network, x: np.ndarray, real: np.ndarray | None) -> np.ndarray:
    """Sum over real positions of the label probabilities, for each segment of x (T, N)."""
    h = net.ahead.v.shape[0]
    logits = np.empty((*x.shape, len(net.langs)), np.float32)
    logits[:] = net.bias
    _run_direction(net.ahead, net.out[:h], x, None, False, logits)
    _run_direction(net.back, net.out[h:], x, real, True, logits)
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    if real is not None:
        logits *= real[:, :, None]
    return logits.sum(axis=0, dtype=np.float64)


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean label probabilities over all bytes of each text (0 for empty ones)."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    full, rest = length // SEGMENT, length % SEGMENT
    out = np.zeros((n, len(net.langs)))
    owner = np.repeat(np.arange(n), full)
    starts = w._positions(np.zeros(n, np.int64), full) * SEGMENT + np.repeat(offsets[:-1], full)
    steps = np.arange(SEGMENT)[:, None]
    for lo in range(0, len(starts), TOGETHER):
        some = slice(lo, lo + TOGETHER)
        np.add.at(out, owner[some], segment_sums(net, data[starts[some][None, :] + steps], None))
    tails = np.flatnonzero(rest)
    tails = tails[np.argsort(rest[tails], kind="stable")]
    for lo in range(0, len(tails), TOGETHER):
        some = tails[lo : lo + TOGETHER]
        reach = int(rest[some].max())
        at = (offsets[:-1][some] + full[some] * SEGMENT)[None, :] + steps[:reach]
        real = steps[:reach] < rest[some][None, :]
        x = np.where(real, data[np.minimum(at, len(data) - 1)], PAD)
        out[some] += segment_sums(net, x, real.astype(np.float32))
    return out / np.maximum(length, 1)[:, None]


def _predict(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = w.raw(batch.column("text"))
            spoken = batch.column("spoken").to_numpy(zero_copy_only=False).astype(bool)
            parts = [pooled(net, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in w.slices(offsets, 4 << 20)]
            p = np.concatenate(parts) if parts else np.zeros((0, len(net.langs)))
            best = p.argmax(axis=1)
            names = [net.langs[k] if s else UNKNOWN for k, s in zip(best, spoken, strict=True)]
            score = np.where(spoken, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
            )

    return run


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that teach nothing: crc32 of the id as text leaves 2 when divided by 4. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))



def has_letter() -> F.Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def excerpts(docs: DataFrame) -> tuple[list[bytes], list[str]]:
    """The learning sample: about SAMPLE_DOCS documents of each language, by a hash of the id, EXCERPTS places of each.

    The driver gets at most a few hundred bytes of each of these documents.
    """
    known = docs.filter(~held_out() & has_letter() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    found = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not found:
        return [], []
    share = F.lit(0.0)
    for lang, n in found.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE_DOCS / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 30)) / (1 << 30)
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - EXCERPT, F.lit(1))) + 1
    cut = F.array(*(F.substring("text", place(k).cast("int"), F.lit(EXCERPT)) for k in range(EXCERPTS)))
    rows = known.filter(draw < share).select("doc_id", "lang", cut.alias("cuts")).collect()
    texts, labels = [], []
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["cuts"])):
        for cut_ in dict.fromkeys(r["cuts"]):
            texts.append(cut_.encode())
            labels.append(r["lang"])
    return texts, labels


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row of ``docs(doc_id, text, lang)``.

    Learns only from rows with a lang where held_out is false; predictions see
    the text alone. A null text, or one without a letter, is ``und`` with score
    0, as is everything if there is nothing to learn from. Repeated rows are
    labelled each; other columns are ignored. Empty table: no rows.
    """
    prepare(spark)
    texts, labels = excerpts(docs)
    out = docs.select("doc_id", "text", has_letter().alias("spoken"))
    if not texts:
        return out.select("doc_id", held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    net = train(texts, labels)
    found = out.mapInArrow(_predict(net), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
