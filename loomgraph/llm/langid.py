"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes that tile the whole text (the last one ends where the text ends; short texts
are filled up with spaces). At every byte the states of both directions give a distribution over languages, and a
document's probabilities are the mean of its bytes' distributions. It is trained in numpy by backpropagation through
time, on SPOTS windows of at most DOCS documents of each language, and of at most ALL_DOCS in all: with more than
ALL_DOCS / DOCS languages each has fewer, one at least. Documents are the first in the order of a hash of the id; rows
that repeat an id are one of them, the one with the least windows.

Arrays have features before windows, so that every elementwise step runs over contiguous memory. Gates use the hard
sigmoid, and candidates the rational function t * (27 + t**2) / (27 + 9 * t**2) of t clipped to -3..3, which stands for
the hyperbolic tangent at a fifth of its cost.

Null texts and texts without a letter are `und` with score 0. Without a labelled document every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import column, encoded, held_out, prepare, spread

WINDOW, HIDDEN = 64, 8
DOCS, ALL_DOCS, SPOTS = 400, 100_000, 4
EPOCH_STEPS, BATCH, RATE = 400, 128, 0.015
UNKNOWN = "und"
_AT_ONCE = 512


@dataclass
class Network:
    """Both directions stacked: x [2, 3H, 256] by byte, u [2, 3H, H], b [2, H, 1] (candidate's recurrent bias), v [2, L, H], c [L, 1]. Gates in order: update, reset, candidate."""

    languages: list[str]
    x: np.ndarray
    u: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
        r, n = np.random.default_rng(seed), len(languages)
        draw = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        x = draw(0.3, 2, 3 * hidden, 256)
        x[:, : 2 * hidden] = x[:, : 2 * hidden] / 4 + 0.5  # the hard sigmoid's slope and middle
        return cls(languages, x, draw(0.5 * hidden**-0.5, 2, 3 * hidden, hidden), np.zeros((2, hidden, 1), np.float32), draw(hidden**-0.5, 2, n, hidden), np.zeros((n, 1), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.v, self.c]


def forward(net: Network, windows: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Probabilities [T, L, N] for windows [N, T] of bytes."""
    n, t_all = windows.shape
    hidden = net.u.shape[2]
    along = np.ascontiguousarray(windows.T).astype(np.intp)
    order = (along, along[::-1])
    h = np.zeros((2, hidden, n), np.float32)
    states = np.empty((t_all, 2, hidden, n), np.float32)
    x, a = np.empty((2, 2, 3 * hidden, n), np.float32)
    gates, (t1, t2) = np.empty((2, 2 * hidden, n), np.float32), np.empty((2, 2, hidden, n), np.float32)
    z, r = gates[:, :hidden], gates[:, hidden:]
    for t in range(t_all):
        for d in (0, 1):
            np.take(net.x[d], order[d][t], axis=1, out=x[d], mode="clip")
        np.matmul(net.u, h, out=a)
        np.add(x[:, : 2 * hidden], a[:, : 2 * hidden], out=gates)
        np.minimum(np.maximum(gates, 0, out=gates), 1, out=gates)
        inner = a[:, 2 * hidden :]
        inner += net.b
        np.multiply(r, inner, out=t1)
        t1 += x[:, 2 * hidden :]
        np.minimum(np.maximum(t1, -3, out=t1), 3, out=t1)
        new = states[t]
        np.multiply(t1, t1, out=t2)
        np.add(t2, 27, out=new)
        new *= t1
        t2 *= 9
        t2 += 27
        new /= t2
        if trace is not None:
            trace.append((h, z.copy(), r.copy(), new.copy(), inner.copy(), t1.copy()))
        # The state is new + z * (h - new).
        np.subtract(h, new, out=t1)
        t1 *= z
        new += t1
        h = new
    logits = np.matmul(net.v[0], states[:, 0]) + np.matmul(net.v[1], states[::-1, 1])
    logits += net.c
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits, out=logits)
    p /= p.sum(axis=1, keepdims=True)
    if trace is not None:
        trace.append((order, states))
    return p


def backward(net: Network, windows: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of the counted bytes (mask [N, T]) and its gradients, by backpropagation through time."""
    trace: list = []
    p = forward(net, windows, trace)
    order, states = trace.pop()
    n, t_all = windows.shape
    hidden, weight = net.u.shape[2], (mask.T / max(1, mask.sum())).astype(np.float32)
    mine = p[:, labels, np.arange(n)]
    loss = float(-(np.log(mine + 1e-9) * weight).sum())
    d_logits = p * weight[:, None, :]
    d_logits[:, labels, np.arange(n)] -= weight
    dx, du, db, dv = (np.zeros_like(w) for w in (net.x, net.u, net.b, net.v))
    dv[0] = np.einsum("tln,thn->lh", d_logits, states[:, 0])
    dv[1] = np.einsum("tln,thn->lh", d_logits, states[::-1, 1])
    dc = d_logits.sum((0, 2))[:, None]
    into = np.stack([np.matmul(net.v[0].T, d_logits), np.matmul(net.v[1].T, d_logits)[::-1]], 1)
    dh = np.zeros((2, hidden, n), np.float32)
    inputs = np.empty((t_all, 2, 3 * hidden, n), np.float32)
    for t in range(t_all - 1, -1, -1):
        before, z, r, new, inner, c = trace[t]
        dh = dh + into[t]
        c = c * c
        d_new = dh * (1 - z) * np.square((9 - c) / (3 * (3 + c)))
        d_inner = d_new * r
        open_ = lambda g: (g > 0) & (g < 1)
        d_gates = np.concatenate([dh * (before - new) * open_(z), d_new * inner * open_(r)], 1)
        inputs[t] = np.concatenate([d_gates, d_new], 1)
        d_recurrent = np.concatenate([d_gates, d_inner], 1)
        du += np.matmul(d_recurrent, before.transpose(0, 2, 1))
        db += d_inner.sum(2, keepdims=True)
        dh = dh * z + np.matmul(net.u.transpose(0, 2, 1), d_recurrent)
    for d in (0, 1):
        seen = np.zeros((t_all * n, 256), np.float32)
        seen[np.arange(t_all * n), order[d].ravel()] = 1
        dx[d] = inputs[:, d].transpose(1, 0, 2).reshape(3 * hidden, -1) @ seen
    return loss, [dx, du, db, dv, dc]


def train(texts: Sequence[str], langs: Sequence[str], steps: int = EPOCH_STEPS, seed: int = 1) -> Network | None:
    """A network from labelled passages, by Adam with a falling rate; languages weigh equally."""
    rows = [(b, g) for b, g in zip(encoded(texts), langs) if b and g is not None]
    languages = sorted({g for _, g in rows})
    if not rows:
        return None
    windows, mask = np.full((len(rows), WINDOW), 32, np.uint8), np.zeros((len(rows), WINDOW), bool)
    for i, (b, _) in enumerate(rows):
        b = b[:WINDOW]
        windows[i, : len(b)], mask[i, : len(b)] = np.frombuffer(b, np.uint8), True
    labels = np.array([languages.index(g) for _, g in rows])
    chance = 1.0 / np.bincount(labels)[labels]
    chance /= chance.sum()
    r, net = np.random.default_rng(seed), Network.fresh(languages, seed=seed)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    for k in range(1, steps + 1):
        pick = r.choice(len(rows), BATCH, p=chance)
        _, gradients = backward(net, windows[pick], labels[pick], mask[pick])
        norm = float(np.sqrt(sum((g * g).sum() for g in gradients)))
        rate = RATE * min(1.0, 20 * (1 - k / (steps + 1)) / 10)
        for w, g, (m, s) in zip(net.weights(), gradients, moments):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return net


def byte_labels(net: Network, texts: Sequence[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, probabilities [bytes, L]) of windows that tile each text."""
    which, at, skip = [], [], []
    base = 0
    filled = [t.ljust(WINDOW, b" ") for t in texts]
    for i, t in enumerate(filled):
        starts = np.arange(0, len(t) - WINDOW + 1, WINDOW)
        over = 0
        if starts[-1] + WINDOW < len(t):
            over = starts[-1] + 2 * WINDOW - len(t)
            starts = np.append(starts, len(t) - WINDOW)
        which.append(np.full(len(starts), i))
        at.append(starts + base)
        s = np.zeros(len(starts), np.int64)
        s[-1] = over
        skip.append(s)
        base += len(t)
    if not texts:
        return
    raw = np.frombuffer(b"".join(filled), np.uint8)
    which, at, skip = np.concatenate(which), np.concatenate(at), np.concatenate(skip)
    for k in range(0, len(at), _AT_ONCE):
        p = forward(net, raw[at[k : k + _AT_ONCE, None] + np.arange(WINDOW)])
        yield which[k : k + _AT_ONCE], skip[k : k + _AT_ONCE], p


def pooled(net: Network, texts: Sequence[bytes]) -> np.ndarray:
    """Mean probabilities [texts, L] over the bytes of whole texts (bytes that fill up a short text don't count)."""
    total = np.zeros((len(texts), len(net.languages)))
    lengths = np.array([max(1, len(t)) for t in texts])
    for which, skip, p in byte_labels(net, texts):
        upto = np.minimum(WINDOW, lengths[which])
        if skip.any() or (upto < WINDOW).any():
            t = np.arange(WINDOW)[:, None]
            p = p * ((t >= skip) & (t < upto))[:, None, :]
        np.add.at(total, which, p.sum(0).T)
    return total / lengths[:, None]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def predictor(net: Network | None):
    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
        raw = encoded([texts.iloc[i] for i in some])
        at = 0
        while at < len(some):  # about a megabyte at a time
            end, size = at, 0
            while end < len(some) and (end == at or size + len(raw[end]) <= 1 << 20):
                size += len(raw[end])
                end += 1
            p = pooled(net, raw[at:end])
            best = p.argmax(1)
            lang[some[at:end]] = np.array(net.languages, object)[best]
            score[some[at:end]] = np.clip(p[np.arange(len(best)), best], 0, 1)
            at = end
        return pd.DataFrame({"lang": lang, "score": score})

    return predict


def labelled_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int | None = None) -> tuple[list[str], list[str]]:
    """Passages and languages of a bounded sample of the documents that are not held out; documents and places come from hashes of the id."""
    rows = docs.select(column(id_col).alias("i"), column(text_col).cast("string").alias("t"), column(lang_col).cast("string").alias("g"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i"))).withColumn("at", spread(F.col("i"), F.lit(5)))
    counts = rows.groupBy("g").agg(F.approx_count_distinct("i").alias("n"))
    languages = counts.count()
    if not languages:
        return [], []
    each = max(1, min(DOCS, ALL_DOCS // languages)) if most is None else most
    # Twice as many as wanted, as some have no letter and counts are approximate; what is too many is cut below.
    # A row for each language, counted above: texts are not dealt by language.
    few = rows.join(F.broadcast(counts) if languages <= ALL_DOCS else counts, "g").where(F.col("at") * F.col("n") < 2 * each).where(F.col("t").rlike(r"\p{L}"))
    last = F.greatest(F.length("t") - WINDOW, F.lit(0)) + 1
    spots = F.array(*[F.col("t").substr((F.floor(spread(F.col("i"), F.lit(11 + k)) * last) + 1).cast("int"), F.lit(WINDOW)) for k in range(SPOTS)])
    one = few.select("i", "at", F.struct(F.array_distinct(spots).alias("spots"), "g").alias("x")).groupBy("i", "at").agg(F.min("x").alias("x"))
    order = F.row_number().over(Window.partitionBy("x.g").orderBy("at", "i"))
    got = one.withColumn("place", order).where(F.col("place") <= each).select("i", "x.g", F.explode("x.spots").alias("p")).orderBy("i", "p").collect()
    return [r["p"] for r in got], [r["g"] for r in got]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """[id_col, held_out, lang_pred, score]: one row per row of docs."""
    prepare(docs.sparkSession)
    predict = predictor(train(*labelled_passages(docs, id_col, text_col, lang_col)))
    found = docs.select(column(id_col).alias("__id"), predict(column(text_col).cast("string")).alias("p"))
    return found.select(F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
