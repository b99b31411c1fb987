"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a trained vector of its hash bucket beside the means of trained vectors of its character n-grams (3 to 5
bytes, with word ends) and of its beginnings (5 to 9 bytes), so unseen word forms still count by their parts. Windows of WINDOW words overlap by WINDOW - STRIDE;
both directions run over each window, attention pools their states, and a text's score is that of its worst window.
All windows of every text are scored.

Training reads a bounded sample: at most MAX_TOXIC toxic and MAX_CLEAN clean labelled rows of MAX_CHARS characters together, smallest
hashes of doc_id first, whole texts of any length. A text's label is for its windows together: the loss is on a
soft maximum over them, and of a text of more than TOP windows those TOP that score highest at the time carry it.
Labels, lang, source and doc_id never enter a score.

Defined cases: null text is empty; an empty text is one window without words; repeated rows are scored one by one; texts of any
length are scored whole; a sample without both classes gives the share of toxic labels in it (0 without labels) as each
score; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, in_slices, mixed, prefix_hash, span_hash, text_buffer, written, xx64
from .decontaminate import _FOLD, _SEPARATOR

WINDOW, STRIDE = 40, 30
WORD_BUCKETS, WORD_DIM = 1 << 16, 6
#: For each group of a word's parts: buckets and dimensions.
PARTS = {"gram": (1 << 15, 10), "head": (1 << 15, 6)}
HIDDEN, ATTENTION = 12, 8
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1000, 2500, 60_000_000
TOP = 32
EPOCHS, STEPS, BATCH, RATE = 5, 250, 50, 0.006
#: Words and n-grams of fewer training texts than one for each so many toxic ones, or than two, have no vector: a text
#: can't be learnt by heart.
LEAST_SHARE = 150
DECAY, DROPPED = 0.02, 0.3
SLICE = 2_000_000
_LANES = 2048  # windows that run side by side
_WORDS = 20_000  # distinct words, or texts' words in training, taken apart at a time
_IN = WORD_DIM + sum(dim for _, dim in PARTS.values())


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, starts, ends, hashes, n + 1 bounds by row): runs of letters and digits, lower-cased for A-Z and Latin-1."""
    data, offsets = text_buffer(column)
    if not len(data):
        z = np.zeros(0, np.int64)
        return data, z, z, np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    folded = _FOLD[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    folded[latin] += 32
    letter = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter & (~np.concatenate([[False], letter[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(letter & (~np.concatenate([letter[1:], [False]]) | edge[1:])) + 1
    return folded, starts, ends, xx64(folded, starts, ends, 4), np.searchsorted(starts, offsets)


class Words:
    """Inputs of distinct words: bucket, and for each group of parts their buckets with bounds."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        self.bucket = (hashes & U64(WORD_BUCKETS - 1)).astype(np.int64)
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {name: [(np.zeros(0, np.int32), np.zeros(0, np.int64))] for name in PARTS}
        for at in range(0, len(starts), _WORDS):
            for name, part in self._parts(data, starts[at : at + _WORDS], ends[at : at + _WORDS]).items():
                found[name].append(part)
        self.parts = {name: (np.concatenate([x[0] for x in rows]), np.concatenate([[0], np.cumsum(np.concatenate([x[1] for x in rows]))])) for name, rows in found.items()}

    def _parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """For each group the buckets of all words' parts, by word, and the number of each word."""
        size = ends - starts
        wide = size + 2
        at = np.cumsum(wide) - wide
        own = np.full(int(wide.sum()), 0x20, np.uint8)  # a space marks both ends
        word = np.repeat(np.arange(len(size)), size)
        within = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        own[at[word] + 1 + within] = data[starts[word] + within]
        prefix = prefix_hash(own, 7)
        spans = {"gram": [(n, np.maximum(wide - n + 1, 0)) for n in (3, 4, 5)], "head": [(n, (wide > n).astype(np.int64)) for n in (6, 7, 8, 9, 10)]}
        out = {}
        for name, kinds in spans.items():
            owners, buckets = [], []
            for n, count in kinds:  # the first ``count`` spans of n bytes of each word
                of = np.repeat(np.arange(len(at)), count)
                a = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                owners.append(of)
                buckets.append((mixed(span_hash(prefix, a, a + n) + U64(n)) & U64(PARTS[name][0] - 1)).astype(np.int32))
            owner = np.concatenate(owners)
            out[name] = np.concatenate(buckets)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(size))
        return out

    def chosen(self, which: np.ndarray) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
        """Buckets of the chosen words; for each group the parts' buckets and the place of each part's word among the chosen."""
        groups = {}
        for name, (buckets, bounds) in self.parts.items():
            count = np.diff(bounds)[which]
            of = np.repeat(np.arange(len(which)), count)
            at = np.repeat(bounds[which] - (np.cumsum(count) - count), count) + np.arange(len(of))
            groups[name] = buckets[at], of
        return self.bucket[which], groups


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of all windows: every row has one at least, and each word is in one at least."""
    n = np.diff(bounds)
    count = np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, bounds[row] + k * STRIDE, np.clip(n[row] - k * STRIDE, 0, WINDOW)


def fresh(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"word": np.zeros((WORD_BUCKETS, WORD_DIM), np.float32)} | {k: normal(*shape, scale=0.05) for k, shape in PARTS.items()}
    for d in "fb":
        p |= {f"w{d}": normal(_IN, 3 * HIDDEN, scale=_IN**-0.5), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)}
    return p | {"wa": normal(2 * HIDDEN, ATTENTION, scale=0.2), "va": normal(ATTENTION, scale=0.5), "out": normal(2 * HIDDEN, scale=0.3), "bias": np.full(1, -2.0, np.float32)}


def inputs(p: dict[str, np.ndarray], bucket: np.ndarray, groups: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row for each distinct word."""
    x = np.zeros((len(bucket), _IN), np.float32)
    x[:, :WORD_DIM] = p["word"][bucket]
    at = WORD_DIM
    for name, (parts, of) in groups.items():
        dim = PARTS[name][1]
        if len(of):
            head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            sums = np.add.reduceat(p[name][parts], head, axis=0)
            x[of[head], at : at + dim] = sums / np.diff(np.append(head, len(of)))[:, None].astype(np.float32)
        at += dim
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    return np.add(x, 0.5, out=x)


def _projected(p: dict[str, np.ndarray], x: np.ndarray, d: str) -> np.ndarray:
    """Input parts of all gates for each word, and a last row, for padding, that keeps the state."""
    out = np.empty((len(x) + 1, 3 * HIDDEN), np.float32)
    np.matmul(x, p[f"w{d}"], out=out[:-1])
    out[:-1] += p[f"c{d}"]
    out[-1] = 0
    out[-1, HIDDEN : 2 * HIDDEN] = 40.0
    return out


def _run(p: dict[str, np.ndarray], table: np.ndarray, ids: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, window, HIDDEN) of one direction; what the backward pass needs if ``keep``."""
    steps, n = ids.shape
    out = np.empty((steps, n, HIDDEN), np.float32)
    h = np.zeros((n, HIDDEN), np.float32)
    u, kept = p[f"u{d}"], []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x = table[ids[t]]
        g = h @ u
        rz = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        new = out[t]
        np.subtract(h, c, out=new)
        new *= z
        new += c
        if keep:
            kept.append((t, h, r, z, c, g[:, 2 * HIDDEN :]))
        h = new
    return out, kept


def forward(p: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, keep: bool = False):
    """Logits of windows; ids (time, window) index words, len(x) is padding."""
    states, kept = [], {}
    for d in "fb":
        s, kept[d] = _run(p, _projected(p, x, d), ids, d, keep)
        states.append(s)
    s = np.concatenate(states, axis=2)
    a = np.tanh(s @ p["wa"])
    e = a @ p["va"]
    e[ids == len(x)] = -1e9
    e -= e.max(axis=0)
    np.exp(e, out=e)
    e /= e.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", e, s)
    logit = pooled @ p["out"] + p["bias"]
    return (logit, (s, a, e, pooled, kept)) if keep else logit


def backward(p: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, kept: tuple, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the dense parameters, and of the words' inputs."""
    s, a, e, pooled, runs = kept
    g = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * p["out"]
    ds = e[:, :, None] * dpooled
    de = np.einsum("tnk,nk->tn", s, dpooled)
    de = e * (de - (e * de).sum(axis=0))
    g["va"] = np.einsum("tnk,tn->k", a, de)
    da = de[:, :, None] * p["va"] * (1 - a * a)
    g["wa"] = np.einsum("tni,tnj->ij", s, da)
    ds += da @ p["wa"].T
    dx = np.zeros((len(x) + 1, _IN), np.float32)
    for k, d in enumerate("fb"):
        u = p[f"u{d}"]
        g[f"u{d}"] = np.zeros_like(u)
        dtable = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
        dh = np.zeros((ids.shape[1], HIDDEN), np.float32)
        for t, h, r, z, c, m in reversed(runs[d]):
            dh = dh + ds[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * m * r * (1 - r)
            dg = np.concatenate([dr, dz, dc * r], axis=1)
            g[f"u{d}"] += h.T @ dg
            dh = dh * z + dg @ u.T
            np.add.at(dtable, ids[t], np.concatenate([dr, dz, dc], axis=1))
        dtable = dtable[:-1]
        g[f"c{d}"] = dtable.sum(axis=0)
        g[f"w{d}"] = x.T @ dtable
        dx[:-1] += dtable @ p[f"w{d}"].T
    return g, dx[:-1]


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, grads: dict[str, tuple[np.ndarray | slice, np.ndarray]]) -> None:
        """grads: rows and their gradient; rows without one stay as they are."""
        self.t += 1
        rate = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, (rows, g) in grads.items():
            m = self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * g
            v = self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * g * g
            self.p[k][rows] -= rate * m / (np.sqrt(v) + 1e-8)


def _ids(of_word: np.ndarray, first: np.ndarray, n: np.ndarray, pad: int) -> np.ndarray:
    """(time, window) indexes of words, ``pad`` past a window's end."""
    steps = max(1, int(n.max())) if len(n) else 1
    t = np.arange(steps)[:, None]
    at = np.minimum(first[None, :] + t, max(len(of_word) - 1, 0))
    return np.where(t < n[None, :], of_word[at] if len(of_word) else pad, pad)


def _split_in_turn(texts: list[str], at_once: int = 100) -> tuple[np.ndarray, ...]:
    """``split_words`` of many texts, a few at a time: the hashes' working arrays stay small."""
    parts = []
    base = before = 0
    for k in range(0, len(texts), at_once):
        data, starts, ends, h, bounds = split_words(pa.array(texts[k : k + at_once], pa.string()))
        parts.append((data, starts + base, ends + base, h, bounds[1:] + before))
        base, before = base + len(data), before + len(starts)
    data, starts, ends, h, bounds = (np.concatenate(x) for x in zip(*parts, strict=True))
    return data, starts, ends, h, np.concatenate([[0], bounds])


class Prior:
    """Texts of each label that have each item."""

    def __init__(self, size: int, y: np.ndarray) -> None:
        self.size, self.y, self.counts = size, y, np.zeros((2, size), np.int64)

    def add(self, texts_of: np.ndarray, items: np.ndarray) -> None:
        """Items of whole texts."""
        pairs = np.unique(texts_of * np.int64(self.size) + items)
        toxic = self.y[pairs // self.size] > 0.5
        for k, own in enumerate((toxic, ~toxic)):
            self.counts[k] += np.bincount(pairs[own] % self.size, minlength=self.size)

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether enough texts have each item, and a shrunk log-odds of toxic texts."""
        t, c = self.counts
        toxic = (self.y > 0.5).sum()
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (len(self.y) - toxic + 1))
        known = t + c >= max(2, toxic / LEAST_SHARE)
        return known, np.where(known, odds * (t + c) / (t + c + 8), 0).astype(np.float32)


def fit(texts: list[str], labels: list[int], share: float | None = None, epochs: int = EPOCHS, seed: int = 0) -> dict[str, np.ndarray]:
    """Trained parameters, or {"share": ...} without both classes. ``share`` is that of toxic labels where the sample differs."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return {"share": np.array([y.mean() if len(y) else 0.0])}
    data, starts, ends, h, bounds = _split_in_turn(texts)
    _, one, of_word = np.unique(h, return_index=True, return_inverse=True)
    of_word = of_word.astype(np.int32)
    words = Words(data, starts[one], ends[one], h[one])
    row, first, n = windows(bounds)
    at = np.searchsorted(row, np.arange(len(y) + 1))
    p = fresh(seed)
    priors = {"word": Prior(WORD_BUCKETS, y)} | {name: Prior(shape[0], y) for name, shape in PARTS.items()}
    at_text = 0
    while at_text < len(y):
        to = max(at_text + 1, int(np.searchsorted(bounds, bounds[at_text] + _WORDS, side="right")) - 1)
        text_of = np.repeat(np.arange(at_text, to), np.diff(bounds[at_text : to + 1]))
        every = np.unique(text_of * np.int64(len(one)) + of_word[bounds[at_text] : bounds[to]])
        bucket, groups = words.chosen(every % len(one))
        priors["word"].add(every // len(one), bucket)
        for name, (parts, of) in groups.items():
            priors[name].add((every // len(one))[of], parts)
        at_text = to
    known_parts = {}
    for name, prior in priors.items():
        known_parts[name], start = prior.start()
        p[name] *= known_parts[name][:, None]
        p[name][:, 0] = start
    known = known_parts["word"]
    adam, rng = Adam(p, RATE), np.random.default_rng(seed)
    # A third toxic in each batch whatever the sample's share.
    toxic, clean = np.flatnonzero(y > 0.5), np.flatnonzero(y < 0.5)
    rounds = max(epochs, -(-STEPS // max(1, -(-len(y) // BATCH))))
    total, done = rounds * -(-len(y) // BATCH), 0
    for _ in range(rounds):
        a, b = rng.permutation(toxic), rng.permutation(clean)
        batches = -(-len(y) // BATCH)
        for k in range(batches):
            docs = np.concatenate([a[k::batches], b[k::batches]])
            own = [_highest(p, words, of_word, first[at[i] : at[i + 1]], n[at[i] : at[i + 1]]) + at[i] for i in docs]
            w, doc = np.concatenate(own), np.repeat(np.arange(len(docs)), list(map(len, own)))
            ids = _ids(of_word, first[w], n[w], -1)
            used, local = np.unique(ids[ids >= 0], return_inverse=True)
            flat = np.full(ids.shape, len(used))
            flat[ids >= 0] = local
            bucket, groups = words.chosen(used)
            x = inputs(p, bucket, groups)
            # Now and then a word is read by its characters alone, or by itself alone.
            drop = rng.random((len(x), 2)) < DROPPED
            mask = np.ones_like(x)
            mask[drop[:, 0], :WORD_DIM] = 0
            mask[drop[:, 1] & ~drop[:, 0], WORD_DIM:] = 0
            x *= mask
            logit, kept = forward(p, x, flat, keep=True)
            # Soft maximum over a text's windows, sharper as training goes on.
            sharp = 1.0 + 3.0 * done / total
            head = np.searchsorted(doc, np.arange(len(docs)))
            top = np.maximum.reduceat(logit, head)
            part = np.exp(sharp * (logit - top[doc]))
            part /= np.add.reduceat(part, head)[doc]
            score = np.add.reduceat(part * logit, head)
            error = (1 / (1 + np.exp(-score)) - y[docs]) / len(docs)
            dlogit = (error[doc] * part * (1 + sharp * (logit - score[doc]))).astype(np.float32)
            g, dx = backward(p, x, flat, kept, dlogit)
            dx *= mask
            grads = {name: (slice(None), v) for name, v in g.items()}
            rows, back = np.unique(bucket, return_inverse=True)
            dword = np.zeros((len(rows), WORD_DIM), np.float32)
            np.add.at(dword, back, dx[:, :WORD_DIM])
            own = known[rows]
            grads["word"] = rows[own], dword[own] + DECAY / len(docs) * p["word"][rows[own]]
            column = WORD_DIM
            for name, (parts, of) in groups.items():
                dim = PARTS[name][1]
                size = np.bincount(of, minlength=len(used))[of].astype(np.float32)
                rows, back = np.unique(parts, return_inverse=True)
                dpart = np.zeros((len(rows), dim), np.float32)
                np.add.at(dpart, back, dx[of, column : column + dim] / size[:, None])
                own = known_parts[name][rows]
                grads[name] = rows[own], dpart[own] + DECAY / len(docs) * p[name][rows[own]]
                column += dim
            adam.rate = RATE * (1 - 0.9 * done / total)
            adam.step(grads)
            done += 1
    if share and 0 < share < 1:
        p["bias"] += np.float32(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return p


def _highest(p: dict[str, np.ndarray], words: Words, of_word: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places, in order, of the TOP windows of a text that score highest; all of a short one."""
    if len(first) <= TOP:
        return np.arange(len(first))
    logits = np.empty(len(first), np.float32)
    for k in range(0, len(first), _LANES):
        ids = _ids(of_word, first[k : k + _LANES], n[k : k + _LANES], -1)
        used, local = np.unique(ids[ids >= 0], return_inverse=True)
        flat = np.full(ids.shape, len(used))
        flat[ids >= 0] = local
        x = inputs(p, *words.chosen(used))
        logits[k : k + _LANES] = _pooled(p, {d: _projected(p, x, d) for d in "fb"}, flat, len(x))
    return np.sort(np.argsort(-logits, kind="stable")[:TOP])


def scores(p: dict[str, np.ndarray], column: pa.Array) -> np.ndarray:
    """The score of each row."""
    if "share" in p:
        return np.full(len(column), float(p["share"][0]))
    data, starts, ends, h, bounds = split_words(column)
    _, one, of_word = np.unique(h, return_index=True, return_inverse=True)
    words = Words(data, starts[one], ends[one], h[one])
    x = np.empty((len(one), _IN), np.float32)
    for at in range(0, len(one), 20_000):
        which = np.arange(at, min(at + 20_000, len(one)))
        x[which] = inputs(p, *words.chosen(which))
    row, first, n = windows(bounds)
    tables = {d: _projected(p, x, d) for d in "fb"}
    logits = np.empty(len(row), np.float32)
    order = np.argsort(-n, kind="stable")  # windows of like length run together
    for at in range(0, len(order), _LANES):
        w = order[at : at + _LANES]
        logits[w] = _pooled(p, tables, _ids(of_word, first[w], n[w], len(x)), len(x))
    worst = np.maximum.reduceat(logits, np.searchsorted(row, np.arange(len(bounds) - 1))) if len(row) else np.zeros(0)
    return 1 / (1 + np.exp(-worst.astype(np.float64)))


def _pooled(p: dict[str, np.ndarray], tables: dict[str, np.ndarray], ids: np.ndarray, pad: int) -> np.ndarray:
    s = np.concatenate([_run(p, tables[d], ids, d, False)[0] for d in "fb"], axis=2)
    e = np.tanh(s @ p["wa"]) @ p["va"]
    e[ids == pad] = -1e9
    e -= e.max(axis=0)
    np.exp(e, out=e)
    e /= e.sum(axis=0)
    return np.einsum("tn,tn->n", e, s @ p["out"]) + p["bias"]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, np.ndarray]:
    """A model of a bounded sample of the labelled rows of ``docs``."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(2 * most) for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    # At most 2 * (MAX_TOXIC + MAX_CLEAN) rows of two numbers.
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "id")
    sample = written(sample.select("id", "y", "text", F.length("text").alias("size")), "labelled")
    parts = []
    for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        taken = sample.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id", "text").limit(most)
        total = F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id", "text").rowsBetween(Window.unboundedPreceding, 0))  # of at most ``most`` rows
        parts.append(taken.withColumn("total", total).where(F.col("total") <= MAX_CHARS // 2).select("y", "total", "text"))
    # The bounded sample is learnt in one task: texts and what training holds stay out of the driver, which gets the model.
    found = parts[0].unionByName(parts[1]).coalesce(1).mapInArrow(_fitted(counts.get(1, 0) / max(1, sum(counts.values()))), "model binary").collect()
    return _unpacked(found[0]["model"]) if found else fit([], [], 0.0)


def _fitted(share: float):
    """Learns from all rows (y, total, text) of its task, toxic ones first, then by ``total`` and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
        rows.sort(key=lambda row: (-row[0], row[1], row[2]))
        yield pa.RecordBatch.from_arrays([pa.array([_packed(fit([text for _, _, text in rows], [y for y, _, _ in rows], share))], pa.binary())], ["model"])

    return run


def _packed(model: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return dict(arrays)


def scored(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row. The model has a fixed size, about 4 MB."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(sent.value, batch.column(1)))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, in one scan, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, text_col, SLICE):
            yield batch.filter(pa.array(scores(sent.value, batch.column(batch.schema.get_field_index(text_col))) < threshold))

    return docs.mapInArrow(run, docs.schema)
