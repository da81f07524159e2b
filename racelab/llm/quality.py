"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``passage`` words; the whole text is covered). Each passage
is described by character and word shares and a hashed bag of its words (``_WORDS`` buckets, signed,
roots of the counts), encoded by one learned layer, weighted by gated attention (tanh and sigmoid gates, softmax over the passages) and
the weighted passage representation is scored by a logistic layer. All layers are fitted together
from document labels on a bounded sample, by Adam.

Null, empty and blank texts are one empty passage. Repeated rows get repeated results. Without
labels of both kinds every score is the labels' mean (0.5 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordHasher, col, only, strings
from .sample import labelled_texts

_KINDS = 8  # lower, upper, digit, space, newline, stop and pause marks, other marks, beyond ASCII
_SHARES = 24
_WORDS = 128
_DIM = _SHARES + _WORDS


def _class_table() -> np.ndarray:
    table = np.full(256, 6, np.int64)
    table[97:123] = 0
    table[65:91] = 1
    table[48:58] = 2
    table[[32, 9]] = 3
    table[[10, 13]] = 4
    table[[ord(c) for c in ".,;:?'\"-()"]] = 5
    table[128:] = 7
    return table


class Passages:
    """Texts to passage descriptions, (passages, _DIM) each."""

    def __init__(self, passage: int = 64):
        self.passage = passage
        self.hasher = WordHasher()
        self.table = _class_table()

    def describe(self, text: str) -> np.ndarray:
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        sep = self.hasher.sep[b]
        first = ~sep
        first[1:] &= sep[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.zeros((1, _DIM))
        words = self.hasher.words(text)
        n = len(starts)
        cut = starts[:: self.passage].copy()
        cut[0] = 0
        k = len(cut)
        where = np.repeat(np.arange(k), np.diff(np.append(cut, len(b))))
        kinds = np.bincount(where * _KINDS + self.table[b], minlength=k * _KINDS).reshape(k, _KINDS)
        size = np.maximum(kinds.sum(1), 1)
        of = np.arange(n) // self.passage
        count = np.bincount(of, minlength=k)
        length = np.diff(np.append(starts, len(b)))
        total = np.bincount(of, length, k)
        square = np.bincount(of, length.astype(float) ** 2, k)
        mean = total / count
        order = np.lexsort((words, of))
        w, p = words[order], of[order]
        new = np.ones(n, bool)
        new[1:] = (w[1:] != w[:-1]) | (p[1:] != p[:-1])
        distinct = np.bincount(p[new], minlength=k) / count
        runs = np.diff(np.append(np.flatnonzero(new), n))
        top = np.zeros(k)
        np.maximum.at(top, p[new], runs)
        head = self.table[b[starts]]
        tail = self.table[b[np.append(starts[1:], len(b) + 1) - 2 if n > 1 else np.array([len(b) - 1])]]
        out = np.zeros((k, _DIM))
        out[:, :_KINDS] = kinds / size[:, None] * 4
        out[:, 8] = mean / 8
        out[:, 9] = np.sqrt(np.maximum(square / count - mean**2, 0)) / 8
        out[:, 10] = distinct
        out[:, 11] = top / count
        out[:, 12] = np.minimum(count / self.passage, 1)
        same = np.zeros(n)
        same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        out[:, 13] = np.bincount(of, same, k) / count
        for j, kind in enumerate((0, 1, 2, 6, 7)):
            out[:, 14 + j] = np.bincount(of, head == kind, k) / count
        for j, kind in enumerate((0, 1, 5, 6)):
            out[:, 19 + j] = np.bincount(of, tail == kind, k) / count
        out[:, 23] = 1.0
        at = (words & np.uint64(_WORDS - 1)).astype(np.int64)
        sign = np.where(words >> np.uint64(63), 1.0, -1.0)
        bag = np.bincount(of * _WORDS + at, sign, k * _WORDS).reshape(k, _WORDS)
        out[:, _SHARES:] = np.sign(bag) * np.sqrt(np.abs(bag)) / 8
        return out


@dataclass
class Attention:
    """Weights of the encoder (e), the two gates (v, u, a) and the output layer (c, d)."""

    e: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: float

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        h = np.tanh(x @ self.e)
        tv, su = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        s = (tv * su) @ self.a
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, s)
        w = np.exp(s - top[bag])
        w /= np.bincount(bag, w, bags)[bag]
        z = np.zeros((bags, h.shape[1]))
        np.add.at(z, bag, w[:, None] * h)
        logit = z @ self.c + self.d
        return {"h": h, "tv": tv, "su": su, "w": w, "z": z, "p": 1 / (1 + np.exp(-np.clip(logit, -40, 40)))}

    def score(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """The score of one document, and the attention on its passages."""
        got = self.forward(x, np.zeros(len(x), np.int64), 1)
        return float(got["p"][0]), got["w"]


def fit(bags: list[np.ndarray], labels: list[int], hidden: int = 16, gates: int = 8, epochs: int = 30, batch: int = 64, seed: int = 3) -> Attention:
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    par = [init(_DIM, hidden), init(hidden, gates), init(hidden, gates), init(gates), init(hidden), np.zeros(1)]
    mean = float(np.mean(labels)) if labels else 0.5
    if mean in (0.0, 1.0) or not labels:
        par[4][:] = 0
        par[5][0] = 0.0 if not labels else 20.0 * (2 * mean - 1)
        return Attention(*par[:5], float(par[5][0]))
    m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    y, step = np.array(labels, float), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = np.concatenate([bags[i] for i in pick])
            bag = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            net = Attention(*par[:5], float(par[5][0]))
            f = net.forward(x, bag, len(pick))
            dl = (f["p"] - y[pick]) / len(pick)
            dz = dl[:, None] * net.c
            # softmax over a bag: the gradient of a passage's weight, less the bag's weighted mean
            dw = (dz[bag] * f["h"]).sum(1)
            ds = f["w"] * (dw - np.bincount(bag, f["w"] * dw, len(pick))[bag])
            dtv, dsu = ds[:, None] * f["su"] * net.a * (1 - f["tv"] ** 2), ds[:, None] * f["tv"] * net.a * f["su"] * (1 - f["su"])
            dh = f["w"][:, None] * dz[bag] + dtv @ net.v.T + dsu @ net.u.T
            grads = [x.T @ (dh * (1 - f["h"] ** 2)), f["h"].T @ dtv, f["h"].T @ dsu, (f["tv"] * f["su"]).T @ ds, f["z"].T @ dl, np.array([dl.sum()])]
            step += 1
            for k, g in enumerate(grads):
                g = g + 1e-4 * par[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                par[k] = par[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Attention(*par[:5], float(par[5][0]))


def score(docs: DataFrame, model: Attention, passage: int = 64) -> DataFrame:
    """(doc_id, score, passages, focus): focus is the passage with the largest attention, from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, maker = shared.value, Passages(passage)
        for b in batches:
            p, k, at = [], [], []
            for text in strings(b):
                x = maker.describe(text)
                s, w = model.score(x)
                p.append(s)
                k.append(len(x))
                at.append(int(w.argmax()))
            yield pa.record_batch([col(b, "doc_id"), pa.array(p, pa.float64()), pa.array(k, pa.int64()), pa.array(at, pa.int64())], ["doc_id", "score", "passages", "focus"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, passages long, focus long")


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, passage: int = 64) -> Attention:
    """Fit on at most ``rows`` labelled documents outside fold 1 of 3."""
    maker = Passages(passage)
    known = labelled_texts(docs, labels, "quality", rows, 3, 1)
    return fit([maker.describe(t) for _, t, _ in known], [y for *_, y in known])
