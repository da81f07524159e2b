"""Toxic spans by a linear-chain conditional random field; document scores from its marginals.

Fit (on a bounded sample of labelled rows). Token features: the word and its first 4, 5 and 6
letters, kept if they are much likelier in toxic documents; tokens of toxic documents that carry
such evidence are the positive token labels. The CRF's weights are fitted by the gradient of the
conditional likelihood on windows of tokens around all evidence of the sample (forward-backward, a
batch of windows at once), and a logistic
layer maps summed and largest marginals to a document score.

Scoring. A token without evidence has one constant potential, so a run of such tokens acts as a
power of one 2x2 matrix: forward-backward runs exactly over the tokens with evidence, with powers
between them. Every token of the whole text counts.

Null and empty texts have no tokens and get the score of a document without evidence. Repeated rows
get repeated results. Without labelled rows every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, fold, keep_rows, only, strings
from .sample import labelled_texts

_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_TOKEN = re.compile(r"\S+")


def features(token: str) -> tuple[str, ...]:
    w = token.lower()
    if not w.isalpha():
        w = _EDGE.sub("", w)
    if len(w) < 2:
        return ()
    return (w, *(f"{w[:k]}~" for k in (4, 5, 6) if len(w) > k))


@dataclass
class ToxicModel:
    weight: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    layer: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def __post_init__(self):
        step = np.exp(self.trans) * np.exp(np.array([0.0, self.bias]))[None, :]
        powers, now = [np.eye(2)], np.eye(2)
        for _ in range(512):  # beyond, a power has reached its limit direction in double precision
            now = now @ step
            now = now / now.sum()
            powers.append(now)
        self.powers = [p.ravel().tolist() for p in powers]

    def evidence(self, token: str) -> float:
        return sum(self.weight.get(f, 0.0) for f in features(token))

    def marginals(self, at: list[int], score: list[float], n: int) -> list[float]:
        """P(toxic) of the tokens with evidence, at positions ``at`` of ``n``."""
        trans, powers = np.exp(self.trans), self.powers
        t00, t01, t10, t11 = trans.ravel().tolist()
        last = len(powers) - 1
        e0 = math.exp(self.bias)
        fwd, f0, f1, before = [], 1.0, 1.0, -1
        for p, s in zip(at, score):
            gap = p - before - 1
            if gap:
                a, b, c, d = powers[min(gap, last)]
                if before < 0:  # the first token has no transition into it
                    f0, f1 = 1.0, e0
                    a, b, c, d = powers[min(gap - 1, last)]
                f0, f1 = f0 * a + f1 * c, f0 * b + f1 * d
            if p:
                f0, f1 = f0 * t00 + f1 * t10, f0 * t01 + f1 * t11
            else:
                f0, f1 = 1.0, 1.0
            f1 *= math.exp(min(60.0, self.bias + s))
            total = f0 + f1
            f0, f1 = f0 / total, f1 / total
            fwd.append((f0, f1))
            before = p
        out, b0, b1, after = [0.0] * len(at), 1.0, 1.0, n
        carried = (0.0, 0.0)
        for i in range(len(at) - 1, -1, -1):
            gap = after - at[i] - 1
            if after < n:  # from the token after: its potential, then the transition into it
                x0, x1 = carried
                b0, b1 = t00 * x0 + t01 * x1, t10 * x0 + t11 * x1
            if gap:
                a, b, c, d = powers[min(gap, last)]
                b0, b1 = a * b0 + b * b1, c * b0 + d * b1
            total = b0 + b1
            b0, b1 = b0 / total, b1 / total
            p0, p1 = fwd[i][0] * b0, fwd[i][1] * b1
            out[i] = p1 / (p0 + p1)
            carried = (b0, b1 * math.exp(min(60.0, self.bias + score[i])))
            after = at[i]
        return out

    def score(self, marginals: list[float]) -> float:
        c, a, b = self.layer
        z = c + a * math.log1p(sum(marginals)) + b * max(marginals, default=0.0)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def _fit_crf(xs: np.ndarray, ys: np.ndarray, mask: np.ndarray, n: int, steps: int, l2: float, batch: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Adam on the mean conditional log-likelihood; xs: feature ids (N, T, F), n for none. Each step
    takes the next ``batch`` windows of a random order; at least every window is taken once."""
    w, bias, trans = np.zeros(n + 1), -2.0, np.zeros((2, 2))
    theta = np.concatenate([w, [bias], trans.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    every = xs, ys, mask
    order, rng = np.random.default_rng(6).permutation(len(ys)), np.random.default_rng(7)
    size = min(batch, len(ys))
    for it in range(1, max(steps, -(-len(ys) // size)) + 1):
        if size < len(ys):
            if len(order) < size:
                order = np.append(order, rng.permutation(len(ys)))
            pick, order = order[:size], order[size:]
            xs, ys, mask = (v[pick] for v in every)
        rows, length = ys.shape
        w, bias, trans = theta[: n + 1], theta[n + 1], theta[n + 2 :].reshape(2, 2)
        unary = np.zeros((rows, length, 2))
        unary[..., 1] = w[xs].sum(-1) + bias
        e, t = np.exp(np.clip(unary, -50, 50)), np.exp(trans)
        f, b = np.ones_like(e), np.ones_like(e)
        f[:, 0] = e[:, 0]
        f[:, 0] /= f[:, 0].sum(-1, keepdims=True)
        for k in range(1, length):
            x = (f[:, k - 1] @ t) * e[:, k]
            f[:, k] = np.where(mask[:, k, None], x / x.sum(-1, keepdims=True), f[:, k - 1])
        for k in range(length - 2, -1, -1):
            x = (b[:, k + 1] * e[:, k + 1]) @ t.T
            b[:, k] = np.where(mask[:, k + 1, None], x / x.sum(-1, keepdims=True), 1.0)
        p = f * b
        p /= p.sum(-1, keepdims=True)
        g1 = (ys - p[..., 1]) * mask
        pair = f[:, :-1, :, None] * t[None, None] * (e * b)[:, 1:, None, :]
        pair = pair / pair.sum((-1, -2), keepdims=True) * mask[:, 1:, None, None]
        gold = np.zeros((2, 2))
        np.add.at(gold, (ys[:, :-1][mask[:, 1:]], ys[:, 1:][mask[:, 1:]]), 1)
        grad = np.concatenate([np.bincount(xs.ravel(), np.repeat(g1.ravel(), xs.shape[-1]), n + 1), [g1.sum()], (gold - pair.sum((0, 1))).ravel()]) / rows
        grad[n] = 0
        grad -= l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
        theta[n] = 0
    return theta[: n + 1], float(theta[n + 1]), theta[n + 2 :].reshape(2, 2)


def fit(rows: list[tuple[int, str, int]], window: int = 12, steps: int = 120, l2: float = 1e-4, min_docs: int = 3, batch: int = 12_000) -> ToxicModel:
    """A model from (doc_id, text, toxic) rows."""
    bad = sum(y for *_, y in rows)
    if not bad or bad == len(rows):
        return ToxicModel()
    tokens = [(text.split(), y) for _, text, y in rows]
    seen: Counter = Counter()
    toxic: Counter = Counter()
    for words, y in tokens:
        found = {f for w in set(words) for f in features(w)}
        seen.update(found)
        if y:
            toxic.update(found)
    base = bad / len(rows)

    def odds(f: str) -> float:
        return math.log((toxic[f] + base) / (seen[f] - toxic[f] + 1 - base))

    # evidence: in few clean documents; a prefix must be clearer than chance among rare prefixes
    strong = {f for f, k in toxic.items() if k >= min_docs and odds(f) > 0.7 + (0.8 if k < 6 else 0.0)}
    index = {f: i for i, f in enumerate(sorted(strong))}
    n = len(index)
    if not n:
        return ToxicModel()
    known: dict[str, tuple[int, ...]] = {}

    def ids(word: str) -> tuple[int, ...]:
        got = known.get(word)
        if got is None:
            got = known[word] = tuple(index[f] for f in features(word) if f in index)
        return got

    xs, ys, mask = [], [], []
    rng = np.random.default_rng(5)
    for words, y in tokens:
        at = [i for i, w in enumerate(words) if ids(w)]
        starts = {int(rng.integers(len(words)))} if words else set()
        after = -1  # windows around all evidence; evidence that stands in the last one needs no other
        for i in at:
            if i >= after:
                starts.add(max(0, i - window // 2))
                after = max(0, i - window // 2) + window
        for s in starts:
            part = words[s : s + window]
            pad = window - len(part)
            feats = [(ids(w) + (n, n, n, n))[:4] for w in part] + [(n, n, n, n)] * pad
            xs.append(feats)
            ys.append([int(y and bool(ids(w))) for w in part] + [0] * pad)
            mask.append([True] * len(part) + [False] * pad)
    w, bias, trans = _fit_crf(np.array(xs), np.array(ys), np.array(mask), n, steps, l2, batch)
    model = ToxicModel({f: float(w[i]) for f, i in index.items()}, bias, trans)
    sums, tops, label = [], [], []
    for words, y in tokens:
        at = [i for i, x in enumerate(words) if ids(x)]
        p = model.marginals(at, [model.evidence(words[i]) for i in at], len(words))
        sums.append(math.log1p(sum(p)))
        tops.append(max(p, default=0.0))
        label.append(y)
    x, y = np.stack([np.ones(len(sums)), sums, tops], 1), np.array(label, float)
    layer = np.zeros(3)
    for _ in range(50):  # Newton steps with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ layer, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-2])
        layer = layer + np.linalg.solve(h, x.T @ (y - q) - np.array([1e-3, 1e-2, 1e-2]) * layer)
    return ToxicModel(model.weight, model.bias, model.trans, tuple(map(float, layer)))


class _Evidence(dict):
    def __init__(self, model: ToxicModel, size: int = 300_000):
        super().__init__()
        self.model, self.size = model, size

    def __missing__(self, token: str) -> float:
        got = self.model.evidence(token)
        if len(self) >= self.size:
            self.clear()
        self[token] = got
        return got


def tag(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score, spans): toxic spans as start and end (exclusive) in code points."""
    kept = {f: w for f, w in model.weight.items() if w}
    model = ToxicModel(kept, model.bias, model.trans, model.layer)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        evidence = _Evidence(model)
        clean = model.score([])
        for b in batches:
            scores, spans = [], []
            for text in strings(b):
                each = list(map(evidence.__getitem__, text.split()))
                if not any(each):
                    scores.append(clean)
                    spans.append([])
                    continue
                at = [i for i, s in enumerate(each) if s]
                p = model.marginals(at, [each[i] for i in at], len(each))
                scores.append(model.score(p))
                hit = {i for i, q in zip(at, p) if q >= 0.5}
                spans.append([{"start": m.start(), "end": m.end()} for i, m in enumerate(_TOKEN.finditer(text)) if i in hit] if hit else [])
            yield pa.record_batch([col(b, "doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], ["doc_id", "score", "spans"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long>>")


def keep_clean(docs: DataFrame, model: ToxicModel, below: float = 0.7) -> DataFrame:
    """Rows that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decider():
        model, evidence = shared.value, _Evidence(shared.value)

        def keep(text: str) -> bool:
            each = list(map(evidence.__getitem__, text.split()))
            at = [i for i, s in enumerate(each) if s]
            return model.score(model.marginals(at, [each[i] for i in at], len(each))) < below

        return keep

    return keep_rows(docs, decider)


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> ToxicModel:
    """Fit on at most ``rows`` labelled documents outside fold 1 of 3."""
    return fit(labelled_texts(docs, labels, "toxic", rows, 3, 1))


__all__ = ["ToxicModel", "features", "fit", "fold", "keep_clean", "tag", "train"]
