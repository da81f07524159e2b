"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns find base spans in linear time. The CRF then labels *units* (number-like runs and
tokens with ``@``): neighbouring units form a chain, and units of a document with the same digits or
the same lower-cased text, however distant, are joined by skip edges. All weights, those of the skip
edges too, are fitted by pseudo-likelihood on a bounded sample: its labels are the base spans, and
some of them are repeated in the sample's texts in other spellings. Loopy message passing with
base units held fixed carries an entity's label to its other spellings (a phone number without its
``+``, a card number with dots), which become further spans; base spans always stay.

Other tokens have no label but ``outside`` and would only pass on constants, so they are not nodes.
A unit's repeats are joined to the next repeat and to the first, never all pairs.

Base spans of several kinds that overlap are one unit, with the label of the one that starts first (ties: the
first kind); all of them stay spans. Null texts count as empty: no spans. Repeated rows get repeated results; ids may be null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, only, strings

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9])[0-9](?:[\x20().-]{0,2}[0-9]){6,}+")
_BESIDE = re.compile(r"[\s@]")
_DIGIT = re.compile(r"[0-9]")
_WORD_BEFORE = re.compile(r"(\S+)\s*$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, looking only around each ``@``."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if len(m[0]) >= 13:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


# ------------------------------------------------------------------- units

_FEATURES = 128


@dataclass
class Units:
    spans: list[tuple[int, int]]
    features: list[list[int]]
    keys: list[str]
    label: list[int]  # 0 outside, 1.. kinds: of the base span that the unit holds, else 0
    base: list[bool]


def _loose(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Number-like runs and tokens with ``@`` in a stretch without base spans, in linear time."""
    for m in _NUMBER.finditer(text, start, end):
        yield m.span()
    at, done = text.find("@", start, end), start
    while at >= 0:
        s = at
        while s > done and not text[s - 1].isspace() and text[s - 1] != "@":
            s -= 1
        m = _BESIDE.search(text, at + 1, end)
        done = m.start() if m else end
        if done - s > 2:
            yield s, done
        at = text.find("@", max(done, at + 1), end)


def units(text: str, base: dict[str, list[tuple[int, int]]]) -> Units:
    out = Units([], [], [], [], [])
    fixed: list[tuple[int, int, int]] = []
    for s, e, k in sorted((s, e, k + 1) for k, kind in enumerate(KINDS) for s, e in base[kind]):
        if not fixed or s >= fixed[-1][1]:  # one unit for base spans of several kinds that overlap
            fixed.append((s, e, k))
    found, at = [], 0
    for s, e, k in [*fixed, (len(text), len(text), 0)]:
        if s > at:
            found += [(a, b, 0) for a, b in sorted(set(_loose(text, at, s)))]
        if k:
            found.append((s, e, k))
        at = max(at, e)
    for s, e, k in found:
        word = text[s:e]
        digits = re.sub(r"[^0-9]", "", word)
        if "@" in word:
            f = [0, 1 + ("." in word.partition("@")[2]), 3 + (len(word) > 6)]
            key = word.strip(".,;:!?()").lower()
        else:
            n = len(digits)
            parts = re.findall(r"[0-9]+", word)
            f = [8 + min(n, 20), 32 + min(len(parts), 8), 44 + luhn(digits), 48 + (word.count(".") == 3 and len(parts) == 4), 52 + ("(" in word), 56 + ("-" in word), 60 + (word[0] == "+")]
            f.append(64 + (len(parts[0]) * 7 + len(parts[-1])) % 32)
            key = digits
        before = _WORD_BEFORE.search(text, max(0, s - 24), s)
        f.append(96 + (sum(map(ord, before[1].lower())) % 31 if before else 31))
        out.spans.append((s, e))
        out.features.append(f)
        out.keys.append(key)
        out.label.append(k)
        out.base.append(bool(k))
    return out


def skips(keys: list[str]) -> list[tuple[int, int]]:
    """Edges between units with one key, or one's last ten digits: to the next and to the first."""
    out: set[tuple[int, int]] = set()
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for i, k in enumerate(keys):
        for name in {k, k[-10:] if len(k) >= 10 and k.isdigit() else k}:
            if name in last:
                out.add((last[name], i))
                out.add((first[name], i))
            first.setdefault(name, i)
            last[name] = i
    return sorted(out)


@dataclass
class SkipChain:
    node: np.ndarray = field(default_factory=lambda: np.zeros((_FEATURES, 5)))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((5, 5)))
    skip: np.ndarray = field(default_factory=lambda: np.eye(5) * 3.0)

    def infer(self, u: Units, rounds: int = 8) -> np.ndarray:
        """Marginals of the units by damped loopy sum-product; base units are observed."""
        n = len(u.spans)
        unary = np.array([self.node[f].sum(0) for f in u.features])
        for i, fixed in enumerate(u.base):
            if fixed:
                unary[i] = -40.0
                unary[i, u.label[i]] = 0.0
        pairs = [(i, i + 1, 0) for i in range(n - 1) if u.spans[i + 1][0] - u.spans[i][1] <= 60] + [(a, b, 1) for a, b in skips(u.keys)]
        if pairs:
            a, b, kind = (np.array(x) for x in zip(*pairs))
            pot = np.exp(np.stack([self.chain, self.skip]))
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            mat = np.concatenate([pot[kind], pot[kind].transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            msg = np.zeros((len(src), 5))
            for _ in range(rounds):
                belief = unary.copy()
                np.add.at(belief, dst, msg)
                out = belief[src] - msg[back]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.log(np.einsum("ei,eij->ej", out, mat) + 1e-300)
                msg = 0.5 * msg + 0.5 * (new - new.max(1, keepdims=True))
            np.add.at(unary, dst, msg)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def respelled(kind: str, word: str, way: int) -> str | None:
    """Another spelling of a phone or card number, one of a few ways, that no pattern knows."""
    d = re.sub(r"[^0-9]", "", word)
    if kind == "phone":
        return [f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", d][way % 4] if 10 <= len(d) < 13 else d
    return ".".join(re.findall("[0-9]{1,4}", d)) if kind == "card" else None


def taught(text: str, turn: int = 0) -> Units:
    """The units of a text, base ones labelled. At its end its phone and card numbers stand once more
    in other spellings, with their label, and after each a number of the same shape but of other
    digits, which is nobody's: only the skip edge tells the two apart. A token with ``@`` that is no
    address is nobody's either."""
    base = base_spans(text)
    known: dict[int, int] = {}
    for k, kind in enumerate(KINDS):
        for s, e in base[kind][:3]:
            word = respelled(kind, text[s:e], turn + len(known))
            if kind == "email":
                pairs = [(0, text[s:e].partition("@")[0] + "@" + text[s:e].partition("@")[2].partition(".")[0])]
            elif word:
                other = "".join(str((int(c) + 3 + 4 * (i % 2)) % 10) if c.isdigit() else c for i, c in enumerate(word))
                pairs = [(k + 1, word), (0, other)]
            else:
                pairs = []
            for label, w in pairs:
                text += f" .{' ' * 64}{'w' * (1 + (turn + 7 * len(known)) % 31)} "  # no chain edge; any word before
                known[len(text) + (w[0] == "(")] = label
                text += w
    text += " ."
    again = base_spans(text)
    u = units(text, {kind: [x for x in again[kind] if not {x[0], x[0] + 1} & set(known)] for kind in KINDS})
    for i, (s, _) in enumerate(u.spans):
        if s in known:
            u.label[i], u.base[i] = known[s], True
    return u


def fit(texts: list[str], steps: int = 300, l2: float = 1e-4) -> SkipChain:
    """Pseudo-likelihood on base labels and their taught repeats; a plus sign is hidden from every
    second unit, and other units that only look like a base unit of their document are left out, as
    their label isn't known."""
    feats, label, use, left, right, skip = [], [], [], [], [], []
    for turn, text in enumerate(texts):
        u = taught(text, turn)
        at = len(label)
        n = len(u.spans)
        near = [u.spans[i + 1][0] - u.spans[i][1] <= 60 for i in range(n - 1)]
        known = {k for k, b in zip(u.keys, u.base) if b} | {k[-10:] for k, b in zip(u.keys, u.base) if b and k.isdigit()}
        partner = dict(skips(u.keys)) | {b: a for a, b in skips(u.keys)}
        for i in range(n):
            f = [x for x in u.features[i] if x != 61 or (at + i) % 2]
            feats.append((f + [_FEATURES] * 10)[:10])
            label.append(u.label[i])
            use.append(u.base[i] or not ({u.keys[i], u.keys[i][-10:]} & known))
            left.append(at + i - 1 if i and near[i - 1] else -1)
            right.append(at + i + 1 if i < n - 1 and near[i] else -1)
            skip.append(at + partner[i] if i in partner else -1)
    model = SkipChain()
    if not label:
        return model
    x, y, on = np.array(feats), np.array(label), np.array(use, float)
    y1 = np.append(y, 0)
    have = [(np.array(v) >= 0).astype(float)[:, None] for v in (left, right, skip)]
    yl, yr, ys = (y1[np.array(v)] for v in (left, right, skip))
    shapes = [(_FEATURES + 1, 5), (5, 5), (5, 5)]
    par = [np.zeros(s) for s in shapes]
    par[2] += np.eye(5)
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    gold = np.eye(5)[y]
    for it in range(1, steps + 1):
        w, c, k = par
        s = w[x].sum(1) + have[0] * c[yl] + have[1] * c[:, yr].T + have[2] * (k[ys] + k[:, ys].T) / 2
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (gold - p) * on[:, None]
        gw, gc, gk = (np.zeros(s) for s in shapes)
        np.add.at(gw, x.ravel(), np.repeat(g, x.shape[1], 0))
        np.add.at(gc, yl, g * have[0])
        np.add.at(gc.T, yr, g * have[1])
        np.add.at(gk, ys, g * have[2] / 2)
        np.add.at(gk.T, ys, g * have[2] / 2)
        for j, grad in enumerate((gw, gc, gk)):
            grad = grad / len(y) - l2 * par[j] / 10
            m[j], v[j] = 0.9 * m[j] + 0.1 * grad, 0.99 * v[j] + 0.01 * grad**2
            par[j] = par[j] + 0.1 * (m[j] / (1 - 0.9**it)) / (np.sqrt(v[j] / (1 - 0.99**it)) + 1e-8)
        par[0][_FEATURES] = 0
    return SkipChain(par[0][:_FEATURES], par[1], (par[2] + par[2].T) / 2)


def train(docs: DataFrame, rows: int = 4000) -> SkipChain:
    """Fit on about ``rows`` documents that hold a digit or ``@`` (never above twice that), chosen by
    a hash of the row: no more than these reach the driver, whatever the number of tasks."""
    own = only(docs, doc_id="long", text="string").where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, rows / max(1, own.count()))
    picked = own.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    return fit(sorted(r.text for r in picked.select("text").limit(2 * rows).collect()))


def find(text: str, model: SkipChain, least: float = 0.8) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base, all) spans by kind."""
    base = base_spans(text)
    every = {k: list(v) for k, v in base.items()}
    if not any(base.values()) and "@" not in text and not _DIGIT.search(text):
        return base, every
    u = units(text, base)
    if not all(u.base):
        p = model.infer(u)
        for i, fixed in enumerate(u.base):
            k = int(p[i].argmax())
            if not fixed and k and p[i, k] >= least:
                every[KINDS[k - 1]].append(u.spans[i])
        for v in every.values():
            v.sort()
    return base, every


def _join(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def detect(docs: DataFrame, model: SkipChain) -> DataFrame:
    """Counts, base digest and all spans of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            counts, digest, spans = [[] for _ in KINDS], [], []
            for text in strings(b):
                base, every = find(text, model)
                for c, k in zip(counts, KINDS):
                    c.append(len(base[k]))
                digest.append(hashlib.sha256(_join(base).encode()).hexdigest())
                spans.append(_join(every))
            yield pa.record_batch(
                [col(b, "doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are one."""
    flat = sorted((s, e, k) for k, v in spans.items() for s, e in v)
    out, at = [], 0
    for s, e, k in flat:
        if s >= at:
            out += [text[at:s], f"[{k}]"]
            at = e
        elif e > at:
            at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SkipChain) -> DataFrame:
    """The rows of ``docs`` with personal data masked in ``text``; all columns stay. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            i = b.schema.get_field_index("text")
            texts = [None if t is None else mask(t, find(t, model)[1]) for t in b.column(i).to_pylist()]
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    return docs.mapInArrow(run, schema)
