"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, anything that is not a letter becomes a space, and 1-, 2- and 3-grams of
characters are hashed to ``dim`` features with log-scaled counts, inverse document frequencies over
all documents of the learning folds, and unit length. The weights are fitted online by
follow-the-regularised-leader (proximal, per-coordinate rates) with an elastic-net penalty, on a
bounded sample that has every language; a temperature fitted on rows kept out of it calibrates the
probabilities.

Null texts and texts without letters are ``und`` with score 0. Documents with a null language teach
nothing. Repeated rows get repeated results. With no language to learn every text is ``und``.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fold, fold_col, keep_rows, only, strings

DIM = 1 << 14
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Of every character: 2 a letter, 1 a mark (part of a word, but no letter), 0 neither."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(sys.maxunicode + 1)), np.int8, sys.maxunicode + 1)
    return _LETTER


def counts(text: str, dim: int = DIM) -> np.ndarray | None:
    """Hashed 1- to 3-gram counts of the whole text; None without a letter."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[x]
    if not (letter == 2).any():
        return None
    x = np.where(letter > 0, x, np.uint32(32))
    x = np.concatenate([[np.uint32(32)], x, [np.uint32(32)]]).astype(np.uint64)
    keep = (x[1:] != 32) | (x[:-1] != 32)  # one space between words
    x = x[np.append(True, keep)]
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        one = (x + np.uint64(1)) * a
        two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * b + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * b + one[2:]
        grams = np.concatenate([one * b, two * b, three * b]) >> np.uint64(64 - dim.bit_length() + 1)
    return np.bincount(grams.astype(np.int64), minlength=dim)


def sum_counts(parts: DataFrame) -> DataFrame:
    """Rows (part, counts: compressed int64 vector) summed by part, streaming over each part's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(col(b, "part").to_pylist(), col(b, "counts").to_pylist()):
                x = np.frombuffer(zlib.decompress(data), np.int64)
                now[part] = now[part] + x if part in now else x
        if now:
            yield pa.record_batch([pa.array(list(now), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in now.values()])], ["part", "counts"])

    return parts.repartition("part").mapInArrow(run, "part int, counts binary")


def document_frequencies(docs: DataFrame, dim: int = DIM, parts: int = 8) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram occurs, and how many texts have letters; over all rows."""
    size = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(dim, np.int64), 0
        for b in batches:
            for text in strings(b):
                c = counts(text, dim)
                if c is not None:
                    seen += c > 0
                    n += 1
        rows = [seen[k * size : (k + 1) * size] for k in range(parts)] + [np.array([n], np.int64)]
        yield pa.record_batch([pa.array(range(parts + 1), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in rows])], ["part", "counts"])

    rows = {r.part: np.frombuffer(zlib.decompress(r.counts), np.int64) for r in sum_counts(docs.select("text").mapInArrow(run, "part int, counts binary")).collect()}
    if not rows:
        return np.zeros(dim, np.int64), 0
    return np.concatenate([rows[k] for k in range(parts)]), int(rows[parts][0])


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (dim + 1, languages), mostly zero
    temperature: float = 1.0

    def vector(self, text: str) -> np.ndarray | None:
        c = counts(text, len(self.idf))
        if c is None:
            return None
        x = np.zeros(len(c) + 1)
        at = np.flatnonzero(c)
        x[at] = np.log1p(c[at]) * self.idf[at]
        x /= max(np.sqrt(x @ x), 1e-12)
        x[-1] = 0.2
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights) / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)

    def predict(self, text: str) -> tuple[str, float]:
        x = self.vector(text) if self.langs else None
        if x is None:
            return "und", 0.0
        p = self.probabilities(x)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int, langs: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> np.ndarray:
    """Follow-the-regularised-leader on sparse rows (features, values, class)."""
    z, n = np.zeros((dim, langs)), np.zeros((dim, langs))

    def leader(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = leader(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            nn = n[at]
            z[at] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha * w
            n[at] = nn + g * g
    return leader(np.arange(dim))


def train(docs: DataFrame, per_language: int = 600, dim: int = DIM) -> LanguageModel:
    """Learn from documents outside fold 0 of 5 that have a language.

    ``per_language`` bounds the sampled rows of each language (about, and never above twice that; chosen by a
    hash of the row, so that rows of one id or of none are not chosen together; the same text of one id is).
    Document frequencies cover all documents of the learning folds.
    """
    own = only(docs, doc_id="long", text="string", lang="string")
    own = own.where((fold_col(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in own.where("text is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    df, total = document_frequencies(own, dim)
    idf = np.log((1 + total) / (1 + df)) + 0.05
    if not langs:
        return LanguageModel([], idf, np.zeros((dim + 1, 0)))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / sizes[k]))])
    picked = own.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    picked = picked.limit(2 * per_language * len(langs))
    model = LanguageModel(langs, idf, np.zeros((dim + 1, len(langs))))
    fit_rows, held = [], []
    for r in sorted(picked.select("doc_id", "text", "lang").toLocalIterator(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()[::-1]), r.lang, r.text or "")):
        x = model.vector(r.text or "")
        if x is not None:
            at = np.flatnonzero(x)
            (held if len(fit_rows) > 8 * len(held) + 8 else fit_rows).append((at, x[at], langs.index(r.lang)))
    model.weights = ftrl(fit_rows, dim + 1, len(langs))
    if held:
        logits = np.array([x @ model.weights[at] for at, x, _ in held])
        y = np.array([k for *_, k in held])

        def loss(t: float) -> float:
            s = logits / t
            top = s.max(1)
            return float(np.mean(np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(y)), y]))

        model.temperature = min(np.geomspace(0.05, 5, 80), key=loss)
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            got = [model.predict(t) for t in strings(b)]
            yield pa.record_batch([col(b, "doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """Rows with an identified language and at least this probability, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decider():
        def keep(text: str) -> bool:
            lang, score = shared.value.predict(text)
            return lang != "und" and score >= least

        return keep

    return keep_rows(docs, decider)


__all__ = ["LanguageModel", "counts", "document_frequencies", "fold", "ftrl", "identify", "keep_identified", "sum_counts", "train"]
