"""Shared helpers: scratch tables in the cluster's checkpoint folder, hashing, folds, components."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelab.sources.scratch import Scratch


def fold(doc_id: int | None, parts: int) -> int:
    """crc32 of the id as text, modulo parts; a null id counts as the empty string."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def fold_col(col, parts: int):
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % parts


def only(df: DataFrame, **cols: str) -> DataFrame:
    """Just the named input columns, cast; extra columns and their names never matter later."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in cols.items()])


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def keep_rows(docs: DataFrame, decider) -> DataFrame:
    """Rows of ``docs`` whose text the decider keeps; all columns stay and nothing is shuffled.

    ``decider()`` is called once in a task and gives a function from a text to true or false.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = decider()
        for b in batches:
            yield b.filter(pa.array([keep(t) for t in strings(b)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def col(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


# ---------------------------------------------------------------- hashing

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased, in numpy only.

    A word is hashed as a polynomial in its position with a random value for each byte; one pass
    over the bytes, no Python object for each word.
    """

    def __init__(self, seed: int = 977):
        rng = np.random.default_rng(seed)
        lut = rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
        lut[65:91] = lut[97:123]
        self.sep = np.zeros(256, bool)
        self.sep[[0x20, *range(0x09, 0x0E)]] = True
        lut[self.sep] = 0
        self.lut = lut
        self._grow(1 << 15)

    def _grow(self, n: int) -> None:
        r = 0x9E3779B97F4A7C15
        ri = pow(r, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.pow = np.cumprod(np.full(n, r, np.uint64))
            self.inv = np.cumprod(np.full(n, ri, np.uint64))

    def words(self, text: str) -> np.ndarray:
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if not len(b):
            return np.empty(0, np.uint64)
        if len(b) > len(self.pow):
            self._grow(1 << int(len(b)).bit_length())
        w = ~self.sep[b]
        first = w.copy()
        first[1:] &= ~w[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            h = self.lut[b] * self.pow[: len(b)]
            return mix64(np.add.reduceat(h, starts) * self.inv[starts])


_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle; no words, none."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < k:
            h = _U(n)
            for x in words:
                h = mix64((h + x) * _C[0])
            return np.array([h], np.uint64)
        m = n - k + 1
        acc = np.zeros(m, np.uint64)
        for j in range(k):
            acc += words[j : j + m] * (_C[j % 5] + _U(2 * (j // 5)))
        acc = np.sort(mix64(acc))
        return acc[np.append(True, acc[1:] != acc[:-1])]


# ------------------------------------------------------------- components


def _stars(batches: Iterator[pa.RecordBatch], block: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Each block of links becomes a spanning star for each of its components (bounded memory)."""

    def flush(a: list, b: list) -> pa.RecordBatch:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for x, y in zip(a, b):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        pairs = [(find(x), x) for x in list(root)]
        pairs = [(x, y) for x, y in pairs if x != y]
        return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    a: list = []
    b: list = []
    for batch in batches:
        a += col(batch, "a").to_pylist()
        b += col(batch, "b").to_pylist()
        if len(a) >= block:
            yield flush(a, b)
            a, b = [], []
    if a:
        yield flush(a, b)


def salted(left: DataFrame, right: DataFrame, on: str, by: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join on a key that many rows of ``left`` may share: its rows are dealt by ``by`` as well, and
    ``right``, one row a key, is repeated ``salts`` times."""
    right = right.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(right, [on, "_salt"], how).drop("_salt")


def components(links: DataFrame, scratch: Scratch, block: int = 200_000) -> DataFrame:
    """Connected components of links (a, b): (node, comp), comp one of the nodes, the same for all.

    Every task first replaces its links by spanning stars. A round then points every node to its
    smallest neighbour and contracts the links to those; again stars, until no link is left. Each
    round is a few hash joins and an aggregation, written to the shared folder; a node with very
    many links is dealt to several tasks. Nodes should be hashes and are compared by their lower
    half first: a chain in order of its nodes would take many rounds. Nodes without links are left
    out.
    """

    def stars(df: DataFrame) -> DataFrame:
        return scratch.save(df.mapInArrow(lambda batches: _stars(batches, block), "a long, b long"), "stars")

    def swapped(c: str):
        return F.shiftleft(c, 32).bitwiseOR(F.shiftrightunsigned(c, 32)).alias(c)

    e = stars(links.where("a <> b").select(swapped("a"), swapped("b")))
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = None
    while True:
        up = scratch.save(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "up")
        if label is None:
            new = nodes.join(up, "node", "left").select("node", F.coalesce("up", "node").alias("comp"))
        else:
            used = label.select(F.col("comp").alias("node")).distinct()
            hop = up.join(used, "node", "left_semi").withColumnRenamed("node", "comp")
            new = salted(label, hop, "comp", "node").select("node", F.coalesce("up", "comp").alias("comp"))
        new = scratch.save(new, "label")
        # both ends of each link move up; a star's centre may be hot, its leaves are not
        moved = e.join(up.select(F.col("node").alias("b"), F.col("up").alias("x")), "b")
        centres = up.join(e.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
        moved = salted(moved, centres.select(F.col("node").alias("a"), "up"), "a", "b").select("x", F.coalesce("up", "a").alias("y")).where("x <> y")
        left = stars(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        scratch.drop(e, up, *([] if label is None else [label]))
        e, label = left, new
        if not e.limit(1).count():
            scratch.drop(e)
            return label.select(swapped("node"), swapped("comp"))
