"""Language-model scores by a hierarchical Pitman-Yor process with Gibbs-sampled seating.

Model. Every token is seated in the restaurant of the word before it. Frequent words (at least ``share``
of all training tokens, so 1 / ``share`` of them at most, by exact counts over all tasks) have a
restaurant of their own; all other words share ``shared`` restaurants, each by a hash, so that no
context is left out and what tasks share stays bounded. A score doesn't depend on the partitioning. All restaurants have one parent, the
restaurant without context, whose base is uniform over the training words and one unknown word. The
first customer of a table is a customer of the parent.

Work. One shuffle deals (word, context, document) entries by word, so that a word's counts in all
restaurants meet in one task; words that are frequent themselves are dealt by word and context. What
tasks need of each other is the number of customers and tables of each restaurant and the counts of
the frequent words: a table of bounded size, summed by Spark after each sweep. A sweep re-seats all
customers given these totals: seats of (word, context) customers one by one (beyond 64 in blocks of
an eighth with a binomial number of new tables), the parent's in turn, several rounds in a task.
Seating is a function of the seed, so a lost task gives the same tables again, and predictive
probabilities are averaged over the last sweeps' seatings.

Null texts count as empty: one token, the end. Repeated rows get repeated results. An empty table
gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHasher, col, fold, mix64, only, strings

_END = np.uint64(0x1234567890ABCDEF)
_LOG10 = math.log(10)


def tokens(hasher: WordHasher, text: str) -> np.ndarray:
    return np.append(hasher.words(text), _END)


# --------------------------------------------------------------- frequent words


def _counts(docs: DataFrame, parts: int, held: int, block: int = 1_000_000) -> DataFrame:
    """(word, n): training counts of all words, whatever the partitioning; word null: all tokens. Words are
    counted in blocks of text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        kept: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            w, n = np.unique(np.concatenate(kept), return_counts=True)
            none = np.append(np.zeros(len(w), bool), True)
            return pa.record_batch([pa.array(np.append(w.view(np.int64), 0), pa.int64(), mask=none), pa.array(np.append(n, size).astype(np.int64))], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(col(b, "doc_id").to_pylist(), strings(b)):
                if fold(doc_id, parts) != held:
                    kept.append(tokens(hasher, text))
                    size += len(kept[-1])
                    if size >= block:
                        yield flush()
                        kept, size = [], 0
        if kept:
            yield flush()

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Plan:
    """What all tasks know: contexts and hot words (both bounded) and the number of buckets."""

    contexts: np.ndarray  # sorted hashes; context ids are positions + 1, 0 is none
    shared: int  # restaurants that all other words share, numbered after these
    hot: np.ndarray  # sorted hashes; hot ids are positions + 1
    buckets: int

    def context_ids(self, words: np.ndarray) -> np.ndarray:
        """Of the token before each; the first token follows the end of nothing."""
        before = np.append(_END, words[:-1])
        own = _lookup(self.contexts, before)
        if not self.shared:
            return own
        return np.where(own > 0, own, 1 + len(self.contexts) + (mix64(before) % np.uint64(self.shared)).astype(np.int64))


def _lookup(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), np.int64)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return np.where(table[at] == x, at + 1, 0)


# ------------------------------------------------------------------- dealing

_ENTRY = [("key", "<u8"), ("hot", "<u2"), ("ctx", "<u2"), ("doc", "<u4"), ("n", "<u4")]


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _deal(docs: DataFrame, plan, parts: int, held: int, block: int = 1_000_000) -> DataFrame:
    """Entries by bucket, packed, a row for each bucket and block of text; the block's documents too.

    A document is known by its block and its place there, twice the place plus one if held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, p = WordHasher(), plan.value
        context = TaskContext.get()
        now = (context.partitionId() if context else 0) << 20
        ws: list[np.ndarray] = []
        cs: list[np.ndarray] = []
        ids: list[int | None] = []
        flags: list[bool] = []
        size = 0

        def flush() -> pa.RecordBatch:
            w, c = np.concatenate(ws), np.concatenate(cs).astype(np.uint64)
            lengths = [len(x) for x in ws]
            doc = np.repeat(np.arange(len(ws), dtype=np.uint64) * np.uint64(2) + np.array(flags, np.uint64), lengths)
            hot = _lookup(p.hot, w)
            key = np.where(hot > 0, mix64(w + c * np.uint64(0x9E3779B97F4A7C15)), w)
            low = (c << np.uint64(32)) | doc
            order = np.lexsort((low, key))
            key, low, hot = key[order], low[order], hot[order]
            new = np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]))
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(key)))
            key, low, hot = key[at], low[at], hot[at]
            bucket = ((key >> np.uint64(33)) * np.uint64(p.buckets)) >> np.uint64(31)
            cut = np.searchsorted(bucket, np.arange(p.buckets + 1))
            rows = []
            for k in range(p.buckets):
                s = slice(cut[k], cut[k + 1])
                if s.stop > s.start:
                    rest = zlib.compress(b"".join([hot[s].astype("<u2").tobytes(), (low[s] >> np.uint64(32)).astype("<u2").tobytes(), low[s].astype("<u4").tobytes(), n[s].astype("<u4").tobytes()]), 1)
                    rows.append((k, now, int(s.stop - s.start), key[s].astype("<u8").tobytes(), rest))
            where = np.array([-1 if i is None else i for i in ids], "<i8")
            rows.append((-1, now, len(ids), where.tobytes(), _pack(np.array(lengths, "<u4"), np.array([i is None for i in ids], bool))))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["bucket", "block", "size", "keys", "rest"])

        for b in batches:
            for doc_id, text in zip(col(b, "doc_id").to_pylist(), strings(b)):
                w = tokens(hasher, text)
                ws.append(w)
                cs.append(p.context_ids(w))
                ids.append(doc_id)
                flags.append(fold(doc_id, parts) == held)
                size += len(w)
                if size >= block:
                    yield flush()
                    now += 1
                    ws, cs, ids, flags, size = [], [], [], [], 0
        if ws:
            yield flush()

    return docs.mapInArrow(run, "bucket int, block long, size long, keys binary, rest binary")


def _entries(size: int, keys: bytes, rest: bytes) -> tuple[np.ndarray, ...]:
    raw = zlib.decompress(rest)
    a, b, c = 2 * size, 4 * size, 8 * size
    return np.frombuffer(keys, "<u8"), np.frombuffer(raw[:a], "<u2"), np.frombuffer(raw[a:b], "<u2"), np.frombuffer(raw[b:c], "<u4"), np.frombuffer(raw[c:], "<u4")


def _gather(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's training counts, and each block's entries pointing into them.

    Words and (word, context) pairs get local numbers; pairs that training never saw have number -1.
    """
    got = [_entries(*r) for r in zip(rows["size"], rows["keys"], rows["rest"])]
    key, hot, ctx, doc, n = (np.concatenate(x) for x in zip(*got))
    sizes = rows["size"].to_numpy()
    order = np.lexsort((ctx, key))
    train = (doc & 1 == 0)[order]
    k, c = key[order], ctx[order]
    new_word = np.append(True, k[1:] != k[:-1])
    new_pair = new_word | np.append(True, c[1:] != c[:-1])
    word_of = np.cumsum(new_word) - 1
    pair_of = np.cumsum(new_pair) - 1
    pair_n = np.bincount(pair_of, np.where(train, n[order], 0)).astype(np.int64)
    pair_word = word_of[new_pair]
    pair_ctx = c[new_pair]
    word_hot = hot[order][new_word]
    back = np.empty(len(order), np.int64)
    back[order] = pair_of
    out = []
    base = rows["bucket"].iloc[0]
    out.append((base, -1, len(pair_n), _pack(pair_word.astype("<u4"), pair_ctx.astype("<u2"), pair_n.astype("<u4"), word_hot.astype("<u2"))))
    at = 0
    for size, block in zip(sizes, rows["block"]):
        s = slice(at, at + size)
        by_doc = np.argsort(doc[s], kind="stable")
        out.append((base, block, size, _pack(back[s][by_doc].astype("<u4"), doc[s][by_doc].astype("<u4"), n[s][by_doc].astype("<u4"))))
        at += size
    return pd.DataFrame(out, columns=["bucket", "block", "size", "data"])


# -------------------------------------------------------------------- seating


def seat(c: np.ndarray, rate: np.ndarray, d: float, rng: np.random.Generator, single: int = 64) -> np.ndarray:
    """Tables of ``c`` customers who all eat one dish; ``rate``: strength of opening a new table,
    (theta + d * tables) * base, against (customers - d * own tables) of joining one."""
    t = (c > 0).astype(np.int64)
    live = np.flatnonzero(c > 1)
    seated = 1
    while len(live):
        step = 1 if seated < single else max(1, seated // 8)
        m = np.minimum(c[live] - seated, step)
        p = rate[live] / (rate[live] + np.maximum(seated - d * t[live], 1e-9))
        t[live] += rng.random(len(live)) < p if step == 1 else rng.binomial(m, np.minimum(p, 1.0))
        seated += step
        live = live[c[live] > seated]
    return t


@dataclass
class State:
    """Totals that all tasks share; sized by the number of contexts and hot words only."""

    customers: np.ndarray  # of each context, position 0: of the parent
    tables: np.ndarray
    words: int  # distinct training words
    discount: tuple[float, float]  # contexts, parent
    theta: float
    hot_tokens: np.ndarray  # training count of each hot word
    hot_customers: np.ndarray  # its customers and tables in the parent
    hot_tables: np.ndarray


def _unpack(size: int, data: bytes) -> tuple[np.ndarray, ...]:
    raw = zlib.decompress(data)
    a, b, c = 4 * size, 6 * size, 10 * size
    return np.frombuffer(raw[:a], "<u4").astype(np.int64), np.frombuffer(raw[a:b], "<u2").astype(np.int64), np.frombuffer(raw[b:c], "<u4").astype(np.int64), np.frombuffer(raw[c:], "<u2").astype(np.int64)


def _seating(bucket: int, pairs: tuple[np.ndarray, ...], s: State, seed: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of each pair; customers and tables of each word in the parent (of hot words: this
    bucket's customers only, and no use of the tables)."""
    word, ctx, n, hot = pairs
    rng = np.random.default_rng([seed, bucket])
    words = len(hot)
    own = ctx > 0
    t = np.where(own, np.minimum(n, 1), n)
    uniform = 1.0 / (s.words + 1)
    d1, d0 = s.discount
    below = (s.theta + d0 * s.tables[0]) * uniform
    for _ in range(rounds):
        customers = np.bincount(word, t, words).astype(np.int64)
        customers = np.where(hot > 0, s.hot_customers[hot], customers)
        # hot words are seated once for all tasks: no draw here, so that held-out texts change no other's draw
        root = seat(np.where(hot > 0, 0, customers), np.full(words, below), d0, rng)
        root = np.where(hot > 0, s.hot_tables[hot], root)
        p0 = (np.maximum(customers - d0 * root, 0) + below) / (s.theta + s.customers[0])
        rate = (s.theta + d1 * s.tables[ctx]) * p0[word]
        t = np.where(own, seat(np.where(own, n, 0), rate, d1, rng), n)
    customers = np.bincount(word, t, words).astype(np.int64)
    root = seat(np.where(hot > 0, 0, customers), np.full(words, below), d0, rng)
    return t, customers, root


def _sweep(pairs: DataFrame, state, seed: int, first: bool, contexts: int, hots: int) -> DataFrame:
    """(kind, id, a, b) totals after a sweep, summed over all buckets; a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, t = np.zeros(contexts + 1), np.zeros(contexts + 1)
        hot_n, hot_c = np.zeros(hots + 1), np.zeros(hots + 1)
        words = ones = twos = root_ones = root_twos = 0
        for b in batches:
            for bucket, size, data in zip(*(col(b, x).to_pylist() for x in ("bucket", "size", "data"))):
                p = _unpack(size, data)
                word, ctx, n, hot = p
                if first:
                    seats = np.where(ctx > 0, np.minimum(n, 1), n)
                    customers = np.bincount(word, seats, len(hot)).astype(np.int64)
                    root = (customers > 0).astype(np.int64)
                else:
                    seats, customers, root = _seating(bucket, p, state.value, seed)
                own = ctx > 0
                c += np.bincount(ctx, n, contexts + 1) * (np.arange(contexts + 1) > 0)
                t += np.bincount(ctx, seats, contexts + 1) * (np.arange(contexts + 1) > 0)
                cold = hot == 0
                c[0] += customers.sum()
                t[0] += root[cold].sum()
                words += int((np.bincount(word, n, len(hot)) > 0)[cold].sum())
                hot_n += np.bincount(hot[word], n, hots + 1)
                hot_c += np.bincount(hot, customers, hots + 1)
                ones += int((n[own] == 1).sum())
                twos += int((n[own] == 2).sum())
                root_ones += int((customers[cold] == 1).sum())
                root_twos += int((customers[cold] == 2).sum())
        hot_n[0] = hot_c[0] = 0
        few = ("w", np.array([0]), np.array([float(words)]), np.array([0.0])), ("d", np.array([1, 0]), np.array([ones, root_ones], float), np.array([twos, root_twos], float))
        for kind, at, x, y in (("c", np.flatnonzero((c != 0) | (t != 0)), c, t), ("h", np.flatnonzero((hot_n != 0) | (hot_c != 0)), hot_n, hot_c), *few):
            if kind in "ch":
                x, y = x[at], y[at]
            yield pa.record_batch([pa.array([kind] * len(at), pa.string()), pa.array(at), pa.array(x), pa.array(y)], ["kind", "id", "a", "b"])

    return pairs.mapInArrow(run, "kind string, id long, a double, b double").groupBy("kind", "id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _totals(rows: list, before: State | None, contexts: int, hots: int, theta: float, seed: int) -> State:
    c, t = np.zeros(contexts + 1), np.zeros(contexts + 1)
    hot_n, hot_c = np.zeros(hots + 1), np.zeros(hots + 1)
    words, counts = 0, {}
    for r in rows:
        if r.kind == "c":
            c[r.id], t[r.id] = r.a, r.b
        elif r.kind == "h":
            hot_n[r.id], hot_c[r.id] = r.a, r.b
        elif r.kind == "w":
            words = int(r.a)
        else:
            counts[r.id] = (r.a, r.b)
    words += int((hot_n > 0).sum())
    if before is None:
        # discounts by the counts of counts; the seating keeps them
        d = tuple(min(0.95, max(0.05, x / (x + 2 * y))) if (x := counts.get(k, (0, 0))[0]) and (y := counts[k][1]) else 0.5 for k in (1, 0))
        roots = (hot_c > 0).astype(np.int64)
    else:
        d = before.discount
        below = (theta + d[1] * before.tables[0]) / (words + 1)
        roots = seat(hot_c.astype(np.int64), np.full(hots + 1, below), d[1], np.random.default_rng([seed, 1 << 20]))
    t[0] += roots.sum()
    return State(c, t, words, d, theta, hot_n.astype(np.int64), hot_c.astype(np.int64), roots)


# -------------------------------------------------------------------- scoring


def _probabilities(bucket: int, pairs: tuple[np.ndarray, ...], chain: list[tuple[State, State, int]]) -> np.ndarray:
    """Of each pair, averaged over the sampled seatings."""
    word, ctx, n, _ = pairs
    total = np.zeros(len(n))
    for before, after, seed in chain:
        # the seats of the sweep that made ``after``, so that customers and tables add up to its totals
        t, customers, root = _seating(bucket, pairs, before, seed)
        hot = pairs[3]
        customers = np.where(hot > 0, after.hot_customers[hot], customers)
        root = np.where(hot > 0, after.hot_tables[hot], root)
        d1, d0 = after.discount
        below = (after.theta + d0 * after.tables[0]) / (after.words + 1)
        p0 = (np.maximum(customers - d0 * root, 0) + below) / (after.theta + after.customers[0])
        own = np.maximum(n - d1 * t, 0) + (after.theta + d1 * after.tables[ctx]) * p0[word]
        total += np.where(ctx > 0, own / (after.theta + after.customers[ctx]), p0[word])
    return total / len(chain)


def _scores(gathered: DataFrame, shared) -> DataFrame:
    """Each block's documents: summed log10 scores and known tokens, from one bucket; packed."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chain = shared.value
        last = chain[-1][1]
        is_pairs = rows["block"] == -1
        head = rows[is_pairs].iloc[0]
        pairs = _unpack(head["size"], head["data"])
        word, _, n, hot = pairs
        c = np.where(hot > 0, last.hot_tokens[hot], np.bincount(word, n, len(hot)))[word]
        logp = np.log(_probabilities(int(head["bucket"]), pairs, chain)) / _LOG10
        base = np.log10(c + 1.0)
        known = c > 0
        out = []
        for block, size, data in zip(*(rows[~is_pairs][x] for x in ("block", "size", "data"))):
            raw = np.frombuffer(zlib.decompress(data), "<u4").reshape(3, size)
            pair, doc, times = raw[0], raw[1], raw[2].astype(float)
            starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            sums = [np.add.reduceat(x[pair] * times, starts) for x in (logp, base, known.astype(float))]
            out.append((block, len(starts), _pack((doc[starts] // 2).astype("<u4"), sums[0], sums[1], sums[2].astype("<u4"))))
        return pd.DataFrame(out, columns=["block", "size", "data"])

    return gathered.groupBy("bucket").applyInPandas(run, "block long, size long, data binary")


def _collect_scores(rows: DataFrame, tokens_n: int, words: int) -> DataFrame:
    """Documents of each block with the buckets' sums added up; rows come together by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sums = None, None, None

        def emit() -> pa.RecordBatch:
            lengths, none = ids[1].astype(np.int64), ids[2]
            base = sums[1] - lengths * math.log10(tokens_n + words + 1)
            return pa.record_batch([pa.array(ids[0], pa.int64(), mask=none), pa.array(lengths), pa.array(np.rint(sums[2]).astype(np.int64)), pa.array(base), pa.array(sums[0])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for block, size, keys, data in zip(*(col(b, x).to_pylist() for x in ("block", "size", "keys", "data"))):
                if block != now:
                    if ids is not None:
                        yield emit()
                    # the documents' row sorts first
                    raw = zlib.decompress(data)
                    ids = (np.frombuffer(keys, "<i8"), np.frombuffer(raw[: 4 * size], "<u4"), np.frombuffer(raw[4 * size :], bool))
                    now, sums = block, np.zeros((3, size))
                    continue
                raw = zlib.decompress(data)
                doc = np.frombuffer(raw[: 4 * size], "<u4")
                sums[0, doc] += np.frombuffer(raw[4 * size : 12 * size], "<f8")
                sums[1, doc] += np.frombuffer(raw[12 * size : 20 * size], "<f8")
                sums[2, doc] += np.frombuffer(raw[20 * size :], "<u4")
        if ids is not None:
            yield emit()

    return rows.repartition("block").sortWithinPartitions("block", F.col("keys").isNull(), "bucket").select("block", "size", "keys", "data").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


# ------------------------------------------------------------------- operator


def score(docs: DataFrame, parts: int = 7, held: int = 2, contexts: int = 4000, shared: int = 60_000, share: float = 1 / 4000, sweeps: int = 3, samples: int = 2, theta: float = 1.0, bucket_tokens: int = 2_000_000, seed: int = 11) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pitman-yor")
    docs = only(docs, doc_id="long", text="string")
    if contexts + shared >= 1 << 16:
        raise ValueError("numbers of restaurants take two bytes")
    counts = scratch.save(_counts(docs, parts, held), "counts")
    total = sum(r.n for r in counts.where("word is null").collect())
    often = counts.where(F.col("word").isNotNull() & (F.col("n") >= share * total)).orderBy(F.desc("n"), "word").limit(contexts).collect()
    scratch.drop(counts)
    buckets = max(4, -(-total * 7 // (6 * bucket_tokens)))
    names = np.sort(np.array([r.word for r in often] or [], np.int64).view(np.uint64))
    hot = np.sort(np.array([r.word for r in often if r.n * 8 * buckets >= total], np.int64).view(np.uint64))
    plan = spark.sparkContext.broadcast(Plan(names, shared, hot, buckets))
    k, h = len(names) + shared, len(hot)  # context ids take two bytes

    dealt = _deal(docs, plan, parts, held)
    dealt = scratch.save(dealt.where("bucket < 0").select("block", "size", "keys", "rest"), "documents"), dealt.where("bucket >= 0")
    gathered = scratch.save(dealt[1].groupBy("bucket").applyInPandas(_gather, "bucket int, block long, size long, data binary"), "entries")
    pairs = gathered.where("block = -1")
    state, chain = None, []
    for i in range(sweeps + 1):
        given = spark.sparkContext.broadcast(state)
        rows = _sweep(pairs, given, seed + i, i == 0, k, h).collect()
        new = _totals(rows, state, k, h, theta, seed + i)
        if i > sweeps - samples:
            chain.append((state, new, seed + i))
        state = new
    train_tokens = int(total)
    got = _scores(gathered, spark.sparkContext.broadcast(chain))
    both = got.select("block", F.col("size"), F.lit(None).cast("binary").alias("keys"), "data", F.lit(0).alias("bucket")).unionByName(dealt[0].select("block", "size", "keys", F.col("rest").alias("data"), F.lit(-1).alias("bucket")))
    out = _collect_scores(both, train_tokens, state.words)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
