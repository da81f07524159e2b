"""Best-fit packing by hierarchical residual packing.

Every task tokenizes its documents, cuts those longer than the limit and best-fits the pieces of a
bounded window, longest first. Bins that are nearly full are final. Underfull bins travel on as
items of their fill: they are merged in groups by further best-fit rounds, each over fewer items,
until one small group is left or a round merges nothing. Only (bin, fill) moves between
rounds; pieces stay where they were written and learn their place by one join.

Null texts count as empty (one token: the end id). Repeated rows and null ids are packed like any
other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import piece_rows, tokenizer
from .common import Scratch, col, only, strings

_COLS = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, closed boolean"


def best_fit(sizes: Iterable[tuple[int, int]], limit: int) -> tuple[list[list[int]], list[int]]:
    """Best-fit decreasing over (item, size): items of each bin and the bins' fills.

    Open bins are kept by free space; the tightest one that fits is the lowest set bit at or above
    the size in a mask of non-empty free spaces.
    """
    bins: list[list[int]] = []
    fill: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(limit + 1)]
    mask = 0
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        above = mask >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            k = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            free, k = limit, len(bins)
            bins.append([])
            fill.append(0)
        bins[k].append(item)
        fill[k] += size
        if free > size:
            by_free[free - size].append(k)
            mask |= 1 << (free - size)
    return bins, fill


def pack(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 0, slack: int = 32, window: int = 50_000, group: int = 10_000) -> DataFrame:
    """Pieces of (doc_id, text) rows with the sequence and offset each is packed at."""
    scratch = Scratch(docs.sparkSession, "packing")
    sep = end_id.to_bytes(4, "little")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        context = TaskContext.get()
        next_bin = (context.partitionId() if context else 0) << 40
        held: list[tuple] = []

        def flush(pieces: list[tuple]) -> pa.RecordBatch:
            nonlocal next_bin
            bins, fill = best_fit(((i, p[3]) for i, p in enumerate(pieces)), limit)
            rows: list[list] = [[] for _ in range(9)]
            for items, full in zip(bins, fill):
                at = 0
                for i in items:
                    p = pieces[i]
                    for c, v in zip(rows, (*p, next_bin, at, full, full >= limit - slack)):
                        c.append(v)
                    at += p[3]
                next_bin += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.bool_()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], [c.split()[0] for c in _COLS.split(", ")])

        for b in batches:
            for doc_id, ids in zip(col(b, "doc_id").to_pylist(), t.encode_all(strings(b), sep)):
                held += [(doc_id, *p) for p in piece_rows(ids, limit)]
                if len(held) >= window:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    pieces = scratch.save(only(docs, doc_id="long", text="string").mapInArrow(local, _COLS), "pieces")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [x for b in batches for x in zip(col(b, "root").to_pylist(), col(b, "fill").to_pylist())]
        bins, fill = best_fit(items, limit)
        size = dict(items)
        out = []
        for members, full in zip(bins, fill):
            at = 0
            for m in members:
                out.append((m, members[0], at, full))
                at += size[m]
        yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["root", "into", "shift", "fill"])

    # one piece of each bin stands at offset 0, so this lists every underfull bin once
    under = pieces.where(~F.col("closed") & (F.col("offset") == 0)).select(F.col("bin").alias("root"), "fill")
    place = None
    left, turn = under.count(), 0
    while left:
        groups = -(-left // group)
        turn += 1
        # other groups in each round: two bins that best fit left apart in one group never fit together
        move = scratch.save(under.repartition(groups, F.xxhash64("root", F.lit(turn))).mapInArrow(merge, "root long, into long, shift long, fill long"), "move")
        if place is None:
            place = move.select(F.col("root").alias("bin"), "into", "shift")
        else:
            # bins that closed in any earlier round did not travel and stay where they are
            now = move.select(F.col("root").alias("r"), F.col("into").alias("into2"), F.col("shift").alias("by"))
            moved = place.join(now, F.col("into") == F.col("r"), "left")
            place = scratch.save(moved.select("bin", F.coalesce("into2", "into").alias("into"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift")), "place")
        under = move.where(F.col("root") == F.col("into")).where(F.col("fill") < limit - slack).select("root", "fill")
        still = under.count()
        if groups == 1 or still == left:
            break
        left = still
    done_rows = pieces.where("closed").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    if place is None:
        return done_rows
    rest = pieces.where("not closed").join(place, "bin").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("into").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return done_rows.unionByName(rest)
