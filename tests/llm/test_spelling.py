"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter
from itertools import product

from racelab.llm import spelling
from racelab.llm.common import Scratch

from .test_documents import EDGE, empty, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, least=6, occurrences=5, every=199):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= occurrences}


def brute(n, ratio=5):
    out, form = {}, {}
    for w in n:
        near = [x for x in n if one_apart(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (n[w], len(near))
    roots = {}
    for w in n:
        roots[w] = w
        while form[roots[w]]:
            roots[w] = form[roots[w]]
    return {w: (form[w], roots[w], *out[w], n[form[w]] if form[w] else None) for w in n}


def plain(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def corpus(seed=5, docs=40):
    """Words of few letters, so that anagrams, ties and chains of forms occur."""
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abéÉÿ") for _ in range(rng.choice((6, 6, 7, 8)))) for _ in range(250)})
    weight = [5.0 ** rng.randrange(4) for _ in words]
    return [(i, " ".join(rng.choices(words, weight, k=200))) for i in range(docs)]


def test_against_all_pairs(spark):
    rows = [*corpus(), (901, "abcdef " * 5 + "abcdeg " * 30 + "abcxeg " * 200)]
    got, want = plain(spelling.variants(frame(spark, rows))), brute(brute_words(rows))
    assert got == want and len(got) > 100
    assert any(root not in (form, word) for word, (form, root, *_) in got.items() if form)  # a chain of two forms


def test_other_parameters(spark):
    rows = corpus(7, 10)
    got = plain(spelling.variants(frame(spark, rows), least=2, occurrences=2, ratio=2, every=3))
    assert got == brute(brute_words(rows, 2, 2, 3), 2)


def test_pairs_meet_once(spark):
    """All words of four letters over three: many anagrams; every near pair in both directions, once."""
    words = ["".join(p) for k in (3, 4) for p in product("abÿ", repeat=k)]
    got = [(r.word, r.other) for r in spelling.pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_apart(a, b)}


def test_key_shifts_by_one_letter(spark):
    key = {r.w: r.k for r in spark.createDataFrame([(w,) for w in ("listen", "silent", "liste", "lister", "ÿ")], "w string").select("w", spelling.anagram_key(spelling.F.col("w")).alias("k")).collect()}
    assert key["listen"] == key["silent"] == key["liste"] + 14**5 == key["lister"] - 18**5 + 14**5 and key["ÿ"] == 90**5


def test_long_chain_of_forms(spark):
    """a -> b -> c ...: pointer doubling reaches the last form."""
    scratch = Scratch(spark, "spelling-test")
    found = spark.createDataFrame([(f"w{k}", 2**k, 1, f"w{k + 1}" if k < 40 else None, 2 ** (k + 1)) for k in range(41)], "word string, n long, n_near long, form string, form_n long")
    assert {r.root for r in spelling.rooted(found, scratch, 2).collect()} == {"w40"}


def test_edges(spark):
    rows = [*EDGE, (9, "straße Straße STRASSE " * 5), (None, "Ünïted×÷ünïted " * 6), (10, "q" * 100_000)] * 2
    assert plain(spelling.variants(frame(spark, rows), occurrences=2)) == brute(brute_words(rows, occurrences=2))
    assert spelling.variants(empty(spark)).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "short")])).count() == 0


def test_entries_are_never_broadcast(spark):
    """A small table of words explodes into many entries, whose size Spark tells from the words'."""
    scratch = Scratch(spark, "spelling-test")
    words = scratch.save(spark.range(2000).select(spelling.F.concat(spelling.F.lit("word"), spelling.F.translate(spelling.F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("word"), spelling.F.lit(5).cast("long").alias("n")), "words")
    found = scratch.save(spelling.forms(words), "forms")
    for df in (spelling.pairs(words), spelling.forms(words), spelling.rooted(found, scratch)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
