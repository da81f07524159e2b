"""Spelling variants by anagram hashing.

A word's anagram key is the sum of a power of each letter's rank in the alphabet: the order of the
letters doesn't matter, and adding, removing or exchanging one letter shifts the key by a known value.
Words join where such a shift makes their keys equal, and their letters are then compared in order.

* counting: words are counted in the tasks that read the texts, then by word;
* join: a word is entered once for each of its distinct letters, under its key without that letter. An
  exchange is two entries of equal key; an addition is an entry that equals a whole word's key. One half
  of the two words is untouched by a single edit, so the half (as text) is part of the join key: words
  with the same bag of letters but another order hardly meet, and an entry's group holds at most the
  words that one alphabet's letters make of it;
* the join is between distinct words only; copies of texts and frequent words are counted before it. It is
  always a merge join: Spark sizes entries by the table of words that they are exploded from, some twenty times
  too low, and would broadcast them.

The 5th power of a rank up to 90 (a-z, then U+00C0 to U+00FF) sums to less than 2^63 for any string.

Null texts and texts without a letter have no words; a null doc_id counts as the empty string in the
hash. Rows are never dropped: repeated rows count again. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, w): every maximal run of letters of every text, A-Z lower-cased."""
    own = only(docs, doc_id="long", text="string")
    return own.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("w")).withColumn("w", F.translate("w", _UPPER, _LOWER))


def misspelt(doc_id: Column, w: Column, every: int = 199) -> Column:
    """The run, or without one letter if ``every`` divides the crc32 of ``doc_id:run``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), w).cast("binary"))
    at = (h % F.length(w)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(w, F.lit(1), at), F.substring(w, at + 2, F.length(w)))).otherwise(w)


def vocabulary(docs: DataFrame, least: int = 6, occurrences: int = 5, every: int = 199) -> DataFrame:
    """(word, n) of at least ``least`` letters and ``occurrences`` occurrences."""
    words = runs(docs).where(F.length("w") >= least).select(misspelt(F.col("doc_id"), F.col("w"), every).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def value(letter: Column) -> Column:
    """5th power of the letter's rank: a-z are 1 to 26, then U+00C0 to U+00FF."""
    code = F.ascii(letter).cast("long")
    rank = F.when(code >= 0xC0, code - (0xC0 - 27)).otherwise(code - 96)
    return rank * rank * rank * rank * rank


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda acc, c: acc + value(c))


def _parts(length: Column, at: Column, word: Column, skip: int) -> Column:
    """The halves of a word cut at ``at``, ``skip`` letters of the second left out, each with its side."""
    left = F.struct(F.lit("l").alias("side"), F.substring(word, F.lit(1), at).alias("half"))
    right = F.struct(F.lit("r").alias("side"), F.substring(word, at + 1 + skip, length).alias("half"))
    return F.explode(F.array(left, right))


def pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): both directions of all pairs of distinct words that are one inserted,
    deleted or replaced letter apart. ``words`` has (word, n), one row a word."""
    keyed = words.select("word", "n", F.length("word").alias("len"), anagram_key(F.col("word")).alias("key"))
    letter = F.explode(F.array_distinct(F.split("word", ""))).alias("letter")
    less = keyed.select("word", "n", "len", "key", letter).withColumn("key", F.col("key") - value(F.col("letter")))
    half = F.floor(F.col("len") / 2).cast("int")

    # an exchange: equal keys without the two letters, equal lengths, one half in common
    entry = less.select("word", "n", "len", "key", "letter", _parts(F.col("len"), half, F.col("word"), 0).alias("p")).select("word", "n", "len", "key", "letter", "p.*")
    # the letter that goes stands in the other half
    entry = entry.where(F.instr(F.expr("if(side = 'l', substring(word, length(half) + 1), substring(word, 1, len - length(half)))"), F.col("letter")) > 0)
    a, b = entry.alias("a"), entry.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "side", "half", "len")]
    near = F.levenshtein("a.word", "b.word", 1) == 1
    exchange = a.join(b.hint("merge"), [*same, F.col("a.letter") != F.col("b.letter"), near]).select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))

    # an addition: the longer word's key without a letter is the shorter one's whole key
    cut = F.floor((F.col("len") - 1) / 2).cast("int")
    longer = less.select("word", "n", "key", cut.alias("cut"), _parts(F.col("len"), cut, F.col("word"), 1).alias("p")).select("word", "n", "key", "cut", "p.*").alias("a")
    shorter = keyed.select("word", "n", "key", half.alias("cut"), _parts(F.col("len"), half, F.col("word"), 0).alias("p")).select("word", "n", "key", "cut", "p.*").alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "side", "half", "cut")]
    # a pair with both halves in common is met on the left only
    once = (F.col("a.side") == "l") | (F.substring("a.word", F.lit(1), F.col("a.cut")) != F.substring("b.word", F.lit(1), F.col("a.cut")))
    added = longer.join(shorter.hint("merge"), [*same, once, near]).select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))
    both = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return exchange.unionByName(added.select(both.alias("p")).select("p.*"))


def forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word: its near word of largest n (ties: smallest) if
    that n is at least ``ratio`` times its own."""
    alone = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))))
    near = alone.unionByName(pairs(words)).groupBy("word", "n").agg(F.count("other").alias("n_near"), best.alias("best"))
    taken = F.col("best").isNotNull() & (-F.col("best.m") >= ratio * F.col("n"))
    return near.select("word", "n", "n_near", F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n"))


def rooted(found: DataFrame, scratch: Scratch, ratio: int = 5) -> DataFrame:
    """``found`` with root, the last form reached from a word. A form's n is ``ratio`` times its word's,
    so that a chain has at most log(largest n) steps; each round doubles the steps taken."""
    largest = found.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(largest, ratio))) if ratio > 1 else 1
    hop = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps)) if steps > 1 else 1)):
        ahead = hop.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        hop = scratch.save(hop.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return found.join(hop.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least: int = 6, occurrences: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus that is frequent enough."""
    if ratio < 2:
        raise ValueError("a form's count must be a multiple of its word's")
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(vocabulary(docs, least, occurrences, every), "words")
    found = scratch.save(forms(words, ratio), "forms")
    return rooted(found, scratch, ratio).select("word", "form", "root", "n", "n_near", "form_n")


_CRC = """4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(bin({t}))),
    lambda k: substr(bin({t}), (8 * (k // 8) + 8 - k % 8)::BIGINT, 1)::BIGINT)), lambda acc, b: xor(acc >> 1, 3988292384 * (xor(acc, b) & 1)))"""

#: The same rows by all near pairs from deletion variants; crc32 bit by bit.
ORACLE_SQL = f"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc_id, translate(w, '{_UPPER}', '{_LOWER}') AS w, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents)
  GROUP BY 1, 2 HAVING length(translate(w, '{_UPPER}', '{_LOWER}')) >= 6),
hashed AS MATERIALIZED (SELECT w, k, {_CRC.format(t="(coalesce(doc_id::VARCHAR, '') || ':' || w)")} AS h FROM runs),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, other, other_n, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.other_n >= 5 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 5 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""
