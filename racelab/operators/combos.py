"""Top-three probabilities of races."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelab.functions.betting import plackett_luce, strength

_ORDERS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))


def realised(df: DataFrame, p: str) -> DataFrame:
    """Races whose places 1, 2, 3 have one runner each, with these runners' and the field's strengths.

    Strengths are scaled by the race's largest; power sums serve the closed form below.
    """
    rows = df.withColumn("_s", strength(F.col(p)))
    place = lambda k: F.max(F.when(F.col("finish_position") == k, F.col("_s"))).alias(f"s{k}")
    power = lambda k: F.sum(F.pow("_s", F.lit(k))).alias(f"p{k}")
    races = rows.groupBy("race_id").agg(*[place(k) for k in (1, 2, 3)], *[F.count_if(F.col("finish_position") == k).alias(f"n{k}") for k in (1, 2, 3)], power(1), power(2), power(3))
    return races.where("n1 = 1 AND n2 = 1 AND n3 = 1").drop("n1", "n2", "n3")


def evidence(df: DataFrame, p: str) -> DataFrame:
    """Plackett-Luce probability of the realised order and set, and of the set given that exactly
    three are placed: s1 s2 s3 / e3, e3 = (p1^3 - 3 p1 p2 + 2 p3) / 6."""
    races = realised(df, p)
    s = [F.col(f"s{k}") for k in (1, 2, 3)]
    ordered = plackett_luce(*s, F.col("p1"))
    trio = sum((plackett_luce(*[s[i] for i in o], F.col("p1")) for o in _ORDERS[1:]), ordered)
    e3 = (F.pow("p1", F.lit(3)) - 3 * F.col("p1") * F.col("p2") + 2 * F.col("p3")) / 6
    return races.select("race_id", ordered.alias("trifecta"), trio.alias("trio"), (s[0] * s[1] * s[2] / F.greatest(e3, F.lit(1e-300))).alias("exact_three"))


def ordered_exact_three(df: DataFrame, p: str, market: str) -> DataFrame:
    """Of each race with one runner on each of the first three places: the probability of its set, given that
    exactly three are placed, times the market's probability of their order within the set."""
    sets = evidence(df, p).select("race_id", "exact_three")
    place = lambda k: F.max(F.when(F.col("finish_position") == k, F.greatest(F.col(market), F.lit(1e-12)))).alias(f"m{k}")
    order = df.groupBy("race_id").agg(*[place(k) for k in (1, 2, 3)])
    m1, m2, m3 = (F.col(f"m{k}") for k in (1, 2, 3))
    within = m1 / (m1 + m2 + m3) * m2 / (m2 + m3)
    return sets.join(order, "race_id").select("race_id", "exact_three", within.alias("order_within"), (F.col("exact_three") * within).alias("exact_trifecta"))


def triples(df: DataFrame, columns: list[str]) -> DataFrame:
    """All unordered triples of a race, positions ascending. A race becomes one row with its field in order;
    triples come from that array, so the table is shuffled once."""
    runner = F.struct("post_position", *columns)
    race = df.where("post_position IS NOT NULL").groupBy("race_id").agg(F.sort_array(F.collect_list(runner)).alias("_f"))
    later = lambda at: F.slice("_f", F.col(at) + 2, F.greatest(F.size("_f") - F.col(at) - 1, F.lit(0)))
    a = race.select("race_id", "_f", F.posexplode("_f").alias("_i", "_a"))
    b = a.select("race_id", "_f", "_i", "_a", F.posexplode(later("_i")).alias("_n", "_b")).withColumn("_j", F.col("_i") + 1 + F.col("_n"))
    c = b.select("race_id", "_a", "_b", F.explode(later("_j")).alias("_c"))
    got = c.where("_a.post_position < _b.post_position AND _b.post_position < _c.post_position")
    return got.select("race_id", *[F.col(f"_{t}.{x}").alias(f"{t}_{'post' if x == 'post_position' else x}") for t in "abc" for x in ("post_position", *columns)])


def role_aware(df: DataFrame, q: str, market: str, longshot: float = 6.0) -> DataFrame:
    """The winner by the market, second and third by top-three strengths of ``q``.

    One row for each race whose places 1, 2, 3 have one runner each: the probability of the realised
    order and set, that of the order inside the set by the market alone, and whether a long shot is in it.
    """
    rows = df.withColumns({"_s": strength(F.col(q)), "_w": F.greatest(F.col(market), F.lit(1e-12))})
    at = lambda c, k: F.max(F.when(F.col("finish_position") == k, F.col(c)))
    places = (1, 2, 3)
    races = rows.groupBy("race_id").agg(
        *[at("_s", k).alias(f"s{k}") for k in places],
        *[at("_w", k).alias(f"w{k}") for k in places],
        *[F.count_if(F.col("finish_position") == k).alias(f"n{k}") for k in places],
        F.sum("_s").alias("s"),
        F.sum("_w").alias("w"),
        F.max(((F.col("finish_position") <= 3) & (F.col("win_odds") >= longshot)).cast("int")).alias("longshot"),
    )
    races = races.where("n1 = 1 AND n2 = 1 AND n3 = 1")

    def order(a: int, b: int, c: int):
        after = F.col("s") - F.col(f"s{a}")
        rest = after - F.col(f"s{b}")
        share = lambda x, of: F.when(of > 0, x / of).otherwise(0.0)
        return F.col(f"w{a}") / F.col("w") * share(F.col(f"s{b}"), after) * share(F.col(f"s{c}"), rest)

    orders = [order(*(i + 1 for i in o)) for o in _ORDERS]
    inside = F.col("w1") / (F.col("w1") + F.col("w2") + F.col("w3")) * F.col("w2") / (F.col("w2") + F.col("w3"))
    bounded = lambda p: F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300))
    return races.select("race_id", bounded(orders[0]).alias("trifecta"), bounded(sum(orders[1:], orders[0])).alias("trio"), inside.alias("order_in_set"), "longshot")
