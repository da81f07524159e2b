"""Keys, codes and checks of incoming rows: every check gives rows or counts, never a driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE_SPACE = "\u3000"


def horse_id(race: Column, post: Column, fallback: Column) -> Column:
    """race-post; the runner's number in its race where the post position is missing."""
    return F.concat_ws("-", race, F.coalesce(post.cast("long"), fallback.cast("long")).cast("string"))


def post_of(horse: Column, race: Column) -> Column:
    """The positive number after ``race-``; null for any other identifier."""
    rest = F.when(F.startswith(horse, F.concat(race, F.lit("-"))), F.substr(horse, F.length(race) + 2))
    n = F.when(rest.rlike("^[0-9]{1,9}$"), F.try_to_number(rest, F.lit("999999999"))).cast("long")
    return F.when(n > 0, n)


def surface_of(track: Column) -> Column:
    """Fixed ranges of track codes."""
    return F.when(track.between(10, 22), "TURF").when(track.between(23, 29), "DIRT").when(track.between(51, 59), "JUMP").otherwise("UNKNOWN")


def first_code(*slots: Column) -> Column:
    """The first slot that is neither blank nor 000."""
    return F.coalesce(*[F.when(~F.trim(c).isin("", "000"), F.trim(c)) for c in slots])


def signed_delta(sign: Column, size: Column) -> Column:
    """Sign and magnitude; 999 and missing magnitudes are null."""
    return F.when(size.isNotNull() & (size != 999), F.when(sign == "-", -size).otherwise(size))


def weight_of(raw: Column) -> Column:
    """A weight where 0 and 999 stand for unknown."""
    return F.when(~raw.isin(0, 999), raw)


def return_code(message: Column) -> Column:
    """The number after ``return code`` in a message; null without one."""
    return F.nullif(F.regexp_extract(message, r"return code\s+(-?[0-9]+)", 1), F.lit("")).try_cast("int")


def heartbeat_stale(updated: Column, now: Column, most_seconds: int = 1800) -> Column:
    """Whether a sign of life is older than ``most_seconds``; without one that can be read it is not stale."""
    return F.coalesce((F.unix_micros(now) - F.unix_micros(updated)) > most_seconds * 1_000_000, F.lit(False))


def blank(text: Column) -> Column:
    """Null, empty, or spaces only, the full-width one included."""
    return F.coalesce(F.trim(F.translate(text, WIDE_SPACE + "\t", "  ")) == "", F.lit(True))


def completed(df: DataFrame, until: str, least_field: int = 3) -> DataFrame:
    """Finished runners with odds, up to a day, of races that then have enough runners."""
    rows = df.where(F.col("finish_position").isNotNull() & (F.col("win_odds") > 1) & (F.col("race_date") <= F.lit(until).cast("date")))
    return rows.withColumn("runners", F.count("*").over(Window.partitionBy("race_id"))).where(F.col("runners") >= least_field)


def safe_races(starters: DataFrame, post: str = "post_position") -> DataFrame:
    """Races of two and more starters whose post positions are all there and all different."""
    each = starters.groupBy("race_id").agg(F.count("*").alias("starters"), F.count(post).alias("_known"), F.count_distinct(post).alias("_distinct"))
    return each.where("starters >= 2 and _known = starters and _distinct = starters").select("race_id", "starters")


def counts_with_defaults(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """How often each known value occurs, 0 where it doesn't, and any other value that does."""
    dim = rows.sparkSession.createDataFrame([(k,) for k in known], f"{column} string")
    return rows.select(column, F.lit(1).alias("_k")).unionByName(dim.select(column, F.lit(0).alias("_k"))).groupBy(column).agg(F.sum("_k").cast("long").alias("rows"))


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with several values; a missing value is one of them."""
    n = F.count_distinct(F.coalesce(F.col(value).cast("string"), F.lit("missing")))
    return rows.groupBy(key).agg(n.alias("values"), F.count("*").alias("rows")).where("values > 1")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def key_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in either, both, and only one of two tables: one aggregation over tagged keys."""
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    each = tagged.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return each.agg(F.count("*").alias("either"), F.count_if(F.col("_a") + F.col("_b") == 2).alias("both"), F.count_if(F.col("_b") == 0).alias("only_a"), F.count_if(F.col("_a") == 0).alias("only_b"))


def all_quoted(runners: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Each race's runners and how many of them have a quote; complete if all."""
    has = quotes.select(*keys).distinct().withColumn("_q", F.lit(1))
    got = runners.join(has, keys, "left").groupBy("race_id").agg(F.count("*").alias("runners"), F.count("_q").alias("quoted"))
    return got.withColumn("complete", F.col("runners") == F.col("quoted"))


def against_recorded(new: DataFrame, recorded: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Of each new record: new, identical to the recorded one, or in conflict with it."""
    old = recorded.select(*keys, F.struct(*values).alias("_old"))
    got = new.join(old, keys, "left")
    status = F.when(F.col("_old").isNull(), "new").when(F.struct(*values).eqNullSafe(F.col("_old")), "identical").otherwise("conflict")
    return got.withColumn("status", status).drop("_old")


def snapshot_faults(rows: DataFrame) -> DataFrame:
    """The rules that a pre-race quote breaks, comma-joined; no row where it breaks none."""
    rules = {
        "blank_race": blank(F.col("race_id")),
        "blank_horse": blank(F.col("horse_id")),
        "blank_name": blank(F.col("horse_name")),
        "blank_source": blank(F.col("source")),
        "bad_odds": F.coalesce((F.col("win_odds") <= 1) | F.isnan("win_odds") | (F.col("win_odds") == float("inf")), F.lit(True)),
        "no_time": F.col("observed_at").isNull() | F.col("post_time").isNull(),
        "too_late": F.coalesce(F.col("observed_at") >= F.col("post_time"), F.lit(False)),  # no_time says what is missing
    }
    return rows.withColumn("faults", F.concat_ws(",", *[F.when(rule, name) for name, rule in rules.items()])).where("faults <> ''")


def bad_sums(rows: DataFrame, column: str, tolerance: float = 1e-9) -> DataFrame:
    """Races whose probabilities don't add up to one, or that miss some."""
    each = rows.groupBy("race_id").agg(F.sum(column).alias("total"), F.count_if(F.col(column).isNull()).alias("missing"))
    return each.where((F.abs(F.col("total") - 1) > tolerance) | (F.col("missing") > 0) | F.col("total").isNull())


def staleness(history: DataFrame, group: str, day: str, most: int = 14) -> DataFrame:
    """Days from each group's last row to a day, and whether that is too long ago."""
    gap = F.datediff(F.lit(day).cast("date"), F.max("race_date"))
    return history.where(F.col("race_date") < F.lit(day).cast("date")).groupBy(group).agg(F.max("race_date").alias("last_day"), gap.alias("gap_days")).withColumn("stale", F.col("gap_days") > most)


def resume_from(rows: DataFrame, overlap_days: int = 7) -> DataFrame:
    """The time from which an incremental read starts again: the last day less the overlap."""
    return rows.agg(F.date_format(F.date_sub(F.max("race_date"), overlap_days), "yyyyMMdd'000000'").alias("from_time"))


def top_pick(rows: DataFrame, column: str) -> DataFrame:
    """One runner of each race: the largest value, the first post position among equals."""
    best = F.max_by(F.struct("post_position", column, "is_winner"), F.struct(F.col(column), -F.col("post_position")))
    return rows.groupBy("race_id").agg(best.alias("_b")).select("race_id", "_b.*")
