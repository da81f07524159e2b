import datetime as dt
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from racelab.functions import betting
from racelab.operators import asof, folds, history, intake, market, sequences, strategy
from racelab.sources import text as sources
from racelab.streaming import quotes as streaming

D = dt.date


def test_same_day_races_share_history_and_null_keys_form_a_group(spark):
    rows = spark.createDataFrame(
        [("A", D(2020, 1, 1), 1, 1.0, "J"), ("B", D(2020, 1, 1), 1, 2.0, "J"), ("C", D(2020, 1, 2), 1, None, "J"), ("D", D(2020, 1, 3), 1, 1.0, None), ("E", D(2020, 1, 4), 1, 3.0, None)],
        "race_id string, race_date date, post_position long, finish_position double, jockey string",
    ).withColumn("field_size", F.lit(4))
    got = {r.race_id: r for r in history.prior_history(history.outcomes(history.finish_percentile(rows)), ["jockey"], "j").collect()}
    assert (got["A"].j_past_starts, got["B"].j_past_starts, got["C"].j_past_starts) == (0, 0, 2)
    assert got["A"].j_past_win_rate is None and got["C"].j_past_win_rate == 0.5 and got["C"].j_days_since == 1
    assert got["D"].j_past_starts == 0 and got["E"].j_past_starts == 1


def test_recent_form_is_over_race_days(spark):
    rows = [("H", D(2020, 1, k), f) for k, f in ((1, 1.0), (2, 5.0), (2, 5.0), (3, 2.0), (4, 9.0))]
    df = spark.createDataFrame(rows, "horse_name string, race_date date, finish_position double")
    df = df.withColumns({"field_size": F.lit(9), "last_3f": F.lit(34.0), **{f"corner_{k}": F.lit(1.0) for k in (1, 2, 3, 4)}})
    df = history.outcomes(history.position_ratios(history.finish_percentile(df)))
    got = {r.race_date: r for r in history.recent_form(df).collect()}
    assert math.isclose(got[D(2020, 1, 4)].recent_finish_3, (1 + 5 + 2) / 3)
    assert got[D(2020, 1, 1)].recent_finish_3 is None


def test_market_probability_leaves_out_bad_odds(spark):
    df = spark.createDataFrame([("R", 1, 2.0), ("R", 2, 1.0), ("R", 3, None), ("R", 4, 4.0)], "race_id string, post_position long, win_odds double")
    got = {r.post_position: r.market_implied_probability for r in market.market_probability(df).collect()}
    assert got[2] == got[3] == 0.0 and math.isclose(got[1], 2 / 3) and math.isclose(sum(got.values()), 1.0)


def test_payout_is_half_even_and_stakes_round_down(spark):
    row = spark.range(1).select(betting.payout(F.lit(1), F.lit(2.5)).alias("a"), betting.payout(F.lit(1), F.lit(3.5)).alias("b"), betting.rounded_stake(F.lit(100000.0), F.lit(0.3), F.lit(4.0)).alias("s"), betting.kelly_fraction(F.lit(0.3), F.lit(1.0)).alias("k")).first()
    assert (row.a, row.b, row.k) == (2, 4, 0.0) and row.s == 1600


def test_asof_takes_quotes_of_the_same_moment(spark):
    q = spark.createDataFrame([(1, 10, 5.0), (1, 20, 4.5), (2, 10, 8.0)], "k long, t long, odds double")
    d = spark.createDataFrame([(7, 1, 20), (8, 1, 9), (9, 2, 99), (10, 3, 5)], "id long, k long, t long")
    got = {r.id: (r.quoted_at, r.odds) for r in asof.latest_before(d, q, "k", "t", ["odds"]).collect()}
    assert got == {7: (20, 4.5), 8: (None, None), 9: (10, 8.0), 10: (None, None)}


def test_latest_quotes_are_attached_or_named(spark):
    rows = spark.createDataFrame([("A", 1, "x"), ("A", 2, "y"), ("A", 3, "z"), ("A", 4, "w"), ("A", 5, "v"), ("A", 1, "x"), (None, 1, "x")], "race_id string, post long, name string")
    quotes = spark.createDataFrame([("A", 1, 1, 9.0, "x"), ("A", 1, 2, 2.0, "x"), ("A", 1, 2, 2.0, "x"), ("A", 2, 5, 2.0, "y"), ("A", 2, 5, 3.0, "y"), ("A", 3, 1, 2.0, "z"), ("A", 3, 2, None, "z"), ("A", 4, 1, 2.0, "other"), (None, 1, 1, 2.0, "x"), ("A", 5, None, 2.0, "v")], "race_id string, post long, t long, odds double, name string")
    got = sorted((r.post, r.odds or 0, r.quoted_at or 0, r.attach_status) for r in asof.attached(rows, quotes, ["race_id", "post"], "t", ["odds"], ["name"]).collect() if r.race_id)
    assert got == [(1, 2.0, 2, "ok"), (1, 2.0, 2, "ok"), (2, 2.0, 5, "ambiguous"), (3, 0, 2, "null_value"), (4, 2.0, 1, "mismatch"), (5, 0, 0, "missing")]
    assert asof.attached(rows, quotes.limit(0), ["race_id", "post"], "t", ["odds"]).where("attach_status = 'missing'").count() == 7
    with pytest.raises(Exception, match="no usable quote: ambiguous A 2"):
        asof.attached_or_fail(rows.where("post = 2"), quotes, ["race_id", "post"], "t", ["odds"], ["name"]).collect()
    assert asof.attached_or_fail(rows.where("post = 1 AND race_id = 'A'"), quotes, ["race_id", "post"], "t", ["odds"], ["name"]).count() == 2


def test_folds_follow_the_loop(spark):
    days = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(k), k) for k in range(23)], "race_date date, day long")
    for least, test, gap in ((10, 4, 0), (10, 4, 2), (22, 5, 0), (30, 5, 0)):
        want, cut = [], least
        while cut + gap < 23:
            want.append((cut, cut + gap, min(cut + gap + test, 23)))
            cut += test + gap
        got = [(r.train_days, r.test_start, r.test_end) for r in folds.walk_forward(days, least, test, gap).orderBy("fold").collect()]
        assert got == want


def test_running_totals_across_days(spark):
    profit = [50, -20, -100, 30, 200, -10, -300]
    rows = [(D(2020, 1, 1 + k // 2), k, v, int(v > 0)) for k, v in enumerate(profit)]
    df = spark.createDataFrame(rows, "day date, id long, v long, win int")
    got = sequences.running(df, "v", "day", ["id"]).orderBy("id").collect()
    total, peak = 0, 0
    for r, v in zip(got, profit):
        total += v
        peak = max(peak, total)
        assert (r.total, r.peak) == (total, peak)
    assert tuple(sequences.streaks(df, "win", "day", ["id"]).first()) == (2, 2)


def test_intake(spark):
    df = spark.createDataFrame([("A", 1, True), ("A", 2, False), ("B", 1, True), ("B", 2, True), ("C", 1, False)], "race_id string, post_position long, won boolean")
    got = {r.race_id: r.quarantined for r in intake.single_winner(df, F.col("won")).collect()}
    assert got == {"A": False, "B": True, "C": True}
    assert intake.unique_only(df, ["race_id"]).collect()[0].race_id == "C"
    merged = intake.replace_races(df, df.where("race_id = 'A' AND post_position = 1"))
    assert merged.groupBy("race_id").count().collect().__len__() == 3 and merged.where("race_id = 'A'").count() == 1


def test_strategy_never_breaks_its_limits(spark):
    rows = [(1, D(2020, 1, 1 + k // 5), k // 3, 0.5, 3.0, int(k % 4 == 0)) for k in range(30)]
    df = spark.createDataFrame(rows, "g int, race_date date, rid long, p double, win_odds double, is_winner int")
    got = strategy.simulate(df, "g").toPandas()
    assert (got.stake >= 100).all() and (got.stake <= 5000).all() and (got.drawdown >= 0).all()
    assert strategy.summary(strategy.simulate(df, "g"), "g").first().bets == len(got)


def test_text_source_aliases_and_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Date,raceid,Horse,rank,odds,other\n2020-01-01,R1,ハナ,1,2.5,x\n2020-01-01,R1,B,abc,,y\n".encode("utf-8-sig"))
    got = sources.read_history(spark, str(tmp_path / "a.csv")).collect()
    assert [r.finish_position for r in got] == [1.0, None] and got[0].horse_name == "ハナ"
    assert sources.detect_encoding(spark, str(tmp_path / "a.csv")) == "UTF-8"


def test_the_whole_file_decides_the_encoding(spark, tmp_path):
    """A character of another charset behind the first 100 KB; several files are one table."""
    head = "race_date,race_id,horse_name,finish_position\n" + "2020-01-01,R1,plain,1\n" * 6000
    (tmp_path / "late.csv").write_bytes(head.encode() + "2020-01-02,R2,ハナ,2\n".encode("cp932"))
    assert sources.detect_encoding(spark, str(tmp_path / "late.csv")) == "windows-31j"
    assert sources.read_history(spark, str(tmp_path / "late.csv")).where("race_id = 'R2'").first().horse_name == "ハナ"
    with zipfile.ZipFile(tmp_path / "h.zip", "w") as z:
        z.writestr("history.csv", "Date,raceid,Horse,rank\n2020-01-02,R2,ハナ,2\n".encode("cp932"))
    assert sources.read_history(spark, str(tmp_path / "h.zip")).first().horse_name == "ハナ"
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.csv").write_bytes(head.encode())
    (tmp_path / "many" / "b.csv").write_bytes("2020-01-02,R2,ハナ,2\n".encode("euc_jp"))
    assert sources.detect_encoding(spark, str(tmp_path / "many")) in ("EUC-JP", "windows-31j", "Shift_JIS")
    (tmp_path / "none.csv").write_bytes(b"a\n\x81 \n")
    with pytest.raises(ValueError, match="none of"):
        sources.detect_encoding(spark, str(tmp_path / "none.csv"))


def test_odds_book(spark):
    text = "HEAD" + "01002501" + "02000902" + "        " + "04012303"
    got = sources.odds_book(spark.createDataFrame([(text,)], "text string"), "text", 5, items=4).collect()
    assert [(r.post_position, r.odds, r.popularity) for r in got] == [(1, 2.5, 1), (4, 12.3, 3)]


def test_streaming_quotes(spark, tmp_path):
    t = dt.datetime(2020, 1, 1, 12)
    rows = [("R", "H1", t, t + dt.timedelta(hours=1), 5.0, 1, "s"), ("R", "H1", t, t + dt.timedelta(hours=1), 5.0, 1, "s"), ("R", "H1", t + dt.timedelta(minutes=5), t + dt.timedelta(hours=1), 4.5, 2, "s"), ("R", "H2", t, t - dt.timedelta(hours=1), 8.0, 3, "s")]
    df = spark.createDataFrame(rows, "race_id string, horse_id string, observed_at timestamp, post_at timestamp, odds double, sequence long, source string")
    df.write.parquet(str(tmp_path / "q"))
    stream = streaming.read_events(spark, str(tmp_path / "q"), df.schema)
    q = streaming.latest_quotes(streaming.valid_quotes(stream).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz")))
    run = q.writeStream.format("memory").queryName("quotes_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    run.awaitTermination(120)
    assert {r.odds for r in spark.table("quotes_out").collect()} == {4.5}


def test_ledger_appends_once(spark, tmp_path):
    batch = spark.createDataFrame([("m", "R1"), ("m", "R2"), ("m", "R1")], "model string, race_id string")
    path = str(tmp_path / "ledger")
    assert streaming.append_new(batch, path, ["model", "race_id"]) == 2
    assert streaming.append_new(batch, path, ["model", "race_id"]) == 0
