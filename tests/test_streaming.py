from sidelines.plans.adapter import plays_from_events
from sidelines.plans.kicker import kicker_games
from sidelines.streaming import merge_partials, start_facts_stream

SF = "/root/testdata/sf0.001"


def test_stream_partials_equal_batch_facts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    src = str(tmp_path / "events")
    # two arrivals of event files (split by time, like real appends)
    events.where("ts < '2024-01-15'").write.parquet(src + "/part=1")
    events.where("ts >= '2024-01-15'").write.parquet(src + "/part=2")
    q = start_facts_stream(spark, src + "/*", str(tmp_path / "partials"), str(tmp_path / "ckpt"),
                           max_files_per_trigger=1)
    q.awaitTermination(300)
    merged = merge_partials(spark.read.parquet(str(tmp_path / "partials")).drop("batch_id"))
    batch = kicker_games(plays_from_events(events))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(merged.collect(), key=key) == sorted(batch.select(*merged.columns).collect(), key=key)
