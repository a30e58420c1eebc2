"""The stream's end state equals the batch, however the events are cut."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestack.operators import budget
from lodestack.streaming import inventory as S
from lodestack.streaming.progress import ProgressEmitter, StreamWatcher


def events(seed, n=120):
    """Files that several sources have, some of them taken out, in any order, some said twice."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        for source in rng.sample(range(3), rng.randrange(1, 4)):
            tokens = rng.choice([10, 500, 4000, 9000])
            rows.append((f"/f{i}", False, source, f"/f{i}", f"f{i}.txt", f"s{source}/f{i}.txt", 3 * i + source, rng.choice(["ready", "images", "error"]), tokens * 4, tokens, tokens + 1))
        if rng.random() < 0.2:
            rows.append((f"/f{i}", True, *[None] * 9))
    rows.append(("/never seen", True, *[None] * 9))
    rows += rng.sample(rows, 20)
    rng.shuffle(rows)
    return rows


def plain(rows):
    first, gone = {}, {r[0] for r in rows if r[1]}
    for r in rows:
        if not r[1] and (r[0] not in first or r[2] < first[r[0]][2]):
            first[r[0]] = r
    return {k: r for k, r in first.items() if k not in gone}, gone


@pytest.mark.parametrize("cuts", [[], [1, 2, 50, 51, 200], [100]])
def test_any_cut_equals_the_batch(spark, tmp_path, cuts):
    rows = events(4)
    kept, gone = plain(rows)
    come, state = tmp_path / "events", str(tmp_path / "state")
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[a:b], S.EVENTS).coalesce(1).write.mode("append").parquet(str(come))
        # Each start goes on where the last one ended.
        query = S.follow(spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(come)), state, availableNow=True)
        assert query.awaitTermination(120)
    now = S.current(spark, state).collect()
    assert {r.key for r in now if r.removed} == gone
    assert {(r.key, r.source_idx, r.relative_path) for r in now if not r.removed} == {(k, r[2], r[5]) for k, r in kept.items()}
    batch = spark.createDataFrame(list(kept.values()), S.EVENTS)
    want = [budget.decision(batch, limit).first().asDict() for limit in (600, 8000, 10**7)]
    got = S.decision(spark, state, (600, 8000, 10**7)).orderBy("context_limit").collect()
    assert [{k: v for k, v in r.asDict().items() if k != "context_limit"} for r in got] == want
    before = sorted(map(str, now))
    S.compact(spark, state)
    assert sorted(map(str, S.current(spark, state).collect())) == before
    assert sorted(map(str, S.standing(spark.createDataFrame(rows, S.EVENTS)).select("key", "removed", "said.*").collect())) == before


def test_files_as_they_come(spark, tmp_path):
    root, state = tmp_path / "in", str(tmp_path / "state")
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("aaa")
    stream = lambda: S.follow(S.arrivals(spark, str(root), 1, a_batch=1), state, availableNow=True)
    assert stream().awaitTermination(120)
    (root / "sub" / "b.exe").write_text("b")
    assert stream().awaitTermination(120)
    rows = {(r.name, r.size_bytes, r.source_idx, r.reason_code) for r in S.left_out(S.current(spark, state)).collect()}
    assert rows == {("a.txt", 3, 1, None), ("b.exe", 1, 1, "unsupported")}
    assert S.current(spark, state).where(F.col("mtime") > 0).count() == 2


def test_a_watcher_tells_of_each_batch(spark, tmp_path):
    come, emitter = tmp_path / "events", ProgressEmitter()
    for part in range(3):
        spark.range(part + 1).coalesce(1).write.mode("append").parquet(str(come))
    watcher = StreamWatcher(emitter)
    spark.streams.addListener(watcher)
    try:
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(come))
        query = rows.writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        events = []
        for _ in range(200):
            events += emitter.drain()
            if events and events[-1].message == "ended":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watcher)
    assert {e.file_path for e in events} == {"watched"} and events[0].status == "pending" and events[-1].current == 6
    assert [e.status for e in events[1:-1]] == ["ready"] * 3 and [e.message for e in events[1:-1]] == ["batch 0", "batch 1", "batch 2"]
