"""Pooled and paced providers."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from citeloom.functions.generation import Exhausted, Pace, Pooled, Ring, generate


def counting(folder):
    """A provider that notes the time of each call in a file and takes a while, longer for even prompts."""
    def build():
        def complete(system, prompt):
            with open(folder, "a") as out:
                out.write(f"{time.time()}\n")
            time.sleep(0.05 if int(prompt) % 2 == 0 else 0.01)
            return f"r{prompt}"

        return complete

    return build


def replies(spark, pooled, n):
    rows = spark.range(n, numPartitions=2).select("id", generate(F.when(F.col("id") % 10 != 9, F.col("id").cast("string")), "s", pooled).alias("r")).collect()
    return {r.id: r.r for r in rows}


def test_threads_keep_the_order_of_replies(spark, tmp_path):
    log = tmp_path / "calls"
    assert replies(spark, Pooled([counting(str(log))], parallel=8), 60) == {i: None if i % 10 == 9 else f"r{i}" for i in range(60)}
    assert len(log.read_text().split()) == 54


def test_calls_of_all_tasks_stay_within_the_rate(spark, tmp_path):
    log = tmp_path / "calls"
    rate = 1200  # a minute: 20 a second over two tasks
    begun = time.time()
    replies(spark, Pooled([counting(str(log))], parallel=8, per_minute=rate, tasks=2), 40)
    calls = sorted(map(float, log.read_text().split()))
    assert len(calls) == 36 and calls[0] >= begun
    # each task's share in any second, and one call where a second begins between two
    assert max(sum(c <= x < c + 1 for x in calls) for c in calls) <= rate / 60 + 2


def test_pace_holds_between_threads():
    pace, times = Pace(0.02), []
    threads = [threading.Thread(target=lambda: (pace.wait(), times.append(time.monotonic()))) for _ in range(10)]
    begun = time.monotonic()
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(times) == 10 and max(times) - begun >= 0.2 - 1e-3


def test_ring_moves_once_for_all_threads():
    built = []

    def spent():
        built.append("a")

        def complete(system, user):
            time.sleep(0.02)
            raise Exhausted
        return complete

    def good():
        built.append("b")
        return lambda system, user: user

    ring = Ring([spent, good], pause=0)
    got = []
    threads = [threading.Thread(target=lambda i=i: got.append(ring.ask("s", str(i)))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [str(i) for i in range(8)] and built == ["a", "b"]
    with pytest.raises(Exhausted):
        Ring([spent], pause=0).ask("s", "u")
