"""Streams and their ledger: batches count once, whenever they are killed and whatever comes again or late."""

import datetime as dt
import random

import pytest

from brickwork.sources.ledger import AlreadyRunning, Ledger
from brickwork.sources.workspace import new_path
from brickwork.streaming import metrics

DAY = dt.datetime(2024, 1, 1)


class Killed(Exception):
    pass


class Feed:
    """A folder of event files; each ``add`` is a file of (event_id, hours, user_id, type)."""

    def __init__(self, spark):
        self.spark, self.folder = spark, new_path(spark, "test-events")

    def add(self, *events):
        rows = [(i, DAY + dt.timedelta(hours=h), u, k, 0.0, "") for i, h, u, k in events]
        self.spark.createDataFrame(rows, metrics.EVENTS).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        return metrics.event_stream(self.spark, self.folder, "*.parquet")


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k long")


def held(ledger):
    return sorted(r.k for r in ledger.read("rows", "k long").collect())


def test_a_batch_counts_once(spark):
    ledger = Ledger(spark, new_path(spark, "test-ledger"))
    assert held(ledger) == []
    assert ledger.append(rows(spark, 1, 2), "a", 0) and not ledger.append(rows(spark, 1, 2), "a", 0)
    assert ledger.append(rows(spark, 3), "b", 0) and ledger.append(rows(spark, 4), "a", 1)
    assert held(ledger) == [1, 2, 3, 4] and ledger.is_done("a", 1) and not ledger.is_done("b", 1)


def test_a_batch_killed_before_its_commit_leaves_nothing(spark, monkeypatch):
    ledger = Ledger(spark, new_path(spark, "test-ledger"))
    ledger.append(rows(spark, 1), "a", 0)
    with monkeypatch.context() as m:
        m.setattr(Ledger, "_make", lambda *_: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            ledger.append(rows(spark, 2), "a", 1)
    assert held(ledger) == [1]
    assert ledger.append(rows(spark, 2), "a", 1) and held(ledger) == [1, 2]
    assert ledger.vacuum(keep=1) == 1 and held(ledger) == [1, 2]


def test_two_writers_both_count(spark, monkeypatch):
    path = new_path(spark, "test-ledger")
    one, other = Ledger(spark, path), Ledger(spark, path)
    one.append(rows(spark, 1), "a", 0)
    state, beaten = Ledger.state, []

    def slow(self):
        found = state(self)
        if self is one and not beaten:
            beaten.append(1)
            other.append(rows(spark, 3), "b", 0)  # commits first, with the version that one is about to take
        return found

    with monkeypatch.context() as m:
        m.setattr(Ledger, "state", slow)
        assert one.commit("a", 1, add={"rows": one.write(rows(spark, 2))})
    assert held(one) == held(other) == [1, 2, 3]


def test_compacting_keeps_the_rows(spark):
    ledger = Ledger(spark, new_path(spark, "test-ledger"))
    for k in range(5):
        ledger.append(rows(spark, k), "a", k)
    old = ledger.read("rows", "k long")
    ledger.compact("k long", most=3)
    assert held(ledger) == sorted(r.k for r in old.collect()) == [0, 1, 2, 3, 4] and len(ledger.state()[1]["tables"]["rows"]) == 1
    assert ledger.vacuum(keep=1) == 5 and held(ledger) == [0, 1, 2, 3, 4] and not ledger.append(rows(spark, 9), "a", 4)


def test_guard_lets_one_run_at_a_time(spark):
    ledger = Ledger(spark, new_path(spark, "test-ledger"))
    with ledger.guard("a"):
        with pytest.raises(AlreadyRunning), ledger.guard("a"):
            pass
        with ledger.guard("b"):
            pass
    with pytest.raises(Killed), ledger.guard("a"):
        raise Killed
    with ledger.guard("a"):
        with ledger.guard("a", stale_s=-1):  # the first one is taken for dead
            pass


@pytest.mark.parametrize("step", ["_make", "compact"])
def test_alerts_survive_a_kill(spark, monkeypatch, step):
    """Killed between writing and committing, or between committing and Spark's own checkpoint."""
    feed, path, checkpoint = Feed(spark), new_path(spark, "test-alerts"), new_path(spark, "test-checkpoint")
    run = lambda: sorted((r.user_id or 0, r.day.day) for r in metrics.raise_alerts(spark, feed.stream(), path, checkpoint).collect())
    feed.add((1, 0, 1, "error"), (2, 1, 1, "error"), (3, 1, 2, "view"))
    assert run() == [(1, 1)]
    feed.add((4, 2, 1, "error"), (5, 30, 1, "error"), (6, 3, None, "error"))
    before, made = getattr(Ledger, step), []

    def once(self, *args, **options):
        if step == "_make" and "running" in args[0]:
            return before(self, *args, **options)
        if not made:
            made.append(1)
            raise Killed
        return before(self, *args, **options)

    with monkeypatch.context() as m:
        m.setattr(Ledger, step, once)
        with pytest.raises(Exception, match="Killed"):
            run()
    assert run() == [(0, 1), (1, 1), (1, 2)]
    feed.add((7, 3, None, "error"), (8, 31, 1, "error"))
    assert run() == [(0, 1), (1, 1), (1, 2)]


def streak(events, user):
    """By sorting all of a user's events."""
    n = 0
    for _, _, kind in sorted((h, i, k or "error") for i, h, u, k in events if u == user):
        n = n + 1 if kind == "error" else 0
    return n


def test_streaks_do_not_depend_on_the_order_of_files(spark):
    rng = random.Random(3)
    events = [(i, i / 2, rng.choice([1, 2, 3, None]), rng.choice(["error", "error", "error", "view", None])) for i in range(120)]
    late = events[:]
    rng.shuffle(late)
    feed, path, checkpoint = Feed(spark), new_path(spark, "test-streaks"), new_path(spark, "test-checkpoint")
    for at in range(0, 120, 30):
        feed.add(*late[at : at + 30])
        got = {r.user_id: r.streak for r in metrics.latest_streaks(spark, feed.stream(), path, checkpoint).collect()}
    assert got == {u: streak(events, u) for u in (1, 2, 3, None)}
    state = Ledger(spark, path)
    assert state.state()[1]["facts"]["late"] == 0 and state.read("last", metrics.LAST).count() <= 4


def test_streak_state_is_bounded_and_counts_what_is_too_late(spark):
    feed, path, checkpoint = Feed(spark), new_path(spark, "test-streaks"), new_path(spark, "test-checkpoint")
    run = lambda: {r.user_id: r.streak for r in metrics.latest_streaks(spark, feed.stream(), path, checkpoint, late_days=2).collect()}
    feed.add(*[(i, i, 1, "error") for i in range(200)], (900, 0, 2, "view"))
    assert run() == {1: 200, 2: 0}
    ledger = Ledger(spark, path)
    assert ledger.read("open", metrics.OPEN).count() == 2 * 24 + 2  # the last two days' errors, the rest as one row
    feed.add((901, 10, 1, "view"), (902, 190, 1, "view"), (903, 201, 1, None))
    assert run() == {1: 10, 2: 0}  # 191 to 199 and 201; the view at hour 10 came too late
    assert ledger.state()[1]["facts"]["late"] == 1 and ledger.read("open", metrics.OPEN).count() == 10
    assert run() == {1: 10, 2: 0}


def test_events_read_again_count_once_and_late_ones_are_counted_apart(spark):
    feed, path, checkpoint = Feed(spark), new_path(spark, "test-daily"), new_path(spark, "test-checkpoint")

    def run():
        out, late = metrics.daily_once(spark, feed.stream(), path, checkpoint)
        return {(r.day.day, r.event_type): r.n for r in out.collect()}, late

    feed.add((1, 0, 1, "view"), (2, 5, 1, "view"), (3, 30, 1, "error"))
    assert run() == ({(1, "view"): 2, (2, "error"): 1}, 0)
    feed.add((2, 5, 1, "view"), (3, 30, 1, "error"), (4, 6, 2, "view"), (5, 24 * 12, 1, "view"))  # two again, one late but in time
    assert run() == ({(1, "view"): 3, (2, "error"): 1, (13, "view"): 1}, 0)
    feed.add((6, 7, 1, "view"), (7, 24 * 10, 1, "view"), (5, 24 * 12, 1, "view"))  # one out of time
    assert run() == ({(1, "view"): 3, (2, "error"): 1, (13, "view"): 1, (11, "view"): 1}, 1)
