"""Runs over several sources: what is due, what fails, and where a run goes on."""

from __future__ import annotations

import datetime

import pytest

from lectern.catalogue import Catalogue
from lectern.streaming import sync

TODAY = datetime.date(2024, 5, 9)


def book(n: int, topic: str, source: str) -> tuple:
    return (f"{n:032x}", f"title {n}", "a", "", "", "", "", "epub", 1, 1, [], source)


SCHEMA = "md5 string, title string, author string, series string, publisher string, year string, language string, extension string, filesize long, pages long, isbn array<string>, source string"


def loads(catalogue, source, topic, n):
    def load():
        catalogue.apply(catalogue.spark.createDataFrame([], "md5 string"), catalogue.spark.createDataFrame([book(n, topic, source)], SCHEMA))
        state = catalogue.store.load_state()
        state.setdefault("next_file_ids", {})[topic] = 10
        catalogue.store.save_state(state)

    return load


def test_pages_end_where_nothing_is_new():
    listing = [{str(i): {} for i in range(k, k + 3)} for k in (0, 3, 3, 9)]
    asked = []
    got = list(sync.pages(lambda offset, limit: asked.append((offset, limit)) or listing[offset // 3], 3))
    assert got == listing[:3] and asked == [(0, 3), (3, 3), (6, 3)]
    assert list(sync.pages(lambda o, n: {"1": {}} if o == 0 else 1 / 0, 2)) == [{"1": {}}]
    assert list(sync.pages(lambda o, n: {}, 0)) == [{}]


def test_a_run_imports_walks_and_replays(spark, tmp_path):
    c = Catalogue(spark, f"file://{tmp_path}/store")
    asked, days = [], []
    file = lambda n, **k: {"md5": f"{n:032x}", "extension": "epub", "visible": "", "broken": "", "topic": "f", "fiction_id": n, "editions": {"a": {"e_id": "5"}}} | k
    edition = {"5": {"title": "five", "visible": ""}}

    def new_files(start, size):
        asked.append(start)
        return ({str(n): file(n) for n in (12, 31) if start <= n < start + size}, edition)

    def changed(day, following):
        days.append((day, following))
        return ({"1": file(1, broken="Y")}, {}) if day == "2024-05-08" else ({}, {})

    def fails():
        raise OSError("no listing")

    good = sync.Source("good", "f", lambda: ("2024-05-08", loads(c, "good", "f", 1)), new_files, changed)
    bad = sync.Source("bad", "l", fails)
    with pytest.raises(RuntimeError, match="bad: no listing"):
        sync.Sync(c, [bad, good], page=5).run(TODAY)
    # windows roll behind the last id that was found and end after four empty ones
    assert asked == [10, 13, 18, 23, 28, 32, 37, 42, 47]
    assert [d for d, _ in days] == ["2024-05-07", "2024-05-08", "2024-05-09"] and days[-1][1] is None
    state = c.store.load_state()
    assert state["sources"] == {"good": {"bootstrapped": True, "snapshot": "2024-05-08", "synced_until": "2024-05-09"}} and state["next_file_ids"]["f"] == 32
    assert {r["md5"] for r in c.books().collect()} == {f"{n:032x}" for n in (12, 31)}
    # once it is there, a source's snapshots are no longer looked for, and a run goes on from its places
    days.clear()
    asked.clear()
    again = sync.Sync(c, [sync.Source("good", "f", fails, new_files, changed)], page=5)
    again.run(TODAY + datetime.timedelta(days=1))
    assert asked == [32, 37, 42, 47] and [d for d, _ in days] == ["2024-05-09", "2024-05-10"]
    # without updates, the same day's snapshot isn't imported twice
    assert sync.Sync(c, [], updates=False).due(sync.Source("good", "f", lambda: ("2024-05-08", fails))) is None
    assert sync.Sync(c, [], updates=False).due(sync.Source("good", "f", lambda: ("2024-06-08", fails))) is not None


def test_one_run_at_a_time(spark, tmp_path):
    c = Catalogue(spark, f"file://{tmp_path}/store")
    runs = sync.Sync(c, [])
    runs._running = True
    with pytest.raises(sync.Busy):
        runs.run(TODAY)
