"""Keeping a catalogue current: listings by page, and runs over several sources.

A run imports the snapshots that are due, each source for itself, walks the ids of
new files, and replays the days of changes one by one; its place is saved after
every step, so a run that ends early goes on from there. What fails in one source
doesn't stop the others; the first error is raised at the end.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.catalogue import Catalogue
from lectern.streaming.incremental import MOST_EMPTY

#: Most records of a page.
PAGE = 10_000


def pages(fetch: Callable[[int, int], dict[str, dict]], size: int) -> Iterator[dict[str, dict]]:
    """The pages of a listing, fetch(offset, limit) each, up to a short one or one that brings no new record."""
    size, offset, seen = min(max(size, 1), PAGE), 0, set()
    while True:
        page = fetch(offset, size)
        yield page
        known = len(seen)
        seen |= page.keys()
        if len(page) < size or len(seen) == known:
            return
        offset += size


def listed(recorded: DataFrame, size: int) -> DataFrame:
    """What a walk over recorded pages (listing, page, id, value) keeps: each id's value of the last page that it reads.

    It reads up to the first page with fewer ids than ``size``, or without a new one."""
    first = recorded.groupBy("listing", "id").agg(F.min("page").alias("page"))
    news = first.groupBy("listing", "page").agg(F.count("*").alias("news"))
    held = recorded.groupBy("listing", "page").agg(F.countDistinct("id").alias("n")).join(news, ["listing", "page"], "left")
    ends = held.where((F.col("n") < size) | F.col("news").isNull()).groupBy("listing").agg(F.min("page").alias("end"))
    read = recorded.join(ends, "listing", "left").where(F.col("end").isNull() | (F.col("page") <= F.col("end")))
    return read.groupBy("listing", "id").agg(F.max_by("value", F.struct("page", "value")).alias("value"))


@dataclass
class Source:
    """name; topic of its changes; snapshot: the day of the newest one and how to import it, or None; new_files(start, size) and changed(day, next day) give (files, editions) as records by id."""

    name: str
    topic: str
    snapshot: Callable[[], tuple[str, Callable[[], None]] | None]
    new_files: Callable[[int, int], tuple[dict, dict]] | None = None
    changed: Callable[[str, str | None], tuple[dict, dict]] | None = None


class Busy(RuntimeError):
    """A run is still going on."""


class Sync:
    def __init__(self, catalogue: Catalogue, sources: list[Source], updates: bool = True, page: int = 1000, prefix: str = "", id_field: Callable[[str], str] = lambda topic: "fiction_id" if topic == "f" else "id"):
        self.catalogue, self.sources, self.updates, self.page, self.prefix, self.id_field, self._running = catalogue, sources, updates, min(max(page, 1), PAGE), prefix, id_field, False

    def state(self) -> dict:
        return self.catalogue.store.load_state()

    def _save(self, change: Callable[[dict], None]) -> None:
        state = self.state()
        change(state)
        self.catalogue.store.save_state(state)

    def due(self, source: Source) -> Callable[[], None] | None:
        """The import that a source needs: none once it is there and updates follow it, nor for the same day's snapshot."""
        held = self.state().get("sources", {}).get(source.name, {})
        if held.get("bootstrapped") and self.updates:
            return None
        found = source.snapshot()
        if found is None or held.get("snapshot") == found[0]:
            return None
        day, load = found

        def import_it() -> None:
            load()
            # changes of the day before a snapshot may not be in it
            since = (datetime.date.fromisoformat(day) - datetime.timedelta(days=1)).isoformat()
            self._save(lambda s: s.setdefault("sources", {}).setdefault(source.name, {}).update(bootstrapped=True, snapshot=day, synced_until=since))

        return import_it

    def run(self, today: datetime.date) -> dict:
        """One run over all sources; the first error is raised when all has been tried."""
        if self._running:
            raise Busy("a run is still going on")
        self._running, errors = True, []
        try:
            for source in self.sources:
                try:
                    if load := self.due(source):
                        load()
                except Exception as e:  # noqa: BLE001
                    errors.append((source.name, e))
            if self.updates:
                try:
                    there = [s for s in self.sources if self.state().get("sources", {}).get(s.name, {}).get("bootstrapped")]
                    for source in there:
                        self._new_files(source)
                    self._days(there, today)
                except Exception as e:  # noqa: BLE001
                    errors.append(("updates", e))
        finally:
            self._running = False
        if errors:
            raise RuntimeError(f"{errors[0][0]}: {errors[0][1]}") from errors[0][1]
        return self.state()

    def _apply(self, source: Source, files: dict, editions: dict) -> None:
        body = lambda x: self.catalogue.spark.createDataFrame([(json.dumps(x),)], "body string")
        self.catalogue.apply(*self.catalogue.changed_books(body(files), body(editions), {source.topic: source.name}, self.prefix))

    def _new_files(self, source: Source) -> None:
        """Windows of ids from the last one on; several empty ones in a row are the end."""
        start = self.state().get("next_file_ids", {}).get(source.topic)
        if start is None or source.new_files is None:
            return
        empty = 0
        while empty < MOST_EMPTY:
            at = start + empty * self.page
            files, editions = source.new_files(at, self.page)
            if not files:
                empty += 1
                continue
            self._apply(source, files, editions)
            start, empty = max(at, *(int(f.get(self.id_field(source.topic)) or 0) for f in files.values())) + 1, 0
            self._save(lambda s, to=start: s.setdefault("next_file_ids", {}).update({source.topic: to}))

    def _days(self, sources: list[Source], today: datetime.date) -> None:
        """From the least of the sources' days on, none older than the catch-up, one batch a day; the last day is asked again next time."""
        held = self.state().get("sources", {})
        oldest = today - datetime.timedelta(days=self.catalogue.catch_up_days)
        known = [datetime.date.fromisoformat(held[s.name]["synced_until"]) for s in sources if held[s.name].get("synced_until")]
        day = max(min(known, default=oldest), oldest)
        while day <= today:
            following = day + datetime.timedelta(days=1)
            for source in sources:
                if source.changed is not None:
                    files, editions = source.changed(day.isoformat(), following.isoformat() if day < today else None)
                    if files:
                        self._apply(source, files, editions)
            until = min(following, today).isoformat()
            self._save(lambda s, to=until: [s["sources"][x.name].update(synced_until=to) for x in sources])
            day = following
