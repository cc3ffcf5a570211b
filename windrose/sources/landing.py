"""A stream of the files that land in a folder of feeds: each file once, the newest first, so many of each feed in a batch.

    spark.dataSource.register(Landing)
    spark.readStream.format("landing").option("limit", 50).option("settle", 30).load(folder)

gives (feed, path, modified) for ``<folder>/<feed>/<file>``; what follows reads the files on the executors. The offset holds, for each feed, which spans in the order of (time of modification,
name) have been read: after a backlog, the newest span and the older one grow together until they meet. So files of equal times, restarts and replays neither lose nor repeat a file.

Files younger than ``settle`` seconds wait, as they may still be written; files older than ``oldest`` seconds (none, if not given) never count. A file that lands later with a
time inside a span that has been read is taken as read: keep times when moving files, or let ``settle`` cover the delay. The driver lists names only.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .gridded import system

Mark = list  # [nanoseconds, name]


def covered(spans: list[list[Mark]], mark: Mark) -> bool:
    return any(low <= mark <= high for low, high in spans)


def joined(spans: list[list[Mark]], taken: list[Mark], order: list[Mark]) -> list[list[Mark]]:
    """Spans that also hold ``taken``: neighbours in ``order`` that are both read lie in one span."""
    out: list[list[Mark]] = []
    marks = sorted([m for m in order if covered(spans, m) or m in taken] + [x for span in spans for x in span])
    position = {tuple(m): i for i, m in enumerate(order)}
    for mark in marks:
        inside = out and (covered([s for s in spans if s[0] <= out[-1][1] <= s[1]], mark) or mark == out[-1][1])
        beside = out and tuple(mark) in position and tuple(out[-1][1]) in position and position[tuple(mark)] - position[tuple(out[-1][1])] == 1
        if inside or beside:
            out[-1][1] = max(out[-1][1], mark)
        else:
            out.append([mark, mark])
    return out


class LandingReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, limit: int, settle: float, oldest: float | None):
        self.path, self.limit, self.settle, self.oldest = path, limit, settle, oldest

    def initialOffset(self) -> dict:
        return {"feeds": {}}

    def listed(self) -> dict[str, list[Mark]]:
        """Marks of each feed in order."""
        store, top = system(self.path)
        found: dict[str, list[Mark]] = {}
        for info in store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
            feed, _, name = info.path.removeprefix(top).strip("/").partition("/")
            if info.type == fs.FileType.File and name:
                found.setdefault(feed, []).append([info.mtime_ns, name])
        return {feed: sorted(marks) for feed, marks in found.items()}

    def row(self, feed: str, mark: Mark) -> tuple:
        return feed, f"{self.path.rstrip('/')}/{feed}/{mark[1]}", mark[0] / 1e9

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now, rows, feeds = time.time(), [], {k: v for k, v in start["feeds"].items()}
        for feed, marks in self.listed().items():
            spans = feeds.get(feed, [])
            ready = [m for m in marks if m[0] / 1e9 <= now - self.settle and (self.oldest is None or m[0] / 1e9 >= now - self.oldest)]
            taken = [m for m in ready if not covered(spans, m)][-self.limit :]
            rows += [self.row(feed, m) for m in reversed(taken)]
            if taken:
                feeds[feed] = joined(spans, taken, marks)
        return iter(rows), {"feeds": feeds}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        listed = self.listed()
        return iter([self.row(f, m) for f, spans in end["feeds"].items() for m in reversed(listed.get(f, [])) if covered(spans, m) and not covered(start["feeds"].get(f, []), m)])

    def commit(self, end: dict) -> None:
        pass


class Landing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return "feed string, path string, modified double"

    def simpleStreamReader(self, schema) -> LandingReader:
        o = self.options
        return LandingReader(o["path"], int(o.get("limit", "1000")), float(o.get("settle", "30")), float(o["oldest"]) if "oldest" in o else None)
