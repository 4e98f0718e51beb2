"""A data source that harvests a literature service.

The service answers at most so many records for one query, so the range of dates is halved until each leaf has few enough;
a single day that still has too many is halved by record number. Leaves are planned once, on the driver, and read side by
side; their number bounds how many requests run at once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusgraph.sources.article_xml import SCHEMA, parse_articles
from corpusgraph.sources.json_arrays import ARTICLE

#: Records of a leaf and of a page, the range of record numbers, tries and the longest wait for an answer.
LEAF, PAGE, IDS, TRIES, TIMEOUT = 9000, 500, (1, 99_999_999), 5, 60.0


class Service(Protocol):
    """What the source asks. It is sent to the workers, so it must pickle."""

    def count(self, query: str) -> int: ...

    def fetch(self, query: str, start: int, size: int) -> str: ...


@dataclass(frozen=True)
class Leaf(InputPartition):
    """A query and how many records it has."""

    query: str
    size: int

    def __init__(self, query: str, size: int) -> None:
        object.__setattr__(self, "query", query)
        object.__setattr__(self, "size", size)


def build_query(term: str, low: date, high: date, ids: tuple[int, int] | None = None) -> str:
    """The term within a range of dates, both ends included, and of record numbers if given."""
    parts = [f"({term})", f'("{low:%Y/%m/%d}"[PDAT] : "{high:%Y/%m/%d}"[PDAT])']
    if ids:
        parts.append(f"({ids[0]}:{ids[1]}[UID])")
    return " AND ".join(parts)


def patient(ask: Callable[[], object], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> object:
    """The answer, asked for again after 1, 2, 4 ... seconds where it fails; the last failure is raised."""
    for turn in range(tries):
        try:
            return ask()
        except OSError:
            if turn + 1 == tries:
                raise
            sleep(2.0**turn)
    raise ValueError("tries must be at least 1")


def plan(count: Callable[[str], int], term: str, low: date, high: date, leaf: int = LEAF, ids: tuple[int, int] = IDS) -> list[Leaf]:
    """Leaves of at most ``leaf`` records that cover every record of the range once.

    A single record number with more records than that can't be halved; it becomes a leaf as it is.
    """
    out: list[Leaf] = []
    open_ranges: list[tuple[date, date, tuple[int, int] | None]] = [(low, high, None)]
    while open_ranges:
        first, last, numbers = open_ranges.pop()
        query = build_query(term, first, last, numbers)
        size = count(query)
        if size == 0:
            continue
        if size <= leaf or (numbers and numbers[0] == numbers[1]):
            out.append(Leaf(query, size))
        elif first < last:
            middle = first + (last - first) // 2
            open_ranges += [(middle + timedelta(days=1), last, None), (first, middle, None)]
        else:
            bottom, top = numbers or ids
            middle = (bottom + top) // 2
            open_ranges += [(first, last, (middle + 1, top)), (first, last, (bottom, middle))]
    return out


class HarvestReader(DataSourceReader):
    def __init__(self, service: Service, options: dict[str, str]) -> None:
        self.service, self.options = service, options

    def partitions(self) -> list[Leaf]:
        low, high = (date.fromisoformat(self.options[k]) for k in ("from", "to"))
        leaf = int(self.options.get("leaf", LEAF))
        ids = (int(self.options.get("lowId", IDS[0])), int(self.options.get("highId", IDS[1])))
        return plan(lambda q: int(patient(lambda: self.service.count(q))), self.options["term"], low, high, leaf, ids) or [Leaf("", 0)]

    def read(self, partition: Leaf) -> Iterator[tuple]:
        page, pause = int(self.options.get("page", PAGE)), float(self.options.get("pause", 0.11))
        for start in range(0, partition.size, page):
            xml = patient(lambda start=start: self.service.fetch(partition.query, start, page))
            for article in parse_articles(str(xml)):
                yield tuple(article[f] for f in ARTICLE)
            if pause:
                time.sleep(pause)


def register(spark: SparkSession, service: Service, name: str = "literature") -> None:
    """Make ``spark.read.format(name)`` harvest ``service``.

    Options: ``term``, ``from``, ``to`` (ISO dates), and ``leaf``, ``page``, ``pause``, ``lowId``, ``highId``. Credentials
    belong to the service, which takes them from the environment of the workers, never from options that plans show.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> HarvestReader:
            return HarvestReader(service, dict(self.options))

    spark.dataSource.register(Source)


def credentials(values: dict[str, str]) -> tuple[str, str]:
    """(email, key), both required and not blank."""
    email, key = (str(values.get(k, "")).strip() for k in ("email", "api_key"))
    if not email or not key:
        raise ValueError("email and api_key must be given")
    return email, key
