"""Boards as a data source (S14, S15, S17, S18, S21 of the survey): sites that answer with pages of a listing.

A board is a folder with ``site=<name>/page=<n>/`` for each page, JSON lines ``id, title, lang, posted, total``; ``total`` is what the site says it
has. Each site's pages are cut into ranges, one input partition each. Filters on site, language and date go into the source, as
a board's own search fields would take them: sites that are not asked for are never listed, and rows that do not fit are dropped where
they are read. A site ends at its first empty page.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition

PAGES_TOGETHER = 4
SCHEMA = "site string, page int, id string, title string, lang string, posted date, total bigint"


@dataclass
class Pages(InputPartition):
    """Some pages of one site."""

    site: str
    first: int
    after: int


class BoardPages(DataSource):
    """``spark.read.format("board_pages").option("path", folder).load()``; option ``pages`` says how many pages a task reads."""

    @classmethod
    def name(cls) -> str:
        return "board_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("pages", PAGES_TOGETHER)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, together: int):
        self.path, self.together = path, together
        self.sites: set[str] | None = None
        self.langs: set[str] | None = None
        self.since: dt.date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and lists of sites and languages, and the earliest date; everything else stays with Spark."""
        for f in filters:
            column = f.attribute if isinstance(f, (EqualTo, In, GreaterThanOrEqual)) else ()
            if column in (("site",), ("lang",)) and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f"{column[0]}s"
                before = getattr(self, name)
                setattr(self, name, values if before is None else before & values)
            elif column == ("posted",) and isinstance(f, GreaterThanOrEqual):
                self.since = max(f.value, self.since or f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for site, pages in sorted(_folders(self.path, "site=").items()):
            if self.sites is None or site in self.sites:
                n = 1 + max((int(p) for p in _folders(pages, "page=")), default=-1)
                out += [Pages(site, at, min(n, at + self.together)) for at in range(0, n, self.together)]
        return out or [Pages("", 0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.after):
            rows = list(_lines(f"{self.path}/site={partition.site}/page={page}"))
            if not rows:
                return
            for r in rows:
                posted = dt.date.fromisoformat(r["posted"]) if r.get("posted") else None
                if (self.langs is None or r.get("lang") in self.langs) and (self.since is None or posted is not None and posted >= self.since):
                    yield partition.site, page, r.get("id"), r.get("title"), r.get("lang"), posted, r.get("total")


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _folders(path: str, prefix: str) -> dict[str, str]:
    """Sub-folders with a prefix: what follows it, and the whole path."""
    from pyarrow import fs

    system, inner = _system(path)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return {f.base_name.removeprefix(prefix): f"{path}/{f.base_name}" for f in found if f.base_name.startswith(prefix)}


def _lines(path: str) -> Iterator[dict]:
    from pyarrow import fs

    system, inner = _system(path)
    for f in sorted(system.get_file_info(fs.FileSelector(inner, allow_not_found=True)), key=lambda f: f.base_name):
        if f.base_name.endswith(".json"):
            with system.open_input_stream(f.path) as lines:
                for line in lines.read().splitlines():
                    if line.strip():
                        yield json.loads(line)


def write_boards(listing: DataFrame, path: str, size: int = 50) -> None:
    """Writes a listing (``site, id, title, lang, posted``) as pages of ``size`` rows by id, with each site's total."""
    from tessera.session import ranked

    rows = ranked(listing.select("site", "id", "title", "lang", "posted"), ["site"], [F.col("id")], "place").join(listing.groupBy("site").agg(F.count("*").alias("total")), "site")
    rows.withColumn("page", F.floor((F.col("place") - 1) / size).cast("int")).drop("place").repartition("site", "page").write.partitionBy("site", "page").json(path)


def boards(spark: SparkSession, path: str, pages: int = PAGES_TOGETHER) -> DataFrame:
    """The listings under a folder. Filters reach the source, which Spark allows for Python sources by a setting.

    Spark asks a loaded source once what it takes; a table that is to be read with and without filters is to be loaded twice.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BoardPages)
    return spark.read.format("board_pages").option("path", path).option("pages", str(pages)).load()


def completeness(listing: DataFrame, cap: int = 400) -> DataFrame:
    """``site, listed, total, complete``: whether as many rows came as the site says it has, and fewer than a site shows at most."""
    counts = listing.groupBy("site").agg(F.count("*").alias("listed"), F.max("total").alias("total"))
    return counts.withColumn("complete", (F.col("listed") >= F.col("total")) & (F.col("listed") < cap))
