"""The board source, and structured data of any depth."""

import contextlib
import datetime as dt
import io
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from tessera.session import new_folder
from tessera.sources import boards, postings


@pytest.fixture(scope="module")
def folder(spark):
    rows = [("hot.nl", f"{i:03}", f"job {i}", "nl" if i % 2 else "en", dt.date(2024, 1, 1 + i % 28)) for i in range(70)] + [("small.nl", "1", "job", None, None)]
    path = new_folder(spark, "board-test")
    boards.write_boards(spark.createDataFrame(rows, "site string, id string, title string, lang string, posted date"), path, 10)
    return path


def test_pages_and_partitions(spark, folder):
    read = boards.boards(spark, folder, 2)
    rows = read.collect()
    assert len(rows) == 71 and {(r.page, r.total) for r in rows if r.site == "hot.nl"} == {(n, 70) for n in range(7)}
    assert read.rdd.getNumPartitions() == 5  # seven pages two by two, and one
    assert {r.site: (r.listed, r.complete) for r in boards.completeness(read).collect()} == {"hot.nl": (70, True), "small.nl": (1, True)}
    assert {r.site: r.complete for r in boards.completeness(read, 70).collect()} == {"hot.nl": False, "small.nl": True}
    assert not boards.completeness(read.filter("id <> '003'")).filter("site = 'hot.nl'").first().complete


def test_filters_are_pushed(spark, folder):
    read = boards.boards(spark, folder, 2).filter((F.col("site") == "hot.nl") & F.col("lang").isin("nl", "de") & (F.col("posted") >= F.lit(dt.date(2024, 1, 15))) & (F.col("title") != "job 15"))
    with contextlib.redirect_stdout(io.StringIO()) as said:
        read.explain("formatted")
    plan = {k: next(line for line in said.getvalue().splitlines() if line.startswith(k)) for k in ("PushedFilters", "Condition")}
    assert all(x in plan["PushedFilters"] for x in ("EqualTo(site,hot.nl)", "In(lang, [de,nl])", "GreaterThanOrEqual(posted,2024-01-15)"))
    assert "hot.nl" not in plan["Condition"] and "job 15" in plan["Condition"]
    want = {f"{i:03}" for i in range(70) if i % 2 and 1 + i % 28 >= 15 and i != 15}
    assert {r.id for r in read.collect()} == want
    reader = boards._Reader(folder, 2)
    assert len(list(reader.pushFilters([EqualTo(("site",), "small.nl"), In(("lang",), ("nl",)), GreaterThanOrEqual(("posted",), dt.date(2024, 1, 1)), LessThan(("page",), 3)]))) == 1
    assert [p.site for p in reader.partitions()] == ["small.nl"] and list(reader.read(reader.partitions()[0])) == []


def test_a_site_ends_at_an_empty_page(spark, tmp_path):
    for page, rows in ((0, 2), (1, 0), (2, 2)):
        at = tmp_path / "site=a" / f"page={page}"
        at.mkdir(parents=True)
        (at / "part.json").write_text("".join(json.dumps({"id": f"{page}{i}", "total": 4}) + "\n" for i in range(rows)))
    read = boards.boards(spark, tmp_path.as_uri())
    assert sorted(r.id for r in read.collect()) == ["00", "01"] and not boards.completeness(read).first().complete
    (tmp_path / "none").mkdir()
    assert boards.boards(spark, (tmp_path / "none").as_uri()).count() == 0


def walker(data):
    """The reference's rule, by recursion."""
    if isinstance(data, list):
        return [p for x in data for p in walker(x)]
    if isinstance(data, dict):
        kind = data.get("@type")
        if "JobPosting" in (kind if isinstance(kind, list) else [kind]):
            return [data]
        return walker(data["@graph"]) if "@graph" in data else []
    return []


def nest(rng, depth):
    if depth == 0:
        return rng.choice([{"@type": "JobPosting", "title": f"t{rng.random()}"}, {"@type": ["X", "JobPosting"], "title": "é\"</p>"}, {"@type": "Thing", "a": {"@type": "JobPosting"}}, 3, None, "JobPosting"])
    inner = [nest(rng, depth - 1) for _ in range(rng.randrange(1, 3))]
    return rng.choice([inner, {"@context": "x", "@graph": inner}, {"@graph": inner[0]}, {"@type": "JobPosting", "title": "outer", "@graph": inner}])


def test_nested_json_ld(spark):
    rng = random.Random(8)
    nests = [nest(rng, depth) for depth in range(9) for _ in range(12)]
    nests += [json.loads("[" * 500 + '{"@type":"JobPosting","title":"deep"}' + "]" * 500)]
    pages = [(i, "".join(f"<script type='application/ld+json'>{b}</script>" for b in ("{broken JobPosting", json.dumps(n), '{"@type":"JobPosting","title":NaN}'))) for i, n in enumerate(nests)]
    found = postings.json_ld(spark.createDataFrame([*pages, (None, None), (-1, "")], "page_id int, html string")).select("page_id", "posting.title").collect()
    want = [(i, p["title"]) for i, n in enumerate(nests) for p in walker(n)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str) and len(want) > 60
