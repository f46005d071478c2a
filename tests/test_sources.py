"""Readers, payloads and sinks over small files."""

import json

import pytest
from fakes import fake_vectors
from pyspark.sql import functions as F

from tessera.operators import documents
from tessera.session import shared_dir
from tessera.sources import postings, readers, sinks

LONG = "word " * 60


def put(folder, name, *lines):
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def test_adverts_and_details(spark, tmp_path):
    put(tmp_path, "board.jsonl", {"source": "board", "source_id": "1", "title": "a"}, "", {"source": "board", "source_id": "2"})
    got = readers.adverts(spark, str(tmp_path)).select("key", "stem", "title").collect()
    assert sorted(tuple(r) for r in got) == [("board:1", "board", "a"), ("board:2", "board", None)]
    logs = tmp_path / "logs"
    logs.mkdir()
    put(logs, "a.jsonl", {"key": "k", "model": "m", "details": {"title": "old"}}, {"key": "k", "model": "m", "details": {"title": "new"}}, {"key": "l", "model": "m", "details": {"title": "l"}})
    put(logs, "b.jsonl", {"key": "l", "model": "m", "details": {"title": "later source"}})
    assert {r.key: r.details.title for r in readers.details(spark, str(logs)).collect()} == {"k": "new", "l": "later source"}


def test_samples_with_sidecars(spark, tmp_path):
    texts, sides = tmp_path / "t", tmp_path / "s"
    texts.mkdir(), sides.mkdir()
    (texts / "one.txt").write_text("First line\nrest")
    (texts / "two.txt").write_text("No sidecar\nrest")
    put(sides, "one.json", {"details": {"title": "Stated"}})
    assert {r.stem: r.title for r in readers.samples(spark, str(texts), str(sides)).collect()} == {"one": "Stated", "two": "No sidecar"}
    assert {r.stem: r.title for r in readers.samples(spark, str(texts)).collect()} == {"one": "First line", "two": "No sidecar"}


def test_published_sets_and_vectors(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "key string, vector array<double>")
    extra = spark.createDataFrame([("a", 1), ("b", 2)], "key string, details int")
    sinks.publish(rows, extra, str(tmp_path / "p"), "m1")
    sinks.publish(rows.limit(1), extra, str(tmp_path / "p"), "m2")
    assert readers.published(spark, str(tmp_path / "p"), "m1").count() == 2 and readers.published(spark, str(tmp_path / "p")).count() == 3
    with pytest.raises(ValueError, match="not extracted"):
        sinks.publish(rows, extra.filter("key = 'a'"), str(tmp_path / "p"), "m1")
    assert readers.published(spark, str(tmp_path / "p"), "m1").count() == 2
    assert [r.key for r in readers.vectors(rows, extra.filter("key = 'b'")).collect()] == ["b"]
    sinks.append_new(rows, rows.filter("key = 'a'"), "key", str(tmp_path / "log"))
    assert [r.key for r in spark.read.json(str(tmp_path / "log")).collect()] == ["b"]


def test_small_files(spark, tmp_path):
    put(tmp_path, "x.csv", "# a comment", "name,lat", "Alphen,52.1")
    assert [tuple(r) for r in readers.commented_csv(spark, str(tmp_path / "x.csv"), "name string, lat double").collect()] == [("Alphen", 52.1)]
    assert readers.settings("[indeed]\nenabled = true\n") == {"indeed": {"enabled": True}}
    put(tmp_path, "q.json", [{"split": "dev", "query": "q1", "relevant": ["a", "b"]}, {"split": "dev", "query": "q2", "relevant": []}])
    assert sorted((r.query, r.doc_id or "") for r in readers.labelled_queries(spark, str(tmp_path / "q.json")).collect()) == [("q1", "a"), ("q1", "b"), ("q2", "")]
    put(tmp_path, "state.json", {"k1": {"board": "b", "strikes": 2}, "k2": {"board": "c"}})
    got = readers.keyed_json(spark, str(tmp_path / "state.json"), "struct<board:string,strikes:int>").collect()
    assert {r.key: (r.board, r.strikes) for r in got} == {"k1": ("b", 2), "k2": ("c", None)}
    (tmp_path / "hello.bin").write_bytes(b"hello")
    assert readers.listing(spark, str(tmp_path / "hello.bin")).first().md5 == "XUFAKrxLKna5cZ2REBfFkg=="


def test_reports_in_order(spark, tmp_path):
    put(tmp_path, "run_fetch.json", {"run_started": "2024-01-02T00:00:00Z", "searches": []})
    put(tmp_path, "run-2_fetch.json", {"run_started": "2024-01-02T00:00:00Z", "searches": []})
    put(tmp_path, "early_fetch.json", {"run_started": "2024-01-01T00:00:00Z", "searches": []})
    assert [(str(r.run_started)[:10], r.attempt) for r in readers.reports(spark, str(tmp_path)).collect()] == [("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-02", 2)]


def test_boards(spark):
    offers = spark.createDataFrame([(f"<p>Do {LONG}</p>", "<li>know</li>")], "description string, requirements string")
    assert postings.recruitee(offers).first().text.endswith("- know")
    jobs = spark.createDataFrame([("&lt;p&gt;a &amp;amp; b, mail x@y.nl&lt;/p&gt;",)], "content string")
    assert postings.greenhouse(jobs).first().text == "a & b, mail [email removed]"
    listing = spark.createDataFrame([("1", "b", 3, "keep"), ("2", "b", 3, "drop"), ("3", "b", 3, "keep")], "id string, board string, total int, title string")
    details = spark.createDataFrame([("1", "d1"), ("3", "d3")], "id string, text string")
    known = spark.createDataFrame([("3",)], "id string")
    assert [r.id for r in postings.listed_with_details(listing, details, known, F.col("title") == "keep").collect()] == ["1"]
    assert postings.complete(listing).first().complete and not postings.complete(listing.limit(2)).first().complete and not postings.complete(listing, 3).first().complete
    maps = spark.createDataFrame([("s", "<urlset><url><loc> https://a.nl/x </loc><lastmod>2024-01-02T00:00:00Z</lastmod></url><url><loc>https://a.nl/y</loc></url></urlset>")], "site string, xml string")
    assert [(r.url, str(r.changed)[:10]) for r in postings.sitemap_urls(maps).orderBy("url").collect()] == [("https://a.nl/x", "2024-01-02"), ("https://a.nl/y", "None")]


def test_scraped_rows(spark):
    rows = spark.createDataFrame([("in-1", "u1", "T", "nan", f"<p>{LONG}</p>", "a@b.nl"), (None, "u2", "T", "c", LONG, None), ("in-3", "u3", "T", "c", "short", None)], "id string, job_url string, title string, company string, description string, emails string")
    (got,) = postings.scraped(rows, "indeed").collect()
    assert (got.source_id, got.url, got.company) == ("1", "u1", None) and json.loads(got.raw) == {"id": "in-1", "job_url": "u1", "title": "T"}


def test_cached_vectors(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id int, document string")
    cache = spark.createDataFrame([], "key string, vector array<float>")
    first, made = documents.with_vectors(docs, cache, "m", fake_vectors)
    assert first.count() == 3 and made.count() == 2
    again, none = documents.with_vectors(docs, made, "m", fake_vectors)
    assert again.count() == 3 and none.count() == 0


def test_the_shared_folder(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")


def test_a_store_in_buckets_is_not_shuffled(spark):
    rows = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v"))
    store = sinks.bucketed(rows.filter("v % 2 = 0"), "store", 4)
    night = rows.filter("v % 5 = 0").withColumn("v", F.col("v") + 5000)
    merged = sinks.merged(store, night.unionByName(night), 4)

    def exchanges(frame):
        """Exchanges that have the store below them: none may stand between a scan of buckets and a join."""
        plan = frame._jdf.queryExecution().executedPlan().toString()
        depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
        lines, found = plan.split("\n"), 0
        for n, line in enumerate(lines):
            if "FileScan parquet" in line and "Bucketed: true" in line:
                above, at = depth(line), n
                while at > 0 and "Join" not in lines[at]:
                    at -= 1
                    if depth(lines[at]) < above:
                        above = depth(lines[at])
                        found += "Exchange" in lines[at]
        return found

    assert "Bucketed: true" in merged._jdf.queryExecution().executedPlan().toString() and exchanges(merged) == 0
    want = {f"k{i}": i for i in range(0, 1000, 2)} | {f"k{i}": i + 5000 for i in range(0, 1000, 5)}
    again = sinks.bucketed(merged, "again", 4)
    assert {r.key: r.v for r in again.collect()} == want
    found = sinks.looked_up(again, rows.filter("v < 10").unionByName(rows.filter("v < 10")))
    assert exchanges(found) == 0 and {r.key: r.v for r in found.collect()} == {f"k{i}": want[f"k{i}"] for i in range(10) if f"k{i}" in want}
    assert sinks.merged(sinks.bucketed(rows.limit(0), "none", 4), night.limit(0), 4).count() == 0
