import math
import random

from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import documents, gaps, metrics, preferences, reports
from tessera.sources import postings, sinks


def test_concordance_like_pairs(spark):
    rng = random.Random(2)
    rows = [("a", rng.randrange(3), float(rng.randrange(6))) for _ in range(60)] + [("b", 1, 2.0)]
    items = [r[1:] for r in rows if r[0] == "a"]
    pairs = [(x, y) for i, x in enumerate(items) for y in items[i + 1 :] if x[0] != y[0]]
    want = sum(0.5 if x[1] == y[1] else (x[1] > y[1]) == (x[0] > y[0]) for x, y in pairs) / len(pairs)
    got = {r.k: r for r in metrics.concordance(spark.createDataFrame(rows, "k string, grade int, score double"), "k").collect()}
    assert math.isclose(got["a"].concordance, want) and got["a"].pairs == len(pairs) and got["b"].concordance is None


def test_list_score(spark):
    empty = F.array().cast("array<string>")
    score = lambda e, p: spark.range(1).select(metrics.list_score(e, p).alias("s")).first().s
    assert (score(empty, empty).precision, score(empty, empty).f1) == (1.0, 1.0)
    assert score(empty, F.array(F.lit("a"))).recall == 0.0
    got = score(F.array(F.lit("Utrecht "), F.lit("b.")), F.array(F.lit("utrecht"), F.lit("c")))
    assert got.precision == 0.5 and got.missing == ["b"] and got.extra == ["c"]


def test_upper_median(spark):
    frame = spark.createDataFrame([("a", x) for x in (5, 1, 4, 2)] + [("b", x) for x in (3, 1, 2)], "k string, v int")
    assert {r.k: r.m for r in frame.groupBy("k").agg(metrics.upper_median("v").alias("m")).collect()} == {"a": 4, "b": 2}


def test_requirement_bands(spark):
    rows = [
        ("all", "skill", True, False, "met", "same", 0), ("knock", "skill", True, True, "missing", "same", 0), ("none", "eligibility", True, False, "met", "next", 0),
        ("odd", "skill", True, False, "met", "same", 1), ("half", "skill", True, False, "partly", "next", 0),
    ]
    frame = spark.createDataFrame(rows, "k string, kind string, must boolean, knockout boolean, status string, work string, conflicts int")
    got = {r.k: (r.verdict, r.fit) for r in preferences.requirement_scores(frame, "k").collect()}
    assert got == {"all": ("strong", 100), "knock": ("weak", 6), "none": ("possible", 67), "odd": ("possible", 57), "half": ("possible", 64)}


def test_conflicts(spark):
    none, empty = (lambda k: F.lit(None).cast(k)), F.array().cast("array<string>")
    advert = {"contract_type": F.lit("freelance"), "work_mode": F.lit("remote"), "hours_min": F.lit(32), "hours_max": none("int"), "salary_min": F.lit(20.0), "salary_max": none("double"), "salary_period": F.lit("hour"), "km": F.lit(100.0), "languages": F.array(F.lit("Dutch"), F.lit("French")), "title": F.lit("Senior Engineer"), "company": F.lit("ING Bank N.V.")}
    wish = {"contract_types": F.array(F.lit("permanent")), "work_modes": empty, "hours_min": F.lit(36), "hours_max": none("int"), "salary_min": F.lit(4000), "max_km": F.lit(40), "languages": F.array(F.lit("dutch")), "seniority": F.array(F.lit("junior")), "avoid": F.array(F.lit("ing"))}
    got = spark.range(1).select(preferences.conflicts(advert, wish).alias("c")).first().c
    assert [c.field for c in got] == ["contract", "hours", "salary", "language", "seniority", "employer"]


def test_gaps(spark):
    vocab = gaps.vocabulary(spark.createDataFrame([(0, "Azure"), (1, "Microsoft Azure"), (2, "SQL"), (3, "C#"), (4, "R"), (5, "azure")], "position int, skill string"))
    rows = [(1, "needs Microsoft Azure", ""), (2, "Azure skills", ""), (3, "mysql", "we use SQL daily"), (4, "C# or SQL", ""), (5, "nothing", "at all")]
    named = {r.gap_id: r.term for r in gaps.term_for(spark.createDataFrame(rows, "gap_id int, requirement string, quote string"), vocab).collect()}
    assert named == {1: "microsoft azure", 2: "azure", 3: "sql", 4: None, 5: None}
    hosts = {r.term: r.host for r in gaps.merged_terms(spark.createDataFrame([("azure",), ("microsoft azure",), ("microsoft azure devops",)], "term string")).collect()}
    assert hosts == {"azure": "azure", "microsoft azure": "azure", "microsoft azure devops": "azure"}
    found = [("azure", "Azure", "v1", False, 80, 0), ("azure", "azure", "v1", True, 60, 1), ("azure", "azure", "v2", False, 50, 2)]
    got = gaps.gap_groups(spark.createDataFrame(found, "term string, spelling string, key string, required boolean, fit int, position int")).first()
    assert (got["count"], got.required_count, got.weight, got.display) == (2, 1, 1.1, "azure")


def test_staged_counts(spark):
    frame = spark.createDataFrame([(1, True, True), (2, False, True), (3, False, None)], "id int, a boolean, b boolean")
    assert reports.staged_counts(frame, [("a", F.col("a")), ("b", F.col("b"))]).first().asDict() == {"loaded": 3, "a": 1, "b": 1, "left": 1}


def test_structured(spark):
    d = F.from_json(F.lit('{"title":"Dev","company":"X","hours_min":32,"hours_max":40,"experience_years_min":0,"skills":["a","b"],"salary_min":3000,"salary_period":"month"}'), "title string, company string, city string, work_mode string, hours_min int, hours_max int, salary_min double, salary_max double, salary_period string, salary_note string, education_level string, experience_years_min int, skills array<string>, languages_required array<string>, contract_type string")
    assert spark.range(1).select(documents.structured(d).alias("x")).first().x == "Dev\nBedrijf: X\nUren per week: 32-40\nSalaris: 3000 per month\nVaardigheden: a, b"


def test_json_ld(spark):
    text = "word " * 60
    posting = '{"@context":"x","@graph":[{"@type":["JobPosting"],"title":" Dev ","description":"<p>%s</p>","datePosted":"2026-01-02","identifier":{"value":"7"},"hiringOrganization":{"name":"Acme"},"jobLocation":[{"address":{"addressLocality":"Utrecht","addressCountry":"nl"}}]}]}' % text
    page = f'<script type="application/ld+json">{{bad</script><script type="application/ld+json">{posting}</script>'
    rows = postings.json_ld(spark.createDataFrame([("https://a.nl/x", page)], "url string, html string"))
    got = postings.posting_adverts(rows, "site", F.lit("2026-02-01").cast("timestamp")).first()
    assert (got.source_id, got.title, got.company, got.city, got.country, str(got.posted_at)) == ("7", "Dev", "Acme", "Utrecht", "NL", "2026-01-02 00:00:00")


def test_elements(spark):
    page = '<div class="a job">x<br>y<div>z</div></div><p class="job">q</p>'
    assert spark.range(1).select(postings.elements(F.lit(page), "class", "job").alias("x")).first().x == ["xyz", "q"]


def test_publish(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    details = spark.createDataFrame([("a", "d")], "key string, d string")
    path = str(tmp_path / "published")
    try:
        sinks.publish(rows, details, path, "m1")
        raise AssertionError("a row without details has to stop it")
    except ValueError as e:
        assert "b" in str(e)
    for model in ("m1", "m2", "m1"):
        sinks.publish(rows.filter("key = 'a'"), details, path, model)
    assert {(r.model, r.key) for r in spark.read.parquet(path).collect()} == {("m1", "a"), ("m2", "a")}


def test_patch_and_suffix(spark):
    stored = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    patch = spark.createDataFrame([(1, None, "z")], "id int, x string, y string")
    assert {tuple(r) for r in sinks.patched(stored, patch, "id").collect()} == {(1, "a", "z"), (2, "c", "d")}
    names = sinks.suffixed(spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "n int, stem string"), "stem", "n", spark.createDataFrame([("s",), ("s-2",)], "name string"))
    assert {r.n: r.name for r in names.collect()} == {1: "s-3", 2: "s-4", 3: "t"}


def test_alternatives(spark):
    x = lambda h: spark.range(1).select(t.names_alternatives(F.lit(h), F.array(F.lit("sql"), F.lit("ci/cd"))).alias("x")).first().x
    assert x("sql or ci/cd") is True and x("sql and ci/cd") is False and x("sql, ci/cd") is False


def test_cv_rows_meet_without_joins(spark):
    """Like the metrics one by one: a variant without a CV, marks given twice, graded documents that no ranking has, a CV without a grade."""
    rng = random.Random(3)
    rank = [(v, q, d, at + 1) for v in "ab" for q in range(12) if (v, q) != ("b", 4) for at, d in enumerate(rng.sample(range(15), 8))]
    graded = [(q, d, rng.choice([1, 2])) for q in range(11) for d in rng.sample(range(15), 1 + q)]
    marks = [(q, d) for q in range(12) for d in rng.choices(range(15), k=12)]
    ranking, grades, judged = (spark.createDataFrame(r, s) for r, s in ((rank, "variant string, query_id bigint, doc_id bigint, rank int"), (graded, "query_id bigint, doc_id bigint, grade int"), (marks, "query_id bigint, doc_id bigint")))
    want = {}
    for v in "ab":
        mine = ranking.filter(F.col("variant") == v).drop("variant")
        found = {r.query_id: r for r in metrics.retrieval(mine, grades.filter("grade = 2").drop("grade"), 3).collect()}
        share = {r.query_id: r.labelled_share for r in metrics.labelled_share(mine, judged, 3).collect()}
        for r in metrics.ndcg(mine, grades, 3).collect():
            f = found.get(r.query_id)
            want[v, r.query_id] = [*((f.hit_at_1, f.recall, f.reciprocal_rank) if f else (0.0, 0.0, 0.0)), r.ndcg, share.get(r.query_id)]
    assert len(want) == 22 and want["b", 4][-1] is None
    for (v, q), x in want.items():
        x.append(min(y[4] for (_, other), y in want.items() if other == q and len(y) > 4 and y[4] is not None))
    for names in (None, ["a", "b"]):
        out = metrics.per_cv_rows(ranking, grades, judged, 3, names) if names else metrics.per_cv_rows(ranking, grades, judged, 3)
        got = {(r.variant, r.query_id): list(r)[2:] for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(x == y or abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))
        assert names or "query_id" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
