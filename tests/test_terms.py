"""Automata of terms and names against the joins that take over beyond their size."""

import random

from pyspark.sql import functions as F

from tessera.operators import gaps, terms, windows


def test_terms_by_automaton_and_by_join(spark, monkeypatch):
    rng = random.Random(5)
    letters = ["java", "c#", "c++", "sql", "net", ".net", "node.js", "azure", "devops", "é", "ok", "ß", "名"]
    made = lambda n: " ".join(rng.choice(letters) + rng.choice(["", "", ",", "/", "-", "+", "#", "_x", " or"]) for _ in range(n))
    skills = [(n, x) for n, x in enumerate(["java", "C#", "c++", "sql", ".net", "node.js", "microsoft azure", "azure devops", "azure", "devops sql", "名 ok", "---", "java sql azure", "SQL"])]
    vocab = gaps.vocabulary(spark.createDataFrame(skills, "position int, skill string"))
    rows = [(i, rng.choice([None, "", made(rng.randrange(6))]), rng.choice([None, made(rng.randrange(8))])) for i in range(400)]
    asked = spark.createDataFrame([*rows, (400, "java " * 50_000, None), (401, "x" * 200_000, "java")], "gap_id int, requirement string, quote string")

    def named():
        return {r.gap_id: (r.hay, r.term, sorted(r["all"])) for r in gaps.named_terms(asked, vocab).collect()}

    def told():
        return {r.gap_id: r.term for r in gaps.term_for(asked, vocab).collect()}

    by_automaton, chosen = named(), told()
    assert len(by_automaton) > 150 and by_automaton[400][1] == "java" and by_automaton[401][1] == "java"
    assert {len(a) for _, _, a in by_automaton.values()} > {1, 2, 3}
    monkeypatch.setattr(terms, "MOST_TERMS", 3)
    assert named() == by_automaton and told() == chosen
    monkeypatch.undo()
    nothing = vocab.filter("term = 'nothing'")
    assert gaps.named_terms(asked, nothing).isEmpty() and gaps.named_terms(asked.limit(0), vocab).isEmpty()


def test_names_by_automaton_and_by_join(spark, monkeypatch):
    rng = random.Random(6)
    words = ["den", "haag", "aan", "rijn", "alphen", "bosch", "a"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) for _ in range(60)} | {"", "den  haag"}
    gazetteer = spark.createDataFrame([(n, [n[:3], str(i)]) for i, n in enumerate(sorted(names))], "name string, provinces array<string>")
    part = lambda: rng.choice([None, "", " ", " ".join(rng.choice([*words, "x", ""]) for _ in range(rng.randrange(9)))])
    rows = [(i % 290, None if i % 50 == 0 else [part() for _ in range(rng.randrange(4))]) for i in range(300)]  # ten keys twice
    asked = spark.createDataFrame(rows, "id int, location array<string>")

    def found():
        return sorted((r.id, str(r.location), [(p.name, p.provinces) for p in r.places]) for r in windows.places_in(asked, "id", "location", gazetteer).collect())

    def plain(location):
        """From the left, the longest, none overlapping, in words."""
        out = []
        for p in location or []:
            w, at = [x for x in (p or "").split(" ") if x], 0
            while at < len(w):
                n = next((n for n in range(5, 0, -1) if at + n <= len(w) and " ".join(w[at : at + n]) in names), 0)
                if n:
                    out.append(" ".join(w[at : at + n]))
                at += n or 1
        return out

    by_automaton = found()
    assert sorted((i, str(x), plain(x)) for i, x in rows) == [(i, x, [n for n, _ in p]) for i, x, p in by_automaton]
    assert sum(len(p) for *_, p in by_automaton) > 60
    monkeypatch.setattr(terms, "MOST_CHARACTERS", 10)
    assert found() == by_automaton


def test_a_location_of_many_names_takes_one_pass(spark):
    """100,000 words and 20,000 names in one row."""
    gazetteer = spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("name"), F.array(F.lit("p")).alias("provinces"))
    text = " ".join(f"n{n % 25_000}" for n in range(100_000))
    rows = spark.createDataFrame([(1, [text])], "id int, location array<string>")
    places = windows.places_in(rows, "id", "location", gazetteer)
    assert places.select(F.size("places")).first()[0] == 80_000
    assert not any("Join" in line for line in places._jdf.queryExecution().executedPlan().toString().splitlines())
