import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import secret_scan as s


def plain(text):
    """All spans by Python's engine, rule by rule."""
    out = []
    for n, rule in enumerate(s.RULES):
        for m in re.finditer(rule.pattern, text or "", re.A):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), n, m.end(), rule.kind))
    return sorted(out)


def spans(frame):
    return [(r.doc_id, [tuple(x) for x in r.secrets]) for r in frame.collect()]


def test_awkward(spark, awkward):
    got = sorted(spans(s.scan_secrets(awkward)), key=str)
    want = sorted(((r.doc_id, plain(r.text)) for r in awkward.collect()), key=str)
    assert got == want


def test_texts(spark):
    parts = ["token=", "secret=", "passwd: ", "api_key:'", "abc", "abcdef12", "AKIA", "A" * 16, "0123456789abcdef" * 2, " ", "ghp_" + "a" * 40, "é", "-----BEGIN RSA PRIVATE KEY-----", "TOKEN='", "eyJ" + "a" * 12 + "." + "b" * 12 + ".ccccc"]
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert dict(spans(s.scan_secrets(frame))) == {i: plain(t) for i, t in enumerate(texts)}


def holds(query, text):
    if query is True:
        return True
    if isinstance(query, str):
        return query in text.lower()
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


@pytest.mark.parametrize("rule", s.RULES, ids=lambda r: r.kind)
@settings(max_examples=60, deadline=None)
@given(st.data())
def test_query_is_mandatory(rule, data):
    text = data.draw(st.from_regex(re.compile(rule.pattern, re.A)))
    assert holds(s.trigram_query(rule.pattern), text)


@pytest.mark.parametrize("rule", s.RULES, ids=lambda r: r.kind)
@settings(max_examples=60, deadline=None)
@given(st.data())
def test_a_lead_gram_is_in_every_match(rule, data):
    leads = s.lead_grams(s.trigram_query(rule.pattern))
    text = data.draw(st.from_regex(re.compile(rule.pattern, re.A))).lower()
    assert not leads or any(g in text for g in leads)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token=abcdef{n} ü " + "0123456789abcdef" * 2 for n in range(20_000))
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert spans(s.scan_secrets(frame)) == [(1, plain(text))]


def test_failing_match_still_consumes(spark):
    frame = spark.createDataFrame([(1, "token:token:abcdefgh")], "doc_id bigint, text string")
    assert spans(s.scan_secrets(frame)) == [(1, [])]


def test_redaction(spark, awkward):
    out = s.scan_secrets(awkward, keep=("text",)).select("doc_id", s.redact(F.col("text"), F.col("secrets")).alias("x")).collect()
    got = {r.doc_id: r.x for r in out}
    assert got[1] == "[secret] and token:abc plus [secret]" and got[2] is None and got[3] == "" and got[5].endswith("ünï [secret]")


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "AKIA" + "B" * 16)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = s.op1_secret_scan(spark, str(tmp_path)).first()
    assert (row.n_access, row.base_sha256) == (1, hashlib.sha256(b"access:0:20").hexdigest())


def test_empty(spark, awkward):
    assert s.scan_secrets(awkward.limit(0)).count() == 0


def test_redaction_of_many_spans_is_linear(spark):
    """A hundred thousand secrets in a row of text, equal to a plain loop; overlaps and neighbours, spans at both ends, characters beyond the plane."""
    import time

    def plain(text, spans):
        at, out = 0, ""
        for start, stop in spans:
            if start >= at:
                out += text[at:start] + "[secret]"
            at = max(at, stop)
        return out + text[at:]

    many = "\U0001f389 a=1 secretx " * 100_000
    rows = [
        (1, many, [(i * 15 + 6, i * 15 + 12) for i in range(100_000)]), (2, "\U0001f389bcdef", [(0, 2), (1, 3), (3, 4), (6, 6)]), (3, "abc", [(0, 3)]), (4, "abc", []), (5, None, []), (6, "abcdefgh", [(0, 8), (2, 3), (4, 6)]), (7, "x" * 3000, [(1000, 1030), (1024, 2048), (2048, 2049)]),
    ]
    frame = spark.createDataFrame(rows, "i int, text string, secrets array<struct<start:int,stop:int>>")
    began = time.perf_counter()
    got = {r.i: r.x for r in frame.select("i", s.redact(F.col("text"), F.col("secrets")).alias("x")).collect()}
    assert time.perf_counter() - began < 20
    assert got == {i: None if text is None else plain(text, spans) for i, text, spans in rows}
