"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
contain. One pass over the texts writes postings ``(gram, row_key)`` for the grams that any rule
asks for; the postings of a row are intersected by the rules' queries, and only rules whose query
holds are run on a text. Of the texts only those that hold the rarest gram of some alternative (``lead_grams``)
travel to meet the candidates; the others cannot be any. A rule without a mandatory trigram is run on every text.

Defined cases: a null text counts as empty and has no spans; equal rows are each returned; a null
``doc_id`` is kept; other columns of the input are ignored; an empty table gives an empty result.
The row key is a 64-bit hash: two rows that share it get the union of their candidates, which costs a
needless check and never loses a span.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, running, spans_of

_parser = re._parser  # the standard library's own regex syntax tree


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read alike by Java and by the tree; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def any_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in text)


ASSIGN = (
    "(" + "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: The three base kinds first, then what the index adds.
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", "-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{5,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES

# ---------------------------------------------------------------- trigram queries
# A query is True (nothing is mandatory), a gram, ("and", parts) or ("or", parts).
_MOST_STRINGS = 64
#: Of a long literal, so many trigrams are asked for: fewer postings, and still a condition of every match.
_MOST_GRAMS = 4


def _join(kind: str, parts: list) -> object:
    if kind == "or" and any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    if kind == "or":  # A or (A and B) is A
        parts = [p for p in parts if not any(grams_in(o) < grams_in(p) for o in parts if isinstance(o, str) or o[0] == "and")]
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _grams(strings: frozenset[str]) -> object:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)][:_MOST_GRAMS]) if len(s) > 2 else True for s in sorted(strings)])


def _exact(node) -> frozenset[str] | None:
    """All the strings that a node matches, in lower case, if they are few."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return frozenset([chr(value).lower()])
    if op == "IN" and all(str(k) == "LITERAL" for k, _ in value):
        return frozenset(chr(c).lower() for _, c in value)
    if op == "SUBPATTERN":
        return _exact_run(value[-1])
    if op == "BRANCH":
        each = [_exact_run(b) for b in value[1]]
        return None if None in each else frozenset().union(*each)
    if op in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1:
        inner = _exact_run(value[2])
        return None if inner is None else inner | {""} if value[0] == 0 else inner
    return None


def _exact_run(nodes) -> frozenset[str] | None:
    out = frozenset([""])
    for node in nodes:
        e = _exact(node)
        if e is None or len(out) * len(e) > _MOST_STRINGS:
            return None
        out = frozenset(a + b for a in out for b in e)
    return out


def _inside(node) -> object:
    op, value = str(node[0]), node[1]
    if op == "SUBPATTERN":
        return _query(value[-1])
    if op == "BRANCH":
        return _join("or", [_query(b) for b in value[1]])
    if op in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
        return _query(value[2])
    return True


def _query(nodes) -> object:
    parts, run = [], frozenset([""])
    for node in nodes:
        e = _exact(node)
        if e is not None and len(run) * len(e) <= _MOST_STRINGS:
            run = frozenset(a + b for a in run for b in e)
            continue
        parts.append(_grams(run))
        run = e if e is not None else frozenset([""])
        if e is None:
            parts.append(_inside(node))
    return _join("and", [*parts, _grams(run)])


def trigram_query(pattern: str) -> object:
    """The Boolean query over lower-case trigrams that any match of the pattern must satisfy."""
    return _query(_parser.parse(pattern))


def grams_in(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(grams_in, query[1]))


#: Letters from common to rare, as in English and its neighbours; anything else is rarer.
_COMMON = "etaoinshrdlcumwfgypbvkjxqz"


def lead_grams(query: object) -> set[str]:
    """Grams of which every match holds at least one: of each alternative the gram with the rarest letters."""
    if query is True or isinstance(query, str):
        return grams_in(query)
    each = [lead_grams(part) for part in query[1]]
    if query[0] == "or":
        return set().union(*each)
    rarity = lambda grams: min(sum(_COMMON.find(c) if c in _COMMON else len(_COMMON) for c in g) for g in grams)
    return max(each, key=lambda grams: (rarity(grams), -len(grams)))


# ---------------------------------------------------------------- index and candidates
def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def gram_pattern(grams: list[str]) -> str:
    """A regular expression for any of the grams in either case, dealt by first letter so that a place fails soon."""
    either = lambda x: "".join(any_case(c) if c.isalpha() else re.escape(c) for c in x)
    tails: dict[str, list[str]] = {}
    for g in grams:
        tails.setdefault(g[0], []).append(either(g[1:]))
    return "|".join(f"{either(first)}(?:{'|'.join(rest)})" for first, rest in tails.items())


def postings(docs: DataFrame, grams: list[str], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index ``(gram_no, row_key)`` for the given lower-case trigrams, by one pass over each text."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?=({gram_pattern(grams)}))"), F.lit(1))
    numbers = F.array_distinct(F.transform(found, lambda g: F.array_position(F.array(*map(F.lit, grams)), F.lower(g)) - 1))
    return docs.select(row_key(doc_id, text).alias("row_key"), F.explode(numbers).alias("gram_no"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """Intersects postings: ``row_key`` with one flag ``may_<kind>`` for each rule that has a query."""
    at = {g: n for n, g in enumerate(grams)}
    bits = index.groupBy("row_key").agg(
        *[
            F.bit_or(F.when(F.floor(F.col("gram_no") / 60) == w, F.expr(f"shiftleft(1L, int(gram_no - {60 * w}))")).otherwise(F.lit(0))).alias(f"w{w}")
            for w in range((len(grams) + 59) // 60)
        ]
    )

    def holds(q) -> Column:
        if isinstance(q, str):
            return F.col(f"w{at[q] // 60}").bitwiseAND(F.lit(1 << (at[q] % 60))) != 0
        return reduce(lambda a, b: a & b if q[0] == "and" else a | b, map(holds, q[1]))

    asked = [(r, q) for r in rules if (q := trigram_query(r.pattern)) is not True]
    flagged = bits.select("row_key", *[holds(q).alias(f"may_{r.kind}") for r, q in asked])
    return flagged.filter(reduce(lambda a, b: a | b, [F.col(f"may_{r.kind}") for r, _ in asked]))


_SPAN = "array<struct<start:bigint,ord:int,stop:bigint,kind:string>>"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches that pass, as code-point spans; gaps and matches add up to positions."""
    good = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m) >= rule.least
    parts = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        lambda gap, m: F.struct(F.length(gap).cast("bigint").alias("gap"), F.coalesce(F.length(m), F.lit(0)).cast("bigint").alias("size"), F.coalesce(good(m), F.lit(False)).alias("good")),
    )

    def spans(parts: Column) -> Column:
        before = running(F.transform(parts, lambda p: p["gap"] + p["size"]), lambda a, b: a + b, F.lit(0).cast("bigint"))

        def span(p, at):
            begin = at + p["gap"]
            return F.when(p["good"], F.struct(begin.alias("start"), F.lit(order).alias("ord"), (begin + p["size"]).alias("stop"), F.lit(rule.kind).alias("kind")))

        return F.filter(F.zip_with(parts, before, span), lambda s: s.isNotNull()).cast(_SPAN)

    return F.when(text.rlike(rule.pattern), let(parts, spans)).otherwise(F.array().cast(_SPAN))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns in ``keep`` and ``secrets``: spans ``(start, ord, stop, kind)`` by start, then rule order."""
    queries = {r: trigram_query(r.pattern) for r in rules}
    grams = sorted(set().union(*map(grams_in, queries.values())))
    leads = sorted(set().union(*map(lead_grams, queries.values())))
    rows = docs.select(doc_id, text, *[c for c in keep if c not in (doc_id, text)])
    body, none = F.coalesce(F.col(text), F.lit("")), F.array().cast(_SPAN)

    def scanned(rows: DataFrame, spans) -> DataFrame:
        """``spans(order, rule)`` of all rules together."""
        every = F.array_sort(F.concat(*[spans(n, r) for n, r in enumerate(rules)]))
        return rows.select(doc_id, *[c for c in keep if c != doc_id], every.alias("secrets"))

    if not grams:
        return scanned(rows, lambda n, r: _spans(body, r, n))
    found = candidates(postings(docs, grams, doc_id=doc_id, text=text), rules, grams)
    found = found.toDF(*[f"__{n}" for n in found.columns])
    holds = body.rlike(gram_pattern(leads))
    met = rows.filter(holds).withColumn("__key", row_key(doc_id, text)).join(found, F.col("__key") == F.col("__row_key"), "left")
    may = lambda n, r: F.when(F.coalesce(F.col(f"__may_{r.kind}"), F.lit(False)), _spans(body, r, n)).otherwise(none)
    some = scanned(met, lambda n, r: _spans(body, r, n) if queries[r] is True else may(n, r))
    others = scanned(rows.filter(~holds), lambda n, r: _spans(body, r, n) if queries[r] is True else none)
    return some.unionByName(others)


def redact(text: Column, secrets: Column, mask: str = "[secret]") -> Column:
    """The text with every span replaced; spans that overlap are replaced as one. Time is linear in text and spans.

    What stays is the gap before each span that begins after all before it have ended, and the rest; masks stand between these.
    """

    def gaps(ends: Column) -> Column:
        each = F.transform(secrets, lambda s, i: F.struct(F.get(ends, i).alias("start"), s["start"].cast("bigint").alias("stop")))
        fresh = F.filter(each, lambda g: g["stop"] >= g["start"])
        last = F.greatest(F.array_max(ends), F.element_at(secrets, -1)["stop"].cast("bigint"))
        return F.concat(fresh, F.array(F.struct(last.alias("start"), F.greatest(last, F.length(text).cast("bigint")).alias("stop"))))

    ends = running(F.transform(secrets, lambda s: s["stop"].cast("bigint")), lambda at, stop: F.greatest(at, stop), F.lit(0).cast("bigint"))
    return F.when(F.size(secrets) == 0, text).otherwise(F.array_join(spans_of(text, let(ends, gaps)), mask))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


# ---------------------------------------------------------------- the registered query
def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = len(BASE_RULES)
    count = lambda n: F.size(F.filter("secrets", lambda s: s["ord"] == n)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)],
        F.sha2(span_text(F.filter("secrets", lambda s: s["ord"] < base)), 256).alias("base_sha256"),
        span_text(F.col("secrets")).alias("spans"),
    )


def _sql_spans(rule: Rule, order: int) -> str:
    p = rule.pattern.replace("\\x20", " ").replace("'", "''")
    good = f"length(regexp_extract(m, '{p}', {rule.group})) >= {rule.least}"
    return f"""select doc_id, '{rule.kind}' as kind, {order} as ord,
        list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) as s, length(m) as n
      from (select doc_id, ms, gs, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m
            from (select doc_id, regexp_extract_all(coalesce(text, ''), '{p}') as ms, string_split_regex(coalesce(text, ''), '{p}') as gs from documents))
      where {good}"""


OP1_SQL = f"""
with hits as ({' union all '.join(_sql_spans(r, n) for n, r in enumerate(RULES))}),
joined as (
  select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
    count(*) filter (where kind = 'hex') as n_hex,
    string_agg(kind || ':' || s::bigint || ':' || (s + n)::bigint, ',' order by s, ord) filter (where ord < 3) as base,
    string_agg(kind || ':' || s::bigint || ':' || (s + n)::bigint, ',' order by s, ord) as spans
  from hits group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join joined j on d.doc_id = j.doc_id
"""
