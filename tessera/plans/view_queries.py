"""Queries of views, decisions, answers, access and evaluation rows over the order tables, events and documents.

Customers stand for CVs, orders for runs, line items for adverts that a run judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.arith import SAME_PLACE_KM
from tessera.operators import access, dedupe, documents, gaps, metrics, preferences, ranking, reports, views, windows
from tessera.plans.registry import query
from tessera.plans.text_queries import CHUNKS
from tessera.session import table
from tessera.sources import postings, sinks
from tessera.streaming import sightings

#: Line items with one row for each order and line number.
_LINES = "lines as (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, max(l_partkey) as l_partkey, max(l_discount) as l_discount, max(l_extendedprice) as l_extendedprice from lineitem group by 1, 2)"


def _lines(spark, folder, by_order: bool = False) -> DataFrame:
    """Each line number of an order once; ``by_order`` deals the orders first, so that what is asked of an order later needs no further shuffle."""
    rows = table(spark, folder, "lineitem")
    return (rows.repartition("l_orderkey") if by_order else rows).groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_quantity", "l_partkey", "l_discount", "l_extendedprice")])


_RUN = f"""{_LINES}, run as (select l_orderkey || '-' || l_linenumber as key, l_quantity::int as fit, l_linenumber as rank, l_orderkey, l_extendedprice as score,
  case when l_quantity >= 45 then 'strong' when l_quantity >= 20 then 'possible' else 'weak' end as verdict from lines),
marks as (select key, case when fit % 3 = 0 then 'yes' else 'no' end as call, case when fit % 4 = 0 then ' ' else 'r' || fit end as reason from run where fit % 5 = 0)"""


def _run(spark, folder) -> DataFrame:
    q = F.col("l_quantity")
    verdict = F.when(q >= 45, "strong").when(q >= 20, "possible").otherwise("weak")
    return _lines(spark, folder).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), q.cast("int").alias("fit"), F.col("l_linenumber").alias("rank"), "l_orderkey", F.col("l_extendedprice").alias("score"), verdict.alias("verdict"))


def _marks(run: DataFrame) -> DataFrame:
    return run.filter("fit % 5 = 0").select("key", F.when(F.col("fit") % 3 == 0, "yes").otherwise("no").alias("call"), F.when(F.col("fit") % 4 == 0, " ").otherwise(F.concat(F.lit("r"), "fit")).alias("reason"))


@query(f"with {_RUN} select m.key, call, verdict, fit, case when rank <= 4 then rank end::double as rank from marks m join run using (key) where trim(reason) <> ''")
def recorded_decisions(spark, folder):
    """ST14: decisions with a reason, with verdict, fit and rank of the run."""
    run = _run(spark, folder)
    return views.decision(run, run.filter("rank <= 4"), _marks(run)).select("key", "call", "verdict", "fit", F.col("rank").cast("double").alias("rank"))


@query(f"with {_RUN} select count(*) filter (where verdict = 'strong') as strong, count(*) filter (where verdict = 'possible') as possible, count(*) filter (where verdict = 'weak') as weak, count(*) filter (where key not in (select key from marks)) as unmarked from run")
def verdict_filters(spark, folder):
    """JS2: what each filter of a results page would show."""
    run = _run(spark, folder)
    return views.verdict_filters(run, _marks(run))


@query(f"with {_RUN} select key, fit, rank as before from run where fit % 2 = 0 and rank <= 3 and fit % 5 > 0 and verdict <> 'weak'")
def pushed_out(spark, folder):
    """adverts that wishes pushed out of the top."""
    rows = _run(spark, folder).select("key", "fit", F.col("rank").alias("before"), F.when(F.col("fit") % 2 == 0, F.array(F.lit("hours"))).otherwise(F.array().cast("array<string>")).alias("conflicts"), (F.col("fit") % 5 == 0).alias("judged"), (F.col("verdict") == "weak").alias("capped"))
    return ranking.pushed_out(rows, "conflicts", 3).select("key", "fit", "before")


@query(f"""with {_RUN}, o as (select *, row_number() over (order by score desc, key) as r, fit % 5 = 0 as judged, verdict = 'weak' as capped from run)
select (select key from o where judged order by r desc limit 1) as last_key, (select key from o where not judged and not capped order by r limit 1) as first_key,
  round((select score from o where judged order by r desc limit 1) - (select score from o where not judged and not capped order by r limit 1), 6) as gap""")
def judging_boundary(spark, folder):
    """The last judged advert and the first that was neither judged nor capped."""
    from tessera.session import ranked

    rows = ranked(_run(spark, folder).drop("rank"), [], [F.desc("score"), F.col("key")])
    flagged = rows.withColumns({"judged": F.col("fit") % 5 == 0, "capped": F.col("verdict") == "weak"})
    return ranking.boundary(flagged).select("last_key", "first_key", F.round("gap", 6).alias("gap"))


@query(f"with {_RUN} select key, verdict from run where key not in (select key from marks) and verdict = 'strong'")
def never_marked(spark, folder):
    """Strong adverts still to do, those with a stored mark left out."""
    run = _run(spark, folder)
    _, todo = preferences.cached_or_new(run.filter("verdict = 'strong'").select("key", "verdict"), _marks(run), "key")
    return todo


@query("select p_type as term, count(*) as n, round(sum(p_size / 100), 6) as weight from part group by 1 order by weight desc, term limit 8")
def heaviest_gaps(spark, folder):
    """JS7: the first eight groups by weight."""
    groups = table(spark, folder, "part").groupBy(F.col("p_type").alias("term")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("p_size") / 100), 6).alias("weight"))
    return views.heaviest_gaps(groups)


@query("""with c as (select source, min(doc_id) as position from documents where doc_id % 3 = 0 group by 1), p as (select source, min(doc_id) as position, count(*) > 10 as enabled from documents where source <> 'src1' group by 1)
select p.source, enabled, case when c.source is null then 1 else 0 end as part, coalesce(c.position, p.position) as position from p left join c on p.source = c.source""")
def source_choices(spark, folder):
    """JS4: sources to choose from: those with rows first, then the others that may be picked."""
    d = table(spark, folder, "documents")
    counted = d.filter("doc_id % 3 = 0").groupBy("source").agg(F.min("doc_id").alias("position"))
    pickable = d.filter("source <> 'src1'").groupBy("source").agg(F.min("doc_id").alias("position"), (F.count("*") > 10).alias("enabled"))
    return views.source_choices(counted, pickable).select("source", "enabled", "place.part", "place.position")


@query("select count(*) filter (where user_id % 4 > 0) as answered, count(*) filter (where user_id % 4 = 0) as open from events")
def answered_questions(spark, folder):
    """JS9: answered and open questions."""
    return views.answered(table(spark, folder, "events").select(F.when(F.col("user_id") % 4 > 0, F.col("event_type")).alias("answer")))


@query("select coalesce(max(json_extract_string(props, '$.k')), 'none') as value from events where event_type = 'purchase'")
def json_setting(spark, folder):
    """Q7: a field of JSON settings, or the default."""
    rows = table(spark, folder, "events").select(F.col("event_type").alias("name"), F.col("props").alias("value"))
    return views.setting(rows, "purchase", "$.k", F.lit("none"))


@query("select o_orderkey, case when count(l_orderkey) > 0 then sum(coalesce(case when l_linenumber % 2 = 0 then l_linenumber end, 0))::double end as published from orders left join lineitem on o_orderkey = l_orderkey group by 1")
def run_totals(spark, folder):
    """Q8: what a run's sources published together; null for a run without an overview."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("published"))).alias("sources"))
    o = table(spark, folder, "orders").select("o_orderkey")
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", views.run_finish(F.col("sources")).cast("double").alias("published"))


@query("select event_id, ts from events where event_type = 'purchase' order by ts desc, event_id desc limit 1")
def newest_overview(spark, folder):
    """Q9: the newest run that has an overview."""
    e = table(spark, folder, "events")
    runs = e.select("event_id", "ts", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "purchase", F.col("props")).alias("overview"))
    return views.newest_overview(runs).select("event_id", "ts")


@query("select c_custkey, 'c_name' as field, c_name as value from customer union all select c_custkey, 'c_mktsegment', c_mktsegment from customer union all select c_custkey, 'c_acctbal', 'yes' from customer where c_acctbal > 0")
def record_fields(spark, folder):
    """JS8: the stated fields of each record as rows."""
    c = table(spark, folder, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") > 0, "yes"))
    return reports.unpivoted(c, "c_custkey", ["c_name", "c_mktsegment", "c_acctbal"])


# ---- answers, parts, texts --------------------------------------------------
@query("""select p_partkey, p_name || case when p_size > 25 then ' (' || p_brand || ' · ' || p_type || ')' when p_size > 10 then ' (' || p_brand || ')' else '' end || chr(10) || chr(10) || p_type as shown, '1. ' || p_brand || chr(10) || '2. ' || p_type as numbered from part""")
def shown_adverts(spark, folder):
    """The text that a judge sees, and a numbered list."""
    c = F.col
    shown = preferences.shown(c("p_name"), F.when(c("p_size") > 10, c("p_brand")), F.when(c("p_size") > 25, c("p_type")), c("p_type"))
    return table(spark, folder, "part").select("p_partkey", shown.alias("shown"), preferences.numbered(F.array("p_brand", "p_type")).alias("numbered"))


@query(f"""with {_LINES} select l_orderkey as key, l_linenumber as number, case when l_quantity < 10 then 'missing' when l_quantity < 20 then case when l_linenumber % 2 = 0 then 'unknown' else 'missing' end
  when l_partkey % 3 = 0 then 'missing' when l_quantity < 35 then 'partly' else 'met' end as status from lines""")
def combined_answers(spark, folder):
    """Requirements with their answers; a quote that the CV does not hold does not count."""
    lines, q = _lines(spark, folder), F.col("l_quantity")
    requirements = lines.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("number"), (F.col("l_linenumber") % 2 == 0).alias("knockout"))
    status = F.when(q < 20, "unknown").when(q < 35, "partly").otherwise("met")
    answers = lines.filter(q >= 10).select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("number"), status.alias("status"), F.when(F.col("l_partkey") % 3 == 0, "eight years of Cobol").otherwise("Python").alias("cv_quote"))
    return preferences.combine(requirements, answers, F.lit("Five years of Python and SQL.")).select("key", "number", "status")


@query("""select c_custkey, nullif(concat_ws(chr(10), case when c_mktsegment <> 'BUILDING' then 'Sector: ' || substr(c_mktsegment, 1, 6) end, case when c_acctbal > 0 then 'Salary: ' || substr(c_acctbal::bigint::varchar, 1, 6) end), '') as wishes from customer""")
def wishes_shown(spark, folder):
    """Lines for the wishes that are stated; null for none."""
    parts = [("Sector", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))), ("Salary", F.when(F.col("c_acctbal") > 0, F.rint("c_acctbal").cast("bigint").cast("string")))]
    return table(spark, folder, "customer").select("c_custkey", preferences.wishes_text(parts, 6).alias("wishes"))


@query("""with o as (select o_custkey as cv, list({'label': o_orderpriority || ' · ' || o_orderstatus, 'text': o_orderpriority || chr(10) || o_orderstatus} order by o_orderkey) as roles from orders group by 1),
p as (select c_custkey as cv, list_concat(coalesce(roles, []), case when c_acctbal > 0 then [{'label': 'background', 'text': c_name}] else [] end) as parts from customer left join o on c_custkey = cv),
e as (select cv, parts, unnest(range(len(parts))) as part from p)
select cv, part, parts[part + 1].label as label, parts[part + 1].text as text from e""")
def query_parts(spark, folder):
    """Each job of a CV and its background as parts that ask by themselves."""
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("cv")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("company"), F.lit(None).cast("string").alias("summary")))).alias("experience"))
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("cv"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("background"), F.col("c_name").alias("text"))
    return documents.query_parts(c.join(o, "cv", "left"), "roles")


@query(f"select doc_id, 'part ' || (chunk + 1) as label, length(text) as n from ({CHUNKS})")
def chunk_query_parts(spark, folder):
    """Every text's chunks as parts that ask by themselves."""
    parts = documents.query_parts(table(spark, folder, "documents").select(F.col("doc_id").alias("cv"), "text"), "chunks")
    return parts.select(F.col("cv").alias("doc_id"), "label", F.length("text").cast("bigint").alias("n"))


@query(f"select doc_id, count(*) as parts, sum(length(text))::bigint as n, count(*) = 1 as short from ({CHUNKS}) group by doc_id")
def short_query_parts(spark, folder):
    """How many parts each text asks with, and which texts are short enough to ask as a whole."""
    parts = documents.query_parts(table(spark, folder, "documents").select(F.col("doc_id").alias("cv"), "text"), "chunks")
    return parts.groupBy(F.col("cv").alias("doc_id")).agg(F.count("*").alias("parts"), F.sum(F.length("text")).alias("n"), (F.count("*") == 1).alias("short"))


@query("""select doc_id, len(regexp_extract_all(x, '�')) as glyphs, least(len(regexp_extract_all(x, '�')), 1) as different, len(list_filter(string_split(x, chr(10)), lambda l: contains(l, '�'))) as lines,
  round(coalesce(len(regexp_extract_all(x, '�')) / nullif(length(x), 0), 0), 9) as share from (select doc_id, replace(text, 'q', '�') as x from documents)""")
def damaged_texts(spark, folder):
    """Unreadable glyphs of texts in which one letter is lost."""
    got = table(spark, folder, "documents").select("doc_id", t.damage(F.replace("text", F.lit("q"), F.lit("�"))).alias("d"))
    return got.select("doc_id", *[F.col(f"d.{c}").cast("bigint").alias(c) for c in ("glyphs", "different", "lines")], F.round("d.share", 9).alias("share"))


@query("""with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))) as l from documents)
select doc_id, trim(regexp_replace(array_to_string(l, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) as text from l""")
def tidy_texts(spark, folder):
    """Squeezed lines, at most one blank line."""
    return table(spark, folder, "documents").select("doc_id", t.tidy_text(F.col("text")).alias("text"))


@query("select lower(trim(p_type)) as folded, arg_min(p_type, p_partkey) as spelling, min(p_partkey) as position from (select p_partkey, case when p_partkey % 2 = 0 then upper(p_type) else ' ' || lower(p_type) end as raw, trim(raw) as p_type from part) group by 1")
def first_spellings(spark, folder):
    """Skills that differ in case once, as first spelled."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("position"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.concat(F.lit(" "), F.lower("p_type"))).alias("spelling"))
    return dedupe.first_spelling(p, "spelling", "position")


@query("select coalesce(count(*) filter (where quality = 1) / nullif(count(*), 0), 1) as grouped_share from labels")
def grouped_share(spark, folder):
    """The share of occurrences that have a term."""
    return gaps.grouped_share(table(spark, folder, "labels").select(F.when(F.col("quality") == 1, "t").alias("term")))


# ---- sources, state, access -------------------------------------------------
_REFUSED = "case when status = 429 then 'too many requests' when status = 403 then 'forbidden' when status between 300 and 399 and regexp_matches(html, '(?i)challenge|blocked') then 'refusal redirect' when regexp_matches(lower(html), 'captcha|access denied|are you a robot|unusual traffic') then 'refusal page' end"


@query(f"with p as (select page_id, html || case when page_id % 7 = 0 then ' Please solve the CAPTCHA' when page_id % 11 = 0 then ' Blocked ' else '' end as html, case page_id % 5 when 0 then 429 when 1 then 403 when 2 then 302 else 200 end as status from pages) select page_id, {_REFUSED} as refusal from p")
def refusals(spark, folder):
    """why responses count as refused."""
    n = F.col("page_id")
    html = F.concat("html", F.when(n % 7 == 0, " Please solve the CAPTCHA").when(n % 11 == 0, " Blocked ").otherwise(""))
    status = F.when(n % 5 == 0, 429).when(n % 5 == 1, 403).when(n % 5 == 2, 302).otherwise(200)
    return table(spark, folder, "pages").select("page_id", postings.refusal(status, html).alias("refusal"))


@query("select event_id, (user_id % 4 = 0 or user_id % 4 in (1, 2)) and ts >= timestamp '2024-02-05' - interval 14 day as fits from events")
def feed_filter(spark, folder):
    """adverts of a feed in a wanted language, or none stated, of the last two weeks."""
    u = F.col("user_id") % 4
    languages = F.when(u == 0, F.array().cast("array<string>")).when(u == 1, F.array(F.lit("nl"), F.lit("de"))).when(u == 2, F.array(F.lit("en"))).otherwise(F.array(F.lit("fr")))
    fits = postings.feed_filter(languages, F.col("ts").cast("timestamp"), F.lit("2024-02-05").cast("timestamp"), 14)
    return table(spark, folder, "events").select("event_id", fits.alias("fits"))


@query("select distinct user_id::varchar as key from events where event_type = 'view' or (event_type = 'click' and user_id % 2 = 0)")
def known_keys(spark, folder):
    """F20, ST5: keys that need no reading: stored, or passed over under this scope."""
    e = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("key"), F.lit("s").alias("source"), "event_type", "user_id")
    read = e.filter("event_type = 'click'")
    now = F.lit("2024-02-05").cast("timestamp")
    state = sightings.pass_over(sightings.empty(spark), read.filter("user_id % 2 = 0"), F.lit("scope-a"), now)
    state = sightings.pass_over(state, read.filter("user_id % 2 = 1"), F.lit("scope-b"), now)
    return sightings.known_keys(e.filter("event_type = 'view'"), state, "scope-a")


@query("select event_id, event_type <> 'error' and value > 20 and not (hour(ts) = 12) as start from events")
def run_gates(spark, folder):
    """ST12: switched on, due, and not started in this hour."""
    e = table(spark, folder, "events")
    at = F.col("ts").cast("timestamp")
    started = F.when(F.hour(at) == 12, at)
    return e.select("event_id", sightings.may_start(F.col("event_type") != "error", F.col("value") > 20, started, at).alias("start"))


@query("select max(ts) as published_at from events where event_type = 'purchase' having max(ts) > timestamp '2024-01-02'")
def set_to_load(spark, folder):
    """ST15: the newest published set, if newer than what is loaded."""
    sets = table(spark, folder, "events").filter("event_type = 'purchase'").select(F.col("ts").alias("published_at"), F.lit("m1").alias("model"))
    return sightings.to_reload(sets, F.lit("2024-01-02").cast("timestamp_ntz"), "m1").select("published_at")


@query("select event_id, ts from events where event_type <> 'purchase' and ts + interval 10 day > timestamp '2024-01-25'")
def redeemable_links(spark, folder):
    """links that were not used and have not expired."""
    at = F.col("ts").cast("timestamp")
    links = table(spark, folder, "events").select("event_id", "ts", F.when(F.col("event_type") == "purchase", at).alias("used_at"), (at + F.expr("interval 10 days")).alias("expires_at"))
    return access.redeemable(links, F.lit("2024-01-25").cast("timestamp")).select("event_id", "ts")


@query("""with u as (select lower(c_name) as email from customer where c_custkey % 2 = 0), a as (select lower(c_name) as email, 't' || c_custkey as token from customer where c_custkey % 3 = 0),
l as (select lower(c_name) as email, 'old' || c_custkey as token, c_custkey % 4 = 0 as used from customer where c_custkey % 2 = 0)
select token, used from l where used or email not in (select email from a) union all select token, false from a""")
def invitations(spark, folder):
    """Q4: links after inviting every third customer: an account found or made, its waiting links replaced."""
    c = table(spark, folder, "customer")
    even = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.upper("c_name").alias("email"), F.col("c_name").alias("name"))
    at = F.lit("2024-01-01").cast("timestamp")
    links = even.select("user_id", F.concat(F.lit("old"), "user_id").alias("token"), F.when(F.col("user_id") % 4 == 0, at).alias("used_at"), at.alias("expires_at"))
    asked = c.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("email"), F.col("c_name").alias("name"), F.concat(F.lit("t"), "c_custkey").alias("token"))
    _, after = access.invited(even, links, asked, at, at)
    return after.select("token", F.col("used_at").isNotNull().alias("used"))


@query("""with c as (select 'src' || s_suppkey % 15 as source, max(case when s_suppkey % 2 = 0 then s_suppkey end) as companies, bool_or(s_acctbal > 5000) as enabled, max(s_suppkey % 4 * 10) as own from supplier group by 1)
select source, least(50, nullif(own, 0)) as ceiling, (select count(*) from events where (c.source || case when event_type = 'error' then ' (' else ': ' end || 'x') is not null and ('src' || user_id % 12) = c.source) as problems
from c where (source in ('src1', 'src2') and coalesce(companies, 0) > 0) or (source not in ('src1', 'src2') and enabled)""")
def enabled_sources(spark, folder):
    """Sources that are asked, with their ceiling and the problem lines that belong to them."""
    s = table(spark, folder, "supplier").withColumn("source", F.concat(F.lit("src"), F.col("s_suppkey") % 15))
    config = s.groupBy("source").agg(F.max(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey"))).alias("companies"), F.bool_or(F.col("s_acctbal") > 5000).alias("enabled"), F.max(F.col("s_suppkey") % 4 * 10).alias("own"))
    name = F.concat(F.lit("src"), F.col("user_id") % 12)
    lines = table(spark, folder, "events").select(F.concat(name, F.when(F.col("event_type") == "error", " (").otherwise(": "), F.lit("x")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))
    asked = access.enabled_sources(config, ("src1", "src2")).join(config, "source")
    owned = asked.join(F.broadcast(lines), access.about(F.col("problem"), F.col("source")), "left")  # two kinds of line a source
    ceiling = access.ceiling(F.lit(50), F.first("own"))
    return owned.groupBy("source").agg(ceiling.cast("int").alias("ceiling"), F.coalesce(F.sum("n"), F.lit(0)).alias("problems"))


@query("with r as (select event_id, ts from events where event_type = 'click') select event_id, ts, row_number() over (order by ts desc, event_id::varchar desc) as place from r order by place limit 20")
def newest_clicks(spark, folder):
    """O3, Q6: the twenty newest, ids compared by bytes."""
    rows = access.newest_first(table(spark, folder, "events").filter("event_type = 'click'").select("event_id", "ts"), "ts", "event_id").limit(20)
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("ts"), F.desc(F.col("event_id").cast("string")))  # twenty rows
    return rows.withColumn("place", F.row_number().over(order).cast("bigint"))


@query("select vec_id as key, label, round(list_sum(embedding::double[]), 3) + 0.0 as total from embeddings where vec_id % 3 > 0 union all select vec_id, label + 100, round(list_sum(embedding::double[]), 3) + 0.0 from embeddings where vec_id % 3 = 0")
def vector_cache(spark, folder):
    """A cache of vectors after a batch that replaces every third."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("key"), "label", access.pack_floats(F.col("embedding").cast("array<double>")).alias("vector"))
    rows = lambda df, at: df.withColumn("at", F.lit(at))
    both = sinks.cached(rows(e, 1), rows(e.filter("key % 3 = 0").withColumn("label", F.col("label") + 100), 2))
    return both.select("key", "label", (F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 3) + 0.0).alias("total"))


@query("""
with s as (select doc_id as key, length(text) + case when doc_id % 5 = 0 then 1000000 else 0 end as size, doc_id % 5 = 0 as night from documents where doc_id % 2 = 0 or doc_id % 5 = 0)
select s.key, size, night, round(list_sum(embedding::double[]), 3) + 0.0 as total from s join embeddings on s.key = vec_id""")
def bucketed_cache(spark, folder):
    """A store in buckets, merged with a night that replaces and adds rows, then asked with every vector's key; the store is never shuffled."""
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("key"), F.length("text").cast("bigint").alias("size"), F.lit(False).alias("night"))
    night = d.filter("key % 5 = 0").select("key", (F.col("size") + 1_000_000).alias("size"), F.lit(True).alias("night"))
    store = sinks.bucketed(sinks.merged(sinks.bucketed(d.filter("key % 2 = 0"), "store", 8), night, 8), "merged", 8)
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    total = F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 3) + 0.0
    return sinks.looked_up(store, e).join(e.hint("shuffle_merge"), "key").select("key", "size", "night", total.alias("total"))


@query("select source, count(*) * 2 as n from documents group by 1")
def compound_documents(spark, folder):
    """SO6: two sources of documents together, equal ones kept."""
    d = table(spark, folder, "documents").select("doc_id", "source")
    return access.compound(d, d.select("doc_id", "source")).groupBy("source").agg(F.count("*").alias("n"))


# ---- places and evaluation rows ---------------------------------------------
@query("""with p as (select 'p' || c_custkey % 50 as place, 'm' || c_custkey % 5 as municipality, 50 + (c_custkey // 50 % 3) * case when c_custkey % 2 = 0 then 0.01 else 0.5 end as lat, 5.0 as lon from customer)
select place as name, case when max(lat) - min(lat) < 0.1 then round(avg(lat), 6) end as lat, case when max(lat) - min(lat) < 0.1 then round(avg(lon), 6) end as lon from p group by 1
union all select municipality, round(avg(lat), 6), round(avg(lon), 6) from p group by 1""")
def point_gazetteer(spark, folder):
    """The point of each place; null where its copies lie too far apart."""
    k = F.col("c_custkey")
    lat = 50 + (F.floor(k / 50) % 3) * F.when(k % 2 == 0, 0.01).otherwise(0.5)
    places = table(spark, folder, "customer").select(F.concat(F.lit("P"), k % 50).alias("place"), F.concat(F.lit("M"), k % 5).alias("municipality"), lat.cast("double").alias("lat"), F.lit(5.0).alias("lon"))
    assert SAME_PLACE_KM < 50
    return windows.point_gazetteer(places, F.lower).select("name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("select l_orderkey as query_id, count(*) filter (where l_quantity >= 45) = 0 and count(*) filter (where l_quantity between 20 and 44) = 0 as is_control from lineitem group by 1")
def control_cvs(spark, folder):
    """CVs that nothing is relevant for are reported apart."""
    q = F.col("l_quantity")
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.count_if(q >= 45).alias("n_relevant"), F.count_if((q >= 20) & (q < 45)).alias("n_maybe"))
    return metrics.control_rows(rows).select("query_id", "is_control")


@query("select label_key, note from (select doc_id + case when doc_id % 10 = 0 then 100000000 else 0 end as label_key, quality as note from labels) where label_key not in (select doc_id from documents)")
def unknown_labels(spark, folder):
    """F24, SO2: labelled keys that the corpus does not hold."""
    labels = table(spark, folder, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 100000000).otherwise(0)).alias("doc_id"), F.col("quality").alias("note"))
    return metrics.unknown_labels(labels, table(spark, folder, "documents")).select(F.col("doc_id").alias("label_key"), "note")


@query("select p_brand as model, p_size % 3 as style, p_size % 2 as instruction, arg_min(p_name, p_partkey) as name, min(p_partkey) as position from part group by all")
def distinct_configs(spark, folder):
    """one configuration of each model, style and instruction."""
    p = table(spark, folder, "part").select(F.col("p_brand").alias("model"), (F.col("p_size") % 3).alias("style"), (F.col("p_size") % 2).alias("instruction"), F.col("p_name").alias("name"), F.col("p_partkey").alias("position"))
    return metrics.distinct_configs(p)


@query("select o_orderkey, (o_totalprice < 50000) = (o_orderstatus <> 'F') as right from orders")
def refusal_check(spark, folder):
    """A refusal is right if and only if there are no matches."""
    rows = table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") < 50000).alias("refused"), (F.col("o_orderstatus") == "F").alias("has_matches"))
    return metrics.refusal_check(rows).select("o_orderkey", "right")


_VARIANTS = f"""{_LINES.replace("lines as", "unique_lines as", 1)}, lines as (select l_orderkey as query_id, l_partkey * 10 + l_linenumber as doc_id, l_quantity, l_discount, l_linenumber from unique_lines),
ranking as (select 'a' as variant, query_id, doc_id, row_number() over (partition by query_id order by l_linenumber) as rank from lines union all select 'b', query_id, doc_id, row_number() over (partition by query_id order by l_linenumber desc) from lines),
grades as (select query_id, doc_id, case when l_quantity >= 40 then 2 else 1 end as grade from lines where l_quantity >= 25),
judged as (select query_id, doc_id from lines where l_discount > 0.02)"""


@query(f"""with {_VARIANTS},
r as (select variant, r.query_id, r.doc_id, rank, grade, j.doc_id is not null as judged from ranking r left join grades g using (query_id, doc_id) left join judged j on r.query_id = j.query_id and r.doc_id = j.doc_id),
i as (select query_id, sum((pow(2, grade) - 1) / log2(n + 1)) as ideal from (select *, row_number() over (partition by query_id order by grade desc, doc_id) as n from grades) where n <= 3 group by 1),
s as (select variant, query_id, coalesce(max(case when rank = 1 and grade = 2 then 1.0 else 0 end), 0)::double as hit_at_1, coalesce(count(*) filter (where grade = 2 and rank <= 3) / nullif(count(*) filter (where grade = 2), 0), 0) as recall,
  coalesce(1 / min(rank) filter (where grade = 2), 0) as reciprocal_rank, coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) filter (where rank <= 3 and grade is not null), 0) as got, count(*) filter (where rank <= 3 and judged) / count(*) filter (where rank <= 3) as labelled_share from r group by 1, 2)
select variant, s.query_id, hit_at_1, round(recall, 9) as recall, round(reciprocal_rank, 9) as reciprocal_rank, round(got / ideal, 9) as ndcg, round(labelled_share, 9) as labelled_share, round(min(labelled_share) over (partition by s.query_id), 9) as floor from s join i using (query_id)""")
def per_cv_rows(spark, folder):
    """Metrics of every CV and variant with the labelled floor of the CV."""
    from pyspark.sql import Window

    lines = _lines(spark, folder, by_order=True).select(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("doc_id"), "l_quantity", "l_discount", "l_linenumber")
    order = lambda name, by: lines.select(F.lit(name).alias("variant"), "query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy(by)).alias("rank"))
    both = order("a", F.col("l_linenumber")).unionByName(order("b", F.desc("l_linenumber")))
    grades = lines.filter("l_quantity >= 25").select("query_id", "doc_id", F.when(F.col("l_quantity") >= 40, 2).otherwise(1).alias("grade"))
    got = metrics.per_cv_rows(both, grades, lines.filter("l_discount > 0.02").select("query_id", "doc_id"), 3, ["a", "b"])
    return got.select("variant", "query_id", "hit_at_1", *[F.round(c, 9).alias(c) for c in ("recall", "reciprocal_rank", "ndcg", "labelled_share", "floor")])
