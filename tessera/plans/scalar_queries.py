"""Queries of single functions and small views over the order tables, so that each has a statement to compare with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arith
from tessera.functions import text as t
from tessera.operators import gaps, reports, views
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import sinks


@query("""
select c_custkey, n_name as city, r_name as country, case c_custkey % 3 when 0 then c_name else 'Tenant Ab' end as company, 'R' || c_custkey as requisition,
  case c_custkey % 4 when 0 then 'a' when 1 then 'a or b' when 2 then 'a, b or c' else '' end as listed,
  case c_custkey % 5 when 0 then 'greenhouse:acme' || c_custkey when 1 then 'recruitee:acme' || c_custkey when 2 then 'lever:acme' || c_custkey end as board,
  case c_custkey % 3 when 0 then 'de' when 1 then 'en' else 'fr' end as language, array_to_string(case c_custkey % 2 when 0 then ['medior', 'senior'] else ['lead'] end, ',') as levels,
  to_base64(unhex(md5(c_name))) as md5, '{"k": ' || c_custkey || '}' as part, 'salary' as field, 'at most ' || c_custkey as found
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def scalar_text(spark, folder):
    """Names, links, headers and lines of customers."""
    c, n, r = (table(spark, folder, x) for x in ("customer", "nation", "region"))
    key = F.col("c_custkey")
    place = t.city_and_country(F.concat_ws(", ", "n_name", "r_name"))
    name = F.when(key % 3 == 0, F.col("c_name")).when(key % 3 == 1, F.concat(F.lit("12"), F.col("c_name")))
    items = F.slice(F.array(*map(F.lit, "abc")), 1, (key % 4).cast("int") + 1)
    items = F.when(key % 4 == 3, F.array().cast("array<string>")).otherwise(items)
    acme = F.concat(F.lit("acme"), key)
    link = F.when(key % 5 == 0, F.concat(F.lit("https://boards.greenhouse.io/"), acme)).when(key % 5 == 1, F.concat(F.lit("https://"), acme, F.lit(".recruitee.com/o/x"))).when(key % 5 == 2, F.concat(F.lit("https://jobs.lever.co/"), acme, F.lit("/1"))).otherwise("https://example.org/")
    header = F.when(key % 3 == 0, "fr;q=0.5, de;q=0.9, en;q=0.8").when(key % 3 == 1, "en-GB,en;q=0.7").otherwise("xx, fr;q=0.1")
    levels = t.title_levels(F.when(key % 2 == 0, "Medior/Senior Developer").otherwise("Head of Staff"))
    line = t.conflict_parts(F.concat(F.lit("salary: at most "), key, F.lit(" (wanted: more)")))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(
        "c_custkey", place["city"].alias("city"), place["country"].alias("country"), t.company_or_tenant(name, F.lit("tenant-ab")).alias("company"),
        t.requisition_id(F.concat(F.lit("/job/Dev_R"), key)).alias("requisition"), t.human_list(items).alias("listed"), t.board_of(link).alias("board"),
        t.preferred_language(header, ("en", "de", "fr"), "en").alias("language"), F.array_join(levels, ",").alias("levels"), t.md5_base64(F.col("c_name")).alias("md5"),
        arith.json_part(F.concat(F.lit('noise {"k": '), key, F.lit("} end"))).alias("part"), line["field"].alias("field"), line["found"].alias("found"),
    )


@query("""
select s_suppkey, greatest(1, round_even(abs(s_acctbal) / 1.609344::double, 0))::int as miles, round_even(s_acctbal, 0) as whole, case when s_nationkey % 2 = 0 then 'Utrecht' end as province,
  case when s_suppkey % 2 = 0 then s_suppkey || '-' || (s_suppkey + 8) when s_suppkey % 3 = 0 then 'tot ' || s_suppkey else s_suppkey::varchar end as range, s_acctbal + 10 > 5000 as over, s_suppkey + 0.0::double as wait,
  s_suppkey % 3 <> 2 as meets from supplier""")
def scalar_numbers(spark, folder):
    """Numbers of suppliers."""
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    level = F.when(k % 3 == 0, "mbo").when(k % 3 == 1, "hbo").otherwise("wo")
    none = F.lit(None).cast("bigint")
    low, high = F.when((k % 2 == 0) | (k % 3 != 0), k), F.when(k % 2 == 0, k + 8).when(k % 3 == 0, k).otherwise(none)
    had = arith.highest_level(F.array(F.struct(F.lit("hbo").alias("level"), F.lit(None).cast("boolean").alias("finished")), F.struct(F.lit("wo").alias("level"), F.lit(False).alias("finished"))))
    code = F.when(F.col("s_nationkey") % 2 == 0, "NL31X").otherwise("DE111")
    return table(spark, folder, "supplier").select(
        "s_suppkey", arith.miles(F.abs(bal)).alias("miles"), arith.half_even(bal).alias("whole"), arith.nuts_province(code).alias("province"), arith.range_text(low, high).alias("range"),
        arith.over_budget(bal, F.lit(10.0), F.lit(5000.0)).alias("over"), arith.retry_after(k.cast("string"), F.lit("2024-01-01").cast("timestamp")).alias("wait"), arith.meets_level(level, had).alias("meets"),
    )


@query("""
select o_orderkey, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::int as s, (year(o_orderdate) * 12 + 12)::int as e, date_trunc('day', o_orderdate)::timestamp as nl, o_orderdate::timestamp as iso,
  case when o_orderkey % 400 < 1 then '<1h' when o_orderkey % 400 < 48 then (o_orderkey % 400) || 'h' else ((o_orderkey % 400) // 24) || 'd' end as age, o_orderkey % 2 = 0 as named from orders""")
def scalar_dates(spark, folder):
    """Dates of orders in several spellings."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    dutch = F.concat_ws(" ", F.dayofmonth(d), F.element_at(F.array(*map(F.lit, arith.MONTHS_NL)), F.month(d)), F.year(d))
    iso = F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 2 == 0, "Z").otherwise(" UTC"))
    text = F.concat(F.lit("since "), F.when(k % 4 == 0, F.year(d).cast("string")).when(k % 2 == 0, F.concat(F.lit("'"), F.date_format(d, "yy"))).otherwise("then"))
    return table(spark, folder, "orders").select(
        "o_orderkey", arith.start_month(F.date_format(d, "yyyy-MM")).alias("s"), arith.end_month(F.date_format(d, "yyyy")).alias("e"), arith.dutch_date(dutch).cast("timestamp_ntz").alias("nl"),
        arith.moment(iso).cast("timestamp_ntz").alias("iso"), arith.age_text((k % 400) * 3600).alias("age"), arith.names_year(text, F.date_format(d, "yyyy-MM")).alias("named"),
    )


@query("""
with a as (select o_orderkey, case o_orderkey % 4 when 0 then null when 1 then 1 when 2 then 2 else 3 end as level, o_orderkey % 3 as l, o_orderkey % 9 as years from orders)
select count(*) as total, count(*) filter (where level > 2) as level, sum(case l when 0 then 2 when 1 then 1 else 0 end)::bigint as languages, count(*) filter (where years > 6.5) as years, max(years) filter (where years > 6.5) as most_years from a""")
def field_gaps(spark, folder):
    """Orders as adverts against a level, a language and years."""
    k = F.col("o_orderkey")
    langs = F.when(k % 3 == 0, F.array(F.lit("German"), F.lit("French"))).when(k % 3 == 1, F.array(F.lit("Dutch"), F.lit("French"))).otherwise(F.array(F.lit("dutch")))
    level = F.when(k % 4 == 1, 1).when(k % 4 == 2, 2).when(k % 4 == 3, 3)
    rows = table(spark, folder, "orders").select(k.alias("key"), level.alias("level"), langs.alias("languages"), (k % 9).alias("years_min"))
    return gaps.field_gaps(rows, 2, ["dutch"], 6.5)


@query("""
with t as (select distinct lower(p_type) as term from part), s as (select term, list_distinct(string_split(term, ' ')) as w from t union select distinct lower(split_part(p_type, ' ', 1)), [lower(split_part(p_type, ' ', 1))] from part),
h as (select a.term, arg_min(b.term, length(b.term) * 1000) as host from s a join s b on len(b.w) < len(a.w) and len(list_intersect(a.w, b.w)) = len(b.w) group by a.term)
select s.term, coalesce(h2.host, h.host, s.term) as host from s left join h on s.term = h.term left join h h2 on h.host = h2.term""")
def merged_terms(spark, folder):
    """A9, SO4: part types as terms, folded into their first words."""
    p = table(spark, folder, "part")
    terms = p.select(F.lower("p_type").alias("term")).unionByName(p.select(F.lower(F.substring_index("p_type", " ", 1)).alias("term")))
    return gaps.merged_terms(terms)


@query("""select p_brand as board, count(*) as jobs, count(*) filter (where p_size > 20) as dutch, count(*) filter (where p_size > 20 and p_retailprice > 1000) as in_scope, count(*) filter (where p_size > 20 and p_retailprice > 1000) >= 20 as accept from part group by 1""")
def board_check(spark, folder):
    """Brands as boards, their counts and whether they are worth adding."""
    jobs = table(spark, folder, "part").select(F.col("p_brand").alias("board"), (F.col("p_size") > 20).alias("dutch"), (F.col("p_retailprice") > 1000).alias("in_scope"))
    return reports.board_check(jobs, 20)


@query("select p_partkey as path from part where p_size > 10 and (p_partkey % 3 = 0 or p_partkey % 7 = 0)")
def changed_files(spark, folder):
    """K7: allowed files that the store does not hold in this version."""
    p = table(spark, folder, "part")
    local = p.select(F.col("p_partkey").alias("path"), F.md5("p_name").alias("md5"), "p_size")
    remote = p.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("path"), F.md5(F.when(F.col("p_partkey") % 3 == 0, "old").otherwise(F.col("p_name"))).alias("md5"))
    return sinks.changed_files(local, remote, F.col("p_size") > 10).select("path")


@query("select o_orderkey from orders where o_orderdate >= timestamp '1998-01-01' - interval 90 day and o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def retained_rows(spark, folder):
    """Rows of the last 90 days, without those of deleted customers."""
    o = table(spark, folder, "orders")
    gone = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return sinks.without(sinks.retained(o, "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")), gone, "o_custkey").select("o_orderkey")


@query("""
with g as (select l_orderkey, arg_min(l_linenumber, l_linenumber + case when l_returnflag = 'R' then 0 else 1000 end) as gap, count(*) as judged, max(l_quantity)::int as fit from lineitem group by 1)
select l_orderkey, gap::varchar as gap, fit, case when fit >= 40 then 'strong' else 'weak' end as verdict, judged from g""")
def match_cards(spark, folder):
    """Orders as runs: the first required gap, else the first, and sizes of nested lists."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_linenumber").cast("string").alias("requirement"), (F.col("l_returnflag") == "R").alias("required"))
    runs = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("gaps"), F.max("l_quantity").cast("int").alias("fit"))
    rows = runs.select(F.col("l_orderkey").alias("key"), F.when(F.col("fit") >= 40, "strong").otherwise("weak").alias("verdict"), "fit", "gaps", F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("city"), F.struct(F.lit("x").alias("company"), F.lit("y").alias("city")).alias("details"))
    cards = views.match_card(rows).select("key", "verdict", "fit", "gap")
    sizes = views.run_summaries(runs.select(F.col("l_orderkey").alias("id"), F.lit("c").alias("cv"), F.lit(0).alias("at"), F.col("gaps").alias("rows"), F.col("gaps").alias("ranking"))).select(F.col("id").alias("key"), F.col("judged").cast("bigint").alias("judged"))
    return cards.join(sizes, "key").select(F.col("key").alias("l_orderkey"), "gap", "fit", "verdict", "judged")
