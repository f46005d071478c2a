"""Queries of scores, preferences, gaps, spending, comparisons and constraints over the order tables and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arith
from tessera.functions import text as t
from tessera.operators import gaps, metrics, preferences, reports, views, windows
from tessera.plans.registry import query
from tessera.session import latest, table, written
from tessera.sources import sinks


@query("""
select c_custkey, coalesce(round(sum(o_totalprice) filter (where o_orderstatus = 'F'), 2), 0) as ours, coalesce(round(sum(o_totalprice) filter (where o_orderstatus <> 'F'), 2), 0) as theirs, count(o_orderkey) as calls
from customer left join orders on c_custkey = o_custkey and o_orderdate >= timestamp '1996-01-01' group by c_custkey""")
def spend_by_person(spark, folder):
    """Every customer with the sums of the period, the date in the join."""
    usage = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", "us").otherwise("them").alias("paid_by"), F.col("o_totalprice").alias("cost"))
    got = reports.spent_by_person(table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id")), usage, F.lit("1996-01-01").cast("timestamp_ntz"))
    return got.select(F.col("user_id").alias("c_custkey"), F.round("ours", 2).alias("ours"), F.round("theirs", 2).alias("theirs"), "calls")


@query("select p as paid_by, coalesce(round(sum(o_totalprice), 2), 0) as cost from (values ('1-URGENT'), ('2-HIGH'), ('nobody')) v(p) left join orders on o_orderpriority = p group by p")
def spent_by_payer(spark, folder):
    """A2: the sum of each payer, zero where there is none."""
    usage = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("paid_by"), F.col("o_totalprice").alias("cost"))
    return reports.spent(usage, ["1-URGENT", "2-HIGH", "nobody"]).withColumn("cost", F.round("cost", 2))


@query("""
select c_custkey, (select max(o_orderdate) from orders where o_custkey = c_custkey) as last_order, (select max(o_orderdate) from orders where o_custkey = c_custkey and o_orderstatus = 'O') as last_open,
  exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) as large from customer""")
def people_latest(spark, folder):
    """Latest rows and existence for each customer, from one grouping."""
    got = table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))).alias("last_open"), F.bool_or(F.col("o_totalprice") > 300000).alias("large"))
    joined = table(spark, folder, "customer").join(got, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "last_order", "last_open", F.coalesce("large", F.lit(False)).alias("large"))


def _fits(spark, folder) -> DataFrame:
    """Lines as judged rows: the quantity gives the fit, bands give the verdict."""
    fit = (F.col("l_quantity") * 2).cast("int")
    verdict = F.when(fit >= 95, "strong").when(fit >= 40, "possible").otherwise("weak")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", fit.alias("fit"), verdict.alias("verdict"), "l_linestatus")


_FITS = "with f as (select *, (l_quantity * 2)::int as fit, case when (l_quantity * 2)::int >= 95 then 'strong' when (l_quantity * 2)::int >= 40 then 'possible' else 'weak' end as verdict from lineitem)"


@query(f"""{_FITS}, c as (select l_suppkey, count(*) filter (where verdict = 'strong') as n_strong, count(*) filter (where verdict = 'possible') as n_possible, count(*) filter (where verdict = 'weak') as n_weak, max(fit) as best_fit from f group by 1)
select *, case when n_strong > 0 then 'ok' when n_possible > 0 then 'no_clear_fit' else 'nothing' end as outcome from c""")
def outcome_bands(spark, folder):
    """Verdict counts and the outcome of each supplier."""
    return preferences.outcome(_fits(spark, folder), "l_suppkey")


@query("""
with a as (select l_orderkey, case l_linenumber % 4 when 0 then 'eligibility' when 1 then 'skill' when 2 then 'experience' else 'education' end as kind, l_tax < 0.06 as must, l_discount > 0.09 as knockout,
  case l_returnflag when 'R' then 'met' when 'A' then 'partly' else 'missing' end as status,
  case l_orderkey % 3 when 0 then 'same' when 1 then 'next' else 'different' end as work, (l_orderkey % 5 = 0)::int as conflicts from lineitem),
w as (select *, case when kind = 'eligibility' then 0.0 when not must then 0.25 when kind in ('experience', 'education') then 0.5 else 1.0 end::double as w from a),
s as (select l_orderkey, sum(w) as total, sum(w * case status when 'met' then 1.0 when 'partly' then 0.5 else 0.0 end)::double as earned, min(work) as work, max(conflicts) as conflicts, bool_or(knockout and status = 'missing') as stopped from w group by 1),
p as (select *, case work when 'same' then 1.0::double when 'next' then 0.6::double else 0.0::double end as points from s),
h as (select *, 0.7::double * coalesce(earned / nullif(total, 0), points) + 0.3::double * points as share, stopped or work = 'different' as ruled from p),
v as (select *, case when share >= 0.75 and not ruled and conflicts = 0 then 'strong' when share >= 0.40 and not ruled then 'possible' else 'weak' end as verdict from h)
select l_orderkey, round(share, 9) as share, verdict, case
  when verdict = 'strong' then round_even(100 * share, 0)
  when verdict = 'possible' and conflicts > 0 then 40 + round_even(share * 17, 0)
  when verdict = 'possible' then 58 + round_even(greatest(0, least(1, (share - 0.40::double) / (0.75::double - 0.40::double))) * 16, 0)
  when ruled or conflicts > 0 then round_even(share * 19, 0)
  else 20 + round_even(greatest(0, least(1, share / 0.40::double)) * 19, 0) end::int as fit from v""")
def requirement_score(spark, folder):
    """Lines as answered requirements of an order."""
    kind = F.when(F.col("l_linenumber") % 4 == 0, "eligibility").when(F.col("l_linenumber") % 4 == 1, "skill").when(F.col("l_linenumber") % 4 == 2, "experience").otherwise("education")
    status = F.when(F.col("l_returnflag") == "R", "met").when(F.col("l_returnflag") == "A", "partly").otherwise("missing")
    work = F.when(F.col("l_orderkey") % 3 == 0, "same").when(F.col("l_orderkey") % 3 == 1, "next").otherwise("different")
    rows = table(spark, folder, "lineitem").select("l_orderkey", kind.alias("kind"), (F.col("l_tax") < 0.06).alias("must"), (F.col("l_discount") > 0.09).alias("knockout"), status.alias("status"), work.alias("work"), (F.col("l_orderkey") % 5 == 0).cast("int").alias("conflicts"))
    return preferences.requirement_scores(rows, "l_orderkey")


@query("""
with p as (select o_custkey, (extract(year from o_orderdate) * 12 + extract(month from o_orderdate) - 1)::bigint as s, (extract(year from o_orderdate) * 12 + extract(month from o_orderdate) - 1)::bigint + 1 + o_orderkey % 9 as e from orders),
w as (select *, max(e) over (partition by o_custkey order by s, e rows between unbounded preceding and 1 preceding) as before from p),
m as (select o_custkey, sum(greatest(e - greatest(s, coalesce(before, s)), 0))::bigint as months from w group by 1)
select o_custkey, months, round_even(months / 12, 1) as years from m""")
def experience_years(spark, folder):
    """Orders as overlapping periods of a customer, merged."""
    start = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    rows = table(spark, folder, "orders").select("o_custkey", start.cast("bigint").alias("start"), (start + 1 + F.col("o_orderkey") % 9).cast("bigint").alias("end"))
    return windows.merged_months(rows, "o_custkey")


@query("""
with p as (select n_nationkey, (n_nationkey * 7) % 60 - 10.0 as lat, (n_nationkey * 13) % 90 - 20.0 as lon from nation),
d as (select c_custkey, 2 * 6371.0 * asin(sqrt(least(1, pow(sin(radians(p.lat - 52.0) / 2), 2) + cos(radians(52.0)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - 5.0) / 2), 2)))) as km, 100 + c_custkey % 4000 as max_km from customer join p on c_nationkey = n_nationkey)
select c_custkey, round(km, 6) as km, km > max_km + greatest(max_km * 0.25, 5) as too_far from d""")
def haversine_conflicts(spark, folder):
    """Distances from one home, and who is farther than the limit allows."""
    n = table(spark, folder, "nation").select("n_nationkey", ((F.col("n_nationkey") * 7) % 60 - 10.0).alias("lat"), ((F.col("n_nationkey") * 13) % 90 - 20.0).alias("lon"))
    c = table(spark, folder, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    km = arith.haversine_km(F.lit(52.0), F.lit(5.0), F.col("lat"), F.col("lon"))
    return c.select("c_custkey", F.round(km, 6).alias("km"), (km > arith.allowed_km(100 + F.col("c_custkey") % 4000)).alias("too_far"))


@query("""
with x as (select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then null else l_quantity end as low, case when l_linenumber % 5 = 0 then null else l_quantity + 5 end as high,
  case l_returnflag when 'R' then 'hour' when 'A' then 'year' else 'month' end as period, case when l_linenumber % 2 = 0 then 0 else 32 end as h from lineitem)
select l_orderkey, l_linenumber, round(case period when 'month' then coalesce(high, low) when 'year' then coalesce(high, low) / 12 else coalesce(high, low) * coalesce(nullif(h, 0), 40) * 52 / 12 end, 6) as monthly from x""")
def salary_monthly(spark, folder):
    """M5: monthly amounts from three periods; zero hours are not stated."""
    n = F.col("l_linenumber")
    low, high = F.when(n % 3 != 0, F.col("l_quantity")), F.when(n % 5 != 0, F.col("l_quantity") + 5)
    period = F.when(F.col("l_returnflag") == "R", "hour").when(F.col("l_returnflag") == "A", "year").otherwise("month")
    hours = F.when(n % 2 == 0, 0).otherwise(32)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(arith.monthly(low, high, period, F.lit(None).cast("int"), hours), 6).alias("monthly"))


@query("""
with w as (select p_partkey, p_size as hours, p_retailprice as salary, p_brand, lower(p_name) as title from part)
select p_partkey, array_to_string(list_filter([case when hours < 10 or hours > 30 then 'hours' end, case when salary < 1000 then 'salary' end, case when p_brand = 'Brand#11' then 'employer' end], lambda x: x is not null), ',') as fields from w""")
def preference_conflicts(spark, folder):
    """Parts as adverts against one person's wishes."""
    none, empty = (lambda k: F.lit(None).cast(k)), F.array().cast("array<string>")
    advert = {"contract_type": none("string"), "work_mode": none("string"), "hours_min": F.col("p_size"), "hours_max": F.col("p_size"), "salary_min": F.col("p_retailprice"), "salary_max": none("double"), "salary_period": F.lit("month"), "km": none("double"), "languages": empty, "title": F.col("p_name"), "company": F.col("p_brand")}
    wish = {"contract_types": empty, "work_modes": empty, "hours_min": F.lit(10), "hours_max": F.lit(30), "salary_min": F.lit(1000.0), "max_km": none("double"), "languages": empty, "seniority": empty, "avoid": F.array(F.lit("Brand#11"))}
    found = preferences.conflicts(advert, wish)
    return table(spark, folder, "part").select("p_partkey", F.array_join(F.transform(found, lambda c: c["field"]), ",").alias("fields"))


@query("""
with o as (select l_orderkey, l_linenumber, l_quantity::int as fit, l_returnflag as verdict from lineitem where l_linenumber <= 4), n as (select l_orderkey, l_linenumber, (l_quantity + case when l_tax > 0.05 then 1 else 0 end)::int as fit, l_returnflag as verdict from lineitem where l_linenumber >= 2)
select coalesce(o.l_orderkey, n.l_orderkey) || ':' || coalesce(o.l_linenumber, n.l_linenumber) as key, case when o.fit is null then 'entered' when n.fit is null then 'left' when o.fit = n.fit and o.verdict = n.verdict then 'unchanged' else 'changed' end as change, (n.fit - o.fit)::double as fit_change
from o full join n on o.l_orderkey = n.l_orderkey and o.l_linenumber = n.l_linenumber""")
def compare_runs(spark, folder):
    """Two runs by key."""
    rows = table(spark, folder, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("key"), "l_linenumber", F.col("l_returnflag").alias("verdict"), "l_quantity", "l_tax")
    old = rows.filter("l_linenumber <= 4").withColumn("fit", F.col("l_quantity").cast("int"))
    new = rows.filter("l_linenumber >= 2").withColumn("fit", (F.col("l_quantity") + F.when(F.col("l_tax") > 0.05, 1).otherwise(0)).cast("int"))
    return reports.compare_runs(old, new).select("key", "change", F.col("fit_change").cast("double").alias("fit_change"))


@query("select conv_id, max_by(role, turn) as role, max(turn) as turn, count(*) as turns from conversations group by conv_id")
def latest_per_key(spark, folder):
    """W1, J23, SO5: each conversation's last turn."""
    c = table(spark, folder, "conversations")
    sizes = c.groupBy(F.col("conv_id").alias("__c")).agg(F.count("*").alias("turns"))
    return latest(c, ["conv_id"], [F.desc("turn")]).join(sizes, F.col("conv_id") == F.col("__c")).select("conv_id", "role", "turn", "turns")



@query()
def gap_groups(spark, folder):
    """Conversation turns as gaps, the longest vocabulary term that each names, grouped by weight."""
    c = table(spark, folder, "conversations").withColumn("gap_id", F.col("conv_id") * 1000 + F.col("turn"))
    words = F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 8))
    common = c.filter("role = 'system'").select(words.alias("skill"), F.col("gap_id").alias("position"))
    vocab = written(gaps.vocabulary(common), "vocabulary")
    named = gaps.term_for(c.select("gap_id", F.col("text").alias("requirement"), F.lit("").alias("quote")), vocab).filter("term is not null")
    spelled = named.join(vocab.select("term", "spelling"), "term")
    rows = spelled.select("term", "spelling", F.floor(F.col("gap_id") / 1000).alias("key"), (F.col("gap_id") % 2 == 0).alias("required"), (F.col("gap_id") % 100).cast("int").alias("fit"), F.col("gap_id").alias("position"))
    return gaps.gap_groups(rows)


@query("select l_orderkey, l_linenumber, array_to_string(list_filter([case when not (l_quantity <= 45) then 'quantity' end, case when not (l_discount <= 0.09) then 'discount' end, case when not (l_linestatus <> 'F' or l_returnflag <> 'N') then 'status' end], lambda x: x is not null), ',') as problems from lineitem where not (l_quantity <= 45) or not (l_discount <= 0.09) or not (l_linestatus <> 'F' or l_returnflag <> 'N')")
def validation_quarantine(spark, folder):
    """F16: rows that break a constraint, with the names of those they break."""
    rules = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") <= 0.09, "status": (F.col("l_linestatus") != "F") | (F.col("l_returnflag") != "N")}
    rows = preferences.checked(table(spark, folder, "lineitem"), rules).filter(F.size("problems") > 0)
    return rows.select("l_orderkey", "l_linenumber", F.array_join("problems", ",").alias("problems"))


@query("""
with prices(model, i, o) as (values ('1-URGENT', 0.3, 2.5), ('2-HIGH', 0.1, 0.4))
select o_orderpriority as model, count(*) as runs, round(sum((o_totalprice * i::double + o_custkey * o::double) / 1e6), 9) as cost from orders left join prices on model = o_orderpriority group by 1""")
def price_runs(spark, folder):
    """Cost by model; null where a model has no price."""
    prices = spark.createDataFrame([("1-URGENT", 0.3, 2.5), ("2-HIGH", 0.1, 0.4)], "model string, input_price double, output_price double")
    runs = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("prompt_tokens"), F.col("o_custkey").alias("output_tokens"))
    return metrics.run_cost(runs, F.broadcast(prices)).groupBy("model").agg(F.count("*").alias("runs"), F.round(F.sum("cost"), 9).alias("cost"))


@query(f"""{_FITS} select verdict, (l_linestatus = 'O')::int as label, count(*) as n, verdict = 'strong' and (l_linestatus = 'O')::int = 0 as costly, verdict = 'weak' and (l_linestatus = 'O')::int = 1 as cheap from f group by 1, 2""")
def confusion(spark, folder):
    """Verdicts against labels."""
    return metrics.confusion(_fits(spark, folder).withColumn("label", (F.col("l_linestatus") == "O").cast("int")))


@query("select o_custkey, min(o_totalprice) as least, list_sort(list(o_totalprice))[(count(*) // 2 + 1)::bigint] as upper_median from orders group by 1")
def upper_median(spark, folder):
    """Of n sorted values that at n // 2."""
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("least"), metrics.upper_median("o_totalprice").alias("upper_median"))


@query("""
with x as (select l_doc.doc_id, case when quality = 1 then 'en' else case when l_doc.doc_id % 7 = 0 then null else 'de' end end as expected, case when l_doc.doc_id % 5 = 0 then null else lang end as predicted from documents l_doc join labels using (doc_id)),
o as (select *, case when expected is null then case when predicted is null then 'correct_null' else 'hallucinated' end when predicted is null then 'missed' when expected = predicted then 'correct' else 'wrong' end as outcome from x)
select 'lang' as field, round(count(*) filter (where outcome in ('correct', 'correct_null')) / count(*), 9) as accuracy, count(*) filter (where outcome = 'correct') as correct, count(*) filter (where outcome = 'wrong') as wrong, count(*) filter (where outcome = 'missed') as missed, count(*) filter (where outcome = 'hallucinated') as hallucinated, count(*) filter (where outcome = 'correct_null') as correct_null from o""")
def extraction_scores(spark, folder):
    """Outcomes of an extracted field against labels."""
    d = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
    expected = F.when(F.col("quality") == 1, "en").when(F.col("doc_id") % 7 != 0, "de")
    predicted = F.when(F.col("doc_id") % 5 != 0, F.col("lang"))
    scored = d.select(F.lit("lang").alias("field"), metrics.scalar_outcome(expected, predicted).alias("outcome"))
    return metrics.extraction_report(scored).withColumn("accuracy", F.round("accuracy", 9))


@query("""
with w as (select item_id, list_distinct(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ')) as w from benchmark),
c as (select item_id, list_distinct(list_transform(w, lambda x: regexp_replace(x, '\\.+$', ''))) as e, list_distinct(list_transform(list_filter(w, lambda x: length(x) > 3), lambda x: regexp_replace(x, '\\.+$', ''))) as p from w),
s as (select item_id, e, p, len(list_intersect(e, p)) as h from c)
select item_id, round(case when len(p) > 0 then h / len(p) when len(e) = 0 then 1 else 0 end, 9) as precision, round(case when len(e) > 0 then h / len(e) when len(p) = 0 then 1 else 0 end, 9) as recall from s""")
def list_scores(spark, folder):
    """Word lists with and without short words, as sets."""
    words = F.split(t.squeeze(F.lower("text")), " ")
    score = metrics.list_score(words, F.filter(words, lambda w: F.length(w) > 3))
    got = table(spark, folder, "benchmark").select("item_id", score.alias("s"))
    return got.select("item_id", F.round("s.precision", 9).alias("precision"), F.round("s.recall", 9).alias("recall"))


@query("""
with d as (select distinct md5(text) as query from documents where doc_id % 3 <> 0),
e as (select query, min(id) as labelled from (select md5(text) as query, item_id as id from benchmark union all select md5(text), doc_id from documents where doc_id % 2 = 0) group by 1)
select coalesce(d.query, e.query) as query, labelled::double as labelled, d.query is null as dropped from d full join e on d.query = e.query""")
def merge_draft(spark, folder):
    """Draft queries, by the digest of the whole text, with the labels of those that exist, and those that the draft drops."""
    docs, digest = table(spark, folder, "documents"), F.md5("text").alias("query")
    draft = docs.filter("doc_id % 3 <> 0").select(digest).distinct().withColumn("relevant", F.lit(None).cast("bigint"))
    existing = table(spark, folder, "benchmark").select(digest, F.col("item_id").alias("id")).unionByName(docs.filter("doc_id % 2 = 0").select(digest, F.col("doc_id").alias("id")))
    kept, dropped = metrics.merge_draft(draft, existing.groupBy("query").agg(F.min("id").alias("relevant")))
    return kept.select("query", F.col("relevant").cast("double").alias("labelled"), F.lit(False).alias("dropped")).unionByName(dropped.select("query", F.col("relevant").cast("double").alias("labelled"), F.lit(True).alias("dropped")))


@query("with s as (select o_orderkey, 'run-' || strftime(o_orderdate, '%Y%m') as stem from orders) select o_orderkey, case when row_number() over (partition by stem order by o_orderkey) = 1 then stem else stem || '-' || row_number() over (partition by stem order by o_orderkey) end as name from s")
def suffixed_names(spark, folder):
    """K5, Q13: names with a number from the second on."""
    rows = table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("run-"), F.date_format("o_orderdate", "yyyyMM")).alias("stem"))
    return sinks.suffixed(rows, "stem", "o_orderkey").select("o_orderkey", "name")


@query("""
with n as (select c_custkey as id, c_name as name, c_acctbal as v from customer where c_custkey % 3 = 0), s as (select c_custkey as id, c_name as name, -1.0::double as v from customer where c_custkey % 2 = 0)
select coalesce(n.id, s.id) as id, coalesce(n.name, s.name) as name, coalesce(n.v, s.v) as v from n full join s on n.id = s.id""")
def upserted_rows(spark, folder):
    """New rows win by key."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))
    return sinks.upserted(c.filter("id % 2 = 0").withColumn("v", F.lit(-1.0)), c.filter("id % 3 = 0"), ["id"])


@query("""
with f as (select p_partkey as number, md5(p_name) as checksum from part where p_partkey % 7 <> 0), a as (select p_partkey as number, md5(case when p_partkey % 11 = 0 then p_type else p_name end) as checksum from part where p_partkey % 5 <> 0)
select coalesce(f.number, a.number) as number, case when a.checksum is null then 'pending' when f.checksum is null then 'unknown' when f.checksum <> a.checksum then 'changed' else 'applied' end as state from f full join a on f.number = a.number""")
def migration_states(spark, folder):
    """K9, Q12: files against what has been applied."""
    p = table(spark, folder, "part")
    files = p.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("number"), F.md5("p_name").alias("checksum"))
    applied = p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("number"), F.md5(F.when(F.col("p_partkey") % 11 == 0, F.col("p_type")).otherwise(F.col("p_name"))).alias("checksum"))
    return sinks.migration_state(files, applied)


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 as active from orders")
def one_active(spark, folder):
    """Q5: the newest order of a customer is active."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return sinks.one_active(rows, "o_custkey", "at").select("o_orderkey", "active")


@query("select l_suppkey, sum(l_quantity)::bigint as quotes, sum(l_linenumber) ::bigint as dropped, round(coalesce((sum(l_quantity) - sum(l_linenumber)) / nullif(sum(l_quantity), 0), 1), 9) as faithfulness from lineitem group by 1")
def faithfulness(spark, folder):
    """The share of quotes that were found."""
    rows = table(spark, folder, "lineitem").select("l_suppkey", F.col("l_quantity").cast("bigint").alias("quotes"), F.col("l_linenumber").cast("bigint").alias("dropped"))
    return reports.faithfulness(rows, "l_suppkey").withColumn("faithfulness", F.round("faithfulness", 9))


@query("""
with c as (select l_suppkey, l_partkey, l_orderkey, l_linenumber, case l_returnflag when 'R' then 'yes' when 'A' then 'maybe' else 'no' end as call, row_number() over (partition by l_suppkey, l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as n from lineitem)
select l_suppkey as cv, count(*) filter (where call = 'yes') as yes, count(*) filter (where call = 'maybe') as maybe, count(*) filter (where call = 'no') as no from c where n = 1 group by 1""")
def marks(spark, folder):
    """A34, J23, ST9: latest decisions counted by call."""
    call = F.when(F.col("l_returnflag") == "R", "yes").when(F.col("l_returnflag") == "A", "maybe").otherwise("no")
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("cv"), F.col("l_partkey").alias("key"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"), call.alias("call"))
    return reports.marks(rows)


@query("select s_suppkey, round(greatest(5000 - greatest(s_acctbal, 0), 0), 4) as left_over, round(case when s_suppkey % 10 > 0 then least(100, 100 * abs(s_acctbal) / (s_suppkey % 10 * 1000.0::double)) else 0 end, 6) as percent, greatest(1, floor(abs(s_acctbal) / 60 + 0.5))::int as minutes from supplier")
def allowance_view(spark, folder):
    """A30, JS5, JS6, M19: what is left of an allowance, percent used, minutes."""
    bal = F.col("s_acctbal")
    return table(spark, folder, "supplier").select("s_suppkey", reports.allowance_left(F.lit(5000.0), F.greatest(bal, F.lit(0.0))).alias("left_over"), F.round(reports.share_used(F.abs(bal), F.col("s_suppkey") % 10 * 1000.0), 6).alias("percent"), reports.run_minutes(F.abs(bal)).alias("minutes"))


@query("""

select n_name, r_name, lower(n_name) as folded, s_count from nation join region on n_regionkey = r_regionkey join (select s_nationkey, count(*) as s_count from supplier group by 1) on s_nationkey = n_nationkey""")
def nations_sorted(spark, folder):
    """Names in case-free order with an inner join."""
    n, r, s = (table(spark, folder, x) for x in ("nation", "region", "supplier"))
    counts = s.groupBy("s_nationkey").agg(F.count("*").alias("s_count"))
    joined = n.join(r, n.n_regionkey == r.r_regionkey).join(counts, n.n_nationkey == counts.s_nationkey)
    return joined.select("n_name", "r_name", F.lower("n_name").alias("folded"), "s_count").orderBy(F.lower("n_name"), "n_name")


@query("""
with s as (select user_id % 12 as source, floor(value / 10)::bigint as listed, case when event_type = 'view' then event_id end as stored from events)
select coalesce(sum(listed), 0)::bigint as listed, coalesce(sum(stored), 0)::bigint as stored, 0::bigint as kept from s""")
def search_totals(spark, folder):
    """A11, JS3: counters of all searches summed; one that no search has counts 0."""
    rows = table(spark, folder, "events").select(F.floor(F.col("value") / 10).cast("bigint").alias("listed"), F.when(F.col("event_type") == "view", F.col("event_id")).alias("stored"), F.lit(None).cast("bigint").alias("kept"))
    return reports.totals(rows, ("listed", "stored", "kept"))


@query("""
with f as (select distinct 'B' || l_suppkey % 40 || '-' || l_returnflag as board from lineitem), k as (select distinct lower('b' || s_suppkey || '-r') as board from supplier)
select board from f where lower(board) not in (select board from k)""")
def new_boards(spark, folder):
    """Boards found in links that are not known under any spelling."""
    found = table(spark, folder, "lineitem").select(F.concat(F.lit("B"), F.col("l_suppkey") % 40, F.lit("-"), "l_returnflag").alias("board")).distinct()
    known = table(spark, folder, "supplier").select(F.concat(F.lit("b"), "s_suppkey", F.lit("-R")).alias("board"))
    return reports.new_boards(found, known)


@query("""
with m as (select l_orderkey as key, case when l_linenumber % 3 = 0 then 'yes' when l_linenumber % 3 = 1 then 'maybe' else 'no' end as call, l_shipdate as seen, l_linenumber from lineitem),
l as (select * from m qualify row_number() over (partition by key order by seen desc, l_linenumber desc) = 1)
select o_orderkey as key, case o_orderstatus when 'F' then 'strong' when 'O' then 'possible' else 'weak' end as verdict, o_custkey as rank, call, o_orderdate < timestamp '1995-01-01' as before
from orders left join l on o_orderkey = l.key""")
def results_page(spark, folder):
    """Judged rows with their rank and their latest mark; rows without a mark stay."""
    o = table(spark, folder, "orders")
    verdict = F.when(F.col("o_orderstatus") == "F", "strong").when(F.col("o_orderstatus") == "O", "possible").otherwise("weak")
    run = o.select(F.col("o_orderkey").alias("key"), verdict.alias("verdict"), (F.col("o_totalprice") % 100).cast("int").alias("fit"))
    order = o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("rank"), (F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("before"), F.col("o_totalprice").alias("score"))
    call = F.when(F.col("l_linenumber") % 3 == 0, "yes").when(F.col("l_linenumber") % 3 == 1, "maybe").otherwise("no")
    marks = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"), call.alias("call"), F.lit("").alias("reason"), F.struct("l_shipdate", "l_linenumber").alias("at"))
    return views.results(run, order, marks).select("key", "verdict", "rank", "call", "before")


_PLAIN = r"""lower(trim(regexp_replace(translate(regexp_replace(translate({0}, '’‘“”–—', '''''""--'), '(^|[^\pL\pN\pM_])#+', '\1', 'g'), '*_`>|•·', ''), '[\s\x0b\x1c-\x1f\x85\xa0\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')))"""


@query(r"""
with w as (select item_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') as w from benchmark),
e as (select item_id * 100000 + i as position, w[i] as word, w[i] || ' ' || w[i + 1] as two from (select item_id, w, unnest(range(1, len(w) + 1)) as i from w)),
v as materialized (select term, ' ' || replace(term, ' ', '   ') || ' ' as padded, min(position) as position from (select position, word as term from e where length(word) >= 8 union all select position, two from e where two is not null) group by 1),
h as (select doc_id, 0 as source, """ + _PLAIN.format("string_split(text, chr(10))[1]") + " as hay from documents union all select doc_id, 1, " + _PLAIN.format("text") + r""" from documents),
p as materialized (select doc_id, source, ' ' || regexp_replace(hay, '([^\pL\pN\pM_+#])', ' \1 ', 'g') || ' ' as hay from h),
n as (select doc_id, source, term, position from p join v on contains(hay, padded)),
g as (select doc_id, source, count(*) as terms, arg_min(term, (-length(term), position)) as term from n group by 1, 2)
select doc_id, arg_min(term, source) as term, arg_min(terms, source) as terms from g group by 1""")
def gap_terms(spark, folder):
    """The longest of the benchmark's long words and pairs of words that each document names as whole tokens, in its first line, else anywhere."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    each = table(spark, folder, "benchmark").select("item_id", words.alias("w")).select("item_id", "w", F.posexplode("w").alias("at", "word"))
    each = each.select((F.col("item_id") * 100_000 + F.col("at") + 1).alias("position"), "word", F.get("w", F.col("at") + 1).alias("next"))
    skills = each.filter("length(word) >= 8").select("position", F.col("word").alias("skill")).unionByName(each.filter("next is not null").select("position", F.concat_ws(" ", "word", "next").alias("skill")))
    asked = table(spark, folder, "documents").select(F.col("doc_id").alias("gap_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("requirement"), F.col("text").alias("quote"))
    named = gaps.named_terms(asked, gaps.vocabulary(skills))
    return named.select(F.col("gap_id").alias("doc_id"), "term", F.size("all").cast("bigint").alias("terms"))
