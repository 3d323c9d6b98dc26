"""The engine's queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.functions import text as X
from causeway.operators import aggregates as A
from causeway.operators import graph as G
from causeway.operators import joins as J
from causeway.operators import predicates as P
from causeway.operators import ranking as R
from causeway.operators import scoring as C
from causeway.rules import any_of, clamp, is_not, ladder, truthy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# filters and reasons


@query("""
select reason, count(*) as n from (
  select case when text is null or text = '' then 'missing_text' when n_chars < 200 then 'too_short'
    when lang not in ('en', 'de') then 'language_not_allowed' when source = 'src3' then 'denied_source' else 'keep' end as reason
  from documents) group by reason
""")
def first_failing_rule(spark, d):
    c = F.col
    rules = [(c("text").isNull() | (c("text") == ""), "missing_text"), (c("n_chars") < 200, "too_short"), (~c("lang").isin("en", "de"), "language_not_allowed"), (c("source") == "src3", "denied_source")]
    return P.reason_counts(t(spark, d, "documents"), rules)


@query("""
select page_id, host, case when host = '' then 'missing_host' when host = 'example.org' or ends_with(host, '.example.org') then 'denied_host'
  when not (host = 'example.com' or ends_with(host, '.example.com')) then 'host_not_allowed' else 'keep' end as reason
from (select page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1) as host from pages)
""")
def host_rules(spark, d):
    df = t(spark, d, "pages").select("page_id", P.host_of(F.col("url")).alias("host"))
    h = F.col("host")
    return P.with_reason(df, [(h == "", "missing_host"), (P.host_in(h, ["example.org"]), "denied_host"), (~P.host_in(h, ["example.com"]), "host_not_allowed")])


_REJECT = """
select reason, count(*) as n, round(cast(sum(cast(o_totalprice as decimal(18,2))) as double), 2) as total from (
  select o_totalprice, case when c_custkey is null then 'unknown_customer' when c_acctbal < 0 then 'negative_balance'
    when o_orderstatus not in ('F', 'O') then 'open_status' else 'keep' end as reason
  from orders left join customer on o_custkey = c_custkey) group by reason
"""


@query(_REJECT)
def reject_split(spark, d):
    customers = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    df = t(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderstatus").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    rules = [(F.col("c_custkey").isNull(), "unknown_customer"), (F.col("c_acctbal") < 0, "negative_balance"), (~F.col("o_orderstatus").isin("F", "O"), "open_status")]
    kept, gone = P.split(df, rules)
    both = kept.withColumn("reason", F.lit(P.KEEP)).unionByName(gone)
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@query("""
select d.doc_id, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id
where l.quality is distinct from 0 and l.toxic is distinct from 1 and d.n_chars >= 100
""")
def null_safe_flags(spark, d):
    df = t(spark, d, "documents").select("doc_id", "n_chars").join(t(spark, d, "labels"), "doc_id", "left")
    return df.where(is_not(F.col("quality"), 0) & is_not(F.col("toxic"), 1) & (F.col("n_chars") >= 100)).select("doc_id", "quality", "toxic")


@query("""
select count(*) filter (where not (n_chars >= 0)) as negative_length, count(*) filter (where not (lang in ('en', 'de', 'fr', 'es'))) as unknown_language,
  count(*) filter (where not (length(text) = n_chars)) as wrong_length from documents
""")
def violations(spark, d):
    checks = {"negative_length": F.col("n_chars") >= 0, "unknown_language": F.col("lang").isin("en", "de", "fr", "es"), "wrong_length": F.length("text") == F.col("n_chars")}
    return P.violations(t(spark, d, "documents"), checks)


# distributions


@query("select event_type as value, count(*) as n from events group by event_type")
def value_distribution(spark, d):
    return A.distribution(t(spark, d, "events"), F.col("event_type"))


@query("""
select value, count(*) as n from (select unnest(string_split(text, ' ')) as value from documents) where value <> '' group by value order by n desc, value limit 50
""")
def list_distribution(spark, d):
    words = F.filter(F.split("text", " "), lambda x: x != "")
    return A.list_distribution(t(spark, d, "documents"), words, 50)


@query("""
select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n_F, count(*) filter (where o_orderstatus = 'O') as n_O,
  count(*) filter (where o_orderstatus = 'P') as n_P from orders group by o_orderpriority
""")
def crosstab(spark, d):
    return A.crosstab(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""
select l_returnflag, l_linestatus, cast(grouping(l_returnflag, l_linestatus) as bigint) as level, count(*) as n,
  cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity
from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())
""")
def grouping_sets_summary(spark, d):
    df = t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    out = df.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
    return out.select("l_returnflag", "l_linestatus", F.col("level").cast("long").alias("level"), "n", "quantity")




def _bin_sql(edges):
    tops = " ".join(f"when v >= {e} then '>={e:.2f}'" for e in sorted(edges, reverse=True))
    return f"case when v is null then 'missing' {tops} else '<{min(edges):.2f}' end"


BIN_TABLES = {"fine": (0.70, 0.80, 0.85, 0.90, 0.95, 0.99), "coarse": (0.50, 0.80, 0.95), "strict": (0.85, 0.95, 1.0)}


@query(
    "select bins, bin, count(*) as n from ("
    + " union all ".join(f"select '{k}' as bins, {_bin_sql(e)} as bin from (select least(value / 100, 1.0) as v from events)" for k, e in BIN_TABLES.items())
    + ") group by bins, bin"
)
def confidence_bins(spark, d):
    v = F.least(F.col("value") / 100, F.lit(1.0))
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("bins"), A.bins(v, e).alias("bin")) for k, e in BIN_TABLES.items())))
    return t(spark, d, "events").select(both.alias("b")).select("b.*").groupBy("bins", "bin").agg(F.count("*").alias("n"))


@query("""
select lang, n, success, round(success / n, 4) as rate from (
  select lang, count(*) as n, coalesce(nullif(count(*) filter (where quality = 1 and toxic = 0), 0), count(*) filter (where quality = 1)) as success
  from documents join labels using (doc_id) group by lang)
""")
def success_rate(spark, d):
    df = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id")
    return A.success(df, ["lang"], (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("quality") == 1)


@query("""
select p_brand, l_returnflag, n, round(n / total, 4) as share from (
  select p_brand, l_returnflag, count(*) as n, sum(count(*)) over (partition by p_brand) as total
  from lineitem join part on l_partkey = p_partkey group by p_brand, l_returnflag) where total >= 50
""")
def share_of_group(spark, d):
    parts = t(spark, d, "part").select("p_partkey", "p_brand")
    df = t(spark, d, "lineitem").select("l_partkey", "l_returnflag").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return A.shares(df, "p_brand", "l_returnflag", 50)


@query("select o_orderpriority, round(least(count(*) / sum(count(*)) over (), 0.08), 4) as boost from orders group by o_orderpriority")
def capped_boosts(spark, d):
    return A.boosts(t(spark, d, "orders"), "o_orderpriority", 0.08)


@query("""
select p_brand, p_type, support, cast(row_number() over (order by support desc, p_brand, p_type) as int) as cluster_id
from (select p_brand, p_type, count(*) as support from part group by p_brand, p_type having count(*) >= 3)
""")
def cluster_min_support(spark, d):
    return A.clusters(t(spark, d, "part"), ["p_brand", "p_type"], 3)


@query("""
select o_custkey, n, mode, round(top / n, 4) as share from (
  select o_custkey, cast(sum(k) as bigint) as n, max(k) as top, arg_min(o_orderstatus, (-k, o_orderstatus)) as mode
  from (select o_custkey, o_orderstatus, count(*) as k from orders group by o_custkey, o_orderstatus) group by o_custkey) where top / n >= 0.6
""")
def mode_rule(spark, d):
    return A.modal(t(spark, d, "orders"), ["o_custkey"], "o_orderstatus", 0.6)


@query("""
with j as (select p_brand, p_type, p_partkey, l_discount, l_extendedprice from lineitem join part on l_partkey = p_partkey),
stats as (select p_brand, count(*) as support, round(avg(l_discount), 4) as avg_discount, min(l_discount) as min_discount, max(l_discount) as max_discount from j group by p_brand),
types as (select p_brand, arg_min(p_type, (-k, p_type)) as modal_type from (select p_brand, p_type, count(*) as k from j group by p_brand, p_type) group by p_brand),
best as (select p_brand, string_agg(cast(p_partkey as varchar), ',' order by rn) as examples from (
  select p_brand, p_partkey, row_number() over (partition by p_brand order by max(l_extendedprice) desc, p_partkey) as rn from j group by p_brand, p_partkey) where rn <= 8 group by p_brand)
select * from stats join types using (p_brand) join best using (p_brand)
""")
def pattern_profile(spark, d):
    parts = t(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    j = t(spark, d, "lineitem").select("l_partkey", "l_discount", "l_extendedprice").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    stats = j.groupBy("p_brand").agg(F.count("*").alias("support"), F.round(F.avg("l_discount"), 4).alias("avg_discount"), F.min("l_discount").alias("min_discount"), F.max("l_discount").alias("max_discount"))
    types = A.modal(j, ["p_brand"], "p_type").select("p_brand", F.col("mode").alias("modal_type"))
    top = R.topk(j.groupBy("p_brand", "p_partkey").agg(F.max("l_extendedprice").alias("x")), ["p_brand"], [F.desc("x"), "p_partkey"], 8)
    best = top.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p_partkey"))), lambda x: x["p_partkey"].cast("string")), ",").alias("examples"))
    return stats.join(types, "p_brand").join(best, "p_brand")


# votes, merges, best rows


@query("""
select l_partkey, supplier as l_suppkey, votes from (
  select l_partkey, l_suppkey as supplier, votes, row_number() over (partition by l_partkey order by votes desc, l_suppkey desc) as rn from (
    select l_partkey, l_suppkey, cast(sum(case l_returnflag when 'R' then 4 when 'A' then 2 else 1 end) as bigint) as votes from lineitem group by l_partkey, l_suppkey)) where rn = 1
""")
def weighted_vote(spark, d):
    weight = ladder([(F.col("l_returnflag") == "R", 4), (F.col("l_returnflag") == "A", 2)], 1)
    return A.vote(t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), ["l_partkey"], "l_suppkey", weight)


@query("""
with f as (select source, lang, n_chars, min(doc_id) as first from documents group by source, lang, n_chars),
k as (select source, lang, string_agg(cast(n_chars as varchar), ',' order by first) as lengths from (
  select *, row_number() over (partition by source, lang order by first) as rn from f) where rn <= 5 group by source, lang)
select source, lang, count(*) as n, md5(arg_min(text, (-length(text), text))) as longest, min(doc_id) as first_id, any_value(lengths) as lengths
from documents join k using (source, lang) group by source, lang
""")
def record_merge(spark, d):
    df = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.md5(A.longest("text")).alias("longest"), F.min("doc_id").alias("first_id"), A.ordered_distinct("n_chars", "doc_id", 5).alias("l"))
    return df.select("source", "lang", "n", "longest", "first_id", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("lengths"))


_QUALITY = "case event_type when 'purchase' then 100 when 'signup' then 20 when 'click' then 15 else 10 end"


@query(f"""
select user_id, event_id, quality from (select user_id, event_id, {_QUALITY} as quality,
  row_number() over (partition by user_id order by {_QUALITY} desc, value desc, event_id desc) as rn from events) where rn = 1
""")
def keep_best(spark, d):
    q = ladder([(F.col("event_type") == k, v) for k, v in (("purchase", 100), ("signup", 20), ("click", 15))], 10)
    return R.keep_best(t(spark, d, "events").withColumn("quality", q), ["user_id"], [F.desc("quality"), F.desc("value"), F.desc("event_id")]).select("user_id", "event_id", "quality")


@query("""
select l_orderkey, count(*) as n, round(least(max(l_discount) * 10 + case when count(*) > 1 then case when bool_or(l_returnflag = 'R') then 0.03 else 0 end
  + case when bool_or(l_linestatus = 'O') then 0.04 else 0 end else 0 end, 1.0), 4) as score, bool_or(l_returnflag = 'R') as returned
from lineitem group by l_orderkey
""")
def candidate_merge(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("s"), "l_returnflag", "l_linestatus")
    r, o = F.bool_or(F.col("l_returnflag") == "R"), F.bool_or(F.col("l_linestatus") == "O")
    return df.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(A.merged_score("s", [(r, 0.03), (o, 0.04)]), 4).alias("score"), r.alias("returned"))


@query("select user_id, count(*) as n, count(*) filter (where event_type = 'purchase') as positives, round(count(*) filter (where event_type = 'error') / count(*), 4) as error_rate from events group by user_id")
def history_rates(spark, d):
    e = F.col("event_type")
    return t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(e == "purchase").alias("positives"), A.rate(e == "error").alias("error_rate"))


# ranking


@query("""
select lang, doc_id, score, cast(rank as int) as rank from (select lang, doc_id, score, row_number() over (partition by lang order by score < 0.15, score desc, doc_id desc) as rank
  from (select lang, doc_id, floor(least(n_chars, 20000) / 2 + 0.5) / 10000 as score from documents)) where rank <= 5
""")
def topk_backfill(spark, d):
    # four places by whole numbers: binary halves round alike everywhere
    df = t(spark, d, "documents").select("lang", "doc_id", (F.floor(F.least(F.col("n_chars"), F.lit(20000)) / 2 + 0.5) / 10000).alias("score"))
    return R.backfill_topk(df, ["lang"], [F.desc("score"), F.desc("doc_id")], "score", 0.15, 5)


@query("""
with s as (select d.source, d.doc_id, d.n_chars, case when l.toxic = 1 and d.n_chars > 6000 then 'root' else 'other' end as label from documents d left join labels l using (doc_id)),
m as (select *, max(case when label = 'root' then 1 else 0 end) over (partition by source) as has, row_number() over (partition by source order by n_chars desc, doc_id) as rn from s)
select source, doc_id, case when has = 0 and rn = 1 then 'root' else label end as label from m
""")
def promote_best(spark, d):
    df = t(spark, d, "documents").select("source", "doc_id", "n_chars").join(t(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    df = df.withColumn("label", F.when((F.col("toxic") == 1) & (F.col("n_chars") > 6000), "root").otherwise("other"))
    return R.promote_best(df, ["source"], "label", "root", "n_chars", ["doc_id"], F.lit(True)).select("source", "doc_id", "label")


@query("""
select o_orderkey, o_custkey, o_totalprice, cast(row_number() over (order by o_totalprice desc, o_orderkey) as int) as rank from (
  select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 2 order by o_totalprice desc, o_orderkey limit 50
""")
def diversified_topk(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.diversify(df, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2, 50)


@query("""
select o_orderpriority, o_orderkey, cast(row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as int) as rank from (
  select *, row_number() over (partition by o_orderpriority order by o_orderkey) as rn from orders) where rn <= 20
""")
def cap_then_sort(spark, d):
    df = t(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return R.cap_then_sort(df, ["o_orderpriority"], ["o_orderkey"], 20, [F.desc("o_totalprice"), "o_orderkey"]).drop("o_totalprice")


@query("""
select p_brand, p_partkey, p_type, cast(rank as int) as rank from (
  select *, row_number() over (partition by p_brand order by tier, p_partkey) as rank from (
    select p_brand, p_partkey, p_type, case when row_number() over (partition by p_brand, p_type order by p_partkey) = 1 then 0 else 1 end as tier from part)) where rank <= 10
""")
def balanced_subset(spark, d):
    return R.balanced(t(spark, d, "part").select("p_brand", "p_partkey", "p_type"), ["p_brand"], ["p_type"], ["p_partkey"], 10)


@query("select doc_id, cast((row_number() over (order by doc_id) - 1) % 4 as int) as shard from documents")
def round_robin_shard(spark, d):
    return R.shard(t(spark, d, "documents").select("doc_id"), ["doc_id"], 4)


@query("""
select l_orderkey, l_linenumber, l_quantity from (select *, coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice
  rows between unbounded preceding and 1 preceding), 0) as before from lineitem) where before < 60
""")
def until_budget(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return R.until_budget(df, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_quantity"), 60).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
with r as (select o_custkey, o_orderkey, o_orderstatus = 'P' as p, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders),
m as (select *, max(case when n <= 3 and p then 1 else 0 end) over (partition by o_custkey) as has, min(case when p then n end) over (partition by o_custkey) as best from r)
select o_custkey, o_orderkey, cast(least(n, 3) as int) as rank from m where case when has = 0 and best is not null then n < 3 or n = best else n <= 3 end
""")
def force_include(spark, d):
    df = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return R.force_include(df, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3, F.col("o_orderstatus") == "P").select("o_custkey", "o_orderkey", F.col("rank").cast("int").alias("rank"))


# joins


@query("""
with u as (select p_size, count(*) as n_targets, min(p_partkey) as p_partkey from part where p_type = 'ECONOMY' group by p_size)
select s_suppkey, case when n_targets = 1 then p_partkey end as p_partkey, coalesce(n_targets, 0) as n_targets from (select s_suppkey, cast(s_suppkey % 60 as int) as p_size from supplier) left join u using (p_size)
""")
def unique_name_resolution(spark, d):
    calls = t(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 60).cast("int").alias("p_size"))
    defined = t(spark, d, "part").where("p_type = 'ECONOMY'").select("p_size", "p_partkey")
    return J.unique_match(calls, defined, "p_size", "p_partkey").select("s_suppkey", "p_partkey", "n_targets")


_ORDERS_AS_RANGES = "select o_custkey % 150 as user_id, o_orderkey, cast(o_orderkey * 7 % 30 as int) as lo, cast(o_orderkey * 7 % 30 + o_orderkey % 5 as int) as hi from orders"
_EVENT_DAYS = "select user_id, event_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as int) as day from events"


@query(f"""
with r as ({_ORDERS_AS_RANGES}), e as ({_EVENT_DAYS})
select e.event_id, b.o_orderkey from e left join (select event_id, o_orderkey, row_number() over (partition by event_id order by hi - lo, lo, o_orderkey) as rn
  from e join r on e.user_id = r.user_id and day between lo and hi) b on e.event_id = b.event_id and rn = 1
""")
def enclosing_range(spark, d):
    key = F.col("o_orderkey")
    ranges = t(spark, d, "orders").select((F.col("o_custkey") % 150).alias("user_id"), "o_orderkey", (key * 7 % 30).cast("int").alias("lo"), (key * 7 % 30 + key % 5).cast("int").alias("hi"))
    points = t(spark, d, "events").select("user_id", "event_id", F.datediff("ts", F.lit("2024-01-01")).alias("day"))
    return J.range_join(points, ranges, ["user_id"], "day", "lo", "hi", [F.col("hi") - F.col("lo"), "lo", "o_orderkey"], ["event_id"], bucket=8).select("event_id", "o_orderkey")


@query("""
with e as (select event_id, user_id, event_type, cast(epoch_us(ts) as bigint) // 1000000 as s from events)
select event_id, other, gap from (select a.event_id, b.event_id as other, abs(a.s - b.s) as gap, row_number() over (partition by a.event_id order by abs(a.s - b.s), b.event_id) as rn
  from e a join e b on a.user_id = b.user_id and a.event_type = 'purchase' and b.event_type = 'click' and abs(a.s - b.s) <= 86400) where rn = 1
""")
def nearest_match(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "s")
    b = e.where("event_type = 'click'").select(F.col("event_id").alias("other"), "user_id", F.col("s").alias("o"))
    return J.band_join(a, b, ["user_id"], "s", "o", 86400, ["event_id"], ["other"]).select("event_id", "other", "gap")


_LIBRARY = "select row_number() over (order by p_brand, p_type) as pattern_id, p_brand as category, p_type as operation, count(*) as support, round(avg(p_size) / 50, 4) as confidence from part group by p_brand, p_type having count(*) >= 3"
_PRIOR = "round(least(case when p_brand = category then 0.45 else 0 end + case when p_type = operation then 0.25 else 0 end + 0.18 * ln(1 + support) / ln(1 + greatest(m, 1)) + 0.10 * greatest(least(confidence, 1), 0), 1.0), 4)"


def _library(spark, d):
    parts = t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("support"), F.round(F.avg("p_size") / 50, 4).alias("confidence")).where("support >= 3")
    lib = parts.select(F.row_number().over(W.orderBy(F.asc_nulls_last("p_brand"), F.asc_nulls_last("p_type"))).alias("pattern_id"), F.col("p_brand").alias("category"), F.col("p_type").alias("operation"), "support", "confidence")
    return lib.crossJoin(F.broadcast(lib.agg(F.max("support").alias("m"))))


@query(f"""
with lib as ({_LIBRARY}), l2 as (select *, max(support) over () as m from lib)
select p_partkey, pattern_id, score from (select p_partkey, pattern_id, score, row_number() over (partition by p_partkey order by score desc, pattern_id) as rn from (
  select p_partkey, pattern_id, {_PRIOR} as score from part join l2 on p_brand = category or p_type = operation)) where rn = 1
""")
def theta_best_match(spark, d):
    score = lambda agree: C.prior_score(*agree, F.col("support"), F.col("m"), F.col("confidence"), F.lit(0.0))
    parts = t(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    best = J.best_agreement(parts, _library(spark, d), [("p_brand", "category"), ("p_type", "operation")], score, ["p_partkey"], ["pattern_id"])
    return best.select("p_partkey", F.col("pattern_id").cast("long").alias("pattern_id"), "score")


@query(f"""
with lib as ({_LIBRARY}) select pattern_id, round(ln(1 + support) / ln(1 + max(support) over ()), 4) as support_score, round(0.45 + 0.25 + 0.18 * ln(1 + support) / ln(1 + max(support) over ()) + 0.10 * confidence, 4) as score from lib
""")
def prior_score(spark, d):
    lib = _library(spark, d)
    yes = F.lit(True)
    return lib.select(F.col("pattern_id").cast("long").alias("pattern_id"), F.round(F.log1p("support") / F.log1p("m"), 4).alias("support_score"), C.prior_score(yes, yes, F.col("support"), F.col("m"), F.col("confidence"), F.lit(0.0)).alias("score"))


@query("select c_custkey, c_mktsegment from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def semi_join(spark, d):
    done = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey", "c_mktsegment").join(done, "c_custkey", "left_semi")


@query("select doc_id, lang from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)")
def anti_join(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
with b as (select c_custkey as k, c_mktsegment as segment, c_acctbal as balance from customer where c_custkey % 4 <> 0),
c as (select c_custkey as k, 'CHANGED' as segment, case when c_custkey % 2 = 0 then c_acctbal + 1 end as balance from customer where c_custkey % 3 = 0)
select coalesce(b.k, c.k) as k, coalesce(c.segment, b.segment) as segment, coalesce(c.balance, b.balance) as balance from b full join c on b.k = c.k
""")
def upsert_merge(spark, d):
    c = t(spark, d, "customer")
    base = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    changes = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("CHANGED").alias("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("balance"))
    return J.upsert(base, changes, ["k"])


@query("""
with a as (select c_custkey, nullif(c_nationkey, 3) as n, c_mktsegment as s from customer), b as (select nullif(s_nationkey, 3) as n, count(*) as suppliers from supplier group by nullif(s_nationkey, 3))
select c_custkey, suppliers from a left join b on a.n is not distinct from b.n
""")
def null_safe_match(spark, d):
    a = t(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("n"))
    b = t(spark, d, "supplier").groupBy(F.nullif(F.col("s_nationkey"), F.lit(3)).alias("n")).agg(F.count("*").alias("suppliers"))
    return J.null_safe_join(a, b, ["n"]).select("c_custkey", "suppliers")


@query("""
select conv_id, turn, string_agg(role, ',' order by o) as around from (select a.conv_id, a.turn, b.role, b.turn as o from conversations a join conversations b
  on a.conv_id = b.conv_id and b.turn between a.turn - 1 and a.turn + 1) group by conv_id, turn
""")
def line_window(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "role")
    lines = c.select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("line_no"), F.col("role").alias("text"))
    around = J.window_text(c.withColumn("line", F.col("turn") + 1), lines, "conv_id", "line", 1, 1, ["conv_id", "turn"])
    return around.select("conv_id", "turn", F.translate("window", "\n", ",").alias("around"))


# scores


@query("""
select doc_id, round(score, 4) as score, case when toxic or score < 0.18 then 'symptom' when score >= 0.6 and good then 'root_cause_candidate' else 'propagation' end as label from (
  select d.doc_id, coalesce(l.toxic = 1, false) as toxic, coalesce(l.quality = 1, false) as good,
    least(greatest(0.18 * least(d.n_chars / 4000, 1.0) + case when l.quality = 1 then 0.34 else 0 end + case when d.lang = 'en' then 0.28 else 0 end - case when l.toxic = 1 then 0.32 else 0 end, 0.0), 1.0) as score
  from documents d left join labels l using (doc_id))
""")
def weighted_score_label(spark, d):
    df = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(t(spark, d, "labels"), "doc_id", "left")
    bad, good = truthy(F.col("toxic") == 1), truthy(F.col("quality") == 1)
    on = lambda c, v: F.when(c, v).otherwise(0.0)
    total = 0.18 * F.least(F.col("n_chars") / 4000, F.lit(1.0)) + on(good, 0.34) + on(F.col("lang") == "en", 0.28) - on(bad, 0.32)
    df = df.withColumn("raw", clamp(total))
    label = ladder([(bad | (F.col("raw") < 0.18), C.SYMPTOM), ((F.col("raw") >= 0.6) & good, C.ROOT)], C.PROPAGATION)
    return df.select("doc_id", F.round("raw", 4).alias("score"), label.alias("label"))


@query("""
with p as (select page_id, a, b, string_split(a, '/') as x, string_split(b, '/') as y from (select page_id, regexp_extract(url, '://([^?#]*)', 1) as a, first_value(regexp_extract(url, '://([^?#]*)', 1)) over (order by page_id) as b from pages)),
s as (select *, case when x[1] is distinct from y[1] then 0 when x[2] is distinct from y[2] then 1 when x[3] is distinct from y[3] then 2 when x[4] is distinct from y[4] then 3 else 4 end as n0 from p),
s2 as (select *, least(n0, len(x), len(y)) as n from s)
select page_id, cast(case when a = b then 1.0 when n >= greatest(least(len(x), len(y)) - 1, 1) then 0.9 when n >= 2 then 0.65 when n >= 1 then 0.4 else 0.1 end as double) as score from s2
""")
def path_prefix_proximity(spark, d):
    pages = t(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("a"))
    first = pages.agg(F.min_by("a", "page_id").alias("b"))
    return pages.crossJoin(F.broadcast(first)).select("page_id", C.proximity(F.col("a"), F.col("b")).alias("score"))


def _token_overlap(items, documents):
    tok = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda x: F.length(x) > 2))
    q = items.select("item_id", tok("text").alias("w"))
    docs = documents.select("doc_id", F.explode(tok("text")).alias("word"))
    met = q.select("item_id", F.size("w").alias("n"), F.explode("w").alias("word")).join(docs, "word").groupBy("item_id", "doc_id", "n").agg(F.count("*").alias("k"))
    first = met.groupBy("item_id", "n", "k").agg(F.min("doc_id").alias("doc_id"))  # an item has n counts at most, so its documents needn't be sorted
    return R.keep_best(first, ["item_id"], [F.desc(F.col("k") / F.col("n")), F.asc_nulls_last("doc_id")]).select("item_id", "doc_id", F.round(F.col("k") / F.col("n"), 4).alias("score"))


@query("""
with q as (select item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 2)) as w from benchmark),
dw as (select distinct doc_id, w from (select doc_id, unnest(string_split(lower(text), ' ')) as w from documents) where length(w) > 2)
select item_id, doc_id, round(k / len(w), 4) as score from (select item_id, doc_id, k, w, row_number() over (partition by item_id order by k / len(w) desc, doc_id) as rn from (
  select q.item_id, dw.doc_id, any_value(q.w) as w, count(*) as k from (select item_id, w, unnest(w) as word from q) q join dw on dw.w = q.word group by q.item_id, dw.doc_id)) where rn = 1
""")
def token_overlap(spark, d):
    return _token_overlap(t(spark, d, "benchmark"), t(spark, d, "documents"))


def _advisory_sql(texts):
    rules = []
    for _, phrases, (a, b, c, p) in C.ADVISORY_RULES:
        met = "(" + " or ".join(f"contains(text, '{x}')" for x in phrases) + ")"
        if a == "integer_overflow":
            rules.append((f"{met} and (contains(text, 'buffer') or contains(text, 'out-of-bounds') or contains(text, 'out of bounds') or contains(text, 'memory'))", (a, b, "integer_overflow_to_memory_error", p)))
            rules.append((met, (a, b, "integer_overflow", p)))
        elif a == "buffer_overflow":
            size = " or ".join(f"contains(text, '{x}')" for x in C.SIZE_TEXT)
            rules.append((f"{met} and ({size})", (a, "incorrect_bounds_or_size_calculation", "incorrect_length_or_bounds_calculation", 0.7)))
            rules.append((met, (a, "missing_bounds_check", "missing_bounds_check_before_write", 0.64)))
        else:
            rules.append((met, (a, b, c, p)))
    rules.append(("true", ("other", "unknown_from_description", "unknown_semantic_pattern", 0.35)))
    case = lambda i: "case " + " ".join(f"when {m} then " + (f"'{r[i]}'" if i < 3 else f"{r[i]}") for m, r in rules) + " end"
    return f"select doc_id, {case(0)} as bug_class, {case(1)} as root_cause_type, {case(2)} as pattern, cast({case(3)} as double) as confidence from ({texts})"


#: Advisory texts made from the documents: a phrase by id, and the document's own words.
_PHRASES = ("use after free", "double free of the buffer", "null pointer", "integer overflow in memory", "integer wrap", "heap overflow of length", "stack overflow", "out of bounds read", "does not validate", "divide by zero", "nothing said")
_ADVISORY_TEXT = "select doc_id, concat(" + "case cast(doc_id % 11 as int) " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(_PHRASES)) + " end, ' ', lower(text)) as text from documents"


@query(_advisory_sql(_ADVISORY_TEXT))
def severity_text_rules(spark, d):
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("doc_id") % 11 + 1).cast("int"))
    df = t(spark, d, "documents").select("doc_id", F.concat(phrase, F.lit(" "), F.lower(F.coalesce("text", F.lit("")))).alias("text"))
    return df.select("doc_id", C.advisory_class(F.col("text"), F.array().cast("array<string>")).alias("c")).select("doc_id", "c.*")


@query(r"""
select source, template, n, cast(rank as int) as rank from (
  select source, template, count(*) as n, row_number() over (partition by source order by count(*) desc, template) as rank
  from (select source, regexp_replace(regexp_replace(text, '"[^"\n]*"', '<str>', 'g'), '\b[0-9]+\b', '<int>', 'g') as template from documents) group by source, template) where rank <= 3
""")
def top_templates_per_cluster(spark, d):
    df = t(spark, d, "documents").select("source", _literals(F.col("text")).alias("template"))
    return A.top_values(df, "source", "template", 3)


# graphs


_TURNS = "select conv_id as g, turn as src, turn + 1 as dst from conversations union select conv_id, turn, turn + 2 from conversations where turn % 3 = 0"


def _turn_edges(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn")
    one = c.select(F.col("conv_id").alias("g"), F.col("turn").alias("src"), (F.col("turn") + 1).alias("dst"))
    two = c.where("turn % 3 = 0").select(F.col("conv_id").alias("g"), F.col("turn").alias("src"), (F.col("turn") + 2).alias("dst"))
    nodes = c.select(F.col("conv_id").alias("g"), F.col("turn").alias("dst"))
    return one.unionByName(two).distinct().join(nodes, ["g", "dst"], "left_semi").select("g", "src", "dst")


def _last_turns(spark, d):
    return t(spark, d, "conversations").groupBy(F.col("conv_id").alias("g")).agg(F.max("turn").alias("node"))


_GRAPH = f"e as (select t.* from ({_TURNS}) t join conversations c on t.g = c.conv_id and t.dst = c.turn), s as (select conv_id as g, max(turn) as node from conversations group by conv_id)"


@query(f"""
with recursive {_GRAPH}, r as (select g, node, 0 as d from s union all select e.g, e.src, r.d + 1 from e join r on e.g = r.g and e.dst = r.node where r.d < 40)
select g, node, min(d) as distance from r group by g, node
""")
def reverse_bfs(spark, d):
    return G.distances(_turn_edges(spark, d), _last_turns(spark, d))


@query(f"""
with recursive {_GRAPH}, back as (select g, node, 0 as d from s union all select e.g, e.src, back.d + 1 from e join back on e.g = back.g and e.dst = back.node where back.d < 8),
dist as (select g, node, min(d) as d from back group by g, node),
w as (select g, 0 as at, [0] as path, cast([] as int[]) as ds from (select distinct conv_id as g from conversations where turn = 0)
  union all select e.g, e.dst, list_append(w.path, e.dst), list_append(w.ds, dist.d) from w join e on e.g = w.g and e.src = w.at join dist on dist.g = e.g and dist.node = e.dst
  where not list_contains(w.path, e.dst) and len(w.path) + dist.d <= 8),
f as (select w.g, array_to_string(path, '>') as path, row_number() over (partition by w.g order by list_transform(list_zip(ds, list_slice(path, 2, len(path))), lambda x: (x[1], cast(x[2] as varchar)))) as rank from w join s on w.g = s.g and w.at = s.node where len(path) > 1)
select g, path, cast(rank as int) as rank from f where rank <= 3
""")
def bounded_paths(spark, d):
    starts = t(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("g"), F.col("turn").alias("node")).distinct()
    got = G.bounded_paths(_turn_edges(spark, d), starts, _last_turns(spark, d), 8, 3)
    return got.select("g", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "rank")


@query("""
with recursive w as (select conv_id as g, turn as stmt, list_distinct(string_split(lower(text), ' ')) as names from conversations),
x as (select g, stmt, unnest(names) as name from w), e as (select distinct a.g, a.stmt as src, b.stmt as dst from x a join x b on a.g = b.g and a.name = b.name and a.stmt < b.stmt and length(a.name) > 3),
s as (select conv_id as g, max(turn) as stmt from conversations group by conv_id),
r as (select g, stmt from s union select e.g, e.src from e join r on e.g = r.g and e.dst = r.stmt) select g, stmt from r
""")
def slice_reach(spark, d):
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("g"), F.col("turn").alias("stmt"), F.col("turn").alias("line"), F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("name"))
    names = c.where("length(name) > 3")
    return G.reach(names, names, _last_turns(spark, d).select("g", F.col("node").alias("stmt")))


# texts


@query("""
select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path,
  regexp_extract(url, '[?]([^#]*)', 1) as query, regexp_extract(url, '#(.*)$', 1) as fragment from pages
""")
def url_parse(spark, d):
    x = lambda p: F.regexp_extract("url", p, 1)
    return t(spark, d, "pages").select("page_id", x("^([a-z]+)://").alias("scheme"), x("^[a-z]+://([^/?#:]+)").alias("host"), x("^[a-z]+://[^/?#]*([^?#]*)").alias("path"), x("[?]([^#]*)").alias("query"), x("#(.*)$").alias("fragment"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_field(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""
select doc_id, regexp_replace(regexp_replace(text, '"[^"\\n]*"', '<str>', 'g'), '\\b[0-9]+\\b', '<int>', 'g') as template from documents where regexp_matches(text, '[0-9]')
""")
def literal_template(spark, d):
    return t(spark, d, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", _literals(F.col("text")).alias("template"))


def _literals(c):
    return F.regexp_replace(F.regexp_replace(c, '"[^"\n]*"', "<str>"), "(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])", "<int>")


@query()
def template_normalise_documents(spark, d):
    """Numbered templates of whole documents; numbering has no SQL."""
    return t(spark, d, "documents").select("doc_id", X.template(F.col("text")).alias("template"))


@query("select 'en' as side, count(*) as n from (select source from documents where lang = 'en' intersect select source from documents where lang = 'de') union all select 'only', count(*) from (select source from documents where lang = 'en' except select source from documents where lang = 'es')")
def set_operations(spark, d):
    s = lambda lang: t(spark, d, "documents").where(F.col("lang") == lang).select("source")
    both, only = s("en").intersect(s("de")), s("en").subtract(s("es"))
    return both.agg(F.lit("en").alias("side"), F.count("*").alias("n")).unionByName(only.agg(F.lit("only").alias("side"), F.count("*").alias("n")))


@query("select sha256(string_agg(cast(r_regionkey as varchar) || ':' || r_name, ',' order by r_regionkey)) as digest from region")
def stable_digest(spark, d):
    rows = t(spark, d, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r"))  # five rows by definition
    return rows.select(F.sha2(F.array_join(F.transform("r", lambda x: F.concat(x["r_regionkey"].cast("string"), F.lit(":"), x["r_name"])), ","), 256).alias("digest"))


@query("""
select doc_id, case when contains(lower(text), 'idiot') or contains(lower(text), 'moron') then true else false end as hit, length(text) > 1000 as long from documents
""")
def phrase_flags(spark, d):
    return t(spark, d, "documents").select("doc_id", any_of(F.lower("text"), ("idiot", "moron")).alias("hit"), (F.length("text") > 1000).alias("long"))
