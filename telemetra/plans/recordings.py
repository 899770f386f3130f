"""Queries on the store of demonstrations, on quality rules and on reports.

Orders stand for demonstrations with a status, customers for teachers, nations for tasks, parts for placements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import quality, records, summaries, windows
from .registry import EVENTS, events, register, table

#: Orders as demonstrations: O is a success, F a failure, P pending; every seventh has no teacher of the store.
DEMOS = "(select o_orderkey id, o_custkey teacher_id, case o_orderstatus when 'O' then 'success' when 'F' then 'failure' else 'pending' end status, o_orderkey % 3 = 0 converted, o_orderkey % 500 path, o_orderdate created_at, o_totalprice price from orders)"


def demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "failure").otherwise("pending")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("teacher_id"), status.alias("status"), (F.col("o_orderkey") % 3 == 0).alias("converted"), (F.col("o_orderkey") % 500).alias("path"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"))


@register(f"select coalesce(c_mktsegment, '?') as segment, count(*) as total, count_if(status = 'success') as success, count_if(status = 'failure') as failure, count_if(converted) as converted from {DEMOS} d left join (select * from customer where c_custkey % 7 <> 0) on c_custkey = teacher_id group by all")
def status_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demonstrations by a property of their teacher, ? for teachers that are gone."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("teacher_id"), "c_mktsegment")
    return demos(spark, sf_dir).join(c, "teacher_id", "left").groupBy(F.coalesce("c_mktsegment", F.lit("?")).alias("segment")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failure").alias("failure"), F.count_if("converted").alias("converted"))


@register(f"select case when grouping(path) = 0 then 'path' else 'teacher_id' end as dimension, coalesce(path, teacher_id)::varchar as value, count(*) as total, count_if(status = 'success') as success, count_if(status = 'pending') as pending from {DEMOS} group by grouping sets ((path), (teacher_id))")
def status_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by task and by teacher in one pass."""
    return summaries.counted_sets(demos(spark, sf_dir), ["path", "teacher_id"], "status", ["success", "pending"])


@register(f"select id, status, created_at from {DEMOS} order by created_at desc, id desc limit 20 offset 40")
def demo_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.page(demos(spark, sf_dir).select("id", "status", "created_at"), [F.desc("created_at"), F.desc("id")], 2)


@register(f"select n.k as path from range(600) n(k) left join (select path, arg_min(status, id) status, arg_min(converted, id) converted from {DEMOS} group by path) d on d.path = n.k where coalesce(status, 'unknown') in ('success', 'unknown') and not coalesce(converted, false)")
def convertible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that are worth converting: successes and those that the store doesn't know."""
    return records.convertible(spark.range(600).withColumnRenamed("id", "path"), demos(spark, sf_dir), "path")


@register(f"select n.k as path from range(600) n(k) left join (select path, arg_min(status, id) status from {DEMOS} group by path) d on d.path = n.k where coalesce(status, 'unknown') in ('success', 'unknown')")
def convertible_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same whether they are converted or not."""
    return records.convertible(spark.range(600).withColumnRenamed("id", "path"), demos(spark, sf_dir), "path", again=True)


@register("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return records.to_do(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@register("select o_orderkey, o_orderdate from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate = o_orderdate + interval 2 day and l_linenumber % 2 = 1)")
def changed_since_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no check of this version with their stamp has seen."""
    checked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_shipdate") - F.expr("interval 2 days")).alias("o_orderdate"), (F.col("l_linenumber") % 2).alias("version"))
    return records.changed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), checked, "o_orderkey", "o_orderdate", 1)


@register("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0) and o_orderstatus = 'F'")
def results_still_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete ones whose episode still exists."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return records.present(o, table(spark, sf_dir, "customer").where("c_acctbal > 0"), ["c_custkey"]).select("o_orderkey")


@register(f"select k.path, f.status as first, l.status as last, case when l.path is null then 'no DB row' else l.status end as label, case when l.path is not null then coalesce(c_name, '?') end as teacher from range(600) k(path) left join (select path, arg_min(status, id) status from {DEMOS} group by path) f on f.path = k.path left join (select path, arg_max(status, id) status, arg_max(teacher_id, id) teacher_id from {DEMOS} group by path) l on l.path = k.path left join (select * from customer where c_custkey % 7 <> 0) on c_custkey = l.teacher_id")
def first_and_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last row of a path, and the label and teacher of the last."""
    d = demos(spark, sf_dir)
    paths = spark.range(600).withColumnRenamed("id", "path")
    teachers = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("teacher_id"), F.col("c_name").alias("name"))
    first = summaries.first_wins(d, ["path"], ["id"]).select("path", F.col("status").alias("first"))
    last = summaries.later_wins(d, ["path"], ["id"]).select("path", F.col("status").alias("last"))
    return records.labelled(paths, d, teachers, "path").join(first, "path", "left").join(last, "path", "left")


@register("select split_part(p, '/', 3) || '/' || split_part(p, '/', 4) as place, count(*) as n, string_agg(distinct s, ',' order by s) as statuses from (select 'data/raw/' || o_custkey % 40 || '/' || o_orderkey % 90 p, o_orderstatus s from orders) group by all")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows there are for the last two parts of a path, with their statuses."""
    path = F.concat(F.lit("data/raw/"), (F.col("o_custkey") % 40).cast("string"), F.lit("/"), (F.col("o_orderkey") % 90).cast("string"))
    o = table(spark, sf_dir, "orders").select(path.alias("path"), F.col("o_orderstatus").alias("status"))
    return records.duplicates(o, records.last_parts(F.col("path")), "place")


@register("with n as (select user_id, event_type, count(*) n from events group by all), l as (select user_id, min(n) least, max(n) most from n group by all), r as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 i from events) select r.event_id from r join l using (user_id) where least >= 0.5 * most and i < least")
def trimmed_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of episodes with like lengths, cut to the shortest."""
    e = events(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("t", "event_id")) - 1)
    return quality.cut(e, quality.unusable_length(e, "user_id", "event_type", 0.5), "user_id", "i").select("event_id")


@register("with f as (select l_returnflag task, l_orderkey ep, count(*) n from lineitem group by all) select task, count(*) as n_seqs, sum(n)::bigint as n_frames, md5(string_agg(ep || ':' || n, ',' order by ep::varchar)) as files from f group by all")
def split_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes and frames of each task, with the frames of each episode."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("task"), F.col("l_orderkey").alias("ep"))
    out = records.split_index(rows, "task", "ep")
    told = F.transform(F.array_sort(F.map_entries("files")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return out.select("task", "n_seqs", "n_frames", F.md5(F.array_join(told, ",")).alias("files"))


@register(f"select id, teacher_id, lpad((row_number() over (partition by teacher_id order by id) - 1)::varchar, 4, '0') as episode from {DEMOS} where status = 'success'")
def episode_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes numbered on for each task."""
    return records.episode_numbers(demos(spark, sf_dir).where("status = 'success'"), "teacher_id", "id").select("id", "teacher_id", "episode")


@register(f"select teacher_id, lpad((max(id % 9000) + case when arg_max(status, id % 9000 * 100000 + id) = 'pending' then 0 else 1 end)::varchar, 4, '0') as next from (select distinct on (teacher_id, id % 9000) * from {DEMOS} where id < 9000) group by all")
def next_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of each task's next recording; pending ones are incomplete and recorded anew."""
    d = demos(spark, sf_dir).where("id < 9000").withColumn("done", F.col("status") != "pending")
    return records.next_episode(d, "teacher_id", "id", "done")


@register("with c as (select floor((7000 - s_acctbal) / 8000 * 5)::int c from supplier), d as (select case when c between 0 and 4 then c end c, 1 k from c), e as (select x::int c from range(5) r(x) union all select null) select e.c as cell, count(d.k) as n from e left join d on e.c is not distinct from d.c group by all")
def coverage_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.coverage_bins(table(spark, sf_dir, "supplier"), "s_acctbal", -1000, 7000, 5)


@register(f"select a.id, round(median(b.price), 4) as others, not a.price between 0.5 * median(b.price) and 1.8 * median(b.price) as outlier from {DEMOS} a join {DEMOS} b on a.teacher_id = b.teacher_id and a.id <> b.id group by a.id, a.price having count(*) >= 5 union all select a.id, null, null from {DEMOS} a where (select count(*) from {DEMOS} b where b.teacher_id = a.teacher_id) <= 5")
def duration_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demonstrations far from the median of their teacher's others."""
    return summaries.outliers(demos(spark, sf_dir), ["teacher_id"], ["id"], "price").select("id", F.round("others", 4).alias("others"), "outlier")


#: Fixed values of this query: boxes, thresholds and texts.
_INNER, _OUTER, _RADIUS = (900.0, 1500.0, 5.0, 45.0), (850.0, 1600.0, 1.0, 50.0), 20.0

_RULES = """[case when p_size is null or p_retailprice is null then 'not found' end,
case when not (p_retailprice >= 900 and p_retailprice <= 1500 and p_size >= 5 and p_size <= 45) then 'centre (' || printf('%.3f', p_retailprice) || ', ' || printf('%+.3f', p_size::double) || ') outside the inner box' end,
case when not (p_retailprice - 20 >= 850 and p_retailprice + 20 <= 1600 and p_size - 20 >= 1 and p_size + 20 <= 50) then '(' || printf('%.3f', p_retailprice) || ', ' || printf('%+.3f', p_size::double) || ') may cross the outer box' end,
case when p_partkey % 5 <> 0 and abs(p_partkey % 40 - 20) > 12 then 'tip 0 row ' || p_partkey % 40 || ' vs 20' end,
case when p_partkey % 3 <> 0 and abs(p_partkey % 30 - 10) > 12 then 'tip 1 row ' || p_partkey % 30 || ' vs 10' end,
case when p_partkey % 15 = 0 then 'no tip found' end,
case when p_partkey % 4 <> 2 then p_partkey % 4 || ' closes (expected 2: ' || case when p_partkey % 4 < 2 then 'not grasped?' else 'regrasp?' end || ')' end,
case when not p_retailprice / 101 between 9.5 and 18 then 'duration ' || printf('%.1f', p_retailprice / 101) || ' outside [9.5, 18.0]' end,
case when sqrt((p_partkey % 8) ** 2 + (p_size % 6) ** 2) > 7.5 then 'moved ' || printf('%.0f', sqrt((p_partkey % 8) ** 2 + (p_size % 6) ** 2) * 1000) || ' mm' end]"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    k, x, y = F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size")
    tips = [F.when(k % 5 != 0, k % 40), F.when(k % 3 != 0, k % 30)]
    rules = [
        *quality.placement_reasons(x, y, _INNER, _OUTER, _RADIUS),
        *quality.tip_reasons(tips, [20, 10], 12),
        quality.closes_reason(k % 4, 2, "not grasped?", "regrasp?"),
        quality.range_reason("duration", x / 101, 9.5, 18.0),
        quality.moved_reason(F.lit(0.0), F.lit(0.0), (k % 8).cast("double"), y % 6, 7.5),
    ]
    return p.withColumn("reasons", quality.reasons(rules))


@register(f"select p_partkey, array_to_string(list_filter({_RULES}, lambda r: r is not null), '; ') as reasons from part")
def qc_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that an episode breaks, in words."""
    return _checked(spark, sf_dir).select("p_partkey", F.array_join("reasons", "; ").alias("reasons"))


_KINDS = [("outside the inner", "placement"), ("may cross", "placement"), ("tip", "wrist camera"), ("closes", "gripper"), ("duration", "duration")]
_KIND = "case " + " ".join(f"when contains(r, '{a}') then '{b}'" for a, b in _KINDS) + " else r end"


@register(f"with r as (select p_partkey, p_partkey % 2 = 0 good, unnest(list_filter({_RULES}, lambda r: r is not null)) r from part), k as (select distinct p_partkey, good, {_KIND} kind from r) select kind, count(*) as episodes, count_if(good) as successes from k group by all")
def flag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes and successes with at least one flag of each kind."""
    return summaries.flags(_checked(spark, sf_dir), "reasons", F.col("p_partkey") % 2 == 0, _KINDS)


@register(f"select count(*) as total, count_if(status = 'success') as success, count_if(status = 'failure') as failure, count_if(status = 'pending') as unlabelled, round(sum(price) filter (status = 'success') / 60, 4) as minutes, round(median(price) filter (status = 'success'), 4) as median_s, min(price) filter (status = 'success') as min_s, max(price) filter (status = 'success') as max_s, min(created_at) as first, count_if(status = 'success' and not converted) as passed, round(count_if(status = 'success') / count_if(status in ('success', 'failure')), 9) as rate from {DEMOS}")
def headline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = summaries.headline(demos(spark, sf_dir), "status", "price", F.col("converted"), "created_at")
    return h.withColumns({"minutes": F.round("minutes", 4), "median_s": F.round("median_s", 4), "rate": F.round("rate", 9)})


@register(f"select teacher_id, status, count(*) as n, min(price) as lowest, max(price) as highest, string_agg(distinct (path % 10)::varchar, ',' order by (path % 10)::varchar) as paths from {DEMOS} group by all")
def label_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, extremes and the sorted distinct names of each label and teacher."""
    names = F.array_join(F.sort_array(F.collect_set((F.col("path") % 10).cast("string"))), ",")
    return demos(spark, sf_dir).groupBy("teacher_id", "status").agg(F.count("*").alias("n"), F.min("price").alias("lowest"), F.max("price").alias("highest"), names.alias("paths"))


_EPISODES = f"(select event_id, user_id, t - (value * 1e8)::bigint a, t z, event_type from {EVENTS} where event_type <> 'signup')"


@register(f"""with e as (select *, lag(z) over (partition by user_id order by z, event_id) p from {_EPISODES}), l as (select user_id, t from {EVENTS} where event_type = 'signup'),
n as (select e.*, case when p is not null and (a - p > 43200000000 or coalesce((select max(t) from l where l.user_id = e.user_id and l.t <= e.a), -9e18::bigint) > p) then 1 else 0 end new from e),
s as (select *, sum(new) over (partition by user_id order by z, event_id) session from n) select user_id, session::bigint as session, count(*) as n, min(z) as first, count_if(event_type = 'purchase') as success, sum(z - a)::bigint as length from s group by all""")
def sessions_with_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that begin after a gap between end and start, or with a logged start; purchases count as successes."""
    e = events(spark, sf_dir)
    eps = e.where("event_type <> 'signup'").select("event_id", "user_id", (F.col("t") - F.bround(F.col("value") * 1e8, 0).cast("long")).alias("a"), F.col("t").alias("z"), "event_type")
    logged = e.where("event_type = 'signup'").select("user_id", F.col("t").alias("at"))
    s = windows.sessions_with_starts(eps, "user_id", "a", "z", "event_id", logged, "at", 43_200_000_000)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("z").alias("first"), F.count_if(F.col("event_type") == "purchase").alias("success"), F.sum(F.col("z") - F.col("a")).alias("length"))


@register("select 'customer' as name, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'part', count(*) from part")
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.record_counts({n: table(spark, sf_dir, n) for n in ("customer", "orders", "part")})


@register("select 'union' as op, count(*) as n, sum(k)::bigint as checksum from (select c_nationkey k from customer union all select s_nationkey from supplier) union all select 'distinct', count(*), sum(k)::bigint from (select c_nationkey k from customer union select s_nationkey from supplier) union all select 'except', count(*), coalesce(sum(k), 0)::bigint from (select n_nationkey k from nation except select s_nationkey % 11 from supplier) union all select 'intersect', count(*), coalesce(sum(k), 0)::bigint from (select n_nationkey k from nation intersect select s_nationkey % 11 from supplier)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    n, few = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), s.select((F.col("k") % 11).alias("k"))
    made = {"union": c.unionAll(s), "distinct": c.unionAll(s).distinct(), "except": n.subtract(few), "intersect": n.intersect(few)}
    out = None
    for op, df in made.items():
        one = df.agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("checksum")).select(F.lit(op).alias("op"), "n", "checksum")
        out = one if out is None else out.unionByName(one)
    return out


@register("select min(event_id) as id, json_extract_string(props, '$.k') as k from events where event_id % 2 = 1 and props not in (select props from events where event_id % 2 = 0) group by props union all select event_id, json_extract_string(props, '$.k') from events where event_id % 2 = 0")
def config_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New configurations are stored once, by content, not by the order of their keys."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "props")
    # of equal content in another order of keys
    new = e.where("id % 2 = 1").withColumn("props", F.concat(F.lit('{"z": 1, '), F.expr("substring(props, 2)")))
    old = e.where("id % 2 = 0").withColumn("props", F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "z": 1}')))
    return records.inserted_once(old, new, records.canonical(F.col("props"))).select("id", F.get_json_object("props", "$.k").alias("k"))


@register("select c_custkey, case c_custkey % 3 when 0 then 'zed' when 1 then 'realsense' else 'zed' end as type, case c_custkey % 3 when 0 then c_custkey::varchar else 'S' || c_custkey end as serial, case when c_custkey % 3 = 1 then 'scene' end as role, case when c_custkey % 3 = 1 then '640x480' end as size, case when c_custkey % 3 = 2 then '1,2,3,4' end as crop from customer")
def camera_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera configuration in its old form, a bare number, and in its new one."""
    k = F.col("c_custkey").cast("string")
    said = F.when(F.col("c_custkey") % 3 == 0, k).when(F.col("c_custkey") % 3 == 1, F.format_string('{"type": "RealSense", "serial": "S%s", "role": "scene", "crop": [1, 2]}', k)).otherwise(F.format_string('{"serial": "S%s", "crop": [1, 2, 3, 4]}', k))
    c = table(spark, sf_dir, "customer").select("c_custkey", records.camera_entry(said).alias("e"))
    joined = lambda a, by: F.array_join(F.transform(a, lambda x: x.cast("string")), by)
    return c.select("c_custkey", "e.type", "e.serial", "e.role", joined(F.col("e.resolution"), "x").alias("size"), joined(F.col("e.crop"), ",").alias("crop"))


@register("select p_partkey, regexp_full_match(p_name, '[A-Za-z0-9_]+') as valid from part")
def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", records.valid_name(F.col("p_name")).alias("valid"))


@register("select o_orderkey, strftime(o_orderdate, '%m-%d %H:%M') as \"when\", printf('%.3f', o_totalprice) || ', ' || printf('%+.3f', o_totalprice - 100000) as xy, case when o_orderstatus in ('O', 'F') then o_orderstatus else 'unlabelled' end as label, coalesce(nullif(case when o_orderkey % 2 = 0 then '' else o_orderpriority end, ''), nullif(o_orderstatus, 'P'), 'dir') as task from orders")
def told_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, places and labels as a report tells them, and the first text that isn't empty."""
    o = table(spark, sf_dir, "orders")
    prompt = F.nullif(F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority")), F.lit(""))
    return o.select("o_orderkey", F.date_format("o_orderdate", "MM-dd HH:mm").alias("when"), F.format_string("%.3f, %+.3f", F.col("o_totalprice"), F.col("o_totalprice") - 100000).alias("xy"), F.when(F.col("o_orderstatus").isin("O", "F"), F.col("o_orderstatus")).otherwise("unlabelled").alias("label"), F.coalesce(prompt, F.nullif("o_orderstatus", F.lit("P")), F.lit("dir")).alias("task"))


@register("select s_suppkey, case s_nationkey % 3 when 0 then 'hand_eye' when 1 then case when s_suppkey % 2 = 0 then 'extrinsics' else 'identity' end else 'identity' end as source, case s_nationkey % 3 when 0 then 1.0 when 1 then case when s_suppkey % 2 = 0 then 2.0 else 0.0 end else 0.0 end::double as pose from supplier")
def calibration_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera's pose: hand-eye before successful extrinsics before the identity."""
    from ..operators.poses import looked_up

    s = table(spark, sf_dir, "supplier").withColumn("camera", F.col("s_suppkey"))
    kind = F.col("s_nationkey") % 3
    cal = s.where(kind != 2).select("camera", F.when(kind == 0, F.lit(1.0)).alias("hand_eye"), F.lit(2.0).alias("extrinsics"), (F.col("s_suppkey") % 2 == 0).alias("success"))
    return looked_up(s.select("s_suppkey", "camera"), cal, F.lit(0.0)).select("s_suppkey", "source", "pose")


@register("select l.o_orderkey as id, l.o_totalprice as left, r.o_totalprice as right from orders l join orders r on l.o_orderkey = r.o_orderkey where l.o_orderkey % 3 <> 0 and r.o_orderkey % 5 <> 0")
def paired_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of two arms by their id; what one arm lacks doesn't shift the rest."""
    from ..operators.poses import paired

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("pose"))
    return paired(o.where("id % 3 <> 0"), o.where("id % 5 <> 0"), "id")


@register("select c_custkey, 'front' as a, c_name as b, case when c_custkey % 4 = 0 then '' else 'task' || c_custkey % 4 end as unfinished from customer")
def renamed_and_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera names of the data set for those of the rig, and the first subtask that isn't done."""
    names = records.renamed_keys(F.create_map(F.lit("scene_camera"), F.lit("front"), F.lit("wrist"), F.col("c_name")), {"scene_camera": "scene"})
    tasks = F.array(*[F.lit(f"task{k}") for k in range(1, 4)])
    done = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.when(F.col("c_custkey") % 4 == 0, True).otherwise(k < F.col("c_custkey") % 4))
    return table(spark, sf_dir, "customer").select("c_custkey", names["scene"].alias("a"), names["wrist"].alias("b"), records.first_unfinished(tasks, done).alias("unfinished"))


@register("select user_id, array_to_string(list_filter([case when user_id % 5 = 0 then 'cut short' end, case when user_id % 40 < 15 then 'only ' || printf('%.1f', (user_id % 40)::double) || ' s long' end, case when user_id % 3 = 0 then 'no verdict' end, case when user_id % 4 = 3 then 'duplicate rows' end, case when n is null then 'no telemetry' end, case when g > 345600000000 then 'gap in telemetry' end, case when s < 60 then 'barely moved' end], lambda x: x is not null), ',') as warnings from (select distinct user_id from events) left join (select user_id, count(*) n, max(d) g, max(value) - min(value) s from (select user_id, value, t - lag(t) over (partition by user_id order by t) d from " + EVENTS + ") where user_id % 10 <> 9 group by all) using (user_id)")
def episode_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What looks wrong about each episode."""
    e = events(spark, sf_dir)
    u = F.col("user_id")
    eps = e.select("user_id").distinct().select("user_id", (u % 5 != 0).alias("complete"), (u % 40).cast("double").alias("duration_s"), F.when(u % 3 == 0, "pending").otherwise("success").alias("status"), F.when(u % 4 == 3, 2).otherwise(1).alias("n_rows"))
    out = quality.linted(eps, e.where("user_id % 10 <> 9"), "user_id", "t", "value", 345_600_000_000, 60.0)
    return out.select("user_id", F.array_join("warnings", ",").alias("warnings"))


@register("select c_custkey, c_custkey % 4 <> 0 as unlocked, c_custkey % 6 = 5 as jumped, c_custkey % 7 <> 1 as finite from customer")
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour controls that differ, commands that jump, and plans that hold what isn't a number."""
    k = F.col("c_custkey")
    got = F.when(k % 4 == 1, F.lit(None).cast("map<string,double>")).when(k % 4 == 2, F.create_map(F.lit("gain"), F.lit(16.0))).otherwise(F.create_map(F.lit("gain"), F.lit(16.0), F.lit("exposure"), F.when(k % 4 == 0, 100.5).otherwise(101.0)))
    want = F.create_map(F.lit("gain"), F.lit(16.0), F.lit("exposure"), F.lit(100.0))
    now = F.array(*[F.lit(0.1 * j) for j in range(6)], F.lit(0.0))
    command = F.concat(F.array(*[F.lit(0.1 * j) for j in range(5)]), F.array(F.lit(0.5) + (k % 6) * 0.05, F.lit(1.0)))
    plan = F.array(F.lit(1.0), F.when(k % 7 == 1, F.lit(float("nan"))).otherwise(F.lit(2.0)))
    return table(spark, sf_dir, "customer").select("c_custkey", quality.unlocked(got, want).alias("unlocked"), (quality.jump(now, command) > 0.22).alias("jumped"), quality.all_finite(plan).alias("finite"))


@register("select p_type, (case when abs(quantile_cont(p_retailprice / 1000, 0.99) - 1.2) < abs(quantile_cont(p_retailprice / 1000, 0.99) - 2.0) then 'low' else 'high' end) as clamp, round(quantile_cont(p_retailprice / 1000, 0.99), 6) as p99, count_if(p_size < 20) / count(*) as closed from part group by all")
def clamp_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ceiling that a gripper's p99 lag is nearest to, and how much of the time it was closed."""
    p = table(spark, sf_dir, "part").withColumn("lag", F.col("p_retailprice") / 1000)
    g = p.groupBy("p_type").agg(F.percentile("lag", 0.99).alias("p99"), (F.count_if(F.col("p_size") < 20) / F.count("*")).alias("closed"))
    return g.select("p_type", quality.matched_clamp(F.col("p99"), {"low": 1.2, "high": 2.0})[0].alias("clamp"), F.round("p99", 6).alias("p99"), "closed")


@register("select c_custkey as id, c_name as name, 'new' as status, null::bigint as at from customer where c_custkey % 10 <> 0 and c_custkey % 3 <> 1 union all select c_custkey, c_name, 'done', 7 from customer where c_custkey % 10 <> 0 and c_custkey % 3 = 1 union all select (select max(c_custkey) from customer) + 1, 'z new', 'pending', null")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inserted by unique name, relabelled and deleted, one version of the table after another."""
    store = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("new").alias("status"), F.lit(None).cast("long").alias("updated_at"))
    new = spark.createDataFrame([("z new",), ("z new",)], "name string").unionByName(store.agg(F.min("name").alias("name")))
    grown = records.inserted(store, new, ["name"], status=F.lit("pending"), updated_at=F.lit(None).cast("long"))
    ids = store.where("id % 3 = 1").select("id")
    out = records.relabelled(grown, ids, "status", F.lit("done"), F.lit(7).cast("long"))
    return records.deleted(out, store.where("id % 10 = 0").select("id")).withColumnRenamed("updated_at", "at")


@register("select l_orderkey, l_linenumber, coalesce(p_name, 'missing') as image from lineitem left join (select * from part where p_partkey % 3 <> 0) on p_partkey = l_partkey where l_orderkey % 50 = 7")
def frames_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their image; one that is missing doesn't drop the frame."""
    frames = table(spark, sf_dir, "lineitem").where("l_orderkey % 50 = 7").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    images = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select("p_partkey", "p_name")
    return frames.join(images, "p_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("missing")).alias("image"))


@register("select o_orderkey, count(*) as anchors, max(k) as last from (select o_orderkey, unnest(range(o_orderkey % 5 + 1)) k from orders) group by all")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of every episode as an anchor."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 5)).alias("k"))
    return o.groupBy("o_orderkey").agg(F.count("*").alias("anchors"), F.max("k").alias("last"))


@register("select a.l_orderkey, max(abs(a.l_tax - b.l_tax)) as worst, coalesce(min(a.l_linenumber) filter (abs(a.l_tax - b.l_tax) > 0.04), -1) as first_off, bool_and(a.l_tax = b.l_tax) as identical from lineitem a join (select l_orderkey + 1 l_orderkey, l_linenumber, l_tax from lineitem) b using (l_orderkey, l_linenumber) group by all")
def replay_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay against its recording, frame by frame: worst error, first frame over tolerance, and whether they are the same."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("recorded"))
    b = a.select((F.col("l_orderkey") + 1).alias("l_orderkey"), "l_linenumber", F.col("recorded").alias("replayed"))
    off = F.abs(F.col("recorded") - F.col("replayed"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(F.max(off).alias("worst"), F.coalesce(F.min(F.when(off > 0.04, F.col("l_linenumber"))), F.lit(-1)).alias("first_off"), F.bool_and(F.col("recorded") == F.col("replayed")).alias("identical"))


@register("select o_orderkey from orders order by md5(o_orderkey::varchar || 'seed'), o_orderkey limit 25")
def shuffled_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of episodes in an order that a seed decides."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("seed"))), "o_orderkey").limit(25)


@register("select l_orderkey, arg_max(l_partkey, (l_extendedprice, l_linenumber)) as largest, arg_min(l_partkey, (l_extendedprice, l_linenumber)) as smallest, string_agg(l_shipmode, ',' order by l_shipmode <> 'A', l_shipmode, l_linenumber) as cameras, round((max(l_linenumber) - 1) / 30.0::double, 6) as seconds from (select *, l_returnflag l_shipmode from lineitem) group by all")
def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest and smallest of each episode, its cameras with those of the scene first, and the last frame's time."""
    rows = table(spark, sf_dir, "lineitem")
    by = F.struct("l_extendedprice", "l_linenumber")
    order = F.array_sort(F.collect_list(F.struct((F.col("l_returnflag") != "A").alias("late"), "l_returnflag", "l_linenumber")))
    return rows.groupBy("l_orderkey").agg(F.max_by("l_partkey", by).alias("largest"), F.min_by("l_partkey", by).alias("smallest"), F.array_join(F.transform(order, lambda x: x["l_returnflag"]), ",").alias("cameras"), F.round((F.max("l_linenumber") - 1) / 30.0, 6).alias("seconds"))


@register("select event_id, event_id % 3 <> 0 as ok, case when event_id % 3 <> 0 then event_id + 15.0 end::double as last, case when event_id % 3 <> 0 and event_id % 2 = 0 then 0.5::double end as trigger, case when event_id % 3 <> 0 then true end as a, case when event_id % 3 <> 0 then false end as b from events")
def tracking_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of a hand controller as poses and buttons; one in three is broken."""
    k = F.col("event_id")
    numbers = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: (j + k).cast("string")), " ")
    line = F.when(k % 3 == 0, F.concat(F.lit("r:1 2 x"))).otherwise(F.concat(F.lit("r:"), numbers, F.lit("|l:1 2 3&R,A,rightJS 0.1 bad,"), F.when(k % 2 == 0, "rightTrig 0.5").otherwise("other")))
    e = table(spark, sf_dir, "events").select("event_id", records.tracking_line(line).alias("l"))
    return e.select("event_id", (F.size("l.poses") > 0).alias("ok"), F.col("l.poses")["r"][15].alias("last"), F.col("l.buttons")["rightTrig"][0].alias("trigger"), F.col("l.pressed")["A"].alias("a"), F.col("l.pressed")["B"].alias("b"))
