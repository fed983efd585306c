"""Queries over the private-data operators, one per operator contract, and their SQL for DuckDB.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.functions import bits
from veil.functions.bits import reverse_lexicographic, unsigned_key
from veil.functions.crypto import ctr, nonce, seal, seal_columns, seal_random, sealed_equal, unseal, unseal_columns
from veil.functions.random_tags import minstd
from veil.operators import dp, oarray, omap, ordering, partition, sampling, trace
from veil.plans import planner
from veil.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: A key for the round-trip query only; callers of the operators bring their own.
DEMO_KEY = bytes(range(32))


def q01_osort(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.osort(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], rank="rk")


def q02_shuffle_minstd(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.shuffle_by_key(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


def q03_compact(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return partition.compact(orders, F.col("o_orderstatus") == "F", "o_orderkey").drop("o_orderstatus")


def q04_interleave(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return partition.interleave(table(spark, sf, "lineitem").select(*keys), F.col("l_orderkey") % 5, 5, keys)


def q05_quantile_pick(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.quantile_pick(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], 8)


def q06_is_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.is_sorted(table(spark, sf, "orders"), ["o_orderkey"], "o_totalprice")


def q07_omap_bulk_build(spark: SparkSession, sf: str) -> DataFrame:
    return omap.bulk_build(table(spark, sf, "customer"), "c_custkey")


def q08_omap_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return omap.upsert_many(table(spark, sf, "events"), "user_id", "value", "event_id")


def q09_omap_get(spark: SparkSession, sf: str) -> DataFrame:
    return omap.get_many(table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "customer"), "c_custkey", "c_acctbal")


def q10_contact_discovery(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return omap.registered(table(spark, sf, "orders"), "o_custkey", members, "c_custkey")


def q11_evict_path(spark: SparkSession, sf: str) -> DataFrame:
    return trace.evict_path(table(spark, sf, "customer"), "c_custkey", F.col("c_custkey") * 37 % 1024, path=341, levels=10, bucket=4)


def q12_rotate_left(spark: SparkSession, sf: str) -> DataFrame:
    return partition.rotate_left(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey"), 7, 25)


def q13_transpose(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey")
    rows = F.floor(parts.agg(F.count("*").alias("n")).first()["n"] / F.lit(10))
    return partition.transpose(parts, F.col("p_partkey"), rows, 10)


def q14_knapsack(spark: SparkSession, sf: str) -> DataFrame:
    return dp.knapsack(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_quantity"), F.col("l_extendedprice"), 100)


def q15_cache_direct_mapped(spark: SparkSession, sf: str) -> DataFrame:
    return trace.cache_direct_mapped(table(spark, sf, "events"), "event_id", F.col("user_id") % 500, 64)


def q16_cache_lru(spark: SparkSession, sf: str) -> DataFrame:
    return trace.cache_lru(table(spark, sf, "events"), "event_id", F.col("user_id") % 200, 64)


def q17_path_indices(spark: SparkSession, sf: str) -> DataFrame:
    return trace.path_indices(table(spark, sf, "customer"), "c_custkey", F.col("c_custkey") % 1024, 10)


def q18_aes_gcm_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    sealed = table(spark, sf, "orders").select("o_orderkey", seal(F.col("o_orderstatus"), DEMO_KEY, F.col("o_orderkey")).alias("c"))
    return sealed.select("o_orderkey", unseal(F.col("c"), DEMO_KEY, F.col("o_orderkey")).cast("string").alias("status"))


def q19_omap_replay(spark: SparkSession, sf: str) -> DataFrame:
    return omap.replay(table(spark, sf, "events"), "user_id", "event_id", F.col("event_id") % 2 == 0, "value")


def q20_merge_split(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    size = orders.count() // 2 + 512
    return partition.merge_split(orders, "o_orderkey", F.col("o_orderkey") % 2, 2, size)


def q21_distribute_by_pivots(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_totalprice", "o_orderkey")
    sample = orders.filter(minstd(F.col("o_orderkey")) < 42949672)  # the sampling operator: one row in fifty by tag
    return partition.distribute_by_pivots(orders, sample, ["o_totalprice", "o_orderkey"], 8).select("o_orderkey", "part")


def q22_page_permuted_scan(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.page_permuted_scan(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 64).select("o_orderkey", "idx", "pos")


def q23_merge_runs(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ordering.merge_runs(orders, F.col("o_orderkey") % 8, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "run", "run_pos", "pos")


def q24_reverse_lexicographic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", reverse_lexicographic(F.col("p_partkey") % 256, 8).alias("rlo"))


def q25_bucket_routing(spark: SparkSession, sf: str) -> DataFrame:
    routed = partition.route(table(spark, sf, "orders").select("o_orderkey"), minstd(F.col("o_orderkey")), [3, 4, 5])
    return routed.groupBy("d0", "d1", "d2").agg(F.count("*").alias("bucket_rows"))


def q26_oarray_put_get(spark: SparkSession, sf: str) -> DataFrame:
    return oarray.read_all(table(spark, sf, "events"), F.col("user_id") % 256, "value", "event_id", 256, -1.0)


def q27_unsigned_order(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "events").select((F.col("event_id") * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)).cast("long").alias("k"))
    return ordering.osort(keys, [unsigned_key(F.col("k"))], rank="rn")


def q28_padded_buckets(spark: SparkSession, sf: str) -> DataFrame:
    tagged = table(spark, sf, "events").select("event_id", (F.col("user_id") % 16).alias("bucket"))
    return partition.padded_buckets(tagged, "bucket", "event_id", 640)


def q29_prefix_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of the trackers per event type: calls, total, mean, xor and maximum."""
    e = table(spark, sf, "events")
    mean = F.sum("event_id").cast("double") / F.count("*")
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("event_id").alias("total"), mean.alias("mean"), F.bit_xor("event_id").alias("xor"), F.max("value").alias("top"))


def q30_tail_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """The planner's tail probabilities, in millionths, for a grid of cases made on the driver."""
    cases = [("binom", n, k, p, 0) for n in (10, 60, 200) for p in (0.1, 0.35, 0.5) for k in range(0, n + 1, max(1, n // 6))]
    cases += [("hyper", n, k, 0.0, m) for n in (30, 120) for m in (5, n // 2) for k in range(0, min(m, n // 3) + 1, 2)]
    rows = []
    for kind, n, k, p, m in cases:
        if kind == "binom":
            point, above = planner.binom_pmf(k, n, p), planner.binom_sf(k, n, p)
        else:
            point, above = planner.hypergeom_pmf(k, n, m, n // 3), planner.hypergeom_sf(k, n, m, n // 3)
        rows.append((kind, n, k, p, m, 2.0**point, 2.0**above))
    made = spark.createDataFrame(rows, "kind string, n long, k long, p double, m long, point double, above double")
    return made.select("kind", "n", "k", "p", "m", *[F.floor(F.col(c) * 1e6 + 0.123).cast("long").alias(c) for c in ("point", "above")])


def q31_apply_log(spark: SparkSession, sf: str) -> DataFrame:
    """The map after inserts and deletes: every third event deletes its user's entry."""
    return omap.apply_log(table(spark, sf, "events"), "user_id", "value", "event_id", F.col("event_id") % 3 == 0)


def q32_delete_many(spark: SparkSession, sf: str) -> DataFrame:
    buyers = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    return omap.delete_many(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey", buyers, "o_custkey")


def q33_ring_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return trace.ring_schedule(table(spark, sf, "customer").select((F.col("c_custkey") - table_first(spark, sf, "customer", "c_custkey")).alias("seq"), "c_custkey"), "seq", F.col("c_custkey") * 37 % 64, 6, every=3, spare=4)


def q34_path_accesses(spark: SparkSession, sf: str) -> DataFrame:
    return trace.path_accesses(table(spark, sf, "events"), "event_id", F.col("user_id"), 10)


def q35_path_cache(spark: SparkSession, sf: str) -> DataFrame:
    return trace.path_cache(table(spark, sf, "customer"), "c_custkey", F.col("c_custkey") * 37 % 256, 8, 16)


def q36_pack_indices(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of paths in packs of three levels, back from their heap index, and whether a path and its neighbour's meet."""
    paths = trace.path_indices(table(spark, sf, "customer"), "c_custkey", F.col("c_custkey") % 512, 9)
    pack, place = bits.pack_index(F.col("c_custkey") % 512, F.col("depth"), 9, 3)
    depth, first = bits.place_of(F.col("idx"), 9)
    meets = bits.paths_meet(F.col("c_custkey") % 512, (F.col("c_custkey") + 1) % 512, F.col("depth"), 9)
    return paths.select("c_custkey", "depth", pack.alias("pack"), place.alias("place"), depth.cast("long").alias("depth_again"), first.alias("first_leaf"), meets.alias("meets"))


def q37_address_walk(spark: SparkSession, sf: str) -> DataFrame:
    return oarray.address_walk(table(spark, sf, "part").select("p_partkey"), F.col("p_partkey") % 4096, 12)


def q38_copy_range(spark: SparkSession, sf: str) -> DataFrame:
    """A range read at unaligned bounds and written back, raised, over the rest."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    part = oarray.copy_out(orders, "o_orderkey", 137, 1041).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return oarray.copy_in(orders, part, "o_orderkey")


def q39_shadow_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Where the map of all events differs from a shadow that missed every tenth."""
    events = table(spark, sf, "events")
    answers = omap.upsert_many(events, "user_id", "value", "event_id").select("user_id", "v")
    shadow = omap.upsert_many(events.filter(F.col("event_id") % 10 != 0), "user_id", "value", "event_id").select("user_id", "v")
    return omap.differences(answers, shadow, "user_id")


def q40_bernoulli(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.bernoulli_by_key(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.125)


def q41_exact_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.exact_size_by_key(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100)


def q42_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products of an order's ways, as arrays of its line numbers, and pages of 7 rows that they take."""
    ways = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("ways"))
    total = bits.product(F.col("ways"))
    return ways.select("l_orderkey", total.alias("total"), bits.divide_round_up(total, 7).alias("pages"))


def q43_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return omap.in_order(omap.bulk_build(table(spark, sf, "customer"), "c_custkey"), "c_custkey")


def q44_reals(spark: SparkSession, sf: str) -> DataFrame:
    marked = table(spark, sf, "events").select("event_id", (F.col("user_id") % 3 == 0).alias("is_dummy"))
    return partition.reals(marked, "is_dummy").select("event_id")


def q45_small_sorts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", ordering.sort_array_by_network(F.array(*[key * m % 101 for m in (7, 11, 13, 17, 19, 23)])).alias("a")).select("p_partkey", *[F.get("a", F.lit(i)).alias(f"a{i}") for i in range(6)])


def q46_mixed_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records with a sealed part, opened again; whether a replayed and a moved one were noticed; equality; counter mode."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    sealed = seal_columns(orders, ["o_custkey"], DEMO_KEY, "o_orderkey", 5)
    replayed = unseal(F.col("sealed"), DEMO_KEY, F.col("o_orderkey"), 4).isNull()
    moved = unseal(F.col("sealed"), DEMO_KEY, F.col("o_orderkey") + 1, 5).isNull()
    hidden = ~F.contains(F.col("sealed"), F.encode(F.lit("o_custkey"), "utf-8"))
    noticed = sealed.withColumn("replayed", replayed).withColumn("moved", moved).withColumn("hidden", hidden)
    opened = unseal_columns(noticed, "o_custkey long", DEMO_KEY, "o_orderkey", 5)
    twice = ctr(ctr(F.col("o_orderstatus"), DEMO_KEY, nonce(F.col("o_orderkey"))), DEMO_KEY, nonce(F.col("o_orderkey"))).cast("string")
    same = sealed_equal(seal_random(F.col("o_orderstatus"), DEMO_KEY), seal_random(F.lit("F"), DEMO_KEY), DEMO_KEY)
    return opened.select("o_orderkey", "o_custkey", "replayed", "moved", "hidden", twice.alias("status"), same.alias("is_f"))


def table_first(spark: SparkSession, sf: str, name: str, column: str) -> int:
    """The least value of a column, from the files' statistics or a scan of that column."""
    return table(spark, sf, name).agg(F.min(column)).first()[0]


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "q" and name[1:3].isdigit()}


_SQL = {
    "q01_osort": "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) as rk from orders",
    "q02_shuffle_minstd": "select o_orderkey, row_number() over (order by ((o_orderkey + 1) * 48271) % 2147483647, o_orderkey) as pos from orders",
    "q03_compact": """select o_orderkey, row_number() over (order by case when o_orderstatus = 'F' then 0 else 1 end, o_orderkey) - 1 as pos,
  cast(case when o_orderstatus = 'F' then sum(case when o_orderstatus = 'F' then 1 else 0 end) over (order by o_orderkey rows between unbounded preceding and current row) - 1 end as bigint) as marked_pos from orders""",
    "q04_interleave": """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  (row_number() over (partition by l_orderkey % 5 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) * 5 + l_orderkey % 5 as pos from lineitem""",
    "q05_quantile_pick": """with s as (select o_totalprice, o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as i, count(*) over () as n from orders)
  select k.k, s.o_totalprice, s.o_orderkey from (values (1),(2),(3),(4),(5),(6),(7)) as k(k) join s on s.i = cast(floor(s.n * k.k / 8) as bigint)""",
    "q06_is_sorted": """select cast(sum(case when p < prev then 1 else 0 end) as bigint) as violations, count(*) as n
  from (select o_totalprice as p, lag(o_totalprice) over (order by o_orderkey) as prev from orders) x""",
    "q07_omap_bulk_build": """with recursive t(l, r, m, depth) as (
  select cast(0 as bigint), n - 1, cast(floor((n - 1) / 2) as bigint), cast(0 as bigint) from (select count(*) as n from customer) c0
  union all
  select nl, nr, cast(floor((nl + nr) / 2) as bigint), depth + 1
  from (select case when s = 0 then l else m + 1 end as nl, case when s = 0 then m - 1 else r end as nr, depth from t cross join (values (0), (1)) as d(s)) q where nl <= nr)
select c.c_custkey, t.depth, case when t.m > t.l then cast(floor((t.l + t.m - 1) / 2) as bigint) end as left_idx,
  case when t.r > t.m then cast(floor((t.m + 1 + t.r) / 2) as bigint) end as right_idx,
  case when (case when t.r = t.m then 0 else length(bin(t.r - t.m)) end) > (case when t.m = t.l then 0 else length(bin(t.m - t.l)) end) then 1 else 2 end as balance
from t join (select c_custkey, row_number() over (order by c_custkey) - 1 as i from customer) c on c.i = t.m""",
    "q08_omap_upsert": "select user_id, arg_max(value, event_id) as v, count(*) as writes from events group by user_id",
    "q09_omap_get": "select q.o_orderkey as k, r.c_custkey is not null as contained, r.c_acctbal as v from orders q left join customer r on r.c_custkey = q.o_orderkey",
    "q10_contact_discovery": """select q.o_custkey, case when c.c_custkey is not null then 1 else 0 end as registered from (select distinct o_custkey from orders) q
  left join (select distinct c_custkey from customer where c_mktsegment = 'BUILDING') c on c.c_custkey = q.o_custkey""",
    "q11_evict_path": """select c_custkey, case when lv <= 10 then 10 - lv else -1 end as level from (
 select c_custkey, cast(floor((rn + mx) / 4) as bigint) as lv from (
  select c_custkey, rn, max(4 * tag - rn) over (order by rn rows between unbounded preceding and current row) as mx from (
   select c_custkey, tag, row_number() over (order by tag, c_custkey) - 1 as rn from (
    select c_custkey, case when x = 0 then 0 else length(bin(x)) end as tag from (select c_custkey, xor(c_custkey * 37 % 1024, 341::bigint) as x from customer) a) b) c) d) e""",
    "q12_rotate_left": "select n_nationkey, n_name, (n_nationkey - 7 + 25) % 25 as pos from nation",
    "q13_transpose": "select p_partkey, (p_partkey % 10) * ((select count(*) from part) // 10) + p_partkey // 10 as pos from part",
    "q14_knapsack": """with recursive it as (
  select l_orderkey, cast(l_quantity as int) as w, l_extendedprice as v, row_number() over (partition by l_orderkey order by cast(l_quantity as int), l_extendedprice) as i,
         count(*) over (partition by l_orderkey) as n from lineitem),
dp(l_orderkey, i, arr) as (
  select distinct l_orderkey, 0::bigint, list_transform(range(101), lambda x: 0.0::double) from it
  union all
  select it.l_orderkey, it.i, list_transform(range(101), lambda j: case when j >= it.w then greatest(dp.arr[j + 1], dp.arr[j - it.w + 1] + it.v) else dp.arr[j + 1] end)
  from dp join it on it.l_orderkey = dp.l_orderkey and it.i = dp.i + 1)
select dp.l_orderkey, arr[101] as best from dp join (select distinct l_orderkey, n from it) q on q.l_orderkey = dp.l_orderkey and q.n = dp.i""",
    "q15_cache_direct_mapped": """select count(*) as accesses, cast(sum(case when pg = prev then 1 else 0 end) as bigint) as hits
  from (select pg, lag(pg) over (partition by pg % 64 order by event_id) as prev from (select event_id, user_id % 500 as pg from events) a) b""",
    "q16_cache_lru": """with a as (select event_id as t, user_id % 200 as pg from events), b as (select t, pg, lag(t) over (partition by pg order by t) as p from a)
select count(*) as hits from (select b.t, count(distinct a.pg) as d from b left join a on a.t > b.p and a.t < b.t where b.p is not null group by b.t) z where d < 64""",
    "q17_path_indices": "select c_custkey, d as depth, (1::bigint << d) - 1 + ((c_custkey % 1024) >> (10 - d)) as idx from customer cross join (select unnest(range(11)) as d) t",
    "q18_aes_gcm_roundtrip": "select o_orderkey, o_orderstatus as status from orders",
    "q19_omap_replay": """select event_id, user_id, v is not null as contained, v from (
  select event_id, user_id, last_value(case when event_id % 2 = 0 then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as v from events) x where event_id % 2 = 1""",
    "q20_merge_split": """with z as (select count(*) // 2 + 512 as z from orders)
select s.half, s.slot, r.o_orderkey from (select half, slot from (values (0::bigint), (1::bigint)) as h(half), (select unnest(range((select z from z))) as slot) q) s
left join (select o_orderkey, o_orderkey % 2 as half, row_number() over (partition by o_orderkey % 2 order by o_orderkey) - 1 as slot from orders) r on r.half = s.half and r.slot = s.slot""",
    "q21_distribute_by_pivots": """with smp as (select o_totalprice as p, o_orderkey as k, row_number() over (order by o_totalprice, o_orderkey) - 1 as i, count(*) over () as n
  from orders where ((o_orderkey + 1) * 48271) % 2147483647 < 42949672),
piv as (select smp.p, smp.k from smp join (values (1),(2),(3),(4),(5),(6),(7)) as t(j) on smp.i = cast(floor(smp.n * t.j / 8) as bigint))
select o.o_orderkey, count(piv.k) as part from orders o left join piv on piv.p < o.o_totalprice or (piv.p = o.o_totalprice and piv.k < o.o_orderkey) group by o.o_orderkey""",
    "q22_page_permuted_scan": """with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as idx, count(*) over () as n from orders),
q as (select o_orderkey, idx, idx // 64 as pg, (n - 1) // 64 as last_pg from r)
select o_orderkey, idx, row_number() over (order by case when pg = last_pg then 1 else 0 end, ((pg + 1) * 48271) % 2147483647, idx) - 1 as pos from q""",
    "q23_merge_runs": """select o_orderkey, o_orderkey % 8 as run, row_number() over (partition by o_orderkey % 8 order by o_totalprice, o_orderkey) - 1 as run_pos,
  row_number() over (order by o_totalprice, o_orderkey) - 1 as pos from orders""",
    "q24_reverse_lexicographic": """select p_partkey, cast(255 - sum(((p_partkey >> b) & 1) << (7 - b)) as bigint) as rlo
  from part cross join (values (0),(1),(2),(3),(4),(5),(6),(7)) as t(b) group by p_partkey""",
    "q25_bucket_routing": """select d0, d1, d2, count(*) as bucket_rows from (
  select tag % 3 as d0, (tag // 3) % 4 as d1, (tag // 12) % 5 as d2 from (select ((o_orderkey + 1) * 48271) % 2147483647 as tag from orders) a) b group by d0, d1, d2""",
    "q26_oarray_put_get": """select a.address, coalesce(w.v, -1.0::double) as v from (select unnest(range(256)) as address) a
  left join (select user_id % 256 as address, arg_max(value, event_id) as v from events group by user_id % 256) w on w.address = a.address""",
    "q27_unsigned_order": """select k, row_number() over (order by case when k < 0 then 1 else 0 end, k) as rn
  from (select event_id * case when event_id % 2 = 0 then 1 else -1 end as k from events) x""",
    "q28_padded_buckets": """with r as (select user_id % 16 as bucket, event_id, row_number() over (partition by user_id % 16 order by event_id) - 1 as slot from events),
c as (select bucket, count(*) as n from r group by bucket)
select bucket, slot, event_id, slot >= 640 as overflow from r
union all select bucket, slot, cast(null as bigint), false from (select bucket, unnest(range(n, 640)) as slot from c where n < 640) f""",
    "q29_prefix_totals": "select event_type, count(*) as calls, cast(sum(event_id) as bigint) as total, cast(sum(event_id) as double) / count(*) as mean, bit_xor(event_id) as xor, max(value) as top from events group by event_type",
    "q30_tail_probabilities": """with cases as (
  select 'binom' as kind, n, unnest(range(0, n + 1, greatest(1, n // 6))) as k, p, 0::bigint as m from (values (10::bigint), (60), (200)) as a(n), (values (0.1::double), (0.35), (0.5)) as b(p)
  union all select 'hyper', n, unnest(range(0, least(m, n // 3) + 1, 2)), 0.0::double, m from (select n, unnest([5, n // 2]) as m from (values (30::bigint), (120)) as c(n)) d),
terms as (select kind, n, k, p, m, unnest(range(0, n + 1)) as i from cases),
valued as (select kind, n, k, p, m, i, case when kind = 'binom' then lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(p) + (n - i) * ln(1 - p)
  when i > m or i > n // 3 or n // 3 - i > n - m then null
  else lgamma(m + 1.0) - lgamma(i + 1.0) - lgamma(m - i + 1.0) + lgamma(n - m + 1.0) - lgamma(n // 3 - i + 1.0) - lgamma(n - m - n // 3 + i + 1.0) - lgamma(n + 1.0) + lgamma(n // 3 + 1.0) + lgamma(n - n // 3 + 1.0) end as e
  from (select kind, n, k, case when kind = 'binom' then p else 0.5 end as p, m, i from terms) t)
select kind, n, k, case when kind = 'binom' then p else 0.0 end as p, m, cast(floor(1e6 * coalesce(sum(case when i = k then exp(e) end), 0) + 0.123) as bigint) as point, cast(floor(1e6 * coalesce(sum(case when i > k then exp(e) end), 0) + 0.123) as bigint) as above
from valued group by kind, n, k, p, m""",
    "q31_apply_log": "select user_id, v from (select user_id, arg_max(value, event_id) as v, max(event_id) as s from events group by user_id) x where s % 3 <> 0",
    "q32_delete_many": "select c_custkey, c_acctbal from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')",
    "q33_ring_schedule": """with a as (select c_custkey - (select min(c_custkey) from customer) as t, c_custkey * 37 % 64 as p from customer),
e as (select t, p, d, false as evicted from a, (select unnest(range(7)) as d) x
  union all select t, 63 - list_sum(list_transform(range(6), lambda b: ((((t + 1) // 3 - 1) % 64 >> b) & 1) << (5 - b))), d, true from a, (select unnest(range(6)) as d) y where (t + 1) % 3 = 0),
n as (select t, d, (1::bigint << d) - 1 + (cast(p as bigint) >> (6 - d)) as idx, evicted from e),
s as (select *, sum(case when evicted then 1 else 0 end) over (partition by idx order by t, evicted rows between unbounded preceding and current row) as turn from n),
r as (select t, d, idx, row_number() over (partition by idx, turn order by t) as j from s where not evicted)
select t as seq, d as depth, idx, j % 5 = 0 as whole from r""",
    "q34_path_accesses": """select event_id, user_id as address, coalesce(lag(((event_id + 1) * 48271) % 2147483647 % 1024) over (partition by user_id order by event_id), ((user_id + 1) * 48271) % 2147483647 % 1024) as position,
  ((event_id + 1) * 48271) % 2147483647 % 1024 as remapped from events""",
    "q35_path_cache": """with a as (select c_custkey * 9 + d as t, (1::bigint << d) - 1 + ((c_custkey * 37 % 256) >> (8 - d)) as pg from customer, (select unnest(range(9)) as d) x),
b as (select t, pg, lag(t) over (partition by pg order by t) as p from a)
select count(*) as hits from (select b.t, count(distinct a.pg) as d from b left join a on a.t > b.p and a.t < b.t where b.p is not null group by b.t) z where d < 16""",
    "q36_pack_indices": """with p as (select c_custkey, c_custkey % 512 as pos, (c_custkey + 1) % 512 as other, d as depth from customer, (select unnest(range(10)) as d) x),
i as (select *, depth - depth % 3 as root, (1::bigint << depth) - 1 + (pos >> (9 - depth)) as idx from p)
select c_custkey, depth, ((1::bigint << root) - 1) // 7 + (pos >> (9 - root)) as pack, (1::bigint << (depth % 3)) - 1 + (pos >> (9 - depth)) % (1::bigint << (depth % 3)) as place,
  cast(length(bin(idx + 1)) - 1 as bigint) as depth_again, ((pos >> (9 - depth)) << (9 - depth)) as first_leaf, (pos >> (9 - depth)) = (other >> (9 - depth)) as meets from i""",
    "q37_address_walk": "select p_partkey, cast(l as int) as level, (p_partkey % 4096) >> (12 - l) as block from part, (select unnest(range(13)) as l) x",
    "q38_copy_range": "select o_orderkey, o_totalprice + case when o_orderkey >= 137 and o_orderkey < 1041 then 1 else 0 end as o_totalprice from orders",
    "q39_shadow_differences": """with a as (select user_id, arg_max(value, event_id) as v from events group by user_id), b as (select user_id, arg_max(value, event_id) as v from events where event_id % 10 <> 0 group by user_id)
select coalesce(a.user_id, b.user_id) as user_id, a.v as answer, b.v as shadow from a full join b on a.user_id = b.user_id where a.user_id is null or b.user_id is null or a.v is distinct from b.v""",
    "q40_bernoulli": "select o_orderkey from orders where ((o_orderkey + 1) * 48271) % 2147483647 < 268435455",
    "q41_exact_sample": "select o_orderkey from orders order by ((o_orderkey + 1) * 48271) % 2147483647, o_orderkey limit 100",
    "q42_products": "select l_orderkey, cast(product(l_linenumber) as bigint) as total, cast((cast(product(l_linenumber) as bigint) + 6) // 7 as bigint) as pages from lineitem group by l_orderkey",
    "q43_in_order": """with recursive t(l, r, m, depth) as (
  select cast(0 as bigint), n - 1, (n - 1) // 2, cast(0 as bigint) from (select count(*) as n from customer) c0
  union all select nl, nr, (nl + nr) // 2, depth + 1 from (select case when s = 0 then l else m + 1 end as nl, case when s = 0 then m - 1 else r end as nr, depth from t cross join (values (0), (1)) as d(s)) q where nl <= nr)
select c.c_custkey, t.depth from t join (select c_custkey, row_number() over (order by c_custkey) - 1 as i from customer) c on c.i = t.m""",
    "q44_reals": "select event_id from events where user_id % 3 <> 0",
    "q45_small_sorts": "select p_partkey, a[1] as a0, a[2] as a1, a[3] as a2, a[4] as a3, a[5] as a4, a[6] as a5 from (select p_partkey, list_sort([p_partkey * 7 % 101, p_partkey * 11 % 101, p_partkey * 13 % 101, p_partkey * 17 % 101, p_partkey * 19 % 101, p_partkey * 23 % 101]) as a from part) x",
    "q46_mixed_records": "select o_orderkey, o_custkey, true as replayed, true as moved, true as hidden, o_orderstatus as status, o_orderstatus = 'F' as is_f from orders",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
