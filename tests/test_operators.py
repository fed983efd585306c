"""Properties of the private-data operators on small inputs."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from veil.functions import bits, crypto
from veil.operators import dp, oarray, omap, ordering, partition, sampling, trace


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_osort_is_a_sorted_permutation(spark):
    r = random.Random(1)
    rows = [(r.randrange(50), i, f"payload{i}") for i in range(700)]
    out = ordering.osort(frame(spark, rows, "k long, i long, p string"), ["k", "i"]).orderBy("rk").collect()
    assert [(x.k, x.i, x.p) for x in out] == sorted(rows) and [x.rk for x in out] == list(range(1, 701))


def test_shuffles_are_permutations(spark):
    df = spark.range(0, 30_000_000, 100_000)
    for out in (ordering.oshuffle(df, 5), ordering.shuffle_by_key(df, "id")):
        got = out.orderBy("pos").collect()
        ids = [x.id for x in got]
        assert sorted(ids) == list(range(0, 30_000_000, 100_000)) != ids
        assert [x.pos for x in got] == list(range(1, 301))


def test_empty_inputs(spark):
    df = frame(spark, [], "k long, v double")
    assert ordering.osort(df, ["k"]).count() == 0
    assert ordering.is_sorted(df, ["k"], "v").first() == (0, 0)
    assert omap.bulk_build(df, "k").count() == 0
    assert trace.cache_lru(df, "k", F.col("k"), 4).first().hits == 0


def test_sortedness(spark):
    df = frame(spark, [(i, float(v)) for i, v in enumerate([1, 2, 2, 1, 5, 4, 9])], "i long, v double")
    assert tuple(ordering.is_sorted(df, ["i"], "v").first()) == (2, 7)


def test_compact_keeps_order(spark):
    rows = [(i, i % 3 == 0) for i in range(100)]
    out = partition.compact(frame(spark, rows, "i long, m boolean"), F.col("m"), "i").orderBy("pos").collect()
    assert [x.i for x in out] == [i for i, m in rows if m] + [i for i, m in rows if not m]
    assert [x.marked_pos for x in out if x.m] == list(range(34)) and all(x.marked_pos is None for x in out if not x.m)


@pytest.mark.parametrize("ways", [3, 5, 8])
def test_interleave_reads_marks_in_turn(spark, ways):
    n = 16 * ways
    marks = [i % ways for i in range(n)]
    random.Random(ways).shuffle(marks)
    out = partition.interleave(frame(spark, [(i, m) for i, m in enumerate(marks)], "i long, m long"), F.col("m"), ways, ["i"]).orderBy("pos").collect()
    assert [x.m for x in out] == [i % ways for i in range(n)]


def test_merge_split_fills_and_overflows(spark):
    df = frame(spark, [(i,) for i in range(20)], "i long")
    out = partition.merge_split(df, "i", F.col("i") % 2, 2, 16)
    assert out.count() == 32 and out.filter("i is not null").count() == 20
    with pytest.raises(Exception, match="bucket overflow"):
        partition.merge_split(df, "i", F.col("i") % 2, 2, 8).collect()


def test_transpose_twice_is_identity(spark):
    df = frame(spark, [(i,) for i in range(48)], "i long")
    once = partition.transpose(df, F.col("i"), 6, 8)
    twice = partition.transpose(once, F.col("pos"), 8, 6, pos="back")
    assert twice.filter("back <> i").count() == 0


def test_rotation_every_shift(spark):
    for n in (1, 5, 13):
        values = list(range(n))
        df = frame(spark, [(values,)], "v array<int>")
        for shift in range(n + 1):
            assert df.select(partition.rotate_array(F.col("v"), shift).alias("r")).first().r == values[shift % n :] + values[: shift % n]


def test_quantiles_and_pivots(spark):
    r = random.Random(3)
    rows = [(r.random(), i) for i in range(101)]
    df = frame(spark, rows, "v double, i long")
    picks = sampling.quantile_pick(df, ["v", "i"], 4).orderBy("k").collect()
    assert [(x.v, x.i) for x in picks] == [sorted(rows)[101 * k // 4] for k in (1, 2, 3)]
    out = partition.distribute_by_pivots(df, df, ["v", "i"], 4).collect()
    cut = [sorted(rows)[101 * k // 4] for k in (1, 2, 3)]
    assert all(x.part == sum(c < (x.v, x.i) for c in cut) for x in out)
    assert sampling.exact_size(df, 10, 1).count() == 10


SEQUENCES = [list(range(100)), [1, 3, 2, 10], [3, 1, 2, 100], [3, 2, 5, 1, 4, 6, 8, 7, 100], [2, 1, 6, 4, 7, 5, 10], [5, 2, 6, 1, 3, 4, 100], [2, 1, 5, 4, 6, 3, 100], [8, 3, 10, 2, 5, 9, 11, 1, 4, 7, 6, 100]]


@pytest.mark.parametrize("keys", SEQUENCES)
def test_map_build_get_and_balance(spark, keys):
    df = frame(spark, [(k, 10.0 * k, i) for i, k in enumerate(keys)], "k long, v double, seq long")
    tree = omap.bulk_build(df, "k").collect()
    ordered = sorted(keys)
    at = {x.k: x for x in tree}
    assert max(x.depth for x in tree) <= omap.depth_budget(len(keys))

    def height(i):
        if i is None:
            return 0
        x = at[ordered[i]]
        l, r = height(x.left_idx), height(x.right_idx)
        assert x.balance == (omap.RIGHT if r > l else omap.BALANCED) and abs(l - r) <= 1
        return 1 + max(l, r)

    height((len(keys) - 1) // 2)
    got = omap.get_many(frame(spark, [(k,) for k in [*keys, -7]], "p long"), "p", df, "k", "v").collect()
    assert all((x.contained, x.v) == ((True, 10.0 * x.k) if x.k in keys else (False, None)) for x in got)


def test_replay_and_upsert_match_a_dictionary(spark):
    r = random.Random(9)
    log = [(i, r.randrange(8), r.random() < 0.5, float(i)) for i in range(200)]
    df = frame(spark, log, "seq long, k long, ins boolean, v double")
    state, want = {}, {}
    for seq, k, ins, v in log:
        if ins:
            state[k] = v
        else:
            want[seq] = state.get(k)
    got = omap.replay(df, "k", "seq", F.col("ins"), "v").collect()
    assert {x.seq: x.v for x in got} == want
    assert {x.k: x.v for x in omap.upsert_many(df.filter("ins"), "k", "v", "seq").collect()} == state
    assert {x.address: x.v for x in oarray.read_all(df.filter("ins"), F.col("k"), "v", "seq", 10, -1.0).collect()} == {a: state.get(a, -1.0) for a in range(10)}


def test_membership(spark):
    members = frame(spark, [(x,) for x in (213, 410, 829)], "u long")
    probes = frame(spark, [(x,) for x in (213, 410, 829, 122, 251, 451, 751, 213)], "p long")
    assert {x.p: x.registered for x in omap.registered(probes, "p", members, "u").collect()} == {213: 1, 410: 1, 829: 1, 122: 0, 251: 0, 451: 0, 751: 0}


def test_eviction_matches_the_greedy_model(spark):
    r = random.Random(4)
    levels, z, path = 5, 2, 19
    blocks = [(i, r.randrange(32)) for i in range(40)]
    got = {x.a: x.level for x in trace.evict_path(frame(spark, blocks, "a long, p long"), "a", F.col("p"), path, levels, z).collect()}
    left = sorted(((p ^ path).bit_length(), a) for a, p in blocks)
    want, free = {}, [z] * (levels + 1)
    for tag, a in left:
        level = levels - tag
        while level >= 0 and not free[level]:
            level -= 1
        want[a] = level
        if level >= 0:
            free[level] -= 1
    assert got == want


def test_caches(spark):
    r = random.Random(6)
    pages = [int(r.paretovariate(1)) % 40 for _ in range(900)]
    df = frame(spark, list(enumerate(pages)), "t long, pg long")
    lru, hits = OrderedDict(), 0
    for p in pages:
        hits += p in lru
        lru[p] = None
        lru.move_to_end(p)
        if len(lru) > 7:
            lru.popitem(last=False)
    assert trace.cache_lru(df, "t", F.col("pg"), 7, chunk=64).first().hits == hits
    slots, direct = {}, 0
    for p in pages:
        direct += slots.get(p % 7) == p
        slots[p % 7] = p
    assert tuple(trace.cache_direct_mapped(df, "t", F.col("pg"), 7).first()) == (900, direct)


def test_allocator_reuses_the_best_hole(spark):
    ops = [("g", 0, "alloc", "a", 10), ("g", 1, "alloc", "b", 4), ("g", 2, "alloc", "c", 6), ("g", 3, "alloc", "d", 1), ("g", 4, "free", "a", 0), ("g", 5, "free", "c", 0), ("g", 6, "alloc", "e", 5), ("g", 7, "free", "b", 0), ("g", 8, "alloc", "f", 14)]
    out = trace.allocate(frame(spark, ops, "g string, s long, op string, n string, z long"), "g", "s", "op", "n", "z")
    assert {x.n: x.offset for x in out.collect()} == {"a": 0, "b": 10, "c": 14, "d": 20, "e": 14, "f": 0}


def test_knapsack_matches_the_table(spark):
    r = random.Random(2)
    items = [(g, r.randint(1, 30), float(r.randint(1, 100))) for g in range(12) for _ in range(r.randint(1, 9))]
    got = {x.g: x.best for x in dp.knapsack(frame(spark, items, "g long, w long, v double"), "g", F.col("w"), F.col("v"), 40).collect()}
    for g in range(12):
        best = [0.0] * 41
        for _, w, v in (x for x in items if x[0] == g):
            best = [max(best[c], best[c - w] + v) if c >= w else best[c] for c in range(41)]
        assert got[g] == best[40]


def test_bits(spark):
    xs = [0, 1, 2, 3, 4, 7, 8, 255, 256, 2**40 + 5, 2**62]
    df = frame(spark, [(x,) for x in xs], "x long")
    out = df.select("x", bits.bit_length(F.col("x")).alias("b"), bits.reversed_bits(F.col("x"), 8).alias("r"), bits.reverse_lexicographic(F.col("x"), 8).alias("l")).collect()
    for row in out:
        back = int(f"{row.x % 256:08b}"[::-1], 2)
        assert (row.b, row.r, row.l) == (row.x.bit_length(), back, 255 - back)
    one = spark.range(1).select(bits.large_mod(F.lit("123456789012345678901234567890"), 97).alias("m"), bits.product(F.array(F.lit(3).cast("long"), F.lit(4).cast("long"))).alias("p")).first()
    assert tuple(one) == (123456789012345678901234567890 % 97, 12)


def test_sealed_values_open_only_unchanged(spark):
    key = bytes(range(32))
    df = frame(spark, [(i, f"value {i}") for i in range(20)], "i long, v string").withColumn("c", crypto.seal(F.col("v"), key, F.col("i"), 3))
    assert df.filter(crypto.unseal(F.col("c"), key, F.col("i"), 3).cast("string") != F.col("v")).count() == 0
    assert df.filter(crypto.unseal(F.col("c"), key, F.col("i"), 2).isNotNull()).count() == 0
    assert df.filter(crypto.unseal(F.col("c"), key, F.col("i") + 1, 3).isNotNull()).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 40, 300])
def test_global_order_over_many_ranges(spark, parts):
    """Ranks, ranks within hot groups, neighbours and carried values against plain lists, for searches of several steps."""
    import random

    from veil.plans.global_order import GlobalOrder

    r = random.Random(parts)
    rows = [(r.choice(["hot", "hot", "hot", *"abcdef"]), r.choice([0.5, -1.5, float("inf"), r.random()]), i, r.choice([None, None, i])) for i in range(700)]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "g string, x double, i long, v long").repartition(3)
        order = GlobalOrder(df, ["g", F.col("x"), "i"]).add_rank("rank").add_rank_within("g", "within", start=0)
        got = {x.i: (x.rank, x.within) for x in order.frame().collect()}
        if parts == 300:  # the ranges are those of the others
            assert got == {row[2]: (rank, sum(x[0] == row[0] and x[:3] < row[:3] for x in rows)) for rank, row in enumerate(sorted(rows, key=lambda x: x[:3]), 1)}
            return
        carried = {x.i: x.last for x in GlobalOrder(df, ["g", "x", "i"]).last_before(F.col("v"), "g", "last").collect()}
        previous = {x.i: x.prev for x in GlobalOrder(df, ["g", "x", "i"]).previous("i", "prev").collect()}
        top = {x.i: x.top for x in GlobalOrder(df, ["g", "x", "i"]).running_max(F.col("i"), "top").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    within, last, most, prev = {}, {}, -1, None
    for rank, (g, _, i, v) in enumerate(sorted(rows, key=lambda x: x[:3]), 1):
        assert got[i] == (rank, within.get(g, 0)) and carried[i] == last.get(g) and previous[i] == prev
        within[g], prev, most = within.get(g, 0) + 1, i, max(most, i)
        last[g] = v if v is not None else last.get(g)
        assert top[i] == most
    assert GlobalOrder(df.limit(0), ["i"]).ranked("rank").count() == 0


def test_log_of_deletes_and_shadow(spark):
    log = spark.createDataFrame([("a", 1, 1, False), ("a", 2, 2, True), ("b", 3, 1, True), ("b", 4, 2, False), ("c", None, 1, False), ("d", 5, 1, True), ("d", 5, 2, True)], "k string, v int, s long, gone boolean")
    held = omap.apply_log(log, "k", "v", "s", F.col("gone"))
    assert sorted((x.k, x.v) for x in held.collect()) == [("b", 4), ("c", None)]
    assert omap.differences(held, held, "k").count() == 0
    shadow = spark.createDataFrame([("b", 4), ("c", 1), ("e", None)], "k string, v int")
    assert sorted((x.k, x.answer, x.shadow) for x in omap.differences(held, shadow, "k").collect()) == [("c", None, 1), ("e", None, None)]


def test_ring_accesses_by_simulation(spark):
    """Counters of every bucket, renewed by whole reads and by evictions, access by access."""
    import random

    r = random.Random(9)
    levels, every, spare = 4, 3, 2
    paths = [r.randrange(2**levels) for _ in range(120)]
    counter, turn, want = {}, 0, {}
    for t, p in enumerate(paths):
        for d in range(levels + 1):
            idx = 2**d - 1 + (p >> (levels - d))
            want[t, idx] = counter.get(idx, 0) >= spare
            counter[idx] = 0 if want[t, idx] else counter.get(idx, 0) + 1
        if (t + 1) % every == 0:
            leaf = 2**levels - 1 - int(f"{turn % 2**levels:0{levels}b}"[::-1], 2)
            turn += 1
            for d in range(levels):
                counter[2**d - 1 + (leaf >> (levels - d))] = 0
    df = spark.createDataFrame(list(enumerate(paths)), "t long, p long")
    got = {(x.t, x.idx): x.whole for x in trace.ring_schedule(df, "t", F.col("p"), levels, every, spare).collect()}
    assert got == want and any(want.values())
