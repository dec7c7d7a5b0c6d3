"""Programs through the context and the message library, with the closed forms of small cases."""

import pytest
from pyspark.sql import functions as F

from tidestep.functions import reducers
from tidestep.operators import collectives, context, lists, messages, move
from tidestep.sources.tables import processes
from tidestep.streaming import supersteps

c = F.col


def cells(df):
    return {(r.pid, r.slot, r.off): r.val for r in df.collect()}


@pytest.mark.parametrize("p", [1, 2, 3, 5])
def test_ring(spark, p):
    ctx = context.BspContext(spark, p, max_slots=2)
    x = ctx.register(ctx.procs.select("pid", F.lit(0).alias("off"), (c("pid") + 5).alias("val")))
    y = ctx.register(ctx.procs.select("pid", F.lit(0).alias("off"), F.lit(10).alias("val")))
    assert (x, y) == (0, 2)
    ctx.put(ctx.procs, c("pid"), (c("pid"), x, 0), ((c("pid") + 1) % p, y, 0))
    after = cells(ctx.sync())
    assert all(after[i, y, 0] == (i - 1) % p + 5 and after[i, x, 0] == i + 5 for i in range(p))


def test_capacity_and_failure(spark):
    ctx = context.BspContext(spark, 2, max_slots=0, max_messages=1)
    with pytest.raises(context.BspOutOfMemory):
        ctx.register(ctx.procs.select("pid", F.lit(0).alias("off"), F.lit(1).alias("val")))
    ctx.resize_memory_register(1)
    ctx.sync()
    s = ctx.register(ctx.procs.select("pid", F.lit(0).alias("off"), F.lit(1).alias("val")))
    with pytest.raises(context.BspFatal):
        ctx.request(None, attr="other")
    ctx.put(ctx.procs, c("pid"), (c("pid"), s, 0), (1 - c("pid"), s, 0))
    with pytest.raises(context.BspFatal):
        ctx.sync()
    with pytest.raises(context.BspFatal):
        ctx.sync()


def test_exec_has_registers_of_its_own(spark):
    ctx = context.BspContext(spark, 4, max_slots=1)
    ctx.register(ctx.procs.select("pid", F.lit(0).alias("off"), F.lit(1).alias("val")))
    assert ctx.rehook(lambda child, procs, args: (procs.count(), child.slots, args), 7) == (4, {}, 7)
    assert ctx.exec(lambda child, procs, args: procs.count(), nprocs=9) == 4


def test_library(spark):
    lib = context.BspLib(spark, 3)
    area = lambda v: lib.procs.select("pid", F.lit(0).alias("off"), F.lit(v).alias("val"))
    lib.push_reg("x", area(1))
    with pytest.raises(context.BspError):
        lib.slot("x")
    lib.sync()
    lib.push_reg("x", area(2))
    lib.push_reg("z", area(0))
    assert lib.set_tagsize(10) == 0 and lib.set_tagsize(4) == 0
    lib.send(lib.procs, c("pid"), F.lit(0), c("pid"), F.lit("tag").cast("binary"), F.lit("abcd"))
    lib.sync()
    assert lib.tag_size == 4 and lib.slot("x") != 0
    assert {r.pid: (r.n, r.bytes) for r in lib.qsize().collect()} == {0: (3, 12), 1: (0, 0), 2: (0, 0)}
    assert {r.pid: r.status for r in lib.get_tag().collect()} == {0: 4, 1: -1, 2: -1}
    assert sorted(r.payload for r in lib.moved(2).collect()) == [b"ab"] * 3  # bytes, as they are copied
    lib.get_from(lib.procs, F.lit(9), ((c("pid") + 1) % 3, "x", 0), (c("pid"), "z", 0))
    lib.put_to(lib.procs.where("pid = 0"), F.lit(1), (0, "z", 0), (0, "z", 0))
    lib.pop_reg("x")
    z = lib.slot("z")
    after = cells(lib.sync())
    assert (after[0, z, 0], after[1, z, 0], after[2, z, 0]) == (0, 2, 2)
    assert lib.slot("x") == 0
    with pytest.raises(context.BspError):
        lib.qsize()


def test_ordered_fold_and_intervals(spark):
    df = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "pid int, val string")
    fold = reducers.ordered_fold(c("val"), c("pid"), F.lit(""), F.concat)
    assert df.agg(fold.alias("v")).first().v == "abc"
    assert abs(reducers.normal_interval(0.95) - 1.959964) < 1e-5


def test_random_list_is_a_permutation(spark):
    nodes = {r.id: r for r in lists.random_list(spark, 300, seed=4).collect()}
    at, seen = next(i for i, r in nodes.items() if r.prev is None), []
    while at is not None:
        seen.append(at)
        at = nodes[at].next
    assert sorted(seen) == list(range(300)) and seen != sorted(seen)


def test_random_bags_against_a_simulator(spark):
    import random

    r = random.Random(6)
    mem = {(p, s, o): r.randrange(100) for p in range(3) for s in (0, 2) for o in range(12)}
    bag = [(r.randrange(2), i, r.randrange(3), 0, r.randrange(10), r.randrange(3), 2, r.randrange(10), r.randrange(5)) for i in range(60)]
    m = spark.createDataFrame([(*k, v) for k, v in mem.items()], "pid int, slot int, off long, val long")
    inside = [b for b in bag if b[4] + b[8] <= 12 and b[7] + b[8] <= 12]
    want = dict(mem)
    for _, _, sp, ss, so, dp, ds, do, n in sorted(inside):
        for i in range(n):
            want[dp, ds, do + i] = mem[sp, ss, so + i]
    b = spark.createDataFrame(inside, "phase int, seq long, src_pid int, src_slot int, src_off long, dst_pid int, dst_slot int, dst_off long, size long")
    assert cells(move.sync(m, b)) == want


def test_empty_processes_and_queries(spark):
    none = spark.createDataFrame([], "pid int, off long, val long")
    procs = processes(spark, 3)
    assert [r.n for r in collectives.local_count(none, procs).collect()] == [0, 0, 0]
    assert [r.val for r in collectives.scan(none, procs).orderBy("pid").collect()] == [None] * 3
    q = messages.send(spark.createDataFrame([], "a int, b int, s long, t string, p string"), c("a"), c("b"), c("s"), c("t"), c("p"))
    assert {r.status for r in messages.peeked(q, procs).collect()} == {-1}


def test_stream_of_supersteps(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k * 10 + i, i % 2, k) for i in range(4)], "seq long, cell int, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq long, cell int, v int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    steps = []
    supersteps.run_supersteps(stream, lambda bag, n: steps.append((n, bag.count())), f"{tmp_path}/ck").awaitTermination(120)
    assert sorted(n for n, _ in steps) == [0, 1, 2] and sum(k for _, k in steps) == 12


def test_messages_are_consumed(spark):
    with context.BspLib(spark, 2) as lib:
        rows = spark.createDataFrame([(0, 1, 1, "aé"), (0, 1, 2, "b"), (1, 1, 3, "ccc"), (1, 0, 4, "d")], "src int, dst int, seq long, payload string")
        lib.send(rows, c("src"), c("dst"), c("seq"), F.lit("t"), c("payload"))
        lib.sync()
        assert {r.dst_pid: bytes(r.payload) for r in lib.move(2).collect()} == {0: b"d", 1: b"b"}
        assert {r.pid: (r.n, r.bytes) for r in lib.qsize().collect()} == {0: (0, 0), 1: (2, 6)}
        assert [(r.seq, r.tag, r.payload) for r in lib.hpmove(5).orderBy("place").collect()] == [(1, "t", "aé"), (3, "t", "ccc")]
        assert {r.pid: r.status for r in lib.get_tag().collect()} == {0: -1, 1: -1}
    with pytest.raises(context.BspFatal), context.BspLib(spark, 2) as lib:
        lib.push_reg("x", lib.procs.select("pid", F.lit(0).alias("off"), F.lit(1).alias("val")))


def test_probe_and_saved_samples(spark, tmp_path):
    from tidestep.operators import cost

    curve = spark.createDataFrame([(1, 10.0, 5.0), (9, 2.0, 13.0)], "block long, g double, l double")
    got = context.BspContext(spark, 3).probe(curve, spark.createDataFrame([(0,), (5,), (99,)], "size long")).orderBy("size").collect()
    assert [(r.size, r.cost_g, r.cost_l, r.p) for r in got] == [(0, 10.0, 5.0, 3), (5, 6.0, 9.0, 3), (99, 2.0, 13.0, 3)]
    for part in (curve.limit(1), curve.where("block = 9")):
        cost.save_samples(part, f"{tmp_path}/samples")
    assert cost.load_samples(curve, f"{tmp_path}/samples").count() == 2


def test_abort_guards_and_sentinels(spark):
    from tidestep.sources.tables import hooked

    ctx = context.BspContext(spark, 2)
    with pytest.raises(context.BspFatal, match="enough"):
        ctx.abort("enough")
    with pytest.raises(context.BspFatal):
        ctx.sync()
    for program, n in ((None, 2), (lambda *_: 0, 0), (lambda *_: 0, -1)):
        with pytest.raises(context.BspFatal):
            context.BspContext(spark, 2).exec(program, nprocs=n)
    with pytest.raises(ValueError):
        hooked(ctx.procs, c("pid"), 0)
    assert (context.ROOT, context.INVALID_SIZE, context.INVALID_SLOT, context.NONE) == (0, -1, -1, None)


def test_remote_query_and_unbuffered_sends(spark):
    lib = context.BspLib(spark, 3)
    asked = lib.procs.select("pid", c("pid").cast("long").alias("seq"), F.lit("q").alias("tag"), c("pid").cast("string").alias("payload"))
    got = lib.query(asked, lambda m: m.withColumn("payload", F.concat(F.lit("you said "), "payload"))).collect()
    assert sorted((r.src_pid, r.dst_pid, r.payload) for r in got) == [(0, i, f"you said {i}") for i in range(3)]
    lib.hpsend(lib.procs, c("pid"), F.lit(2), c("pid"), F.lit("t"), F.lit("x"))
    lib.sync()
    assert {r.pid: r.n for r in lib.qsize().collect()} == {0: 0, 1: 0, 2: 3}
