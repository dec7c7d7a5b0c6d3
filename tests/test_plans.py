"""Every registered query of the bulk-synchronous operators against its SQL."""

import os

import pytest
from oracle import compare

from tidestep.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, name):
    compare(spark, name, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)


def test_each_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLE_SQL.keys()


def test_bulk_insertion_at_the_ends_and_before_one_node(spark):
    from tidestep.operators import lists

    nodes = spark.createDataFrame([(1, None, 2), (2, 1, 3), (3, 2, None)], "id long, prev long, next long")
    new = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (21, 2), (22, 2), (30, None), (31, None), (40, 99)], "id long, before long")
    got = {r.id: (r.prev, r.next) for r in lists.insert_before(nodes, new).collect()}
    order = [10, 11, 1, 20, 21, 22, 2, 3, 30, 31]
    assert got == {x: (a, b) for a, x, b in zip([None, *order], order, [*order[1:], None])}


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_each_row_is_scattered_and_exchanged(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey")
    block, most = (f(spark, SF) for f in (registry.QUERIES["scatter_whole"], registry.QUERIES["alltoall_whole"]))
    size = c.agg({"c_custkey": "max"}).first()[0] // 8 + 1
    # The root's own block, and the diagonal, stay where they are.
    assert block.count() == c.where(f"c_custkey div {size} <> 4").count()
    x = c.selectExpr("c_custkey % 8 AS pid", "c_custkey div 8 AS off")
    size = x.agg({"off": "max"}).first()[0] // 8 + 1
    assert most.count() == x.where(f"off div {size} <> pid").count()


def test_ranking_rejects_cycles_and_pointers_to_nothing(spark):
    from tidestep.operators import lists

    make = lambda rows: spark.createDataFrame(rows, "id long, next long")
    with pytest.raises(ValueError, match="not in the list"):
        lists.list_rank(make([(1, 2), (2, 9), (3, None)]))
    with pytest.raises(ValueError, match="cycle"):
        lists.list_rank(make([(1, 2), (2, 1), (3, None)]))
    assert lists.list_rank(make([])).count() == 0


def test_ranking_by_contraction(spark):
    import random

    from tidestep.operators import lists

    order = [*range(500)]
    random.Random(4).shuffle(order)
    nodes = spark.createDataFrame([*zip(order, [*order[1:], None])], "id long, next long")
    for short in (1000, 40):
        assert {r.id: r["rank"] for r in lists.list_rank(nodes, short=short).collect()} == {x: i for i, x in enumerate(order)}


def test_bytes_are_cut_and_a_refused_message_leaves_room(spark):
    from tidestep.operators import messages

    q = spark.createDataFrame([(0, 1, 1, "t", "éé日本"), (0, 1, 2, "t", "x" * 90), (0, 1, 3, "t", "abc")], "src_pid int, dst_pid int, seq long, tag string, payload string")
    q = messages.send(q, q.src_pid, q.dst_pid, q.seq, q.tag, q.payload)
    assert {r.seq: (bytes(r.payload), r.length) for r in messages.moved(q, 5).collect()}[1] == ("éé日".encode()[:5], 10)
    assert [(r.used, r.full) for r in messages.full_flags(q, 40).orderBy("seq").collect()] == [(19, False), (19, True), (31, False)]


def test_machine_parameters_of_four_relations(spark):
    from tidestep.operators import cost

    t = spark.createDataFrame([(1, h, x) for h, x in ((0, 5.0), (1, 9.0), (2, 12.0), (4, 20.0), (4, 25.0))], "block long, h long, t double")
    assert [tuple(r) for r in cost.machine_parameters(t).collect()] == [(1, 4.0, 6.0)]
    assert cost.bsp_parameters(1.0, 10.0, 14.0, 54.0, 8.0, 4, 12) == {"t0": 1.0, "g": 1.0, "L": 6.0, "r": 8.0 / 48}


def test_a_release_meets_one_row_however_often_its_name_was_pushed(spark):
    import threading

    from tidestep.operators import checks

    rows = spark.range(400_000)
    pushes = rows.selectExpr("0 AS pid", "'a' AS ident", "2 * id + 2 AS step", "id AS depth")
    pops = rows.selectExpr("2 * id + 1 AS step", "0 AS pid", "id AS seq", "'a' AS ident")
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)  # all pairs, 1.6e11, take far longer
    late.start()
    got = [tuple(r) for r in checks.unequal_pops(pops, pushes).collect()]
    late.cancel()
    assert got == [(1, 1, 1)]


def test_releases_of_names_never_pushed_pushed_later_or_without_a_depth(spark):
    from tidestep.operators import checks

    pushes = spark.createDataFrame([(0, "a", 1, 7), (0, "a", 3, 9), (0, "b", 2, 8), (0, "c", 0, None), (None, "a", 0, 5)], "pid int, ident string, step long, depth long")
    pops = [(1, 0, 1, "a"), (2, 0, 2, "a"), (2, 0, 3, "b"), (3, 0, 4, "b"), (3, 0, 5, "b"), (4, 0, 6, "c"), (5, 0, 7, "z"), (6, None, 8, "a"), (7, 0, 9, None), (8, 0, 10, "a"), (8, 0, 10, "a"), (9, 1, 11, "a"), (9, 0, 12, "b")]
    got = sorted(tuple(r) for r in checks.unequal_pops(spark.createDataFrame(pops, "step long, pid int, seq long, ident string"), pushes).collect())
    assert got == [(1, 1, 1), (2, 2, 1), (4, 1, 1), (5, 1, 1), (6, 1, 1), (7, 1, 1), (9, 1, 1)]
