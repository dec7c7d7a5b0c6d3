"""Queries of the bulk-synchronous operators over the test tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestep.functions import reducers
from tidestep.operators import checks, collectives, cost, lists, messages, move, registration
from tidestep.sources.tables import cents, hooked, owned, processes, table

P = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str):
    """Registers a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- relations that several queries share, in both forms ----

SQL_PROCS = f"SELECT CAST(range AS INTEGER) AS pid FROM range({P})"
SQL_CUSTOMER = f"SELECT CAST(c_custkey % {P} AS INTEGER) AS pid, c_custkey // {P} AS off, CAST(round(c_acctbal * 100) AS BIGINT) AS val FROM customer"
SQL_EVENT_BAG = """SELECT 1 AS phase, event_id AS seq, CAST(event_id % 8 AS INTEGER) AS src_pid, 0 AS src_slot, event_id // 8 AS src_off,
  CAST(user_id % 8 AS INTEGER) AS dst_pid, 2 AS dst_slot, (user_id * 7) % 64 AS dst_off, 1 + event_id % 4 AS size FROM events"""
SQL_EVENT_MEM = """SELECT CAST(event_id % 8 AS INTEGER) AS pid, 0 AS slot, event_id // 8 AS off, CAST(round(value * 100) AS BIGINT) AS val FROM events
  UNION ALL SELECT CAST(p.range AS INTEGER), 2, o.range, 0 FROM range(8) p, range(80) o"""


def customers(spark, d) -> DataFrame:
    return owned(table(spark, d, "customer"), "c_custkey", cents("c_acctbal"), P)


def event_bag(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return move.put(e, c("event_id"), (c("event_id") % P, 0, F.expr(f"event_id div {P}")), (c("user_id") % P, 2, c("user_id") * 7 % 64), 1 + c("event_id") % 4)


def cells(spark, slot: int, n: int) -> DataFrame:
    return processes(spark, P).select("pid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("off")).select("pid", F.lit(slot).alias("slot"), c("off").cast("long").alias("off"), F.lit(0).cast("long").alias("val"))


def event_mem(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return move.memory(e, c("event_id") % P, 0, F.expr(f"event_id div {P}"), cents("value")).unionByName(cells(spark, 2, 80))


def sync_sql(mem: str, bag: str, out: str = "SELECT pid, slot, off, val FROM after") -> str:
    return f"""
WITH m AS ({mem}), b AS ({bag}),
e AS (SELECT phase, seq, src_pid, src_slot, src_off + i AS src_off, dst_pid, dst_slot, dst_off + i AS dst_off FROM (SELECT *, unnest(range(CAST(size AS BIGINT))) AS i FROM b)),
w AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY dst_pid, dst_slot, dst_off ORDER BY phase DESC, seq DESC) = 1),
after AS (
  SELECT m.pid, m.slot, m.off, CASE WHEN o.pid IS NULL THEN m.val ELSE o.val END AS val
  FROM m LEFT JOIN w ON m.pid = w.dst_pid AND m.slot = w.dst_slot AND m.off = w.dst_off
  LEFT JOIN m o ON o.pid = w.src_pid AND o.slot = w.src_slot AND o.off = w.src_off)
{out}"""


# ---- processes ----


@query(f"SELECT CAST(n_nationkey % {P} AS INTEGER) AS pid, count(*) AS n FROM nation GROUP BY 1")
def hook_nations(spark, d):
    """Rows that exist already become the data of processes."""
    return hooked(table(spark, d, "nation"), c("n_nationkey"), P).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(n_regionkey AS INTEGER) AS pid, CAST(n.range AS INTEGER) AS sub_pid, (100 + 8 - n.range - 1) // 8 AS size FROM (SELECT DISTINCT n_regionkey FROM nation), range(8) n")
def nested_exec_sizes(spark, d):
    """Sizes of the parts of 100 processors, dealt round-robin over 8 inner processes, for each outer process."""
    outer = table(spark, d, "nation").select(c("n_regionkey").cast("int").alias("pid")).distinct()
    inner = processes(spark, P).withColumnRenamed("pid", "sub_pid")
    return outer.join(F.broadcast(inner)).select("pid", "sub_pid", F.expr(f"(100 + {P} - sub_pid - 1) div {P}").cast("long").alias("size"))


@query("SELECT pid, CAST(sum(val) AS BIGINT) AS val, count(DISTINCT sub_pid) AS inner FROM (SELECT CAST(c_nationkey % 8 AS INTEGER) AS pid, CAST(c_custkey % 5 AS INTEGER) AS sub_pid, CAST(round(c_acctbal * 100) AS BIGINT) AS val FROM customer) GROUP BY 1")
def nested_exec_sum(spark, d):
    """Each process runs a subgroup of five over its customers, which adds up their balances."""
    own = hooked(table(spark, d, "customer"), c("c_nationkey"), P).withColumn("val", cents("c_acctbal"))
    return collectives.reduce_nested(collectives.nested(own, c("c_custkey"), 5), "sum")


@query("""SELECT CAST(a.n_regionkey AS INTEGER) AS src_node, CAST(b.n_regionkey AS INTEGER) AS dst_node, count(*) AS n, count(*) FILTER (WHERE a.n_regionkey = b.n_regionkey) AS local
FROM events JOIN nation a ON event_id % 25 = a.n_nationkey JOIN nation b ON user_id % 25 = b.n_nationkey GROUP BY 1, 2""")
def node_routing(spark, d):
    """Two-level routing: messages between nodes, those that stay on a node told apart. The map of processes to nodes has 25 rows."""
    node = table(spark, d, "nation").select(c("n_nationkey").alias("pid"), c("n_regionkey").cast("int").alias("node"))
    e = table(spark, d, "events").select((c("event_id") % 25).alias("src"), (c("user_id") % 25).alias("dst"))
    a, b = node.withColumnsRenamed({"pid": "src", "node": "src_node"}), node.withColumnsRenamed({"pid": "dst", "node": "dst_node"})
    return e.join(F.broadcast(a), "src").join(F.broadcast(b), "dst").groupBy("src_node", "dst_node").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("src_node") == c("dst_node")).alias("local"))


# ---- one-sided requests and supersteps ----


@query(f"SELECT CAST(user_id % {P} AS INTEGER) AS pid, (user_id * 7) % 64 AS off, arg_max(CAST(round(value * 100) AS BIGINT), event_id) AS val, count(*) AS writers FROM events GROUP BY 1, 2")
def superstep_last_writer(spark, d):
    """Every event is a put; the last writer of each cell stays."""
    e = table(spark, d, "events")
    return e.groupBy((c("user_id") % P).cast("int").alias("pid"), (c("user_id") * 7 % 64).alias("off")).agg(F.max_by(cents("value"), "event_id").alias("val"), F.count(F.lit(1)).alias("writers"))


@query(sync_sql(SQL_EVENT_MEM, SQL_EVENT_BAG, "SELECT pid, off, val FROM after WHERE slot = 2"))
def sync_put(spark, d):
    """A superstep of puts of one to four elements, with conflicts."""
    return move.sync(event_mem(spark, d), event_bag(spark, d)).where("slot = 2").select("pid", "off", "val")


SQL_RING = f"""SELECT pid, 0 AS slot, off, val FROM ({SQL_CUSTOMER}) UNION ALL SELECT pid, 2, off, -val FROM ({SQL_CUSTOMER}) UNION ALL SELECT pid, 4, off, 0 FROM ({SQL_CUSTOMER})"""


def ring_mem(spark, d):
    x = customers(spark, d)
    parts = [x.select("pid", F.lit(s).alias("slot"), "off", v.cast("long").alias("val")) for s, v in ((0, c("val")), (2, -c("val")), (4, F.lit(0)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(sync_sql(SQL_RING, f"SELECT 1 AS phase, off * 8 + pid AS seq, pid AS src_pid, 0 AS src_slot, off AS src_off, (pid + 1) % 8 AS dst_pid, 4 AS dst_slot, off AS dst_off, 1 AS size FROM ({SQL_CUSTOMER})", "SELECT pid, off, val FROM after WHERE slot = 4"))
def sync_put_ring(spark, d):
    """Each process puts its array to the next."""
    x = customers(spark, d)
    bag = move.put(x, c("off") * P + c("pid"), (c("pid"), 0, c("off")), ((c("pid") + 1) % P, 4, c("off")))
    return move.sync(ring_mem(spark, d), bag).where("slot = 4").select("pid", "off", "val")


@query(sync_sql(SQL_RING, f"SELECT 0 AS phase, off * 8 + pid AS seq, (pid + 1) % 8 AS src_pid, 0 AS src_slot, off AS src_off, pid AS dst_pid, 4 AS dst_slot, off AS dst_off, 1 AS size FROM ({SQL_CUSTOMER})", "SELECT pid, off, val FROM after WHERE slot = 4"))
def sync_get_ring(spark, d):
    """Each process gets the array of the next."""
    x = customers(spark, d)
    bag = move.get(x, c("off") * P + c("pid"), ((c("pid") + 1) % P, 0, c("off")), (c("pid"), 4, c("off")))
    return move.sync(ring_mem(spark, d), bag).where("slot = 4").select("pid", "off", "val")


@query(sync_sql(SQL_RING, f"""SELECT 0 AS phase, off * 8 + pid AS seq, (pid + 1) % 8 AS src_pid, s AS src_slot, off AS src_off, pid AS dst_pid, s + 2 AS dst_slot, off AS dst_off, 1 AS size
  FROM ({SQL_CUSTOMER}), (SELECT unnest([0, 2]) AS s)"""))
def sync_chained_gets(spark, d):
    """x to y and y to z in one superstep: both read what was there before."""
    x, n = customers(spark, d), (c("pid") + 1) % P
    a = move.get(x, c("off") * P + c("pid"), (n, 0, c("off")), (c("pid"), 2, c("off")))
    b = move.get(x, c("off") * P + c("pid"), (n, 2, c("off")), (c("pid"), 4, c("off")))
    return move.sync(ring_mem(spark, d), a.unionByName(b))


@query(sync_sql(SQL_RING, f"""SELECT s AS phase, off * 8 + pid AS seq, pid AS src_pid, s * 2 AS src_slot, off AS src_off, (pid + 1 - s) % 8 AS dst_pid, 4 AS dst_slot, off - off % (1 + s) AS dst_off, 1 AS size
  FROM ({SQL_CUSTOMER}), (SELECT unnest([0, 1]) AS s)""", "SELECT pid, off, val FROM after WHERE slot = 4"))
def sync_put_beats_get(spark, d):
    """A get and a put to the same cell: the put stays."""
    x = customers(spark, d)
    a = move.get(x, c("off") * P + c("pid"), (c("pid"), 0, c("off")), ((c("pid") + 1) % P, 4, c("off")))
    b = move.put(x, c("off") * P + c("pid"), (c("pid"), 2, c("off")), (c("pid"), 4, c("off") - c("off") % 2))
    return move.sync(ring_mem(spark, d), a.unionByName(b)).where("slot = 4").select("pid", "off", "val")


@query(sync_sql("SELECT CAST(s.range AS INTEGER) AS pid, 0 AS slot, i.range AS off, i.range * 320 + s.range AS val FROM range(8) s, range(320) i UNION ALL SELECT CAST(s.range AS INTEGER), 2, i.range, 0 FROM range(8) s, range(320) i",
    "SELECT 0 AS phase, range AS seq, CAST(range AS INTEGER) AS src_pid, 0 AS src_slot, range * 20 AS src_off, 0 AS dst_pid, 2 AS dst_slot, range * 20 AS dst_off, (16 - 2 * range) * 20 AS size FROM range(8)", "SELECT off, val FROM after WHERE slot = 2 AND pid = 0"))
def sync_overlap_pyramid(spark, d):
    """Process 0 gets blocks k to 2P - k of each process k: overlapping writes, each block from one writer."""
    n = 2 * P * 20
    procs = processes(spark, P)
    own = procs.select("pid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("off"))
    mem = move.memory(own, c("pid"), 0, c("off"), c("off") * n + c("pid")).unionByName(move.memory(own, c("pid"), 2, c("off"), F.lit(0).cast("long")))
    bag = move.get(procs, c("pid"), (c("pid"), 0, c("pid") * 20), (0, 2, c("pid") * 20), (2 * P - 2 * c("pid")) * 20)
    return move.sync(mem, bag).where("slot = 2 AND pid = 0").select("off", "val")


@query(sync_sql(SQL_EVENT_MEM, SQL_EVENT_BAG.replace("1 + event_id % 4 AS size", "event_id % 2 AS size"), "SELECT pid, off, val FROM after WHERE slot = 2"))
def sync_zero_size(spark, d):
    """Requests of size zero do nothing."""
    bag = event_bag(spark, d).withColumn("size", c("seq") % 2)
    return move.sync(event_mem(spark, d), bag).where("slot = 2").select("pid", "off", "val")


@query(f"""
WITH a AS (SELECT pid, off, val FROM ({SQL_CUSTOMER})),
b AS (SELECT x.pid, x.off, coalesce(y.val, x.val) AS val FROM a x LEFT JOIN a y ON y.pid = (x.pid + 7) % 8 AND y.off = x.off)
SELECT x.pid, x.off, coalesce(y.val, x.val) AS val FROM b x LEFT JOIN b y ON y.pid = (x.pid + 7) % 8 AND y.off = x.off""")
def two_supersteps(spark, d):
    """The ring twice: the second superstep reads what the first one wrote."""
    x = customers(spark, d)
    mem = x.select("pid", F.lit(0).alias("slot"), "off", "val")
    bag = move.put(x, c("off"), (c("pid"), 0, c("off")), ((c("pid") + 1) % P, 0, c("off")))
    return move.sync(move.sync(mem, bag), bag).select("pid", "off", "val")


@query("""
WITH s AS (SELECT CAST(range AS INTEGER) AS pid, unnest([0, 2]) AS slot, unnest([0, 16]) AS base FROM range(8)),
b AS (SELECT event_id AS seq, CAST(user_id % 8 AS INTEGER) AS pid, CAST(2 * (event_id % 2) AS INTEGER) AS slot, user_id % 32 AS off, CAST(round(value * 100) AS BIGINT) AS val FROM events)
SELECT b.pid, b.off + s.base AS address, arg_max(b.val, b.seq) AS val, count(*) AS writers FROM b JOIN s ON b.pid = s.pid AND b.slot = s.slot GROUP BY 1, 2""")
def aliased_slots(spark, d):
    """Two slots of one region overlap: conflicts are found by address."""
    e = table(spark, d, "events")
    slots = processes(spark, P).select("pid", F.explode(F.array(F.struct(F.lit(0).alias("slot"), F.lit(0).alias("base")), F.struct(F.lit(2).alias("slot"), F.lit(16).alias("base")))).alias("s")).select("pid", "s.slot", F.lit(0).alias("region"), c("s.base").cast("long").alias("base"))
    bag = move.put(e, c("event_id"), (c("user_id") % P, 0, cents("value")), (c("user_id") % P, 2 * (c("event_id") % 2), c("user_id") % 32))
    won = move.winners(move.resolve(bag, slots))
    return won.select("pid", c("off").alias("address"), c("s.off").alias("val"), "writers")


# ---- collectives ----


def procs_of(spark):
    return processes(spark, P)


@query(f"SELECT p.pid, x.off, x.val FROM ({SQL_CUSTOMER}) x, ({SQL_PROCS}) p WHERE x.pid = 4 AND p.pid <> 4")
def broadcast(spark, d):
    return collectives.broadcast(customers(spark, d), procs_of(spark), P // 2)


@query(ORACLE_SQL["broadcast"])
def broadcast_tree(spark, d):
    return collectives.broadcast_tree(customers(spark, d), procs_of(spark), P // 2, P)


@query(f"SELECT 4 AS pid, pid * 100000000 + off AS off, val FROM ({SQL_CUSTOMER}) WHERE pid <> 4")
def gather(spark, d):
    return collectives.gather(customers(spark, d), 100000000, P // 2)


@query("SELECT CAST(c_custkey // 10 AS INTEGER) AS pid, c_custkey % 10 AS off, CAST(round(c_acctbal * 100) AS BIGINT) AS val FROM customer WHERE c_custkey < 80 AND c_custkey // 10 <> 4")
def scatter(spark, d):
    """Blocks of ten of an array on process 4."""
    root = table(spark, d, "customer").select(F.lit(4).alias("pid"), c("c_custkey").alias("off"), cents("c_acctbal").alias("val"))
    return collectives.scatter(root, 10, 4, P)


@query(f"SELECT p.pid, x.pid * 100000000 + x.off AS off, x.val FROM ({SQL_CUSTOMER}) x, ({SQL_PROCS}) p")
def allgather(spark, d):
    return collectives.allgather(customers(spark, d), procs_of(spark), 100000000)


@query(f"SELECT p.pid, x.pid * 100000000 + x.off AS off, x.val FROM ({SQL_CUSTOMER}) x, ({SQL_PROCS}) p WHERE p.pid <> x.pid")
def allgather_exclude_self(spark, d):
    return collectives.allgather(customers(spark, d), procs_of(spark), 100000000, exclude_self=True)


@query(f"""WITH x AS ({SQL_CUSTOMER}), n AS (SELECT p.pid, count(x.pid) AS n FROM ({SQL_PROCS}) p LEFT JOIN x ON x.pid = p.pid GROUP BY 1),
s AS (SELECT pid, coalesce(sum(n) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM n)
SELECT p.pid, CAST(s.start + x.off AS BIGINT) AS off, x.val FROM x JOIN s ON x.pid = s.pid, ({SQL_PROCS}) p""")
def allgatherv(spark, d):
    return collectives.allgatherv(customers(spark, d), procs_of(spark))


@query(f"SELECT CAST(off // 4 AS INTEGER) AS pid, pid * 4 + off % 4 AS off, val FROM ({SQL_CUSTOMER}) WHERE off < 32 AND off // 4 <> pid")
def alltoall_transpose(spark, d):
    return collectives.alltoall(customers(spark, d), 4, P)


def block_size(df: DataFrame) -> int:
    """Size of the least equal blocks, one for each process, that hold all of an array."""
    most = df.agg(F.max("off").alias("most")).first().most
    return 1 if most is None else most // P + 1


@query("""WITH s AS (SELECT max(c_custkey) // 8 + 1 AS size FROM customer)
SELECT CAST(c_custkey // size AS INTEGER) AS pid, c_custkey % size AS off, CAST(round(c_acctbal * 100) AS BIGINT) AS val FROM customer, s WHERE c_custkey // size <> 4""")
def scatter_whole(spark, d):
    """As ``scatter``, in blocks that hold the whole of the array."""
    root = table(spark, d, "customer").select(F.lit(4).alias("pid"), c("c_custkey").alias("off"), cents("c_acctbal").alias("val"))
    return collectives.scatter(root, block_size(root), 4, P)


@query(f"""WITH x AS ({SQL_CUSTOMER}), s AS (SELECT max(off) // 8 + 1 AS size FROM x)
SELECT CAST(off // size AS INTEGER) AS pid, pid * size + off % size AS off, val FROM x, s WHERE off // size <> pid""")
def alltoall_whole(spark, d):
    """As ``alltoall_transpose``, in blocks that hold the whole of each array."""
    own = customers(spark, d)
    return collectives.alltoall(own, block_size(own), P)


for _op, _sql in (("sum", "CAST(sum(val) AS BIGINT)"), ("min", "min(val)"), ("max", "max(val)"), ("xor", "bit_xor(val)")):

    def _reduce(spark, d, op=_op):
        return collectives.reduce(customers(spark, d), op, P // 2)

    def _allreduce(spark, d, op=_op):
        return collectives.allreduce(customers(spark, d), procs_of(spark), op)

    QUERIES |= {f"reduce_{_op}": _reduce, f"allreduce_{_op}": _allreduce}
    ORACLE_SQL |= {f"reduce_{_op}": f"SELECT 4 AS pid, {_sql} AS val FROM ({SQL_CUSTOMER})", f"allreduce_{_op}": f"SELECT p.pid, x.val FROM (SELECT {_sql} AS val FROM ({SQL_CUSTOMER})) x, ({SQL_PROCS}) p"}


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select((c("vec_id") % P).cast("int").alias("pid"), F.posexplode(c("embedding").cast("array<double>")).alias("off", "x")).select("pid", c("off").cast("long").alias("off"), F.round(c("x") * 1000000).cast("long").alias("val"))


SQL_COMBINE = """SELECT off, CAST(sum(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)) AS BIGINT) AS val
  FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS off FROM embeddings) GROUP BY off"""


@query(f"SELECT 4 AS pid, off, val FROM ({SQL_COMBINE})")
def combine_vector_add(spark, d):
    return collectives.combine(vectors(spark, d), "sum", P // 2)


@query(f"SELECT p.pid, off, val FROM ({SQL_COMBINE}), ({SQL_PROCS}) p")
def allcombine_vector_add(spark, d):
    return collectives.allcombine(vectors(spark, d), procs_of(spark), "sum")


@query("""SELECT p.pid, off, val FROM (SELECT off, CAST(max(abs(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT))) AS BIGINT) AS val
  FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS off FROM embeddings) GROUP BY off), (SELECT CAST(range AS INTEGER) AS pid FROM range(8)) p""")
def allcombine_user(spark, d):
    """A combiner of the user's own: the largest magnitude of each element."""
    return collectives.allcombine(vectors(spark, d), procs_of(spark), lambda v: F.max(F.abs(v)))


@query(f"SELECT CAST((pid - 1) // 3 AS INTEGER) AS pid, max(val) AS val, count(*) AS n FROM ({SQL_CUSTOMER}) WHERE pid >= 1 AND pid < 8 AND (pid - 1) % 3 = 0 GROUP BY 1")
def strided_max(spark, d):
    """The processes 1, 4 and 7 as a group with ranks of their own."""
    own = collectives.ranked(customers(spark, d), collectives.members(procs_of(spark), 1, 8, 3))
    return own.groupBy("pid").agg(F.max("val").alias("val"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT p.pid, CAST(sum(x.val) AS BIGINT) AS val FROM ({SQL_PROCS}) p JOIN ({SQL_CUSTOMER}) x ON x.pid <= p.pid GROUP BY 1")
def scan_inclusive(spark, d):
    return collectives.scan(customers(spark, d), procs_of(spark), "sum")


@query(f"SELECT p.pid, CAST(sum(x.val) AS BIGINT) AS val FROM ({SQL_PROCS}) p LEFT JOIN ({SQL_CUSTOMER}) x ON x.pid < p.pid GROUP BY 1")
def scan_exclusive(spark, d):
    return collectives.scan(customers(spark, d), procs_of(spark), "sum", exclusive=True)


@query(f"SELECT p.pid, (SELECT bool_or(val < 0) FROM ({SQL_CUSTOMER})) AS val FROM ({SQL_PROCS}) p")
def any_flag(spark, d):
    return collectives.any_flag(customers(spark, d), procs_of(spark), c("val") < 0)


SQL_SKEWED = "SELECT CAST((s_suppkey * s_suppkey) % 8 AS INTEGER) AS pid FROM supplier"


def skewed(spark, d):
    return table(spark, d, "supplier").select((c("s_suppkey") * c("s_suppkey") % P).cast("int").alias("pid"))


@query(f"SELECT p.pid, count(x.pid) AS n FROM ({SQL_PROCS}) p LEFT JOIN ({SQL_SKEWED}) x ON x.pid = p.pid GROUP BY 1")
def local_count(spark, d):
    return collectives.local_count(skewed(spark, d), procs_of(spark))


@query(f"SELECT max(n) - min(n) AS imbalance FROM (SELECT p.pid, count(x.pid) AS n FROM ({SQL_PROCS}) p LEFT JOIN ({SQL_SKEWED}) x ON x.pid = p.pid GROUP BY 1)")
def imbalance(spark, d):
    return collectives.imbalance(skewed(spark, d), procs_of(spark))


# ---- messages ----

SQL_QUEUE = """SELECT CAST(conv_id % 8 AS INTEGER) AS src_pid, CAST((conv_id + turn) % 8 AS INTEGER) AS dst_pid, conv_id * 100000 + turn AS seq, role AS tag, text AS payload,
  CAST(coalesce(strlen(text), 0) AS BIGINT) AS size FROM conversations"""


def queue(spark, d):
    t = table(spark, d, "conversations")
    return messages.send(t, c("conv_id") % P, (c("conv_id") + c("turn")) % P, c("conv_id") * 100000 + c("turn"), c("role"), c("text"))


@query(f"SELECT dst_pid, seq, row_number() OVER (PARTITION BY dst_pid ORDER BY src_pid, seq DESC) AS place FROM ({SQL_QUEUE})")
def bsmp_delivery_order(spark, d):
    return messages.delivered(queue(spark, d)).select("dst_pid", "seq", c("place").cast("long").alias("place"))


@query(f"SELECT p.pid, count(q.seq) AS n, CAST(coalesce(sum(q.size), 0) AS BIGINT) AS bytes FROM ({SQL_PROCS}) p LEFT JOIN ({SQL_QUEUE}) q ON q.dst_pid = p.pid GROUP BY 1")
def bsmp_qsize(spark, d):
    return messages.queue_size(queue(spark, d), procs_of(spark))


@query(f"SELECT p.pid, coalesce(q.size, -1) AS status, q.tag FROM ({SQL_PROCS}) p LEFT JOIN (SELECT * FROM ({SQL_QUEUE}) QUALIFY row_number() OVER (PARTITION BY dst_pid ORDER BY src_pid, seq DESC) = 1) q ON q.dst_pid = p.pid")
def bsmp_get_tag(spark, d):
    return messages.peeked(queue(spark, d), procs_of(spark))


@query(f"SELECT src_pid, dst_pid, seq, left(hex(encode(payload)), 80) AS bytes, coalesce(strlen(payload), 0) AS length FROM ({SQL_QUEUE})")
def bsmp_truncate(spark, d):
    """Payloads cut to forty bytes, which may cut a character."""
    return messages.moved(queue(spark, d), 40).select("src_pid", "dst_pid", "seq", F.hex("payload").alias("bytes"), "length")


SQL_MOVES = f"SELECT pid, 5 * pid AS n FROM ({SQL_PROCS})"
SQL_PLACED = f"SELECT *, row_number() OVER (PARTITION BY dst_pid ORDER BY src_pid, seq DESC) AS place FROM ({SQL_QUEUE})"


def moves(spark):
    return procs_of(spark).select("pid", (c("pid") * 5).alias("n"))


@query(f"SELECT q.dst_pid, q.seq FROM ({SQL_PLACED}) q JOIN ({SQL_MOVES}) m ON m.pid = q.dst_pid WHERE q.place > m.n")
def bsmp_consumed(spark, d):
    """What is left of the queue after process s has moved 5 s messages."""
    return messages.remaining(queue(spark, d), moves(spark)).select("dst_pid", "seq")


@query(f"SELECT q.dst_pid, q.place, q.seq, q.tag, strlen(q.payload) AS bytes FROM ({SQL_PLACED}) q JOIN ({SQL_MOVES}) m ON m.pid = q.dst_pid WHERE q.place <= m.n")
def bsmp_hpmove(spark, d):
    """The messages that those moves take."""
    out = messages.hp_moved(queue(spark, d), moves(spark))
    return out.select("dst_pid", c("place").cast("long").alias("place"), "seq", "tag", F.octet_length("payload").cast("long").alias("bytes"))


@query(f"SELECT p.pid, count(q.seq) AS n, CAST(coalesce(sum(q.size), 0) AS BIGINT) AS bytes FROM ({SQL_MOVES}) p LEFT JOIN ({SQL_PLACED}) q ON q.dst_pid = p.pid AND q.place > p.n GROUP BY 1")
def bsmp_qsize_after_moves(spark, d):
    """Messages and bytes that still wait after those moves."""
    return messages.queue_size(messages.remaining(queue(spark, d), moves(spark)), procs_of(spark))


@query(f"""WITH RECURSIVE q AS (SELECT src_pid, dst_pid, seq, 8 + coalesce(strlen(tag), 0) + size AS need, row_number() OVER (PARTITION BY src_pid, dst_pid ORDER BY seq) AS nth FROM ({SQL_QUEUE})),
f AS (SELECT src_pid, dst_pid, seq, nth, CASE WHEN need > 2000 THEN 0 ELSE need END AS used, need > 2000 AS "full" FROM q WHERE nth = 1
  UNION ALL SELECT q.src_pid, q.dst_pid, q.seq, q.nth, CASE WHEN f.used + q.need > 2000 THEN f.used ELSE f.used + q.need END, f.used + q.need > 2000
  FROM f JOIN q ON q.src_pid = f.src_pid AND q.dst_pid = f.dst_pid AND q.nth = f.nth + 1)
SELECT seq, CAST(used AS BIGINT) AS used, "full" FROM f""")
def bsmp_full_flags(spark, d):
    """Regions of 2,000 bytes: a refused message leaves room for a smaller one."""
    return messages.full_flags(queue(spark, d), 2000).select("seq", "used", "full")


@query(f"SELECT queue, dst_pid, count(*) AS n FROM (SELECT 'text' AS queue, dst_pid FROM ({SQL_QUEUE}) UNION ALL SELECT 'turn', src_pid FROM ({SQL_QUEUE})) GROUP BY 1, 2")
def bsmp_sync_all(spark, d):
    """Two queues in one exchange."""
    q = queue(spark, d)
    both = messages.sync_all({"text": q, "turn": q.withColumns({"src_pid": c("dst_pid"), "dst_pid": c("src_pid")})})
    return both.groupBy("queue", "dst_pid").agg(F.count(F.lit(1)).alias("n"))


SQL_LOG = """SELECT CAST(event_id % 8 AS INTEGER) AS src_pid, CAST(user_id % 8 AS INTEGER) AS dst_pid, event_type AS kind, 1 + event_id % 100 AS size, event_id AS seq FROM events"""


def log(spark, d):
    return table(spark, d, "events").select((c("event_id") % P).cast("int").alias("src_pid"), (c("user_id") % P).cast("int").alias("dst_pid"), c("event_type").alias("kind"), (1 + c("event_id") % 100).alias("size"), c("event_id").alias("seq"))


@query(f"SELECT src_pid, dst_pid, count(*) FILTER (WHERE kind = 'click') AS click, count(*) FILTER (WHERE kind = 'view') AS \"view\", count(*) FILTER (WHERE kind = 'purchase') AS purchase, CAST(sum(size) AS BIGINT) AS bytes FROM ({SQL_LOG}) GROUP BY 1, 2")
def comm_volume_matrix(spark, d):
    return messages.volume(log(spark, d), ["click", "view", "purchase"])


_KINDS = "['" + "', '".join(messages.KINDS) + "']"
SQL_REQUESTS = f"SELECT CAST(event_id % 8 AS INTEGER) AS src_pid, CAST(user_id % 8 AS INTEGER) AS dst_pid, list_extract({_KINDS}, CAST(event_id % 6 AS INTEGER) + 1) AS kind, 1 + event_id % 100 AS size FROM events"


@query(f"""SELECT *, put + hpput + get + hpget + 2 * (send + hpsend) AS messages FROM (
  SELECT src_pid, dst_pid, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in messages.KINDS)},
    CAST(coalesce(sum(size) FILTER (WHERE kind = 'get'), 0) AS BIGINT) AS get_payload, CAST(coalesce(sum(size) FILTER (WHERE kind IN ('send', 'hpsend')), 0) AS BIGINT) AS send_payload
  FROM ({SQL_REQUESTS}) GROUP BY 1, 2)""")
def request_volume(spark, d):
    """What each process tells each other one of its requests before they are exchanged."""
    kinds = F.array(*map(F.lit, messages.KINDS))
    return messages.request_volume(log(spark, d).withColumn("kind", F.get(kinds, (c("seq") % 6).cast("int"))))


@query(f"SELECT seq, row_number() OVER (PARTITION BY src_pid ORDER BY size DESC, seq) > 10 AS buffered FROM ({SQL_LOG})")
def hp_demotion_topk(spark, d):
    """Unbuffered messages of each process: all but the ten largest are buffered."""
    return messages.demoted(log(spark, d), 10).select("seq", "buffered")


@query("""WITH l AS (SELECT event_id // 1000 AS step, event_id % 8 AS pid, arg_max(user_id % 3, event_id) AS n FROM events GROUP BY 1, 2)
SELECT step, CASE WHEN min(n) = max(n) THEN max(n) END AS tag_size, min(n) <> max(n) AS mismatch FROM l GROUP BY 1""")
def tag_size_agreement(spark, d):
    s = table(spark, d, "events").select(F.expr("event_id div 1000").alias("step"), (c("event_id") % P).alias("pid"), (c("user_id") % 3).alias("tag_size"), c("event_id").alias("seq"))
    return messages.tag_sizes(s)


# ---- registration ----

SQL_SLOTS = """SELECT CAST(p_partkey % 8 AS INTEGER) AS pid, CASE WHEN p_size % 3 = 0 THEN 'local' ELSE 'global' END AS kind, p_partkey AS seq, p_partkey // 8 AS slot,
  CAST(p_size AS BIGINT) AS size, p_size % 5 AS active_from FROM part"""


def slots_of(spark, d):
    return table(spark, d, "part").select((c("p_partkey") % P).cast("int").alias("pid"), F.when(c("p_size") % 3 == 0, "local").otherwise("global").alias("kind"), c("p_partkey").alias("seq"), F.expr(f"p_partkey div {P}").alias("slot"), c("p_size").cast("long").alias("size"), (c("p_size") % 5).alias("active_from"))


@query(f"SELECT pid, kind, seq, 2 * (row_number() OVER (PARTITION BY pid, kind ORDER BY seq) - 1) + CASE WHEN kind = 'local' THEN 1 ELSE 0 END AS slot FROM ({SQL_SLOTS})")
def slot_allocation(spark, d):
    return registration.allocated(slots_of(spark, d)).select("pid", "kind", "seq", "slot")


@query(f"SELECT pid, count(*) AS n FROM ({SQL_SLOTS}) GROUP BY 1 HAVING count(*) > 20")
def register_over_capacity(spark, d):
    return registration.over_capacity(slots_of(spark, d), 20)


@query("SELECT pid, count(*) AS n, count(*) > 1000 AS over FROM (SELECT CAST(unnest([event_id % 8, user_id % 8]) AS INTEGER) AS pid FROM events) GROUP BY 1")
def message_queue_load(spark, d):
    return registration.message_load(event_bag(spark, d), 1000)


@query(f"SELECT pid, slot, kind FROM ({SQL_SLOTS}) WHERE (pid, slot) NOT IN (SELECT (CAST(s_suppkey % 8 AS INTEGER), s_suppkey // 8) FROM supplier)")
def deregister_antijoin(spark, d):
    freed = table(spark, d, "supplier").select((c("s_suppkey") % P).cast("int").alias("pid"), F.expr(f"s_suppkey div {P}").alias("slot"))
    return registration.live(slots_of(spark, d), freed).select("pid", "slot", "kind")


SQL_PUSHES = "SELECT CAST(user_id % 8 AS INTEGER) AS pid, event_type AS ident, event_id AS depth, 1 + event_id % 50 AS size FROM events"


def pushes(spark, d):
    return table(spark, d, "events").select((c("user_id") % P).cast("int").alias("pid"), c("event_type").alias("ident"), c("event_id").alias("depth"), (1 + c("event_id") % 50).alias("size"))


@query(f"SELECT pid, ident, max(depth) AS depth, arg_max(size, depth) AS size FROM ({SQL_PUSHES}) GROUP BY 1, 2")
def registration_stack_top(spark, d):
    return registration.stack_top(pushes(spark, d))


@query(f"""SELECT pid, ident, depth, size FROM (SELECT *, row_number() OVER (PARTITION BY pid, ident ORDER BY depth DESC) AS nth FROM ({SQL_PUSHES})) WHERE nth = 1 + CASE WHEN pid % 2 = 0 THEN 2 ELSE 0 END""")
def registration_after_pops(spark, d):
    """The even processes released each name twice."""
    p = pushes(spark, d)
    pops = p.where("pid % 2 = 0").select("pid", "ident", F.lit(2).alias("n")).distinct()
    return registration.popped(p, pops)


@query(f"SELECT pid, slot FROM ({SQL_SLOTS}) WHERE kind = 'local' OR active_from <= 2")
def active_slots(spark, d):
    return registration.active(slots_of(spark, d), 2).select("pid", "slot")


@query("SELECT pid, own, max(own) OVER () AS need FROM (SELECT CAST(user_id % 8 AS INTEGER) AS pid, count(*) AS own FROM events GROUP BY 1)")
def global_reserve(spark, d):
    return registration.reserve(hooked(table(spark, d, "events"), c("user_id"), P))


# ---- misuse ----

SQL_CALLS = """SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS phase, event_id AS seq, CAST(event_id % 8 AS INTEGER) AS src_pid, CAST(event_id % 30 AS INTEGER) AS src_slot, event_id % 40 AS src_off,
  CAST(user_id % 9 AS INTEGER) AS dst_pid, CAST(user_id % 35 AS INTEGER) AS dst_slot, user_id % 40 AS dst_off, 1 + event_id % 10 AS size FROM events"""


def calls(spark, d):
    e = table(spark, d, "events")
    return move.requests(e, F.when(c("event_id") % 3 == 0, 0).otherwise(1), c("event_id"), (c("event_id") % P, c("event_id") % 30, c("event_id") % 40), (c("user_id") % 9, c("user_id") % 35, c("user_id") % 40), 1 + c("event_id") % 10)


@query(f"SELECT pid, seq FROM (SELECT pid, seq, row_number() OVER (PARTITION BY pid ORDER BY seq) AS nth FROM ({SQL_SLOTS})) WHERE nth > 12")
def violation_register_beyond_reserved(spark, d):
    return checks.beyond_reserved(slots_of(spark, d), 12).select("pid", "seq")


@query(f"SELECT seq FROM ({SQL_CALLS}) b WHERE NOT EXISTS (SELECT 1 FROM ({SQL_SLOTS}) s WHERE s.pid = b.dst_pid AND s.slot = b.dst_slot)")
def violation_unknown_slot(spark, d):
    return checks.unknown_slot(calls(spark, d), slots_of(spark, d)).select("seq")


@query(f"SELECT DISTINCT s.pid, s.slot FROM ({SQL_SLOTS}) s JOIN ({SQL_CALLS}) b ON (s.pid = b.src_pid AND s.slot = b.src_slot) OR (s.pid = b.dst_pid AND s.slot = b.dst_slot)")
def violation_freed_in_use(spark, d):
    return checks.freed_in_use(slots_of(spark, d).select("pid", "slot"), calls(spark, d))


@query(f"SELECT seq FROM ({SQL_CALLS}) WHERE dst_pid > 7")
def violation_unknown_process(spark, d):
    return checks.unknown_process(calls(spark, d), P).select("seq")


@query("SELECT event_id AS seq FROM events WHERE CAST(9223372036854775807 - user_id AS HUGEINT) + 1 + event_id % 10 > 9223372036854775807")
def violation_offset_overflow(spark, d):
    bag = table(spark, d, "events").select(c("event_id").alias("seq"), (F.lit(checks.MOST) - c("user_id")).alias("dst_off"), (1 + c("event_id") % 10).alias("size"))
    return checks.overflow(bag).select("seq")


@query(f"SELECT b.seq FROM ({SQL_CALLS}) b JOIN ({SQL_SLOTS}) s ON s.pid = b.dst_pid AND s.slot = b.dst_slot WHERE s.kind = 'global' AND s.active_from > 2")
def violation_inactive_slot(spark, d):
    return checks.inactive(calls(spark, d), slots_of(spark, d), 2).select("seq")


@query(f"SELECT b.seq FROM ({SQL_CALLS}) b JOIN ({SQL_SLOTS}) s ON s.pid = b.src_pid AND s.slot = b.src_slot WHERE s.kind = 'global' AND s.active_from > 2")
def violation_inactive_source(spark, d):
    return checks.inactive(calls(spark, d), slots_of(spark, d), 2, "src").select("seq")


SQL_POPS = "SELECT event_id // 40 AS step, CAST(user_id % 8 AS INTEGER) AS pid, event_id AS seq, event_type AS ident FROM events WHERE event_id % 3 = 0"
SQL_PUSHED = "SELECT CAST(user_id % 8 AS INTEGER) AS pid, event_type AS ident, event_id // 40 AS step, event_id AS depth FROM events WHERE event_id % 3 <> 0"


@query(f"""WITH p AS ({SQL_POPS}), u AS ({SQL_PUSHED}),
t AS (SELECT p.step, p.pid, p.seq, p.ident, (SELECT max(u.depth) FROM u WHERE u.pid = p.pid AND u.ident = p.ident AND u.step < p.step) AS slot FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY step, pid ORDER BY seq) AS i FROM t)
SELECT step, i, count(*) FILTER (WHERE slot IS NULL) AS unregistered FROM n GROUP BY 1, 2 HAVING min(ident) <> max(ident) OR count(*) FILTER (WHERE slot IS NULL) > 0""")
def violation_unequal_pops(spark, d):
    e = table(spark, d, "events").select(F.expr("event_id div 40").alias("step"), (c("user_id") % P).cast("int").alias("pid"), c("event_id").alias("seq"), c("event_type").alias("ident"))
    return checks.unequal_pops(e.where("seq % 3 = 0"), e.where("seq % 3 <> 0").select("pid", "ident", "step", c("seq").alias("depth"))).select("step", c("i").cast("long").alias("i"), "unregistered")


@query(f"SELECT b.seq FROM ({SQL_CALLS}) b JOIN ({SQL_SLOTS}) s ON s.pid = b.dst_pid AND s.slot = b.dst_slot WHERE b.dst_off + b.size > s.size")
def violation_write_out_of_bounds(spark, d):
    return checks.out_of_bounds(calls(spark, d), slots_of(spark, d)).select("seq")


@query(f"SELECT b.seq FROM ({SQL_CALLS}) b JOIN ({SQL_SLOTS}) s ON s.pid = b.src_pid AND s.slot = b.src_slot WHERE b.src_off + b.size > s.size")
def violation_read_out_of_bounds(spark, d):
    return checks.out_of_bounds(calls(spark, d), slots_of(spark, d), "src").select("seq")


@query("SELECT pid, count(*) AS n FROM (SELECT CAST(unnest([event_id % 8, user_id % 9]) AS INTEGER) AS pid FROM events) GROUP BY 1 HAVING count(*) > 150")
def violation_too_many_requests(spark, d):
    return checks.too_many(calls(spark, d), 150)


@query(f"""SELECT b.seq FROM ({SQL_CALLS}) b JOIN ({SQL_SLOTS}) s ON s.kind = 'local' AND s.pid = CASE b.phase WHEN 1 THEN b.dst_pid ELSE b.src_pid END AND s.slot = CASE b.phase WHEN 1 THEN b.dst_slot ELSE b.src_slot END""")
def violation_local_slot_remote(spark, d):
    return checks.local_remote(calls(spark, d), slots_of(spark, d)).select("seq")


SQL_COLLECTIVE = "SELECT event_id // 40 AS step, CAST(user_id % 8 AS INTEGER) AS pid, event_id AS seq, user_id % 4 AS slot FROM events"


def collective_calls(spark, d):
    return table(spark, d, "events").select(F.expr("event_id div 40").alias("step"), (c("user_id") % P).cast("int").alias("pid"), c("event_id").alias("seq"), (c("user_id") % 4).alias("slot"))


@query(f"""SELECT step, min(n) AS least, max(n) AS most FROM (SELECT s.step, p.pid, count(x.seq) AS n FROM (SELECT DISTINCT step FROM ({SQL_COLLECTIVE})) s CROSS JOIN ({SQL_PROCS}) p LEFT JOIN ({SQL_COLLECTIVE}) x ON x.step = s.step AND x.pid = p.pid GROUP BY 1, 2)
GROUP BY 1 HAVING min(n) <> max(n)""")
def violation_unequal_collectives(spark, d):
    return checks.unequal_counts(collective_calls(spark, d), procs_of(spark))


@query(f"SELECT step, i FROM (SELECT step, slot, row_number() OVER (PARTITION BY step, pid ORDER BY seq) AS i FROM ({SQL_COLLECTIVE})) GROUP BY 1, 2 HAVING min(slot) <> max(slot)")
def violation_unequal_deregistration(spark, d):
    return checks.unequal_slots(collective_calls(spark, d)).select("step", c("i").cast("long").alias("i"))


SQL_RANGES = """SELECT event_id AS seq, CAST(user_id % 16 AS INTEGER) AS src_pid, 0 AS src_slot, event_id * 3 AS src_off, CAST(event_id % 16 AS INTEGER) AS dst_pid, 0 AS dst_slot, event_id * 3 + user_id % 7 AS dst_off, 1 + user_id % 50 AS size FROM events"""


@query(f"SELECT r.src_pid AS pid, r.src_slot AS slot, r.seq AS reader, w.seq AS writer FROM ({SQL_RANGES}) r JOIN ({SQL_RANGES}) w ON r.src_pid = w.dst_pid AND r.src_off < w.dst_off + w.size AND w.dst_off < r.src_off + r.size")
def rw_conflict_interval_join(spark, d):
    e = table(spark, d, "events")
    bag = move.put(e, c("event_id"), (c("user_id") % 16, 0, c("event_id") * 3), (c("event_id") % 16, 0, c("event_id") * 3 + c("user_id") % 7), 1 + c("user_id") % 50)
    return checks.read_write_conflicts(bag)


@query(f"SELECT b.seq, CASE WHEN b.dst_pid > 7 THEN 'pid' WHEN s.size IS NULL THEN 'unregistered' WHEN b.dst_off + b.size > s.size THEN 'range' ELSE 'ok' END AS status FROM ({SQL_CALLS}) b LEFT JOIN ({SQL_SLOTS}) s ON s.pid = b.dst_pid AND s.slot = b.dst_slot")
def argument_status(spark, d):
    return checks.argument_status(calls(spark, d), slots_of(spark, d), P)


@query(f"""SELECT pid, n, most FROM (SELECT pid, n, max(n) OVER () AS most FROM (SELECT p.pid, count(x.pid) AS n FROM ({SQL_PROCS}) p LEFT JOIN (SELECT CAST(user_id % 8 AS INTEGER) AS pid FROM events) x ON x.pid = p.pid GROUP BY 1)) WHERE n < most""")
def violation_unequal_syncs(spark, d):
    return checks.unequal_syncs(hooked(table(spark, d, "events"), c("user_id"), P), procs_of(spark))


# ---- sorting and lists ----


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey) - 1 AS rank FROM orders")
def sample_sort_rank(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").alias("id"), cents("o_totalprice").alias("price"))
    return lists.ranked(o, "price", "id").select("id", "rank")


SQL_LINKS = "SELECT o_orderkey AS id, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (ORDER BY CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey)"


def order_list(spark, d):
    return lists.links(table(spark, d, "orders"), "o_orderkey", cents("o_totalprice"), "o_orderkey")


@query(SQL_LINKS)
def list_links(spark, d):
    return order_list(spark, d)


@query(ORACLE_SQL["sample_sort_rank"])
def list_rank(spark, d):
    """Positions found from the links alone."""
    return lists.list_rank(order_list(spark, d).select("id", "next"))


@query(f"SELECT row_number() OVER (ORDER BY price, id) - 1 AS rank, id, prev, next FROM ({SQL_LINKS}) JOIN (SELECT o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders) ON key = id")
def list_dump(spark, d):
    """Each node with its place and its neighbours."""
    return lists.dumped(order_list(spark, d))


@query(f"""WITH l AS ({SQL_LINKS}), n AS (SELECT id, 2 * row_number() OVER (ORDER BY CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey) AS k FROM (SELECT o_orderkey AS id, o_totalprice, o_orderkey FROM orders)),
a AS (SELECT id, k FROM n UNION ALL SELECT -1 - id, k - 1 FROM n WHERE id % 5 = 0)
SELECT id, lag(id) OVER (ORDER BY k) AS prev, lead(id) OVER (ORDER BY k) AS next FROM a""")
def list_insert(spark, d):
    """A new node before every fifth key."""
    nodes = order_list(spark, d)
    return lists.insert_before(nodes, nodes.where("id % 5 = 0").select((-1 - c("id")).alias("id"), c("id").alias("before")))


@query(f"""WITH l AS ({SQL_LINKS}), n AS (SELECT id, 8 * row_number() OVER (ORDER BY CAST(round(o_totalprice * 100) AS BIGINT), o_orderkey) AS k FROM (SELECT o_orderkey AS id, o_totalprice, o_orderkey FROM orders)),
a AS (SELECT id, k FROM n UNION ALL SELECT -1 - 4 * id - i.range, k - 4 + i.range FROM n, range(3) i WHERE id % 5 = 0 AND i.range <= id % 3)
SELECT id, lag(id) OVER (ORDER BY k) AS prev, lead(id) OVER (ORDER BY k) AS next FROM a""")
def list_insert_bulk(spark, d):
    """One to three new nodes, in an order of their own, before every fifth key."""
    nodes = order_list(spark, d)
    new = nodes.where("id % 5 = 0").select(c("id").alias("before"), F.explode(F.sequence(F.lit(0).cast("long"), c("id") % 3)).alias("idx"))
    return lists.insert_before(nodes, new.select((-1 - 4 * c("before") - c("idx")).alias("id"), "before", "idx"), "idx")


@query("SELECT pid, (n + 8 - pid - 1) // 8 AS n FROM (SELECT count(*) AS n FROM orders), (SELECT CAST(range AS INTEGER) AS pid FROM range(8))")
def rebalance_sizes(spark, d):
    o = table(spark, d, "orders").select((c("o_custkey") % 3).cast("int").alias("pid"), c("o_orderkey").alias("id"))
    return collectives.local_count(lists.rebalanced(o, P, "id"), procs_of(spark))


# ---- cost ----

SQL_STEPS = "SELECT event_id // 500 AS step, event_id % 8 AS src_pid, user_id % 8 AS dst_pid, 1 + event_id % 100 AS size FROM events"
SQL_H = f"""SELECT step, CAST(max(greatest(sent, got)) AS BIGINT) AS h FROM (SELECT step, pid, sum(sent) AS sent, sum(got) AS got FROM (
  SELECT step, src_pid AS pid, size AS sent, 0 AS got FROM ({SQL_STEPS}) UNION ALL SELECT step, dst_pid, 0, size FROM ({SQL_STEPS})) GROUP BY 1, 2) GROUP BY 1"""


def stepped(spark, d):
    return table(spark, d, "events").select(F.expr("event_id div 500").alias("step"), (c("event_id") % P).alias("src_pid"), (c("user_id") % P).alias("dst_pid"), (1 + c("event_id") % 100).alias("size"))


@query(SQL_H)
def hrelation(spark, d):
    return cost.h_relation(stepped(spark, d))


@query(f"SELECT CAST(sum(h * 3 + 50) AS BIGINT) AS cost FROM ({SQL_H})")
def hrelation_cost(spark, d):
    return cost.program_cost(stepped(spark, d), 3, 50)


SQL_MACHINE = "SELECT o_orderkey AS id, 2 + o_orderkey % 62 AS p, 1 + o_custkey % 1000 AS size, 1 + o_orderkey % 7 AS g, 100 * (o_orderkey % 13) AS l FROM orders"


@query(f"""SELECT id, CASE WHEN basic < striping AND basic < tree THEN 'one_step' WHEN size < p THEN 'tree' ELSE 'striped' END AS plan
FROM (SELECT id, p, size, p * size * g + l AS basic, 2 * sqrt(p) * size * g + 2 * l AS tree, 3 * size * g + 2 * l AS striping FROM ({SQL_MACHINE}))""")
def cost_model_choice(spark, d):
    m = table(spark, d, "orders").select(c("o_orderkey").alias("id"), (2 + c("o_orderkey") % 62).alias("p"), (1 + c("o_custkey") % 1000).alias("size"), (1 + c("o_orderkey") % 7).alias("g"), (100 * (c("o_orderkey") % 13)).alias("l"))
    return cost.broadcast_plan(m).select("id", "plan")


CURVE = [(b, 1000.0 / (k + 1), 64.0 * (k + 1)) for k, b in enumerate(cost.BLOCKS)]
SQL_CURVE = "SELECT * FROM (VALUES " + ", ".join(f"(CAST({b} AS BIGINT), CAST({g!r} AS DOUBLE), CAST({l!r} AS DOUBLE))" for b, g, l in CURVE) + ") t(block, g, l)"


@query(f"""WITH c AS (SELECT *, lead(block) OVER (ORDER BY block) AS block2, lead(g) OVER (ORDER BY block) AS g2, lead(l) OVER (ORDER BY block) AS l2 FROM ({SQL_CURVE})),
w AS (SELECT o_orderkey AS id, o_custkey * o_custkey AS size FROM orders)
SELECT id, size, CASE WHEN block IS NULL THEN 1000.0::DOUBLE WHEN block2 IS NULL THEN g ELSE g + (size - block) / (block2 - block) * (g2 - g) END AS cost_g,
  CASE WHEN block IS NULL THEN 64.0::DOUBLE WHEN block2 IS NULL THEN l ELSE l + (size - block) / (block2 - block) * (l2 - l) END AS cost_l
FROM w LEFT JOIN c ON size >= block AND (size < block2 OR block2 IS NULL)""")
def g_interpolation(spark, d):
    """Cost parameters at the block size of each order, between seven measured sizes."""
    w = table(spark, d, "orders").select(c("o_orderkey").alias("id"), (c("o_custkey") * c("o_custkey")).alias("size"))
    return cost.interpolated(w, spark.createDataFrame(CURVE, "block long, g double, l double"))


@query("""WITH b AS (SELECT list_extract([1, 8, 128, 1024, 8192, 131072, 1048576], CAST(event_id % 7 AS INTEGER) + 1) AS block, CAST(pow(2, user_id % 6) AS BIGINT) AS h, CAST(min(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS t FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY h) AS up, row_number() OVER (PARTITION BY block ORDER BY h DESC) AS down FROM b),
x AS (SELECT block, count(*) AS n, max(t) FILTER (WHERE up = 1) AS t0, max(t) FILTER (WHERE up = 2) AS t1, max(h) FILTER (WHERE up = 2) AS h1, max(t) FILTER (WHERE up = 3) AS t2, max(h) FILTER (WHERE up = 3) AS h2,
  max(t) FILTER (WHERE down = 2) AS ta, max(h) FILTER (WHERE down = 2) AS ha, max(t) FILTER (WHERE down = 1) AS tb, max(h) FILTER (WHERE down = 1) AS hb FROM r GROUP BY 1)
SELECT CAST(block AS BIGINT) AS block, CASE WHEN n >= 3 THEN greatest(2.2250738585072014e-308::DOUBLE, (tb - ta) / CAST(hb - ha AS DOUBLE)) END AS g,
  CASE WHEN n >= 3 THEN greatest(t0, least(t1, t1 - (t2 - t1) / CAST(h2 - h1 AS DOUBLE) * h1)) END AS l FROM x""")
def machine_parameters(spark, d):
    sizes = F.array(*(F.lit(b).cast("long") for b in cost.BLOCKS))
    t = table(spark, d, "events").select(F.get(sizes, (c("event_id") % 7).cast("int")).alias("block"), F.pow(F.lit(2), c("user_id") % 6).cast("long").alias("h"), cents("value").alias("t"))
    return cost.machine_parameters(t)


@query("""WITH s AS (SELECT event_type AS kind, CAST(round(value * 100) AS BIGINT) AS t FROM events),
m AS (SELECT kind, CAST(floor(sum(t) / count(*)) AS BIGINT) AS c FROM s GROUP BY 1),
q AS (SELECT kind, c, count(*) AS n, CAST(sum(CAST(t - c AS HUGEINT)) AS DOUBLE) AS s1, CAST(sum(CAST(t - c AS HUGEINT) * (t - c)) AS DOUBLE) AS s2, CAST(sum(CAST(t - c AS HUGEINT) * (t - c) * (t - c)) AS DOUBLE) AS s3,
  quantile_disc(t, 0.025) AS low, quantile_disc(t, 0.975) AS high FROM s JOIN m USING (kind) GROUP BY 1, 2)
SELECT kind, n, c + s1 / n AS mean, (s2 - s1 * (s1 / n)) / (n - 1) AS variance, (s3 - s2 * 3 * (s1 / n) + s1 * 2 * (s1 / n) * (s1 / n)) / n AS third, low, high FROM q""")
def probe_statistics(spark, d):
    return cost.statistics(table(spark, d, "events").select(c("event_type").alias("kind"), cents("value").alias("t")), "kind", "t")


@query(f"SELECT kind, round(0.3328 * (abs(third) / pow(variance, 1.5) + 0.429) / sqrt(n), 6) AS bound FROM ({ORACLE_SQL['probe_statistics']})")
def probe_error_bound(spark, d):
    """How far the means of each kind are from the normal law at most."""
    return probe_statistics(spark, d).select("kind", F.round(reducers.normal_error_bound(F.abs("third"), c("variance"), c("n")), 6).alias("bound"))


@query("""WITH b AS (SELECT event_type AS kind, event_id % 40 AS bucket, count(*) AS n, sum(CAST(CAST(round(value * 100) AS BIGINT) AS HUGEINT)) AS s FROM events GROUP BY 1, 2),
m AS (SELECT kind, bucket, n, s, CAST(s AS DOUBLE) / n AS m FROM b),
k AS (SELECT kind, count(*) AS buckets, CAST(sum(s) AS DOUBLE) / sum(n) AS mean FROM m GROUP BY 1)
SELECT m.kind, row_number() OVER (PARTITION BY m.kind ORDER BY m.m) - 1 AS nth, m.m AS bucket_mean, k.buckets, k.mean,
  round(sum((m.m - k.mean) * (m.m - k.mean)) OVER (PARTITION BY m.kind) / (k.buckets - 1), 3) AS variance_of_means FROM m JOIN k ON k.kind = m.kind""")
def probe_buckets(spark, d):
    """Means of forty buckets of each kind, in order, with their variance about the mean of all samples."""
    e = table(spark, d, "events").select(c("event_type").alias("kind"), (c("event_id") % 40).alias("bucket"), cents("value").alias("t"))
    x = cost.bucket_statistics(e, "kind", "bucket", "t")
    out = x.select("kind", F.posexplode("means").alias("nth", "bucket_mean"), "buckets", "mean", F.round("variance_of_means", 3).alias("variance_of_means"))
    return out.withColumn("nth", c("nth").cast("long"))


@query(f"SELECT block, sum(10.0::DOUBLE * (0.01::DOUBLE / 7 + 0.99::DOUBLE * block / 1189001)) OVER (ORDER BY block) AS deadline FROM ({SQL_CURVE})")
def probe_budget(spark, d):
    return cost.budget_split(spark.createDataFrame(CURVE, "block long, g double, l double"), 10.0)


_PAIR = f"(SELECT a.pid AS src_pid, b.pid AS dst_pid FROM ({SQL_PROCS}) a, ({SQL_PROCS}) b)"
for _name, _sql in (
    ("all", f"SELECT * FROM {_PAIR}"),
    ("scatter", f"SELECT * FROM {_PAIR} WHERE src_pid = 0"),
    ("gather", f"SELECT * FROM {_PAIR} WHERE dst_pid = 0"),
    ("grid", f"SELECT DISTINCT pid AS src_pid, CAST(unnest([y * 2 + (x + 1) % 2, y * 2 + (x + 1) % 2, (y + 1) % 4 * 2 + x, (y + 3) % 4 * 2 + x]) AS INTEGER) AS dst_pid FROM (SELECT pid, pid % 2 AS x, pid // 2 AS y FROM ({SQL_PROCS}))"),
):

    def _traffic(spark, d, name=_name):
        return cost.traffic(procs_of(spark), name, P)

    QUERIES[f"traffic_{_name}"] = _traffic
    ORACLE_SQL[f"traffic_{_name}"] = _sql


_DRAWN = "((({0}) % 2147483648 * 1103515245 + 12345) % 2147483648)"
_LANDS = _DRAWN.format(_DRAWN.format("pid * 6 + i + 1000003"))


@query(f"""SELECT pid AS src_pid, CAST(i AS INTEGER) AS i, CAST(dst AS INTEGER) AS dst_pid, CAST((pid * 6 + i) * 1000 AS BIGINT) AS src_off, CAST((pid * 6 + i) * 1000 AS BIGINT) AS dst_off, CAST(1000 AS BIGINT) AS size
FROM (SELECT pid, i.range AS i, {_LANDS.replace("+ i +", "+ i.range +")} * 8 // 2147483648 AS dst FROM ({SQL_PROCS}), range(6) i) WHERE dst <> pid""")
def traffic_random(spark, d):
    """Six messages of each process to drawn destinations."""
    return cost.message_bag(procs_of(spark), "random", P, 6, 1000)


@query(f"""SELECT pid AS src_pid, CAST(i AS INTEGER) AS i, CAST(dst AS INTEGER) AS dst_pid, CAST((pid * 6 + i) * 1000 AS BIGINT) AS src_off, CAST((dst * 6 + i) * 1000 AS BIGINT) AS dst_off, CAST(1000 AS BIGINT) AS size
FROM (SELECT pid, i.range AS i, list_extract([(pid + 2) % 8, (8 + pid - 2) % 8, (pid + 1) % 8, (8 + pid - 1) % 8], CAST(i.range % 4 AS INTEGER) + 1) AS dst FROM ({SQL_PROCS}), range(6) i) WHERE dst <> pid""")
def traffic_grid_collisions(spark, d):
    """Six messages of each process in turn to its grid neighbours, all into the same cells."""
    return cost.message_bag(procs_of(spark), "grid", P, 6, 1000, collide=True)


@query(f"""SELECT a.pid AS src_pid, CAST(i.range AS INTEGER) AS i, b.pid AS dst_pid, CAST((a.pid * 3 + i.range) * 8 AS BIGINT) AS src_off, CAST((b.pid * 3 + i.range) * 8 AS BIGINT) AS dst_off, CAST(8 AS BIGINT) AS size
FROM ({SQL_PROCS}) a, ({SQL_PROCS}) b, range(3) i WHERE a.pid <> b.pid""")
def traffic_all_collisions(spark, d):
    """Three messages of each process to each other, all writers into the same cells."""
    return cost.message_bag(procs_of(spark), "all", P, 3, 8, collide=True)


@query(f"""WITH l AS ({SQL_LINKS}), r AS (SELECT id, prev, next, row_number() OVER (ORDER BY id) - 1 AS place FROM l),
a AS (SELECT id, prev, next, CAST(place % 8 AS INTEGER) AS pid, place // 8 AS idx FROM r)
SELECT a.id, a.pid, a.idx, p.pid AS prev_pid, p.idx AS prev_idx, n.pid AS next_pid, n.idx AS next_idx FROM a LEFT JOIN a p ON p.id = a.prev LEFT JOIN a n ON n.id = a.next""")
def rebalance_links(spark, d):
    """A list dealt evenly over the processes, its links as places."""
    return lists.relocated(order_list(spark, d), P, "id")


@query(f"""WITH r AS (SELECT c_custkey AS off, CAST(round(c_acctbal * 100) AS BIGINT) AS val FROM customer), s AS (SELECT max(off) + 1 AS size FROM r)
SELECT p.pid, CAST(off // ((size + 7) // 8) AS INTEGER) AS via, off, val FROM r, s, ({SQL_PROCS}) p WHERE p.pid <> 4""")
def broadcast_striped(spark, d):
    """The array of process 4, first in stripes over all processes, then from all to all."""
    root = table(spark, d, "customer").select(F.lit(4).alias("pid"), c("c_custkey").alias("off"), cents("c_acctbal").alias("val"))
    size = (root.agg(F.max("off").alias("most")).first().most or 0) + 1
    return collectives.broadcast_striped(root, procs_of(spark), 4, size, P)
