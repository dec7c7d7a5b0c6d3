"""Programs as objects: a context with memory, slots and pending requests, and the message-passing library on top of it."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestep.operators import cost, messages, move
from tidestep.sources.tables import kept, processes

ROOT, MAX_P, NONE, NO_ARGS, DEFAULT = 0, (1 << 31) - 1, None, None, "default"
INVALID_SIZE, INVALID_SLOT = -1, -1


class BspError(Exception):
    """An error after which the context can go on."""


class BspOutOfMemory(BspError):
    """A reserved capacity does not suffice; the call had no effect."""


class BspFatal(BspError):
    """The context is of no more use: every later sync fails as well."""


# Errors of the message-passing library and what they say.
ERRORS = {
    "NULL_POINTER": "a name is missing",
    "MEMORY_ACCESS_OUT_OF_RANGE": "memory access out of range",
    "NOT_REGISTERED": "the name is not registered",
    "PID_OUT_OF_RANGE": "no such process",
    "PUSHREG_MISMATCH": "processes registered different numbers of areas",
    "POPREG_MISMATCH": "processes released different areas",
    "TAGSIZE_MISMATCH": "processes set different tag sizes",
    "EMPTY_MESSAGE_QUEUE": "no message is left",
    "SYNC_EXIT_MISMATCH": "processes left at different supersteps",
}


class BspContext:
    """``nprocs`` processes with one memory relation; requests are collected and carried out by ``sync``."""

    def __init__(self, spark: SparkSession, nprocs: int, memory: DataFrame | None = None, max_slots: int = 0, max_messages: int | None = None):
        if not 0 < nprocs <= MAX_P:
            raise BspFatal("a positive number of processes")
        self.spark, self.nprocs, self.procs = spark, nprocs, processes(spark, nprocs)
        self.mem, self.pending, self.failed, self.steps = memory, [], False, 0
        self.max_slots, self._next_slots, self.max_messages, self._next_messages = max_slots, max_slots, max_messages, max_messages
        self.slots: dict[int, dict] = {}

    def exec(self, program: Callable[..., Any], args: Any = NO_ARGS, nprocs: int | None = None) -> Any:
        """Runs ``program(context, procs, args)`` on new processes; its DataFrames are the distributed part."""
        if program is None or (nprocs is not None and nprocs <= 0):
            raise BspFatal("a program and a positive number of processes")
        return program(child := BspContext(self.spark, min(nprocs or self.nprocs, self.nprocs)), child.procs, args)

    def probe(self, curve: DataFrame, sizes: DataFrame) -> DataFrame:
        """``p`` and, for each of ``sizes`` (size), the cost parameters between those measured in ``curve`` (block, g, l)."""
        return cost.interpolated(sizes, curve).withColumn("p", F.lit(self.nprocs))

    def rehook(self, program: Callable[..., Any], args: Any = NO_ARGS) -> Any:
        """The same processes with registers of their own."""
        return self.exec(program, args)

    def resize_memory_register(self, n: int) -> None:
        if n < 0:
            raise BspOutOfMemory("a number of slots")
        self._next_slots = n

    def resize_message_queue(self, n: int) -> None:
        if n < 0:
            raise BspOutOfMemory("a number of messages")
        self._next_messages = n

    def register(self, df: DataFrame, kind: str = "global") -> int:
        """Adds the rows ``pid, off, val`` as a new slot: even if global, odd if local. A global slot serves from the next sync."""
        if len(self.slots) >= self.max_slots:
            raise BspOutOfMemory("no slot is reserved")
        slot = next(s for s in range(0 if kind == "global" else 1, 2 * len(self.slots) + 3, 2) if s not in self.slots)
        rows = move.memory(df, F.col("pid"), slot, F.col("off"), F.col("val"))
        self.mem = rows if self.mem is None else self.mem.unionByName(rows)
        self.slots[slot] = {"kind": kind, "active_from": self.steps + (kind == "global")}
        return slot

    def deregister(self, slot: int) -> None:
        if slot not in self.slots:
            raise BspFatal("no such slot")
        del self.slots[slot]
        self.mem = self.mem.where(F.col("slot") != slot)

    def request(self, bag: DataFrame, attr: str = DEFAULT) -> None:
        if attr != DEFAULT:
            raise BspFatal("only the default attribute is known")
        self.pending.append(bag)

    def put(self, df: DataFrame, seq, src: tuple, dst: tuple, size=1, attr: str = DEFAULT) -> None:
        self.request(move.put(df, seq, src, dst, size), attr)

    def get(self, df: DataFrame, seq, src: tuple, dst: tuple, size=1, attr: str = DEFAULT) -> None:
        self.request(move.get(df, seq, src, dst, size), attr)

    def sync(self, attr: str = DEFAULT) -> DataFrame:
        """Carries out all pending requests; the new memory is a table in the shared folder."""
        if self.failed or attr != DEFAULT:
            self.failed = True
            raise BspFatal("the context failed before" if attr == DEFAULT else "only the default attribute is known")
        bag = None
        for b in self.pending:
            bag = b if bag is None else bag.unionByName(b)
        if bag is not None and self.max_messages is not None:
            ends = bag.select(F.explode(F.array("src_pid", "dst_pid")).alias("pid")).groupBy("pid").count()
            if not ends.where(F.col("count") > self.max_messages).isEmpty():
                self.failed = True
                raise BspFatal("more messages than reserved")
        if bag is not None and self.mem is not None:
            self.mem = kept(move.sync(self.mem, bag), "memory")
        self.pending, self.steps = [], self.steps + 1
        self.max_slots, self.max_messages = self._next_slots, self._next_messages
        return self.mem

    def abort(self, why: str = "") -> None:
        self.failed = True
        self.spark.sparkContext.cancelAllJobs()
        raise BspFatal(why or "aborted")


class BspLib(BspContext):
    """The buffered library: named areas registered as on a stack, gets before puts, tagged messages."""

    def __init__(self, spark: SparkSession, nprocs: int):
        super().__init__(spark, nprocs, max_slots=MAX_P)
        self.began, self.tag_size, self._next_tag = time.monotonic(), 0, None
        self.stack: dict[str, list[int]] = {}
        self._push, self._pop, self._sent, self.inbox = [], [], [], None

    def time(self) -> float:
        return time.monotonic() - self.began

    def __enter__(self) -> BspLib:
        return self

    def __exit__(self, kind, *_) -> None:
        """The end of the program: what was asked for after the last sync would be lost, so that is an error."""
        if kind is None and (self.pending or self._sent or self._push or self._pop):
            raise BspFatal(ERRORS["SYNC_EXIT_MISMATCH"])

    def push_reg(self, ident: str, df: DataFrame) -> None:
        """Takes effect at the next sync; the newest registration of a name counts."""
        if not ident:
            raise BspError(ERRORS["NULL_POINTER"])
        self._push.append((ident, self.register(df)))

    def pop_reg(self, ident: str) -> None:
        """Takes effect at the next sync; until then the area can be used."""
        if len(self.stack.get(ident, [])) <= self._pop.count(ident):
            raise BspError(ERRORS["NOT_REGISTERED"])
        self._pop.append(ident)

    def slot(self, ident: str) -> int:
        if not self.stack.get(ident):
            raise BspError(ERRORS["NOT_REGISTERED"])
        return self.stack[ident][-1]

    def put_to(self, df: DataFrame, seq, src: tuple, dst: tuple, size=1) -> None:
        """As ``put``, with names for slots. DataFrames do not change, so every put is buffered."""
        self.put(df, seq, (src[0], self.slot(src[1]), src[2]), (dst[0], self.slot(dst[1]), dst[2]), size)

    def get_from(self, df: DataFrame, seq, src: tuple, dst: tuple, size=1) -> None:
        self.get(df, seq, (src[0], self.slot(src[1]), src[2]), (dst[0], self.slot(dst[1]), dst[2]), size)

    hpput, hpget = put_to, get_from

    def set_tagsize(self, n: int) -> int:
        """Takes effect at the next sync; returns the size in force."""
        self._next_tag = n
        return self.tag_size

    def send(self, df: DataFrame, src, dst, seq, tag, payload) -> None:
        self._sent.append(messages.send(df, src, dst, seq, tag, payload))

    hpsend = send

    def qsize(self) -> DataFrame:
        return messages.queue_size(self._messages(), self.procs)

    def get_tag(self) -> DataFrame:
        return messages.peeked(self._messages(), self.procs)

    def moved(self, most: int) -> DataFrame:
        """All that wait, cut to ``most`` bytes, in the order of reading; none leaves the queue."""
        return messages.delivered(messages.moved(self._messages(), most))

    def _take(self, n: int) -> DataFrame:
        """The next ``n`` messages of each process, which leave the queue."""
        moves, queue = self.procs.select("pid", F.lit(n).alias("n")), self._messages()
        taken = messages.hp_moved(queue, moves)
        self.inbox = kept(messages.remaining(queue, moves), "messages")
        return taken

    def move(self, most: int, n: int = 1) -> DataFrame:
        """Payloads of the next ``n`` messages of each process, cut to ``most`` bytes; they leave the queue."""
        return messages.moved(self._take(n), most)

    def hpmove(self, n: int = 1) -> DataFrame:
        """As ``move``, with tags, and nothing cut."""
        return self._take(n)

    def _messages(self) -> DataFrame:
        if self.inbox is None:
            raise BspError(ERRORS["EMPTY_MESSAGE_QUEUE"])
        return self.inbox

    def sync(self, attr: str = DEFAULT) -> DataFrame:
        """Gets, then puts, then messages, releases and registrations."""
        mem = super().sync(attr)
        sent = {str(i): q for i, q in enumerate(self._sent)}
        self.inbox = kept(messages.sync_all(sent), "messages") if sent else None
        for ident in self._pop:
            self.deregister(self.stack[ident].pop())
            mem = self.mem
        for ident, slot in self._push:
            self.stack.setdefault(ident, []).append(slot)
        if self._next_tag is not None:
            self.tag_size, self._next_tag = self._next_tag, None
        self._push, self._pop, self._sent = [], [], []
        return mem

    def query(self, df: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A remote call: requests go to the server process as messages, and its answers back to whoever asked."""
        asked = messages.send(df, F.col("pid"), F.lit(ROOT), F.col("seq"), F.col("tag"), F.col("payload"))
        return answer(asked).select(F.lit(ROOT).alias("src_pid"), F.col("src_pid").alias("dst_pid"), "seq", "tag", "payload")
