"""Sessions of late events: what stood after each batch, what each batch retracted.

A user's events arrive in batches, late ones in batches long after their time. Each batch is applied in
ascending order to the user's list of disjoint sessions, sorted by time: an event's place is found by
bisection, the sessions within the gap of it are spliced into one, and every standing session that a
spliced one swallows is logged as retracted by it.

No user is replayed in one group, as one user may hold a third of all events, in one endless session.
Events of one user, batch and second are counted together before anything is shuffled by user. A user's
replay is cut into blocks of BATCHES batches. A block needs its own events, those of the last `lateness`
batches before it, and of all earlier ones only the last run: as everything older has arrived, that run is
final, so four numbers carry it over (`carried`), found by a scan over summaries of FAN slices at a time.
A group holds FAN summaries or (BATCHES + lateness) batches of distinct seconds, whatever the input.

Events without a user, batch or second have no place in a replay and are left out. Rows that repeat count
as often as they stand. An empty table gives no version. Other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Batches replayed in one group.
BATCHES = 24
#: Summaries folded in one group.
FAN = 256

VERSION = "user long, batch long, start_s long, end_s long, n_events long, n_new long, n_retracted long, h_sum long, retracted_batch long, retracted_start_s long"


def events_of(conversations: DataFrame) -> DataFrame:
    """The turns of conversations as events: user, second, batch, h. Rows without a turn are no events."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    found = conversations.filter(turn.isNotNull() & conv.isNotNull()).select(
        conv.alias("conv"),
        turn.alias("turn"),
        F.crc32(conv.cast("string")).alias("c"),
        F.crc32(F.concat_ws(":", conv.cast("string"), turn.cast("string"))).alias("h"),
    )
    found = found.select(
        (2 * _div(F.col("conv"), 8) + F.col("c") % 2).alias("user"),
        (_div(F.col("c"), 2) % 7200 + 300 * F.col("turn") + F.col("h") % 600).alias("second"),
        _div(F.col("h"), 600).alias("g"),
        "h",
    )
    late = F.when(F.col("g") % 3 == 0, F.col("g") % 4).otherwise(F.lit(0))
    return found.select("user", "second", (_div(F.col("second"), 3600) + late).alias("batch"), "h")


def _div(x: Column, by: int) -> Column:
    """Floor of x / by in whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def _joined(gap: int):
    """Summary of two neighbours in time: first and last second, the run that ends it, whether that run is all of it."""

    def step(a: Column, x: Column) -> Column:
        linked = x["first"] - a["last"] <= gap
        longer = linked & x["whole"]
        return F.struct(
            a["first"].alias("first"),
            x["last"].alias("last"),
            F.when(longer, a["start"]).otherwise(x["start"]).alias("start"),
            F.when(longer, a["n"] + x["n"]).otherwise(x["n"]).alias("n"),
            F.when(longer, a["h"] + x["h"]).otherwise(x["h"]).alias("h"),
            F.when(longer, F.greatest(a["batch"], x["batch"])).otherwise(x["batch"]).alias("batch"),
            (a["whole"] & longer).alias("whole"),
        )

    return step


PARTS = ("first", "last", "start", "n", "h", "batch", "whole")
RUN = ("start", "last", "n", "h", "batch")


def _folded(parts: Column, gap: int) -> Column:
    """Summary of a sorted array of summaries."""
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), parts[0], _joined(gap))


def carried(slices: DataFrame, gap: int, fan: int = FAN) -> DataFrame:
    """For each user and slice the run that ends last before it (null before the first): user, slice, carry.
    slices: user, slice, part (a summary). Groups of fan slices are summed up, the sums are scanned in
    the same way, then each group from what is carried into it."""
    low, high = slices.agg(F.min("slice"), F.max("slice")).first()
    groups = (
        slices.groupBy("user", _div(F.col("slice") - F.lit(low or 0), fan).alias("above"))
        .agg(F.array_sort(F.collect_list(F.struct("slice", "part"))).alias("parts"))
    )
    nothing = slices.schema["part"].dataType.simpleString()
    if high is not None and high - low >= fan:
        groups = stored(groups, "slice_groups")
        sums = groups.select("user", F.col("above").alias("slice"), _folded(F.col("parts.part"), gap).alias("part"))
        before = carried(stored(sums, "slice_sums"), gap, fan).withColumnsRenamed({"slice": "above", "carry": "before"})
        groups = groups.join(before, ["user", "above"])
    else:
        groups = groups.withColumn("before", F.lit(None).cast(nothing))
    step = _joined(gap)
    walked = F.aggregate(
        "parts",
        F.struct(F.col("before").alias("now"), F.array().cast(f"array<struct<slice:bigint,carry:{nothing}>>").alias("out")),
        lambda a, x: F.struct(
            F.when(a["now"].isNull(), x["part"]).otherwise(step(a["now"], x["part"])).alias("now"),
            F.array_append(a["out"], F.struct(x["slice"].alias("slice"), a["now"].alias("carry"))).alias("out"),
        ),
    )
    return groups.select("user", F.inline(walked["out"]))


class Session:
    """A session of the list. versions: ids (batch, start) of the standing ones in it."""

    __slots__ = ("start", "end", "n", "h", "batch", "new", "versions")

    def __init__(self, start: int, end: int, n: int, h: int, batch: int, new: int, versions: list):
        self.start, self.end, self.n, self.h, self.batch, self.new, self.versions = start, end, n, h, batch, new, versions


class Replay:
    """A sorted list of disjoint sessions, events put in one by one."""

    def __init__(self, gap: int):
        self.gap = gap
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.held: list[Session] = []

    def put(self, own: Session) -> Session:
        """own spliced with the sessions within the gap of it."""
        i = bisect.bisect_left(self.ends, own.start - self.gap)
        j = bisect.bisect_right(self.starts, own.end + self.gap)
        for s in self.held[i:j]:
            own = Session(min(s.start, own.start), max(s.end, own.end), s.n + own.n, s.h + own.h, max(s.batch, own.batch), s.new + own.new, s.versions + own.versions)
        self.starts[i:j], self.ends[i:j], self.held[i:j] = [own.start], [own.end], [own]
        return own

    def settle(self) -> None:
        """What stands now are versions."""
        for s in self.held:
            s.new, s.versions = 0, [(s.batch, s.start)]

    def apply(self, batch: int, events: list[tuple[int, int, int]]) -> Iterator[Session]:
        """Puts a batch's events (second, n, h) in; gives each session that holds one of them, its
        versions those it retracts."""
        for second, n, h in events:
            self.put(Session(second, second, n, h, batch, n, []))
        seen = None
        for second, _, _ in events:
            s = self.held[bisect.bisect_right(self.starts, second) - 1]
            if s is not seen:
                seen = s
                yield s
                s.new, s.versions = 0, [(batch, s.start)]


def replay_block(first_batch: int, carry: tuple | None, cells: list[tuple[int, int, int, int]], gap: int) -> Iterator[tuple]:
    """The versions and retractions of a block's batches, of one user. cells: (batch, second, n, h) in
    order; those of batches before first_batch stand when it begins, as does the carried run
    (start, end, n, h, batch)."""
    replay = Replay(gap)
    if carry is not None:
        replay.put(Session(*carry, 0, []))
    at = 0
    while at < len(cells) and cells[at][0] < first_batch:
        batch, second, n, h = cells[at]
        replay.put(Session(second, second, n, h, batch, 0, []))
        at += 1
    replay.settle()
    while at < len(cells):
        batch, until = cells[at][0], at
        while until < len(cells) and cells[until][0] == batch:
            until += 1
        for s in replay.apply(batch, [c[1:] for c in cells[at:until]]):
            yield batch, s.start, s.end, s.n, s.new, len(s.versions), s.h, None, None
            for old_batch, old_start in s.versions:
                yield old_batch, old_start, None, None, None, None, None, batch, s.start
        at = until


def _replayed(gap: int, batches: int):
    schema = pa.schema([(x.split()[0], pa.int64()) for x in VERSION.split(", ")])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            cells, carry = table.column("cells"), table.column("carry")
            bounds, values = cells.offsets.to_pylist(), cells.values
            fields = list(zip(*(values.field(f).to_pylist() for f in ("batch", "second", "n", "h"))))
            out: list[tuple] = []
            for k, (user, block, run_) in enumerate(zip(table.column("user").to_pylist(), table.column("block").to_pylist(), carry.to_pylist())):
                before = None if run_ is None else tuple(run_[f] for f in RUN)
                out += [(user, *row) for row in replay_block(block * batches, before, fields[bounds[k] : bounds[k + 1]], gap)]
                if len(out) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


def versions(events: DataFrame, gap: int = 420, batch_seconds: int = 3600, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """Every version of every session of events (user, second, batch, h): columns of VERSION. A version's
    n_retracted standing sessions went into it; retracted_batch and retracted_start_s name the version
    that retracts it, null if none does.

    How late events are is measured; an event is read again in each block that begins between its batch
    and the batch in which the latest of its time arrive."""
    if gap >= batches * batch_seconds:
        raise ValueError("a block must be longer than the gap")
    usable = F.col("user").isNotNull() & F.col("second").isNotNull() & F.col("batch").isNotNull()
    cells = stored(
        events.filter(usable).groupBy("user", "batch", "second").agg(F.count("*").alias("n"), F.sum(F.coalesce("h", F.lit(0))).cast("long").alias("h")),
        "session_cells",
    )
    time = _div(F.col("second"), batch_seconds)
    lateness = cells.agg(F.max(F.col("batch") - time)).first()[0] or 0
    cells = cells.withColumn("slice", _div(time + lateness, batches))
    whole = F.struct(*[F.col(c).alias(p) for c, p in zip(("second", "second", "second", "n", "h", "batch"), PARTS)], F.lit(True).alias("whole"))
    slices = cells.groupBy("user", "slice").agg(F.array_sort(F.collect_list(whole)).alias("parts"))
    carry = carried(stored(slices.select("user", "slice", _folded(F.col("parts"), gap).alias("part")), "session_slices"), gap, fan)
    blocks = (
        cells.withColumn("block", F.explode(F.sequence(_div(F.col("batch"), batches), "slice")))
        .groupBy("user", "block")
        .agg(F.array_sort(F.collect_list(F.struct("batch", "second", "n", "h"))).alias("cells"))
        .join(carry.filter("carry is not null").select("user", F.col("slice").alias("block"), F.struct(*[F.col(f"carry.{f}").alias(f) for f in RUN]).alias("carry")), ["user", "block"], "left")
    )
    found = blocks.select("user", "block", "cells", "carry").mapInArrow(_replayed(gap, batches), VERSION)
    own = [x.split()[0] for x in VERSION.split(", ")]
    return found.groupBy("user", "batch", "start_s").agg(*[F.max(c).alias(c) for c in own if c not in ("user", "batch", "start_s")]).select(*own)
