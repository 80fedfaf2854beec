"""Mixing sources to target weights by a Pfair schedule.

The unit of scheduling is a block of about ``block_chars`` characters of one
source. The ``i``-th block of a source with weight ``w`` may not be placed
before slot ``floor((i - 1) / w)`` and must be placed before slot
``ceil(i / w)``; in every slot the released block with the earliest deadline
goes next. With weights that sum to one this meets all deadlines, so after any
number of slots each source has had its share to within less than one block.

Weights are held as whole shares of a period of ``PERIOD`` slots, far more than
any mix has, so their rounding moves a source by less than a thousandth of a
block over 2**42 slots. The slots of the mix are worked out one after another by
a single task, as each depends on those before; it reads no documents, takes
one step per block, and hands on chunks of ``CHUNK`` slots of a source. A
shorter ``period`` makes the schedule repeat: a block's slot then follows from
its number by division.

The mix reads each source from its start as often as its weight asks for, until
every source has been read in full: no document is left out, and sources that
are short for their weight are repeated (``epoch`` counts the readings).
"""
from __future__ import annotations

import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacancia.llm.texts import own_columns, whole
from vacancia.session import reliable

#: Slots in a period: the resolution of the weights.
PERIOD = 1 << 52
#: Slots of one source that stand in one row of the plan.
CHUNK = 256
#: A plan of up to this many slots is broadcast (24 bytes each).
MOST_BROADCAST = 4_000_000
BLOCK_CHARS = 8192
#: More sources than this are refused: their weights are held by the driver.
MAX_SOURCES = 100_000
#: Default weights are the sources' shares of the text to this power.
TEMPERATURE = 0.9
#: Rows of a source that are numbered together in one task, about.
GROUP_ROWS = 512


def shares(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole shares of the period by largest remainder, at least one for each source."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    period = max(period, len(weights))
    free = period - len(weights)
    each = {s: Fraction(w) for s, w in weights.items()}
    scale = free / sum(each.values(), Fraction(0)) if each else 0
    exact = {s: w * scale for s, w in each.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in rest[: period - sum(out.values())]:
        out[s] += 1
    return out


def period_slots(units: Mapping[str, int], length: int | None = None) -> Iterator[tuple[str, int, int, int, int]]:
    """``(source, i, slot, release, deadline)`` of the first ``length`` slots of a period by earliest deadline first."""
    period = sum(units.values())
    waiting = [(0, -(-period // u), s, 1) for s, u in units.items()]       # release, deadline, source, i
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    for slot in range(period if length is None else min(period, length)):
        while waiting and waiting[0][0] <= slot:
            release, deadline, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, i, release))
        deadline, s, i, release = heapq.heappop(ready)
        yield s, i, slot, release, deadline
        if i < units[s]:
            heapq.heappush(waiting, (i * period // units[s], -(-(i + 1) * period // units[s]), s, i + 1))


def _plan(spark: SparkSession, units: Mapping[str, int], length: int, names: list[str]) -> DataFrame:
    """The slots by source and chunk: ``names`` are those of the source, the chunk, and the arrays of slot, release and deadline."""
    kinds = [pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held: dict[str, tuple[array, array, array]] = defaultdict(lambda: (array("q"), array("q"), array("q")))
            begun: dict[str, int] = {}
            out: list[tuple] = []

            def batch_of() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)
                out.clear()
                return made
            for s, i, *values in period_slots(units, length):
                arrays = held[s]
                begun[s] = (i - 1) // CHUNK
                for column, value in zip(arrays, values, strict=True):
                    column.append(value)
                if i % CHUNK == 0:
                    out.append((s, begun[s], *held.pop(s)))
                    if len(out) >= 1000:
                        yield batch_of()
            for s, arrays in held.items():
                out.append((s, begun[s], *arrays))
                if len(out) >= 1000:
                    yield batch_of()
            yield batch_of()
    key, chunk, *arrays = names
    return reliable(spark.range(1, numPartitions=1).mapInArrow(
        run, f"{key} string, {chunk} bigint, " + ", ".join(f"{n} array<bigint>" for n in arrays)))


def _source_key(source: Column) -> Column:
    """Sources as text that is never null: a null source is a source of its own."""
    return F.concat(F.when(source.isNull(), "-").otherwise("+"), F.coalesce(source.cast("string"), F.lit("")))


def _placed(docs: DataFrame, weights: Mapping[str | None, float] | None, source: str, text: str, doc_id: str,
            block_chars: int, period: int, temperature: float, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """Every row of ``docs`` once per reading, with the columns that the second value names."""
    plain = ("key", "size", "mark", "part", "total", "base", "parts", "blocks", "units", "reads",
             "offset", "first", "epoch", "block", "i", "chunk", "slot", "release", "deadline",
             "slots", "releases", "deadlines")
    c = dict(zip(plain, own_columns(docs, *plain), strict=True))
    spark = docs.sparkSession
    sized = docs.withColumns({c["key"]: _source_key(docs[source]), c["size"]: F.length(whole(docs[text])),
                              c["mark"]: F.xxhash64(F.lit(seed), docs[doc_id], docs[text])})

    # Rows and characters of each source over the whole table: one row a source.
    known = sized.groupBy(c["key"]).agg(F.count(F.lit(1)).alias("n"), F.sum(c["size"]).alias("chars"))
    found = {r[0]: (r["n"], r["chars"]) for r in known.limit(MAX_SOURCES + 1).collect()}
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:
        # No source is less than its one block: a lighter one would ask for the others to be read again and again.
        wanted = {s: max(chars, block_chars) ** temperature for s, (_, chars) in found.items()}
    else:
        named = {("-" if s is None else f"+{s}"): w for s, w in weights.items()}
        if missing := set(found) - set(named):
            raise ValueError(f"no weight for sources {sorted(missing)[:5]}")
        wanted = {s: named[s] for s in found}
    units = shares(wanted, period)
    slots = sum(units.values())
    blocks = {s: max(1, -(-chars // block_chars)) for s, (_, chars) in found.items()}
    length = max((-(-blocks[s] * slots // units[s]) for s in units), default=0)   # every source read in full
    rows = [(s, -(-found[s][0] // GROUP_ROWS), blocks[s], units[s], length * units[s] // slots // blocks[s] + 2)
            for s in sorted(found)]
    facts = spark.createDataFrame(rows, f"{c['key']} string, {c['parts']} long, {c['blocks']} long, "
                                        f"{c['units']} long, {c['reads']} long")
    plan = _plan(spark, units, length, [c[n] for n in ("key", "chunk", "slots", "releases", "deadlines")])
    if min(slots, length) <= MOST_BROADCAST:
        plan = F.broadcast(plan)

    # A source's rows in the order of their hash, cut into as many ranges as its size asks for.
    range_of = F.shiftright(F.shiftrightunsigned(c["mark"], 32) * F.col(c["parts"]), 32)
    dealt = sized.join(F.broadcast(facts), c["key"]).withColumn(c["part"], range_of)   # a row a source
    sums = dealt.groupBy(c["key"], c["part"]).agg(F.sum(c["size"]).alias(c["total"]))
    before = Window.partitionBy(c["key"]).orderBy(c["part"]).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(c["key"], c["part"], F.coalesce(F.sum(c["total"]).over(before), F.lit(0)).alias(c["base"]))
    inside = (Window.partitionBy(c["key"], c["part"]).orderBy(F.col(c["mark"]), docs[doc_id], docs[text])
              .rowsBetween(Window.unboundedPreceding, -1))
    offset = F.col(c["base"]) + F.coalesce(F.sum(c["size"]).over(inside), F.lit(0))
    read = F.explode(F.sequence(F.lit(1).cast("long"), F.col(c["reads"])))
    block = (F.col(c["epoch"]) - 1) * F.col(c["blocks"]) + F.col(c["first"])
    turn = F.expr(f"{c['block']} div {c['units']}")
    placed = (
        dealt.join(bases, [c["key"], c["part"]]).withColumn(c["offset"], offset)
        .withColumn(c["first"], F.least(F.expr(f"{c['offset']} div {block_chars}"), F.col(c["blocks"]) - 1))
        .withColumn(c["epoch"], read).withColumn(c["block"], block)
        .withColumn(c["i"], (F.col(c["block"]) % F.col(c["units"])))
        .withColumn(c["chunk"], F.expr(f"{c['i']} div {CHUNK}"))
        .join(plan, [c["key"], c["chunk"]])                                            # a row a source and chunk
        .withColumns({c[n]: F.get(c[f"{n}s"], (F.col(c["i"]) % CHUNK).cast("int")) + turn * slots
                      for n in ("slot", "release", "deadline")})
        .filter(F.col(c["slot"]) < length)
    )
    return placed, c


def schedule(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source",
             text: str = "text", doc_id: str = "doc_id", block_chars: int = BLOCK_CHARS, period: int = PERIOD,
             temperature: float = TEMPERATURE, seed: int = 7) -> DataFrame:
    """``doc_id, source, epoch, block, release, deadline, slot, offset``, a row per document and reading.

    ``block`` counts the source's blocks over all its readings from 0, the
    window is ``release <= slot < deadline``, and ``offset`` is the number of
    the source's characters before the document in one reading. A document lies
    in the block that it starts in. ``weights`` are by source (None for a null
    source); sources without one are refused. Within a source the order is a
    hash of id and text. Null texts have length zero, a null source is a source,
    repeated rows are repeated, an empty table gives an empty result.
    """
    placed, c = _placed(docs, weights, source, text, doc_id, block_chars, period, temperature, seed)
    names = ("epoch", "block", "release", "deadline", "slot", "offset")
    return placed.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"),
                         *[F.col(c[n]).alias(n) for n in names])


def mix_documents(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source",
                  text: str = "text", doc_id: str = "doc_id", block_chars: int = BLOCK_CHARS, period: int = PERIOD,
                  temperature: float = TEMPERATURE, seed: int = 7) -> DataFrame:
    """The documents in mix order, short sources repeated; the columns are those of ``docs``."""
    placed, c = _placed(docs, weights, source, text, doc_id, block_chars, period, temperature, seed)
    ordered = placed.repartitionByRange(c["slot"], c["offset"]).sortWithinPartitions(c["slot"], c["offset"], c["mark"])
    return ordered.select(*[docs[n] for n in docs.columns])
