"""Greedy packing of ordered rows, in parallel inside a group of any size.

Greedy packing looks sequential, but where a batch would end if it began at a
row is known from the rows that follow, a bounded number of them. Rows get
their place in the whole order from a range sort and the counts of its
partitions, and are cut into slices of ``SLICE`` places. A slice alone tells,
for every place among its first rows where a batch may begin, at which place of
the next slice the chain of batches goes on. These maps are composed by
doubling, two slices, four, eight at a time, until every slice knows its true
entry; then each marks its batches. No task sees more than a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.storage import materialize

SLICE = 1 << 16


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with ``_place``, their number from 0 in the order of ``order``, without one task that sees all."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialize(spread.withColumn("_at", F.monotonically_increasing_id()), "places")
    part = F.shiftrightunsigned("_at", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition of the sort
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before")


def _chain(table: pa.Table, size: int, budget: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a slice and the rows around it: which rows are its own (as positions), where each one's batch ends, which begin a group."""
    place, tokens = table.column("_place").to_numpy(), table.column("_tokens").to_numpy().astype(np.int64)
    group = table.column("_group").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = np.concatenate([[place[0] == 0], group[1:] != group[:-1]])
    at = int(table.column("_slice")[0].as_py()) * size
    own = np.flatnonzero((place >= at) & (place < at + size))
    spent = np.cumsum(tokens)
    row = np.arange(len(place))
    full = np.searchsorted(spent, spent - tokens + budget, side="right")
    heads = np.append(np.flatnonzero(first), len(place))
    group_end = heads[np.searchsorted(heads, row, side="right")]
    return own, np.minimum(np.minimum(np.maximum(full, row + 1), row + most), group_end), first


def pack_batches(items: DataFrame, group: str, order: Sequence[str], tokens: str, budget: int, most: int, size: int = SLICE) -> DataFrame:
    """``items`` (group, order, tokens) with ``batch``: a new one when the budget or the number of items would be passed.

    Batches count from 1 in each group; a row over the budget is a batch
    alone. Tokens of null (and below 0) count as none; rows without a group are a group; rows
    that are equal in order are taken by their tokens. An empty table gives no rows.
    """
    size = max(size, most)  # a batch reaches into the next slice at most
    columns = list(dict.fromkeys([group, *order, tokens]))
    rows = items.select(*columns).withColumn("_group", F.to_json(F.struct(group))).withColumn("_tokens", F.greatest(F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)), F.lit(0)))
    spread = materialize(placed(rows, list(dict.fromkeys([group, *order, tokens]))), "packing")
    own = F.floor(F.col("_place") / size).cast("bigint")
    offset = F.col("_place") % size
    # a row stands in its slice, in the one before if that one's batches may reach it, and the last row in the one after
    seats = F.array_compact(F.array(own, F.when((offset < most) & (own > 0), own - 1), F.when(offset == size - 1, own + 1)))
    seated = spread.select("_place", "_group", "_tokens", F.explode(seats).alias("_slice"))

    def exits(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        rows_, ends, _ = _chain(table, size, budget, most)
        n, low = len(rows_), int(rows_[0]) if len(rows_) else 0
        out = np.empty(n, dtype=np.int64)
        for i in range(n - 1, -1, -1):
            end = int(ends[low + i]) - low
            out[i] = end - n if end >= n else out[end]
        entries = min(n, most)
        return pa.table({"slice": pa.array([table.column("_slice")[0].as_py()] * entries, pa.int64()), "entry": pa.array(np.arange(entries)), "exit": pa.array(out[:entries])})

    last = spread.agg(F.max("_place").alias("m")).first()["m"]
    known = items.sparkSession.createDataFrame([(0, 0)], "slice bigint, entry bigint")
    slices = 0 if last is None else int(last) // size + 1
    if slices > 1:
        step = materialize(seated.groupBy("_slice").applyInArrow(exits, "slice bigint, entry bigint, exit bigint"), "packing-exits")
        reach = 1
        while reach < slices:
            on = known.join(step, ["slice", "entry"]).select((F.col("slice") + reach).alias("slice"), F.col("exit").alias("entry")).where(F.col("slice") < slices)
            known = materialize(known.unionByName(on), "packing-known")
            far = step.select((F.col("slice") - reach).alias("slice"), F.col("entry").alias("exit"), F.col("exit").alias("further"))
            reach *= 2
            if reach < slices:
                step = materialize(step.join(far, ["slice", "exit"]).select("slice", "entry", F.col("further").alias("exit")), "packing-exits")

    entered = seated.unionByName(known.select(F.lit(-1).cast("bigint").alias("_place"), F.lit(None).cast("string").alias("_group"), F.col("entry").alias("_tokens"), F.col("slice").alias("_slice")))

    def mark(table: pa.Table) -> pa.Table:
        place = table.column("_place").to_numpy()
        entered_at = table.column("_tokens").to_numpy()[place == -1]
        entry = int(entered_at[0]) if len(entered_at) else 0  # past the last slice stands a copied row only
        table = table.filter(pa.array(place >= 0)).sort_by("_place")
        rows_, ends, first = _chain(table, size, budget, most)
        n, low = len(rows_), int(rows_[0]) if len(rows_) else 0
        starts, i = np.zeros(n, dtype=np.int64), entry
        while i < n:
            starts[i] = 1
            i = int(ends[low + i]) - low
        return pa.table({"_place": table.column("_place").take(pa.array(rows_)), "_slice": pa.array([table.column("_slice")[0].as_py()] * n, pa.int64()), "_starts": pa.array(np.cumsum(starts)), "_head": pa.array(first[rows_])})

    if not slices:
        return spread.select(*columns, F.lit(None).cast("int").alias("batch"))
    marked = materialize(entered.groupBy("_slice").applyInArrow(mark, "_place bigint, _slice bigint, _starts bigint, _head boolean"), "packing-marks")
    counts = marked.groupBy("_slice").agg(F.max("_starts").alias("_n"))  # a row for each slice
    before = counts.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_before"))
    numbered = marked.join(F.broadcast(before), "_slice").withColumn("_nth", F.col("_starts") + F.col("_before"))
    joined = spread.join(numbered.select("_place", "_nth", "_head"), "_place")
    heads = joined.where("_head").select("_group", F.col("_nth").alias("_first"))  # one row a group
    return joined.join(heads, "_group").select(*columns, (F.col("_nth") - F.col("_first") + 1).cast("int").alias("batch"))

