"""Filling fixed-capacity containers with items by a plan over the length histogram.

Best-fit decreasing needs only how many items there are of each length: the histogram has at most ``capacity`` rows, so
the plan is made once on the driver from counts, and every item finds its slot by its rank within its length. Ranks are
the rank within the partition plus the count of that length in earlier partitions, so a length that a third of all
items share is never gathered in one task.

Defined cases: an item larger than the capacity is cut into full pieces and a remainder, others are never cut; NULL and
empty texts have size 0, take no room and are spread evenly over the containers; repeated rows are items of their own;
no items give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexitile.sources.tables import ensure_checkpoint_dir


def plan_slots(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: ``(size, first_rank, n_items, first_container, per_container)`` and the number of containers.

    Open containers are kept as ranges of equal free room, so a length costs as many steps as there are ranges it uses.
    """
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> [(first container, how many)]
    plan, used = [], 0
    for size in sorted((s for s in histogram if s > 0), reverse=True):
        left, rank = histogram[size], 0
        for room in sorted(r for r in ranges if r >= size):
            while left and ranges[room]:
                first, n = ranges[room].pop()
                per = min(room // size, left)
                take = min(n, max(1, left // per))
                if n > take:
                    ranges[room].append((first + take, n - take))
                plan.append((size, rank, take * per, first, per))
                ranges[room - per * size].append((first, take))
                rank, left = rank + take * per, left - take * per
            if not ranges[room]:
                ranges.pop(room, None)
            if not left:
                break
        while left:
            per = min(capacity // size, left)
            take = max(1, left // per)
            plan.append((size, rank, take * per, used, per))
            ranges[capacity - per * size].append((used, take))
            rank, left, used = rank + take * per, left - take * per, used + take
    return plan, used


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """``id_col, piece_no, piece_start, piece_size, container_id``: one row for each piece of each item."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    ensure_checkpoint_dir(sizes.sparkSession)
    n = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    pieces = sizes.select(F.col(id_col), n.alias("n")).select(
        id_col, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / capacity).cast("bigint"))).alias("piece_no")
    )
    pieces = pieces.select(id_col, "piece_no", (F.col("piece_no") * capacity).alias("piece_start"), F.least(F.col("n") - F.col("piece_no") * capacity, F.lit(capacity).cast("bigint")).alias("piece_size"))
    pieces = pieces.checkpoint()  # read three times; its partitions and their order are fixed from here on
    schema = T.StructType([*pieces.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local_rank", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            ranks = []
            for s in b.column(3).to_pylist():
                ranks.append(seen[s])
                seen[s] += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(ranks, pa.int64())], names=schema.names)

    numbered = pieces.mapInArrow(number, schema)
    counts = pieces.groupBy(F.spark_partition_id().alias("part"), "piece_size").count()
    before = F.sum("count").over(Window.partitionBy("piece_size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "piece_size", F.coalesce(before, F.lit(0)).alias("offset"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("piece_size").count().collect()}  # at most capacity + 1 rows
    plan, containers = plan_slots(histogram, capacity)
    # The slots of a size follow each other, so a slot is found by binary search over the plan's first slots. The plan
    # has a few rows for each of the at most `capacity` sizes, whatever the number of items.
    base, at = {}, 0
    for size in sorted({p[0] for p in plan}):
        base[size], at = at, at + histogram[size]
    ordered = sorted((base[s] + rank, first, per) for s, rank, _, first, per in plan)
    starts, firsts, pers = (np.array([o[i] for o in ordered], dtype=np.int64) for i in range(3))
    shared = sizes.sparkSession.sparkContext.broadcast((base, starts, firsts, pers))

    @F.pandas_udf("bigint")
    def container(size, rank):
        import pandas as pd

        base, starts, firsts, pers = shared.value
        size, rank = size.to_numpy(), rank.to_numpy()
        if not len(starts):
            return pd.Series(np.zeros(len(size), dtype=np.int64))
        slot = rank + np.array([base.get(s, 0) for s in size.tolist()], dtype=np.int64)
        k = np.searchsorted(starts, slot, side="right") - 1
        k = np.clip(k, 0, None)
        full = firsts[k] + (slot - starts[k]) // pers[k]
        return pd.Series(np.where(size == 0, rank % max(1, containers), full))

    ranked = numbered.join(offsets, ["part", "piece_size"])
    return ranked.select(id_col, "piece_no", "piece_start", "piece_size", container("piece_size", F.col("offset") + F.col("local_rank")).alias("container_id"))
