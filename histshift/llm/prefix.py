"""Distributed prefix sums: running totals within groups, over all tasks, in a total order.

Rows are dealt by ranges of (group, order), so that a group with a third of all rows covers as
many tasks as its share; each task sorts its range and sums within it. What crosses tasks is one
total per (task, group): at most tasks + groups rows, whose running totals are added back.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histshift.llm.common import write_table


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str, name: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (long, not null) over the earlier rows of the same
    group. Groups and order compare ascending; a null sorts first and equals a null. Rows that
    agree in all of group and order stand in any order. Written as a table.
    """
    cols = df.columns
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)

    def run(batches):
        task, last, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for g in group:
                c = b.column(g)
                x, y = c.slice(1), c.slice(0, len(c) - 1)
                differ = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(pc.is_null(x), pc.is_null(y)))
                new[1:] |= differ.to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(new)
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(v) - v
            first = tuple(b.column(g)[0].as_py() for g in group)
            carry = total if first == last else 0
            base = sums[begin].copy()
            base[0] -= carry
            sums -= np.repeat(base, np.diff(np.r_[begin, len(v)]))
            last, total = tuple(b.column(g)[len(v) - 1].as_py() for g in group), int(sums[-1] + v[-1])
            yield pa.record_batch([*(b.column(c) for c in cols), pa.array(sums),
                                   pa.array(np.full(len(v), task), pa.int32())], names=[*cols, "_within", "_task"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = write_table(dealt.mapInArrow(run, f"{kinds}, _within long, _task int"), f"{name}-sorted")
    last = rows.groupBy(*group, "_task").agg(F.max(F.col("_within") + F.col(value)).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = last.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    totals = write_table(totals.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(group)})
                         .withColumnRenamed("_task", "_t"), f"{name}-totals")
    same = F.col("_task") == F.col("_t")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(totals, same).select(*cols, (F.col("_within") + F.col("_base")).alias(out))
