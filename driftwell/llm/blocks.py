"""Members of groups dealt to tasks that compare each pair of a group exactly once.

A group of up to ``block`` members is one task. A larger one is cut into blocks by hash, and each
pair of blocks (and each block with itself) is a task of its own: none holds more than two
blocks, whatever the group's size. Tasks stream through Python one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from driftwell.llm.common import spread_join


def dealt(members: DataFrame, block: int) -> DataFrame:
    """``members`` (grp, id, ...) with task, and side: 0 whole block, 1 and 2 the two blocks of a pair."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("grp_rows"))
    sized = spread_join(members, sizes, "grp", "grp_rows", members.count()).withColumn("grp_blocks", F.expr(f"cast(ceil(grp_rows / {block}) as int)"))
    placed = sized.withColumn("blk", F.pmod(F.xxhash64("id", F.lit(5)), F.col("grp_blocks").cast("long")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("grp_blocks") - 1)))
    task = F.concat_ws("-", F.col("grp").cast("string"), F.least("blk", "other"), F.greatest("blk", "other"))
    side = F.when(F.col("blk") == F.col("other"), 0).when(F.col("blk") < F.col("other"), 1).otherwise(2)
    return pairs.select(*members.columns, task.alias("task"), side.alias("side"))


def per_task(rows: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, order: tuple[str, ...] = ("side", "id")) -> DataFrame:
    """Apply ``fn`` to all rows of each task, in the order given; one task is held at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ready: dict[str, list] = {f.name: [] for f in arrow}
        waiting = 0

        def finish() -> None:
            nonlocal waiting
            made = fn(pa.concat_batches(held) if len(held) > 1 else held[0])
            held.clear()
            for name in ready:
                ready[name].append(pa.array(made[name], arrow.field(name).type))
            waiting += len(made[arrow.names[0]])

        def emit() -> pa.RecordBatch:
            nonlocal waiting
            made = pa.RecordBatch.from_arrays([pa.concat_arrays(ready[f.name]) for f in arrow], schema=arrow)
            for name in ready:
                ready[name] = []
            waiting = 0
            return made

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("task")
            cuts = [0, *(np.flatnonzero(pc.not_equal(task.slice(1), task.slice(0, len(task) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist(), len(task)]
            for a, b in zip(cuts, cuts[1:]):
                own = task[a].as_py()
                if held and own != last:
                    finish()
                    if waiting > 20_000:
                        yield emit()
                held.append(batch.slice(a, b - a))
                last = own
        if held:
            finish()
        if waiting:
            yield emit()

    return rows.repartition("task").sortWithinPartitions("task", *order).mapInArrow(run, out)
