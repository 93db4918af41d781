"""Comparing rows that a sort has brought together by a leading key, without ever holding an unbounded group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

Compare = Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]]
_ARROW = {"long": pa.int64(), "int": pa.int32()}


def _stretches(batches: Iterable[pa.RecordBatch], cell_rows: int) -> Iterator[tuple[list[np.ndarray], np.ndarray | None]]:
    """Columns of whole runs of the sorted first column, with None; of runs of over ``cell_rows`` rows, pieces with the rows' ranks."""
    kept: list[np.ndarray] | None = None
    large, gone = None, 0  # the key of the large run at hand, and its rows so far
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if large is not None and len(cols[0]):
            n = int(np.searchsorted(cols[0], large, "right"))
            if n:
                yield [x[:n] for x in cols], np.arange(gone, gone + n)
                gone, cols = gone + n, [x[n:] for x in cols]
            if len(cols[0]):
                large = None
        if not len(cols[0]):
            continue
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols)]
        key = cols[0]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(first, len(key)))
        over = sizes > cell_rows
        at = int(first[-1])
        if over.any():
            row = np.repeat(over, sizes)
            rank = np.arange(len(key)) - np.repeat(first, sizes)
            yield [x[row] for x in cols], rank[row]
            if over[-1]:
                large, gone, kept = key[-1], int(sizes[-1]), None
            else:
                kept = [x[at:] for x in cols]
            row[at:] = True
            if not row.all():
                yield [x[~row] for x in cols], None
        else:
            kept = [x[at:] for x in cols]
            if at:
                yield [x[:at] for x in cols], None
    if kept is not None:
        yield kept, None


def meet_in_cells(rows: DataFrame, compare: Compare, out: Sequence[str], cell_rows: int = 1 << 14) -> DataFrame:
    """What ``compare`` finds among the rows of each cell, as long columns ``out``: an equality join that emits findings only.

    ``rows`` holds longs and ints, the cell's key first. ``compare`` gets columns of whole cells sorted by key, and the rows' half:
    rows of half 0 are to be compared with all of their cell, others with those of the other half. Cells of over ``cell_rows``
    rows are passed on, cut into blocks and compared as pairs of blocks, each pair a task's cell of its own: so no task holds
    more than two blocks of a cell, however many rows share it, and no pair is left out.
    """
    names, kinds = [f.name for f in rows.schema], [f.dataType.simpleString().replace("bigint", "long") for f in rows.schema]
    fields = [*zip(names, kinds), ("__block", "int"), *((c, "long") for c in out)]
    schema, arrow = ", ".join(f"`{n}` {k}" for n, k in fields), pa.schema([(n, _ARROW[k]) for n, k in fields])
    width = len(names)

    def passed(cols: list[np.ndarray], block: np.ndarray) -> pa.RecordBatch:
        n = len(block)
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(block.astype(np.int32)), *(pa.nulls(n, pa.int64()) for _ in out)], schema=arrow)

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        n = len(cols[0])
        return pa.RecordBatch.from_arrays([*(pa.nulls(n, _ARROW[k]) for k in kinds), pa.nulls(n, pa.int32()), *(pa.array(c) for c in cols)], schema=arrow)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, rank in _stretches(batches, cell_rows):
            if rank is None:
                yield found(compare(cols, np.zeros(len(cols[0]), np.int8)))
            else:
                yield passed(cols, rank // cell_rows)

    key = names[0]
    first = cut(rows.repartition(key).sortWithinPartitions(key).mapInArrow(small, schema))
    done = first.where("__block IS NULL").select(*out)
    rest = first.where("__block IS NOT NULL").select(*names, "__block")
    if rest.isEmpty():
        return done
    blocks = rest.groupBy(key).agg((F.max("__block") + 1).alias("__blocks"))
    placed = rest.join(blocks, key).withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    half = F.when(F.col("__block") == F.col("__with"), 0).when(F.col("__block") < F.col("__with"), 1).otherwise(2)
    placed = placed.select(F.xxhash64(key, F.least("__block", "__with"), F.greatest("__block", "__with")).alias("__cell"), half.cast("int").alias("__half"), *names)

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches):
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            cols = compare([cols[0], *cols[3:]], cols[1])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], list(out))

    more = placed.repartition("__cell").sortWithinPartitions("__cell").mapInArrow(large, ", ".join(f"`{c}` long" for c in out))
    return done.unionByName(more)


def strips(later: np.ndarray, budget: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, i + 1 .. i + later[i]), about ``budget`` of them at a time."""
    total = np.concatenate([[0], np.cumsum(later)])
    done = 0
    while done < len(later):
        stop = max(done + 1, int(np.searchsorted(total, total[done] + budget, "right")) - 1)
        n = later[done:stop]
        a = np.repeat(np.arange(done, stop), n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(total[done:stop] - total[done], n)
        done = stop


def whole_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each run of equal values of the sorted first column lies in one; for runs of bounded length."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        at = int(np.searchsorted(key, key[-1]))
        if at == 0 and kept and key[-1] == last:
            kept.append(batch)
            continue
        head = [*kept, batch.slice(0, at)] if at else kept
        if head:
            yield _joined(head)
        kept, last = [batch.slice(at)], key[-1]
    if kept:
        yield _joined(kept)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
