"""Per-key results over keys of which a handful hold most rows.

The rows are range-partitioned on the composite key followed by a secondary order, with the
boundaries taken from sampled quantiles (Spark's range partitioner). As the secondary order
belongs to the partitioning key, a heavy key is split over as many partitions as its share of
the rows asks for. One pass over each sorted partition emits a partial state per key, and the
states of the keys that cross partition boundaries are stitched together afterwards: there are
at most as many states of one key as there are partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

_STATE = "part int, to_id string, edge_type string, n_edges long, n_from long, first_from string, last_from string, last_us long"
_STATE_ARROW = pa.schema([("part", pa.int32()), ("to_id", pa.string()), ("edge_type", pa.string()), ("n_edges", pa.int64()), ("n_from", pa.int64()), ("first_from", pa.string()), ("last_from", pa.string()), ("last_us", pa.int64())])
_NEVER = np.iinfo(np.int64).min


def _starts(*columns: pa.Array) -> np.ndarray:
    """True at each row that differs from the row before it in any column; nulls are equal."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    out[:1] = True
    for c in columns:
        if n > 1:
            a, b = c.slice(1), c.slice(0, n - 1)
            differs = pc.fill_null(pc.not_equal(a, b), True)
            both_null = pc.and_(pc.is_null(a), pc.is_null(b))
            out[1:] |= pc.and_(differs, pc.invert(both_null)).to_numpy(zero_copy_only=False)
    return out


def _partial_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of one sorted partition, one per key, carried over Arrow batches.

    A state is [to_id, edge_type, edges, distinct from_id, first from_id, last from_id, last
    observation]; two neighbouring states of a key share a from_id if the last of the one is
    the first of the other.
    """
    part = TaskContext.get().partitionId()
    open_state: list | None = None
    last_edge: tuple | None = None

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 7
        columns[6] = [None if x == _NEVER else x for x in columns[6]]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), *(pa.array(c, f.type) for c, f in zip(columns, list(_STATE_ARROW)[1:]))], schema=_STATE_ARROW)

    for batch in batches:
        if not batch.num_rows:
            continue
        to, kind, source, edge, us = (batch.column(i) for i in range(5))
        new_edge = _starts(to, kind, source, edge)
        if last_edge == (to[0].as_py(), kind[0].as_py(), source[0].as_py(), edge[0].as_py()):
            new_edge[0] = False
        last_edge = (to[-1].as_py(), kind[-1].as_py(), source[-1].as_py(), edge[-1].as_py())
        starts = _starts(to, kind)
        new_from = _starts(to, kind, source)
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], batch.num_rows) - 1
        seen = pc.fill_null(us, _NEVER).to_numpy(zero_copy_only=False)
        edges, froms, last = np.add.reduceat(new_edge.astype(np.int64), at), np.add.reduceat(new_from.astype(np.int64), at), np.maximum.reduceat(seen, at)
        a, b = pa.array(at), pa.array(ends)
        rows = [list(x) for x in zip(to.take(a).to_pylist(), kind.take(a).to_pylist(), edges.tolist(), froms.tolist(), source.take(a).to_pylist(), source.take(b).to_pylist(), last.tolist())]
        if open_state is not None:
            first = rows[0]
            if open_state[:2] == first[:2]:
                first[2] += open_state[2]
                first[3] += open_state[3] - (open_state[5] == first[4])
                first[4] = open_state[4]
                first[6] = max(first[6], open_state[6])
            else:
                rows.insert(0, open_state)
        open_state = rows.pop()
        if rows:
            yield batch_of(rows)
    if open_state is not None:
        yield batch_of([open_state])


def key_states(edges: DataFrame) -> DataFrame:
    """Stitched per-(to_id, edge_type) counts over whole ``edges``.

    Returns to_id, edge_type, n_edges (distinct edges), n_from (distinct from_id) and
    last_observed. Rows with a null or empty ``to_id`` are left out; a null ``edge_type`` or
    ``from_id`` is a value of its own. A delivery again of an edge (same edge_id and endpoints)
    counts once; one with other endpoints is an edge of each of its pairs. A key without any
    observation time has a null last_observed. An empty table gives an empty result.
    """
    rows = edges.where((F.col("to_id") != "") & F.col("to_id").isNotNull()).select(
        F.col("to_id").cast("string"), F.col("edge_type").cast("string"), F.col("from_id").cast("string"), F.col("edge_id").cast("long"), F.unix_micros(F.col("observed_at").cast("timestamp")).alias("us")
    )
    order = ["to_id", "edge_type", "from_id", "edge_id"]
    states = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_partial_states, _STATE)
    pieces = F.sort_array(F.collect_list(F.struct("part", "first_from", "last_from")))
    stitched = states.groupBy("to_id", "edge_type").agg(F.sum("n_edges").alias("n_edges"), F.sum("n_from").alias("n_from"), F.max("last_us").alias("last_us"), pieces.alias("pieces"))
    shared = F.when(F.size("pieces") < 2, F.lit(0)).otherwise(
        F.size(F.filter(F.arrays_zip(F.slice("pieces", 1, F.size("pieces") - 1).alias("a"), F.slice("pieces", 2, F.size("pieces") - 1).alias("b")), lambda x: x["a"]["last_from"].eqNullSafe(x["b"]["first_from"])))
    )
    return stitched.select("to_id", "edge_type", "n_edges", (F.col("n_from") - shared).alias("n_from"), F.timestamp_micros("last_us").cast("timestamp_ntz").alias("last_observed"))


def heavy_pairs(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """The rows of :func:`key_states` that hold at least ``share`` of all edges."""
    states = key_states(edges)
    total = states.groupBy().agg(F.sum("n_edges").alias("total")).scalar()
    return states.where(F.col("n_edges") >= F.lit(share) * total)
