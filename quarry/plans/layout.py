"""Plan shapes that keep order-dependent work distributed.

* ``running_sum``: a global prefix sum without a single-partition window
  (range partition, per-block totals, tiny offset table, per-block window).
* ``global_row_number``: the same trick with a count of ones.
* ``top_k``: ``row_number() <= k`` per group; Spark plans it as a partial
  ``WindowGroupLimit`` before the shuffle, so a hot group ships at most k rows
  per map task.
* ``bounded_broadcast``: broadcast only after measuring the side.
* ``sorted_fold``: an ordered per-key fold that streams sorted Arrow batches,
  carrying only the fold state (never a whole group).
* ``segmented_fold``: the same for folds that forget: a hot key is cut at idle
  gaps and its segments are folded in parallel.

Convention: expensive arrays are exploded with ``explode_outer`` /
``posexplode_outer`` plus a not-null filter on the generated column.  A plain
``explode`` makes the optimizer infer ``size(array) > 0`` and push it below
the projections, which evaluates the array expression (a chunk fold, 23
regex probes, an HTML parse) a second time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import cut_lineage

BLOCK_COL = "_blk"


def default_parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def running_sum(df: DataFrame, order_cols: list[str], value_col: str | list[str], out_col: str | list[str],
                inclusive: bool = True, num_blocks: int | None = None,
                checkpoint: bool = True, partition_cols: list[str] | None = None) -> DataFrame:
    """Running sum of ``value_col`` in ``order_cols`` order (per ``partition_cols``
    group if given, else over the whole frame).  Several columns are summed in one pass.

    ``order_cols`` must identify rows uniquely (ties would make the sum
    ambiguous) and start with ``partition_cols``.  Returns ``df`` plus
    ``out_col``.  Work: one range exchange, one aggregate over (block, group)
    totals, one window per (block, group): a hot group is spread over many
    blocks instead of landing in one task.
    """
    parts = list(partition_cols or [])
    values = [value_col] if isinstance(value_col, str) else list(value_col)
    outs = [out_col] if isinstance(out_col, str) else list(out_col)
    n = num_blocks or default_parts(df)
    ranged = df.repartitionByRange(n, *order_cols).withColumn(BLOCK_COL, F.spark_partition_id())
    if checkpoint:
        # Pins the block labels (AQE may re-plan a re-read) and cuts lineage.
        ranged = cut_lineage(ranged)
    totals = ranged.groupBy(BLOCK_COL, *parts).agg(*[F.sum(v).alias(f"_tot{i}") for i, v in enumerate(values)])
    before = Window.partitionBy(*parts).orderBy(BLOCK_COL).rowsBetween(Window.unboundedPreceding, -1) \
        if parts else Window.orderBy(BLOCK_COL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(BLOCK_COL, *parts,
                            *[F.coalesce(F.sum(f"_tot{i}").over(before), F.lit(0)).alias(f"_off{i}")
                              for i in range(len(values))])
    if not parts:
        offsets = F.broadcast(offsets)  # one row per block
    frame_end = 0 if inclusive else -1
    w = Window.partitionBy(BLOCK_COL, *parts).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, frame_end)
    sums = {o: F.col(f"_off{i}") + F.coalesce(F.sum(v).over(w), F.lit(0)) for i, (v, o) in enumerate(zip(values, outs))}
    # a NULL group is a group: its rows meet its offsets too
    same = ranged[BLOCK_COL] == offsets[BLOCK_COL]
    for c in parts:
        same &= ranged[c].eqNullSafe(offsets[c])
    joined = ranged.join(offsets, same).drop(offsets[BLOCK_COL], *[offsets[c] for c in parts])
    return joined.withColumns(sums).drop(*[f"_off{i}" for i in range(len(values))], BLOCK_COL)


def global_row_number(df: DataFrame, order_cols: list[str], out_col: str = "rn",
                      num_blocks: int | None = None) -> DataFrame:
    """1-based row number over the whole frame, computed block-wise."""
    return running_sum(df.withColumn("_one", F.lit(1)), order_cols, "_one", out_col,
                       num_blocks=num_blocks).drop("_one")


def top_k(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per group in ``order`` (ties broken by ``order``)."""
    w = Window.partitionBy(*group_cols).orderBy(*order) if group_cols else Window.orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast-hint ``df`` only if it has at most ``max_rows`` rows.

    The count is a cheap job on a small side; beyond the bound the frame is
    returned unhinted and the join stays a shuffle join (AQE may still turn it
    into a broadcast from measured sizes).
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def sorted_fold(df: DataFrame, key_cols: list[str], order_cols: list[str],
                fold: Callable[[Iterable], Iterator], schema,
                num_partitions: int | None = None) -> DataFrame:
    """Run ``fold`` over each key's rows in order, streaming.

    Rows are hash-partitioned by key and sorted by (key, order) inside each
    partition; ``fold`` receives (Arrow batch, mask of the rows that start a key) in
    that order and carries its own state across batch boundaries.  Keys are compared
    as Arrow values, so that 64-bit keys stay exact and NULL is one key.  Memory is
    one Arrow batch plus the fold state, whatever the size of a key's history (a hot
    key is sequential, but never materialised as one array or one frame).
    """
    n = num_partitions or default_parts(df)
    prepared = df.repartition(n, *key_cols).sortWithinPartitions(*key_cols, *order_cols)
    return prepared.mapInArrow(lambda batches: fold(key_starts(batches, key_cols)), schema)


def segmented_fold(df: DataFrame, key_cols: list[str], order_cols: list[str], time_col: str, idle: int,
                   fold: Callable[[Iterable], Iterator], schema) -> DataFrame:
    """``sorted_fold`` for a fold that knows nothing any more after a gap of ``idle`` or more
    between two rows of a key: a key is cut at such gaps, and its segments are folded apart.

    Rows are dealt by range of (key, order), so that a hot key is in many blocks, and
    each block folds the segments that it holds whole.  The few that go on in the next
    block (one a border at most) are known from the blocks' first and last rows; they
    alone are shuffled, and each is folded in order by one task.  ``order_cols`` begin
    with ``time_col``; a row without a time is a segment of its own.
    """
    names = df.columns
    ranged = df.repartitionByRange(default_parts(df), *key_cols, *order_cols).sortWithinPartitions(*key_cols, *order_cols)
    ranged = cut_lineage(ranged.withColumn(BLOCK_COL, F.spark_partition_id()))
    edge_cols = [*key_cols, time_col]
    edges = [T.StructField(f"{side}{i}", ranged.schema[c].dataType) for side in ("first", "last") for i, c in enumerate(edge_cols)]
    edge_schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("cuts", T.LongType()), *edges])

    def block_of(b):
        return b.column(b.schema.get_field_index(BLOCK_COL))[0].as_py()

    def ends(batches):
        first, last, cuts = None, None, 0
        for b, cut in segment_starts(batches, key_cols, time_col, idle):
            row = b.select(edge_cols)
            first = row.slice(0, 1) if first is None else first
            last, cuts, block = row.slice(b.num_rows - 1, 1), cuts + int(cut.sum()), block_of(b)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cuts], pa.int64()), *first.columns, *last.columns], names=edge_schema.names)

    owner, shared = _touching(ranged.mapInArrow(ends, edge_schema).collect(), len(key_cols) + 1, idle)  # a row a block

    def segments(batches):
        """(batch, cut, segment of each row, whether it goes over a border)."""
        n = 0
        for b, cut in segment_starts(batches, key_cols, time_col, idle):
            local = n + np.cumsum(cut)
            n = int(local[-1])
            block = block_of(b)
            ids = np.where(local == 0, owner[block], (block << 32) + local)
            yield b, cut, ids, np.isin(ids, shared)

    def here(batches):
        def whole():
            last = None
            for b, _, ids, over in segments(batches):
                kept = ids[~over]
                if len(kept):
                    yield b.filter(pa.array(~over)).select(names), np.diff(kept, prepend=-1 if last is None else last) != 0
                    last = kept[-1]
        return fold(whole())

    def there(batches):
        for b, _, ids, over in segments(batches):
            if over.any():
                yield b.filter(pa.array(over)).select(names).append_column("_segment", pa.array(ids[over]))

    with_segment = T.StructType([*(ranged.schema[c] for c in names), T.StructField("_segment", T.LongType())])
    rest = ranged.mapInArrow(there, with_segment)
    return ranged.mapInArrow(here, schema).unionByName(sorted_fold(rest, ["_segment"], order_cols, fold, schema))


def _touching(blocks: list, width: int, idle: int) -> tuple[dict[int, int], np.ndarray]:
    """Of each block the segment that its first rows are of, and the segments that are in two
    blocks or more.  blocks: (block, cuts in it, its first row's key and time, its last row's)."""
    owner, shared, before, segment = {}, [], None, 0
    for block, cuts, *edges in sorted(map(tuple, blocks)):
        first, last = edges[:width], edges[width:]
        goes_on = before is not None and before[:-1] == first[:-1] and None not in (before[-1], first[-1]) and first[-1] - before[-1] < idle
        if goes_on:
            shared.append(segment)
        else:
            segment = block << 32
        owner[block] = segment
        segment = (block << 32) + cuts if cuts else segment
        before = last
    return owner, np.array(shared, np.int64)


def segment_starts(batches: Iterable, key_cols: list[str], time_col: str, idle: int) -> Iterator:
    """Each batch of rows sorted by key and time, with a mask of the rows that begin a segment:
    another key than the row before, no time in one of the two, or a gap of ``idle``; the very
    first row is not marked."""
    before, first = pa.nulls(1, pa.int64()), True
    for b, new in key_starts(batches, key_cols):
        t = b.column(b.schema.get_field_index(time_col)).cast(pa.int64())
        gap = pc.subtract(t, pa.concat_arrays([before, t.slice(0, len(t) - 1)]))
        cut = new | pc.fill_null(pc.greater_equal(gap, idle), True).to_numpy(zero_copy_only=False)
        if first:
            cut[0], first = False, False
        before = t.slice(len(t) - 1, 1)
        yield b, cut


def key_starts(batches: Iterable, key_cols: list[str]) -> Iterator:
    """Each batch of rows sorted by key, with a mask of the rows whose key is not that of
    the row before (NULL equals NULL)."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(b.schema.get_field_index(c)) for c in key_cols]
        new = np.zeros(b.num_rows, dtype=bool)
        new[0] = last is None
        for k, end in zip(keys, last or [k.slice(0, 1) for k in keys]):
            before = pa.concat_arrays([end, k.slice(0, len(k) - 1)])
            differs = pc.or_(pc.fill_null(pc.not_equal(k, before), False), pc.xor(pc.is_null(k), pc.is_null(before)))
            new |= differs.to_numpy(zero_copy_only=False)
        last = [k.slice(len(k) - 1, 1) for k in keys]
        yield b, new


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    A join on a constant key against the broadcast single row, which the optimizer
    folds to a nested loop over that one row: no shuffle of ``df``.
    """
    return (df.withColumn("_k1", F.lit(0))
            .join(F.broadcast(one_row.withColumn("_k1", F.lit(0))), "_k1").drop("_k1"))
