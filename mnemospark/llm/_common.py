"""Helpers shared by the training-data operators: shared storage and prefix sums."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.storage import cut


#: Arrow batches hold so many bytes at most (and one row at least): texts differ in length by orders of magnitude.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches; by default they hold ten thousand rows, however long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trimmed(run):
    """run (an iterator function of a Python task), returning freed memory to the system at its end.

    Python workers are used again by later stages; without this each keeps
    the most that any stage has needed.
    """

    @functools.wraps(run)
    def outer(batches):
        import pyarrow

        try:
            yield from run(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return outer


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage durably."""
    bound_batches(df.sparkSession)
    return cut(df, name, compression)


def text_id(column: Column | str) -> Column:
    """An id as text, for Python tasks: whole numbers beside nulls reach pandas as doubles and lose their last digits."""
    return (F.col(column) if isinstance(column, str) else column).cast("long").cast("string")


def whole_ids(ids: Iterable):
    """The ids of text_id() as nullable whole numbers."""
    import pandas as pd

    return pd.array([None if i is None else int(i) for i in ids], "Int64")


#: lookup() takes keys of more than this part of all rows as hot: they are fewer than HOT_KEYS.
HOT_KEYS = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str, by: list[str]) -> DataFrame:
    """rows with the other columns of table (null where it has no such key), whatever the keys' frequencies.

    table is a stored one with a row a key, of which `count` says how many
    rows have it. Keys with over 1 / HOT_KEYS of all counted rows are broadcast
    (fewer than HOT_KEYS rows, as counts add up to the total), and their rows
    are dealt out by a hash of the columns `by`; the rest is a common join.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    rest = [c for c in table.columns if c not in keys]
    hot, held = F.col(count) * HOT_KEYS > total, F.struct(*rest)
    marked = rows.join(F.broadcast(table.where(hot).select(*keys, held.alias("hot_held"))), keys, "left")
    marked = marked.withColumn("hot_part", F.when(F.col("hot_held").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*by), F.lit(1 << 20))))
    common = table.where(~hot).select(*keys, held.alias("cold_held"), F.lit(0).cast("long").alias("hot_part"))
    out = marked.join(common, [*keys, "hot_part"], "left").withColumn("any_held", F.coalesce("hot_held", "cold_held"))
    return out.select(*rows.columns, *[F.col(f"any_held.{c}").alias(c) for c in rest])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_ascii(column: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(column, upper, upper.lower())


def open_fs(uri: str):
    """(filesystem, path) of a URI on any store pyarrow reaches; a bare path is local."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


#: Ranking cells: one for so many rows, and so many at least.
CELL_ROWS, LEAST_CELLS = 50_000, 64


def gapless_rank(rows: DataFrame, within: list[str], keys: list[str], name: str) -> DataFrame:
    """rows (a stored table) with `name`: a gapless rank from 0 within each value of `within` (never null).

    Rows are dealt over hash cells of their keys; ranks are counted within a
    cell and begin where the cells before it end, so that no value of
    `within`, however common, is one task's work. The order is that of the
    hash cells: arbitrary, but the same whenever it is computed.
    """
    cells = max(LEAST_CELLS, rows.count() // CELL_ROWS)
    dealt = rows.withColumn("rank_cell", F.pmod(F.xxhash64(*keys), F.lit(cells)))
    sizes = dealt.groupBy(*within, "rank_cell").agg(F.count("*").alias("rank_n"))
    before = Window.partitionBy(*within).orderBy("rank_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*within, "rank_cell", F.coalesce(F.sum("rank_n").over(before), F.lit(0)).alias("rank_first"))
    place = F.row_number().over(Window.partitionBy(*within, "rank_cell").orderBy(*keys)) - 1
    inner = dealt.withColumn("rank_place", place)
    return inner.join(starts, [*within, "rank_cell"]).select(*rows.columns, (F.col("rank_first") + F.col("rank_place")).alias(name))
