"""Seeded order, exact samples, splits, slices and global positions.

No operator here sorts a whole table in one task or sends it through the
driver. What the driver sees is one boundary row; what is broadcast is a table
of offsets whose length is a constant or the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.session import settle

_KEY = "_order_key"
# Hex digits of the key that name a bucket: 65,536 buckets at most.
_BUCKET_DIGITS = 4
# Up to so many rows are taken from one pass in which each task keeps its smallest keys.
_FEW = 10_000


def seeded_key(seed: int, *keys: str | Column) -> Column:
    """A reproducible random sort key: md5 of ``seed:key[:key...]``."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def _bucket_of(key: Column) -> Column:
    return F.substring(key, 1, _BUCKET_DIGITS)


def _boundary(df: DataFrame, n: int, seed: int, keys: list[str]):
    """``last``, the n-th smallest (seeded key, keys), with how many rows are ``tied`` there and ``need`` to be
    taken of them; None when there are at most n rows.

    A few rows are the smallest of each task's smallest, in one pass. For more, rows are
    counted by the first digits of the key, which are spread evenly; the
    counts name the bucket that holds the n-th row and its place there, and only
    that bucket, one part in 65,536 of the table, is ordered.
    """
    keyed = df.select(*keys, seeded_key(seed, keys[0]).alias(_KEY))
    if n <= _FEW:
        return _boundary_of_few(keyed.select(F.struct(_KEY, *keys).alias("last")), n)
    counts = keyed.groupBy(_bucket_of(F.col(_KEY)).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per bucket, never the data.
    upto = F.sum("_n").over(Window.orderBy("_bucket"))
    found = (
        counts.select("_bucket", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"))
        .filter((F.col("_before") < n) & (F.col("_upto") >= n))
        .first()
    )
    if found is None:
        return None
    inside = keyed.filter(_bucket_of(F.col(_KEY)) == found["_bucket"])
    place = n - found["_before"]
    per_key = inside.groupBy(F.struct(_KEY, *keys).alias("last")).agg(F.count(F.lit(1)).alias("tied"))
    upto = F.sum("tied").over(Window.orderBy("last"))
    at = per_key.select("*", upto.alias("_upto")).filter(F.col("_upto") >= place).orderBy("last").first()
    return {"last": at["last"], "tied": at["tied"], "need": place - at["_upto"] + at["tied"]}


def _boundary_of_few(keyed: DataFrame, n: int):
    """The same for a small ``n``: each task passes on n + 1 keys at most."""
    held = F.array_sort(F.collect_list("last")).alias("held")
    last = F.get("held", F.lit(n - 1))
    found = (
        keyed.orderBy("last").limit(n + 1).agg(held)
        .select(
            last.alias("last"),
            (F.get("held", F.lit(n)) == last).alias("goes_on"),
            F.size(F.filter(F.slice("held", 1, n), lambda x: x == last)).alias("need"),
            (F.size("held") > n).alias("more"),
        )
        .first()
    )
    if not found["more"]:
        return None
    return {"last": found["last"], "tied": found["need"] + found["goes_on"], "need": found["need"]}


def _place(df: DataFrame, last, seed: int, keys: list[str]) -> tuple[Column, Column]:
    """Where a row of ``df`` stands, and where the boundary does."""
    mine = F.struct(seeded_key(seed, keys[0]), *keys)
    return mine, F.struct(F.lit(last[_KEY]), *[F.lit(last[k]).cast(df.schema[k].dataType) for k in keys])


def make_splits(df: DataFrame, dev_size: int = 200, seed: int = 42, key: str = "idx") -> DataFrame:
    """Add ``split``: the first ``dev_size`` rows in seeded order are dev, the rest train.

    ``key`` must be unique. Once the boundary is known this is a filter on each
    row alone, so the table is neither sorted, joined nor shuffled.
    """
    if dev_size <= 0:
        return df.withColumn("split", F.lit("train"))
    found = _boundary(df, dev_size, seed, [key])
    if found is None:
        return df.withColumn("split", F.lit("dev"))
    mine, last = _place(df, found["last"], seed, [key])
    return df.withColumn("split", F.when(mine <= last, "dev").otherwise("train"))


def sample_exact_n(
    df: DataFrame, n: int, seed: int = 42, key: str = "idx", ties: tuple[str, ...] = ()
) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, the same ones for the same seed, in seeded order.

    ``key`` gives the order; where it is not unique, ``ties`` names columns that
    tell its rows apart. Membership is a filter on each row and the order a
    distributed sort, so no task sees the sample, whatever ``n``. Only where rows
    that nothing tells apart stand at the end, some of those are taken by a limit.
    """
    if n <= 0:
        return df.limit(0)
    keys = [key, *ties]
    found = _boundary(df, n, seed, keys)
    taken = df
    if found is not None:
        mine, last = _place(df, found["last"], seed, keys)
        taken = df.filter(mine <= last)
        if found["need"] < found["tied"]:
            taken = df.filter(mine < last).union(df.filter(mine == last).limit(found["need"]))
    return taken.orderBy(seeded_key(seed, key), *keys)


def last_of_first(df: DataFrame, n: int, index: str = "idx"):
    """The largest of the ``n`` smallest different values of ``index``; None without rows."""
    return df.select(index).distinct().orderBy(index).limit(n).agg(F.max(index)).first()[0]


def first_by_index(df: DataFrame, n: int, index: str = "idx") -> DataFrame:
    """Rows whose ``index`` is among the ``n`` smallest different ones of the table."""
    return df.filter(F.col(index) <= F.lit(last_of_first(df, n, index)))


def seeded_shuffle(
    df: DataFrame, seed: int = 42, key: str = "idx", position: str | None = None
) -> DataFrame:
    """All rows in seeded order; with ``position``, their 0-based place in it as a column.

    Places need no global sort: even buckets by key prefix, the number of rows
    in all earlier buckets, and a row number inside the bucket.
    """
    if position is None:
        return df.orderBy(seeded_key(seed, key), key)
    keyed = df.withColumn(_KEY, seeded_key(seed, key)).withColumn(
        "_bucket", F.substring(_KEY, 1, _BUCKET_DIGITS)
    )
    offsets = _offsets(
        df.select(F.substring(seeded_key(seed, key), 1, _BUCKET_DIGITS).alias("_bucket")),
        "_bucket",
    )
    inside = Window.partitionBy("_bucket").orderBy(_KEY, key)
    return (
        keyed.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(position, F.col("_before") + F.col("_row") - 1)
        .drop(_KEY, "_bucket", "_row", "_before")
    )


def _offsets(df: DataFrame, bucket: str) -> DataFrame:
    """Rows in all earlier buckets, per bucket. One row per bucket, so the
    unpartitioned window below runs over the buckets, never over the data."""
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        bucket, F.coalesce(F.sum("_n").over(running), F.lit(0)).cast("bigint").alias("_before")
    )


def global_index(
    df: DataFrame, order_cols: list[str], start: int = 0, out: str = "idx", settled: str = "index"
) -> DataFrame:
    """Number the rows from ``start`` in the order of ``order_cols``.

    ``order_cols`` should be unique together; ties are numbered arbitrarily.
    Rows are range-partitioned on the full key, so a frequent leading value is
    split like any other, and written once: sampled ranges may differ from run
    to run, so counts and numbers must come from the same stored rows. What is
    broadcast has one row per partition.
    """
    ranged = (
        df.repartitionByRange(*order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    stored = settle(ranged, settled)
    offsets = _offsets(stored.select("_part"), "_part")
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(
            out,
            F.lit(start) + F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)),
        )
        .drop("_part", "_at", "_before")
    )


def chunk_slice(df: DataFrame, start: int, n: int, index: str = "idx") -> DataFrame:
    """Rows ``[start, start + n)`` of a stored 0-based index, as a pushed-down range filter."""
    return df.filter((F.col(index) >= start) & (F.col(index) < start + n))


def first_k_of_each(df: DataFrame, k: int, by: str, index: str = "idx") -> DataFrame:
    """The first ``k`` rows by ``index`` for each value of ``by``; a task passes on no more than that of each."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(index))
    return df.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def first_k(df: DataFrame, k: int, index: str = "idx") -> DataFrame:
    return df.orderBy(index).limit(k)
