"""State at a log position, from version intervals or from the version log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.lsn import HEAD
from tidemark.schema import LSN, LSN_TO, ORD


def visible_at(lsn: int) -> Column:
    """Rows that live at a position. Two plain comparisons, so both reach the scan and prune row groups;
    a version that opens and closes at one position has an empty interval and is never seen."""
    return (F.col(LSN) <= F.lit(lsn)) & (F.col(LSN_TO) > F.lit(lsn))


def state_at(versions: DataFrame, lsn: int = HEAD - 1, keep_lsn: bool = True) -> DataFrame:
    """The table as of a position: no shuffle."""
    out = versions.where(visible_at(lsn)).drop(ORD, LSN_TO)
    return out if keep_lsn else out.drop(LSN)


def latest_at(rows: DataFrame, key: list[str], lsn: int, deleted: str = "_deleted", at: str = "_lsn", ordinal: str = "_ord") -> DataFrame:
    """The same state from raw version rows: newest row of every key, tombstones dropped afterwards."""
    rest = [c for c in rows.columns if c not in (*key, at, ordinal)]
    newest = F.max_by(F.struct(*rest), F.struct(at, ordinal)).alias("v")
    out = rows.where(F.col(at) <= lsn).groupBy(*key).agg(newest, F.max(at).alias(at)).where(~F.col(f"v.{deleted}"))
    return out.select(*key, *[F.col(f"v.{c}").alias(c) for c in rest if c != deleted], at)


def intervals(rows: DataFrame, key: list[str], deleted: str = "_deleted", at: str = "_lsn", ordinal: str = "_ord") -> DataFrame:
    """Version rows to intervals: the next version of the key closes one, tombstones only close."""
    order = Window.partitionBy(*key).orderBy(at, ordinal)
    closed = rows.withColumn(LSN_TO, F.coalesce(F.lead(at).over(order), F.lit(HEAD))).where(~F.col(deleted)).drop(deleted)
    return closed.withColumnRenamed(ordinal, ORD).withColumn(LSN, F.col(at)).drop(at)


def sample_at(versions: DataFrame, key: list[str], lsn: int, n: int) -> DataFrame:
    """The first n keys ever seen up to a position, with their state, tombstones included (null columns)."""
    seen = versions.where(F.col(LSN) <= lsn).select(*key).distinct().orderBy(*key).limit(n)
    live = state_at(versions, lsn)
    return seen.join(live, key, "left")


def version_number(lsn: Column, ordinal: Column) -> Column:
    """A single ordered number, (lsn << 32) | ordinal, beyond 64 bits."""
    return lsn.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(11,0)") + ordinal.cast("decimal(10,0)")


def difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Full outer comparison of two states: missing, extra and changed keys."""
    rest = [c for c in left.columns if c not in key]
    a = left.select(*key, F.struct(*rest).alias("a"), F.lit(True).alias("in_a"))
    b = right.select(*key, F.struct(*rest).alias("b"), F.lit(True).alias("in_b"))
    kind = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full").withColumn("kind", kind).where("kind is not null").select(*key, "kind", "a", "b")


def multiset_equal(left: DataFrame, right: DataFrame) -> bool:
    """Equal as multisets: per distinct row the counts agree. One shuffle of pre-aggregated rows."""
    cols = left.columns
    tagged = left.select(*cols, F.lit(1).alias("__n")).unionAll(right.select(*cols, F.lit(-1).alias("__n")))
    return tagged.groupBy(*cols).agg(F.sum("__n").alias("__n")).where("__n <> 0").isEmpty()


def projection_multiset(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every distinct row of a projection and how often it occurs, as ``n``."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def multiset_digest(df: DataFrame) -> DataFrame:
    """rows and an order-free digest: the sums of two 60-bit parts of each row's MD5, as decimals.

    A row's text is length:value; for each column, N; for a null."""
    row = F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"), F.lit(";")), F.lit("N;")) for c in df.columns])
    part = lambda start: F.conv(F.substring(F.md5(row), start, 15), 16, 10).cast("decimal(38,0)")
    return df.select(part(1).alias("h"), part(16).alias("g")).agg(F.count(F.lit(1)).alias("rows"), F.sum("h").alias("h"), F.sum("g").alias("g"))
