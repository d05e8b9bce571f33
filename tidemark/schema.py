"""Column descriptions, their storage types, and the schema registry by log position."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOL, INTS, FLOATS = 16, (20, 21, 23, 26), (700, 701)
#: Helper columns of a version row; the insert position comes last.
ORD, LSN_TO, LSN = "__ord", "__lsn_to", "__lsn"


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type_oid: int
    is_key: bool = False

    @property
    def data_type(self) -> T.DataType:
        """Every type without a native store keeps its exact text."""
        if self.type_oid == BOOL:
            return T.BooleanType()
        if self.type_oid in INTS:
            return T.LongType()
        return T.DoubleType() if self.type_oid in FLOATS else T.StringType()

    @property
    def field(self) -> T.StructField:
        return T.StructField(self.name, self.data_type, True, {"oid": self.type_oid, "is_key": self.is_key})


def struct_of(columns: list[ColumnSpec]) -> T.StructType:
    return T.StructType([c.field for c in columns])


def from_text(value: Column, spec: ColumnSpec) -> Column:
    """A source's text rendering as the stored type; a malformed value raises under ANSI."""
    if spec.type_oid == BOOL:
        return F.when(value.isin("t", "true"), True).when(value.isin("f", "false"), False).when(value.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), value)))
    return value.cast(spec.data_type)


def to_text(value: Column, spec: ColumnSpec) -> Column:
    return F.when(value, "t").when(~value, "f") if spec.type_oid == BOOL else value.cast("string")


def eligibility(identity: str, has_identity_index: bool, has_primary_key: bool) -> str:
    """How a source table takes part, by its replica identity."""
    if identity == "f":
        return "full (identity FULL inflates the log)"
    if identity == "i" and has_identity_index or identity == "d" and has_primary_key:
        return "full"
    return "append-only"


def schema_versions(shapes: DataFrame) -> DataFrame:
    """Drop a shape that repeats the one before it. ``shapes``: relid, name, valid_from_lsn, columns."""
    order = Window.partitionBy("relid").orderBy("valid_from_lsn")
    same = F.lag("columns").over(order).eqNullSafe(F.col("columns")) & F.lag("name").over(order).eqNullSafe(F.col("name"))
    return shapes.withColumn("same", F.coalesce(same, F.lit(False)) & (F.row_number().over(order) > 1)).where("not same").drop("same")


def schema_at(versions: DataFrame, lsn: int) -> DataFrame:
    """The shape of every relation at a position: greatest valid_from_lsn not beyond it."""
    latest = F.max_by(F.struct("name", "columns", "valid_from_lsn"), "valid_from_lsn").alias("v")
    return versions.where(F.col("valid_from_lsn") <= lsn).groupBy("relid").agg(latest).select("relid", "v.*")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, take: list[str]) -> DataFrame:
    """Each left row with the right row of its key in force at its position: one shuffle, one sort, no range join."""
    cols = [c for c in left.columns if c not in (key, left_at)]
    a = left.select(F.col(key), F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*[left[c] for c in cols]).alias("__l"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("__r"))
    b = right.select(F.col(key), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(*take).alias("__r"))
    order = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__r", F.last("__r", ignorenulls=True).over(order)).where("__side = 1")
    return both.select(key, F.col("__at").alias(left_at), *[F.col("__l")[c].alias(c) for c in cols], *[F.col("__r")[c].alias(c) for c in take])
