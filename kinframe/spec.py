"""Entities and relations: declared columns, keys, and how tables belong together."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Cardinality(Enum):
    ONE_TO_ONE = "1:1"
    ONE_TO_MANY = "1:N"
    MANY_TO_MANY = "N:M"
    MANY_TO_ONE = "N:1"

    def inverse(self) -> Cardinality:
        return {Cardinality.ONE_TO_MANY: Cardinality.MANY_TO_ONE, Cardinality.MANY_TO_ONE: Cardinality.ONE_TO_MANY}.get(self, self)


#: Database type names (lower case) to Spark types; decimal and numeric take precision and scale.
DATABASE_TYPES: dict[str, T.DataType] = {
    "bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType(), "tinyint": T.ShortType(), "bit": T.BooleanType(),
    "money": T.DecimalType(19, 4), "smallmoney": T.DecimalType(10, 4), "float": T.DoubleType(), "real": T.FloatType(),
    "date": T.DateType(), "datetime": T.TimestampNTZType(), "datetime2": T.TimestampNTZType(), "smalldatetime": T.TimestampNTZType(),
    "time": T.StringType(), "datetimeoffset": T.TimestampType(),
    "char": T.StringType(), "varchar": T.StringType(), "text": T.StringType(), "nchar": T.StringType(), "nvarchar": T.StringType(), "ntext": T.StringType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "image": T.BinaryType(), "uniqueidentifier": T.StringType(), "xml": T.StringType(),
    "sql_variant": T.VariantType(), "rowversion": T.BinaryType(),
}


def spark_type(name: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """The Spark type of a database type; decimals default to (18, 2). Unknown names raise."""
    low = name.strip().lower()
    if low in ("decimal", "numeric"):
        return T.DecimalType(18 if precision is None else precision, 2 if scale is None else scale)
    if low not in DATABASE_TYPES:
        raise ValueError(f"unknown database type {name!r}")
    return DATABASE_TYPES[low]


@dataclass(frozen=True)
class Property:
    """One column of an entity: ``source`` is its name in the raw table."""

    name: str
    type: T.DataType
    source: str | None = None
    nullable: bool = True
    default: object = None
    max_length: int | None = None
    facts: tuple[tuple[str, str], ...] = ()

    @property
    def raw(self) -> str:
        return self.source or self.name

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.type, self.nullable, dict(self.facts))


@dataclass(frozen=True)
class EntitySpec:
    """An entity: table, ordered properties, ordered key. Keys are declared; ``integrity`` checks them."""

    name: str
    properties: tuple[Property, ...] = ()
    key: tuple[str, ...] = ()
    table: str | None = None
    schema: str | None = None
    junction: bool = False
    facts: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self) -> None:
        names = {p.name for p in self.properties}
        if len(names) != len(self.properties):
            raise ValueError(f"{self.name}: repeated property")
        if self.properties and (unknown := [k for k in self.key if k not in names]):
            raise ValueError(f"{self.name}: key columns {unknown} are not properties")

    @property
    def table_name(self) -> str:
        """The declared table, or by convention the name with an ``s``."""
        return self.table or f"{self.name}s"

    def struct(self) -> T.StructType:
        return T.StructType([p.field() for p in self.properties])


@dataclass(frozen=True)
class RelationSpec:
    """A relation by ordered column pairs (source column, target column); N:M also names its junction.

    For N:M, ``pairs`` lead from source to junction and ``far_pairs`` from junction to target.
    """

    name: str
    cardinality: Cardinality
    pairs: tuple[tuple[str, str], ...]
    far_pairs: tuple[tuple[str, str], ...] = ()
    unique: bool = False

    def __post_init__(self) -> None:
        if not self.pairs:
            raise ValueError(f"{self.name}: a relation needs column pairs")
        if (self.cardinality is Cardinality.MANY_TO_MANY) != bool(self.far_pairs):
            raise ValueError(f"{self.name}: exactly N:M relations have far pairs")

    def inverse(self) -> RelationSpec:
        turned = lambda ps: tuple((b, a) for a, b in ps)
        if self.far_pairs:
            return RelationSpec(self.name, self.cardinality, turned(self.far_pairs), turned(self.pairs), self.unique)
        return RelationSpec(self.name, self.cardinality.inverse(), turned(self.pairs), (), self.unique)


def quoted(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")
