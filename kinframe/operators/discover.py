"""Keys and relations read from data.

Column sets are tried by size: a set that holds a key already is no minimal key, so it is
never looked at. Of the others, sketches of distinct counts (one combinable aggregate a
pass, no row is multiplied) tell most that cannot be keys; those left are counted
exactly, one exchange each. Inclusions are told by ranges and distinct counts, then by
a sample of values chosen by hash (the same value is in the sample wherever it occurs, so
a sampled value that the other column lacks disproves an inclusion), and only those
left by one join for each kind of values. Every claim is exact: sketches and samples only
rule out.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from ..spec import Cardinality, RelationSpec, quoted

#: Relative standard deviation of distinct counts by sketch (of 2**14 registers), and how many of them a set may lack before it is ruled out.
DEVIATION, MARGIN = 0.01, 6
#: Sketches of one pass.
SKETCHES = 48


def _distinct(hashed: Column) -> Column:
    """Distinct values by a sketch that is one value of the aggregate, however many registers it has."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(hashed, 14)), F.lit(0))


def unique_sets(df: DataFrame, max_size: int = 3, columns: list[str] | None = None) -> list[tuple[str, ...]]:
    """Minimal sets of up to ``max_size`` columns without a null whose values differ in every row, in order of columns.

    A table of no or one row has the empty set for a key, so nothing is listed. Columns whose
    type has no equality (maps, variants) are left out.
    """
    names = [f.name for f in df.schema.fields if (columns is None or f.name in columns) and not isinstance(f.dataType, T.MapType | T.VariantType)]
    if not names:
        return []
    cols = {c: quoted(c) for c in names}
    facts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(cols[c]).alias(f"v{i}") for i, c in enumerate(names)]).first()
    n = facts["n"]
    if n < 2:
        return []
    names = [c for i, c in enumerate(names) if facts[f"v{i}"] == n]
    keys: list[tuple[str, ...]] = []
    estimates: dict[str, float] = {}
    for size in range(1, max_size + 1):
        sets = [s for s in itertools.combinations(names, size) if not any(set(k) <= set(s) for k in keys)]
        # as many values as rows need as many combinations of the parts' values
        sets = [s for s in sets if size == 1 or math.prod(estimates[c] * (1 + MARGIN * DEVIATION) for c in s) >= n]
        near = []
        for at in range(0, len(sets), SKETCHES):
            some = sets[at : at + SKETCHES]
            row = df.agg(*[_distinct(F.xxhash64(*[cols[c] for c in s])).alias(f"d{i}") for i, s in enumerate(some)]).first()
            for i, s in enumerate(some):
                if size == 1:
                    estimates[s[0]] = row[f"d{i}"]
                if row[f"d{i}"] >= n * (1 - MARGIN * DEVIATION):
                    near.append(s)
        keys += [s for s in near if is_unique(df, s)]
    return keys


def is_unique(df: DataFrame, names: tuple[str, ...]) -> bool:
    """No two rows agree in all of ``names``; counts are combined before their exchange."""
    cols = [quoted(c).alias(f"k{i}") for i, c in enumerate(names)]
    return not df.select(*cols).groupBy(*[f"k{i}" for i in range(len(cols))]).count().where("count > 1").take(1)


def composite_keys(tables: dict[str, DataFrame], max_size: int = 3) -> DataFrame:
    """(table_name, columns, n_columns): every minimal key of up to ``max_size`` columns; ``columns`` joined by commas in order of the table."""
    found = [(name, ",".join(s), len(s)) for name, df in tables.items() for s in unique_sets(df, max_size)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(found, "table_name string, columns string, n_columns int")


@dataclass(frozen=True)
class ColumnFacts:
    table: str
    name: str
    kind: str
    n: int
    values: int
    estimate: int
    least: object
    greatest: object

    @property
    def ref(self) -> tuple[str, str]:
        return self.table, self.name


def kind_of(dtype: T.DataType) -> str | None:
    """What values of a column can be equal to: integers, numbers, text, days or times; None: no reference by it."""
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, T.DecimalType | T.DoubleType | T.FloatType):
        return "double" if not isinstance(dtype, T.DecimalType) else f"decimal(38,{dtype.scale})"
    return {"string": "string", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp_ntz"}.get(dtype.simpleString())


def value(c: ColumnFacts) -> Column:
    return quoted(c.name).cast(c.kind)


def column_facts(name: str, df: DataFrame) -> list[ColumnFacts]:
    """Facts of the columns of one table that can refer or be referred to: one aggregate."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    use = [c for c, k in kinds.items() if k]
    if not use:
        return []
    per = []
    for i, c in enumerate(use):
        v = quoted(c).cast(kinds[c])
        per += [F.count(v).alias(f"v{i}"), _distinct(F.when(v.isNotNull(), F.xxhash64(v))).alias(f"d{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *per).first()
    return [ColumnFacts(name, c, kinds[c], row["n"], row[f"v{i}"], row[f"d{i}"], row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(use)]


def samples(tables: dict[str, DataFrame], facts: list[ColumnFacts], size: int) -> DataFrame:
    """(c, value, place): of each column the distinct values whose hash lies below a share of ``size`` / distinct values, written.

    place: the hash as a number in [0, 1). Rows pass on only sampled values, whatever the number of columns.
    """
    out = None
    for name, df in tables.items():
        mine = [(i, c) for i, c in enumerate(facts) if c.table == name]
        if not mine:
            continue
        place = lambda c: (F.shiftrightunsigned(F.xxhash64(value(c).cast("string")), 11)).cast("double") / F.lit(float(1 << 53))
        one = [F.when(place(c) < F.lit(min(1.0, size / max(1, c.estimate))), F.struct(F.lit(i).alias("c"), value(c).cast("string").alias("value"), place(c).alias("place"))) for i, c in mine]
        rows = df.select(F.explode(F.filter(F.array(*one), lambda x: x.isNotNull() & x["value"].isNotNull())).alias("s")).select("s.*").distinct()
        out = rows if out is None else out.unionByName(rows)
    return written(out, "samples")


def inclusions(tables: dict[str, DataFrame], sample: int = 200) -> DataFrame:
    """(table_name, column_name, ref_table, ref_column, n_values, n_ref, is_unique): each column whose values, nulls aside, all occur in another column that is a key.

    A column without values refers to nothing. n_values and n_ref are the distinct values of both, so their quotient tells
    how much of the key is used; is_unique: the referring column has no value twice. Values are compared as integers, doubles,
    decimals of one scale, text, days or times; columns of different kinds do not refer to each other.
    """
    spark = next(iter(tables.values())).sparkSession
    schema = "table_name string, column_name string, ref_table string, ref_column string, n_values bigint, n_ref bigint, is_unique boolean"
    facts = [c for name, df in tables.items() for c in column_facts(name, df)]
    may_be_key = lambda c: c.values == c.n and c.n > 0 and c.estimate >= c.n * (1 - MARGIN * DEVIATION)
    fits = lambda a, b: a.values and a.least >= b.least and a.greatest <= b.greatest and a.estimate * (1 - MARGIN * DEVIATION) <= b.n
    numbered = list(enumerate(facts))
    pairs = [(i, k) for k, b in numbered if may_be_key(b) for i, a in numbered if i != k and a.kind == b.kind and fits(a, b)]
    if not pairs:
        return spark.createDataFrame([], schema)
    shares = spark.createDataFrame([(i, k, min(1.0, sample / max(1, facts[i].estimate), sample / max(1, facts[k].estimate))) for i, k in pairs], "a int, b int, share double")
    taken = samples(tables, facts, sample)
    left = F.broadcast(shares).join(taken.withColumnRenamed("c", "a"), "a").where("place < share")  # pairs of columns: as many as the schemas give
    missing = left.join(taken.select(F.col("c").alias("b"), "value"), ["b", "value"], "left_anti").select("a", "b").distinct()
    wrong = {(r.a, r.b) for r in missing.collect()}  # pairs of columns, not of values
    pairs = [p for p in pairs if p not in wrong]
    out = None
    for kind in sorted({c.kind for c in facts}):
        mine = [(i, k) for i, k in pairs if facts[i].kind == kind]
        if not mine:
            continue
        values = None
        for i in sorted({c for p in mine for c in p}):  # each column is read once, alone
            one = tables[facts[i].table].select(value(facts[i]).alias("v")).where("v is not null").groupBy("v").agg((F.count(F.lit(1)) > 1).alias("again")).select(F.lit(i).alias("c"), "v", "again")
            values = one if values is None else values.unionByName(one)
        values = written(values, "values")
        sums = values.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"))
        ends = spark.createDataFrame([(i, k, facts[i].table, facts[i].name, facts[k].table, facts[k].name) for i, k in mine], "a int, b int, table_name string, column_name string, ref_table string, ref_column string")
        keys = sums.where("NOT again").select(F.col("c").alias("b"), F.col("n").alias("n_ref"))
        open_ = ends.join(F.broadcast(keys), "b")
        met = values.select(F.col("c").alias("a"), "v").join(F.broadcast(open_.select("a", "b")), "a").join(values.select(F.col("c").alias("b"), "v"), ["b", "v"])
        held = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_met"))
        rows = held.join(F.broadcast(open_), ["a", "b"]).join(F.broadcast(sums.select(F.col("c").alias("a"), F.col("n").alias("n_values"), (~F.col("again")).alias("is_unique"))), "a").where("n_met = n_values")
        rows = rows.select("table_name", "column_name", "ref_table", "ref_column", "n_values", "n_ref", "is_unique")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema) if out is None else out


def proposed_relations(found: DataFrame) -> list[tuple[str, str, RelationSpec]]:
    """(table referred to, referring table, relation) of rows of ``inclusions``: 1:1 where the referring column is unique, else 1:N."""
    out = []
    for r in found.orderBy("ref_table", "ref_column", "table_name", "column_name").collect():  # a row a pair of columns
        kind = Cardinality.ONE_TO_ONE if r.is_unique else Cardinality.ONE_TO_MANY
        out.append((r.ref_table, r.table_name, RelationSpec(f"{r.table_name}_by_{r.column_name}", kind, ((r.ref_column, r.column_name),))))
    return out
