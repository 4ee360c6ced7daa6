"""Keys and relations checked on data, and keys made.

Spark enforces no key. The checks return the violating rows or groups; ``summary``
turns them into a count per rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from ..spec import EntitySpec, RelationSpec, quoted


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with ``n``; keys with a null part are the business of ``null_violations``."""
    groups = df
    for k in key:
        groups = groups.filter(quoted(k).isNotNull())
    return groups.groupBy(*[quoted(k) for k in key]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def row_rules(spec: EntitySpec) -> dict[str, Column]:
    """The rules of single rows: keys and required columns not null, lengths, precision; true where violated."""
    rules: dict[str, Column] = {}
    for p in spec.properties:
        c = quoted(p.name)
        if p.name in spec.key or not p.nullable:
            rules[f"{p.name}: null"] = c.isNull()
        if p.max_length is not None:
            rules[f"{p.name}: longer than {p.max_length}"] = F.length(c) > p.max_length
        if p.type.typeName() == "decimal":
            rules[f"{p.name}: beyond {p.type.simpleString()}"] = c.isNotNull() & c.try_cast(p.type).isNull()
    return rules


def row_violations(df: DataFrame, spec: EntitySpec) -> DataFrame:
    """Rows that break a rule of single rows, with the rules broken in ``violations``."""
    rules = row_rules(spec)
    if not rules:
        return df.withColumn("violations", F.array().cast("array<string>")).filter(F.lit(False))
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).filter(F.size("violations") > 0)


def orphans(child: DataFrame, parent: DataFrame, rel: RelationSpec) -> DataFrame:
    """Children whose foreign key has no parent; keys with a null part refer to nothing."""
    linked = child
    for a, _ in rel.pairs:
        linked = linked.filter(quoted(a).isNotNull())
    keys = parent.select(*[quoted(b).alias(f"_p{i}") for i, (_, b) in enumerate(rel.pairs)])
    return linked.join(keys, [linked[f"`{a}`"] == keys[f"_p{i}"] for i, (a, _) in enumerate(rel.pairs)], "left_anti")


def shared_parents(child: DataFrame, rel: RelationSpec) -> DataFrame:
    """1:1: foreign keys used by more than one child, with ``n``."""
    return duplicate_keys(child, [a for a, _ in rel.pairs])


def junction_report(junction: DataFrame, left: DataFrame, right: DataFrame, to_left: RelationSpec, to_right: RelationSpec) -> DataFrame:
    """(rule, n) of a junction table: repeated pairs, rows without left or right side, columns beyond the pair."""
    pair = [a for a, _ in (*to_left.pairs, *to_right.pairs)]
    extra = len([c for c in junction.columns if c not in pair])
    counted = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
    parts = [counted(duplicate_keys(junction, pair), "repeated pair"), counted(orphans(junction, left, to_left), "no left side"), counted(orphans(junction, right, to_right), "no right side")]
    pure = junction.sparkSession.createDataFrame([("other columns", extra)], "rule string, n long")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(pure)


def summary(df: DataFrame, spec: EntitySpec) -> DataFrame:
    """(rule, n): how many rows break each rule of single rows, and how many key values are repeated."""
    rules = row_rules(spec)
    rows = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())], F.count(F.lit(1)).alias("all"))
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("n")) for i, r in enumerate(rules)]) if rules else F.array().cast("array<struct<rule:string,n:bigint>>")
    out = rows.select(F.explode(listed).alias("x")).select("x.rule", "x.n")
    if spec.key:
        out = out.unionByName(duplicate_keys(df, spec.key).agg(F.lit("key: repeated").alias("rule"), F.count(F.lit(1)).alias("n")))
    return out


def dense_keys(df: DataFrame, order_by: Sequence[str], name: str = "id", start: int = 1) -> DataFrame:
    """Keys start, start + 1, ... in the given order, without a window over all rows.

    Rows are dealt by range and sorted once and written, so that the two passes see the same
    partitions even if an executor is lost (so this runs when called, not when the result is
    read); offsets are one number a partition. Ties get keys in the order of all columns.
    """
    by = [quoted(c) for c in order_by]
    ties = [quoted(f.name) for f in df.schema.fields if f.name not in order_by and f.dataType.typeName() not in ("map", "variant")]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = df.repartitionByRange(n, *by, *ties).sortWithinPartitions(*by, *ties)
    rows = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "keys")
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    # one row a partition is in this window
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + start).alias("shift"))
    # one row a partition: a bounded table
    return rows.join(F.broadcast(offsets), "_part").select(*[quoted(c) for c in df.columns if c != name], (F.col("_at") + F.col("shift")).alias(name))


def hilo_keys(df: DataFrame, name: str = "id") -> DataFrame:
    """Unique keys with gaps, without an exchange: a block of numbers for each partition."""
    return df.withColumn(name, F.monotonically_increasing_id())


def name_keys(df: DataFrame, key: Sequence[str], name: str = "id") -> DataFrame:
    """UUID-shaped keys from the natural key's parts: the same for the same parts, in every run."""
    parts = F.to_json(F.struct(*[quoted(k) for k in key]), {"ignoreNullFields": "false"})
    h = F.sha2(parts.cast("binary"), 256)
    piece = lambda a, n: F.substring(h, a, n)
    return df.withColumn(name, F.concat(piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-8"), piece(14, 3), F.lit("-a"), piece(18, 3), F.lit("-"), piece(21, 12)))
