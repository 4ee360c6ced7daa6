"""Related rows as nested rows, and back.

Children are grouped before the join, so a parent row is never repeated. A parent
with very many children is one very large row; where that can happen use ``include_in_chunks``,
or ``flat``, which gives the same pairs as rows and lets a skewed join be split.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicate import where
from ..spec import Cardinality, RelationSpec, quoted
from .integrity import dense_keys


def _sorted_children(columns: Sequence[str], first: Sequence[str]) -> Column:
    """All children as structs, sorted by ``first`` and then by all columns."""
    lead = [c for c in first if c in columns]
    rest = [c for c in columns if c not in lead]
    gathered = F.sort_array(F.collect_list(F.struct(*[quoted(c) for c in [*lead, *rest]])))
    if [*lead, *rest] == list(columns):
        return gathered
    return F.transform(gathered, lambda x: F.struct(*[x[c].alias(c) for c in columns]))


def _keys_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.filter(quoted(c).isNotNull())
    return df


def _attach(parent: DataFrame, grouped: DataFrame, left: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    condition = [parent[f"`{a}`"] == grouped[k] for a, k in zip(left, keys, strict=True)]
    joined = parent.join(grouped, condition, "left")
    empty = F.array().cast(grouped.schema[name].dataType)
    return joined.select(*[parent[f"`{c}`"] for c in parent.columns if c != name], F.coalesce(grouped[name], empty).alias(name))


def include_many(parent: DataFrame, child: DataFrame, rel: RelationSpec, name: str | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """1:N: the parent's rows with an array of their children, empty if there is none, sorted by ``order_by``."""
    if rel.cardinality not in (Cardinality.ONE_TO_MANY, Cardinality.ONE_TO_ONE):
        raise ValueError(f"{rel.name} is {rel.cardinality.value}")
    name = name or rel.name
    keys = [f"_k{i}" for i in range(len(rel.pairs))]
    linked = _keys_not_null(child, [b for _, b in rel.pairs])
    grouped = linked.groupBy(*[quoted(b).alias(k) for (_, b), k in zip(rel.pairs, keys, strict=True)]).agg(_sorted_children(child.columns, order_by).alias(name))
    return _attach(parent, grouped, [a for a, _ in rel.pairs], keys, name)


def include_in_chunks(parent: DataFrame, child: DataFrame, rel: RelationSpec, size: int, name: str | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """1:N with children in arrays of ``size`` at most: the parent's columns, ``chunk`` (from 0) and the array, a row a chunk.

    Children are numbered over all parents in order of key, ``order_by`` and all columns, by one range exchange, and cut
    at every ``size``-th number; so a parent's first and last chunk may be short, the others are full, and no task or row holds
    more of a parent than others do. A parent without children has one row with an empty array. ``flatten`` gives the children back.
    Numbers are written on the way, so this runs when called.
    """
    if rel.cardinality not in (Cardinality.ONE_TO_MANY, Cardinality.ONE_TO_ONE):
        raise ValueError(f"{rel.name} is {rel.cardinality.value}")
    if size < 1:
        raise ValueError("a chunk has one child at least")
    name = name or rel.name
    keys = [f"_k{i}" for i in range(len(rel.pairs))]
    near = [b for _, b in rel.pairs]
    placed = dense_keys(_keys_not_null(child, near), [*near, *[c for c in order_by if c not in near]], "_place", 0)
    grouped = placed.withColumn("_chunk", F.floor(F.col("_place") / size)).groupBy(*[quoted(b).alias(k) for b, k in zip(near, keys, strict=True)], "_chunk").agg(_sorted_children(child.columns, order_by).alias(name))
    # a row a chunk of a parent, no children
    firsts = placed.groupBy(*[quoted(b).alias(f"f{k}") for b, k in zip(near, keys, strict=True)]).agg(F.floor(F.min("_place") / size).alias("_first"))
    numbered = grouped.join(firsts, [F.col(k) == F.col(f"f{k}") for k in keys]).withColumn("_chunk", F.col("_chunk") - F.col("_first"))
    joined = parent.join(numbered, [parent[f"`{a}`"] == numbered[k] for (a, _), k in zip(rel.pairs, keys, strict=True)], "left")
    empty = F.array().cast(grouped.schema[name].dataType)
    return joined.select(*[parent[f"`{c}`"] for c in parent.columns if c not in (name, "chunk")], F.coalesce("_chunk", F.lit(0)).cast("long").alias("chunk"), F.coalesce(numbered[name], empty).alias(name))


def include_many_to_many(source: DataFrame, junction: DataFrame, target: DataFrame, rel: RelationSpec, name: str | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """N:M through a junction: an array of targets for each source row; ``rel.inverse()`` gives the other side.

    A pair that the junction repeats counts once; sources without targets get an empty array.
    """
    if rel.cardinality is not Cardinality.MANY_TO_MANY:
        raise ValueError(f"{rel.name} is {rel.cardinality.value}")
    name = name or rel.name
    near, far = [b for _, b in rel.pairs], [a for a, _ in rel.far_pairs]
    keys, ends = [f"_k{i}" for i in range(len(near))], [f"_e{i}" for i in range(len(far))]
    links = _keys_not_null(junction, [*near, *far]).select(*[quoted(c).alias(k) for c, k in zip(near, keys, strict=True)], *[quoted(c).alias(e) for c, e in zip(far, ends, strict=True)]).distinct()
    met = links.join(target, [links[e] == target[f"`{b}`"] for e, (_, b) in zip(ends, rel.far_pairs, strict=True)])
    grouped = met.groupBy(*keys).agg(_sorted_children(target.columns, order_by).alias(name))
    return _attach(source, grouped, [a for a, _ in rel.pairs], keys, name)


def include_one(child: DataFrame, parent: DataFrame, rel: RelationSpec, name: str | None = None) -> DataFrame:
    """N:1 or 1:1: the child's rows with a struct of their parent, null if there is none."""
    if rel.cardinality not in (Cardinality.MANY_TO_ONE, Cardinality.ONE_TO_ONE):
        raise ValueError(f"{rel.name} is {rel.cardinality.value}")
    name = name or rel.name
    keys = [f"_k{i}" for i in range(len(rel.pairs))]
    packed = parent.select(*[quoted(b).alias(k) for (_, b), k in zip(rel.pairs, keys, strict=True)], F.struct(*[quoted(c) for c in parent.columns]).alias(name))
    joined = child.join(packed, [child[f"`{a}`"] == packed[k] for (a, _), k in zip(rel.pairs, keys, strict=True)], "left")
    return joined.select(*[child[f"`{c}`"] for c in child.columns if c != name], packed[name])


def flatten(nested: DataFrame, name: str, prefix: str = "") -> DataFrame:
    """One row per parent and child; a parent without children stays, with nulls."""
    opened = nested.withColumn(name, F.explode_outer(quoted(name)))
    fields = nested.schema[name].dataType.elementType.names
    return opened.select(*[quoted(c) for c in nested.columns if c != name], *[quoted(name)[f].alias(f"{prefix}{f}") for f in fields])


def flat(parent: DataFrame, child: DataFrame, rel: RelationSpec, prefix: str = "") -> DataFrame:
    """The pairs of ``include_many`` as rows, without gathering a parent's children anywhere."""
    condition = [parent[f"`{a}`"] == child[f"`{b}`"] for a, b in rel.pairs]
    return parent.join(child, condition, "left").select(*[parent[f"`{c}`"] for c in parent.columns], *[child[f"`{c}`"].alias(f"{prefix}{c}") for c in child.columns])


def with_any_child(parent: DataFrame, child: DataFrame, rel: RelationSpec, *trees: Any) -> DataFrame:
    """The parents that have a child for which all trees hold: a semi join, nothing is nested to be tested."""
    found = where(child, *trees)
    return parent.join(found, [parent[f"`{a}`"] == found[f"`{b}`"] for a, b in rel.pairs], "left_semi")


def lookup(rows: DataFrame, others: DataFrame, rel: RelationSpec, name: str | None = None) -> DataFrame:
    """Two results matched by key, as ``include_many``: no row of one is scanned for each of the other."""
    return include_many(rows, others, rel, name)
