"""Operators on small hand-made frames: nulls, ties, empty sides, errors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.functions import jsoncol, names
from kinframe.functions.predicate import And, Cmp, Col, Not, Or, any_in, expect_one, to_column, where, where_in
from kinframe.operators import assign, compare, integrity, measure, metadata, relation, select
from kinframe.sources import tables as source
from kinframe.spec import Cardinality, EntitySpec, Property, RelationSpec, spark_type

LINES = RelationSpec("lines", Cardinality.ONE_TO_MANY, (("id", "parent"),))


@pytest.fixture
def parents(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], "id long, name string")


@pytest.fixture
def children(spark):
    return spark.createDataFrame([(10, 1, 5.0), (11, 1, None), (12, 2, 1.0), (13, 9, 2.0), (14, None, 3.0)], "cid long, parent long, v double")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_types():
    assert spark_type("DECIMAL") == T.DecimalType(18, 2)
    assert spark_type("tinyint") == T.ShortType()
    with pytest.raises(ValueError):
        spark_type("geography")


def test_spec_conventions():
    e = EntitySpec("Order", (Property("id", T.LongType()),), ("id",))
    assert e.table_name == "Orders"
    with pytest.raises(ValueError):
        EntitySpec("X", (Property("id", T.LongType()),), ("other",))
    with pytest.raises(ValueError):
        RelationSpec("r", Cardinality.MANY_TO_MANY, (("a", "b"),))
    r = RelationSpec("r", Cardinality.MANY_TO_MANY, (("a", "b"),), (("c", "d"),))
    assert r.inverse().pairs == (("d", "c"),) and r.inverse().inverse() == r


@pytest.mark.parametrize(("op", "ids"), [("=", [2]), ("<>", [1]), (">", []), (">=", [2]), ("<", [1]), ("<=", [1, 2])])
def test_comparisons_skip_null(spark, op, ids):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, x int")
    assert [r.id for r in where(df, Cmp("x", op, 2)).orderBy("id").collect()] == ids


def test_null_literals(parents):
    assert where(parents, Cmp("name", "=", None)).count() == 1
    assert where(parents, Cmp("name", "<>", None)).count() == 3
    for bad in (Cmp("name", "<", None), Cmp(None, "=", None), Cmp("name", "~", 1)):
        with pytest.raises(ValueError):
            to_column(bad)
    with pytest.raises(ValueError):
        And()
    with pytest.raises(TypeError):
        to_column("name = 1")


def test_not_is_three_valued(spark):
    df = spark.createDataFrame([(1, "F"), (2, "O"), (3, None)], "id long, s string")
    assert [r.id for r in where(df, Not(Cmp("s", "=", "F"))).collect()] == [2]
    assert where(df, ~(Cmp("s", "=", "F") | Cmp("s", "is null"))).count() == 1


def test_lists(spark, parents):
    assert where(parents, Cmp("id", "in", [1, 3])).count() == 2
    assert where_in(parents, "id", range(1, 5000)).count() == 3
    with pytest.raises(ValueError):
        where_in(parents, "id", [1, None])


def test_contains_has_no_wildcards(spark):
    df = spark.createDataFrame([("a%b",), ("axb",)], "s string")
    assert where(df, Cmp("s", "contains", "%")).count() == 1
    assert where(df, Cmp("s", "like", "a_b")).count() == 2


def test_expect_one(parents):
    assert expect_one(parents, Cmp("id", "=", 1)).first().name == "a"
    for tree in (Cmp("id", "=", 77), Cmp("id", ">", 0)):
        with pytest.raises(Exception, match="expected one row"):
            expect_one(parents, tree).collect()


def test_json(spark):
    df = spark.createDataFrame([('{"k": 1, "o": {"a": 1}, "s": "x"}',), ("{bad",), ('["p", "q"]',), (None,)], "j string")
    got = df.select(jsoncol.owned_json("j", "k int").alias("o"), jsoncol.json_array("j").alias("a"), jsoncol.json_value("j", "$.k", "int").alias("k"), jsoncol.json_value("j", "$.o").alias("n"), jsoncol.json_value("j", "$.s", "int").alias("s")).collect()
    assert got[0].o.k == 1 and got[0].k == 1 and got[0].n is None and got[0].s is None and got[0].a is None
    assert got[1].o is None and got[1].a is None
    assert got[2].a == ["p", "q"] and got[2].o is None
    assert got[3].o is None and got[3].a is None
    assert df.filter(any_in(jsoncol.json_array("j"), "q")).count() == 1


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "`WWI Order ID` long, `Unit Price` long")
    assert names.to_property_names(df, "WWI ").columns == ["OrderID", "UnitPrice"]
    with pytest.raises(ValueError):
        names.to_property_names(spark.createDataFrame([(1, 2)], "`a b` long, ab long"))


def test_conform(spark):
    spec = EntitySpec("E", (Property("Id", T.LongType(), "x"), Property("Amount", spark_type("decimal", 5, 2), "y"), Property("Note", T.StringType(), "z", default="none")), ("Id",))
    df = spark.createDataFrame([("1", "2.505", None), ("x", "3", "t")], "x string, y string, z string")
    got = source.conform(df, spec, lenient=True).collect()
    assert [str(got[0].Amount), got[0].Note, got[0].conform_errors] == ["2.51", "none", []]
    assert got[1].Id is None and got[1].conform_errors == ["Id"]
    with pytest.raises(Exception, match="CAST"):
        source.conform(df, spec).collect()
    with pytest.raises(ValueError):
        source.conform(df, EntitySpec("E", (Property("Q", T.LongType(), nullable=False),)))


def test_extract_changes_window_and_total(spark):
    orders = spark.sql("SELECT 1 AS o, TIMESTAMP_NTZ '2020-01-01' AS d UNION ALL SELECT 2, TIMESTAMP_NTZ '2020-02-01'")
    lines = spark.createDataFrame([(1, 1.0, 1.0, 0.0), (2, 96.0, 18.0, 0.15)], "l int, q double, p double, t double")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    got = source.extract_changes(orders, lines, at("2020-01-01"), at("2020-02-01"), changed="d", key=("o", "l"), quantity="q", price="p", tax="t").collect()
    assert [(r.o, str(r.total_including_tax)) for r in got] == [(2, "1987.20")]


def test_report_round_trip(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Method;Mean;Allocated\n"A1";"526,920.3 us";"24294.84 KB"\n"B";"NA";"1 B"\n')
    got = source.read_report(spark, str(tmp_path / "r.csv")).select(measure.with_unit("Mean").alias("ns"), measure.with_unit("Allocated").alias("b")).collect()
    assert got[0].ns == pytest.approx(526920300.0) and got[0].b == pytest.approx(24294.84 * 1024)
    assert got[1].ns is None and got[1].b == 1


def test_joins(spark, parents, children):
    assert select.join(parents, children, [("id", "parent")]).count() == 3
    assert select.join(parents, children, [("id", "parent")], "left").count() == 5
    assert select.join(parents, children, [("id", "parent")], "right").count() == 5
    assert select.join(parents, children, [("id", "parent")], "full").count() == 7
    assert select.join(parents, children, [("id", "parent")], "anti").count() == 2
    on = And(Cmp("l.id", "=", Col("r.parent")), Cmp("r.v", ">", 2))
    assert select.join(parents, children, on).count() == 1
    with pytest.raises(ValueError):
        select.join(parents, children, Or(Cmp("l.id", "=", Col("r.parent")), Cmp("r.v", ">", 2)))
    with pytest.raises(ValueError):
        select.join(parents, children, [], "inner")


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2)], "g string, x int")
    got = rows(select.group(df, ["g"], [select.aggregate_column("count", "x", "n"), select.aggregate_column("count", "*", "all")]))
    assert got == [("a", 1, 2), (None, 1, 1)]
    empty = df.filter("false")
    assert select.scalar(empty, F.sum("x").alias("s"), F.max("x").alias("m")).first() == (None, None)
    with pytest.raises(ValueError):
        select.aggregate_column("median", "x", "m")
    assert select.group(df, ["g"], [F.count("*").alias("n")], Cmp("n", ">", 1), keep=["g"]).collect() == [("a",)]
    assert select.as_map(select.count_by(df, "g"), "g", "n").first()[0] == {"a": 2}


def test_pages(spark):
    spec = EntitySpec("E", (Property("a", T.LongType()), Property("b", T.LongType())), ("a", "b"))
    df = spark.createDataFrame([(i // 3, i) for i in range(12)], "a long, b long")
    assert [r.b for r in select.page(df, spec, 4, 3, "a").collect()] == [4, 5, 6]
    assert [r.b for r in select.page_after(df, spec, (1, 3), 3).collect()] == [4, 5, 6]
    assert select.first_n(df, spec, 2, ("a", False)).first().b == 9
    with pytest.raises(ValueError):
        select.page(df, EntitySpec("K"), 0, 1)


def test_sets(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x long")
    b = spark.createDataFrame([(1,), (3,)], "x long")
    got = {k: rows(select.set_operation(a, b, k)) for k in ("union", "union all", "intersect", "except", "except all")}
    assert got == {"union": [(1,), (2,), (3,)], "union all": [(1,), (1,), (1,), (2,), (3,)], "intersect": [(1,)], "except": [(2,)], "except all": [(1,), (2,)]}
    with pytest.raises(ValueError):
        select.set_operation(a, b.withColumnRenamed("x", "y"), "union")


def test_include_many_and_back(parents, children):
    nested = relation.include_many(parents, children, LINES, order_by=["cid"])
    got = {r.id: [c.cid for c in r.lines] for r in nested.collect()}
    assert got == {1: [10, 11], 2: [12], 3: [], None: []}
    back = relation.flatten(nested, "lines")
    assert rows(back) == rows(relation.flat(parents, children, LINES))
    assert rows(relation.include_many(parents, children.filter("false"), LINES).select(F.size("lines"))) == [(0,)] * 4


def test_many_to_many_both_sides(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "a long")
    b = spark.createDataFrame([(7,), (8,)], "b long")
    j = spark.createDataFrame([(1, 7), (1, 8), (1, 7), (2, 99), (None, 7)], "ja long, jb long")
    rel = RelationSpec("bs", Cardinality.MANY_TO_MANY, (("a", "ja"),), (("jb", "b"),))
    one = {r.a: [x.b for x in r.bs] for r in relation.include_many_to_many(a, j, b, rel).collect()}
    other = {r.b: [x.a for x in r["as"]] for r in relation.include_many_to_many(b, j, a, rel.inverse(), "as").collect()}
    assert one == {1: [7, 8], 2: [], 3: []} and other == {7: [1], 8: [1]}


def test_include_one(parents, children):
    got = {r.cid: r.up and r.up.name for r in relation.include_one(children, parents, LINES.inverse(), "up").collect()}
    assert got == {10: "a", 11: "a", 12: "b", 13: None, 14: None}
    with pytest.raises(ValueError):
        relation.include_one(children, parents, LINES)


def test_keys(spark, parents, children):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 1), (None, 1)], "a long, b long")
    assert rows(integrity.duplicate_keys(df, ["a", "b"])) == [(1, 1, 2)]
    assert [r.cid for r in integrity.orphans(children, parents, LINES.inverse()).collect()] == [13]
    assert rows(integrity.shared_parents(children, LINES.inverse())) == [(1, 2)]
    spec = EntitySpec("P", (Property("id", T.LongType()), Property("name", T.StringType(), nullable=False, max_length=0)), ("id",))
    got = {r.rule: r.n for r in integrity.summary(parents, spec).collect()}
    assert got == {"id: null": 1, "name: null": 1, "name: longer than 0": 3, "key: repeated": 0}
    assert integrity.row_violations(parents, spec).count() == 4


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_dense_keys_do_not_depend_on_partitions(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)] + [(5, 900), (5, 900)], "k long, v long")
        got = integrity.dense_keys(df, ["k"]).orderBy("id").collect()
        assert [r.id for r in got] == list(range(1, 104)) and [r.k for r in got] == sorted(r.k for r in got)
        assert integrity.dense_keys(df.filter("false"), ["k"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_made_keys(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (1, "x")], "a long, b string")
    ids = [r.id for r in integrity.name_keys(df, ["a", "b"]).orderBy(F.col("b").asc_nulls_first()).collect()]
    assert ids[1] == ids[2] != ids[0] and all(len(i) == 36 for i in ids)
    assert integrity.hilo_keys(df).select("id").distinct().count() == 3


def test_profile(spark):
    df = spark.createDataFrame([(1, "ab", "12.50"), (2, None, "100.00")], "k long, s string, d string").withColumn("d", F.col("d").cast("decimal(10,2)"))
    got = {r.column_name: r for r in metadata.profile(df, "t", exact=True).collect()}
    assert got["k"].key_candidate and not got["s"].key_candidate
    assert (got["s"].n_nulls, got["s"].max_length) == (1, 2)
    assert (got["d"].max_precision, got["d"].max_scale) == (5, 1)


def test_units_and_boxes(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4, 100)] + [("one", 7.0), ("n", None)], "g string, v double")
    box = {r.g: r for r in measure.box_figures(df, ["g"], "v").collect()}
    assert (box["g"].q1, box["g"].q2, box["g"].q3, box["g"].high, box["g"].n_outliers) == (2, 3, 4, 4, 1)
    err = {r.g: r for r in measure.mean_error(df, ["g"], "v").collect()}
    assert err["one"].std_error is None and err["g"].mean == 22 and err["n"].n == 0
    unit = measure.common_unit(spark.createDataFrame([(2e6,), (5e7,)], "v double"), "v").collect()
    assert [(r.scaled, r.unit) for r in unit] == [(2.0, "ms"), (50.0, "ms")]
    bins = measure.histogram(df.filter("g = 'g'"), ["g"], "v", 3).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in bins] == [(0, 4), (2, 1)]


PAPER = [(0, [(30.0, 989), (21.0, 3048), (21.0, 819)]), (1, [(748.0, 1169), (745.0, 3472), (743.0, 979)]), (2, [(182.0, 40924), (557.0, 144094), (2474.0, 175866)])]


def example(spark, mem, n=2):
    m = spark.createDataFrame([("w", q, o, c, b) for q, cells in PAPER for o, (c, b) in enumerate(cells)], "workload string, query int, option int, cost double, mem long")
    w = spark.createDataFrame([("w", 0, 1), ("w", 1, 10_000_000), ("w", 2, 0)], "workload string, query int, weight int")
    return m, w, spark.createDataFrame([("w", n, mem)], "workload string, max_options int, max_mem long")


def test_assignment_example(spark):
    got = assign.cheapest(*example(spark, None)).orderBy("query").collect()
    assert [r.option for r in got] == [2, 2, 0] and got[0].objective == 7_430_000_203
    full = assign.assignment(*example(spark, 200_000)).orderBy("query").collect()
    assert [(r.option, r.status) for r in full] == [(2, "ok"), (2, "ok"), (0, "ok")]


def test_quantiles_do_not_depend_on_partitions(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=999), "b": rng.integers(0, 3, 1000).astype(float), "c": np.array([5.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("d", None), (None, 1.0), (None, 2.0)], "g string, v double")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.g: (r.q1, r.q2) for r in measure.quantiles(df, ["g"], "v", (0.25, 0.9)).collect()}
        assert set(got) == {"a", "b", "c", None} and got[None] == (1.25, 1.9)
        for g, vs in groups.items():
            assert np.allclose(got[g], np.quantile(vs, (0.25, 0.9)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_workloads_of_unlike_sizes_and_budgets(spark):
    m = spark.createDataFrame([("w", q, o, float(q + o), 10 - 3 * o) for q in range(3) for o in range(3)] + [("v", 0, 0, 1.0, 5), ("v", 0, 1, 2.0, 1)], "workload string, query int, option int, cost double, mem long")
    w = spark.createDataFrame([], "workload string, query int, weight int")
    limits = spark.createDataFrame([("w", 2, 20), ("v", 1, 2), ("none", 1, None)], "workload string, max_options int, max_mem long")
    got = {}
    for r in assign.assignment(m, w, limits).collect():
        got.setdefault((r.workload, r.status, r.objective), {})[r.query] = r.option
    assert got == {("v", "ok", 2.0): {0: 1}, ("none", "infeasible", None): {None: None}, ("w", "ok", 7.0): got[("w", "ok", 7.0)]}
    assert sum(10 - 3 * o for o in got[("w", "ok", 7.0)].values()) <= 20


def test_assignment_limits(spark):
    m, w, limits = example(spark, 10)
    assert [(r.query, r.status) for r in assign.assignment(m, w, limits).collect()] == [(None, "infeasible")]
    one = assign.assignment(*example(spark, 200_000, 1)).collect()
    assert {r.option for r in one} == {2} and one[0].status == "ok"
    single, bound = assign.best_single(m, w).first(), assign.greedy(m, w).agg(F.sum("cost")).first()[0]
    assert bound <= assign.cheapest(*example(spark, None)).first().objective <= single.cost


def test_budget_against_brute_force(spark):
    import itertools
    import random

    rng = random.Random(3)
    cells = {(k, q, o): (float(rng.randint(1, 50)), rng.randint(1, 30)) for k in range(6) for q in range(4) for o in range(4)}
    m = spark.createDataFrame([(*key, *v) for key, v in cells.items()], "workload int, query int, option int, cost double, mem long")
    w = spark.createDataFrame([(k, q, 1) for k in range(6) for q in range(4)], "workload int, query int, weight int")
    limits = spark.createDataFrame([(k, 2, 30 + 8 * k) for k in range(6)], "workload int, max_options int, max_mem long")
    got = {r.workload: r.objective for r in assign.assignment(m, w, limits).groupBy("workload").agg(F.max("objective").alias("objective")).collect()}
    for k in range(6):
        best = min((sum(cells[k, q, o][0] for q, o in enumerate(way)) for way in itertools.product(range(4), repeat=4) if len(set(way)) <= 2 and sum(cells[k, q, o][1] for q, o in enumerate(way)) <= 30 + 8 * k), default=None)
        assert got[k] == best


def test_conditions_without_an_equality_are_refused(spark):
    from kinframe.functions.predicate import And, Cmp, Col
    from kinframe.operators import select

    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string")
    both = ("l", "r")
    for on in (F.col("l.k") > F.col("r.k"), And(F.col("l.k") > F.col("r.k"), F.col("l.s") == "x"), Cmp("l.k", "=", "r"), Cmp("l.s", "=", "r.s"), Cmp("l.k", ">", Col("r.k")), Cmp("l.k", "=", Col("l.k")), And(Cmp("l.k", "=", 1), Cmp(Col("r.k"), "=", 1))):
        with pytest.raises(ValueError):
            select.join(a, a, on, aliases=both)
        assert select.join(a, a, on, aliases=both, allow_non_equi=True).columns == ["k", "s", "k", "s"] if not isinstance(on, Cmp) or on.right not in ("r", "r.s") else True
    assert select.join(a, a, And(Cmp("l.k", "=", Col("r.k")), F.col("l.s") == "x"), aliases=both).count() == 1


def test_comparison_without_case(spark):
    from kinframe.functions.predicate import Cmp, where

    df = spark.createDataFrame([("Ab",), ("AB",), ("b",), (None,)], "s string")
    found = lambda *c: sorted(r.s for r in where(df, Cmp("s", *c, ci=True)).collect())
    assert found("=", "aB") == ["AB", "Ab"] and found("<>", "ab") == ["b"] and found("like", "A%") == ["AB", "Ab"]
    assert found("contains", "B") == ["AB", "Ab", "b"] and found("in", ("AB", "x")) == ["AB", "Ab"] and found("between", ("B", "C")) == ["b"]
    assert where(df, Cmp("s", "=", "AB")).count() == 1


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "x"), (3, 3.0, "y")], "k long, v double, s string")
    b = spark.createDataFrame([(1, 1.001, None), (2, 2.5, "x"), (4, 3.0, "y")], "k long, v double, s string")
    got = {r.k: (r.only, r.differing) for r in compare.differences_by_key(a, b, ["k"], 0.01).collect()}
    assert got == {2: (None, ["v"]), 3: ("left", []), 4: ("right", [])}
    assert compare.differences(a, a).count() == 0 and compare.differences(a, a.union(a)).count() == 3
    assert compare.differences(a, b, digits=1).count() == 4
    assert compare.differences_in_order(a, a, ["k"]).count() == 0
    with pytest.raises(ValueError):
        compare.differences(a, b.drop("s"))


def test_merge_facts(spark):
    facts = spark.createDataFrame([("t", "c", "len", "4000", "map", 1), ("t", "c", "len", "17", "profile", 2), ("t", "d", "len", None, "map", 1), ("t", "d", "len", "5", "profile", 2)], "table_name string, column_name string, fact string, value string, source string, priority int")
    got = {r.column_name: (r.value, r.source, r.conflict) for r in compare.merge_facts(facts).collect()}
    assert got == {"c": ("4000", "map", True), "d": ("5", "profile", False)}


def test_sql_parameters_are_values(spark, parents):
    got = source.sql_params(spark, "SELECT * FROM {p} WHERE name = :n OR array_contains(:ids, id)", {"n": "a' OR '1'='1", "ids": [2]}, p=parents)
    assert [r.id for r in got.collect()] == [2]


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("q", "o", 1.5, 3)], "query string, option string, cost double, mem long")
    source.write_measurements(df, str(tmp_path / "m"), ("query",))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
    with pytest.raises(ValueError):
        source.write_measurements(df, str(tmp_path / "x"), kind="xls")


def test_no_machine_local_folder_on_a_cluster(tmp_path):
    from types import SimpleNamespace

    from kinframe.sources.scratch import shared_folder

    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: conf.get(k.rsplit(".", 1)[-1], default)))

    assert shared_folder(session(dir=str(tmp_path), master="spark://host:7077"), "x").startswith(f"{tmp_path}/x-")
    assert "spark-kinframe-" in shared_folder(session(master="local[4]"), "x")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master=master), "x")


def brute(cells, queries, options, most, budget):
    """(cost, mem, picks) by trying every way; None if there is none."""
    import itertools

    ways = []
    for way in itertools.product(options, repeat=len(queries)):
        got = [cells.get((q, o)) for q, o in zip(queries, way, strict=True)]
        if len(set(way)) <= most and None not in got and (budget is None or sum(m for _, m in got) <= budget):
            ways.append((sum(c for c, _ in got), sum(m for _, m in got), list(way)))
    return min(ways, default=None)


def answers(rows):
    out = {}
    for r in rows:
        out.setdefault(r.workload, []).append(r)
    return {w: None if rs[0].query is None else (rs[0].objective, sum(r.mem for r in rs), [r.option for r in sorted(rs, key=lambda r: r.query)]) for w, rs in out.items()}


def test_search_against_brute_force(spark):
    """Missing cells, ties, budgets that bind or not, one to all options."""
    import random

    rng = random.Random(8)
    problems, cells = {}, []
    for w in range(60):
        nq, nf = rng.randint(1, 5), rng.randint(1, 5)
        mine = {(q, o): (float(rng.randint(0, 6)), rng.randint(0, 9)) for q in range(nq) for o in range(nf) if rng.random() < 0.85}
        queries, options = sorted({q for q, _ in mine}), sorted({o for _, o in mine})
        problems[w] = (mine, queries, options, rng.randint(1, nf), rng.choice([None, rng.randint(0, 9 * nq)]))
        cells += [(w, q, o, c, m) for (q, o), (c, m) in mine.items()]
    m = spark.createDataFrame(cells, "workload int, query int, option int, cost double, mem long")
    w = spark.createDataFrame([], "workload int, query int, weight int")
    limits = spark.createDataFrame([(k, p[3], p[4]) for k, p in problems.items()], "workload int, max_options int, max_mem long")
    got = answers(assign.assignment(m, w, limits).collect())
    assert got == {k: brute(*p) if p[1] else None for k, p in problems.items()}
    free = answers(assign.cheapest(m, w, limits).collect())
    assert free == {k: brute(*p[:4], None) for k, p in problems.items() if p[1] and brute(*p[:4], None)}


def test_forty_options_five_of_them(spark):
    import itertools

    import numpy as np

    rng = np.random.default_rng(12)
    cost = rng.integers(1, 1000, (40, 30)).astype(float)
    m = spark.createDataFrame([("w", q, f"o{o:02}", float(cost[o, q]), 1) for o in range(40) for q in range(30)], "workload string, query int, option string, cost double, mem long")
    w = spark.createDataFrame([], "workload string, query int, weight int")
    got = assign.cheapest(m, w, spark.createDataFrame([("w", 5)], "workload string, max_options int")).collect()
    pairs = np.array(list(itertools.combinations(range(40), 2)))
    least = np.minimum(cost[pairs[:, 0]], cost[pairs[:, 1]])
    best = min(np.minimum(least, np.minimum(least[k], cost[o])).sum(axis=1).min() for k in range(len(pairs)) for o in range(pairs[k, 1] + 1, 40))
    assert got[0].objective == best and len(got) == 30 and {r.option for r in got} == {r.option for r in assign.selected_options(spark.createDataFrame(got)).collect()}


def test_a_hundred_queries_under_a_budget(spark):
    """Against a knapsack table over memory, for each pair of options."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(13)
    cost, mem = rng.uniform(1, 100, (6, 100)).round(3), rng.integers(1, 40, (6, 100))
    budget = 1700  # pairs need 1,000 to 1,400 at least, and 2,000 for their cheapest choices
    best = np.inf
    for pair in itertools.combinations(range(6), 2):
        table = np.zeros(budget + 1)
        for q in range(100):
            table = np.min([np.concatenate([np.full(min(mem[o, q], budget + 1), np.inf), table[: max(0, budget + 1 - mem[o, q])]]) + cost[o, q] for o in pair], axis=0)
        best = min(best, table[-1])
    m = spark.createDataFrame([(1, q, o, float(cost[o, q]), int(mem[o, q])) for o in range(6) for q in range(100)], "workload int, query int, option int, cost double, mem long")
    w = spark.createDataFrame([], "workload int, query int, weight int")
    got = assign.assignment(m, w, spark.createDataFrame([(1, 2, budget)], "workload int, max_options int, max_mem long")).collect()
    assert got[0].objective == pytest.approx(best, abs=1e-6) and sum(r.mem for r in got) <= budget and len({r.option for r in got}) <= 2


def pairs_at_most(a, b, tolerance):
    """The greatest number of pairs of one of ``a`` and one of ``b`` within the tolerance, by augmenting paths."""
    partner = {}

    def place(i, seen):
        for j, y in enumerate(b):
            if abs(a[i] - y) <= tolerance and j not in seen:
                seen.add(j)
                if j not in partner or place(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(a)))


def test_rows_without_a_key_within_a_tolerance(spark):
    import random
    from collections import Counter, defaultdict

    from kinframe.operators import matching

    rng = random.Random(21)
    sides = [[(g, round(rng.uniform(0, 6), 2)) for g in ("a", "b", None, "c") for _ in range(rng.randint(3, 14))] for _ in range(2)]
    sides[0] += [("a", 100.0)] * 40 + [("b", None), ("b", float("nan")), ("c", float("inf")), ("c", -float("inf"))]
    sides[1] += [("a", 100.4)] * 55 + [("b", None), ("b", None), ("c", float("inf")), ("d", 0.0)]
    left, right = (spark.createDataFrame(s, "g string, v double") for s in sides)
    for tolerance in (0.0, 0.3, 0.5, 2.0, 1000.0):
        for parts in (1, 9):  # with nine ranges, runs of close values lie across borders
            rows = matching.differences_within(left, right, "v", tolerance, partitions=parts).collect()
            got = Counter()
            for r in rows:
                got[r.g] += r.n_left
                got[r.g, "right"] += r.n_right
            for g in ("a", "b", None, "c", "d"):
                a, b = ([v for k, v in s if k == g and v is not None and abs(v) < float("inf")] for s in sides)
                odd = [Counter(repr(v) for k, v in s if k == g and not (v is not None and abs(v) < float("inf"))) for s in sides]
                pairs = pairs_at_most(a, b, tolerance) + sum((odd[0] & odd[1]).values())
                n = [sum(k == g for k, _ in s) for s in sides]
                assert (got[g], got[g, "right"]) == (n[0] - pairs, n[1] - pairs)
            have = defaultdict(lambda: [0, 0])
            for k, s in enumerate(sides):
                for row in s:
                    have[repr(row)][k] += 1
            assert all(r.n_left <= have[repr((r.g, r.v))][0] and r.n_right <= have[repr((r.g, r.v))][1] for r in rows)
    assert matching.differences_within(left, left, "v", 0.1).count() == 0
    assert matching.differences_within(left.filter("false"), right.filter("false"), "v", 0.1).count() == 0
    assert matching.differences_within(spark.createDataFrame([(0.49,)], "v double"), spark.createDataFrame([(0.51,)], "v double"), "v", 0.05).count() == 0
    for bad in (("g", 1.0), ("v", -1.0), ("v", float("nan"))):
        with pytest.raises(ValueError):
            matching.differences_within(left, right, *bad)


def test_differences_by_ranges(spark):
    from kinframe.operators import matching

    left = spark.range(20_000).selectExpr("id AS k", "concat('v', id % 97) AS s", "CAST(id AS double) AS v")
    right = left.where("k <> 77").selectExpr("k", "IF(k = 5000, 'other', s) AS s", "IF(k = 9000, 0.0D, v) AS v").unionByName(spark.createDataFrame([(30_000, "new", 1.0)], "k long, s string, v double"))
    want = sorted(map(tuple, compare.differences_by_key(left, right, ["k"]).collect()))
    assert sorted(map(tuple, matching.differences_by_ranges(left, right, ["k"]).collect())) == want and len(want) == 4
    ranges, width, few = matching.unequal_ranges(left, right, ["k"], bits=6, levels=3, enough=0)
    assert width == 18 and few and ranges.count() == 4
    assert matching._within(left, ranges, few, ["k"], width).count() <= 6  # of 20,000 rows; the others stay where they are
    assert matching.differences_by_ranges(left, left, ["k"]).count() == 0
    near = left.withColumn("v", left.v + 0.001)
    assert matching.differences_by_ranges(left, near, ["k"], tolerance=0.01).count() == 0
    odd = spark.createDataFrame([(None, "x", None), (None, "x", None), (1, None, -0.0)], "k long, s string, v double")
    assert matching.differences_by_ranges(odd, odd, ["k"]).count() == 0
    assert matching.differences_by_ranges(odd.where("k = 1"), odd.filter("false"), ["k"]).collect()[0].only == "left"


def test_composite_keys(spark):
    import itertools
    import random

    from kinframe.operators import discover

    rng = random.Random(2)
    rows = [(i // 40, i % 40, rng.randint(0, 3), rng.randint(0, 9999) if i else None, float(i // 20), None) for i in range(400)]
    df = spark.createDataFrame(rows, "`a,b` long, b int, c int, d int, e double, f string")
    got = set(discover.unique_sets(df, 3))
    full = [i for i in range(6) if all(r[i] is not None for r in rows)]
    keys = []
    for size in (1, 2, 3):
        keys += [s for s in itertools.combinations(full, size) if not any(set(k) <= set(s) for k in keys) and len({tuple(r[i] for i in s) for r in rows}) == len(rows)]
    assert got == {tuple(df.columns[i] for i in s) for s in keys} and ("a,b", "b") in got
    assert discover.unique_sets(df.limit(1)) == [] and discover.unique_sets(df.filter("false")) == []
    assert discover.unique_sets(df.unionAll(df)) == []


def test_inclusions_and_relations(spark):
    from kinframe.operators import discover
    from kinframe.spec import Cardinality

    parent = spark.createDataFrame([(i, f"n{i}", i % 5) for i in range(1, 3001)], "id long, name string, z int")
    child = spark.createDataFrame([(i, None if i % 7 == 0 else i % 2900 + 1, f"n{i}" if i != 4321 else "missing", 5000 - i) for i in range(1, 5001)], "cid long, pid int, pname string, pid2 long")
    got = {tuple(r)[:4]: (r.n_values, r.n_ref, r.is_unique) for r in discover.inclusions({"parent": parent, "child": child, "none": parent.filter("false")}).collect()}
    assert got[("child", "pid", "parent", "id")][1:] == (3000, False) and ("child", "pname", "parent", "name") not in got
    assert got[("parent", "id", "child", "cid")] == (3000, 5000, True) and ("child", "pid2", "child", "cid") not in got  # 0 is no cid
    assert got[("parent", "z", "child", "pid2")] == (5, 5000, False)
    specs = discover.proposed_relations(discover.inclusions({"parent": parent, "child": child}))
    kinds = {(a, b, s.pairs): s.cardinality for a, b, s in specs}
    assert kinds[("parent", "child", (("id", "pid"),))] is Cardinality.ONE_TO_MANY and kinds[("child", "parent", (("cid", "id"),))] is Cardinality.ONE_TO_ONE


def test_pages_by_rank(spark, monkeypatch):
    import datetime
    import random

    from kinframe.operators import paging, select
    from kinframe.spec import EntitySpec, Property

    monkeypatch.setattr(paging, "SORTED", 50)
    monkeypatch.setattr(paging, "BOUNDS", 7)
    rng = random.Random(9)
    day = datetime.datetime(2020, 1, 1)
    rows = [(i, None if i % 11 == 0 else rng.choice(["x", "y", "z"]), None if i % 13 == 0 else day + datetime.timedelta(hours=rng.randint(0, 90)), rng.choice([0.5, float("nan"), -1.0])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, s string, t timestamp_ntz, v double").repartition(5)
    types = dict(df.dtypes)
    spec = EntitySpec("E", tuple(Property(c, df.schema[c].dataType) for c in types), ("k",))
    for by in ([], ["s"], [("s", False), "t"], [("t", False), ("v", False)], ["v", ("k", False)]):
        whole = [r.k for r in select.order(df, *select.total_order(spec, by)).collect()]
        for skip, take in ((0, 10), (777, 25), (1800, 40), (1990, 40), (2500, 5), (5, 0)):
            assert [r.k for r in paging.page_by_rank(df, spec, skip, take, *by).collect()] == whole[skip : skip + take]
    assert paging.page_by_rank(df.filter("false"), spec, 5, 5).count() == 0
    found = paging.page_by_rank(df, spec, 1800, 20)
    assert found.sparkSession is spark and "Filter" in found._jdf.queryExecution().executedPlan().toString()


def test_range_joins(spark, monkeypatch):
    import random

    from kinframe.operators import rangejoin

    rng = random.Random(4)
    some = lambda: rng.choice([rng.uniform(-50, 50), rng.randint(-9, 9), 1e15 + rng.randint(0, 9), None, float("nan"), float("inf"), 0.0])
    fl = lambda v: None if v is None else float(v)
    points = [(i, fl(some()), rng.choice(["a", "b", None])) for i in range(300)] + [(1000 + i, 7.0, "a") for i in range(1500)]
    spans = [(i, a, None if a is None else a + rng.choice([0.0, 0.3, 5.0, 1e-9, 40.0, -1.0]), rng.choice(["a", "b", None])) for i in range(120) for a in [fl(some())]]
    p, iv = spark.createDataFrame(points, "i long, v double, g string"), spark.createDataFrame(spans, "j long, lo double, hi double, h string")
    ok = lambda v: v is not None and abs(v) < float("inf")
    for on in ((), (("g", "h"),)):
        same = lambda g, h, on=on: not on or (g is not None and g == h)
        got = rangejoin.interval_join(p, iv, "v", "lo", "hi", on)
        assert got.columns == ["i", "v", "g", "j", "lo", "hi", "h"]
        want = sorted((i, j) for i, v, g in points for j, lo, hi, h in spans if ok(v) and ok(lo) and ok(hi) and lo <= v <= hi and same(g, h))
        assert sorted((r.i, r.j) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        for width in (0.0, 0.5, 30.0):
            want = sorted((i, j) for i, v, g in points for j, lo, _, h in spans if ok(v) and ok(lo) and abs(v - lo) <= width and same(g, h))
            assert sorted((r.i, r.j) for r in rangejoin.band_join(p, iv, "v", "lo", width, on).collect()) == want
    assert rangejoin.interval_join(p, iv.filter("false"), "v", "lo", "hi").count() == 0
    for bad in (lambda: rangejoin.band_join(p, p, "v", "v", 1.0), lambda: rangejoin.band_join(p, iv, "g", "lo", 1.0), lambda: rangejoin.band_join(p, iv, "v", "lo", -1.0)):
        with pytest.raises(ValueError):
            bad()


def test_children_in_chunks(spark):
    from kinframe.spec import Cardinality, RelationSpec

    parent = spark.createDataFrame([(1, "one"), (2, "hot"), (3, "none")], "k long, name string")
    child = spark.range(10_000).selectExpr("IF(id < 7, 1, 2) AS pk", "id AS n").unionByName(spark.createDataFrame([(None, 1), (9, 1)], "pk int, n long")).repartition(6)
    rel = RelationSpec("kids", Cardinality.ONE_TO_MANY, (("k", "pk"),))
    got = relation.include_in_chunks(parent, child, rel, 100, order_by=["n"])
    assert got.columns == ["k", "name", "chunk", "kids"]
    rows = got.collect()
    assert max(len(r.kids) for r in rows) == 100 and {r.k: 0 for r in rows if not r.kids} == {3: 0}
    hot = sorted((r for r in rows if r.k == 2), key=lambda r: r.chunk)
    assert [r.chunk for r in hot] == list(range(len(hot))) and [x.n for r in hot for x in r.kids] == list(range(7, 10_000))
    flat = relation.flatten(got.drop("chunk"), "kids")
    assert flat.where("n is not null").count() == 10_000 and flat.where("n is null").count() == 1


def test_clustered_files_are_sought(spark, tmp_path):
    from kinframe.sources import tables as source

    df = spark.range(60_000).selectExpr("(id * 7919) % 60000 AS k", "concat('name ', id) AS name", "id % 10 AS z")
    source.write_clustered(df, str(tmp_path / "c"), ["k"], row_group_bytes=1 << 16, page_rows=500, bloom=["name"])
    back = spark.read.parquet(str(tmp_path / "c"))

    def read(tree):
        got = back.where(tree)
        got.collect()
        plan = got._jdf.queryExecution().executedPlan()
        node = plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan
        while not node.nodeName().startswith("Scan"):
            node = node.children().apply(0)
        return node.metrics().apply("numOutputRows").value()

    assert back.where("k = 4711").count() == 1 and read("k = 4711") <= 1000  # two pages at most of 60,000 rows
    assert read("name = 'nobody'") <= 6000  # Bloom filters leave out most row groups, whose bounds do not


def test_keys_go_on(spark, tmp_path):
    from kinframe.operators import keyblocks

    ledger = str(tmp_path / "ledger")
    batch = lambda a, b: spark.range(a, b).toDF("n")
    keys = lambda name, a, b: {r.n: r.id for r in keyblocks.continued_keys(batch(a, b), ["n"], ledger, name).collect()}
    assert keys("one", 0, 50) == {n: n + 1 for n in range(50)}
    assert keys("two/ü", 50, 80) == {n: n + 1 for n in range(50, 80)}
    assert keys("none", 0, 0) == {} and keys("one", 0, 50)[49] == 50
    assert keys("three", 80, 81) == {80: 81}
    assert [(c["batch"], c["start"], c["count"]) for c in keyblocks.claims(spark, ledger)] == [("one", 1, 50), ("two/ü", 51, 30), ("none", 81, 0), ("three", 81, 1)]
    with pytest.raises(ValueError):
        keys("one", 0, 51)


def test_outlier_rows(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 3, 3, 3, 4, 50, -40)] + [("a", None), ("b", 1.0)], "g string, v double")
    assert sorted((r.g, r.v, r.side) for r in measure.outliers(df, ["g"], "v").collect()) == [("a", -40.0, "low"), ("a", 50.0, "high")]
    assert measure.box_figures(df, ["g"], "v").where("g = 'a'").first().n_outliers == 2
