"""Specs of the tables the queries run on."""

from __future__ import annotations

from pyspark.sql import types as T

from ..spec import Cardinality, EntitySpec, Property, RelationSpec, spark_type

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
NTZ = T.TimestampNTZType()


def entity(name: str, table: str, key: tuple[str, ...], **columns: T.DataType) -> EntitySpec:
    return EntitySpec(name, tuple(Property(c, t) for c, t in columns.items()), key, table)


REGION = entity("Region", "region", ("r_regionkey",), r_regionkey=I, r_name=S)
NATION = entity("Nation", "nation", ("n_nationkey",), n_nationkey=I, n_name=S, n_regionkey=I)
CUSTOMER = entity("Customer", "customer", ("c_custkey",), c_custkey=L, c_name=S, c_nationkey=I, c_acctbal=D, c_mktsegment=S)
SUPPLIER = entity("Supplier", "supplier", ("s_suppkey",), s_suppkey=L, s_name=S, s_nationkey=I, s_acctbal=D)
PART = entity("Part", "part", ("p_partkey",), p_partkey=L, p_name=S, p_brand=S, p_type=S, p_size=I, p_retailprice=D)
ORDERS = entity("Order", "orders", ("o_orderkey",), o_orderkey=L, o_custkey=L, o_orderstatus=S, o_totalprice=D, o_orderdate=NTZ, o_orderpriority=S)
LINEITEM = entity("Line", "lineitem", (), l_orderkey=L, l_partkey=L, l_suppkey=L, l_linenumber=I, l_quantity=D, l_extendedprice=D, l_discount=D, l_tax=D, l_returnflag=S, l_linestatus=S, l_shipdate=NTZ)
EVENTS = entity("Event", "events", ("event_id",), event_id=L, ts=NTZ, user_id=L, event_type=S, value=D, props=S)
ALL = (REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS)

#: The supplier as the library's users see it: own names, and money as decimal.
SUPPLIER_ENTITY = EntitySpec(
    "SupplierContact",
    (
        Property("SupplierID", L, "s_suppkey", nullable=False),
        Property("SupplierName", S, "s_name", max_length=100),
        Property("Balance", spark_type("decimal"), "s_acctbal"),
        Property("NationID", I, "s_nationkey"),
        Property("Reference", S, "s_reference", default="none"),
    ),
    ("SupplierID",),
    "supplier",
)

ORDER_LINES = RelationSpec("lines", Cardinality.ONE_TO_MANY, (("o_orderkey", "l_orderkey"),))
CUSTOMER_ORDERS = RelationSpec("orders", Cardinality.ONE_TO_MANY, (("c_custkey", "o_custkey"),))
ORDER_CUSTOMER = CUSTOMER_ORDERS.inverse()
PART_SUPPLIERS = RelationSpec("suppliers", Cardinality.MANY_TO_MANY, (("p_partkey", "l_partkey"),), (("l_suppkey", "s_suppkey"),))
