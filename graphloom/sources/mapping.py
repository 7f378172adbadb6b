"""The TPC-H-like and corpus tables as a mapped graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.pattern import Mapped, MappedGraph

#: The key of each table's subjects.
KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "events": "event_id",
    "documents": "doc_id",
    "labels": "doc_id",
    "embeddings": "vec_id",
    "pages": "page_id",
}
#: Columns that point to another table's subjects.
LINKS = {
    "nation.n_regionkey": "region",
    "customer.c_nationkey": "nation",
    "supplier.s_nationkey": "nation",
    "orders.o_custkey": "customer",
    "lineitem.l_orderkey": "orders",
    "lineitem.l_partkey": "part",
    "lineitem.l_suppkey": "supplier",
    "events.user_id": "customer",
}
#: Tables that say more of another table's subjects.
SPACES = {"labels": "documents"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped_table(spark: SparkSession, sf_dir: str, name: str) -> Mapped:
    """A table as a class; its predicates are named table.column.

    Subjects keep their native key, so a link column joins its target's subject without any conversion.
    Line items have no key and take a hash of the row.
    """
    df = read_table(spark, sf_dir, name)
    subject = F.col(KEYS[name]) if name in KEYS else F.xxhash64(*df.columns)
    predicates = {f"{name}.{c}": F.col(c) for c in df.columns}
    return Mapped(name, df, subject, predicates, {p: c for p, c in LINKS.items() if p in predicates}, SPACES.get(name))


def mapped_graph(spark: SparkSession, sf_dir: str, *names: str) -> MappedGraph:
    return MappedGraph([mapped_table(spark, sf_dir, n) for n in names])
