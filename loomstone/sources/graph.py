"""Triples (h, r, t) as DataFrames, from files or from the order tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLE = T.StructType([T.StructField("head", T.LongType(), False), T.StructField("relation", T.IntegerType(), False), T.StructField("tail", T.LongType(), False)])

#: Relation r of the graph over the order tables; r + INVERSE is its inverse.
INVERSE = 7
RELATIONS = {1: "customer nation", 2: "nation region", 3: "supplier nation", 4: "order customer", 5: "order part", 6: "order supplier", 7: "part supplier"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of head, relation, tail with a header, with or without a byte-order mark. A row that isn't three integers fails the read; equal rows are one triple."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(TRIPLE).csv(path)
    return raw.select(F.col("head").alias("h"), F.col("relation").alias("r"), F.col("tail").alias("t")).dropDuplicates()


def write_triples(kg: DataFrame, path: str) -> None:
    """Parquet by relation, heads in order inside a file: a hop reads one partition and skips row groups by head. Ranges of (r, h, t) split a relation, and a head, however large they are."""
    kg.repartitionByRange("r", "h", "t").sortWithinPartitions("r", "h").write.partitionBy("r").parquet(path)


def indexed(kg: DataFrame, name: str = "triples") -> DataFrame:
    """The triples written as by ``write_triples`` to the shared folder and read back: a filter on r reads that relation's files alone."""
    from ..streaming.staged import shared_folder

    path = f"{shared_folder(kg.sparkSession)}/{name}-{uuid.uuid4().hex}"
    kinds = {f.name: f.dataType.simpleString() for f in kg.schema}
    write_triples(kg, path)
    return kg.sparkSession.read.schema(f"h {kinds['h']}, t {kinds['t']}, r {kinds['r']}").parquet(path).select("h", "r", "t")


_INDEXES: dict[tuple, DataFrame] = {}


def order_index(spark: SparkSession, sf_dir: str, relations: tuple[int, ...] | None = None) -> DataFrame:
    """``order_graph``, or some relations of it, as an index that is made once for a Spark application and folder; the tables under the folder are taken not to change meanwhile."""
    key = (spark.sparkContext.applicationId, sf_dir, relations)
    if key not in _INDEXES:
        kg = order_graph(spark, sf_dir)
        _INDEXES[key] = indexed(kg if relations is None else kg.where(F.col("r").isin(*relations)))
    return _INDEXES[key]


def order_graph(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """The triples of the order tables, both directions. A filter on r keeps only the branches that hold it. With ``repeated`` a triple comes as often as line items give it, and the line items needn't be shuffled before a join."""

    def pairs(name: str, r: int, h, t, several: bool = False) -> DataFrame:
        out = table(spark, sf_dir, name).select(h.cast("long").alias("h"), t.cast("long").alias("t"))
        out = out.distinct() if several and not repeated else out
        return out.select("h", F.lit(r).alias("r"), "t").union(out.select(F.col("t").alias("h"), F.lit(r + INVERSE).alias("r"), F.col("h").alias("t")))

    c = F.col
    parts = [
        pairs("customer", 1, 20_000_000 + c("c_custkey"), 100 + c("c_nationkey")),
        pairs("nation", 2, 100 + c("n_nationkey"), c("n_regionkey")),
        pairs("supplier", 3, 1_000_000 + c("s_suppkey"), 100 + c("s_nationkey")),
        pairs("orders", 4, 30_000_000 + c("o_orderkey"), 20_000_000 + c("o_custkey")),
        pairs("lineitem", 5, 30_000_000 + c("l_orderkey"), 10_000_000 + c("l_partkey"), True),
        pairs("lineitem", 6, 30_000_000 + c("l_orderkey"), 1_000_000 + c("l_suppkey"), True),
        pairs("lineitem", 7, 10_000_000 + c("l_partkey"), 1_000_000 + c("l_suppkey"), True),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def entity_index(kg: DataFrame) -> DataFrame:
    """(e, h, r, t): each triple under its head and its tail."""
    return kg.select(F.col("h").alias("e"), "h", "r", "t").union(kg.where("h <> t").select(F.col("t").alias("e"), "h", "r", "t"))


def read_kb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A knowledge base in JSON: (id, name) of its entities, and the directed edges (h, predicate, direction, t) whose fields are text and whose direction is forward or backward."""
    kind = "struct<name:string,relations:array<struct<predicate:string,direction:string,object:string>>>"
    kb = spark.read.option("multiLine", True).schema(f"entities map<string,{kind}>, concepts map<string,{kind}>").json(path)
    entries = kb.select(F.explode("entities").alias("id", "e"))
    names = entries.select("id", F.col("e.name").alias("name")).where("name IS NOT NULL")
    edges = entries.select(F.col("id").alias("h"), F.explode("e.relations").alias("x")).select("h", "x.predicate", "x.direction", F.col("x.object").alias("t"))
    return names, edges.where("predicate IS NOT NULL AND t IS NOT NULL AND direction IN ('forward', 'backward')").distinct()


def name_index(names: DataFrame) -> DataFrame:
    """(name, ids): the sorted ids that bear a name; more than one makes it ambiguous."""
    return names.groupBy("name").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def relation_ids(edges: DataFrame) -> DataFrame:
    """(rel_key, rel_id): predicates get ids by name, forward from 1 on, backward the same plus their number. The predicate list is small: one row for each predicate."""
    from pyspark.sql import Window

    predicates = edges.select("predicate").distinct().select("predicate", F.row_number().over(Window.orderBy("predicate")).alias("i"))
    n = predicates.agg(F.max("i").alias("n"))
    both = predicates.crossJoin(n)  # one row on the right
    return both.select(F.concat("predicate", F.lit("::forward")).alias("rel_key"), F.col("i").alias("rel_id")).union(both.select(F.concat("predicate", F.lit("::backward")), F.col("i") + F.col("n")))
