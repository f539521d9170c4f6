"""Graph operators: dictionaries, direction, degrees, normalisation, adjacency, partitions.

Graphs are tables of edges (src, dst, weight) or triplets (h, r, t, weight); duplicates are parallel edges. Contracts are by name; ids are dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settle
from .sampling import cumulative

EPSILON = 1e-15
#: Names that are sent to every executor.
FEW_NAMES = 50_000


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with __at, their place from 0 on in the given order.

    Range-partitioned and checkpointed: each partition numbers its own rows and adds the rows of the partitions before it, so no task sorts all rows.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = settle(ranged.withColumn("__seq", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__seq", 33))
    counts = tagged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    out = tagged.join(F.broadcast(starts), "__part")  # a row a partition
    return out.select(*rows.columns, (F.col("__start") + F.col("__seq") - F.shiftleft("__part", 33)).alias("__at"))


def dense_ids(names: DataFrame, order: Column | None = None) -> DataFrame:
    """(name, id) for distinct names, ids dense from 0 in the order of `order` (by default the name)."""
    key = F.col("name") if order is None else order
    return numbered(names.select("name", key.alias("__key")), [F.col("__key"), F.col("name")]).select("name", F.col("__at").alias("id"))


def vertex_names(edges: DataFrame, by: str = "name") -> DataFrame:
    """(name, id) of all vertices; by "name", or by "line" in the order of first appearance (source before target of a line)."""
    both = edges.select(F.col("src").alias("name"), *([(F.col("line") * 2).alias("at")] if by == "line" else [])).unionByName(
        edges.select(F.col("dst").alias("name"), *([(F.col("line") * 2 + 1).alias("at")] if by == "line" else []))
    )
    if by == "line":
        first = both.groupBy("name").agg(F.min("at").alias("at"))
        return dense_ids(first, F.col("at"))
    return dense_ids(both.distinct())


def encode(edges: DataFrame, names: DataFrame, columns: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """edges with names replaced by ids; a row with an unknown name goes. A few names are broadcast: all rows of one, such as a relation's, would else meet in one task."""
    if names.limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        names = F.broadcast(names)
    for c in columns:
        edges = edges.join(names.select(F.col("name").alias(c), F.col("id").alias(f"__{c}")), c).drop(c).withColumnRenamed(f"__{c}", c)
    return edges


def kg_names(triplets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dictionaries (name, id) of entities and of relations."""
    entities = triplets.select(F.col("h").alias("name")).union(triplets.select("t")).distinct()
    return dense_ids(entities), dense_ids(triplets.select(F.col("r").alias("name")).distinct())


def encode_triplets(triplets: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    return encode(encode(triplets, entities, ("h", "t")), relations, ("r",))


def directed(edges: DataFrame, as_undirected: bool = True) -> DataFrame:
    """Adjacency entries: as undirected, every edge but self-loops counts in both directions."""
    own = edges.select("src", "dst", "weight")
    if not as_undirected:
        return own
    return own.unionByName(own.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def vertex_weights(adjacency: DataFrame) -> DataFrame:
    """(id, weight): weighted out-degree; vertices without out-edges have 0."""
    gone = adjacency.select(F.col("dst").alias("id"), F.lit(0.0).alias("weight"))
    return adjacency.select(F.col("src").alias("id"), "weight").unionByName(gone).groupBy("id").agg(F.sum("weight").alias("weight"))


def normalize(adjacency: DataFrame) -> DataFrame:
    """Weight over the root of its source's out-weight times its target's in-weight.

    Two aggregates joined back, not windows: sums of hot vertices are taken before the shuffle.
    """
    out = adjacency.groupBy("src").agg(F.sum("weight").alias("__out"))
    in_ = adjacency.groupBy("dst").agg(F.sum("weight").alias("__in"))
    both = adjacency.join(out, "src").join(in_, "dst")
    return both.select("src", "dst", F.try_divide("weight", F.sqrt(F.col("__out") * F.col("__in"))).alias("weight"))


def kg_normalize(triplets: DataFrame) -> DataFrame:
    """Weight over the root of the sums of its (h, r) and of its (t, r)."""
    head = triplets.groupBy("h", "r").agg(F.sum("weight").alias("__head"))
    tail = triplets.groupBy("t", "r").agg(F.sum("weight").alias("__tail"))
    both = triplets.join(head, ["h", "r"]).join(tail, ["t", "r"])
    return both.select("h", "r", "t", F.try_divide("weight", F.sqrt(F.col("__head") * F.col("__tail"))).alias("weight"))


def head_weights(triplets: DataFrame) -> DataFrame:
    """(id, weight) of a knowledge graph: sums over the head side, 0 for entities that are tails only."""
    gone = triplets.select(F.col("t").alias("id"), F.lit(0.0).alias("weight"))
    return triplets.select(F.col("h").alias("id"), "weight").unionByName(gone).groupBy("id").agg(F.sum("weight").alias("weight"))


def adjacency_lists(adjacency: DataFrame) -> DataFrame:
    """(src, neighbours): array of (dst, weight), sorted. A hot vertex makes a long array; use edge tables where that matters."""
    return adjacency.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("neighbours"))


def flatten(lists: DataFrame) -> DataFrame:
    """The inverse of adjacency_lists()."""
    return lists.select("src", F.inline("neighbours"))


def offsets(adjacency: DataFrame) -> DataFrame:
    """(src, degree, offset): where each vertex's entries begin in the edge list sorted by vertex. Blocks of a range partitioning are summed, so no task sees all vertices."""
    degree = adjacency.groupBy("src").agg(F.count("*").alias("degree"))
    return cumulative(degree, "degree", ["src"]).select("src", "degree", F.col("lo").cast("long").alias("offset"))


def graph_info(edges: DataFrame) -> DataFrame:
    """One row: num_vertex and num_edge (input lines)."""
    n = edges.select("src").union(edges.select("dst")).agg(F.count_distinct("src").alias("num_vertex"))
    return n.crossJoin(edges.agg(F.count("*").alias("num_edge")))


def kg_info(triplets: DataFrame) -> DataFrame:
    """One row: num_entity, num_relation and num_edge."""
    n = triplets.select("h").union(triplets.select("t")).agg(F.count_distinct("h").alias("num_entity"))
    return n.crossJoin(triplets.agg(F.count_distinct("r").alias("num_relation"), F.count("*").alias("num_edge")))


def zigzag_partition(weights: DataFrame, parts: int) -> DataFrame:
    """(id, weight, part): vertices by falling weight, dealt to and fro over the parts, which balances their sums."""
    turn = F.col("__at") % (2 * parts)
    weights = numbered(weights.select("id", "weight"), [F.desc("weight"), F.col("id")])
    return weights.withColumn("__turn", turn).select("id", "weight", F.least(F.col("__turn"), F.lit(2 * parts - 1) - F.col("__turn")).cast("int").alias("part"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Entries present in both directions take the mean of their weights; others stay. Settled first: both sides of the join are the same entries, made once."""
    edges = settle(edges.select("src", "dst", "weight"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("__back"))
    return edges.join(back, ["src", "dst"], "left").select("src", "dst", F.coalesce((F.col("weight") + F.col("__back")) / 2, F.col("weight")).alias("weight"))


def clear(*tables: DataFrame) -> None:
    """Give back what tables hold in memory; doing it again does no harm."""
    for t in tables:
        t.unpersist()
