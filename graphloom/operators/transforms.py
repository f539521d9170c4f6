"""Dataset transforms: label filters, induced graphs, seeded splits, aliases, synthetic triplets, label hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import draw
from .graph import dense_ids


def csv_to_tabs(spark: SparkSession, csv: str, out: str) -> None:
    """Replace commas by tabs."""
    spark.read.text(csv).select(F.translate("value", ",", "\t").alias("value")).write.text(out)


def top_k_label(labels: DataFrame, k: int) -> DataFrame:
    """(node, label) rows of the k most frequent labels; ties go to the smaller label. k rows decide, whatever the size of labels."""
    top = labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k).select("label")
    return labels.join(F.broadcast(top), "label", "left_semi").select("node", "label") if k <= 100_000 else labels.join(top, "label", "left_semi").select("node", "label")


def induced_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both in nodes (node)."""
    known = nodes.select("node").distinct()
    return edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def edge_split(edges: DataFrame, portions: list[float], seed: int = 1024, key: str = "line") -> DataFrame:
    """edges with a column part: part i gets about portions[i] of the lines; what lies beyond the sum of portions gets null.

    A line's part depends on its number and the seed only.
    """
    u = draw(F.col(key), 0, seed)
    part, at = F.lit(None).cast("int"), 0.0
    bounds = []
    for p in portions:
        bounds.append((at, at + p))
        at += p
    for i, (lo, hi) in reversed(list(enumerate(bounds))):
        part = F.when((u >= lo) & (u < hi), i).otherwise(part)
    return edges.withColumn("part", part)


def negative_edges(edges: DataFrame, n: int, seed: int = 1024, rounds: int = 20) -> DataFrame:
    """(src, dst): exactly n different seeded pairs u <> v of vertices with no edge in either direction (fewer only if the graph has no more)."""
    names = dense_ids(edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()).persist()
    size = names.count()
    known = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    found, have = None, 0
    spark = edges.sparkSession
    for r in range(rounds):
        if have >= n or size < 2:
            break
        want = int((n - have) * 1.2) + 16
        tries = spark.range(want).select(
            "id", F.floor(draw(F.col("id"), 2 * r, seed) * size).alias("a"), F.floor(draw(F.col("id"), 2 * r + 1, seed) * size).alias("b")
        ).where("a <> b")
        pairs = tries.join(names.select(F.col("id").alias("a"), F.col("name").alias("src")), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("dst")), "b")
        fresh = pairs.join(known, ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min("id").alias("id"))
        if found is not None:
            fresh = fresh.join(found, ["src", "dst"], "left_anti")
        fresh = fresh.withColumn("at", F.col("id") + F.lit(r * (1 << 32)))
        found = fresh.select("src", "dst", "at") if found is None else found.unionByName(fresh.select("src", "dst", "at"))
        found = found.persist()
        have = found.count()
    if found is None:
        return known.limit(0)
    return found.orderBy("at").limit(n).select("src", "dst")


def link_prediction_split(edges: DataFrame, portions: list[float], seed: int = 1024) -> tuple[DataFrame, list[DataFrame]]:
    """(train edges, [test sets (src, dst, y)]): the first portion trains; each other one gets its edges with y = 1 and as many negatives with y = 0."""
    split = edge_split(edges, portions, seed).persist()
    tests = []
    for i in range(1, len(portions)):
        own = split.where(F.col("part") == i).select("src", "dst")
        bad = negative_edges(edges, own.count(), seed + i)
        tests.append(own.withColumn("y", F.lit(1)).unionByName(bad.withColumn("y", F.lit(0))))
    return split.where("part = 0").drop("part"), tests


def alias_map(aliases: DataFrame) -> DataFrame:
    """(alias, object) from (object, aliases); an alias that names more than one object goes."""
    rows = aliases.select("object", F.explode("aliases").alias("alias"))
    return rows.groupBy("alias").agg(F.count_distinct("object").alias("n"), F.min("object").alias("object")).where("n = 1").select("alias", "object")


def math_triplets(spark: SparkSession, n: int, seed: int = 1023, numbers: int = 1000, largest: int = 30) -> DataFrame:
    """(h, r, t) = (x, op y, f(x, y)) with x < numbers, 1 <= y <= largest and op among + - * / %; / is floor division, the first three wrap at `numbers`."""
    i = F.col("id")
    x, y, o = F.floor(draw(i, 0, seed) * numbers), F.floor(draw(i, 1, seed) * largest) + 1, F.floor(draw(i, 2, seed) * 5)
    rows = spark.range(n).select("id", x.alias("x"), y.alias("y"), o.alias("o"))
    r = F.concat(F.element_at(F.array(*[F.lit(c) for c in "+-*/%"]), (F.col("o") + 1).cast("int")), F.col("y").cast("string"))
    t = F.expr(f"CASE o WHEN 0 THEN (x + y) % {numbers} WHEN 1 THEN pmod(x - y, {numbers}) WHEN 2 THEN (x * y) % {numbers} WHEN 3 THEN x DIV y ELSE x % y END")
    return rows.select("id", F.col("x").cast("string").alias("h"), r.alias("r"), t.cast("string").alias("t"))


def root_paths(parents: DataFrame, max_depth: int = 64) -> DataFrame:
    """(child, path): names from the root to each node of (child, parent); roots have a null parent. One join a level."""
    level = parents.where("parent IS NULL").select("child", F.array("child").alias("path"))
    done, depth = level, 0
    while depth < max_depth:
        level = parents.where("parent IS NOT NULL").join(level.select(F.col("child").alias("parent"), "path"), "parent").select("child", F.concat("path", F.array("child")).alias("path")).persist()
        if level.isEmpty():
            return done
        done, depth = done.unionByName(level), depth + 1
    raise ValueError("the hierarchy is deeper than max_depth, or has a cycle")


def common_depth(paths: DataFrame) -> DataFrame:
    """Paths cut or padded with their leaf to one depth, the largest found, so that levels line up."""
    deepest = paths.agg(F.max(F.size("path"))).first()[0] or 0
    return paths.withColumn("path", F.concat("path", F.array_repeat(F.element_at("path", -1), F.lit(deepest) - F.size("path"))))


def readable_labels(labels: DataFrame, parents: DataFrame, hierarchy: bool = False) -> DataFrame:
    """labels (id, label) with names from the root (hierarchy), or with each label lifted level by level towards the root until one class is left."""
    paths = root_paths(parents)
    named = labels.join(paths.withColumnRenamed("child", "label"), "label")
    if hierarchy:
        return common_depth(named.select("id", "path"))
    return named.select("id", F.col("path")[0].alias("label"))


def concat_splits(*parts: DataFrame) -> DataFrame:
    """Rows of all parts with their part number first, so that order and origin stay known."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("split", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def effective(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: n_before, n_after of a filtering step."""
    return before.agg(F.count("*").alias("n_before")).crossJoin(after.agg(F.count("*").alias("n_after")))


def largest_first(rows: DataFrame, by: str, key: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), key)))
