"""Plot-ready projections of coordinates (id, x, y[, z]) and a dependency-free SVG writer."""

from __future__ import annotations

import math
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import within_deviations


def coordinates(embeddings: DataFrame) -> DataFrame:
    """(id, x, y[, z]) from (id, vec)."""
    first = embeddings.select(F.size("vec")).first()
    names = "xyz"[: min(3, first[0] if first else 2)]
    return embeddings.select("id", *[F.col("vec")[i].cast("double").alias(c) for i, c in enumerate(names)])


def scatter_points(points: DataFrame, labels: DataFrame, k: float = 5.0) -> DataFrame:
    """Points without outliers, with their label (id, label); unlabelled ones get null."""
    axes = [c for c in points.columns if c in "xyz"]
    return within_deviations(points, axes, k).join(labels.select("id", "label"), "id", "left").select("id", *axes, "label")


def hierarchy_frames(paths: DataFrame, target: str) -> DataFrame:
    """(depth, id, class) frames that zoom to a target label of (id, path), root first.

    Frame d shows the labels at depth d of points that share the target's class one level up; everything else is "else".
    """
    holds = paths.where(F.array_contains("path", target)).orderBy("id").select("path").first()
    if holds is None:
        raise ValueError(f"no label is called `{target}`")
    path = list(holds["path"])
    depth = path.index(target)
    frames = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    own = F.array(*[F.lit(x) for x in path])
    rows = paths.select("id", "path", frames.alias("depth"))
    inside = (F.col("depth") == 0) | (F.get("path", F.col("depth") - 1) == F.get(own, F.col("depth") - 1))
    return rows.select("depth", "id", F.when(inside, F.get("path", F.col("depth"))).otherwise("else").alias("class"))


def rotation_frames(points: DataFrame, num_frame: int = 700, elevation: float = 30.0) -> DataFrame:
    """(frame, id, u, v): 3-D points seen from an azimuth of 360 / num_frame degrees a frame, at a fixed elevation."""
    e = math.radians(elevation)
    frames = points.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(num_frame - 1))))
    a = F.radians(F.col("frame") * F.lit(360.0 / num_frame))
    turned = frames.withColumn("__x", F.col("x") * F.cos(a) - F.col("y") * F.sin(a)).withColumn("__y", F.col("x") * F.sin(a) + F.col("y") * F.cos(a))
    return turned.select("frame", "id", F.col("__x").alias("u"), (F.col("z") * F.lit(math.cos(e)) + F.col("__y") * F.lit(math.sin(e))).alias("v"))


PALETTE = ("#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#3ca951", "#ff8ab7", "#a463f2", "#97bbf5", "#9c6b4e", "#9498a0")


def write_svg(points: DataFrame, path: str, x: str = "x", y: str = "y", label: str = "label", size: int = 800, radius: float = 2.0, most: int = 200_000) -> None:
    """A scatter figure as SVG, classes in sorted order. A picture holds at most `most` points; more are an error, not a silent sample."""
    rows = points.select(x, y, F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label")).orderBy("label", x, y).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a figure holds {most} points; filter or sample first")
    lo, hi = [min((r[i] for r in rows), default=0.0) for i in (0, 1)], [max((r[i] for r in rows), default=1.0) for i in (0, 1)]
    place = lambda v, i: 20 + (v - lo[i]) / ((hi[i] - lo[i]) or 1.0) * (size - 40)
    color = {c: PALETTE[i % len(PALETTE)] for i, c in enumerate(sorted({r["label"] for r in rows}))}
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}" viewBox="0 0 {size} {size}">\n')
        for r in rows:
            out.write(f'<circle cx="{place(r[0], 0):.2f}" cy="{size - place(r[1], 1):.2f}" r="{radius:g}" fill="{color[r["label"]]}"/>\n')
        for i, c in enumerate(color):
            out.write(f'<text x="24" y="{30 + 16 * i}" font-size="12" fill="{color[c]}">{escape(c)}</text>\n')
        out.write("</svg>\n")
