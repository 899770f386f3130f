"""Walls of a layout as boxes, from planes that a camera saw and extents that were taped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far a box extends outward from its inner face, and what makes a plane an end or a side.
THICKNESS, SQUARE, BEYOND = 0.02, 0.9, 0.45


def _box(side: str, normal: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column], top: float, gap: float, like: str, points: Column) -> Column:
    """A wall whose inner face runs from a to b, with its normal into the table."""
    n, zero, z = normal, F.lit(0.0), F.col("table_z")
    u = (n[1], -n[0])
    at = [u[0] * p[0] + u[1] * p[1] for p in (a, b)]
    fields = {
        "wall": F.lit(side),
        "normal": F.array(n[0], n[1], zero),
        "offset": -(n[0] * a[0] + n[1] * a[1]),
        "u": F.array(u[0], u[1], zero),
        "extent": F.array(F.least(*at), F.greatest(*at)),
        "center": F.array((a[0] + b[0]) / 2, (a[1] + b[1]) / 2, z + (gap + top) / 2),
        "z_extent": F.array(z + gap, z + top),
        "rgb": F.col(f"{like}.rgb"),
        "n_points": points,
        "thickness": F.lit(THICKNESS),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def taped_walls(walls: DataFrame, tables: DataFrame, top: float, gap: float) -> DataFrame:
    """(layout, wall, normal, offset, u, extent, center, z_extent, rgb, n_points, thickness, problem): the walls of each layout.

    walls: (layout, normal, center, u, offset, extent, z_extent, rgb, n_points), planes as a camera saw them; tables: (layout, x0, x1, y0, y1, table_z).
    Where one plane is an end partition and one a long side, they become boxes from `gap` to `top` over the table with
    inner faces on its edges: `end`, the like of it at the other end (`far end`, of no point), and `side`, which spans the
    table and both ends' thickness; ends run from the near end of the seen one to the side's outer face. All other planes stay
    as `seen`. A layout without just one of both keeps all its planes, and `problem` says what was found.
    """
    n, c = F.col("normal"), F.col("center")
    is_end = (F.abs(n[1]) > SQUARE) & (F.abs(c[1]) > BEYOND)
    is_side = (F.abs(n[0]) > SQUARE) & (c[0] > BEYOND)
    kind = F.when(is_end, "end").when(is_side, "side").otherwise("other")
    marked = walls.withColumn("_kind", kind)
    box = F.struct("normal", "center", "u", "offset", "extent", "rgb", "n_points")
    one = lambda k: F.first(F.when(F.col("_kind") == k, box), True).alias(k)
    found = marked.groupBy("layout").agg(one("end"), one("side"), F.count_if(F.col("_kind") == "end").alias("ends"), F.count_if(F.col("_kind") == "side").alias("sides"))
    found = found.join(tables, "layout").withColumn("good", (F.col("ends") == 1) & (F.col("sides") == 1))
    e = F.col("end")
    near_end = F.array_min(F.transform(e["extent"], lambda t: -e["offset"] * e["normal"][0] + t * e["u"][0]))
    first_near = F.abs(F.col("y0") - e["center"][1]) <= F.abs(F.col("y1") - e["center"][1])
    placed = found.withColumns({"near_x": near_end, "far_x": F.col("x1") + THICKNESS, "near_y": F.when(first_near, F.col("y0")).otherwise(F.col("y1")), "other_y": F.when(first_near, F.col("y1")).otherwise(F.col("y0"))})
    inward = lambda y: F.when(F.col(y) < (F.col("y0") + F.col("y1")) / 2, 1.0).otherwise(-1.0)
    across = lambda name, y, points: _box(name, (F.lit(0.0), inward(y)), (F.col("near_x"), F.col(y)), (F.col("far_x"), F.col(y)), top, gap, "end", points)
    zero = F.lit(0).cast("long")
    along = _box("side", (F.lit(-1.0), F.lit(0.0)), (F.col("x1"), F.col("y0") - THICKNESS), (F.col("x1"), F.col("y1") + THICKNESS), top, gap, "side", F.col("side.n_points"))
    boxes = placed.where("good").select("layout", F.explode(F.array(across("end", "near_y", F.col("end.n_points")), across("far end", "other_y", zero), along)).alias("b"))
    boxes = boxes.select("layout", "b.*", F.lit(None).cast("string").alias("problem"))
    problem = F.when(~F.col("good"), F.format_string("expected one end and one side, found %d and %d", F.col("ends"), F.col("sides")))
    rest = marked.join(found.select("layout", "good", problem.alias("problem")), "layout").where(~F.col("good") | (F.col("_kind") == "other"))
    rest = rest.select("layout", F.lit("seen").alias("wall"), "normal", "offset", "u", "extent", "center", "z_extent", "rgb", "n_points", F.lit(THICKNESS).alias("thickness"), "problem")
    return boxes.unionByName(rest)
