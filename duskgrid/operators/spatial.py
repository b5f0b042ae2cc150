"""Points in polygons by an index of square cells, with even-odd crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _crossing(y: Column) -> Column:
    """Where a side (x1, y1, x2, y2) that isn't level meets height y."""
    return F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))


def _cells(low: Column, high: Column) -> Column:
    """Whole numbers from low to high, none if high is less."""
    return F.explode(F.when(high >= low, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<long>")))


def area_index(edges: DataFrame, cell: float) -> DataFrame:
    """cx, cy, area, corner, sides: of each cell that an area reaches whether its lower right corner is inside, and the sides in it.

    Corners of a row are inside between the 1st and 2nd, 3rd and 4th, ... place at which the area's sides meet the row's
    lower line, so a row of an area is one list. Cells wholly inside have no sides; cells outside are not in the index. A
    side is in as many cells as it is long, an area in as many as it is large, both counted in cells.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    part = edges.select("area", "x1", "y1", "x2", "y2").withColumn("cy", _cells(F.floor(low / cell), F.floor(high / cell)))
    at = [F.when(F.col("y1") == F.col("y2"), x).otherwise(_crossing(y)) for x, y in ((F.col("x1"), F.greatest(low, F.col("cy") * cell)), (F.col("x2"), F.least(high, (F.col("cy") + 1) * cell)))]
    # a side on a cell's right edge is in it too; a side more changes nothing
    part = part.withColumn("cx", _cells(F.ceil(F.least(*at) / cell - 1e-9) - 1, F.floor(F.greatest(*at) / cell + 1e-9)))
    sides = part.groupBy("cx", "cy", "area").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("sides"))
    line = edges.where("y1 <> y2").withColumn("cy", _cells(F.ceil(low / cell), F.ceil(high / cell))).where((low <= F.col("cy") * cell) & (F.col("cy") * cell < high))
    met = line.groupBy("area", "cy").agg(F.sort_array(F.collect_list(_crossing(F.col("cy") * cell))).alias("_x"))
    spans = met.where("size(_x) > 1").select("area", "cy", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("_x") / 2).cast("int") - 1), lambda i: F.struct(F.get("_x", 2 * i).alias("a"), F.get("_x", 2 * i + 1).alias("b")))).alias("_s"))
    corners = spans.withColumn("_j", _cells(F.floor(F.col("_s.a") / cell), F.ceil(F.col("_s.b") / cell))).where((F.col("_j") * cell >= F.col("_s.a")) & (F.col("_j") * cell < F.col("_s.b")))
    inside = corners.select((F.col("_j") - 1).alias("cx"), "cy", "area", F.lit(1).alias("corner"))
    return sides.join(inside, ["cx", "cy", "area"], "full").withColumn("corner", F.coalesce("corner", F.lit(0)))


def assign_area(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """points (entity, x, y) with the area they lie in, the first by name where areas overlap, else null.

    edges (area, x1, y1, x2, y2) are the sides of each area's closed rings. A point is inside if a ray to the right meets an
    odd number of sides, of which one counts where its lower end's y <= y < its upper end's y, so a corner counts once. Point
    and area meet by cell: on the way from the point to the cell's right edge and down it to the corner, whose parity is
    known, each side that is met changes the parity, and only sides in the cell can be. The work for a point depends on the
    areas and sides in its cell, not on how many there are.
    """
    at = points.where("x is not null and y is not null").select("entity", "x", "y").withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    met = at.join(area_index(edges, cell), ["cx", "cy"])
    right, bottom = (F.col("cx") + 1) * cell, F.col("cy") * cell

    def changes(s: Column) -> Column:
        low, high, level = F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]), s["y1"] == s["y2"]
        meets = s["x1"] + (F.col("y") - s["y1"]) / F.when(~level, s["y2"] - s["y1"]) * (s["x2"] - s["x1"])
        across = (F.col("y") >= low) & (F.col("y") < high) & (F.col("x") < meets) & (meets <= right)
        spans = (F.least(s["x1"], s["x2"]) <= right) & (right < F.greatest(s["x1"], s["x2"]))
        height = F.when(spans, s["y1"] + (right - s["x1"]) / (s["x2"] - s["x1"]) * (s["y2"] - s["y1"]))
        rises = (s["x2"] > s["x1"]) == (s["y2"] > s["y1"])
        down = F.when(rises & ~level, (bottom <= height) & (height < F.col("y"))).otherwise((bottom < height) & (height <= F.col("y")))
        return F.coalesce(across.cast("int"), F.lit(0)) + F.coalesce((spans & down).cast("int"), F.lit(0))

    parity = F.col("corner") + F.coalesce(F.aggregate("sides", F.lit(0), lambda n, s: n + changes(s)), F.lit(0))
    first = met.where(parity % 2 == 1).groupBy("entity").agg(F.min("area").alias("area"))
    return points.join(first, "entity", "left")


def renamed_areas(df: DataFrame, names: dict[str, str], column: str = "area") -> DataFrame:
    """area names trimmed, single-spaced, upper-cased and recoded."""
    plain = F.upper(F.trim(F.regexp_replace(column, r"\s+", " ")))
    out = plain
    for old, new in names.items():
        out = F.when(plain == old.upper(), F.lit(new)).otherwise(out)
    return df.withColumn(column, out)


def area_totals(points: DataFrame, edges: DataFrame, cell: float, value: str) -> DataFrame:
    """area, n, total of value; points outside all areas are under a null area."""
    at = assign_area(points, edges, cell)
    return at.groupBy("area").agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def nearest_row(df: DataFrame, by: str) -> DataFrame:
    """One row of each key, by order of all columns: for layers with repeated keys."""
    w = Window.partitionBy(by).orderBy(*[c for c in df.columns if c != by])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
