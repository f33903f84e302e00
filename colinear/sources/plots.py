"""PostScript pages from rectangle and segment tables: the thin end of the plot operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = "%!PS-Adobe-3.0\n"
TAIL = "showpage\n"


def rectangles(paint: DataFrame, scale: float = 1e-3, height: float = 10.0, colours: int = 10) -> DataFrame:
    """``value``: a PostScript line for each painted rectangle (axis, name, start, end, colour); rows of names lie above each other."""
    hue = F.pmod(F.col("colour"), F.lit(colours)) / float(colours)
    y = F.pmod(F.abs(F.xxhash64("name")), F.lit(60)) * height
    return paint.select(F.format_string("%.3f 1 0.8 sethsbcolor %.2f %.2f %.2f %.2f rectfill", hue, F.col("start") * scale, y, (F.col("end") - F.col("start")) * scale, F.lit(height * 0.8)).alias("value"))


def segments(dots: DataFrame, scale: float = 1e-3) -> DataFrame:
    """``value``: a PostScript line for each segment of a dot plot."""
    return dots.select(F.format_string("%.2f setgray newpath %.2f %.2f moveto %.2f %.2f lineto stroke", F.col("colour") / 20.0, F.col("x1") * scale, F.col("y1") * scale, F.col("x2") * scale, F.col("y2") * scale).alias("value"))


def write_page(lines: DataFrame, path: str) -> None:
    """Writes the body in parts; ``HEAD`` and ``TAIL`` go around them when the parts are joined."""
    lines.write.text(path)
