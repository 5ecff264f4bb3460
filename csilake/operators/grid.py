"""Survey rooms and their points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_points(rooms: DataFrame) -> DataFrame:
    """(room_id, numero, x, y): full grid of each room, numbered from 1 row by row."""
    cells = rooms.where(F.col("width") * F.col("length") > 0).select(
        F.col("id").alias("room_id"),
        "width",
        F.posexplode(F.sequence(F.lit(1), (F.col("width") * F.col("length")).cast("int"))).alias("_pos", "numero"),
    )
    return cells.select(
        "room_id", "numero", (F.col("_pos") % F.col("width")).alias("x"), F.floor(F.col("_pos") / F.col("width")).cast("int").alias("y")
    )


def coordinates(rooms: DataFrame) -> DataFrame:
    """A room with its two coordinate lists as one row per point."""
    return rooms.select(
        F.col("id").alias("room_id"), F.posexplode(F.arrays_zip("pontos_x", "pontos_y")).alias("_pos", "_point")
    ).select(
        "room_id", (F.col("_pos") + 1).alias("numero"), F.col("_point.pontos_x").alias("x"), F.col("_point.pontos_y").alias("y")
    )


def points_with_room(points: DataFrame, rooms: DataFrame) -> DataFrame:
    return points.join(rooms.withColumnRenamed("id", "room_id"), "room_id")
