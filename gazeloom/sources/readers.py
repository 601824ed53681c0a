"""Gaze from CSV, labelled ARFF recordings, head-mounted exports and in-memory records; sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAZE_SCHEMA = "gazeX double, gazeY double, gazeZ double, status double"
#: Label names of the ARFF recordings and their numbers.
ARFF_LABELS = {"UNKNOWN": 0, "NOISE": 0, "FIX": 1, "SACCADE": 2, "SP": 3}


def _numbered(df: DataFrame) -> DataFrame:
    """Row order becomes the sample number, file by file: position in the file's splits, dense after sorting."""
    placed = df.withColumn("recording", F.input_file_name()).withColumn("__at", F.monotonically_increasing_id())
    return placed.withColumn("i", (F.row_number().over(Window.partitionBy("recording").orderBy("__at")) - 1).cast("long")).drop("__at")


def gaze_csv(spark: SparkSession, path: str, distance: float = 1000.0, schema: str | None = None) -> DataFrame:
    """(recording, i, x, y, z, status) from CSV files with a header, one recording a file; gazeZ and status are optional."""
    raw = _numbered(spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None))
    z = F.coalesce(F.col("gazeZ"), F.lit(distance)) if "gazeZ" in raw.columns else F.lit(distance)
    status = F.coalesce(F.col("status"), F.lit(1.0)) if "status" in raw.columns else F.lit(1.0)
    return raw.select("recording", "i", F.col("gazeX").cast("double").alias("x"), F.col("gazeY").cast("double").alias("y"), z.cast("double").alias("z"), status.cast("double").alias("status"))


def gaze_arff(spark: SparkSession, path: str) -> DataFrame:
    """(recording, i, time_us, x_px, y_px, x, y, confidence, label, off_screen) from ARFF files, x and y in millimetres from the metadata lines."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("recording"))
    meta = lines.where(F.col("value").startswith("%@METADATA"))
    sized = meta.groupBy("recording").agg(*[F.max(F.when(F.col("value").contains(f" {k} "), F.regexp_extract("value", r"(-?[0-9.]+)\s*$", 1).cast("double"))).alias(k) for k in ("width_px", "height_px", "width_mm", "height_mm", "distance_mm")])
    cells = F.split("value", ",")
    rows = lines.where(F.col("value").rlike(r"^\s*-?[0-9]")).select("recording", *[F.trim(cells[k]).cast("double").alias(n) for k, n in enumerate(("time_us", "x_px", "y_px", "confidence"))], F.upper(F.trim(F.element_at(cells, -1))).alias("name"))
    rows = rows.withColumn("i", (F.row_number().over(Window.partitionBy("recording").orderBy("time_us")) - 1).cast("long")).join(F.broadcast(sized), "recording")
    label = F.create_map(*[F.lit(x) for k, v in ARFF_LABELS.items() for x in (k, v)])[F.col("name")]
    off = (F.col("x_px") < 0) | (F.col("y_px") < 0) | (F.col("x_px") > F.col("width_px")) | (F.col("y_px") > F.col("height_px"))
    return rows.select("recording", "i", "time_us", "x_px", "y_px", (F.col("x_px") * F.col("width_mm") / F.col("width_px")).alias("x"), (F.col("y_px") * F.col("height_mm") / F.col("height_px")).alias("y"), "confidence", F.coalesce(label, F.lit(0)).alias("label"), off.alias("off_screen"), "width_mm", "height_mm")


def cleaned(df: DataFrame, most_noise: float) -> DataFrame:
    """Recordings (recording, i, x, y, label) with at most ``most_noise`` of their samples labelled 0; x and y of those samples are interpolated.

    Samples without a position count as noise, too. The last known position holds to the end; before the first one positions stay null.
    """
    whole, order = Window.partitionBy("recording"), Window.partitionBy("recording").orderBy("i")
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    df = df.withColumn("label", F.when(known, F.col("label")).otherwise(0))
    place = F.when(F.col("label") != 0, F.struct("i", "x", "y"))
    # one struct for all helpers, so that no column of the input clashes
    near = F.struct(F.avg(F.when(F.col("label") == 0, 1.0).otherwise(0.0)).over(whole).alias("noise"), F.last(place, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("p"), F.first(place, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("q"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), near.alias("near")).where(F.col("near.noise") <= most_noise)
    gap = F.col("near.q.i") - F.col("near.p.i")
    between = lambda c: F.when(F.col("near.q").isNull() | (gap == 0), F.col(f"near.p.{c}")).otherwise(F.col(f"near.p.{c}") + (F.col(f"near.q.{c}") - F.col(f"near.p.{c}")) * (F.col("row.i") - F.col("near.p.i")) / gap)
    return rows.select(*[between(c).alias(c) if c in ("x", "y") else F.col(f"row.`{c}`") for c in df.columns])


def gaze_arff_cleaned(spark: SparkSession, path: str, plane: tuple[float, float] = (475.0, 280.0), most_noise: float = 0.05) -> DataFrame:
    """:func:`gaze_arff` centred on a common plane, samples off the screen without label, noise interpolated, noisy recordings dropped."""
    df = gaze_arff(spark, path)
    off = (F.col("x") <= 0) | (F.col("y") <= 0) | (F.col("x") > F.col("width_mm")) | (F.col("y") > F.col("height_mm"))
    moved = {c: F.when(~off, F.col(c) - F.col(size) / 2 + to / 2) for c, size, to in (("x", "width_mm", plane[0]), ("y", "height_mm", plane[1]))}
    return cleaned(df.withColumns(moved | {"label": F.when(off, 0).otherwise(F.col("label"))}), most_noise)


#: Labels of recordings in degrees: oscillations after saccades are fixations; pursuits, blinks and undefined samples are noise.
DEGREE_LABELS = {3: 1, 4: 0, 5: 0}


def degrees_cleaned(df: DataFrame, screen: tuple[float, float] = (533.0, 301.0), distance: float = 565.0, most_noise: float = 0.10) -> DataFrame:
    """Recordings (recording, i, x, y in degrees, label) on the plane, relabelled and cleaned."""
    new = F.create_map(*[F.lit(v) for pair in DEGREE_LABELS.items() for v in pair])[F.col("label")]
    return cleaned(degrees_to_plane(df, screen[0] / 2, screen[1] / 2, distance).withColumn("label", F.coalesce(new, F.col("label"))), most_noise)


def head_mounted_csv(spark: SparkSession, path: str, width: float, height: float) -> DataFrame:
    """(timestamp_ns, x, y, worn) of a head-mounted export, coordinates as shares of the camera image."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    return raw.select(F.col("timestamp [ns]").cast("long").alias("timestamp_ns"), (F.col("gaze x [px]") / width).alias("x"), (F.col("gaze y [px]") / height).alias("y"), F.col("worn").cast("boolean").alias("worn"))


def degrees_to_plane(df: DataFrame, half_width: float, half_height: float, distance: float = 565.0) -> DataFrame:
    """Visual angles in degrees (x, y) to plane coordinates."""
    return df.withColumns({"x": F.tan(F.radians("x")) * distance + half_width, "y": F.tan(F.radians("y")) * distance + half_height})


def scanpath_records(spark: SparkSession, records: dict[int, list[tuple[float, float, float]]]) -> DataFrame:
    """(recording_id, k, x, y, dur) from in-memory lists."""
    return spark.createDataFrame([(r, k, float(x), float(y), float(d)) for r, v in records.items() for k, (x, y, d) in enumerate(v)], "recording_id long, k long, x double, y double, dur double")


def aoi_records(spark: SparkSession, records: dict[int, list[tuple[str, float]]]) -> DataFrame:
    """(recording_id, k, aoi, dur) from in-memory lists."""
    return spark.createDataFrame([(r, k, a, float(d)) for r, v in records.items() for k, (a, d) in enumerate(v)], "recording_id long, k long, aoi string, dur double")


def write(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    """Sink: Parquet or CSV, partitioned on request."""
    out = df.write.mode("overwrite").format(form)
    (out.option("header", True) if form == "csv" else out).partitionBy(*(by or [])).save(path)
