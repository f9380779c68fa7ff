"""Vector, terrain and building scans that hold a source to what it declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import datum, geo


def declared(sources: DataFrame) -> Column:
    """Why a vector source must not be read, or null.

    sources: path, layer, layers (those it has), crs (as declared), src_crs (as found),
    encoding, cad_layers. A drawing needs the names of its layers to take.
    """
    c = F.col
    drawing = F.lower("path").endswith(".dxf")
    none = F.coalesce(F.size("cad_layers"), F.lit(0)) <= 0
    return (
        F.when(c("crs").isNull() | (F.trim("crs") == ""), "no CRS declared")
        .when(c("src_crs").isNotNull() & (c("src_crs") != c("crs")), "the CRS differs from the declared one")
        .when(~drawing & F.lower("path").endswith(".shp") & c("encoding").isNull(), "no encoding declared")
        .when(drawing & none, "a drawing needs cad_layers")
        .when(c("layer").isNotNull() & ~F.array_contains("layers", c("layer")), "no such layer")
    )


def sidecars(files: DataFrame) -> DataFrame:
    """stem, files, bytes, sha256 of each source with its sidecars, in order of their names.

    files: path, length, sha256 (as contexts.fingerprints gives them).
    """
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(F.col("path"), r"\.[^./]*$", "")
    each = files.select(stem.alias("stem"), name.alias("name"), "length", "sha256")
    parts = F.array_sort(F.collect_list(F.struct("name", "sha256")))
    return each.groupBy("stem").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["name"], p["sha256"])), "\n"), 256).alias("sha256"))


# -- row groups ------------------------------------------------------------------------


def row_groups(spark: SparkSession, path: str) -> list[dict]:
    """file, index, rows and the statistics {column: (low, high) or None} of every row group.

    Footers are read by the driver through the session's own file system.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    listing, files = fs.listFiles(root, True), []
    while listing.hasNext():
        f = listing.next().getPath()
        if not f.getName().startswith(("_", ".")):
            files.append(f)
    out = []
    for f in sorted(files, key=str):
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(f, conf))
        try:
            for index, block in enumerate(reader.getRowGroups()):
                known = {}
                for column in block.getColumns():
                    s = column.getStatistics()
                    whole = s is not None and s.hasNonNullValue() and s.isNumNullsSet() and s.getNumNulls() == 0
                    known[column.getPath().toDotString()] = (s.genericGetMin(), s.genericGetMax()) if whole else None
                out.append({"file": f.toString(), "index": index, "rows": block.getRowCount(), "statistics": known})
        finally:
            reader.close()
    return out


def pruned(spark: SparkSession, path: str, box: dict[str, tuple[float, float]]) -> tuple[DataFrame, int, int]:
    """Rows whose columns lie in the ranges of box, the row groups met and their number.

    A row group may be left out only if its statistics account for every row, so missing
    or partial statistics of a column of box are an error, never an empty answer.
    """
    groups = row_groups(spark, path)
    met = 0
    for g in groups:
        stats = {c: g["statistics"].get(c) for c in box}
        lost = sorted(c for c, s in stats.items() if s is None)
        if lost and g["rows"]:
            raise ValueError(f"row group {g['index']} of {g['file']} lacks whole statistics of {', '.join(lost)}")
        met += all(low <= stats[c][1] and stats[c][0] <= high for c, (low, high) in box.items()) if g["rows"] else 0
    rows = spark.read.parquet(path)
    for c, (low, high) in box.items():
        rows = rows.filter(F.col(c).between(low, high))
    return rows, met, len(groups)


# -- buildings -------------------------------------------------------------------------


def ring_bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    """xmin, ymin, xmax, ymax of a ring ARRAY<STRUCT<x,y>>."""
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)


def footprint_problem(tolerance: float = 1e-9) -> Column:
    """Why a building row (ring, bbox) breaks its source's contract, or null: not a closed
    flat polygon, implausible coordinates, or a box that is not the ring's."""
    west, south, east, north = ring_bounds(F.col("ring"))
    size = F.coalesce(F.size("ring"), F.lit(0))
    shut = F.get("ring", F.lit(0)) == F.get("ring", size - 1)
    plausible = (west > 120) & (west < east) & (east < 135) & (south > 25) & (south < north) & (north < 45)
    close = lambda a, b: F.abs(a - F.col(f"bbox.{b}")) <= tolerance
    agrees = close(west, "xmin") & close(south, "ymin") & close(east, "xmax") & close(north, "ymax")
    return F.when((size < 4) | ~shut, "not a polygon").when(~plausible, "coordinates").when(~F.coalesce(agrees, F.lit(False)), "box")


def footprints(rows: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """source_id, height_m, height_var, unresolved, estimated, plane (the projected ring) of
    buildings whose box meets box; a row that breaks the contract is an error.

    rows: source_id, ring, bbox, height, var.
    """
    west, south, east, north = box
    c = F.col
    near = rows.filter((c("bbox.xmin") <= east) & (c("bbox.ymin") <= north) & (c("bbox.xmax") >= west) & (c("bbox.ymax") >= south))
    problem = footprint_problem()
    sound = near.withColumn("ring", F.when(problem.isNull(), c("ring")).otherwise(F.raise_error(F.concat(F.lit("building "), "source_id", F.lit(": "), problem)).cast(rows.schema["ring"].dataType)))
    height = geo.finite(c("height"))
    height = F.when(height > 0, height)

    def plane(p: Column) -> Column:
        x, y = geo.to_plane(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return sound.select("source_id", height.alias("height_m"), geo.finite(c("var")).alias("height_var"), height.isNull().alias("unresolved"), F.lit(1).alias("estimated"), F.transform("ring", plane).alias("plane"))


# -- terrain ---------------------------------------------------------------------------


def terrain(rows: DataFrame, crs: str, field: str, count: int, source_crs: str = "EPSG:5174") -> DataFrame:
    """source_id, elevation_m, x, y of a terrain layer on the newer grid.

    rows: UFID, the elevation field, x, y. The declared CRS, the fields and the pinned
    number of rows must hold, and no row may lack its id or a finite elevation; else an
    error, and nothing is filled in.
    """
    if crs != source_crs:
        raise ValueError(f"the terrain source must declare {source_crs}")
    if not {"UFID", field, "x", "y"} <= set(rows.columns):
        raise ValueError("the elevation schema has changed")
    found = rows.count()
    if found != count:
        raise ValueError(f"{found} features where {count} are pinned")
    z = geo.finite(F.col(field))
    bad = F.col("UFID").isNull() | z.isNull() | F.col("x").isNull() | F.col("y").isNull()
    z = F.when(~bad, z).otherwise(F.raise_error(F.lit("a terrain row lacks its id, place or elevation")).cast("double"))
    out = rows.select(F.col("UFID").cast("string").alias("source_id"), z.alias("elevation_m"), datum.regridded(F.col("x"), F.col("y")).alias("place"))
    return out.select("source_id", "elevation_m", "place.x", "place.y")


def terrain_report(rows: DataFrame) -> DataFrame:
    """features, duplicate ids, elevation range and bounds of a terrain layer."""
    return rows.agg(
        F.count(F.lit(1)).alias("features"), (F.count(F.lit(1)) - F.count_distinct("source_id")).alias("duplicate_ids"),
        F.min("elevation_m").alias("low"), F.max("elevation_m").alias("high"), F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"),
    )
