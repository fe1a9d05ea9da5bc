"""Pluggable data providers.

A provider returns DataFrames; features are required, elevation and land cover
optional (``None``).
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.operators import elevation, tiling
from landloom.operators import filters as Fl
from landloom.schema import RECT_FIELDS
from landloom.sources import arcgis, dem, geojson, landcover, manifest


class Provider(Protocol):
    name: str

    def available(self) -> bool: ...

    def features(self, bounds=None) -> DataFrame: ...

    def dem(self) -> tuple[DataFrame, DataFrame] | None: ...

    def elevation(self, bounds, resolution_m: float) -> DataFrame | None: ...

    def landcover(self, bounds=None) -> tuple[DataFrame, DataFrame] | None: ...


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


class LocalFiles:
    """GeoJSON files plus, optionally, an elevation file or folder."""

    name = "LocalFile"

    def __init__(self, spark: SparkSession, geojson_path: str, dem_path: str | None = None, dem_size=(0, 0), dem_bounds=None, lines: bool = False):
        """``lines`` reads newline-delimited features, the splittable form."""
        self.spark, self.geojson_path, self.dem_path, self.lines = spark, geojson_path, dem_path, lines
        self.dem_size, self.dem_bounds = dem_size, dem_bounds

    def available(self) -> bool:
        return bool(self.geojson_path) and _exists(self.spark, self.geojson_path)

    def features(self, bounds=None) -> DataFrame:
        read = geojson.read_geojson_lines if self.lines else geojson.read_geojson
        return Fl.any_vertex_in_bounds(read(self.spark, self.geojson_path), bounds)

    def dem(self):
        if not self.dem_path:
            return None
        return dem.read_dem(self.spark, self.dem_path, *self.dem_size, self.dem_bounds)

    def elevation(self, bounds, resolution_m: float = 30.0):
        data = self.dem()
        return None if data is None else elevation.elevation_grid(self.spark, *data, bounds, resolution_m)

    def landcover(self, bounds=None):
        return None


class ArcGIS:
    """Layers of a feature service; the envelope is applied by the server."""

    name = "ArcGIS"

    def __init__(self, spark: SparkSession, url: str, extra_layers: list[str] | None = None, **options):
        self.spark, self.url, self.extra, self.options = spark, url, extra_layers, options

    def available(self) -> bool:
        return bool(self.url)

    def features(self, bounds=None) -> DataFrame:
        options = dict(self.options)
        if bounds:
            options["bounds"] = tuple(bounds)
        return arcgis.read_arcgis(self.spark, self.url, self.extra, **options)

    def dem(self):
        return None

    def elevation(self, bounds, resolution_m: float = 30.0):
        return None

    def landcover(self, bounds=None):
        return None


class TiledFiles:
    """A tiling output: manifest, per-tile features and land cover."""

    name = "TiledFile"

    def __init__(
        self,
        spark: SparkSession,
        manifest_path: str,
        dem_path: str | None = None,
        parity_no_dem: bool = True,
        id_keys: tuple[str, ...] = ("feature_id",),
    ):
        self.spark, self.manifest_path, self.dem_path, self.parity_no_dem = spark, manifest_path, dem_path, parity_no_dem
        self.base, self.id_keys = manifest_path.rsplit("/", 1)[0], id_keys
        self._parsed = None

    def _load(self):
        if self._parsed is None:
            self._parsed = manifest.read_tile_manifest(self.spark, self.manifest_path)
        return self._parsed

    def available(self) -> bool:
        return bool(self.manifest_path) and _exists(self.spark, self.manifest_path)

    def grid(self) -> tiling.Grid:
        row = self._load()[0].first()
        return tiling.Grid(row["tile_size_m"], row["origin_lon"], row["origin_lat"])

    def tiles(self) -> DataFrame:
        return self._load()[1]

    def _wanted(self, bounds) -> DataFrame:
        return self.tiles() if bounds is None else Fl.tiles_in_bounds(self.tiles(), bounds)

    def _listed(self, tiles: DataFrame, kind: str) -> list[str]:
        """Declared paths of the wanted tiles, under the manifest's folder.

        One short string per tile of a bounded query; Spark's reader takes its
        file list from the driver, too.
        """
        rows = tiles.where(F.col(kind) != "").select(kind).distinct().toLocalIterator()
        return [f"{self.base}/{r[0]}" for r in rows]

    def _documents(self, tiles: DataFrame, kind: str, pattern: str, bounded: bool = False) -> DataFrame:
        """Stored documents of the wanted tiles: ``tile_col, tile_row, source, value``.

        With ``bounded`` only the wanted paths are listed and read, so a query
        of three tiles opens three tiles' files however many are stored; else the
        whole folder is read. Documents and tiles meet in a join on the declared
        path (a file or its folder). A declared path without a file is an error,
        not an empty tile.
        """
        named = tiles.where(F.col(kind) != "").select("tile_col", "tile_row", F.col(kind).alias("_path"))
        if bounded:
            root = self._listed(tiles, kind)
            lost = [p.removeprefix(f"{self.base}/") for p in root if not _exists(self.spark, p)]
            if lost:
                raise FileNotFoundError(f"the manifest names {kind} files that are not stored: {lost[:3]}")
        else:
            top = named.select(F.regexp_extract("_path", r"^([^/]+)/", 1).alias("t")).distinct().limit(2).collect()
            root = self.base if len(top) != 1 or not top[0]["t"] else f"{self.base}/{top[0]['t']}"
        reader = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        docs = reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
        base = self.base.removeprefix("file:").lstrip("/")
        relative = F.substring(F.regexp_replace("source", r"^file:/*", ""), len(base) + 2, 1 << 20)
        # Partition folders escape odd characters in the path text only.
        docs = docs.withColumn("_file", relative).withColumn("_folder", F.regexp_extract("_file", r"^(.*)/[^/]+$", 1))
        by_file = docs.select("source", "value", F.explode(F.array("_file", "_folder")).alias("_path"))
        found = named.join(by_file, "_path", "left")
        gone = found.where("source IS NULL").select("_path").limit(3).collect()
        if gone:
            raise FileNotFoundError(f"the manifest names {kind} files that are not stored: {[r[0] for r in gone]}")
        return found.drop("_path")

    def _stored(self, listed: DataFrame, kind: str, folder: str, bounded: bool = False) -> DataFrame:
        """Rows of the listed tiles in a stored table; a declared tile without rows is an error.

        The table has a folder per tile or per column of tiles; with ``bounded``
        the rows outside the extent of the listed tiles are not read.
        """
        stored = self.spark.read.parquet(f"{self.base}/{folder}")
        keys = ["tile_col", "tile_row"]
        if bounded:
            box = listed.agg(*[f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)]).first()
            for k in keys:
                stored = stored.where(F.col(k).between(box[f"min_{k}"], box[f"max_{k}"]))
        gone = listed.join(stored.select(*keys).distinct(), keys, "left_anti")
        lost = [r[0] for r in gone.select(kind).limit(3).collect()]
        if lost:
            raise FileNotFoundError(f"the manifest names tiles that are not stored: {lost}")
        return stored.join(listed.select(*keys), keys, "left_semi")

    def copies(self, bounds=None) -> DataFrame:
        """Feature copies per tile, with the id stored by the tiling run.

        Outputs of ``preprocess`` keep all tiles in one table partitioned by
        tile, read by a pruned join; other data sets keep a GeoJSON file per tile.
        """
        tiles = self._wanted(bounds)
        listed = tiles.where("geojson <> ''")
        if listed.where("geojson LIKE 'features/tile_col=%'").isEmpty():
            docs = self._documents(tiles, "geojson", "*json", bounds is not None)
            rows = geojson.parse_features(geojson.explode_collections(docs).drop("pos"))
            ids = geojson.source_feature_id(F.col("props"), self.id_keys)
            rows = rows.withColumn("feature_id", ids)
        else:
            rows = self._stored(listed, "geojson", "features", bounds is not None).drop("clipped", *RECT_FIELDS)
        return rows.join(tiles.select("tile_col", "tile_row", "tile_ord"), ["tile_col", "tile_row"])

    def features(self, bounds=None) -> DataFrame:
        """Features of the tiles that touch the bounds (None: all), first copy per id."""
        once = tiling.first_copies(self.copies(bounds))
        return once if bounds is None else Fl.centroid_in_bounds(once, *bounds)

    def dem(self):
        if self.parity_no_dem or not self.dem_path:
            return None
        return dem.read_dem(self.spark, self.dem_path)

    def elevation(self, bounds, resolution_m: float = 30.0):
        data = self.dem()
        return None if data is None else elevation.elevation_grid(self.spark, *data, bounds, resolution_m)

    def landcover(self, bounds=None, single_tile_only: bool = False):
        """``(grids, pixels)`` of the tiles that touch the bounds, or None.

        ``single_tile_only`` answers only when exactly one tile matches.
        """
        tiles = self._wanted(bounds)
        if single_tile_only and tiles.limit(2).count() != 1:
            return None
        if tiles.where("landcover <> ''").isEmpty():
            return None
        listed = tiles.where("landcover <> ''")
        if listed.where("landcover LIKE 'landcover/tile_col=%'").isEmpty():
            docs = self._documents(tiles, "landcover", "*", bounds is not None)
        else:
            docs = self._stored(listed, "landcover", "landcover", bounds is not None)
        grids, pixels = landcover.parse_landcover(docs)
        return landcover.with_tile_bounds(grids, tiles), pixels
