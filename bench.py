"""Headline queries, timed; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``.
Each query is materialised in full through the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from landloom.catalogue import QUERIES  # noqa: E402
from landloom.session import local_session  # noqa: E402

HEADLINE = (
    "wgs84_to_utm",
    "features_to_covered_tiles",
    "manifest_rollup",
    "tile_query_features",
    "main_road_adjacency",
    "polygons_in_water",
    "polygons_in_world_box",
    "land_use_report_per_tile",
    "landcover_votes",
    "slope_and_aspect",
    "connected_zones",
    "elevation_nearest",
    "road_crossings",
    "sample_points_lattice",
)
# Timed after the headline, not part of its total.
FURTHER = (
    "all_tiles_build",
    "sample_points_jittered",
    "polygons_cut_by_roads",
    "road_graph_split",
    "terrain_zones",
    "zone_outline_corners",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "landloom-bench", "16g")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/part.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE + FURTHER:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times[n] for n in HEADLINE), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
