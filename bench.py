"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from urbanloom.plans import registry
from urbanloom.session import build_session

HEADLINE = (
    "mean_commute_minutes", "locations_balanced", "area_interpolation_extensive", "area_interpolation_hexagons", "shock_hats", "od_direct_minutes", "od_summary", "knn_stations", "knn_walk_edges",
    "shortest_paths_walking", "standalone_routing", "direct_station_access", "sinkhorn_2_passes", "spillover_density", "equilibrium_one_step", "travel_time_measures", "map_classes",
    "inversion_full", "closed_city", "open_city", "no_spillovers",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    registry.QUERIES[registry.FLAGSHIP](spark, "/root/testdata/sf0.001").collect()  # starts the JVM's workers
    times = {}
    for name in HEADLINE:
        begun = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
