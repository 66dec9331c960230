"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run to the end into a no-op sink; one untimed query warms the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "agg_block_mean_area",
    "agg_zone_mean_area",
    "agg_anomaly",
    "win_cumulative_flux",
    "agg_trend_compact",
    "agg_harmonics",
    "agg_alpha_disagreement",
    "agg_gradient_disagreement",
    "agg_beta_median",
    "cons_project_block",
    "cons_project_zone",
    "cons_decompose_supported",
    "met_temporal",
    "met_internal_monthly",
    "met_region",
    "met_spearman",
    "regrid_bilinear",
    "zonal_point_in_polygon",
    "fil_gaussian_highpass",
    "spc_radial_power",
    "obj_total",
    "st_grid_median",
    "pr_contrast_metrics",
    "bs_cluster",
)


def main() -> None:
    from isopleth import plans, session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    known = plans.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("time_month_start")
    seconds = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
