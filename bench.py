"""Wall-clock of the headline queries; prints one JSON line.

BENCH_SF_DIR (default sf0.1) and BENCH_CPUS choose data and cores; names on the command
line replace the default list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from hoopflow.plans import catalog  # noqa: F401
from hoopflow.plans.registry import QUERIES
from hoopflow.session import local_session

HEADLINE = [
    "geo_zone", "geo_pressure", "geo_plausible", "set_dedup_moments", "win_possession_frames", "who_holds_where",
    "state_build", "join_nearest_defender", "feat_pass", "feat_drive", "act_enumerate", "act_transition",
    "win_pbp_possessions", "join_shot_moment", "flt_offense_agrees", "join_nearest_clock", "join_possession_interval",
    "win_linear_interp", "win_min_hold", "win_rank_actions", "join_why_not", "agg_regret", "agg_domain_gap",
    "join_identity", "win_assign_tracks", "agg_homography_fit", "txt_number_audit", "txt_template",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # One small job first, so that start-up is not charged to the first query.
    QUERIES["str_points"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
        print(f"{n} {times[n]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
