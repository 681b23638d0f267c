"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from obsweave.operators import assess as A  # noqa: E402
from obsweave.operators import areas as R  # noqa: E402
from obsweave.operators import block as B  # noqa: E402
from obsweave.operators import fuse as FU  # noqa: E402
from obsweave.operators import score as S  # noqa: E402
from obsweave.plans import fixture as X  # noqa: E402
from obsweave.plans import fixture_areas as Y  # noqa: E402
from obsweave.plans.q_core import fixture_verdicts  # noqa: E402
from obsweave.session import build_session, cut  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "obsweave-bench", **{
        "spark.sql.shuffle.partitions": cpus if cpus != "*" else "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    run = lambda df: df.write.format("noop").mode("overwrite").save()
    # session start-up and class loading are not part of the figures
    run(X.table(spark, sf, "region"))
    obs = timed("normalize", lambda: cut(X.observations(spark, sf)))
    grouped = timed("block", lambda: cut(B.block(obs)))
    feats = timed("features", lambda: cut(S.prepare(grouped)))
    scored = timed("score_pairs", lambda: cut(S.scored_pairs(feats).where("band <> 'different'")))
    verdicts = cut(fixture_verdicts(scored, feats))
    dec = timed("adjudicate", lambda: cut(FU.adjudicate(FU.gray_pairs(scored), verdicts)))
    edges = (scored.where("band = 'same'").select(F.col("obs_a").alias("a"), F.col("obs_b").alias("b")).unionByName(FU.colocated_edges(feats))
             .unionByName(dec.where("same").select(F.col("obs_a").alias("a"), F.col("obs_b").alias("b"))))
    slim = feats.select("obs_id", "source_id", "obs_type", "cell_id", "occurred_start", "occurred_end", "geom_precision_m")
    members = timed("propagate", lambda: cut(FU.propagate(slim, edges, FU.flagged_obs(dec))[0]))
    events = timed("events", lambda: cut(FU.build_events(members)))
    timed("digest", lambda: FU.digest(events).collect())
    timed("assess", lambda: run(A.assess(events, X.NOW)))
    ctx = timed("cell_context", lambda: cut(Y.build_context(spark, sf)))
    timed("rollup", lambda: run(R.rollup(Y.units(spark, sf), ctx, events, 3)))
    timed("area_attention", lambda: run(R.area_attention(R.area_cells(ctx), events, A.cell_anomalies(events, X.NOW), X.NOW)))
    print(json.dumps({"metric": "event_fusion_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name,
                      "rows": {"observations": obs.count(), "pairs_kept": scored.count(), "events": events.count()}}))
    spark.stop()


if __name__ == "__main__":
    main()
