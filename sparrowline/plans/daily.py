"""A day's run from landed files to tested marts, in one call."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, dims, facts, quality, report
from ..sources import raw as R
from . import domain as D
from .project import Project


@dataclass
class Run:
    """What the steps of a run gave, in order, and how long each took."""

    day: str
    results: dict[str, Any] = field(default_factory=dict)
    steps: list[dict[str, Any]] = field(default_factory=list)

    def to_json(self) -> str:
        return report.to_json({"day": self.day, "steps": self.steps})

    def to_markdown(self) -> str:
        return report.to_markdown(self.steps, ["step", "tries", "seconds", "outcome"])


def attempt(run: Run, name: str, step: Callable[[], Any], *, tries: int, pause: float, sleep: Callable[[float], None], send: Callable[[str], None] | None) -> Any:
    """Run a step, again after a growing pause if it fails. The last failure
    is recorded, alerted and raised."""
    began = time.monotonic()
    for k in range(1, tries + 1):
        try:
            out = run.results[name] = step()
        except Exception as e:
            if k < tries:
                sleep(pause * 2 ** (k - 1))
                continue
            run.steps.append({"step": name, "tries": k, "seconds": time.monotonic() - began, "outcome": f"failed: {type(e).__name__}"})
            report.alert(f"{name} of {run.day} failed", {"tries": k, "error": e}, send)
            raise
        run.steps.append({"step": name, "tries": k, "seconds": time.monotonic() - began, "outcome": "ok"})
        return out
    return None


def star(spark: SparkSession, folder: str, clean: str, changes: str, first: str, end: str) -> Project:
    """The star schema over cleaned days as models: staging as views, the
    rest as tables."""
    p = Project(spark, folder)
    p.source("clean_impressions", lambda: spark.read.parquet(clean))
    p.source("campaign_changes", lambda: spark.read.parquet(changes))
    p.model("stg_impressions", "clean_impressions")(lambda ref: facts.stage_impressions(ref("clean_impressions")))
    kept = lambda ref: dims.keep_last(ref("campaign_changes").where("campaign_id is not null and changed_at is not null"), ["campaign_id", "changed_at"], F.desc(F.xxhash64("budget_tier", "bid_strategy", "daily_budget_usd")))
    p.model("stg_changes", "campaign_changes")(kept)
    p.model("dim_campaign", "stg_changes", kind="table")(lambda ref: dims.scd2(ref("stg_changes"), key="campaign_id", at="changed_at", attributes=D.ATTRIBUTES, sk="campaign_sk", unknown=D.UNKNOWN))
    p.model("dim_device", "stg_impressions", kind="table")(lambda ref: dims.dim_segment(ref("stg_impressions")))
    p.model("dim_date", kind="table")(lambda ref: dims.dim_date(spark, first, end))
    p.model("fct_impressions", "stg_impressions", "dim_campaign", "dim_device", kind="table", cluster=("date_key", "campaign_id"))(lambda ref: facts.fct_impressions(ref("stg_impressions"), ref("dim_campaign"), ref("dim_device")))
    p.model("fct_clicks", "fct_impressions", kind="table", cluster=("date_key",))(lambda ref: facts.fct_clicks(ref("fct_impressions")))
    p.model("fct_conversions", "fct_impressions", kind="table")(lambda ref: facts.fct_conversions(ref("fct_impressions")))
    p.model("mart_campaign_daily", "fct_impressions", "fct_conversions", "dim_date", "dim_campaign", kind="table", cluster=("date_key", "campaign_id"))(
        lambda ref: facts.mart_campaign_daily(ref("fct_impressions"), ref("fct_conversions"), ref("dim_date"), ref("dim_campaign"))
    )
    return p


def checks(built: dict[str, Any]) -> list[quality.Check]:
    fct, dim, mart = built["fct_impressions"], built["dim_campaign"], built["mart_campaign_daily"]
    return [
        quality.Check("fct_unique", quality.unique(fct, "impression_id")),
        quality.Check("fct_campaign_known", quality.relationship(fct, "campaign_sk", dim, "campaign_sk")),
        quality.Check("dim_versions_tile", quality.scd2_integrity(dim, "campaign_id")),
        quality.Check("mart_unique", quality.unique(mart, "campaign_day_id")),
        quality.Check("mart_reconciles", quality.mart_reconciles(mart, fct)),
        quality.Check("unknown_members", quality.unknown_members(fct), "warn"),
    ]


def run_day(
    spark: SparkSession, raw_root: str, out: str, day: str, *, anchor_epoch: int, first: str, end: str, tries: int = 3, pause: float = 30, timeout: float = 6 * 3600, send: Callable[[str], None] | None = None, sleep: Callable[[float], None] = time.sleep
) -> Run:
    """Wait for the day's files, clean them, reload the change log, judge how
    fresh the clean table is, build the star, and test it; a check of severity
    `error` that doesn't hold fails the run. Every step replaces what it
    writes, so a run can be repeated."""
    run = Run(day)
    step = lambda name, f: attempt(run, name, f, tries=tries, pause=pause, sleep=sleep, send=send)
    attempt(run, "wait", lambda: R.wait_until_ready(spark, raw_root, day, timeout=timeout, sleep=sleep), tries=1, pause=0, sleep=sleep, send=send)
    log = R.read_changes(spark, f"{raw_root}/campaign_changes")
    step("clean", lambda: cleaning.clean_days(spark, raw_root, f"{out}/clean", day=day, anchor_epoch=anchor_epoch, known=R.reference_set(log)))
    step("changes", lambda: log.write.mode("overwrite").parquet(f"{out}/changes"))
    day_end = F.date_add(F.lit(day).cast("date"), 1).cast("timestamp")
    step("freshness", lambda: quality.freshness(spark.read.parquet(f"{out}/clean/impressions"), "event_ts", day_end, 26 * 3600, 50 * 3600).first().status)
    built = step("build", star(spark, f"{out}/models", f"{out}/clean/impressions", f"{out}/changes", first, end).build)

    def test() -> dict[str, tuple[str, int]]:
        found = quality.run_checks(checks(built), f"{out}/failures")
        if bad := sorted(n for n, (outcome, _) in found.items() if outcome == "error"):
            raise AssertionError("checks failed: " + ", ".join(bad))
        return found

    attempt(run, "test", test, tries=1, pause=0, sleep=sleep, send=send)
    return run
