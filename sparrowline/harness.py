"""Timings: a warm-up, repeats, medians, and results that outlive a run."""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Timings:
    """Median seconds by name. With a `path` each result is written as it
    comes, and what an earlier run wrote is not measured again."""

    path: str | None = None
    seconds: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.path and os.path.exists(self.path):
            with open(self.path, encoding="utf-8") as f:
                self.seconds |= json.load(f)

    def measure(self, name: str, run: Callable[[], object], *, repeats: int = 3, warm_up: int = 1, enough: float = float("inf"), clock: Callable[[], float] = time.perf_counter) -> float:
        """The median of up to `repeats` runs; none begins once timed runs
        have taken `enough` seconds."""
        if name not in self.seconds:
            for _ in range(warm_up):
                run()
            took: list[float] = []
            while len(took) < repeats and (not took or sum(took) < enough):
                began = clock()
                run()
                took.append(clock() - began)
            self.seconds[name] = round(statistics.median(took), 3)
            if self.path:
                passing = f"{self.path}.next"
                with open(passing, "w", encoding="utf-8") as f:
                    json.dump(self.seconds, f, sort_keys=True)
                os.replace(passing, self.path)
        return self.seconds[name]

    def ratio(self, name: str, to: str) -> float:
        """How many times as fast `name` is."""
        return round(self.seconds[to] / self.seconds[name], 2)
