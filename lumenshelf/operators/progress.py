"""Steps of a job that count what they write while they write it, and rules on these counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
#: Part of the expected rows that a step must write.
LEAST_RATIO = 0.9
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Report:
    """What a step wrote, its counters, and why it failed, if it did."""

    name: str
    written: int
    expected: int | None
    counters: dict[str, int] = field(default_factory=dict)
    failure: str | None = None

    @property
    def ok(self) -> bool:
        return self.failure is None


@dataclass(frozen=True)
class Step:
    """rows and how to write them. `expected` rows are pending; without `exact` only zero progress is judged. A `required` step that fails ends the run."""

    name: str
    rows: Callable[[], DataFrame]
    write: Callable[[DataFrame], None]
    expected: int | None = None
    exact: bool = True
    required: bool = True
    counters: dict[str, Column] = field(default_factory=dict)


def verdict(written: int, expected: int | None, exact: bool = True) -> str | None:
    """Why a step failed: it wrote nothing though rows were pending, or less than 90 % of them; None where it did not."""
    if expected is None or expected <= 0:
        return None
    if written == 0:
        return f"no progress: 0 of {expected} rows"
    if exact and written < LEAST_RATIO * expected:
        return f"low progress: {written} of {expected} rows"
    return None


def counted_write(rows: DataFrame, write: Callable[[DataFrame], None], counters: dict[str, Column] | None = None) -> dict[str, int]:
    """Write rows and return the counters, and `written`, gathered in the same pass.

    A counter is the number of rows where its condition holds. `write` must
    run one action over the whole of what it is given.
    """
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("written"), *(F.count_if(c).alias(n) for n, c in (counters or {}).items())]
    write(rows.observe(seen, *metrics))
    return {n: int(v or 0) for n, v in seen.get.items()}


def run_steps(steps: Iterable[Step]) -> list[Report]:
    """Reports of the steps in order; none runs after a required one that failed.

    A step that raises fails with the error's text, and the run goes on as
    after any failure.
    """
    reports = []
    for step in steps:
        try:
            counts = counted_write(step.rows(), step.write, step.counters)
            written = counts.pop("written")
            report = Report(step.name, written, step.expected, counts, verdict(written, step.expected, step.exact))
        except Exception as e:  # noqa: BLE001 - any failure of a step is its report
            report = Report(step.name, 0, step.expected, {}, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
        reports.append(report)
        if not report.ok and step.required:
            break
    return reports
