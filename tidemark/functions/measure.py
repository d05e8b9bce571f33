"""Measurement rules: percentiles, comparisons of two engines, stopping rules, run validity."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum


def percentile(values: list[int], q: float) -> int:
    """Nearest rank, at least one microsecond."""
    ordered = sorted(values)
    if not ordered:
        raise ValueError("no samples")
    return max(1, ordered[max(0, math.ceil(len(ordered) * q) - 1)])


def rounded_percentile(values: list[float], p: float) -> float:
    """The other rule in use: the value at the rounded index."""
    ordered = sorted(values)
    return ordered[int(math.floor((len(ordered) - 1) * p + 0.5))]


class Verdict(Enum):
    WIN, LOSS, TIE, CONFLICT = "win", "loss", "tie", "conflict"


def cell(ours: tuple[int, int], theirs: tuple[int, int]) -> Verdict:
    """By (p95, p99): a win is 5 % lower at p95 and no higher at p99; a tie is equal, or apart by less than
    5 % of the smaller, at both. Nothing is lower than a baseline of zero."""
    (a95, a99), (b95, b99) = ours, theirs
    lower = lambda x, base: base != 0 and x * 100 <= base * 95
    if lower(a95, b95) and a99 <= b99:
        return Verdict.WIN
    if lower(b95, a95) and b99 <= a99:
        return Verdict.LOSS
    near = lambda x, y: x == y or abs(x - y) * 100 < 5 * min(x, y)
    return Verdict.TIE if near(a95, b95) and near(a99, b99) else Verdict.CONFLICT


def scorecard(cells: dict[str, Verdict], p95_ratio: float, churn_ratio: float, queries: tuple[str, ...] = ("q1", "q2", "q3", "q4", "q5")) -> bool:
    """Four wins, no loss, p95 at most 0.9 and churn at most 0.8 of the other's, over exactly these queries."""
    got = list(cells.values())
    return set(cells) == set(queries) and got.count(Verdict.WIN) >= 4 and Verdict.LOSS not in got and p95_ratio <= 0.9 and churn_ratio <= 0.8


def two_rates(results: dict[int, bool], base: int = 1000) -> bool:
    """Both the base rate and the highest rate the engines share must hold."""
    return bool(results) and results.get(base, False) and results[max(results)]


@dataclass(frozen=True)
class Interval:
    """One minute of a rate search."""

    achieved: float
    target: float
    freshness_p99_ms: float
    backlog_bytes: int
    correct: bool = True
    resources_ok: bool = True


def stop_reason(intervals: list[Interval], backlog_limit: int = 10 << 30, freshness_limit_ms: float = 1000) -> str | None:
    """Why a rate search ends: lastingly short of the target, stale, a growing backlog, wrong, or out of resources."""
    if not intervals:
        return None
    last, three = intervals[-1], intervals[-3:]
    if not last.correct:
        return "correctness"
    if not last.resources_ok:
        return "resources"
    if last.freshness_p99_ms > freshness_limit_ms:
        return "freshness"
    if len(three) == 3:
        if all(i.achieved < 0.95 * i.target for i in three):
            return "rate"
        sizes = [i.backlog_bytes for i in three]
        if sizes[0] > backlog_limit and sizes[0] < sizes[1] < sizes[2]:
            return "backlog"
    return None


def stage_done(samples: dict[str, int], elapsed_s: float, planned_s: float, least: int = 30) -> bool | None:
    """True when every query has its samples and the time is up; None when twice the time is up without them."""
    enough = bool(samples) and min(samples.values()) >= least
    if elapsed_s >= planned_s and enough:
        return True
    return None if elapsed_s >= 2 * planned_s else False


#: In their order; after a run is found invalid only those in AFTER_INVALID still run.
STAGES = tuple(
    "preflight seed baseline_snapshot bootstrap initial_checkpoint warmup quiet cdc_300 cdc_1000 rate_search"
    " failure_sequence final_checkpoint report checksums complete".split()
)
AFTER_INVALID = ("report", "checksums")


def scaled_capacity(measured: int, margin_percent: int = 135) -> int:
    return -(-measured * margin_percent // 100)


class Invalid(Enum):
    """Why a run does not count."""

    DATASET = "the dataset's hash differs"
    WORKLOAD = "the workload's hash differs"
    MISSING = "a sequence number is missing"
    REPEATED = "a sequence number is repeated"
    REORDERED = "an order that changes the state"
    STALE = "a result from before its target position"
    DIGEST = "a result's digest differs"
    FRESHNESS = "freshness p99 above its limit"
    RATE = "the source's rate was missed"
    RESOURCE = "a resource limit"
    EXIT = "a process ended"
    ARTIFACT = "a missing artifact"


def freshness_at(commits: list[tuple[int, int]], position: int, now_ms: int) -> int | None:
    """Age of the newest commit at or below a position; commits are (lsn, ms) in order."""
    from bisect import bisect_right

    k = bisect_right([c[0] for c in commits], position)
    return None if not k else now_ms - commits[k - 1][1]
