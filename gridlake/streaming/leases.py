"""Jobs under leases as one stateful stream with timers.

A job waits to be claimed (pending), runs under a lease that its holder's token renews (running), waits after a failed attempt
(waiting), and ends (succeeded, failed).  A lease that is not renewed in time counts as a failed attempt.  After the last
attempt, and after success, nothing more is heard of a job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass
from itertools import starmap

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .state import bucketed, in_order

#: Seconds of a lease, of the wait after a failed attempt, and after which an ended job is forgotten; attempts.
LEASE, DELAY, FORGET, ATTEMPTS = 180, 5, 86_400, 3
OUTPUT = "key long, ts timestamp, state string, reason string, attempts int"
_STATE = "keys array<long>, status array<string>, token array<string>, deadline array<long>, attempts array<int>, seen array<long>"
ENDED = ("succeeded", "failed")


@dataclass
class _Job:
    """What is kept of a job; times are microseconds."""

    status: str | None = None
    token: str | None = None
    deadline: int | None = None
    attempts: int = 0
    seen: int | None = None


@dataclass(frozen=True)
class Rules:
    lease: int = LEASE
    delay: int = DELAY
    attempts: int = ATTEMPTS
    forget: int = FORGET

    def failed(self, job: _Job, at: int, reason: str) -> tuple[int, str, str, int]:
        job.attempts, job.token = job.attempts + 1, None
        if job.attempts < self.attempts:
            job.status, job.deadline = "waiting", at + self.delay * 1_000_000
        else:
            job.status, job.deadline = "failed", at + self.forget * 1_000_000
        return at, job.status, reason, job.attempts

    def due(self, job: _Job, now: int) -> Iterator[tuple[int, str, str, int]]:
        """What the passing of time does up to now."""
        while job.deadline is not None and job.deadline <= now and job.status not in ENDED:
            at = job.deadline
            if job.status == "running":
                yield self.failed(job, at, "stale")
            else:
                job.status, job.deadline = "pending", None
                yield at, "pending", "delay_over", job.attempts

    def heard(self, job: _Job, at: int, kind: str, token: str | None) -> Iterator[tuple[int, str, str, int]]:
        """What an event does; an event out of order, or for an ended job, does nothing."""
        if job.seen is not None and at < job.seen:
            return
        yield from self.due(job, at)
        job.seen = at
        if job.status in ENDED:
            return
        if kind == "enqueue":
            if job.status is None:
                job.status = "pending"
                yield at, "pending", "enqueued", job.attempts
        elif kind == "claim" and job.status == "pending":
            job.status, job.token, job.deadline = "running", token, at + self.lease * 1_000_000
            yield at, "running", "claimed", job.attempts
        elif kind == "claim":
            yield at, job.status or "unknown", "refused_claim", job.attempts
        elif job.status != "running" or token is None or token != job.token:
            yield at, job.status or "unknown", f"refused_{kind}", job.attempts
        elif kind == "heartbeat":
            job.deadline = at + self.lease * 1_000_000
        elif kind == "succeed":
            job.status, job.token, job.deadline = "succeeded", None, at + self.forget * 1_000_000
            yield at, "succeeded", "done", job.attempts
        elif kind == "fail":
            yield self.failed(job, at, "reported")


def lease_transitions(stream: DataFrame, rules: Rules | None = None, late: str = "0 seconds") -> DataFrame:
    """(key, ts, state, reason, attempts): what happens to jobs, from events (key, ts, kind, token).

    kind is enqueue, claim, heartbeat, fail or succeed.  Only the holder of a running job's token may renew, fail or end it;
    others are refused, and that is put out too.  A failed or stale attempt makes the job pending again after the delay,
    ATTEMPTS times at most; then it has failed.  Timers follow the watermark, late behind the latest event; what they do has
    the time that they were set for.  Kept is one entry for each job, in the row of its key's bucket, until an ended one is
    forgotten; a bucket's timer is the earliest of its jobs'.
    """
    rules = rules or Rules()

    def run(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = {}
        if state.exists:
            keys, *kept = state.get
            jobs = dict(zip(keys, starmap(_Job, zip(*kept, strict=True)), strict=True))
        out = []
        if not state.hasTimedOut:
            for key, at, kind, token in in_order(bucket, frames, "kind", "token"):
                if key not in jobs:
                    jobs[key] = _Job()
                out += [(key, *x) for x in rules.heard(jobs[key], at // 1000, kind, token)]
        now = state.getCurrentWatermarkMs() * 1000
        for key, job in jobs.items():
            out += [(key, *x) for x in rules.due(job, now)]
        jobs = {key: job for key, job in jobs.items() if job.status not in ENDED or job.deadline > now}
        if jobs:
            state.update((list(jobs), *map(list, zip(*map(astuple, jobs.values()), strict=True))))
            timers = [job.deadline for job in jobs.values() if job.deadline is not None]
            if timers:
                state.setTimeoutTimestamp(-(-min(timers) // 1000) - 1)  # timers go off when the watermark has passed them
        else:
            state.remove()
        if out:
            keys, at, name, reason, attempts = zip(*out, strict=True)
            yield pd.DataFrame({"key": keys, "ts": pd.to_datetime(list(at), unit="us"), "state": name, "reason": reason, "attempts": attempts})

    events = bucketed(stream.withWatermark("ts", late), "key", "ts", "kind", "token")
    return events.groupBy("bucket").applyInPandasWithState(run, OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
