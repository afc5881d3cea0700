"""Health of sources, run by run: the verdict on each run against its source's history, and recovery after a collapse.

A verdict decides what later runs are compared with, so a source's runs are folded in order. The state of a source is
small: the sizes of its good runs of the last 30 days, whether an anomaly is open, and the requests for a recovery pass
since it was last healthy. The same fold serves the batch (every source's whole log in one pass over sorted rows, bounded
by the log's retention) and the stream (streaming/health.py).
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY, HOUR = 86_400_000_000, 3_600_000_000
#: Shares of a drop, the share of rejected records that is a warning, and when page counts can be compared.
DROPS = [(0.6, "CRITICAL"), (0.3, "INCOMPLETE"), (0.1, "WARNING"), (0.0, "HEALTHY")]
REJECTED_SHARE, LEAST_PAGE_RUNS, PAGE_SPREAD, WINDOWS = 0.3, 2, 2, (7, 30)
#: Verdicts under which nothing that a source no longer shows is removed; those that a full pass may cure.
PROTECTIVE = ["WARNING", "INCOMPLETE", "CRITICAL", "BLOCKED", "FAILED", "NO_DATA"]
COLLAPSED = ["INCOMPLETE", "CRITICAL"]
#: Hours between requests and until one expires, and requests for one collapse.
COOLDOWN_HOURS, EXPIRY_HOURS, MOST_ATTEMPTS = 12, 24, 3

#: Columns of a run beside id, source and started_at, and what a null means.
RUN = {
    "records": ("double", None), "pages": ("double", None), "rejected": ("double", 0.0), "blocked": ("boolean", False), "complete": ("boolean", None), "eligible": ("boolean", True),
    "structure_changed": ("boolean", False), "failed": ("boolean", False), "accepted": ("boolean", False), "index_size": ("double", None), "index_before": ("double", None),
}


def drop_of(now: float | None, before: float | None) -> tuple[float | None, str | None]:
    """Share by which a number is below what it was, and its class; nothing where there is nothing to compare."""
    if now is None or not before:
        return None, None
    share = max(0.0, (before - now) / before)
    return share, next(name for least, name in DROPS if share >= least)


class Sizes:
    """Numbers of the last days: two machine words for each, and the distinct ones in order of size with how often they come.

    A pointer at the median's place moves with what is added and dropped, so the median of any moment is two look-ups.
    """

    def __init__(self, days: int, times: Iterable[int] = (), values: Iterable[float] = ()):
        self.span, self.times, self.values, self.first = days * DAY, array("q"), array("d"), 0
        self.sorted, self.often = [], {}
        self.place, self.below = 0, 0  # a place among the distinct, and how many numbers are below it
        for at, value in zip(times, values):
            self.add(at, value)

    def __len__(self) -> int:
        return len(self.times) - self.first

    def add(self, at: int, value: float) -> None:
        self.times.append(at)
        self.values.append(value)
        if value not in self.often:
            i = bisect_left(self.sorted, value)
            self.sorted.insert(i, value)
            self.often[value] = 0
            self.place += i <= self.place and len(self.sorted) > 1
        self.often[value] += 1
        self.below += value < self.sorted[self.place]

    def _drop(self, value: float) -> None:
        self.below -= value < self.sorted[self.place]
        self.often[value] -= 1
        if self.often[value]:
            return
        del self.often[value]
        i = bisect_left(self.sorted, value)
        del self.sorted[i]
        self.place -= i < self.place
        if self.place and self.place == len(self.sorted):
            self.place -= 1
            self.below -= self.often[self.sorted[self.place]]

    def at(self, now: int) -> Sizes:
        while self.first < len(self.times) and self.times[self.first] < now - self.span:
            self._drop(self.values[self.first])
            self.first += 1
        if self.first > 1000 and self.first * 2 > len(self.times):
            del self.times[: self.first], self.values[: self.first]
            self.first = 0
        return self

    @property
    def median(self) -> float | None:
        n = len(self)
        if not n:
            return None
        while self.below > (n - 1) // 2:
            self.place -= 1
            self.below -= self.often[self.sorted[self.place]]
        while (upto := self.below + self.often[self.sorted[self.place]]) <= (n - 1) // 2:
            self.place, self.below = self.place + 1, upto
        low = self.sorted[self.place]
        return (low + (low if n // 2 < upto else self.sorted[self.place + 1])) / 2

    def dump(self) -> list[str]:
        return [base64.b64encode(zlib.compress(x[self.first :].tobytes(), 1)).decode() for x in (self.times, self.values)]

    @classmethod
    def load(cls, days: int, times: str, values: str) -> Sizes:
        words = lambda kind, text: array(kind, zlib.decompress(base64.b64decode(text)))
        return cls(days, words("q", times), words("d", values))


@dataclass
class Verdict:
    status: str
    protect: bool
    record_health: str | None = None
    page_health: str | None = None
    baseline: float | None = None
    page_baseline: float | None = None


@dataclass
class Source:
    """State of a source between runs; times in microseconds."""

    sizes: dict = field(default_factory=lambda: {(k, d): Sizes(d) for k in ("records", "pages") for d in WINDOWS})
    before: list = field(default_factory=list)  # the last two sizes that counted
    protected: bool = False
    status: str | None = None  # of the run that decides about protection
    compared: bool = False  # whether the open anomaly began when there was something to compare with
    queued: list = field(default_factory=list)  # requests since the source was last healthy
    open_at: int | None = None
    passed: str | None = None  # verdict of the newest complete pass after the open request
    state: str | None = None
    gave_up: bool = False

    # -- verdicts --------------------------------------------------------------------------------------------------

    def judge(self, run: dict, at: int) -> Verdict:
        """The verdict on a run; the rules in order, the first that applies."""
        seen = {k: s.at(at) for k, s in self.sizes.items()}
        first = lambda *values: next((v for v in values if v is not None), None)
        size = first(seen["records", 7].median, seen["records", 30].median, self.before[0] if len(self.before) == 2 else None)
        known = bool(size) and bool(seen["records", 7] or seen["records", 30])
        pages = self._comparable_pages(seen)
        records, open_ = run["records"], self.protected and self.compared
        _, records_now = drop_of(records, size)
        _, pages_now = drop_of(run["pages"], pages)
        _, index_now = drop_of(run["index_size"], run["index_before"])
        worst = next((name for _, name in DROPS if name in (records_now, pages_now)), "HEALTHY")
        health = (records_now or "HEALTHY", pages_now)
        rules = [
            (run["accepted"], ("HEALTHY", False, "HEALTHY", None)),
            (not run["eligible"] and index_now not in (None, "HEALTHY"), (index_now, True, index_now, None)),
            (not run["eligible"], ("RECOVERING", False)),
            (run["blocked"], ("BLOCKED", True)),
            (run["structure_changed"], ("CRITICAL", True)),
            (run["failed"] and records is None, ("FAILED", True)),
            (run["complete"] is False, ("INCOMPLETE", True)),
            (records == 0 and bool(size), ("CRITICAL", True, "CRITICAL", None)),
            (records is None, ("RECOVERING", open_)),
            (not known and open_, ("RECOVERING", True)),
            (not known and records == 0, ("NO_DATA", True)),
            (not known, ("RECOVERING", False)),
            (worst != "HEALTHY", (worst, True, *health)),
            (known and bool(records) and run["rejected"] / records >= REJECTED_SHARE, ("WARNING", True, *health)),
            (True, ("HEALTHY", False, *health)),
        ]
        out = Verdict(*next(result for holds, result in rules if holds))
        out.baseline, out.page_baseline = size, pages
        self._remember(run, at, out)
        return out

    def _comparable_pages(self, seen: dict) -> float | None:
        week, month = seen["pages", 7], seen["pages", 30]
        if max(len(week) if len(week) >= LEAST_PAGE_RUNS else 0, len(month)) < LEAST_PAGE_RUNS:
            return None
        if week.sorted and week.sorted[0] and week.sorted[-1] / week.sorted[0] > PAGE_SPREAD:
            return None
        return (week.median if week else month.median) or None

    def _remember(self, run: dict, at: int, verdict: Verdict) -> None:
        clean = not (verdict.protect or run["blocked"] or run["structure_changed"] or run["failed"] or run["complete"] is False)
        if run["accepted"]:  # a new start: older runs count no more
            self.sizes, self.before = {k: Sizes(d) for k, d in ((k, k[1]) for k in self.sizes)}, []
        if run["eligible"] and (verdict.status == "HEALTHY" or (verdict.status == "RECOVERING" and clean)):
            for (name, days), sizes in self.sizes.items():
                if run[name] is not None:
                    sizes.add(at, run[name])
            if run["records"] is not None:
                self.before = [*self.before, run["records"]][-2:]
        if verdict.status == "RECOVERING" and not verdict.protect:
            return  # settles nothing
        told = verdict.status == "RECOVERING" or verdict.record_health is not None or verdict.page_health is not None
        self.compared = verdict.protect and ((self.protected and self.compared) or told)
        self.protected, self.status = verdict.protect, verdict.status

    # -- recovery --------------------------------------------------------------------------------------------------

    def recover(self, run: dict, at: int, verdict: Verdict) -> str | None:
        """What is done about the source after a run: QUEUED, DONE, FAILED_ATTEMPT, EXPIRED, CANCELLED, EXHAUSTED or nothing."""
        if verdict.status == "HEALTHY":
            self.queued, self.gave_up = [], False
        if self.open_at is not None and run["eligible"] and run["complete"]:
            self.passed = verdict.status
        done = self._about_open(at) if self.open_at is not None else self._about_new(at)
        if done:
            self.state = done
        return done

    def _about_open(self, at: int) -> str | None:
        if self.passed is not None:
            done = "FAILED_ATTEMPT" if self.passed != "HEALTHY" else None if self.protected else "DONE"
        elif self.status is not None and not self.protected:
            done = "CANCELLED"
        else:
            done = "EXPIRED" if at - self.open_at > EXPIRY_HOURS * HOUR else None
        if done:
            self.open_at = self.passed = None
        return done

    def _about_new(self, at: int) -> str | None:
        if not self.protected or self.status not in COLLAPSED or self.gave_up:
            return None
        if len(self.queued) >= MOST_ATTEMPTS:
            self.gave_up = True
            return "EXHAUSTED"
        if self.queued and at - self.queued[-1] < COOLDOWN_HOURS * HOUR:
            return None
        self.queued, self.open_at = [*self.queued, at], at
        return "QUEUED"

    # -- between batches of a stream ---------------------------------------------------------------------------------

    def dump(self) -> str:
        sizes = [[k, d, *s.dump()] for (k, d), s in self.sizes.items()]
        return json.dumps({**{k: v for k, v in self.__dict__.items() if k != "sizes"}, "sizes": sizes})

    @classmethod
    def load(cls, text: str) -> Source:
        held = json.loads(text)
        sizes = {(k, d): Sizes.load(d, *rows) for k, d, *rows in held.pop("sizes")}
        return cls(sizes=sizes, **held)


OUT = "id long, source string, started_at timestamp_ntz, baseline double, page_baseline double, verdict string, protect boolean, record_health string, page_health string, action string, state string, attempts int"


def run_rows(runs: DataFrame) -> DataFrame:
    """id, source, started_at and the columns of RUN; those that runs do not have are null, and nulls (and no numbers) mean what RUN says."""
    have = set(runs.columns)

    def value(name: str, kind: str, null) -> Column:
        if name not in have:
            return F.lit(null).cast(kind)
        given = F.col(name).cast(kind)
        given = F.when(~F.isnan(given), given) if kind == "double" else given
        return given if null is None else F.coalesce(given, F.lit(null))

    columns = [value(c, kind, null).alias(c) for c, (kind, null) in RUN.items()]
    return runs.select(F.col("id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), F.col("started_at").cast("timestamp_ntz").alias("started_at"), *columns)


def advance(source: Source, row: dict, at: int) -> tuple:
    """One run more: the row of OUT from `baseline` on."""
    verdict = source.judge(row, at)
    action = source.recover(row, at, verdict)
    return verdict.baseline, verdict.page_baseline, verdict.status, verdict.protect, verdict.record_health, verdict.page_health, action, source.state, len(source.queued)


def source_health(runs: DataFrame) -> DataFrame:
    """For each run (id, source, started_at and columns of RUN): the verdict and what it was compared with, whether it
    protects, and the action, state and requests of recovery after it. Runs of a source go by started_at, then id.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = object(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(n) for n in batch.schema.names}
            times, rows = cols["started_at"].cast(pa.int64()).to_pylist(), []
            for row, at in zip(batch.to_pylist(), times):
                if row["source"] != now:
                    now, held = row["source"], Source()
                rows.append(advance(held, row, at))
            types = [pa.float64(), pa.float64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([cols["id"], cols["source"], cols["started_at"], *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [x.split()[0] for x in OUT.split(", ")])

    return run_rows(runs).repartition("source").sortWithinPartitions("source", "started_at", "id").mapInArrow(walk, OUT)
