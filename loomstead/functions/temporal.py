"""Time windows read from the words of a query."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, time, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()  # fixed values
_UNITS = {"day": 1, "week": 7}
READ = 512
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@dataclass(frozen=True)
class Window:
    start: datetime
    end: datetime
    kind: str
    matched: str
    now_anchored: bool


def _day_end(d: date) -> datetime:
    return datetime.combine(d + timedelta(days=1), time(), UTC) - timedelta(milliseconds=1)


def _at(d: date) -> datetime:
    return datetime.combine(d, time(), UTC)


def back_months(d: datetime, n: int) -> datetime:
    """The same day ``n`` months before, or the month's last."""
    year, month = divmod(d.year * 12 + d.month - 1 - n, 12)
    for day in range(d.day, 27, -1):
        try:
            return d.replace(year=year, month=month + 1, day=day)
        except ValueError:
            continue
    return d.replace(year=year, month=month + 1)


def _month(year: int, month: int) -> tuple[datetime, datetime]:
    first = date(year, month, 1)
    after = date(year + month // 12, month % 12 + 1, 1)
    return _at(first), _day_end(after - timedelta(days=1))


def parse_window(query: str, now: datetime) -> Window | None:
    """The window of the first phrase that matches, in a fixed order; a phrase with an impossible date gives none."""
    text = re.sub(r"\"[^\"]*\"|“[^”]*”", lambda m: " " * len(m[0]), query[:READ]).lower()
    today = now.date()
    months = "|".join(MONTHS)
    if m := re.search(r"\bon (\d{4})-(\d{2})-(\d{2})\b", text):
        try:
            d = date(*map(int, m.groups()))
        except ValueError:
            return None
        return Window(_at(d), _day_end(d), "on_date", m[0], False)
    if m := re.search(r"\bsince (\d{4})-(\d{2})-(\d{2})\b", text):
        try:
            d = date(*map(int, m.groups()))
        except ValueError:
            return None
        return Window(_at(d), now, "since_date", m[0], True) if _at(d) <= now else None
    if m := re.search(rf"\b(?:in|during) ({months})(?: (\d{{4}}))?\b", text):
        month = MONTHS.index(m[1]) + 1
        year = int(m[2]) if m[2] else today.year - (month > today.month)
        return Window(*_month(year, month), "in_month", m[0], False) if 1 <= year <= 9998 else None
    if m := re.search(r"\b(?:last|past) (\d{1,10}) (day|week|month)s?\b", text):
        n = int(m[1])
        try:
            if m[2] in _UNITS:
                start = now - timedelta(days=n * _UNITS[m[2]])
            else:
                start = back_months(now, n)
        except (OverflowError, ValueError):
            return None
        return Window(start, now, "last_n", m[0], True) if n else None
    monday = today - timedelta(days=today.weekday())
    first = today.replace(day=1)
    last_month = back_months(_at(first), 1)
    spans = {
        "yesterday": (_at(today - timedelta(days=1)), _day_end(today - timedelta(days=1)), False),
        "today": (_at(today), now, True),
        "last week": (_at(monday - timedelta(days=7)), _day_end(monday - timedelta(days=1)), False),
        "this week": (_at(monday), now, True),
        "last month": (*_month(last_month.year, last_month.month), False),
        "this month": (_at(first), now, True),
        "last year": (_at(date(today.year - 1, 1, 1)), _day_end(date(today.year - 1, 12, 31)), False),
        "this year": (_at(date(today.year, 1, 1)), now, True),
    }
    for phrase, (start, end, anchored) in spans.items():
        if m := re.search(rf"\b{phrase}\b", text):
            return Window(start, end, phrase.replace(" ", "_"), m[0], anchored)
    return None


def windows(query: Column, now: Column) -> Column:
    """``kind``, ``start_ms``, ``end_ms`` and ``now_anchored`` of the window in each query's words as of ``now``; null where there is none."""

    @F.pandas_udf("kind string, start_ms bigint, end_ms bigint, now_anchored boolean")
    def read(queries: pd.Series, times: pd.Series) -> pd.DataFrame:
        rows = []
        for q, ms in zip(queries, times, strict=True):
            at = None if q is None or pd.isna(ms) else parse_window(q, datetime.fromtimestamp(ms / 1000, UTC))
            rows.append((at.kind, *(round((t - _EPOCH) / timedelta(milliseconds=1)) for t in (at.start, at.end)), at.now_anchored) if at else (None, None, None, None))
        return pd.DataFrame(rows, columns=["kind", "start_ms", "end_ms", "now_anchored"]).astype({"start_ms": "Int64", "end_ms": "Int64"})

    return read(query.cast("string"), F.unix_millis(now.cast("timestamp")))
