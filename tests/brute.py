"""Plain-Python account of the study rules, to compare the pipelines with."""

from __future__ import annotations

import datetime as dt


def _key(v):
    return (v is None, v if v is not None else "")


def episodes(cells, outcomes):
    """cells: {(date, county): {outcome: n}} -> [(date, county, outcome, id text)]"""
    out, number = [], 0
    for date, county in sorted(cells, key=lambda k: (k[0] is None, k[0] or dt.date.min, _key(k[1]))):
        for o in outcomes:
            for _ in range(cells[date, county].get(o, 0)):
                number += 1
                out.append((date, county, o, f"{o[:4]} {number}"))
    return out


def in_study(date, months, start):
    return date is not None and date.month in months and date > start


def crossed(cells, outcomes, months, start, weeks=26):
    """[(date, case date, county, outcome, id, is case)]"""
    out = []
    for date, county, o, pid in episodes(cells, outcomes):
        if not in_study(date, months, start):
            continue
        for w in range(-weeks, weeks + 1):
            day = date + dt.timedelta(days=7 * w)
            if in_study(day, months, start):
                out.append((day, date, county, o, pid, w == 0))
    return out


def lags(panel, variables, n):
    """panel: {(date, county): {v: x}} -> the same with row lags added."""
    out = {}
    for county in {c for _, c in panel}:
        days = sorted(d for d, c in panel if c == county)
        for i, day in enumerate(days):
            row = dict(panel[day, county])
            for v in variables:
                for k in range(1, n + 1):
                    row[f"{v}_lag{k}"] = panel[days[i - k], county][v] if i >= k else None
            out[day, county] = row
    return out


def tables(cells, panel, outcomes, months, start, variables, n=5, weeks=26):
    """Analysis rows of all outcomes: (date, year, month, county, id, outcome, *exposures, name)."""
    lagged = lags(panel, variables, n)
    names = [*variables, *[f"{v}_lag{k}" for v in variables for k in range(1, n + 1)]]
    rows = crossed(cells, outcomes, months, start, weeks)
    values: dict[str, set] = {}
    for *_, pid, is_case in rows:
        values.setdefault(pid, set()).add(is_case)
    out = []
    for day, case_day, county, o, pid, is_case in rows:
        if len(values[pid]) == 2:
            exposure = lagged.get((day, county), {})
            out.append((
                day, f"{case_day:%Y}", f"{case_day:%m}", county, pid, int(is_case),
                *[exposure.get(v) for v in names], o.removesuffix("_dx"),
            ))
    return out
