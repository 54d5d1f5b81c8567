"""Public holidays: parsed from a service's JSON, or from the calendar's rules when it cannot be reached."""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

#: The fixed-date public holidays (month, day, name).
FIXED_DATES = (
    (1, 1, "New Year's Day"),
    (3, 21, "Human Rights Day"),
    (4, 27, "Freedom Day"),
    (5, 1, "Workers' Day"),
    (6, 16, "Youth Day"),
    (8, 9, "National Women's Day"),
    (9, 24, "Heritage Day"),
    (12, 16, "Day of Reconciliation"),
    (12, 25, "Christmas Day"),
    (12, 26, "Day of Goodwill"),
)
SCHEMA = "holiday_date date, name string, source string"


def parse(payload: str, country: str = "ZA") -> list[tuple[str, str, str]]:
    """(date, name, source) of a service's JSON array; another country's days are refused, unmarked ones are taken."""
    days = json.loads(payload)
    if any(d.get("countryCode") not in (None, country) for d in days):
        raise ValueError(f"holidays of another country than {country}")
    return [(d["date"], d.get("name") or d.get("localName"), "api") for d in days]


def over_http(template: str, timeout: float = 10.0) -> Callable[[int], str]:
    """Fetches a year's JSON from a service; ``{year}`` in the template stands for the year."""

    def fetch(year: int) -> str:
        with urllib.request.urlopen(template.format(year=year), timeout=timeout) as answer:  # an OSError where it cannot
            return answer.read().decode()

    return fetch


def easter(year: int) -> dt.date:
    """Easter Sunday of the Gregorian calendar, by the full moon's age and the week's day."""
    golden, (century, of_century) = year % 19, divmod(year, 100)
    corrected = century - century // 4 - (8 * century + 13) // 25
    moon = (19 * golden + corrected + 15) % 30
    moon -= moon // 28 * (1 - 29 // (moon + 1) * ((21 - golden) // 11))
    weekday = (year + year // 4 + moon + 2 - century + century // 4) % 7
    return dt.date(year, 3, 28) + dt.timedelta(days=moon - weekday)


def fallback(year: int) -> list[tuple[str, str, str]]:
    """Fixed and movable days, and the Monday after a day that falls on a Sunday; a date has one name."""
    sunday = easter(year)
    days = {dt.date(year, m, d): name for m, d, name in FIXED_DATES}
    days.setdefault(sunday - dt.timedelta(days=2), "Good Friday")
    days.setdefault(sunday + dt.timedelta(days=1), "Family Day")
    for day, name in sorted(days.items()):
        if day.weekday() == 6:
            days.setdefault(day + dt.timedelta(days=1), f"{name} (observed)")
    return [(day.isoformat(), name, "fallback") for day, name in sorted(days.items())]


def collect(years: Iterable[int], fetch: Callable[[int], str] | None = None, tries: int = 3, pause: Callable[[float], None] = time.sleep) -> list[tuple[str, str, str]]:
    """Each year from the service, tried a few times with growing pauses, else from the rules."""
    rows: list[tuple[str, str, str]] = []
    for year in years:
        found = None
        for attempt in range(tries if fetch else 0):
            try:
                found = parse(fetch(year))
                break
            except (OSError, ValueError):
                pause(2.0**attempt)
        rows.extend(found or fallback(year))
    return rows


def holidays(spark: SparkSession, years: Iterable[int] = range(1995, 2003), fetch: Callable[[int], str] | None = None) -> DataFrame:
    rows = collect(years, fetch)
    return spark.createDataFrame(rows, "d string, name string, source string").selectExpr("cast(d as date) holiday_date", "name", "source")
