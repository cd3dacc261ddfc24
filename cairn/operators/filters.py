"""Predicates and selectors; all are Catalyst expressions, so they push down to the scan."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alive() -> Column:
    return F.col("deleted_at").isNull()


def visible() -> Column:
    """Neither trashed nor hidden."""
    return alive() & ~F.col("hidden")


def every(*conditions: Column | None) -> Column:
    given = [c for c in conditions if c is not None]
    return reduce(and_, given) if given else F.lit(True)


def date_window(date_from: str | None = None, date_to: str | None = None, year: str | int | None = None, column: str = "date_taken") -> Column:
    """Inclusive range; a year is a range too, so that it pushes down. Rows without a date drop out where a bound is given."""
    taken = F.col(column)
    bound = [taken >= F.lit(date_from).cast("timestamp_ntz") if date_from else None, taken <= F.lit(date_to).cast("timestamp_ntz") if date_to else None]
    if year is not None:
        if not re.fullmatch(r"\d{4}", str(year)):
            raise ValueError(f"not a year: {year}")
        bound += [taken >= F.lit(f"{int(year):04d}-01-01").cast("timestamp_ntz"), taken < F.lit(f"{int(year) + 1:04d}-01-01").cast("timestamp_ntz")]
    return every(*bound)


def parse_slice_date(text: str, *, end: bool) -> datetime:
    """``YYYY``, ``YYYY-MM``, ``YYYY-MM-DD`` or ISO, widened to its first or last instant."""
    if m := re.fullmatch(r"(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", text.strip()):
        year, month, day = int(m[1]), int(m[2] or (12 if end else 1)), m[3]
        last = int(day) if day else (calendar.monthrange(year, month)[1] if end else 1)
        first = datetime(year, month, last)
        return first + timedelta(days=1) - timedelta(microseconds=1) if end else first
    return datetime.fromisoformat(text.strip())


def browse(status: str | None = "done", has_text: bool | None = None, category: str | None = None, show_hidden: bool = False, hidden_only: bool = False, date_from: str | None = None, date_to: str | None = None, year: str | None = None) -> Column:
    """Conjunction of the given filters over rows that are not trashed; ``hidden_only`` beats ``show_hidden``."""
    shown = F.col("hidden") if hidden_only else None if show_hidden else ~F.col("hidden")
    return every(
        alive(),
        shown,
        F.col("status") == status if status and status != "all" else None,
        F.col("has_text") == has_text if has_text is not None else None,
        F.col("category") == category if category else None,
        date_window(date_from, date_to, year) if date_from or date_to or year else None,
    )


def with_person(photos: DataFrame, tags: DataFrame, people: DataFrame, name: str, min_confidence: float = 0.0) -> DataFrame:
    """Photos that show a person, by semi-join; names compare without case and outer space."""
    who = people.where(F.lower("name") == F.lower(F.trim(F.lit(name)))).select(F.col("id").alias("person_id"))
    tagged = tags.where(F.col("present") & (F.col("confidence") >= min_confidence)).join(F.broadcast(who.limit(1)), "person_id", "left_semi")
    return photos.join(tagged.select(F.col("photo_id").alias("id")), "id", "left_semi")


def reprocess(selector: str, value: str | None = None) -> Column:
    """Selectors of the reprocess command, visible rows only; an unknown one selects nothing."""
    by = {
        "errors": lambda: F.col("status") == "error",
        "no_text": lambda: (F.col("status") == "done") & (F.col("has_text") == F.lit(False)),
        "tiled": lambda: F.col("tiled"),
        "gated": lambda: F.col("gated"),
        "derivative": lambda: F.col("derivative"),
        "done_with": lambda: (F.col("status") == "done") & (F.col("model") == value),
        "done_before": lambda: (F.col("status") == "done") & F.col("finished_at").isNotNull() & (F.col("finished_at") < F.lit(value).cast("timestamp_ntz")),
        "category": lambda: F.col("category") == value,
        "all": lambda: F.col("status") != "deferred",
    }
    return visible() & (by[selector]() if selector in by else F.lit(False))


def review(threshold: float = 0.6) -> Column:
    """Whether a tag waits for a human: a model's, below the threshold."""
    return (F.col("origin") == "model") & (F.col("confidence") < threshold)


def date_params(date_from: str | None = None, date_to: str | None = None, year: str | None = None) -> dict[str, str | None]:
    """Dates of a request as arguments of ``date_window``: what is no date or year is left out, the last day counts whole."""

    def day(text: str | None) -> str | None:
        try:
            return datetime.strptime((text or "").strip(), "%Y-%m-%d").strftime("%Y-%m-%d")
        except ValueError:
            return None

    last = day(date_to)
    return {"date_from": day(date_from), "date_to": last and f"{last}T23:59:59", "year": year.strip() if re.fullmatch(r"\d{4}", (year or "").strip()) else None}


def pick_ids(photos: DataFrame, ids: DataFrame, tags: DataFrame | None = None, people: DataFrame | None = None, person: str | None = None, **dates: str | None) -> DataFrame:
    """Those of the ids that show the person and lie in the date window, as far as asked; trashed ones too."""
    rows = photos.join(ids.select("id").distinct(), "id", "left_semi").where(date_window(**dates))
    return (with_person(rows, tags, people, person) if person else rows).select("id")


def bulk(condition: Column | None) -> Column:
    """A condition for a change of many rows; none is an error, so that a slip does not change all."""
    if condition is None:
        raise ValueError("say which rows are meant")
    return condition
