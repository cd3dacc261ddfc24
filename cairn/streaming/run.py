"""One run of the catalog: recover, scan, work off the queue, report; and the same for every batch of a watched folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cairn.operators.browse import status_counts
from cairn.operators.extract import Model, NotReady, Policy, process
from cairn.sources.files import scan_all
from cairn.workspace import cut


def run_once(tables: dict[str, DataFrame], listings: dict[int, DataFrame], images: Callable[[dict[str, DataFrame]], DataFrame], model: Model, now: str, policy: Policy = Policy(), limit: int | None = None, recent_first: bool = False, log: str | None = None, **scanning) -> dict[str, DataFrame]:
    """All tables after a run, with ``stats`` of the scans, ``outcomes`` of the queue, and ``counts`` by state.

    Interrupted rows are taken up again, every source is scanned, and what is queued is worked off, ``limit`` photos at most.
    ``images`` gives (id, image) of the tables after the scans. A model with a ``preflight`` is asked for its problems first; any is
    ``NotReady``, and nothing is begun. Of a model that is lost on the way, and of a run that is stopped or out of time, the answers
    so far are kept, and the outcomes name what was requeued. With a ``log`` they outlive a run that breaks off; it is for the caller
    to ``forget`` once the tables are saved.
    """
    if problems := getattr(model, "preflight", list)():
        raise NotReady("; ".join(problems))
    scanned = scan_all(tables, listings, now=now, **scanning) if listings else dict(tables)
    scanned["photos"] = cut(scanned["photos"], "photos")
    photos, found = process(scanned["photos"], images(scanned), model, now, policy, limit, recent_first, log)
    done = cut(photos, "photos")
    return scanned | {"photos": done, "outcomes": found, "counts": status_counts(done)}


def batch_runner(load: Callable[[], dict[str, DataFrame]], save: Callable[[dict[str, DataFrame], int], None], source_id: int, images: Callable, model: Model, clock: Callable[[], str], **options) -> Callable[[DataFrame, int], None]:
    """A sink for ``queue.watch`` over listings: each batch of files is one run over the tables that ``load`` gives, kept by ``save``.

    ``save`` gets the number of the batch, so that one that is repeated after a failure replaces what it wrote.
    """

    def sink(batch: DataFrame, number: int) -> None:
        save(run_once(load(), {source_id: batch}, images, model, clock(), **options), number)

    return sink
