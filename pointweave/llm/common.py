"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

from pointweave.shared import looked_up, shared_dir, stored, stored_with

__all__ = ["arrow_map", "looked_up", "shared_dir", "slices", "stored", "stored_with"]


def arrow_map(make: Callable[[], Callable[[pa.RecordBatch], list]], names: list[str]) -> Callable:
    """A ``mapInArrow`` function: make() builds the per-batch function once in a task; it returns one list or array per name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if batch.num_rows:
                work = work or make()
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in work(batch)], names)

    return run


def slices(texts: list[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters each; a longer text is a range of its own."""
    start = total = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > start and total + n > chars:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
