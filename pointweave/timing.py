"""Named timers that add up."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager


class StageTimer:
    def __init__(self) -> None:
        self.spent: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.spent[name] = self.spent.get(name, 0.0) + time.perf_counter() - start

    def table(self) -> str:
        wide = max(map(len, self.spent), default=0)
        return "\n".join(f"{name:<{wide}}  {1000 * s:10.0f} ms" for name, s in self.spent.items())
