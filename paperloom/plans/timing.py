"""Times of the stages of an audit, for reports."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

#: Stages in the order in which they run.
STAGES = ("read", "validate", "extract", "score", "review", "ground", "explain")


class Timings:
    """Seconds by stage. A stage that never ran shows as N/A."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def report(self) -> str:
        rows = [(name, self.seconds.get(name)) for name in STAGES] + [("total", sum(self.seconds.values()) if self.seconds else None)]
        return "\n".join(f"{name:<10}{'N/A' if s is None else f'{s:.2f} s'}" for name, s in rows)
