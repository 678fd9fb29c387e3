"""Calls of remote or local models: a pace, retries, and whether a model is there."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from lavra.config import REQUESTS_PER_MINUTE, least_interval

# How often a call is tried, and how long to wait after the n-th failure, in seconds.
ATTEMPTS, WAIT_STEP, WAIT_MOST, WAIT_JITTER = 4, 5.0, 60.0, 0.5


@dataclass
class Paced:
    """``call`` at most so many times a minute within one task; run such calls in one partition to hold the pace for all."""

    call: Callable[[str], str]
    requests_per_minute: int = REQUESTS_PER_MINUTE
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _last: float | None = field(default=None, repr=False)

    def __call__(self, text: str) -> str:
        if self._last is not None:
            rest = self._last + least_interval(self.requests_per_minute) - self.clock()
            if rest > 0:
                self.sleep(rest)
        self._last = self.clock()
        return self.call(text)


@dataclass
class Retried:
    """``call`` tried again after failures and empty answers; the last failure is raised."""

    call: Callable[[str], str]
    attempts: int = ATTEMPTS
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, text: str) -> str:
        for n in range(1, self.attempts + 1):
            try:
                answer = self.call(text)
                if answer and answer.strip():
                    return answer
                raise ValueError("an empty answer")
            except Exception:
                if n == self.attempts:
                    raise
                self.sleep(min(WAIT_MOST, WAIT_STEP * n) + random.uniform(0, WAIT_JITTER))
        raise ValueError("attempts must be 1 or more")


def available(model: str, names: Iterable[str]) -> tuple[bool, list[str]]:
    """Whether a server that offers ``names`` has the model, by its name or as the beginning of one, and the names in order."""
    known = sorted(set(names))
    return any(n == model or n.startswith(model) for n in known), known
