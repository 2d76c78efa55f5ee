"""Word of how far a loop of queries has come."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame


class Progress:
    """A callback for ``each`` of loops such as ``deconvolve``: says something every so many rounds, and not more often than every so many seconds.

    ``show`` gets the number of the round and its result every ``show_every`` rounds, to look at it or keep it.
    """

    def __init__(self, total: int, every: int = 1, seconds: float = 0.0, say: Callable[[str], None] = print, show: Callable[[int, DataFrame], None] | None = None, show_every: int = 50):
        self.total, self.every, self.seconds, self.say, self.show, self.show_every = total, every, seconds, say, show, show_every
        self.began = self.last = time.monotonic()

    def __call__(self, k: int, result: DataFrame) -> None:
        now = time.monotonic()
        if (k + 1) % self.every == 0 and (now - self.last >= self.seconds or k + 1 == self.total):
            self.last = now
            self.say(f"{k + 1} of {self.total}, {now - self.began:.1f} s")
        if self.show and (k + 1) % self.show_every == 0:
            self.show(k, result)
