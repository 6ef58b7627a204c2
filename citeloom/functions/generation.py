"""Text generation as a column: a pluggable function called in Arrow batches.

A provider is a zero-argument factory of ``complete(system, user) -> str``.
Raise ``Exhausted`` to give up on a provider for good, ``Refused`` for errors
that no retry can mend; anything else is retried with growing pauses.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Complete = Callable[[str, str], str]
Provider = Callable[[], Complete]


class Exhausted(Exception):
    """The provider's quota is used up; move on to the next one, never back."""


class Refused(Exception):
    """Bad credentials or a bad request; retrying is pointless."""


@dataclass(frozen=True)
class Pooled:
    """Providers asked by several threads of a task, at no more than a rate over all tasks.

    ``tasks`` is how many run at once at most (the cluster's cores). Each takes an equal part
    of ``per_minute``; without a rate nobody waits. Stands wherever providers are given.
    """

    providers: Sequence[Provider]
    parallel: int = 8
    per_minute: float | None = None
    tasks: int = 1


class Pace:
    """Keeps the calls of a task ``every`` seconds apart.

    The first call waits too, so tasks that follow each other in one place keep the
    rate together. Time that passed unused is not made up for.
    """

    def __init__(self, every: float):
        self._every, self._next, self._lock = every, time.monotonic() + every, Lock()

    def wait(self) -> None:
        with self._lock:
            at = max(self._next, time.monotonic())
            self._next = at + self._every
        time.sleep(max(0.0, at - time.monotonic()))


class Ring:
    """Providers in order, moved through forward only, whichever thread finds one at its end."""

    def __init__(self, providers: Sequence[Provider], attempts: int = 3, pause: float = 2.0, pace: Pace | None = None):
        self._providers = list(providers)
        self._attempts, self._pause, self._pace = attempts, pause, pace
        self._place, self._current, self._lock = 0, None, Lock()

    def _now(self) -> tuple[int, Complete | None]:
        with self._lock:
            if self._current is None and self._place < len(self._providers):
                self._current = self._providers[self._place]()
            return self._place, self._current

    def _leave(self, place: int) -> bool:
        """Moves on from a provider unless another thread did; whether one is left."""
        with self._lock:
            if place == self._place:
                self._place, self._current = place + 1, None
            return self._place < len(self._providers)

    def ask(self, system: str, user: str) -> str:
        while True:
            place, complete = self._now()
            if complete is None:
                raise Exhausted("no provider left")
            last: Exception | None = None
            for attempt in range(self._attempts):
                try:
                    if self._pace is not None:
                        self._pace.wait()
                    return complete(system, user)
                except Refused:
                    raise
                except Exhausted:
                    last = None
                    break
                except Exception as error:
                    last = error
                    if attempt + 1 < self._attempts:
                        time.sleep(self._pause**attempt if self._pause else 0)
            if not self._leave(place) and last is not None:
                raise last


def _is_object(reply: str) -> bool:
    start, end = reply.find("{"), reply.rfind("}")
    if start < 0 or end < start:
        return False
    try:
        return isinstance(json.loads(reply[start:end + 1]), dict)
    except ValueError:
        return False


def generate(
    user: Column, system: str, providers: Sequence[Provider] | Pooled, expect_json: bool = False,
    fail_open: bool = False, pause: float = 2.0,
) -> Column:
    """Reply per prompt; null prompts are not asked.

    With ``expect_json`` a reply that holds no JSON object is asked for once
    more. With ``fail_open`` an error gives null instead of failing the task.
    ``Pooled`` providers are asked from several threads; replies keep their rows.
    """
    pooled = providers if isinstance(providers, Pooled) else Pooled(providers, parallel=1)
    every = None if pooled.per_minute is None else 60.0 * pooled.tasks / pooled.per_minute

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ring = Ring(pooled.providers, pause=pause, pace=None if every is None else Pace(every))

        def one(prompt: str | None) -> str | None:
            if prompt is None:
                return None
            try:
                reply = ring.ask(system, prompt)
                if expect_json and not _is_object(reply):
                    reply = ring.ask(system, prompt)
                return reply
            except Exception:
                if fail_open:
                    return None
                raise

        if pooled.parallel == 1:
            for batch in batches:
                yield pa.array([one(p) for p in batch.to_pylist()], pa.string())
            return
        with ThreadPoolExecutor(pooled.parallel) as threads:
            for batch in batches:
                yield pa.array(list(threads.map(one, batch.to_pylist())), pa.string())

    # a model may answer differently when asked again, so the optimizer must not duplicate the call
    return run.asNondeterministic()(user)
