"""Calls to a hosted model: several at once, at a set pace, and none twice.

A ledger keeps each answer under the digest of its prompt as soon as it is there: one
small object a call, in a folder that all executors reach. A task that is run again, or
the whole job, finds the answers of the calls that were made and makes only the others.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs


class Ledger:
    """Answers by prompt below a path or URI."""

    def __init__(self, where: str):
        self._system, self._base = fs.FileSystem.from_uri(where)

    def _place(self, prompt: str) -> str:
        digest = hashlib.sha256(prompt.encode("utf-8", "surrogatepass")).hexdigest()
        return f"{self._base}/{digest[:2]}/{digest}"

    def get(self, prompt: str) -> str | None:
        try:
            with self._system.open_input_stream(self._place(prompt)) as stream:
                return stream.read().decode()
        except FileNotFoundError:
            return None

    def put(self, prompt: str, answer: str) -> None:
        """Written aside and moved, so a reader never sees half an answer."""
        place = self._place(prompt)
        self._system.create_dir(place.rpartition("/")[0], recursive=True)
        aside = f"{place}.{uuid.uuid4().hex}"
        with self._system.open_output_stream(aside) as stream:
            stream.write(answer.encode())
        self._system.move(aside, place)


class Pace:
    """At most ``per_second`` starts a second over all threads of a task; 0 is no limit."""

    def __init__(self, per_second: float):
        self._gap, self._next, self._lock = (1 / per_second if per_second else 0.0), 0.0, threading.Lock()

    def wait(self) -> None:
        with self._lock:
            now = time.monotonic()
            start = max(now, self._next)
            self._next = start + self._gap
        time.sleep(max(0.0, start - now))


class Caller:
    """One task's calls: retries with a growing wait, null after the last failure."""

    def __init__(
        self, generator: Callable[[str], str], retries: int, wait: float, parallel: int, per_second: float, ledger: str | None
    ):
        self._generator, self._retries, self._wait = generator, retries, wait
        self._pool = ThreadPoolExecutor(parallel) if parallel > 1 else None
        self._pace = Pace(per_second)
        self._ledger = Ledger(ledger) if ledger else None

    def _answer(self, prompt: str) -> str | None:
        known = self._ledger.get(prompt) if self._ledger else None
        if known is not None:
            return known
        for n in range(1, self._retries + 1):
            self._pace.wait()
            try:
                answer = self._generator(prompt).strip()
            except Exception:
                time.sleep(n * self._wait)
                continue
            if self._ledger:
                self._ledger.put(prompt, answer)
            return answer
        return None

    def answers(self, prompts: list[str | None]) -> list[str | None]:
        """In the order of the prompts; null for a null one. With a ledger, equal prompts are one call."""
        if self._ledger:
            distinct = [p for p in dict.fromkeys(prompts) if p is not None]
            found = dict(zip(distinct, self._pool.map(self._answer, distinct) if self._pool else map(self._answer, distinct)))
            return [found.get(p) for p in prompts]
        one = lambda p: None if p is None else self._answer(p)
        return list(self._pool.map(one, prompts) if self._pool else map(one, prompts))
