"""Compaction in the background, beside writes, streams and searches."""

from __future__ import annotations

import threading
import time

from ..database import Collection


class Compactor:
    """A thread that merges whatever level is eligible, each in its own job, every ``interval`` seconds.

    Commits are optimistic, so nothing waits for a merge's rows. Writes through the same collection object are not made
    to begin again: a merge publishes before or after them. An error is kept in ``errors`` and the level tried again.
    """

    def __init__(self, collection: Collection, interval: float = 1.0):
        self.collection, self.interval = collection, interval
        self.merges, self.errors = 0, []
        self._stop, self._idle = threading.Event(), threading.Event()
        self._thread = threading.Thread(target=self._run, name=f"compact-{collection.schema.name}", daemon=True)

    def _run(self) -> None:
        while not self._stop.is_set():
            try:
                self.collection.refresh()
                done = self.collection.compact_once()
            except Exception as e:  # the next pass starts from the latest snapshot
                self.errors.append(e)
                done = 0
            self.merges += done
            if not done:
                self._idle.set()
                self._stop.wait(self.interval)

    def start(self) -> Compactor:
        self._thread.start()
        return self

    def stop(self) -> None:
        """Returns once a merge under way has ended."""
        self._stop.set()
        self._thread.join()

    def wait_idle(self, timeout: float = 60.0) -> None:
        """Until a pass that began after this call has found nothing to merge."""
        end = time.time() + timeout
        for _ in range(2):  # the pass at work now may have looked before the last write
            self._idle.clear()
            if not self._idle.wait(max(0.0, end - time.time())):
                raise TimeoutError("compaction has not come to rest")

    def __enter__(self) -> Compactor:
        return self.start()

    def __exit__(self, *_: object) -> None:
        self.stop()
