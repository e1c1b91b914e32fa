"""The live tail: committed rows, pushed to whoever listens, best effort."""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Callable, Iterator

HEARTBEAT_SECONDS = 15.0


class LiveTail:
    """Fan-out in one process.  A subscriber that raises is removed."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._subscribers: dict[int, Callable[[list[dict]], None]] = {}
        self._next = 0

    def subscribe(self, subscriber: Callable[[list[dict]], None]) -> Callable[[], None]:
        with self._lock:
            number, self._next = self._next, self._next + 1
            self._subscribers[number] = subscriber
        return lambda: self._remove(number)

    def _remove(self, number: int) -> None:
        with self._lock:
            self._subscribers.pop(number, None)

    def publish(self, logs: list[dict]) -> None:
        if not logs:
            return
        with self._lock:
            now = list(self._subscribers.items())
        for number, subscriber in now:
            try:
                subscriber(logs)
            except Exception:
                self._remove(number)

    @property
    def subscribers(self) -> int:
        return len(self._subscribers)


class EventStream:
    """Server-sent events for one client: a bounded queue that drops batches
    while it is full, and heartbeats while nothing happens."""

    def __init__(self, tail: LiveTail, capacity: int = 64, heartbeat: float = HEARTBEAT_SECONDS):
        self.heartbeat = heartbeat
        self._queue: queue.Queue[list[dict] | None] = queue.Queue(capacity)
        self._closed = threading.Event()
        self.dropped = 0
        self._leave = tail.subscribe(self._offer)

    def _offer(self, logs: list[dict]) -> None:
        try:
            self._queue.put_nowait(logs)
        except queue.Full:
            self.dropped += 1

    def close(self) -> None:
        """Idempotent; the frames end."""
        self._closed.set()
        self._leave()

    def frames(self) -> Iterator[str]:
        yield ": connected\n\n"
        waited = 0.0
        while not self._closed.is_set():
            step = min(0.05, self.heartbeat)
            try:
                logs = self._queue.get(timeout=step)
            except queue.Empty:
                waited += step
                if waited >= self.heartbeat:
                    waited = 0.0
                    yield ": heartbeat\n\n"
                continue
            waited = 0.0
            yield f"event: logs\ndata: {json.dumps({'logs': logs}, ensure_ascii=False, separators=(',', ':'))}\n\n"
