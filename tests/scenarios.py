"""Event tables with known answers: a fleet of weather buoys that upload readings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from itertools import cycle, islice

START = datetime(2025, 2, 17, 5, 0, tzinfo=UTC)
END = START + timedelta(minutes=30)
SCHEMA = "log_group string, log_stream string, ts timestamp, message string"

JOURNAL_TRACE = "\n".join(
    [
        "Traceback (most recent call last):",
        '  File "/opt/buoy/uplink.py", line 311, in flush',
        "    segment = journal.open_segment(day)",
        '  File "/opt/buoy/journal.py", line 77, in open_segment',
        "    self._lock(day)",
        '  File "/opt/buoy/journal.py", line 140, in _lock',
        "SegmentLockFailure: day file is held by another writer",
    ]
)
RELAY_TRACE = "\n".join(
    [
        "Traceback (most recent call last):",
        '  File "/opt/buoy/modem.py", line 58, in dial',
        "    self.port.write(frame)",
        "CarrierFault: antenna below 9 dB",
        "",
        "During handling of the above exception, another exception occurred:",
        "",
        "Traceback (most recent call last):",
        '  File "/opt/buoy/relay.py", line 21, in forward',
        "    modem.dial(station)",
        "RelayFailure: station 4 unreachable",
    ]
)


def event(at: datetime, message: str, group: str = "/app/x", stream: str | None = "i-1"):
    return (group, stream, at, message)


@dataclass(frozen=True)
class Burst:
    """``count`` events, ``step`` seconds apart, whose text is made of their number."""

    count: int
    text: Callable[[int], str]
    first: float = 0
    step: float = 1

    def rows(self):
        return [event(START + timedelta(seconds=self.first + i * self.step), self.text(i)) for i in range(self.count)]


SENSORS = ("wave", "wind", "salt")


def locked(count: int, step: float = 4):
    """Uploads of three sensors in turn, all stopped by the same lock."""
    sensor = list(islice(cycle(SENSORS), count))
    return Burst(
        count,
        lambda i: f"buoy B{40000 + 7 * i} seq '{i}' ERROR PUT /readings/{sensor[i]} status=507\n{JOURNAL_TRACE}",
        step=step,
    ).rows()


def drizzle():
    """Many warnings about one sensor, and few relay failures shortly before the end."""
    dull = Burst(170, lambda i: f"WARNING PUT /readings/fog status=422 RangeError: visibility of {10000 + i} m", step=9)
    lost = Burst(25, lambda i: f"ERROR GET /relays/{i}/state status=599\n{RELAY_TRACE}", first=1500, step=8)
    return dull.rows() + lost.rows()
