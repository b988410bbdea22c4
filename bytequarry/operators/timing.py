"""Durations of event tracks: their events by a table of forms, a clock that takes them in, and the loop arithmetic around it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps in a quarter note.
RESOLUTION = 480


class Form(NamedTuple):
    """How the events of a range of codes are laid out: bytes before their values, whether a gate and a step follow, and where a bit makes each of them 16 bits wide (byte, bit)."""

    first: int
    last: int
    head: int
    gate: tuple[int, int] | None = None
    step: tuple[int, int] | None = None


# Fixed values of the events: a bit that is never set stands for values that are always 8 bits wide.
FORMS = (
    Form(0x00, 0x3F, 3, gate=(0, 0x20), step=(0, 0x10)),
    Form(0x82, 0x82, 2, step=(1, 0x80)),
    Form(0x81, 0x81, 4), Form(0x84, 0x84, 4),
    Form(0xA0, 0xAF, 3, step=(0, 0x100)),
    Form(0xB0, 0xBF, 3, step=(1, 0x80)), Form(0xC0, 0xEF, 2, step=(1, 0x80)),
)
AGAIN, LOOP, END, TEMPO = 0x81, 0x82, 0x83, 0x84
# What the events that lengthen the next gate, or the time, add.
LONGER_GATE = {0x88: 0x200, 0x89: 0x800, 0x8A: 0x1000, 0x8B: 0x2000}
LONGER_TIME = {0x8C: 0x100, 0x8D: 0x200, 0x8E: 0x800, 0x8F: 0x1000}
_FORM_OF = {code: form for form in FORMS for code in range(form.first, form.last + 1)}


class Event(NamedTuple):
    code: int
    at: int
    gate: int
    step: int


def events(data: bytes, at: int) -> Iterator[Event]:
    """The events from a place on, up to the end mark or the data's end."""
    while at < len(data) and data[at] != END:
        code, begin = data[at], at
        form = _FORM_OF.get(code)
        at += form.head if form else 1
        values = []
        for wide in (form.gate, form.step) if form else ():
            size = 0 if wide is None else 2 if data[begin + wide[0]] & wide[1] else 1
            if at + size > len(data):
                raise ValueError("event out of the data")
            values.append(int.from_bytes(data[at : at + size], "big"))
            at += size
        yield Event(code, begin, *(values or (0, 0)))


@dataclass
class Clock:
    """Time so far in tempo units (tempo: thousands of microseconds a quarter note), where the loop begins, and how long the last note sounds on."""

    tempo: int
    steps: int = 0
    before_loop: int = -1
    loops: int = 0
    sounding: int = 0
    longer: int = 0
    parts: dict = field(default_factory=dict)

    @property
    def tail(self) -> int:
        return 0 if self.loops else self.sounding + self.longer

    def take(self, data: bytes, e: Event, inside: tuple[int, ...]) -> bool:
        """Take an event in; whether it is one that a repeated part counts."""
        unit = self.tempo * 1000
        if e.code in LONGER_GATE:
            self.longer += LONGER_GATE[e.code] * unit
            return False
        if e.code in LONGER_TIME:
            self.steps += LONGER_TIME[e.code] * unit
            return False
        if e.code == AGAIN:
            self.steps += self.part(data, int.from_bytes(data[e.at + 1 : e.at + 3], "big"), data[e.at + 3], inside)
        elif e.code == TEMPO:
            self.tempo = int.from_bytes(data[e.at + 1 : e.at + 3], "big")
        elif e.code == LOOP:
            self.loops += 1
            if self.loops == 1:
                self.before_loop, self.steps = self.steps, self.steps + e.step * unit
        else:
            self.steps += e.step * unit
            if e.code < 0x40:
                self.sounding, self.longer = e.gate * unit + self.longer, 0
        return True

    def part(self, data: bytes, at: int, count: int, inside: tuple[int, ...]) -> int:
        """The time of `count` events that are played again, at the tempo of now; a part that plays itself has none. Each part is worked out once for a tempo."""
        key = (at, count, self.tempo)
        if key not in self.parts:
            if at in inside:
                raise ValueError("a part that plays itself")
            own = Clock(self.tempo, parts=self.parts)
            for e in events(data, at) if count else ():
                count -= own.take(data, e, (*inside, at))
                if not count:
                    break
            self.parts[key] = own.steps
        return self.parts[key]


def walk(data: bytes, tempo: int, at: int = 12) -> Clock:
    """The clock after all events of a track, however many."""
    clock = Clock(tempo)
    for e in events(data, at):
        clock.take(data, e, ())
    return clock


def track_seconds(data: bytes, loops: int = 2) -> tuple[float, bool]:
    """(seconds, whether the track loops): the loop played `loops` times, or one second of tail. The little-endian word at 8 is the tempo."""
    got = walk(data, int.from_bytes(data[8:12], "little"))
    unit = RESOLUTION * 1e6
    whole, before = (got.steps + got.tail) / unit, got.before_loop / unit
    return (loops * whole - (loops - 1) * before, True) if got.before_loop >= 0 else (whole + 1.0, False)


def durations(tracks: DataFrame, key: str, content: str, loops: int = 2) -> DataFrame:
    """(key, seconds, looped, error) of event tracks, one row each."""
    kind = tracks.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for data in pdf[content]:
                try:
                    rows.append((*track_seconds(bytes(data), loops), None))
                except (ValueError, IndexError, TypeError) as e:
                    rows.append((None, None, str(e)))
            yield pd.DataFrame({key: pdf[key], "seconds": [r[0] for r in rows], "looped": [r[1] for r in rows], "error": [r[2] for r in rows]})

    return tracks.select(key, content).mapInPandas(run, f"{key} {kind}, seconds double, looped boolean, error string")


def looped_time(time: Column, before: Column, loops: int) -> Column:
    """Seconds of a looped track; without a loop one second more."""
    return F.when(before >= 0, time * loops - before * (loops - 1)).otherwise(time + 1.0)
