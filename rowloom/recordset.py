"""Materialised records: computed once, read again as often as needed, in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

from .field import Header
from .operators.builders import Into
from .stream import Aux, RecordStream


class RecordSet:
    """Persisted in memory and on disk, recomputed from its lineage if an executor is lost. Equality and printing collect rows."""

    def __init__(self, stream: RecordStream):
        self._stream = stream._with(stream.df.persist())

    @staticmethod
    def collector(configure: Callable[[Into], None]) -> Callable[[Aux], RecordSet]:
        """``RecordSet.collector(config)(aux)``: map to records and materialise; an empty stream gives an empty set with its header."""
        return lambda aux: aux.map_to_record(configure).to_record_set()

    @property
    def header(self) -> Header:
        return self._stream.header

    def stream(self) -> RecordStream:
        return self._stream

    def size(self) -> int:
        return self._stream.count()

    def is_empty(self) -> bool:
        return self._stream.df.isEmpty()

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self._stream._rows().collect()]

    def release(self) -> None:
        self._stream.df.unpersist()

    def __eq__(self, other) -> bool:
        return isinstance(other, RecordSet) and self.header == other.header and self.rows() == other.rows()

    def __hash__(self) -> int:
        """Of header and rows, which are collected."""
        return hash((tuple(f.column for f in self.header), tuple(map(repr, self.rows()))))

    def __str__(self) -> str:
        names = [f.name for f in self.header]
        cells = [names, *[["null" if v is None else str(v) for v in r] for r in self.rows()]]
        widths = [max(len(row[i]) for row in cells) for i in range(len(names))]
        return "\n".join(" | ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip() for row in cells)
