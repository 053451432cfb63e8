"""A topic kept as a folder of JSON-lines segments; each segment appears whole or not at all."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FileTopic:
    """Segments of at most ``segment_rows`` records, numbered in order of arrival."""

    def __init__(self, folder: str, segment_rows: int = 10_000):
        self.folder, self.segment_rows = Path(folder), segment_rows
        self.folder.mkdir(parents=True, exist_ok=True)

    def segments(self) -> list[Path]:
        return sorted(self.folder.glob("segment-*.json"))

    def _put(self, lines: list[str]) -> None:
        last = self.segments()
        number = int(last[-1].stem.rpartition("-")[2]) + 1 if last else 0
        side = self.folder / f".{uuid.uuid4().hex}"
        side.write_text("\n".join(lines) + "\n")
        os.replace(side, self.folder / f"segment-{number:08d}.json")

    def produce(self, records: Iterable[dict]) -> int:
        """Append records; returns how many."""
        lines, total = [], 0
        for record in records:
            lines.append(json.dumps(record, default=str))
            total += 1
            if len(lines) == self.segment_rows:
                self._put(lines)
                lines = []
        if lines:
            self._put(lines)
        return total

    def copy_in(self, path: str) -> None:
        """Take a finished JSON-lines file as one segment."""
        self._put([line for line in Path(path).read_text().splitlines() if line.strip()])

    def consume(self) -> Iterator[dict]:
        """All records in order; blank lines are skipped."""
        for segment in self.segments():
            with segment.open() as lines:
                for line in lines:
                    if line.strip():
                        yield json.loads(line)

    def clear(self) -> None:
        shutil.rmtree(self.folder)
        self.folder.mkdir(parents=True)


def publish(df: DataFrame, folder: str, segments: int = 3, number: int = 0) -> None:
    """Rows as JSON lines in ``segments`` files of a folder on shared storage, written by the executors; readers see finished files only."""
    lines = df.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}).alias("value"))
    lines.repartition(segments).write.mode("append" if number else "overwrite").text(folder)
