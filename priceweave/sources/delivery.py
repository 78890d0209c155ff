"""Deliveries: a folder of CSV or JSON-lines files with a report, that appears as a whole or not at all.

Each task writes a file of its own beside the destination. The commit keeps the files that tasks have told of, writes the
report and puts the folder in the destination's place; until then the old delivery stays, and if anything fails the new
files go. A writer that died between the two renames is settled by the next one, or by settle().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .paged import _system

REPORT = "report.json"


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    bytes: int


def _there(system: fs.FileSystem, at: str) -> bool:
    return system.get_file_info(at).type != fs.FileType.NotFound


def settle(path: str) -> None:
    """Bring back the delivery that a dead writer had set aside, and remove what is left of others."""
    system, at = _system(path)
    at = at.rstrip("/")
    parent, name = at.rsplit("/", 1)
    if not _there(system, parent):
        return
    for info in system.get_file_info(fs.FileSelector(parent)):
        if info.base_name.startswith(f"{name}.old-"):
            if _there(system, at):
                system.delete_dir(info.path)
            else:
                system.move(info.path, at)


class DeliveryWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        if options.get("format", "csv") not in ("csv", "json"):
            raise ValueError(f"a delivery is csv or json, not {options['format']!r}")
        self.path, self.kind, self.overwrite = options["path"].rstrip("/"), options.get("format", "csv"), overwrite
        self.delimiter, self.token = options.get("delimiter", ","), uuid.uuid4().hex

    def _new(self) -> tuple[fs.FileSystem, str, str]:
        system, at = _system(self.path)
        return system, at, f"{at}.new-{self.token}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, new = self._new()
        system.create_dir(new, recursive=True)
        # a task that is run again writes another file
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.{self.kind}"
        rows = 0
        with system.open_output_stream(f"{new}/{name}") as out:
            header = True
            for batch in iterator:
                if self.kind == "csv":
                    csv.write_csv(batch, out, csv.WriteOptions(include_header=header, delimiter=self.delimiter, quoting_style="needed"))
                else:
                    for row in batch.to_pylist():
                        out.write(json.dumps(row, ensure_ascii=False, default=str).encode() + b"\n")
                header = False
                rows += batch.num_rows
            size = out.tell()
        return Written(name, rows, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, at, new = self._new()
        settle(self.path)
        if _there(system, at) and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} is there already")
        system.create_dir(new, recursive=True)
        told = [m for m in messages if m is not None]
        kept = {m.name for m in told if m.rows}
        for info in system.get_file_info(fs.FileSelector(new)):
            if info.base_name not in kept:
                system.delete_file(info.path)  # empty ones, and those of tasks that were run again
        report = {"files": sorted(kept), "rows": sum(m.rows for m in told), "bytes": sum(m.bytes for m in told if m.rows)}
        with system.open_output_stream(f"{new}/{REPORT}") as out:
            out.write(json.dumps(report, indent=1).encode())
        old = f"{at}.old-{self.token}"
        if _there(system, at):
            system.move(at, old)
        system.move(new, at)
        if _there(system, old):
            system.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, new = self._new()
        if _there(system, new):
            system.delete_dir(new)


class DeliverySource(DataSource):
    """Options: path; format (csv or json); delimiter of csv."""

    @classmethod
    def name(cls):
        return "delivery"

    def writer(self, schema, overwrite):
        return DeliveryWriter(dict(self.options), overwrite)


def report_of(path: str) -> dict:
    system, at = _system(path)
    with system.open_input_stream(f"{at.rstrip('/')}/{REPORT}") as f:
        return json.loads(f.read())
