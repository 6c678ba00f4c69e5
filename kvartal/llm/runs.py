"""Files of a store that is kept by key: sorted runs of a bucket, its filter and its state, in any shared file system.

A run is a parquet file sorted by its first column, cut into small row groups,
so a lookup reads only the groups into whose range a key falls.  Runs of a
bucket are merged by levels, ``FAN`` of one level into one of the next.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

GROUP_ROWS = 8192
FAN = 8


def open_root(root: str):
    """(file system, path) of a folder that a URI names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))


class Folder:
    """Reads and writes files below a root; names are unique, so an attempt that was given up leaves only files that nothing names."""

    def __init__(self, root: str):
        self.fs, self.base = open_root(root)

    def new_name(self, kind: str, tag: str, ending: str) -> str:
        return f"{kind}/{tag}-{uuid.uuid4().hex[:12]}.{ending}"

    def put(self, name: str, data: bytes) -> None:
        self.fs.create_dir(f"{self.base}/{name}".rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(f"{self.base}/{name}") as out:
            out.write(data)

    def get(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.base}/{name}") as source:
            return source.read()

    def drop(self, name: str) -> None:
        try:
            self.fs.delete_file(f"{self.base}/{name}")
        except FileNotFoundError:
            pass

    def commit(self, name: str, data: bytes) -> None:
        """Put a file that appears whole or not at all."""
        self.put(name + ".part", data)
        self.fs.move(f"{self.base}/{name}.part", f"{self.base}/{name}")

    def names(self, kind: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.base}/{kind}", allow_not_found=True))
        return sorted(f"{kind}/{x.base_name}" for x in found if x.is_file and not x.base_name.endswith(".part"))

    def write_run(self, name: str, run: pa.Table) -> None:
        self.fs.create_dir(f"{self.base}/{name}".rpartition("/")[0], recursive=True)
        pq.write_table(run, f"{self.base}/{name}", filesystem=self.fs, row_group_size=GROUP_ROWS, use_dictionary=False, compression="zstd", write_statistics=[run.column_names[0]])

    def read_run(self, name: str, columns: list[str] | None = None) -> pa.Table:
        return pq.read_table(f"{self.base}/{name}", filesystem=self.fs, columns=columns, partitioning=None)

    def lookup(self, name: str, keys: np.ndarray) -> tuple[pa.Table | None, int]:
        """Rows of a run whose first column is among the sorted ``keys``, and how many rows were read for that."""
        with self.fs.open_input_file(f"{self.base}/{name}") as source:
            run = pq.ParquetFile(source)
            ranges = [run.metadata.row_group(g).column(0).statistics for g in range(run.metadata.num_row_groups)]
            low = np.searchsorted(keys, [s.min for s in ranges], "left")
            high = np.searchsorted(keys, [s.max for s in ranges], "right")
            groups = np.flatnonzero(high > low).tolist()
            if not groups:
                return None, 0
            rows = run.read_row_groups(groups)
        return rows.filter(pa.array(among(rows.column(0).to_numpy(), keys))), rows.num_rows


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values


class Bucket:
    """State of one bucket: runs by kind as [level, name, rows], its filter, and names that the next write may delete."""

    def __init__(self, folder: Folder, name: str | None):
        self.folder = folder
        self.state = json.loads(folder.get(name)) if name else {"runs": {}, "filter": None, "size": 0, "keys": 0, "garbage": []}
        self.name = name

    def lookup(self, kind: str, keys: np.ndarray) -> tuple[list[pa.Table], int]:
        found, read = [], 0
        if len(keys):
            for _, name, _ in self.state["runs"].get(kind, []):
                rows, n = self.folder.lookup(name, keys)
                read += n
                if rows is not None and rows.num_rows:
                    found.append(rows)
        return found, read

    def everything(self, kind: str, columns: list[str] | None = None) -> list[pa.Table]:
        return [self.folder.read_run(name, columns) for _, name, _ in self.state["runs"].get(kind, [])]

    def add(self, kind: str, tag: str, fresh: pa.Table, fold, all_of_it: bool = False) -> pa.Table | None:
        """Add a run, merging levels that became full (or ``all_of_it``); ``fold`` sorts and folds a table.  Returns the run if it was merged."""
        runs, parts, level, merged = self.state["runs"].setdefault(kind, []), [fresh] if fresh.num_rows else [], 0, False
        while all_of_it or sum(r[0] == level for r in runs) >= FAN - 1 + (not parts):
            take = [r for r in runs if all_of_it or r[0] == level]
            parts += [self.folder.read_run(name) for _, name, _ in take]
            self.state["garbage"] += [name for _, name, _ in take]
            runs[:] = [r for r in runs if r not in take]
            merged, level = True, max([level, *(r[0] for r in take)]) + (not all_of_it)
            if all_of_it or not parts:
                break
        if not parts:
            return None
        run = fold(pa.concat_tables(parts))
        if not run.num_rows:
            return None
        name = self.folder.new_name(kind, tag, "parquet")
        self.folder.write_run(name, run)
        runs.append([level, name, run.num_rows])
        return run if merged else None

    def save(self, tag: str) -> str:
        name = self.folder.new_name("state", tag, "json")
        if self.name:
            self.state["garbage"].append(self.name)
        self.folder.put(name, json.dumps(self.state).encode())
        return name

    def clean(self) -> None:
        """Delete what the last committed write replaced."""
        for name in self.state["garbage"]:
            self.folder.drop(name)
        self.state["garbage"] = []
