"""Immutable sorted runs of 16-byte identifiers, laid out by hash prefix and searched in place.

A run is a folder of cells. A cell holds, per topic, the sorted identifiers of one range
of hash prefixes with four numbers each; how many cells a run has depends on its size,
so a cell stays a few megabytes. Tasks open the cells of the prefixes they were given,
through the shared storage's own client, and nothing of an index is ever shuffled: what
a batch costs doesn't grow with the index, but for the cells that it touches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of the hash prefix; a run has at most 2 to this many cells.
PREFIX_BITS = 20
#: Identifiers that a cell is meant to hold.
CELL_IDS = 32_768
#: Runs are merged when so many of like size stand at the end.
FAN = 3

VALUES = {"t": np.int64, "b": np.int64, "p": np.int32, "o": np.int64}
ARRAYS = ("ids", "h", *VALUES)
RUN_ARROW = pa.schema([("cell", pa.int32()), ("topic", pa.string()), *((c, pa.binary()) for c in ARRAYS)])
RUN = "cell int, topic string, " + ", ".join(f"{c} binary" for c in ARRAYS)


def prefix_of(identifier: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(identifier), 64 - PREFIX_BITS).cast("int")


def cell_of(prefix: Column, bits: int) -> Column:
    return F.shiftright(prefix, PREFIX_BITS - bits)


def text_id(*columns: Column) -> Column:
    """Sixteen bytes (MD5) for an identifier of any text, or of several parts; none of them may be null."""
    return F.unhex(F.md5(F.concat_ws("\0", *(c.cast("string") for c in columns))))


def as_ids(column: pa.Array) -> np.ndarray:
    """Sixteen-byte identifiers without a copy."""
    if not len(column):
        return np.empty(0, "S16")
    offsets = np.frombuffer(column.buffers()[1], np.int32, count=len(column) + 1, offset=4 * column.offset)
    return np.frombuffer(column.buffers()[2], "S16", count=len(column), offset=int(offsets[0]))


def id_array(ids: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(ids)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def best_first(ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by identifier and preference; the second array marks the first of each identifier."""
    order = np.lexsort((*reversed(keys), ids))
    sorted_ids = ids[order]
    first = np.ones(len(order), bool)
    first[1:] = sorted_ids[1:] != sorted_ids[:-1]
    return order, first


def groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows with equal keys that stand together, as one table each."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(k).dictionary_encode(null_encoding="encode") for k in keys]
        index = np.stack([c.indices.to_numpy(zero_copy_only=False) for c in codes])
        edges = [0, *(np.flatnonzero((index[:, 1:] != index[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c.dictionary[int(i)].as_py() for c, i in zip(codes, index[:, a]))
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def run_row(cell: int, topic: str, ids: np.ndarray, h: np.ndarray, values: Sequence[np.ndarray]) -> dict:
    arrays = {c: v.astype(k).tobytes() for (c, k), v in zip(VALUES.items(), values)}
    return {"cell": cell, "topic": topic, "ids": ids.tobytes(), "h": h.astype(np.int32).tobytes(), **arrays}


def unpacked(row: dict) -> tuple[np.ndarray, ...]:
    """ids, h, t, b, p, o of a run's row."""
    return (np.frombuffer(row["ids"], "S16"), np.frombuffer(row["h"], np.int32), *(np.frombuffer(row[c], k) for c, k in VALUES.items()))


class Reader:
    """Opens cells of runs from within a task."""

    def __init__(self, root: str, runs: Sequence[dict]):
        self.root, self.runs = root, list(runs)  # the newest run comes last
        self._fs = None
        self._held: dict[int, tuple[int, dict[str, tuple[np.ndarray, ...]]]] = {}

    def _cell(self, k: int, cell: int) -> dict[str, tuple[np.ndarray, ...]]:
        """The cell of a run by topic; the last one of each run is held."""
        if self._held.get(k, (None,))[0] == cell:
            return self._held[k][1]
        import pyarrow.parquet as pq
        from pyarrow import fs

        if self._fs is None:
            self._fs, self._at = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", self.root)))
        found = self._fs.get_file_info(fs.FileSelector(f"{self._at}/{self.runs[k]['path']}/cell={cell}", allow_not_found=True))
        by_topic = {}
        for f in found:
            if f.path.endswith(".parquet"):
                for row in pq.read_table(f.path, filesystem=self._fs, partitioning=None).to_pylist():
                    by_topic[row["topic"]] = unpacked(row)
        self._held[k] = cell, by_topic
        return by_topic

    def lookup(self, topic: str, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Binary search in each run, newest first: which identifiers are known, and their numbers in force."""
        known = np.zeros(len(ids), bool)
        found = [np.zeros(len(ids), np.int64) for _ in VALUES]
        for k in range(len(self.runs) - 1, -1, -1):
            cells = h >> (PREFIX_BITS - self.runs[k]["bits"])
            for cell in np.unique(cells[~known]):
                run_ids, _, *values = self._cell(k, int(cell)).get(topic, (np.empty(0, "S16"), None))
                open_ = np.flatnonzero(~known & (cells == cell))
                if not len(run_ids):
                    continue
                at = np.minimum(np.searchsorted(run_ids, ids[open_]), len(run_ids) - 1)
                hit = run_ids[at] == ids[open_]
                known[open_[hit]] = True
                for out, v in zip(found, values):
                    out[open_[hit]] = v[at[hit]]
        return known, found

    def merged(self, cell: int, bits: int) -> dict[str, tuple[np.ndarray, ...]]:
        """All entries of a cell (of ``bits``) by topic, the newest of each identifier, sorted."""
        parts: dict[str, list[tuple[int, tuple[np.ndarray, ...]]]] = {}
        for k, run in enumerate(self.runs):
            more = run["bits"] - bits
            for c in range(cell << more, (cell + 1) << more) if more >= 0 else [cell >> -more]:
                for topic, arrays in self._cell(k, c).items():
                    if more < 0:
                        mine = arrays[1] >> (PREFIX_BITS - bits) == cell
                        arrays = tuple(a[mine] for a in arrays)
                    if len(arrays[0]):
                        parts.setdefault(topic, []).append((len(self.runs) - k, arrays))
        out = {}
        for topic, pieces in sorted(parts.items()):
            columns = [np.concatenate([a[c] for _, a in pieces]) for c in range(len(ARRAYS))]
            order, first = best_first(columns[0], np.concatenate([np.full(len(a[0]), age) for age, a in pieces]))
            out[topic] = tuple(c[order[first]] for c in columns)
        return out


class RunSet:
    """The runs of an index, as plain data for its owner's manifest: `runs` (path, bits, rows) and `retired`.

    Nothing takes effect until the owner publishes ``state``: an owner that dies before
    leaves the former runs in force. Runs replaced by a merge are deleted one state later.
    """

    def __init__(self, spark: SparkSession, folder: str, state: dict | None = None, fan: int = FAN, per_cell: int = CELL_IDS, least_bits: int = 0):
        self.spark, self.folder, self.fan, self.per_cell, self.least_bits = spark, folder.rstrip("/"), max(2, fan), per_cell, least_bits
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        self.runs, self.retired = list((state or {}).get("runs", [])), list((state or {}).get("retired", []))

    @property
    def state(self) -> dict:
        return {"runs": self.runs, "retired": self.retired}

    def bits_for(self, rows: int) -> int:
        """Bits of the cells of a run of so many identifiers."""
        return min(PREFIX_BITS, max(self.least_bits, math.ceil(math.log2(max(rows, 1) / self.per_cell))))

    def reader(self) -> Reader:
        return Reader(self.root, self.runs)

    def look_up(self, rows: DataFrame, identifier: str = "_id", value: str | None = None) -> DataFrame:
        """``rows`` with `_known` and, named ``value``, the number t in force; only ``rows`` are shuffled, so that each cell of the largest run is opened once."""
        kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
        schema = f"{kinds}, _known boolean" + (f", `{value}` bigint" if value else "")
        if not self.runs:
            return rows.withColumns({"_known": F.lit(False)} | ({value: F.lit(None).cast("bigint")} if value else {}))
        reader = self.reader()

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = batch.drop_columns(["_h"])
                known, found = reader.lookup("", as_ids(batch.column(identifier)), batch.column("_h").to_numpy())
                columns = [*keep.columns, pa.array(known)] + ([pa.array(found[0], mask=~known)] if value else [])
                yield pa.RecordBatch.from_arrays(columns, names=[*keep.schema.names, "_known"] + ([value] if value else []))

        placed = rows.withColumn("_h", prefix_of(F.col(identifier)))
        clustered = placed.repartition(cell_of(F.col("_h"), max(r["bits"] for r in self.runs))).sortWithinPartitions("_h")
        return clustered.mapInArrow(search, schema)

    def add(self, path: str, rows: int, bits: int) -> None:
        """Take a run written at ``path`` (below the folder), then merge where runs of like size stand together."""
        if rows:
            self.runs.append({"path": path, "rows": rows, "bits": bits})
        while (n := self._due()) >= self.fan:
            self._merge(n, f"merged/{path.replace('/', '-')}-{n}")

    def add_ids(self, rows: DataFrame, path: str, count: int, identifier: Column | str = "_id", t: Column | None = None) -> None:
        """Write different identifiers as a run, with t as their number."""
        if not count:
            return
        bits = self.bits_for(count)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (cell,), table in groups(batches, ["cell"]):
                table = table.combine_chunks()
                ids = as_ids(table.column("_id").chunk(0))
                order = np.argsort(ids, kind="stable")
                none = np.zeros(len(ids), np.int64)
                row = run_row(cell, "", ids[order], table.column("_h").to_numpy()[order], (table.column("_t").to_numpy()[order], none, none, none))
                yield from pa.Table.from_pylist([row], RUN_ARROW).to_batches()

        placed = rows.select((F.col(identifier) if isinstance(identifier, str) else identifier).alias("_id"), (F.lit(0) if t is None else t).cast("bigint").alias("_t")).withColumn("_h", prefix_of(F.col("_id")))
        placed = placed.withColumn("cell", cell_of(F.col("_h"), bits)).repartition("cell").sortWithinPartitions("cell")
        placed.mapInArrow(pack, RUN).write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/{path}")
        self.add(path, count, bits)

    def _due(self) -> int:
        """How many runs at the end are no larger than those after them together."""
        n, newer = 0, 0
        for run in reversed(self.runs):
            if n and run["rows"] > newer:
                break
            newer += run["rows"]
            n += 1
        return n

    def _merge(self, n: int, path: str) -> None:
        old = self.runs[-n:]
        total = sum(r["rows"] for r in old)
        bits = self.bits_for(total)
        reader = Reader(self.root, old)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell in batch.column(0).to_pylist():
                    rows = [run_row(cell, topic, ids, h, values) for topic, (ids, h, *values) in reader.merged(cell, bits).items()]
                    if rows:
                        yield from pa.Table.from_pylist(rows, RUN_ARROW).to_batches()

        self.cells(bits).mapInArrow(merge, RUN).write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/{path}")
        self.runs[-n:] = [{"path": path, "rows": total, "bits": bits}]
        self.retired += [r["path"] for r in old]

    def cells(self, bits: int) -> DataFrame:
        tasks = min(1 << bits, 4 * self.spark.sparkContext.defaultParallelism)
        return self.spark.range(0, 1 << bits, 1, max(1, tasks)).select(F.col("id").cast("int").alias("cell"))

    def entries(self) -> DataFrame:
        """All entries in force (topic, id and the four numbers), cell by cell and without a shuffle."""
        schema = "topic string, id binary, t bigint, b bigint, p int, o bigint"
        if not self.runs:
            return self.spark.createDataFrame([], schema)
        reader, bits = self.reader(), max(r["bits"] for r in self.runs)

        def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell in batch.column(0).to_pylist():
                    for topic, (ids, _, t, b, p, o) in reader.merged(cell, bits).items():
                        yield pa.RecordBatch.from_arrays([pa.array([topic] * len(ids)), id_array(ids), *map(pa.array, (t, b, p, o))], names=["topic", "id", "t", "b", "p", "o"])

        return self.cells(bits).mapInArrow(unfold, schema)
