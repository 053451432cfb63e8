"""One wide row per entity from events of hundreds of types."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questlake.functions.scalars import micros
from questlake.operators.id_runs import RunSet, text_id
from questlake.workspace import Folder, Manifest, materialise


class TooManyTypes(ValueError):
    """The type dictionary is larger than the documented bound."""


def type_dictionary(events: DataFrame, type_col: str, max_types: int = 2000) -> list[str]:
    """All type names in order; the place in the list is the index. Beyond the bound it fails, nothing is dropped."""
    names = [r[0] for r in events.select(type_col).where(F.col(type_col).isNotNull()).distinct().limit(max_types + 1).collect()]
    if len(names) > max_types:
        raise TooManyTypes(f"more than {max_types} types in {type_col}")
    return sorted(names)


def _coded(events: DataFrame, types: Sequence[str], entity: str, type_col: str, time: str, totals: Sequence[str], event_id: str | None) -> DataFrame:
    """Entity `_u`, type index `_i`, time `_t`, totals `_s…` and, with ``event_id``, the identifier `_id`, each row of a (entity, type, id) once."""
    index = events.sparkSession.createDataFrame(list(enumerate(types)), "_i int, _name string")
    rows = events.where(F.col(entity).isNotNull()).select(
        F.col(entity).alias("_u"), F.col(type_col).alias("_name"), micros(F.col(time)).alias("_t"), *(F.col(c).cast("bigint").alias(f"_s{k}") for k, c in enumerate(totals)),
        *([F.col(event_id).alias("_id")] if event_id else []),
    )
    rows = rows.join(F.broadcast(index), "_name", "left")  # at most max_types rows
    # a type that isn't in the dictionary stops the run: nothing falls out unseen
    unlisted = F.raise_error(F.concat(F.lit("type not in the dictionary: "), F.coalesce("_name", F.lit("null")))).cast("int")
    sums = [f"_s{k}" for k in range(len(totals))]
    rows = rows.select("_u", F.coalesce("_i", unlisted).alias("_i"), "_t", *sums, *(["_id"] if event_id else []))
    if not event_id:
        return rows
    key = F.when(F.col("_id").isNotNull(), text_id(F.col("_u"), F.col("_i"), F.col("_id")))
    once = rows.where("_id IS NOT NULL").groupBy("_u", "_i", key.alias("_id")).agg(F.max("_t").alias("_t"), *(F.max(s).alias(s) for s in sums))
    return once.unionByName(rows.where("_id IS NULL").withColumn("_id", F.lit(None).cast("binary")))


def _vectors(coded: DataFrame) -> DataFrame:
    sums = [c for c in coded.columns if c.startswith("_s")]
    return coded.groupBy("_u", "_i").agg(F.count("*").alias("_n"), F.max("_t").alias("_t"), *(F.sum(s).alias(s) for s in sums))


def type_vectors(events: DataFrame, types: Sequence[str], entity: str, type_col: str, time: str, totals: Sequence[str], event_id: str | None = None) -> DataFrame:
    """Sparse vectors: one row per entity and type index with count, latest time and totals.

    Rows with one event_id, entity and type that landed more than once count once (with
    ``event_id``). Counts, sums and maxima combine before each shuffle, so an entity
    with a third of the rows costs no more than its types. Vectors of several parts can
    be unioned and put through ``merge_vectors`` if no event is in two of them;
    ``FeatureStore`` sees to that. A type not in ``types`` is an error.
    """
    return _vectors(_coded(events, types, entity, type_col, time, totals, event_id))


def merge_vectors(vectors: DataFrame) -> DataFrame:
    """Combine sparse vectors of several parts that have no event in common."""
    sums = [c for c in vectors.columns if c.startswith("_s")]
    return vectors.groupBy("_u", "_i").agg(F.sum("_n").alias("_n"), F.max("_t").alias("_t"), *(F.sum(s).alias(s) for s in sums))


class FeatureStore:
    """Sparse vectors per entity, maintained part by part (days, files, batches of landing).

    Each part adds vectors of its own; the table is their merge. An index of the
    (entity, type, event_id) seen (see ``RunSet``) keeps an event that lands in several
    parts from counting again: the first part's copy counts, within a part the largest
    time and values of the copies. The type dictionary only grows: new names go to its
    end, so indices stay. A part whose number was published is skipped; numbers must
    rise. Rows without an event_id always count.
    """

    def __init__(self, spark: SparkSession, folder: str, totals: Sequence[str], kind: str = "bigint", types: Sequence[str] = (), max_types: int = 2000):
        self.spark, self.folder, self.totals, self.max_types = spark, folder.rstrip("/"), list(totals), max_types
        self.files, self.first_types = Folder(spark, folder), list(types)
        self.manifest = Manifest(self.files)
        self.schema = f"_u {kind}, _i int, _n bigint, _t bigint" + "".join(f", _s{k} bigint" for k in range(len(self.totals)))

    @property
    def types(self) -> list[str]:
        return self.manifest.load()[1].get("types", self.first_types)

    def add(self, events: DataFrame, part_no: int, entity: str, type_col: str, time: str, event_id: str) -> None:
        number, state = self.manifest.load()
        if state and part_no <= state["part"]:
            return
        known = state.get("types", self.first_types)
        types = [*known, *(t for t in type_dictionary(events.where(F.col(entity).isNotNull()), type_col, self.max_types) if t not in set(known))]
        if len(types) > self.max_types:
            raise TooManyTypes(f"more than {self.max_types} types in {type_col}")
        ids = RunSet(self.spark, self.folder, state.get("ids"))
        coded = _coded(events, types, entity, type_col, time, self.totals, event_id)
        rows = ids.look_up(coded.where("_id IS NOT NULL")).where("NOT _known").drop("_known").unionByName(coded.where("_id IS NULL"))
        novel = materialise(rows, f"{self.folder}/novel/part={part_no}")
        _vectors(novel).write.mode("overwrite").parquet(f"{self.folder}/vectors/part={part_no}")
        identified = novel.where("_id IS NOT NULL").select("_id")
        ids.retired, gone = [], ids.retired
        ids.add_ids(identified, f"ids/part={part_no}", identified.count())
        self.manifest.publish(number + 1, {"types": types, "ids": ids.state, "part": part_no})
        for path in [*gone, f"novel/part={part_no}"]:
            self.files.delete(path)

    def vectors(self) -> DataFrame:
        """One row per entity and type index over all parts."""
        _, state = self.manifest.load()
        if not state:
            return self.spark.createDataFrame([], self.schema)
        parts = self.spark.read.schema(self.schema + ", part int").parquet(f"{self.folder}/vectors")
        return merge_vectors(parts.where(F.col("part") <= state["part"]).drop("part"))

    def named(self, entity: str) -> DataFrame:
        """The long form: entity, type name, count, latest time and totals."""
        names = self.spark.createDataFrame(list(enumerate(self.types)), "_i int, event_type string")
        long = self.vectors().join(F.broadcast(names), "_i")  # at most max_types rows
        stamp = F.timestamp_micros("_t").cast("timestamp_ntz")
        return long.select(F.col("_u").alias(entity), "event_type", F.col("_n").alias("cnt"), stamp.alias("last"), *(F.col(f"_s{k}").alias(c) for k, c in enumerate(self.totals)))

    def table(self, entity: str) -> DataFrame:
        """The wide form, see ``expand``."""
        return expand(self.vectors(), self.types, entity, self.totals)


def expand(vectors: DataFrame, types: Sequence[str], entity: str, totals: Sequence[str], zone_less: bool = True) -> DataFrame:
    """Vectors to columns: `{type}_cnt` (0 if none), `{type}_last`, `{type}_{total}` (null if none).

    The entity's entries are gathered into one row (at most one a type) and scattered
    into Arrow columns batch by batch.
    """
    sums = [f"_s{k}" for k in range(len(totals))]
    packed = vectors.groupBy("_u").agg(F.collect_list(F.struct("_i", "_n", "_t", *sums)).alias("_v"))
    stamp = T.TimestampNTZType() if zone_less else T.TimestampType()
    fields = [T.StructField(entity, vectors.schema["_u"].dataType)]
    for name in types:
        fields += [T.StructField(f"{name}_cnt", T.LongType()), T.StructField(f"{name}_last", stamp), *(T.StructField(f"{name}_{c}", T.LongType()) for c in totals)]
    n_types, when = len(types), pa.timestamp("us") if zone_less else pa.timestamp("us", tz="UTC")

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = part.num_rows
                lists = part.column(1)
                owner = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy()))
                entries = lists.flatten()
                cell = entries.field("_i").to_numpy(zero_copy_only=False).astype(np.int64) * rows + owner
                columns: list[pa.Array] = [part.column(0)]
                dense = {}
                for name in ("_n", "_t", *sums):
                    values = entries.field(name)
                    full, have = np.zeros(n_types * rows, np.int64), np.zeros(n_types * rows, bool)
                    full[cell] = values.fill_null(0).to_numpy(zero_copy_only=False)
                    have[cell] = values.is_valid().to_numpy(zero_copy_only=False)
                    dense[name] = full.reshape(n_types, rows), ~have.reshape(n_types, rows)
                for i in range(n_types):
                    columns.append(pa.array(dense["_n"][0][i]))
                    columns.append(pa.array(dense["_t"][0][i], pa.int64(), mask=dense["_t"][1][i]).cast(when))
                    columns += [pa.array(dense[s][0][i], mask=dense[s][1][i]) for s in sums]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return packed.mapInArrow(scatter, T.StructType(fields))


def feature_table(
    events: DataFrame,
    entity: str,
    type_col: str,
    time: str,
    totals: Sequence[str],
    event_id: str | None = None,
    types: Sequence[str] | None = None,
    max_types: int = 2000,
) -> DataFrame:
    """One row per entity with count, latest time and totals of each event type.

    Types are encoded as indices, counts, totals and latest times kept as mergeable
    sparse vectors per entity, and expanded into columns at the end. Null entities are
    left out; null types must be named before (see ``event_type_name``); a null time
    counts but isn't a latest time; null totals add nothing. An empty table gives no
    rows and only the entity column. With ``types`` given, an event of another type is
    an error. Other columns, of whatever name, are not read.
    """
    names = list(types) if types is not None else type_dictionary(events, type_col, max_types)
    zone_less = isinstance(events.schema[time].dataType, T.TimestampNTZType)
    return expand(type_vectors(events, names, entity, type_col, time, totals, event_id), names, entity, totals, zone_less)
