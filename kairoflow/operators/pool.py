"""Sequence pools: immutable views over an entity table and a static table.

The entity table has ``_id``, ``_rank`` (the place of a row in its sequence, fixed at build time by
time and then ordinal), one or two time columns (``_t``, or ``_start`` and ``_end``) and the
features. Every operator returns a new pool and nothing runs before an action. All windows
partition by ``_id``, so one exchange serves a chain of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kairoflow.functions import as_column, is_time

ID, RANK, T0, NEAREST = "_id", "_rank", "_t0", "_t0_rank"
TIMES = {"event": ("_t",), "interval": ("_start", "_end"), "state": ("_start", "_end")}
RESERVED = {ID, RANK, T0, NEAREST, "_t", "_start", "_end", "_ordinal"}


def by_id() -> "Window":
    return Window.partitionBy(ID).orderBy(RANK)


def check_names(names, taken=()) -> None:
    """Refuse reserved and taken names."""
    bad = [n for n in names if n in RESERVED]
    if bad:
        raise ValueError(f"reserved names: {bad}")
    clash = sorted(set(names) & set(taken))
    if clash:
        raise ValueError(f"names already in use: {clash}")


@dataclass(frozen=True)
class Pool:
    """Many sequences of one kind with a shared schema."""

    kind: str
    entity: DataFrame
    static: DataFrame | None = None
    id_name: str = "id"
    time_names: tuple[str, ...] = ("time",)
    t0: DataFrame | None = None
    hidden: frozenset[str] = field(default_factory=frozenset)

    # -- schema ------------------------------------------------------------------------------

    @property
    def times(self) -> tuple[str, ...]:
        return TIMES[self.kind]

    @property
    def features(self) -> list[str]:
        own = {ID, RANK, *self.times}
        return sorted(c for c in self.entity.columns if c not in own and c not in self.hidden)

    @property
    def static_features(self) -> list[str]:
        return [] if self.static is None else sorted(c for c in self.static.columns if c != ID and c not in self.hidden)

    @property
    def time_type(self) -> T.DataType:
        return self.entity.schema[self.times[0]].dataType

    @property
    def is_datetime(self) -> bool:
        return is_time(self.time_type)

    def checked(self, names, static: bool = False) -> list[str]:
        """The asked features (all if None), sorted; unknown ones raise KeyError."""
        known = self.static_features if static else self.features
        names = known if names is None else [names] if isinstance(names, str) else list(names)
        unknown = [n for n in names if n not in known]
        if unknown:
            raise KeyError(f"unknown {'static ' if static else ''}features {unknown}; known: {known}")
        return sorted(dict.fromkeys(names))

    def __repr__(self) -> str:
        return f"Pool(kind={self.kind!r}, id={self.id_name!r}, time={self.time_names}, features={self.features}, static={self.static_features})"

    # -- projections -------------------------------------------------------------------------

    def _public(self, columns) -> list[Column]:
        names = dict(zip((ID, *self.times), (self.id_name, *self.time_names)))
        return [F.col(c).alias(names.get(c, c)) for c in columns]

    def temporal_data(self, features=None) -> DataFrame:
        """id, time columns and features under their public names."""
        return self.entity.select(*self._public([ID, *self.times, *self.checked(features)]))

    def static_data(self, features=None) -> DataFrame | None:
        """id and static features, or None where there are none."""
        if not self.static_features:
            return None
        return self.static.select(*self._public([ID, *self.checked(features, static=True)]))

    def time_index(self) -> DataFrame:
        """id and time columns only."""
        return self.entity.select(*self._public([ID, *self.times]))

    def ids(self) -> DataFrame:
        """Distinct ids of the entity and static tables, as ``_id``."""
        ids = self.entity.select(ID)
        return (ids if self.static is None else ids.unionByName(self.static.select(ID))).distinct()

    def lengths(self) -> DataFrame:
        """(_id, length): ids that only have static data have length 0."""
        counts = self.entity.groupBy(ID).agg(F.count("*").alias("length"))
        if self.static is None:
            return counts
        return self.ids().join(counts, ID, "left").fillna(0, ["length"])

    def dense(self) -> DataFrame:
        """The entity table with ``_rank`` counted anew, 0-based, over the rows that are left."""
        return self.entity.withColumn(RANK, F.row_number().over(by_id()).cast("long") - 1)

    def sequence(self, key) -> "Pool":
        """The pool of one id."""
        return self.subset([key])

    def __getitem__(self, key) -> "Pool":
        return self.sequence(key)

    def keys(self) -> Iterator:
        """The ids in order, fetched partition by partition."""
        return (r[0] for r in self.ids().orderBy(ID).toLocalIterator())

    def items(self) -> "Iterator[tuple[object, Pool]]":
        """Each id with its own pool, which is read when it is used."""
        return ((key, self.sequence(key)) for key in self.keys())

    def values(self) -> "Iterator[Pool]":
        return (pool for _, pool in self.items())

    def __iter__(self) -> Iterator:
        return self.keys()

    def __len__(self) -> int:
        return self.ids().count()

    def __bool__(self) -> bool:
        return True

    def __contains__(self, key) -> bool:
        return not self.ids().where(F.col(ID) == F.lit(key)).isEmpty()

    def row(self, key, rank: int):
        """One row of one sequence by dense rank; negative ranks count from the end."""
        order = F.col(RANK) if rank >= 0 else F.col(RANK).desc()
        rows = self.sequence(key).entity.orderBy(order).limit(rank + 1 if rank >= 0 else -rank).collect()
        if len(rows) < (rank + 1 if rank >= 0 else -rank):
            raise IndexError(rank)
        return rows[-1]

    # -- id sets -----------------------------------------------------------------------------

    def _id_frame(self, ids) -> DataFrame:
        if isinstance(ids, DataFrame):
            return ids.select(F.col(ids.columns[0] if ID not in ids.columns else ID).alias(ID)).distinct()
        kind = self.entity.schema[ID].dataType
        spark = self.entity.sparkSession
        return spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField(ID, kind)])).distinct()

    def subset(self, ids) -> "Pool":
        """The sequences of some ids: a left semi join with an id table, or a literal list."""
        if not isinstance(ids, DataFrame) and len(ids := list(ids)) <= 64:
            keep = lambda df: df.where(F.col(ID).isin(ids))
        else:
            frame = self._id_frame(ids)
            keep = lambda df: df.join(frame, ID, "left_semi")
        return replace(self, entity=keep(self.entity), static=None if self.static is None else keep(self.static), t0=None if self.t0 is None else keep(self.t0))

    # -- criteria ----------------------------------------------------------------------------

    def which(self, criterion) -> DataFrame:
        """Ids (``_id``) of the sequences that satisfy a criterion; compose with intersect, union, subtract."""
        return criterion.which(self)

    def filter_entities(self, criterion) -> "Pool":
        """Keep the rows that satisfy a criterion; a state pool would lose its continuity and refuses."""
        if self.kind == "state":
            raise NotImplementedError("rows of a state pool can't be filtered; convert it to intervals first")
        return replace(self, entity=criterion.rows(self))

    def match(self, criterion, key) -> bool:
        """Whether one sequence satisfies a criterion."""
        return not self.sequence(key).which(criterion).isEmpty()

    # -- expressions and features --------------------------------------------------------------

    def apply(self, by_id: bool = False, is_static: bool = False, **expressions: Column | str) -> DataFrame:
        """New columns beside id: row expressions; with ``by_id`` one row for each id, by aggregates.

        Window expressions over ``Window.partitionBy("_id")`` give per-sequence results by row.
        """
        frame = self.static if is_static else self.entity
        if frame is None:
            raise ValueError("the pool has no static table")
        columns = [as_column(e).alias(name) for name, e in expressions.items()]
        if by_id:
            return frame.groupBy(ID).agg(*columns).withColumnRenamed(ID, self.id_name)
        key = [] if is_static else [F.col(RANK)]
        return frame.select(F.col(ID).alias(self.id_name), *key, *columns)

    def to_dummies(self, features, is_static: bool = False, drop_first: bool = False, categories: dict[str, list] | None = None) -> DataFrame:
        """0/1 columns ``feature_value`` in sorted order; null is in no category."""
        frame = self.static if is_static else self.entity
        out = []
        for name in self.checked(features, static=is_static):
            values = (categories or {}).get(name) or (frame.schema[name].metadata or {}).get("categories")
            if values is None:
                values = [r[0] for r in frame.select(name).where(F.col(name).isNotNull()).distinct().collect()]
            for value in sorted(values)[1 if drop_first else 0 :]:
                out.append(F.when(F.col(name) == value, 1).otherwise(0).cast("byte").alias(f"{name}_{value}"))
        base = [ID] if is_static else [ID, *self.times]
        return frame.select(*self._public(base), *out)

    def with_features(self, overwrite: bool = False, **expressions: Column | str) -> "Pool":
        """Entity features from expressions over the entity table."""
        check_names(expressions, () if overwrite else self.features)
        return replace(self, entity=self.entity.withColumns({n: as_column(e) for n, e in expressions.items()}))

    def add_entity_features(self, df: DataFrame, overwrite: bool = False) -> "Pool":
        """Features keyed by (id, ``_rank``); rows without a partner get nulls."""
        new = [c for c in df.columns if c not in (self.id_name, ID, RANK)]
        check_names(new, () if overwrite else self.features)
        frame = df.withColumnRenamed(self.id_name, ID) if ID not in df.columns else df
        return replace(self, entity=self.entity.drop(*new).join(frame, [ID, RANK], "left"))

    def add_static_features(self, df: DataFrame, id_column: str | None = None, overwrite: bool = False) -> "Pool":
        """Features keyed by id; ids without a row get nulls, unknown ids are ignored."""
        key = id_column or self.id_name
        new = [c for c in df.columns if c != key]
        check_names(new, () if overwrite else self.static_features)
        kind = self.entity.schema[ID].dataType
        frame = df.withColumn(key, F.col(key).cast(kind)).withColumnRenamed(key, ID)
        base = self.ids() if self.static is None else self.ids().join(self.static.drop(*new), ID, "left")
        return replace(self, static=base.join(frame, ID, "left"))

    def drop_features(self, features, is_static: bool = False, permanently: bool = False) -> "Pool":
        """Hide features, or drop the columns for good."""
        names = self.checked(features, static=is_static)
        if not permanently:
            return replace(self, hidden=self.hidden | set(names))
        return replace(self, static=self.static.drop(*names)) if is_static else replace(self, entity=self.entity.drop(*names))

    # -- casts -------------------------------------------------------------------------------

    def cast_features(self, schema: dict[str, str], is_static: bool = False, strict: bool = True) -> "Pool":
        """Cast features; strict casts raise on values that don't fit, others give null. The type
        "categorical" marks a string column with its categories."""
        from kairoflow.functions import with_categories

        frame = self.static if is_static else self.entity
        self.checked(schema, static=is_static)
        for name, kind in schema.items():
            if kind in ("categorical", "enum"):
                frame = with_categories(frame.withColumn(name, F.col(name).cast("string")), name, ordered=kind == "enum")
            else:
                frame = frame.withColumn(name, F.col(name).cast(kind) if strict else F.col(name).try_cast(kind))
        return replace(self, static=frame) if is_static else replace(self, entity=frame)

    def cast_id(self, kind: str) -> "Pool":
        if kind in ("categorical", "enum"):
            raise TypeError("an id can't be categorical")
        cast = lambda df: None if df is None else df.withColumn(ID, F.col(ID).cast(kind))
        return replace(self, entity=cast(self.entity), static=cast(self.static), t0=cast(self.t0))

    def cast_to_datetime(self, unit: str = "us") -> "Pool":
        """Numbers become timestamps without zone: epoch units of ``unit`` (s, ms, us)."""
        scale = {"s": 10**6, "ms": 10**3, "us": 1}
        if unit not in scale:
            raise ValueError(f"unit must be one of {sorted(scale)}; Spark has no finer timestamps")
        make = lambda c: F.timestamp_add("MICROSECOND", (F.col(c) * scale[unit]).cast("long"), F.lit("1970-01-01").cast("timestamp_ntz"))
        made = {c: F.col(c).cast("timestamp_ntz") if self.is_datetime else make(c) for c in self.times}
        return replace(self, entity=self.entity.withColumns(made), t0=None)

    def cast_to_timestep(self, kind: str = "long") -> "Pool":
        """Numeric times in another numeric type; calendar times are refused."""
        if self.is_datetime:
            raise TypeError("calendar times can't become time steps")
        return replace(self, entity=self.entity.withColumns({c: F.col(c).cast(kind) for c in self.times}), t0=None)

    # -- operators in modules of their own -------------------------------------------------------

    def set_t0(self, **how) -> "Pool":
        from kairoflow.operators.alignment import set_t0

        return set_t0(self, **how)

    def t0_data(self) -> DataFrame:
        from kairoflow.operators.alignment import t0_data

        return t0_data(self)

    def relative_time(self, unit: str = "d") -> DataFrame:
        from kairoflow.operators.alignment import relative_time

        return relative_time(self, unit)

    def as_event(self, anchor: str = "start") -> "Pool":
        from kairoflow.operators.conversion import as_event

        return as_event(self, anchor)

    def as_interval(self, duration=None) -> "Pool":
        from kairoflow.operators.conversion import as_interval

        return as_interval(self, duration)

    def as_state(self, end_value=None) -> "Pool":
        from kairoflow.operators.conversion import as_state

        return as_state(self, end_value)

    def describe(self, by_id: bool = True, add_to_static: bool = False, separator: str = "_", prefix: str = "") -> "DataFrame | Pool":
        """The description of ``description.describe``; with ``add_to_static`` the pool that has it as
        static features, named with ``prefix`` and ``separator`` where a prefix is given."""
        from kairoflow.operators.description import add_description, describe

        if not add_to_static:
            return describe(self, by_id)
        if not by_id:
            raise ValueError("only a description by id can be static features")
        return add_description(self, separator, prefix)

    def survival_target(self, endpoint_time: str, occurred: str | None = None, censure_time: str | None = None) -> DataFrame:
        from kairoflow.operators.description import survival_target

        return survival_target(self, endpoint_time, occurred, censure_time)

    def binned_data(self, features=None, bin_size=None, **options) -> DataFrame:
        from kairoflow.operators.binning import binned_data

        return binned_data(self, features, bin_size, **options)

    def to_tensor(self, features=None, bin_size=None, **options):
        from kairoflow.operators.binning import to_tensor

        return to_tensor(self, features, bin_size, **options)

    def extend(self, other: "Pool", on_duplicate: str = "raise") -> "Pool":
        from kairoflow.operators.sets import extend

        return extend(self, other, on_duplicate)

    def split(self, ratio: float | None = None, count: int | None = None, seed: int | None = None):
        from kairoflow.operators.sets import split

        return split(self, ratio, count, seed)

    def metadata(self) -> dict:
        from kairoflow.operators.description import metadata

        return metadata(self)
