"""Building pools from one or more sources."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kairoflow.functions import elapsed, is_time
from kairoflow.functions.columns import literal
from kairoflow.operators.pool import ID, RANK, TIMES, Pool, check_names


def _plain(df: DataFrame) -> DataFrame:
    """Day-time intervals as microseconds, so that sources with either can be merged."""
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    spans = [f.name for f in df.schema if isinstance(f.dataType, T.DayTimeIntervalType)]
    return df.withColumns({c: F.timestamp_diff("MICROSECOND", zero, zero + F.col(c)) for c in spans}) if spans else df


@dataclass
class Builder:
    """Collect sources, then ``build``: entity sources are stacked by name (missing columns null),
    static sources are joined by id, ids of any source are kept."""

    kind: str
    sort_anchor: str = "start"
    end_value: object = None
    validate_continuity: bool = False
    entities: list[DataFrame] = field(default_factory=list)
    statics: list[DataFrame] = field(default_factory=list)
    id_name: str | None = None
    time_names: tuple[str, ...] = ()

    def add(self, df: DataFrame, id: str, time: str | None = None, start: str | None = None, end: str | None = None, features=None, ordinal: str | None = None, is_static: bool = False) -> "Builder":
        """Register a source; columns must exist, and entity sources need their time columns."""
        wanted = [c for c in (id, time, start, end, ordinal, *(features or ())) if c]
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            raise KeyError(f"no columns {missing} in the source")
        if self.id_name is None:
            self.id_name = id
        if is_static:
            names = list(features) if features is not None else [c for c in df.columns if c != id]
            check_names(names, {c for s in self.statics for c in s.columns} - {ID})
            self.statics.append(_plain(df.select(F.col(id).alias(ID), *names)))
            return self
        times = (time,) if self.kind == "event" else (start, end)
        if times[0] is None or (self.kind == "interval" and end is None):
            raise ValueError(f"{self.kind} sources need {'time' if self.kind == 'event' else 'start and end' if self.kind == 'interval' else 'start'}")
        structural = {c for c in (id, time, start, end, ordinal) if c}
        names = list(features) if features is not None else [c for c in df.columns if c not in structural]
        if not names:
            raise ValueError("at least one feature is needed")
        check_names(names)
        columns = [F.col(id).alias(ID), *(F.col(t).alias(n) for t, n in zip(times, TIMES[self.kind]) if t), *names]
        if ordinal:
            columns.append(F.col(ordinal).alias("_ordinal"))
        self.time_names = self.time_names or (times if times[-1] else (times[0], "end"))
        self.entities.append(_plain(df.select(*columns)))
        return self

    def _static(self) -> DataFrame | None:
        if not self.statics:
            return None
        one = [s.dropDuplicates([ID]) for s in self.statics]
        return reduce(lambda a, b: a.join(b, ID, "full"), one)

    def build(self) -> Pool:
        """The pool, lazily; only ``validate_continuity`` runs a job."""
        if not self.entities:
            raise ValueError("no entity source was added")
        entity = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.entities)
        start, *rest = TIMES[self.kind]
        if self.kind == "interval":
            kind = entity.schema[start].dataType
            middle = elapsed(F.col(start), F.col("_end"), kind) / 2
            zero = F.lit("1970-01-01").cast(kind) if is_time(kind) else F.lit(0)
            middle = elapsed(zero, F.col(start), kind) + middle
            key = {"start": [F.col(start)], "end": [F.col("_end")], "middle": [middle]}[self.sort_anchor]
        else:
            key = [F.col(start)]
        ordinal = [F.col("_ordinal")] if "_ordinal" in entity.columns else []
        # Equal times are put in an order that the rows themselves fix.
        rest_of_row = [F.xxhash64(*[c for c in entity.columns if c != ID])]
        order = Window.partitionBy(ID).orderBy(*key, *ordinal, *rest_of_row)
        entity = entity.withColumn(RANK, F.row_number().over(order).cast("long") - 1)
        ranked = Window.partitionBy(ID).orderBy(RANK)
        if self.kind == "state":
            if "_end" not in entity.columns:
                entity = entity.withColumn("_end", F.lead(start).over(ranked))
            if self.end_value is not None:
                entity = entity.withColumn("_end", F.coalesce(F.col("_end"), literal(self.end_value).cast(entity.schema[start].dataType)))
            if self.validate_continuity:
                broken = entity.withColumn("_next", F.lead(start).over(ranked)).where(F.col("_end") != F.col("_next")).select(ID).distinct().limit(6).collect()
                if broken:
                    raise ValueError(f"states don't follow one another in {[r[0] for r in broken[:5]]}{' and more' if len(broken) > 5 else ''}")
        entity = entity.drop("_ordinal")
        columns = [ID, RANK, *TIMES[self.kind], *sorted(c for c in entity.columns if c not in (ID, RANK, *TIMES[self.kind]))]
        return Pool(self.kind, entity.select(*columns), self._static(), self.id_name, self.time_names)


def _with_static(builder: Builder, static: DataFrame | None, id: str, static_id: str | None) -> Pool:
    if static is not None:
        builder.add(static, static_id or id, is_static=True)
    return builder.build()


def build_events(df: DataFrame, id: str, time: str, features=None, static: DataFrame | None = None, static_id: str | None = None, ordinal: str | None = None) -> Pool:
    """Point events. Features default to all other columns."""
    return _with_static(Builder("event").add(df, id, time=time, features=features, ordinal=ordinal), static, id, static_id)


def build_intervals(df: DataFrame, id: str, start: str, end: str, features=None, static: DataFrame | None = None, static_id: str | None = None, ordinal: str | None = None, sort_anchor: str = "start") -> Pool:
    """Intervals that may overlap and leave gaps."""
    return _with_static(Builder("interval", sort_anchor=sort_anchor).add(df, id, start=start, end=end, features=features, ordinal=ordinal), static, id, static_id)


def build_states(df: DataFrame, id: str, start: str, end: str | None = None, features=None, static: DataFrame | None = None, static_id: str | None = None, ordinal: str | None = None, end_value: Column | object = None, validate_continuity: bool = False) -> Pool:
    """States that follow one another; without an end column each ends where the next starts."""
    builder = Builder("state", end_value=end_value, validate_continuity=validate_continuity)
    return _with_static(builder.add(df, id, start=start, end=end, features=features, ordinal=ordinal), static, id, static_id)
