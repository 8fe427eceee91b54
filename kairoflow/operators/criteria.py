"""Criteria: predicates on rows (``rows``) and on sequences or trajectories (``which``).

``which`` gives ids as a lazy one-column DataFrame, so id sets compose with intersect, union and
subtract. ``rows`` gives the entity table with only the rows that satisfy the criterion; each filter
sees the result of the one before it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kairoflow.errors import CriterionError, LevelError
from kairoflow.functions import as_column
from kairoflow.functions.columns import literal
from kairoflow.operators.pool import ID, NEAREST, RANK, Pool, by_id

#: In a pattern: any number of rows, and exactly one row with a value.
ANY, WILDCARD = "...", "*"


class Criterion:
    """Base class; a level that a criterion doesn't have raises LevelError."""

    def rows(self, pool: Pool) -> DataFrame:
        raise LevelError(f"{type(self).__name__} doesn't filter rows")

    def which(self, pool: Pool) -> DataFrame:
        raise LevelError(f"{type(self).__name__} doesn't select sequences")


REGISTRY: dict[str, type[Criterion]] = {}


def register(cls: type[Criterion]) -> type[Criterion]:
    """Make a criterion known by its class name."""
    REGISTRY[cls.__name__] = cls
    return cls


def _boolean(frame: DataFrame, query: Column | str) -> Column:
    column = as_column(query)
    if not isinstance(frame.select(column.alias("q")).schema["q"].dataType, T.BooleanType):
        raise CriterionError("the query isn't boolean")
    return column


@register
@dataclass(frozen=True)
class Entity(Criterion):
    """Rows where a boolean expression holds; sequences with at least one such row."""

    query: Column | str

    def rows(self, pool):
        return pool.entity.where(_boolean(pool.entity, self.query))

    def which(self, pool):
        return self.rows(pool).select(ID).distinct()


@register
@dataclass(frozen=True)
class Length(Criterion):
    """Sequences by their number of rows; ids without rows are never selected."""

    gt: int | None = None
    ge: int | None = None
    lt: int | None = None
    le: int | None = None

    def __post_init__(self):
        low = max([x for x in (None if self.gt is None else self.gt + 1, self.ge) if x is not None], default=None)
        high = min([x for x in (None if self.lt is None else self.lt - 1, self.le) if x is not None], default=None)
        if low is None and high is None:
            raise CriterionError("a bound is needed")
        if low is not None and high is not None and low > high:
            raise CriterionError("the bounds contradict each other")

    def which(self, pool):
        counts, n = pool.entity.groupBy(ID).agg(F.count("*").alias("n")), F.col("n")
        for bound, keep in ((self.gt, n > self.gt), (self.ge, n >= self.ge), (self.lt, n < self.lt), (self.le, n <= self.le)):
            if bound is not None:
                counts = counts.where(keep)
        return counts.select(ID)


@register
@dataclass(frozen=True)
class Static(Criterion):
    """Sequences or trajectories whose static row satisfies a boolean expression."""

    query: Column | str

    def which(self, pool):
        if pool.static is None:
            raise CriterionError("the pool has no static table")
        return pool.static.where(_boolean(pool.static, self.query)).select(ID).distinct()


@register
@dataclass(frozen=True)
class Time(Criterion):
    """Rows by time. Events: bounds on their time. Periods overlap the window [start_ge, end_le]
    (a null end is still open), or lie within it with ``duration_within``; ``all_entities``: a
    sequence is selected if every row satisfies the bounds."""

    start_ge: object = None
    start_le: object = None
    end_ge: object = None
    end_le: object = None
    duration_within: bool = False
    all_entities: bool = False

    def __post_init__(self):
        if all(x is None for x in (self.start_ge, self.start_le, self.end_ge, self.end_le)):
            raise CriterionError("a bound is needed")

    def condition(self, pool: Pool) -> Column:
        value = {k: literal(getattr(self, k)) for k in ("start_ge", "start_le", "end_ge", "end_le") if getattr(self, k) is not None}
        start = F.col(pool.times[0])
        parts = []
        if pool.kind == "event":
            if "end_ge" in value or "end_le" in value:
                raise CriterionError("events have no end")
            parts += [start >= value["start_ge"]] if "start_ge" in value else []
        else:
            end = F.col(pool.times[1])
            open_end = lambda c: c if self.duration_within else F.coalesce(c, F.lit(True))
            if "start_ge" in value:
                parts.append(start >= value["start_ge"] if self.duration_within else open_end(end >= value["start_ge"]))
            if "end_le" in value:
                parts.append(end <= value["end_le"] if self.duration_within else start <= value["end_le"])
            if "end_ge" in value:
                parts.append(open_end(end >= value["end_ge"]))
        if "start_le" in value:
            parts.append(start <= value["start_le"])
        out = parts[0]
        for part in parts[1:]:
            out = out & part
        return out

    def rows(self, pool):
        return pool.entity.where(self.condition(pool))

    def which(self, pool):
        if not self.all_entities:
            return self.rows(pool).select(ID).distinct()
        every = pool.entity.groupBy(ID).agg(F.coalesce(F.bool_and(self.condition(pool)), F.lit(True)).alias("every"))
        return every.where("every").select(ID)


@register
@dataclass(frozen=True)
class Rank(Criterion):
    """Rows by their place in the sequence, counted anew over the rows that are left.

    Negative places count from the end. With ``relative`` places are relative to the row nearest to
    the reference date, negative ones lie before it, and ids without a date are kept whole.
    ``step`` is taken on the place itself, not on its distance from ``start``.
    """

    first: int | None = None
    last: int | None = None
    start: int | None = None
    end: int | None = None
    step: int | None = None
    ranks: tuple[int, ...] | None = None
    relative: bool = False

    def __post_init__(self):
        groups = [self.first is not None, self.last is not None, self.ranks is not None, any(x is not None for x in (self.start, self.end, self.step))]
        if sum(groups) != 1:
            raise CriterionError("give one of first, last, ranks, or start/end/step")
        if self.first == 0 or self.last == 0 or (self.step is not None and self.step <= 0):
            raise CriterionError("first and last can't be 0, step must be positive")
        if self.ranks is not None and not self.ranks:
            raise CriterionError("ranks can't be empty")

    def _condition(self, rank: Column, n: Column) -> Column:
        at = lambda v: n + v if v < 0 and not self.relative else F.lit(v)
        if self.first is not None:
            return rank < (self.first if self.first > 0 else n + self.first)
        if self.last is not None:
            return rank >= (n - self.last if self.last > 0 else -self.last)
        if self.ranks is not None:
            out = rank == at(self.ranks[0])
            for r in self.ranks[1:]:
                out = out | (rank == at(r))
            return out
        out = F.lit(True)
        if self.start is not None:
            out = out & (rank >= at(self.start))
        if self.end is not None:
            out = out & (rank < at(self.end))
        if self.step is not None:
            out = out & (F.pmod(rank, F.lit(self.step)) == 0)
        return out

    def rows(self, pool):
        whole = Window.partitionBy(ID)
        placed = pool.entity.withColumn("_place", F.row_number().over(by_id()).cast("long") - 1).withColumn("_n", F.count("*").over(whole))
        if not self.relative:
            return placed.where(self._condition(F.col("_place"), F.col("_n"))).drop("_place", "_n")
        from kairoflow.operators.alignment import nearest

        joined = placed.join(nearest(pool).select(ID, NEAREST), ID, "left")
        kept = joined.where(F.col(NEAREST).isNull() | self._condition(F.col("_place") - F.col(NEAREST), F.col("_n")))
        return kept.drop("_place", "_n", NEAREST)


@register
@dataclass(frozen=True)
class Pattern(Criterion):
    """Sequences that hold an ordered pattern of a feature's values.

    Elements are next to one another unless parted by ``ANY``; ``WILDCARD`` is one row with a value.
    Elements are regular expressions searched for (Java dialect), or literal parts of the value with
    ``regex=False``. ``rows`` keeps the rows of the leftmost match; ``present=False`` turns both round.
    """

    feature: str
    pattern: tuple[str, ...] | list[str] | str
    present: bool = True
    regex: bool = True
    case_sensitive: bool = True

    def __post_init__(self):
        elements = [self.pattern] if isinstance(self.pattern, str) else list(self.pattern)
        if not [e for e in elements if e != ANY]:
            raise CriterionError("the pattern has no element")
        if self.regex:
            for e in elements:
                if e not in (ANY, WILDCARD):
                    re.compile(e)

    def segments(self) -> list[list[str]]:
        out: list[list[str]] = [[]]
        for e in [self.pattern] if isinstance(self.pattern, str) else self.pattern:
            if e == ANY:
                out.append([])
            else:
                out[-1].append(e)
        return [s for s in out if s]

    def _fits(self, value: Column, element: str) -> Column:
        if element == WILDCARD:
            return value.isNotNull()
        if self.regex:
            found = value.rlike(element if self.case_sensitive else f"(?i){element}")
        else:
            found = value.contains(element) if self.case_sensitive else F.lower(value).contains(element.lower())
        return F.coalesce(found, F.lit(False))

    def matches(self, pool: Pool) -> DataFrame:
        """(_id, _first): the first place of each segment's leftmost match, null where one is missing.

        Per row, a flag tells for each segment whether it matches there (``lead`` looks ahead); per
        id, the sorted places of each segment's flags are then walked once, segment by segment.
        """
        value = F.col(self.feature).cast("string")
        frame = pool.entity.select(ID, RANK, value.alias("_v")).withColumn("_place", F.row_number().over(by_id()).cast("long") - 1)
        segments = self.segments()
        flags = {}
        for k, segment in enumerate(segments):
            hit = self._fits(F.col("_v"), segment[0])
            for j, element in enumerate(segment[1:], 1):
                hit = hit & F.coalesce(F.lead(self._fits(F.col("_v"), element), j).over(by_id()), F.lit(False))
            flags[f"_hit{k}"] = hit
        frame = frame.withColumns(flags)
        places = frame.groupBy(ID).agg(*[F.array_sort(F.collect_list(F.when(F.col(f"_hit{k}"), F.col("_place")))).alias(f"_p{k}") for k in range(len(segments))])
        from_place = lambda column, least: F.array_min(F.filter(column, lambda p: p >= least))
        at, firsts = F.lit(0).cast("long"), []
        for k, segment in enumerate(segments):
            firsts.append(from_place(f"_p{k}", at))
            at = firsts[-1] + len(segment)
        return places.select(ID, F.array(*firsts).alias("_firsts"), at.isNotNull().alias("_found"))

    def which(self, pool):
        found = self.matches(pool)
        return found.where(F.col("_found") == F.lit(self.present)).select(ID)

    def rows(self, pool):
        found = self.matches(pool)
        spans = F.array(*[F.struct(F.col("_firsts")[k].alias("a"), (F.col("_firsts")[k] + len(s)).alias("b")) for k, s in enumerate(self.segments())])
        placed = pool.entity.withColumn("_place", F.row_number().over(by_id()).cast("long") - 1).join(found.select(ID, "_found", spans.alias("_spans")), ID)
        inside = F.col("_found") & F.exists("_spans", lambda s: (F.col("_place") >= s["a"]) & (F.col("_place") < s["b"]))
        return placed.where(inside if self.present else ~inside).drop("_place", "_found", "_spans")
