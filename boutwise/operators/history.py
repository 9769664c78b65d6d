"""As-of features over the earlier rows of each entity.

A `History` holds rows of entities in time order. Every feature looks only at rows strictly
before the current one in `(day, *order)`. Ordinary entities are one window partition each. When
the busiest entity holds more than `segment_rows` rows, all entities are cut into segments of
consecutive days, so no task holds more than one segment, and what earlier segments contribute
(sums, last values, the tail of a rolling window) is joined in as one small carry row per
segment. Both forms give the same values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutwise.operators.keyed import dealt
from boutwise.session import materialize

SEGMENT_ROWS = 2_000_000
# Rows that a task should sort at most, however many tasks that takes; entities stay whole.
TASK_ROWS = 200_000
SEGMENT = "_segment"
BEFORE = (Window.unboundedPreceding, -1)
UP_TO_NOW = (Window.unboundedPreceding, Window.currentRow)


@dataclass(frozen=True)
class PrefixSum:
    """Sum of `value` over earlier rows; 0 when there are none."""

    name: str
    value: Column


@dataclass(frozen=True)
class PrefixMax:
    """Largest non-null `value` of earlier rows."""

    name: str
    value: Column
    default: object = None


@dataclass(frozen=True)
class PrefixLast:
    """Latest non-null `value`, of earlier rows or up to and with the current row."""

    name: str
    value: Column
    with_current: bool = False
    default: object = None


@dataclass(frozen=True)
class PrefixFirst:
    """First non-null `value` up to and with the current row."""

    name: str
    value: Column


@dataclass(frozen=True)
class Rolling:
    """Mean (or sum) of the last `size` non-null values of earlier rows."""

    name: str
    value: Column
    size: int
    default: object
    nullable: bool = False
    kind: str = "mean"


@dataclass(frozen=True)
class SinceDays:
    """Sum of `value` over earlier rows dated no more than `days` days before."""

    name: str
    value: Column
    days: int


def busiest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the most frequent key: one pre-aggregated pass over the key columns."""
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return row[0] or 0


def load(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the most frequent key and all rows, in the same pass."""
    row = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return row[0] or 0, row[1] or 0


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be NULL on both sides; the right copies of the keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


class History:
    def __init__(
        self,
        df: DataFrame,
        entity: list[str],
        day: str,
        order: list[str],
        segment_rows: int = SEGMENT_ROWS,
        hottest: int | None = None,
        task_rows: int = TASK_ROWS,
    ):
        self.entity, self.day, self.order = list(entity), day, list(order)
        rows = 0  # where the caller has counted, an earlier history has dealt the rows
        if hottest is None:
            hottest, rows = load(df, self.entity)
        self.hottest, self.segmented = hottest, hottest > segment_rows
        self.df = self._cut(df, segment_rows) if self.segmented else dealt(df, self.entity, rows, task_rows)
        self.by = [*self.entity, SEGMENT] if self.segmented else self.entity
        # Days as numbers: range frames reach back by days, and share this sort order.
        self.window = Window.partitionBy(*self.by).orderBy(F.unix_date(self.day), *self.order)

    def _cut(self, df: DataFrame, segment_rows: int) -> DataFrame:
        earlier = Window.partitionBy(*self.entity).orderBy(self.day).rowsBetween(*BEFORE)
        later_days = (
            df.groupBy(*self.entity, self.day).agg(F.count("*").alias("_n"))
            .withColumn(SEGMENT, F.floor(F.coalesce(F.sum("_n").over(earlier), F.lit(0)) / segment_rows))
            .drop("_n").filter(F.col(SEGMENT) > 0)
        )
        cut = null_safe_join(df, later_days, [*self.entity, self.day])
        # Several carry aggregates read the cut rows, so they are written once.
        return materialize(cut.withColumn(SEGMENT, F.coalesce(SEGMENT, F.lit(0).cast("long"))))

    def add(self, *specs) -> "History":
        for kind, method in (
            (PrefixSum, self._sums), (PrefixMax, self._maxima), (PrefixLast, self._lasts),
            (PrefixFirst, self._firsts), (Rolling, self._rolling), (SinceDays, self._since),
        ):
            chosen = [s for s in specs if isinstance(s, kind)]
            if chosen:
                method(chosen)
        return self

    def result(self) -> DataFrame:
        return self.df.drop(SEGMENT) if self.segmented else self.df

    # -- one method per kind of feature ------------------------------------------------------

    def _sums(self, specs: list[PrefixSum]) -> None:
        before = self.window.rowsBetween(*BEFORE)
        self._carry({s.name: F.sum(s.value) for s in specs}, F.sum)
        self._set({
            s.name: F.coalesce(F.sum(s.value).over(before), F.lit(0)) + self._carried(s.name, F.lit(0))
            for s in specs
        })

    def _maxima(self, specs: list[PrefixMax]) -> None:
        before = self.window.rowsBetween(*BEFORE)
        self._carry({s.name: F.max(s.value) for s in specs}, F.max)
        self._set({
            s.name: F.coalesce(
                F.greatest(F.max(s.value).over(before), self._carried(s.name, F.lit(None))), F.lit(s.default))
            for s in specs
        })

    def _lasts(self, specs: list[PrefixLast]) -> None:
        rank = F.struct(self.day, *self.order)
        self._carry(
            {s.name: F.max_by(s.value, F.when(s.value.isNotNull(), rank)) for s in specs},
            lambda c: F.last(c, ignorenulls=True),
        )
        self._set({
            s.name: F.coalesce(
                F.last(s.value, ignorenulls=True).over(
                    self.window.rowsBetween(*(UP_TO_NOW if s.with_current else BEFORE))),
                self._carried(s.name, F.lit(None)), F.lit(s.default))
            for s in specs
        })

    def _firsts(self, specs: list[PrefixFirst]) -> None:
        rank = F.struct(self.day, *self.order)
        self._carry(
            {s.name: F.min_by(s.value, F.when(s.value.isNotNull(), rank)) for s in specs},
            lambda c: F.first(c, ignorenulls=True),
        )
        so_far = self.window.rowsBetween(*UP_TO_NOW)
        self._set({
            s.name: F.coalesce(self._carried(s.name, F.lit(None)), F.first(s.value, ignorenulls=True).over(so_far))
            for s in specs
        })

    def _rolling(self, specs: list[Rolling]) -> None:
        dense = [s for s in specs if not s.nullable]
        sparse = [s for s in specs if s.nullable]
        if self.segmented:
            self._carry_tails(specs)
        if sparse:
            before = self.window.rowsBetween(*BEFORE)
            self._set({f"_c_{s.name}": F.count(s.value).over(before) for s in sparse})
        columns = {}
        for s in dense:
            frame = self.window.rowsBetween(-s.size, -1)
            columns[s.name] = self._combine(s, F.sum(s.value).over(frame), F.count(s.value).over(frame))
        for s in sparse:
            # Rows that share a count of earlier non-null values share one answer, so a range over
            # that count reaches exactly the last `size` non-null values however long the gaps are.
            frame = Window.partitionBy(*self.by).orderBy(f"_c_{s.name}").rangeBetween(-s.size, -1)
            columns[s.name] = self._combine(s, F.sum(s.value).over(frame), F.count(s.value).over(frame))
        self._set(columns)
        self.df = self.df.drop(*[f"_c_{s.name}" for s in sparse], *[f"_t_{s.name}" for s in specs])

    def _combine(self, s: Rolling, total: Column, count: Column) -> Column:
        total = F.coalesce(total.cast("double"), F.lit(0.0))
        if self.segmented:
            tail = F.coalesce(F.col(f"_t_{s.name}"), F.array().cast("array<double>"))
            take = F.least(F.lit(s.size) - count, F.size(tail)).cast("int")
            older = F.slice(tail, F.size(tail) - take + 1, take)
            total = total + F.aggregate(older, F.lit(0.0), lambda acc, x: acc + x)
            count = count + take
        value = total / F.when(count > 0, count) if s.kind == "mean" else F.when(count > 0, total)
        return F.coalesce(value, F.lit(s.default))

    def _since(self, specs: list[SinceDays]) -> None:
        before = self.window.rowsBetween(*BEFORE)
        totals = {f"_b_{s.name}": F.sum(s.value) for s in specs}
        self._carry(totals, F.sum)
        if self.segmented:
            daily = self.df.groupBy(*self.entity, self.day).agg(
                *[F.sum(s.value).alias(f"_v_{s.name}") for s in specs])
            by_day = Window.partitionBy(*self.entity).orderBy(F.unix_date(self.day))
            daily = daily.select(*self.entity, self.day, *[
                F.sum(f"_v_{s.name}").over(
                    by_day.rangeBetween(Window.unboundedPreceding, -(s.days + 1))).alias(f"_o_{s.name}")
                for s in specs
            ])
            self.df = null_safe_join(self.df, daily, [*self.entity, self.day])
            older = {s.name: F.col(f"_o_{s.name}") for s in specs}
        else:
            by_day = Window.partitionBy(*self.by).orderBy(F.unix_date(self.day))
            older = {
                s.name: F.sum(s.value).over(by_day.rangeBetween(Window.unboundedPreceding, -(s.days + 1)))
                for s in specs
            }
        self._set({
            s.name: F.coalesce(F.sum(s.value).over(before), F.lit(0))
            + self._carried(f"_b_{s.name}", F.lit(0)) - F.coalesce(older[s.name], F.lit(0))
            for s in specs
        })
        self.df = self.df.drop(*[f"_o_{s.name}" for s in specs])

    # -- what earlier segments contribute ----------------------------------------------------

    def _set(self, columns: dict[str, Column]) -> None:
        self.df = self.df.withColumns(columns).drop(*[f"_k_{n}" for n in columns], *[
            c for c in self.df.columns if c.startswith("_k_")])

    def _carried(self, name: str, default: Column) -> Column:
        return F.coalesce(F.col(f"_k_{name}"), default) if self.segmented else default

    def _carry(self, aggregates: dict[str, Column], fold) -> None:
        if not self.segmented:
            return
        per_segment = self.df.groupBy(*self.by).agg(*[a.alias(f"_k_{n}") for n, a in aggregates.items()])
        earlier = Window.partitionBy(*self.entity).orderBy(SEGMENT).rowsBetween(*BEFORE)
        carried = per_segment.select(
            *self.by, *[fold(F.col(f"_k_{n}")).over(earlier).alias(f"_k_{n}") for n in aggregates]
        ).filter(F.col(SEGMENT) > 0)
        self.df = null_safe_join(self.df, carried, self.by)

    def _carry_tails(self, specs: list[Rolling]) -> None:
        """The last `size` non-null values before each segment, as one array per segment."""
        segments = self.df.select(*self.by).distinct()
        for s in specs:
            newest = Window.partitionBy(*self.by).orderBy(
                F.col(self.day).desc(), *[F.col(c).desc() for c in self.order])
            kept = (
                self.df.filter(s.value.isNotNull())
                .select(*self.by, s.value.cast("double").alias("_v"), F.row_number().over(newest).alias("_i"))
                .filter(F.col("_i") <= s.size)
            )
            running = Window.partitionBy(*self.entity).orderBy(SEGMENT, F.col("_i").desc())
            tails = kept.select(
                *self.by, "_i", F.collect_list("_v").over(running.rowsBetween(-(s.size - 1), 0)).alias("_tail")
            ).filter(F.col("_i") == 1).drop("_i")
            earlier = Window.partitionBy(*self.entity).orderBy(SEGMENT).rowsBetween(*BEFORE)
            carried = null_safe_join(segments, tails, self.by).select(
                *self.by, F.last("_tail", ignorenulls=True).over(earlier).alias(f"_t_{s.name}")
            ).filter(F.col(SEGMENT) > 0)
            self.df = null_safe_join(self.df, carried, self.by)
