"""Values of the row before or after, running sums and held marks in the order of rows within keys.

Without a span, a key's rows are one window: right for trials. With one, they are cut into stretches of `span` of the order
column, and each stretch is a window; a summary with a row per key and stretch, made by partial aggregates, carries what
lies before or behind. A key may then have any number of rows: none of its tasks holds more than one stretch, and all
steps on one cut share a single shuffle by stretch. Nothing is sampled or stored, so the cut is the same in every pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = "_stretch"


def even_span(df: DataFrame, order: str, rows: float | None = None) -> float:
    """A span that has `rows` rows on average, as if all were of one key; by default the square root of all rows, so that
    neither a stretch nor a key's summary has more than that."""
    told = df.agg(F.count(order).alias("n"), F.min(order).cast("double").alias("low"), F.max(order).cast("double").alias("high")).first()
    n = told["n"]
    return max((told["high"] - told["low"]) * (rows or n**0.5) / n, 1e-9) if n else 1.0


@dataclass(frozen=True)
class Scan:
    """Rows of a table in order within keys, equals by `ties`; a span cuts them to stretches."""

    df: DataFrame
    keys: list[str]
    order: str
    span: float | None = None
    ties: tuple[str, ...] = ()

    def __post_init__(self):
        if self.span is not None:
            if self.span <= 0:
                raise ValueError("span is above 0")
            cell = F.floor(F.col(self.order) / F.lit(float(self.span)))
            # One struct, never null, so that null keys are keys and joins keep the partitioning.
            object.__setattr__(self, "df", self.df.withColumn(STRETCH, F.struct(*(F.col(k).alias(k) for k in self.keys), cell.alias("_cell"))))

    def _with(self, df: DataFrame) -> Scan:
        out = object.__new__(Scan)
        for name, value in (("df", df), ("keys", self.keys), ("order", self.order), ("span", self.span), ("ties", self.ties)):
            object.__setattr__(out, name, value)
        return out

    def _window(self, backward: bool = False):
        by = self.keys if self.span is None else (STRETCH,)
        return Window.partitionBy(*by).orderBy(*(F.col(c).desc() if backward else F.col(c) for c in (self.order, *self.ties)))

    def _place(self) -> Column:
        return F.struct(self.order, *self.ties) if self.ties else F.col(self.order)

    def _carried(self, summary: dict[str, Column], carry) -> DataFrame:
        """Rows with columns that a window over the stretches' summary gives."""
        ends = self.df.groupBy(STRETCH).agg(*(c.alias(f"_e_{n}") for n, c in summary.items()))
        w = Window.partitionBy(*(f"{STRETCH}.{k}" for k in self.keys)).orderBy(f"{STRETCH}._cell")
        return self.df.join(ends.select(STRETCH, *(carry(F.col(f"_e_{n}"), w).alias(f"_c_{n}") for n in summary)), STRETCH)

    def _neighbour(self, columns: dict[str, Column], behind: bool) -> Scan:
        near, w = (F.lead if behind else F.lag), self._window()
        if self.span is None:
            return self._with(self.df.withColumns({n: near(c).over(w) for n, c in columns.items()}))
        end = F.min_by if behind else F.max_by
        rows = self._carried({n: end(F.struct(c.alias("v")), self._place()) for n, c in columns.items()}, lambda e, s: near(e).over(s))
        # A struct tells a null value from there being no neighbour within the stretch.
        found = {n: F.coalesce(near(F.struct(c.alias("v"))).over(w), F.col(f"_c_{n}"))["v"] for n, c in columns.items()}
        return self._with(rows.withColumns(found).drop(*(f"_c_{n}" for n in columns)))

    def previous(self, **columns: Column) -> Scan:
        """With the value that each expression has in the row before; null for the first."""
        return self._neighbour(columns, False)

    def following(self, **columns: Column) -> Scan:
        """With the value that each expression has in the next row; null for the last."""
        return self._neighbour(columns, True)

    def running(self, fold=F.sum, **columns: Column) -> Scan:
        """With the sum (or F.max, F.min) of each expression over the rows so far, this one included."""
        w = self._window().rowsBetween(Window.unboundedPreceding, 0)
        if self.span is None:
            return self._with(self.df.withColumns({n: fold(c).over(w) for n, c in columns.items()}))
        rows = self._carried({n: fold(c) for n, c in columns.items()}, lambda e, s: fold(e).over(s.rowsBetween(Window.unboundedPreceding, -1)))
        join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}[fold.__name__]
        return self._with(rows.withColumns({n: join(F.col(f"_c_{n}"), fold(c).over(w)) for n, c in columns.items()}).drop(*(f"_c_{n}" for n in columns)))

    def _mark(self, columns: dict[str, Column], ahead: bool) -> Scan:
        w = self._window(ahead).rowsBetween(Window.unboundedPreceding, 0)
        last = lambda c, s: F.last(c, ignorenulls=True).over(s)
        if self.span is None:
            return self._with(self.df.withColumns({n: last(c, w) for n, c in columns.items()}))
        end = F.min_by if ahead else F.max_by
        if ahead:
            carry = lambda e, s: F.first(e, ignorenulls=True).over(s.rowsBetween(1, Window.unboundedFollowing))
        else:
            carry = lambda e, s: last(e, s.rowsBetween(Window.unboundedPreceding, -1))
        rows = self._carried({n: end(c, F.when(c.isNotNull(), self._place())) for n, c in columns.items()}, carry)
        return self._with(rows.withColumns({n: F.coalesce(last(c, w), F.col(f"_c_{n}")) for n, c in columns.items()}).drop(*(f"_c_{n}" for n in columns)))

    def held(self, **columns: Column) -> Scan:
        """With the last value of each expression that isn't null, at this row or before."""
        return self._mark(columns, False)

    def awaited(self, **columns: Column) -> Scan:
        """With the first value of each expression that isn't null, at this row or later."""
        return self._mark(columns, True)

    def derive(self, **columns: Column) -> Scan:
        return self._with(self.df.withColumns(columns))

    def rows(self) -> DataFrame:
        return self.df.drop(STRETCH)
