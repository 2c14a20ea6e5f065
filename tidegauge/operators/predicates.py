"""Filters, record contracts and checks."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LIMIT = 100  # fixed value: the most rows one entity query returns


def drop_columns(df: DataFrame, leaky: Sequence[str]) -> DataFrame:
    return df.drop(*leaky)


def complete_cases(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(subset) if subset else None)


def clamp_limit(n: int, top: int = MAX_LIMIT) -> int:
    return max(1, min(int(n), top))


def entity_query(tables: dict[str, DataFrame], entity: str, filters: dict | None = None, limit: int = 20,
                 order: Sequence[str] = ()) -> DataFrame:
    """Equality filters on allowed columns with a clamped limit; a bad request gives one error row."""
    spark = next(iter(tables.values())).sparkSession

    def error(text: str) -> DataFrame:
        return spark.range(1).select(F.lit(text).alias("error"))

    if entity not in tables:
        return error(f"unknown entity '{entity}'")
    df, filters = tables[entity], filters or {}
    bad = sorted(set(filters) - set(df.columns))
    if bad:
        return error(f"unknown column(s) {bad} for entity '{entity}'")
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in filters.items()], F.lit(True))
    out = df.where(cond)
    return (out.orderBy(*order) if order else out).limit(clamp_limit(limit))


def contains_text(column: Column | str, text: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the text are literal."""
    safe = text.replace("!", "!!").replace("%", "!%").replace("_", "!_")
    return F.ilike(F.col(column) if isinstance(column, str) else column, F.lit(f"%{safe}%"), F.lit("!"))


def first_failing_rule(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition holds (the row is bad), else null: one pass for a cascade."""
    out = None
    for name, bad in rules:
        bad = F.coalesce(bad, F.lit(False))
        out = F.when(bad, F.lit(name)) if out is None else out.when(bad, F.lit(name))
    return out


def clean(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(surviving rows, reject count per rule)."""
    tagged = df.withColumn("rule", first_failing_rule(rules))
    report = tagged.groupBy(F.coalesce("rule", F.lit("kept")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    return tagged.where(F.col("rule").isNull()).drop("rule"), report


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def violations(rules: dict[str, Column]) -> Column:
    """All violated rule codes of a row, in rule order."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in rules.items()])
    )


def line_amount_ok(quantity: Column, unit_price: Column, amount: Column, tolerance: str = "0.02") -> Column:
    """|round_half_up(quantity x price, 2) - amount| <= tolerance on exact decimals."""
    expected = F.round(quantity.cast("decimal(18,2)") * unit_price.cast("decimal(18,2)"), 2)
    return F.abs(expected - amount.cast("decimal(18,2)")) <= F.lit(tolerance).cast("decimal(18,2)")


def totals_reconcile(headers: DataFrame, lines: DataFrame, key: str, amount: str, subtotal: str, tax: str, total: str,
                     tolerance: str = "0.02") -> DataFrame:
    """Per document: does the subtotal equal the lines, and the total the subtotal plus tax?"""
    sums = lines.groupBy(key).agg(F.sum(F.col(amount).cast("decimal(18,2)")).alias("lines_sum"))
    tol = F.lit(tolerance).cast("decimal(18,2)")
    gap1 = F.abs(F.coalesce("lines_sum", F.lit(0).cast("decimal(18,2)")) - F.col(subtotal))
    gap2 = F.abs(F.col(subtotal) + F.col(tax) - F.col(total))
    return headers.join(sums, key, "left").withColumns(
        {"subtotal_gap": gap1, "total_gap": gap2, "reconciles": (gap1 <= tol) & (gap2 <= tol)}
    )


def luhn_valid(c: Column) -> Column:
    """Luhn checksum of a text of digits; blanks and hyphens are ignored, anything else is false."""
    digits = F.translate(c, " -", "")
    return F.coalesce(F.when(digits.rlike("^[0-9]+$"), F.call_function("luhn_check", digits)), F.lit(False))


def disagreements(df: DataFrame, derived: Column, existing: Column) -> DataFrame:
    """Rows where a derived flag contradicts an existing one (empty when consistent)."""
    return df.where(~derived.eqNullSafe(existing))


def owner_scoped(df: DataFrame, owner_col: str, owner, id_col: str, wanted) -> DataFrame:
    """A record is visible only among the caller's own rows."""
    return df.where((F.col(owner_col) == F.lit(owner)) & (F.col(id_col) == F.lit(wanted)))
