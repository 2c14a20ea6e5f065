"""Column functions: distances, links, clipping, text and JSON access, thresholds."""
from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.ordering import as_col, let

EARTH_KM = 6371.0  # fixed value: mean earth radius
VERDICT = r"(?i)VERDICT:\s*([A-Za-z_][A-Za-z0-9_]*)"  # fixed pattern: the vote line of a statement
HONORIFIC = r",\s*([^.]+)\."  # fixed pattern: title between the comma and the first full stop
PSI_STABLE, PSI_SIGNIFICANT = 0.10, 0.25  # fixed values: drift thresholds


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    chord = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * F.lit(radius) * F.asin(F.sqrt(chord))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softmax(a: Column | str) -> Column:
    e = let(F.array_max(as_col(a)).cast("double"), lambda m: F.transform(as_col(a), lambda x: F.exp(x.cast("double") - m)))
    return let(e, lambda v: let(F.aggregate(v, F.lit(0.0), lambda s, y: s + y), lambda t: F.transform(v, lambda x: x / t)))


def argmax(a: Column | str) -> Column:
    """0-based position of the first largest element."""
    a = as_col(a)
    return F.array_position(a, F.array_max(a)) - 1


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    out = x if hi is None else F.least(x, F.lit(hi))
    return out if lo is None else F.greatest(out, F.lit(lo))


def honorific(name: Column | str) -> Column:
    return F.nullif(F.regexp_extract(as_col(name), HONORIFIC, 1), F.lit(""))


def extract_verdict(text: Column | str) -> Column:
    """Upper-cased tag of the first vote line, null when the statement has none."""
    return F.nullif(F.upper(F.regexp_extract(as_col(text), VERDICT, 1)), F.lit(""))


def _grams(parts: Column, n: int, glue: str) -> Column:
    def cut(p):
        starts = F.sequence(F.lit(1), F.greatest(F.size(p) - n + 1, F.lit(1)))
        return F.when(F.size(p) >= n, F.transform(starts, lambda i: F.array_join(F.slice(p, i, F.lit(n)), glue))).otherwise(
            F.array().cast("array<string>"))

    return let(parts, cut)


def word_ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams joined by a blank; empty when the text is shorter."""
    return _grams(tokens, n, " ")


def char_ngrams(text: Column, n: int) -> Column:
    """Character n-grams. The text is split once: a substring call per position would be quadratic."""
    return _grams(F.filter(F.split(text, ""), lambda c: c != ""), n, "")


def clean_amount(text: Column | str) -> Column:
    """Trimmed text without thousands commas as an exact decimal; null when it is not a number."""
    return F.regexp_replace(F.trim(as_col(text)), ",", "").try_cast("decimal(18,2)")


def iso_date(text: Column | str) -> Column:
    """ISO date (yyyy-MM-dd), null for anything else."""
    t = F.trim(as_col(text))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date"))


def psi_label(psi: Column) -> Column:
    return F.when(psi < PSI_STABLE, "stable").when(psi < PSI_SIGNIFICANT, "moderate shift").otherwise("significant drift")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs x1, y1, x2, y2); zero when the union is zero."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def enum_name(code: Column, names: Mapping[int, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.create_map(*pairs)[code]


def enum_code(name: Column, names: Mapping[int, str]) -> Column:
    forward = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    back = F.map_from_entries(F.transform(F.map_entries(forward), lambda e: F.struct(e["value"], e["key"])))
    return back[name]


def row_items(a: pa.Array, i: int) -> list:
    """Row ``i``'s tokens, or characters of a string."""
    row = a[i]
    return row.values.to_numpy(zero_copy_only=False).tolist() if isinstance(row, pa.ListScalar) else list(row.as_py())


@F.arrow_udf(T.LongType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """Longest common subsequence of two token arrays, by bit-parallel rows: one step of a few machine words per token of ``b``.

    Memory is one bit per token of ``a`` for each different token that ``b`` has too. One row at a time leaves its Arrow batch.
    """
    out = []
    for i in range(len(a)):
        x, y = row_items(a, i), row_items(b, i)
        at: dict = dict.fromkeys(y, 0)
        for j, token in enumerate(x):
            if token in at:
                at[token] |= 1 << j
        full = (1 << len(x)) - 1
        row = full
        for token in y:
            hit = row & at[token]
            row = ((row + hit) | (row - hit)) & full
        out.append(len(x) - row.bit_count())
    pa.default_memory_pool().release_unused()  # workers are reused: what a batch needed is not kept
    return pa.array(out, pa.int64())

