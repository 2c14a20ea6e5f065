"""Box matching and suppression. Images of a bounded number of pairs are matched in numpy, many at a time, from one sorted stream of boxes.
In larger ones, and in suppression, candidate pairs come from shared grid cells, not from pairing all boxes of
an image. The greedy order of an image is one ordered stream of its pairs; an image with more pairs than a task should
take is cut into the components of its overlaps, and a component still larger is resolved in rounds."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.scalar import iou
from tidegauge.operators.components import connected
from tidegauge.operators.ordering import running_sums
from tidegauge.session import settle

UNIT = 1_000_000  # pairs that one task may take in order; more go another way to the same result


def _cells(box: Column, size: float) -> Column:
    span = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    return F.flatten(F.transform(span(box["x1"], box["x2"]), lambda i: F.transform(span(box["y1"], box["y2"]), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


CROWD = 64  # boxes of an image above which its boxes meet in grid cells, not each with each


def _sides(a: DataFrame, b: DataFrame, keys: Sequence[str], extra=()) -> tuple[DataFrame, DataFrame]:
    return tuple(d.select(*keys, F.col("id").alias(f"{n}_id"), F.col("score").alias(f"{n}_score"), F.col("box").alias(f"{n}_box"), *extra) for n, d in (("a", a), ("b", b)))


def _in_cells(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Boxes meet in the cells they cover; a pair is kept only in the cell of its intersection's lower corner, which makes it unique without a distinct."""
    left, right = _sides(a, b, keys, [F.inline(_cells(F.col("box"), cell))])
    j = left.join(right, [*keys, "cx", "cy"])
    home = (F.floor(F.greatest("a_box.x1", "b_box.x1") / cell) == F.col("cx")) & (F.floor(F.greatest("a_box.y1", "b_box.y1") / cell) == F.col("cy"))
    return j.where(home).drop("cx", "cy")


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float, crowd: int = CROWD) -> DataFrame:
    """Pairs with a positive overlap: (keys, a.id, b.id, iou, both scores where present).

    In an image of at most ``crowd`` boxes on either side each box meets each other one, and a box moves once; only larger images copy their boxes to grid cells.
    """
    keys = list(keys)
    full = lambda d: d.groupBy(*keys).count().where(F.col("count") > crowd).select(*keys)
    crowded = settle(full(a) if a is b else full(a).unionByName(full(b)).distinct(), "crowded-images")
    if crowded.isEmpty():
        left, right = _sides(a, b, keys)
        j = left.join(right, keys)
    else:
        left, right = _sides(*(d.join(crowded, keys, "left_anti") for d in (a, b)), keys)
        j = left.join(right, keys).unionByName(_in_cells(*(d.join(crowded, keys, "left_semi") for d in (a, b)), keys, cell))
    return j.withColumn("iou", iou(F.col("a_box"), F.col("b_box"))).where("iou > 0").drop("a_box", "b_box")


def units(pairs: DataFrame, keys: Sequence[str], unit: int, bipartite: bool) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``pairs`` of images with at most ``unit`` pairs; of components (column ``_c``) of larger images; of larger components."""
    large = settle(pairs.groupBy(*keys).count().where(F.col("count") > unit).select(*keys), "crowded")
    if large.isEmpty():
        return pairs, None, None
    crowd = settle(pairs.join(large, [*keys], "left_semi"), "crowd")
    a, b = F.struct(F.lit(0).alias("side"), F.col("a_id").alias("id")), F.struct(F.lit(int(bipartite)).alias("side"), F.col("b_id").alias("id"))
    label = connected(crowd.select(a.alias("u"), b.alias("v"))).where("v.side = 0").select(F.col("v.id").alias("a_id"), F.col("c").alias("_c"))
    crowd = settle(crowd.join(label, "a_id"), "crowd")
    giants = crowd.groupBy("_c").count().where(F.col("count") > unit).select("_c")
    return pairs.join(large, [*keys], "left_anti"), crowd.join(giants, "_c", "left_anti"), crowd.join(giants, "_c", "left_semi").drop("_c")


def _types(df: DataFrame, *names: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def _claims_in_order(pairs: DataFrame, by: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """(thr, a_id, b_id): one pass over each unit by falling score, then falling overlap; a task holds what the present unit claimed."""
    by, levels = list(by), [float(x) for x in thresholds]

    def claim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, taken = None, set()
        for pdf in batches:
            out = []
            for *key, a, b, x in zip(*[pdf[k] for k in by], pdf["a_id"], pdf["b_id"], pdf["iou"]):
                if key != unit:
                    unit, taken = key, set()
                for thr in levels:
                    if x >= thr and (thr, 0, a) not in taken and (thr, 1, b) not in taken:
                        taken.update([(thr, 0, a), (thr, 1, b)])
                        out.append((thr, a, b))
            yield pd.DataFrame(out, columns=["thr", "a_id", "b_id"])

    order = [*by, F.desc("a_score"), "a_id", F.desc("iou"), "b_id"]
    rows = pairs.repartition(*by).sortWithinPartitions(*order).select(*by, "a_id", "b_id", "iou")
    return rows.mapInPandas(claim, "thr double, " + _types(pairs, "a_id", "b_id"))


def _claims_in_rounds(pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame | None:
    """The same without an order over all pairs: where no open detection with a higher score could still want a truth, the claim is final."""
    thr = F.explode(F.filter(F.array(*[F.lit(float(x)) for x in thresholds]), lambda x: x <= F.col("iou")))
    open_ = settle(pairs.withColumn("thr", thr).select("thr", "a_id", "a_score", "b_id", "iou"), "candidates")
    claims = None
    while not open_.isEmpty():
        best = open_.groupBy("thr", "a_id").agg(F.min_by("b_id", F.struct(-F.col("iou"), "b_id")).alias("b_id"))
        first = open_.groupBy("thr", "b_id").agg(F.min_by("a_id", F.struct(-F.col("a_score"), "a_id")).alias("a_id"))
        won = settle(best.join(first, ["thr", "a_id", "b_id"]).select("thr", "a_id", "b_id"), "claims")
        claims = won if claims is None else claims.unionByName(won)
        open_ = settle(open_.join(won.select("thr", "a_id"), ["thr", "a_id"], "left_anti").join(won.select("thr", "b_id"), ["thr", "b_id"], "left_anti"), "candidates")
    return claims


HELD = 1 << 16  # boxes of whole images that are matched at a time
PAIRS = 1 << 18  # pairs at a time, more only where a single image has more
ROUNDS = 32  # after so many the pairs still open are taken one by one
EDGES = ("x1", "y1", "x2", "y2")


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``iou`` of boxes in rows x1, y1, x2, y2, by the same arithmetic."""
    with np.errstate(all="ignore"):
        w = np.maximum(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), 0.0)
        h = np.maximum(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]), 0.0)
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
        return np.where(union > 0, w * h / union, 0.0)


def _first_come(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks over n numbers of what the greedy pass over the pairs (a, b), in their order, takes on either side.

    A pair that is the first open one of both its sides is taken by the sequential pass whatever else happens, so all such pairs are taken at once.
    """
    took_a, took_b = np.zeros(n, bool), np.zeros(n, bool)
    first_a, first_b = np.empty(n, np.int64), np.empty(n, np.int64)
    for _ in range(ROUNDS):
        if not len(a):
            return took_a, took_b
        at = np.arange(len(a))
        first_a[a[::-1]] = at[::-1]  # the last one written stays
        first_b[b[::-1]] = at[::-1]
        won = (first_a[a] == at) & (first_b[b] == at)
        took_a[a[won]] = took_b[b[won]] = True
        left = ~(took_a[a] | took_b[b])
        a, b = a[left], b[left]
    for x, y in zip(a.tolist(), b.tolist()):
        if not took_a[x] and not took_b[y]:
            took_a[x] = took_b[y] = True
    return took_a, took_b


def _numbers(ids: pa.Array, group: np.ndarray) -> np.ndarray:
    """A number below the number of rows for each (group, id); equal ids of a group are one, so are null ones."""
    code = ids.dictionary_encode()
    at = np.asarray(code.indices.fill_null(len(code.dictionary))).astype(np.int64)
    if len(code.dictionary) == len(ids):
        return at
    return np.unique(group * (len(code.dictionary) + 1) + at, return_inverse=True)[1]


def _match_images(keep: Sequence[str], levels: Sequence[float]):
    """Rows of whole images, each image's detections in their order before its truths in theirs, to detections with the levels at which they have a truth."""

    def match(rows: pa.Table) -> pa.RecordBatch:
        side, group = np.asarray(rows["_side"]), np.cumsum(np.asarray(rows["_n"]) == 1) - 1
        box = np.stack([rows[e].to_numpy() for e in EDGES])  # null as NaN, whose overlap reaches no level
        n_groups = int(group[-1]) + 1
        preds = np.flatnonzero(side == 0)
        na, nb = (np.bincount(group[side == k], minlength=n_groups) for k in (0, 1))
        first_b = np.concatenate([[0], np.cumsum(na + nb)])[:-1] + na
        a_number, b_number = (_numbers(rows[c].combine_chunks(), group) for c in ("id", "_b_id"))
        partners = nb[group[preds]]
        before, i, j, x = np.concatenate([[0], np.cumsum(partners)]), [], [], []
        lo = 0
        while lo < len(preds):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + PAIRS, "right")) - 1)
            many = partners[lo:hi]
            p = np.repeat(preds[lo:hi], many)
            t = np.arange(len(p)) - np.repeat(before[lo:hi] - before[lo], many) + first_b[group[p]]
            overlap = _iou(box[:, p], box[:, t])
            on = (overlap > 0) & (overlap >= min(levels))
            i, j, x = [*i, p[on]], [*j, t[on]], [*x, overlap[on]]
            lo = hi
        i, j, x = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (i, j, x))
        order = np.lexsort((-x, i))  # equal overlaps stay in the order of the truths
        a, b, x = a_number[i[order]], b_number[j[order]], x[order]
        has = np.zeros((len(preds), len(levels)), bool)
        for k, level in enumerate(levels):
            on = x >= level
            has[:, k] = _first_come(a[on], b[on], rows.num_rows)[0][a_number[preds]]
        has[~np.asarray(rows["id"].is_valid())[preds]] = False  # a detection without an id names no row
        claimed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has.sum(1))]).astype(np.int32)), pa.array(np.array(levels)[np.nonzero(has)[1]]))
        out = rows.select(list(keep)).take(pa.array(preds)).append_column("claimed", claimed)
        return out.combine_chunks().to_batches()[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < HELD:
                continue
            rows = pa.Table.from_batches(held)
            last = int(np.flatnonzero(np.asarray(rows["_n"]) == 1)[-1])
            if last and (np.asarray(rows["_side"])[:last] == 0).any():
                yield match(rows.slice(0, last))
            held = rows.slice(last).to_batches()  # the last image may go on
            n = 0 if last else n
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and (np.asarray(rows["_side"]) == 0).any():
            yield match(rows)

    return scan


def _matched_whole(preds: DataFrame, truths: DataFrame, keys: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """(id, score, keys, claimed) of detections whose images one task may pair at once; a box moves once."""
    edges = [F.col("box")[e].cast("double").alias(e) for e in EDGES]
    kind = {f.name: f.dataType for f in preds.schema.fields} | {"_b_id": {f.name: f.dataType for f in truths.schema.fields}["id"]}
    null = lambda c: F.lit(None).cast(kind[c])
    a = preds.select(*keys, F.lit(0).alias("_side"), "id", null("_b_id").alias("_b_id"), "score", *edges)
    b = truths.select(*keys, F.lit(1).alias("_side"), null("id").alias("id"), F.col("id").alias("_b_id"), null("score").alias("score"), *edges)
    order = Window.partitionBy(*keys).orderBy("_side", F.desc("score"), "id", "_b_id")
    both = a.unionByName(b).withColumn("_n", F.row_number().over(order))
    keep = ["id", "score", *keys]
    fields = [T.StructField(f.name, f.dataType) for f in both.select(*keep).schema.fields]
    out = both.mapInArrow(_match_images(keep, [float(x) for x in thresholds]), T.StructType([*fields, T.StructField("claimed", T.ArrayType(T.DoubleType()))]))
    return out.select(*[F.col(c).cast(kind[c]).alias(c) for c in keep], "claimed")


def _matched_apart(preds: DataFrame, truths: DataFrame, keys: Sequence[str], thresholds: Sequence[float], cell: float, unit: int) -> DataFrame:
    """The same for images of very many boxes: grid cells, then ordered streams, components or rounds."""
    t = truths.withColumn("score", F.lit(0.0)) if "score" not in truths.columns else truths
    pairs = overlapping(preds, t, keys, cell).where(F.col("iou") >= float(min(thresholds)))
    pairs = settle(pairs.select(*keys, "a_id", "a_score", "b_id", "iou"), "candidates")
    small, parts, giants = units(pairs, keys, unit, bipartite=True)
    claims = _claims_in_order(small, keys, thresholds)
    if parts is not None:
        claims = claims.unionByName(_claims_in_order(parts, ["_c"], thresholds))
        more = _claims_in_rounds(giants, thresholds)
        claims = claims if more is None else claims.unionByName(more)
    hit = claims.groupBy(F.col("a_id").alias("id")).agg(F.collect_list("thr").alias("claimed"))  # as many as thresholds
    found = preds.select("id", "score", *keys).join(hit, "id", "left")
    return found.withColumn("claimed", F.coalesce("claimed", F.array().cast("array<double>"))).select("id", "score", *keys, "claimed")


def greedy_match(preds: DataFrame, truths: DataFrame, keys: Sequence[str], thresholds: Sequence[float], cell: float = 50.0, unit: int = UNIT, wide: bool = False) -> DataFrame:
    """(id, score, keys, thr, tp): detections in descending score claim their best unclaimed truth.

    Claims never cross images or classes. The outcome equals the sequential pass whatever ``unit`` is: an image of at most so many boxes and pairs is matched
    in numpy as a whole. ``preds`` and ``truths`` have id, box
    (and score); ids are unique over all images. Equal scores and overlaps go to the smaller id. ``wide``: one row a detection, with the
    array ``claimed`` of the thresholds at which it has a truth, instead of one row a threshold.
    """
    keys = list(keys)
    named = None
    for k in keys:
        named = F.col(k).isNotNull() if named is None else named & F.col(k).isNotNull()
    p, t = preds.where(named), truths.where(named)
    sides = p.select(*keys, F.lit(1.0).alias("_a"), F.lit(0.0).alias("_b")).unionByName(t.select(*keys, F.lit(0.0).alias("_a"), F.lit(1.0).alias("_b")))
    crowded = settle(sides.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).where("_a * _b > {0} or _a + _b > {0}".format(unit)).select(*keys), "crowded-images")
    if crowded.isEmpty():
        found = _matched_whole(p, t, keys, thresholds)
    else:
        found = _matched_whole(*(d.join(crowded, keys, "left_anti") for d in (p, t)), keys, thresholds)
        found = found.unionByName(_matched_apart(*(d.join(crowded, keys, "left_semi") for d in (p, t)), keys, thresholds, cell, unit))
    bare = preds.where(~named).select("id", "score", *keys, F.array().cast("array<double>").alias("claimed"))  # no image or class to claim in
    found = found.unionByName(bare)
    if wide:
        return found
    grid = found.withColumn("thr", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    return grid.select("thr", "id", "score", *keys, F.array_contains("claimed", F.col("thr")).cast("long").alias("tp"))


def _packed(cls: str, levels: Sequence[float]):
    """A partition of detections in order to rows of (class, partition, place, n, hits a level, hits as bits)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.asarray(batch.column(cls).dictionary_encode().indices)
            head = np.concatenate([[0], np.flatnonzero(np.diff(names)) + 1])
            claimed = batch.column("claimed")
            value, owner = np.asarray(claimed.flatten()), np.repeat(np.arange(batch.num_rows), np.asarray(claimed.value_lengths()))
            hit = np.zeros((batch.num_rows, len(levels)), bool)
            for k, level in enumerate(levels):
                hit[owner[value == level], k] = True
            ends = np.concatenate([head[1:], [batch.num_rows]])
            bits = [np.packbits(hit[lo:hi], axis=1).tobytes() for lo, hi in zip(head, ends)]
            sums = [hit[lo:hi].sum(0, dtype=np.int64).tolist() for lo, hi in zip(head, ends)]
            places = np.arange(place, place + len(head))
            place += len(head)
            yield pa.RecordBatch.from_arrays([batch.column(cls).take(pa.array(head)), pa.array(np.full(len(head), part)), pa.array(places), pa.array(ends - head),
                                              pa.array(sums, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=[cls, "_b", "_at", "n", "hits", "bits"])

    return scan


def _best_at_levels(cls: str, levels: Sequence[float]):
    """Rows of ``_packed`` with what came before them to (class, thr, level of recall, best precision, highest recall)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, thr, level, best, top = [], [], [], [], []
            col = lambda c: batch.column(c).to_pylist()
            for row, (n, bits, seen, before, truths) in enumerate(zip(*map(col, ("n", "bits", "_seen", "_hits", "num_gt")))):
                hit = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(n, -1), axis=1)[:, :len(levels)]
                tp = np.cumsum(hit, axis=0, dtype=np.int64) + np.array(before)
                recall, precision = tp / truths, tp / (np.arange(seen + 1, seen + n + 1)[:, None])
                lev = np.floor(recall * 100 + 1e-9).astype(np.int32)
                for k, x in enumerate(levels):
                    head = np.concatenate([[0], np.flatnonzero(np.diff(lev[:, k])) + 1])
                    at += [row] * len(head)
                    thr += [x] * len(head)
                    level.append(lev[head, k])
                    best.append(np.maximum.reduceat(precision[:, k], head))
                    top.append(np.maximum.reduceat(recall[:, k], head))
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(cls).take(pa.array(at)), pa.array(thr, pa.float64()), *[pa.array(np.concatenate(v)) for v in (level, best, top)]],
                                                 names=[cls, "thr", "level", "p", "recall"])

    return scan


def _levels_reached(matches: DataFrame, n: DataFrame, cls: str, levels: Sequence[float]) -> DataFrame:
    """(class, thr, level, p, recall) from one order of the detections of a class for all thresholds.

    A task of the order packs what it read, a few thousand detections a row, with their number and hits; the sums before a row come
    from those, so the second pass neither sorts nor moves detections.
    """
    one = settle(matches.where(F.col(cls).isNotNull()).select("id", "score", cls, "claimed"), "matches")
    keys = [F.col(cls), (-F.col("score")).alias("_s"), F.col("id")]
    width = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = one.select(*keys, "claimed").repartitionByRange(width, cls, "_s", "id").sortWithinPartitions(cls, "_s", "id").select(cls, "claimed")
    kind = placed.schema[cls].dataType
    long = T.LongType()
    fields = [("_b", long), ("_at", long), ("n", long), ("hits", T.ArrayType(long)), ("bits", T.BinaryType())]
    packed = settle(placed.mapInArrow(_packed(cls, levels), T.StructType([T.StructField(cls, kind), *[T.StructField(*f) for f in fields]])), "packed")
    before = Window.partitionBy(cls).orderBy("_b", "_at").rowsBetween(Window.unboundedPreceding, -1)  # a row in some thousand detections
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = packed.select(cls, "_b", "_at", total("n").alias("_seen"), F.array(*[total(F.col("hits")[k]) for k in range(len(levels))]).alias("_hits"))
    rows = packed.join(offsets, [cls, "_b", "_at"]).join(F.broadcast(n), cls)  # a row a class
    out = T.StructType([T.StructField(cls, kind), *[T.StructField(c, t) for c, t in (("thr", T.DoubleType()), ("level", T.IntegerType()), ("p", T.DoubleType()), ("recall", T.DoubleType()))]])
    return rows.select(cls, "n", "bits", "_seen", "_hits", "num_gt").mapInArrow(_best_at_levels(cls, levels), out)


def coco_average_precision(matches: DataFrame, truths: DataFrame, cls: str, thresholds: Sequence[float]) -> DataFrame:
    """101-point interpolated average precision and recall per class and threshold. ``matches`` in either form of ``greedy_match``.

    All thresholds share one order of the detections of a class, so wide matches are ordered once for all of them.
    """
    n = truths.groupBy(cls).agg(F.count(F.lit(1)).alias("num_gt"))
    # highest recall level a rank reaches; the envelope then runs over at most 101 levels
    if "claimed" in matches.columns:
        reached = _levels_reached(matches, n, cls, [float(x) for x in thresholds])
    else:
        matches = settle(matches, "matches")
        r = running_sums(matches, [-F.col("score"), "id"], {"_tp": "tp", "_rank": F.lit(1).cast("long")}, [cls, "thr"]).join(n, cls)
        r = r.withColumn("recall", F.col("_tp") / F.col("num_gt")).withColumn("p", F.col("_tp") / F.col("_rank"))
        reached = r.withColumn("level", F.floor(F.col("recall") * 100 + 1e-9).cast("int"))
    lev = reached.groupBy(cls, "thr", "level").agg(F.max("p").alias("p"), F.max("recall").alias("recall"))
    spread = lev.groupBy(cls, "thr").agg(F.collect_list(F.struct("level", "p")).alias("l"), F.max("recall").alias("ar"))
    at = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda k: F.coalesce(F.array_max(F.transform(F.filter("l", lambda e: e["level"] >= k), lambda e: e["p"])), F.lit(0.0)))
    found = spread.select(cls, "thr", (F.aggregate(at, F.lit(0.0), lambda s, x: s + x) / 101).alias("ap"), "ar")
    grid = n.select(cls, F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("thr"))
    return grid.join(found, [cls, "thr"], "left").na.fill(0.0, ["ap", "ar"])  # a class without detections scores 0


def mean_average_precision(ap: DataFrame, cls: str) -> DataFrame:
    """mAP@0.5, mAP over all thresholds, and mean recall."""
    return ap.agg(F.avg(F.when(F.abs(F.col("thr") - 0.5) < 1e-9, F.col("ap"))).alias("map_50"), F.avg("ap").alias("map"), F.avg("ar").alias("mar"))


def _lost_in_order(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(id): one pass over each unit by falling score of the worse box, whose better ones are then settled; a task holds the unit's lost boxes."""
    by = list(by)

    def lose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, lost = None, set()
        for pdf in batches:
            out = []
            for *key, better, worse in zip(*[pdf[k] for k in by], pdf["a_id"], pdf["b_id"]):
                if key != unit:
                    unit, lost = key, set()
                if better not in lost and worse not in lost:
                    lost.add(worse)
                    out.append(worse)
            yield pd.DataFrame({"id": out})

    rows = edges.repartition(*by).sortWithinPartitions(*by, F.desc("b_score"), "b_id").select(*by, "a_id", "b_id")
    return rows.mapInPandas(lose, _types(edges.withColumnRenamed("a_id", "id"), "id"))


def _lost_in_rounds(edges: DataFrame) -> DataFrame | None:
    """The same in rounds: a box without an open better neighbour is kept, and boxes that overlap a kept one are lost."""
    edges = settle(edges.select(F.col("a_id").alias("better"), F.col("b_id").alias("worse")), "edges")
    gone = None
    while not edges.isEmpty():
        kept = edges.select(F.col("better").alias("id")).distinct().join(edges.select(F.col("worse").alias("id")), "id", "left_anti")
        lost = settle(edges.join(kept.withColumnRenamed("id", "better"), "better", "left_semi").select(F.col("worse").alias("id")).distinct(), "lost")
        gone = lost if gone is None else gone.unionByName(lost)
        left = edges.join(lost.withColumnRenamed("id", "worse"), "worse", "left_anti")
        edges = settle(left.join(lost.withColumnRenamed("id", "better"), "better", "left_anti"), "edges")
    return gone


def suppress(preds: DataFrame, keys: Sequence[str], score_threshold: float, iou_threshold: float, cell: float = 50.0, unit: int = UNIT) -> DataFrame:
    """Score filter, then non-maximum suppression per image; the outcome equals the sequential pass in descending score whatever ``unit`` is."""
    keys = list(keys)
    p = settle(preds.where(F.col("score") >= score_threshold), "boxes")
    better = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_id") < F.col("b_id")))
    pairs = settle(overlapping(p, p, keys, cell).where((F.col("iou") > iou_threshold) & better).select(*keys, "a_id", "b_id", "b_score"), "edges")
    small, parts, giants = units(pairs, keys, unit, bipartite=False)
    gone = _lost_in_order(small, keys)
    if parts is not None:
        gone = gone.unionByName(_lost_in_order(parts, ["_c"]))
        more = _lost_in_rounds(giants)
        gone = gone if more is None else gone.unionByName(more)
    return p.join(gone, "id", "left_anti")
