"""Greedy matching and suppression by ordered streams, by components and by rounds, all against the sequential pass."""
import random

import pyarrow as pa
import pytest

from test_operators import frames, iou_py, sequential_match
from tidegauge.operators import detection as D
from tidegauge.operators.components import connected
from tidegauge.session import settle

THR = (0.1, 0.4)


def sequential_keep(preds, floor, limit):
    kept = []
    for q in sorted((q for q in preds if q[4] >= floor), key=lambda q: (-q[4], q[0])):
        if not any(k[1] == q[1] and iou_py(k[3], q[3]) > limit for k in kept):
            kept.append(q)
    return {q[0] for q in kept}


def crowd(seed):
    """Image 0: many small heaps apart from each other and one large heap; images 1 and 2: a few boxes."""
    r = random.Random(seed)
    box = lambda x, y: (lambda a, b: (a, b, a + r.randrange(10, 30), b + r.randrange(10, 30)))(x + r.randrange(20), y + r.randrange(20))
    at = [(100 * (i % 5), 100 * (i // 5)) for i in range(15)] + [(900, 0)] * 12
    truths = [(i, 0, 0, box(*at[i % len(at)])) for i in range(60)] + [(100 + i, 1 + i % 2, 0, box(0, 0)) for i in range(6)]
    preds = [(i, 0, 0, box(*at[i % len(at)]), round(r.random(), 1)) for i in range(110)] + [(200 + i, 1 + i % 2, 0, box(0, 0), round(r.random(), 1)) for i in range(8)]
    return preds, truths


@pytest.mark.parametrize("unit", [1, 40, D.UNIT])
def test_every_way_equals_the_sequential_pass(spark, unit):
    preds, truths = crowd(7)
    p, t = frames(spark, preds, truths)
    got = {(q["thr"], q["id"]): q["tp"] for q in D.greedy_match(p.repartition(3), t, ["image", "cls"], THR, 25.0, unit).collect()}
    for thr in THR:
        assert {i: v for (h, i), v in got.items() if h == thr} == sequential_match(preds, truths, thr)
    assert {q["id"] for q in D.suppress(p.repartition(3), ["image"], 0.2, 0.2, 25.0, unit).collect()} == sequential_keep(preds, 0.2, 0.2)


def test_a_long_chain_takes_no_more_steps(spark, monkeypatch):
    """Boxes in a row, each overlapping the next, with rising scores: rounds would settle one box after another."""
    steps = {}
    for n in (10, 1_000):
        seen = []
        monkeypatch.setattr(D, "settle", lambda df, name, seen=seen: seen.append(name) or settle(df, name))
        preds = [(i, 0, 0, (6 * i, 0, 6 * i + 10, 10), i / n) for i in range(n)]
        p, t = frames(spark, preds, [q[:4] for q in preds])
        assert {q["id"] for q in D.suppress(p, ["image"], 0.0, 0.2, 50.0).collect()} == sequential_keep(preds, 0.0, 0.2)
        assert D.greedy_match(p, t, ["image", "cls"], [0.5], 50.0).where("tp = 1").count() == n
        steps[n] = seen
    assert steps[10] == steps[1_000]


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(2)
    name = list(range(400))
    r.shuffle(name)
    edges = [(name[i], name[i + 1]) for i in range(199)] + [(name[200], name[i]) for i in range(201, 300)] + [(name[300], name[300]), (name[301], name[302]), (name[302], name[301])]
    got = dict(tuple(q) for q in connected(spark.createDataFrame(edges, "u long, v long")).collect())
    want = {}
    for part in (range(200), range(200, 300), [300], [301, 302]):
        want |= {name[i]: min(name[j] for j in part) for i in part}
    assert got == want
    assert connected(spark.createDataFrame([], "u long, v long")).collect() == []


def test_no_overlap_and_no_boxes(spark):
    p, t = frames(spark, [(1, 0, 0, (0, 0, 5, 5), 0.5)], [(1, 0, 0, (50, 50, 60, 60))])
    assert [q["tp"] for q in D.greedy_match(p, t, ["image", "cls"], [0.5]).collect()] == [0]
    assert D.suppress(p, ["image"], 0.1, 0.5).count() == 1 and D.suppress(p.limit(0), ["image"], 0.1, 0.5).count() == 0


def gaps_and_repeats(spark):
    """Boxes on a coarse grid (many ties) with repeated rows and without some keys, ids, scores and corners."""
    r = random.Random(11)
    gone = lambda x, p=0.04: None if r.random() < p else x
    box = lambda: (lambda a, b: (float(a), float(b), gone(float(a + r.choice([10, 20]))), float(b + r.choice([10, 20]))))(r.randrange(0, 30, 5), r.randrange(0, 30, 5))
    preds = [(gone(f"p{i}"), gone(i % 40), gone("AB"[i % 40 % 2]), gone(box()), gone(r.randrange(10) / 10)) for i in range(500)]
    truths = [(gone(f"t{i}"), gone(i % 40), gone("AB"[i % 40 % 2]), gone(box())) for i in range(350)]
    kind = "id string, image long, cls string, box struct<x1: double, y1: double, x2: double, y2: double>"
    return spark.createDataFrame(preds + preds[::7], f"{kind}, score double"), spark.createDataFrame(truths + truths[::5], kind)


def test_whole_images_are_matched_without_a_join(spark):
    p, t = gaps_and_repeats(spark)
    levels = [0.2, 0.5, 0.75]
    rows = lambda d: sorted([(*q[:4], sorted(q["claimed"])) for q in d.select("id", "score", "image", "cls", "claimed").collect()], key=str)
    whole = D.greedy_match(p.repartition(5), t, ["image", "cls"], levels, 25.0, wide=True)
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()
    named = "image is not null and cls is not null"
    apart = D._matched_apart(p.where(named), t.where(named), ["image", "cls"], levels, 25.0, D.UNIT)
    assert rows(whole.where(named)) == rows(apart) and sum(len(q[4]) for q in rows(apart)) > 100
    assert whole.count() == p.count() and whole.where(f"not ({named}) and size(claimed) > 0").count() == 0


def test_many_boxes_of_an_image_across_held_batches(monkeypatch):
    """Images that do not end where a batch does, pairs in pieces, and rounds that run out."""
    for name, value in (("HELD", 1), ("PAIRS", 7), ("ROUNDS", 1)):
        monkeypatch.setattr(D, name, value)
    preds, truths = crowd(3)
    run = D._match_images(["id", "image"], THR)
    both = [(m, 0, i, None, s, *map(float, b)) for i, m, c, b, s in preds] + [(m, 1, None, i, None, *map(float, b)) for i, m, c, b in truths]
    both.sort(key=lambda q: (q[0], q[1], -(q[4] or 0), q[2] or 0, q[3] or 0))
    n, rows = {}, []
    for q in both:
        n[q[0]] = n.get(q[0], 0) + 1
        rows.append((*q, n[q[0]]))
    table = pa.table([pa.array(c) for c in zip(*rows)], names=["image", "_side", "id", "_b_id", "score", *D.EDGES, "_n"])
    got = {q["id"]: q["claimed"] for b in run(iter(table.to_batches(max_chunksize=3))) for q in b.to_pylist()}
    for thr in THR:
        assert {i: int(thr in c) for i, c in got.items()} == sequential_match(preds, truths, thr)


def test_wide_and_long_matches_score_alike(spark):
    p, t = gaps_and_repeats(spark)
    levels = [0.2, 0.5, 0.75]
    p = p.where("id is not null and score is not null").dropDuplicates(["id"])
    match = lambda wide: D.greedy_match(p, t, ["image", "cls"], levels, 25.0, wide=wide)
    wide, long = (sorted(map(tuple, D.coco_average_precision(match(w), t, "cls", levels).collect()), key=str) for w in (True, False))
    assert wide == long and any(q[2] > 0 for q in wide)
