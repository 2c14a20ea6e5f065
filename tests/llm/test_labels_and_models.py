"""Quality network and toxic passages: learning, whole texts, edges."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import quality_net as Q
from tidegauge.llm import toxic_spans as X
from tidegauge.llm.labelled import remainder


def sample(n, seed):
    """(text, good): prose, or prose with symbols, separators, capitals or repeated words."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = ["".join(r.choice("abcdeiorstlm") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(30, 120))]
        kind = r.randrange(8)
        if kind == 0:
            w = [x + r.choice(["###", "%%%", "&&&"]) for x in w]
        elif kind == 1:
            w = [x for a in w for x in (a, "|")]
        elif kind == 2:
            w = [x for a in w[::8] for x in [a] * 8]
        out.append((" ".join(w).capitalize() + ".", int(kind > 2)))
    return out


def test_network_learns_and_reads_whole_texts(spark):
    train = sample(600, 1)
    net = Q.train([t.encode() for t, _ in train], np.array([y for _, y in train], np.float32), epochs=8)
    held = sample(200, 2)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in Q.scores(docs, net).collect()}
    right = sum((got[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(held))
    assert right >= 188 and all(0 <= s <= 1 for s in got.values())
    # a text is judged by all of it: the same start, then symbols to the end
    good = " ".join(t for t, y in held if y)[:3000]
    bad = " ".join(x + "%%%" for x in good.split())
    a, b = (Q.score_bytes(net, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in (good, good[:500] + bad * 8))
    assert a > 0.5 > b


def test_score_does_not_depend_on_neighbours_in_the_batch():
    net = Q.Net.start(1)
    texts = [t.encode() for t, _ in sample(20, 3)] + [b"", b"x", "é".encode() * 700]
    one = [Q.score_bytes(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert Q.score_bytes(net, np.frombuffer(b"".join(texts), np.uint8), off) == pytest.approx(one, abs=1e-6)


def test_gradients_match_finite_differences():
    net = Q.Net.start(2)
    texts = [t.encode() for t, _ in sample(6, 4)]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    y, w = np.array([0, 1, 1, 0, 1, 0], np.float32), np.ones(6, np.float32)

    def loss():
        p = Q.score_bytes(net, raw, off)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = Q.gradients(net, raw, off, y, w)
    for name, at in (("weights", 3), ("weights", 20), ("offset", 0), ("bias", 5)):
        old = getattr(net, name)[at]
        getattr(net, name)[at] = old + 1e-2
        up = loss()
        getattr(net, name)[at] = old - 1e-2
        down = loss()
        getattr(net, name)[at] = old
        assert getattr(grad, name)[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b c"), (4, "x" * 200_000), (4, "x" * 200_000)], "doc_id long, text string").withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(1, 1), (2, None), (77, 0)], "doc_id long, quality int")
    net = Q.fit(docs, labels)  # nothing to learn from: null text, null label, no document
    got = Q.scores(docs, net).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"]
    assert Q.scores(docs.limit(0), net).count() == 0 and Q.keep_good(docs.limit(0), net).count() == 0
    assert Q.keep_good(docs, net, 0.0).count() == 5 and Q.keep_good(docs, net, 0.0).columns == docs.columns


def test_held_out_rows_teach_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = labels.where(remainder("doc_id", 5) != 0)
    flipped = labels.withColumn("toxic", F.when(remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).where(remainder("doc_id", 5) != 0)
    a, b = X.fit(docs, kept), X.fit(docs, flipped)
    assert (a.token == b.token).all() and a.slope == b.slope
    # the fold is that of zlib
    import zlib
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in labels.select("doc_id", remainder("doc_id", 5).alias("f")).collect())


def brute_segments(scores):
    """All maximal scoring segments by their definition (Ruzzo and Tompa): repeatedly the best remaining segment, shortest first."""
    def best(lo, hi):
        top = max(((sum(scores[i:j]), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
        return top

    out, todo = [], [(0, len(scores))]
    while todo:
        lo, hi = todo.pop()
        s, n, i = best(lo, hi)
        if s > 0:
            out.append((-i, -i - n, s))
            todo += [(lo, -i), (-i - n, hi)]
    return sorted(out)


def test_maximal_segments_equal_brute_force():
    r = random.Random(5)
    for _ in range(300):
        scores = [r.choice([-1.0, -1.0, -1.0, 0.75, 1.5, 2.25, 3.125]) for _ in range(r.randrange(1, 18))]
        got = X.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], -1.0)
        assert sorted(got) == brute_segments(scores), scores


def test_stems_and_words():
    import pyarrow as pa
    raw, off, _ = X.text_buffer(pa.array(["Über ÜBER überall Übermut ab abc idiot IDIOTS", "über"]))
    w, stems = X.tokens(raw, off)
    assert len(w.hashes) == 9 and w.hashes[6] != w.hashes[7] and stems[6] == stems[7]
    assert stems[2] == stems[8] and stems[0] == stems[3] and w.hashes[0] == w.hashes[1] != w.hashes[8]  # only A-Z are lower-cased
    assert stems[4] != stems[5]


def test_toxic_passages_are_found_in_long_texts(spark, prose):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        w = prose(r.randrange(20, 80), i).split()
        bad = i % 6 == 0
        if bad:
            for x in r.sample(["scumbag", "moronic", "trashy", "pathetic"], 2):
                w.insert(r.randrange(len(w)), x)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = X.fit(docs, known)
    got = {r["doc_id"]: r for r in X.passages(docs, model).collect()}
    assert all((got[i]["score"] >= 0.5) == bool(y) for i, y in labels)
    far = prose(20_000, 9) + " scumbag moronic " + prose(5_000, 10)
    long = X.passages(spark.createDataFrame([(1, far), (2, None), (3, ""), (None, "trashy")], "doc_id long, text string"), model, 0.2).orderBy("doc_id").collect()
    assert [(p["from"], p["to"]) for p in long[1]["passages"]] == [(20_000, 20_002)]
    assert long[2]["passages"] == [] and long[3]["passages"] == [] and long[2]["score"] == long[3]["score"] < 0.5
    assert X.passages(docs.limit(0), model).count() == 0
    none = X.fit(docs, known.limit(0))
    assert X.passages(docs, none).where("score >= 0.5").count() == 0


def test_a_rare_word_that_no_clean_text_holds_is_significant(spark, prose):
    words = {i: "scum" if i % 100 == 0 else "insult" for i in range(0, 1000, 10)}  # scum: in 1 % of the texts
    docs = spark.createDataFrame([(i, prose(30, i) + " " + words.get(i, "plain")) for i in range(1000)], "doc_id long, text string")
    model = X.fit(docs, spark.createDataFrame([(i, int(i in words)) for i in range(1000)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in X.passages(docs, model).collect()}
    assert [i for i in words if got[i] < 0.5] == [] and sum(got[i] >= 0.5 for i in got if i not in words) <= 5


def test_labels_of_absent_documents_use_up_no_bound(spark):
    from tidegauge.llm.labelled import training_texts
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 400, 40)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(400)], "doc_id long, quality int")
    assert {r["d"] for r in training_texts(docs, labels, "quality", 10).collect()} == set(range(0, 400, 40))
    assert training_texts(docs, labels, "quality", 4).count() == 4


def test_nothing_learned_rejects_nothing(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(sample(40, 4))], "doc_id long, text string")
    for labels in ([], [(900, 1)], [(1, 0), (2, 0), (3, 0)]):  # none, of no document, of one class
        net = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert Q.keep_good(docs, net).count() == 40
