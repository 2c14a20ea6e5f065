"""Near-duplicate join and nearest vectors against brute force."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import graph as G
from tidegauge.llm import nearjoin as J
from tidegauge.llm import projected_search as P


def shingle_set(text, size=5):
    w = (text or "").split()
    return {tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute_links(texts, threshold=0.8):
    first = {}
    for i, t in enumerate(texts):
        if t is not None:
            first.setdefault(t, i)
    reps = sorted(first.values())
    sets = {i: shingle_set(texts[i]) for i in reps}
    links, parent = dict.fromkeys(reps, 0), {i: i for i in reps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(reps, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (i, i, 0) if t is None else (first[t], root(first[t]), links[first[t]]) for i, t in enumerate(texts)}


def corpus(prose, seed):
    r = random.Random(seed)
    texts = [None, None, "", "", "one", "one", "one two three", "one  two three", prose(5, 1)]
    for i in range(25):
        base = prose(r.randrange(6, 120), i).split()
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            edit = list(base)
            for _ in range(r.randrange(1, 4)):
                edit[r.randrange(len(edit))] = "edit" + str(r.randrange(9))
            texts.append(" ".join(edit))
    r.shuffle(texts)
    return texts + texts[:10]


@pytest.mark.parametrize("blocks", [(512, 256), (3, 2)])
def test_links_and_classes_equal_brute_force(docs_of, prose, monkeypatch, blocks):
    monkeypatch.setattr(J, "SIGNATURE_BLOCK", blocks[0])
    monkeypatch.setattr(J, "TEXT_BLOCK", blocks[1])
    texts = corpus(prose, 5)
    got = {r["doc_id"]: (r["text_id"], r["class_id"], r["n_links"]) for r in J.near_links(docs_of(texts)).collect()}
    assert got == brute_links(texts)


def test_large_group_of_near_copies_is_counted_whole(docs_of, prose, monkeypatch):
    monkeypatch.setattr(J, "TEXT_BLOCK", 32)
    monkeypatch.setattr(J, "SIGNATURE_BLOCK", 50)
    base = prose(150, 3).split()
    texts = [" ".join(base[:i % 150] + [f"v{i}"] + base[i % 150 + 1:]) for i in range(200)]
    got = J.near_links(docs_of(texts)).collect()
    assert {r["class_id"] for r in got} == {0}
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: v[2] for i, v in brute_links(texts).items()}


def test_near_edges_and_keep_one(spark, prose):
    p = prose(60, 1)
    rows = [(3, p, 1), (3, p, 2), (None, p, 3), (8, p + " x", 4), (9, None, 5), (11, None, 6), (12, "", 7), (13, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumns({"d": F.lit("own"), "s": F.lit("own")})
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in J.near_links(docs).collect()), key=str)
    assert got == sorted([(3, 3, 1), (3, 3, 1), (8, 3, 1), (9, 9, 0), (11, 11, 0), (12, 12, 0), (13, 12, 0), (None, None, 0)], key=str)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [3, None, 9, 11, 12]))
    assert J.near_links(docs.limit(0)).count() == 0 and J.keep_one(docs.limit(0)).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    table = J.prune_table(0.8, 1e-7)
    assert list(table) == list(range(J.STEP, J.HASHES + 1, J.STEP)) and all(a <= b for a, b in zip(table.values(), list(table.values())[1:]))
    rng = np.random.default_rng(0)
    agree = (rng.random((200_000, J.HASHES)) < 0.8).cumsum(1)
    lost = np.zeros(len(agree), bool)
    for n, m in table.items():
        lost |= agree[:, n - 1] <= m
    assert lost.sum() == 0 and table[J.HASHES] > 0.4 * J.HASHES


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 60)] + [(7, 7), (5, 6), (300, 299)]
    got = {r["v"]: r["label"] for r in G.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(5, 60)) and got[300] == got[299] == 299
    assert G.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_nearest(ids, x, queries, k):
    n = np.sqrt((x * x).sum(1))
    out = {}
    for i in queries:
        s = (x * x[i]).sum(1) / (n * n[i])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def vectors_of(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(P, "CANDIDATES", 400)
    monkeypatch.setattr(P, "QUERIES", 7)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(1500, 24)) + 2 * rng.normal(size=(15, 24))[rng.integers(0, 15, 1500)]).astype(np.float32).astype(float)
    ids = rng.permutation(5000)[:1500]
    df = vectors_of(spark, ids, x)
    asked = np.flatnonzero(ids % 50 == 0)
    got = P.nearest(df.where("vec_id % 50 = 0"), df, 5).collect()
    want = brute_nearest(ids, x, asked, 5)
    hits = sum(r["vec_id"] in [v for v, _ in want[r["query_id"]]] for r in got)
    assert hits >= 0.9 * 5 * len(asked) and len(got) == 5 * len(asked)
    at = {int(i): n for n, i in enumerate(ids)}
    for r in got:
        a, b = x[at[r["query_id"]]], x[at[r["vec_id"]]]
        assert r["score"] == pytest.approx((a @ b) / np.sqrt((a @ a) * (b @ b)), abs=1e-14)


def test_ties_copies_and_unusable_vectors(spark):
    same = [0.5, 0.25, -1.0]
    rows = [(i, same) for i in range(50, 90)] + [(50, same), (100, [1.0, 0.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 0.0]),
                                                (6, [float("inf"), 0.0, 0.0]), (None, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "v": F.lit("y"), "g": F.lit(0)})
    got = P.nearest(df.where("vec_id % 50 = 0 or vec_id in (1, 3, 5)"), df, 5).orderBy("query_id", "rank").collect()
    by = {q: [r["vec_id"] for r in got if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert by == {50: [51, 52, 53, 54, 55], 100: [50, 51, 52, 53, 54]}
    assert P.nearest(df.limit(0), df).count() == 0 and P.nearest(df, df.limit(0)).count() == 0
    few = df.where("vec_id in (50, 100)")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in P.nearest(few, few, 5).collect()) == [(50, 1, 100), (100, 1, 50)]


def test_chi_square_values():
    # fixed values: textbook quantiles
    assert P.chi_square_quantile(0.95, 8) == pytest.approx(15.50731, abs=1e-4)
    assert P.chi_square_cdf(3.84146, 1) == pytest.approx(0.95, abs=1e-5)
