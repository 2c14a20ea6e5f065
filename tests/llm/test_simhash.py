"""SimHash components against brute force over the hash library."""
import random

import numpy as np
import pytest
import xxhash

from tidegauge.llm import popcount_join as S

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = [x for x in "".join(c if c not in " \t\n\v\f\r" else " " for c in (text or "").translate(LETTERS)).split(" ") if x]
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids, prints, radius=3):
    label = list(range(len(ids)))
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (prints[i] ^ prints[j]).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, []).append(ids[i])
    return [min((d for d in groups[x] if d is not None), default=None) for x in label]


def test_hashes_of_slices_of_every_length():
    r = np.random.default_rng(3)
    raw = r.integers(0, 256, 20_000, dtype=np.uint8)
    start = np.concatenate([np.arange(0, 700), r.integers(0, 9_000, 200)])
    end = start + np.concatenate([np.arange(0, 700), r.integers(0, 40, 200)])
    assert S.xxh64(raw, start, end).tolist() == [xxhash.xxh64_intdigest(raw[a:b].tobytes(), 42) for a, b in zip(start, end)]


@pytest.mark.parametrize("width", [2, 4, 8])
def test_embedding_is_a_lower_bound_and_near_points_share_a_cell(width):
    r = np.random.default_rng(width)
    x = r.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    y = x.copy()
    for k in range(400):
        for b in r.choice(64, k % 6, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    s, t = S.thermometer(x, width), S.thermometer(y, width)
    counts = lambda v: np.array([[(int(z) >> k & (1 << width) - 1).bit_count() for k in range(0, 64, width)] for z in v])
    apart = np.bitwise_count(s ^ t)
    assert apart.tolist() == np.abs(counts(x) - counts(y)).sum(1).tolist()
    assert (apart <= np.bitwise_count(x ^ y)).all()
    for radius in (1, 3, 4):
        masks = np.array(S.grids(radius, width), np.int64).view(np.uint64)
        assert all(((a ^ b) & masks == 0).any() for a, b, d in zip(s, t, apart) if d <= radius)


def corpus(prose):
    r = random.Random(5)
    texts = ["", None, " \t\n", "One", "one", "one two", "one  TWO", "one two three", "É é", "x" * 5_000 + " b c", "a " * 700]
    for i in range(20):
        base = prose(r.randrange(3, 400), i).split()
        texts.append(" ".join(base))
        for _ in range(r.randrange(5)):
            edit = list(base)
            edit[r.randrange(len(edit))] = "edit" + str(r.randrange(9))
            texts.append("\n".join(edit).upper())
    return texts + texts[:15]


@pytest.mark.parametrize("block", [1024, 3])
def test_components_equal_brute_force(docs_of, prose, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    texts = corpus(prose)
    prints = [fingerprint(t) for t in texts]
    want = dict(enumerate(brute(list(range(len(texts))), prints)))
    got = {r["doc_id"]: r for r in S.simhash_components(docs_of(texts)).collect()}
    assert len(got) == len(texts)
    assert {d: (r["fingerprint"] % 2**64, r["component_id"]) for d, r in got.items()} == {d: (prints[d], want[d]) for d in got}


def test_dense_cluster_of_fingerprints_keeps_every_link(spark):
    """Thousands of points a few bits from a centre, and chains: components of the range join equal those of all pairs."""
    r = random.Random(2)
    centre, prints = r.getrandbits(64), set()
    while len(prints) < 1_200:
        prints.add(centre ^ sum({1 << r.randrange(64) for _ in range(r.randrange(5))}))
    at = r.getrandbits(64)
    for _ in range(60):
        at ^= sum({1 << r.randrange(64) for _ in range(3)})
        prints.add(at)
    x = np.array(sorted(prints), np.uint64)
    code = S.thermometer(x, 2)
    points = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x.view(np.int64), code.view(np.int64))], "fp long, code long")
    found = S.components(S.links(points)).collect()
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    label = S.forest(len(x), *np.nonzero(np.triu(near, 1)))
    want = {}
    for i, v in enumerate(label):
        want.setdefault(v, set()).add(int(x[i]))
    got = {}
    for v in found:
        got.setdefault(v["label"], set()).add(v["v"] % 2**64)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_cells_of_the_points_are_never_broadcast(spark):
    """Points under Spark's broadcast size become a row a grid, so no side that comes from them may be collected by the driver."""
    prints = [random.Random(i // 2).getrandbits(64) ^ i % 2 for i in range(200)]
    x = np.array(prints, np.uint64)
    points = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x.view(np.int64), S.thermometer(x, 2).view(np.int64))], "fp long, code long")
    found = S.links(S.settle(points, "points"))  # written, so that Spark knows a size
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {frozenset((r["u"] % 2**64, r["v"] % 2**64)) for r in found.collect()} == {frozenset(prints[i:i + 2]) for i in range(0, 200, 2)}


def test_nulls_repeats_clashing_columns_and_the_empty_table(spark):
    rows = [(None, "a b c d e", 1, "x"), (7, "a b c d e", 2, "y"), (7, "a b c d e", 2, "y"), (3, None, 3, None), (None, "", 4, "z"), (9, "q r s t u v", 5, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, label string")
    got = sorted(map(tuple, S.simhash_components(docs).select("doc_id", "component_id", "n_alike").collect()), key=str)
    assert got == sorted([(None, 7, 3), (7, 7, 3), (7, 7, 3), (3, 3, 2), (None, 3, 2), (9, 9, 1)], key=str)
    assert S.simhash_components(docs.where("doc_id > 99")).collect() == []


def test_registered_query_equals_brute_force(spark, sf):
    from tidegauge.llm.op11 import op11_simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = np.array([fingerprint(r["text"]) for r in docs], np.uint64)
    ids = np.array([r["doc_id"] for r in docs])
    label = S.forest(len(ids), *np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3, 1)))
    least = {v: min(ids[label == v]) for v in set(label)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op11_simhash(spark, sf).collect()}
    assert got == {d: (f"{p:016x}", least[v]) for d, p, v in zip(ids, prints, label)}
