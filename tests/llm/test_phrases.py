"""Collocations against brute force."""
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge import session
from tidegauge.llm import phrases as P

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, words=5):
    """{(lang, phrase): (a, l, r, n, score, cut, dropped)}"""
    n, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LETTERS)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, words + 1):
                f.update((lang or "und", tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in found.items():
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(g == lang and len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for (g, q), b in found.items())
        out[lang, " ".join(p)] = (a, f[lang, p[:cut]], f[lang, p[cut:]], n[lang], score, cut, inside)
    return out


def corpus(seed):
    r = random.Random(seed)
    rows = [("en", None), (None, "a b"), ("en", ""), ("fr", " .,\n"), (None, "A B\tc. d;e!f?g\x0bh\x0ci\rj")]
    for i in range(60):
        words = [r.choice(["the", "The", "cat", "sat", "é", "ÈI", "x" * 300, "on\x00", "mat"]) for _ in range(r.randrange(1, 90))]
        rows.append((r.choice(["en", "fr", None, "und"]), "".join(w + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for w in words)))
    rows += [("en", "same words again and again " * 40), ("en", "no " * 5_000)]
    return rows + rows[:7]


@pytest.mark.parametrize("least,parts", [(3, 1), (3, 6), (12, 4), (1, 2)])
def test_collocations_equal_brute_force(spark, least, parts):
    rows = corpus(least)
    if least == 1:
        rows = rows[:12]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("block", F.lit("x")).withColumn("n", F.lit(1)).repartition(parts)
    got = P.collocations(docs, least).collect()
    want = brute(rows, least)
    assert len(got) == len(want) and {(r["lang"], r["phrase"]): tuple(r)[2:] for r in got} == want
    ranked = {}
    for r in P.top(P.collocations(docs, least), 9).collect():
        ranked.setdefault(r["lang"], {})[r["rank"]] = r["phrase"]
    for lang in {k for k, _ in want}:
        best = sorted(((-v[4], -v[0], p.encode()) for (g, p), v in want.items() if g == lang and not v[6]))[:9]
        assert [ranked.get(lang, {}).get(k + 1, "").encode() for k in range(len(best))] == [p for _, _, p in best]


def test_words_that_share_a_hash_stay_apart():
    raw = np.frombuffer(b"ab cd ab ef", np.uint8)
    start, end = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    for h in (np.zeros(4, np.uint64), np.array([1, 2, 1, 2], np.uint64)):
        code, one = P.vocabulary(raw, start, end, np.zeros(4, np.int64), h)
        assert len(one) == 3 and code[0] == code[2] and len(set(code.tolist())) == 3 and [code[i] for i in one] == [0, 1, 2]
    code, one = P.vocabulary(raw, start, end, np.array([0, 0, 1, 0]), np.array([5, 6, 5, 7], np.uint64))
    assert len(one) == 4


def test_scores_beyond_64_bits_are_exact(spark):
    f = 10**13 + 7
    c1 = spark.createDataFrame([(1, "x", "a", "a", f, [f], [f])], "id long, lang string, phrase string, last string, f long, heads array<long>, tails array<long>")
    c2 = spark.createDataFrame([(2, "x", "a a", "a", f - 1, [f, f - 1], [f, f - 1], 1, 1)], "id long, lang string, phrase string, last string, f long, heads array<long>, tails array<long>, a long, b long")
    real = P.levels
    P.levels = lambda *_: ([c1, c2], spark.createDataFrame([("x", 10**15)], "lang string, total long"))
    try:
        [r] = P.collocations(None, 100, 2).collect()
    finally:
        P.levels = real
    assert r["score"] == 1000 * (f - 1) * 10**15 // (f * f)


def test_tables_without_rows_or_words(spark):
    docs = spark.createDataFrame([("en", None), (None, " ,.")], "lang string, text string")
    assert P.collocations(docs).collect() == [] and P.collocations(docs.where("lang = 'q'")).collect() == [] and P.top(P.collocations(docs), 3).collect() == []


def test_many_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "TEXT_A_BUCKET", 1500, raising=False)
    monkeypatch.setattr(P, "PAIRS_A_BUCKET", 40, raising=False)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert {(r["lang"], r["phrase"]): tuple(r)[2:] for r in P.collocations(docs, 4).collect()} == brute(rows, 4)


def test_counts_move_as_one_short_row_a_block_and_bucket(spark, monkeypatch):
    r = random.Random(3)
    docs = spark.createDataFrame([("en", " ".join(f"w{int(r.random() ** 3 * 2000)}" for _ in range(2_000))) for _ in range(40)], "lang string, text string").coalesce(2)
    moved, real = [], P._group_count
    monkeypatch.setattr(P, "_group_count", lambda rows, *rest: moved.append(rows.cache()) or real(rows, *rest))
    P.levels(docs, 2, 3)
    assert [m.count() for m in moved] == [2, 2, 2]  # two blocks, one bucket
    for m in moved[1:]:
        size, data = m.agg(F.sum("size"), F.sum(F.length("data"))).first()
        assert size > 1_000 and data < 6 * size
    for m in moved:
        m.unpersist()


def test_relations_of_finished_levels_are_deleted(spark, monkeypatch):
    made = []
    monkeypatch.setattr(P, "scratch", lambda s, name: made.append(session.scratch(s, name)) or made[-1], raising=False)
    docs = spark.createDataFrame([("en", "a b c d e f " * 20)] * 3, "lang string, text string")
    assert len(P.collocations(docs, 5).collect()) and len(made) == 5
    assert not any(os.path.exists(path) for path in made)
    kept = session.scratch(spark, "step")
    session.settle(docs, path=kept)
    with pytest.raises(ValueError):
        session.discard(spark, os.path.dirname(os.path.dirname(kept)))
    assert os.path.exists(kept)
    session.discard(spark, kept)
    assert not os.path.exists(kept)
