"""Benchmark decontamination and substring deduplication against brute force."""
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import bytewords as B
from tidegauge.llm import decontaminate as D
from tidegauge.llm import substrings as S

WORD9 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words9(text):
    return WORD9.findall(low(text)) if text else []


def words10(text):
    return re.findall("[^\x20\x09-\x0d]+", text) if text else []


def random_texts(n, seed, words=60):
    r = random.Random(seed)
    alphabet = ["a", "B", "être", "x9", "Ü", "zz", "the", "über-all", "q!", " ", "日本"]
    out = [None, "", " ", "\n\t", "!!!", "a", "A b"]
    while len(out) < n:
        t = [r.choice(alphabet) for _ in range(r.randrange(words))]
        out.append(r.choice([" ", "  ", "\n", ". "]).join(t) + r.choice(["", " ", "."]))
    return out


def test_words_match_the_patterns():
    texts = random_texts(300, 1)
    raw, off, valid = B.text_buffer(pa.array(texts, pa.string()))
    for mask, want in ((B.ALNUM, words9), (~B.SPACES, words10)):
        w = B.split_words(B.LOWER[raw] if mask is B.ALNUM else raw, off, mask)
        blob = (B.LOWER[raw] if mask is B.ALNUM else raw).tobytes()
        got = [[blob[s:e].decode() for s, e in zip(w.start[a:z], w.end[a:z])] for a, z in zip(w.first, w.first[1:])]
        assert got == [want(t) for t in texts]
        seen = {}
        for t, h in zip((x for g in got for x in g), w.hashes.tolist()):
            assert seen.setdefault(t, h) == h
        assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_place_or_block():
    raw, off, _ = B.text_buffer(pa.array(["alpha beta gamma " * 50, "beta"]))
    w = B.split_words(raw, off, ~B.SPACES)
    assert len(set(B.word_hashes(raw, w.start, w.end, block=7).tolist())) == 3
    assert (B.word_hashes(raw, w.start, w.end, block=7) == w.hashes).all()


def test_sliced_and_null_columns():
    col = pa.array(["zero", None, "one two", "", "three"]).slice(1, 3)
    raw, off, valid = B.text_buffer(col)
    assert raw.tobytes() == b"one two" and off.tolist() == [0, 0, 7, 7] and valid.tolist() == [False, True, True]


def brute_hits(doc, items, size):
    w = words9(doc)
    hit, found = set(), set()
    for item, text in items:
        v = words9(text)
        n = min(size, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == v[i:i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("part_windows", [D.PART_WINDOWS, 40])
def test_decontamination_equals_brute_force(spark, docs_of, part_windows):
    r = random.Random(3)
    base = random_texts(40, 4, 30)
    items = [(i, t) for i, t in enumerate(base)] + [(99, base[20]), (100, "lonely"), (101, None)]
    docs = random_texts(50, 5, 40)
    for t in [x for x in base if x and len(x) > 30][:15]:
        docs.append("noise " * r.randrange(5) + t.upper().replace("Ü", "Ü") + " tail" * r.randrange(3))
    docs += ["lonely", "Lonely!", "lonelyer", base[20] + " " + base[20]]
    found = D.find_items(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"), 6, part_windows).collect()
    assert len(found) == len(docs)
    for row in found:
        n, hits, ids = brute_hits(docs[row["doc_id"]], items, 6)
        spans = row["spans"]
        assert (row["n_words"], sum(z - a for a, z in spans), row["items"]) == (n, hits, ids)
        assert all(a < z for a, z in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("part_windows", [D.PART_WINDOWS, 10])
def test_parts_keep_rows_that_share_an_id_apart(spark, part_windows):
    items = spark.createDataFrame([(i, " ".join(f"b{i}x{j}" for j in range(8))) for i in range(6)], "item_id long, text string")
    one, two = (" ".join(f"b{i}x{j}" for j in range(8)) for i in (1, 2))
    docs = [(None, one), (None, two), (None, "w " * 8), (4, one), (4, two), (4, one), (5, None), (5, "")]
    found = D.find_items(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), items, 4, part_windows).collect()
    want = [(d, 8 if t else 0, [[0, 8]] if t in (one, two) else [], [1] if t == one else [2] if t == two else []) for d, t in docs]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_words"], r["spans"], r["items"])) for r in found)


def test_stage_keeps_documents_that_repeats_cover_whole(spark):
    import corpus_pipeline
    whole = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, whole, 99), (2, "  " + whole, 99), (3, whole + " own", 99), (4, None, 5), (5, "", 0)], "doc_id long, text string, n_chars long").coalesce(1)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert got == {1: (whole, 99), 2: ("", 0), 3: ("own", 3), 4: (None, 5), 5: ("", 0)}


def test_contamination_rule_and_edges(spark, docs_of):
    item = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(13)))], "item_id long, text string")
    text = item.first()["text"]
    docs = docs_of([text + " x" * 247, text + " x" * 248, None, "", "clean"]).withColumns({"spans": F.lit(1), "items": F.lit("own"), "n_words": F.lit(2)})
    kept = {r["doc_id"] for r in D.decontaminate(docs, item).collect()}
    assert kept == {1, 2, 3, 4}  # 13 of 260 words is one in twenty, 13 of 261 is not
    assert D.decontaminate(docs, item).columns == docs.columns
    assert D.report(docs.limit(0), item).count() == 0
    none = D.report(docs, item.limit(0))
    assert none.count() == 5 and none.where("contaminated or n_hit > 0").count() == 0


def test_very_long_text_crosses_stretches(spark, docs_of):
    item = spark.createDataFrame([(7, " ".join(f"b{i}" for i in range(20)))], "item_id long, text string")
    far = " ".join(["filler"] * 30_000) + " " + item.first()["text"] + " " + "z" * 5000
    row = D.find_items(docs_of([far]), item).first()
    assert row["spans"] == [[30_000, 30_020]] and row["n_words"] == 30_021


def brute_removed(docs, size):
    first = {}
    for d, t in docs:
        w = words10(t)
        for i in range(len(w) - size + 1):
            g = tuple(w[i:i + size])
            first[g] = min(first.get(g, d), d)
    out = {}
    for d, t in docs:
        w = words10(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < d:
                gone |= set(range(i, i + size))
        out[d] = [x for i, x in enumerate(w) if i not in gone], len(gone)
    return out


@pytest.mark.parametrize("gram", [3, 5])
def test_substring_removal_equals_brute_force(docs_of, prose, gram):
    r = random.Random(8)
    passages = [prose(n, n) for n in (13, 14, 20, 60, 12)]
    texts = [None, "", "short", prose(12, 1), "to " * 40, "to " * 30 + "be", "x " * 13]
    for i in range(60):
        parts = [prose(r.randrange(30), 100 + i)] + [r.choice(passages) for _ in range(r.randrange(3))] + [prose(r.randrange(10), 300 + i)]
        texts.append(r.choice([" ", "\n", "\t \n"]).join(parts))
    texts += texts[20:30] + [texts[25] + " one more"] * 2
    want = brute_removed(list(enumerate(texts)), 13)
    got = S.remove_repeats(docs_of(texts), 13, gram).collect()
    assert len(got) == len(texts)
    for row in got:
        d = row["row"]["doc_id"]
        kept, gone = want[d]
        assert words10(row["text"]) == kept and row["n_removed"] == gone and row["n_words"] == len(words10(texts[d]))
        assert sum(z - a for a, z in row["spans"]) == gone
        if not gone:
            assert row["text"] == texts[d]


def test_substrings_clashing_columns_repeated_rows_and_nulls(spark, prose):
    p, q = prose(40, 1), prose(40, 2)
    rows = [(5, p, "a"), (5, p, "a"), (5, q, "b"), (None, p, "n"), (9, p + " end", "c"), (2, None, "d"), (9, q, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumns({"d": F.lit(1), "t": F.lit(2), "row": F.lit(3), "spans": F.lit(4), "seeds": F.lit(5)})
    got = sorted(((r["row"]["doc_id"], r["row"]["key"], r["text"], r["row"]["spans"]) for r in S.remove_repeats(docs).collect()), key=str)
    # rows of one doc_id do not remove each other's words; rows without a doc_id take no part
    want = sorted([(5, "a", p, 4), (5, "a", p, 4), (5, "b", q, 4), (None, "n", p, 4), (9, "c", "end", 4), (2, "d", None, 4), (9, "e", "", 4)], key=str)
    assert got == want
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_passage_in_every_document_stays_in_the_first_only(docs_of, prose):
    common = prose(50, 77)
    texts = [prose(20, i, 10**9) + " " + common + " " + prose(5, 1000 + i, 10**9) for i in range(300)]
    got = S.remove_repeats(docs_of(texts)).where("n_removed > 0")
    assert got.count() == 299 and got.where("n_removed = 50 and size(spans) = 1").count() == 299
