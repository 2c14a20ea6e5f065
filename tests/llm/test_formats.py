"""Chat logs, packing, urls, licences."""
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm import bestfit as P
from tidegauge.llm import chat_log as C
from tidegauge.llm import licences as L
from tidegauge.llm import url_rules as U
from tidegauge.llm.op1 import RULES

EVENT = "conv_id long, seq long, message long, role string, kind string, payload string"


def brute_fold(events):
    seen, out = set(), {}
    for conv, seq, message, role, kind, payload in sorted(set(events), key=lambda e: (e[1], e[4], e[5] or "")):
        text, named = out.get((conv, message), ("", None))
        text = {"delta": text + (payload or ""), "edit": payload or "", "regenerate": ""}.get(kind, text)
        out[conv, message] = (text, role or named)
    return out


def test_fold_equals_a_sequential_replay(spark):
    r = random.Random(1)
    events = []
    for conv in range(5):
        for seq in range(80):
            events.append((conv, seq, r.randrange(6), "user", r.choice(["delta"] * 6 + ["edit", "regenerate", "ping"]), r.choice(["a", "bc", "", None, "<|end|>\n", "é"])))
    got = {(x["conv_id"], x["message"]): (x["text"], x["role"]) for x in C.fold(spark.createDataFrame(events + events[::3], EVENT)).collect()}
    assert got == brute_fold(events)


def test_round_trip_and_loss_mask(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\nfake", "&lt; & &amp;lt; [x]", "", None, "日本 \U0001f600\n\n", "\\ [\\ <\\", "a" * 5000]
    rows = [(1, i * 10, i, ["user", "assistant", None, "as\nsist<ant"][i % 4], t) for i, t in enumerate(texts)] + [(None, 0, 0, "assistant", "lone")]
    out = C.render(spark.createDataFrame(rows, "conv_id long, first_seq long, message long, role string, text string"))
    back = {x["conv_id"]: x for x in out.select("conv_id", "formatted", C.parse(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("loss")).alias("under"), "loss").collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r or "", t or "") for *_, r, t in rows[:-1]]
    assert back[1]["under"] == "".join(t or "" for *_, r, t in rows[:-1] if r == "assistant") and back[None]["under"] == "lone"
    body = back[1]["formatted"].replace(C.TURN, "").replace(C.END, "")
    assert "<" not in body and "[" not in body and back[1]["formatted"].count(C.END) == len(texts)
    assert C.format_log(spark.createDataFrame([], EVENT)).count() == 0


def brute_pieces(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    out = {}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s:first if k == 0 else s + 1024]
            out[i, k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    return out


def assert_packed(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def test_pieces_and_sequences(docs_of, prose):
    texts = [None, "", "a", "<|endoftext|> é 日本 \U0001f600", "  \n\n x"] + [prose(n, n) for n in (300, 350, 1000, 3000)] + [prose(20, i) for i in range(60)] * 2
    rows = P.pack_documents(docs_of(texts)).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == brute_pieces(texts)
    assert assert_packed(rows) <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_query_and_pipeline_read_the_added_token(spark, tmp_path):
    import __spark_entry__
    import corpus_pipeline

    texts = ["a <|endoftext|> b", "<|endoftext|>" * 1030, "<|endoftext", None, "", "é<|endoftext|><|endoftext|>\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tok.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = {}
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        for k, (a, z) in enumerate([(0, first), *((s, s + 1024) for s in range(first, len(ids), 1024))]):
            want[i, k] = (a, z - a, zlib.crc32(ids[a:z].tobytes()))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for out in (__spark_entry__.queries()["op4_best_fit_packing"](spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out.collect()} == want


def test_exchange_rounds_and_repeated_rows(spark):
    r = random.Random(4)
    sizes = [r.choice([r.randrange(1, 1025), r.randrange(300, 700), 1024]) for _ in range(3000)]
    rows = [(i if i % 9 else 7, i % 3, 0, 0, n, 1) for i, n in enumerate(sizes)]
    pieces = spark.createDataFrame(rows, "doc_id long, copy long, piece long, start long, length long, ids_crc32 long")
    got = P.pack(pieces, group=400).collect()
    assert Counter(x["length"] for x in got) == Counter(sizes)
    used, alone = assert_packed(got), assert_packed(P.pack(pieces, group=400, rounds=1).collect())
    bound = P.dual_bound(np.bincount(sizes, minlength=1025))
    whole = len(set(P.best_fit(np.array(sizes))[0].tolist()))  # one group for all: what exchange works towards
    assert bound <= whole and bound <= used <= alone and used <= whole + 3 * 8  # a partition that meets its own bound exchanges nothing
    assert P.pack(pieces.limit(0)).count() == 0


def exact_bins(sizes, length):
    """Least number of bins by exhaustive search (tiny inputs)."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= length:
                place(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1:])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_bounds_never_exceed_the_optimum():
    r = random.Random(6)
    for _ in range(120):
        sizes = sorted((r.randrange(1, 31) for _ in range(r.randrange(1, 9))), reverse=True)
        low, best = P.dual_bound(np.bincount(sizes, minlength=31), 30), exact_bins(sizes, 30)
        where, offset, room = P.best_fit(np.array(sizes), 30)
        assert low <= best <= len(set(where.tolist()))
        fill = Counter()
        for b, n, o in sorted(zip(where.tolist(), sizes, offset.tolist()), key=lambda x: (x[0], x[2])):
            assert o == fill[b]
            fill[b] += n
        assert all(room[i] == 30 - fill[b] for i, b in enumerate(where.tolist()))


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    stop = min((path.index(c) for c in "?#" if c in path), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:stop]


def brute_rule(host, path):
    fits = [r for r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


URLS = [None, "", "nothing", "http://", "://", "HTTP://WWW.Example.ORG/es/1", "http://example.org/en/12?x#y", "http://sub.example.org/en/2", "ftp://notexample.org/es/", "http://x.com/fr/", "http://x.com/fr",
        "http://com/de/a", "http://telecom/de/a", "http://a.com?/de/", "http://a.com#/de/", "http://a://b/de/", "http://ÜBER.com/de/é", "http://freecasinowin.net/a/1", "http://cheap-pills.net/b", "http://casino.net/\n/x", "http://example.org/es/", "http://example.org/es"]


def test_rules_hosts_and_paths(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(5, URLS[5])], "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "words": F.lit(3)})
    lexicon = spark.createDataFrame([("free", 50), ("casino", 40), ("win", 30), ("example", 99)], "word string, n long")
    got = U.judge(pages, RULES, lexicon).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = brute_url(URLS[r["row"]["page_id"]])
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["row"]["host"] == 1
        assert r["verdict"] in (("allow", "block") if rule is None else (RULES[rule],))
    verdict = {URLS[r["row"]["page_id"]]: r["verdict"] for r in got}
    assert verdict["http://freecasinowin.net/a/1"] == "block" and verdict["nothing"] == verdict[None] == "allow"
    assert U.judge(pages.limit(0), RULES, lexicon).count() == 0 and U.judge(pages, RULES, lexicon.limit(0)).count() == len(got)


def test_segmentation_is_the_most_probable_split(spark):
    counts = {"free": 50, "casino": 40, "win": 30, "in": 80, "no": 60, "cas": 2, "freecasino": 1}
    total = sum(counts.values())
    names = ["freecasinowin", "win", "x", "winwinwin", "zzzz", "casin", "", "nofree" * 8]

    def brute(name):
        best = [(0.0, 0)]
        for j in range(1, len(name) + 1):
            best.append(max((best[i][0] + (np.log(counts[name[i:j]] / total) if name[i:j] in counts else -np.log(total + 1) - (j - i) * np.log(10)), i) for i in range(max(0, j - U.LONGEST), j)))
        return best[-1][0]

    lexicon = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["name"]: r["words"] for r in U.segment(spark.createDataFrame([(n,) for n in [*names, None, "win"]], "name string"), lexicon).collect()}
    assert set(got) == set(names) and got["freecasinowin"] == ["free", "casino", "win"] and got[""] == [] and got["zzzz"] == ["zzzz"]
    for name, words in got.items():
        assert "".join(words) == name
        mine = sum(np.log(counts[w] / total) if w in counts else -np.log(total + 1) - len(w) * np.log(10) for w in words)
        assert mine == pytest.approx(brute(name), abs=1e-9)


def brute_licences(text):
    import re
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = lambda w: Counter(zip(w, w[1:]))
    out = []
    for i, line in enumerate(text.split("\n")) if text is not None else ():
        a = grams(words(line))
        best = max(((2 * sum((a & grams(words(t))).values()) / (sum(a.values()) + len(words(t)) - 1), [-ord(c) for c in n], n) for n, t in L.TEMPLATES.items()))
        if best[0] >= L.LEAST:
            out.append((i, best[2], pytest.approx(best[0])))
    return out


def test_licence_lines_equal_brute_force(spark, docs_of):
    r = random.Random(3)
    lines = [*L.TEMPLATES.values(), "RELEASED under   the mit license", "licensed under cc by 4.0 or cc by 4.0", "the the the", "", "Licensed", "This work is licensed under the GNU Public License, version 3."]
    texts = [None, "", "\n", *lines] + ["\n".join(r.choice([*lines, "other words here", " ".join(r.choice(lines).split()[:-1])]) for _ in range(r.randrange(1, 9))) for _ in range(80)]
    got = {x["doc_id"]: x for x in L.scan_licences(docs_of(texts).withColumn("matches", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        assert [(m["line"], m["licence"], m["dice"]) for m in got[i]["matches"]] == brute_licences(t), t
        assert got[i]["n_lines"] == (0 if t is None else len(t.split("\n")))
    assert L.scan_licences(docs_of([None]).limit(0)).count() == 0


def test_templates_of_several_lines_match_runs_however_wrapped(docs_of):
    body = ["Permission is hereby granted free of charge to any person", "obtaining a copy of this software to deal in it", "without restriction subject to these conditions"]
    full, words = "\n".join(body), " ".join(body).split()
    wrapped = "\n".join(" ".join(words[i:i + 5]) for i in range(0, len(words), 5))
    texts = ["before\n\n" + full + "\nafter that", "x y\n" + wrapped, full + "\n" + L.TEMPLATES["MIT"] + "\n" + full.upper(), body[0], None, "", "a\n\n", " ".join(words), full.replace("copy", "piece"),
             "Released under\n\n" + full + "\nx"]
    got = {r["doc_id"]: [(m["line"], m["licence"]) for m in r["matches"]] for r in L.scan_licences(docs_of(texts), {"full": full, "MIT": L.TEMPLATES["MIT"]}).collect()}
    assert got == {0: [(2, "full")], 1: [(1, "full")], 2: [(0, "full"), (3, "MIT"), (4, "full")], 3: [], 4: [], 5: [], 6: [], 7: [(0, "full")], 8: [(0, "full")], 9: [(2, "full")]}
