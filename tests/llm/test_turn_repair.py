"""Conversation repair against exhaustive search, a chart of all splits, and a row-by-row replay."""
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import turn_repair as R

SHAPE = re.compile(r"(s?(ua)+)?")
CODES = [r + f for r in "sua-" for f in "bdt-"]


def exhaustive(rows, most=14):
    """Least (cost, audit) by trying every edit of every row and every insertion up to a cost."""
    best = (most + 1, "")
    todo = [(0, "", "", 0)]
    while todo:
        cost, audit, roles, at = todo.pop()
        if cost > best[0]:
            continue
        if at == len(rows) and SHAPE.fullmatch(roles):
            best = min(best, (cost, audit))
        if len(audit) - at < 4:
            todo += [(cost + 2, audit + "I", roles + x, at) for x in "ua"]
        if at < len(rows):
            role, fault = rows[at]
            todo.append((cost + 3, audit + "D", roles, at + 1))
            if fault not in "bd":
                more = fault == "t"
                todo.append((cost + more, audit + "K", roles + role, at + 1))
                todo += [(cost + 2 + more, audit + "R", roles + x, at + 1) for x in "ua"]
    return best


def all_splits(rows):
    """The chart with every span and every split."""
    n = len(rows)
    chart = {(i, i + 1): R.row_cells(rows[i]) for i in range(n)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            out = {}
            for k in range(i + 1, i + size):
                for at, (c, a) in R.combine(chart[i, k], chart[k, i + size]).items():
                    R.offer(out, at, c, a)
            chart[i, i + size] = out
    return chart[0, n] if n else R.INSERTIONS


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_cells_equal_exhaustive_search(n):
    r = random.Random(n)
    for rows in r.sample(list(itertools.product(CODES, repeat=n)), min(len(CODES) ** n, 60)):
        assert R.root(R.parse("".join(rows))) == exhaustive(rows)


def test_one_split_a_span_gives_the_chart_of_all_splits():
    r = random.Random(4)
    for n in [*range(1, 12), 25, 40]:
        rows = [r.choice(CODES) for _ in range(n)]
        assert R.parse("".join(rows)) == all_splits(rows)
    rows = "".join(r.choice(CODES) for _ in range(3_000))
    parts = [rows[i:i + 2 * 77] for i in range(0, len(rows), 2 * 77)]
    assert R.span_cells([R.parse(p) for p in parts]) == R.parse(rows)


def replay(rows):
    """(summary, repaired turns) of one conversation by plain Python and a left-to-right search."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows))
    seen, codes, turns = set(), [], sorted({t for known, t, _, _ in rows if known})
    for _, _, role, text in rows:
        shown = text.rstrip(" \t\n\v\f\r")
        fault = "b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "-"
        seen.add((role, text))
        codes.append((role[:1] if role[:1] in ("s", "u", "a") else "-") + fault)
    states = {0: (0, "")}

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for q, (c, a) in list(out.items()):
                for (p, x), j in R.MOVES.items():
                    if p == q and x != "s":
                        R.offer(out, j, c + 2, a + "I")
        return out

    states = inserted(states)
    for code in codes:
        new = {}
        for q, (c, a) in states.items():
            for (p, j), (d, b) in [(k, v) for k, v in row_only(code).items() if k[0] == q]:
                R.offer(new, j, c + d, a + b)
        states = inserted(new)
    cost, audit = min(v for q, v in states.items() if q in (0, 3))
    out, at, total = [], 0, len(audit) - audit.count("D")
    for e in audit:
        due = "assistant" if (total - len(out)) % 2 else "user"  # counted from the end: ... user, assistant
        if e == "I":
            out.append((len(out), "I", due, ""))
            continue
        if e != "D":
            out.append((len(out), e, rows[at][2] if e == "K" else due, rows[at][3]))
        at += 1
    roles = "".join(c[0] for c in codes)
    illegal = sum(roles[i:i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    return (gaps, *(sum(c[1] == f for c in codes) for f in "bdt"), illegal, cost, audit), out


def row_only(code):
    cells = {(i, i): (3, "D") for i in range(4)}
    if code[1] not in "bd":
        for (i, x), j in R.MOVES.items():
            if x == code[0]:
                R.offer(cells, (i, j), code[1] == "t", "K")
            if x != "s":
                R.offer(cells, (i, j), 2 + (code[1] == "t"), "R")
    return cells


def conversations(seed):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "", "  ", None, "é.\n", "a\x0b.\x0c", "B" * 50_000 + "."]
    rows = []
    for c in [None, -7, *range(25)]:
        for t in range(r.randrange(1, 9)):
            role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "ups"])
            rows.append((c, r.choice([t, t, t, None, t + 5]), role, r.choice(texts)))
    for t in range(900):  # one conversation holds most rows
        rows.append((99, t // 2, r.choice(["user", "assistant", "system"]), f"{r.randrange(600)}{r.choice('.!a ')}"))
    return rows + rows[:9]


@pytest.mark.parametrize("parts", [1, 7])
def test_repair_equals_a_replay(spark, parts):
    rows = conversations(parts)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns, summary = R.repair(df.withColumn("known", F.lit("x")).withColumn("seq", F.lit(None).cast("long")))
        turns, summary = turns.collect(), summary.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(r)
    assert len(summary) == len(by)
    got = {}
    for r in turns:
        got.setdefault(r["conv_id"], []).append(tuple(r)[1:])
    for r in summary:
        want, out = replay(by[r["conv_id"]])
        assert tuple(r)[1:] == want and sorted(got.get(r["conv_id"], [])) == out
        assert SHAPE.fullmatch("".join(x[2][0] for x in out))


def test_digests_of_streams_and_the_empty_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", ""), (3, 0, "user", "é?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = R.in_order(df)
    found = R.audits(R.faults(turns))
    got = {r["cid"]: r["digest"] for r in R.digests(R.repaired_turns(turns, found)).collect()}
    assert got == {1: hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest(), 3: hashlib.sha256("user:é?\nassistant:".encode()).hexdigest()}
    turns, summary = R.repair(df.where("conv_id > 99"))
    assert turns.collect() == [] and summary.collect() == []


def test_query_equals_sql_with_nulls_ties_and_dropped_conversations(spark, tmp_path):
    import duckdb

    from tidegauge.llm.op12 import SQL, op12_turn_repair

    r = random.Random(8)
    rows = [(c, r.choice([t, t, t - 1, None]), r.choice(["user", "assistant", "system", None, "tool", ""]), r.choice(["Yes. No", "ok!", "", " ", None, "a?b", "a b."])) for c in [None, *range(-9, 60)] for t in range(r.randrange(1, 7))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = duckdb.connect().execute(SQL.replace("from conversations", f"from '{tmp_path}/conversations.parquet/*.parquet'")).fetchall()
    got = [tuple(x) for x in op12_turn_repair(spark, str(tmp_path)).collect()]
    assert len(got) == len({c for c, *_ in rows}) and sorted(got, key=str) == sorted(want, key=str)
