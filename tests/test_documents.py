"""Field extraction against a plain reading of the lines, one after another."""
import random
import re
from decimal import Decimal

from tidegauge.operators import text as T


def plain(text):
    out, items, bad, inside, n = {}, [], 0, False, -1
    for line in (s.strip(" ") for s in re.split(r"\r?\n", text or "")):
        if line in ("", T.ITEM_HEADER):
            continue
        n += 1
        if re.search(T.SEPARATOR, line):
            inside = not inside
        elif inside:
            m = re.search(T.ITEM, line)
            if m:
                items.append((n, m[1], int(m[2]), Decimal(m[3].replace(",", "")), Decimal(m[4].replace(",", ""))))
            bad += m is None
        else:
            if n < 2:
                out[("vendor_name", "vendor_address")[n]] = line
            for name, pattern in T.FIELDS.items():
                m = re.search(pattern, line)
                if m:
                    out[name] = Decimal(m[1].replace(",", "")) if name in ("subtotal", "tax", "total") else m[1].strip(" ")
    errors = [f"missing {c}" for c in ("vendor_name", "vendor_address", *T.FIELDS) if c not in out]
    errors += ["missing line_items"] * (not items) + ["unreadable line item"] * (bad > 0)
    return out, items, bad, errors


LINES = ["Acme", " 1 Road ", "Invoice Number: A-1", "Invoice Date: 2024-01-02", "Invoice Date:   2024-02-03 ", "Bill To: Someone", "Subtotal: 1,200.50", "Tax (10%): 120.05",
         "Tax: 3", "Total Due: 1,320.55", T.ITEM_HEADER, "-----", "--------", "Wide part 3 10.00 30.00", "Part 7 2 1,000.25 2,000.50", "not an item", "", "Part 9 1 5.00 5"]


def test_documents_equal_a_plain_reading(spark):
    r = random.Random(11)
    texts = {i: r.choice(["\n", "\r\n"]).join(r.choice(LINES) for _ in range(r.randrange(0, 25))) for i in range(150)}
    texts |= {1000: None, 1001: "", 1002: "-----\n" * 41, 1003: "\n".join(LINES)}
    d = spark.createDataFrame(list(texts.items()), "doc long, text string").repartition(4)
    head, items = T.extract_fields(d, "doc", "text")
    got, rows = {q["doc"]: q for q in head.collect()}, {}
    for q in items.collect():
        rows.setdefault(q["doc"], []).append(tuple(q)[1:])
    assert set(got) == set(texts)
    for k, text in texts.items():
        out, want, bad, errors = plain(text)
        assert {c: got[k][c] for c in ("vendor_name", "vendor_address", *T.FIELDS)} == {c: out.get(c) for c in ("vendor_name", "vendor_address", *T.FIELDS)}, text
        assert (sorted(rows.get(k, [])), got[k]["n_items"], got[k]["bad_items"], got[k]["errors"]) == (want, len(want), bad, errors), text


def test_literal_start():
    assert [T.literal_start(p) for p in ("^Tax\\s*x", "^Due:?x", "a", "^a|b", r"^\d", "^Net: (.+)")] == ["Tax", "Due", "", "", "", "Net: "]


def test_no_line_is_shuffled(spark):
    d = spark.createDataFrame([(1, "a")], "doc long, text string")
    assert "Exchange" not in T.parse_documents(d, "doc", "text")._jdf.queryExecution().executedPlan().toString()
