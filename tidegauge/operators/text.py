"""Text operators: chunks, n-grams, byte-pair merges, field extraction."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordering import running_sums
from tidegauge.session import settle


def words(text: Column | str) -> Column:
    """Whitespace tokens without empty ones."""
    return F.filter(F.split(F.col(text) if isinstance(text, str) else text, r"\s+"), lambda w: w != "")


def chunk_words(df: DataFrame, key: str, text: str, size: int = 100, overlap: int = 20) -> DataFrame:
    """Word windows per document: (key, ordinal, chunk). The last window is the first to reach the end."""
    step = size - overlap
    # a generator keeps the token array from being pasted into each window
    w = df.select(key, F.explode(F.array(words(text))).alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.ceil((F.size("_w") - F.lit(size)) / F.lit(step)), F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("_w", i * step + 1, F.lit(size)), " "))
    return w.select(key, F.posexplode(cut).alias("ordinal", "chunk"))


def with_running_ids(chunks: DataFrame, key: str) -> DataFrame:
    """Running chunk ids over the corpus in key order: offsets come from per-document counts."""
    n = settle(chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "chunk-counts")
    start = running_sums(n, [key], {"_end": "_n"}).select(key, (F.col("_end") - F.col("_n")).alias("_start"))
    return chunks.join(start, key).withColumn("chunk_id", F.col("_start") + F.col("ordinal")).drop("_start")


#: A template of our own for ``prompt``; pass another where it does not suit.
PROMPT = "Read the passages. Reply from them alone and name the chunks you used; if they don't hold the answer, say that.\n\nPassages:\n{context}\n\nQuestion: {question}\n"


def assemble_context(hits: DataFrame, query: str, rank: str, chunk: str, page: str, score: str, text: str) -> DataFrame:
    """Labelled blocks of a query's hits (top-k, so few) in rank order, joined by blank lines."""
    block = F.format_string("[chunk %d, page %d, similarity %.4f]\n%s", F.col(chunk), F.col(page), F.col(score), F.col(text))
    g = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))).alias("_b"))
    return g.select(query, F.array_join(F.col("_b.b"), "\n\n").alias("context"))


def prompt(context: Column, question: Column, template: str = PROMPT) -> Column:
    head, rest = template.split("{context}")
    mid, tail = rest.split("{question}")
    return F.concat(F.lit(head), context, F.lit(mid), question, F.lit(tail))


def snippet(text: Column | str, n: int = 70) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.substring(t, 1, n), F.when(F.length(t) > n, "...").otherwise(""))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def _symbols(word: Column) -> Column:
    return F.concat(F.filter(F.split(word, ""), lambda c: c != ""), F.array(F.lit("</w>")))


def _merge(symbols: Column, a: str, b: str) -> Column:
    """Replace every adjacent (a, b), from the left, by the joined symbol."""
    def step(done, s):
        hit = (F.size(done) > 0) & (F.element_at(done, -1) == a) & (s == b)
        return F.when(hit, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.lit(a + b)))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(symbols, F.array().cast("array<string>"), step)


def pair_counts(vocab: DataFrame) -> DataFrame:
    """Adjacent symbol pairs weighted by word frequency."""
    pairs = F.zip_with(F.col("symbols"), F.slice("symbols", F.lit(2), F.greatest(F.size("symbols") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    e = vocab.select("freq", F.inline(pairs)).where(F.col("b").isNotNull())
    return e.groupBy("a", "b").agg(F.sum("freq").alias("n"))


def learn_merges(counts: DataFrame, merges: int = 8) -> list[tuple[str, str, int]]:
    """Byte-pair merges from a (word, freq) table: most frequent pair first, ties to the smallest pair.

    One row per merge comes to the driver; the vocabulary is written after each round, which keeps the
    plan short and the job restartable.
    """
    vocab = settle(counts.select("freq", _symbols(F.col("word")).alias("symbols")), "vocab")
    learned = []
    for _ in range(merges):
        best = pair_counts(vocab).orderBy(F.desc("n"), "a", "b").first()
        if best is None:
            break
        learned.append((best["a"], best["b"], best["n"]))
        vocab = settle(vocab.select("freq", _merge(F.col("symbols"), best["a"], best["b"]).alias("symbols")), "vocab")
    return learned


def apply_merges(word: Column | str, merges: list[tuple[str, str]]) -> Column:
    """Split a word by replaying the learned merges in order."""
    out = _symbols(F.col(word) if isinstance(word, str) else word)
    for a, b in merges:
        out = _merge(out, a, b)  # each fold reads its input once
    return out


# fixed patterns: labelled fields, item rows and separators of the invoice layout
FIELDS = {
    "invoice_number": r"^Invoice Number:\s*(.+)$",
    "invoice_date": r"^Invoice Date:\s*(.+)$",
    "bill_to": r"^Bill To:\s*(.+)$",
    "subtotal": r"^Subtotal:\s*([\d,]+\.\d{2})$",
    "tax": r"^Tax\s*\([^)]*\):\s*([\d,]+\.\d{2})$",
    "total": r"^Total Due:\s*([\d,]+\.\d{2})$",
}
ITEM = r"^(.+?)\s+(\d+)\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})$"
SEPARATOR = r"^-{5,}$"
ITEM_HEADER = "Description Qty Unit Price Amount"


def literal_start(pattern: str) -> str:
    """The plain text that every match of a pattern anchored at the start begins with (empty if none): a cheap test before the expression."""
    found = re.match(r"\^([A-Za-z0-9 :]+)([?*{|]?)", pattern)
    if found is None or "|" in pattern:
        return ""
    return found[1][:-1] if found[2] else found[1]


def parse_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document: header fields, ``items``, ``n_items``, ``bad_items`` and ``errors``. Required: all fields, two leading lines, an item.

    Lines are trimmed, empty ones and the column header left out; those between an odd and the next even separator are items, a field is the last
    line outside with its label. All stays in the document's row: no line is shuffled. A null or empty text lacks everything.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda s: F.trim(s)), lambda s: (s != "") & (s != ITEM_HEADER))
    # one-element generators keep an array from being pasted into each use
    rows = df.select(key, F.explode(F.array(lines)).alias("_l"))
    rows = rows.select(key, "_l", F.explode(F.array(F.array_compact(F.transform("_l", lambda s, i: F.when(s.rlike(SEPARATOR), i))))).alias("_marks"))
    numbered = F.transform("_l", lambda s, i: F.struct(i.alias("no"), s.alias("s"), F.size(F.filter("_marks", lambda m: m < i)).alias("before")))
    rows = rows.select(key, F.explode(F.array(F.filter(numbered, lambda x: ~F.array_contains("_marks", x["no"])))).alias("_n"))
    inside = F.filter("_n", lambda x: x["before"] % 2 == 1)
    good = F.filter(inside, lambda x: x["s"].rlike(ITEM))
    # one match gives all groups: the numbers first, then the description, which may hold anything
    groups = F.transform(good, lambda x: F.struct(x["no"].alias("no"), F.split(F.regexp_replace(x["s"], ITEM, "$2 $3 $4 $1"), " ", 4).alias("g")))
    amount = lambda x, i: F.replace(x["g"][i], F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    item = lambda x: F.struct(x["no"].alias("line_no"), x["g"][3].alias("description"), x["g"][0].try_cast("int").alias("quantity"),
                              amount(x, 1).alias("unit_price"), amount(x, 2).alias("amount"))
    both = F.struct(F.filter("_n", lambda x: x["before"] % 2 == 0).alias("outside"), F.size(inside).alias("n_inside"), F.transform(groups, item).alias("items"))
    rows = rows.select(key, F.explode(F.array(both)).alias("_d"))
    last = lambda hit: F.try_element_at(F.filter("_d.outside", hit), F.lit(-1))["s"]
    numbered_as = lambda i: lambda x: x["no"] == i
    like = lambda pattern: lambda x: x["s"].startswith(literal_start(pattern)) & x["s"].rlike(pattern)
    cols = [last(numbered_as(i)).alias(n) for i, n in enumerate(("vendor_name", "vendor_address"))]
    money = ("subtotal", "tax", "total")
    for name, pattern in FIELDS.items():
        value = F.regexp_extract(last(like(pattern)), pattern, 1)
        cols.append((F.regexp_replace(value, ",", "") if name in money else F.trim(value)).alias(name))
    head = rows.select(key, *cols, F.col("_d.items").alias("items"), F.size("_d.items").alias("n_items"), (F.col("_d.n_inside") - F.size("_d.items")).alias("bad_items"))
    required = ["vendor_name", "vendor_address", *FIELDS]
    errors = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required],
                                     F.when(F.col("n_items") == 0, F.lit("missing line_items")), F.when(F.col("bad_items") > 0, F.lit("unreadable line item"))))
    return head.withColumn("errors", errors).withColumns({c: F.col(c).try_cast("decimal(18,2)") for c in money})


def extract_fields(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(header row per document with an error list, item rows) of ``parse_documents``."""
    parsed = parse_documents(df, key, text)
    return parsed.drop("items"), parsed.select(key, F.inline("items"))


def report_lines(statements: DataFrame, outcome: DataFrame, tally: DataFrame, debate: str, speaker: str, round_no: str, turn: str,
                 text: str, verdict: str) -> DataFrame:
    """A debate report as ordered lines (debate, section, seq, line); ``section`` and ``seq`` give the order.

    Lines stay rows, so a very long debate needs no single huge string; ``array_join`` over one debate
    renders it.
    """
    row = lambda df, section, seq, line: df.select(debate, F.lit(section).alias("section"), seq.cast("long").alias("seq"), line.alias("line"))
    num = lambda c: F.col(c).cast("string")
    head = row(outcome, 0, F.lit(0), F.concat(F.lit("Rounds run: "), num("rounds_run"), F.lit(" (stop reason: "), F.col("stop_reason"), F.lit(")")))
    body = row(statements, 1, F.col(turn), F.concat(F.lit("[Round "), num(round_no), F.lit("] "), F.col(speaker), F.lit(": "), F.col(text)))
    last = statements.groupBy(debate, speaker).agg(F.max_by(verdict, turn).alias("_v"), F.max(turn).alias("_t"))
    votes = row(last, 2, F.col("_t"), F.concat(F.lit("  "), F.col(speaker), F.lit(": "), F.coalesce(F.col("_v"), F.lit("ABSTAIN"))))
    foot = row(outcome.select(debate, "unanimous").join(tally.select(debate, "deadlock", F.col("winner").alias("_w")), debate), 3, F.lit(0), F.concat(
        F.lit("Unanimous: "), F.initcap(num("unanimous")), F.lit("   Deadlock: "), F.initcap(num("deadlock")), F.lit("   Winning verdict: "), F.coalesce("_w", F.lit("None"))))
    return head.unionByName(body).unionByName(votes).unionByName(foot)
