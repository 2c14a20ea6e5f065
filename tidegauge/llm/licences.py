"""Licence scan: lines compared with licence templates by the Dice coefficient over word bigrams.

A line's words are normalised (A-Z lower-cased, everything but letters, digits and non-ASCII dropped). Its similarity with a template is
2 |A and B| / (|A| + |B|) over the multisets of word bigrams. To reach ``t``, the line's bigram count must lie between
t / (2 - t) and (2 - t) / t of the template's: templates outside these bounds are never compared. A template
of one line is compared with single lines, as in the SQL twin; one of several lines with every run of whole lines inside its size
bounds, as one text, however the run is wrapped. A one-line notice that is wrapped, or shares its line with prose, is not found.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.batches import bounded
from tidegauge.llm.bytewords import ALNUM, LOWER, U64, mix, split_words, text_buffer

#: Short notices of common licences, as their publishers word them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
}
#: A line counts as the licence from this similarity on.
LEAST = 0.85


def text_bigrams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bigram hash at each word but the last, first word of each line, first word of each text); bigrams cross line breaks."""
    raw, off, _ = text_buffer(column)
    w = split_words(LOWER[raw], off, ALNUM)
    starts = np.sort(np.concatenate([off[:-1], np.flatnonzero(raw == 10) + 1]))  # a text's first line, and one after each break
    grams = mix(w.hashes[:-1] * U64(0x9E3779B97F4A7C15) + w.hashes[1:]) if len(w.hashes) > 1 else np.zeros(0, np.uint64)
    return grams, np.concatenate([np.searchsorted(w.start, starts), [len(w.start)]]), w.first


def bigrams_of(text: str) -> list[int]:
    _, _, grams, _ = line_bigrams(pa.array([text]))
    return grams.tolist()


def line_bigrams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each line, words of each line, bigram hashes, line of each bigram)."""
    raw, off, _ = text_buffer(column)
    w = split_words(LOWER[raw], off, ALNUM)
    breaks = np.flatnonzero(raw == 10)
    text_of = np.repeat(np.arange(len(off) - 1), np.diff(off)) if len(raw) else np.zeros(0, np.int64)
    lines = np.bincount(text_of[breaks], minlength=len(off) - 1) + 1
    line_text = np.repeat(np.arange(len(off) - 1), lines)
    # number of a word's line: line breaks before it, and one more for each text before it
    line = np.searchsorted(breaks, w.start) + w.owner
    grams = mix(w.hashes[:-1] * U64(0x9E3779B97F4A7C15) + w.hashes[1:]) if len(w.hashes) > 1 else np.zeros(0, np.uint64)
    same = line[1:] == line[:-1] if len(line) > 1 else np.zeros(0, bool)
    return line_text, np.bincount(line, minlength=len(line_text)), grams[same], line[:-1][same] if len(line) > 1 else line[:0]


def runs_of_lines(grams: list[int], first: list[int], known: Counter, least: float) -> list[tuple[float, int, int]]:
    """(coefficient, from, to) of the runs of lines that reach ``least``: the best ones first, none overlapping a better one.

    ``grams[j]`` joins words j and j + 1 of one text; line i has the words ``first[i]:first[i + 1]``.
    """
    size = sum(known.values())
    low, high = least / (2 - least) * size, (2 - least) / least * size
    if 2 * sum((Counter(grams) & known).values()) < least * (size + low):
        return []  # not even the whole text shares enough
    reach = []
    for a in range(len(first) - 1):
        # a run that begins with a line of which it shares nothing is better without that line
        if not any(g in known for g in grams[first[a]:first[a + 1]]):
            continue
        own, shared, at = Counter(), 0, first[a]
        for z in range(a + 1, len(first)):
            n = first[z] - first[a] - 1
            if n > high:
                break
            for g in grams[at:first[z] - 1]:
                own[g] += 1
                shared += own[g] <= known[g]
            at = max(at, first[z] - 1)
            if first[z] > first[z - 1] and n >= low and 2 * shared >= least * (n + size):
                reach.append((2 * shared / (n + size), a, z))
    out: list[tuple[float, int, int]] = []
    for dice, a, z in sorted(reach, key=lambda r: (-r[0], r[1], r[2])):
        if all(z <= b or y <= a for _, b, y in out):
            out.append((dice, a, z))
    return out


FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()),
                      T.StructField("matches", T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType())])))])


def scan_licences(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, n_lines, matches): for each line that reaches ``least`` with a template, its number, the best template (ties: first by
    name) and the coefficient. A template of several lines is matched to runs of lines (see ``runs_of_lines``) and named at the first
    line of the run, beside what single lines match; of overlapping runs the best template's stands. Null texts have 0 lines, an empty text 1; lines of fewer than two words have no bigrams and match
    nothing. One row per document row; other columns are ignored.
    """
    given = templates or TEMPLATES
    tall = {n: Counter(text_bigrams(pa.array([given[n]]))[0].tolist()) for n in sorted(given) if "\n" in given[n].strip()}
    names = sorted(given.keys() - tall.keys())
    known = [Counter(bigrams_of(given[n])) for n in names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_grams = np.unique(np.array([g for k in known for g in k], np.uint64))
        sizes = np.array([sum(k.values()) for k in known])
        for batch in bounded(batches):
            line_text, words, grams, line = line_bigrams(batch.column("text"))
            count = np.bincount(line, minlength=len(line_text))
            valid = np.asarray(batch.column("text").is_valid())
            first = np.searchsorted(line_text, np.arange(batch.num_rows + 1))
            near = np.flatnonzero(np.isin(grams, all_grams))
            matches: list[list] = [[] for _ in range(batch.num_rows)]
            for at in np.unique(line[near]):
                n = count[at]
                # size bounds, then the shared bigrams
                fit = [t for t in range(len(names)) if least / (2 - least) * sizes[t] <= n <= (2 - least) / least * sizes[t]]
                if not fit:
                    continue
                lo, hi = np.searchsorted(line, [at, at + 1])
                own = Counter(grams[lo:hi].tolist())
                best = max(((2 * sum((own & known[t]).values()) / (n + sizes[t]), -t) for t in fit))
                if best[0] >= least:
                    text = line_text[at]
                    matches[text].append({"line": int(at - first[text]), "licence": names[-best[1]], "dice": float(best[0])})
            if tall:
                every, first_word, text_first = text_bigrams(batch.column("text"))
                for text in np.flatnonzero(valid):
                    lo, hi = text_first[text], text_first[text + 1]
                    own, begins = every[lo:max(hi - 1, lo)].tolist(), (first_word[first[text]:first[text + 1] + 1] - lo).tolist()
                    begins[-1] = int(hi - lo)
                    found = sorted((-dice, a, n, z) for n, k in tall.items() for dice, a, z in runs_of_lines(own, begins, k, least))
                    taken: list[tuple[int, int]] = []
                    for dice, a, n, z in found:
                        if all(z <= b or y <= a for b, y in taken):
                            taken.append((a, z))
                            matches[text].append({"line": a, "licence": n, "dice": float(-dice)})
                    matches[text].sort(key=lambda m: m["line"])
            kind = pa.list_(pa.struct([("line", pa.int64()), ("licence", pa.string()), ("dice", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(valid, np.diff(first), 0).astype(np.int64)), pa.array(matches, kind)], names=["doc_id", "n_lines", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, FOUND)
