"""URL filters: longest-prefix rules, then host word segmentation and multinomial naive Bayes.

A host such as ``freecasinowin`` is cut into words by the Viterbi path through a unigram model, and the words of host and path
are scored by naive Bayes. Nothing of the corpus is collected: the unigram model meets the host names as a join on
their substrings, and the class counts meet the pages as a join on their words.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that mark unwanted sites: the weak labels of the classifier. A documented parameter of ``learn``.
SEEDS = ("adult", "bet", "bets", "betting", "casino", "crack", "cracked", "escort", "gambling", "hentai", "jackpot", "keygen", "lottery", "malware", "nude", "payday", "phishing",
         "pills", "poker", "porn", "pornhub", "replica", "sex", "sexy", "slot", "slots", "spam", "torrent", "viagra", "warez", "webcam", "win", "xxx")
LONGEST = 20  # letters of a word
#: Words that every host may hold and that say nothing: not segmented further.
PARTS = r"[^a-z0-9]+"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end. Null or
    no ``://``: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    # lower() would also touch letters beyond A-Z
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Iterable[str]) -> Column:
    """The longest rule that fits, or null. A rule is ``host/path-prefix``; it fits its host and all subdomains of it, if the path
    (with its leading ``/``) starts with the rule's. Rules are a short fixed list, so they are one expression."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # a longer rule later wins
        cut = rule.index("/")
        fits = ((host == rule[:cut]) | F.endswith(host, F.lit("." + rule[:cut]))) & F.startswith(path, F.lit(rule[cut:]))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def unigram_counts(texts: Sequence[Column], df: DataFrame) -> DataFrame:
    """(word, n): letter words of up to ``LONGEST`` letters in all the texts, counted over all rows."""
    words = F.flatten(F.array(*[F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[a-z]+"), F.lit(0)) for t in texts]))
    return df.select(F.explode(words).alias("word")).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segment(names: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(name, words): the most probable split of each distinct ``name`` of lower-case letters into words.

    A piece of the name that the unigram model knows scores log(n / total); an unknown piece of L letters scores
    log(1 / total) - L log 10, so that unknown names stay whole. Ties go to the split whose last word is shorter.
    Each name meets the model as its own substrings: a join whose size is linear in the distinct names (at most
    ``LONGEST`` pieces for each letter). Null names drop out; an empty name has no words.
    """
    distinct = names.select("name").where("name is not null").distinct()
    pieces = distinct.select("name", F.explode(F.expr(
        f"flatten(transform(sequence(1, greatest(length(name), 1)), i -> transform(sequence(1, greatest(least({LONGEST}, length(name) - i + 1), 1)), n -> struct(i as i, n as n))))")).alias("p"))
    pieces = pieces.select("name", F.substr("name", F.col("p.i"), F.col("p.n")).alias("word"))
    total = unigrams.agg(F.sum("n").alias("total"))
    known = pieces.distinct().join(unigrams, "word", "left").where("n is not null").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", F.col("n").cast("double")))).alias("m"))
    rows = distinct.join(known, "name", "left").join(F.broadcast(total))  # the total is one row
    # Viterbi as a fold over the letters: best[j] = (score, start of the last word) for the first j letters
    best = F.expr(f"""aggregate(sequence(1, greatest(length(name), 1)), array(struct(cast(0 as double) as s, 0 as b)), (best, j) -> concat(best, array(
        array_max(transform(sequence(greatest(j - {LONGEST}, 0), j - 1), i -> struct(
            best[i].s + coalesce(ln(m[substr(name, i + 1, j - i)] / total), -ln(total + 1) - (j - i) * ln(10D)) as s, i as b))))))""")
    words = F.expr("""aggregate(sequence(1, greatest(length(name), 1)), struct(length(name) as at, cast(array() as array<string>) as w), (acc, k) ->
        if(acc.at <= 0, acc, struct(best[acc.at].b as at, concat(array(substr(name, best[acc.at].b + 1, acc.at - best[acc.at].b)), acc.w) as w)), acc -> acc.w)""")
    return rows.withColumn("total", F.coalesce("total", F.lit(1))).withColumn("m", F.coalesce("m", F.expr("cast(map() as map<string, double>)"))).withColumn("best", best).select("name", words.alias("words"))


def url_words(urls: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(host, path_words, words): distinct host and path shapes with their words. ``urls`` has host and path. Digits become ``#``."""
    shape = lambda c: F.regexp_replace(F.lower(c), r"[0-9]+", " # ")
    parts = lambda c: F.filter(F.split(shape(c), r"[^a-z#]+"), lambda x: x != "")
    # a third of all pages may share a host: work on distinct shapes
    shapes = urls.select("host", shape(F.col("path")).alias("path_shape")).distinct().withColumns({"hw": parts(F.col("host")), "pw": parts(F.col("path_shape"))})
    split = segment(shapes.select(F.explode("hw").alias("name")), unigrams)
    cut = shapes.select("host", F.explode("hw").alias("name")).distinct().join(split, "name").groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("words"))).alias("host_words"))
    return shapes.join(cut, "host", "left").select("host", "path_shape", F.concat(F.coalesce("host_words", F.expr("cast(array() as array<string>)")), F.transform("pw", lambda w: F.concat(F.lit("/"), w))).alias("words"))


def learn(shapes: DataFrame, weights: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(word, odds): log-odds of block against allow for every word, and one row with a null word for the priors and smoothing.

    Weak labels: a shape with a seed word among its host words is a block example, any other an allow example, each counted with the pages it
    stands for (``weights``: host, path_shape, pages). Laplace smoothing by 1. All counts are over all pages.
    """
    marked = shapes.join(weights, ["host", "path_shape"]).withColumn("block", F.arrays_overlap("words", F.array(*[F.lit(s) for s in seeds])))
    tokens = marked.select("block", "pages", F.explode("words").alias("word"))
    sums = lambda c: F.sum(F.when(F.col("block") == c, F.col("pages")).otherwise(0))
    counts = tokens.groupBy("word").agg(sums(True).alias("b"), sums(False).alias("a"))
    totals = counts.agg(F.sum("b").alias("tb"), F.sum("a").alias("ta"), F.count(F.lit(1)).alias("v"))
    priors = marked.agg(sums(True).alias("pb"), sums(False).alias("pa"))
    one = totals.join(F.broadcast(priors)).select(  # both are one row
        F.log((F.col("pb") + 1) / (F.col("pa") + 1)).alias("prior"), (F.coalesce("tb", F.lit(0)) + F.col("v")).alias("nb"), (F.coalesce("ta", F.lit(0)) + F.col("v")).alias("na"))
    return counts.join(F.broadcast(one)).select("word", (F.log((F.col("b") + 1) / F.col("nb")) - F.log((F.col("a") + 1) / F.col("na"))).alias("odds"), "prior")


def judge(pages: DataFrame, rules: dict[str, str], unigrams: DataFrame, url_col: str = "url", seeds: Sequence[str] = SEEDS, bar: float = log(1.0)) -> DataFrame:
    """All columns of ``pages`` in a struct ``row``, and host, path, rule, verdict (``allow`` or ``block``), odds (of the naive Bayes; null for a url without words).

    The longest fitting rule decides; else block if the log-odds exceed ``bar``. A null or malformed url has empty host and path, no words, and is
    allowed. Rows that repeat stay rows. An empty table gives no rows.
    """
    whole = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{url_col}`").cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    split = whole.withColumns({"host": host, "path": path}).withColumn("path_shape", F.regexp_replace(F.lower("path"), r"[0-9]+", " # "))
    weights = split.groupBy("host", "path_shape").agg(F.count(F.lit(1)).alias("pages"))
    shapes = url_words(weights.select("host", F.col("path_shape").alias("path")), unigrams)
    model = learn(shapes, weights, seeds)
    scored = shapes.select("host", "path_shape", F.explode("words").alias("word")).join(model, "word").groupBy("host", "path_shape").agg((F.sum("odds") + F.max("prior")).alias("odds"))
    out = split.join(scored, ["host", "path_shape"], "left").withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("odds") > bar, "block").otherwise("allow"))
    return out.select("row", "host", "path", "rule", verdict.alias("verdict"), "odds")
