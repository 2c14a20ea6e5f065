"""Query: rules and naive Bayes over every page's url."""
from pyspark.sql import functions as F

from tidegauge.llm.catalog import query, table
from tidegauge.llm.url_rules import judge, split_url, unigram_counts

#: The fixed rules of the query.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


@query("op1_url_filter")
def op1_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    # the unigram model: words of the pages' visible text and of their urls
    text = F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    unigrams = unigram_counts([text], table(spark, sf_dir, "pages", "html"))
    return judge(pages, RULES, unigrams).select("row.page_id", "host", "path", "rule", "verdict", "odds")
