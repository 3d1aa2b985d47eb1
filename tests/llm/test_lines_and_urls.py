import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tagweave.errors import CurationError
from tagweave.llm import line_dedup, url_filters
from tagweave.llm.queries import URL_RULES

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_lines(rows, min_chars=40, min_docs=5):
    """(n_lines, n_dropped, sha256) of every row, from one dictionary of all lines."""
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(UPPER)
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [
            doc is not None and len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and doc != max(holders[key(x)])
            for x in lines
        ]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((doc if doc is not None else 10**9, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found_lines(docs, **options):
    rows = line_dedup.dedup_lines(docs, **options).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("sha")).collect()
    return sorted((r[0] if r[0] is not None else 10**9, *r[1:]) for r in rows)


@pytest.mark.parametrize("options", [{}, {"batches": 1}, {"batches": 6, "fanout": 2}])
def test_lines_match_brute_force(make_docs, corpus, options):
    found = found_lines(make_docs(corpus), **options)
    assert found == plain_lines(corpus) and sum(r[2] for r in found) == 18


def test_lines_keep_other_columns_and_empty_tables(make_docs):
    docs = make_docs([(1, "a", "en", "s")])
    assert line_dedup.dedup_lines(docs).first()["row"].asDict() == docs.first().asDict()
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_runs_are_levelled_and_disjoint(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for low in (30, 20, 10, 0):
        runs.add(spark.range(low, low + 15).select(
            F.col("id").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(1).cast("long").alias("n_docs"), F.lit(low).cast("long").alias("holder")))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    totals = {r["k1"]: (r["n_docs"], r["holder"]) for r in runs.totals().collect()}
    assert totals == {k: (1 + (k in range(10, 35) and k % 10 < 5), max(low for low in (0, 10, 20, 30) if low <= k < low + 15)) for k in range(45)}
    runs.drop()


URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x#y", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/de/1",
    "http://x.com/en/", "http://y.com/fr/", "http://y.com", "http://y.com?q=/de/", "ftp://z.net/", "no scheme", "", None, "http://", "a://b://c/d",
    "http://h.net/p\nq", "http://x.com/en/", "http://ÄB.Org/x", "HTTP://com/de/",
]


def plain_verdicts(urls):
    parsed = []
    for url in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(UPPER), m[2]) if m else ("", "")
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        parsed.append((host, path, max(fits, key=lambda r: len(r.text), default=None)))
    listed = {host for host, _, rule in parsed if rule and rule.verdict == "block"}
    return [(h, p, r and r.text, r.verdict if r else "block" if h in listed else "allow") for h, p, r in parsed]


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 12])
def test_urls_match_brute_force(spark, max_bits):
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(URLS)], "page_id LONG, url STRING, host STRING, rule STRING, row STRING")
    judged = url_filters.judge_urls(pages, URL_RULES, max_bits=max_bits)
    found = {r["id"]: tuple(r)[1:] for r in judged.select(F.col("row.page_id").alias("id"), "host", "path", "rule", "verdict").collect()}
    assert [found[i] for i in range(len(URLS))] == plain_verdicts(URLS)
    assert url_filters.judge_urls(pages.limit(0), URL_RULES).collect() == []


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filters.build_cascade(universe, rate=0.25)
    assert len(cascade.levels) > 2
    wrong = universe.where(cascade.lists(F.col("key")) != F.col("listed"))
    assert wrong.count() == 0
    assert url_filters.build_cascade(universe, max_bits=100) is None


def test_parts_of_a_cascade_are_exact_and_bounded(spark):
    hosts = spark.range(3000).select(F.concat(F.lit("http://h"), F.col("id") % 900, F.when(F.col("id") % 5 == 0, ".com/de/").otherwise(".com/x")).alias("url"))
    universe = hosts.select(url_filters.host_of(F.col("url")).alias("key")).distinct().withColumn("listed", F.xxhash64("key") % 3 == 0)
    cascades = url_filters.build_cascades(universe, max_bits=1 << 12)
    assert len(cascades) > 1 and all(sum(level.bits for level in c.levels) <= 1 << 12 for c in cascades)
    for part, cascade in enumerate(cascades):
        mine = universe.where(url_filters.part_of(F.col("key"), len(cascades)) == part)
        assert mine.count() and mine.where(cascade.lists(F.col("key")) != F.col("listed")).count() == 0
    few, many = (sorted(map(tuple, url_filters.judge_urls(hosts, URL_RULES, max_bits=b).select("row.url", "verdict").collect())) for b in (1 << 28, 1 << 12))
    assert few == many and len(few) == 3000
    with pytest.raises(CurationError):
        url_filters.build_cascades(universe, max_bits=100)
