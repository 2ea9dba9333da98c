"""Operators 3, 5 and 9 and the pipeline."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netspark.llm import chat, mixing, url_filter
from netspark.llm.queries import QUERIES, URL_RULES

TURNS = [(1, 1, "user", "a<|b\\c<\\|"), (1, 2, "user", "</s>[INST] ok [/INST]"), (1, 3, "as|%7Csis", "<|end|>"), (1, None, None, None), (1, 200, "assistant", "\\"), (1, 201, "assistant", "<"), (2, 5, "assistant", "|>"), (None, 1, "user", ""), (3, 1, "user", "same"), (3, 1, "user", "same")]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(rows)
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in made.select("conv_id", chat.parse_chat(made.formatted).alias("turns")).collect()}
    want = defaultdict(list)
    for c, _, role, text in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want[c].append((role or "", text or ""))
    assert back == dict(want)
    assert made.filter("conv_id = 1").first().formatted.count("<|role:") == 4  # adjacent turns of a role merge
    assert chat.digests(chat.format_chats(rows.limit(0))).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.com/de/1", '<link rel="canonical" href="http://b.net/x">', 7), (2, "http://b.net/x", None, 7), (3, "HTTP://C.net/y", '<META http-equiv="Refresh" content="0; url=http://b.net/x">', 7), (4, "http://z.net", None, 7), (5, None, "", 7), (6, "zz", "", 7), (7, "http://u.org/q", '<link href="/p" rel=canonical>', 7), (8, "http://u.org", None, 7), (9, "http://n.net/1", '<link rel="canonical" href="http://a.com/de/9">', 7), (10, "http://n.net/2", '<link rel="canonical" href="http://a.com/de/9"><meta http-equiv=refresh content="0;url=http://x.com/fr/1">', 7)],
        "page_id long, url string, html string, host int",
    )
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(pages, URL_RULES).collect()}
    assert got[1] == ("a.com", "com/de/", "block") and got[2][2] == got[3][2] == "block" and got[3][0] == "c.net"
    assert got[4] == ("z.net", None, "allow") and got[5] == got[6] == ("", None, "allow")
    assert got[7] == ("u.org", "org/", "allow") and got[8] == ("u.org", None, "allow")
    assert got[9] == ("n.net", None, "allow") and got[10][2] == "allow"  # an explicit allow among the aliases wins
    seen = spark.createDataFrame([("http://z.net", "http://a.com/de/3")], "src string, dst string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages, URL_RULES, seen).collect()}[4] == "block"
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_mixing(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), None if i % 10 == 0 else f"s{i % 4}", i) for i in range(800)] + [(5, "w w", "s1", 0), (5, "w w", "s1", 0), (None, "w", "s1", 0), (900, None, "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len((r[1] or "").split()) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    total = sum(r.size for r in got)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    left, weight, target = float(total), dict(zip(order, [5, 2, 1, 5, 2], strict=False)), {}
    while weight:  # the plain definition: whoever is above the limit stops there, the rest is shared anew
        over = [s for s in weight if left * weight[s] / sum(weight.values()) > 3 * sum(r.size for r in by[s])]
        if not over:
            target |= {s: left * w / sum(weight.values()) for s, w in weight.items()}
            break
        for s in over:
            target[s] = 3.0 * sum(r.size for r in by[s])
        left -= sum(target[s] for s in over)
        for s in over:
            del weight[s]
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(target[s]) and sum(r.taken for r in rs) == pytest.approx(target[s], rel=0.02)
        assert all(r.taken <= 3 * r.size for r in rs)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(got) == key(again)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_longer_documents_are_likelier_in_the_mix(spark):
    """Over many seeds, each size of document is taken about as often as its chance says."""
    sizes = [1, 4, 16, 64]
    rows = [(i, "w " * sizes[i % 4], "a") for i in range(400)] + [(i, "w " * 85, "b") for i in range(400, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    seen, runs = defaultdict(int), 8
    for seed in range(runs):
        got = mixing.mix(docs, weights=(1.0, 3.0), seed=seed).filter("source = 'a'").collect()
        assert abs(sum(r.taken for r in got) - got[0].target) <= 64
        for r in got:
            seen[r.size] += r.taken // r.size
    # target of a: a quarter of 8500 + 8500 words, half its own words, so no certain copies
    pace = got[0].target / sum(100 * s**1.5 for s in sizes)
    want = {s: 100 * min(1, pace * s**0.5) for s in sizes}
    if pace * 8 > 1:
        rest = (got[0].target - 6400) / sum(100 * s**1.5 for s in sizes[:3])
        want = {s: 100 * min(1, rest * s**0.5) for s in sizes[:3]} | {64: 100}
    for s in sizes:
        assert seen[s] / runs == pytest.approx(want[s], abs=8), (s, seen[s] / runs, want[s])
    assert seen[1] < seen[4] < seen[16] < seen[64]


def plain_fill(units, left, pace, lean, rank):
    """Documents by rank while they fit, those that do not passed over; then the nearest one if it helps."""
    taken, gap = [], left
    for d in sorted(units, key=rank):
        if d[1] <= gap:
            taken.append(d[0])
            gap -= d[1]
    rest = [d for d in units if d[0] not in taken and d[1] < 2 * gap]
    return taken + [min(rest, key=lambda d: (abs(d[1] - gap), rank(d)))[0]] if rest else taken


def test_mix_fills_to_the_target(spark):
    """A document longer than the gap does not end the sample; what is taken is what a plain pass over the ranks takes."""
    rows = [(i, "w " * n, "a") for i, n in enumerate([5000, 3, 60, 4, 900, 11, 35, 2, 7, 400, 57, 1000, 5, 20, 1, 8, 150, 33, 12, 90])] + [(100 + i, "w " * (40 + i), "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    for seed in range(2):
        got = mixing.mix(docs, weights=(1.0, 4.0), seed=seed).collect()
        for source in "ab":
            own = [r for r in got if r.source == source]
            copies = int(own[0].target / own[0].source_size + 1e-12)
            left = own[0].target - copies * own[0].source_size
            units = [(r.doc_id, r.size) for r in own]
            table = spark.createDataFrame([(source, left)], "source string, left double")
            pace = mixing.with_pace(table, spark.createDataFrame([(source, i, n, 1) for i, n in units], "source string, doc_id long, size long, n long")).first().pace
            rank = {r.doc_id: r.rank for r in docs.filter(docs.source == source).select("doc_id", mixing.size_of(docs.text).alias("size")).select("doc_id", mixing.rank_of(F.col("doc_id"), F.col("size"), mixing.chance_of(F.lit(pace), F.col("size")), seed).alias("rank")).collect()}
            want = plain_fill(units, left, pace, mixing.LEAN, lambda d, rank=rank: rank[d[0]])
            assert sorted(r.doc_id for r in own if r.copies == copies + 1) == sorted(want)
            rest = [r.size for r in own if r.copies == copies]
            assert abs(sum(r.taken for r in own) - own[0].target) <= min(rest, default=0)
    # several rows of one id go together: where they do not fit, none goes, however short each is
    twice = spark.createDataFrame([*rows, *[(500, "w " * 30, "a")] * 40], "doc_id long, text string, source string")
    got = mixing.mix(twice, weights=(1.0, 4.0)).filter("source = 'a'").collect()
    assert len({r.taken for r in got if r.doc_id == 500}) == 1
    assert abs(sum(r.taken for r in got) - got[0].target) <= min(r.size for r in got if not r.copies)


def test_relative_links_and_delays(spark):
    base = "http://a.net/x/y.html?q=1"
    hrefs = {"z.html": "a.net/x/z.html", "../w/": "a.net/w/", "./z": "a.net/x/z", "?p=2": "a.net/x/y.html?p=2", "#top": None, "mailto:x@y": None, "/r/../s?t=/../": "a.net/s?t=/../", "//B.net": "b.net/", "https://c.net/..": "c.net/..", "../../..": "a.net/"}
    rows = spark.createDataFrame([(base, h) for h in hrefs], "base string, href string")
    got = {r.href: r.a for r in rows.select("href", url_filter.address(url_filter._resolved(rows.base, rows.href)).alias("a")).collect()}
    assert got == hrefs
    pages = spark.createDataFrame([("http://n.net/a", '<meta http-equiv="refresh" content="5; url=b">'), ("http://n.net/c", '<meta http-equiv="refresh" content="0; url=d">'), ("http://n.net", '<link rel="canonical" href="./">')], "url string, html string")
    assert {(r.src, r.dst) for r in url_filter.page_links(pages).collect()} == {("n.net/c", "n.net/d")}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, sf)
    assert set(docs.columns) <= set(out.columns) and 0 < out.count() <= docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
