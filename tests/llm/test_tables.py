"""Operators 3 and 10, the registered SQL, and the pipeline."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import catalog, mixing, url_filter
from tests.conftest import DATA
from tests.test_catalog import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name])


def test_urls(spark):
    urls = ["http://A.Example.COM/en/7?x#y", "https://com/en/", "http://xcom/en/", "no scheme", None, "://", "x://net?/de/", "http://example.net/de/81", "http://b.net/de/#/de/", "http://org", "http://a.b.c.d.e.org/es/", "ftp://u@h.com:80/en/", "a\nb://com/en/\nq", "http://" + "s." * 500 + "com/en/7"]
    df = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)] + [(1, urls[1], "h", "r"), (None, urls[1], "h", "r")], "page_id long, url string, host string, rule string")
    rows = url_filter.url_filter(df, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert len(rows) == len(urls) + 2
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in rows}
    assert got[0] == ("a.example.com", "example.com/en/7", "allow")
    assert got[1] == ("com", "com/en/", "block") and got[None] == got[1]
    assert [got[k][1] for k in range(2, 14)] == [None, None, None, None, None, "example.net/de/8", "net/de/", None, "org/es/", None, "com/en/", "com/en/"]
    assert got[3][0] == got[4][0] == got[5][0] == ""
    assert url_filter.url_filter(df.limit(0), url_filter.rule_table(spark, url_filter.RULES)).collect() == []


def test_url_verdicts_of_the_contract(spark, tmp_path):
    said = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    listed = {rule: word for word, rule in (r.split(" ") for r in said.split(", "))}
    assert {host + path: verdict for host, path, verdict in url_filter.RULES} == listed
    urls = [f"http://a.{rule}1" for rule in listed] + ["http://example.net/de/7", "http://b.net/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.op10_url_filters(spark, str(tmp_path)).collect()}
    assert got == {**dict(enumerate(listed.items())), 5: ("net/de/", "allow"), 6: (None, "allow")}


def test_urls_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", -1)
    test_urls(spark)


def filled(sizes):
    """Shares by weight, capped, the excess given out again until none is above."""
    budget, caps = sum(sizes.values()) * 1.5, {s: 2 * n for s, n in sizes.items()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full = {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in full}
        level = (budget - sum(full.values())) / sum(rest.values()) if rest else 0
        over = [s for s in rest if level * weights[s] > caps[s]]
        if not over:
            return {**full, **{s: level * w for s, w in rest.items()}}
        full |= {s: float(caps[s]) for s in over}


def queued(docs):
    """(taken, finish of the first pass) by source, key and size: the queue in plain Python."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda d, t: hashlib.md5(f"{'' if d is None else d}:mix:{t or ''}".encode()).hexdigest()
    sizes, groups = defaultdict(int), Counter()
    for d, t, s in docs:
        sizes[s] += words(t)
        groups[s, key(d, t), words(t)] += 1
    goal = filled(sizes)
    upto, passes = defaultdict(int), []
    for (s, k, n), copies in sorted(groups.items(), key=lambda g: g[0][1]):
        upto[s] += n * copies
        passes += [((sizes[s] * p + upto[s]) / goal[s], s is None, s or "", (s, k, n), copies) for p in (0, 1) if n]
    left, taken, finish = sum(sizes.values()) * 3 // 2, defaultdict(int), {}
    for f, _, _, g, copies in sorted(passes):
        part = max(0, min(g[2], left // copies))
        taken[g] += part
        left -= g[2] * copies
        finish.setdefault(g, f)
    return sizes, goal, {g: (taken[g], finish.get(g)) for g in groups}, key, words


@pytest.mark.parametrize("cell", [50_000, 3])
def test_mixing(spark, monkeypatch, cell):
    monkeypatch.setattr(mixing, "CELL_ROWS", cell)
    docs = [(k, " ".join("w" * (k * 7 % 40)), ["é", "a", "b", None, "Z", "hot"][min(k % 13, 5)]) for k in range(300)]
    docs += [(None, "x y", "a"), (7, None, "a"), (1, "a b", "b"), (1, "a b", "b"), (1, "c d", "b"), (1, "c d", "hot"), (None, None, None), (4, "", None)] + [(9, "one and the same text", "hot")] * 40
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, source string, target long, key string")
    rows = mixing.shares(df).collect()
    sizes, goal, want, key, words = queued(docs)
    assert Counter((r.source, r.id, r["size"], r.source_size, r.taken, r.finish) for r in rows) == Counter((s, d, words(t), sizes[s], *want[s, key(d, t), words(t)]) for d, t, s in docs)
    assert all(abs(r.target - goal[r.source]) < 1e-6 and r.taken <= 2 * r["size"] for r in rows)
    for s in sizes:
        assert abs(sum(r.taken for r in rows if r.source == s) - goal[s]) <= 160
    mix = mixing.mixed_documents(spark, df, "").collect()
    taken = [words(r.text) for r in mix]
    assert sum(taken) == sum(r.taken for r in rows) and all(taken)
    assert Counter({(r.id, r.source): 0 for r in rows}) + sum((Counter({(r.doc_id, r.source): words(r.text)}) for r in mix), Counter()) == sum((Counter({(r.id, r.source): r.taken}) for r in rows), Counter())
    assert mixing.shares(df.limit(0)).collect() == [] and mixing.mixed_documents(spark, df.limit(0), "").collect() == []
    assert mixing.shares(df.filter("text IS NULL OR text = ''")).filter("taken > 0 OR target > 0 OR finish IS NOT NULL").count() == 0


def test_words_of_a_cut_text_stay_as_they_stand(spark):
    texts = [("  a b\n\nc d", 3), ("a\tb  c", 2), ("a", 1), ("\n a\n", 1), ("w " * 50_000, 49_999)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string, n long").select(mixing.first_words(F.col("t"), F.col("n"))).collect()]
    assert got == ["  a b\n\nc", "a\tb", "a", "\n a", ("w " * 49_999)[:-1]]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, DATA))
        counts.append(docs.count())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
    assert counts[0] > counts[1] > counts[2] == counts[3] < counts[4]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0
    from lectern.llm.quality import kept_documents

    first = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = kept_documents(spark, first, DATA).join(labels, "doc_id")
    good = first.join(labels, "doc_id").filter("quality = 1 AND size(split(text, ' ')) >= 25")
    assert kept.filter("quality = 0").count() == 0 and good.join(kept, "doc_id", "left_anti").count() <= good.count() // 50
    again = sorted(map(repr, corpus_pipeline.run(spark, DATA).collect()))
    assert again == sorted(map(repr, docs.collect()))
