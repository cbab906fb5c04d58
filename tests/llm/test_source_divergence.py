"""The source divergence audit against SQL and a count in plain Python."""

import collections
import random
import re

import duckdb
import pytest

pytest.importorskip("tessera.llm")

from tessera.llm import queries, source_divergence

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '/root/testdata/sf{sf}/documents.parquet'")
    want = sorted(db.sql(f"select {', '.join(COLUMNS)} from ({queries.oracle_sql()['op12_source_divergence']})").fetchall())
    got = rows(queries.op12_source_divergence(spark, f"/root/testdata/sf{sf}"))
    assert got == want and len({r[2] for r in got}) == 2


def brute(docs, least, top):
    counts, seen, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        counts.update((lang, source, w) for w in words)
        seen.update((lang, w) for w in set(words))
    kept = {lang: [w for (k, w), n in seen.items() if k == lang and n >= least] for lang, _ in groups}
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, source in groups:
        terms, peers = kept[lang], [s for k, s in groups if k == lang]
        share = {}
        for s in peers:
            total = sum(counts[lang, s, w] for w in terms)
            share[s] = [1 + 10**9 * (counts[lang, s, w] + 2) // (total + 2 * len(terms)) for w in terms]
        every = [sum(counts[lang, s, w] for s in peers) for w in terms]
        q = [1 + 10**9 * (n + 2) // (sum(every) + 2 * len(terms)) for n in every]
        pair = [(-sum(map(f, share[source], share[s])), s.encode(), s) for s in peers if s != source]
        term = [(-f(p, b), w.encode(), w) for w, p, b in zip(terms, share[source], q) if counts[lang, source, w] and p > b]
        for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
            out += [(lang, source, part, s, -v, k + 1) for k, (v, _, s) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block, met, held", [(1 << 15, 1 << 21, 600_000), (40, 7, 5)])
def test_against_plain_counts(spark, monkeypatch, block, met, held):
    monkeypatch.setattr(source_divergence, "BLOCK", block)
    monkeypatch.setattr(source_divergence, "MET", met)
    monkeypatch.setattr(source_divergence, "HELD", held)
    rng = random.Random(4)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)] + ["Été", "ÉTÉ", "日本", "A", "a"]
    docs = [("_".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(80))), rng.choice(["x", "y", None]), rng.choice("abcdefg")) for _ in range(200)]
    docs += [(None, "x", "silent"), ("", "alone", "only"), ("one word", None, None), ("tie tie", "z", "b"), ("tie tie", "z", "a"), ("tie tie", "z", "c")] + [("same same", "r", "a")] * 3 + [("other", "r", "b")]
    df = spark.createDataFrame([(t, lang, s, 1, "n") for t, lang, s in docs], "text string, lang string, source string, n int, term string")
    for least, top in ((10, 10), (2, 3)):
        assert rows(source_divergence.source_divergence(df, least, top)) == brute(docs, least, top)


def test_odd_tables(spark):
    schema = "text string, lang string, source string"
    assert rows(source_divergence.source_divergence(spark.createDataFrame([], schema))) == []
    bare = spark.createDataFrame([(None, None, None), ("", None, "b"), ("123 !", None, "c"), ("x", "one", "s")], schema)
    assert rows(source_divergence.source_divergence(bare)) == brute([tuple(r) for r in bare.collect()], 10, 10)
    long = spark.createDataFrame([("word other " * 40_000, "x", "a"), ("other", "x", "b")], schema)
    assert rows(source_divergence.source_divergence(long, 1)) == brute([tuple(r) for r in long.collect()], 1, 10)
