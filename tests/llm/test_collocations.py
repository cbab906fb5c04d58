"""Phrase mining against SQL and a count in plain Python, with and without colliding fingerprints."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

pytest.importorskip("tessera.llm")

from tessera.llm import collocations, queries

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '/root/testdata/sf{sf}/documents.parquet'")
    want = sorted(db.sql(f"select {', '.join(COLUMNS)} from ({queries.oracle_sql()['op13_collocations']})").fetchall())
    got = rows(queries.op13_collocations(spark, f"/root/testdata/sf{sf}"))
    assert got == want and len(got) > 100


def brute(docs, least, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    frequent = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    found = collections.defaultdict(list)
    for (lang, p), a in frequent.items():
        if any(k == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for (k, q), b in frequent.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(p).encode(), " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p, -a, lf, rf, n[lang], -s) for lang, x in found.items() for i, (s, a, _, p, lf, rf) in enumerate(sorted(x)[:top]))


@pytest.fixture(scope="module")
def fixture(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(25)] + ["Été", "New", "york", "\x00z", "　", "日本"]
    docs = []
    for k in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n"]) for _ in range(rng.randrange(90)))
        docs.append((k, text, rng.choice(["x", "y", None])))
    docs += [(200 + k, "new York City hall " * 3, "x") for k in range(8)] + [(300, "a a a a a a a a a a a a a a", "z"), (300, "a a a", "z"), (None, "new york city", "x"), (None, None, None), (301, "", "q"), (302, "few words", "r")]
    return docs, spark.createDataFrame([(i, t, lang, 1, "y") for i, t, lang in docs], "doc_id long, text string, lang string, n int, phrase string")


@pytest.mark.parametrize("bits, bitmap, held", [(64, 26, 1_500_000), (64, 10, 50), (5, 26, 40), (11, 12, 1_500_000)])
def test_against_plain_counts(fixture, monkeypatch, bits, bitmap, held):
    """Few bits let fingerprints collide: phrases are told apart all the same."""
    monkeypatch.setattr(collocations, "BITMAP_BITS", bitmap)
    monkeypatch.setattr(collocations, "HELD", held)
    docs, df = fixture
    plain = [(t, lang) for _, t, lang in docs]
    for least, top in ((10, 2000), (4, 7)):
        want = brute(plain, least, top)
        assert rows(collocations.collocations(df, least, top, bits)) == want and len(want) > 4


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string"
    assert rows(collocations.collocations(spark.createDataFrame([], schema))) == []
    assert rows(collocations.collocations(spark.createDataFrame([(1, None, None), (None, "", "x"), (2, " .. \n", None)], schema))) == []
    long = spark.createDataFrame([(7, "a b c. " * 30_000, None)] * 2, schema)
    assert rows(collocations.collocations(long)) == brute([("a b c. " * 30_000, None)] * 2, 10, 2000)


def test_fingerprints_do_not_depend_on_the_place():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 50, np.uint64)
    twice = np.concatenate([values, values])
    starts = np.array([0, 3, 20])
    a = collocations.stretches(twice, collocations.BASES[0][0], starts, starts + 17)
    b = collocations.stretches(twice, collocations.BASES[0][0], starts + 50, starts + 67)
    assert (a == b).all() and len(set(a.tolist())) == 3
