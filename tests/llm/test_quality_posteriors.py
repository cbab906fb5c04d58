"""The posteriors of the quality classifier, worked out anew in plain Python from each document's own probability."""

import collections
import math

import pytest

pytest.importorskip("tessera.llm")

from tessera.llm import quality_classifier as Q

SF = "/root/testdata/sf0.001"


def posteriors(rows):
    """For each row (host, path, p): p_path and p_good."""
    n = len(rows)
    mean = min(0.999, max(0.001, sum(p for _, _, p in rows) / n))
    paths, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for h, q, p in rows:
        paths[h, q].append(p)
        hosts[h].append(p)
    average = lambda x: sum(x) / len(x)
    within = sum((p - average(paths[h, q])) ** 2 for h, q, p in rows) / max(1, n - len(paths))
    among_paths = sum(len(x) * (average(x) - average(hosts[h])) ** 2 for (h, _), x in paths.items())
    among_hosts = sum(len(x) * (average(x) - sum(p for _, _, p in rows) / n) ** 2 for x in hosts.values())
    sizes = sum(sum(len(x) ** 2 for (g, _), x in paths.items() if g == h) / len(own) for h, own in hosts.items())
    of_paths = (among_paths - (len(paths) - len(hosts)) * within) / max(1e-9, n - sizes)
    of_hosts = (among_hosts - (len(hosts) - 1) * within) / max(1e-9, n - sum(len(x) ** 2 for x in hosts.values()) / n)
    strength = lambda v: min(1e4, max(2.0, mean * (1 - mean) / v - 1)) if v > 0 else 1e4
    a, b = strength(of_hosts), strength(of_paths)
    logit = lambda p: math.log(p / (1 - p))
    out = []
    for h, q, p in rows:
        host = (a * mean + sum(hosts[h]) - p) / (a + len(hosts[h]) - 1)
        path = min(0.999, max(0.001, (b * host + sum(paths[h, q]) - p) / (b + len(paths[h, q]) - 1)))
        out.append((path, 1 / (1 + math.exp(-(logit(p) - logit(mean) + logit(path))))))
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_posteriors(spark, monkeypatch, most):
    monkeypatch.setattr(Q, "MOST_SITES", most)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.selectExpr("doc_id", "text", "lang", "case when doc_id % 9 = 0 then null when doc_id % 5 = 0 then 'small' || doc_id else source end as source")
    got = Q.quality_classifier(docs, spark.read.parquet(f"{SF}/labels.parquet"), carry=("doc_id", "source", "lang")).orderBy("doc_id").collect()
    want = posteriors([(r["source"] or "", r["lang"] or "", r["p_document"]) for r in got])
    assert len(got) == docs.count() and len({r["source"] for r in got}) > 20
    for r, (path, good) in zip(got, want, strict=True):
        assert math.isclose(r["p_path"], path, rel_tol=1e-6) and math.isclose(r["p_good"], good, rel_tol=1e-6, abs_tol=1e-9)
        assert r["kept"] == (r["p_good"] >= 0.5 and r["p_toxic"] < 0.5)
