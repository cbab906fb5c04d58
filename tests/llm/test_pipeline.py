"""Each stage of the pipeline against brute force, and on odd input."""

import re

import pytest

pytest.importorskip("tessera.llm")

import public_tokenizers as public

import corpus_pipeline
from tessera.llm import byte_bpe, decontaminate, secret_scan
from tessera.llm.queries import op1_quality_classifier
from tessera.llm.shared import materialise, shared_dir

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, row string, features long, _hashed long, n long, words string, p_good double, kept boolean, node long, component_id long, item_id long, block int"
EXTRA = ("r", 1, 2, 3, "w", 0.5, False, 4, 5, 6, 7)
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "two words"), (4, "two words"), (None, "no id here"), (5, "x " * 60_000), (6, "é\U0001f600 İ password=abcdefghijkl12345"), (7, "the same words here as there"), (8, "the same words here as there")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None, None if t is None else len(t), *EXTRA) for i, t in ROWS], FIELDS)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_empty_tables(spark, odd, stage):
    name, run = stage
    got = run(spark, odd, SF)
    assert run(spark, odd.limit(0), SF).collect() == []
    if name == "byte_bpe":
        assert got.count() == len(ROWS)
        return
    assert got.columns == odd.columns
    before, after = plain(odd), plain(got)
    if name == "near_dedup":
        assert after == [r for r in before if r[0] != 8]
    elif name == "secret_scan":
        assert [r for r in after if r[0] != 6] == [r for r in before if r[0] != 6]
        (masked,) = [r for r in after if r[0] == 6]
        assert masked[1] == "é\U0001f600 İ [secret]" and masked[4] == len(masked[1]) and masked[5:] == EXTRA
    elif name == "decontamination":
        assert after == before
    else:
        assert all(r in before for r in after)


def test_each_stage_against_brute_force(spark):
    folder, docs = shared_dir(spark), spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), folder, name)
        out.append({r["doc_id"]: r for r in docs.collect()})
    good, single, clean, masked, coded = out
    first = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    assert good == {i: first[i] for i in (r["doc_id"] for r in op1_quality_classifier(spark, SF).filter("p_good >= 0.5 and p_toxic < 0.5").collect())}

    sets = {}
    for i, r in good.items():
        w = (r["text"] or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert single == {i: good[i] for i in ids if find(i) == i}

    items = [" ".join(decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = {i: " ".join(decontaminate.words_of(r["text"] or "")) for i, r in single.items()}
    assert clean == {i: single[i] for i, w in words.items() if not any(f" {x} " in f" {w} " for x in items)}

    assert masked.keys() == clean.keys() and any(masked[i]["text"] != clean[i]["text"] for i in clean)
    for i, r in masked.items():
        text, spans = clean[i]["text"] or "", secret_scan.secrets_of(clean[i]["text"] or "")[1]
        hidden = [any(s <= k < e for _, s, e in spans) for k in range(len(text))]
        assert "".join(c for c, h in zip(text, hidden, strict=True) if not h) == (r["text"] or "").replace("[secret]", "") or "[secret]" in text
        assert not secret_scan.secrets_of(r["text"] or "")[1] and r["n_chars"] == len(r["text"] or "")
        assert len(re.findall(r"\[secret\]", r["text"] or "")) <= len(spans)

    import tiktoken

    ref = tiktoken.Encoding("ref", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {i: r["ids"] for i, r in coded.items()} == {i: ref.encode_ordinary(r["text"] or "") for i, r in masked.items()}
