"""The corpus operators against brute force, and on odd input."""

import base64
import collections
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import pytest

pytest.importorskip("tessera.llm")

import public_tokenizers as public

from tessera.llm import byte_bpe, decontaminate, license_scan, lm_score, near_dedup, pii, quality_classifier, quality_rules, queries, secret_scan, token_files
from tessera.llm.shared import shared_dir

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, _words string, n_words long"
LONG = "word " * 30_000
ODD = [(1, None), (2, ""), (3, " \t\n\r "), (4, "one two"), (4, "one two"), (5, "the same five words here"), (6, "The SAME five words here"), (7, LONG), (8, "ÀÉ \U0001f600 İ K\x0b\x1c 　x"), (None, "no id"), (9, "<|endoftext|>")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None, 5, "x", 7) for i, t in ODD], SCHEMA)


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_byte_bpe_is_tiktoken(docs, odd):
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    ref = tiktoken.Encoding("ref", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, odd.filter("doc_id is not null")):
        want = texts(df)
        for r in byte_bpe.byte_bpe(df, path, public.PATTERN).collect():
            assert r["ids"] == ref.encode_ordinary(want[r["doc_id"]]) and r["round_trip"]
            assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
    coder = byte_bpe.ByteBpe(path, public.PATTERN)
    rng = random.Random(3)
    for batch in [["a \nb", "b a"], ["  a", "a  b ", "\na", " \n"]] + [["".join(rng.choice("ab1 \n\t'é,") for _ in range(rng.randrange(30))) for _ in range(50)] for _ in range(20)]:
        for t, ids in zip(batch, coder.encode_all(batch), strict=True):
            assert list(memoryview(ids).cast("I")) == ref.encode_ordinary(t), t


def test_token_files_hold_the_library_s_ids(spark, docs, odd):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for df in (docs, odd):
        path = shared_dir(spark)
        token_files.write_tokens(df, path, public.path("word_bpe_49k.json"), 1)
        rows = token_files.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
        want = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
        assert [r["doc_id"] for r in rows] == [d for d, _ in want]
        start = 0
        for r, (_, t) in zip(rows, want, strict=True):
            ids = ref.encode(t or "", add_special_tokens=False).ids + [1]
            assert r["ids"] == ids and r["start"] == start and r["n_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
            start += len(ids)
        assert token_files.read_document(spark, path, rows[-1]["doc_id"]) == rows[-1]["ids"]
    path = shared_dir(spark)
    token_files.write_tokens(odd.limit(0), path, public.path("word_bpe_49k.json"), 1)
    assert token_files.read_tokens(spark, path).collect() == []


def test_token_ids_of_any_characters():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    ref, words, rng = Tokenizer.from_file(path), token_files.Words(path), random.Random(6)
    chars = [*"abZÉé'sSTDl \n\t  ,.;ßİſﬁ1²½9 ªºµ×÷ÿŸ\u0301中\U0001f600x\x0b\x1c\x85\xa0\u3000", "<|endoftext|>", "'VE", "'re"]
    for _ in range(100):
        batch = ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(20)]
        ids, at = words.encode_all(pa.array(batch))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ref.encode(t, add_special_tokens=False).ids for t in batch]


def test_near_duplicates_against_all_pairs(spark, docs):
    extra = docs.limit(40).selectExpr("doc_id + 10000 as doc_id", "concat(text, ' one more word') as text")
    df = docs.select("doc_id", "text").union(extra)
    sets = {}
    for i, t in texts(df).items():
        w = [x.decode() for x in t.encode().lower().split()]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("region, block, shingles", [(4, 4, 10**9), (8, 1000, 1000), (16, 3, 500)])
def test_near_duplicates_cut_into_blocks(spark, monkeypatch, region, block, shingles):
    """Chains (each text alike its neighbours only), a crowd about one text, and texts with a common part that are no links."""
    monkeypatch.setattr(near_dedup, "REGION", region)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*words[:k], "x", *words[k + 1 :]])) for k in range(60)] + [(99, "quite another text of a few words")]
    rows += [(100 + k, " ".join(f"c{j}" for j in range(8 * k, 8 * k + 120))) for k in range(40)]
    rows += [(200 + k, " ".join([*(f"p{j}" for j in range(150)), *(f"q{k}x{j}" for j in range(50))])) for k in range(40)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) == 43


def test_near_duplicates_at_the_threshold_in_crowded_regions(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 1)
    rows = []
    for k in range(1500):  # 181 of 211 shingles in common: 0.858
        words = [f"w{k}x{j}" for j in range(200)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:185], *(f"v{k}x{j}" for j in range(15))]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in got if r["component_id"] != r["doc_id"] // 2 * 2] == []


def test_near_duplicates_of_the_pipeline_from_80_percent(spark):
    import corpus_pipeline

    words = [f"w{j}" for j in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:179], *(f"v{j}" for j in range(21))]))]  # 175 of 217: 0.806
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, df, SF).collect()] == [1]
    assert all(r["kept"] for r in near_dedup.near_duplicates(df).collect())
    assert near_dedup.trees_for(85) == 16 and near_dedup.trees_for(80) == 22 and near_dedup.most_different(85) == 36


def test_rules_against_brute_force(docs):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in texts(docs).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        places = collections.defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        covered = {k + j for v in places.values() if len(v) > 1 for k in v for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_licenses_against_brute_force(spark):
    bits = ["mit license", "MIT-License", "the", "Apache License, Version 2.0", "gnu general public license", "GNU  General\nPublic License v3", "cc by", "CC.BY", "cc", "by", "é", "..."]
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for k in range(300)]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower().decode())
        places = [(k, label) for p, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_license_detections_against_plain_patterns(spark):
    rules, rng = license_scan.rules(), random.Random(11)
    assert len(rules) > 300
    bits = ["mit license", "is licensed under the", "released under", "see the", "Apache License", "version", "2.0", "3", "GNU", "General Public License", "lesser", "Creative Commons Attribution", "non commercial", "cc-by-sa 4.0", "cc by nc", "all rights reserved", "SPDX-License-Identifier:", "MIT", "for details", "bsd", "the", "license"]
    rows = [(k, " ".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for k in range(300)] + [(999, "MIT License. " * 40)]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        norm = f" {re.sub(license_scan.GAP, ' ', t.encode().lower().decode()).strip()} "
        every = {(label, p, w, *m.span()) for label, p, w, keyword, rx in rules if keyword in norm for m in re.finditer(f"(?<= )(?:{rx})(?= )", norm)}
        left = {d for d in every if not any(x[3] <= d[3] and x[4] >= d[4] and (x[1] < d[1] or x[1] == d[1] and x[4] - x[3] > d[4] - d[3]) for x in every)}
        r = got[i]
        assert {tuple(d) for d in r["detections"]} == left and len(r["detections"]) == len(left), t
        assert set(filter(None, r["labels"].split(","))) == {d[0] for d in left} | set(filter(None, r["base_labels"].split(",")))
        assert r["score"] == max([d[2] for d in left] + [0.6 if r["n_base"] else 0.0])


def test_license_scan_of_very_many_statements(spark):
    import time

    start = time.time()
    (row,) = license_scan.license_scan(spark.createDataFrame([(1, "Licensed under the MIT License. " * 20_000)], "doc_id long, text string")).collect()
    assert row["n_base"] == 20_000 == len(row["detections"]) and time.time() - start < 60


def test_license_rules_hold_their_keywords(spark):
    from re import _parser

    def every(parsed):
        """All texts that a pattern of literals, ranges, options and alternatives matches."""
        out = [""]
        for op, x in parsed:
            if str(op) == "LITERAL":
                part = [chr(x)]
            elif str(op) == "IN":
                part = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in x]
            elif str(op) == "SUBPATTERN":
                part = every(x[-1])
            elif str(op) == "BRANCH":
                part = [t for b in x[1] for t in every(b)]
            else:
                assert str(op) == "MAX_REPEAT" and x[:2] == (0, 1)
                part = ["", *every(x[2])]
            out = [a + b for a in out for b in part]
        return out

    assert [(k, t) for _, _, _, k, rx in license_scan.rules() for t in every(_parser.parse(rx)) if k not in t] == []
    want = {"Released under the Expat License": "mit", "Creative Commons Zero": "cc0-1.0", "wtfpl": "wtfpl", "Creative Commons Attribution ShareAlike": "cc-by-sa", "Creative Commons Attribution No Derivatives": "cc-by-nd", "Creative Commons Attribution Non Commercial": "cc-by-nc", "Creative Commons Attribution Non Commercial Share Alike": "cc-by-nc-sa"}
    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).collect()
    assert {list(want)[r["doc_id"]]: r["labels"] for r in got} == want


def test_pii_base_patterns_and_added_mentions(spark):
    rng = random.Random(2)

    def plain(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    for _ in range(3000):
        t = "".join(rng.choice("0123456789+@.-() abZ") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == plain(t)
    text = "call +1 (555) 010-2233 now. Later again: 1.555.010.2233 and jo@mail.example.com or jo[at]mail.example.com"
    rows = [(1, text)] + [(k, f"call +1 (555) 010-{k} or +1 (555) 011-{k} today") for k in range(1000, 1200)]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[1]
    assert got["n_phone"] == 1 and got["n_email"] == 1 and got["n_added"] >= 1
    assert f"phone:{text.index('1.555')}" in got["spans"]


def test_belief_propagation_against_all_labellings():
    import itertools
    import math

    rng = random.Random(9)
    right = tried = 0
    for turn in range(120):
        n, width = rng.randrange(1, 7), rng.randrange(2, 4)
        local = [[rng.uniform(-2, 2) for _ in range(width)] for _ in range(n)]
        pairs = [(rng.randrange(k), k) for k in range(1, n)]  # a tree
        loops = [p for p in itertools.combinations(range(n), 2) if p not in pairs] if turn % 2 else []
        links = [(a, b, [[rng.uniform(-1, 1) + (i == j) for j in range(width)] for i in range(width)]) for a, b in pairs + loops[:2]]
        mass = [[0.0] * width for _ in range(n)]
        for labels in itertools.product(range(width), repeat=n):
            w = math.exp(sum(local[k][x] for k, x in enumerate(labels)) + sum(t[labels[a]][labels[b]] for a, b, t in links))
            for k, x in enumerate(labels):
                mass[k][x] += w
        for exact, got in zip(mass, pii.beliefs(local, links, 20), strict=True):
            exact = [x / sum(exact) for x in exact]
            got = [math.exp(x - max(got)) for x in got]
            got = [x / sum(got) for x in got]
            if not loops:
                assert got == pytest.approx(exact, abs=1e-9)
            elif max(exact) > 0.6:
                tried += 1
                right += exact.index(max(exact)) == got.index(max(got))
    assert tried > 50 and right >= 0.95 * tried


@pytest.mark.parametrize("base, others", [(5, 0), (200, 200), (3000, 50), (50, 3000)])
def test_pii_added_in_corpora_of_any_size(base, others, spark):
    text = "write to +1 (555) 010-2233 today. Later again: 1.555.010.2233 or 555-010-2233, and order 5550102234 of 77215550102"
    rows = [(k, f"call +1 (555) 019-{k:04} or {k}.x@mail.example.com today") for k in range(base)]
    rows += [(10_000 + k, f"order {5_000_000_000 + 37 * k} of batch {k}") for k in range(others)] + [(99_999, text)]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 99999").collect()}[99_999]
    found = got["spans"].split(",")
    assert f"phone:{text.index('1.555')}:{text.index('1.555') + 14}" in found and f"phone:{text.index('555-')}:{text.index('555-') + 12}" in found
    if others:
        assert not any(x.startswith(f"phone:{text.index('5550102234')}:") for x in found)


def test_secrets_in_layers(spark):
    inner = "password=abcdefghijkl12345 tail"
    packed = base64.b64encode(gzip.compress(inner.encode())).decode()
    twice = base64.b64encode(urllib.parse.quote("secret: 'ABCDEFGHIJKLMNOP'").encode()).decode()
    text = f"x {packed} y {urllib.parse.quote('token=%5BAKIA' + 'A' * 18)} z {twice} \\u0070assword=0123456789ab"
    base, every = secret_scan.secrets_of(text)
    found = {(k, text[s:e]) for k, s, e in every}
    assert set(base) <= set(every) and ("assign", packed) in found and any(k == "assign" and twice.startswith(x[:8]) for k, x in found)
    assert any(x.startswith("\\u0070") for _, x in found)
    out = secret_scan.redact_secrets(spark.createDataFrame([(1, text, 3), (2, None, None)], "doc_id long, text string, n_chars long")).collect()
    assert packed not in out[0]["text"] and out[0]["n_chars"] == len(out[0]["text"]) and out[1]["text"] is None


def test_secrets_of_a_repeated_blob(spark):
    inner = base64.b64encode(b"password=abcdefghijkl12345 tail").decode()
    for twice in (base64.b64encode(f"x {inner} y".encode()).decode(), base64.b64encode(gzip.compress(f"x {inner} y".encode(), mtime=0)).decode()):
        text = f"a {twice} b {twice} c"
        every = secret_scan.secrets_of(text)[1]
        assert len(every) == 2 and every[1][1] - every[0][1] == text.rindex(twice) - text.index(twice)
        out = secret_scan.redact_secrets(spark.createDataFrame([(1, text, 3)], "doc_id long, text string, n_chars long")).first()
        assert out["text"].count("[secret]") == 2


def test_base_secrets_against_plain_patterns(spark):
    def plain(t):
        out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.IGNORECASE | re.ASCII) if len(m[2]) >= 12]
        out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        return sorted(out, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))

    rng = random.Random(10)
    bits = ["password", "PassWD", "secret", "token", "ſecret", "api_key", "apikey", " ", "=", ": ", '"', "'", "AKIA", "ABC123", "0123456789abcdef", "abcdef", "xyz_./-+", "é", "\n"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for k in range(600)]
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        want, r = plain(t), got[k]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[0] == kind for x in want) for kind in secret_scan.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest()


def test_secrets_in_every_sort_of_layer():
    import time

    import zstandard

    inner = "password=abcdefghijkl12345 tail"
    raw, zipped, pressed = inner.encode(), gzip.compress(inner.encode()), zstandard.ZstdCompressor().compress
    b64 = lambda x: base64.b64encode(x).decode()
    layers = {
        "second member": b64(gzip.compress(b"nothing to see here") + zipped),
        "second frame": b64(pressed(b"nothing") + pressed(raw)),
        "packed twice": b64(pressed(zipped)),
        "packed in URL escapes": "".join(f"%{c:02x}" for c in zipped),
        "packed in Unicode escapes": "".join(f"\\x{c:02x}" for c in zlib.compress(raw)),
        "beyond 64 MB": b64(gzip.compress(b"some of these words " * 4_000_000 + raw)),
    }
    for name, t in layers.items():
        _, every = secret_scan.secrets_of(f"a {t} z")
        assert ("assign", 2, 2 + len(t)) in every, name
    assert [x[0] for x in secret_scan.secrets_of(b64(b"\xff\x00 " + raw))[1]] == ["assign"]
    wrapped = base64.encodebytes(b"words before it, " * 9 + raw).decode()
    (kind, s, e), = secret_scan.secrets_of(f"see\n{wrapped}end")[1]
    assert kind == "assign" and "\n" in wrapped and 0 < e - s < 60
    packed = base64.encodebytes(gzip.compress(random.Random(1).randbytes(300) + b" " + raw)).decode().strip()
    assert ("assign", 4, 4 + len(packed)) in secret_scan.secrets_of(f"see\n{packed} end")[1]
    assert [x[0] for x in secret_scan.secrets_of(base64.b64encode(b"0123456789abcdef").decode().rstrip("="))[1]] == ["hex"]
    deep = inner
    for _ in range(6):
        deep = urllib.parse.quote(b64(gzip.compress(deep.encode())), safe="")
    assert ("assign", 0, len(deep)) in secret_scan.secrets_of(deep)[1]
    for t in ("a" * 500_000 + "%41" + "b" * 500_000, "Z%" * 500_000 + "%41", "\\" * 1_000_000 + "\\u0041", "中" * 1_000_000 + "%41"):
        start = time.process_time()
        secret_scan.secrets_of(t)
        assert time.process_time() - start < 5  # quadratic patterns took hours


def test_leaks_against_a_scan(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {(i, b["item_id"]) for i, t in texts(docs).items() for b in items.collect() if f" {' '.join(decontaminate.words_of(b['text']))} " in f" {' '.join(decontaminate.words_of(t))} "}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == want
    left = {r["doc_id"] for r in decontaminate.drop_leaks(docs, items).collect()}
    assert left == set(texts(docs)) - {i for i, _ in want}


def test_leaks_of_short_items(spark):
    rng = random.Random(8)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 16)] + [(20, "What is it? The thing."), (21, "Where? Here")]
    filler = lambda n: " ".join(f"f{rng.randrange(500)}" for _ in range(n))
    rows = [(1000 + k, t) for k, t in items] + [(2000 + k, f"{filler(rng.randrange(200))} {t.upper()}, {filler(rng.randrange(200))}") for k, t in items]
    rows += [(3000 + k, filler(300)) for k in range(20)] + [(1, None), (2, ""), (2, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, item_id int")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, table).collect()}
    assert got == {(base + k, k) for base in (1000, 2000) for k, _ in items}
    left = decontaminate.drop_leaks(docs, table)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 2, *range(3000, 3020)]
    assert decontaminate.drop_leaks(docs.limit(0), table).collect() == [] == decontaminate.find_leaks(docs.limit(0), table).collect()
    assert decontaminate.drop_leaks(docs, table.limit(0)).count() == len(rows)


def test_leaks_in_several_shards(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    once = sorted(decontaminate.find_leaks(docs, items).collect())
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 300)
    assert sorted(decontaminate.find_leaks(docs, items).collect()) == once and len(list(decontaminate.shards_of(items))) > 2
    kept = {r["doc_id"] for r in decontaminate.drop_leaks(docs, items).collect()}
    assert kept == set(texts(docs)) - {r["doc_id"] for r in once}


def test_block_max_search_finds_all_above_the_threshold():
    rng = random.Random(4)
    items = [(k, " ".join(f"t{min(rng.randrange(60), rng.randrange(60))}" for _ in range(20))) for k in range(300)]
    df = collections.Counter(w for _, t in items for w in set(t.split()))
    index = decontaminate.Index(items, df, len(items), 20.0)
    import numpy as np

    for _ in range(60):
        terms = np.array(sorted(rng.sample(range(len(index.terms)), 25)))
        score = collections.Counter()
        for t in terms.tolist():
            for c, w in zip(*index.lists[t], strict=True):
                score[c] += w
        assert sorted(c for c, _ in index.search(terms, 0.5)) == sorted(c for c, s in score.items() if s >= 0.5)


def test_losses_of_the_two_models(spark):
    rows = [(1, "abab"), (2, "abac"), (3, "")]
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert got[1]["n_tokens"] == 4 and got[1]["ce_difference"] < got[2]["ce_difference"] and got[3]["ce_difference"] is None


def test_losses_against_counted_dictionaries(spark, docs, monkeypatch):
    import math

    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 20_000)
    rows, chosen = docs.select("doc_id", "text").limit(60), spark.createDataFrame([(k,) for k in range(0, 60, 3)] + [(None,), (3,)], "doc_id long")
    data = {i: b"\0" * 4 + t.encode() for i, t in texts(rows).items()}
    picked = {r["doc_id"] for r in chosen.collect()}

    def model(held):
        counts = [collections.Counter(x[k - n + 1 : k + 1] for x in held for k in range(4, len(x))) for n in range(1, 6)]
        before = [collections.Counter() for _ in range(5)]
        for order, found in enumerate(counts):
            for gram, n in found.items():
                before[order][gram[:-1]] += n

        def probability(gram):
            p = 1 / 256
            for n in range(1, 6):
                part = gram[len(gram) - n :]
                p = (counts[n - 1][part] + lm_score.PSEUDO * p) / (before[n - 1][part[:-1]] + lm_score.PSEUDO)
            return p

        return probability

    target, every = model([x for i, x in data.items() if i in picked]), model(list(data.values()))
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(rows, chosen).collect()}
    for i, x in data.items():
        grams = [x[k - 4 : k + 1] for k in range(4, len(x))]
        r = got[i]
        assert r["n_tokens"] == len(grams)
        if grams:
            a, b = (-sum(math.log(m(g)) for g in grams) / len(grams) for m in (target, every))
            assert (r["ce_target"], r["ce_background"], r["ce_difference"]) == pytest.approx((a, b, a - b), abs=1e-9)


def test_quality_posterior_against_documents_one_by_one(docs):
    import math

    names = [r[0] for r in quality_rules.RULES]
    votes = quality_rules.features(docs).select("doc_id", *quality_rules.votes()).collect()
    seen = [tuple(r[f"vote_{n}"] for n in names) for r in votes]
    share, table = quality_rules.PRIOR_GOOD, [dict(quality_rules.START) for _ in names]
    for _ in range(quality_rules.ROUNDS):
        good = []
        for v in seen:
            a, b = share, 1 - share
            for x, t in zip(v, table, strict=True):
                a, b = a * t[x][0], b * t[x][1]
            good.append(a / (a + b))
        old, share = share, (sum(good) + 8) / (len(seen) + 10)
        new = [{x: ((sum(g for g, v in zip(good, seen, strict=True) if v[k] == x) + 10 * s[0]) / (sum(good) + 10), (sum(1 - g for g, v in zip(good, seen, strict=True) if v[k] == x) + 10 * s[1]) / (len(seen) - sum(good) + 10)) for x, s in quality_rules.START.items()} for k in range(len(names))]
        moved = max([abs(share - old)] + [abs(a - b) for x, y in zip(new, table, strict=True) for v in x for a, b in zip(x[v], y[v], strict=True)])
        table = new
        if moved < quality_rules.TOLERANCE:
            break
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for r, v in zip(votes, seen, strict=True):
        odds = math.log(share / (1 - share)) + sum(math.log(t[x][0] / t[x][1]) for x, t in zip(v, table, strict=True))
        p = 1 / (1 + math.exp(-odds))
        assert got[r["doc_id"]]["p_good"] == pytest.approx(p, abs=1e-6) and got[r["doc_id"]]["kept"] == (p >= 0.5 and not got[r["doc_id"]]["base_failed"])


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality_classifier.quality_classifier(docs, labels.filter("doc_id % 3 <> 0")).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in out)
    assert right >= 0.9 * len(out)


def test_classifier_whatever_the_columns_labels_and_sites(spark, docs, monkeypatch):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = ["p_document", "p_toxic", "p_path", "p_good", "kept"]
    answers = lambda df: {r["doc_id"]: tuple(x if isinstance(x, bool) else round(x, 9) for x in (r[c] for c in columns)) for r in df.collect()}
    want = answers(quality_classifier.quality_classifier(docs, labels))
    clash = docs.selectExpr("*", "1 as features", "2 as _hashed", "3 as n", "4 as words", "5 as upper", "6 as p_good", "7 as _host", "8 as row")
    out = quality_classifier.quality_classifier(clash, labels, carry=tuple(clash.columns))
    assert answers(out) == want and out.columns == [c for c in clash.columns if c != "p_good"] + columns
    assert all((r["features"], r["n"], r["row"]) == (1, 3, 8) for r in out.collect())
    worse = labels.selectExpr("doc_id", "0 as quality", "0 as toxic").filter("doc_id % 3 = 0")
    lowest = labels.selectExpr("doc_id", "case when doc_id % 3 = 0 then 0 else quality end as quality", "toxic")
    assert answers(quality_classifier.quality_classifier(docs, labels.union(worse))) == answers(quality_classifier.quality_classifier(docs, lowest))
    monkeypatch.setattr(quality_classifier, "MOST_SITES", 0)
    assert answers(quality_classifier.quality_classifier(docs, labels)) == want


def test_strengths_of_sites(spark):
    import numpy as np

    rng, rows = np.random.default_rng(1), []
    for h in range(300):
        centre = rng.beta(6, 4)  # ten pseudo-documents
        for p in range(4):
            x = rng.binomial(1, min(0.99, max(0.01, centre + rng.normal(0, 0.02))), 40)
            rows.append((f"h{h}", f"p{p}", 40, float(x.sum()), float((x * x).sum())))
    mean, hosts, paths = quality_classifier.strengths(spark.createDataFrame(rows, "_host string, _path string, n long, s double, q double"))
    assert abs(mean - 0.6) < 0.03 and 7 < hosts < 14 and paths > 60
    same = [(f"h{k}", "p", 40, 20.0, 20.0) for k in range(50)]
    assert quality_classifier.strengths(spark.createDataFrame(same, "_host string, _path string, n long, s double, q double"))[1:] == (1e4, 1e4)


def test_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(7, 1, 0), (4, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (3, "one two")], "item_id long, text string")
    runs = {
        "quality": lambda d: quality_classifier.quality_classifier(d, labels),
        "pii": pii.find_pii,
        "rules": quality_rules.quality_rules,
        "lm": lambda d: lm_score.cross_entropy_difference(d, labels.select("doc_id")),
        "secrets": secret_scan.secret_scan,
        "licenses": license_scan.license_scan,
        "bpe": lambda d: byte_bpe.byte_bpe(d, queries.tokenizer_path("byte_bpe_50k.tiktoken"), queries.pretoken_pattern()),
    }
    for name, run in runs.items():
        assert len(run(odd).collect()) == len(ODD), name
        assert run(odd.limit(0)).collect() == [], name
    twice = spark.createDataFrame([(1, "one two three four five six"), (1, "other words here that are six"), (2, "other words here that are six")], "doc_id long, text string")
    assert len(near_dedup.near_duplicates(twice).collect()) == 2
    same = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(odd).collect()}
    assert same[5] == same[6] == 5 and same[1] == 1 and None not in same and len(same) == 9
    assert near_dedup.near_duplicates(odd.limit(0)).collect() == []
    assert decontaminate.find_leaks(odd, items.limit(0)).collect() == []
    assert {r["doc_id"] for r in decontaminate.find_leaks(odd, items).collect()} == {4}
