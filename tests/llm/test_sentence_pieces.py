"""The sentencepiece operator against the library."""

import hashlib
import random

import pytest

pytest.importorskip("tessera.llm")

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import sentencepiece

from tessera.llm import queries, sentence_pieces

SF = "/root/testdata/sf0.001"
PATH = public.path("piece_bpe_32k.model")
ODD = [(1, None), (2, ""), (3, " \t\n\r "), (4, "one  two"), (4, "one  two"), (5, "▁ a▁b ▁"), (6, "<s> </s> <0x41> <unk>"), (7, "word " * 30_000), (8, "ÀÉ \U0001f600 İ K\x0b\x1c 　x\0"), (None, "no id"), (9, "ab" * 20_000), (10, " " * 5_000)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.pieces_of(PATH, False)


def test_ids_and_text_are_the_library_s(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(i, t, 5, "x", 7, "y") for i, t in ODD], "doc_id long, text string, ids int, ids_sha256 string, n_tokens int, _words string")
    for df in (docs, odd):
        got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids"], r["decoded_sha256"], r["ids_sha256"]) for r in sentence_pieces.sentence_pieces(df, PATH).collect())
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r["text"] or "") + [library.eos_id()]
            want.append((r["doc_id"] or 0, len(ids), ids, hashlib.sha256(library.decode(ids).encode()).hexdigest(), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
        assert got == sorted(want)
    assert sentence_pieces.sentence_pieces(odd.limit(0), PATH).collect() == []
    trips = {r["doc_id"]: r["round_trip"] for r in sentence_pieces.sentence_pieces(odd, PATH).collect()}
    assert not trips[5] and all(v for k, v in trips.items() if k != 5)


def test_query(spark, library):
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op11_sentence_pieces(spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(library.encode(t)) + 1 for i, t in text.items()}


def test_texts_of_any_characters(library, pieces):
    rng = random.Random(5)
    chars = [*"abZÉé \n\t  ,.;ßİ中\U0001f600x\0▁", "the", " in", "er", "</s>", "<0x41>", "   ", "́", "▁▁", "----", "       "]
    for _ in range(150):
        batch = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(20)]
        ids, at = pieces.encode_all(pa.array(batch))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(batch)


def test_short_and_long_segments_merge_alike(monkeypatch, library, pieces):
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrd▁") for _ in range(rng.randrange(1, 60))) for _ in range(400)] + ["▁" * k for k in range(1, 60)]
    arrays = pieces.agenda.encode(words)
    monkeypatch.setattr(sentence_pieces, "SHORT", 3)
    heaps = pieces.agenda.encode(words)
    assert all((a == b).all() for a, b in zip(arrays, heaps, strict=True))


def test_any_ids_decode_as_the_library_does(library, pieces):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(259), rng.randrange(130, 259), 0, 1, 2, 28_705]) for _ in range(rng.randrange(9))]
        assert pieces.decode(np.array(ids, np.int64)).decode() == library.decode(ids), ids


def test_a_difference_from_the_library_is_an_error(pieces):
    with open(PATH, "rb") as f:
        other = sentence_pieces.Pieces(f.read())
    other.agenda.rank = other.agenda.rank[::-1].copy()
    with pytest.raises(RuntimeError):
        other.encode_all(pa.array(["the library encodes this otherwise"]))


def test_models_of_other_kinds_are_refused():
    with open(PATH, "rb") as f:
        body = f.read()
    trainer = next(v for k, v in sentence_pieces._fields(body) if k == 2)
    with pytest.raises(ValueError):
        sentence_pieces.Model(body.replace(trainer, trainer.replace(b"\x18\x02", b"\x18\x01", 1)))
