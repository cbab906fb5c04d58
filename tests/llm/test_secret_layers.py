"""Layers that are deep, many, or not what they begin like: each text ends soon, and with its spans."""

import base64
import gzip
import time
import zlib

import pytest

pytest.importorskip("tessera.llm")

from tessera.llm import secret_scan

SECRET = b"password=abcdefghijklmnop"


def b64(data):
    return base64.b64encode(data).decode()


def spans(text, seconds=1.0):
    began = time.time()
    found = secret_scan.secrets_of(text)[1]
    assert time.time() - began < seconds
    return found


def chain(inner, levels):
    return "%" + "25" * levels + inner


def test_nested_escapes_in_packed_data():
    text = b64(gzip.compress(chain("41", 1500).encode()))
    assert len(text) == 60 and {k for k, _, _ in spans(text)} == {"hex"}
    rows = [("token" + chain("3D", 1500) + "abcdefghijklm", "assign"), ("token\\" + "u005c" * 1500 + "u003dabcdefghijklm", "assign")]
    for inner, kind in rows:
        assert kind in {k for k, _, _ in spans(b64(zlib.compress(inner.encode())))}


@pytest.mark.parametrize("levels", [6, 7, 8, 12, 200])
def test_both_sorts_of_escapes_in_one_run(levels):
    text = "secret" + chain("3D", levels) + "abcdefgh" + "\\" + "u005c" * levels + "u0041" + "ijklmn"
    assert ("assign", 0, len(text)) in spans(text)


def test_escapes_that_make_escapes():
    for text in ("secret%5cu003dabcdefghijklm", "secret\\u00253dabcdefghijklm", "secret%%33dabcdefghijklm", "secret%5cx3Dabcdefghijklm", "secret%5c%75%30%30%33%64abcdefghijklm"):
        assert ("assign", 0, len(text)) in spans(text), text
    assert spans("x=%C3%A9%zz \\u12 %4") == []


def test_a_hundred_thousand_characters_of_escapes():
    for text in ("token" + chain("3D", 50_000) + "abcdefghijklm", "token%5cu0025" + "5cu0025" * 14_000 + "3Dabcdefghijklm"):
        assert ("assign", 0, len(text)) in spans(text, 10.0)


def test_data_that_only_begin_like_packed_ones():
    for head in (b"x^ ", b"y^ ", b"x\x9c", b"\x1f\x8b "):
        text = b64(head + SECRET + b" end")
        assert [k for k, _, _ in spans(text)] == ["assign"], head
    cut = b64(zlib.compress(b"nothing here " * 30)[:-9] + b" " + SECRET + b" ")
    assert "assign" in {k for k, _, _ in spans(cut)}
    whole = b64(zlib.compress(b"hello " + SECRET))
    assert spans(whole) == [("assign", 0, len(whole))]


def test_base64_behind_other_letters():
    body = b64(b"yy " + SECRET + b" end")
    for head in ("", "b", "zz", "aaa", "id_", "id12_"):
        (kind, start, end), = spans(head + body)
        assert kind == "assign" and head == "" or start > len(head) - 1 and end <= len(head + body)


def test_deep_layers():
    data = SECRET
    for _ in range(1500):
        data = gzip.compress(data, 1)
    text = b64(data)
    assert spans(text, 5.0) == [("assign", 0, len(text))]
    data = b"a " + SECRET
    for _ in range(12):
        data = base64.b64encode(data)
    assert "assign" in {k for k, _, _ in spans(data.decode())}
    for turn in range(40):
        data = ("".join(f"%{b:02x}" for b in gzip.compress(data)) if turn == 39 else b64(gzip.compress(data))).encode()
    assert "assign" in {k for k, _, _ in spans(data.decode())}


def test_packed_data_in_escapes():
    data = gzip.compress(b"%41%42 secret: abcdefghijklmnop")
    for form in ("%{:02x}", "%25{:02x}", "%2525{:02X}", "\\x{:02x}", "\\u00{:02x}"):
        text = "".join(form.format(b) for b in data)
        assert ("assign", 0, len(text)) in spans(text), form


def test_equal_blobs_at_many_places():
    blob = b64(gzip.compress(SECRET * 50))
    found = spans(" ".join([blob] * 300), 5.0)
    assert len(found) == 300


def test_what_large_packed_data_hold_does_not_depend_on_their_size():
    size = 9 << 20
    # a stretch without a break is one window, so that no match is begun in its middle
    pieces = (b"-" * (1 << 20) for _ in range(9))
    assert [len(w) for w in secret_scan._windows(pieces)] == [size]
    assert [len(w) for w in secret_scan._windows(iter([b"-" * size, b"a b", b"-" * 5, b"x\n", b"!" * 5]))] == [size + 2, 8, 5]
    # a layer that only begins like packed data is text, large or small
    for fill in (100, size):
        broken = gzip.compress(b"nothing")[:-4] + b" " * 3 + SECRET + b" " * fill
        assert {k for k, _, _ in spans(b64(gzip.compress(broken)), 20)} == {"assign"}
