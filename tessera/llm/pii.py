"""Personal data: base patterns, and a skip-chain conditional random field for what they miss.

The nodes of a document are its base spans, whose labels are given, and its other candidate stretches: numbers of
7 or more digits with any separators, and words with an at sign or a spelt-out one. Neighbouring nodes are joined
by chain edges, nodes with the same digits or the same letters by skip edges, however far apart they are. Loopy
belief propagation over both gives each free node its label, so that a number or address that is written in an
odd way takes the label of its other mentions.

Potentials are log ratios of counts over the whole corpus. The base spans are the labelled examples of their kinds;
candidates that share no key with a base span of their document are those of OTHER, and candidates that do share
one are not counted, since their label is what is asked. What makes a stretch a base span (its sign and separators)
is no feature, as no candidate could have it. Every ratio is mixed with a uniform part, so that a potential does not
grow with the size of the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import map_texts, spans_digest, texts_of

#: The kinds in their order; labels are the kinds and OTHER.
KINDS = ("email", "ip", "card", "phone")
OTHER = "other"
LABELS = (*KINDS, OTHER)

LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Other stretches that may be personal data.
NUMBER = re.compile(r"[+(]?[0-9](?:[\x20()./_-]{0,2}[0-9]){6,}")
ADDRESS = re.compile(r"[^\s@\[\]()<>,;]{1,64}(?:@|\[at\]|\(at\)|\[@\])[^\s@\[\]()<>,;]{1,128}", re.IGNORECASE)

#: Neighbours within this many characters get a chain edge; rounds of message passing.
CHAIN_GAP, ROUNDS = 200, 8
#: Smoothing of the counts; the uniform part of each ratio, and the number of values it spreads over.
SMOOTHING, UNIFORM, VALUES = 0.5, 0.1, 16
#: Pairs with one key and one label that the skip potential starts from; only pairs of base spans are counted.
SAME_BEFORE = 1000.0

Span = tuple[str, int, int]
Model = dict[str, dict]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns by kind, then start."""
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and not LOCAL_END.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if any(d in text for d in "0123456789"):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        found += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """A stretch of numbers, cut at blanks where it would pass 19 digits (two numbers that stand side by side)."""
    first, last, held = start, start, 0
    for m in re.finditer(r"\S+", text[start:end]):
        n = len(_digits(m[0]))
        if held and held + n > 19:
            yield first, last
            first, held = start + m.start(), 0
        last, held = start + m.end(), held + n
    yield first, last


def nodes_of(text: str, base: list[Span]) -> list[tuple[str | None, int, int]]:
    """Base spans with their labels and free candidates (None) that overlap none of them, by start."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = []
    for _, e in taken:
        reach.append(max(e, reach[-1] if reach else 0))
    free: list[tuple[None, int, int]] = []
    end = 0
    pool = [part for m in NUMBER.finditer(text) for part in _parts(text, *m.span()) if len(_digits(text[slice(*part)])) >= 7] if any(d in text for d in "0123456789") else []
    pool += [m.span() for m in ADDRESS.finditer(text)] if any(h in text for h in ("@", "[at]", "(at)", "[AT]", "(AT)")) else []
    for s, e in sorted(pool):
        k = bisect_left(starts, e)
        if s >= end and not (k and reach[k - 1] > s):
            free.append((None, s, e))
            end = e
    return sorted([*base, *free], key=lambda n: (n[1], n[2], n[0] or ""))


def features(text: str, start: int, end: int) -> list[str]:
    """Features of a stretch that base spans and other candidates can share."""
    own, around = text[start:end], text[start - 1 : start] + text[end : end + 1]
    digits, at = _digits(own), "@" in own or "[at]" in own.lower() or "(at)" in own.lower()
    return [f"n{0 if at else min(len(digits), 20)}", f"at{at}", f"abc{any(c.isalpha() for c in own)}", f"luhn{16 <= len(digits) <= 19 and luhn(digits)}", f"inside{any(c.isalnum() for c in around)}"]


def keys(text: str) -> list[str]:
    """What a node shares with others that say the same."""
    digits = _digits(text)
    plain = re.sub(r"\[at\]|\(at\)|\[@\]", "@", text.lower())
    plain = re.sub(r"\[dot\]|\(dot\)", ".", plain)
    out = [f"d{digits}"] + [f"d{digits[1:]}"] * (len(digits) == 11 and digits[0] == "1") if len(digits) >= 7 and not any(c.isalpha() for c in plain) else []
    return out + ([f"a{''.join(c for c in plain if c.isalnum() or c == '@')}", f"l{plain.split('@')[0]}"] if "@" in plain else [])


def edges_of(nodes: list[tuple], text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges, and skip edges from each mention to the one before it and to the first (their number is linear)."""
    chain = [(k - 1, k) for k in range(1, len(nodes)) if nodes[k][1] - nodes[k - 1][2] <= CHAIN_GAP]
    skip, first, last = set(), {}, {}
    for k, (_, s, e) in enumerate(nodes):
        for key in keys(text[s:e]):
            if key in first:
                skip |= {(first[key], k), (last[key], k)}
            first.setdefault(key, k)
            last[key] = k
    return chain, sorted(skip)


def train(docs: DataFrame) -> Model:
    """Potentials from counts over all texts; the counts have a bounded number of keys (features and labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for _, texts in texts_of(batch):
                for text in texts:
                    nodes = nodes_of(text, base_spans(text))
                    shared = {key for label, s, e in nodes if label for key in keys(text[s:e])} if any(n[0] is None for n in nodes) else set()
                    labels = [label or (None if shared.intersection(keys(text[s:e])) else OTHER) for label, s, e in nodes]
                    for label, (_, s, e) in zip(labels, nodes, strict=True):
                        if label:
                            counts["label", label, ""] += 1
                            for f in features(text, s, e):
                                counts["unary", label, f] += 1
                    chain, skip = edges_of(nodes, text) if len(nodes) > 1 else ([], [])
                    for a, b in chain:
                        if labels[a] and labels[b]:
                            counts["chain", labels[a], labels[b]] += 1
                    for a, b in skip:
                        if nodes[a][0] and nodes[b][0]:
                            counts["skip", str(labels[a] == labels[b]), ""] += 1
        what, a, b = zip(*counts, strict=True) if counts else ((), (), ())
        yield pa.record_batch([pa.array(what, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["what", "a", "b", "n"])

    rows = docs.select("text").mapInArrow(run, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    n = {(r["what"], r["a"], r["b"]): r["n"] for r in rows}
    total = {c: n.get(("label", c, ""), 0) for c in LABELS}
    chain = {(a, b): n.get(("chain", a, b), 0) + SMOOTHING for a in LABELS for b in LABELS}
    left = {a: sum(chain[a, b] for b in LABELS) for a in LABELS}
    right = {b: sum(chain[a, b] for a in LABELS) for b in LABELS}
    mass = sum(left.values())
    agree, differ = n.get(("skip", "True", ""), 0) + SAME_BEFORE, n.get(("skip", "False", ""), 0) + 1.0
    return {
        "prior": {c: math.log((1 - UNIFORM) * (total[c] + SMOOTHING) / (sum(total.values()) + SMOOTHING * len(LABELS)) + UNIFORM / len(LABELS)) for c in LABELS},
        "unary": {(c, f): math.log((1 - UNIFORM) * n.get(("unary", c, f), 0) / total[c] + UNIFORM / VALUES if total[c] else 1 / VALUES) for f in sorted({r["b"] for r in rows if r["what"] == "unary"}) for c in LABELS},
        "unseen": {c: math.log(UNIFORM / VALUES if total[c] else 1 / VALUES) for c in LABELS},
        "chain": {(a, b): math.log((1 - UNIFORM) * chain[a, b] * mass / (left[a] * right[b]) + UNIFORM) for a in LABELS for b in LABELS},
        "skip": {"same": math.log(max(agree / differ, 1.0) * len(KINDS))},
    }


def beliefs(local: list[list[float]], links: list[tuple[int, int, list[list[float]]]], rounds: int = ROUNDS) -> list[list[float]]:
    """Log beliefs (up to a constant a node) after ``rounds`` of sum-product messages over links (node, node, table)."""
    width = len(local[0]) if local else 0
    messages = {(k, side): [0.0] * width for k in range(len(links)) for side in (0, 1)}
    touching: list[list[tuple[int, int]]] = [[] for _ in local]
    for k, (a, b, _) in enumerate(links):  # message 0 of a link goes to its second end, message 1 to its first
        touching[a].append((k, 1))
        touching[b].append((k, 0))
    belief = [list(x) for x in local]
    for _ in range(rounds if links else 0):
        fresh = {}
        for k, (a, b, table) in enumerate(links):
            for side, source in ((0, a), (1, b)):
                back = messages[k, 1 - side]
                out = [belief[source][i] - back[i] for i in range(width)]
                scores = [[out[i] + (table[i][j] if side == 0 else table[j][i]) for i in range(width)] for j in range(width)]
                message = [max(x) + math.log(sum(math.exp(v - max(x)) for v in x)) for x in scores]
                fresh[k, side] = [v - max(message) for v in message]
        messages = fresh
        belief = [[local[v][i] + sum(messages[k, way][i] for k, way in touching[v]) for i in range(width)] for v in range(len(local))]
    return belief


def infer(text: str, base: list[Span], model: Model) -> list[Span]:
    """The spans that belief propagation adds to the base spans."""
    nodes = nodes_of(text, base)
    if all(n[0] for n in nodes):
        return []
    chain, skip = edges_of(nodes, text)
    local = []
    for label, s, e in nodes:
        own = features(text, s, e)
        local.append([(0.0 if c == label else -50.0) if label else model["prior"][c] + sum(model["unary"].get((c, f), model["unseen"][c]) for f in own) for c in LABELS])
    chain_table = [[model["chain"][a, b] for b in LABELS] for a in LABELS]
    same = model["skip"]["same"]
    skip_table = [[same if a == b else 0.0 for b in LABELS] for a in LABELS]
    belief = beliefs(local, [(a, b, chain_table) for a, b in chain] + [(a, b, skip_table) for a, b in skip])
    return [(LABELS[best], s, e) for (label, s, e), x in zip(nodes, belief, strict=True) if not label and (best := max(range(len(LABELS)), key=x.__getitem__)) < len(KINDS)]


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Personal data in every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone (counts of base spans), base_sha256, spans (base spans and added
    ones as kind:start:end by kind, then start; code points, end exclusive) and n_added. A null or empty text has
    no spans. Repeated rows each give a row; other columns are not carried; an empty table gives an empty one.
    The model is trained on ``docs`` unless given. Two passes; only the counts of shapes are shuffled.
    """
    model = train(docs) if model is None else model

    def per_batch(_: pa.RecordBatch, texts: list[str]) -> dict:
        base = [base_spans(t) for t in texts]
        added = [infer(t, b, model) for t, b in zip(texts, base, strict=True)]
        return {f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in KINDS} | {
            "base_sha256": [hashlib.sha256(spans_digest(b).encode()).hexdigest() for b in base],
            "spans": [spans_digest(sorted({*b, *a}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))) for b, a in zip(base, added, strict=True)],
            "n_added": [len(a) for a in added],
        }

    return map_texts(docs, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", per_batch)
