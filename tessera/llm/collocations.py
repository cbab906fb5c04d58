"""Phrases of two and three words that stand together more often than their parts alone would, by Rabin-Karp fingerprints.

1. Texts are cut into words and pieces. A word's code is a polynomial of its bytes, a phrase's fingerprint one of its words'
   codes, both differences of prefix sums modulo 2^64, mixed with the language. A second pair of polynomials gives each
   phrase a check number.
2. Tasks count the fingerprints of their texts; a shuffle by fingerprint adds up the counts and keeps the least and the
   largest check number and a pointer to a document that holds an occurrence. One pass counts words, the next pairs of
   frequent words, the last triples of frequent pairs: a phrase is never more frequent than its parts. What a pass hands to
   the next is a bitmap of fixed size, which lets no frequent phrase out and some others in.
3. Only frequent phrases become text: their documents are fetched by the pointers, and an occurrence with the fingerprint
   and the check number is read from the text. A fingerprint with two check numbers, or two texts, belongs to several
   phrases: those are counted once more by their text.
4. Scores, parts and longer phrases are joins of the small table of frequent phrases.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Cutter, materialise, shared_dir, slices_of

#: Candidates occur so often; phrases listed of a language; a phrase is dropped if a longer one has this percentage of it.
LEAST, TOP, COVERED = 10, 2000, 50
#: Bits of the bitmaps that say which phrases may be frequent (8 MB each, whatever the size of the input).
BITMAP_BITS = 26
#: Bits of a fingerprint; fewer only make more collisions to resolve.
BITS = 64
#: Fingerprints that a task adds up before it passes them on.
HELD = 1_500_000
#: Texts that are cut at a time, and about how many bytes of them.
SLICE, SLICE_BYTES = 20_000, 4 << 20
#: Parts in which a language's phrases are ranked first.
SALTS = 256

_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
#: For each of the two fingerprints the bases of the byte and the word polynomials (odd, so that they have inverses).
BASES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[_U(1)], np.cumprod(np.full(n, base, np.uint64))])


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n modulo 2^64 (at least); kept for the next power of two."""
    return _powers(base, 1 << max(10, n.bit_length()))


def stretches(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomials of the stretches of ``values`` from ``starts`` to ``ends``, each as if it began at 0."""
    inverse = pow(base, -1, 1 << 64)
    prefix = np.concatenate([[_U(0)], np.cumsum(values * powers(base, len(values))[: len(values)])])
    return (prefix[ends] - prefix[starts]) * powers(inverse, len(values))[starts]


@functools.lru_cache(maxsize=4096)
def _language_seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of a slice of texts with their codes; phrases are numbered by their first word."""

    def __init__(self, part: pa.RecordBatch, texts: pa.Array, bits: int):
        data, at, inside, starts = _CUTTER.spans(texts)
        coded = _CUTTER.strings(data, inside, starts).dictionary_encode()
        self.dictionary, self.code, self.n, self.bits = coded.dictionary, coded.indices.to_numpy(), len(starts), bits
        self.doc = np.searchsorted(at, starts, "right") - 1
        piece = np.cumsum(_BREAK[data])[starts] if self.n else starts
        self.joined = np.concatenate([(piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1]), [False]]) if self.n else np.zeros(0, bool)
        languages = part.column(part.schema.get_field_index("lang")).dictionary_encode()
        self.languages, self.of_doc = languages.dictionary.to_pylist(), languages.indices.to_numpy()
        self.seed = np.array([_language_seed(x) for x in self.languages] or [0], np.uint64)
        self.ref = part.column(part.schema.get_field_index("ref")).to_numpy()
        flat = self.dictionary.cast(pa.large_binary())
        ends = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1]
        raw = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[: ends[-1] if len(flat) else 0].astype(np.uint64) + _U(1)
        self.codes = [_mix(stretches(raw, byte, ends[:-1], ends[1:]) + np.diff(ends).astype(np.uint64)) if len(flat) else np.zeros(0, np.uint64) for byte, _ in BASES]
        self.sides: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def starts(self, k: int) -> np.ndarray:
        """Where phrases of k words begin: no two of their words are parted by a text or piece."""
        good = np.ones(self.n, bool)
        for step in range(k - 1):
            good[: self.n - step] &= self.joined[step:]
            good[self.n - step :] = False
        return np.flatnonzero(good)

    def prints(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints and check numbers of the phrases of k words that begin at ``at``."""
        out = []
        seed = self.seed[self.of_doc[self.doc[at]]]
        for side, (_, base) in enumerate(BASES):
            if side not in self.sides:
                inverse = pow(base, -1, 1 << 64)
                self.sides[side] = np.concatenate([[_U(0)], np.cumsum(self.codes[side][self.code] * powers(base, self.n)[: self.n])]), powers(inverse, self.n)
            prefix, back = self.sides[side]
            out.append(_mix(((prefix[at + k] - prefix[at]) * back[at]) ^ _mix(seed + _U(k))))
        return (out[0] if self.bits == 64 else out[0] & _U((1 << self.bits) - 1)), out[1]

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each language's empty phrase, which stands for all words: fingerprint, check number, words, a document."""
        own = self.of_doc[self.doc]
        n = np.bincount(own, minlength=len(self.seed))
        there = np.flatnonzero(n)
        first = np.full(len(self.seed), np.iinfo(np.int64).max)
        np.minimum.at(first, own, self.ref[self.doc])
        seeds = _mix(self.seed[there])
        fp = _mix(seeds + _U(1)) if self.bits == 64 else _mix(seeds + _U(1)) & _U((1 << self.bits) - 1)
        return fp, _mix(seeds + _U(2)), n[there], first[there]

    def phrase(self, at: np.ndarray, k: int) -> list[str]:
        words = [self.dictionary.take(pa.array(self.code[at + step])).to_pylist() for step in range(k)]
        return list(map(" ".join, zip(*words, strict=True))) if k else [""] * len(at)


_CUTTER = Cutter(~(_BLANK | _BREAK))


def bit_places(fp: np.ndarray, width: int) -> np.ndarray:
    return _mix(fp ^ _U(0x5851F42D4C957F2D)) >> _U(64 - width)


def bitmap(table: DataFrame) -> np.ndarray:
    """2^BITMAP_BITS bits, those of all fingerprints of ``table`` set; put together by Spark word by word."""
    width = BITMAP_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(bit_places(batch.column(0).to_numpy().view(np.uint64), width))
            word, bit = (place >> _U(6)).astype(np.int64), (_U(1) << (place & _U(63)))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            yield pa.record_batch([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64) if len(first) else np.zeros(0, np.int64))], names=["word", "bits"])

    got = table.select("fp").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (width - 6), np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _set(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    place = bit_places(fp, 5 + len(bits).bit_length())
    return (bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1


def _added(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts of equal fingerprints and check numbers added up, with the least pointer."""
    fp, check, n, ref = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(fp, kind="stable")
    fp, check, n, ref = fp[order], check[order], n[order], ref[order]
    first = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])])) if len(fp) else np.zeros(0, np.int64)
    if not len(first):
        return fp, check, n, ref
    return fp[first], check[first], np.add.reduceat(n, first), np.minimum.reduceat(ref, first)


def _frequent(docs: DataFrame, k: int, known, least: int, bits: int) -> DataFrame:
    """fp, n, low, high (check numbers), ref: fingerprints of k words in at least ``least`` places; with k = 1 also totals.

    ``known`` is the broadcast bitmap of the frequent phrases of one word less.
    """

    def sliced(part: pa.RecordBatch, texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        w = Words(part, texts, bits)
        at = w.starts(k)
        if k > 1:
            good = np.zeros(w.n + 1, bool)
            parts = w.starts(k - 1)
            good[parts] = _set(known.value, w.prints(k - 1, parts)[0])
            at = at[good[at] & good[at + 1]]
        else:
            yield w.totals()
        fp, check = w.prints(k, at)
        yield _added([(fp, check, np.ones(len(at), np.int64), w.ref[w.doc[at]])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(x: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(x[0]), 20_000):
                yield pa.record_batch([pa.array(v[a : a + 20_000].view(np.int64)) for v in x], names=["fp", "check", "n", "ref"])

        for batch in batches:
            for part, texts in slices_of(batch, SLICE, SLICE_BYTES):
                held += sliced(part, texts)
                if sum(len(x[0]) for x in held) > HELD:
                    held = [_added(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield from out(held[0])
                        held = []
        if held:
            yield from out(_added(held))

    rows = docs.mapInArrow(run, "fp long, check long, n long, ref long").repartition("fp")
    return rows.groupBy("fp").agg(F.sum("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"), F.min("ref").alias("ref")).filter(F.col("n") >= least)


def _read(docs: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """fp, check, lang, phrase: occurrences of the wanted fingerprints in the documents that their pointers name."""
    asked = wanted.groupBy("ref").agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices_of(batch, SLICE, SLICE_BYTES):
                w = Words(part, texts, bits)
                fps = np.unique(part.column(part.schema.get_field_index("fps")).flatten().to_numpy()).view(np.uint64)
                found: list[tuple[np.ndarray, np.ndarray, list[str], list[str]]] = []
                fp, check, _, ref = w.totals()
                for k in range(4):
                    if k:
                        at = w.starts(k)
                        fp, check = w.prints(k, at)
                    hit = np.flatnonzero(np.isin(fp, fps))
                    pair, first = np.unique(np.stack([fp[hit], check[hit]]), axis=1, return_index=True)
                    hit = hit[first]
                    if k:
                        langs = [w.languages[i] for i in w.of_doc[w.doc[at[hit]]]]
                        found.append((pair[0], pair[1], langs, w.phrase(at[hit], k)))
                    else:
                        there = np.flatnonzero(np.bincount(w.of_doc[w.doc], minlength=len(w.seed)))
                        found.append((pair[0], pair[1], [w.languages[i] for i in there[hit]], [""] * len(hit)))
                columns = [np.concatenate([x[side] for x in found]).view(np.int64) for side in (0, 1)]
                yield pa.record_batch([*map(pa.array, columns), *(pa.array([v for x in found for v in x[side]], pa.string()) for side in (2, 3))], names=["fp", "check", "lang", "phrase"])

    return docs.join(asked, "ref").select("lang", "text", "ref", "fps").mapInArrow(run, "fp long, check long, lang string, phrase string")


def _recounted(docs: DataFrame, shared: DataFrame, least: int, bits: int) -> DataFrame:
    """lang, phrase, f of all phrases whose fingerprints are in ``shared``, counted by their text."""
    known = docs.sparkSession.sparkContext.broadcast(bitmap(shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices_of(batch, SLICE, SLICE_BYTES):
                w = Words(part, texts, bits)
                for k in range(4):
                    if k:
                        at = w.starts(k)
                        fp = w.prints(k, at)[0]
                        hit = _set(known.value, fp)
                        at, fp, n = at[hit], fp[hit], np.ones(int(hit.sum()), np.int64)
                        langs, phrases = [w.languages[i] for i in w.of_doc[w.doc[at]]], w.phrase(at, k)
                    else:
                        fp, _, n, _ = w.totals()
                        langs = [w.languages[i] for i in np.flatnonzero(np.bincount(w.of_doc[w.doc], minlength=len(w.seed)))]
                        phrases = [""] * len(langs)
                    yield pa.record_batch([pa.array(fp.view(np.int64)), pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(n)], names=["fp", "lang", "phrase", "n"])

    counts = docs.mapInArrow(run, "fp long, lang string, phrase string, n long").groupBy("fp", "lang", "phrase").agg(F.sum("n").alias("f"))
    return counts.filter(F.col("f") >= least).join(shared.select("fp").distinct(), "fp", "left_semi").select("lang", "phrase", "f")


def frequent_phrases(docs: DataFrame, least: int = LEAST, bits: int = BITS, folder: str | None = None) -> DataFrame:
    """lang, phrase, f: phrases of one to three words in at least ``least`` places, and the empty phrase for all words."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("ref"))
    tables, known = [], None
    for k in (1, 2, 3):
        tables.append(materialise(_frequent(docs, k, known, least, bits), folder, f"frequent{k}"))
        known = spark.sparkContext.broadcast(bitmap(tables[-1])) if k < 3 else None
    every = tables[0].unionByName(tables[1]).unionByName(tables[2])
    # a fingerprint that phrases of two lengths share has two check numbers as well
    every = every.groupBy("fp").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("ref").alias("ref"))
    single = every.filter("low = high")
    read = materialise(_read(docs, single, bits).distinct(), folder, "read")
    found = single.join(read.withColumnRenamed("check", "low"), ["fp", "low"])
    found = materialise(found.select("fp", "n", "lang", "phrase", F.count("*").over(Window.partitionBy("fp")).alias("texts")), folder, "found")
    sure = found.filter("texts = 1").select("lang", "phrase", F.col("n").alias("f"))
    shared = every.filter("low <> high").select("fp").unionByName(found.filter("texts > 1").select("fp"))
    if shared.isEmpty():
        return sure
    return sure.unionByName(materialise(_recounted(docs, materialise(shared, folder, "shared"), least, bits), folder, "recounted"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = BITS, folder: str | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two and three words.

    A-Z are lowered, texts fall into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs. n is the
    number of a language's words, a that of a phrase's places within pieces (at least ``least``). Cut after its first k
    words it has l = f(first part), r = f(rest) and floor(1000000 a a / (l r)); the lowest-scoring cut counts, of equal
    ones the first. A phrase is left out if a longer one that holds it occurs in COVERED percent of its places or more.
    Order: score, then a, both descending, then the phrase by its bytes.

    Null text counts as empty, null lang as ``und``; each row counts, repeated ones too; doc_id only serves as a pointer
    and may be null or stand for several rows. An empty table gives no rows; other columns are not carried.
    """
    folder = folder or shared_dir(docs.sparkSession)
    phrases = materialise(frequent_phrases(docs, least, bits, folder), folder, "phrases")
    words = F.split("phrase", " ")
    candidates = phrases.filter("phrase <> ''").select("lang", "phrase", F.col("f").alias("a"), words.alias("words")).filter(F.size("words") > 1)
    joined = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    exact = lambda c: f"cast({c} as decimal(19,0))"
    cuts = cuts.withColumn("score", F.expr(f"cast(1000000 as decimal(7,0)) * ({exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.filter(F.size("words") > 2).select("lang", "a", F.explode(F.array(joined(F.lit(1), F.lit(2)), joined(F.lit(2), F.lit(2)))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {COVERED} * a").select("lang", "phrase", "a", "cut.*").drop("k")
    n = phrases.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return _first(left, top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first(table: DataFrame, top: int) -> DataFrame:
    """Each language's first rows with their rank: the first of each of SALTS parts, then the first of those."""
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))

    def ranked(*keys: Column | str) -> Callable[[DataFrame], DataFrame]:
        return lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)

    salted = table.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    return salted.transform(ranked("lang", "salt")).drop("rank", "salt").transform(ranked("lang"))


#: The same for DuckDB.
SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
q AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, w, len(w) AS m, unnest(range(1, len(w) + 1)) AS i FROM q),
o AS (SELECT lang, '' AS phrase, 0 AS k FROM g
  UNION ALL SELECT lang, w[i], 1 FROM g
  UNION ALL SELECT lang, w[i] || ' ' || w[i + 1], 2 FROM g WHERE i < m
  UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 3 FROM g WHERE i + 1 < m),
f AS (SELECT lang, phrase, k, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE k > 1),
u AS (SELECT lang, phrase, f, 1 AS cut, s[1] AS a, array_to_string(s[2:], ' ') AS b, k FROM c
  UNION ALL SELECT lang, phrase, f, 2, s[1] || ' ' || s[2], s[3], k FROM c WHERE k = 3),
x AS (SELECT u.lang, u.phrase, u.f AS a, y.f AS l, z.f AS r, u.k, u.cut, ((1000000::HUGEINT * u.f * u.f) // (y.f::HUGEINT * z.f))::BIGINT AS score
  FROM u JOIN f y ON y.lang = u.lang AND y.phrase = u.a JOIN f z ON z.lang = u.lang AND z.phrase = u.b),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS j FROM x) WHERE j = 1),
h AS (SELECT lang, sub, max(f) AS f FROM (SELECT lang, f, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS sub FROM c WHERE k = 3) GROUP BY ALL),
v AS (SELECT e.*, row_number() OVER (PARTITION BY e.lang ORDER BY score DESC, a DESC, e.phrase) AS rank
  FROM e LEFT JOIN h ON h.lang = e.lang AND h.sub = e.phrase WHERE h.f IS NULL OR 100 * h.f < {COVERED} * a)
SELECT v.lang, v.rank, v.phrase, v.a, v.l, v.r, n.f AS n, v.score FROM v JOIN f n ON n.lang = v.lang AND n.k = 0 WHERE v.rank <= {TOP}
"""
