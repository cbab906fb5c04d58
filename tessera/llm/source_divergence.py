"""How the sources of a language differ in their words: triangular discrimination, exactly, from count-level bitmaps.

1. Tasks count terms by (lang, source) before anything is shuffled; one shuffle by (lang, term) adds them up, gives each
   term its documents and drops the rare ones.
2. A language's terms are dealt into blocks of a bounded number of counts, terms of like frequency together, and numbered
   in each. For each (source, count) of a block the bitset of its terms' numbers is stored, as those of its 64-bit words
   that are not empty.
3. For two sources AND and popcount of their bitsets give the joint cells: how many terms have count c here and d there.
   A cell is multiplied by the f of its two counts. Cells with a zero on a side are never stored: they are a level's size
   less its joint cells, so each joint cell is weighed by f(c, d) - f(c, 0) - f(0, d) + f(0, 0), and levels and the whole
   block by what is left. Blocks give sums for pairs of sources only, and these are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Cutter, materialise, shared_dir, slices_of

#: A kept term stands in so many documents of its language.
LEAST_DOCS = 10
#: Shares are counted in parts of this.
UNIT = 1_000_000_000
#: Terms listed of a source.
TOP = 10
#: Counts (of a term in a source) of a block, about; rows that a task adds up before it passes them on; pairs of bitset
#: words that are met at a time.
BLOCK, HELD, MET = 1 << 15, 600_000, 1 << 21
#: Texts that are cut at a time, and about how many bytes of them.
SLICE, SLICE_BYTES = 20_000, 8 << 20

_LETTERS = np.array([c >= 0x80 or chr(c).isalpha() for c in range(256)])


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, df: added up within each task as far as HELD rows go."""
    cutter = Cutter(_LETTERS)
    names = ["lang", "source", "term"]

    def sliced(part: pa.RecordBatch, texts: pa.Array) -> pa.Table:
        words, doc = cutter.words(texts)
        coded = words.dictionary_encode()
        width = max(1, len(coded.dictionary))
        group = pa.table([part.column("lang"), part.column("source"), pa.array(np.arange(part.num_rows))], names=["lang", "source", "doc"])
        once, n = np.unique(doc * width + coded.indices.to_numpy(), return_counts=True)
        found = group.take(pa.array(once // width)).drop_columns("doc")
        return found.append_column("term", coded.dictionary.take(pa.array(once % width))).append_column("n", pa.array(n)).append_column("df", pa.array(np.ones(len(n), np.int64)))

    def summed(tables: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(tables).group_by(names, use_threads=False).aggregate([("n", "sum"), ("df", "sum")])
        return whole.select([*names, "n_sum", "df_sum"]).rename_columns([*names, "n", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part, texts in slices_of(batch, SLICE, SLICE_BYTES):
                held.append(sliced(part, texts))
                if sum(t.num_rows for t in held) > 2 * HELD:
                    held = [summed(held)]
                    if held[0].num_rows > HELD:
                        yield from held[0].combine_chunks().to_batches(max_chunksize=10_000)
                        held = []
        if held:
            yield from summed(held).combine_chunks().to_batches(max_chunksize=10_000)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, df long")


def discrimination(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of whole numbers up to UNIT + 1."""
    return (p - q) ** 2 // (p + q)


def block_sums(rows: pa.Table, sources: pa.Table) -> dict[tuple[str, str], int]:
    """For each two sources the sum of f over the block's terms.

    ``rows``: source, n, word, bits of the block's bitsets; ``sources``: source, total, kinds of all sources of the language.
    """
    names = sorted(sources.column("source").to_pylist())
    at = {s: k for k, s in enumerate(names)}
    size = len(names)
    total = dict(zip(sources.column("source").to_pylist(), zip(sources.column("total").to_pylist(), sources.column("kinds").to_pylist(), strict=True), strict=True))
    share = lambda s, n: 1 + UNIT * (n + 2) // (total[s][0] + 2 * total[s][1])
    zero = np.array([share(s, 0) for s in names], np.int64)
    coded = pc.unique(rows.column("source")).to_pylist()
    source = np.array([at[s] for s in coded], np.int64)[pc.index_in(rows.column("source"), pa.array(coded)).to_numpy()]
    word, n = rows.column("word").to_numpy(), rows.column("n").to_numpy()
    bits = rows.column("bits").to_numpy().view(np.uint64)
    order = np.lexsort((n, source, word))
    source, word, n, bits = source[order], word[order], n[order], bits[order]
    level, place = np.unique(np.stack([source, n]), axis=1, return_inverse=True)
    shares = np.array([share(names[s], c) for s, c in level.T.tolist()], np.int64)
    of_level = np.zeros(len(shares), np.int64)
    np.add.at(of_level, place, np.bitwise_count(bits).astype(np.int64))
    p = shares[place]
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    terms = int(np.bitwise_count(np.bitwise_or.reduceat(bits, starts)).sum())

    nothing = discrimination(zero[:, None], zero[None, :])
    sums = terms * nothing
    for k in range(size):  # what a level of one source adds beside a zero of each other
        own = level[0] == k
        added = (of_level[own][:, None] * (discrimination(shares[own][:, None], zero[None, :]) - nothing[k])).sum(axis=0)
        sums[k, :] += added
        sums[:, k] += added

    run_start = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(source, prepend=-1) != 0))
    run_end = np.repeat(np.append(run_start[1:], len(word)), np.diff(np.append(run_start, len(word))))
    word_end = np.repeat(np.append(starts[1:], len(word)), np.diff(np.append(starts, len(word))))
    others = word_end - run_end  # entries of later sources in the same word
    upto = np.cumsum(others)
    first = 0
    while first < len(word):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + MET, "right")))
        a = np.repeat(np.arange(first, last), others[first:last])
        b = np.arange(len(a)) - np.repeat(np.cumsum(others[first:last]) - others[first:last], others[first:last]) + run_end[a]
        both = bits[a] & bits[b]
        hit = np.flatnonzero(both)
        a, b, cells = a[hit], b[hit], np.bitwise_count(both[hit]).astype(np.int64)
        i, j = source[a], source[b]
        weight = discrimination(p[a], p[b]) - discrimination(p[a], zero[j]) - discrimination(zero[i], p[b]) + nothing[i, j]
        np.add.at(sums, (i, j), cells * weight)
        first = last
    return {(names[i], names[j]): int(sums[i, j]) for i in range(size) for j in range(i + 1, size)}


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, folder: str | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms.

    Terms are runs of letters and of characters beyond ASCII, with A-Z lowered; a language keeps those in at least
    ``least_docs`` of its rows. A source gives each kept term p = 1 + floor(UNIT * (count + 2) / (N + 2 V)), and so does the
    language as a whole, q. Part ``pair`` has each other source of the language with the sum over kept terms of
    floor((p - p')^2 / (p + p')); part ``term`` the ``top`` terms that the source has and that have p > q, by the same of
    p and q. Ranks are by value descending, then item ascending (by bytes).

    Null text, lang and source count as empty strings. Each row is a document, repeated ones too. A source without terms
    has its pairs; a language with one source has none; an empty table gives no rows. Other columns are not carried.
    """
    folder = folder or shared_dir(docs.sparkSession)
    docs = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    by_term = Window.partitionBy("lang", "term")
    counts = _counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    kept = counts.withColumns({"all_n": F.sum("n").over(by_term), "all_df": F.sum("df").over(by_term), "one": F.row_number().over(by_term.orderBy("source")) == 1})
    kept = materialise(kept.filter(F.col("all_df") >= least_docs).select("lang", "term", "source", "n", "all_n", "one"), folder, "kept")

    languages = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("one").cast("long")).alias("kinds"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = materialise(groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "kinds"))), folder, "groups")

    pairs = _pairs(kept, groups, folder)
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = others.join(pairs, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", zero))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    share = lambda n, total: F.expr(f"1 + cast({n} + 2 as decimal(20,0)) * {UNIT} div cast({total} + 2 * kinds as decimal(20,0))")
    term = kept.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total"), "q": share("all_n", "lang_total")}).filter("p > q")
    term = term.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    return pair.unionByName(term.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top))


def _pairs(kept: DataFrame, groups: DataFrame, folder: str) -> DataFrame:
    """lang, source, item, value for both orders of each two sources of a language with kept terms."""
    rows = kept.withColumn("class", F.floor(F.log2("all_n")).cast("int"))
    classes = materialise(rows.groupBy("lang", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), folder, "classes")
    rows = rows.join(classes, ["lang", "class"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    key = ["lang", "class", "block"]
    rows = rows.select(*key, "term", "all_n", "source", "n").repartition(*key)
    rows = rows.withColumn("number", F.dense_rank().over(Window.partitionBy(*key).orderBy("all_n", "term")) - 1)
    word, bit = F.shiftright("number", 6).alias("word"), F.expr("shiftleft(1L, number & 63)")
    bitsets = rows.groupBy(*key, "source", "n", word).agg(F.bit_or(bit).alias("bits"))
    there = kept.sparkSession.read.schema(classes.schema).parquet(f"{folder}/classes").select("lang", "class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(groups.select("lang", "source", "total", "kinds"), "lang")

    def run(held: pa.Table, sources: pa.Table) -> pa.Table:
        sums = block_sums(held, sources) if held.num_rows else {}
        lang = sources.column("lang")[0].as_py()
        columns = [pa.array([lang] * len(sums), pa.string()), *(pa.array([k[side] for k in sums], pa.string()) for side in (0, 1)), pa.array(list(sums.values()), pa.int64())]
        return pa.table(columns, names=["lang", "source", "item", "value"])

    sums = bitsets.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(run, "lang string, source string, item string, value long")
    sums = materialise(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), folder, "sums")
    return sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


#: The same for DuckDB.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
a AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM a GROUP BY ALL),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN a ON w.lang = a.lang AND w.term = a.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
s AS (SELECT g.lang, g.source, a.term, coalesce(c.n, 0) AS n, a.n AS an,
  1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.n, 0) + 2 * l.v)::HUGEINT AS p, 1 + {UNIT}::HUGEINT * (a.n + 2) // (l.n + 2 * l.v)::HUGEINT AS q
  FROM g JOIN a ON g.lang = a.lang JOIN l ON g.lang = l.lang LEFT JOIN t ON g.lang = t.lang AND g.source = t.source
  LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND a.term = c.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
u AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
