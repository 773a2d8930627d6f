"""Phrase collocations from an FM-index per shard over word ids.

Texts are cut into pieces and words; `shards` gathers the words of a language into slices of about SHARD_WORDS, and `build`
keeps for each the Burrows-Wheeler transforms of its word ids and of their reverse. `Shard` extends patterns in both
directions at once: an interval of either transform gives the pattern's count, the symbols inside it are the words
found beside the pattern, and both intervals follow each extension. `ngrams` enumerates the patterns of one length in all
shards and sums them: how often they occur, and how often with a word before and after them in their piece.

Lengths are counted one after the other, because a phrase is as frequent as its parts at most: before a length is
enumerated, the frequent phrases that are one shorter become a filter of FILTER_BITS bits, whatever their number. A false
hit costs a row that the exact count drops again, so the filter decides nothing. Rows of a shard are added up before
they are shuffled.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows and rows with null ids count
each; phrases of equal score and count are ranked by their bytes; an empty table gives no rows; extra columns are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import keep, register, table
from leadloom.session import lookup, work_path

SHARD_WORDS, FILTER_BITS, CHUNK_BITS, FILE_SHARDS = 1 << 17, 1 << 23, 1 << 17, 64
#: Symbols 0 and 1 of every shard: the end of a piece, and words too rare for any candidate.
END, RARE = 0, 1
ROWS_OUT = 1 << 16
_MIX = 1_000_003

_kind = np.zeros(256, np.uint8)
_kind[[9, 32]] = 1
_kind[[*b".,;:!?", 10, 11, 12, 13]] = 2
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, lower-cased, and the number of the piece that each stands in."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    first = np.unique(ends[:-1] - ends[0])
    first = first[first < len(data)]
    kind = _kind[data]
    inside = kind == 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[first] = inside[first]
    cut = kind == 2
    cut[first] = True  # a text's first character may be a word's, which then starts behind the cut
    at = np.flatnonzero(start)
    piece = np.cumsum(cut, dtype=np.int64)[at]
    offsets = np.append(np.cumsum(inside, dtype=np.int64)[at] - 1, np.count_nonzero(inside)).astype(np.int64)
    flat = np.ascontiguousarray(_lower[data[inside]])
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(flat)), piece


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """Language, words and piece numbers of slices of about `size` words; a slice ends with a text."""
    held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
    count: dict[str, int] = {}

    def flush(lang: str):
        parts, total = held.pop(lang), 0
        del count[lang]
        pieces = []
        for _, piece in parts:
            pieces.append(piece + total)
            total += int(piece[-1]) + 1
        return lang, pa.concat_arrays([w for w, _ in parts]), np.concatenate(pieces)

    for batch in batches:
        langs = pc.fill_null(batch.column("lang"), "und")
        for lang in pc.unique(langs).to_pylist():
            own = batch.column("text").filter(pc.equal(langs, lang))
            sizes = np.cumsum(pc.fill_null(pc.binary_length(own), 0).to_numpy(zero_copy_only=False))
            step = 0
            while step < len(own):  # as many texts as hold 8 bytes a word
                stop = max(step + 1, int(np.searchsorted(sizes, (sizes[step - 1] if step else 0) + 8 * size, "right")))
                words, piece = words_of(own[step:stop])
                step = stop
                if len(words):
                    held.setdefault(lang, []).append((words, piece))
                    count[lang] = count.get(lang, 0) + len(words)
                    if count[lang] >= size:
                        yield flush(lang)
        while sum(count.values()) > 4 * size:  # many languages
            yield flush(max(count, key=count.get))
    for lang in list(held):
        yield flush(lang)


def _order(text: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """Positions sorted by the `depth` symbols that start there; the text is followed by ends."""
    key = text.astype(np.int64)
    padded = np.append(text, np.zeros(depth, text.dtype)).astype(np.int64)
    for k in range(1, depth):
        if int(key.max()) + 1 > (1 << 62) // symbols:
            key = np.unique(key, return_inverse=True)[1]
        key = key * symbols + padded[k:k + len(text)]
    return np.argsort(key, kind="stable")


def transforms(ids: np.ndarray, piece: np.ndarray, symbols: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol before each position in the order of the following `depth` symbols, and the same for the reversed text."""
    breaks = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    text = np.append(np.insert(ids, breaks, END), END).astype(np.int32)
    out = []
    for one in (text, np.append(text[-2::-1], np.int32(END))):
        order = _order(one, symbols, depth)
        out.append(one[order - 1])  # the symbol before the first one is the last, an end
    return out[0], out[1]


class Index:
    """One transform with its last-to-first mapping and the rank of the end symbol."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        order = np.argsort(bwt, kind="stable")
        self.last_to_first = np.empty(len(bwt), np.int64)
        self.last_to_first[order] = np.arange(len(bwt))
        self.ends = np.append(0, np.cumsum(bwt == END))

    def inner(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many symbols of each interval are words."""
        return size - (self.ends[start + size] - self.ends[start])


class Shard:
    """Patterns as rows: word ids, interval starts in the forward and the reversed transform, and the common size."""

    def __init__(self, forward: np.ndarray, reverse: np.ndarray):
        self.forward, self.reverse = Index(forward), Index(reverse)
        counts = np.bincount(forward)
        starts = np.cumsum(counts) - counts
        ids = np.flatnonzero(counts)
        ids = ids[ids > RARE]
        self.roots = ids[:, None], starts[ids], starts[ids], counts[ids]

    def extend(self, patterns, right: bool = True):
        """The patterns with each of the words found after (or before) them."""
        ids, forward, reverse, size = patterns
        index, near, far = (self.reverse, reverse, forward) if right else (self.forward, forward, reverse)
        owner = np.repeat(np.arange(len(size)), size)
        begin = np.cumsum(size) - size
        place = np.arange(len(owner)) - begin[owner] + near[owner]
        symbol = index.bwt[place].astype(np.int64)
        order = np.argsort(owner * (int(index.bwt.max()) + 1) + symbol, kind="stable")
        owner, symbol, place = owner[order], symbol[order], place[order]
        head = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]))) if len(owner) else order
        number = np.diff(np.append(head, len(owner)))
        smaller = head - begin[owner[head]]  # symbols of the interval that sort before this one
        word = symbol[head] > RARE
        head, number, smaller = head[word], number[word], smaller[word]
        moved, kept = index.last_to_first[place[head]], far[owner[head]] + smaller
        parts = (ids[owner[head]], symbol[head][:, None])
        new = np.hstack(parts if right else parts[::-1])
        return (new, kept, moved, number) if right else (new, moved, kept, number)

    def beside(self, patterns) -> tuple[np.ndarray, np.ndarray]:
        """How many occurrences have a word of their piece before and after them."""
        _, forward, reverse, size = patterns
        return self.forward.inner(forward, size), self.reverse.inner(reverse, size)


def _crc(lang: str, words: list[str]) -> np.ndarray:
    salt = zlib.crc32(lang.encode())
    return np.array([(zlib.crc32(w.encode()) + salt) & 0xFFFFFFFF for w in words], np.int64)


def _passes(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether the filter has the bit of each row of word codes."""
    total = codes[:, 0]
    for k in range(1, codes.shape[1]):
        total = (total * _MIX + codes[:, k]) % (8 * len(bits))
    at = total % (8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def frequent_filter(counted: DataFrame) -> np.ndarray:
    """FILTER_BITS bits as bytes, set for the phrases of `counted` (key: words joined by spaces, a tab, the language)."""
    salt = F.crc32(F.element_at(F.split("key", "\t", 2), 2).cast("binary"))
    codes = F.transform(F.split(F.substring_index("key", "\t", 1), " "), lambda w: F.pmod(F.crc32(w.cast("binary")) + salt, F.lit(1 << 32)))
    mixed = F.aggregate(F.slice(codes, 2, 1 << 20), F.element_at(codes, 1), lambda t, c: F.pmod(t * _MIX + c, F.lit(FILTER_BITS)))
    chunk = min(CHUNK_BITS, FILTER_BITS)
    bit = counted.select(F.pmod(mixed, F.lit(FILTER_BITS)).alias("bit")).distinct()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(chunk, bool)
        flags[rows["at"]] = True
        return pd.DataFrame({"chunk": rows["chunk"][:1], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    parts = bit.select(F.expr(f"bit div {chunk}").alias("chunk"), (F.col("bit") % chunk).alias("at")).groupBy("chunk").applyInPandas(pack, "chunk long, bits binary")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.collect():  # FILTER_BITS bits at most
        out[r.chunk * chunk // 8:(r.chunk + 1) * chunk // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _passes(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether the filter has the bit of each row of word codes."""
    total = codes[:, 0]
    for k in range(1, codes.shape[1]):
        total = (total * _MIX + codes[:, k]) % (8 * len(bits))
    at = total % (8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def frequent_filter(counted: DataFrame) -> np.ndarray:
    """FILTER_BITS bits as bytes, set for the phrases of `counted` (key: words joined by spaces, a tab, the language)."""
    salt = F.crc32(F.element_at(F.split("key", "\t", 2), 2).cast("binary"))
    codes = F.transform(F.split(F.substring_index("key", "\t", 1), " "), lambda w: F.pmod(F.crc32(w.cast("binary")) + salt, F.lit(1 << 32)))
    mixed = F.aggregate(F.slice(codes, 2, 1 << 20), F.element_at(codes, 1), lambda t, c: F.pmod(t * _MIX + c, F.lit(FILTER_BITS)))
    bit = counted.select(F.pmod(mixed, F.lit(FILTER_BITS)).alias("bit"))
    found = bit.groupBy(F.expr("bit div 32").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 32))")).alias("word")).toPandas()  # 2M rows at most
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def _rows(lang: str, phrases: pa.Array, *numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = pc.binary_join_element_wise(phrases.cast(pa.string()), pa.scalar(lang), "\t")
    for at in range(0, len(keys), ROWS_OUT):
        part = slice(at, at + ROWS_OUT)
        yield pa.RecordBatch.from_arrays([keys[part], *[pa.array(n[part].astype(np.int64)) for n in numbers]],
                                         ["key", "n", "before", "after"][:1 + len(numbers)])


def _summed(rows: DataFrame, *numbers: str) -> DataFrame:
    """Sums by key. Each shard has a key once, so rows are not worth a table of them before the shuffle; no key is hot."""
    return rows.repartition("key").groupBy("key").agg(*[F.sum(n).alias(n) for n in numbers])


def word_counts(docs: DataFrame) -> DataFrame:
    """key (word, tab, language) and n of every word; the key without a word holds the language's number of words."""
    size = SHARD_WORDS

    def count(batches):
        for lang, words, _ in shards(batches, size):
            found = words.value_counts()
            yield from _rows(lang, found.field(0), found.field(1).to_numpy())
            yield from _rows(lang, pa.array([""]), np.array([len(words)]))

    return _summed(docs.select("lang", "text").mapInArrow(count, "key string, n long"), "n")


def build(docs: DataFrame, words: DataFrame, depth: int) -> DataFrame:
    """The written index: per shard its language, words (sorted, joined by spaces) and both transforms."""
    spark = docs.sparkSession
    known, size = spark.sparkContext.broadcast(frequent_filter(words)), SHARD_WORDS

    def index(batches):
        for lang, words, piece in shards(batches, size):
            coded = words.dictionary_encode()
            names = coded.dictionary.to_pylist()
            frequent = _passes(known.value, _crc(lang, names)[:, None])
            kept = sorted(n for n, f in zip(names, frequent) if f)
            number = {n: i + RARE + 1 for i, n in enumerate(kept)}
            ids = np.array([number.get(n, RARE) for n in names], np.int32)[coded.indices.to_numpy()]
            forward, reverse = transforms(ids, piece, len(kept) + RARE + 1, depth)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([" ".join(kept)]), pa.array([forward.tobytes()]), pa.array([reverse.tobytes()])],
                                             ["lang", "words", "forward", "reverse"])

    schema, path = "lang string, words string, forward binary, reverse binary", work_path(spark, "fm-index")
    # Few shards in a file, because a reader holds many rows at a time.
    docs.select("lang", "text").mapInArrow(index, schema).write.option("maxRecordsPerFile", FILE_SHARDS).parquet(path)
    return spark.read.schema(schema).parquet(path)


def ngrams(index: DataFrame, length: int, shorter: dict[int, np.ndarray]) -> DataFrame:
    """key, n, before and after of the phrases of `length` words, as enumerated in every shard and summed.

    `shorter` holds the filters of the frequent phrases of each length from 2 to length - 1.
    """
    filters = {k: index.sparkSession.sparkContext.broadcast(v) for k, v in shorter.items()}

    def count(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lang, names = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().split(" ")
                shard = Shard(*(np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in (2, 3)))
                codes = np.append(np.zeros(RARE + 1, np.int64), _crc(lang, names))
                patterns = shard.roots
                for k in range(2, length + 1):
                    patterns = shard.extend(patterns)
                    if k - 1 in filters or k in filters:
                        # both parts that are one word shorter must be frequent, and so must the phrase if it is extended
                        held = np.ones(len(patterns[3]), bool)
                        if k - 1 in filters:
                            held &= _passes(filters[k - 1].value, codes[patterns[0][:, 1:]])
                        if k in filters:
                            held &= _passes(filters[k].value, codes[patterns[0]])
                        patterns = tuple(p[held] for p in patterns)
                if len(patterns[3]):
                    strings = pa.array(["", "", *names])
                    phrase = pc.binary_join_element_wise(*[strings.take(pa.array(patterns[0][:, c])) for c in range(length)], " ")
                    yield from _rows(lang, phrase, patterns[3], *shard.beside(patterns))

    return _summed(index.mapInArrow(count, "key string, n long, before long, after long"), "n", "before", "after")


def count_phrases(docs: DataFrame, depth: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """The written counts of all phrases of up to `depth` words that occur `least` times, and of all words by language.

    First: key, length, n, before, after. Second: lang, n.
    """
    words = keep(word_counts(docs).where(F.expr(f"n >= {least} OR key LIKE '\t%'")), "words")
    totals = words.where(F.expr("key LIKE '\t%'")).select(F.substring("key", 2, 1 << 30).alias("lang"), "n")
    words = words.where(F.expr(f"key NOT LIKE '\t%' AND n >= {least}"))
    out = words.select("key", F.lit(1).alias("length"), "n", F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("after"))
    index, filters = build(docs, words, depth), {}
    for length in range(2, depth + 1):
        found = keep(ngrams(index, length, filters).where(F.col("n") >= least), "ngrams")
        out = out.unionByName(found.withColumn("length", F.lit(length)))
        if length < depth:
            filters[length] = frequent_filter(found)
    return out, totals


def collocations(docs: DataFrame, depth: int = 3, least: int = 10, share: int = 50, first: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, before and after of the phrases of 2 to `depth` words, best first.

    A phrase's score is that of its weakest cut: a million times a * a / (l * r). Phrases are left out if a longer one that
    contains them has at least `share` percent of their occurrences.
    """
    counts, totals = count_phrases(docs, depth, least)
    candidates = counts.where("length >= 2").select("key", "length", "before", "after", F.col("n").alias("a"))
    lang, words = F.element_at(F.split("key", "\t", 2), 2), F.split(F.substring_index("key", "\t", 1), " ")
    split = candidates.withColumns({"lang": lang, "words": words})
    part = lambda start, size: F.concat_ws("\t", F.array_join(F.slice("words", start, size), " "), "lang")
    cuts = split.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "before", "after", "k", part(F.lit(1), F.col("k")).alias("left_key"), part(F.col("k") + 1, F.col("length") - F.col("k")).alias("right_key"))
    sizes = counts.select("key", "n")
    met = lookup(keep(cuts, "cuts"), sizes.select(F.col("key").alias("left_key"), F.col("n").alias("l")), "left_key")
    met = lookup(met, sizes.select(F.col("key").alias("right_key"), F.col("n").alias("r")), "right_key")
    big = lambda c: F.col(c).cast("decimal(14,0)")
    met = met.withColumns({"top": F.lit(1_000_000).cast("decimal(7,0)") * big("a") * big("a"), "low": big("l") * big("r")})
    met = met.select("key", "a", "before", "after", F.struct(F.expr("top div low").alias("score"), "k", "l", "r").alias("cut"), F.lit(None).cast("long").alias("longer"))
    inner = split.where("length > 2").select("a", "lang", "words", "length", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("size"))
    inner = inner.select("a", "lang", "words", "size", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)).alias("start"))
    inner = inner.select(part(F.col("start"), F.col("size")).alias("key"), F.col("a").alias("longer"))
    every = met.unionByName(inner, allowMissingColumns=True).groupBy("key").agg(
        F.max("a").alias("a"), F.max("before").alias("before"), F.max("after").alias("after"), F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    every = every.where(F.expr(f"longer IS NULL OR 100 * longer < {share} * a"))
    every = every.select(lang.alias("lang"), F.substring_index("key", "\t", 1).alias("phrase"), "a", "cut.l", "cut.r", "cut.score", "before", "after")
    if first is not None:
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        every = every.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return every.join(totals, "lang")


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), g AS (
  SELECT lang, m, list_slice(w, i, i + m - 1) AS p, count(*) AS f, count(*) FILTER (WHERE i > 1) AS before, count(*) FILTER (WHERE i + m - 1 < len(w)) AS after
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(m)) GROUP BY ALL
), n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang
), c AS (SELECT * FROM g WHERE m >= 2 AND f >= 10
), cut AS (
  SELECT c.lang, c.p, c.f AS a, c.before, c.after, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM c, (VALUES (1), (2)) AS s(k)
  JOIN g x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, k) JOIN g y ON y.lang = c.lang AND y.p = list_slice(c.p, k + 1, c.m)
  WHERE k < c.m
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM c t WHERE t.m = 3 AND len(b.p) = 2 AND t.lang = b.lang AND (list_slice(t.p, 1, 2) = b.p OR list_slice(t.p, 2, 3) = b.p) AND 100 * t.f >= 50 * b.a)
), phrases AS (SELECT *, array_to_string(p, ' ') AS phrase FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score, before, after
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM phrases) JOIN n USING (lang) WHERE rank <= 2000
"""


def op11_collocations(spark, folder):
    found = collocations(table(spark, folder, "documents").select("lang", "text"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "before", "after")


register("op11_collocations", ORACLE)(op11_collocations)
