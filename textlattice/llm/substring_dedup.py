"""Repeated passages, found with a compressed FM-index per shard.

1. Every window of words has a minimizer: of its grams of GRAM words the one with the smallest hash. Equal windows have
   equal minimizers, so a window whose minimizer stands once in the corpus is unique. Counting minimizers, about one for
   every thirteen words, is the only step that all words take part in.
2. Runs of windows with one minimizer form a segment. Segments go to shards by minimizer, so that all copies of a window
   meet in one shard, each in exactly one segment; equal segments are one with a weight.
3. Each shard builds a compressed FM-index over its segments: the Burrows-Wheeler transform in a wavelet matrix of
   packed bits with block ranks. The segments are streamed against it from right to left. Backward search extends a match
   while the suffix range holds two or more (weighted) places; where it fails, the right end moves. Wherever a match
   covers a window, the interval is reported.
4. Intervals go back to the documents, whose words in them are removed.

Words are compared by 64-bit hashes, and a row is known by a 64-bit hash of its id and text: with n different ones the
chance of any two that are taken for each other is about n^2 / 2^65.

Minimizers of very many windows (a passage that a large part of all documents shares) are replaced by the smallest gram
of the window that isn't one of them, so that the windows at the passage's edges spread over the shards.

Defined results: a null or empty text, or one of fewer words than a window, keeps all its words; repeated rows are
places of their own, so that a text that stands twice is removed twice; of grams with equal hashes in a window the first
counts; a very long text is hashed in bounded chunks; a null id is an id like others; an empty table gives an empty
result; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlattice.llm.common import SPACE, drop_path, freed, materialise, text_or_empty

WINDOW, GRAM = 35, 10
#: Words of a shard's index; a shard ends with the minimizer at which it reaches this.
SHARD = 1_500_000
LANES = 20_000
#: A minimizer with more than 1/HEAVY of all minimizers, and at least FEW, is heavy: there are fewer than HEAVY.
HEAVY, FEW = 200_000, 1000
#: Contents whose words a task remembers to have given.
GIVEN = 500_000
_SPACE = re.compile(SPACE.encode())
_BASE = 0x9E3779B97F4A7C15 | 1


def _mixed_ints(n: int, seed: int) -> np.ndarray:
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(_BASE))


class WordHash:
    """64-bit hashes of words: two multilinear hashes of a word's bytes, of which the upper halves are kept.

    A text is hashed as arrays over its bytes, some CHUNK of them at a time, cut between words.
    """

    CHUNK = 1 << 20

    def __init__(self) -> None:
        self.value = np.arange(1, 257, dtype=np.uint64)
        self.value[[32, *range(9, 14)]] = 0
        self.factors = [_mixed_ints(64, seed) for seed in (1, 1 << 40)]

    def of(self, text: str) -> np.ndarray:
        data, parts, lo = text.encode(), [], 0
        while lo < len(data):
            hi = lo + self.CHUNK
            if hi < len(data):
                space = _SPACE.search(data, hi)
                hi = space.start() if space else len(data)
            parts.append(self._of(np.frombuffer(data, dtype=np.uint8, count=min(hi, len(data)) - lo, offset=lo)))
            lo = hi
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

    def _of(self, data: np.ndarray) -> np.ndarray:
        v = self.value[data]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], v > 0, [False]])))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        longest = int((ends - starts).max())
        if longest > len(self.factors[0]):
            self.factors = [_mixed_ints(2 * longest, seed) for seed in (1, 1 << 40)]
        v = v[starts[0] : ends[-1]]
        ends, starts = ends - starts[0], starts - starts[0]
        place = np.arange(len(v)) - np.repeat(starts, np.diff(starts, append=len(v)))
        np.minimum(place, longest - 1, out=place)  # spaces after a word count as nothing wherever they stand
        one, two = (np.add.reduceat(v * f[place], starts) >> np.uint64(32) for f in self.factors)
        return one << np.uint64(32) | two


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of `gram` words; equal words give equal hashes wherever they stand. Runs grow by doubling."""
    if len(h) < gram:
        return np.zeros(0, dtype=np.uint64)
    out, done, run, size, base = h[:0], 0, h, 1, _BASE
    while size <= gram:
        if gram & size:
            n = len(h) - done - size + 1
            out = out[:n] * np.uint64(base) + run[done : done + n] if done else run
            done += size
        run = run[:-size] * np.uint64(base) + run[size:]
        size, base = 2 * size, base * base & (1 << 64) - 1
    return mixed(out)


def among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def minimizers(grams: np.ndarray, window: int, gram: int, heavy: np.ndarray | None = None) -> np.ndarray:
    """For each window, the position of its smallest gram, the first of equal ones. Heavy grams come after all others."""
    per = window - gram + 1
    if len(grams) < per:
        return np.zeros(0, dtype=np.int64)
    best = grams >> np.uint64(1)
    if heavy is not None and len(heavy):
        best = best | (among(grams, heavy).astype(np.uint64) << np.uint64(63))
    at, size = np.arange(len(grams)), 1
    while size < per:  # the best of `size` grams from each on; the last step's halves overlap
        step = min(size, per - size)
        less = best[step:] < best[:-step]
        best = np.where(less, best[step:], best[:-step])
        at = np.where(less, at[step:], at[:-step])
        size += step
    return at


class WaveletMatrix:
    """Ranks of symbols in a sequence: a level of packed bits per bit of the symbols, with a count per 64 bits."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.n, self.levels = len(seq), max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
            self.words.append(packed)
            ones = np.bitwise_count(packed).astype(np.int32)
            self.counts.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32))
            self.zeros.append(int(len(seq) - ones.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.base = self._walk(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = i >> 6
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & below)
            i = np.where(symbol >> level & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        return self._walk(symbol, i) - self.base[symbol]


class FMIndex:
    """An FM-index of weighted segments of words. Words become symbols from 1 on; 0 ends a segment."""

    def __init__(self, segments: list[np.ndarray], weights: np.ndarray):
        sizes = np.array([len(s) for s in segments])
        self.words, codes = np.unique(np.concatenate(segments), return_inverse=True)
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[ends] = False
        text[inside] = codes + 1
        self.symbols = len(self.words) + 1
        order = self._sorted(text, ends)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])[:-1]
        self.bwt = WaveletMatrix(text[order - 1], self.symbols)
        self.weight = np.concatenate([[0], np.cumsum(np.repeat(weights, sizes + 1)[order])])
        self.n = len(text)
        self.starts, self.sizes, self.codes = ends - sizes, sizes, text

    @staticmethod
    def _sorted(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The suffix array by doubling. Ends of segments differ from one another, so that no comparison goes beyond one."""
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        step = 1
        while True:
            ahead = np.zeros_like(rank)
            ahead[:-step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + ahead
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank = np.empty_like(rank)
            rank[order] = new
            if new[-1] == len(text) - 1:
                return order
            step *= 2

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after one more symbol on the left."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.first[symbol] + both[: len(lo)], self.first[symbol] + both[len(lo) :]

    def repeated(self, which: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """For the segments `which`: (segment, start) of all windows that have two or more places in the index."""
        seg, end = which.copy(), self.sizes[which].copy()
        at, lo, hi = end.copy(), np.zeros(len(which), np.int64), np.full(len(which), self.n)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(seg):
            symbol = self.codes[self.starts[seg] + at - 1]
            new_lo, new_hi = self.extend(symbol, lo, hi)
            more = self.weight[new_hi] - self.weight[new_lo] >= 2
            lo, hi, at = np.where(more, new_lo, 0), np.where(more, new_hi, self.n), at - more
            whole = more & (end - at >= window)
            found.append((seg[whole], at[whole]))
            # What lies from at - 1 to end stands once: no window holds it. The next one ends before, or starts there.
            end = np.where(more, end, np.minimum(end - 1, at - 1 + window))
            at = np.where(more, at, end)
            go = np.where(more, at > 0, end >= window)
            seg, end, at, lo, hi = seg[go], end[go], at[go], lo[go], hi[go]
        return np.concatenate([s for s, _ in found]), np.concatenate([a for _, a in found])


def segments_of(h: np.ndarray, repeated: np.ndarray, heavy: np.ndarray, window: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(minimizer, start, end) of the runs of windows whose minimizers stand more than once."""
    grams = gram_hashes(h, gram)
    at = minimizers(grams, window, gram)
    keep = among(grams[at], repeated)
    if len(heavy) and keep.any():
        swap = keep & among(grams[at], heavy)
        if swap.any():
            at = np.where(swap, minimizers(grams, window, gram, heavy), at)
    starts = np.flatnonzero(keep)
    if not len(starts):
        return
    cut = np.flatnonzero((np.diff(starts) > 1) | (np.diff(at[starts]) != 0)) + 1
    for run in np.split(starts, cut):
        yield int(grams[at[run[0]]]), int(run[0]), int(run[-1]) + window


def _signed(x: np.ndarray | list[int]) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def minimizer_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """rows: key, text. Minimizers of each document: key, m, n (places in the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in batches:
            keys, found, counts = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                grams = gram_hashes(words.of(text.as_py()), gram)
                at = np.unique(minimizers(grams, window, gram))
                if len(at):
                    m, n = np.unique(grams[at], return_counts=True)
                    keys.append(np.full(len(m), key, dtype=np.int64))
                    found.append(m)
                    counts.append(n)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(_signed(np.concatenate(found))), pa.array(np.concatenate(counts).astype(np.int32))], names=["key", "m", "n"])

    return rows.mapInArrow(run, "key long, m long, n int")


def segment_rows(candidates: DataFrame, heavy: np.ndarray, window: int, gram: int) -> DataFrame:
    """candidates: key, doc_id, text, repeated. Their segments: m, content (a hash of its words), place and words.

    A task leaves out the words of a content that it has lately given.
    """
    kind = candidates.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, given = WordHash(), set()
        for b in batches:
            rows, m, content, starts, words = [], [], [], [], []
            for k, text in enumerate(b.column(2)):
                h = hashes.of(text.as_py())
                repeated = np.sort(b.column(3)[k].values.to_numpy().view(np.uint64))
                for minimizer, lo, hi in segments_of(h, repeated, heavy, window, gram):
                    part = h[lo:hi].tobytes()
                    name = (minimizer, xxhash.xxh64_intdigest(part))
                    rows.append(k)
                    m.append(minimizer)
                    content.append(name[1])
                    starts.append(lo)
                    words.append(None if name in given else part)
                    given.add(name)
            if len(given) > GIVEN:
                given.clear()
            take = pa.array(rows, pa.int64())
            columns = [pa.array(_signed(m)), pa.array(_signed(content)), b.column(0).take(take), b.column(1).take(take), pa.array(starts, pa.int32()), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["m", "content", "key", "doc_id", "start", "words"])

    return candidates.mapInArrow(run, f"m long, content long, key long, doc_id {kind}, start int, words binary")


def repeated_windows(contents: DataFrame, window: int, shard: int) -> DataFrame:
    """contents: m, content, words, n. The intervals of words, in each content, that repeated windows cover."""

    def index(held: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch | None:
        by_m = [list(g) for _, g in itertools.groupby(held, key=lambda r: r[0])]
        held = [r for g in by_m if len(g) > 1 or g[0][3] > 1 for r in g]  # one segment with one place has no repeat
        if not held:
            return None
        fm = FMIndex([np.frombuffer(r[2], dtype=np.uint64) for r in held], np.array([r[3] for r in held], dtype=np.int64))
        parts = [fm.repeated(np.arange(lo, min(lo + LANES, len(held))), window) for lo in range(0, len(held), LANES)]
        seg, at = np.concatenate([s for s, _ in parts]), np.concatenate([a for _, a in parts])
        order = np.lexsort((at, seg))
        seg, at = seg[order], at[order]
        apart = np.flatnonzero((np.diff(seg) != 0) | (np.diff(at) > window)) + 1
        first, last = np.concatenate([[0], apart]), np.concatenate([apart, [len(seg)]]) - 1
        if not len(seg):
            return None
        m, content = np.array([r[0] for r in held]), np.array([r[1] for r in held])
        return pa.RecordBatch.from_arrays([pa.array(m[seg[first]]), pa.array(content[seg[first]]), pa.array(at[first].astype(np.int32)), pa.array((at[last] + window).astype(np.int32))], names=["m", "content", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for m, content, words, n in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if size >= shard and m != held[-1][0]:
                    if (out := index(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append((m, content, words, n))
                size += len(words) // 8
        if held and (out := index(held)) is not None:
            yield out

    dealt = contents.repartition("m").sortWithinPartitions("m")
    return dealt.select("m", "content", "words", "n").mapInArrow(run, "m long, content long, lo int, hi int")


def removed(rows: DataFrame) -> DataFrame:
    """rows: key, text, spans. n_words, n_removed and the hash of the words that stay, per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                words = text.as_py().encode().split()  # bytes are split at the same six characters
                drop = np.zeros(len(words) + 1, dtype=np.int64)
                for s in spans.as_py():
                    drop[s["lo"]] += 1
                    drop[s["hi"]] -= 1
                gone = np.cumsum(drop)[:-1] > 0
                kept = b" ".join(itertools.compress(words, (~gone).tolist()))
                for column, v in zip(out, (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names=["key", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "key long, n_words long, n_removed long, kept_sha256 string")


def unchanged(rows: DataFrame) -> DataFrame:
    """rows: key, doc_id, text. doc_id, key, n_words and the hash of all words, as `whole`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, whole = [], []
            for text in b.column(2):
                words = text.as_py().encode().split()
                n.append(len(words))
                whole.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(n, pa.int64()), pa.array(whole, pa.string())], names=["doc_id", "key", "n_words", "whole"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key long, n_words long, whole string")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key (of id and text), doc_id, text."""
    text = text_or_empty(text_col)
    return docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).alias("doc_id"), text.alias("text"))


def intervals(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, heavy: int = HEAVY) -> DataFrame:
    """rows: key, doc_id, text. Intervals of words to remove: key, doc_id, lo, hi."""
    spark = rows.sparkSession
    found = materialise(minimizer_rows(rows.select("key", "text"), window, gram), "minimizers")
    counted = materialise(found.groupBy("m").agg(F.sum("n").alias("n")).filter("n > 1"), "repeated")
    total = counted.agg(F.sum("n")).first()[0] or 0
    limit = max(total // heavy, FEW)
    freed(spark)
    hot = np.array([r["m"] for r in counted.filter(F.col("n") > limit).select("m").collect()], dtype=np.int64).view(np.uint64)
    hot.sort()  # fewer than `heavy`
    by_doc = found.join(counted.select("m"), "m").groupBy("key").agg(F.collect_set("m").alias("repeated"))  # a document's own
    by_doc = materialise(by_doc, "document-minimizers")
    drop_path(spark, found)
    drop_path(spark, counted)
    freed(spark)
    candidates = rows.join(by_doc, "key").select("key", "doc_id", "text", "repeated")
    segments = materialise(segment_rows(candidates, hot, window, gram), "segments")
    del candidates
    drop_path(spark, by_doc)
    freed(spark)
    contents = segments.groupBy("m", "content").agg(F.first("words", ignorenulls=True).alias("words"), F.count(F.lit(1)).alias("n"))
    spans = materialise(repeated_windows(contents, window, shard), "windows")
    del contents
    freed(spark)
    places = segments.select("m", "content", "key", "doc_id", "start").join(spans, ["m", "content"])
    places = places.select("key", "doc_id", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    out = materialise(places, "places")
    del places
    drop_path(spark, segments)
    drop_path(spark, spans)
    freed(spark)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256."""
    rows = numbered(docs, id_col, text_col)
    by_doc = intervals(rows, window, gram, shard).distinct().groupBy("key", "doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # a document's own
    by_doc = materialise(by_doc, "spans")
    freed(rows.sparkSession)
    changed = removed(rows.select("key", "text").join(by_doc.select("key", "spans"), "key")).distinct().join(by_doc.select("key", "doc_id"), "key")
    changed = materialise(changed.select("key", F.col("doc_id").alias("id"), F.col("n_removed").alias("r"), F.col("kept_sha256").alias("s")), "removed")
    freed(rows.sparkSession)
    whole = unchanged(rows)
    out = whole.join(changed, (whole["key"] == changed["key"]) & whole["doc_id"].eqNullSafe(changed["id"]), "left")
    return out.select("doc_id", "n_words", F.coalesce("r", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("s", "whole").alias("kept_sha256"))
