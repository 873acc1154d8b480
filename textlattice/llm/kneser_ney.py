"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text, joined with counts in shards.

The model is a bigram model over all words of trusted text, which are known by 64-bit hashes; a word that trusted text
hasn't got has the uniform share of the unigrams' left-over mass. With back-off weights folded in, a document's log
probability is a sum of one weight per word and one per stored bigram that it holds. So scoring is a join of counts:

1. Trusted rows (a label, and not in the held-out quarter) give the bigram counts. They are added up per chunk of
   documents, then in shards by first word, where the totals of contexts are; then they move to shards by second word,
   where the words' continuations are. The number of shards follows the size of trusted text.
2. Only numbers of counts of 1, 2, 3 and 4, of words and of bigrams go over the driver to all tasks.
3. Documents are scored in ROUNDS parts of the table, so that only a part of the questions is on disk at a time. Each
   chunk of documents sends every shard its bigrams by second word, each once, with the documents that hold it. The shard
   looks them up and returns a number per document. Hashes are sorted and stored as differences, each once a message.
4. Perplexities are compared with a quantile of the held-out trusted documents of their language, which the model has
   never seen. The logarithms' quantile of n documents is drawn towards that of all languages, which counts as SHRINK
   documents; a language without any is held against the latter. Quantiles are found by counting in steps of FINE, so they
   don't depend on the order of rows.

Two words of one hash would share their counts: with n distinct words the chance of any such pair is about n^2 / 2^65.

Defined results: a document without words has no perplexity and is rejected; a null text is empty; a null language is a
language of its own; a null id has no label; repeated rows are judged alike and all of them returned; a perplexity equal
to the threshold is kept; a text of any length is one document, in a chunk of its own where it is long; columns of any
name may stand beside those named; without any trusted document all documents with words are kept; an empty table gives
an empty result. Rows must come in the same order when a task is repeated, as those of a table do.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlattice.llm.common import drop_path, freed, materialise, packed, text_or_empty

SHARDS = 8  # at least
SHARD_CHARS = 10_000_000  # of trusted text in a shard
CHUNK_WORDS = 1_000_000
PIECE = 1_000_000  # bigrams in a row of the model's tables
ROUNDS = 8
FILTER_BITS = 1 << 27  # at most
QUANTILE, MARGIN = 0.99, 1.05
SHRINK = 20
COARSE, FINE = 1e-3, 1e-7
HELD_OUT = "pmod(crc32(cast(doc_id as string)), 4) = 2"
SEED = 42
START = np.uint64(xxhash.xxh64_intdigest(b"", SEED))  # no word
_LOW = np.uint64(0xFFFFFFFF)


# Arrays of numbers, as bytes.


def squeezed(x: np.ndarray, kind: str = "<u4") -> bytes:
    """An array of numbers, by planes of bytes; rising ones best as differences."""
    planes = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(b: bytes, kind: str = "<u4") -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def rising(x: np.ndarray) -> bytes:
    """A sorted array of unsigned 64-bit numbers."""
    return squeezed(np.diff(x, prepend=np.uint64(0)), "<u8")


def risen(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(b, "<u8"), dtype=np.uint64)


def listed(x: np.ndarray) -> tuple[bytes, bytes]:
    """An array of hashes in any order: the distinct ones, and the place of each among them."""
    kinds, at = np.unique(x, return_inverse=True)
    return rising(kinds), squeezed(at)


def unlisted(kinds: bytes, at: bytes) -> np.ndarray:
    return risen(kinds)[unsqueezed(at)]


def coded(x: np.ndarray) -> bytes:
    """Fractions of which many are equal: the distinct ones, and the place of each among them."""
    kinds, at = np.unique(x, return_inverse=True)
    return len(kinds).to_bytes(8, "little") + kinds.tobytes() + squeezed(at)


def uncoded(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(b, np.float64, n, 8)[unsqueezed(b[8 + 8 * n :])]


def starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers of a sorted array begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


def runs(x: np.ndarray) -> tuple[bytes, bytes]:
    """A sorted array with many equal numbers: the distinct ones, and how often each comes."""
    at = starts(x)
    return rising(x[at]), squeezed(np.diff(at, append=len(x)))


def unrun(kinds: bytes, times: bytes) -> np.ndarray:
    return np.repeat(risen(kinds), unsqueezed(times))


def found_in(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the place of each number in a sorted table, whether it is there)."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


class Hashes(dict):
    """Word hashes, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word, SEED)
        return out

    def of(self, text: str, most: int = 200_000) -> np.ndarray:
        if len(self) > most:
            self.clear()
        words = text.encode().split()  # bytes are split at space, tab, line feed, vertical tab, form feed, carriage return
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def before(hashes: list[np.ndarray]) -> np.ndarray:
    """The word before each word, START before a document's first."""
    return np.concatenate([x for n in hashes if len(n) for x in ([START], n[:-1])] or [np.zeros(0, np.uint64)]).astype(np.uint64)


def joined(hashes: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]).astype(np.uint64)


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(shards)


def by_shard(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions) of an array of shards. What follows is done for a shard at a time, in little memory."""
    order = np.argsort(at.astype(np.uint32), kind="stable")
    begins = starts(at[order])
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(at)], strict=True) if len(at) else ():
        yield int(at[order[lo]]), order[lo:hi]


def chunks(batches: Iterator[pa.RecordBatch], text_at: int, words: int) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """(the rows' other columns, the hashes of each row's words) for about so many words at a time."""
    known, rows, hashes, size = Hashes(), [], [], 0
    for b in batches:
        others, lo = pa.Table.from_batches([b]).remove_column(text_at), 0
        others = others.take(pa.array(range(b.num_rows)))  # a copy, which doesn't hold on to the texts
        for k, text in enumerate(b.column(text_at)):
            hashes.append(known.of(text.as_py()))
            size += len(hashes[-1]) + 1
            if size >= words:
                yield pa.concat_tables([*rows, others.slice(lo, k + 1 - lo)]), hashes
                rows, hashes, size, lo = [], [], 0, k + 1
        if lo < b.num_rows:
            rows.append(others.slice(lo))
    if hashes:
        yield pa.concat_tables(rows), hashes


def batch_of(rows: list[tuple], names: str) -> pa.RecordBatch:
    """Rows of numbers (of a shard or chunk) and bytes."""
    kinds = [pa.binary() if isinstance(x, bytes) else pa.int64() for x in rows[0]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names.split())


def schema_of(numbers: str, names: str) -> str:
    return ", ".join(f"{n} {'long' if n in numbers.split() else 'binary'}" for n in names.split())


# The model.


def discounts(n: list[float]) -> np.ndarray:
    """D1, D2 and D3+ from the numbers of n-grams with counts 1, 2, 3 and 4."""
    if not n[0] or not n[1]:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0] + [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return np.clip(d, 0.0, [0, 0.95, 1.9, 2.85])


class Model:
    """What all tasks need: a few numbers, whatever the vocabulary."""

    def __init__(self, high: np.ndarray, totals: np.ndarray):
        """high: the bigrams' discounts. totals: words with 1, 2, 3 and 4 distinct words before them, words, bigrams."""
        words, bigrams = int(totals[4]), int(totals[5])
        self.high, self.low, self.every = high, discounts(totals[:4].tolist()), max(1.0, float(bigrams))
        off = self.low[1] * totals[0] + self.low[2] * totals[1] + self.low[3] * (words - totals[0] - totals[1])
        self.spread = off / self.every / (words + 2)
        self.unseen = float(np.log(self.unigram(np.zeros(1, np.int64)))[0])

    @classmethod
    def of(cls, state: dict) -> Model:
        out = cls.__new__(cls)
        vars(out).update(state)
        return out

    def unigram(self, kinds: np.ndarray) -> np.ndarray:
        """The probability of words with so many distinct words before them."""
        return np.maximum(np.maximum(kinds - self.low[np.minimum(kinds, 3)], 0) / self.every + self.spread, 1e-12)


class Shard:
    """A shard's words and their bigrams, ready for questions."""

    def __init__(self, m: Model, held: list[tuple]):
        """held: pieces of the model, in the order of their words."""
        words, kinds, self.back, firsts, scales, at, n = zip(*held, strict=True)
        self.words, kinds, self.back = np.concatenate(words), np.concatenate(kinds), np.concatenate(self.back)
        self.firsts, place = np.unique(np.concatenate(firsts), return_index=True)
        scale, n = np.concatenate(scales)[place], np.concatenate(n)
        first = np.concatenate([np.searchsorted(self.firsts, f)[a] for f, a in zip(firsts, at, strict=True)])
        unigram = m.unigram(kinds)
        #: What a word adds as a word, beyond an unseen one, and as a context.
        self.weights = np.log(unigram) - m.unseen + self.back
        keys = np.repeat(np.arange(len(kinds), dtype=np.uint64), kinds) << np.uint64(32) | first.astype(np.uint64)
        order = np.argsort(keys)
        ratio = (n - m.high[np.minimum(n, 3)]) / scale[first]
        self.keys, self.pairs = keys[order], np.log1p(ratio / np.repeat(unigram, kinds))[order]

    def answer(self, words: np.ndarray, times: np.ndarray, firsts: np.ndarray, at: np.ndarray, many: np.ndarray, docs: np.ndarray, count: np.ndarray, edges: np.ndarray, edge_docs: np.ndarray) -> np.ndarray:
        """A number for each document of a chunk, from its bigrams by second word; the edges are no contexts, but for START."""
        w, known = found_in(self.words, words)
        f, seen = found_in(self.firsts, firsts)
        of = np.repeat(np.arange(len(words)), times)
        place, there = found_in(self.keys, w[of].astype(np.uint64) << np.uint64(32) | f[at].astype(np.uint64))
        value = np.where(known, self.weights[w], 0.0)[of]
        hit = there & known[of] & seen[at]
        value[hit] += self.pairs[place[hit]]
        e, real = found_in(self.words, edges)
        back = np.where(real, self.back[e], 0.0) * np.where(edges == START, 1.0, -1.0)
        size = int(np.concatenate([docs, edge_docs]).max()) + 1
        return np.bincount(docs, np.repeat(value, many) * count, size) + np.bincount(edge_docs, back, size)


def maybe_in(docs: DataFrame, ids: DataFrame, bits: int) -> DataFrame:
    """The rows of docs whose doc_id may be one of ids: a filter of so many bits, before a join makes it exact."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = ids.select(F.shiftright(place, 5).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(doc_id), {bits}L), 32) as int))").alias("bit"))
    found = words.groupBy("at").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()  # at most bits / 32 rows
    mask = np.zeros(bits // 32, dtype=np.uint32)
    mask[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("__place").to_numpy()
            hit = shared.value[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)
            yield b.filter(pa.array(hit == 1)).select(["doc_id", "text"])

    rows = docs.select("doc_id", "text").filter("doc_id is not null").withColumn("__place", place)
    return rows.mapInArrow(run, rows.drop("__place").schema)


def trusted_rows(docs: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """docs: doc_id, text. Those with a good label, without the held-out quarter, written once.

    Documents without such a label are dropped before the join, but for a few that a filter of bounded size lets pass.
    """
    good = materialise(labels.filter((F.col(label_col) == 1) & ~F.expr(HELD_OUT)).select("doc_id").distinct(), "good")
    bits = min(FILTER_BITS, 1 << max(10, (16 * good.count()).bit_length()))
    out = materialise(maybe_in(docs, good, bits).join(good, "doc_id").select("text"), "trusted")
    drop_path(docs.sparkSession, good)
    return out


def pieces(first: np.ndarray, piece: int) -> Iterator[tuple[int, int]]:
    """Spans of about so many elements of a sorted array that don't part equal ones."""
    lo = 0
    while lo < len(first):
        hi = int(np.searchsorted(first, first[min(lo + piece, len(first)) - 1], side="right"))
        yield lo, hi
        lo = hi


def summed(v: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each bigram once, in order, with the sum of its counts."""
    if not len(v):
        return v, w, np.zeros(0, np.int64)
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    at = np.concatenate([[0], np.flatnonzero((v[1:] != v[:-1]) | (w[1:] != w[:-1])) + 1])
    sums = np.diff(at, append=len(v)) if n is None else np.add.reduceat(n[order].astype(np.int64), at)
    return v[at], w[at], sums


COUNTED = "shard v times w at n"


def counted(trusted: DataFrame, shards: int, chunk: int) -> DataFrame:
    """Bigram counts of trusted text, added up within each chunk, by shards of the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes in chunks(batches, 0, chunk):
            v, w = before(hashes), joined(hashes)
            del hashes
            out = []
            for s, its in by_shard(shard_of(v, shards)):
                vs, ws, n = summed(v[its], w[its])
                out.append((s, *runs(vs), *listed(ws), squeezed(n)))
            if out:
                yield batch_of(out, COUNTED)

    return trusted.mapInArrow(run, schema_of("shard", COUNTED))


def by_context(parts: DataFrame, shards: int, piece: int) -> DataFrame:
    """Rows of whole contexts, and how many of their bigrams have counts of 1, 2, 3 and 4."""
    names = f"{COUNTED} counts"

    def rows(shard: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        v, w, n = summed(*map(np.concatenate, zip(*held, strict=True)))
        for lo, hi in pieces(v, piece):
            counts = np.bincount(np.minimum(n[lo:hi], 5), minlength=6)[1:5]
            yield batch_of([(shard, *runs(v[lo:hi]), *listed(w[lo:hi]), squeezed(n[lo:hi], "<u8"), counts.astype("<i8").tobytes())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, least = None, [], 0
        for b in batches:
            for shard, v, times, w, at, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if shard != now and held:
                    yield from rows(now, held)
                    held, least = [], 0
                now = shard
                held.append((unrun(v, times), unlisted(w, at), unsqueezed(n).astype(np.int64)))
                if sum(len(h[0]) for h in held) > 2 * least + 1_000_000:  # equal bigrams of many chunks become one
                    held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                    least = len(held[0][0])
        if held:
            yield from rows(now, held)

    dealt = parts.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, schema_of("shard", names))


SENT = "shard words times firsts scale at n"


def by_word(contexts: DataFrame, d: np.ndarray, shards: int, piece: int) -> DataFrame:
    """The model, by shards of the second word: words, numbers of distinct words before them, log back-off weights; the
    first words of their bigrams, what divides a discounted count after each of them, which of them, counts; totals for Model."""
    names = "shard words kinds back firsts scale at n totals"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, v, times, w, at, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                v, size, w, n = risen(v), unsqueezed(times).astype(np.int64), unlisted(w, at), unsqueezed(n, "<u8").astype(np.int64)
                begins = np.cumsum(size) - size
                c, off = np.add.reduceat(n, begins), np.add.reduceat(d[np.minimum(n, 3)], begins)
                back = np.clip(off / c, 1e-12, 1.0)
                scale, of = c * back, np.repeat(np.arange(len(v)), size)
                out = [(shard, rising(v), b"", b"", coded(np.log(back)), b"", b"")]
                for s, its in by_shard(shard_of(w, shards)):
                    its = its[np.lexsort((of[its], w[its]))]
                    which, at = np.unique(of[its], return_inverse=True)
                    out.append((s, *runs(w[its]), rising(v[which]), coded(scale[which]), squeezed(at), squeezed(n[its], "<u8")))
                yield batch_of(out, SENT)

    def rows(shard: int, contexts: list[tuple], grams: list[tuple]) -> Iterator[pa.RecordBatch]:
        v, back = map(np.concatenate, zip(*(contexts or [(np.zeros(0, np.uint64), np.zeros(0))]), strict=True))
        w, firsts, scale, at, n = (list(x) for x in (zip(*grams, strict=True) if grams else [[np.zeros(0, t)] for t in ("<u8", "<u8", "<f8", "<u4", "<u8")]))
        offset = np.cumsum([0, *map(len, firsts)])  # a first word is in one row only
        at = np.concatenate([a + o for a, o in zip(at, offset, strict=False)])
        w, firsts, scale, n = map(np.concatenate, (w, firsts, scale, n))
        order, by_v = np.argsort(w, kind="stable"), np.argsort(v)
        w, at, n, v, back = w[order], at[order], n[order], v[by_v], back[by_v]
        words = np.union1d(w, v)  # START is a context only
        kinds = np.searchsorted(w, words, side="right") - np.searchsorted(w, words, side="left")
        log_back = np.zeros(len(words))
        log_back[np.searchsorted(words, v)] = back
        ends = np.cumsum(kinds)
        for a, b in pieces(ends // piece, 1):
            lo, hi = int(ends[a - 1]) if a else 0, int(ends[b - 1])
            k = kinds[a:b]
            totals = np.array([*[(k == j).sum() for j in (1, 2, 3, 4)], (k > 0).sum(), k.sum()], dtype="<i8")
            own, place, of = np.unique(firsts[at[lo:hi]], return_index=True, return_inverse=True)
            row = (shard, rising(words[a:b]), squeezed(k), coded(log_back[a:b]), rising(own), coded(scale[at[lo:hi][place]]), squeezed(of), squeezed(n[lo:hi], "<u8"), totals.tobytes())
            yield batch_of([row], names)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, contexts, grams = None, [], []
        for b in batches:
            for shard, words, times, firsts, scale, at, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if shard != now and now is not None:
                    yield from rows(now, contexts, grams)
                    contexts, grams = [], []
                now = shard
                if times:
                    grams.append((unrun(words, times), risen(firsts), uncoded(scale), unsqueezed(at), unsqueezed(n, "<u8")))
                else:
                    contexts.append((risen(words), uncoded(scale)))
        if now is not None:
            yield from rows(now, contexts, grams)

    sent = contexts.select(*COUNTED.split()).mapInArrow(send, schema_of("shard", SENT))
    dealt = sent.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(receive, schema_of("shard", names))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label_col: str = "quality", shards: int = SHARDS, chunk: int = CHUNK_WORDS, piece: int = PIECE):
    """docs: doc_id, text. (the model as a table, the shared model, the number of shards)."""
    trusted = trusted_rows(docs, labels, label_col)
    chars = trusted.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(shards, -(-chars // SHARD_CHARS))
    contexts = materialise(by_context(counted(trusted, shards, chunk), shards, piece), "bigrams")
    drop_path(spark, trusted)
    freed(spark)
    high = discounts(summed_column(contexts, "counts", 4).tolist())
    table = materialise(by_word(contexts, high, shards, piece), "model")
    drop_path(spark, contexts)
    freed(spark)
    model = Model(high, summed_column(table, "totals", 6))
    return table.drop("totals"), spark.sparkContext.broadcast(vars(model)), shards


def summed_column(table: DataFrame, name: str, size: int) -> np.ndarray:
    """The sum of a column of arrays of a few numbers, a row per piece."""
    out = np.zeros(size, dtype=np.int64)
    for r in table.select(name).toLocalIterator():
        out += np.frombuffer(r[name], dtype="<i8")
    return out


ASKED = "shard kind chunk a b c d e f g h i"


def asked(rows: DataFrame, model, shards: int, chunk: int) -> DataFrame:
    """Per chunk a row for each shard with the bigrams and who holds them, and a row about the documents. text: the last column."""
    text_at = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, m = TaskContext.get().partitionId(), Model.of(model.value)
        for k, (others, hashes) in enumerate(chunks(batches, text_at, chunk)):
            name = task << 24 | k
            sizes = np.array([len(n) for n in hashes])
            about = others.append_column("__n", pa.array(sizes, pa.int64())).append_column("__log_p", pa.array(sizes * m.unseen, pa.float64()))
            w, v, some = joined(hashes), before(hashes), np.flatnonzero(sizes)
            del others, hashes
            edges = np.concatenate([w[np.cumsum(sizes)[some] - 1], np.full(len(some), START)])
            edge_docs = np.concatenate([some, some])
            at, edge_at = shard_of(w, shards), shard_of(edges, shards)
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            out = [(name % shards, 1, name, about_bytes(about), *[b""] * 8)]
            asks = dict(by_shard(at))
            for s in np.union1d(at, edge_at).astype(np.int64).tolist():
                its, own = asks.get(s, np.zeros(0, np.int64)), edge_at == s
                words, wi = np.unique(w[its], return_inverse=True)
                firsts, vi = np.unique(v[its], return_inverse=True)
                grams, gi = np.unique(wi.astype(np.uint64) << np.uint64(32) | vi.astype(np.uint64), return_inverse=True)
                pairs, count = np.unique(gi.astype(np.uint64) << np.uint64(32) | doc[its], return_counts=True)
                times = np.bincount((grams >> np.uint64(32)).astype(np.int64), minlength=len(words))
                many = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(grams))
                out.append((s, 2, name, rising(words), squeezed(times), rising(firsts), squeezed(grams & _LOW), squeezed(many), squeezed(pairs & _LOW), squeezed(count), squeezed(edges[own], "<u8"), squeezed(edge_docs[own])))
            del w, v, doc, at, asks
            yield batch_of(out, ASKED)

    return rows.mapInArrow(run, schema_of("shard kind chunk", ASKED))


def about_bytes(about: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, about.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(about)
    return sink.getvalue().to_pybytes()


def answered(table: DataFrame, asks: DataFrame, model, shards: int) -> DataFrame:
    """The join: each shard's model meets what the chunks ask. Rows chunk, shard (-1: about the documents), numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, own, m = None, [], None, Model.of(model.value)
        for batch in batches:
            out = []
            for shard, kind, chunk, a, b, c, d, e, f, g, h, i in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if shard != now:
                    now, held, own = shard, [], None
                if kind == 0:
                    held.append((risen(a), unsqueezed(b).astype(np.int64), uncoded(c), risen(d), uncoded(e), unsqueezed(f), unsqueezed(g, "<u8").astype(np.int64)))
                elif kind == 1:
                    out.append((chunk, -1, a))
                else:
                    if own is None and held:
                        own, held = Shard(m, sorted(held, key=lambda x: int(x[0][0]))), []
                    if own is not None:
                        out.append((chunk, shard, own.answer(risen(a), unsqueezed(b), risen(c), unsqueezed(d), unsqueezed(e), unsqueezed(f), unsqueezed(g), unsqueezed(h, "<u8"), unsqueezed(i)).tobytes()))
            if out:
                yield batch_of(out, "chunk shard numbers")

    zero, none = F.lit(0).cast("long"), F.lit(b"")
    held = table.select("shard", zero.alias("kind"), zero.alias("chunk"), *[F.col(n).alias(a) for n, a in zip("words kinds back firsts scale at n".split(), "abcdefg", strict=True)], none.alias("h"), none.alias("i"))
    dealt = held.unionByName(asks).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "chunk")
    return dealt.mapInArrow(run, "chunk long, shard long, numbers binary")


def added(answers: DataFrame, schema) -> DataFrame:
    """The documents' columns, n_words, log_p. A chunk's rows are one per shard; they are added in the shards' order."""

    def rows(about: bytes, sums: list[bytes]) -> Iterator[pa.RecordBatch]:
        out = pa.ipc.open_stream(about).read_all()
        log_p = out.column("__log_p").to_numpy().copy()
        for s in sums:
            part = np.frombuffer(s)
            log_p[: len(part)] += part
        yield from out.set_column(out.num_columns - 1, "__log_p", pa.array(log_p)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, sums = b"", []
        for b in batches:
            for shard, numbers in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if shard == -1:
                    if about:
                        yield from rows(about, sums)
                    about, sums = numbers, []
                else:
                    sums.append(numbers)
        if about:
            yield from rows(about, sums)

    dealt = answers.repartition("chunk").sortWithinPartitions("chunk", "shard")
    return dealt.mapInArrow(run, schema)


def perplexities(spark: SparkSession, docs: DataFrame, labels: DataFrame, label_col: str = "quality", shards: int = SHARDS, chunk: int = CHUNK_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """docs: doc_id, text, key (a hash of the row) and others. All rows, without their texts: n_words, perplexity (null without words)."""
    table, model, shards = fit(spark, docs, labels, label_col, shards, chunk)
    rows = docs.select(*[c for c in docs.columns if c != "text"], "text")
    schema = rows.drop("text").withColumns({"__n": F.lit(0).cast("long"), "__log_p": F.lit(0.0)}).schema
    parts = []
    for r in range(rounds):
        asks = asked(rows.filter(F.pmod("key", F.lit(rounds)) == r), model, shards, chunk)
        parts.append(materialise(added(answered(table, asks, model, shards), schema), "log-probabilities"))
        del asks
        freed(spark)
    drop_path(spark, table)
    sums = functools.reduce(DataFrame.unionByName, parts)
    perplexity = F.when(F.col("__n") > 0, F.exp(-F.col("__log_p") / F.col("__n")))
    return sums.select(*rows.drop("text").columns, F.col("__n").alias("n_words"), perplexity.alias("perplexity"))


def quantiles(values: DataFrame, by: Column, q: float) -> DataFrame:
    """values: x. One row for each value of by, `group`: n, and `own`, the smallest x with a share of at least q up to it.

    Found by counts in steps of COARSE, then of FINE inside one of them; values within a step of FINE count as its largest.
    """

    def upto(steps: DataFrame) -> DataFrame:
        return steps.withColumn("upto", F.sum("m").over(Window.partitionBy("group").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))

    values = values.select(by.alias("group"), "x")
    steps = upto(values.groupBy("group", F.floor(F.col("x") / COARSE).alias("step")).agg(F.count(F.lit(1)).alias("m")))
    need = steps.groupBy("group").agg(F.sum("m").alias("n")).withColumn("need", F.ceil(F.col("n") * q - 1e-9))
    first = steps.alias("s").join(need.alias("t"), F.expr("s.group <=> t.group")).filter("upto >= need and upto - m < need").select("t.group", "n", (F.col("need") - F.col("upto") + F.col("m")).alias("need"), F.col("step").alias("coarse"))
    inside = values.alias("v").join(first.alias("f"), F.expr(f"v.group <=> f.group and floor(v.x / {COARSE!r}) = f.coarse"))
    fine = inside.groupBy("f.group", "n", "need", F.floor(F.col("x") / FINE).alias("step")).agg(F.count(F.lit(1)).alias("m"), F.max("x").alias("own"))
    return upto(fine).filter("upto >= need and upto - m < need").select("group", "n", "own")


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """One row per row of docs: doc_id, lang, key, n_words, perplexity, threshold, kept."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("key"), F.col(lang_col).alias("lang"), text.alias("text"))
    found = perplexities(spark, rows, labels)
    fair = labels.filter((F.col("quality") == 1) & F.expr(HELD_OUT)).select("doc_id").distinct()
    fair = materialise(found.filter("perplexity is not null").join(fair, "doc_id").select("lang", F.ln("perplexity").alias("x")), "fair")  # read four times
    by_lang = quantiles(fair, F.col("lang"), quantile)
    every = quantiles(fair, F.lit(0), quantile).select(F.col("own").alias("every"))
    cuts = materialise(by_lang.crossJoin(F.broadcast(every)), "cuts")  # one row
    out = found.join(cuts, F.col("lang").eqNullSafe(F.col("group")), "left")
    one = cuts.first()
    every = F.lit(one["every"] if one else None).cast("double")
    drawn = (F.col("own") * F.col("n") + F.col("every") * SHRINK) / (F.col("n") + SHRINK)
    threshold = F.exp(F.coalesce(drawn, every) * margin)
    kept = (F.col("n_words") > 0) & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", "lang", "key", "n_words", "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def survivors(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, that are kept."""
    found = judged(spark, docs, labels, id_col, text_col, lang_col).filter("kept")
    found = found.select("key", F.col("doc_id").alias("id"), F.col("lang").alias("l")).distinct()
    full = packed(docs).withColumn("__key", F.xxhash64(F.col(f"__row.{id_col}"), text_or_empty(F.col(f"__row.{text_col}"))))
    same = (F.col("__key") == F.col("key")) & F.col(f"__row.{id_col}").eqNullSafe(F.col("id")) & F.col(f"__row.{lang_col}").eqNullSafe(F.col("l"))
    return full.join(found, same, "left_semi").select("__row.*")
