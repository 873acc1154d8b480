"""SimHash near-duplicates: fingerprints linked at a few differing bits, through pivot distance tables.

Distances of a fingerprint to many reference fingerprints bound its distance to every other one from below: two
fingerprints whose distances to any reference differ by more than `most` are further apart than `most` themselves.

1. Distinct fingerprints only; copies never meet each other.
2. Blocking. The references of the first kind are the zero word and words with one block of bits set; what they give,
   the number of ones in each block, and the block's bits themselves, are equal in all but `most` blocks of a linked
   pair. With BLOCKS = most + 2 blocks, every linked pair shares two whole blocks and so a key of about 21 bits.
3. In a key's group, a table of distances to PIVOTS spread references discards pairs by the largest coordinate
   difference; the survivors are verified by their differing bits.
4. Groups beyond TILE fingerprints are dealt out as pairs of tiles, so that no task holds a group. A tile pair returns
   a spanning forest of its links, not the links.
5. Components by repeated hooking to the smallest label, on checkpointed tables.

`near_duplicates` links fingerprints of four-word shingles. One edited word changes four of them, and so many bits that
few edited copies stay within a distance that blocks can find. `survivors` therefore takes two kinds of fingerprint: of
a text's distinct words, 64 bits that an edit hardly moves, for blocks and pivots; and of its distinct five-word
shingles, 256 bits, whose distance estimates the share of equal shingles. Texts are linked where the first differ in
WORD_MOST bits or fewer and the second in no more than `limit()`, the distance to be expected at a similarity of 0.8
and one standard deviation.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other; fewer
words than a shingle are one shingle; a null id is larger than other ids; rows with equal ids are members each for
themselves; an empty table gives an empty result; very long texts are hashed in bounded chunks; columns of any name may
stand beside the id and the text, and `survivors` keeps them all.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlattice.llm.common import materialise, packed, text_or_empty
from textlattice.llm.substring_dedup import WordHash, gram_hashes, mixed

SHINGLE, SEED, MOST = 4, 42, 4
#: For `survivors`: differing bits of the fingerprints of words, words of a shingle, longs of its fingerprint.
WORD_MOST, NEAR_SHINGLE, NEAR_LONGS, SIMILAR = 6, 5, 4, 0.8
PIVOTS = 48
#: Groups of more fingerprints, and of more than 1/GROUPS of all, are dealt out: there are fewer than GROUPS x keys.
TILE, GROUPS = 2000, 20_000
CHUNK = 1 << 15
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = text.encode().translate(_UPPER).split()  # bytes are split at the same six characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest, spans = xxhash.xxh64_intdigest, list(zip(starts[:n].tolist(), last, strict=True))
    return majority(np.array([digest(joined[a:b], SEED) for a, b in spans[lo : lo + CHUNK]], dtype="<u8") for lo in range(0, n, CHUNK))


def majority(chunks: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in chunks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long). One pass over the texts, no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


class Sketcher:
    """The fingerprints of `survivors`: of a text's distinct words, and of its distinct five-word shingles."""

    def __init__(self) -> None:
        self.words = WordHash()
        self.words.value[65:91] = self.words.value[97:123]  # A-Z count as a-z

    def of(self, text: str) -> list[int]:
        h = self.words.of(text)
        if not len(h):
            return [0] * (1 + NEAR_LONGS)
        grams = np.unique(gram_hashes(h, min(NEAR_SHINGLE, len(h))))
        salted = [self._chunks(grams, k) for k in range(1, NEAR_LONGS + 1)]
        return [majority(c) for c in (self._chunks(np.unique(h), 0), *salted)]

    @staticmethod
    def _chunks(h: np.ndarray, salt: int) -> Iterator[np.ndarray]:
        for lo in range(0, len(h), CHUNK):
            yield mixed(h[lo : lo + CHUNK] + np.uint64(1000 * salt))


def limit(similar: float = SIMILAR, bits: int = 64 * NEAR_LONGS) -> int:
    """Differing bits to be expected of two texts with this share of equal shingles, and one standard deviation."""
    p = math.acos(2 * similar / (1 + similar)) / math.pi
    return math.floor(bits * p + math.sqrt(bits * p * (1 - p)))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words (the fingerprint of the words), s0, s1, ... (of the shingles), fp (a hash of all of them)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    names = ["words", *[f"s{k}" for k in range(NEAR_LONGS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        for b in batches:
            bits = np.array([sketcher.of(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in bits.T.copy()]], names=["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names)).withColumn("fp", F.xxhash64(*names))


def blocks(most: int = MOST) -> list[int]:
    """Masks of most + 2 blocks that cover the 64 bits."""
    n = most + 2
    edges = [64 * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]


def pivots(n: int = PIVOTS, seed: int = 7) -> np.ndarray:
    """References in general position: random words from a fixed seed."""
    r = random.Random(seed)
    return np.array([r.getrandbits(64) for _ in range(n)], dtype=np.uint64)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def keyed(fps: DataFrame, most: int = MOST) -> DataFrame:
    """fps with every key of two blocks of its first column: two linked fingerprints have one of them in common."""
    pairs, bits = list(itertools.combinations(blocks(most), 2)), F.col(fps.columns[0])
    keys = [F.xxhash64(F.lit(k), bits.bitwiseAND(F.lit(_signed(a | b)))) for k, (a, b) in enumerate(pairs)]
    return fps.select(*fps.columns, F.explode(F.array(*keys)).alias("key"))


def tiled(keys: DataFrame, total: int, tile: int = TILE) -> DataFrame:
    """keys with i, j, mine: large groups as pairs of tiles (i <= j), in which a row's own tile is `mine`.

    total: number of fingerprints. The list of large groups is broadcast; a key's hash may join two groups, which costs
    comparisons and changes no link.
    """
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(tile, total // GROUPS))
    tiles = sizes.select("key", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("tiles"))
    rows = keys.join(F.broadcast(tiles), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", *[c for c in keys.columns if c != "key"])


def links_of(fp: np.ndarray, reference: np.ndarray, most: int = MOST, within: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of positions at `most` or fewer differing bits, some at a time. within: tile of each, if only pairs
    across count.

    Candidates come from a window over the first reference's distances; the largest coordinate difference over the
    others discards; differing bits verify.
    """
    table = np.bitwise_count(fp[:, None] ^ reference[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    upto = np.searchsorted(first, first + most, side="right")
    step = max(1, 400_000 // max(1, int((upto - np.arange(len(fp))).max(initial=1))))
    for lo in range(0, len(fp), step):
        hi = min(lo + step, len(fp))
        counts = upto[lo:hi] - np.arange(lo, hi) - 1
        a = np.repeat(np.arange(lo, hi), counts)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
        a, b = order[a], order[b]
        if within is not None:
            across = within[a] != within[b]
            a, b = a[across], b[across]
        for k in range(1, len(reference), 6):  # most pairs are gone after the first few references
            near = np.abs(table[a, k : k + 6] - table[b, k : k + 6]).max(axis=1, initial=0) <= most
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= most
        yield a[near], b[near]


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label: the smallest position that each position is linked to so far. The same with the links (a, b)."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def links(fps: DataFrame, most: int = MOST, tile: int = TILE, beyond: int = 0) -> DataFrame:
    """fps: distinct rows of a fingerprint for the blocks, longs that may differ in `beyond` bits in all, if any, and fp.

    Links (fp, to) with to < fp that join the same rows as all links do.
    """
    reference, first, last = pivots(), 4, 4 + len(fps.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in itertools.chain(batches, [None]):
            if b is not None:
                cols = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(b.num_columns)]
                held.append(np.stack(cols, axis=1))
            rows = np.concatenate(held) if held else np.zeros((0, last + 1), np.int64)
            new = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            edges = np.concatenate([[0], new, [len(rows)]])
            if b is not None:  # the last group may go on
                edges = edges[:-1]
            several = np.flatnonzero(np.diff(edges) > 1)
            out = [x for lo, hi in zip(edges[several].tolist(), edges[several + 1].tolist(), strict=True) for x in group(rows[lo:hi])]
            held = [rows[edges[-1] :]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out).T.copy()], names=["fp", "to"])

    def group(rows: np.ndarray) -> list[np.ndarray]:
        rows = rows[np.argsort(rows[:, last])]  # the smallest fp is the first position
        bits = rows[:, first:last].copy().view(np.uint64)
        blocked = rows[:, first].copy().view(np.uint64)
        low = np.arange(len(rows))
        for a, b in links_of(blocked, reference, most, rows[:, 3] if rows[0, 1] != rows[0, 2] else None):
            if bits.shape[1] > 1:
                near = np.bitwise_count(bits[a, 1:] ^ bits[b, 1:]).sum(axis=1, dtype=np.int64) <= beyond
                a, b = a[near], b[near]
            if len(a):
                low = forest(low, a, b)
        moved = np.flatnonzero(low != np.arange(len(rows)))
        return [np.stack([rows[moved, last], rows[low[moved], last]], axis=1)] if len(moved) else []

    tiles = tiled(keyed(fps, most), fps.count(), tile).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return tiles.mapInArrow(run, "fp long, to long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (fp, to). One row per linked fp: its smallest reachable one, as `root`.

    Each round hooks the two roots of an edge, then halves the chains; edges inside a tree are gone after it, so that
    the tables shrink by half and more each round.
    """
    edges = materialise(edges, "links")
    labels = materialise(edges.select("fp").unionByName(edges.select(F.col("to").alias("fp"))).distinct().withColumn("root", F.col("fp")), "labels")
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("fp").alias("x"), F.col("to").alias("y")), F.struct(F.col("to").alias("x"), F.col("fp").alias("y")))).alias("e"))
        hook = ends.groupBy("e.x").agg(F.min("e.y").alias("y")).filter("y < x")  # each root to its smallest neighbour
        hook = materialise(hook, "hooks")
        if hook.isEmpty():
            return labels
        hook = flattened(hook)
        a, b = hook.select(F.col("x").alias("fp"), F.col("y").alias("fp_root")), hook.select(F.col("x").alias("to"), F.col("y").alias("to_root"))
        moved = edges.join(a, "fp", "left").join(b, "to", "left")
        moved = moved.select(F.coalesce("fp_root", "fp").alias("fp"), F.coalesce("to_root", "to").alias("to")).filter("fp <> to").distinct()
        edges = materialise(moved, "links")
        new = labels.join(hook.select(F.col("x").alias("root"), "y"), "root", "left")
        labels = materialise(new.select("fp", F.coalesce("y", "root").alias("root")), "labels")


def flattened(hook: DataFrame) -> DataFrame:
    """hook (x, y < x): each x with the end of its chain, by pointer doubling."""
    while True:
        up = hook.select(F.col("x").alias("y"), F.col("y").alias("z"))
        hook = materialise(hook.join(up, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("on")), "chains")
        if hook.filter("on").isEmpty():
            return hook.select("x", "y")
        hook = hook.select("x", "y")


def classes(fps: DataFrame, most: int = MOST, beyond: int = 0) -> DataFrame:
    """fps: doc_id and the columns of `links`. One row per distinct fp: its component's smallest doc_id, as component_id."""
    bits = [c for c in fps.columns if c != "doc_id"]
    first = materialise(fps.groupBy(*bits).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(first.select(*bits), most, beyond=beyond))
    tree = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = tree.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return materialise(tree.join(low, "root").select("fp", "n", "component_id"), "classes")


def with_class(fps: DataFrame, by_fp: DataFrame, heavy: int = 1000) -> DataFrame:
    """fps joined with their class. Fewer than `heavy` fingerprints can have over 1/heavy of the rows: these are broadcast."""
    total = by_fp.agg(F.sum("n")).first()[0] or 0
    large = by_fp.filter(F.col("n") > max(total // heavy, 1000)).select("fp", F.col("component_id").alias("c"), F.lit(True).alias("large"))
    marked = fps.join(F.broadcast(large), "fp", "left")
    hot = marked.filter("large").withColumn("component_id", F.col("c")).drop("large", "c")
    rest = marked.filter("large is null").drop("large", "c").join(by_fp.select("fp", "component_id"), "fp")
    return hot.unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (hex), component_id."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    out = with_class(fps, classes(fps, most))
    return out.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = WORD_MOST, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs, with all their columns: of each component the one with the smallest id (nulls last), of equal
    ids the one with the smallest hash of its text, of equal texts any one."""
    hashed = lambda text: F.xxhash64(text_or_empty(text))
    place = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), hashed(text_col).alias("hash"))
    fps = materialise(sketches(docs.select(place.alias("doc_id"), F.col(text_col).alias("text"))), "sketches")
    keep = with_class(fps.select("doc_id", "fp"), classes(fps, most, limit(similar))).filter(F.col("doc_id") == F.col("component_id"))
    keep = keep.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("doc_id.id").alias("__id"), F.col("doc_id.hash").alias("__hash"), "n")
    full = packed(docs).withColumn("__text", hashed(F.col(f"__row.{text_col}")))
    hit = full.join(keep, F.col(f"__row.{id_col}").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")))
    once = hit.filter("n = 1").select("__row.*")
    tied = hit.filter("n > 1").groupBy("__id", "__hash").agg(F.first("__row").alias("__row")).select("__row.*")
    return once.unionByName(tied)
