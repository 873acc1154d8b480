"""MinHash near-duplicates with sequential Bayesian verification of banded candidates.

1. A document's set is its distinct two-word shingles, as 64-bit hashes. Equal sets (128-bit digests) are one entry, so that
   copies never meet each other. An entry has BANDS x ROWS minhashes: band keys, and one byte of each for verification.
2. Entries that share a band are candidates. Each one first meets the smallest entry of its band's group; only those that
   aren't near it meet the others, dealt out in tiles of them. A group of near copies costs its size, not its square.
3. Sequential verification: signatures are compared BATCH bytes at a time. After n of them with m equal, and a uniform
   prior, the posterior chance of a similarity of `similar` or more is P(Binomial(n + 1, similar) <= m); a pair goes as soon
   as it is below MISS. The least m is a table made once. Bytes that are equal by chance only let more pairs pass.
4. Survivors' components are clusters. The full sets of their entries, and of no others, are made again from the texts (a
   bit filter of bounded size lets few other texts pass), and links are confirmed on them, in the same two steps: with the
   cluster's smallest entry, then those that failed with all others of their cluster. A link inside a tree that is
   already known is not looked for; none between trees is left out.
5. Components of the confirmed links.

A pair at a similarity of 0.8 shares no band with a chance of (1 - 0.8^ROWS)^BANDS = 1.3e-7, less when it is nearer; MISS
adds about a millionth.

Defined results: words are compared with A-Z in lower case; a text of one word is one shingle; a null or empty text, or one
without words, has an empty set, is linked with nothing and is its own component; a null id is larger than other ids, and a
component of null ids alone has none (such rows are kept); rows with equal ids are members each for themselves; a very
long text is hashed in bounded chunks; columns of other names are not looked at; an empty table gives no rows. Shingles are
compared by 64-bit hashes: two different ones of a pair are taken for each other with a chance of some n^2 / 2^64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlattice.llm.common import drop_path, materialise, text_or_empty
from textlattice.llm.kneser_ney import FILTER_BITS, maybe_in
from textlattice.llm.simhash import components, with_class
from textlattice.llm.substring_dedup import WordHash, gram_hashes, mixed

SHINGLE, SIMILAR = 2, 80
BANDS, ROWS, BATCH = 40, 5, 40
HASHES = BANDS * ROWS
MISS = 1e-6
#: Entries of a group that one task holds; shingles that are hashed at a time.
TILE, CHUNK = 512, 2048


def least_matches(similar: float, miss: float = MISS) -> list[int]:
    """For each batch, the fewest equal minhashes with which a pair may still be similar."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * similar**m * (1 - similar) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return out


class Sketcher:
    """Sets of shingles, and their minhashes."""

    def __init__(self, shingle: int = SHINGLE) -> None:
        self.shingle, self.words = shingle, WordHash()
        self.words.value[65:91] = self.words.value[97:123]  # A-Z count as a-z
        self.factors = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.weights = mixed(np.arange(1001, 1001 + HASHES, dtype=np.uint64)) | np.uint64(1)

    def grams(self, text: str) -> np.ndarray:
        """The distinct shingles, sorted."""
        h = self.words.of(text)
        return np.unique(gram_hashes(h, min(self.shingle, len(h)))) if len(h) else h

    def minhashes(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
        for lo in range(0, len(grams), CHUNK):
            np.minimum(low, (grams[lo : lo + CHUNK, None] * self.factors).min(axis=0), out=low)
        return low

    def bands(self, low: np.ndarray) -> np.ndarray:
        return mixed((low * self.weights).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_shingles, fp (digest of the set), bands, bytes; none of the last three for an empty set."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("text_key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shingle)
        for b in batches:
            out = []
            for t in b.column(2):
                grams = sketcher.grams(t.as_py())
                if not len(grams):
                    out.append((0, None, None, None))
                    continue
                low = sketcher.minhashes(grams)
                digest = xxhash.xxh3_128_digest(grams.tobytes())
                out.append((len(grams), digest, sketcher.bands(low).view(np.int64), low.astype(np.uint8).tobytes()))
            types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "text_key", "n_shingles", "fp", "bands", "bytes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, fp binary, bands array<long>, bytes binary")


def sets_of(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rows: doc_id, text. fp and the whole set of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shingle)
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # a set takes more room than its text
                sets = [sketcher.grams(t.as_py()) for t in b.column(1).slice(lo, 256)]
                fps = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["fp", "set"])

    return rows.mapInArrow(run, "fp binary, set array<long>")


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, HASHES)


def not_pruned(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Positions of the pairs (a or its rows, rows of b) that pass all batches; a batch is compared for those that passed the one before."""
    left = np.arange(len(b))
    equal = np.zeros(len(b), dtype=np.int64)
    for k, low in enumerate(least):
        at = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + (b[left, at] == (a[at] if a.ndim == 1 else a[left, at])).sum(axis=1)
        passed = equal >= low
        left, equal = left[passed], equal[passed]
        if not len(left):
            break
    return left


def near_pairs(pairs: DataFrame, least: list[int]) -> DataFrame:
    """pairs: fp, to, a, b (bytes). Those (fp, to) that verification doesn't prune."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                left = not_pruned(_bytes(b.column(2)), _bytes(b.column(3)), least)
                yield b.select(["fp", "to"]).take(pa.array(left))

    return pairs.mapInArrow(run, "fp long, to long")


def similar_sets(n: str | Column, other: str | Column, both: Column, similar: int = SIMILAR) -> Column:
    """100 * intersection >= similar * union, of two sizes and the number of equal shingles."""
    return 100 * both >= similar * (F.col(n) + F.col(other) - both)


class Trees:
    """Which entries of a group are known to be linked."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def dealt(members: DataFrame, payload: DataFrame, tile: int) -> DataFrame:
    """members: group, id, base (the entry that it is linked to, or itself), failed. Groups of two have nothing left to compare.

    A group's failed entries are dealt into tiles of `tile`, all its members into chunks of four times as many. Each pair of
    a tile and a chunk has the tile's entries first (side 0), then the chunk's (side 1), so that no task holds a group. Both
    sides come from one row: where two joins met in a union, Spark could fail on their partitions when it had dealt a join anew.
    """
    count = lambda rows, n: F.ceil(rows / F.lit(n)).cast("int")
    grid = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), count(F.count(F.lit(1)), 4 * tile).alias("chunks"), count(F.count_if("failed"), tile).alias("tiles"))
    rows = members.join(grid.filter("n > 2 and tiles > 0").drop("n"), "group")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n, place: F.transform(F.sequence(F.lit(0), F.col(n) - 1), place)
    place = lambda tile, chunk, side, base: F.struct(tile.alias("tile"), chunk.alias("chunk"), F.lit(side).alias("side"), F.col(base).alias("base"))
    own = each("chunks", lambda k: place(mine("tiles"), k, 0, "id"))
    others = each("tiles", lambda k: place(k, mine("chunks"), 1, "base"))
    places = rows.select("group", "id", F.explode(F.when(F.col("failed"), F.concat(own, others)).otherwise(others)).alias("at"))
    both = places.select("group", "at.tile", "at.chunk", "at.side", "id", "at.base").join(payload, "id")
    names = ["group", "tile", "chunk", "side", "id", "base", *[c for c in payload.columns if c != "id"]]
    return both.select(*names).repartition("group", "tile", "chunk").sortWithinPartitions("group", "tile", "chunk", "side", "id")


def links_of_failed(rows: DataFrame, least: list[int], similar: int = SIMILAR) -> DataFrame:
    """rows: as from `dealt`, with bytes and perhaps set. Links (fp, to), to < fp, of the failed entries with all members of their
    group: those that join trees which weren't joined before."""
    exact = "set" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, ...] | None = None
        own: list[tuple[int, np.ndarray, np.ndarray | None]] = []
        trees = Trees()
        for b in batches:
            if not b.num_rows:
                continue
            group, tile, chunk, side, ids, base = (b.column(k).to_numpy() for k in range(6))
            sigs = _bytes(b.column(6))
            sets = [np.asarray(s.values).view(np.uint64) for s in b.column(7)] if exact else [None] * b.num_rows
            edges = np.flatnonzero(np.any([np.diff(c) != 0 for c in (group, tile, chunk, side)], axis=0)) + 1
            out = []
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                if at != (here := (group[lo], tile[lo], chunk[lo])):
                    at, own, trees = here, [], Trees()
                if side[lo] == 0:
                    own += [(int(ids[k]), sigs[k].copy(), sets[k]) for k in range(lo, hi)]
                    continue
                for me, sig, mine in own:
                    for k in not_pruned(sig, sigs[lo:hi], least).tolist():
                        other, known = int(ids[lo + k]), int(base[lo + k])
                        if other == me or trees.root(me) == trees.root(known):
                            continue
                        if not exact or overlaps(mine, sets[lo + k], similar):
                            trees.join(me, known)
                            out.append((max(me, other), min(me, other)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["fp", "to"])

    return rows.mapInArrow(run, "fp long, to long")


def overlaps(a: np.ndarray, b: np.ndarray, similar: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < similar * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similar * (small + large - both)


def candidate_links(entries: DataFrame, least: list[int], tile: int = TILE) -> DataFrame:
    """entries: id, bands, bytes. Links of entries that share a band and aren't pruned; they join what all such links join."""
    keys = entries.select("id", F.explode("bands").alias("group"))
    groups = keys.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).filter("n > 1")
    members = materialise(keys.join(groups, "group"), "members")
    bits = entries.select("id", "bytes")
    pairs = members.filter("id <> rep").select(F.col("id").alias("fp"), F.col("rep").alias("to")).distinct()
    pairs = pairs.join(bits.select(F.col("id").alias("fp"), F.col("bytes").alias("a")), "fp").join(bits.select(F.col("id").alias("to"), F.col("bytes").alias("b")), "to")
    near = materialise(near_pairs(pairs.select("fp", "to", "a", "b"), least), "near")
    linked = near.select(F.col("fp").alias("id"), F.col("to").alias("rep"), F.lit(True).alias("linked"))
    large = members.filter("n > 2").join(linked, ["id", "rep"], "left")
    large = materialise(large.select("group", "id", F.when(F.col("linked") | (F.col("id") == F.col("rep")), F.col("rep")).otherwise(F.col("id")).alias("base"), (F.col("linked").isNull() & (F.col("id") != F.col("rep"))).alias("failed")), "bases")
    more = links_of_failed(dealt(large, bits, tile), least)
    return near.unionByName(more).distinct()


def confirmed_links(clusters: DataFrame, entries: DataFrame, texts: DataFrame, least: list[int], similar: int = SIMILAR, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """clusters: id, group (its smallest id). Links whose full sets are similar; they join what all such links inside clusters join.

    texts: doc_id (the hash that entries have as text_key), text.
    """
    spark = clusters.sparkSession
    wanted = materialise(clusters.join(entries.select("id", "text_key", "fp", "bytes"), "id"), "wanted")
    keys = wanted.select(F.col("text_key").alias("doc_id"))
    passing = maybe_in(texts, keys, min(FILTER_BITS, 1 << max(10, (16 * wanted.count()).bit_length())))
    sets = sets_of(passing, shingle).groupBy("fp").agg(F.first("set").alias("set"))  # a row may be repeated, a copy pass
    sets = materialise(sets.join(wanted, "fp").select("id", "group", "bytes", "set"), "sets")
    first = sets.filter("id = group").select("group", F.col("set").alias("first_set"))
    other = F.col("id") != F.col("group")
    both = F.when(other, F.size(F.array_intersect("set", "first_set")).cast("long"))
    tried = sets.join(first, "group").select("group", "id", F.size("set").alias("n"), F.size("first_set").alias("m"), both.alias("both"))
    tried = materialise(tried.select("group", "id", (~other | similar_sets("n", "m", F.col("both"), similar)).alias("linked")), "tried")
    out = links_inside(tried, sets, least, similar, tile)
    drop_path(spark, sets)
    return out


def links_inside(tried: DataFrame, sets: DataFrame, least: list[int], similar: int, tile: int) -> DataFrame:
    """tried: group, id (all of the cluster), linked (with the smallest, or that itself). Its links, and those of the others with all."""
    near = tried.filter("linked and id <> group").select(F.col("id").alias("fp"), F.col("group").alias("to"))
    members = tried.select("group", "id", F.when(F.col("linked"), F.col("group")).otherwise(F.col("id")).alias("base"), (~F.col("linked")).alias("failed"))
    more = links_of_failed(dealt(members, sets.select("id", "bytes", "set"), tile), least, similar)
    return materialise(near.unionByName(more), "confirmed")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    least = least_matches(similar / 100)
    rows = materialise(sketches(docs, id_col, text_col, shingle).withColumn("row", F.monotonically_increasing_id()), "sketches")
    full = rows.filter("n_shingles > 0")
    distinct = materialise(full.groupBy("fp").agg(F.min("row").alias("id"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct")
    entries = full.join(distinct.select(F.col("id").alias("row")), "row").select(F.col("row").alias("id"), "text_key", "fp", "bands", "bytes")
    entries, wide = materialise(entries, "entries"), rows
    rows = materialise(rows.select("doc_id", "n_shingles", "fp"), "sizes")
    full = rows.filter("n_shingles > 0")
    drop_path(spark, wide)
    clusters = components(candidate_links(entries, least, tile)).select(F.col("fp").alias("id"), F.col("root").alias("group"))
    texts = docs.select(F.xxhash64(F.col(id_col), text_or_empty(text_col)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    roots = components(confirmed_links(clusters, entries, texts, least, similar, shingle, tile)).select(F.col("fp").alias("id"), "root")
    tree = distinct.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    low = tree.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = materialise(tree.join(low, "root").select("fp", "n", "component_id"), "classes")
    out = with_class(full.select("doc_id", "n_shingles", "fp"), by_fp).select("doc_id", "n_shingles", "component_id")
    none = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
