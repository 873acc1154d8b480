"""Best-fit packing of token sequences, planned on a histogram of lengths.

Every text is tokenised once; its pieces are written to the shared folder with their lengths. The plan is made on the
driver from the count of pieces of each length, never from the pieces: best-fit decreasing moves whole groups of equal
pieces into groups of equally full sequences. A piece then takes its planned slot by joining on its rank within its
length; ranks are made from counts of small groups, to which pieces are dealt by a number of their own, so that neither a
frequent length nor repeated rows are ever sorted in one task.

The vocabulary is the `tokenizers` file. Offline, on the driver, it's proven that its merges make the ids in order; then a
pre-token's ids depend on the ranks of byte strings alone, and a faster encoder of these gives the library's ids.

Defined results: a null text is empty and has the end id only; a null id is an id like others; repeated rows are packed
once each; which of equally long pieces takes which slot follows the order of rows; a very long text is cut into pieces in
one task, without a copy of it anywhere else; an empty table gives an empty result; columns other than the id and the text
are not looked at.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textlattice.llm.common import materialise, text_or_empty

CAPACITY, END = 1024, 2
CACHED, CACHED_CHARS = 200_000, 48
#: Pieces of one length are ranked in groups of about so many, or in the largest number of groups.
GROUP, GROUPS = 200, 100_000
#: White space as Unicode has it; Python's \s holds four more characters.
SPACES = "\t-\r \x85\xa0  -     　"


def _class(kind: str, below: int) -> str:
    """The characters below a code point whose Unicode category starts with `kind`, as ranges of a character class."""
    codes = [c for c in range(below) if unicodedata.category(chr(c))[0] == kind]
    out, start = "", None
    for c, after in zip(codes, [*codes[1:], -1], strict=True):
        start = c if start is None else start
        if after != c + 1:
            out, start = out + f"{re.escape(chr(start))}-{re.escape(chr(c))}", None
    return out


def _pattern(letters: str, numbers: str) -> str:
    """The vocabulary's public pre-token pattern, with its classes written out."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def byte_of_letter() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def prove(path: str) -> dict:
    """What encoding needs of a `tokenizers` file: byte strings with their ranks, and special strings with their ids."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, pre = whole["model"], whole["pre_tokenizer"]
    plain = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
    if model["type"] != "BPE" or any(model.get(k) for k in plain) or whole["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
        raise ValueError("not a plain byte-level vocabulary")
    letters, vocab = byte_of_letter(), model["vocab"]
    bytes_of = {t: bytes(letters[c] for c in t) for t in vocab if all(c in letters for c in t)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab["".join(m)] for m in merges]
    singles = {bytes_of[t] for t in vocab if len(t) == 1}
    if made != sorted(made) or len(singles) != 256 or len(made) + 256 != len(bytes_of) or max(vocab[t] for t in vocab if len(t) == 1) > made[0]:
        raise ValueError("ids aren't in the order of the merges; ranks would give other tokens")
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in whole["added_tokens"]):
        raise ValueError("special strings take more than themselves")
    return {"ranks": {b: vocab[t] for t, b in bytes_of.items() if t not in special}, "special": special}


class Encoder(dict):
    """Ids of texts as little-endian 32-bit bytes, from a bounded cache of pre-tokens."""

    LATIN = 0x250

    def __init__(self, proof: dict):
        public = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("pieces", pat_str=public, mergeable_ranks=proof["ranks"], special_tokens={})
        self.latin = re.compile(_pattern(_class("L", self.LATIN), _class("N", self.LATIN)))
        self.any = regex.compile(_pattern(r"\p{L}", r"\p{N}"))
        self.other = re.compile(f"[^\0-{chr(self.LATIN - 1)}]")
        self.special = {k: np.array([v], dtype="<u4").tobytes() for k, v in proof["special"].items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, pre: str) -> bytes:
        ids = np.array(self.bpe.encode_ordinary(pre), dtype="<u4").tobytes()
        if len(pre) <= CACHED_CHARS:
            if len(self) > CACHED:
                self.clear()
            self[pre] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, without an end id; a special string is one token, as the library's default has it."""
        out = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                pattern = self.any if self.other.search(part) else self.latin
                out.append(b"".join(map(self.__getitem__, pattern.findall(part))))
        return b"".join(out)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all are full but the first, which may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, row (a number of its own)."""
    proof = docs.sparkSession.sparkContext.broadcast(prove(vocabulary))  # as long as the vocabulary
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(proof.value)
        for b in batches:
            at, out = [], []
            for k, text in enumerate(b.column(1)):
                ids = encoder.ids(text.as_py()) + tail
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(k)
                    out.append((piece, start, length, zlib.crc32(ids[start * 4 : (start + length) * 4])))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *arrays], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("row", F.monotonically_increasing_id())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, first rank, last rank + 1, first sequence, offset).

    A group of sequences with equal room is a run of numbers; a step moves as many pieces of one length as there are
    sequences in the group with the least room that suffices. The number of steps depends on the lengths, not on N.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    out, made = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            r = next((r for r in range(length, capacity + 1) if room[r]), None)
            if r is None:
                n = -(-left // (capacity // length))
                room[capacity].append((made, n))
                made, r = made + n, capacity
            first, n = room[r].pop()
            k = min(n, left)
            out.append((length, rank, rank + k, first, capacity - r))
            if k < n:
                room[r].append((first + k, n - k))
            room[r - length].append((first, k))
            rank, left = rank + k, left - k
    return out


def ranked(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with their rank within their length. No task sorts more than a group of a length.

    counts: length, n; a row for each length up to the capacity, so that it can be broadcast.
    """
    groups = F.least(F.lit(GROUPS), F.ceil(F.col("n") / GROUP)).cast("int")
    rows = rows.join(F.broadcast(counts.select("length", groups.alias("groups"))), "length")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.col("groups"))).drop("groups")
    sizes = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(W.partitionBy("length", "part").orderBy("row"))
    return rows.withColumn("own", own).join(sizes, ["length", "part"]).withColumn("rank", F.col("base") + F.col("own") - 1)


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = materialise(pieces(docs, vocabulary, id_col, text_col, capacity, end), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    steps = plan(counts, capacity)
    by_length = spark.createDataFrame(sorted(counts.items()), "length long, n long")
    slots = spark.createDataFrame(steps, "length long, lo long, hi long, first long, offset long")
    # The plan has a few steps for each of at most `capacity` lengths, whatever the number of documents.
    joined = ranked(rows, by_length).join(F.broadcast(slots.withColumnRenamed("length", "l")), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
