"""Token counts of whole texts by a sentencepiece BPE vocabulary, with a whole-token shortcut.

Offline, on the driver, each vocabulary string is encoded alone; those that come out as exactly one token are proven and
count as 1 wherever they stand as a whole pre-token. Pre-tokens are cut where no merge can cross: the vocabulary is
searched for strings that hold a non-space before a space, or a line feed beside another character; where there are
none, a text's tokens are the sum of its pre-tokens' tokens. Only pre-tokens that aren't proven are merged, once for
each worker's bounded cache.

Defined results: a null text is empty and has 0 tokens; strings of special tokens in a text are ordinary text, as the
library's default has it; very long pre-tokens are merged but not cached; repeated rows are counted alike; a null id is an
id like others; columns other than the id and the text are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlattice.llm.common import text_or_empty

LIMIT = 4096
CACHED, CACHED_CHARS = 300_000, 48
SPACE_MARK = "▁"


def prove(model: str) -> dict:
    """What the counting needs to know of the vocabulary: proven whole tokens, and where merges cannot cross."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
    if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces):
        raise ValueError("a vocabulary string has a space after another character; pre-tokens would not be independent")
    if sp.normalize("a  b\n① ") != f"{SPACE_MARK}a{SPACE_MARK * 2}b\n①{SPACE_MARK}":
        raise ValueError("the model normalises texts; pre-tokens would not be independent")
    lines = not any("\n" in p for p in pieces)
    # A pre-token is a space and a word; alone, the word gets the space by the library's own prefix.
    words = [p[1:] for p in pieces if p[0] == SPACE_MARK and SPACE_MARK not in p[1:] and len(p) > 1 and "\n" not in p]
    proven = {f" {w}" for w, ids in zip(words, sp.encode(words), strict=True) if len(ids) == 1}
    return {"proven": frozenset(proven), "lines": lines}


class Counter(dict):
    """Tokens of a pre-token; what isn't known is merged by the library and kept, up to a bound."""

    def __init__(self, model: str, proof: dict):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.proven = dict.fromkeys(proof["proven"], 1)
        self.update(self.proven)
        self.lines = proof["lines"]
        self.pre = re.compile(r" *[^ \n]+|\n| +" if self.lines else r" *[^ ]+| +")

    def __missing__(self, pre: str) -> int:
        if pre == "\n" and self.lines:
            n = len(self.sp.encode("\n")) - 1  # without the prefix's own token
        elif pre[0] == " ":
            n = len(self.sp.encode(pre[1:]))  # the library's prefix is the first space
            n = n if len(pre) > 1 else len(self.sp.encode("a ")) - 1
        else:  # it stands after a line feed
            n = len(self.sp.encode("\n" + pre)) - len(self.sp.encode("\n"))
        if len(pre) <= CACHED_CHARS:
            if len(self) > CACHED + len(self.proven):
                self.clear()
                self.update(self.proven)
            self[pre] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        # The library writes a space as this mark, so that the two are the same to it.
        return sum(map(self.__getitem__, self.pre.findall(" " + text.replace(SPACE_MARK, " "))))


def count_tokens(spark: SparkSession, docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: its id, n_bytes, n_tokens, over_limit. The scan is the only stage."""
    proof = spark.sparkContext.broadcast(prove(model))  # at most as long as the vocabulary
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model, proof.value)
        for b in batches:
            n = pa.array([counter.count(x.as_py()) for x in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
