"""URL rules by a bit-parallel wildcard automaton.

All glob patterns are packed, one after another, into the bits of a few 64-bit words. Each byte of a canonical URL moves
all patterns of all URLs of a batch by one step: shift, mask by the byte, keep the bits that wait in a wildcard
(multiword Shift-And). `*` stands for any bytes but `/`, `**` for any bytes.

The canonical URL is `.host/path`: the host lies after the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower
case; the path follows up to `?`, `#` or the end. A rule `com/en/` becomes `*.com/en/**`.

Defined results: a null url, or one without `://`, has an empty host and path and fits no rule; a url of any length is
read to its end; a null id is an id like others; repeated rows are judged alike; of rules of one length that fit, the one
that stands first counts; an empty table gives an empty result; columns other than the id and the url are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: URLs simulated together.
LANES = 4096


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


class GlobAutomaton:
    """Masks for a list of globs. Bit k of a pattern is set when its first k literal bytes have been read."""

    def __init__(self, globs: list[str]):
        bits: list[tuple[int | None, str]] = []  # the byte that leads to the bit, the wildcard that keeps it
        first, last = [], []
        for glob in globs:
            first.append(len(bits))
            bits.append((None, ""))
            parts = [p for p in glob.replace("**", "\0").replace("*", "\1")]
            for p in parts:
                if p in "\0\1":
                    bits[-1] = (bits[-1][0], "".join(sorted(bits[-1][1] + p)))
                else:
                    bits += [(b, "") for b in p.encode()]
            last.append(len(bits) - 1)
        self.words = max(1, math.ceil(len(bits) / 64))
        self.start = self._mask(first)
        self.last = [(b // 64, np.uint64(b % 64)) for b in last]
        self.step = np.stack([self._mask([k for k, (b, _) in enumerate(bits) if b == c]) for c in range(256)])
        free, local = [k for k, (_, w) in enumerate(bits) if "\0" in w], [k for k, (_, w) in enumerate(bits) if "\1" in w]
        self.wait = np.stack([self._mask(free + (local if c != ord("/") else [])) for c in range(256)])

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = [0] * self.words
        for b in bits:
            out[b // 64] |= 1 << (b % 64)
        return np.array(out, dtype=np.uint64)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """A row per text, a column per glob: whether the glob fits the whole text."""
        out = np.zeros((len(texts), len(self.last)), dtype=bool)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for lo in range(0, len(texts), LANES):
            self._run([texts[i] for i in order[lo : lo + LANES]], order[lo : lo + LANES], out)
        return out

    def _run(self, texts: list[bytes], rows: np.ndarray, out: np.ndarray) -> None:
        lengths = np.array([len(t) for t in texts])
        data, starts = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for k in range(int(lengths[0]) if len(texts) else 0):
            alive = int(np.searchsorted(-lengths, -k, side="left"))  # the longest come first
            byte, now = data[starts[:alive] + k], state[:alive]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:alive] = (moved & self.step[byte]) | (now & self.wait[byte])
        for g, (word, bit) in enumerate(self.last):
            out[rows, g] = (state[:, word] >> bit) & one


def host_of(url: str) -> Column:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: its id, host, path, rule (null if none fits) and verdict. The longest rule wins."""
    urls = pages.select(F.col(id_col), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = GlobAutomaton([r.glob for r in ranked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            hit = automaton.matches([f".{h}{p}".encode() for h, p in zip(hosts, paths, strict=True)])
            best = np.where(hit.any(axis=1), hit.argmax(axis=1), -1).tolist()
            rule = pa.array([ranked[k].name if k >= 0 else None for k in best], pa.string())
            verdict = pa.array([ranked[k].verdict if k >= 0 else default for k in best], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], names=[*b.schema.names, "rule", "verdict"])

    kind = urls.schema[id_col].dataType.simpleString()
    return urls.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
