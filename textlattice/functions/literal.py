"""Conversions for typed text: romaji to kana, word breaks and byte codes over Arrow, kana cycles as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# The rows of the syllabary by consonant, for the vowels a i u e o.
_ROWS = {
    "": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも",
    "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "x": "ぁぃぅぇぉ",
}
_SPECIAL = {"ya": "や", "yu": "ゆ", "yo": "よ", "wa": "わ", "wo": "を", "nn": "ん", "n'": "ん", "shi": "し", "chi": "ち", "tsu": "つ", "fu": "ふ", "ji": "じ", "xtu": "っ", "-": "ー"}


def romaji_table() -> dict[str, str]:
    """All spellings, from the rows: each consonant with each vowel, and with a glide before a small kana."""
    out = {c + v: row[k] for c, row in _ROWS.items() for k, v in enumerate("aiueo")}
    for c, row in _ROWS.items():
        if c and c != "x":
            out |= {f"{c}y{v}": row[1] + small for v, small in zip("auo", "ゃゅょ", strict=True)}
    for c, kana in (("sh", "し"), ("ch", "ち"), ("j", "じ")):
        out |= {c + v: kana + small for v, small in zip("auo", "ゃゅょ", strict=True)}
    return out | _SPECIAL


_TABLE = romaji_table()
_LONGEST = max(map(len, _TABLE))


def romaji_pieces(text: str) -> list[tuple[int, int, str]]:
    """(start, length, kana) of all that is converted: the longest spelling at each place, a small tsu for the first of
    doubled consonants, n before a consonant."""
    out, at, low = [], 0, text.lower()
    while at < len(text):
        size = next((n for n in range(_LONGEST, 0, -1) if low[at : at + n] in _TABLE and at + n <= len(text)), 0)
        if size:
            out.append((at, size, _TABLE[low[at : at + size]]))
        elif at + 1 < len(text) and low[at] == low[at + 1] and low[at] in "kstcphgzdbjfmrwy":
            out.append((at, 1, "っ"))
        elif low[at] == "n" and at + 1 < len(text) and low[at + 1].isalpha() and low[at + 1] not in "aiueoy":
            out.append((at, 1, "ん"))
        at += size or 1
    return out


def romaji_to_kana(text: str) -> str:
    """The text with its pieces converted; what isn't a spelling stays."""
    out, at = [], 0
    for start, size, kana in romaji_pieces(text):
        out += [text[at:start], kana]
        at = start + size
    return "".join([*out, text[at:]])


def edits_before_caret(text: str) -> list[tuple[int, int, str]]:
    """The pieces from the last to the first, so that applying one doesn't move those still to come."""
    return romaji_pieces(text)[::-1]


def break_words(text: str) -> list[str]:
    """Runs of letters and digits (with inner apostrophes and hyphens), and single other marks; spaces part them."""
    return re.findall(r"[^\W_]+(?:['’-][^\W_]+)*|[^\w\s]|_", text)


# Fixed values of the format: value bits of a number of 1 to 5 bytes, and of its first byte.
_BITS, _FIRST = (7, 13, 19, 25, 32), (7, 6, 5, 4, 4)


def put_varint(value: int) -> bytes:
    """An unsigned 32-bit number in 1 to 5 bytes: the first byte's leading ones tell how many follow, with seven bits each."""
    size = next(n for n, bits in enumerate(_BITS, 1) if value < 1 << bits)
    if size == 1:
        return bytes([value])
    lead = 0x100 - (1 << (9 - size))
    return bytes([lead | value >> 7 * (size - 1), *(0x80 | value >> 7 * k & 0x7F for k in reversed(range(size - 1)))])


def get_varint(data: bytes) -> tuple[int, int]:
    """(value, bytes read). Bytes that follow the first have their highest bit set."""
    size = 1 + next((k for k in range(4) if not data[0] << k & 0x80), 4)
    value, rest = data[0] & (1 << _FIRST[size - 1]) - 1, data[1:size]
    if len(rest) < size - 1 or any(x < 0x80 for x in rest):
        raise ValueError("a number that isn't complete")
    for x in rest:
        value = value << 7 | x & 0x7F
    return value, size


# Fixed values of the format: the kinds of a tree's nodes.
_NUMBER, _PAIR, _ARRAY, _BYTES = range(4)


def put_tree(node: int | tuple | list | bytes | str) -> bytes:
    """A tree as bytes, each node after its kind: numbers, pairs (tuples), arrays (lists), bytes; a text is UTF-16 bytes."""
    if isinstance(node, int):
        return put_varint(_NUMBER) + put_varint(node & 0xFFFFFFFF)
    if isinstance(node, tuple):
        first, second = node
        return put_varint(_PAIR) + put_tree(first) + put_tree(second)
    if isinstance(node, list):
        return put_varint(_ARRAY) + put_varint(len(node)) + b"".join(map(put_tree, node))
    raw = node.encode("utf-16-le") if isinstance(node, str) else node
    return put_varint(_BYTES) + put_varint(len(raw)) + raw


def get_tree(data: bytes, at: int = 0) -> tuple[int | tuple | list | bytes, int]:
    """(the tree that starts at `at`, where it ends). Numbers are signed; a kind's higher bits, a field's name, are left out."""

    def number() -> int:
        nonlocal at
        value, size = get_varint(data[at : at + 5])
        at += size
        return value

    def below() -> int | tuple | list | bytes:
        nonlocal at
        out, at = get_tree(data, at)
        return out

    kind = number() & 3
    if kind == _NUMBER:
        value = number()
        return value - ((value >> 31) << 32), at
    if kind == _PAIR:
        return (below(), below()), at
    size = number()
    if kind == _ARRAY:
        return [below() for _ in range(size)], at
    if at + size > len(data):
        raise ValueError("bytes that aren't complete")
    return data[at : at + size], at + size


# Characters that a repeated key goes through, and those of the key for small and voiced ones.
NEXT = ("あいうえお", "かきくけこ", "さしすせそ", "たちつてと", "なにぬねの", "はひふへほ", "まみむめも", "やゆよ", "らりるれろ", "わをんー", "、。?")
VARIANTS = (
    "あぁ", "いぃ", "うぅゔ", "えぇ", "おぉ", "かが", "きぎ", "くぐ", "けげ", "こご", "さざ", "しじ", "すず", "せぜ", "そぞ",
    "ただ", "ちぢ", "つっづ", "てで", "とど", "はばぱ", "ひびぴ", "ふぶぷ", "へべぺ", "ほぼぽ", "やゃ", "ゆゅ", "よょ", "わゎ",
)


def cycle_last(c: Column, cycles: tuple[str, ...] = NEXT, back: bool = False) -> Column:
    """The text with the next (or the one before) of its cycle for its last character; one without a cycle stays."""
    here, there = "".join(cycles), "".join(x[1:] + x[:1] for x in cycles)
    return F.concat(F.substr(c, F.lit(1), F.length(c) - 1), F.translate(F.right(c, F.lit(1)), *((there, here) if back else (here, there))))


def tapped(c: Column, label: Column, repeated: Column) -> Column:
    """The text after a key: a repeated one turns the last character on if it has a cycle, others add their label."""
    known = F.right(c, F.lit(1)).isin(*"".join(NEXT))
    return F.when(repeated & known, cycle_last(c)).otherwise(F.concat(c, label))


def to_kana(c: Column) -> Column:
    return pandas_udf(lambda s: s.map(romaji_to_kana, na_action="ignore"), "string")(c)


def romaji_edits(c: Column) -> Column:
    """edits_before_caret as an array of structs (start, length, kana)."""
    kind = "array<struct<start:int,length:int,kana:string>>"
    return pandas_udf(lambda s: s.map(lambda x: [dict(zip(("start", "length", "kana"), e, strict=True)) for e in edits_before_caret(x)], na_action="ignore"), kind)(c)


def words_of(c: Column) -> Column:
    return pandas_udf(lambda s: s.map(break_words, na_action="ignore"), "array<string>")(c)


def varint(c: Column) -> Column:
    return pandas_udf(lambda s: s.map(put_varint, na_action="ignore"), "binary")(c)


def tree(c: Column) -> Column:
    """Bytes of an array of texts as a tree."""
    return pandas_udf(lambda s: s.map(lambda x: put_tree([*x]), na_action="ignore"), "binary")(c)


def tree_texts(c: Column) -> Column:
    """The texts of a tree that is an array of them."""
    return pandas_udf(lambda s: s.map(lambda x: [t.decode("utf-16-le") for t in get_tree(bytes(x))[0]], na_action="ignore"), "array<string>")(c)
