"""Column functions on text: folds, predicates, character types, URLs. All are built-in expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = "[^a-zA-Z0-9À-ÿ]+"
#: The same class letter by letter: Java looks these up in a table of bits, but tries ranges one after another at each character.
_BREAK = "[^" + "".join(c for c in map(chr, range(256)) if not re.match(TOKEN_BREAK, c)) + "]+"
LETTER = "[A-Za-zÀ-ÿ]"
#: Marks after which a sentence ends.
TERMINATORS = "[.!?。！？]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACCENTS, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Small kana and voiced kana stand at the same distance in both syllabaries, so the fold is a shift by a rule.
HIRAGANA = "".join(chr(c) for c in range(0x3041, 0x3097))
KATAKANA = "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))
ASCII = "".join(chr(c) for c in range(0x21, 0x7F))
FULL_WIDTH = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_text(c: str | Column) -> Column:
    return F.lower(_col(c))


def tokens(c: str | Column) -> Column:
    """Lower-case words as an array."""
    return F.filter(F.split(F.lower(_col(c)), _BREAK), lambda x: x != "")


def reading_of(c: str | Column) -> Column:
    """The reading of a display form: its letters without accents."""
    return F.translate(_col(c), ACCENTS, PLAIN)


def pos_of(c: str | Column) -> Column:
    """A deterministic part of speech, from length and ending."""
    w = _col(c)
    ends = lambda *parts: reduce(or_, [F.endswith(w, F.lit(x)) for x in parts])
    return (
        F.when(is_number(w), "num")
        .when(F.length(w) <= 2, "func")
        .when(ends("ing", "ed", "er", "en"), "verb")
        .when(ends("tion", "heit", "keit", "ment", "dad"), "noun")
        .when(ends("ly", "lich", "eux", "oso"), "mod")
        .otherwise("other")
    )


def is_number(c: str | Column) -> Column:
    """Whether a word begins with a digit: it stands from 0 up to the mark after 9."""
    return (_col(c) >= "0") & (_col(c) < ":")


def kata_to_hira(c: str | Column) -> Column:
    return F.translate(_col(c), KATAKANA, HIRAGANA)


def to_fullwidth(c: str | Column) -> Column:
    """ASCII as full-width forms, and the space as the ideographic one."""
    return F.translate(_col(c), ASCII + " ", FULL_WIDTH + "　")


def replace_nbsp(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), "&nbsp;", "　")


def normalize_space(c: str | Column) -> Column:
    """Runs of white space become one space; bars, which the class has always held, go as well."""
    return F.trim(F.regexp_replace(_col(c), "[\r\n\t |]+", " "))


def verdict(c: str | Column, ng: list[str], suppress: list[str]) -> Column:
    """1 if the text has a banned term, else 2 if it has a suppressed one, else 0."""
    hit = lambda terms: F.greatest(F.lit(False), *[F.contains(_col(c), F.lit(t)) for t in terms], F.lit(False))
    return F.when(hit(ng), 1).when(hit(suppress), 2).otherwise(0)


def script_share_ok(c: str | Column, cls: str = LETTER, num: int = 2, den: int = 3) -> Column:
    """Whether a text has letters of the class, and at least num/den of its length, in whole numbers."""
    n = F.regexp_count(_col(c), F.lit(cls))
    return (n > 0) & (n >= F.floor(F.length(_col(c)) * num / den))


def is_valid_url(c: str | Column) -> Column:
    """Up to 1,700 characters, an authority of up to 256, ASCII only."""
    url = _col(c)
    authority = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return (F.length(url) <= 1700) & (authority != "") & (F.length(authority) <= 256) & ~url.rlike("[^\\x00-\\x7F]")


def url_host(c: str | Column) -> Column:
    return F.regexp_extract(_col(c), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def url_left_part(c: str | Column, part: str = "path") -> Column:
    """The URL up to its path (without query and fragment), or up to its query."""
    return F.regexp_replace(_col(c), "[?#].*$" if part == "path" else "#.*$", "")


def reduce_host(c: str | Column) -> Column:
    """The host without its first label, unless the first dot stands first, or within the last six characters."""
    host = F.regexp_replace(_col(c), "^[a-z]+://", "")
    dot = F.instr(host, ".") - 1
    return F.when((dot <= 0) | (dot >= F.length(host) - 6), host).otherwise(F.substring(host, dot + 2, F.length(host)))


def char_type(c: str | Column) -> Column:
    """space, alpha, digit, punct, control or other, of the first character; other for an empty text."""
    x = _col(c)
    return (
        F.when(x.rlike("^ "), "space")
        .when(x.rlike("^[A-Za-z]"), "alpha")
        .when(x.rlike("^[0-9]"), "digit")
        .when(x.rlike("^[.,!?]"), "punct")
        .when(x.rlike("^[\\x01-\\x1f]"), "control")
        .otherwise("other")
    )


def need_store(last: str | Column, nxt: str | Column) -> Column:
    """Whether the words before the caret go into the history: there is a last character, and the next one is a mark or
    begins a run of another type."""
    before, after = char_type(last), char_type(nxt)
    return (_col(last) != "") & ((after == "punct") | (after.isin("alpha", "digit", "other") & (before != after)))


def is_next_word(nxt: str | Column) -> Column:
    """Whether a whole next word can be predicted: the next character doesn't go on with a word."""
    return char_type(nxt).isin("space", "punct", "other")


def spaced_words(c: str | Column) -> Column:
    """The words before the caret, an array of structs (word, space_before, space_after): runs of letters, runs of digits,
    single marks. What stands before the first space may be cut, so it is left out; a piece with any other character drops
    all words up to the next space."""
    rest = F.regexp_replace(F.regexp_replace(_col(c), "^[^ ]*", ""), "(?s)^.*[^ A-Za-z0-9.,!?][^ ]*", "")
    heads, words = (F.regexp_extract_all(rest, F.lit("( ?)([A-Za-z]+|[0-9]+|[.,!?])"), F.lit(k)) for k in (1, 2))
    before = F.transform(heads, lambda h: h == " ")
    after = F.slice(F.concat(F.slice(before, 2, F.greatest(F.size(heads), F.lit(1))), F.array(rest.endswith(" "))), F.lit(1), F.size(words))
    # arrays side by side: one that a function of each word looks into would be made anew for each
    spaces = F.zip_with(before, after, lambda x, y: F.struct(x.alias("before"), y.alias("after")))
    return F.zip_with(words, spaces, lambda w, x: F.struct(w.alias("word"), x["before"].alias("space_before"), x["after"].alias("space_after")))


def time_bucket(ts: str | Column) -> Column:
    """The time in units of 64 seconds."""
    return F.floor(F.unix_timestamp(_col(ts)) / 64).cast("long")


def split_time(c: str | Column) -> tuple[Column, Column]:
    """(low, high) unsigned 32-bit halves of a 64-bit time."""
    x = _col(c).cast("long")
    return x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)


def join_time(lo: str | Column, hi: str | Column) -> Column:
    return F.shiftleft(_col(hi).cast("long"), 32).bitwiseOR(_col(lo).cast("long"))


def varint_len(c: str | Column) -> Column:
    """Bytes of an unsigned 32-bit number: 7, 13, 19, 25 or 32 bits."""
    x = _col(c).cast("long")
    return F.when(x < 1 << 7, 1).when(x < 1 << 13, 2).when(x < 1 << 19, 3).when(x < 1 << 25, 4).otherwise(5)


def log_add(a: str | Column, b: str | Column) -> Column:
    """ln(exp(a) + exp(b)); an `a` of 0 stands for nothing yet."""
    x, y = _col(a), _col(b)
    return F.when(x == 0, y).otherwise(F.greatest(x, y) + F.log1p(F.exp(F.least(x, y) - F.greatest(x, y))))


def finite(c: str | Column) -> Column:
    """The number itself; a job with a number that is none, or without end, fails."""
    x = _col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("a number that isn't finite")).cast("double")).otherwise(x)


def file_timestamp(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "yyyyMMdd-HHmmss")


def phrase_text(arr: str | Column, field: str, space_flag: str = "space_after") -> Column:
    """The texts of a phrase's primitives; a space where a primitive asks for one after it."""
    step = lambda acc, x: F.concat(acc, x[field], F.when(x[space_flag], F.lit(" ")).otherwise(F.lit("")))
    return F.rtrim(F.aggregate(_col(arr), F.lit(""), step))


def phrase_flags(arr: str | Column) -> Column:
    """First primitive's opening flag (bit 0) with the last primitive's closing flag (bit 1)."""
    first, last = F.element_at(_col(arr), 1)["flags"], F.element_at(_col(arr), -1)["flags"]
    return first.bitwiseAND(F.lit(1)).bitwiseOR(last.bitwiseAND(F.lit(2)))


def map_get(c: str | Column, key: str) -> Column:
    return F.try_element_at(_col(c), F.lit(key))


def map_put(c: str | Column, key: str, value: Column) -> Column:
    """The map with key set; an old value of the key goes."""
    return F.map_concat(F.map_filter(_col(c), lambda k, _: k != key), F.create_map(F.lit(key), value))
