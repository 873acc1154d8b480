"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Two states, toxic and other, over the words of a sentence. A word's emission is the sum of the weights of its lower-case
form and its prefixes; transitions make spans. Word labels come from document labels: in toxic training documents the
words are tagged whose form or prefix is far more frequent there than in clean ones. The field is fitted on them by
gradient steps on its log-likelihood, with forward-backward for the expectations, on the driver and on a bounded sample
of labelled rows (SAMPLE of each class, of at most LONGEST characters). Scoring runs over all whole texts in one scan:
forward-backward for all sentences of a batch at once gives each word's marginal; their largest and their sum give the
document's score, by a logistic curve that is fitted on the same sample.

Chains are sentences, cut at line feeds and . ! ?. A sentence of more than PIECE words is handled in pieces, whose
messages are carried on through each piece's product of moves: the marginals are those of the whole sentence.

Of the sample, texts that share their words with the two smallest hashes are taken as near copies, and one of each such
group is fitted on; texts of under 100 characters are all taken.

Defined results: a null or empty text has no words and the score of such; a null id is in neither fold's training
rows; where the sample has no text of one of the classes, or no words, all scores are 0; a score equal to the threshold is
predicted as toxic; of rows with one labelled id the smallest text is learnt from; repeated rows are scored alike; an
empty table gives an empty result; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlattice.llm.common import text_or_empty

SAMPLE = (1500, 3000)  # toxic, clean
LONGEST = 40_000
PIECE = 256
FEWEST = 3  # documents of the sample that a feature needs
SEED_LOG_ODDS = 2.5
LEAST_GAIN = 2.0  # documents that a tagging feature has to explain beyond the ones chosen before it
STEPS = 30
THRESHOLD = 0.3
SPAN = 0.5
CACHED = 400_000
HELD_OUT = "coalesce(pmod(crc32(cast({} as string)), 4) = 2, false)"
_TOKENS = re.compile(r"[^\W_]+|[.!?\n]")
_BREAKS = frozenset(".!?\n")


def features_of(word: str) -> list[str]:
    w = word.lower()
    return [f"={w}", *[w[:k] for k in range(3, min(8, len(w)))]]


def one_of_each(texts: list[str]) -> list[int]:
    """Positions of texts, one of each group of near copies: those that share their words with the two smallest hashes."""
    seen, out = set(), []
    for k, text in enumerate(texts):
        key = tuple(sorted({zlib.crc32(w.encode()) for w in _TOKENS.findall(text)})[:2])
        if key not in seen or len(text) < 100:
            out.append(k)
        seen.add(key)
    return out


def explaining(docs: list[list[int]], n: int) -> list[int]:
    """Features that explain the toxic documents. docs: the features of each that are rare in clean documents.

    The feature with the most documents goes first; a document counts half as much for each feature that it has among
    those chosen. So words that stand in toxic documents by chance, beside others that explain them, aren't chosen.
    """
    feature = np.array([f for d in docs for f in d], dtype=np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    order = np.argsort(feature, kind="stable")
    docs_of = np.split(doc[order], np.cumsum(np.bincount(feature, minlength=n))[:-1]) if n else []
    weight, out = np.ones(len(docs)), []
    while n:
        gain = np.bincount(feature, weights=weight[doc], minlength=n)
        gain[out] = 0
        best = int(gain.argmax())
        if gain[best] < LEAST_GAIN:
            break
        out.append(best)
        weight[docs_of[best]] /= 2
    return out


def chains(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, whether it goes on from the one before) of pieces of the runs between breaks, none longer than PIECE."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], breaks, [True]])))
    starts, ends = edge[::2], edge[1::2]
    pieces = -(-(ends - starts) // PIECE)
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    place = np.arange(len(first)) - first
    starts, ends = np.repeat(starts, pieces) + place * PIECE, np.repeat(ends, pieces)
    return starts, np.minimum(ends - starts, PIECE), place > 0


def carried(odds: np.ndarray, starts: np.ndarray, lengths: np.ndarray, move: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The messages that enter each piece from the left and from the right, 0 and 1 at a sentence's ends.

    A word turns a message f into (a f + b) / (c f + d), so that a piece does by the product of its words' matrices; for
    the messages from the right it is the transposed product.
    """
    left, right = np.zeros(len(starts)), np.ones(len(starts))
    own = np.flatnonzero(goes_on | np.append(goes_on[1:], False))
    if not len(own):
        return left, right
    product = np.tile(np.eye(2), (len(own), 1, 1))
    for t in range(int(lengths[own].max())):
        live = lengths[own] > t
        o = odds[starts[own[live]] + t]
        word = np.stack([np.stack([o * move[1, 1], o * move[0, 1]], -1), np.stack([np.full(len(o), move[1, 0]), np.full(len(o), move[0, 0])], -1)], -2)
        new = word @ product[live]
        product[live] = new / new.max(axis=(1, 2), keepdims=True)
    at = dict(zip(own.tolist(), product.tolist(), strict=True))
    for k in own.tolist():
        if goes_on[k]:
            (a, b), (c, d) = at[k - 1]
            left[k] = (a * left[k - 1] + b) / (c * left[k - 1] + d)
    for k in reversed(own.tolist()):
        if k + 1 < len(starts) and goes_on[k + 1]:
            (a, c), (b, d) = at[k + 1]
            right[k] = (a * right[k + 1] + b) / (c * right[k + 1] + d)
    return left, right


def forward_backward(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, move: np.ndarray, count_moves: bool = True, goes_on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state for each word, and expected moves between states over all chains.

    e: log odds of a word's emission. move: exp of the move scores, [from][to], state 0 other, state 1 toxic. goes_on: which
    pieces belong to the sentence of the piece before. With two states the forward and backward messages are ratios, toxic
    to other. All pieces go one step at a time, the longest first, so that the ones that go on are a prefix.
    """
    odds = np.exp(np.clip(e, -30, 30))
    goes_on = np.zeros(len(starts), bool) if goes_on is None else goes_on
    left, right = carried(odds, starts, lengths, move, goes_on)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, left, right, goes_on = starts[order], lengths[order], left[order], right[order], goes_on[order]
    (m00, m01), (m10, m11) = move.tolist()
    fwd, bwd = np.zeros(len(e)), np.ones(len(e))
    bwd[starts + lengths - 1] = right
    alive = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
    for t, n in enumerate(alive):
        at = starts[:n] + t
        before = fwd[at - 1] if t else left[:n]  # a sentence starts as if after another word
        fwd[at] = odds[at] * (m01 + m11 * before) / (m00 + m10 * before)
    for t in range(len(alive) - 1, 0, -1):
        at = starts[: alive[t]] + t
        after = odds[at] * bwd[at]
        bwd[at - 1] = (m10 + m11 * after) / (m00 + m01 * after)
    p = fwd * bwd
    p = p / (1 + p)
    moves = np.zeros((2, 2))
    if count_moves and len(starts):
        inner, first = fwd > 0, starts[~goes_on]
        inner[first] = False
        at = np.flatnonzero(inner)
        before, after = fwd[at - 1], odds[at] * bwd[at]
        parts = np.stack([np.full(len(at), m00), m01 * after, m10 * before, m11 * before * after])
        moves = (parts / parts.sum(axis=0)).sum(axis=1).reshape(2, 2)
        moves[0] += [(1 - p[first]).sum(), p[first].sum()]
    return p, moves


class Field:
    """The fitted weights."""

    def __init__(self, weights: dict[str, float], bias: float, move: np.ndarray, curve: np.ndarray):
        self.weights, self.bias, self.move, self.curve = weights, bias, move, curve

    @classmethod
    def empty(cls) -> Field:
        return cls({}, -4.0, np.ones((2, 2)), np.zeros(4))

    @classmethod
    def fit(cls, texts: list[str], toxic: np.ndarray, prior: float) -> Field:
        """The field on two of three texts; the curve on the third ones, whose words the field hasn't seen."""
        if not toxic.any() or toxic.all():
            return cls.empty()
        own = one_of_each(texts)
        texts, toxic = [texts[k] for k in own], toxic[own]
        third = np.arange(len(texts)) % 3 == 2
        field = cls.of_words([t for t, h in zip(texts, third, strict=True) if not h], toxic[~third])
        scorer, rest, marginals = Scorer(vars(field)), [t for t, h in zip(texts, third, strict=True) if h], []
        for lo in range(0, len(rest), 100):
            marginals += scorer.marginals(rest[lo : lo + 100])
        field.curve = fitted_curve(scorer.inputs(marginals), toxic[third], prior) if marginals else np.zeros(4)
        return field

    @classmethod
    def of_words(cls, texts: list[str], toxic: np.ndarray) -> Field:
        docs = [_TOKENS.findall(t) for t in texts]
        types: dict[str, int] = {}
        if not any(docs):
            return cls.empty()
        ids = [np.fromiter((types.setdefault(w, len(types)) for w in d), np.int64, len(d)) for d in docs]
        shapes = [[] if w in _BREAKS else features_of(w) for w in types]
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for d, label in zip(ids, toxic.tolist(), strict=True):
            seen[label].update({f for t in np.unique(d) for f in shapes[t]})
        n = [int((toxic == k).sum()) for k in (0, 1)]
        odds = {f: np.log((c + 0.5) / (n[1] + 1)) - np.log((seen[0][f] + 0.5) / (n[0] + 1)) for f, c in seen[1].items() if c >= FEWEST}
        able = {f: k for k, f in enumerate(f for f, v in odds.items() if v > SEED_LOG_ODDS)}
        chosen = explaining([sorted({able[f] for t in np.unique(d) for f in shapes[t] if f in able}) for d, label in zip(ids, toxic, strict=True) if label], len(able))
        names = list(able)
        chosen_names = {names[k] for k in chosen}
        tagged = np.array([any(f in chosen_names for f in s) for s in shapes], dtype=bool)
        known = {f: k for k, f in enumerate(f for f in {*seen[0], *seen[1]} if seen[0][f] + seen[1][f] >= FEWEST)}
        rows = [[known[f] for f in s if f in known] for s in shapes]
        of_type = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        feature = np.array([f for r in rows for f in r], dtype=np.int64)

        flat = np.concatenate(ids)
        doc = np.repeat(np.arange(len(ids)), [len(d) for d in ids])
        breaks = np.array([w in _BREAKS for w in types])[flat]
        starts, lengths, goes_on = chains(breaks)
        word = np.zeros(len(flat), dtype=bool)
        for k in range(len(starts)):
            word[starts[k] : starts[k] + lengths[k]] = True
        y = word & tagged[flat] & (toxic[doc] == 1)
        first = np.zeros(len(flat), dtype=bool)
        first[starts[~goes_on]] = True
        before = np.where(first, 0, np.concatenate([[0], y[:-1]]))
        told = np.bincount((before * 2 + y)[word], minlength=4).reshape(2, 2).astype(float)

        w, bias, moves = np.zeros(len(known)), -4.0, np.zeros((2, 2))
        square_w, square_b, square_m = np.full(len(known), 1e-8), 1e-8, np.full((2, 2), 1e-8)
        for _ in range(STEPS):
            e = bias + np.bincount(of_type, weights=w[feature], minlength=len(rows))[flat]
            p, expected = forward_backward(e, starts, lengths, np.exp(moves), True, goes_on)
            off = np.where(word, y - p, 0.0)
            by_type = np.bincount(flat, weights=off, minlength=len(rows))
            g = np.bincount(feature, weights=by_type[of_type], minlength=len(known)) - 0.05 * w
            square_w += g * g
            w += 0.8 * g / np.sqrt(square_w)
            square_b += off.sum() ** 2
            bias += 0.4 * off.sum() / np.sqrt(square_b)
            gm = told - expected - 0.1 * moves
            square_m += gm * gm
            moves += 0.2 * gm / np.sqrt(square_m)
        return cls({f: float(w[k]) for f, k in known.items() if abs(w[k]) > 1e-3}, float(bias), np.exp(moves), np.zeros(4))

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features_of(word))


def curve_inputs(top: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What a document's score looks at: the largest marginal as log odds, the sum, and how far it goes beyond one word."""
    logit = np.log(np.clip(top, 1e-4, 1 - 1e-4) / np.clip(1 - top, 1e-4, 1))
    return np.stack([np.ones(len(top)), logit / 9, np.log1p(total), np.minimum(total, 3) / 3], axis=1)


def fitted_curve(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Logistic regression by Newton steps; rows weigh so that the toxic share is the labels' own."""
    share = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (share * (y - p)) - 1.0 * b
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(len(b))
        b += np.linalg.solve(h, g)
    return b


class Scorer(dict):
    """Emissions of words, from a bounded cache; NaN for breaks."""

    def __init__(self, field: dict):
        self.field = Field(**field)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(dict.fromkeys(_BREAKS, float("nan")))

    def __missing__(self, word: str) -> float:
        if len(self) > CACHED:
            self.reset()
        e = self.field.emission(word)
        self[word] = e
        return e

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """The toxic marginal of each token of each text; 0 for breaks."""
        found = [_TOKENS.findall(t) for t in texts]
        sizes = [len(f) for f in found]
        e = np.concatenate([np.fromiter(map(self.__getitem__, f), np.float64, len(f)) for f in found] or [np.zeros(0)])
        breaks = np.isnan(e)
        ends = np.cumsum(sizes)
        # Texts are apart from one another as sentences are.
        e, at = np.insert(e, ends, np.nan), ends + np.arange(len(ends))
        breaks = np.insert(breaks, ends, True)
        starts, lengths, goes_on = chains(breaks)
        p, _ = forward_backward(np.where(breaks, 0.0, e), starts, lengths, self.field.move, False, goes_on)
        p = np.where(breaks, 0.0, p)
        return np.split(np.delete(p, at), ends[:-1]) if len(ends) else []

    def inputs(self, marginals: list[np.ndarray]) -> np.ndarray:
        return curve_inputs(np.array([m.max(initial=0.0) for m in marginals]), np.array([m.sum() for m in marginals]))

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        if not self.field.curve.any():
            return np.zeros(len(marginals))
        return 1 / (1 + np.exp(-np.clip(self.inputs(marginals) @ self.field.curve, -30, 30)))


def spans_of(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, largest marginal) in characters, of runs of toxic words."""
    out: list[tuple[int, int, float]] = []
    if p.max(initial=0.0) < SPAN:
        return out
    last = -2
    for k, m in enumerate(_TOKENS.finditer(text)):
        if p[k] >= SPAN:
            if last == k - 1:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(p[k])))
            else:
                out.append((m.start(), m.end(), float(p[k])))
            last = k
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int] = SAMPLE) -> dict:
    """Fit the field on a bounded sample of the labelled rows outside the held-out fold."""
    own = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).alias("toxic"))
    own = own.filter(~F.expr(HELD_OUT.format("doc_id")))
    counts = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return vars(Field.empty())
    parts = [own.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for label, n in ((1, sample[0]), (0, sample[1]))]
    picked = parts[0].unionByName(parts[1])
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).filter(F.length("text") <= LONGEST)
    # Of rows with one id the smallest text, so that an id with very many rows doesn't come to the driver with all of them.
    found = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = found.select("text", "toxic").orderBy(F.xxhash64("text"), "toxic").collect()  # at most sum(sample) rows
    field = Field.fit([r["text"] for r in found], np.array([r["toxic"] for r in found]), counts[1] / (counts[0] + counts[1]))
    return vars(field)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, spans (start, end, p)."""
    field = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))  # features of a bounded sample
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(field.value)
        for b in batches:
            lo = 0
            while lo < b.num_rows:  # some 500,000 characters at a time
                texts, size = [], 0
                while lo < b.num_rows and size < 500_000:
                    texts.append(b.column(1)[lo].as_py())
                    size, lo = size + len(texts[-1]), lo + 1
                p = scorer.marginals(texts)
                spans = [[{"start": a, "end": z, "p": q} for a, z, q in spans_of(t, m)] for t, m in zip(texts, p, strict=True)]
                ids = b.column(0).slice(lo - len(texts), len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(scorer.scores(p)), pa.array(spans, span)], names=["doc_id", "score", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start: int, end: int, p: double>>")
    return out.select("doc_id", F.expr(HELD_OUT.format("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
