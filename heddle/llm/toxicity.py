"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of two words is the sum over common subsequences of three and of five
characters, read in order and with gaps, of a decay for every skipped character,
over both words' norms.  Triples span at most five characters and fives at most
six, so insults with inserted or missing characters still share many of them.  Words stand where white space parts them, so marks
put inside a word are gaps too.

A support vector machine on Nyström features of landmark words is linear in the
subsequences, f(x) = sum over landmarks of beta * k(x, landmark); the sum of the
landmarks' subsequences, weighted by beta, is one table, and a word's
margin is a sum of lookups.  That is the same function at a small cost, for
whole texts in one pass.

A mark before each word's first character lets them tell beginnings.

Training is on at most ``per_class`` labelled documents a class; one half of them
chooses words, the other calibrates.  Words that stand out in toxic documents,
counted in the cluster by documents, are positive; a bounded choice of clean documents'
words is negative, and so are, round by round, those to which the machine gave
clean documents' highest margins: they weigh most, being what a document is judged by.
All words are learnt together with copies that hold one more character at some inner
place, so the margin of an insult with an inserted mark stays above that of a word
that looks like one.  A document's score is a logistic fit of its highest margin and of
the log of its count of words with a margin above zero; toxic documents whose flagged
words got a character inserted take part in that fit, at ``inserted`` of the weight.

With labels of one class only, the score is the smoothed share of toxic labels.
Characters fall into 64 classes, a-z each alone and all others by code point, so that
a triple is a place in a table; words that differ in such characters alone may be taken for one
another.  A word's norm counts the places of its subsequences up to 256 characters and grows
as the root of the length from there: longer words are no insults, and their exact norm
would need their subsequences sorted.  Null and empty texts have no
words and score as such; repeated rows are scored one by one, an empty table gives
no rows, and other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, settle
from .labelled import fit_logistic, held_out, labelled_sample, predict_logistic

DECAY, CLASSES, MARK = 0.7, 64, 63
#: Places after the first character, for triples and for fives.
GAPS = [(a, b) for b in range(2, 5) for a in range(1, b)] + [(1, 2, 3, 4)] + [tuple(x for x in range(1, 6) if x != g) for g in range(1, 5)]
TRIPLES, FIVES = CLASSES**3, 1 << 20  # triples have a place each, fives are hashed
SIZE = TRIPLES + FIVES
LONGEST = 40  # training words; scored words have any length
INSERTED = "*-._abcdefghijklmnopqrstuvwxyz"  # what training puts into words
CHUNK = 1_000_000  # characters at a time


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Character to class: 0 white space, 1-26 a-z, the rest by code point."""
    table = (np.arange(0x3001) % (CLASSES - 28) + 27).astype(np.int32)
    for i in range(26):
        table[97 + i] = 1 + i
    for c in range(0x3001):
        if chr(c).isspace():
            table[c] = 0
    return table


def weight(gaps: tuple[int, ...]) -> float:
    return DECAY ** (gaps[-1] - len(gaps))


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return _classes()[np.minimum(points, 0x2FFF)]


@lru_cache(maxsize=1)
def _norms() -> np.ndarray:
    """Norm of a word's triples, each place its own, by length; beyond 256 it grows as the root."""
    n = np.arange(257)
    square = sum(weight(g) ** 2 * np.maximum(0, n - g[-1]) for g in GAPS)
    return np.sqrt(np.maximum(square, 1.0)).astype(np.float32)


def norm(lengths: np.ndarray) -> np.ndarray:
    return _norms()[np.minimum(lengths, 256)] * np.sqrt(np.maximum(1.0, lengths / 256.0)).astype(np.float32)


def marked(joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a text, and starts and ends of its words, each with the mark before it."""
    c = codes("\n" + joined)
    inside = np.zeros(len(c) + 1, np.int8)
    inside[:-1] = c > 0
    edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
    starts, ends = edge[::2] - 1, edge[1::2]
    c[starts] = MARK
    return c, starts, ends


def subsequences(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each pattern of gaps: its weight, and at each place the number and whether it stays in its word."""
    left = np.full(len(c), -1, np.int32)  # characters after this one in its word
    lengths = ends - starts
    place = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    left[place] = np.repeat(ends - 1, lengths) - place
    for gaps in GAPS:
        n = len(c) - gaps[-1]
        if n <= 0:
            continue
        number = c[:n]
        for g in gaps:
            number = (number << 6) + c[g : g + n]
        if len(gaps) > 2:
            number = TRIPLES + ((number.view(np.uint32) * np.uint32(2654435761)) >> np.uint32(12)).view(np.int32)
        yield weight(gaps), number, left[:n] >= gaps[-1]


def margins(c: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of each word: the table's sum over its subsequences, over the word's norm."""
    if not len(starts):
        return np.empty(0, np.float32)
    total = np.zeros(len(c), np.float32)
    for w, number, inside in subsequences(c, starts, ends):
        total[: len(number)] += table[number] * (inside * np.float32(w))
    return np.add.reduceat(total, starts) / norm(ends - starts)


def features(words: list[str]) -> list[dict[int, float]]:
    """Sparse normed subsequences of each word."""
    out = []
    for word in words:
        c, starts, ends = marked(word)
        found: dict[int, float] = {}
        for w, number, inside in subsequences(c, starts, ends):
            for k in number[inside].tolist():
                found[k] = found.get(k, 0.0) + w
        size = float(norm(np.array([len(word) + 1]))[0])
        out.append({k: v / size for k, v in found.items()})
    return out


def _kernel(words: list[dict[int, float]], landmarks: list[dict[int, float]]) -> np.ndarray:
    column: dict[int, int] = {}
    for f in landmarks:
        for k in f:
            column.setdefault(k, len(column))
    dense = np.zeros((len(landmarks), len(column)), np.float32)
    for row, f in zip(dense, landmarks):
        row[[column[k] for k in f]] = list(f.values())
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for row, f in zip(out, words):
        if own := [k for k in f if k in column]:
            row[:] = dense[:, [column[k] for k in own]] @ np.array([f[k] for k in own], np.float32)
    return out


def with_insertion(word: str, nth: int = 0) -> str:
    """The word with one character more at an inner place; the same for the same word and number."""
    r = random.Random(zlib.crc32(f"{nth}:{word}".encode("utf-8", "replace")))
    at = r.randint(1, len(word) - 1)
    return word[:at] + r.choice(INSERTED) + word[at:]


def fit_svm(words: list[str], y: np.ndarray, weight: np.ndarray, landmarks: list[str], cost: float = 10.0) -> np.ndarray:
    """The table over subsequences; its last entry is the bias."""
    marks = features(landmarks)
    values, vectors = np.linalg.eigh(_kernel(marks, marks).astype(float) + 1e-6 * np.eye(len(marks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    z = np.hstack([_kernel(features(words), marks) @ root.astype(np.float32), np.ones((len(words), 1), np.float32)])
    sign, w = 2.0 * y - 1, np.zeros(z.shape[1])
    for _ in range(50):  # Newton steps of the squared hinge
        on = sign * (z @ w) < 1
        a = z[on] * weight[on, None].astype(np.float32)
        new = np.linalg.solve(np.eye(len(w)) / cost + (a.T @ z[on]).astype(float), a.T @ sign[on])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    beta = root @ w[:-1]
    table = np.zeros(SIZE + 1, np.float32)
    for b, f in zip(beta, marks):
        for k, v in f.items():
            table[k] += b * v
    table[-1] = w[-1]
    return table


def pieces(text: str) -> Iterator[str]:
    """The text, or parts of about CHUNK characters cut at white space."""
    at = 0
    while len(text) - at > CHUNK:
        cut = at + CHUNK
        while cut < len(text) and not text[cut].isspace():
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def document_features(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Highest margin and log count of positive words of each text, and its highest word."""
    best, count, top = np.full(len(texts), -2.0), np.zeros(len(texts)), [""] * len(texts)
    group: list[tuple[int, str]] = []

    def flush() -> None:
        if not group:
            return
        joined = "\n".join(p for _, p in group).lower()
        c, starts, ends = marked(joined)
        if len(starts):
            m = margins(c, starts, ends, table) + table[-1]
            # Lower case may change lengths, so lines are found in the joined text.
            edges = np.cumsum([len(p.lower()) + 1 for _, p in group]) + 0
            owner = np.searchsorted(edges, starts, side="right")
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            high, positive = np.maximum.reduceat(m, first), np.add.reduceat((m > 0).astype(float), first)
            for f, (k, h, n) in zip(first, zip(owner[first], high, positive)):
                i = group[k][0]
                count[i] += n
                if h > best[i]:
                    best[i] = h
                    at = f + int((m[f:] == h).argmax())
                    top[i] = joined[starts[at] : ends[at] - 1]
        group.clear()

    size = 0
    for i, text in enumerate(texts):
        for part in pieces(text):
            group.append((i, part))
            size += len(part)
            if size >= CHUNK:
                flush()
                size = 0
    flush()
    return np.stack([best, np.log1p(count)], 1), top


def _words(sample: DataFrame, n: dict[int, int]) -> DataFrame:
    """(word, t, c, apart, odds): toxic and clean documents of the sample that hold it, and how far that is from chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1)):
                words = sorted({w for w in t.as_py().lower().split() if 3 <= len(w) <= LONGEST})
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([y.as_py()] * len(words), pa.int32())], names=["word", "label"])

    counts = sample.select("text", "label").transform(mapped, run, "word string, label int").groupBy("word").agg(F.sum("label").cast("long").alias("t"), F.sum(1 - F.col("label")).cast("long").alias("c"))
    share = n[1] / (n[0] + n[1])
    t, c, both = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    term = lambda k, p: F.when(k > 0, k * F.log(k / (both * p))).otherwise(0.0)
    odds = F.log((t + 0.5) / (n[1] + 1)) - F.log((c + 0.5) / (n[0] + 1))
    return counts.select("word", "t", "c", (term(t, share) + term(c, 1 - share)).alias("apart"), odds.alias("odds"))


def inserted_into(text: str, table: np.ndarray) -> str:
    """The text, in lower case, with a character more in each word of four or more that has a margin above zero."""
    out = []
    for part in pieces(text.lower()):
        c, starts, ends = marked(part)  # the mark before a word stands at its own place there
        m, at = margins(c, starts, ends, table) + table[-1], 0
        for i in np.flatnonzero((m > 0) & (ends - starts > 4)).tolist():
            a, b = int(starts[i]), int(ends[i]) - 1
            out += [part[at:a], with_insertion(part[a:b])]
            at = b
        out.append(part[at:])
    return "".join(out)


def _tops(sample: DataFrame, table: np.ndarray, insert: bool = False) -> list:
    """(label, a, b, word) of each document: its two features and its highest word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            f, top = document_features([inserted_into(t, table) for t in texts] if insert else texts, table)
            top = [w[:LONGEST] for w in top]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(f[:, 0], pa.float64()), pa.array(f[:, 1], pa.float64()), pa.array(top, pa.string())], names=["label", "a", "b", "word"])

    return sample.select("text", "label").transform(mapped, run, "label int, a double, b double, word string").collect()


def train_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    *,
    label: str = "toxic",
    per_class: int = 4000,
    negatives: int = 4000,
    landmarks: int = 600,
    rounds: int = 4,
    inserted: float = 0.3,
    doc_id: str = "doc_id",
    text: str = "text",
):
    """(table over subsequences, logistic model), or a constant score."""
    sample = labelled_sample(documents, labels, label, per_class=per_class, doc_id=doc_id, text=text, name="toxic")
    n_half = {(r["label"], r["half"]): r["count"] for r in sample.groupBy("label", "half").count().collect()}
    n = {c: n_half.get((c, 0), 0) + n_half.get((c, 1), 0) for c in (0, 1)}
    if not n[0] or not n[1]:
        return (n[1] + 1) / (n[0] + n[1] + 2)
    fitted = sample
    if len(n_half) == 4:  # one half of the documents chooses words, the other calibrates
        sample, fitted = sample.filter("half = 0"), sample.filter("half = 1")
        n = {c: n_half[c, 0] for c in (0, 1)}
    words = settle(_words(sample, n), "toxic-words")
    stands_out = words.filter("odds > 1 AND c <= t * 0.05 AND t > 1")
    up = [r["word"] for r in stands_out.orderBy(F.desc("apart"), "word").filter("apart > 8").limit(1500).collect()]
    if not up:  # few labels: what lies furthest from chance
        up = [r["word"] for r in words.filter("odds > 0").orderBy(F.desc("apart"), "word").limit(30).collect()]
    easy = [r["word"] for r in words.filter("c > 0").orderBy(F.xxhash64("word"), "word").limit(negatives).collect()]
    known = set(up)
    clean = sample.filter("label = 0")
    hard: dict[str, float] = {}
    table = np.zeros(SIZE + 1, np.float32)
    pick = lambda words, k: words[:: max(1, len(words) // k)][:k]
    for _ in range(rounds if up else 0):
        down = sorted(sorted(hard, key=lambda w: (-hard[w], w))[: negatives // 2])
        rest = [w for w in easy if w not in hard and w not in known]
        marks = list(dict.fromkeys(pick(up, landmarks // 2) + pick(down, landmarks // 4) + pick(rest, landmarks // 4)))
        more = [with_insertion(w, i) for w in up for i in range(4)]
        no, often = [with_insertion(w) for w in rest], [with_insertion(w) for w in down if len(w) > 2]
        own = [*up, *more, *down, *often, *rest, *no]
        y = np.r_[np.ones(len(up) + len(more)), np.zeros(len(own) - len(up) - len(more))]
        weight = np.where(np.arange(len(own)) < len(up) + len(more) + len(down) + len(often), 8.0, 1.0)
        weight = np.where(y > 0, len(own) / 3 / max(1, y.sum()), weight * (len(own) * 2 / 3 / max(1.0, weight[y == 0].sum())))
        table = fit_svm(own, y, weight, marks)
        for r in _tops(clean, table):  # at most per_class
            if r["word"] and r["word"] not in known:
                hard[r["word"]] = max(hard.get(r["word"], -9.0), r["a"])
    whole = _tops(fitted, table)
    rows = whole + _tops(fitted.filter("label = 1"), table, insert=True)
    x, y = np.array([(r["a"], r["b"]) for r in rows]), np.array([r["label"] for r in rows], float)
    return table, fit_logistic(x, y, weight=np.where(np.arange(len(rows)) < len(whole), 1.0, inserted))


def score_toxicity(documents: DataFrame, model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and the highest word of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                p, top = np.full(batch.num_rows, model), [""] * batch.num_rows
            else:
                f, top = document_features([t or "" for t in batch.column(1).to_pylist()], model[0])
                p = predict_logistic(model[1], f)
            columns = [batch.column(0), batch.column(2), pa.array(p, pa.float64()), pa.array((p >= threshold).astype("int32")), pa.array(top, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "word"])

    fields = [("held_out", T.BooleanType()), ("score", T.DoubleType()), ("predicted", T.IntegerType()), ("word", T.StringType())]
    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), *(T.StructField(*f) for f in fields)])
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), held_out(doc_id).alias("held_out"))
    return own.transform(mapped, run, schema)
