"""Secrets: fixed patterns, and strings that a tokenizer finds hard to read.

Base kinds (``assign access hex``) follow fixed patterns and are always
reported.  The method adds ``random`` spans: runs of key characters with few
characters per token under a byte-level BPE vocabulary.  Ordinary words compress
well; random strings do not.  Where a whole run reads well, the heaviest groups of
its parts between ``/ = _ + -`` are measured.  Digests of known lengths, UUIDs and
runs without letters are left out, and letters alone need a lower ratio, as is what a base span covers; what a base span
leaves of a run is measured by itself, down to 4 characters of the same key.  Null and empty texts have no
spans; very long runs are measured in blocks; repeated rows are scanned one by one; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, keep_between_tasks, mapped
from .spans import Span, scan_spans

BASE, ADDED = ("assign", "access", "hex"), ("random",)

# Each letter in either case, and no other character that folds to it.
_KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = re.compile(rf"""(?:{_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_GATE = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SEPARATORS = "/=_+-"
_SEPARATOR = re.compile(r"[/=_+-]")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_ALL_HEX = re.compile(r"[0-9a-fA-F]+")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
BLOCK = 256
LETTERS = 0.2  # how much lower the ratio has to be where no digit stands
LEAST, REST = 20, 4  # characters of a random string, and of what a base span leaves of one


@lru_cache(maxsize=2)
def token_counter(path: str | None) -> Callable[[str], int]:
    """Tokens of a string under a tiktoken vocabulary file; None is the public 50k byte BPE."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: sum(len(encoding.encode_ordinary(s[i : i + BLOCK])) for i in range(0, len(s), BLOCK))


def known_identifier(run: str) -> bool:
    return bool(_UUID.fullmatch(run)) or run.isdigit() or (len(run) in DIGEST_LENGTHS and bool(_ALL_HEX.fullmatch(run)))


def _outside(s: int, e: int, base: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of s to e outside the sorted spans."""
    for a, b in base:
        if a < e and s < b:
            if s < a:
                yield s, a
            s = max(s, b)
    if s < e:
        yield s, e


def _heavy(values: list[float]) -> list[tuple[int, int]]:
    """The disjoint segments of greatest sum above 0 (Ruzzo and Tompa), in order."""
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum with it
    done: list[tuple[int, int, float, float]] = []  # those that nothing later can join
    total = 0.0
    for i, v in enumerate(values):
        before, total = total, total + v
        if v <= 0:
            continue
        start, low = i, before
        while True:
            j = next((j for j in range(len(kept) - 1, -1, -1) if kept[j][2] < low), -1)
            if j < 0:
                done += kept
                kept = []
            if j < 0 or kept[j][3] >= total:
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((start, i + 1, low, total))
    return [(a, b) for a, b, _, _ in done + kept]


def _random_parts(text: str, start: int, end: int, base: list[tuple[int, int]], tokens: Callable[[str], int], ratio: float) -> Iterator[tuple[int, int]]:
    """Random strings of a run: all of it, or its parts between separators, outside base spans."""

    def is_random(s: int, e: int) -> bool:
        return any(c.isalpha() for c in text[s:e]) and not known_identifier(text[s:e]) and (e - s) / tokens(text[s:e]) < ratio - LETTERS * (not any(c.isdigit() for c in text[s:e]))

    for s, e in _outside(start, end, base):
        if e - s >= LEAST and is_random(s, e):
            yield s, e
        elif e - s >= LEAST:
            cuts = [s, *(c for m in _SEPARATOR.finditer(text, s, e) if (c := m.start()) > s), e]
            pieces = list(zip(cuts, cuts[1:]))
            for i, j in _heavy([ratio * tokens(text[a:b]) - (b - a) for a, b in pieces]):
                a, b = cuts[i], cuts[j]
                while a < b and text[a] in SEPARATORS:
                    a += 1
                if b - a >= LEAST and is_random(a, b):
                    yield a, b
        elif e - s < end - start:  # a short rest, up to a separator, of a key that a base span cuts
            left, right = s > start and text[s] not in SEPARATORS, e < end and text[e - 1] not in SEPARATORS
            if left:
                e = m.start() if (m := _SEPARATOR.search(text, s, e)) and not right else e
            elif right:
                s = max(s, *(m.end() for m in _SEPARATOR.finditer(text, s, e)), s)
            if (left or right) and e - s >= REST and is_random(s, e):
                yield s, e


def find_secrets(text: str, tokens: Callable[[str], int], ratio: float = 1.9) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in _GATE):
        found += [("assign", *m.span(), 1.0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span(), 1.0) for m in _HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in found)
    for m in _RUN.finditer(text):
        for s, e in _random_parts(text, *m.span(), base, tokens, ratio):
            found.append(("random", s, e, min(1.0, ratio - (e - s) / tokens(text[s:e]) + 0.5)))
    return found


def detect_secrets(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ratio: float = 1.9, vocabulary: str | None = None) -> DataFrame:
    def scanner() -> Callable[[str], list[Span]]:
        tokens = token_counter(vocabulary)
        return lambda t: find_secrets(t, tokens, ratio)

    return scan_spans(documents, scanner, base=BASE, added=ADDED, doc_id=doc_id, text=text)


def without_secrets(text: str, spans: list[Span]) -> str:
    """The text with every run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for _, s, e, _ in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(documents: DataFrame, *, text: str = "text", size: str | None = "n_chars", ratio: float = 1.9, vocabulary: str | None = None) -> DataFrame:
    """All rows and columns, secrets in the text replaced, and the size column set to match; null texts stay null."""
    bound_batches(documents.sparkSession)
    at = documents.columns.index(text)
    size_at = documents.columns.index(size) if size in documents.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_counter(vocabulary)
        keep_between_tasks("redact_secrets.<locals>.run", token_counter.cache_clear)
        for batch in batches:
            texts, lengths = [], batch.column(size_at).to_pylist() if size_at is not None else []
            for i, value in enumerate(batch.column(at)):
                t = value.as_py()
                if t and (spans := find_secrets(t, tokens, ratio)):
                    t = without_secrets(t, spans)
                    if size_at is not None:
                        lengths[i] = len(t)
                texts.append(t)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if size_at is not None:
                columns[size_at] = pa.array(lengths, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.transform(mapped, run, documents.schema)
