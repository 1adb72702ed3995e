"""Source divergence, token counts and conversation repair against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from heddle.llm import conversations, divergence, token_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TURNS = "conv_id bigint, turn bigint, role string, text string"
CLASH = ["place", "term", "count", "value", "rank", "item", "n", "p", "q", "kind", "tie", "code", "at", "audit", "codes", "docs", "document"]


def with_clashes(df):
    return df.withColumns({c: F.lit(1) for c in CLASH})


# --- source divergence


def divergence_of(rows, min_docs=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = sorted(s for g, s in groups if g == lang)
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def p_of(c, t, n):
            return 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept))

        p = {s: {t: p_of(counts[lang, s], t, sum(counts[lang, s][t] for t in kept)) for t in kept} for s in sources}
        q = {t: p_of(total, t, sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)]
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms, 1)]
    return sorted(out)


def doc_rows():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("aeioustrnÉü") for _ in range(r.randint(1, 4))) for _ in range(60)]
    rows = []
    for i in range(150):
        lang, source = r.choice(["en", "en", "de"]), r.choice(["a", "b", "c", "d"])
        words = [r.choice(vocabulary[: 20 + 10 * ord(source) % 40]).upper() if r.random() < 0.2 else r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        rows.append((i, r.choice([" ", "-", "1"]).join(words), lang, source, 0))
    rows += [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "only", 0), (3, "one two", "xx", "s1", 0), (4, "three", "xx", "s2", 0), (5, "alone", "yy", "s", 0)]
    rows += [rows[3]] * 3 + [(6, "Über über " * 20_000, "de", "a", 0)]
    return rows


def test_divergence_is_brute_force(spark):
    rows = doc_rows()
    got = divergence.audit_sources(with_clashes(spark.createDataFrame(rows, DOCS).repartition(5)))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_of(rows)


def test_divergence_other_parameters_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 3)
    rows = doc_rows()
    got = divergence.audit_sources(spark.createDataFrame(rows, DOCS).repartition(3), min_docs=2, top=3)
    assert sorted(map(tuple, got.collect())) == divergence_of(rows, 2, 3)


def test_divergence_without_rows(spark):
    assert divergence.audit_sources(spark.createDataFrame([], DOCS)).collect() == []


def test_runs_are_whole_over_batches():
    import pyarrow as pa

    rows = [("l", t, s, 0, 1, 2) for t in "aab" for s in "xxy"]
    rows.sort()
    names = ["lang", "term", "source", "document", "docs", "count"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, row))]) for row in rows]
    got = [r for t in divergence.whole_runs(iter(batches), fold=True) for r in t.to_pylist()]
    assert [(r["term"], r["source"], r["docs"], r["count"]) for r in got] == [("a", "x", 4, 8), ("a", "y", 2, 4), ("b", "x", 2, 4), ("b", "y", 1, 2)]


def test_terms_in_pieces(monkeypatch):
    text = "Ab cd, é_f g1h ijk".encode()
    whole = [t for part in divergence.terms_of(text) for t in part]
    monkeypatch.setattr(divergence, "PIECE", 2)
    assert [t for part in divergence.terms_of(text) for t in part] == whole == ["ab".encode(), b"cd", "é".encode(), b"f", b"g", b"h", b"ijk"]


def test_shares_do_not_overflow(spark):
    n = 4 * 10**12
    df = spark.createDataFrame([(n, n, 5)], "c long, n long, v long").select(divergence.share("c", "n", "v"))
    assert df.first()[0] == 1 + 10**9 * (n + 2) // (n + 10)


# --- token counts


@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.tokenizer_of(None)[0]


def odd_texts():
    r = random.Random(3)
    signs = [*"ab 's\n\n\t  1é'’！。中文 x.", "<|endoftext|>", "  ", "😀", "\x1c", "\x85", "\xa0", "\xad", "don't", "we'LL", "²", "<|endof", "text|>"]
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 80))) for _ in range(400)]


def test_token_counts_are_the_librarys(spark, tokenizer):
    texts = [*odd_texts(), None, "", " ", "x" * 100_000, "word " * 60_000, "中文" * 20_000, "a<|endoftext|>b", "same", "same"]
    rows = [(i if i % 7 else None, t, None, None, None) for i, t in enumerate(texts)]
    got = token_counts.count_tokens(with_clashes(spark.createDataFrame(rows, DOCS).repartition(3)), sample_rows=100, table_size=64)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    want = [(i if i % 7 else None, len((t or "").encode()), k, k > 512) for (i, t), k in zip(enumerate(texts), n)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_token_counts_of_the_tables_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()} == want


def test_pre_tokens_of_every_sure_character(tokenizer):
    for code in range(0x2028):
        c = chr(code)
        if token_counts._SURE.fullmatch(c):
            for s in (f"a{c}b", f" {c} b", f"1{c}2", f"!{c}!", f"a {c}{c}  {c}\n{c}x", f"'{c}s 's"):
                assert [m.span() for m in token_counts._PRE_TOKEN.finditer(s)] == [x[1] for x in tokenizer.pre_tokenizer.pre_tokenize_str(s)], s


@pytest.mark.parametrize("size", [1, 3, 9])
def test_pieces_lose_no_token(tokenizer, size):
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for text in odd_texts():
        parts = list(token_counts.pieces(text, size))
        assert "".join(parts) == text and sum(map(count, parts)) == count(text)


def test_the_table_and_the_cache_do_not_decide(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(odd_texts())], DOCS)
    whole = sorted(token_counts.count_tokens(docs, table_size=1, sample_rows=1).collect())
    assert sorted(token_counts.count_tokens(docs, table_size=10_000, sample_rows=10_000).collect()) == whole
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 0)
    assert sorted(token_counts.count_tokens(docs, table_size=1, sample_rows=1).collect()) == whole


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 1000)
    cache = token_counts.Cache()
    for i in range(100):
        cache.learn([f"t{i}"], [i])
        assert len(cache) <= 11 and cache[f"t{i}"] == i


def test_token_counts_without_rows(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS)).collect() == []


# --- conversation repair

SPACE = " \t\n\x0b\f\r"


def repaired(rows):
    """Best repair of rows [(role, text)]: counts, cost, audit, lines; every choice tried, memoized."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, said, inserted):
        """(cost, audit, lines) from row i on; ``said`` holds the initials so far that matter."""
        out = []
        if i == len(rows) and (said in ("", "a")):
            out.append((0, "", ()))
        free = {"": "user", "s": "user", "u": "assistant", "a": "user"}[said]
        if inserted < 3:
            c, a, lines = best(i, free[0], inserted + 1)
            out.append((c + 3, "I" + a, (f"{free}:", *lines)))
        if i < len(rows):
            role, text = rows[i]
            c, a, lines = best(i + 1, said, 0)
            out.append((c + 4, "D" + a, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                c, a, lines = best(i + 1, free[0], 0)
                out.append((c + 3 + more, "R" + a, (f"{free}:{text}", *lines)))
                if role[:1] == free[0] or (role[:1] == "s" and said == ""):
                    c, a, lines = best(i + 1, role[:1], 0)
                    out.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
        return min(out) if out else (10**9, "", ())

    cost, audit, lines = best(0, "", 0)
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return [faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, lines


def repairs_of(rows):
    """The contract, row by row."""
    out, by_conv = [], defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, turns in by_conv.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()))
        kept = []
        for turn, role, text in turns:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind:
                row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
                kept += [row] * (2 if kind == 3 else 1)
        known = [t for t, _, _ in kept if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        counts, illegal, cost, audit, lines = repaired([(r, t) for _, r, t in kept])
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversation_rows(n=60):
    r = random.Random(7)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "sudo", "User"])
            rows.append((conv, turn * r.choice([1, 1, 2]), role, r.choice(["Yes.", "No", "What?", " \n", "", "So it is!  ", "." * r.randint(0, 2), "end\x85", f"text {r.randint(0, 3)}."])))
    rows += [(None, None, None, None), (None, 1, "user", "Hello."), (1000, None, "user", "First."), (1000, None, None, None), (1000, 3, "assistant", None), (1001, 5, "user", "x" * 200_000 + ".")]
    rows += [(1002, 1, "user", "The same.")] * 5 + [(1002, 1, "assistant", "Another."), (1002, 2, None, "Last")]
    return rows


def test_repairs_are_brute_force(spark):
    rows = conversation_rows()
    got = conversations.repair_damaged(with_clashes(spark.createDataFrame(rows, TURNS).repartition(3)))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == repairs_of(rows)


def test_least_audits_are_brute_force():
    r = random.Random(1)
    for _ in range(400):
        rows = [(r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b.", "c", "", "d!"])) for _ in range(r.randint(0, 8))]
        *_, cost, audit, _ = repaired(rows)
        seen, codes = set(), ""
        for role, text in rows:
            fault = conversations.BLANK if not text else conversations.DUPLICATE if (role, text) in seen else conversations.CUT if text == "c" else conversations.OK
            seen.add((role, text))
            codes += chr(65 + 4 * fault + {"s": 1, "u": 2, "a": 3}.get(role[0], 0))
        assert conversations.least_audit(codes) == (cost, audit)


def test_a_long_conversation_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 2)
    r = random.Random(2)
    rows = [(1, i, r.choice(["user", "assistant", "assistant"]), f"{r.randint(0, 200)}{r.choice(['.', '', '!'])}") for i in range(120)] + [(2, 0, "user", "Hi.")]
    got = conversations.repair_damaged(spark.createDataFrame(rows, TURNS).repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == repairs_of(rows)


def test_conversations_whose_rows_all_go(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (row,) = conversations.repair_damaged(spark.createDataFrame([(5, turn, "user", "Hi.")], TURNS)).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark):
    assert conversations.repair_damaged(spark.createDataFrame([], TURNS)).collect() == []
