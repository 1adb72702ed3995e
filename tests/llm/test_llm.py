"""The dealt operators against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import lm, ngram_join, packing, pii, quality, secret_scan, topk, toxicity, url_filter
from heddle.llm.decontaminate import decontaminate, keep_clean

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; inputs may hold them too.
CLASH = ["kind", "n", "rep", "token", "label", "half", "_id", "_text", "word", "score", "held_out", "uid", "id", "piece", "row"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("aeioustrn") for _ in range(r.randint(1, 9))) for _ in range(300)] + ["Über", "l'été", "a,b", "X!!"]
    out = []
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            near = list(base)
            for _ in range(r.randint(0, 4)):
                near[r.randrange(len(near))] = r.choice(vocabulary)
            out.append(" ".join(near))
    return out


@pytest.fixture(scope="module")
def nasty(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    long = "word%d " * 40000 % tuple(range(40000))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts(), 10)]
    rows += [(None, None, None, None, None), (1, None, "en", None, None), (2, "", None, "s", 0), (3, " \n\t ", "en", "s", 4), (4, long, "en", "s", len(long)), (5, long, "en", "s", len(long))]
    rows += [(6, "same text on a repeated row of this table", "en", "s", 5)] * 3 + [(None, rows[0][1], "en", "s", 1), (7, "x" * 300_000, "en", "s", 300_000)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({c: F.lit(1) for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(10, 60)] + [(None, 1, 1), (11, None, None), (12, 0, 1)], "doc_id bigint, quality int, toxic int")


# 1
def brute_top(rows, k=5, every=50):
    v = [(i, [math.floor(float(x) * 256) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in v:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q and len(a) == len(b))
            out += [(q, r, i, -p) for r, (p, i) in enumerate(s[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 0.2, 16)]) for i in range(400)]
    rows += [(400, rows[3][1]), (401, rows[3][1]), (402, None), (403, [None] * 16), (404, [float("nan")] * 16), (None, rows[0][1]), (450, [0.5, 0.5]), (451, [0.25, 1.0]), (500, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5).withColumns({"q": F.lit(1), "x": F.lit(2), "score": F.lit(3)})
    for block in (16384, 3):
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=block).collect()
        assert sorted(map(tuple, got)) == brute_top(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_segment_bounds_hold():
    r = np.random.default_rng(2)
    a, b = r.normal(size=(50, 33)) * 100, r.normal(size=(60, 33)) * 100
    exact, last = a @ b.T, None
    for parts in (1, 4, 16):
        bound = topk.summary(a, parts) @ topk.summary(b, parts).T
        assert (bound >= exact - 1e-6).all()
        assert last is None or bound.mean() <= last
        last = bound.mean()


# 2 and 6
@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_classifiers_on_held_out_documents(spark):
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.score_quality(docs, quality.train_quality(docs, marks)).join(marks, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in good) / len(good) > 0.9
    bad = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, marks)).join(marks, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in bad) / len(bad) > 0.9


def test_classifier_edges(spark, nasty, empty, labels):
    for train, score in ((quality.train_quality, quality.score_quality), (toxicity.train_toxicity, toxicity.score_toxicity)):
        model = train(nasty, labels)
        rows = score(nasty, model).collect()
        assert len(rows) == nasty.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert score(empty, model).count() == 0
        assert 0 < train(empty, labels.limit(0)) < 1
        assert all(r["score"] == 0.5 for r in score(nasty, 0.5).collect())


def test_kernel_tolerates_gaps():
    insult, spread, other = toxicity.features(["idiot", "i.d.i.o.t", "orange"])
    k = lambda a, b: sum(v * b.get(i, 0) for i, v in a.items())
    assert k(insult, insult) > k(insult, spread) > k(insult, other)


def test_kernel_from_its_definition():
    """Common subsequences of three over at most five places and of five over at most six, a decay for every place skipped, over both norms."""
    from itertools import combinations

    decay = toxicity.DECAY

    def parts(word):
        own, found = "^" + word, Counter()
        for size, most in ((3, 5), (5, 6)):
            for at in combinations(range(len(own)), size):
                span = at[-1] - at[0] + 1
                if span <= most:
                    found[tuple(own[i] for i in at)] += decay ** (span - size)
        square = sum(decay ** (2 * (at[-1] - at[0] + 1 - size)) for size, most in ((3, 5), (5, 6)) for at in combinations(range(len(own)), size) if at[-1] - at[0] + 1 <= most)
        return found, max(1.0, square) ** 0.5

    words = ["idiot", "idi*ot", "i.d.i.o.t", "orange", "an", "banana", "anagram", "x"]
    got = toxicity.features(words)
    for a, fa in zip(words, got):
        for b, fb in zip(words, got):
            (pa, na), (pb, nb) = parts(a), parts(b)
            want = sum(v * pb[k] for k, v in pa.items()) / na / nb
            assert abs(sum(v * fb.get(k, 0) for k, v in fa.items()) - want) < 1e-5, (a, b)


def test_insertions_are_the_same_each_time():
    for word in ("idiot", "abc", "über"):
        for nth in range(5):
            new = toxicity.with_insertion(word, nth)
            assert new == toxicity.with_insertion(word, nth) and len(new) == len(word) + 1 and new[0] == word[0] and new[-1] == word[-1]
            assert any(new[:i] + new[i + 1 :] == word for i in range(len(new)))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_insults_with_an_inserted_character_stay_toxic(spark):
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train_toxicity(docs, marks)
    hot = [r["doc_id"] for r in toxicity.score_toxicity(docs, model).filter("held_out AND predicted = 1").collect()]
    texts_ = [r["text"] for r in docs.filter(F.col("doc_id").isin(hot)).collect()]
    new = spark.createDataFrame([(i, toxicity.inserted_into(t, model[0])) for i, t in enumerate(texts_)], "doc_id bigint, text string")
    assert all(a.lower() != b["text"] for a, b in zip(texts_, new.orderBy("doc_id").collect()))
    still = [r["predicted"] for r in toxicity.score_toxicity(new, model).collect()]
    assert sum(still) / len(still) >= 0.6


# 3
def brute_components(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted((i, len(s), least[find(a)]) for a, ((i, _), s) in enumerate(zip(rows, sets)) if i is not None)


def test_near_duplicates(spark, nasty, empty):
    got = ngram_join.near_duplicates(nasty).collect()
    assert len(got) == nasty.count()
    want = brute_components([(r["doc_id"], r["text"]) for r in nasty.select("doc_id", "text").collect()])
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert ngram_join.near_duplicates(empty).count() == 0


def test_one_of_each(spark, nasty):
    kept = ngram_join.one_of_each(nasty)
    assert kept.columns == nasty.columns
    want = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in nasty.select("doc_id", "text").collect()])}
    ids = [r["doc_id"] for r in kept.collect()]
    # The row without id and without text stays; the one whose text is a copy goes.
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_rows_that_share_an_id_or_have_none(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    near = lambda t, i: t + f" more{i}"
    rows = [(3, one), (7, near(one, 1)), (7, two), (9, near(two, 2)), (None, near(two, 3)), (None, three), (None, near(three, 4)), (5, ""), (5, near(one, 5)), (5, None), (9, near(two, 2))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter(map(tuple, ngram_join.near_duplicates(docs).collect()))
    n = lambda t: len(words(t)) - 4
    comp = {one: 3, two: 7, three: None}
    want = Counter((i, n(t), comp[next(b for b in comp if t.startswith(b))]) for i, t in rows if t)
    assert got == want + Counter({(5, 0, 5): 2})
    kept = sorted(ngram_join.one_of_each(docs).collect(), key=str)
    assert [r["doc_id"] for r in kept].count(None) == 1 and sum(r["text"] in ("", None) for r in kept) == 2
    assert {(3, one), (7, two)} <= {tuple(r) for r in kept} and len(kept) == 5


@pytest.mark.parametrize("with_base", [True, False])
def test_group_of_copies_that_differ_among_each_other(spark, with_base):
    """Most pairs are just below the threshold; the pairs made stay near the number of texts."""
    r = random.Random(13)
    base = [f"w{i}" for i in range(90)]
    rows = [(0, " ".join(base))] if with_base else []
    for i in range(1, 260):
        t = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5, 6])):
            t[r.randrange(90)] = f"x{r.randrange(5000)}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()))
    assert got == brute_components(rows)


def test_many_near_copies_and_heavy_tokens(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        t = list(base)
        t[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(t)))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(1000 + i, passage + " " + " ".join(f"y{i}_{j}" for j in range(r.randint(2, 12)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for heavy in (200_000, 5):
        got = sorted(map(tuple, ngram_join.near_duplicates(docs, heavy=heavy).collect()))
        assert got == brute_components(rows)


# 4 and 8
def joined(spans, order):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order.index(x[0]))))


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(digits(m)[::-1])) % 10 == 0]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]


def brute_secrets(t):
    k = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [("assign", *m.span()) for m in re.finditer(rf"""({k})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def planted(seed):
    r = random.Random(seed)
    pieces = ["a@b.co", "x.y+z@ex-1.org_d@e.f.g", "@@a@b", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (098) 555-0174", "+44 20 7946 0958 12", "12345678901234",
              "Password = 'hunter222'", "token==abcdefg", "API_KEY: x", "apikey\"=\"abc.def-ghi", "AKIA" + "A1" * 9, "0123456789abcdef01234567", "deadbeef", "é🙂ü", "ſecret=abcdefgh", "toKen=abcdefghij", " ", "\n", "foo"]
    return "".join(r.choice(pieces) + r.choice(["", " ", ".", "x"]) for _ in range(r.randint(0, 25)))


def test_spans_match_the_plain_patterns(spark, nasty):
    many = [planted(i) for i in range(400)] + ["GB82 WEST 1234 5698 7654 32 iban", "a" * 100_000 + "@", "1" * 50_000]
    tokens = secret_scan.token_counter(None)
    for t in many:
        assert sorted(s[:3] for s in pii.find_pii(t) if s[0] in pii.BASE) == sorted(brute_pii(t) if len(t) < 10_000 else [])
        assert sorted(s[:3] for s in secret_scan.find_secrets(t, tokens) if s[0] in secret_scan.BASE) == sorted(brute_secrets(t) if len(t) < 10_000 else [("hex", 0, len(t))] if t[:2] in ("aa", "11") and t[-1] != "@" else [("hex", 0, len(t) - 1)])
    assert any(s[0] == "iban" for s in pii.find_pii(many[400]))
    docs = spark.createDataFrame(list(enumerate(many[:50])), "doc_id bigint, text string")
    for detect, brute, order in ((pii.detect_pii, brute_pii, [*pii.BASE]), (secret_scan.detect_secrets, brute_secrets, [*secret_scan.BASE])):
        for r in detect(docs).collect():
            base = brute(many[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(joined(base, order).encode()).hexdigest()
            assert all(r[f"n_{k}"] == sum(s[0] == k for s in base) for k in order)
        assert detect(nasty).count() == nasty.count()


def test_random_strings_and_redaction(spark, nasty):
    tokens = secret_scan.token_counter(None)
    find = lambda t: [s[0] for s in secret_scan.find_secrets(t, tokens)]
    assert find("key 9fXk2LmQ7vRz8TpW3nYb6HsD done") == ["random"]
    assert find("550e8400-e29b-41d4-a716-446655440000 internationalization_of_software_2") == []
    out = secret_scan.redact_secrets(nasty)
    assert out.columns == nasty.columns and out.count() == nasty.count()
    assert secret_scan.without_secrets("a token=abcdefgh b", [("assign", 2, 16, 1.0)]) == "a [SECRET] b"
    assert pii.redact("mail a@b.co now", [("email", 5, 11, 1.0)]) == "mail [EMAIL] now"


# 5
def test_ibans_before_other_words():
    def find(t):
        return [t[s:e] for k, s, e, _ in pii.find_pii(t) if k == "iban"]

    de, gb = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    for t in (f"IBAN {de} BIC COBADEFFXXX", f"{de}", f"REF AB12 {de} EUR 500.", f"{de} {de[:4]}", f"{de} PLEASE TRANSFER NOW OR NEVER"):
        assert find(t) == [de]
    assert find(f"{gb} EUR 500 to") == [gb] and find(f"{de} {gb} {de}") == [de, gb, de]
    assert find("NO93 8601 1117 947 KR 5") == ["NO93 8601 1117 947"]
    assert find(f"{de[:-1]}1 BIC COBADEFFXXX") == find("DE89 3704 0044 0532 0130") == find(f"{de}X") == []


def test_random_strings_without_digits():
    tokens, r = secret_scan.token_counter(None), random.Random(4)
    for n in (20, 32, 40):
        keys = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n)) for _ in range(100)]
        found = [[s[:3] for s in secret_scan.find_secrets(f"the {k} of", tokens)] == [("random", 4, 4 + n)] for k in keys]
        assert sum(found) >= 95
    for t in ("services/production/webhooks/incoming", "internationalization_configuration", "=" * 40, "Donaudampfschifffahrtsgesellschaft", "1234567890" * 2):
        assert secret_scan.find_secrets(t, tokens) == []


def test_random_strings_in_longer_runs():
    tokens, r = secret_scan.token_counter(None), random.Random(4)
    keys = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(20)) for _ in range(100)]
    for before in ("session_identifier=", "/services/production/webhooks/incoming/"):
        at = len(before)
        assert sum(any(s <= at and at + 20 <= e for _, s, e, _ in secret_scan.find_secrets(before + k, tokens)) for k in keys) >= 95
    text = "key Qz9XpLk2" + "0123456789abcdef01234567" + "QzWpLk2Rt9 x"
    assert secret_scan.without_secrets(text, secret_scan.find_secrets(text, tokens)) == "key [SECRET][SECRET][SECRET] x"
    assert secret_scan.find_secrets("word-longer/" * 30_000, tokens) == []
    for _ in range(200):
        v = [r.randint(-3, 3) for _ in range(12)]
        best = max(sum(v[i:j]) for i in range(12) for j in range(i, 13))
        got = secret_scan._heavy(v)
        assert max((sum(v[i:j]) for i, j in got), default=0) == best
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))


def test_packing(spark, nasty, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    for capacity in (2048, 64):
        rows = packing.pack(nasty, capacity=capacity).collect()
        seqs = {}
        for r in rows:
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in seqs.values():
            at = 0
            for o, n in sorted(places):
                assert o == at
                at += n
            assert at <= capacity
        whole = sum(r["length"] for r in rows)
        assert len(seqs) <= -(-whole // capacity) * 1.02 + 1
        want = Counter()
        for r in nasty.select("doc_id", "text").collect():
            ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            for k, a in enumerate(range(0, len(ids), capacity)):
                p = np.array(ids[a : a + capacity], "<u4")
                want[(r["doc_id"], k, a, len(p), zlib.crc32(p.tobytes()))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert packing.pack(empty).count() == 0


def test_word_cache_gives_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    ids = packing.id_bytes(None)
    for s in ["Don't STOP, l'été... <|endoftext|> a b\x1cc 12ab_c İx ΑΣ ÀÉ!!%% é x", "", " \n", "The cat's 3rd (re)try: 100%&*"]:
        assert np.frombuffer(ids(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def test_word_cache_keeps_what_comes_again_and_is_bounded():
    held, learnt = packing.Recent(10), 0
    for i in range(200):
        wanted = {"often", f"once{i}"}
        new = held.lacking(wanted)
        learnt += "often" in new
        held.young.update((w, w.encode()) for w in new)
        assert all(held.young[w] == w.encode() for w in wanted)
        assert len(held.young) + len(held.older) <= 25
    assert learnt == 1
    assert 2 * (packing.CACHED_WORDS + packing.CACHED_PARTS) * 250 < 160e6  # bytes of a worker


def test_words_are_the_same_whatever_the_cache_holds(monkeypatch):
    texts = [f"word{i % 37}, x{i}y Don't {'long' * 30} é{i}!" for i in range(120)]
    wide = [packing.id_bytes(None)(t) for t in texts]
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    monkeypatch.setattr(packing, "CACHED_PARTS", 3)
    narrow = packing.id_bytes.__wrapped__(None)
    assert [narrow(t) for t in texts] == wide


def test_blocks_of_texts_give_the_tokenizers_ids(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    odd = ["Don't STOP, l'été... <|endoftext|> a b\x1cc 12ab_c İx ΑΣ ÀÉ!!%% é x", None, "", " \n\t", "a\u00a0b\u2003c\x85d e\x01f \x01", "J\u030c j\u030c Ψ\u0301", "x" * 90 + " " + "ab!" * 60, "end", "of", "\u00a0", "\u00a0 \u2028"]
    odd += [f"word{i % 37}, Word{i % 7}! x{i}y zz{chr(97 + i % 26)}q{chr(97 + i % 25)}$$ é{i}!" for i in range(300)] + ["the cat, sat. " * 400, "y" * 3000]
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in odd]
    for places, block in ((20, 1 << 18), (2, 64), (6, 500)):  # few places: words drive each other out
        monkeypatch.setattr(packing, "PLACE_BITS", places)
        monkeypatch.setattr(packing, "BLOCK", block)
        ids = packing.id_bytes.__wrapped__(None)
        for _ in range(2):
            assert list(ids.each(pa.array(odd))) == want
            assert list(ids.each(pa.array(["before", *odd]).slice(1))) == want
        ids.forget()
        assert list(ids.each(pa.array(odd[:3]))) == want[:3]
        assert list(ids.each(pa.array([], pa.string()))) == []


def test_many_rare_words_are_not_encoded_again(monkeypatch):
    import pyarrow as pa
    import tokenizers

    class Spy:
        letters = 0

        @classmethod
        def from_file(cls, path):
            spy = cls()
            spy.own = kept.from_file(path)
            return spy

        def encode_batch_fast(self, texts, **more):
            Spy.letters += sum(map(len, texts))
            return self.own.encode_batch_fast(texts, **more)

        def __getattr__(self, name):
            return getattr(self.own, name)

    kept = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", Spy)
    ids, r, took = packing.id_bytes.__wrapped__(None), np.random.default_rng(8), []
    letters = r.integers(97, 123, (450_000, 8), np.uint8)
    letters[:, 7] = 32
    texts = pa.array([row.tobytes().decode() for row in letters.reshape(450, -1)])
    each = getattr(ids, "each", lambda texts: map(ids, texts.to_pylist()))
    for _ in (0, 1):
        Spy.letters = 0
        for _ in each(texts):
            pass
        took.append(Spy.letters)
    assert took[1] < took[0] / 2  # what was learnt 450,000 words ago was forgotten before


# 7
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fit = [(len(r), r, a) for a, r in RULES for h, p in [(r.split("/")[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?q", "http://example.org/en/1#f", "http://example.org/en/2", "https://xexample.org/es/", "http://com/fr/", "http://x.com/de/?a", "http://x.com", "ftp://a.b.c.d.org?x/y", "http://x.com/FR/", "http://o.rg//", "http://org/", "http://org"]
    rows = [(i, u, None) for i, u in enumerate(urls * 2)] + [(None, "http://x.org/", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"host": F.lit("z"), "rule": F.lit("z"), "key": F.lit(1)})
    for bits in (10, 1):
        got = sorted(map(tuple, url_filter.judge_urls(pages, RULES, bits_per_key=bits).collect()), key=str)
        assert got == sorted([(i, *brute_url(u)) for i, u, _ in rows], key=str)
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0


def test_cascade_is_exact_with_tiny_filters(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7 == 0).alias("listed")).cache()
    cascade = url_filter.Cascade.build(keys, bits_per_key=2)
    assert len(cascade.levels) > 2
    assert keys.filter(cascade.member(F.col("key")) != F.col("listed")).count() == 0


# 9
def nine_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute_hits(doc, items, width=10):
    w = nine_words
    d, hit, found = w(doc), set(), set()
    for i, t in items:
        x = w(t)
        for a in range(max(1, len(x) - width + 1)) if x else []:
            g = x[a : a + width]
            for s in range(len(d) - len(g) + 1):
                if d[s : s + len(g)] == g:
                    hit.update(range(s, s + len(g)))
                    found.add(str(i))
    return len(d), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, empty):
    r = random.Random(3)
    vocabulary = [f"v{i}" for i in range(40)] + ["Straße", "ÉTÉ"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(r.choice([1, 3, 9, 10, 11, 30])))) for i in range(25)] + [(30, None), (31, ""), (32, "..."), (5, "v1 v2 v3")]
    docs = []
    for i in range(60):
        d = some(r.randint(0, 40))
        if i % 3 == 0:
            x = (r.choice(items)[1] or "").split()
            a = r.randint(0, len(d))
            d[a:a] = x
        docs.append((i, ", ".join(d)))
    docs += [(None, docs[0][1]), (100, None), (101, ""), docs[3], docs[3]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"item": F.lit(1), "pos": F.lit(2), "w": F.lit(3), "term": F.lit(4)})
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter(map(tuple, decontaminate(df, it).collect()))
    assert got == Counter((i, *brute_hits(t, items)) for i, t in docs)
    assert Counter(map(tuple, decontaminate(df, it, limit=300).collect())) == got
    assert decontaminate(df.limit(0), it).count() == 0
    assert {(r["n_hit"], r["contaminated"]) for r in decontaminate(df, it.limit(0)).collect()} == {(0, False)}
    # By rows: a clean row stays though its id stands on a contaminated one too, which goes, as do rows without id.
    clean = decontaminate(df, it).filter("NOT contaminated").count()
    kept = keep_clean(df.unionByName(df.filter("doc_id = 0").withColumn("text", F.lit("clean words alone"))), it)
    assert kept.columns == df.columns and kept.count() == clean + 1


def test_proximity(spark):
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(r.sample(vocabulary, n))) for i, n in enumerate([1, 3, 4, 6, 12])]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(80)]
    for i in range(30):  # an item with words put in and neighbours swapped
        x = r.choice(items)[1].split()
        k = r.randrange(len(x))
        x[k:k] = [r.choice(vocabulary)]
        docs.append((100 + i, " ".join(x)))
    counts = Counter(w for _, t in docs for w in nine_words(t))
    for slack in (1, 3):
        want = {}
        for i, t in docs:
            w = nine_words(t)
            for k, item in items:
                b = nine_words(item)
                for g in {tuple(b[s : s + 10]) for s in range(max(1, len(b) - 9))}:
                    order = sorted(range(len(g)), key=lambda o: (counts[g[o]], o))
                    if not counts[g[order[0]]]:
                        continue
                    for p in range(len(w)):
                        start = p - order[0]
                        if w[p] != g[order[0]]:
                            continue
                        if len(g) > 1 and not any(0 <= q < len(w) and w[q] == g[order[1]] for q in range(start + order[1] - slack, start + order[1] + slack + 1)):
                            continue
                        if set(g) <= set(w[max(0, start - slack) : max(0, start + len(g) + slack)]):
                            want.setdefault(i, set()).add(k)
        df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
        got = {x["doc_id"]: x["n_near"] for x in decontaminate(df, it, slack=slack).collect()}
        assert got == {i: len(want.get(i, ())) for i, _ in docs} and any(got.values())


# 10
def test_language_model(spark, nasty, empty):
    rows = nasty.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter()
    for r in rows:
        if not held(r["doc_id"]):
            c.update([*words(r["text"]), None])
    n, v = sum(c.values()), len(c)
    for frequent in (1 << 18, 50):
        got = lm.score_texts(nasty, frequent=frequent).collect()
        assert len(got) == len(rows)
        want = Counter()
        for r in rows:
            t = [*words(r["text"]), None]
            base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)
            want[(r["doc_id"], held(r["doc_id"]), len(t), sum(c[x] > 0 for x in t), n, f"{base:.6g}")] += 1
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.6g}") for r in got) == want
        assert all(r["score"] < 0 and math.isfinite(r["bits_per_byte"]) for r in got)
    assert lm.score_texts(empty).count() == 0


def test_prefix_code_is_the_shortest():
    import heapq

    r = random.Random(8)
    for n in (2, 3, 17, 400):
        counts = [r.choice([1, 1, 2, 3, 50, 1000]) for _ in range(n)]
        paths = [bin(int(c))[3:] for c in lm.prefix_code(np.array(counts))]
        assert len(set(paths)) == n and not any(a != b and b.startswith(a) for a in paths[:60] for b in paths)
        heap, total = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            two = heapq.heappop(heap) + heapq.heappop(heap)
            total += two
            heapq.heappush(heap, two)
        assert sum(c * len(p) for c, p in zip(counts, paths)) == total
    assert len(lm.prefix_code(np.array([5]))) == 1


def units_of(text, codes):
    import pyarrow as pa
    from heddle.llm.words import text_blocks

    ((_, data, offsets),) = text_blocks(pa.array([text or ""]))
    return lm.Units(data, offsets, codes)


def test_contexts_of_words_and_bytes():
    text = "the cat saw the cat run the cat zebrazebra the"
    ids = np.unique(units_of("the cat saw run", None).hashes)
    u = units_of(text, lm.Codes(ids, np.arange(1, 5), 1, 1, np.ones(256, np.int64)))
    w = [*text.split(), None]
    said = lambda i: w[i] if i >= 0 else None
    contexts = [[() for _ in w], [said(i - 1) for i in range(len(w))], [(said(i - 1), said(i - 2)) for i in range(len(w))]]
    spelt = "zebrazebra" + "\0"
    contexts[0] += [("b", spelt[max(0, i - 3) : i]) for i in range(len(spelt))]
    contexts[1] += [("b", spelt[:i]) for i in range(len(spelt))]
    contexts[2] += [("b", "cat", spelt[:i]) for i in range(len(spelt))]
    for own, tables in zip(contexts, u.contexts):
        assert len(own) == len(tables)
        for x, i in zip(own, tables):
            for y, j in zip(own, tables):
                assert (x == y) == (i == j)


def brute_mixer(rows, frequent, least):
    """Score of each text, a decision at a time."""
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    n_of = Counter(int(h) for t in train for h in units_of(t, None).hashes)
    top = sorted((h for h, c in n_of.items() if c >= least), key=lambda h: (-n_of[h], h - (1 << 64) * (h >> 63)))[:frequent]
    rare = sum(n_of.values()) - sum(n_of[h] for h in top)
    of_bytes = Counter(b for t in train for w in words(t) for b in w.encode())
    of_bytes[lm.CLOSE] = sum(n_of.values())
    codes = lm.Codes(np.array(top, np.uint64), np.array([n_of[h] for h in top], np.int64), len(train), rare, np.array([of_bytes[b] for b in range(256)]), lm.table_bits(sum(n_of.values())))

    def decided(t):
        u = units_of(t, codes)
        _, unit, bit, slots = u.decisions(slice(None))
        return u, [(int(u.mode[x]), int(u.word[x]), int(u.chunk[x]), int(b), [(o, int(s[i])) for o, s in enumerate(slots)]) for i, (x, b) in enumerate(zip(unit, bit))]

    seen = Counter()
    for t in train:
        for *_, b, slots in decided(t)[1]:
            seen.update((s, b) for s in slots)
    level = lambda n: (n > 0) + (n >= 4)
    odds = lambda n0, n1: math.log((n1 + lm.PRIOR) / (n0 + lm.PRIOR))
    k = lm.ORDERS + 1
    hessian, slope = np.zeros((lm.GATES, k, k)) + lm.RIDGE * np.eye(k), np.zeros((lm.GATES, k))
    for t in train:
        for mode, _, _, b, slots in decided(t)[1]:
            n = [(seen[s, 0] - (b == 0), seen[s, 1] - (b == 1)) for s in slots]
            x = np.array([odds(*z) for z in n] + [1])
            gate = mode * 16 + sum(level(sum(z)) * 4**e for e, z in zip((1, 0), n[1:]))
            p = 1 / (1 + math.exp(-lm.FIRST_WEIGHT * x[:-1].sum()))
            hessian[gate] += np.outer(x, x) * p * (1 - p)
            slope[gate] += x * (b - p)
    weights = np.clip(lm.even_weights() + np.linalg.solve(hessian, slope[:, :, None])[:, :, 0], -2, 3)
    once = sum(c == 1 and h not in set(top) for h, c in n_of.items())
    again = min(0.5, max(0.0, 1 - (once + 1) / (rare + 2))) if rare else 0.0
    out = []
    for _, t in rows:
        u, each = decided(t)
        factor, score, spelt = 1.0, 0.0, Counter()
        for c in sorted({e[2] for e in each}):
            g = n = 0
            for mode, word, _, b, slots in (e for e in each if e[2] == c):
                z = [(seen[s, 0], seen[s, 1]) for s in slots]
                x = [round(odds(*y) / lm.STEP) * lm.STEP for y in z]
                gate = mode * 16 + sum(level(sum(y)) * 4**e for e, y in zip((1, 0), z[1:]))
                mixed = (2 * b - 1) * (weights[gate, :-1] @ x + weights[gate, -1])
                if mode:
                    spelt[word] -= math.log1p(math.exp(-mixed * factor))
                else:
                    score -= math.log1p(math.exp(-mixed * factor))
                g, n = g + mixed / (1 + math.exp(mixed * factor)), n + 1
            factor = min(2, max(0.5, factor + lm.RATE * g / (n + 200)))
        for word, lp in spelt.items():
            c = n_of[int(u.hashes[word])]
            score += np.logaddexp(lp + math.log(1 - again), math.log(again * c / rare) if c and again else -math.inf)
        out.append(score / math.log(10))
    return out


@pytest.mark.parametrize("frequent,least", [(1 << 18, 8), (40, 2)])
def test_mixer_against_a_decision_at_a_time(spark, frequent, least):
    r = random.Random(21)
    some = [" ".join(r.choice(["alpha", "bravo", "carol", "delta", "q%d" % r.randrange(40), "Über"]) for _ in range(r.randint(0, 90))) for _ in range(40)]
    rows = [*enumerate(some), (None, None), (None, ""), (100, "x" * 700), (101, " ".join(["alpha bravo"] * 400)), (3, some[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = Counter((i, f"{s:.3g}") for (i, _), s in zip(rows, brute_mixer(rows, frequent, least)))
    for parts in (1, 8):  # the result is the same however rows are dealt
        got = lm.score_texts(docs.repartition(parts), frequent=frequent, least=least).collect()
        assert Counter((x["doc_id"], f"{x['score']:.3g}") for x in got) == want


def some_units(n_texts=300):
    import pyarrow as pa
    from heddle.llm.words import text_blocks

    r = random.Random(33)
    texts = pa.array([" ".join(r.choice(["w%d" % int(r.paretovariate(0.7)), "rare%d" % r.randrange(10**6)][: 1 + (r.random() < 0.1)]) for _ in range(400)) for _ in range(n_texts)])
    blocks = [lm.Units(d, o, None) for _, d, o in text_blocks(texts, lm.BLOCK)]
    ids, n = np.unique(np.concatenate([u.hashes for u in blocks]), return_counts=True)
    codes = lm.Codes(ids[n >= 8], n[n >= 8], n_texts, int(n[n < 8].sum()), np.ones(256, np.int64))
    return codes, [lm.Units(d, o, codes) for _, d, o in text_blocks(texts, lm.BLOCK)]


def test_fit_leaves_out_each_decision_and_costs_little_more_than_counting():
    import time

    codes, units = some_units()
    counts = np.zeros((lm.ORDERS, 2 << codes.bits), np.uint32)

    def count():
        for u in units:
            for a in range(0, len(u.code), 4096):
                _, _, bit, slots = u.decisions(slice(a, a + 4096))
                for o in range(lm.ORDERS):
                    np.add.at(counts[o], slots[o] + bit, np.uint32(1))

    def least(run):
        took = []
        for _ in range(3):
            start = time.process_time()
            run()
            took.append(time.process_time() - start)
        return min(took)

    counted = least(count)
    counts = np.minimum(counts // 3, 0xFFFF)
    table, k = lm.FitTable(counts.astype(np.uint16).reshape(lm.ORDERS, -1, 2)), lm.ORDERS + 1
    sums = np.zeros((lm.GATES, k * k + k))
    for u in units:
        table.add(u, sums)
    want = np.zeros((lm.GATES, k * k + k))
    for u in units:
        _, unit, bit, slots = u.decisions(slice(None))
        n = np.array([[counts[o][s] - (bit == 0), counts[o][s + 1] - (bit == 1)] for o, s in enumerate(slots)]).astype(float)
        x = np.vstack([np.log((n[:, 1] + lm.PRIOR) / (n[:, 0] + lm.PRIOR)), np.ones((1, len(bit)))])
        level = (n.sum(1) > 0).astype(int) + (n.sum(1) >= 4)
        gate = u.mode[unit] * 16 + level[1] * 4 + level[2]
        p = 1 / (1 + np.exp(-lm.FIRST_WEIGHT * x[:-1].sum(0)))
        for g in np.unique(gate):
            z = x[:, gate == g]
            q = p[gate == g]
            want[g] += np.concatenate([((z * (q * (1 - q))) @ z.T).ravel(), z @ (bit[gate == g] - q)])
    assert want.any(1).sum() > 10 and np.allclose(sums, want, rtol=2e-3, atol=2e-3 * np.abs(want).max(1, keepdims=True))
    # Before, a decision was fitted in 64-bit numbers, at four times the time of counting it.
    assert least(lambda: [table.add(u, sums) for u in units]) < 2.5 * counted


def test_words_are_found_among_crowded_hashes():
    r = np.random.default_rng(5)
    ids = np.unique(np.concatenate([r.integers(0, 1 << 64, 3000, np.uint64), np.arange(500, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(70, dtype=np.uint64)]))
    codes = lm.Codes(ids[::2], np.arange(1, len(ids[::2]) + 1), 1, 1, np.ones(256, np.int64))
    place = {int(h): i for i, h in enumerate(codes.ids)}
    assert codes.find(ids).tolist() == [place.get(int(h), -1) for h in ids]
    assert lm.Codes(ids[:0], np.arange(0), 1, 1, np.ones(256, np.int64)).find(ids[:9]).tolist() == [-1] * 9


def test_tables_without_words_or_training_texts(spark):
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    for rows in ([(1, "")], [(1, None)], [(held[0], "some words here"), (held[1], None)], [(1, ""), (2, "one word"), (held[0], "x" * 80_000)]):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(len(rows))
        got = lm.score_texts(docs).collect()
        assert len(got) == len(rows) and all(math.isfinite(x["score"]) and x["score"] <= 0 for x in got)
        assert all(x["n_known"] == 0 and x["train_tokens"] == 0 for x in got) or any(not x["held_out"] for x in got)
        assert all(x["score"] < -20_000 for x in got if x["n_tokens"] == 2 and x["doc_id"] == held[0])


def test_word_order_counts(spark):
    r = random.Random(6)
    phrases = [" ".join(r.choice(["alpha", "bravo", "carol", "delta", "eagle", "fancy", "giant"]) + str(i) for _ in range(6)) for i in range(6)]
    rows = [(i, " ".join(r.choice(phrases) for _ in range(20))) for i in range(1000, 1150)]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    text = " ".join(r.choice(phrases) for _ in range(20)).split()
    mixed = r.sample(text, len(text))
    docs = spark.createDataFrame([*rows, (held[0], " ".join(text)), (held[1], " ".join(mixed))], "doc_id bigint, text string")
    for frequent in (1 << 18, 1):
        got = {x["doc_id"]: x["score"] for x in lm.score_texts(docs, frequent=frequent).collect()}
        assert got[held[0]] > got[held[1]] / 2


def test_a_long_word_costs_all_its_bytes(spark):
    r = random.Random(11)
    junk = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(100_000))
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, t) for i, t in enumerate(texts()) if i not in held] + [(held[0], junk), (held[1], junk[:1000])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for frequent in (1 << 18, 1):
        got = {x["doc_id"]: x for x in lm.score_texts(docs, frequent=frequent).collect()}
        assert got[held[0]]["score"] < -100_000 and got[held[1]]["score"] < -1000
        assert min(got[i]["bits_per_byte"] for i in held) > 4


# pipeline
def test_pipeline_stages(spark, nasty, empty, labels, tmp_path):
    import corpus_pipeline as cp

    items = spark.createDataFrame([(1, " ".join(texts()[0].split()[:12])), (None, None)], "item_id bigint, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = nasty.select(*[f.split()[0] for f in DOCS.split(", ")])
    for start in (plain, empty, nasty):
        docs = start
        for i, (name, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < len(cp.STAGES) - 1:
                assert out.columns == docs.columns
                before = docs.count()
                out.write.mode("overwrite").parquet(str(tmp_path / f"{name}-{len(start.columns)}-{before}"))
                docs = spark.read.parquet(str(tmp_path / f"{name}-{len(start.columns)}-{before}"))
                assert docs.count() == before if name == "secrets" else docs.count() <= before
            else:
                assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_equal_rows_are_dealt_evenly(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 1000, "doc_id bigint, text string").repartition(4)
    got = packing.pack(docs, shard_pieces=10).select("sequence_id").distinct().collect()
    shards = Counter(r[0] >> 40 for r in got)
    assert len(shards) > 50


def brute_quality(text, model):
    """Score by compressing each block alone with either dictionary and with none."""
    import zstandard

    good, bad, size, (centre, scale, w) = model
    data = (text or "").encode()
    blocks = [data[i : i + size] for i in range(0, max(1, len(data)), size)]

    def total(dictionary):
        options = {"level": quality.LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if dictionary:
            options["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
        return sum(len(zstandard.ZstdCompressor(**options).compress(b)) for b in blocks)

    x = ((total(bad) - total(good)) / total(None), math.log(total(None) / sum(len(b) + 1 for b in blocks)))
    z = sum(max(-8, min(8, (v - c) / s)) * k for v, c, s, k in zip(x, centre, scale, w)) + w[-1]
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_quality_scores_against_plain_compression(spark, nasty, labels):
    model = quality.train_quality(nasty, labels)
    rows = nasty.select("doc_id", "text").collect()
    want = Counter((i, f"{brute_quality(t, model):.6f}") for i, t in rows)
    got = quality.score_quality(nasty, model).collect()
    assert Counter((r["doc_id"], f"{r['score']:.6f}") for r in got) == want
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_toxicity_scores_against_one_word_at_a_time(spark, labels):
    rows = [(i, t) for i, t in enumerate(texts(), 10)] + [(1, None), (2, ""), (3, "i.d.i.o.t word")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train_toxicity(docs, labels)
    if isinstance(model, float):
        pytest.skip("labels of one class")
    table, (centre, scale, w) = model
    for r in toxicity.score_toxicity(docs, model).collect():
        own = next(t for i, t in rows if i == r["doc_id"]) or ""
        margins = [float(toxicity.margins(*toxicity.marked(x), table).max() + table[-1]) for x in own.lower().split()]
        best = toxicity.document_features([own], table)[0][0]
        if margins:
            assert abs(max(-2, *margins, -2) - best[0]) < 1e-3
            assert abs(sum(m > 0 for m in margins) - math.expm1(best[1])) < 0.01
        z = sum(max(-8, min(8, (v - c) / s)) * k for v, c, s, k in zip(best, centre, scale, w)) + w[-1]
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-5


def test_pipeline_against_brute_force(spark, labels, tmp_path):
    import corpus_pipeline as cp

    base = texts()
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    rows = [(i, t) for i, t in enumerate(base, 10)] + [(None, base[0]), (None, "alone and without an id"), (5, ""), (6, None), (7, f"the key is {key} here"), (300, base[3] + " extra"), (8, " ".join(base[5].split()[:14]) + " with more"), (8, "clean words on the same id")]
    items = [(1, " ".join(base[5].split()[:12])), (None, "not in any text at all")]
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    model = quality.train_quality(docs, labels)
    stages = dict(cp.STAGES)
    pairs = lambda df: Counter(map(tuple, df.select("doc_id", "text").collect()))

    kept = stages["quality"](spark, docs, str(tmp_path))
    assert pairs(kept) == Counter((i, t) for i, t in rows if isinstance(model, float) and model >= 0.3 or not isinstance(model, float) and brute_quality(t, model) >= 0.3)

    alone = stages["near_duplicates"](spark, docs, str(tmp_path))
    sets = [{tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = min(least.get(g, math.inf), math.inf if i is None else i)
    got = pairs(alone)
    assert sum(got.values()) == len(set(group))
    assert sorted(i for i, t in got.elements() if i is not None and words(t)) == sorted(x for g, x in least.items() if x < math.inf and sets[group.index(g)])

    clean = stages["decontamination"](spark, docs, str(tmp_path))
    assert pairs(clean) == Counter((i, t) for i, t in rows if not brute_hits(t, items)[4])

    marked = stages["secrets"](spark, docs, str(tmp_path))
    assert Counter(i for i, _ in pairs(marked).elements()) == Counter(i for i, _ in rows)
    assert (7, "the key is [SECRET] here") in pairs(marked)

    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for i, _ in rows)
    assert len(by_sequence) <= -(-sum(r["length"] for r in packed) // 2048) + 1


def test_coding_a_block_takes_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from heddle.llm.words import text_blocks

    texts = pa.array([" ".join(f"w{i % 97}{j % 89}" for j in range(400)) for i in range(1200)])
    codes = lm.Codes(np.arange(1, 5, dtype=np.uint64), np.arange(1, 5), 1, 1, np.ones(256, np.int64))
    for _, data, offsets in text_blocks(texts.slice(0, 1), lm.BLOCK):
        lm.Units(data, offsets, codes)  # what stays: powers
    for block in (lm.BLOCK, getattr(lm, "SCORED", lm.BLOCK)):
        tracemalloc.start()
        for _, data, offsets in text_blocks(texts, block):
            lm.Units(data, offsets, codes)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 256 * (1 << 19), peak


def test_workers_get_long_texts_by_batches_of_bounded_bytes(spark):
    import pyarrow as pa

    from heddle.llm import common

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], names=["rows", "bytes"])

    texts = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 5000).alias("text"))  # 30 MB
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    few = texts.limit(2)
    try:
        for step in (packing.cut_documents, secret_scan.redact_secrets, lambda d: quality.keep_good(d, 0.5), ngram_join.one_of_each):
            spark.conf.unset(key)
            step(few)
            seen = texts.transform(common.mapped, run, "rows long, bytes long").collect()
            assert sum(r["rows"] for r in seen) == 600
            assert max(r["bytes"] for r in seen) < (4 << 20) + 100_000
        spark.conf.set(key, str(10 << 20))  # the user's own bound stays
        packing.cut_documents(few)
        seen = texts.transform(common.mapped, run, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in seen) == 600
        assert 8 << 20 < max(r["bytes"] for r in seen) < (10 << 20) + 100_000
    finally:
        spark.conf.unset(key)
