"""Token counts, periodic runs and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import periodic, tokencounts, variants
from tests.llm.conftest import prose

PATH = tokencounts.default_path()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def counted(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect()), key=repr)


def encoded(tokenizer, rows, limit=1024):
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    return sorted(((i, len((t or "").encode()), k, k > limit) for (i, t), k in zip(rows, n, strict=True)), key=repr)


TEXTS = [
    None, "", " ", "\n\n  \t x", "it's we'll I'M 'S", "a  b   c d　e ", "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endoftext",
    "ﬁ Ünïcödé 漢字かな 😀👨‍👩‍👧 \x1c\x1d\x85 ١٢٣ ²³ Ⅷ", "a" * 5000, "!?" * 400, "ᲉꟚ new letters \U00016d40", "the " * 3000,
]


@pytest.mark.parametrize("most_bytes", [tokencounts.COMMON_BYTES, 400, 0])
def test_token_counts_are_the_librarys(make_docs, tokenizer, most_bytes):
    """With all pre-tokens looked up, a few, and none; a third of the rows are copies, and some have no id."""
    rows = [*enumerate(TEXTS), *((i, " ".join(prose(i, 40))) for i in range(30))] + [(7, TEXTS[8])] * 20 + [(None, None), (None, "a b"), (7, "a b")]
    assert counted(tokencounts.token_counts(make_docs(rows), most_bytes=most_bytes)) == encoded(tokenizer, rows)


def test_token_counts_of_an_empty_table(make_docs):
    assert tokencounts.token_counts(make_docs([])).collect() == []


def test_settled_characters_are_classed_alike(tokenizer):
    """The pattern and the library agree on each character that is not handed to the library."""
    own = tokencounts.pre_tokens(PATH)
    settled = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not own._unsettled.match(chr(c))]
    assert len(settled) > 40_000 and all(unicodedata.category(c) != "Cn" for c in settled)
    for i in range(0, len(settled), 500):
        text = "".join(f"a{c}1{c}!{c} {c}a" for c in settled[i : i + 500])
        assert own._pattern.findall(text) == [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        tokencounts.PreTokens(public_tokenizers.path("word_bpe_49k.json"))


def brute_runs(ids, least=12):
    found = {}
    for q in range(1, len(ids) // 2 + 1):
        i = 0
        while i + q < len(ids):
            start = i
            while i + q < len(ids) and ids[i] == ids[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_all_lags(seed):
    r = random.Random(seed)
    for _ in range(250):
        n, k = r.randint(0, 130), r.choice([1, 2, 2, 3, 4, 10, 60])
        ids = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 3) if n > 4 else 0):
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 2))
            for i in range(a + p, min(n, a + p * r.randint(2, 12) + r.randint(0, p))):
                ids[i] = ids[i - p]
        for least in (12, 7):
            assert [tuple(x) for x in periodic.runs(np.array(ids, np.int64), least)] == brute_runs(ids, least)


def test_long_repetitive_texts_are_scanned_fast():
    import time

    fibonacci = "a", "ab"
    while len(fibonacci[1]) < 60_000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    rng = np.random.default_rng(1)
    cases = [np.zeros(200_000, np.int64), np.frombuffer(fibonacci[1].encode(), np.uint8).astype(np.int64), np.tile(rng.integers(0, 9**5, 9**5), 4)]
    start = time.perf_counter()
    found = [periodic.runs(c) for c in cases]
    assert time.perf_counter() - start < 60
    assert found[0] == [(0, 200_000, 1)] and found[2] == [(0, 4 * 9**5, 9**5)] and len(found[1]) > 1000


def test_periodic_rows(make_docs, odd_docs):
    texts = {i: " ".join(prose(i, 60) * (1 + i % 3)) for i in range(60)}
    rows = [*texts.items(), (60, "x " * 500), (61, "a b c " * 4 + "d " + "a b c " * 5), (None, "y " * 30)]
    got = {r.doc_id: r for r in periodic.periodic_runs(make_docs(rows), plant=True).collect()}
    for doc_id, text in rows:
        words = text.split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(words)
        drop = {i for s, k, q in runs for i in range(s + q, s + k)}
        r = got[doc_id]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest()
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == top
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
    assert periodic.periodic_runs(odd_docs).count() == odd_docs.count()
    assert periodic.periodic_runs(make_docs([])).collect() == []


def test_collapsed_documents_keep_their_columns(make_docs, odd_docs):
    docs = make_docs([(1, "a b\n" * 9 + "c"), (2, " two  blanks stay "), (3, None)])
    got = periodic.collapse(docs)
    assert got.schema == docs.schema and {r.doc_id: r.text for r in got.collect()} == {1: "a b c", 2: " two  blanks stay ", 3: None}
    assert periodic.collapse(odd_docs).count() == odd_docs.count()


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def brute_variants(rows, plant):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if plant and doc_id is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [x for x in counts if is_near(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


@pytest.mark.parametrize("block,plant", [(512, True), (3, True), (1, False)])
def test_variants_are_those_of_all_pairs(make_docs, block, plant):
    """Chains of forms, ties, a hot group of words with the same ends, letters outside ASCII, doubled letters."""
    r = random.Random(4)
    bag = ["aaaaaaa"] * 2 + ["aaaaaaaa"] * 20 + ["aaaaaaaaa"] * 200 + ["aaaaaaaab"] * 200 + ["Élèvesßÿ", "élèvesßÿ", "ÉLÈVESßÿ"] * 3
    bag += ["abcdefgh", "abcdefg", "bcdefgh", "abdefgh", "xabcdefgh", "abcdefghx", "abcdXfgh", "abcd÷fgh", "abcd×fgh"] * 2
    bag += [f"prefix{a}{b}suffix" for a in "abcdefghijk" for b in "lmnopqrst" for _ in range(r.randint(1, 3))]
    bag += [w + x for w in (p * 3 for p in prose(9, 40)) for x in ("", "", "s", "s", "q", "")] + ["z" * 300, "z" * 300, "z" * 301] * 2
    r.shuffle(bag)
    rows = [(i, " ".join(bag[i::40]) + ".") for i in range(40)] + [(None, "abcdefgh abcdefgh"), (3, None), (3, "")]
    got = variants.spelling_variants(make_docs(rows), plant=plant, block=block).collect()
    want = brute_variants(rows, plant)
    assert {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in got} == want and len(got) == len(want)
    if not plant:
        assert want["aaaaaaa"][2:] == ("aaaaaaaa", 20, "aaaaaaaaa")  # a chain, and the first of a tie


def test_variants_of_nothing(make_docs, odd_docs):
    assert variants.spelling_variants(make_docs([])).collect() == []
    assert variants.spelling_variants(make_docs([(1, None), (2, "short words only")])).collect() == []
    assert {r.word for r in variants.spelling_variants(odd_docs).collect()} <= {w for w in prose(1, 30_000)}
