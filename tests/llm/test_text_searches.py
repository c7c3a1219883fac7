"""Joins and searches over texts against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from millrace.llm import components, decontam, jaccard, licenses, passages
from millrace.llm.prefixes import signatures
from millrace.llm.words import grams, hashes, shingle_set, words
from tests.llm.conftest import prose


def edited(tokens, seed, n):
    r, out = random.Random(seed), list(tokens)
    for _ in range(n):
        out[r.randrange(len(out))] = "edit" + str(r.randrange(10**6))
    return out


def brute_components(rows, percent=80):
    sets = {i: set(shingle_set(t).tolist()) for i, t in rows if i is not None}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.fixture(scope="module")
def groups():
    """A large group of near copies, groups of a few, exact copies, and a passage that all share."""
    rows, shared = [], prose(99, 12)
    base = prose(0, 120)
    for i in range(60):
        rows.append(edited(base, i, i % 9))
    for g in range(1, 12):
        own = shared + prose(g, 30 + 7 * g)
        rows += [own, own, edited(own, g, 1), edited(own, g + 50, 3), own[: len(own) * 5 // 6]]
    rows += [shared + prose(1000 + i, 4) for i in range(30)] + [["a", "b"], ["a", "b"], ["a"], ["A", "B"]]
    random.Random(3).shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_similar_sets_share_enough_signatures():
    r = random.Random(5)
    for n in (1, 4, 5, 11, 30, 95, 400):
        for share in (0.0, 0.5, 1.0):
            union = np.unique(np.array([r.getrandbits(64) for _ in range(n * 2)], np.uint64))
            a = np.sort(union[:n])
            for drop in (0, 1, n // 9, n // 5):
                b = np.sort(np.concatenate([a[drop:], union[n : n + drop // 2]]))
                if len(b) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                    frequent = np.array(sorted(x for x in union if r.random() < share), np.uint64)
                    (x, p), (y, q) = signatures(a, frequent, 80), signatures(b, frequent, 80)
                    assert len(np.intersect1d(x, y)) >= min(p, q), (n, share, drop)


@pytest.mark.parametrize("frequent,block", [(8, 16), (3, 256), (10**6, 256)])
def test_components_are_those_of_all_pairs(groups, make_docs, frequent, block):
    got = jaccard.ngram_components(make_docs(groups), frequent=frequent, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(groups)


def test_equal_texts_keep_their_near_copies_when_ids_fall(make_docs):
    text = prose(7, 60)
    near = text[:-1] + ["edit"]
    rows = [(9, " ".join(text)), (4, " ".join(text)), (6, " ".join(near)), (2, " ".join(prose(8, 60)))]
    got = jaccard.ngram_components(make_docs(rows).coalesce(1)).collect()
    assert {r.doc_id: r.component_id for r in got} == {9: 4, 4: 4, 6: 4, 2: 2}


def test_jaccard_join_of_odd_rows(odd_docs, make_docs):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.ngram_components(odd_docs).collect())
    assert [(a, c) for a, _, c in got] == [(0, None), (0, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (5, 5), (6, 5), (7, 7), (8, 8)]
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 10
    assert jaccard.ngram_components(make_docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_chains_take_matches_in_order():
    found = passages.chains([0, 10, 20, 30, 40], [100, 110, 5, 130, 140])
    assert found[0] == ([0, 10, 30, 40], [100, 110, 130, 140])
    assert len(passages.chains([0, 500], [0, 500])) == 2  # too far apart
    assert passages.chains([0, 0, 8], [7, 50, 15])[0] == ([0, 8], [7, 15])


def test_every_shared_run_has_a_seed():
    shared = prose(3, passages.K + passages.WINDOW - 1)
    for i in range(30):
        a, b = prose(i + 10, i % 7) + shared + prose(i + 50, 20), prose(i + 90, 13) + shared
        seeds = [set(passages.seed_places(hashes([w.encode() for w in x]))[0].tolist()) for x in (a, b)]
        assert seeds[0] & seeds[1]


def test_passages_are_found_and_cut(make_docs):
    p, q = prose(1, 80), prose(2, 60)
    loose = p[:20] + ["new", "words"] + p[20:40] + p[41:]
    rows = [
        (1, " ".join(prose(10, 30) + p + prose(11, 30))), (2, " ".join(prose(12, 90) + loose + prose(13, 5))),
        (3, " ".join(q)), (4, " ".join(prose(14, 10) + p[:30] + q)), (5, " ".join(prose(15, 200) + p[:40])), (6, " ".join(q)),
        (7, " ".join(["la"] * 90)), (8, " ".join(["la"] * 90)), (9, " ".join(prose(16, 60) * 2)),
    ]
    found = {}
    for r in passages.repeated_passages(make_docs(rows)).collect():
        found.setdefault(r.doc_id, []).append((r.start_word, r.end_word, r.first_doc_id, r.first_start, r.first_end))
    assert found[2] == [(90, 171, 1, 30, 110)]
    assert found[4] == [(40, 100, 3, 0, 60)] and found[6] == [(0, 60, 3, 0, 60)]
    assert set(found) == {2, 4, 6, 8}  # 40 words are too few, repeats within a document do not count
    left = {r.doc_id: r for r in passages.drop_repeats(make_docs(rows)).collect()}
    assert set(left) == {1, 2, 3, 4, 5, 7, 9} and left[1].text == rows[0][1] and left[1].n_chars == len(rows[0][1])
    assert left[4].text.split() == rows[3][1].split()[:40] and left[4].n_chars == len(left[4].text)


def test_replaced_runs_split_no_passage():
    for seed in range(40):
        for side, n in ((44, 9), (44, 10), (44, 11), (44, 12), (24, 12), (27, 12)):
            text = prose(seed, 2 * side + n)
            other = text[:side] + prose(seed + 500, n) + text[side + n :]
            rows = [prose(seed + 900, 20) + other + prose(seed + 950, 20), prose(seed + 700, 30) + text + prose(seed + 750, 30)]
            a, b = (hashes([w.encode() for w in r]) for r in rows)
            (x, at), (y, there) = passages.seed_places(a), passages.seed_places(b)
            both = sorted((int(p), int(q)) for u, p in zip(x, at) for v, q in zip(y, there) if u == v)
            found = []
            for dp, fp in passages.bridged(passages.chains(*map(list, zip(*both)))):
                found += passages.align(a, b, dp, fp)
            assert [f[:4] for f in found] == [(20, 20 + len(text), 30, 30 + len(text))], (seed, side, n)


def test_every_copy_of_a_passage_is_found(make_docs):
    p = prose(1, 60)
    twice, many = p + prose(2, 40) + p, [w for i in range(20) for w in p + prose(30 + i, 9)]
    rows = [(1, " ".join(prose(3, 9) + p)), (2, " ".join(twice)), (3, " ".join(many)), (4, " ".join(p + prose(4, 70) + p[:30]))]
    found = {(r.doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(make_docs(rows)).collect()}
    assert found == {(2, 0, 60), (2, 100, 160), *[(3, 69 * i, 69 * i + 60) for i in range(20)], (4, 0, 60)}


@pytest.mark.parametrize("spread", [1024, 2])
def test_passages_whose_parts_come_first_elsewhere(make_docs, monkeypatch, spread):
    monkeypatch.setattr(passages, "SPREAD", spread)
    p = prose(1, 60)
    loose = p[:15] + ["new"] + p[16:44] + ["word"] + p[45:]
    rows = [
        (1, " ".join(prose(2, 20) + p[:30])), (2, " ".join(p[30:] + prose(3, 20))), (3, " ".join(prose(4, 9) + p)),
        (4, " ".join(prose(5, 40) + loose)), (5, " ".join(p[:30] + prose(6, 40) + p[30:])), (6, " ".join(p)),
    ]
    found = {(r.doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(make_docs(rows)).collect()}
    assert found == {(4, 40, 100), (6, 0, 60)}


def test_passages_of_odd_rows(odd_docs, make_docs):
    assert {r.doc_id for r in passages.repeated_passages(odd_docs).collect()} == {6}
    left = passages.drop_repeats(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == 10
    assert passages.repeated_passages(make_docs([])).count() == 0


def test_words_are_cut_with_the_space_behind_them():
    assert passages.without_words(" a  b\nc d ", [(1, 3)]) == " a  d "
    assert passages.without_words("a b c", [(0, 2), (1, 3)]) == ""


def test_items_inside_long_documents(spark, make_docs):
    r = random.Random(4)
    items = [(i, " ".join(prose(1000 + i, r.choice([1, 3, 5, 9, 20, 40, 90, 150])))) for i in range(60)] + [(900, None), (901, "")]
    rows = []
    for i in range(120):
        text = prose(i, r.choice([10, 300, 4000]))
        if i % 3 == 0:
            item = items[i // 3][1].split()
            at = r.randrange(len(text))
            text[at:at] = edited(item, i, len(item) // 40) if i % 2 else item
        rows.append((i, " ".join(text)))

    def share(item, doc):
        own = hashes(words(item))
        k = min(5, len(own))
        a, b = set(grams(own, k).tolist()), set(grams(hashes(words(doc)), k).tolist())
        return 100 * len(a & b) >= 80 * len(a)

    want = {(i, d) for i, t in items if t for d, x in rows if share(t, x)}
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.item_id, x.doc_id) for x in decontam.contained_items(make_docs(rows), table).collect()}
    assert got == want and len(want) >= 40
    left = decontam.drop_contaminated(make_docs(rows), table)
    assert {x.doc_id for x in left.collect()} == {d for d, _ in rows} - {d for _, d in want}


def test_items_in_groups_and_odd_rows(spark, odd_docs, make_docs, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 4)
    table = spark.createDataFrame([(i, "one two three four five six") for i in range(20)] + [(None, "word")], "item_id long, text string")
    got = decontam.contained_items(odd_docs, table).collect()
    assert len(got) == 21 and {r.doc_id for r in got} == {None, 4}
    assert decontam.drop_contaminated(odd_docs, table).count() == 9
    assert decontam.contained_items(make_docs([]), table.limit(0)).count() == 0


def test_notices_with_errors():
    n, found = licenses.matches("It is Licenced under the Apache Licence, version 2.0! Apache  License")
    assert n == 12 and [(m.label, m.exact, m.word) for m in found] == [("apache", True, 10), ("apache", False, 2)]
    assert 0 < found[1].errors <= 4 and found[1].score < 1
    assert {m.label for m in licenses.matches("GNU  Lesser-General Public License; MIT license.")[1]} == {"lgpl", "mit"}
    assert licenses.matches(None) == (0, []) and licenses.matches(" .,")[0] == 0
    assert licenses.matches("gnu general public licenses")[1][0].exact is False


def test_worse_notices_before_better_ones():
    text = "released under the mit licence by x released under the mit license"
    assert [(m.word, m.errors) for m in licenses.matches(f"{text} {text}")[1] if not m.exact] == [(0, 1), (7, 0), (12, 1), (19, 0)]


def test_words_of_many_matches():
    """Places are words from 0, also beyond characters of several bytes; time grows with the text."""
    import time

    text = "漢字 é released under the mit license " * 4000
    start = time.perf_counter()
    n, found = licenses.matches(text)
    assert time.perf_counter() - start < 20 and n == 7 * 4000
    exact = [m for m in found if m.exact]
    assert [m.word for m in exact] == [7 * i + 5 for i in range(4000)]
    joined = licenses.joined_words(text)
    assert all(m.word == joined.count(" ", 0, m.start) - 1 for m in found[:50] + found[-50:])


def test_exact_phrases_against_brute_force(make_docs, odd_docs):
    import re

    r, rows = random.Random(8), []
    vocabulary = " ".join(licenses.BASE).split() + ["x", "é", "9"]
    for i in range(200):
        rows.append((i, r.choice(" .\n-é").join(r.choice(vocabulary).title() for _ in range(60))))
    for row in licenses.scan(make_docs(rows)).collect():
        own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", rows[row.doc_id][1].translate({c: c + 32 for c in range(65, 91)}))
        want = sorted(
            (i, label) for p, label in licenses.BASE.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split()
        )
        assert row.n_words == len(own) and sorted((m.word, m.label) for m in row.matches if m.exact) == want
    assert licenses.scan(odd_docs).count() == 11 and licenses.scan(make_docs([])).count() == 0


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 0, 2, 3), (3, 2, 1, 0), (2, 1, 3, 0)])
def test_all_texts_of_a_repeated_id_are_linked(make_docs, order):
    a, b = prose(31, 60), prose(32, 60)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:-1])), (3, " ".join(b[:-1]))]
    got = jaccard.ngram_components(make_docs([rows[i] for i in order]).coalesce(1)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1}
    assert len(got) == 4


def test_a_whole_chain_is_aligned_at_its_ends_only(monkeypatch):
    """Of a chain that is a passage as a whole, the gaps inside are not tried as ends."""
    text = list(range(400))
    other = [-x if x % 40 == 39 else x for x in text]
    tried = []
    reach = passages._reach
    monkeypatch.setattr(passages, "_reach", lambda a, b: tried.append(1) or reach(a, b))
    at = [x for x in range(1, 390) if x % 40 < 34]
    found = passages.align(np.array(text, np.int32), np.array(other, np.int32), at, at)
    assert found == [(0, 399, 0, 399, 390)] and len(tried) == 2


def test_bridges_are_those_of_one_by_one():
    r = random.Random(4)
    for n in (1, 5, 40, 300):
        chains = [([d], [f]) for d, f in {(r.randrange(4 * n), r.randrange(4 * n)) for _ in range(n)}]
        chains = [(d + [d[0] + 3] * (d[0] % 2), f + [f[0] + 5] * (d[0] % 2)) for d, f in chains]
        out, limit = [], passages.BRIDGE + passages.K
        for d, f in sorted(chains):
            near = [i for i, (x, y) in enumerate(out) if 0 < d[0] - x[-1] <= limit and 0 < f[0] - y[-1] <= limit]
            if near:
                i = min(near, key=lambda i: (abs(d[0] - out[i][0][-1] - f[0] + out[i][1][-1]), d[0] - out[i][0][-1]))
                out[i] = (out[i][0] + d, out[i][1] + f)
            else:
                out.append((d, f))
        assert passages.bridged(chains) == out


def test_places_of_a_slice_are_those_of_each_document():
    steps = passages._steps(passages.LEAST_WORDS)
    texts = [prose(i, n) for i, n in enumerate((6, 7, 15, 14, 90, 41, 40, 55, 56, 200))] + [["la"] * 90, ["la"] * 9]
    own = [hashes([w.encode() for w in t]) for t in texts]
    seeds, docs, at, blocks = passages.places_of(np.concatenate(own), np.array([len(o) for o in own]), steps)
    for i, o in enumerate(own):
        want, places = passages.seed_places(o)
        assert seeds[docs == i].tolist() == want.tolist() and at[docs == i].tolist() == places.tolist()
        assert ((blocks[docs == i] > 0) == (places + steps[-1] + passages.K <= len(o))).all()


def test_a_text_that_repeats_itself_is_matched_in_order():
    """Each place is matched with a few, not all with the same, and all of the text is covered."""
    block, n = 41, 2000
    doc = np.array([1] * 60 + [2] * n)
    at = np.concatenate([np.arange(60), np.arange(n)])
    rows, others = passages._pairs(np.zeros(n + 60, np.int64), doc, at, block)
    diagonals = set((at[others] - at[rows]).tolist())
    assert len(diagonals) <= n // 60 + 2
    covered = np.zeros(n + block, bool)
    for x in at[rows]:
        covered[x : x + block] = True
    assert covered[: n - 1].all()


def test_a_long_repeating_text_has_few_passages(make_docs):
    rows = [(1, " ".join(["la"] * 100)), (2, " ".join(prose(1, 20) + ["la"] * 1015))]
    found = passages.repeated_passages(make_docs(rows)).collect()
    covered = set().union(*[range(r.start_word, r.end_word) for r in found])
    assert covered == set(range(20, 1035)) and len(found) <= 40


@pytest.mark.parametrize("spread", [1 << 18, 50])
def test_frequent_seeds_are_dealt_by_documents(make_docs, monkeypatch, spread):
    p, la = prose(1, 60), ["la"] * 70
    rows = [(7 * i, " ".join(prose(100 + i, i % 9) + (p if i % 3 else la) + prose(200 + i, 5) + (p[:45] if i % 2 else []))) for i in range(80)]
    want = sorted(passages.repeated_passages(make_docs(rows)).collect())
    monkeypatch.setattr(passages, "SPREAD", spread)
    monkeypatch.setattr(passages, "FREQUENT", 10)
    dealt = []
    in_order = passages._in_order
    monkeypatch.setattr(passages, "_in_order", lambda *a: dealt.append(in_order(*a)) or dealt[-1])
    assert sorted(passages.repeated_passages(make_docs(rows)).collect()) == want and {r.doc_id for r in want} == {7 * i for i in range(2, 80)} - {0}
    assert all(d.where("part > 0").count() and d.where("known = 1").count() for d in dealt)
