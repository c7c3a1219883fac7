"""Pages, archives, fingerprints, conversations, languages and the mix."""

from __future__ import annotations

import glob
import gzip
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, html_extract, langid, mixing, spotsigs, warc
from tests.llm.conftest import prose

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><p>no</p>";</script><style>p{}</style></head>
<body class="has-sidebar"><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies, and this is a long notice for all of the readers of the site and of the others.</div>
%s<aside>More of the same for you and for all of the others who have come to the site to read it.</aside>
<form>Name <input name=n> and a long text that is to be read by the one who has to fill in the form for us.</form>
<div id="comments"><p>I think that it is the best of all the texts that I have ever read and it was a joy to do so.</p></div>
<footer>&copy; all of the rights are with the owners of the site and not with the others.</footer></body></html>"""
LONG = "The cat sat on the mat and it was a good day for all of the others that were in the house by the sea with her."


def test_marked_articles_and_their_blocks():
    article = f"<article><h1>A &amp; B</h1><p><b>{LONG}<br>next<p>Ti.<div class='ad'>{LONG}</div><pre>x\n  y</pre></article>"
    assert html_extract.main_text(PAGE % article) == f"A & B\n{LONG} next\nTi.\nx y"
    assert html_extract.main_text("<article><p>ab</p><ul class=menu><li>cd</ul></article><p>" + LONG) == "ab"


def test_unmarked_pages_are_judged_by_density():
    body = f"<div><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><p><a href=x>{LONG}</a></p><div>x1 x2 " + "zq " * 60 + "</div>"
    assert html_extract.main_text(PAGE % body) == f"Head\n{LONG}\nShort.\n{LONG}"


@pytest.mark.parametrize("name", ["main-sidebar", "main-menu", "no-print cookie-notice", "comments with-avatars", "ad-layout", "userComments", "siteNavigation"])
def test_names_of_boilerplate(name):
    """Also in camel case and beside words of layout; a name that says what an element has is not that thing."""
    for page in ("%s", "<article>%s</article>"):
        for kind in ("class", "id"):
            assert html_extract.main_text(page % f"<div {kind}='{name}'><p>{LONG} one</p></div><p>{LONG}</p>") == LONG
    for kept in ("has-sidebar", "page-with-sidebar no-ads", "loads", "hasSidebar"):
        assert html_extract.main_text(f"<div class='{kept}'><p>{LONG} one</p></div><p>{LONG}</p>") == f"{LONG} one\n{LONG}"


def nearest_labels(found, labels):
    """The second pass, each open block looking for its neighbours by itself."""
    out = []
    for i, label in enumerate(labels):
        if label is None:
            near = []
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(found) and (found[j].outside or (found[j].article == found[i].article and labels[j] is None)):
                    j += step
                if 0 <= j < len(found) and found[j].article == found[i].article:
                    near.append((abs(j - i), labels[j]))
                elif found[i].article:
                    near.append((len(found), True))
            closest = [x for d, x in near if d == min(d for d, _ in near)]
            label = found[i].linked == 0 if not near else any(closest) if found[i].article else all(closest)
            if found[i].heading and len(near) == 2:
                label = near[1][1]
        out.append(label)
    return out


def test_second_pass_against_a_search_from_each_block():
    r = random.Random(6)
    for _ in range(4000):
        found = [html_extract.Block("x", r.choice([0, 0, 1]), r.random() < 0.3, r.choice([0, 0, 1, 2]), r.random() < 0.2) for _ in range(r.randint(0, 14))]
        labels = [False if b.outside else r.choice([True, False, None, None]) for b in found]
        assert html_extract.second_pass(found, labels) == nearest_labels(found, labels)


@pytest.mark.parametrize("piece", ["<p>short one</p>", "<div>", "<b></i>", "<a>x", "<p>word</p></div>", "<h2>x</h2>"])
def test_long_pages_take_time_by_length(piece):
    start = time.perf_counter()
    html_extract.main_text(piece * 100_000)
    assert time.perf_counter() - start < 10


def test_odd_pages(spark):
    rows = [(1, None, None, "a"), (None, "u", "", "a"), (3, "u", "<p", "a"), (4, "u", "a < b &amp c &#x41;", "a"), (5, "u", "<b>" * 5000 + "x", "a"), (5, "u", "<!-- x", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract(pages).collect())
    assert got == [(0, "", 0), (1, "", 0), (3, "", 0), (4, "a < b & c A", 11), (5, "", 0), (5, "x", 1)]
    assert html_extract.extract(pages.limit(0)).columns == ["page_id", "url", "text", "n_chars"]


def test_archives_round_trip(spark, tmp_path):
    big, other = "é\r\n\r\nWARC/1.1\r\n" * 200, "b" * 2000
    rows = [(1, "http://a/\nb", big), (2, None, big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", other), (7, "u", other), (7, "u", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"), records_per_file=4)
    files = glob.glob(str(tmp_path / "w/*.gz"))
    records = [r for f in files for r in warc.parse(gzip.open(f).read())]
    assert len(records) == 3 * len(rows) and all(len(list(warc.parse(gzip.open(f).read()))) <= 4 for f in files)
    got = warc.captures(warc.read_warc(spark, str(tmp_path / "w"))).collect()
    assert len(got) == len(rows) and all(r.request and r.metadata for r in got)
    out = sorted((r.page_id or 0, r.response.type, r.response.payload_bytes, r.response.digest, r.response.refers_to_page) for r in got)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    size = len(big.encode())
    assert out == sorted(
        [(1, "revisit", size, sha(big), 9), (2, "revisit", size, sha(big), 9), (9, "response", size, sha(big), None), (0, "response", 2000, sha(other), None)]
        + [(i, "response", len(t or ""), sha(t), None) for i, t in ((3, "small"), (4, "small"), (5, None), (7, other), (7, other))]
    )
    assert all(r.response.digest_ok for r in got if r.response.type == "response")
    warc.write_warc(pages.limit(0), str(tmp_path / "e"))
    assert warc.captures(warc.read_warc(spark, str(tmp_path / "e"))).count() == 0


def test_cut_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


def brute_signatures(text):
    import re

    w = [x for x in re.split(r"[^\w]+|_+", text.lower()) if x]
    out = set()
    for i, x in enumerate(w):
        if x in spotsigs.ANCHORS or not any(y in spotsigs.ANCHORS for y in w[max(0, i - spotsigs.REACH + 1) : i + 1]):
            chain = [y for y in w[i + 1 : i + 1 + spotsigs.REACH] if y not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if chain:
                out.add((x, *chain))
    return out or ({tuple(w)} if w else set())


def test_fingerprints_of_edited_texts(spark, make_docs):
    r = random.Random(2)
    texts = {i: " ".join(r.choice([w, w, "the", "of"]) for w in prose(i, r.choice([1, 3, 40, 200]))) for i in range(0, 6000, 97)}
    texts[97] = texts[0]
    got = {x.doc_id: x for x in spotsigs.edited_pairs(make_docs(list(texts.items()))).collect()}
    ids = sorted(texts, reverse=True)
    sets = {i: brute_signatures(t) for i, t in texts.items()}
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, after in zip(ids, ids[1:] + ids[:1]):
        k = len(texts[i]) // 3
        changed = texts[i][: len(texts[i]) - k] + texts[after][:k]
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[i].n_chars == len(texts[i])
        assert got[i].near_edited == pytest.approx(likeness(sets[i], brute_signatures(changed)))
        assert got[i].near_next == pytest.approx(likeness(sets[i], sets[after]))
    assert got[0].fingerprint == got[97].fingerprint and len({x.fingerprint for x in got.values()}) == len(set(texts.values()))


def test_common_words_are_looked_up_once_a_word(make_docs):
    rows = make_docs([(1, "of the one and two on three the the of four by"), (2, "x of the a in to of the by y z")]).select("doc_id", "text")
    signed = spotsigs.with_signatures(rows, {"text": "sigs"})
    assert str(signed._jdf.queryExecution().optimizedPlan()).count("INSET") == 1  # the list stands there once
    from pyspark.sql import functions as F

    for r in signed.collect():
        brute = [F.xxhash64(F.lit(x), F.array(*map(F.lit, chain))) for x, *chain in brute_signatures(r.text)]
        assert r.sigs == sorted(signed.limit(1).select(*[b.alias(str(i)) for i, b in enumerate(brute)]).first())


def test_fingerprints_of_odd_rows(odd_docs, make_docs):
    got = spotsigs.edited_pairs(odd_docs).collect()
    assert len(got) == 11 and len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1
    assert all(r.near_next == 1.0 for r in got if r.doc_id == 3)  # 2 is as empty
    assert spotsigs.edited_pairs(make_docs([])).count() == 0


def test_near_documents_by_length_partition(make_docs):
    base = ("the " + " of ".join(prose(5, 80))).split()
    rows = [(1, " ".join(base)), (2, " ".join(base[:-6] + ["x"] * 6)), (3, " ".join(base[:80])), (4, "of " + " the ".join(prose(6, 60)))]
    assert {(r.a, r.b) for r in spotsigs.near_documents(make_docs(rows)).collect()} == {(1, 2)}


def test_preferences_share_their_prompt(spark):
    turn = "array<struct<role:string,text:string>>"
    u, a, b = ("user", "hi"), ("assistant", "yés"), ("assistant", "no")
    rows = [(1, [u, a, u, a], [u, a, u, b]), (2, [u, a], [u, a]), (3, [a], [u]), (4, None, [u]), (5, [u, a, u], [u, a])]
    got = {r.id: r for r in chat.preferences(spark.createDataFrame(rows, f"id long, chosen {turn}, rejected {turn}")).collect()}
    assert [got[i].n_common for i in range(1, 6)] == [3, 2, 0, 0, 2]
    one = got[1]
    assert one.prompt.count("<|im_start|>") == 3 and one.chosen_text == "<|im_start|>assistant\nyés<|im_end|>\n"
    assert [one.chosen_text[s.start : s.end] for s in one.chosen_mask] == ["yés<|im_end|>"]
    assert got[2].chosen_text == got[2].rejected_text == "" and got[3].prompt == "" and got[3].rejected_mask == []
    for r in got.values():
        turns = next(x for x in rows if x[0] == r.id)[1] or []
        assert r.prompt + r.chosen_text == "".join(f"<|im_start|>{x}\n{t}<|im_end|>\n" for x, t in turns)


def test_odd_conversations(spark):
    rows = [(0, 0, "user", "a"), (0, 0, "user", "a"), (0, 1, None, None), (None, 1, "user", "x"), (1, None, "user", "x"), (2, 0, "user", "q"), (3, 0, "user", "r")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: (r.chosen, r.rejected) for r in chat.swapped_answers(table).collect()}
    assert set(got) == {0, 2, 3} and len(got[0][0]) == 2 and len(got[0][1]) == 1 and got[2][1][0].text == "r"
    assert chat.swapped_answers(table.limit(0)).count() == 0


def test_forward_pass_sums_all_segmentations():
    chance = {"▁": 0.1, "▁a": 0.2, "a": 0.15, "b": 0.05, "ab": 0.25, "▁ab": 0.01}
    model = langid.Model(["x"], {k: (v,) for k, v in chance.items()}, 3)
    begun = langid.starts(model.pieces)
    total = 0.01 + 0.2 * 0.05 + 0.1 * 0.25 + 0.1 * 0.15 * 0.05
    import math

    assert math.exp(langid.log_likelihoods("ab", model, begun)[0]) == pytest.approx(total)
    counts = langid.expected_pieces("ab", chance, 3)
    assert counts["▁ab"] == pytest.approx(0.01 / total) and sum(counts[p] * len(p) for p in counts) == pytest.approx(3)
    scores = langid._Scores(model)
    words = ["ab", "a", "b", "q", "abqab", "qqqq", "ab" * 20, "ba" * 12]
    together = langid.block_likelihoods(words, model, scores.ids, scores.chances)
    assert together[:, 0].tolist() == pytest.approx([langid.log_likelihoods(w, model, begun)[0] for w in words])
    scores.meet({*words, "ab" * 40})
    assert set(scores) == set(words) and scores.table[scores["abqab"]][0] == pytest.approx(langid.log_likelihoods("abqab", model, begun)[0])
    long = langid.log_likelihoods("ab" * 400, model, begun)[0]
    part = langid.log_likelihoods("ab" * 40, model, begun)[0]
    assert long == pytest.approx(part * 10, rel=0.1) and math.isfinite(langid.log_likelihoods("q" * 5000, model, begun)[0])


def test_held_out_languages_are_told(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    got = langid.predict(docs, model).where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 30 and right >= 0.97


def test_languages_of_odd_rows(odd_docs, make_docs):
    model = langid.fit(odd_docs)
    got = langid.predict(odd_docs.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == 11 and all((r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    none = langid.fit(make_docs([]))
    assert none.languages == [] and langid.predict(odd_docs, none).where("lang_pred <> 'und'").count() == 0
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() <= 7


def brute_targets(sizes, weights):
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix_meets_its_targets(make_docs):
    r, rows = random.Random(1), []
    for source, n in (("a", 30), ("b", 300), ("c", 5), ("d", 1), (None, 60), ("é", 90)):
        rows += [(len(rows) + i, " ".join(["w"] * r.randint(0, 200)), "en", source) for i in range(n)]
    plan = mixing.mix_plan(make_docs(rows), shards=8).cache()
    got = plan.select("doc.doc_id", "doc.source", "size", "source_size", "target", "draws").collect()
    sizes = {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for s in sizes:
        own = [x for x in got if x.source == s]
        taken = sum(x["size"] * len(x.draws) for x in own)
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        assert abs(taken - want[s]) <= 200 and max(len(x.draws) for x in own) <= 3
    copies = [(x.doc_id, d.epoch) for x in got for d in x.draws]
    assert len(copies) == len(set(copies)) and {d.shard for x in got for d in x.draws} <= set(range(8))
    again = mixing.mix_plan(make_docs(rows[::-1]), shards=8).select("doc.doc_id", "draws").collect()
    assert {x.doc_id: x.draws for x in again} == {x.doc_id: x.draws for x in got}


def test_splitting_tree_gives_every_block_once(spark):
    quotas = {0: 40, 1: 0, 2: 7, 3: 153}
    table = spark.createDataFrame(list(quotas.items()), "place int, quota long")
    rows = mixing.splitting_tree(table, 16).collect()
    assert {p: sum(r.blocks for r in rows if r.place == p) for p in quotas} == quotas
    loads = [sum(r.blocks for r in rows if r.shard == s) for s in range(16)]
    assert max(loads) - min(loads) <= 1 and all(r.first == sum(x.blocks for x in rows if x.place == r.place and x.shard < r.shard) for r in rows)
    # a source's blocks spread as draws without replacement do
    draws = [r.blocks for seed in range(30) for r in mixing.splitting_tree(table, 2, seed).collect() if (r.place, r.shard) == (0, 0)]
    assert abs(sum(draws) / 30 - 20) < 2.5 and len(set(draws)) > 3


def test_mix_of_odd_rows(odd_docs, make_docs):
    plan = mixing.mix_plan(odd_docs)
    assert plan.count() == 11 and plan.select("doc.*").columns == odd_docs.columns
    out = mixing.mixed(odd_docs)
    assert out.columns == [*odd_docs.columns, "mix_epoch", "mix_shard", "mix_place"]
    assert mixing.mixed(make_docs([]), shards=4).count() == 0
