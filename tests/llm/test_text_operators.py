"""BPE, surrogates, language model, mixing, pages, licences and url rules against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from pyspark.sql import functions as F

from lakesift.llm import bpe, class_lm, html_extract, license_scan, mixing, pii, url_filter
from lakesift.llm.queries import QUERIES, URL_RULES

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def test_bpe_equals_the_library(spark, edges):
    want = []
    for key, text in documents(spark, edges):
        ids = TIKTOKEN.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in QUERIES["op4_byte_bpe"](spark, edges).collect())


def test_bpe_tree_at_any_leaf_size(monkeypatch):
    r, pattern = random.Random(3), regex.compile(public_tokenizers.PATTERN)
    parts = ["the", "'ll", " ", "  ", "a", "tion", "\n", "'", "é", "漢", "12", "!#", "\t\r", "r", "e", "'r", "🙂"]
    for i in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(40)))
        if i % 20 == 0:
            text = "".join(r.choice("abcdeinotr") for _ in range(r.randrange(50, 600)))
        monkeypatch.setattr(bpe, "PIECE_LEAF", r.choice([1, 2, 5, 24]))
        split = bpe.split_text(text, pattern, r.choice([1, 2, 3, 7, 20]))
        assert split == pattern.findall(text)
        pieces = bpe.Pieces(RANKS)
        assert [t for p in split for t in pieces[p]] == TIKTOKEN.encode_ordinary(text)


def test_bpe_of_long_runs():
    r, pieces = random.Random(6), bpe.Pieces(RANKS)
    runs = [ch * n for ch in "x= -0é" for n in (97, 1000, 5001)]
    runs += ["".join(r.choices(alphabet, k=n)) for alphabet in ("ab", "xX=", "thein", "0123456789", "aAbBcC0123+/") for n in (97, 300, 2000) for _ in range(6)]
    for run in runs:
        want = TIKTOKEN._core_bpe.encode_single_piece(run.encode())
        alike = pieces.merge_alike(run.encode())
        assert pieces.tree(run.encode()) == pieces.merge_agenda(run.encode()) == want and alike in (None, want)
    began = time.process_time()
    assert sum(map(len, map(pieces.bytes_of.get, pieces["=" * 1_000_000]))) == 1_000_000
    assert time.process_time() - began < 5  # about half a second; quadratic work would take hours


def test_surrogates(spark, edges):
    rows = {r["doc_id"]: r for r in QUERIES["op5_pii_surrogates"](spark, edges).collect() if r["doc_id"] is not None}
    assert rows[0]["text"] is None and rows[1]["text"] == ""
    assert rows[17]["kinds"] == "email,phone" and "a.b@mail1" not in rows[17]["text"] and "555-1234" not in rows[17]["text"]
    assert re.fullmatch(r"[a-z]\.[a-z]@[a-z]{4}\d\.example\.com or \+1 \(\d{3}\) 555-\d{4}", rows[17]["text"])
    for i, text in documents(spark, edges):
        if i is not None and i not in (17,) and text:
            assert rows[i]["text"] == text


def test_surrogates_are_consistent_and_distinct(spark):
    people = [f"Mr. {g} {f} met Mrs. Anna {f}. {f} left; call 212-555-{1000 + i}." for i, (g, f) in enumerate(
        (g, f) for g in ("Adam", "Bob", "Carl", "Иван") for f in ("Smith", "Jones", "Meyer", "Dupont", "Rossi", "Silva", "Петров"))]
    docs = spark.createDataFrame(list(enumerate(people)), "doc_id int, text string")
    rows = {r["doc_id"]: r["text"] for r in pii.surrogates(docs, b"k").collect()}
    again = {r["doc_id"]: r["text"] for r in pii.surrogates(docs, b"k").collect()}
    assert rows == again != {r["doc_id"]: r["text"] for r in pii.surrogates(docs, b"other").collect()}
    forward = {}
    for i, text in enumerate(people):
        for (s, e, kind, value), (s2, e2, kind2, new) in zip(pii.find(text), pii.find(rows[i]), strict=True):
            assert kind == kind2 and value != new
            assert forward.setdefault((kind, value), new) == new
    assert len({(k[0], v) for k, v in forward.items()}) == len(forward)
    assert not {(k[0], v) for k, v in forward.items()} & set(forward)


def test_surrogates_of_more_entities_than_names(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    given = [a + b + c for a in letters for b in letters for c in letters][:700]
    entities = [("given-latin-n", v) for v in given] + [("given-cyrillic-n", f"имя{v}") for v in given]
    entities += [("ip", f"{a}.{b}.{c}.{d}") for a in range(1, 10) for b in range(1, 10) for c in range(1, 10) for d in range(1, 10)]
    entities += [("email", f"{a}@{b}.com") for a in letters for b in letters[:9]] + [("secret", "--------"), ("secret", "a-------")]
    frame = spark.createDataFrame(entities, "kind string, value string").repartition(4)
    rows = pii.settled(frame, b"k").collect()
    assert {(r["kind"], r["value"]) for r in rows} == set(entities) and len(rows) == len(entities)
    new = {(r["kind"], r["surrogate"]) for r in rows}
    assert len(new) == len(entities) and not new & set(entities)


def test_longer_surrogates_keep_their_layout():
    values = {"card": "4111 1111 1111 1111", "ssn": "123-45-6789", "phone": "+1 22 33", "iban": "DE44 5001 0517 5407", "email": "a@b.com"}
    for kind, written in values.items():
        value = pii.canonical(kind, written)
        sizes = [len(pii.draw(b"k", kind, value, a)) - len(pii.draw(b"k", kind, value, 0)) for a in (3, 4, 9)]
        assert sizes == [0, 1, 6]
        new = pii.draw(b"k", kind, value, 9)
        assert pii.canonical(kind, pii.lay_out(kind, written, new)) == new


def test_class_model_counts(spark, edges):
    rows = documents(spark, edges)
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\0end"] for _, t in rows]
    out = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    c = Counter(w for ws, o in zip(tokens, out) if not o for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(k), o, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6))
                  for (k, _), o, ws in zip(rows, out, tokens))
    got = QUERIES["op7_class_lm"](spark, edges).collect()
    assert want == sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_exchange_raises_the_likelihood():
    r = np.random.default_rng(1)
    true = r.integers(0, 3, 60)
    pairs = np.zeros((62, 62), np.int64)
    for _ in range(20000):  # words of class c are followed by words of class c + 1
        a = r.integers(0, 60)
        b = r.choice(np.flatnonzero(true == (true[a] + 1) % 3))
        pairs[a, b] += 1
    of = class_lm.exchange(pairs, 60, 3, 10)[:60]
    assert all(len(set(of[true == k])) == 1 for k in range(3)) and len(set(of)) == 3


def test_exchange_never_lowers_the_likelihood_and_ends():
    r = np.random.default_rng(2)
    rank = 1 / (1 + np.arange(32))
    pairs = r.poisson(400 * np.outer(rank, rank) * r.gamma(0.3, 3, (32, 32)))

    def likelihood(of):
        f, pick = class_lm._xlogx, np.eye(8)[of]
        t = pick.T @ pairs @ pick
        return f(t).sum() - f(t.sum(axis=0)).sum() - f(t.sum(axis=1)).sum()

    after = [class_lm.exchange(pairs, 30, 6, k) for k in range(40)]
    scores = [likelihood(of) for of in after]
    assert all(b >= a - 1e-6 for a, b in zip(scores, scores[1:]))
    assert (after[-1] == after[-2]).all() and (class_lm.exchange(pairs, 30, 6) == after[-1]).all()
    for w in range(30):  # where it ends no move of a word raises it
        for b in range(6):
            of = after[-1].copy()
            of[w] = b
            assert likelihood(of) <= scores[-1] + 1e-6


def test_best_class_raises_the_likelihood_most():
    r = np.random.default_rng(4)
    table = r.integers(200, 240, (6, 6)).astype(float)
    before, after = r.integers(0, 5, (30, 6)), np.zeros((30, 6), np.int64)
    before[:, 0] += 1
    for i in range(30):  # as many classes after the word as before it
        after[i] = np.bincount(r.integers(0, 6, before[i].sum()), minlength=6)

    def likelihood(t):
        f = class_lm._xlogx
        return f(t).sum() - f(t.sum(axis=0)).sum() - f(t.sum(axis=1)).sum()

    for got, p, q in zip(class_lm.best_classes(before, after, table, 4), before, after):
        all_ = []
        for b in range(4):
            t = table.copy()
            t[5] -= q  # the word's place so far
            t[:, 5] -= p
            t[b] += q
            t[:, b] += p
            all_.append(likelihood(t))
        assert np.isclose(all_[got], max(all_))


def test_words_beyond_the_frequent_join_learned_classes(spark, monkeypatch):
    """Words alternate between two sets; ten of each are frequent, the others come a
    few times each and have the same shape."""
    monkeypatch.setattr(class_lm, "CHUNK_ROWS", 500)
    r = random.Random(6)
    sets = [[f"{c}{i:04d}z" for i in range(400)] for c in "pq"]
    draw = lambda k: sets[k][r.randrange(10)] if r.random() < 0.8 else r.choice(sets[k])
    rows = [(i, " ".join(draw(j % 2) for j in range(40))) for i in range(300)]
    docs = class_lm._blocks(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    model = class_lm.Model(words=20, classes=2)
    vocabulary = class_lm.requests(docs).groupBy("w", "r").agg(F.sum("n").alias("c")).where("c > 0")
    words, n_classes = class_lm.classes_of(docs, vocabulary, model)
    want = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split())
    names = list(want)
    hashes = class_lm.span_hashes(*class_lm.word_spans([" ".join(names).encode()])[:3]).view(np.int64).tolist()
    found = {x["w"]: x for x in words.where("r < 8").collect()}
    assert {h: want[w] for h, w in zip(hashes, names)} == {h: x["c"] for h, x in found.items()} and len(want) > 600
    # a word whose neighbours were all rare can't be told
    sides = [Counter(found[h]["k"] for h, w in zip(hashes, names) if w[0] == c).most_common(1)[0] for c in "pq"]
    assert n_classes == 2 and sides[0][0] != sides[1][0] and sum(n for _, n in sides) > 0.9 * len(want)


def test_class_probabilities_sum_to_one():
    r = np.random.default_rng(2)
    pairs = r.integers(0, 9, (20, 20))
    of = class_lm.exchange(pairs, 11, 4, 5)
    width = of.max() + 1
    pick = np.eye(width)[of]
    table = pick.T @ pairs @ pick
    prior = (table.sum(axis=0) + 1) / (table.sum() + width)
    p = (table + 5 * prior) / (table.sum(axis=1, keepdims=True) + 5)
    assert np.allclose(p.sum(axis=1), 1)


def test_mix_of_overlapping_sources(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.randrange(0, 60), r.sample(["a", "b", "c"], r.randrange(0, 4))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source array<string>")
    plan = mixing.Mix(weights=(1.0, 1.0, 4.0), share=0.8)
    got = mixing.mix(docs, plan).collect()
    total = sum(len(t.split()) for _, t, _ in rows)
    taken = sum(x["taken"] for x in got)
    reach = sum(len(t.split()) for _, t, s in rows if s)
    assert all(x["taken"] <= 2 * x["size"] for x in got)
    assert abs(taken - min(0.8 * total, 2 * reach)) < 60 * 8
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(5), plan).collect()))


def test_flow_uses_new_words_before_repeats():
    flow = mixing.min_cost_flow({"ab": 10, "a": 10}, {"A": 10, "B": 10}, {"ab": ["A", "B"], "a": ["A"]}, 2)
    assert flow == {("ab", "A"): 0, ("ab", "B"): 10, ("a", "A"): 10}


def test_targets_stop_at_epochs():
    assert mixing.targets([10, 100, 100], [3, 1, 2], 315, 2) == [20.0, pytest.approx(295 / 3), pytest.approx(590 / 3)]


def test_pages(spark, edges):
    rows = {}
    for r in QUERIES["op9_html_extract"](spark, edges).collect():
        rows.setdefault(r["page_id"], []).append(r)
    assert [r["text"] for r in rows[0]] == ["T & t One two bold text"] * 2
    assert rows[1][0]["text"] == rows[2][0]["text"] == "" and rows[1][0]["n_chars"] == 0
    assert rows[3][0]["text"] == "plain <text>" and rows[None][0]["text"] == "unclosed tag" and rows[5][0]["text"] == "deep"
    # a box on every page of the host is template, the page's own text isn't
    assert [rows[10 + i][0]["text"] for i in range(12)] == [f"Own text {i} of the page" for i in range(12)]


@pytest.mark.parametrize("page,text", [
    ("<p>a<p>b<ul><li>x<li>y</ul>", "a b x y"),
    ("<script>var x='</p>';</script><style>p{}</style><article>x<!-- c --><form>f</form><aside>s</aside><div class='comment-list'>c</div>y</article>", "x y"),
    ("<body><header>h</header><div class='cookie notice'>n</div><main>m&nbsp;&eacute;\n\n n</main><div id=sidebar>s</div></body>", "m é n"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("a<br>b<img src=x>c", "a bc"),
])
def test_page_parsing(page, text):
    assert html_extract.main_text(page) == text


def test_shared_passages_of_articles_stay(spark):
    rows = [(i, f"http://h.org/{i}", f"<article><p>Text {i}</p><p>The same passage in all.</p><div><i>Box</i></div></article>") for i in range(20)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert sorted(r["text"] for r in got) == sorted(f"Text {i} The same passage in all." for i in range(20))


@pytest.mark.parametrize("inner", [
    "<h2 id='related-work'>Own</h2><p>text</p>", "<section id='search-algorithms'><p>Own text</p></section>",
    "<div id='social-contract'>Own text</div>", "<p class='notice'>Own text</p>", "Own <div class='ad'>text"])
def test_names_in_articles_delete_no_text(inner):
    assert html_extract.main_text(f"<body><article>{inner}</article></body>") == "Own text"
    assert html_extract.main_text(f"<article>{inner}<div class='share'>Like</div></article>") == "Own text"
    assert html_extract.main_text(f"<div class='with-sidebar'><article>{inner}</article></div>") == "Own text"


def test_a_closed_advert_in_an_article_goes():
    assert html_extract.main_text("<article><p>Own</p><div class='big ad'>Buy</div><p>text</p></article>") == "Own text"


def test_template_of_a_section_of_a_large_host(spark):
    named = "<p class='notice'>Named and repeated</p>"
    rows = [(i, f"http://h.org/a/{i}", f"<body><div>Box of a section</div><p>Text {i} of its own page.</p></body>") for i in range(8)]
    rows += [(i, f"http://h.org/b/{i}", f"<body><article><p>Text {i} of its own page.</p>{named if i < 60 else ''}</article></body>") for i in range(8, 200)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert sorted(r["text"] for r in got) == sorted(f"Text {i} of its own page." for i in range(200))


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://h.org/x", "<body><div>Only text here</div></body>") for i in range(50)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Only text here"}


def test_licences(spark, edges):
    phrases = [(p.split(), label) for p, label in license_scan.PHRASES]
    got = QUERIES["op10_license_scan"](spark, edges).collect()
    want = []
    for key, text in documents(spark, edges):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        hits = [(i, label) for p, label in phrases for i in range(len(words)) if words[i:i + len(p)] == p]
        want.append(repr((key, len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None),
                          ",".join(sorted({h[1] for h in hits})))))
    assert sorted(want) == sorted(repr(tuple(r)[:6]) for r in got)
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_licence_templates_by_diagonals(spark):
    mit = license_scan.TEMPLATES[0][1]
    changed = mit.replace("free of charge", "free of any charge").replace("including without", "including, but not, without")
    rows = [(0, "Some code. " + mit + " More."), (1, changed), (2, "Permission is hereby granted to leave."), (3, (mit + " ") * 3)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[0]["labels"] == got[1]["labels"] == got[3]["labels"] == "mit" and got[2]["labels"] == ""
    assert got[0]["spans"][0]["start"] == 2 and len(got[3]["spans"]) == 3


def test_licences_with_words_inserted_and_dropped(spark):
    texts = {label: text for label, text in license_scan.TEMPLATES if label in ("mit", "gpl", "isc") and len(text) > 100}
    rows, want = [], {}
    for label, text in texts.items():
        words = text.split()
        for n in (4, 6, 10):
            cut = len(words) // 2
            rows.append((len(rows), " ".join(["Before."] + words[:cut] + [f"extra{i}" for i in range(n)] + words[cut:] + ["After."])))
            want[len(rows) - 1] = label
        for n in (4, 6):
            cut = len(words) // 3
            rows.append((len(rows), " ".join(words[:cut] + words[cut + n:])))
            want[len(rows) - 1] = label
    for label in texts:  # too little of a template
        rows.append((len(rows), " ".join(texts[label].split()[: len(texts[label].split()) // 2])))
        want[len(rows) - 1] = ""
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for i, text in rows:
        own = [s["label"] for s in got[i]["spans"]]
        assert own == ([want[i]] if want[i] else []), (text, got[i])


def test_licence_labels_by_brute_force(spark):
    """A text of a template with words lost, doubled or changed has its label if
    enough words match in order, tried with all templates over the whole text."""
    r = random.Random(8)
    rows, want = [], []
    for i in range(60):
        t = r.randrange(len(license_scan.TEMPLATES))
        words = [w for w in license_scan._words(license_scan.TEMPLATES[t][1])]
        for _ in range(r.randrange(0, max(2, len(words) // 4))):
            at = r.randrange(len(words))
            words[at:at + 1] = r.choice([[], [b"other"], [words[at], b"more"]])
        rows.append((i, b" ".join(words).decode()))
        scores = {}
        for label, text in license_scan.TEMPLATES:
            template = license_scan._words(text)
            same = sum(m.size for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks())
            scores[label] = max(scores.get(label, 0), same / len(template))
        want.append(scores)
    for row in license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        scores = want[row["doc_id"]]
        own = {s["label"] for s in row["spans"]}
        assert all(scores[label] >= license_scan.MIN_SHARE for label in own), (rows[row["doc_id"]], own)
        best = max(scores.values())
        if best >= license_scan.MIN_SHARE + 0.05:
            assert own & {label for label, x in scores.items() if x >= best - 0.05}, (rows[row["doc_id"]], scores, own)


def test_url_rules(spark, edges):
    rules = [(r.split()[0], *r.split()[1].partition("/")) for r in URL_RULES]
    got = QUERIES["op2_url_filter"](spark, edges).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{edges}/pages.parquet").collect()}
    for r in got:
        rest = (urls[r["page_id"]] or "").partition("://")[2]
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = lower(m[1]), m[2]
        assert (r["host"], r["path"]) == (host, path)
        fit = [(len(h + s + p), h + s + p, v) for v, h, s, p in rules if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        assert r["rule"] == (max(fit)[1] if fit else None)
        assert r["verdict"] == max(fit)[2] if fit else r["verdict"] in ("allow", "block")


def test_url_trees_on_held_out_urls(spark):
    r = random.Random(8)
    good = [f"http://site{i}.example.org/news/{r.choice(['sport', 'art', 'city'])}" for i in range(300)]
    bad = [f"http://x{r.randrange(9)}.casino.net/{r.randrange(10**9)}?a={r.randrange(10**6)}&b={r.randrange(10**6)}&c=1" for i in range(300)]
    rules = url_filter.parse_rules(["allow example.org/"])
    held = [(f"http://x{r.randrange(9)}.poker.net/{r.randrange(10**9)}?a=77777&b=88888&c=1", "block") for _ in range(40)]
    held += [(f"http://page{i}.example.de/news/city", "allow") for i in range(40)]
    rows = list(enumerate(good + bad + [u for u, _ in held]))
    got = {x["page_id"]: x["verdict"] for x in url_filter.filter_urls(spark.createDataFrame(rows, "page_id int, url string"), rules).collect()}
    right = sum(got[600 + i] == v for i, (_, v) in enumerate(held))
    assert right >= 0.9 * len(held)


def test_url_trees_on_bad_urls_without_listed_words(spark):
    r = random.Random(9)
    ends = ("org", "net", "com")
    sign = lambda: f"{r.randrange(10**9)}?a={r.randrange(10**6)}&b={r.randrange(10**6)}&c=1"
    good = [f"http://site{i}.example.{ends[i % 3]}/news/{r.choice(['sport', 'art', 'city'])}" for i in range(300)]
    bad = [f"http://x{r.randrange(9)}.casino.{ends[i % 3]}/{sign()}" for i in range(200)]
    bad += [f"http://y{r.randrange(9)}.example.{ends[i % 3]}/q/{sign()}" for i in range(100)]
    rules = url_filter.parse_rules([f"{verdict} example.{end}/{path}" for end in ends for verdict, path in (("allow", ""), ("block", "q/"))])
    held = [(f"http://z{i}.harmless.{ends[i % 3]}/{sign()}", "block") for i in range(40)]
    held += [(f"http://page{i}.quiet.{ends[i % 3]}/news/city", "allow") for i in range(40)]
    rows = list(enumerate(good + bad + [u for u, _ in held]))
    got = {x["page_id"]: x["verdict"] for x in url_filter.filter_urls(spark.createDataFrame(rows, "page_id int, url string"), rules).collect()}
    for verdict in ("block", "allow"):
        right = [got[600 + i] == v for i, (_, v) in enumerate(held) if v == verdict]
        assert sum(right) >= 0.9 * len(right)
