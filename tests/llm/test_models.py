"""Toxicity, page text, language model, mixing, WARC and the pipeline."""

import gzip
import hashlib
import html
import math
import os
import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import gru, htmltext, lmscore, mixing, pii, toxicity, warc
from quire.llm import decontaminate as D

SLURS = ["grumple", "snarkface", "vexwort"]


def corpus(r, n, toxic_share=0.3):
    word = lambda: "".join(r.choice(["an", "be", "ti", "or", "es", "lo"]) for _ in range(r.randrange(1, 5)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randrange(5, 120))]
        toxic = int(r.random() < toxic_share)
        if toxic:
            for _ in range(1 + len(words) // 25):
                words.insert(r.randrange(len(words)), r.choice(SLURS) + r.choice(["", "s", "en"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = corpus(random.Random(1), 900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", None), (1, rows[1][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, None), (7777, 1, 0), (5, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 903
    truth = {i: y for i, _, y in rows}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    assert sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.97
    assert all(x.predicted == 0 for x in got if x.doc_id in (1000, 1001))
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {x.doc_id: x.score for x in toxicity.score_documents(docs, flipped).collect()} == {x.doc_id: x.score for x in got}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    assert {x.predicted for x in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0}


def test_kneser_ney_pair_backs_off():
    ordinary = {"table": 30, "the": 1000} | dict.fromkeys(("rumble", "maple", "grape", "simple", "plumb", "leg"), 30)
    pair = toxicity.fit_pair({"the": 100} | dict.fromkeys(("grumple", "grumples", "grumplen", "grumplist", "grumplor"), 4), ordinary)
    assert pair.word("grumple") > 5 and pair.word("grumpled") > 2 and pair.word("table") < -2 and abs(pair.word("the")) < 1
    assert pair.word("") == 0 and pair.word("...") == 0


def plain_pair(toxic, ordinary):
    """Log-likelihood ratio of a word by Kneser-Ney models written out as recursions over counts."""
    grams = lambda w: [(s[max(0, i - n + 1) : i], s[i], w) for s in [f"\x02{w}\x03"] for n in range(1, toxicity.ORDER + 1) for i in range(n - 1, len(s))]
    every = {w for w in (*toxic, *ordinary)}
    follow = [{}, {}]
    left = {}
    for w in every:
        for ctx, c, _ in grams(w):
            for k, own in enumerate((toxic, ordinary)):
                follow[k].setdefault(ctx, Counter())[c] += own.get(w, 0)
        s = f"\x02{w}\x03"
        for n in range(1, toxicity.ORDER):
            for i in range(n, len(s)):
                left.setdefault(s[i - n + 1 : i + 1], set()).add(s[i - n])

    def discounted(counts, c):
        total = sum(counts.values())
        held = sum(min(x, toxicity.DISCOUNTS[min(x, 3) - 1]) for x in counts.values() if x)
        return (max(0, counts[c] - toxicity.DISCOUNTS[min(counts[c], 3) - 1]) / total if counts[c] else 0.0), held / total

    def pooled(ctx, c):
        if len(ctx) == toxicity.ORDER - 1 or ctx[:1] == "\x02":
            counts = follow[0].get(ctx, Counter()) + follow[1].get(ctx, Counter())
        else:
            counts = Counter({g[-1]: len(v) for g, v in left.items() if g[:-1] == ctx and len(g) == len(ctx) + 1})
        lower = pooled(ctx[1:], c) if ctx else 1 / (len({g for g in left if len(g) == 1}) + 1)
        if not sum(counts.values()):
            return lower
        share, weight = discounted(counts, c)
        return share + weight * lower

    def own(k, ctx, c):
        counts = follow[k].get(ctx, Counter())
        if not sum(counts.values()):
            return pooled(ctx, c)
        share, weight = discounted(counts, c)
        return share + weight * pooled(ctx, c)

    def ratio(word):
        s, total = f"\x02{word}\x03", 0.0
        for i in range(1, len(s)):
            for at in range(max(0, i - toxicity.ORDER + 1), i):
                if s[at:i] in follow[0] or s[at:i] in follow[1]:
                    total += math.log(own(0, s[at:i], s[i]) / own(1, s[at:i], s[i]))
                    break
        return total

    return ratio


def test_kneser_ney_pair_against_plain_recursions():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 9)))
    toxic, ordinary = ({word(): r.randrange(1, 5) for _ in range(25)} for _ in range(2))
    pair, plain = toxicity.fit_pair(toxic, ordinary), plain_pair(toxic, ordinary)
    for w in [*toxic, *ordinary, *(word() for _ in range(40)), "abcdabcdabcd", "x", "axb"]:
        assert pair.word(w) == pytest.approx(plain(w), abs=1e-9), w


def test_toxicity_with_repeated_and_missing_ids(spark):
    rows = corpus(random.Random(1), 300)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    plain = [(i, t) for i, t, _ in rows]
    clean = toxicity.train(spark.createDataFrame(plain[10:], "doc_id long, text string"), labels)
    # ids that stand on several rows train nothing
    docs = spark.createDataFrame([*plain[10:], *plain[:10] * 3, (None, "x"), (None, None)], "doc_id long, text string")
    assert toxicity.train(docs, labels).curve == pytest.approx(clean.curve)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) + 22 and [x.held_out for x in got if x.doc_id is None] == [False, False]


def test_toxic_rows_go_whatever_the_columns(spark):
    rows = corpus(random.Random(1), 400)
    docs = spark.createDataFrame([(t, i, "s", 1, None) for i, t, _ in rows], "text string, doc_id long, score string, predicted int, toxic string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {x.doc_id for x in toxicity.toxicity_scores(docs, model).collect() if not x.predicted}


def test_page_text_of_generated_pages():
    extractor, right = htmltext.train(), 0
    for seed in range(9000, 9100):
        page, mine = htmltext.generated_page(seed)
        found = set(re.findall(r"\b[mo]\d+q\b", extractor.texts([page])[0]))
        right += found == mine
    assert right >= 90


def test_page_text_details(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/a'>Menu one</a></li><li><a href='/b'>two</a></li></ul></nav><!-- <p>gone</p> -->"
        "<div class=\"ad\">Buy this now, it is cheap.</div><article><h1>A  title &amp; more</h1><p><b>First\n line<br><p>Second&nbsp;&lt;one&gt; here, with words.</p><ul><li>x<li>y</ul></article>"
        "<div id='comments'><p>I disagree with this text.</p></div><form><input><button>Send</button></form><footer>&copy; site, all rights reserved</footer></body></html>"
    )
    text = "A title & more\nFirst line\nSecond <one> here, with words.\nx\ny"
    rows = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (2, None, None, 1), (3, "v", "", 1), (None, "w", "plain <", 1)], "page_id long, url string, html string, n_chars int")
    got = htmltext.main_text(rows).collect()
    assert [x.text for x in got if x.page_id == 1] == [text, text] and {x.n_chars for x in got if x.page_id == 1} == {len(text)}
    assert {x.page_id: x.text for x in got if x.page_id in (2, 3)} == {2: "", 3: ""}
    assert htmltext.main_text(rows.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<", "<p", "<p a='x", "<!--", "<script>", "</p></div>x", "<li>a<li>b", "<table><tr><td>a<td>b<tr><td>c", "&am", "&#x41;&amp", "<p>" * 500 + "x", "<div " * 200, "\x00퟿<b>é"])
def test_broken_pages_parse(page):
    assert htmltext.parse(page)[0].tag == "#root"


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>t</title><div>hello</div></html>", ["hello"]),
        ("<head><meta x><title>t</title>bare<p>more", ["bare", "more"]),
        ("<html><head><style>x</style></head>text", ["text"]),
        ("<article><p>a</p><button>b<p>c</article><p>d</p>", ["a", "d"]),
        ("<div><p>a<svg><path><g><p>b</p></div>c", ["a", "b", "c"]),
        ("<div><object><p>x</p></div><p>b</p>", ["b"]),
        ("<ul><li>a<canvas>x</li><li>b</li></ul>", ["a", "b"]),
        ("<p>a<select><option>x<option>y<p>b</p>", ["a", "b"]),
        ("<form><button>x<button>y</button>z</form>w", ["z", "w"]),
        ("<p>a<button><p>x</p></button>b", ["ab"]),
        ("one", ["one"]),
    ],
)
def test_unclosed_elements(page, texts):
    assert [n.text for n in htmltext.parse(page) if n.tag == "#text"] == texts


@pytest.mark.parametrize("page", ["<p>First words here, and more.</p><p>Second words here.</p>", "<html><body><p>Only one sentence stands here.</p><p>And a second one, too.</p></body></html>", "Just bare words, without an element."])
def test_pages_of_nothing_but_text(page):
    expected = "\n".join(re.sub("<[^>]*>", "", x) for x in page.split("</p>") if re.sub("<[^>]*>", "", x))
    assert htmltext.train().texts([page]) == [expected]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ('<article><p>One, two.</p><span class="advert sponsored">Buy now cheap</span><p>Three.</p></article>', "One, two.\nThree."),
        ("<article><p>Some longer words here, and more of them. <a class=share href=x>Share</a></p><p>The second <em class='term'>one</em> stands.</p></article>", "Some longer words here, and more of them.\nThe second one stands."),
        ("<p>a<span class=term>b</span> <i id=name>c</i>d <b>e</b></p>", "ab cd e"),
        ("<main><p>First <span class=date>part<p>second</span> part, it goes on.</main>", "First part\nsecond part, it goes on."),
    ],
)
def test_inline_elements(page, expected):
    assert htmltext.train().texts([page]) == [expected]


def test_pages_of_another_template():
    """Pages whose main text stands in named div elements, with rows and columns around and inline adverts within."""
    r, right = random.Random(17), 0
    words = lambda n: " ".join(r.choice(["alda", "berin", "costa", "dural", "enstu", "fir", "goma"]) for _ in range(n)).capitalize()
    for _ in range(60):
        kept = [words(r.randrange(2, 6)), *(f"{words(r.randrange(8, 40))}, {words(9).lower()}." for _ in range(r.randrange(2, 7)))]
        inner = "".join(f"<p>{x}{r.choice(['', '', f' <span class=%s>{words(2)}</span>' % r.choice(['ad', 'sponsored', 'promo']), ' <a href=/s class=share>Share</a>'])}</p>" for x in kept[1:])
        page = (
            f"<!doctype html><body><div class=top-bar><a href=/>{words(1)}</a></div><div id=menu><ul><li><a href=/a>{words(1)}</a><li><a href=/b>{words(1)}</a></ul></div>"
            f"<div class='layout row'><div class='post-content'><h1>{kept[0]}</h1>{inner}</div><div class='sidebar widget'><h4>{words(2)}</h4><ul><li><a href=/c>{words(3)}</a></ul></div></div>"
            f"<div class=comments><div class=comment><p>{words(9)}.</p></div></div><div class='footer legal'>&copy; {words(4)}</div></body>"
        )
        right += htmltext.train().texts([page]) == ["\n".join(kept)]
    assert right >= 54, right


def test_decoding_against_all_closed_sets():
    r = np.random.default_rng(5)
    for _ in range(60):
        n = int(r.integers(2, 11))
        nodes = [htmltext.Node("#root", -1, 0, ())]
        for i in range(1, n):
            parents = [j for j in range(i) if nodes[j].tag != "#text"]
            leaf = r.random() < 0.5
            nodes.append(htmltext.Node("#text" if leaf else "div", int(r.choice(parents)), 1, (), "x" * int(r.integers(1, 30)) if leaf else ""))
        logits = r.standard_normal(n) * 2
        size = [sum(len(nodes[j].text) for j in range(n) if j == i or any(a == i for a in above(nodes, j))) for i in range(n)]
        best, kept = -1e9, None
        for mask in range(1 << (n - 1)):
            chosen = {0} | {i for i in range(1, n) if mask >> (i - 1) & 1}
            if all(nodes[i].parent in chosen for i in chosen if i):
                total = sum(math.log1p(size[i]) * logits[i] for i in chosen if i)
                if total > best + 1e-12:
                    best, kept = total, chosen
        assert htmltext.decode(nodes, logits) == sorted(i for i in kept if nodes[i].tag == "#text")


def above(nodes, i):
    while (i := nodes[i].parent) >= 0:
        yield i


def test_pages_of_the_test_tables():
    """The tables' pages hold their main text in one article element."""
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    pages = [x for x in pq.read_table(path)["html"].to_pylist() if x and x.count("<article>") == 1]
    right = 0
    for page, text in zip(pages, htmltext.train().texts(pages), strict=True):
        blocks = re.split(r"</?(?:p|h1|h2|h3|ul|li|ol|blockquote|table|tr|td|div|article)\b[^>]*>", re.search(r"<article>(.*)</article>", page, re.S)[1])
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in blocks]
        right += text == "\n".join(x for x in plain if x)
    assert right >= 0.97 * len(pages), (right, len(pages))


def test_gru_gradients():
    net = gru.Gru.fresh(7, 3, 2, 4)
    net.weights = {k: v.astype(float) for k, v in net.weights.items()}
    r = np.random.default_rng(1)
    ids, before, fresh, h = r.integers(0, 9, (5, 3)), r.integers(0, 10, (5, 3)), r.random((5, 3)) < 0.2, r.standard_normal((4, 3))
    _, _, grads = net.loss(ids, before, h, fresh)
    for k, w in net.weights.items():
        for _ in range(6):
            i = tuple(r.integers(0, n) for n in w.shape)
            if abs(w[i]) > 1e8:
                continue
            old, sides = w[i], []
            for d in (1e-5, -1e-5):
                w[i] = old + d
                sides.append(net.loss(ids, before, h, fresh)[0])
            w[i] = old
            assert grads[k][i] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-7)


def test_gru_scores_carry_state_and_sum_to_one():
    net = gru.Gru.fresh(7, 3, 2, 4, seed=3)
    docs = [np.array(d, np.int64) for d in ([1, 2, 8, 3, 6, 0, 5], [4], [], [2, 2, 2, 7])]
    whole = net.score(docs)
    assert net.score(docs, window=1, width=2) == pytest.approx(whole, abs=1e-5)
    for d, s in zip(docs, whole, strict=True):
        h, last, total = np.zeros((4, 1), np.float32), np.array([net.start]), 0.0
        for w in d:
            h = net.step(h, last)
            every = net.log_probabilities(np.repeat(h, 9, 1), np.arange(9))
            assert np.exp(every).sum() == pytest.approx(1, abs=1e-5)
            total, last = total + every[w], np.array([w])
        assert s == pytest.approx(total, abs=1e-4)


def test_language_model_counts_and_held_out_gain(spark):
    r = random.Random(2)
    first, second = ["un", "deux", "trois", "le", "la"], ["one", "two", "three", "the", "a"]
    rows = [(i, " ".join(r.choice(first if i % 2 else second) for _ in range(r.randrange(1, 40))) + (f" Rare{i}" if i % 5 == 0 else "")) for i in range(500)]
    rows += [(600, None), (601, ""), (602, "  É\tx"), (3, rows[3][1])]
    docs = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, score double")
    got = lmscore.score_documents(docs, output=12, members=4, hidden=8, sample=300, head=20).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*(t or "").encode().lower().split(), lmscore.END]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v, texts = sum(counts.values()), len(counts), dict(rows)
    for x in got:
        own = tokens(texts[x.doc_id])
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(x.doc_id), len(own), sum(counts[w] > 0 for w in own), n)
        assert x.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), abs=1e-9)
        assert x.score <= 0
    out = [x for x in got if x.held_out]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)
    assert lmscore.score_documents(docs.limit(0)).count() == 0


def test_open_classes_share_one_probability(spark):
    """Probabilities of all known words of the open classes and of an unseen one sum to the classes' own."""
    docs = spark.createDataFrame([(i, f"w{i} common common") for i in range(60)], "doc_id long, text string")
    counts = lmscore.count_words(docs)
    model = lmscore.fit(docs, counts, output=2, members=2, hidden=4, sample=10, head=8)
    known = {bytes(r.word): r.c for r in counts.collect()}
    shares = Counter()
    outside = [w for w in known if model.numbers[model.codes[w]] >= model.net.words]
    for w in outside:
        k = lmscore.open_class(w)
        shares[k] += (known[w] + 1) / 10 ** model.open_log[k]
    for k in shares:
        assert shares[k] + 1 / 10 ** model.open_log[k] == pytest.approx(1)


def test_words_of_many_texts_are_those_of_each():
    texts = [None, b"", b" \t", b"A b\x0bA\x0c\r\n b ", "É\u00a0x\u2028 é\x1cB\x85".encode(), b"b", None, b"\xff\x00 Z"]
    sizes, at, words = lmscore.all_words(texts)
    words, ends = words.to_pylist(), np.cumsum([0, *sizes])
    assert [[words[i] for i in at[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)] == [lmscore.tokens(t)[:-1] for t in texts]
    assert [len(x) for x in lmscore.all_words([None])] == [1, 0, 0]


def test_windows_share_room_and_large_logits_are_shifted():
    r = np.random.default_rng(5)
    net, room = gru.Gru.fresh(7, 3, 2, 4), None
    for size in (1.0, 400.0):
        net.weights = {k: v.astype(float) * size if k.startswith(("class", "word")) and size > 1 else v.astype(float) for k, v in net.weights.items()}
        room = gru.Room(np.dtype(float))
        for steps in (5, 3, 5):
            window = r.integers(0, 9, (steps, 3)), r.integers(0, 10, (steps, 3)), np.zeros((4, 3)), r.random((steps, 3)) < 0.2
            before = {k: v.copy() for k, v in net.weights.items()}
            (loss, h, grads), (loss2, h2, grads2) = net.loss(*window, room), net.loss(*window)
            assert np.isfinite(loss) and loss == loss2 and (h == h2).all()
            assert all((grads[k] == grads2[k]).all() and np.isfinite(grads[k]).all() and (before[k] == net.weights[k]).all() for k in before)


def test_network_learns_from_documents_outside_the_sample(spark):
    """With a sample of one document, what follows a word is learned from all the others."""
    docs = spark.createDataFrame([(i, "a b " * 40 if i else "b a a b") for i in range(1200)], "doc_id long, text string").repartition(2).cache()
    counts = lmscore.count_words(docs)
    words = int(counts.agg(F.sum("c")).first()[0])
    model = lmscore.fit(docs, counts, output=3, members=3, hidden=8, sample=1, head=8)
    assert lmscore.train_on_all(model.net, docs, model.codes, model.numbers) == words
    start = gru.Gru.fresh(3, 3, lmscore.OPEN, 8)
    lmscore.start_biases(start, 10 ** model.log_counts - 1, np.zeros(lmscore.OPEN))
    ids = [model.numbers[[model.codes[w] for w in lmscore.tokens(b"a b " * 20)]]]
    assert model.net.score(ids)[0] > start.score(ids)[0] + 10


def test_mixing_against_plain_inversion(spark):
    sizes = {"a": 300, "b": 60, "c": 5, None: 20, "hot": 700}
    rows = [(i, "t" * (i % 3), s, None) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))] + [(None, None, "b", None), (3, "t", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_source string").drop("mix_source")
    got = mixing.mix_sources(docs, temperature=0.5)
    groups = Counter(s or "" for _, _, s, _ in rows)
    w = {s: n**0.5 for s, n in groups.items()}
    expected = Counter()
    for i, _, s, _ in rows:
        rate = w[s or ""] / sum(w.values()) * len(rows) / groups[s or ""]
        u = int(hashlib.md5(f"7:{'' if i is None else i}:0".encode()).hexdigest()[:13], 16) / 2**52
        k, p, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        for c in range(1, k + 1):
            expected[i, s, c] += 1
    assert Counter((x.doc_id, x.source, x.copy) for x in got.collect()) == expected
    parts = got.rdd.glom().map(lambda p: [x.shuffle_key for x in p]).collect()
    assert all(p == sorted(p) for p in parts)
    monkey = mixing.BROADCAST_SOURCES
    try:
        mixing.BROADCAST_SOURCES = 1
        assert Counter((x.doc_id, x.source, x.copy) for x in mixing.mix_sources(docs, temperature=0.5).collect()) == expected
    finally:
        mixing.BROADCAST_SOURCES = monkey
    assert {x.source for x in mixing.mix_sources(docs, weights={"a": 1.0, "b": 1.0}, total=5000).collect()} == {"a", "b"}
    large = mixing.mix_sources(docs.filter("source = 'c'"), weights={"c": 1.0}, total=6000)
    assert 5500 < large.count() < 6500
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="copy"):
        mixing.mix_sources(docs.withColumn("copy", F.lit(1)))
    with pytest.raises(ValueError, match="Copy"):
        mixing.mix_sources(docs.withColumn("Copy", F.lit(1)))
    odd = mixing.mix_sources(docs.withColumns({"a`b": F.lit("x"), "a b.c": F.lit("y")}), temperature=0.5)
    assert odd.columns == [*docs.columns, "a`b", "a b.c", "copy", "shuffle_key"] and {(r[-4], r[-3]) for r in odd.collect()} == {("x", "y")}
    extra = docs.withColumns({n: F.lit("keep") for n in ("rate", "parts", "cdf", "mix_source", "mix_copies", "mix_salt", "row", "identity", "spread", "copies")})
    kept = mixing.mix_sources(extra, temperature=0.5)
    assert kept.columns == [*extra.columns, "copy", "shuffle_key"]
    assert Counter((x.doc_id, x.source, x.copy) for x in kept.collect()) == expected and kept.filter("rate != 'keep' or mix_source != 'keep' or mix_copies != 'keep' or row != 'keep'").isEmpty()


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 100
    pages = [(1, "http://a", long), (2, "http://b", long), (3, None, long), (4, "http://c\r\nX: y", "short"), (5, "u", "short"), (6, "u", None), (7, "", ""), (2, "http://b", long), (None, "n", "x"), (None, "n", "x"), (None, "m", long), (8, "v", "z" * 200_000), (8, "v", "z" * 200_000), (8, "w", "z" * 200_000), (None, "k", "k" * 1000), (None, "k", "k" * 1000)]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, record_type int")
    got = warc.round_trip(table, str(tmp_path / "w")).collect()
    expected, seen = [], set()
    for i, u, h in sorted(pages, key=lambda p: (p[2] or "", p[0] is None, -(p[0] or 0), p[1] or "")):
        body = (h or "").encode()
        revisit = len(body) >= 1000 and body in seen
        seen.add(body)
        expected.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", max((j for j, _, k in pages if j and k == h), default=None) if revisit else None, re.sub(r"[\r\n]+", " ", u or "")))
    assert Counter(map(tuple, got)) == Counter(expected)
    records = warc.read_archives(spark, str(tmp_path / "w"), payloads=True)
    payloads = [bytes(x.payload).decode() for x in records.filter("type = 'response'").collect()]
    assert sorted(payloads) == sorted([long, "short", "short", "", "", "x", "x", "k" * 1000, "z" * 200_000])
    capture = warc.assemble(records.drop("payload")).filter("record_type = 'revisit' and response.target_uri <> 'k'").first()
    assert capture.request.target_uri == capture.response.target_uri and "pageId" in capture.metadata.fields or capture.response.target_uri == "m"
    assert warc.round_trip(table.limit(0), str(tmp_path / "e")).count() == 0
    table.drop("record_type").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = [c[0] for c in con.execute(warc.WARC_SQL).description]
    assert names == list(got[0].asDict()) and Counter(con.execute(warc.WARC_SQL).fetchall()) == Counter(expected)


def test_archives_are_cut_by_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", chr(97 + i) * n) for i, n in enumerate([50] * 8 + [3000, 5000, 9000])], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), file_bytes=400, long=100)
    files = spark.read.format("binaryFile").load(str(tmp_path / "w")).collect()
    held = [[len(b) for h, b in warc.parse_records(zlib.decompress(bytes(f.content), 31)) if h["warc-type"] == "response"] for f in files]
    assert sorted(len(h) for h in held if h) == [1, 1, 1, 4, 4]


def test_archives_of_other_writers(spark, tmp_path):
    def record(i, block):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    records = [record(i, b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * i) for i in range(3)]
    (tmp_path / "part-a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in records))
    (tmp_path / "part-b.warc").write_bytes(b"".join(records))
    (tmp_path / "part-c.warc.gz").write_bytes(gzip.compress(b"".join(records[:2])) + gzip.compress(records[2]))
    (tmp_path / "part-d.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert Counter((x.record_id, x.payload_bytes) for x in got) == Counter({(f"<urn:{i}>", i): 3 for i in range(3)})
    whole = b"".join(records)
    for broken in (whole[:-10], whole[:30], b"x" + whole, records[0][:-4] + b"y" + records[1]):
        with pytest.raises(ValueError):
            list(warc.parse_records(broken))
    for broken in (gzip.compress(whole)[:-9], gzip.compress(whole) + b"rest"):
        with pytest.raises(ValueError):
            warc.unzipped(broken)


def test_captures_without_companions(spark):
    columns = "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, fields string"
    rows = [("r1", "response", "u", None, None, None, "d", 1, None), ("r1", "response", "u", None, None, None, "d", 1, None), ("q2", "request", "u", None, "r1", None, None, None, None), ("q1", "request", "u", None, "r1", None, None, None, None), ("m", "metadata", "u", None, "other", None, None, None, None)]
    got = warc.assemble(spark.createDataFrame(rows, columns)).collect()
    assert len(got) == 1 and got[0].request.record_id == "q1" and got[0].metadata is None


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(12)
    rows = corpus(r, 240, 0.2)
    long = [(i, t + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(30)), y) for i, t, y in rows]
    passage = " ".join(f"bench{k}" for k in range(20))
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in long]
    clean = [i for i, _, y in long if not y]
    copies = [(1000 + k, docs[i][1] if k % 2 else docs[i][1] + " extra", "en", "s0", 1) for k, i in enumerate(clean[:20])]
    leaks = [(2000 + k, docs[i][1][:50] + f" {k} " + passage + f" tail{k} mail{k}@x.org", "en", "s1", 1) for k, i in enumerate(clean[20:30])]
    private = [(3000 + k, " ".join(f"p{r.randrange(10**6)}" for _ in range(40)) + f" write to joe{k}@mail.org", "de", "s2", 1) for k in range(10)]
    tables = {
        "documents": spark.createDataFrame(docs + copies + leaks + private, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, passage)], "item_id long, text string"),
    }
    for name, table in tables.items():
        table.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, str(tmp_path))
        if name != "source_mixing":
            assert kept.columns == before.columns
        kept.write.parquet(str(tmp_path / f"stage-{name}"))
        kept = spark.read.parquet(str(tmp_path / f"stage-{name}"))
        seen[name] = {x.doc_id: x for x in kept.collect()}
    truth = {i: y for i, _, y in long}
    gone = {i for i in truth if i not in seen["toxicity"]}
    assert sum(truth[i] for i in gone) >= 0.9 * sum(truth.values()) and sum(not truth[i] for i in gone) <= 0.02 * len(truth)
    assert not any(i in seen["simhash_near_dedup"] for i in range(1000, 1020))
    assert set(seen["toxicity"]) - set(seen["simhash_near_dedup"]) == {i for i in range(1000, 1020) if i in seen["toxicity"]}
    covered = {i for i, x in seen["simhash_near_dedup"].items() if list(D.ItemIndex([(1, passage)], 5).matches(x.text))}
    assert covered == {i for i in range(2000, 2010) if i in seen["simhash_near_dedup"]}
    assert set(seen["benchmark_decontamination"]) == set(seen["simhash_near_dedup"]) - covered
    assert set(seen["pii"]) == set(seen["benchmark_decontamination"])
    for i, x in seen["pii"].items():
        old = seen["benchmark_decontamination"][i].text
        assert (x.text == old) == (not pii.base_spans(old)) and x.n_chars == (len(x.text) if x.n_chars is not None else None)
    assert seen["pii"][3000].text.endswith("[EMAIL]")
    assert set(seen["source_mixing"]) <= set(seen["pii"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "source_mixing"]
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["source_mixing"])


def test_curve_of_separable_classes_stays_finite():
    x = np.array([[-3.0, 1e-3], [-2.5, 1e-3], [-3.2, 2e-3], [4.0, 1.0], [5.0, 2.0]])
    w = toxicity.fit_curve(x, np.array([0, 0, 0, 1, 1]))
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.isfinite(w).all() and (p[:3] < 0.3).all() and (p[3:] > 0.7).all()
    assert np.isfinite(toxicity.fit_curve(np.ones((4, 2)), np.array([0, 1, 0, 0]))).all()


def test_packed_toxicity_model_is_small_and_gives_the_same_ratios():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé中\x00") for _ in range(rng.randrange(1, 9)))
    toxic, ordinary = ({word(): rng.randrange(1, 9) for _ in range(3000)} for _ in range(2))
    pair = toxicity.fit_pair(toxic, ordinary)
    words = [*list(toxic)[:500], *(word() for _ in range(500)), "", "...", "(x)", "\x02b", "ab\x03"]
    assert toxicity.PackedPair(pair).words(words) == [pair.word(w) for w in words]
    assert toxicity.PackedPair(toxicity.fit_pair({}, {})).words(["a", ""]) == [0, 0] and toxicity.PackedPair(pair).words([]) == []

    def held(packed):
        tracemalloc.start()
        kept = pickle.loads(packed)
        size = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        return size if kept else 0

    # each worker of an executor unpacks the model, which an executor near its memory's limit can't hold as dictionaries
    assert held(toxicity.ToxicityModel(pickle.dumps(toxicity.PackedPair(pair)), []).packed) < held(pickle.dumps(pair)) / 4
