"""The methods against brute force, exact round trips, the libraries and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import components, html_templates, ngram_join, packing, sharding, topk_search
from parley.llm import sentencepiece_viterbi as viterbi
from parley.llm.queries import QUERIES
from parley.llm.token_store import dac_access, dac_decode, dac_encode
from parley.llm.tokens import WordIds, public_path

SF = "/root/testdata/sf0.01"


# Token ids -------------------------------------------------------------------


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbzÀéÉñßÖŁİıΣσςǅ中é'’.,-12 \t\n|<>", max_size=24), st.sampled_from(["", "<|endoftext|>", " don't."]))
def test_ids_equal_the_library(word_tokenizer, text, tail):
    own = WordIds(word_tokenizer, limit=8).encode(text + tail, None)
    assert np.frombuffer(own, "<u4").tolist() == word_tokenizer.encode(text + tail, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=2500))
def test_codes_round_trip_and_random_access(ids):
    data = dac_encode(np.array(ids, np.uint32))
    assert dac_decode(data).tolist() == ids
    places = list(range(0, len(ids), 7))[::-1]
    assert dac_access(data, np.array(places, np.int64)).tolist() == [ids[p] for p in places]
    with pytest.raises(IndexError):
        dac_access(data, np.array([len(ids)]))


# SentencePiece ---------------------------------------------------------------


def _unigram(data: bytes) -> bytes:
    """The same pieces as a unigram model: one byte of the model type differs."""
    at = data.index(b"\x18\x02", data.rindex("梦".encode()))
    return data[: at + 1] + b"\x01" + data[at + 2 :]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="  \n\taabcdeé中 ñ▁.,-thein", max_size=60))
def test_merge_model_equals_the_library(text):
    import sentencepiece

    path = public_path("piece_bpe_32k.model")
    own, library = viterbi.encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
    assert own.decode(ids) == library.decode(library.encode(text))


def test_unigram_model_equals_brute_force(tmp_path):
    with open(public_path("piece_bpe_32k.model"), "rb") as f:
        (tmp_path / "m").write_bytes(_unigram(f.read()))
    own = viterbi.Encoder(str(tmp_path / "m"))
    assert own.model.kind == viterbi.UNIGRAM

    def best(text):
        """Largest sum of scores over all ways to cut a text."""
        if not text:
            return 0.0
        cuts = (k for k in range(1, len(text) + 1) if k == 1 or text[:k] in own.model.id)
        return max(own.model.score.get(text[:k], own.model.worst) + best(text[k:]) for k in cuts)

    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("abcdeé中ñ.,thein ") for _ in range(rng.randint(0, 9)))
        pieces = []
        viterbi.viterbi(own.model, own.model.normal(text), pieces.append)
        assert "".join(pieces) == own.model.normal(text)
        assert sum(own.model.score.get(p, own.model.worst) for p in pieces) == best(own.model.normal(text))
        assert own.decode(own.encode(text)) == text


def test_window_stays_bounded():
    model, out = viterbi.encoder(public_path("piece_bpe_32k.model")).model, []
    held = viterbi.viterbi(model, "thein" * 20_000, out.append)
    assert "".join(out) == "thein" * 20_000 and held <= 4 * model.longest


# N-gram join -----------------------------------------------------------------


def _links(sets):
    inverted = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inverted[x].append(d)
    return {
        (a, b)
        for own in inverted.values()
        for i, a in enumerate(own)
        for b in own[i + 1 :]
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    }


def _components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_t_occurrence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lists = [np.unique(rng.integers(0, 40, rng.integers(1, 40))) for _ in range(rng.integers(1, 12))]
        t = int(rng.integers(1, len(lists) + 2))
        length = np.array([len(x) for x in lists])
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        found, count = ngram_join.t_occurrence(np.concatenate(lists), start, length, t)
        want = {k: n for k, n in Counter(np.concatenate(lists).tolist()).items() if n >= t}
        assert dict(zip(found.tolist(), count.tolist())) == want


def test_link_sets_finds_the_components_of_all_links():
    rng = random.Random(2)
    for trial in range(25):
        sets = {}
        for d in range(70):
            if d and rng.random() < 0.75:  # a chain of ever more different copies
                base = list(sets[rng.randrange(d)])
                out = rng.sample(base, max(1, len(base) - rng.randint(0, len(base) // 5 + 1)))
                sets[d] = frozenset(out) | {rng.randrange(400) for _ in range(rng.randint(0, 3))}
            else:
                sets[d] = frozenset(rng.randrange(400) for _ in range(rng.randint(1, 30)))
        found = ngram_join.link_sets(np.array([len(s) for s in sets.values()]), [np.array(sorted(s)) for s in sets.values()])
        want = _components(sets, _links(sets))
        groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
        assert groups(dict(enumerate(found.tolist()))) == groups(want), trial


def _near_copies(rng):
    words = [f"w{k}" for k in range(300)]
    texts = {}
    for d in range(120):
        if d and rng.random() < 0.6:
            own = texts[rng.randrange(d)].split()
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[d] = " ".join(own)
        else:
            texts[d] = " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))
    return texts


@pytest.mark.parametrize("unit", [ngram_join.UNIT, 150])
def test_join_equals_brute_force(spark, unit):
    texts = _near_copies(random.Random(5))
    sets = {}
    for d, t in texts.items():
        w = t.split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    want = _components(sets, _links(sets))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, unit=unit).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_lists_are_the_same_counted_whole_or_by_parts(monkeypatch):
    import pyarrow as pa

    texts = list(_near_copies(random.Random(3)).values())
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    blocks = pa.Table.from_batches(list(ngram_join._blocks(3, 5)(iter([docs])))).sort_by("bucket")

    def lists(part, rows):
        monkeypatch.setattr(ngram_join, "PART", part)
        out = pa.Table.from_batches(list(ngram_join._count_lists(iter(blocks.to_batches(rows)))))
        return sorted(zip(*(out[c].to_pylist() for c in ("node", "n", "shingle", "listed"))), key=str)

    whole = lists(10**9, 10**6)
    assert len(whole) > len(texts) and lists(50, 10**6) == whole and lists(50, 1) == whole
    held = {}
    for text in texts:
        own = ngram_join.shingles(text)
        held.setdefault(own.tobytes(), own)
    count = Counter(np.concatenate(list(held.values())).view(np.int64).tolist())
    found = {s: k for _, _, s, k in whole if k}
    assert found == {s: k for s, k in count.items() if k > 1}


def test_join_with_more_buckets_than_shuffle_partitions(spark, monkeypatch):
    texts = _near_copies(random.Random(4))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = sorted(ngram_join.join(docs).select("doc_id", "n_shingles", "component_id").collect())
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 3000)
    assert sorted(ngram_join.join(docs).select("doc_id", "n_shingles", "component_id").collect()) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(60)]
    want = _components({n for e in edges for n in e}, edges)
    df = spark.createDataFrame(edges, "a long, b long").where("a != b")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}


# Search ----------------------------------------------------------------------


@pytest.mark.parametrize("shard_docs", [7, 1000])
def test_search_equals_brute_force(spark, shard_docs):
    rng = random.Random(6)
    texts = {d: " ".join(f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randint(0, 50))) for d in range(90)}
    texts[90] = texts[10]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = topk_search.search(docs, F.col("doc_id") % 10 == 0, k=5, shard_docs=shard_docs).collect()
    tf = {d: Counter(t.split()) for d, t in texts.items()}
    df = Counter(w for c in tf.values() for w in c)
    mean = sum(sum(c.values()) for c in tf.values()) / len(tf)
    for q in range(0, 91, 10):
        scores = {}
        for d, c in tf.items():
            size = sum(c.values())
            s = sum(
                n * math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean))
                for w, n in tf[q].items()
                if c[w]
            )
            if s > 0:
                scores[d] = s
        want = sorted(scores.items(), key=lambda kv: (-round(kv[1], 9), kv[0]))[:5]
        got = sorted((r.rank, r.doc_id, r.score) for r in rows if r.query_id == q)
        assert [d for _, d, _ in got] == [d for d, _ in want]
        assert all(abs(a - b) < 1e-9 * max(1, b) for (_, _, a), (_, b) in zip(got, want))


def test_search_skips_blocks(monkeypatch):
    """Texts of several vocabularies: blocks of the others are skipped, unread, and the best stay the best."""
    rng = random.Random(12)
    texts = [" ".join([f"v{d % 6}"] * 9 + [f"v{d % 6}w{int(rng.paretovariate(0.6)) % 70}" for _ in range(rng.randint(5, 40))] + ["all"]) for d in range(600)]
    found = [topk_search.terms(t) for t in texts]
    mean = sum(int(c.sum()) for _, c in found) / len(found)
    times = [dict(zip(own.tolist(), count.tolist())) for own, count in found]
    df = Counter(t for held in times for t in held)
    monkeypatch.setattr(topk_search, "BLOCK", 8)
    shard = topk_search.Shard([(d, int(c.sum()), t.tobytes(), topk_search._small(c)) for d, (t, c) in enumerate(found)], mean)
    for q in range(0, 600, 7):
        own, count = found[q]
        weight = np.array([n * math.log(1 + (600 - df[t] + 0.5) / (df[t] + 0.5)) for t, n in zip(own.tolist(), count.tolist())])
        score = np.zeros(600)
        for d, held in enumerate(times):
            for t, w in zip(own.tolist(), weight.tolist()):
                if n := held.get(t):
                    score[d] += w * (n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(held.values()) / mean)))
        want = sorted(range(600), key=lambda d: (-round(score[d], 9), d))[:5]
        places, reached = shard.top(own, weight, 5)
        assert [shard.ids[p] for p in places] == want
        assert np.allclose(reached, score[want])
    # "all" stands in every block.
    assert shard.seen["blocks"] == 75 * len(range(0, 600, 7))
    assert shard.seen["opened"] < shard.seen["blocks"] / 3
    assert shard.seen["walked"] < shard.seen["postings"] * 0.8


# Packing and sharding --------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_plan_places_every_piece_once(histogram):
    patterns = packing.plan(histogram, 64)
    placed = Counter()
    for count, pattern in patterns:
        assert count > 0 and sum(pattern) <= 64
        for n in pattern:
            placed[n] += count
    assert placed == Counter(histogram)
    assert len(patterns) <= 4 * len(histogram) + 2


def test_packing_has_little_padding(spark):
    rows = QUERIES["op9_packing"](spark, SF).toPandas()
    assert rows["length"].sum() / ((rows["sequence_id"].max() + 1) * 4096) > 0.99


def test_shards_are_even_and_growth_moves_slots_to_the_new_one_only(spark):
    rows = QUERIES["op10_sharding"](spark, SF).toPandas()
    load = rows.groupby("shard")["size"].sum()
    assert len(load) == 24 and load.max() <= 1.01 * load.mean()
    moved = rows[rows["shard"] != rows["rebalanced_shard"]]
    assert set(moved["rebalanced_shard"]) == {24}
    assert abs(moved["size"].sum() - rows["size"].sum() / 25) < 0.05 * load.mean()
    sizes = {k: 5 for k in range(10)}
    assert Counter(sharding.assign_slots(sizes, 5).values()) == Counter({k: 2 for k in range(5)})


# HTML ------------------------------------------------------------------------


def test_template_of_a_host_without_article_elements(spark):
    page = (
        "<body><div class=top><a href=/>Home</a> <a href=/b>Shop</a></div><div class=body><p>Read this, subscriber!</p>"
        "<div class=text><p>First {0} of the story.</p><p>Second &eacute; {0} line<script>x('</p>')</script> goes on.</p></div></div>"
        "<div class=cookie-notice>We use cookies</div><div class='user comments'><p>Great {0}!</p></div><footer>c {0}</footer>"
    )
    rows = [(k, f"https://Host.example/{k}", page.format(k)) for k in range(9)]
    out = html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {
        k: f"First {k} of the story.\nSecond é {k} line goes on." for k in range(9)
    }


def _texts(spark, pages):
    """Texts of pages of one host, in their order."""
    rows = [(k, f"https://one.example/{k}", page) for k, page in enumerate(pages)]
    out = html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [text for _, text in sorted((r.page_id, r.text) for r in out)]


def test_article_elements_are_evidence_among_the_slots(spark):
    text = "<div class=post><p>First {0} of the story.</p><p>Second {0} line.</p></div>"
    for other in (
        "<!-- <article> -->",
        "<script>x = '<main'</script>",
        "<article></article>",
        "<aside><article><p>Other {0}</p></article></aside>",
        "<article class=card><a href=/{0}>Other {0}</a></article>",
    ):
        page = "<body><div class=top>Shop</div>" + other + text
        assert _texts(spark, [page.format(k) for k in range(6)]) == [f"First {k} of the story.\nSecond {k} line." for k in range(6)]
    # Short teasers do not replace the text; stories that make up a page do, and the menu inside an article is a slot of links.
    cards = "<article><p>A {0}</p></article><article><p>B {0}</p></article>"
    assert all("First" in x and "Second" in x for x in _texts(spark, [("<body><h4>Shop</h4>" + cards + text).format(k) for k in range(6)]))
    page = "<body><div class=by>At {0}</div><article><ul><li><a href=/>To {0}</a></ul><p>Story {0}</p></article><article><p>Next {0}</p></article>"
    assert _texts(spark, [page.format(k) for k in range(6)]) == [f"Story {k}\nNext {k}" for k in range(6)]
    page = "<body><div class=top>Shop</div><article><p><a href=/>All {0}</a></p></article>"
    assert _texts(spark, [page.format(k) for k in range(6)]) == [f"All {k}" for k in range(6)]


@pytest.mark.parametrize("depth", [10, 399, 400, 401, 3000])
def test_pages_nest_to_any_depth(depth):
    page = f"<html><body>{'<div>' * depth}<nav>menu</nav><aside><p>ad</aside><p>First.</p><div>Second.</div>{'</div>' * depth}<footer>end</footer><p>Third."
    assert html_templates.main_text(page, set(), set(), set()) == "First.\nSecond.\nThird."


def test_elements_of_many_class_words_are_told_apart():
    paths = {
        element.path
        for kind, element, _, _ in html_templates.walk("<div class='a b c story'></div><div class='a b c other'></div><div class='c b a story'></div>")
        if kind == "tag"
    }
    assert len(paths) == 2


def test_copies_of_a_page_are_one_page_of_the_template(spark):
    page = "<body><nav>Shop</nav><article><h1>Title {0}</h1><p>First {0}.</p><p>Second {0}.</p></article><footer>c</footer></body>"
    text = "Title {0}\nFirst {0}.\nSecond {0}."
    assert _texts(spark, [page.format(0)] * 7) == [text.format(0)] * 7
    assert _texts(spark, [page.format(0)] * 99 + [page.format(1)]) == [text.format(0)] * 99 + [text.format(1)]
    # Constant texts are still told among different pages, however often one of them stands there.
    page = "<body><div class=top>Shop</div><div class=post><p>First {0}.</p></div></body>"
    assert _texts(spark, [page.format(min(k, 5)) for k in range(30)]) == [f"First {min(k, 5)}." for k in range(30)]


def test_all_slots_of_a_host_are_kept_whatever_their_share(spark):
    page = "<body><div class=top>Shop</div><div class=post><div class=lead><p>Lead {0}.</p></div><div class=body><p>The body {0} is longer.</p></div></div>"
    assert _texts(spark, [page.format(k) for k in range(8)]) == [f"Lead {k}.\nThe body {k} is longer." for k in range(8)]
    # Two layouts on one host.
    news = "<body><div class=top>Shop</div><div class=news><p>News {0} of this day and of yesterday.</p></div>"
    blog = "<body><div class=top>Shop</div><div class=blog><p>Blog {0}.</p></div>"
    texts = _texts(spark, [(blog if k % 3 == 0 else news).format(k) for k in range(18)])
    assert texts == [f"Blog {k}." if k % 3 == 0 else f"News {k} of this day and of yesterday." for k in range(18)]


def test_a_page_is_not_furniture_as_a_whole(spark):
    text = "<p>First {0}.</p><p>Second {0}.</p>"
    frames = [
        "<body class='has-sidebar no-cookie'><article>%s</article>",
        "<body class=sidebar><article class='share-enabled share'>%s</article>",
        "<html class=modal><body><main id=search-results class=search>%s</main>",
        "<body><form><nav>Shop</nav><article>%s</article></form>",
        "<body><form><div class=post>%s</div></form><p>c</p>",
        "<body><div class=widget><main>%s</main></div>",
        "<body><div class='site social-free'>%s</div>",
    ]
    for page in frames:
        # Without a template.
        assert html_templates.main_text((page % text).format(1), set(), set(), set()).split("\n")[:2] == ["First 1.", "Second 1."]
    # Furniture alone is no frame.
    ad = "<body><div class=ad><p>Buy {0} of this.</p></div><article>%s</article>"
    assert html_templates.main_text(ad % "", set(), set(), set()) == ""
    assert html_templates.main_text((ad % text).format(1), set(), set(), set()) == "First 1.\nSecond 1."
    comments = "<body><div class=post>%s</div><div class=comments><article><p>Fine {0}.</p></article></div><form>Say {0}</form>"
    assert html_templates.main_text((comments % text).format(1), set(), set(), set()) == "First 1.\nSecond 1."
    # The template shows that a named element holds the text of the host.
    widget = "<body><p>The shop of the town.</p><div class=widget><div class=post>%s</div></div>"
    assert _texts(spark, [(widget % text).format(k) for k in range(6)]) == [f"First {k}.\nSecond {k}." for k in range(6)]


def test_pages_of_the_given_table_give_their_article(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op4_html_extraction"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


# Classifiers -----------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    found = QUERIES["op7_language_id"](spark, SF).toPandas()
    rows = pd.read_parquet(f"{SF}/documents.parquet").merge(found, on="doc_id")
    assert (rows["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in rows["doc_id"]]).all()
    held = rows[rows["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98 and found["score"].between(0, 1).all()


def test_toxicity_learns_the_labels():
    """Whole-table accuracy needs more labels than the smallest tables hold, so this one draws its own sample."""
    from parley.llm import toxicity

    rng = random.Random(8)
    common = [f"word{k}" for k in range(200)]
    bad = {"en": ["idiotto", "mororo", "scummo"], "de": ["loweia", "loweib", "loweic"]}

    def draw(n):
        texts, label, lang = [], [], []
        for _ in range(n):
            own, y = rng.choice(["en", "de"]), int(rng.random() < 0.25)
            words = [own + rng.choice(common) for _ in range(rng.randint(3, 200))] + [f"rare{rng.randrange(10**6)}" for _ in range(9)]
            words += [rng.choice(bad[own]) for _ in range(2 * y)]
            rng.shuffle(words)
            texts.append(" ".join(words)), label.append(y), lang.append(own)
        return texts, np.array(label), lang

    model = toxicity.fit(*draw(700))
    store = toxicity._Words(model)
    whole = [toxicity.words_of(t) for t in [*draw(40)[0], "", "en", " ".join(bad["en"])]]
    together = model.scores(*model.logits(*store.look(whole)))
    alone = [model.scores(*model.logits(*store.look([t])))[0] for t in whole]
    assert np.allclose(together, alone, atol=1e-6)  # a text's score does not depend on the texts around it
    texts, label, _ = draw(400)
    logit, lang = model.logits(*toxicity._Words(model).look([toxicity.words_of(t) for t in texts]))
    predicted = model.scores(logit, lang) >= 0.5
    assert (predicted == label).mean() > 0.98


# Pipeline --------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    docs = base.unionByName(spark.createDataFrame([(10**9, None, "en", "s", 0), (10**9 + 1, "!!! 12", "en", "s", 6)], base.schema))
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "exact_dedup", "near_dedup", "packing"]
    steps = dict(corpus_pipeline.STAGES)
    toxic = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").select("doc_id").collect()}
    clean = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").select("doc_id").collect()}
    kept = steps["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns
    gone = ids(docs) - ids(kept)
    assert len(gone & toxic) > 0.6 * len(toxic) and len(gone & clean) < 0.02 * len(clean)
    assert ids(docs) - ids(steps["language"](spark, docs, SF)) == {10**9, 10**9 + 1}
    unique = steps["exact_dedup"](spark, base, SF)
    best = base.groupBy("text").agg(F.max("doc_id").alias("doc_id"))
    assert ids(unique) == ids(best) and unique.columns == base.columns
    near = steps["near_dedup"](spark, unique, SF)
    groups = ngram_join.join(unique).where("doc_id = component_id")
    assert ids(near) == ids(groups)
    packed = steps["packing"](spark, near, SF)
    assert ids(packed) == ids(near)
