"""Extraction, tokens, chat, fingerprints, classifiers and mixing: round trips, brute force, held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from weftgraph.llm import chat, fingerprints, html, labelled, mixing, quality, tokens, toxicity

DOCS = "doc_id long, text string"
PATH = public_tokenizers.path("word_bpe_49k.json")

# html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head>
<body class="page"><header><h2>Site</h2></header><nav><ul><li>Menu</ul></nav><div id="cookie-notice">Accept</div>
<article><header><h1>The &amp; head</h1></header><p>One&nbsp;two<br>three <b>four</b>
<p>five <i>six<p>seven</i></p><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><pre> x
  y </pre><aside>side</aside><form>name <input></form><div class="ad-slot">buy</div>
<section class="comments"><p>reader</p></section><!-- <p>no</p> --></article><footer>foot</footer>"""


def test_blocks():
    assert html.blocks(html.parse(PAGE)) == ["The & head", "One two three four", "five six", "seven", "a", "b", "1", "2", "3", "x y"]
    assert html.blocks(html.parse("")) == [] and html.blocks(html.parse("plain < text")) == ["plain < text"]
    assert html.blocks(html.parse("<p>a</div>b</p>c<main>d</main>")) == ["d"]
    assert html.blocks(html.parse("<div>" * 300 + "deep")) == ["deep"]


def test_host_templates(spark):
    rows = []
    for i in range(8):
        rows.append((i, f"http://a.example/{i}", f"<body><div><p>Welcome to our site</p></div><p>text number {i} is long enough to be the longest one</p><div><span>All rights</span></div></body>"))
    for i in range(8, 16):  # mirrors of one article: its paragraphs recur, but with one longest block
        rows.append((i, f"http://b.example/{i}", "<body><p>the same long article text on every one of these pages</p><p>short</p></body>"))
    for i in range(16, 22):  # a quoted line inside articles stays, a recurring box goes
        rows.append((i, f"http://c.example/{i}", f"<article><p>own text of page {i}, quite a long one it is</p><p>common quote</p><div><span>Box</span></div></article>"))
    rows += [(22, "http://a.example/0", None), (23, None, "<p>x</p>"), (24, "http://[broken", "<p>y</p>"), (None, "u", "<p>z</p>"), (0, *rows[0][1:])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, n_chars int")
    got = {}
    for r in html.main_text(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert got[3] == ["text number 3 is long enough to be the longest one"] and len(got[0]) == 2
    assert got[9] == ["the same long article text on every one of these pages\nshort"]
    assert got[17] == ["own text of page 17, quite a long one it is\ncommon quote"]
    assert got[22] == [""] and got[23] == ["x"] and got[24] == ["y"] and got[None] == ["z"]
    assert html.main_text(df.limit(0)).count() == 0


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, f"http://d.example/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.main_text(df).collect()}


def test_text_blocks_of_an_article_are_counted_too(spark):
    own = [f"own text of page {i}, quite a long one it is, longer than all the rest" for i in range(12)]
    notice, links = "<p>Read our <a>rules</a> first</p>", "<h3>More</h3><ul><li><a>One</a><li><a>Two</a></ul><table><tr><td>x</table>"
    got = texts_of(spark, [f"<main>{notice}<p>{o}</p>{'<p>quoted</p>' if i % 2 else ''}<p>end {i}</p>{links}</main>" for i, o in enumerate(own)])
    assert all(got[i] == f"{o}\n" + ("quoted\n" if i % 2 else "") + f"end {i}" for i, o in enumerate(own))
    got = texts_of(spark, [f"<article><h1>h {i}</h1><p>the same notice</p><p>{o}</p></article>" for i, o in enumerate(own)])
    assert all(got[i] == f"h {i}\n{o}" for i, o in enumerate(own))
    got = texts_of(spark, [f"Home - <a>News</a><p>{o}</p><i>All rights</i>" for o in own])
    assert all(got[i] == o for i, o in enumerate(own))


def test_a_long_block_of_the_host_does_not_merge_its_pages(spark):
    licence = "this long licence text stands on every page and is longer than all of its articles " * 3
    got = texts_of(spark, [f"<div><p>Menu</p></div><p>short article {i}</p><div><p>{licence}</p></div>" for i in range(6)])
    assert all(got[i] == f"short article {i}" for i in range(6))
    story = [f"<p>paragraph {k} of an article that some pages mirror, told at length</p>" for k in range(9)]
    got = texts_of(spark, [f"{''.join(story)}<p>copy {i}</p>" for i in range(4)] + [f"<p>other article {i}</p>" for i in range(8)])
    assert all(len(got[i].split("\n")) == 10 for i in range(4))


def test_names_that_only_mention_boilerplate():
    read = lambda x: html.blocks(html.parse(x))
    for name in ("content no-sidebar", "post-with-comments", "has-header", "sidebarless header-and-content"):
        assert read(f'<div class="{name}"><article><h1>T</h1><p>x</p></article></div><p>other</p>') == ["T", "x"], name
        assert read(f'<p>other text</p><div class="{name}"><p>x</p></div>') == ["other text", "x"], name
    assert read('<div class="sidebar"><main><p>the text</p></main></div>') == ["the text"]
    assert read('<div id="feedback"><p>nearly all of the text</p></div><p>x</p>') == ["nearly all of the text", "x"]
    assert read('<article><div class="entry-header"><h1>T</h1></div><p>x</p></article>') == ["T", "x"]
    assert read('<div class="entry-header"><h1>T</h1></div><p>and a text</p>') == ["T", "and a text"]
    assert read('<article><p>the long text of it</p></article><div class="comments"><article class="comment"><p>no</p></article></div>') == ["the long text of it"]
    for name in ("comments-area", "siteFooter", "left-sidebar", "ad-slot", "main-nav links", "nav2"):
        assert read(f'<p>a text that is long enough</p><div class="{name}"><p>gone</p></div>') == ["a text that is long enough"], name


# tokens

ODD = ["", " \n", "it's 5'8 <|endoftext|> x<|startoftext|>Y", "日本語 text É̈ é", "ÀÉ×÷ß ÿŸ", "12ab34!!?? a|b", "a b c\x1cd \x85", "don'T CAN'T 'S", "é \xe9×", "Ça ffi ﬁ İI", "x" * 5000, "### ###", "́ abc"]


def test_ids_are_those_of_whole_texts():
    e, t = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    assert e.cuts
    for _ in range(2):  # the second time from the table
        ids, counts = e(pa.array([*ODD, None]))
        at = 0
        for text, n in zip([*ODD, ""], counts.tolist(), strict=True):
            assert ids[at : at + n].tolist() == [*t.encode(text, add_special_tokens=False).ids, tokens.END], text[:40]
            at += n


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    ids, _ = tokens.encoder(PATH)(pa.array([text]))
    assert ids.tolist() == [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, tokens.END]


@pytest.mark.parametrize("terminals", [49408, 1 << 20])
def test_shards_round_trip(terminals):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 8, n).astype(np.uint32) for n in (5000, 1, 0, 3000, 2)] + [np.full(1001, 7, np.uint32)]
    docs = [np.append(d, 2).astype(np.uint32) for d in docs]
    counts = np.array([len(d) for d in docs])
    s = tokens.Shard(tokens.pack([3, None, 5, 6, 7, 8], counts, np.concatenate(docs), terminals))
    assert s.doc_ids == [3, None, 5, 6, 7, 8] and len(s.rules) and len(s.symbols) < 0.8 * counts.sum()
    assert (s.all_ids() == np.concatenate(docs)).all()
    for k, d in enumerate(docs):
        assert (s.ids(k) == d).all()
        for a, b in ((0, 1), (1, 700), (len(d) - 1, len(d)), (3, 3)):
            assert s.ids(k, a, b).tolist() == d[a:b].tolist()
    with pytest.raises(ValueError):
        tokens.Shard(tokens.pack([1], np.array([1]), np.array([2], np.uint32), terminals)[:-1] + b"x")


def test_token_output(spark, monkeypatch):
    rows = [(5, "hello there"), (1, None), (3, ""), (2, "General Kenobi! " * 50), (2, "same id"), (None, "no id"), (9, "hello there")]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", start int")
    got = sorted(tuple(r) for r in tokens.token_output(df, PATH).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    t, at, want = Tokenizer.from_file(PATH), 0, []
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tokens.token_output(df.limit(0), PATH).count() == 0


# chat

@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[ROLE]", ""]), st.one_of(st.text(alphabet="ab<[]/s\\IN TlE\n", max_size=20), st.text(max_size=8), st.just(chat.PROBE))), min_size=1, max_size=6))
def test_chat_round_trip(turns):
    turns = [(r, t.encode("utf-8", "ignore").decode()) for r, t in turns]
    out, starts, begin, end = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    assert chat.read_turns(out.tobytes().decode()) == turns
    raw = out.tobytes()
    assert [chat.unescape(raw[a:b].decode()) for a, b in zip(begin, end)] == [t for _, t in turns]


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "hé <s>"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 1, "user", "n"), (3, 5, "assistant", ""), (4, 0, "assistant", "long " * 50_000)]
    rows += [(7, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(400)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    parts = chat.format_chat(chat.with_probe(df))
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    rows += [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[-1].formatted_chars > 2 * len(chat.PROBE)
    assert chat.digests(chat.format_chat(df.limit(0))).count() == 0


def test_a_conversation_over_several_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame([(c, i, "assistant", f"{c}.{i}") for c in (1, 2) for i in range(8)], "conv_id long, turn long, role string, text string")
        got = {r.conv_id: r for r in chat.digests(chat.format_chat(df)).collect()}
        assert chat.format_chat(df).count() > 2
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for c in (1, 2):
        assert got[c].n_turns == 8 and got[c].loss_sha256 == hashlib.sha256("".join(f"{c}.{i}" for i in range(8)).encode()).hexdigest()


# fingerprints

def test_fingerprints(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(3000)}" for _ in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[:200] + [f"v{i}" for i in range(200)])), (4, None), (5, ""), (6, "héé wörld"), (7, "日本語のテキスト" * 60), (8, "a b c d e f g"), (None, "none"), (8, "a b c d e f g")]
    df = spark.createDataFrame([(*x, 3) for x in rows], DOCS + ", n_chars int")
    got = sorted(fingerprints.fingerprints(df).collect(), key=lambda x: (x.doc_id is None, -(x.doc_id or 0)))
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((g.doc_id, g.n_chars, g.edited_sha256)) for g in got)
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)
    by = {g.doc_id: g for g in got}
    assert by[1].fingerprint == by[2].fingerprint and by[2].near_next == 1.0
    assert 0.15 < by[3].near_next < 0.55 and by[6].near_next == 0.0
    assert fingerprints.fingerprints(df.limit(0)).count() == 0
    assert fingerprints.fingerprints(df.where("doc_id = 1")).first().near_next == 1.0


def test_anchors_do_not_depend_on_context(spark):
    words = [f"k{i * 7919 % 1000}" for i in range(60)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(["zz", "yy", "xx", *words, "ww"]))], "i int, text string")
    a, b = [r.a for r in fingerprints.with_anchors(df, "text", "a", positions=True).orderBy("i").collect()]
    assert [x for x in a if x is not None] and b[3 : 3 + 57] == a[:57]


def test_a_passage_that_long_documents_share_is_found_in_place(spark):
    r = random.Random(6)
    a, b, shared = ([f"{c}{r.randrange(10**6)}" for _ in range(n)] for c, n in (("a", 6000), ("b", 6000), ("s", 300)))
    rows = [(2, " ".join(a[:1000] + shared + a[1000:])), (1, " ".join(b[:4000] + shared + b[4000:]))]
    got = {x.doc_id: x for x in fingerprints.fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    parts = {d: [(int(x.fingerprint[i : i + 8], 16), x.fingerprint[i + 8 : i + 24]) for i in range(0, len(x.fingerprint), 24)] for d, x in got.items()}
    assert all(len(x) > 0.6 * 6300 and [at for at, _ in x] == sorted(at for at, _ in x) for x in parts.values())
    there = {h: at for at, h in parts[1]}
    both = [(at, there[h]) for at, h in parts[2] if h in there]
    assert len(both) > 150 and all(y - x == 3000 and 1000 <= x < 1300 for x, y in both)
    n = len(parts[1]) + len(parts[2])
    assert 0.8 * len(both) / n < got[2].near_next < 1.1 * len(both) / (n - 2 * len(both))


# classifiers

def labelled_tables(spark, n, make, label):
    r = random.Random(4)
    rows = [(i, *make(r, i)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "e") for i, t, _ in rows] + [(9001, None, "e"), (9002, "", "e"), (None, "x", "e")], DOCS + ", score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {label} int")
    return docs, labels, {i: y for i, _, y in rows}


def words_of(r, n):
    return [r.choice(["lorem", "ipsum", "dolor", "sit", "amet", "velit", "nulla", "quis"]) + r.choice(["", "a", "um", "is", "us"]) for _ in range(n)]


def test_toxicity(spark):
    def make(r, i):
        w = words_of(r, 10 + i % 90)
        if i % 5 == 1:
            for _ in range(2):
                w[r.randrange(len(w))] = "vile" + r.choice(["", "ly", "ness", "st"])
        return " ".join(w), int(i % 5 == 1)

    docs, labels, y = labelled_tables(spark, 400, make, "toxic")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert len(held) > 40 and sum(r.predicted == y[r.doc_id] for r in held) >= 0.97 * len(held)
    empty = {r.doc_id: r.score for r in got if r.doc_id in (9001, 9002)}
    assert empty[9001] == empty[9002] < 0.5
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in got if not r.predicted} == {r.doc_id for r in kept.collect()}
    none = toxicity.fit(docs, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.scored(docs, none).collect()} == {0.333333}
    assert toxicity.without_toxic(docs, none).count() == docs.count()
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_quality(spark):
    def make(r, i):
        w = words_of(r, 20 + i % 60)
        if i % 4 == 0:
            w = [x.upper() + "!!" for x in w] if i % 8 else [x + "$$$" for x in w]
        return " ".join(w), int(i % 4 != 0)

    docs, labels, y = labelled_tables(spark, 400, make, "quality")
    got = quality.scored(docs, quality.fit(docs, labels)).collect()
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 403
    assert {round(r.score, 6) for r in quality.scored(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_pairs_add_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert (0, 1) in model.pairs and ((model.scores(x) > 0.5) == y).mean() > 0.95


def test_training_rows_are_bounded_and_not_held_out(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(300)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    rows = labelled.training_rows(docs, labels, "toxic", 50).collect()
    assert len(rows) == 50 and all(zlib.crc32(r.text.encode()) % 5 for r in rows)
    assert sorted(r.text for r in rows) == sorted(r.text for r in labelled.training_rows(docs.repartition(7), labels, "toxic", 50).collect())


# mixing

def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free -= over
    return out


def test_mixing(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randrange(1, 60)), r.choices(["é", "b", "a", None, "B", "tiny"], [9, 5, 5, 3, 2, 0.1])[0]) for i in range(500)]
    rows += [(600, None, "empty"), (601, "", "empty"), (7, rows[7][1], rows[7][2]), (None, "x y z", "a"), (602, "one", "tiny")]
    df = spark.createDataFrame([(*x, 1) for x in rows], DOCS + ", source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(5)).collect()))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken = {}
    for x in got:
        assert x.size == len((x.text or "").split()) and x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6
        assert 0 <= x.taken <= 3 * x["size"]
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    out = {}
    for x in mixing.repeated(mixing.mix(df)).collect():
        out[x.source] = out.get(x.source, 0) + len((x.text or "").split())
    assert {s: n for s, n in out.items() if n} == {s: n for s, n in taken.items() if n}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.repeated(mixing.mix(df.limit(0))).count() == 0
