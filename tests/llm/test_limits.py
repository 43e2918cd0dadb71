"""Adversarial words, hot keys, outlying ids, clashing names, deep markup, stored parts, and brute force for what SQL can't say."""

import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from weftgraph.llm import chat, decontamination, fingerprints, html, mixing, neardup, shared, substrings, tokens, toxicity, words

DOCS = "doc_id long, text string"
PATH = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(levels, a="a", b="b"):
    out, swap = a, str.maketrans(a + b, b + a)
    for _ in range(levels):
        out += out.translate(swap)
    return out


def two_words(levels):
    word = thue_morse(levels)
    return "x" + word + "x", "x" + word.translate(str.maketrans("ab", "ba")) + "x"


@pytest.mark.parametrize("levels", [10, 12, 14])
def test_patterned_words_do_not_collide(spark, levels):
    a, b = two_words(levels)
    encode, whole = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    ids, counts = encode(pa.array([a, b]))
    assert [ids[: counts[0]].tolist(), ids[counts[0] :].tolist()] == [[*whole.encode(x, add_special_tokens=False).ids, tokens.END] for x in (a, b)]
    filler = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (2, b), (3, " ".join(a)), (4, " ".join(b))], DOCS)
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect() if r.doc_id < 3} == {1: 1, 2: 2}
    df = spark.createDataFrame([(1, f"{a} {filler}"), (2, f"{b} {filler}")], DOCS)
    # the filler repeats, the word before it doesn't
    assert {r.doc_id: r.kept for r in substrings.remove_repeats(df).collect()} == {1: f"{a} {filler}", 2: b}


def test_windows_of_words_by_doubling():
    h = np.random.default_rng(1).integers(0, 3, 300).astype(np.uint64)
    for width in (1, 2, 5, 8, 25, 50, 300):
        found = {}
        for i, x in enumerate(words.runs(h, width).tolist()):
            assert found.setdefault(tuple(h[i : i + width].tolist()), x) == x
        assert len(set(found.values())) == len(found)
    assert len(words.runs(h, 301)) == 0


# Re-Pair


@pytest.mark.parametrize("terminals", [40, 49152, 65500, 70000])
def test_no_frequent_pair_is_left(terminals):
    rng = np.random.default_rng(terminals)
    docs = [rng.integers(3, 40, rng.integers(1, 900)) for _ in range(120)]
    docs += [np.full(5000, 7), np.tile(rng.integers(3, 40, 33), 90), np.array([2]), *[docs[0]] * 40]
    counts = np.array([len(d) for d in docs])
    ids = np.concatenate(docs).astype(np.uint32)
    rules, symbols, firsts = tokens.compress(ids, counts, terminals)
    pairs = {}
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        for pair in zip(symbols[a : b - 1].tolist(), symbols[a + 1 : b].tolist()):
            pairs[pair] = pairs.get(pair, 0) + 1
    assert max(pairs.values(), default=0) < tokens.LEAST_COUNT
    assert symbols.itemsize == (2 if terminals + len(rules) <= 1 << 16 else 4)
    shard = tokens.Shard(tokens.pack(list(range(len(docs))), counts, ids, terminals))
    assert (shard.all_ids() == ids).all() and all((shard.ids(k) == d).all() for k, d in enumerate(docs))
    assert (shard.ids(120, 1234, 1300) == 7).all() and len(shard.ids(120, 1234, 1300)) == 66


def test_the_table_of_pieces_grows_and_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "FIRST_SLOTS", 1 << 4)
    monkeypatch.setattr(tokens, "SLOTS", 1 << 9)
    encode, whole = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    pick = np.random.default_rng(1).integers
    texts = [" ".join(f"{thue_morse(3)[: x % 7]}{'abcdefghij'[x % 10]}{'klmnopqrst'[x // 10 % 10]}{'uvwxyz'[x // 100]}" for x in pick(0, 600, 20)) for _ in range(60)]
    sizes = []
    for a in range(0, 60, 2):
        ids, counts = encode(pa.array(texts[a : a + 2]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*whole.encode(t, add_special_tokens=False).ids, tokens.END] for t in texts[a : a + 2]]
        sizes.append((encode.known.size, encode.known.held))
        assert encode.known.held <= encode.known.size // 2
    assert len({size for size, _ in sizes}) > 1 and any(b[1] < a[1] for a, b in zip(sizes, sizes[1:], strict=False))


def test_batches_to_python_are_bounded_in_bytes(spark):
    spark.conf.unset(shared.BATCH_SETTING)
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 10000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    found = [r.n for r in shared.in_arrow(rows, sizes, "n long").collect()]
    assert sum(found) > 30_000_000 and max(found) < 1.1 * shared.BATCH_BYTES
    spark.conf.set(shared.BATCH_SETTING, "1m")
    assert max(r.n for r in shared.in_arrow(rows, sizes, "n long").collect()) < 1.1 * (1 << 20)
    spark.conf.unset(shared.BATCH_SETTING)


def test_a_long_text_is_encoded_in_stretches(monkeypatch):
    monkeypatch.setattr(tokens, "LONG_BYTES", 1000)
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 300)
    text = "it's éA 12 <|endoftext|> no" + "x" * 900 + " tail\n" * 700
    encode = tokens.Encoder(PATH)
    ids, counts = encode(pa.array([text]))
    assert ids.tolist() == [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, tokens.END] and counts.tolist() == [len(ids)]


# pages


def test_deep_and_broken_markup():
    for tag in ("div", "ul><li", "section", "b"):
        root = html.parse(f"<p>before</p>{f'<{tag}>' * 10_000}deep")
        html.mark(root)
        assert html.blocks(root, {1: html.RARE})[-1] == "deep"
    assert html.blocks(html.parse('<p>a <a href="x>link</a> text <b class="y">z</b></p>')) == ["a link text z"]
    assert html.blocks(html.parse('<p title="1<2>3">k</p><a data-x="<p>q</p>">w</a>')) == ["k", "w"]


def test_templates_outside_the_article_go_before_it_is_looked_for(spark):
    teaser = "<div><article><h2>Read next</h2><p>a story that every page of the host advertises at length, longer than its own</p></article></div>"
    menu = "<nav><ul><li>One<li>Two</ul></nav><div><p>All rights</p></div>"
    rows = [(i, f"http://t.example/{i}", f"{menu}<div><p>page {i} has no article element</p><p>and says {i * i}</p></div>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.main_text(df).collect()} == {i: f"page {i} has no article element\nand says {i * i}" for i in range(12)}
    counted = {n.tag for n in html.outer(marked(menu))}
    assert counted == {"nav", "ul", "li", "div", "p"} and not html.outer(marked(teaser))


def marked(page):
    root = html.parse(page)
    html.mark(root)
    return root


# chat


def test_stored_parts_are_read_in_any_order(spark):
    rows = [(c, t, ("user", "assistant", "tool<")[t % 3], f"say [{c}] \\ {t} </s>" * (t + 1)) for c in (1, 2, None) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    old = words.chunks.__defaults__
    words.chunks.__defaults__ = (40,)
    try:
        parts = list(chat._parts(iter(pa.RecordBatch.from_pylist([{"conv_id": c, "turn": t, "role": r, "text": x} for c, t, r, x in rows[:9]]).slice(0, 9) for _ in range(1))))
    finally:
        words.chunks.__defaults__ = old
    assert sum(len(b) for b in parts) > 3
    stored = shared.written(chat.format_chat(df).repartition(7), "parts")
    key = lambda r: str(tuple(r))
    assert sorted(chat.digests(stored).collect(), key=key) == sorted(chat.digests(chat.format_chat(df)).collect(), key=key)


# fingerprints


def brute_fingerprint(text):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long = lambda x, seed=42: xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
    said = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    h = []
    for i, w in enumerate(said):
        x = xxhash.xxh64_intdigest(w.encode(), 42)
        h.append(signed(xxhash.xxh64_intdigest(said[i + 1].encode(), x) if i + 1 < len(said) else x))
    out = [(i, signed(long(h[i + 2], long(h[i])))) for i in range(len(said) - 3) if h[i + 1] >= min(h[i], h[i + 2])]
    return out or [(0, signed(xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(b"whole", 42))))]


def brute_steps(fp):
    return {(a[1], b[1], b[0] - a[0]) for a, b in zip(fp, fp[1:])} if len(fp) > 1 else {fp[0][1]}


def test_fingerprints_against_brute_force(spark, sf):
    edge = [(-(1 << 63), "the least id of all has a text"), ((1 << 63) - 1, "and the greatest one has another text here"), (10**15, "far away from all the others it stands"), (None, "no id"), (7, None), (7, "")]
    rows = edge + [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", __p_text int, _p_text int")
    got = {}
    for r in fingerprints.fingerprints(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    for (d, t), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        fps = [brute_fingerprint(x) for x in (t, t[: len(t) - half] + following[:half], following)]
        steps = [brute_steps(x) for x in fps]
        like = [len(steps[0] & s) / len(steps[0] | s) for s in steps[1:]]
        text = ["".join(f"{a:08x}{h & (1 << 64) - 1:016x}" for a, h in fp) for fp in fps]
        assert any((r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (*text[:2], *like) for r in got[d]), d


def test_ranges_of_outlying_ids_are_even(spark):
    cuts = [3, 5, 5 + (1 << 40)]
    df = spark.createDataFrame([(x,) for x in (-(1 << 63), 2, 3, 4, 5, 1 << 40, (1 << 62))], "x long")
    assert [r[0] for r in df.select(fingerprints.not_above(cuts, df.x)).collect()] == [0, 0, 1, 1, 2, 2, 3]
    assert [r[0] for r in df.select(fingerprints.not_above([], df.x)).collect()] == [0] * 7


# mixing


@pytest.mark.parametrize("edge_rows", [1, 10_000])
def test_mix_with_clashing_names(spark, sf, edge_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix(docs, edge_rows=10).collect()}
    clash = docs.selectExpr("*", "1 as _key", "2 as __of", "3 as _CUT", "4 as __prefix", "5 as Taken")
    got = mixing.mix(clash, edge_rows=edge_rows)
    assert {"_key", "__of", "_CUT", "__prefix"} <= set(got.columns)
    assert {r.doc_id: (r["size"], r["source_size"], r["target"], r["taken"]) for r in got.collect()} == want


# near-duplicates


def test_classes_with_frequent_copies(spark, monkeypatch):
    text = lambda i: " ".join(f"v{i}_{j}" for j in range(30))
    rows = [(i, text(0)) for i in range(40)] + [(100 + i, text(i % 9 + 1)) for i in range(30)]
    rows += [(200, text(0) + " more"), (201, text(1) + " more")]
    want = {d: min(x for x, t in rows if t[:60] == s[:60]) for d, s in rows}
    df = spark.createDataFrame([(*r, "c") for r in rows], DOCS + ", _id string")
    monkeypatch.setattr(neardup, "COPIES", 5)
    for bound in (1_000_000, 0):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", bound)
        assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == want
    assert sorted(r.doc_id for r in neardup.without_duplicates(df).collect()) == sorted(set(want.values()))


def test_recall_of_pairs_by_brute_force(spark):
    """Every pair of likeness 0.8 or more is linked, whatever the number of edits that make it."""
    import random

    rows, linked = [], 0
    for i in range(60):
        r = random.Random(i)
        base = [f"u{i}_{r.randrange(10**6)}" for _ in range(r.randrange(40, 200))]
        near = base.copy()
        for _ in range(1 + i % 4):
            near[r.randrange(len(near))] = f"edit{r.random()}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, DOCS)).collect()}
    for i in range(60):
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (rows[2 * i][1].split(), rows[2 * i + 1][1].split()))
        alike = len(a & b) >= 0.8 * len(a | b)
        linked += alike
        assert (got[2 * i] == got[2 * i + 1]) == alike
    assert 10 < linked < 60


# toxicity


def test_fit_and_scores_do_not_depend_on_the_tasks(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    again = toxicity.fit(docs.orderBy("n_chars").repartition(5), labels)
    assert model.bias == again.bias and (model.weights == again.weights).all()
    texts = [r.text for r in docs.limit(40).collect()] + [None, "", "  ", "ÀÉ x x X", "no"]
    by_hand = []
    for t in texts:
        total = model.bias
        for w in set(words.np.unique([x for x in lower_words(t or "")])):
            at, slot = toxicity.ngrams([w.encode()])
            total += model.weights[slot].sum()
        by_hand.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
    for size in (toxicity.KNOWN, 16):  # with a table, and one that is always too small
        old, toxicity.KNOWN = toxicity.KNOWN, size
        try:
            fresh = toxicity.Model(model.weights, model.bias)
            assert np.allclose(np.concatenate([fresh.scores(pa.array(texts[i : i + 7], pa.string())) for i in range(0, len(texts), 7)]), by_hand)
        finally:
            toxicity.KNOWN = old


def lower_words(text):
    raw = decontamination.lowered(np.frombuffer(text.encode(), np.uint8)).tobytes() if text else b""
    return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]


# decontamination


def normal(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())


@pytest.mark.parametrize("window, similarity", [(13, 0.8), (8, 0.7), (20, 0.9), (6, 1.0)])
def test_overlaps_against_brute_force(spark, window, similarity):
    rng = np.random.default_rng(window)
    items = [(i, " ".join(f"q{x}" for x in rng.integers(0, 300, rng.integers(2, 40)))) for i in range(40)] + [(90, "same old words " * 9)]
    rows = []
    for i in range(60):
        w = [f"q{x}" for x in rng.integers(0, 300, 60)]
        take = items[rng.integers(len(items))][1].split()
        for k in rng.integers(0, len(take), rng.integers(0, 5)):
            take[k] = f"sub{k}"
        a = rng.integers(0, len(take))
        rows.append((i, " ".join(w[:30] + take[a // 2 :] + w[30:])))
    rows.append((99, "same old words " * 30))
    want = set()
    for d, t in rows:
        b = normal(t)
        for i, it in items:
            a = normal(it)
            width = min(window, len(a))
            need = decontamination.needed(width, window, similarity)
            best = None
            for lag in range(-len(a) + 1, len(b)):
                low, high = max(0, -lag), min(len(a), len(b) - lag)
                equal = [a[k] == b[k + lag] for k in range(low, high)]
                for k in range(len(equal) - width + 1):
                    n = sum(equal[k : k + width])
                    if n >= need and (best is None or (n, -(low + lag + k)) > best):
                        best = (n, -(low + lag + k))
            if best:
                want.add((d, i, -best[1], best[0], width))
    got = decontamination.overlaps(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), window, similarity)
    assert {tuple(r) for r in got.collect()} == want
