"""Near-duplicates, repeats, decontamination and components against brute force."""

import hashlib
import random

import numpy as np
import pytest

from weftgraph.llm import decontamination, neardup, substrings
from weftgraph.llm.components import components

DOCS = "doc_id long, text string"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(words, every, seed=0):
    return [f"x{seed}_{i}" if i % every == every - 1 else w for i, w in enumerate(words)]


@pytest.fixture(scope="module")
def corpus(spark):
    base = [prose(i, 60 + 13 * i) for i in range(8)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(20 + i, "\n".join(w)) for i, w in enumerate(base[:3])]  # the same words
    rows += [(30 + i, " ".join(edited(w, 60, i))) for i, w in enumerate(base)]  # near
    rows += [(40 + i, " ".join(edited(w, 8, i))) for i, w in enumerate(base)]  # not near
    rows += [(50, " ".join(base[0] + base[1][:55])), (51, None), (52, ""), (53, "one two"), (54, "one two"), (55, " \n "), (None, "only words here"), (56, "nospace" * 3000)]
    rows += [(60, rows[0][1]), (60, rows[0][1])]
    return rows


def shingles(text, k=5):
    w = (text or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or a and b and len(a & b) >= similarity * len(a | b):
                label[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return [(rows[i][0], least[root(i)]) for i in range(len(rows))]


def test_classes(spark, corpus):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in corpus], DOCS + ", class_id int, node string")
    got = [(r.doc_id, r.class_id) for r in neardup.classes(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or 0)
    assert sorted(got, key=key) == sorted(brute_classes(corpus), key=key)


def test_one_row_of_each_class_stays(spark, corpus):
    df = spark.createDataFrame([(d, t, "c") for d, t in corpus], DOCS + ", extra string")
    kept = neardup.without_duplicates(df).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "extra"]
    classes = dict.fromkeys((c for _, c in brute_classes(corpus)))
    assert sorted((r.doc_id for r in kept), key=lambda x: (x is None, x)) == sorted(classes, key=lambda x: (x is None, x))
    assert neardup.without_duplicates(df.limit(0)).count() == 0


def test_chain_between_classes_is_found(spark):
    """Members that only link to each other, not to their bucket's centre, still end in one class."""
    words = prose(99, 300, 5000)
    rows = [(i, " ".join(w if j > 12 * i else f"e{j}" for j, w in enumerate(words))) for i in range(6)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == dict(brute_classes(rows))


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(5)
    n, common = 400, 300
    e = rng.integers(0, 1 << 40, n, dtype=np.uint64)
    other = np.concatenate([e[:common], rng.integers(0, 1 << 40, n - common, dtype=np.uint64)])
    w = 1 + rng.random(n)
    doc = np.repeat([0, 1], n)
    sketch = neardup.prob_min_hash(doc, np.concatenate([e, other]), np.concatenate([w, w]), 2, 2048)
    wa = dict(zip(e.tolist(), w))
    wb = dict(zip(other.tolist(), w))
    exact = sum(1 / sum(max(wa.get(j, 0) / wa[d], wb.get(j, 0) / wb[d]) for j in wa.keys() | wb.keys()) for d in wa.keys() & wb.keys())
    assert abs((sketch[0] == sketch[1]).mean() - exact) < 0.045


def test_repeated_lines_do_not_part_alike_sets():
    """Likeness 0.8 and more, but far less by weights: 50 shingles and a line of ten repeated, one word of it edited."""
    import pyarrow as pa

    texts = []
    for i in range(60):
        plain, line = prose(4000 + i, 54, 10**6), prose(5000 + i, 10, 10**6)
        texts += [" ".join(plain + x * 100) for x in (line, line[:5] + [f"new{i}"] + line[6:])]
        sets = [shingles(t) for t in texts[-2:]]
        assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(120)), "row": list(range(120)), "text": texts})
    found = [set(x) for b in neardup._sketches(5, neardup.BANDS, neardup.ROWS)(iter([batch])) for x in b.column("bands").to_pylist()]
    assert len(found) == 120 and all(found[i] & found[i + 1] for i in range(0, 120, 2))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(f"{rng.randrange(80):03d}".encode(), f"{rng.randrange(80):03d}".encode()) for _ in range(60)]
    import weftgraph.llm.components as c

    for size in (c.LINKS_A_TASK, 10):  # one forest, and several that are joined
        old, c.LINKS_A_TASK = c.LINKS_A_TASK, size
        try:
            got = {bytes(r.node): bytes(r.label) for r in components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
        finally:
            c.LINKS_A_TASK = old
        label = {x: x for p in pairs for x in p}
        for _ in range(80):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        linked = {x for a, b in pairs if a != b for x in (a, b)}
        assert got == {x: label[x] for x in linked}
    assert components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def brute_removed(rows, window=50):
    first = {}
    low = lambda d: -(1 << 63) if d is None else d
    words = [(low(d), d, (t or "").encode().split()) for d, t in rows]
    for d, _, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, name, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((name, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def test_repeats(spark, corpus):
    passage = prose(77, 90)
    rows = corpus + [(100 + i, " ".join(prose(200 + i, 20 + i) + passage[i : i + 60 + i] + prose(300 + i, 9))) for i in range(12)]
    rows += [(130, " ".join(passage * 3)), (131, "a " * 200), (132, "a " * 120), (133, "  tab\tand\x0bvt \x1c odd ".join(passage[:60]))]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], DOCS + ", n_words int")
    got = [tuple(r) for r in substrings.remove_repeats(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute_removed(rows), key=key)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_a_short_window(spark):
    rows = [(1, "a b c d e f"), (2, "x b c d e y"), (3, "b c d"), (4, "q b c d e f")]
    got = {r.doc_id: r.kept for r in substrings.remove_repeats(spark.createDataFrame(rows, DOCS), window=4).collect()}
    assert got == {1: "a b c d e f", 2: "x y", 3: "b c d", 4: "q"}


def test_decontamination(spark):
    items = [(i, " ".join(prose(500 + i, 16 + 3 * i))) for i in range(6)] + [(10, "just five little words here"), (11, None), (12, ""), (13, "...")]
    by = dict(items)
    w = by[3].split()
    rows = [
        (1, " ".join(prose(1, 80)) + " " + by[0].upper() + "!! " + " ".join(prose(2, 30))),
        (2, " ".join(prose(3, 30) + w[:4] + ["zzz"] + w[5:9] + ["yyy"] + w[10:13] + prose(4, 20))),  # 11 of 13
        (3, " ".join(prose(3, 30) + w[:4] + ["zzz", "q"] + w[6:9] + ["yyy"] + w[10:13] + prose(4, 20))),  # 10 of 13
        (4, "So: just FIVE, little words here."),
        (5, "just five little words"),
        (6, None),
        (7, ""),
        (8, by[1] + " " + by[2]),
        (8, by[1] + " " + by[2]),
    ]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], DOCS + ", item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_equal) for r in decontamination.overlaps(df, bench).collect())
    assert got == [(1, 0, 13), (2, 3, 11), (4, 10, 5), (8, 1, 13), (8, 1, 13), (8, 2, 13), (8, 2, 13)]
    kept = decontamination.without_overlaps(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7]
    assert decontamination.overlaps(df, bench.limit(0)).count() == 0 and decontamination.overlaps(df.limit(0), bench).count() == 0


def test_short_items_with_substituted_words():
    import pyarrow as pa
    from itertools import combinations

    for n, bad in ((8, 0), (9, 1), (10, 2), (11, 2), (12, 2)):
        item = prose(40 + n, n, 10**6)
        index = decontamination.Index.of([7], [" ".join(item)], decontamination.WINDOW, decontamination.SIMILARITY)
        for k in (bad, bad + 1):
            texts = [" ".join(["before", *(f"z{i}" if i in gone else w for i, w in enumerate(item)), "after"]) for gone in combinations(range(n), k)]
            got = index.find(*decontamination.normal_words(pa.array(texts)))
            assert got == ([(d, 0, 1, n - k, n) for d in range(len(texts))] if k == bad else [])


def test_seeds_hit_every_window_with_two_substitutions():
    from itertools import combinations

    for bad in combinations(range(decontamination.WINDOW), 2):
        assert any(not {o + x for x in m} & set(bad) for m in decontamination.MASKS for o in range(decontamination.WINDOW - m[-1]))


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    items = [(i, " ".join(prose(700 + i, 20))) for i in range(5)]
    rows = [(i, " ".join(prose(800 + i, 10)) + " " + t) for i, t in items] + [(9, "clean")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id, r.item_id) for r in decontamination.overlaps(df, bench).collect()) == [(i, i) for i in range(5)]
    assert [r.doc_id for r in decontamination.without_overlaps(df, bench).collect()] == [9]
