"""Benchmark decontamination against plain loops, and its suffix arrays against sorting."""

import hashlib
import re

import numpy as np
import pytest

from tallgrass.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, tests, window=10):
    """Per document row: n_words, hit positions, items (a null id marks, unnamed)."""
    windows = {}
    for i, t in tests:
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    sizes, out = sorted({len(x) for x in windows}), []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    items |= {str(i) for i in found if i is not None}
        out.append((d, len(w), sorted(hit), sorted(items)))
    return out


def table(rows):
    return sorted(((d, n, len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit)) for d, n, hit, items in rows), key=str)


@pytest.fixture(scope="module")
def odd():
    """Documents and items with nulls, empty and short items, ties, repeated rows, a hot passage and a very long text."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"P{i % 7}" for i in range(60))
    tests = [(1, passage), (2, "one Two"), (3, " ".join(f"q{i}" for i in range(10))), (4, " ".join(f"q{i}" for i in range(9))), (10, passage), (5, None), (6, ""), (7, " .,-"), (None, "secret words here"), (8, "a b a b a b a b a b a b a b"), (8, "émile zola"), (9, "one two")]
    docs = [(1, passage + " x"), (2, "x " * 20_000 + passage + " y" * 20_000), (3, None), (4, ""), (5, "ONE-two, one_two one"), (6, "q0 q1.q2 q3 q4 q5 q6 q7 q8 q9"), (6, "q0 q1.q2 q3 q4 q5 q6 q7 q8 q9"), (7, "q0 q1 q2 q3 q4 q5 q6 q7 q8"), (None, "the secret words here"), (8, "a b " * 30), (9, "Émile Zola émile Zola"), (11, "p0 p1 p2 p3 p4 p5 p6 p0 p1"), (12, "q1 q2 q3 q4 q5 q6 q7 q8 q9")]
    for d in range(100, 160):  # texts over few words, so that every prefix length occurs
        docs.append((d, " ".join(rng.choice(["p0", "p1", "p2", "one", "a", "b", "q8"], int(rng.integers(0, 40))))))
        docs.append((d + 1000, " ".join([f"own{d}"] * 3 + ([passage] if d % 3 == 0 else []) + ["z"])))
    return docs, tests


@pytest.mark.parametrize(("parts", "part", "shard"), [(1, 8 << 20, 4 << 20), (5, 8 << 20, 300), (3, 40, 5000)])
def test_odd_rows(spark, odd, parts, part, shard):
    docs, tests = odd
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_words int, leak string").repartition(parts)
    t = spark.createDataFrame(tests, "item_id long, text string")
    rows = decontaminate.marked(d, t, part=part, shard=shard)
    assert rows.columns == ["doc_id", "text", "n_words", "leak"]
    want = brute(docs, tests)
    got = sorted(((r.doc_id, r.leak.n_words, [p for s in r.leak.spans for p in range(s.start, s.start + s.n_words)], r.leak["items"]) for r in rows.collect()), key=str)
    assert got == sorted(want, key=str)
    assert sorted(map(tuple, decontaminate.summary(d, t).collect()), key=str) == table(want)
    kept = decontaminate.clean(d, t)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in want if not x[2])


def test_whole_tables(spark, small):
    docs, tests = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, decontaminate.summary(docs, tests).collect()), key=str)
    want = table(brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in tests.collect()]))
    assert got == want and 0 < sum(x[-1] for x in want) < len(want)


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for n, kinds in ((0, 1), (1, 1), (50, 1), (300, 2), (2000, 50)):
        ids = rng.integers(0, kinds, n)
        got = decontaminate.suffix_array(ids, n + 1).tolist()
        assert got == sorted(range(n), key=lambda i: ids[i:].tolist())


@pytest.mark.parametrize(("part", "shard"), [(8 << 20, 4 << 20), (60, 2000)])
def test_longest_matches(spark, odd, part, shard):
    docs, tests = odd
    d, t = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([x for x in tests if x[0] != 8], "item_id long, text string")
    got = {r.item_id: (r.n_words, r.item_word, r.doc_id) for r in decontaminate.longest_matches(d, t, part=part, shard=shard).collect()}
    want = {}
    for i, text in tests:
        w = words(text)
        if i is None or i == 8 or not w:
            continue
        found = []
        for p in range(len(w)):
            for doc, other in docs:
                o = words(other)
                for q in range(len(o)) if len(o) < 9000 else range(19_990, 20_070):
                    n = 0
                    while p + n < len(w) and q + n < len(o) and w[p + n] == o[q + n]:
                        n += 1
                    if n >= min(10, len(w)):
                        found.append((-n, doc is not None, doc or 0, p))
        if found:
            best = min(found)
            want[str(i)] = max(want.get(str(i), (0, 0, None)), (-best[0], best[3], best[2]))
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    texts = {}
    for doc, text in docs:
        texts.setdefault(doc, []).append(words(text))
    for r in decontaminate.longest_matches(d, t, part=part, shard=shard).collect():
        item = [words(x) for i, x in tests if str(i) == r.item_id]
        assert any(x[r.item_word : r.item_word + r.n_words] == o[r.doc_word : r.doc_word + r.n_words] and len(o) >= r.doc_word + r.n_words for x in item for o in texts[r.doc_id])


def test_empty_tables(spark, odd):
    docs, tests = odd
    none = spark.createDataFrame([], "item_id long, text string")
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")
    assert decontaminate.summary(d, none).where("contaminated OR n_items > 0").count() == 0
    assert decontaminate.summary(d.limit(0), t).count() == 0 and decontaminate.longest_matches(d, none).count() == 0
