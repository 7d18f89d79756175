"""The training-data operators against brute force, with odd rows."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import byte_bpe, language_id, line_dedup, mixing, ngram_join, preference, projected_neighbours, quality, rarity, substring_dedup, warc
from tallgrass.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, small):
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "a", 0), (10_003, " \n\t", None, "a", 3), (10_004, "é", "fr", None, 1)], SCHEMA)
    return spark.read.parquet(f"{small}/documents.parquet").unionByName(odd).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(texts, k, percent):
    """Smallest doc_id reachable by links, by comparing all pairs; texts: (doc_id, text) rows."""
    sets, root = {}, {d: d for d, _ in texts}
    for d, t in texts:
        sets.setdefault(d, []).append(shingles(t, k))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if any(x and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("parts", [1, 9])
def test_near_classes(docs, texts, parts, monkeypatch):
    if parts > 1:  # tokens meet in buckets, are often shared within a batch, and tiles hold two sets
        monkeypatch.setattr(rarity, "SHARED", 2)
        monkeypatch.setattr(ngram_join, "MEETINGS", 1)
        docs = docs.repartition(parts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_classes(docs, 4, 85, tile=2 if parts > 1 else 2000, bucket_bytes=50_000).collect()}
    want = classes(texts.items(), 4, 85)
    assert got == {d: (len(shingles(t, 4)), want[d]) for d, t in texts.items()}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("meetings", [0, 2])
def test_near_classes_of_a_hot_group(spark, meetings, monkeypatch):
    """A third of all documents are near copies, of which only some link; another third share a passage and no more."""
    monkeypatch.setattr(ngram_join, "MEETINGS", meetings)
    monkeypatch.setattr(rarity, "SHARED", 3)
    rng = np.random.default_rng(5)
    base, passage, rows = [f"b{i}" for i in range(80)], [f"p{i}" for i in range(30)], []
    for d in range(0, 180, 3):
        near = list(base)
        for at in rng.choice(80, int(rng.integers(0, 4)), replace=False):
            near[at] = f"e{d}x{at}"
        rows += [(d, " ".join(near)), (d + 1, " ".join(passage + [f"w{d}x{i}" for i in range(60)])), (d + 2, " ".join(f"o{d // 6}x{i}" for i in range(50)) + f" z{d}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_join.near_classes(docs, 4, 85, tile=10).collect()}
    assert got == classes(rows, 4, 85)
    assert 5 < sum(got[d] == d for d, _ in rows if d % 3 == 0) < 60


def test_near_classes_of_repeated_ids(spark):
    """Rows of one doc_id are one node; rows without one keep their size; equal rows and other columns change nothing."""
    one, two = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, one), (2, two), (3, one), (3, two), (3, two), (4, f"{two} c"), (None, one), (5, "x y"), (6, "X  y"), (7, "")]
    docs = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "doc_id long, text string, n int, token string, component_id int")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.near_classes(docs, 4, 85).collect()), key=str)
    want = {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
    assert got == sorted(((d or 0, len(shingles(t, 4)), want.get(d)) for d, t in rows), key=str)
    kept = ngram_join.representatives(docs, 4, 85)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 7]


@pytest.mark.parametrize("parts", [1, 9])
def test_substrings(docs, texts, parts):
    """Over several partitions, windows meet in the buckets of their minimisers."""
    first = {}
    words = {d: WORD.findall(t or "") for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    want = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs.repartition(parts) if parts > 1 else docs, 13).collect()}
    assert got == want


def removed_lines(rows):
    """Per row of (doc_id, text): numbers of the lines that an earlier one matches; rows of one doc_id in the order given."""
    seen, want = [], []
    for _, text in rows:
        gone = []
        for n, line in enumerate((text or "").split("\n")):
            w = WORD.findall(line)
            s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            if s:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen if s & o):
                    gone.append(n)
                seen.append(s)
        want.append(gone)
    return want


@pytest.mark.parametrize("parts", [1, 9])
def test_lines(docs, texts, parts, monkeypatch):
    want = dict(zip(sorted(texts), removed_lines([(d, texts[d]) for d in sorted(texts)]), strict=True))
    docs = docs.repartition(parts)
    if parts > 1:
        monkeypatch.setattr(rarity, "SHARED", 2)
        assert {tuple(r) for r in line_dedup.removed_lines(docs, bucket_bytes=20_000).select("doc_id", F.col("line_no").bitwiseAND(0xFFFFFFFF)).collect()} == {(d, n) for d, gone in want.items() for n in gone}
        return
    got = {r.doc_id: list(r.removed_lines) for r in line_dedup.summary(docs).collect()}
    assert got == want
    kept = {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()}
    for d, t in kept.items():
        assert t == (None if texts[d] is None else "\n".join(x for n, x in enumerate(texts[d].split("\n")) if n not in want[d]))


def test_lines_of_a_hot_token(spark):
    """Half of all lines share their rarest tokens; many differ from one another in few shingles and one line is everywhere."""
    rng = np.random.default_rng(3)
    base, rows = [f"b{i}" for i in range(40)], []
    for d in range(120):
        near = list(base)
        for at in rng.choice([0, 1, 2, 20, 37, 38, 39], int(rng.integers(0, 3)), replace=False):
            near[at] = f"e{rng.integers(0, 9)}"
        rows.append((d, "\n".join([" ".join(near), "the line of everyone is this one", " ".join(["b0", "b1", "b2", "b3", "b4"] + [f"w{d}x{i}" for i in range(5)])])))
    got = {r.doc_id: list(r.removed_lines) for r in line_dedup.summary(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == dict(zip(range(120), removed_lines(rows), strict=True))
    assert 0 < sum(0 not in x for x in got.values()) < 120


def test_lines_of_odd_rows(spark):
    """Rows of one doc_id with different texts keep their own lines; equal rows are one; clashing columns and nulls pass."""
    one, two = "the first line of all these lines", "quite another line that nothing matches"
    rows = [(1, one), (2, two), (2, one), (3, f"{two}\n\nx"), (3, f"{two}\n\nx"), (None, one), (4, None), (5, ""), (6, " \t\n"), (7, "x"), (8, f"a {'y ' * 9999}b")]
    docs = spark.createDataFrame([(*r, "keep", 1, 2, 3) for r in rows], "doc_id long, text string, removed string, row int, kept int, n_chars int")
    got = sorted(((r.doc_id, r.text, r.removed, r.row, r.kept) for r in line_dedup.deduplicated(docs).collect()), key=str)
    want = [(1, one), (2, two), (3, "\nx"), (3, "\nx"), (None, one), (4, None), (5, ""), (6, " \t\n"), (8, f"a {'y ' * 9999}b")]
    assert got == sorted(((*r, "keep", 1, 2) for r in want), key=str)
    assert {(r.doc_id or 0, r.n_removed) for r in line_dedup.summary(docs).collect()} == {(1, 0), (2, 0), (2, 1), (3, 1), (0, 0), (4, 0), (5, 0), (6, 0), (7, 1), (8, 0)}


def test_lines_without_python(spark, monkeypatch):
    """No Python runs on the executors. Lines differ in blanks only, have equal sets in another order, or more of equal shingles; half of all are near copies of one."""

    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(1)), name, refused)
    for name in ("applyInArrow", "applyInPandas"):
        monkeypatch.setattr(type(spark.range(1).groupBy("id")), name, refused)
    rng, turn = np.random.default_rng(8), [f"t{i}" for i in range(6)]
    base = [f"b{i}" for i in range(30)]
    rows = []
    for d in range(60):
        near = list(base)
        for at in rng.choice(30, int(rng.integers(0, 3)), replace=False):
            near[at] = f"e{rng.integers(0, 4)}"
        odd = ["one\ttwo", " one  two\r", "one two", "\x0b", "ein\u00a0wort", "y " * int(rng.integers(3, 30)), " ".join((turn[d % 6 :] + turn[: d % 6]) * 4)]
        rows.append((d, "\n".join([" ".join(near), odd[int(rng.integers(0, 7))], " ".join([f"w{rng.integers(0, 3)}" for _ in range(12)]), odd[-1]])))
    got = {r.doc_id: list(r.removed_lines) for r in line_dedup.summary(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == dict(zip(range(60), removed_lines(rows), strict=True))


def test_quality_statistics(spark, docs, texts, small):
    got = {r.doc_id: r.quality for r in quality.judged(docs, quality.trusted_ids(spark.read.parquet(f"{small}/labels.parquet"))).collect()}
    for d, t in texts.items():
        w = WORD.findall(t or "")
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times = Counter(three)
        covered = {j for i, x in enumerate(three) if times[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        q = got[d]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert q.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (q.base_failed and q.kept)


@pytest.mark.parametrize(("sf", "most"), [("sf0.001", 0.3), ("sf0.01", 0.15), ("sf0.1", 0.06)])
def test_quality_verdict_on_labels_left_out(spark, sf, most):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    good = quality.trusted_ids(labels)
    used = good.where("pmod(xxhash64(doc_id, 1), 2) = 0")
    rows = quality.judged(docs, used).where("NOT quality.base_failed").select("doc_id", "quality.kept").collect()
    used, good, known = ({r.doc_id for r in x.select("doc_id").collect()} for x in (used, good, labels))
    rejected = lambda ids: np.mean([not r.kept for r in rows if r.doc_id in ids])
    assert rejected(good - used) <= most
    assert rejected(known - good) >= max(0.2, 2 * rejected(good - used))


def test_every_good_label_is_trusted(spark):
    labels = spark.range(30_000).selectExpr("id DIV 2 * 2 AS doc_id", "1 AS quality", "0 AS toxic").unionByName(spark.range(200_000, 250_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic"))
    assert quality.trusted_ids(labels).count() == 15_000 + 25_000


@pytest.mark.parametrize("words", [1, 64, quality.ID_WORDS])
def test_texts_meet_trusted_ids_alike_at_every_size(spark, docs, texts, words):
    """The join doesn't turn from a broadcast to a shuffle of all texts as ids grow, and texts that have no trusted id stay out of it where the bitmap is wide enough."""
    ids = docs.where("doc_id % 3 = 0").select("doc_id").distinct()
    may = quality.likely(stored(quality.id_bits(ids, words), "bits"), words)
    moved = {r.doc_id for r in docs.where(may).select("doc_id").collect()}
    assert {d for d in texts if d % 3 == 0} <= moved and (words == 1 or len(moved) < len(texts) / 2)
    found = quality.log_ratios(docs, ids, 512, may=may)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert [join for join, key in re.findall(r"(\w+Join) \[(\w+)#", plan) if key == "doc_id"] == ["SortMergeJoin"]
    plain = quality.log_ratios(docs, ids, 512)
    assert found.first().ratios == pytest.approx(plain.first().ratios, abs=1e-12)


def test_quality_without_labels(spark, docs):
    rows = [r.quality for r in quality.judged(docs, docs.select("doc_id").limit(0)).collect()]
    assert all(q.kept != q.base_failed for q in rows) and {q.score for q in rows} == {0.0, None}


def test_mix(docs, texts):
    rows = mixing.mixed(docs).collect()
    size = {r.source: r.source_size for r in rows}
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s)), [5, 2, 1] * 20, strict=False))
    left, open_, target = 1.5 * sum(size.values()), set(size), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not full:
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    longest = max(r.size for r in rows)
    for s in size:
        assert next(r.target for r in rows if r.source == s) == pytest.approx(target[s])
        assert abs(sum(r.passes * r.size * r.copies for r in rows if r.source == s) - target[s]) <= 2 * longest
    assert all(r.passes <= 2 for r in rows)
    again = {r.doc_id: r.taken for r in mixing.taken(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.passes * r.size for r in rows}


def test_bpe_round_trip(docs, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = byte_bpe.Codec(open(path, "rb").read(), public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("ref", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for r in byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True).collect():
        text = texts[r.doc_id] or ""
        assert list(r.ids) == ref.encode_ordinary(text)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_language(docs):
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.lang_pred for r in rows if r.doc_id in (10_001, 10_002, 10_003)} == {"und"}
    held = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)


def test_neighbours(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(90_000, None), (90_001, [0.0] * 64), (90_002, [float("nan")] * 64), (90_003, [1.0] * 3)], rows.schema)
    all_rows = rows.unionByName(odd)
    got = projected_neighbours.nearest(all_rows, all_rows.where("vec_id % 50 = 0"), 5).collect()
    ids, x = zip(*((r.vec_id, r.embedding) for r in rows.collect()), strict=True)
    ids, x = np.array(ids), np.array(x, dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    asked = np.flatnonzero(ids % 50 == 0)
    for i in asked:
        best = [j for j in np.lexsort((ids, -(x @ x[i]))) if j != i][:5]
        hits += len(set(ids[best]) & {r.vec_id for r in got if r.query_id == ids[i]})
    assert hits >= 0.9 * 5 * len(asked)
    assert not {r.query_id for r in got} & {90_000}


def test_visits_are_bounded():
    import pyarrow as pa

    cells, project = projected_neighbours.Cells(np.zeros((0, 8)), 0), projected_neighbours.directions(64)
    x = np.random.default_rng(2).standard_normal((100, 64)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(list(x)), pa.array([4.0] * 100)], names=["vec_id", "embedding", "bound"])
    out = list(projected_neighbours._visits(cells, project, [25_000], 18.2, True)([batch]))
    assert max(len(b) for b in out) <= 10_000
    pairs = {(i, s) for b in out for i, s in zip(b.column("vec_id").to_pylist(), b.column("salt").to_pylist(), strict=True)}
    assert len(pairs) == sum(len(b) for b in out) == 100 * 25_000


def test_neighbours_in_many_blocks_and_asks(spark, small, monkeypatch):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    asked = rows.where("vec_id % 5 = 0")
    got = [sorted(map(tuple, projected_neighbours.nearest(rows, asked, 5, chance=1 - 1e-12).collect()))]
    monkeypatch.setattr(projected_neighbours, "BLOCK", 64)
    monkeypatch.setattr(projected_neighbours, "ASKED", 7)
    got.append(sorted(map(tuple, projected_neighbours.nearest(rows, asked, 5, chance=1 - 1e-12).collect())))
    assert [r[:3] for r in got[0]] == [r[:3] for r in got[1]] and len(got[0]) == 5 * asked.count()


def test_neighbours_of_few_vectors(spark):
    # The direction that projections stretch most: an opposite vector is far beyond any test on the bound 4.
    v = np.linalg.svd(projected_neighbours.directions(64))[0][:, 0]
    rows = spark.createDataFrame([(1, v.tolist()), (2, (-v).tolist()), (3, (2 * v).tolist())], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): r.vec_id for r in projected_neighbours.nearest(rows, rows, 5).collect()}
    assert got == {(1, 1): 3, (1, 2): 2, (2, 1): 1, (2, 2): 3, (3, 1): 1, (3, 2): 2}


def test_warc(spark):
    pages = spark.createDataFrame([(3, "http://b.org/x", "same"), (1, "http://a.org/\r\n\r\n", "same"), (2, None, None), (5, "http://a.org", ""), (None, "http://c.org", "same"), (6, "http://A.org/y", "\r\n\r\nWARC/1.1\r\n")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {3: (4, "revisit", 1), 1: (4, "response", None), 2: (0, "response", None), 5: (0, "revisit", 2), None: (4, "revisit", 1), 6: (14, "response", None)}


def test_loser_tree():
    rng = np.random.default_rng(1)
    runs = [sorted(rng.integers(0, 50, n).tolist()) for n in (0, 1, 7, 30, 2)]
    assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(sum(runs, []))


def test_preference(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (2, 0, "user", None), (3, 1, "assistant", "z"), (3, 0, "system", "s")]
    rows = {r.conv_id: r for r in preference.formatted(preference.paired_with_next(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert rows[1].prompt == "<|user|>\nhi<|end|>\n" and rows[1].chosen_text == "<|assistant|>\na<|end|>\n" and rows[1].rejected_text == "<|assistant|>\n<|end|>\n"
    span = rows[1].chosen_spans[0]
    assert rows[1].chosen_text[span.start : span.end] == "a<|end|>"


@pytest.mark.parametrize("f", [lambda d: ngram_join.near_classes(d), lambda d: substring_dedup.dedup_substrings(d), lambda d: line_dedup.deduplicated(d), lambda d: mixing.taken(d), lambda d: language_id.identify(d)])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0
