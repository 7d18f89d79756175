"""The methods' inner machinery on small inputs, and the pipeline stage by stage against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import byte_bpe, language_id, mixing, projected_neighbours, quality, warc
from tallgrass.llm.common import smallest, stored
from tallgrass.llm.components import components

from .test_operators import SCHEMA, WORD, classes, removed_lines


@pytest.fixture(scope="module")
def stages(spark, small):
    """Input and output rows of every stage over the smallest tables."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, small), name)
        out.append((name, docs.collect(), made.collect(), docs.columns, made.columns))
        docs = made
    return out


def test_stage_names_and_columns(stages):
    assert [s[0] for s in stages] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "weighted_mixing", "byte_bpe"]
    assert all(s[3] == s[4] for s in stages[:-1])
    assert all(s[2] for s in stages)


def test_quality_stage(spark, small, stages):
    _, before, after, *_ = stages[0]
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.judged(docs, quality.trusted_ids(labels)).where("quality.kept").collect()}
    assert {r.doc_id for r in after} == kept and 0 < len(after) < len(before)
    bad = {r.doc_id for r in before if len(WORD.findall(r.text or "")) < 50}
    assert not bad & kept


def test_line_stage(stages):
    _, before, after, *_ = stages[1]
    rows = sorted((r.doc_id, r.text) for r in before)
    want = {}
    for (d, t), gone in zip(rows, removed_lines(rows), strict=True):
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(gone))
        if not gone or WORD.search(left):
            want[d] = left
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after if r.text != dict(rows)[r.doc_id])


def test_near_duplicate_stage(stages):
    _, before, after, *_ = stages[2]
    want = classes([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(d for d, c in want.items() if d == c)


def test_mixing_stage(stages):
    _, before, after, *_ = stages[3]
    times = Counter(r.doc_id for r in after)
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in before}
    words = {r.doc_id: len(WORD.findall(r.text)) for r in before}
    total = sum(words.values())
    assert abs(sum(n * words[d] for d, n in times.items()) - 1.5 * total) <= max(words.values())


def test_encoding_stage(stages):
    _, before, after, *_ = stages[4]
    import tiktoken

    own = byte_bpe.Codec(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("ref", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(ref.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in before)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in after) == want


def test_mix_takes_the_first_finish_times(spark, small):
    """The set taken is that of a plain sort by virtual finish time, cut at the budget."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {(r.source, r.doc_id): r for r in mixing.mixed(docs).collect()}
    keys = {r.doc_id: r.key for r in docs.select("doc_id", F.xxhash64(F.lit(42), "doc_id", F.xxhash64("text")).alias("key")).collect()}
    passes = []
    for s in {s for s, _ in got}:
        done = 0
        for r in sorted((r for (t, _), r in got.items() if t == s), key=lambda r: (keys[r.doc_id], r.doc_id)):
            done += r.size * r.copies
            passes += [((done + n * r.source_size) / r.target, keys[r.doc_id], r.doc_id, s, r.size * r.copies) for n in range(2) if r.size]
    budget, taken, total = math.floor(1.5 * sum(r.size * r.copies for r in got.values())), Counter(), 0
    for *_, d, s, n in sorted(passes):
        total += n
        if total > budget:
            break
        taken[(s, d)] += 1
    assert {k: r.passes for k, r in got.items() if r.size} == {k: taken[k] for k, r in got.items() if r.size}


def test_clashing_columns(spark):
    """Columns named like an operator's own come back as they were."""
    names = ["_source", "_doc", "_fp", "_pass", "passes", "fp", "row", "__words", "__hashes", "quality", "kept"]
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{text} x{i}", "en", "a", 9, *names) for i in range(6)] + [(None, None, None, None, None, *names)], f"{SCHEMA}, {', '.join(f'`{n}` string' for n in names)}")
    mix = mixing.apply_mix(docs)
    assert mix.columns == docs.columns and all([r[n] for n in names] == names for r in mix.collect())
    clean = quality.clean(docs, docs.select("doc_id").where("doc_id < 3"))
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} <= set(range(6)) and all([r[n] for n in names] == names for r in clean.collect())


def test_quality_scores(spark, small):
    """Scores from counts made in plain Python; only the hashes of words are the operator's."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    trusted = docs.select("doc_id").where("pmod(doc_id, 3) = 0")
    rows = {r.doc_id: (r.words, r.h) for r in docs.select("doc_id", quality.split_words(F.col("text")).alias("words"), quality.word_hashes(F.col("text")).alias("h")).collect()}
    pairs = sorted({p for _, h in rows.values() for p in zip(h[:-1], h[1:], strict=True)})
    two = dict(zip(pairs, (r.h for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a long, b long").orderBy("i").select(F.xxhash64("a", "b").alias("h")).collect()), strict=True))
    grams = {d: [x % quality.BUCKETS for x in [*h, *(two[p] for p in zip(h[:-1], h[1:], strict=True))]] for d, (_, h) in rows.items()}
    held = {r.doc_id for r in trusted.where(F.pmod(F.hash("doc_id"), F.lit(quality.HELD_OUT)) == 0).collect()}
    target_ids = {r.doc_id for r in trusted.collect()} - held
    raw, target = Counter(x for g in grams.values() for x in g), Counter(x for d in target_ids for x in grams.get(d, []))
    n, m = sum(raw.values()), sum(target.values())
    score = {d: np.mean([math.log((target[x] * n / (m * raw[x]) + 1) / 2) for x in g]) for d, g in grams.items() if g}
    got = quality.judged(docs, trusted).select("doc_id", "quality.*").collect()
    assert all(r.score == pytest.approx(score[r.doc_id], abs=1e-9) if r.doc_id in score else r.score is None for r in got)
    least = np.quantile([score[d] for d in held if d in score and len(rows[d][0]) >= 50] or [-math.inf], quality.QUANTILE)
    assert all(r.kept == (not r.base_failed and r.score >= least - 1e-12) for r in got)


def test_warc_of_many_ranges(spark, small, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 3)
    monkeypatch.setattr(warc, "RECORDS", 7)
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = sorted(warc.round_trip(pages.repartition(4)).collect(), key=lambda r: (r.range, r.place))
    keys = [(r.urlkey, r.ts, r.page_id) for r in rows]
    assert keys == sorted(keys) and len(keys) == pages.count() and len({r.range for r in rows}) > 5
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_neighbours_in_double_precision(spark):
    """Doubles are not rounded to floats, and neither large nor small components overflow."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 8)) * (10.0 ** rng.integers(-200, 200, 40))[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(40, x[0].tolist()), (40, x[1].tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in projected_neighbours.nearest(rows, rows.where("vec_id < 40"), 3, chance=1 - 1e-12).collect()}
    u = projected_neighbours.unit(x)
    for i in range(40):
        cosine = {j: float(u[i] @ u[j]) for j in range(40) if j != i} | {40: max(float(u[i] @ u[0]), float(u[i] @ u[1]))}
        best = sorted(cosine, key=lambda j: (-round(cosine[j], 12), j))[:3]
        assert [got[(i, n)][0] for n in (1, 2, 3)] == best
        assert got[(i, 1)][1] == pytest.approx(cosine[best[0]], abs=1e-14)


def test_smallest_hashes(spark):
    rows = spark.range(5000)
    hashed = F.xxhash64("id")
    want = {r.id for r in rows.orderBy(F.shiftrightunsigned(hashed, 1)).limit(100).collect()}
    assert {r.id for r in smallest(rows, hashed, 100, "id").collect()} == want
    assert smallest(rows, hashed, 9000).count() == 5000 and smallest(rows.limit(0), hashed, 5).count() == 0


def test_components(spark):
    """Chains, stars, cycles, self-edges, nulls and no edges at all."""
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)] + [(300, 300), (None, 5), (5, None), (7, 3)] + [tuple(map(int, rng.integers(400, 460, 2))) for _ in range(40)]
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_by_brute_force(spark, small):
    """Profiles built letter by letter, over several partitions; only the letters' vectors are the operator's."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 80").select("doc_id", "text", F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("lang"))
    vectors: dict[int, np.ndarray] = {}

    def letter(code: int) -> np.ndarray:
        if code not in vectors:
            vectors[code] = language_id.letter_vectors(np.array([code]))[0].astype(int)
        return vectors[code]

    def profile(text: str | None) -> np.ndarray:
        line = [0]
        for c in (text or "").lower():
            code = ord(c) if c.isalpha() else 0
            if code or line[-1]:
                line.append(code)
        counts = Counter(x for x in zip(line, line[1:], [*line[2:], 0], strict=False) if x[1])
        out = np.zeros(language_id.DIM, int)
        for (a, b, c), n in counts.items():
            out += n * np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        return out

    rows = docs.collect()
    own, learned = {r.doc_id: profile(r.text) for r in rows}, {}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    for r in rows:
        if r.lang is not None and not held[r.doc_id]:
            learned[r.lang] = learned.get(r.lang, 0) + own[r.doc_id]
    for got in language_id.identify(docs.repartition(5)).collect():
        v = own[got.doc_id]
        assert got.held_out == held[got.doc_id]
        if not v.any():
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        cosine = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in sorted(learned.items())}
        best = max(cosine, key=cosine.get)
        assert got.lang_pred == best or cosine[best] - cosine[got.lang_pred] < 1e-9
        assert got.score == pytest.approx(max(cosine[best], 0.0), abs=1e-9)
