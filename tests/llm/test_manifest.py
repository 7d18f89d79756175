"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest

from tallgrass.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx int, digest string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    out = []
    for row in tree[:-1]:
        first = i // 8 * 8
        out.append(("".join(row[first:i]), "".join(row[i + 1 : first + 8])))
        i //= 8
    return out


def fold(digest, steps):
    for a, b in steps:
        digest = sha(a, digest, b)
    return digest


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, levels([leaf(r) for r in own])
    top = levels([trees[x][1][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        own, tree = trees[lang]
        for i, r in enumerate(own):
            steps = path(tree, i) + path(top, k)
            found = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                found = leaf((*r[:4], None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            folded = fold(found, steps)
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], sha(*(x + y for x, y in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def odd_rows():
    """Trees of one leaf, of a last run of one, of several levels; nulls, repeated rows and ids, many langs, a long text."""
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (None, None, "en", 3, "No Id"), (3, "s", "en", 1, "É Same"), (3, "s", "en", 1, "É Same"), (3, "s", "en", 1, "other"), (7, "s", "zz", 9, "Alone"), (8, "s", "en", 5, "LONG " * 50_000)]
    rows += [(d, f"s{d % 3}", "fr", d, f"Text {d}") for d in range(1000, 1073)]
    rows += [(d, None, f"l{d}", d, f"T{d}") for d in range(20)]
    rows += [(5000 - d, "x", "de", d, "Copy") for d in range(4100)]
    return rows


@pytest.mark.parametrize(("parts", "levels_"), [(1, 4), (13, 4), (5, 1), (3, 2)])
def test_odd_rows(spark, parts, levels_, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", levels_)
    rows = odd_rows() if levels_ > 1 else odd_rows()[:200]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)
    assert sorted(map(tuple, manifest.summary(docs).collect()), key=str) == plain(rows)


def test_proofs_fold_to_the_root(spark):
    rows = odd_rows()[:110]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = manifest.manifest(docs).collect()
    assert len(got) == len(rows) and all(r.verified and manifest.fold(r.leaf, r.lefts, r.rights) == r.root == r.folded_root for r in got)
    assert all(manifest.fold("0" * 64, r.lefts, r.rights) != r.root for r in got)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = sorted(map(tuple, manifest.summary(docs).collect()), key=str)
    assert got == plain(rows) and 0 < sum(not r[-1] for r in got) < len(got)


def test_empty_table(spark):
    assert manifest.summary(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counts():
    assert [manifest.height(n) for n in (0, 1, 2, 8, 9, 64, 65, 8**7, 8**7 + 1)] == [0, 0, 1, 1, 2, 2, 3, 7, 8]
    assert [manifest.counts(65, k) for k in range(4)] == [65, 9, 2, 1]
