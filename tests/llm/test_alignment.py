"""Cross-tokenizer alignment against a plain count of overlapping tokens."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallgrass.llm import alignment
from tallgrass.llm.common import shared_dir

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "tab\tand no-break", "x▁y", "▁", "<s> </s> <|endoftext|> <0x41>",
    "café \U0001f984\U0001f984 naïve", "你好 世界", "don't won't 's 's", "\x00 \x01", "é combining", "a" * 3000, " ".join(["word"] * 2000), "　wide 　 wide", "ﬁ Ａ", "1234567890 12 3",
]


class Plain:
    """Whole texts, token by token."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        bs = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.of = {chr(x): x for x in bs} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in bs)}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.of[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = b" " + text.encode()
        return (a, b) if b"".join(x[1] for x in a) == whole == b"".join(x[1] for x in b) else ([], [])

    def document(self, text):
        a, b = self.tokens(text)
        links, groups, i, j, at_a, at_b, group = [], [], 0, 0, 0, 0, ([], [])
        spans = []
        for tokens in (a, b):
            at, own = 0, []
            for x, raw in tokens:
                own.append((at, at + len(raw), x))
                at += len(raw)
            spans.append(own)
        for s, t, x in spans[0]:
            while j < len(spans[1]) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < t:
                links.append((x, spans[1][k][2]))
                k += 1
        ends = sorted({t for _, t, _ in spans[0]} & {t for _, t, _ in spans[1]})
        low = 0
        for end in ends:
            groups.append(tuple([x for s, t, x in own if low < t <= end] for own in spans)) if len(ends) < 400 else None
            low = end
        if len(ends) >= 400:  # the same in one pass
            import bisect

            groups = [([], []) for _ in ends]
            for side, own in enumerate(spans):
                for _, t, x in own:
                    groups[bisect.bisect_left(ends, t)][side].append(x)
        return a, b, links, groups


def summaries(rows):
    plain = Plain()
    found = [(d, *plain.document(t)) for d, t in rows]
    counts = Counter(x for f in found for x in f[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d, a, b, links, groups in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str), counts, best


@pytest.fixture(scope="module")
def rows(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (10_000, "twice"), (10_000, "twice")]


@pytest.mark.parametrize("parts", [1, 7])
def test_summary(spark, rows, parts):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, slice string").repartition(parts)
    got = sorted((tuple(r) for r in alignment.summary(docs, A, B).collect()), key=str)
    assert got == summaries(rows)[0]


def test_small_slices_give_the_same(rows):
    with open(A, "rb") as a, open(B, "rb") as b:
        pair = alignment.Pair(a.read(), b.read())
    assert pair.cuts
    plain = Plain()
    for d, t in rows:
        part = alignment.Slice(pair, [t.encode() if t else t])
        a, b, links, groups = plain.document(t)
        assert [x.tolist() for x in part.ids] == [[x for x, _ in a], [x for x, _ in b]], d
        assert sorted(zip(*(x.tolist() for x in part.link_ids), strict=True)) == sorted(links)
        _, _, ends, n_a, n_b = part.spans(0)
        assert list(zip(n_a.tolist(), n_b.tolist(), strict=True)) == [(len(x), len(y)) for x, y in groups] and (not groups or ends[-1] == len(t.encode()) + 1)


def test_spans_and_translation(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, counts, best = summaries(rows)
    got = {(r.a_id, r.b_id): (r["count"], r.best) for r in alignment.translation(docs, A, B).collect()}
    assert got == {p: (n, n == best[p[1]]) for p, n in counts.items()}
    plain = Plain()
    want = sorted(str((d, [x for x, _ in plain.document(t)[0]], len(plain.document(t)[3]))) for d, t in rows)
    assert sorted(str((r.doc_id, r.a_ids, len(r.groups))) for r in alignment.aligned(docs, A, B).collect()) == want


def test_empty_table_and_clean_up(spark):
    import os

    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.summary(docs, A, B).count() == 0
    assert alignment.translation(docs, A, B).count() == 0
    assert not [x for x in os.listdir(shared_dir(spark)) if x.startswith("counts-")]


def test_invalid_utf8(spark):
    docs = spark.createDataFrame([(1, bytearray(b"ok \xff"))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) text")
    r = alignment.summary(docs, A, B).collect()[0]
    assert (r.n_a, r.n_links, r.groups_sha256) == (0, 0, "")
