"""Token alignment against offsets: where groups close, which tokens end together, and counts over all texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from varlake.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def printable_bytes():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@pytest.fixture(scope="module")
def sides():
    a, b, of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), printable_bytes()
    a.encode_special_tokens = True
    piece = lambda p: bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode()
    return (lambda t: [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids],
            lambda t: [(i, piece(b.id_to_piece(i))) for i in b.encode(t)])


def ends(tokens):
    at, out = 0, []
    for _, x in tokens:
        at += len(x)
        out.append(at)
    return out


def brute(rows, sides):
    done, count = [], Counter()
    for doc, text in rows:
        text = text or ""
        a, b = (side(text) for side in sides) if text else ([], [])
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
            a, b = [], []
        ends_a, ends_b = ends(a), ends(b)
        both = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for end in both:
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(str(t) for t, _ in a[i:x]) + "|" + ",".join(str(t) for t, _ in b[j:y]))
            i, j = x, y
        at_b = {}
        for (j, _), f in zip(b, ends_b):
            at_b.setdefault(f, []).append(j)
        links = [(i, j) for (i, _), e in zip(a, ends_a) for j in at_b.get(e, [])]
        count.update(links)
        done.append((doc, len(a), len(b), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    return sorted(((d, na, nb, ng, len(ln), sum(count[x] == most[x[1]] for x in ln), sum(count[x] for x in ln), sha) for d, na, nb, ng, ln, sha in done), key=repr)


TEXTS = [None, "", " ", "  ", "a", "Hello world", "Hello  world \n\n next\tline", "naïve café — “quoted” …", "日本語のテキスト と English", "▁", "a▁b", "<s> </s> <unk> <0x41>",
         "<|endoftext|>", "x<|endoftext|>y", "🙂🙃 👩‍👩‍👧", "\x00", "﻿bom", "ﬁ ligature ① ²", "é é", " nbsp　wide", "don't we'll I'd", "1234567890 3.14159", "\U0010ffff", "ا ل ع"]


def test_alignment_equals_offsets(spark, sides):
    rng = random.Random(2)
    chars = "abc de.,'\n\t é日🙂́<>0x41|"
    rows = [*enumerate(TEXTS + ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 60))) for _ in range(300)])]
    rows += [(0, "Hello world"), (0, "Hello world"), (None, "Hello world"), (None, None), (999, "the same of it " * 300), (1000, "x" * 3000)]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, pairs string, id int").repartition(3)
    got = sorted((tuple(r) for r in alignment.alignment(docs, A, B).collect()), key=repr)
    assert got == brute(rows, sides)
    assert sum(r[1] > 0 for r in got) > 200 and sum(r[1] == 0 for r in got) >= 5


def test_whole_small_table(spark, sides):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in alignment.alignment_query(spark, "/root/testdata/sf0.001").collect()), key=repr) == brute(rows, sides)


def test_groups(spark, sides):
    docs = spark.createDataFrame([("k", "Hello  wörld"), ("n", None)], "name string, body string")
    got = {r["name"]: r["groups"] for r in alignment.token_groups(docs, A, B, "name", "body").collect()}
    a, b = (side("Hello  wörld") for side in sides)
    assert got["n"] == [] and [i for g in got["k"] for i in g["a"]] == [i for i, _ in a] and [j for g in got["k"] for j in g["b"]] == [j for j, _ in b]
    assert alignment.alignment(docs, A, B, "name", "body").columns[0] == "name"


def test_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_links_stay_within_the_bound(sides):
    own = alignment.Aligner(A, B)
    assert 30_000 < own.link_bound() < 700_000
    for text in own.aligned([t for t in TEXTS if t]):
        for _, said, _ in text:
            for a, b in alignment.groups(said):
                x, y = own.bytes_a[a[-1]], own.bytes_b[b[-1]]
                assert x.endswith(y) or y.endswith(x)
    assert len(own.memo) and own.residuals[0] == (False, b"")


def test_transitions_do_not_depend_on_the_memo(monkeypatch):
    text = "Hello  wörld, many a word's tokens 日本 don't line up"
    own = alignment.Aligner(A, B)
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    whole = own.transduced(a, b)
    steps = len(own.memo)
    assert own.transduced(a, b) == whole and len(own.memo) == steps
    monkeypatch.setattr(alignment, "MEMO_MOST", 2)
    assert alignment.Aligner(A, B).transduced(a, b) == whole


def test_stretches_join_to_whole_texts(sides):
    """Cut into stretches, texts of all kinds of white space and signs have the ids that they have as a whole."""
    rng = random.Random(8)
    chars = ["a", "b", "word", "the", "'s", "'", "ll", "1", "23", ".", "…", "é", "日本", "🙂", "\u0301", "ß"] * 2 + [" "] * 14 + ["\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "\x00"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 50))) for _ in range(4000)]
    own = alignment.Aligner(A, B)
    for text, found in zip(texts, own.aligned(texts)):
        a, b = (side(text) for side in sides)
        if all(b"".join(x for _, x in side) == (" " + text).encode() for side in (a, b)):
            assert [i for s in found for g, _ in alignment.groups(s[1]) for i in g] == [i for i, _ in a]
            assert [j for s in found for _, g in alignment.groups(s[1]) for j in g] == [j for j, _ in b]
        else:
            assert found == []
    assert any(len(found) > 3 for found in own.aligned(texts))


def test_memo_of_stretches_is_bounded(monkeypatch, spark, sides):
    monkeypatch.setattr(alignment, "STRETCHES_MOST", 3)
    own = alignment.Aligner(A, B)
    texts = ["many words that are not the same", "many words that are", None, "x" * 500, "many"] * 40
    whole = [[s[1] for s in found] for found in alignment.Aligner(A, B).aligned(texts[:5])]
    for _ in range(2):
        assert [[s[1] for s in found] for found in own.aligned(texts)] == whole * 40
    assert not any(len(s) > alignment.LONG for s in own.known) and len(own.known) <= 40
