"""Each stage of the pipeline against a brute-force version on the same rows."""

import hashlib
import itertools

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from varlake.llm import pii, quality
from varlake.llm.shared import Scratch

COLUMNS = "doc_id long, text string, source string, n_chars long, quality_score double, `a.b` int, mix_times int, row_id long, Text2 string"


@pytest.fixture(scope="module")
def stages(spark):
    """name -> (rows before, rows after), with planted copies, null ids, personal data and clashing names."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "n_chars")
    good = " ".join(f"The {a}{b} went to the town of {b}." for a in ("cat", "dog", "man", "sun", "red", "old") for b in ("river", "mountain", "valley", "garden"))
    more = [(None, good, "s", 1), (None, good, None, 1), (5000, good + " And one more thing.", "s", 1), (5001, good, "s", 1), (5001, good, "s", 1), (5001, "Write to " + good[::2] + " or a.b@example.com.", "t", 1), (5002, None, "s", None), (5003, "", "s", 0)]
    docs = docs.union(spark.createDataFrame(more, "doc_id long, text string, source string, n_chars long"))
    docs = docs.selectExpr("doc_id", "text", "source", "n_chars", "1.0d as quality_score", "2 as `a.b`", "3 as mix_times", "4L as row_id", "'t' as Text2")
    scratch, out = Scratch(spark, "t"), {}
    docs = scratch.save(docs, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.save(stage(spark, docs, sf), name)
        assert after.columns == docs.columns
        out[name] = ([tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()])
        docs = after
    out["bpe"] = (out["mixing"][1], [tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()])
    return out


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


def test_quality_stage(spark, stages):
    before, after = stages["quality"]
    docs = spark.createDataFrame(before, COLUMNS)
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    score = lambda t: quality.scores(model, pii.np.array([quality.features(t)]))[0]
    assert same(after, [r for r in before if score(r[1]) >= quality.REJECT_BELOW]) and len(after) < len(before)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_near_duplicates_stage(stages):
    before, after = stages["near_duplicates"]
    sets = [shingles(r[1]) for r in before]
    head = [*range(len(before))]
    root = lambda i: i if head[i] == i else root(head[i])
    for i, j in itertools.combinations(range(len(before)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0:
            head[root(j)] = root(i)
    groups = {}
    for i, row in enumerate(before):
        groups.setdefault(root(i) if sets[i] else ("none", i), []).append(row)
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    # of rows alike in both, any may stay
    assert same([order(r) for r in after], [min(map(order, g)) for g in groups.values()]) and all(r in before for r in after)


def test_personal_data_stage(stages):
    before, after = stages["personal_data"]
    counts = {}
    for r in before:
        for k, _, _, v, _ in pii.candidates(r[1]):
            counts[k, v] = counts.get((k, v), 0) + 1
    model = pii.fit([(k, v, n) for (k, v), n in counts.items()])

    def redacted(text):
        spans, out, at = pii.find(text, model)[1], "", 0
        for s, k, e in spans:
            if s >= at:
                out += text[at:s] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, e)
        return out + text[at:]

    want = [(r[0], t := redacted(r[1]) if r[1] else r[1], r[2], None if t is None else len(t), *r[4:]) for r in before]
    assert same(after, want) and any("[EMAIL]" in (r[1] or "") for r in after)
    assert all(not pii.base_spans(r[1]) for r in after)


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    times = lambda rows: {r: rows.count(r) for r in set(rows)}
    own, got = times(before), times(after)
    assert own.keys() == got.keys() and all(own[r] <= got[r] <= 2 * own[r] for r in own)
    tokens = lambda rows, s: sum(len((r[1] or "").split()) + 1 for r in rows if r[2] == s)
    lift = {s: tokens(after, s) / tokens(before, s) for s in {r[2] for r in before}}
    assert lift[max(lift, key=lambda s: tokens(before, s))] <= 1.1  # the largest source is taken once, smaller ones more often


def test_bpe_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in before:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert same(after, want)


def test_stages_of_an_empty_table(spark):
    none = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0, name
    assert none.filter(F.lit(True)).count() == 0
