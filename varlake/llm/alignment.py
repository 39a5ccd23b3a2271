"""Alignment of two tokenizers' tokens over the same bytes, by a transducer over dangling suffixes.

The state is which side leads and the bytes by which it leads (the residual). From the empty residual, A reads its next
token and leads by it; while a side leads, the other one reads: its token takes bytes off the residual, or uses it up and
leads by what is left of itself. Whenever the residual is empty a group of tokens closes. A transition depends on the
residual and the next token alone and is memoised by them, so that nearly every step is one look-up; residuals are proper
parts of tokens, so there is a bounded number of states. Texts of which a tokenizer's bytes are not the text's are left out
beforehand, so the sides never contradict each other.

The last tokens of a group end together, and only those: they are its link. Of two tokens that end together one is a suffix
of the other. So the id pairs that any corpus can link are bounded by the vocabularies: each token has at most as many
suffixes as bytes, about 600,000 pairs for the two vocabularies of the query (`link_bound` counts them). Each text is
tokenised once, its groups' digest and its link counts are written, and the corpus-wide count of every pair, a table within
that bound, goes to the second pass as a broadcast.

Where a space follows something that is not white space, both sides have a cut: if no token holds such a place, none can lie across it,
and what is on either side is tokenised alike on its own. There the residual is empty, so a text is a sequence of stretches, each from the empty
residual back to it, and stretches are memoised whole: the transducer runs over new ones only. With vocabularies that do hold such a place,
a text is one stretch.

Tokenizers are files given by path, A for the tokenizers library (byte-level BPE), B for sentencepiece. Special tokens'
strings inside texts are plain text.

Defined results: null and empty texts, and texts whose bytes a tokenizer does not keep, have no tokens: zeros, no groups
and an empty digest; each row is a text of its own, repeated or not; a null id stays null; an empty table gives no rows; other columns
are ignored and may have any names. Texts are whole, however long.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .shared import Scratch, table

BATCH = 64  # texts tokenised at a time
MEMO_MOST, STRETCHES_MOST = 2_000_000, 400_000
LONG = 64  # longer stretches are not memoised
SHIFT = 32  # a pair of ids is a * 2**SHIFT + b
STATE_SHIFT = 20  # bits of a token in the key of a transition
PIECE_SPACE = "▁"


# Of a part of a text: n_a | n_b << SHIFT, the groups of ids as `a1,a2|b1;a3|b2,b3`, and its links, codes of eight bytes each.
Stretch = tuple[int, str, bytes]


def groups(said: str) -> list[tuple[list[int], list[int]]]:
    return [tuple([*map(int, side.split(","))] for side in group.split("|")) for group in said.split(";")]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        self.bytes_a: list[bytes] = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.bytes_b = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.text = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.residuals: list[tuple[bool, bytes]] = [(False, b"")]  # state: whether A leads, by which bytes
        self.states = {(False, b""): 0}
        self.b_reads = [False]  # by state: whose turn it is
        self.memo: dict[int, int] = {}  # by state and token
        self.four = [i.to_bytes(4, "little") for i in range(len(self.text))]
        self.known: dict[str, Stretch | None] = {}
        self.older: dict[str, Stretch | None] = {}
        apart = not any(re.search(r"\S ", x.decode("utf-8", "replace")) for x in self.bytes_a) and not any(re.search(rb"[^ ] ", x) for x in self.bytes_b)
        self.cut = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*" if apart else ".+", re.S).findall

    @staticmethod
    def _piece(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(PIECE_SPACE, " ").encode()

    def link_bound(self) -> int:
        """How many pairs of ids can end together: one's bytes are a suffix of the other's."""
        count_a, count_b = ({x: n for x, n in zip(*np.unique(np.array(side, object), return_counts=True))} for side in (self.bytes_a, self.bytes_b))
        suffixes = lambda tokens, other, first: sum(n * other.get(t[i:], 0) for t, n in tokens.items() for i in range(first, len(t)))
        return int(suffixes(count_a, count_b, 0) + suffixes(count_b, count_a, 1))

    def aligned(self, texts: list[str | None]) -> Iterator[list[Stretch]]:
        """The stretches of each text after a space; none where the bytes of either side are not those of a space and the text."""
        for at in range(0, len(texts), BATCH):
            some = [self.cut(" " + t) if t else [] for t in texts[at:at + BATCH]]
            new = set().union(*some).difference(self.known)
            again = new & self.older.keys()
            self.known.update((s, self.older[s]) for s in again)
            once = self.tokenised(list(new - again))
            yield from ([] if None in (out := [*map(once.__getitem__, cut)]) else out for cut in some)
            for stretch in new:
                if len(stretch) > LONG:
                    del self.known[stretch]
            if len(self.known) > STRETCHES_MOST // 2:  # what is not used again goes with the next generation
                self.older, self.known = self.known, {}

    def tokenised(self, stretches: list[str]) -> dict[str, Stretch | None]:
        """All known stretches with new ones, which begin with a space: that of B's own prefix is left to it. Stretches that end with a sign are
        tokenised as one text, which is cut where they end; should the bytes not be the text's, each on its own."""
        text = "".join([s for s in stretches if s[-1:].strip() and len(s) <= LONG])
        apart = [s for s in stretches if not s[-1:].strip() or len(s) > LONG]
        if text:
            together = [s for s in stretches if s[-1:].strip() and len(s) <= LONG]
            ends = np.cumsum([len(s.encode()) for s in together])
            ids = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
            cuts = []
            for side, tokens in zip(ids, (self.bytes_a, self.bytes_b)):
                upto = np.cumsum([len(tokens[i]) for i in side])
                cut = np.searchsorted(upto, ends)
                same = len(upto) and upto[-1] == ends[-1] and (upto[cut] == ends).all() and b"".join([tokens[i] for i in side]) == text.encode()
                cuts.append([0, *(cut + 1).tolist()] if same else None)
            if None in cuts:
                apart = stretches
            else:
                (a, b), (ca, cb) = ids, cuts
                for n, stretch in enumerate(together):
                    self.known[stretch] = self.transduced(a[ca[n]:ca[n + 1]], b[cb[n]:cb[n + 1]])
        ids_b = self.b.encode([s[1:] for s in apart], num_threads=1)
        for stretch, a, b in zip(apart, self.a.encode_batch_fast(apart, add_special_tokens=False), ids_b):
            whole, a, b = stretch.encode(), a.ids, b or [self.b.piece_to_id(PIECE_SPACE)]
            kept = b"".join([self.bytes_a[i] for i in a]) == whole and b"".join([self.bytes_b[i] for i in b]) == whole
            self.known[stretch] = self.transduced(a, b) if kept else None
        return self.known

    def _learn(self, key: int) -> int:
        """The state after the side whose turn it is has read the token."""
        state, token = key >> STATE_SHIFT, key & ((1 << STATE_SHIFT) - 1)
        a_leads, residual = self.residuals[state]
        read = (self.bytes_b if a_leads else self.bytes_a)[token]
        if residual.startswith(read):
            after = (a_leads, residual[len(read):])
        else:
            assert read.startswith(residual), "the sides contradict each other"
            after = (not a_leads, read[len(residual):])
        if not after[1]:
            after = (False, b"")
        if after not in self.states:
            self.states[after] = len(self.residuals)
            self.residuals.append(after)
            self.b_reads.append(after[0])
        if len(self.memo) > MEMO_MOST:
            self.memo.clear()
        self.memo[key] = self.states[after]
        return self.states[after]

    def transduced(self, a: list[int], b: list[int]) -> Stretch:
        said, links, state, i, j, at_a, at_b = [], [], 0, 0, 0, 0, 0
        known, b_reads, text, four = self.memo.get, self.b_reads, self.text, self.four
        n_a, n_b = len(a), len(b)
        while i < n_a or j < n_b:
            if b_reads[state]:
                token = b[j]
                j += 1
            else:
                token = a[i]
                i += 1
            key = state << STATE_SHIFT | token
            state = known(key, -1)
            if state < 0:
                state = self._learn(key)
            if not state:  # a group closes
                left = text[a[at_a]] if i == at_a + 1 else ",".join([text[t] for t in a[at_a:i]])
                right = text[b[at_b]] if j == at_b + 1 else ",".join([text[t] for t in b[at_b:j]])
                said.append(f"{left}|{right}")
                links.append(four[b[j - 1]] + four[a[i - 1]])
                at_a, at_b = i, j
        return i | j << SHIFT, ";".join(said), b"".join(links)


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker and pair of paths."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def token_groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, groups array<struct<a array<int>, b array<int>>> for every row: the ids of A and of B over the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            out = [[{"a": a, "b": b} for _, said, _ in text for a, b in groups(said)] for text in own.aligned(batch["text"].to_pylist())]
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(out, kind)], names=["id", "groups"])

    rows = _texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, groups array<struct<a array<int>, b array<int>>>").withColumnRenamed("id", id_col)


def linked_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256 and the text's distinct links: pairs (codes of two ids), times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            numbers, digests, pairs, times = [], [], [], []
            for text in own.aligned(batch["text"].to_pylist()):
                codes, n = np.unique(np.frombuffer(b"".join([s[2] for s in text]), np.int64), return_counts=True)
                both, links = sum([s[0] for s in text]), int(n.sum())
                numbers.append((both & ((1 << SHIFT) - 1), both >> SHIFT, links, links))  # a link for each group
                digests.append(hashlib.sha256(";".join([s[1] for s in text]).encode()).hexdigest() if text else "")
                pairs.append(codes)
                times.append(n)
            columns = [pa.array(c, pa.int64()) for c in zip(*numbers)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(
                [batch["id"], *columns, pa.array(digests, pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = _texts(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>").withColumnRenamed("id", id_col)


def link_counts(linked: DataFrame) -> DataFrame:
    """a, b, n, best: each linked pair of ids, how many links of the corpus hold it, and whether no A id is linked with b
    more often."""
    each = linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    counted = each.select(F.shiftright("pair", SHIFT).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b"), "n")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row."""
    scratch = Scratch(docs.sparkSession, "alignment")
    linked = scratch.save(linked_texts(docs, path_a, path_b, id_col, text_col), "linked")
    counts = scratch.save(link_counts(linked), "counts").toArrow()  # bounded by the vocabularies, see above
    codes = (counts["a"].to_numpy().astype(np.int64) << SHIFT) + counts["b"].to_numpy()
    order = codes.argsort()
    shared = docs.sparkSession.sparkContext.broadcast((codes[order], counts["n"].to_numpy()[order], counts["best"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = shared.value
        for batch in batches:
            pairs, times = (batch[c].flatten().to_numpy() for c in ("pairs", "times"))
            ends = np.concatenate([[0], np.cumsum(batch["pairs"].value_lengths().to_numpy())]).astype(np.int64)
            at = np.searchsorted(codes, pairs)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[at], times * n[at])]
            n_best, count_sum = (s[ends[1:]] - s[ends[:-1]] for s in sums)
            kept = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=[*kept, "n_best", "count_sum"])

    out = linked.schema.simpleString().removeprefix("struct<").split(",pairs:")[0].replace(id_col, f"`{id_col}`", 1)
    done = linked.mapInArrow(run, f"{out},n_best:bigint,count_sum:bigint")
    return done.select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
