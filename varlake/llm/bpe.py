"""BPE encoding and decoding by speculation and verification, for tokenizers with word-end suffixes.

Each distinct word is first cut greedily into the longest vocabulary tokens. A cut is the true BPE result exactly if all
its tokens are (each merges to itself) and every two neighbours are compatible: no merge across their border would come
up before the border symbols are merged away on their own sides. That test runs over all new pairs of a batch at once,
in NumPy. Only words with an incompatible pair go through exact merging, with a heap, so that very long words cost
n log n. Results of words are kept in a bounded memo per Python worker; the tokenizer is a file given by its path.

Defined results: null and empty texts have no tokens and decode to empty text; repeated rows are repeated; other columns
are ignored. The strings of the tokenizer's special tokens in a text are those tokens, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import normalizers

from .shared import table

FAR = np.iinfo(np.int64).max
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Code points that newer Unicode tables call letters or numbers and the tokenizers library does not, and
# capitals whose small letters only its newer case table knows (first, last, distance).
NOT_WORDS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    r"\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    r"\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    r"\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    r"\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f")
NEW_CASES = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
             (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
LOWERED = {c: c + by for first, last, by in NEW_CASES for c in range(first, last + 1)}
# The file's split pattern with its \s written out, for Python's \s has four more characters; the plain one serves texts
# without code points from U+0500 on other than common punctuation.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^{2}{0}{1}]+"
WORDS = _SPLIT.format(r"\p{L}", r"\p{N}", SPACE)
RARE = "[\u0500-\u1fff\u2070-\u209f\u2c00-\U0010ffff]"
RARE_WORDS = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{NOT_WORDS}]]+|[\p{{N}}--[{NOT_WORDS}]]|(?:[^{SPACE}\p{{L}}\p{{N}}]|[{NOT_WORDS}])+"
END = "\ue000"  # stands for the word-end suffix; byte symbols never use it
MEMO_MOST = 300_000


def byte_symbols() -> list[str]:
    """A printable character for each byte: printable Latin-1 bytes are themselves, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


class WordBPE:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        assert model["type"] == "BPE" and suffix and spec["decoder"] is None
        self.text = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words, self.rare, self.rare_words = regex.compile(WORDS), regex.compile(RARE), regex.compile(RARE_WORDS)
        self.nfc = normalizers.NFC().normalize_str  # orders rare marks by the library's Unicode tables, not by Python's
        self.bytes = {i: s for i, s in enumerate(byte_symbols())}
        ends = lambda t: t[:-len(suffix)] + END if t.endswith(suffix) and t != suffix else t
        vocab = model["vocab"]
        self.ids = {s: vocab[s] for s in self.bytes.values()} | {s + END: vocab[s + suffix] for s in self.bytes.values()}
        n = max(vocab.values()) + 1
        self.n, self.left, self.right, self.rank = n, np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault((x, y), (rank, z))
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, rank
                self.ids[ends(a + b)] = z
        codes = np.array([x * n + y for x, y in self.merges], np.int64)
        order = codes.argsort()
        self.codes, self.code_ranks = codes[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        # only tokens that merge to themselves may be proposed
        self.ids = {s: i for s, i in self.ids.items() if self.rank[i] < 0 or self.merged(self.symbols(s)) == [i]}
        # how long tokens with the same first three characters get, so that a proposal tries few lengths
        self.reach: dict[str, int] = {}
        for t in self.ids:
            self.reach[t[:3]] = max(self.reach.get(t[:3], 0), len(t))
        self.rights, self.lefts = self.spine(self.right), self.spine(self.left)
        self.good, self.memo = {}, {}

    def symbols(self, word: str) -> list[int]:
        """Ids of the base symbols of a mapped word that ends with END (or of a token's inner part that does not)."""
        parts = list(word)
        if word.endswith(END):
            parts = [*parts[:-2], parts[-2] + END]
        return [self.ids[p] for p in parts]

    def spine(self, child: np.ndarray) -> np.ndarray:
        """Row by token: from its outermost base symbol up to the token itself, then -1."""
        chains = []
        for t in range(self.n):
            chain = [t]
            while child[chain[-1]] >= 0:
                chain.append(child[chain[-1]])
            chains.append(chain[::-1])
        out = np.full((self.n, max(map(len, chains)) + 1), -1, np.int32)
        for t, chain in enumerate(chains):
            out[t, :len(chain)] = chain
        return out

    def merged(self, ids: list[int]) -> list[int]:
        """Exact merging: lowest rank first, leftmost of equals. Short words go through a list, long ones a heap."""
        return self._merged_heap(ids) if len(ids) > 200 else self._merged_list(ids)

    def _merged_list(self, ids: list[int]) -> list[int]:
        ids, get, none = [*ids], self.merges.get, (FAR, -1)
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i:i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _merged_heap(self, ids: list[int]) -> list[int]:
        nxt, prev = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        ids, alive = [*ids], [True] * len(ids)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], alive[j], nxt[i] = z, False, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
                if m := self.merges.get((z, ids[nxt[j]])):
                    heapq.heappush(heap, (m[0], i, z, ids[nxt[j]], m[1]))
            if prev[i] >= 0 and (m := self.merges.get((ids[prev[i]], z))):
                heapq.heappush(heap, (m[0], prev[i], ids[prev[i]], z, m[1]))
        return [t for t, a in zip(ids, alive) if a]

    def proposed(self, word: str) -> list[int]:
        """Longest tokens from the left; the end mark never stands alone."""
        out, at, n, get, reach = [], 0, len(word), self.ids.get, self.reach.get
        while at < n:
            end = min(n, at + reach(word[at:at + 3], 2))
            while (t := get(word[at:end])) is None or end == n - 1:
                end -= 1
            out.append(t)
            at = end
        return out

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether both stay whole when their symbols are merged side by side."""
        i, j, ok = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.ones(len(x), bool)
        while True:
            r, up_r, l, up_l = self.rights[x, i], self.rights[x, i + 1], self.lefts[y, j], self.lefts[y, j + 1]
            code = r.astype(np.int64) * self.n + l
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            across = np.where(self.codes[at] == code, self.code_ranks[at], FAR)
            next_r, next_l = np.where(up_r >= 0, self.rank[up_r], FAR), np.where(up_l >= 0, self.rank[up_l], FAR)
            ok &= (across == FAR) | (across >= next_r) | (across > next_l)
            over = (next_r == FAR) & (next_l == FAR)
            if over.all():
                return ok
            right_first = next_r <= next_l
            i, j = i + (~over & right_first), j + (~over & ~right_first)

    def learn(self, words: list[str]) -> None:
        """Put new words into the memo: ids, the ids as text, the tokens as text."""
        plain = lambda w: w if w.isascii() and w.isprintable() else "".join(map(self.bytes.__getitem__, w.encode("utf-8", "surrogatepass")))
        mapped = [plain(w) + END for w in words]
        cuts = [self.proposed(w) for w in mapped]
        if len(self.good) > MEMO_MOST:
            self.good.clear()
        borders = [[*zip(c, c[1:])] for c in cuts]
        pairs = np.array([*set().union(*borders).difference(self.good)], np.int64).reshape(-1, 2)
        if len(pairs):
            self.good.update(zip(map(tuple, pairs.tolist()), self.compatible(pairs[:, 0], pairs[:, 1]).tolist()))
        for word, m, cut, border in zip(words, mapped, cuts, borders):
            if not all(map(self.good.__getitem__, border)):
                cut = self.merged(self.symbols(m))
            self.memo[word] = (cut, " ".join(map(str, cut)), " ".join(map(self.text.__getitem__, cut)))

    def pieces(self, text: str | None) -> list[list[str] | int]:
        """Lists of words, and ids of special tokens between them."""
        out: list = []
        for part in self.split.split(text or ""):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = self.nfc(part) if self.rare.search(part) else unicodedata.normalize("NFC", part)
                part = part.replace("Σ", "σ").lower()
                out.append(self.rare_words.findall(part.translate(LOWERED)) if self.rare.search(part) else self.words.findall(part))
        return out

    def results(self, texts: list[str | None]) -> Iterator[list[tuple[list[int], str, str]]]:
        """For each text the memo's entries of its words and special tokens, in order."""
        for at in range(0, len(texts), 256):
            cut = [self.pieces(t) for t in texts[at:at + 256]]
            words = set().union(*(p for pieces in cut for p in pieces if isinstance(p, list)))
            new = words.difference(self.memo)
            if len(self.memo) + len(new) > MEMO_MOST:
                self.memo.clear()
                new = words
            self.learn(list(new))
            for pieces in cut:
                out = []
                for p in pieces:
                    out += map(self.memo.__getitem__, p) if isinstance(p, list) else [([p], str(p), self.text[p])]
                yield out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.text[i] for i in ids if i in self.text)


_LOADED: dict[str, WordBPE] = {}


def tokenizer(path: str) -> WordBPE:
    """One per Python worker and path."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int> for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids = [[i for entry in r for i in entry[0]] for r in bpe.results(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, text for every row of (id, ids): tokens joined by spaces, as the tokenizer has no decoder; null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and of decoded text, without moving the ids themselves. What is decoded is
    looked up by token, as in decode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        sha = lambda entries, k: hashlib.sha256(" ".join([e[k] for e in entries]).encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = [(sum(len(e[0]) for e in r), sha(r, 1), sha(r, 2)) for r in bpe.results(batch["text"].to_pylist())]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
