"""Personal data by weak supervision.

Base spans come from exact patterns. Looser patterns, and the parts of exact matches that fail their test, propose further
candidates. Seven labelers (exact pattern, validity, gazetteer, context for, context against, neighbours, shape) vote
private, not private or abstain on every candidate. Expectation maximisation over the counts of all documents estimates
each labeler's reliability and the share of private spans: base spans are known to be private and failed exact matches not
to be, all others are hidden. A logistic classifier is trained on the resulting posteriors. Its inputs are the votes and
features of the span itself that no labeler sees (length, share of digits, separators, what stands on either side), and it
alone decides which candidates beyond the base are spans. Counts are by kind, votes and features, each of few values: at
most kinds * 3 ** 7 * 54 rows however many documents there are. They are counted in every task before they are shuffled;
only these counts reach the driver.

Limits of the loose patterns are those of mail addresses (64 characters before the sign, 63 in a name); runs of digits of
under 12 characters are no card candidates.

Defined results: a null text counts as empty and has no spans; very long runs and many spans cost time in proportion;
repeated rows are treated alike; a corpus without candidates adds no spans; other columns pass through. Offsets are code
points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from ipaddress import IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOOSE = {
    "email": re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z]{2,24}(?!\w)", re.I),
    "ip": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "card": re.compile(r"(?<![\w.])[0-9]{4}(?:[./_][0-9]{4}){3}(?![\w.])"),
    "phone": re.compile(r"(?<![\w+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"),
}
PART = re.compile(r"[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3}")  # of failed card matches
# What a text must hold for a loose pattern to be tried: each is found in one quick pass.
DIGIT = re.compile("[0-9]")
GROUPED = re.compile(r"[0-9]{3,4}[ ./_-][0-9]{4}")
GUARD = {"email": re.compile(r"[\[({]at[\])}]", re.I), "ip": re.compile(r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"), "card": GROUPED, "phone": GROUPED}
# Fixed values of the gazetteer and context labelers.
TLDS = frozenset("com org net edu gov mil int io co de fr es it uk us ca au jp cn in br mx ar cl nl ch at be pl se no dk fi ie pt gr cz hu ro ru ua tr il za kr tw hk sg nz eu info biz name online site tech app dev".split())
ISSUERS = {15: ("34", "37"), 16: ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "6011", "65", "35", "62"), 14: ("36", "38", "30"), 19: ("4", "62")}
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "354", "358", "380", "420", "421", "852", "886", "966", "971", "972")
FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt|schreib)", re.I),
    "ip": re.compile(r"\b(?:ip|ipv[46]|address|host|login|logged|server|from|adresse|dirección)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|pay|paid|karte|carte|tarjeta)", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|cell|ring|dial|whatsapp|telefon|téléphone|teléfono|appel|llam)", re.I),
}
AGAINST = re.compile(r"\b(?:version|build|isbn|issn|order|invoice|sku|part|model|ref|page|section|chapter|serial|hash|token|id|no|nr)\b[\s:#=.\"']*$", re.I)
LABELERS, ABSTAIN = 7, 2
CONTEXT, AFTER, ACCEPT = 40, 20, 0.9
FEATURES = (3, 3, 3, 2)  # values of length, share of digits, separators, sides


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Leftmost matches of the email pattern, found from their @: the run before it is walked once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), True
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """kind, start, end and whether the match passes its test."""
    if "@" in text:
        for s, e, ok in emails(text):
            yield "email", s, e, ok
    if not DIGIT.search(text):
        return
    for m in NUMBERS.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            yield "ip", at, end, all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four)
            at = end + 1
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        yield "card", m.start(), m.end(), 14 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 10 <= sum(c.isdigit() for c in m[0]) <= 15


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base, in order."""
    return sorted((s, KINDS.index(k), e) for k, s, e, ok in base_matches(text or "") if ok)


def _apart(base: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether a span touches none of base, which is sorted by start."""
    starts, furthest = [s for s, _, _ in base], []
    for _, _, e in base:
        furthest.append(max(e, furthest[-1]) if furthest else e)

    def apart(start: int, end: int) -> bool:
        n = bisect_left(starts, end)
        return n == 0 or furthest[n - 1] <= start

    return apart


def loose_matches(text: str, failed: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    for kind, pattern in LOOSE.items():
        if GUARD[kind].search(text):
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end()
    for kind, s, e in failed:
        if kind == "card" and e - s > 14:
            for m in PART.finditer(text, s, e):
                if (m.start(), m.end()) != (s, e):
                    yield kind, m.start(), m.end()


def _valid(kind: str, found: str, digits: str, strict: bool) -> bool:
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and (strict or (digits[-10] not in "01" and digits[-7] not in "01"))
    if kind == "email":
        return strict or found.count("@") + len(re.findall(r"\Wat\W", found)) == 1
    try:
        return bool(IPv6Address(found)) and not IPv6Address(found).is_unspecified
    except ValueError:
        return False


def _known(kind: str, found: str, digits: str) -> bool | None:
    if kind == "email":
        return re.split(r"\W+", found.lower().strip(")]} "))[-1] in TLDS
    if kind == "ip":
        return found[:1] in "23" or found[:2].lower() in ("fc", "fd", "fe") if ":" in found else digits[:1] != "0"
    if kind == "card":
        return digits.startswith(ISSUERS.get(len(digits), ()))
    return digits.startswith(COUNTRIES) if found.startswith("+") else None


def votes(text: str, kind: str, start: int, end: int, strict: bool, ok: bool) -> str:
    """One character per labeler, 1 private, 0 not, 2 abstains; then one for each feature of the span."""
    found, before, after = text[start:end], text[max(0, start - CONTEXT):start], text[end:end + AFTER]
    digits = re.sub("[^0-9]", "", found)
    known = _known(kind, found, digits)
    left, right = text[start - 1:start], text[end:end + 1]
    even = len(set(digits)) > 3 if kind in ("card", "phone") else True
    share, apart = len(digits) / len(found), len(re.findall(r"[^0-9A-Za-z]", found))
    return "".join((
        "1" if strict and ok else "0" if strict else "2",
        "1" if (ok if strict and kind == "ip" else _valid(kind, found, digits, strict)) else "0",
        "2" if known is None else "1" if known else "0",
        "1" if FOR[kind].search(before) or FOR[kind].search(after) else "2",
        "0" if AGAINST.search(before) else "2",
        "0" if left.isalnum() or right.isalnum() else "2",
        "1" if even else "0",
        str((len(found) > 14) + (len(found) > 20)), str((share > 0.3) + (share > 0.8)), str(min(2, apart // 2)),
        "1" if (not left or left.isspace() or left in "(<\"'[") and (not right or right.isspace() or right in ".,;:!?)>\"']") else "0",
    ))


def candidates(text: str | None) -> Iterator[tuple[str, int, int, str, bool]]:
    """kind, start, end, votes, whether it is a base span. Those that are not touch none, unless they failed as exact matches."""
    text = text or ""
    found = [*base_matches(text)]
    apart = _apart(sorted((s, KINDS.index(k), e) for k, s, e, ok in found if ok))
    for k, s, e, ok in found:
        if ok or k != "card" or e - s >= 12:
            yield k, s, e, votes(text, k, s, e, True, ok), ok
    for k, s, e in loose_matches(text, [(k, s, e) for k, s, e, ok in found if not ok]):
        if apart(s, e):
            yield k, s, e, votes(text, k, s, e, False, True), False


def vote_counts(docs: DataFrame) -> DataFrame:
    """kind, votes, n over all documents: at most as many rows as there are kinds, votes and values of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                counts.update((k, v) for k, _, _, v, _ in candidates(text))
        rows = [(k, v, n) for (k, v), n in counts.items()]
        kind, vote, n = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(vote, pa.string()), pa.array(n, pa.int64())], names=["kind", "votes", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "kind string, votes string, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))


def reliabilities(patterns: np.ndarray, counts: np.ndarray, fixed: np.ndarray | None = None, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Two-class EM. patterns: rows of votes; fixed: 1 or 0 for patterns of known class, else nan. Returns the posterior of
    each pattern, P(vote | class) and the prior."""
    one_hot = np.eye(3)[patterns]
    known = np.full(len(patterns), np.nan) if fixed is None else fixed
    anchored = lambda p: np.where(np.isnan(known), p, known)
    # start from the majority of those that vote
    post = anchored(np.clip(((patterns == 1).sum(1) + 0.5) / ((patterns != ABSTAIN).sum(1) + 1.0), 0.05, 0.95))
    for _ in range(rounds):
        w = np.stack([(1 - post) * counts, post * counts])
        likely = np.einsum("cp,plv->clv", w, one_hot) + 0.1
        likely /= likely.sum(axis=2, keepdims=True)
        prior = (w[1].sum() + 1) / (counts.sum() + 2)
        log = np.einsum("plv,clv->pc", one_hot, np.log(likely)) + np.log([1 - prior, prior])
        new = anchored(1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50))))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, likely, float(prior)


def _design(rows: np.ndarray) -> np.ndarray:
    """Votes other than the exact pattern's, which is the anchor; and the features, one column for each value."""
    patterns = rows[:, 1:LABELERS]
    features = [np.eye(n)[rows[:, LABELERS + i]] for i, n in enumerate(FEATURES)]
    return np.concatenate([np.ones((len(rows), 1)), (patterns == 1).astype(float), (patterns == 0).astype(float), *features], axis=1)


def _digits(vote: str) -> list[int]:
    return [int(c) for c in vote]


def fit(rows: list[tuple[str, str, int]], rounds: int = 50) -> dict:
    """Per kind: a ridge logistic classifier on votes and features, trained on the posteriors; and the reliabilities."""
    model: dict = {"weights": {}, "reliability": {}}
    for kind in KINDS:
        own = sorted((v, n) for k, v, n in rows if k == kind)
        if not own:
            continue
        patterns, counts = np.array([_digits(v) for v, _ in own]), np.array([n for _, n in own], float)
        exact = patterns[:, 0]
        known = np.where(exact == ABSTAIN, np.nan, exact)
        # the anchor is no evidence on hidden candidates, which all lack it
        post, likely, prior = reliabilities(patterns[:, 1:LABELERS], counts, known)
        x = _design(patterns)
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (counts * (post - p)) / counts.sum() - 1e-3 * w
            hess = (x * (counts * np.clip(p * (1 - p), 1e-6, None))[:, None]).T @ x / counts.sum() + 1e-3 * np.eye(x.shape[1])
            w = w + np.clip(np.linalg.solve(hess, grad), -4, 4)
        model["weights"][kind] = w
        model["reliability"][kind] = {"prior": prior, "votes": likely}
    return model


def train(docs: DataFrame) -> dict:
    """The model of all documents; a few hundred counts at most reach the driver."""
    return fit([(r["kind"], r["votes"], r["n"]) for r in vote_counts(docs).collect()])


def probability(kind: str, vote: str, model: dict) -> float:
    """That a candidate is private, by the classifier. Patterns are few, so that each is computed once for a model."""
    memo = model.setdefault("memo", {})
    if (kind, vote) not in memo:
        w = model["weights"].get(kind)
        memo[kind, vote] = 0.0 if w is None else 1 / (1 + np.exp(-np.clip((_design(np.array([_digits(vote)])) @ w)[0], -500, 500)))
    return memo[kind, vote]


def find(text: str | None, model: dict) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind index, end) in order. Added spans touch no base span; failed exact matches
    are dropped and add nothing as they are."""
    base, added = [], []
    for kind, s, e, vote, is_base in candidates(text):
        if is_base:
            base.append((s, KINDS.index(kind), e))
        elif vote[0] == "2" and probability(kind, vote, model) >= ACCEPT:
            added.append((s, KINDS.index(kind), e))
    base.sort()
    return base, sorted({*base, *added})


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def with_spans(docs: DataFrame, model: dict) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                base, spans = find(text, model)
                n = Counter(k for _, k, _ in base)
                rows.append([n[0], n[1], n[2], n[3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)])
            cols = [*zip(*rows)] if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                                             names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted_text(text: str | None, model: dict) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become the first one's."""
    if not text:
        return text
    out, at = [], 0
    for s, k, e in find(text, model)[1]:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with its text redacted, all columns kept."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    inner = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [*batch.columns]
            cols[at] = pa.array([redacted_text(t, model) for t in cols[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return inner.mapInArrow(run, inner.schema).toDF(*docs.columns)


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_spans(docs, train(docs))
