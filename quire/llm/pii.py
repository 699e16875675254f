"""Personal data by weak supervision.

Strict patterns give the base spans, which are always reported. Looser candidate patterns reach
further, and labelers vote on every candidate (base spans included): whether a strict pattern
holds, whether a cue word of a gazetteer stands before it, whether its context looks like one of
a contact line rather than a figure, and whether its digits are laid out as such numbers are. A
vote is yes, no or abstain. Votes are counted by pattern over all documents; expectation-
maximisation (Dawid and Skene) estimates each labeler's reliability and every pattern's
posterior; a logistic span classifier is then trained on the posteriors from surface features,
and decides about the candidates that aren't base spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import map_batches

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds; they sort after the base kinds.
MORE = ("email_spelled", "phone_local", "national_id", "iban")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = {
    "email_spelled": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]+)+", re.I),
    "phone_local": re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])", re.A),
    "national_id": re.compile(r"(?<![\w+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.A),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A),
}
#: Cue words, fixed values.
CUES = frozenset("phone tel telephone telefon teléfono téléphone mobile cell fax call email e-mail mail courriel correo contact kontakt ssn social security iban account konto compte cuenta card carte karte tarjeta ip address adresse".split())
FIGURES = frozenset("page pages seite no nr version v figure fig section chapter order item invoice total price sku isbn".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strict patterns, leftmost without overlaps in each kind, failing matches dropped."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:  # around each @, so that no run of characters is walked twice
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):  # four numbers after four numbers
            own = parts[i : i + 4]
            end = start + sum(map(len, own)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in own):
                out.append((start, end, "ip"))
            start = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """Of the four labelers: 1 for personal, 0 for not, -1 for no opinion."""
    span = text[start:end]
    before = [w.strip(".,:;()").lower() for w in text[max(0, start - 60) : start].split()[-4:]]
    after = text[end : end + 1]
    digits = re.sub(r"[^0-9]", "", span)
    if kind in KINDS:
        strict = 1
    elif kind == "iban":
        strict = int(iban_valid(span))
    elif kind == "national_id":
        strict = int(span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000")
    else:
        strict = -1
    gazetteer = 1 if any(w in CUES for w in before) else -1
    context = 0 if before and before[-1] in FIGURES or after in "%€$" and after else 1 if before and before[-1].endswith(":") else -1
    layout = 1 if "@" in span or kind == "email_spelled" else 0 if digits and len(set(digits)) <= 2 else 1 if re.search(r"[ ().-]", span) else -1
    return strict, gazetteer, context, layout


def features(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """Small counts only, so that spans with equal features can be counted together."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    before = text[max(0, start - 60) : start].lower().split()[-4:]
    return (
        (*KINDS, *MORE).index(kind),
        min(digits, 20) // 3,
        min(len(span), 40) // 5,
        int(any(w.strip(".,:;()") in CUES for w in before)),
        int(bool(before) and before[-1].strip(".,:;()") in FIGURES),
        int(text[end : end + 1] in ("%", "€", "$")),
        min(len({c for c in span if c.isdigit()}), 6) // 2,
    )


class Taken:
    """Places of a text that spans hold, as separate intervals in order."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def take(self, start: int, end: int) -> bool:
        """Whether nothing of start to end was taken; if so, it is now."""
        at = bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def candidates(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and candidates of other kinds that overlap none of them."""
    base = base_spans(text)
    loose: list[tuple[int, int, str]] = []
    if re.search("[0-9]", text) or "at" in text and re.search(r"[\[(]at[\])]", text, re.I):
        taken = Taken(base)
        for kind, pattern in LOOSE.items():
            loose += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if taken.take(m.start(), m.end())]
    return base, loose


@dataclass
class SpanModel:
    """weights of the one-hot features (intercept first); reliabilities by labeler for the reader."""

    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    intercept: float = 0.0
    reliability: list[tuple[float, float]] = field(default_factory=list)

    def probability(self, x: tuple[int, ...]) -> float:
        z = self.intercept + sum(self.weights.get((i, v), 0.0) for i, v in enumerate(x))
        return float(1 / (1 + np.exp(-z)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern and, by class, the chance of each vote (no, yes) of each labeler.

    It starts from the majority of votes. An abstention says nothing, and the classes are taken
    to be equally common, since strict spans, nearly all personal, outnumber what is in doubt;
    pseudo counts that favour better-than-chance labelers keep the classes from changing places.
    """
    yes, no = (patterns == 1).sum(1), (patterns == 0).sum(1)
    post = (yes + 0.5) / (yes + no + 1)
    table = np.zeros((2, patterns.shape[1], 2))
    voted = patterns >= 0
    column = np.where(voted, patterns, 0)
    for _ in range(rounds):
        for y, p in ((1, post), (0, 1 - post)):
            for j in range(patterns.shape[1]):
                table[y, j] = np.bincount(column[:, j], p * counts * voted[:, j], 2) + np.array([1 + 4 * (y == 0), 1 + 4 * (y == 1)])
                table[y, j] /= table[y, j].sum()
        log = np.array([sum(np.log(table[y, j][column[:, j]]) * voted[:, j] for j in range(patterns.shape[1])) for y in (0, 1)])
        fresh = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(fresh - post).max() < 1e-9:
            break
        post = fresh
    return post, table


def fit(tallies: list[tuple[tuple[int, ...], tuple[int, ...], int]], rounds: int = 300) -> SpanModel:
    """From (votes, features, count) of all spans; the number of tallies is bounded by their small ranges."""
    if not tallies:
        return SpanModel()
    by: dict[tuple[int, ...], int] = {}
    for v, _, n in tallies:
        by[v] = by.get(v, 0) + n
    patterns = np.array(sorted(by))
    post, table = expectation_maximisation(patterns, np.array([by[tuple(p)] for p in patterns.tolist()], float))
    posterior = dict(zip(map(tuple, patterns.tolist()), post, strict=True))
    columns: dict[tuple[int, int], int] = {}
    for _, x, _ in sorted(tallies):
        for c in enumerate(x):
            columns.setdefault(c, len(columns))
    # one column of numbers for each feature in place of a matrix of ones and zeros
    a = np.array([[columns[c] for c in enumerate(x)] for _, x, _ in tallies])
    y = np.array([posterior[v] for v, _, _ in tallies])
    n = np.log1p(np.array([c for *_, c in tallies], float))
    w, b = np.zeros(len(columns)), 0.0
    for _ in range(rounds):
        g = n * (y - 1 / (1 + np.exp(-(w[a].sum(1) + b))))
        w += 0.5 * (np.bincount(a.ravel(), np.repeat(g, a.shape[1]), len(columns)) / n.sum() - 1e-3 * w)
        b += 0.5 * g.sum() / n.sum()
    return SpanModel({c: float(w[i]) for c, i in columns.items()}, float(b), [(float(table[1, j, 1]), float(table[0, j, 0])) for j in range(patterns.shape[1])])


def train(docs: DataFrame) -> SpanModel:
    """Count votes and features over all documents and fit.

    However many documents there are, a tally's key has at most 54 patterns of votes times 16,128 of
    features, and in practice a few hundred, so the counts fit the driver.
    """

    def rows(columns: list[list]) -> list[list]:
        found: dict[tuple, int] = {}
        for text in columns[0]:
            for spans in candidates(text or ""):
                for s in spans:
                    key = (votes(text, *s), features(text, *s))
                    found[key] = found.get(key, 0) + 1
        return [[list(k[0]) for k in found], [list(k[1]) for k in found], list(found.values())]

    counted = map_batches(docs.select("text"), rows, "votes array<int>, features array<int>, n long")
    tallies = counted.groupBy("votes", "features").agg(F.sum("n").alias("n")).collect()
    return fit(sorted((tuple(r.votes), tuple(r.features), r.n) for r in tallies))


def find(text: str, model: SpanModel, threshold: float = 0.5) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, each sorted by start and then kind."""
    base, loose = candidates(text)
    rank = {k: i for i, k in enumerate((*KINDS, *MORE))}
    order = lambda s: (s[0], rank[s[2]], s[1])
    added = [s for s in loose if model.probability(features(text, *s)) >= threshold]
    return sorted(base, key=order), sorted(base + added, key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """A row per document with counts of base spans, their digest, and all spans.

    Null texts count as empty; offsets are code points of the whole text, however long; repeated rows give a row
    each; other columns are ignored; without any candidate in the table the classifier says nothing and only base spans count.
    """
    model = model or train(docs)

    def rows(columns: list[list]) -> list[list]:
        out: list[list] = [[] for _ in range(7)]
        for doc_id, text in zip(*columns, strict=True):
            base, spans = find(text or "", model)
            n = [sum(s[2] == k for s in base) for k in KINDS]
            for column, value in zip(out, (doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)), strict=True):
                column.append(value)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """docs with every span replaced by its kind in brackets and n_chars counted anew; no row is dropped.

    Where spans overlap, the one that starts first is named and the rest of the overlap goes with it.
    """
    model = model or train(docs)
    names = docs.columns

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for start, end, kind in find(text, model)[1]:
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [clean(t) for t in batch.column(names.index("text")).to_pylist()]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, batch.column(names.index("text")).type)
            if "n_chars" in names:
                own = batch.column(names.index("n_chars"))
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], own.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
