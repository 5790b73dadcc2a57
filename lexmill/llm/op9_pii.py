"""Operator 9: personal data by weak supervision.

Fixed patterns give the base spans (email, ip, card, phone), which always stay. Further spans, credentials and other
identifying strings, come from weak supervision: candidate strings get votes from regex, gazetteer and context
labelers; expectation-maximisation over the counts of vote patterns of the whole corpus estimates how reliable each
labeler is; the posteriors train a span classifier over shape features, which decides in a second pass.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, table

#: Kinds in the order in which spans are listed; the last is what the method adds.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Posterior from which the classifier adds a span.
THRESHOLD = 0.9

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")  # from the first digit of a run only, so each run is read once
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Words that name a credential, and beginnings of well-known credential formats.
NAMES = frozenset("password passwd pwd pass secret token apikey api_key api-key access_key secret_key auth key bearer".split())
STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ", "AIza", "glpat-")

_VALUE = re.compile(r"[A-Za-z0-9_+/=.~-]+")
_ASSIGN = re.compile(r"[=:]\s?[\"']?(?=[A-Za-z0-9_+/~-]{6})")
_NAME_BEFORE = re.compile(r"([A-Za-z_-]+)[\"']?\s?$")
_DIGITS = re.compile(r"[0-9]+")
_RUN = re.compile(r"[A-Za-z0-9_+/=~-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses: each needs an @, so the search goes from @ to @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, by kind, then start; code points, end exclusive."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Strings that may be credentials: runs with a digit of 12 characters or more, and assigned values; none touches a base span.

    Each character is read a fixed number of times, so a text's time grows with its length, whatever is in it.
    """
    found = set()
    for m in _RUN.finditer(text):
        run = m.group()
        if len(run) < 12 or not _DIGITS.search(run):
            continue
        a, b = m.end() - len(run.lstrip("=+/-")), m.end()
        if b - a >= 12:
            cut = text.rfind("=", a, b - 2)  # name=value: the value is the candidate
            found.add((max(a, cut + 1), b))
    stop = end = 0  # of the run of value characters read last: its end, and that without dots
    for m in _ASSIGN.finditer(text):
        if m.end() >= stop and (v := _VALUE.match(text, m.end())):
            stop = v.end()
            end = v.start() + len(v.group().rstrip("."))
        if end - m.end() >= 6:
            found.add((m.end(), end))
    busy: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in taken):
        if busy and s < busy[-1][1]:
            busy[-1][1] = max(busy[-1][1], e)
        else:
            busy.append([s, e])
    out, i = [], 0
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            continue
        while i < len(busy) and busy[i][1] <= a:
            i += 1
        if i == len(busy) or busy[i][0] >= b:
            out.append((a, b))
    return out


def votes(text: str, a: int, b: int) -> tuple[int, ...]:
    """Each labeler's vote on a candidate: 1 for, 0 none, -1 against."""
    value = text[a:b]
    before = text[max(0, a - 24) : a]
    assigned = bool(re.search(r"[=:]\s?[\"']?$", before))
    name = _NAME_BEFORE.search(re.sub(r"[=:]\s?[\"']?$", "", before)) if assigned else None
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    return (
        1 if value.startswith(STARTS) else 0,  # gazetteer of formats
        1 if name and name.group(1).lower().lstrip("-_") in NAMES else (-1 if assigned and not digits else 0),  # gazetteer of names
        1 if assigned else 0,  # context
        1 if re.fullmatch(r"[0-9a-f]{16,}|[A-Z0-9]{16,}|[A-Za-z0-9_+/~=-]{24,}", value) and digits and letters else 0,  # regex of shape
        -1 if not digits or not letters else (1 if len(value) >= 16 and min(digits, letters) >= 4 else 0),  # mixture of characters
        -1 if value.count("-") + value.count("/") >= 3 or len(set(value)) * 4 <= len(value) else 0,  # paths, dates, rulers, repeats
    )


def features(text: str, a: int, b: int) -> tuple[int, ...]:
    """The classifier's shape features, each with a few values, so all patterns together are bounded."""
    value = text[a:b]
    n = len(value)
    digits = sum(c.isdigit() for c in value)
    before = text[max(0, a - 2) : a]
    return (
        min(3, n // 8),
        min(3, 4 * digits // n),
        2 * any(c.isupper() for c in value) + any(c.islower() for c in value),
        min(2, 3 * len(set(value)) // min(n, 16)),
        1 if any(c in "=:" for c in before) else 0,
        1 if value.startswith(STARTS) else 0,
    )


def _onehot(patterns: list[tuple[int, ...]]) -> np.ndarray:
    sizes = (4, 4, 4, 3, 2, 2)
    x = np.zeros((len(patterns), 1 + sum(sizes)))
    x[:, 0] = 1
    at = 1
    for j, size in enumerate(sizes):
        x[np.arange(len(patterns)), at + np.array([p[j] for p in patterns], int)] = 1
        at += size
    return x


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for labelers that are independent given the truth: the share of true spans, each labeler's accuracy where it votes, and each pattern's posterior.

    Whether a labeler votes tells nothing, only what it says; labelers are taken to be better than chance (a prior
    of four right votes to one wrong, within 0.55 and 0.99), and the share is at most a half, so a candidate that
    nothing speaks for is never added.
    """
    share, right = 0.5, np.full(patterns.shape[1], 0.8)
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + patterns @ np.log(right / (1 - right))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        agree = np.where(patterns > 0, post[:, None], 1 - post[:, None]) * (patterns != 0) * counts[:, None]
        cast = ((patterns != 0) * counts[:, None]).sum(axis=0)
        new = np.clip((agree.sum(axis=0) + 4) / (cast + 5), 0.55, 0.99)
        share = float(np.clip((post * counts).sum() / counts.sum(), 0.02, 0.5))
        if np.abs(new - right).max() < 1e-9:
            break
        right = new
    return share, right, post


class SpanClassifier:
    """Logistic regression on the shape features, trained on the posteriors of the labelers."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.known: dict[tuple[int, ...], float] = {}

    def probability(self, pattern: tuple[int, ...]) -> float:
        p = self.known.get(pattern)
        if p is None:
            p = self.known[pattern] = float(1 / (1 + np.exp(-(_onehot([pattern]) @ self.weights)[0])))
        return p


def fit(docs: DataFrame, rounds: int = 200) -> SpanClassifier | None:
    """The classifier from all texts of docs(text); None if there are no candidates. Only counts of (votes, features) patterns reach the driver: at most 3^6 * 768 of them, whatever the input."""

    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    for a, e in candidates(text, base_spans(text)):
                        held[(*votes(text, a, e), *features(text, a, e))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, k)) for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["pattern", "n"])

    rows = docs.select("text").mapInArrow(lean(count), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not rows:
        return None
    all_ = np.array([list(map(int, r.pattern.split(","))) for r in rows])
    n = np.array([r.n for r in rows], float)
    _, _, post = reliabilities(all_[:, :6], n)
    x = _onehot([tuple(p) for p in all_[:, 6:].tolist()])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # damped Newton steps of the weighted logistic loss
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - post)) + 0.1 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return SpanClassifier(w)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, model: SpanClassifier | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, n_secret, base (base spans) and spans (all), each "kind:start:end" joined by commas.

    Offsets are code points, end exclusive. Null and empty texts have no spans. Texts are searched whole, repeated
    rows each; an empty table gives no rows; extra columns are ignored. Without a model only base spans are found.
    The time of a text grows with its length, also where it is one token of a million characters.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            counts, base, spans = [[] for _ in KINDS], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                fixed = base_spans(text)
                more = [(4, a, e) for a, e in candidates(text, fixed) if m.probability(features(text, a, e)) >= threshold] if m else []
                for k, c in enumerate(counts):
                    c.append(sum(s[0] == k for s in fixed) + (len(more) if k == 4 else 0))
                base.append(_listed(fixed))
                spans.append(_listed(fixed + more))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(spans, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")


def op9_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, fit(docs))
    n = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.col("n_secret")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_secret", n.alias("n_found"), F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op9_pii": op9_pii}
SQL: dict[str, str] = {}
