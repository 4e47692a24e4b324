"""Personal data by weak supervision.

Candidate spans of four kinds are found in whole texts: the base patterns, matches of theirs that narrowly fail a test (a card with a wrong check
digit, an address with one part too large), and looser ones (spelled-out addresses, phone numbers without a plus, long IP addresses, cards in dotted groups). Five labelers vote yes, no or nothing on every candidate: the
strict pattern, a checksum or range test, a gazetteer (top-level domains, calling codes, issuer prefixes), the words around it
and the characters next to it. Expectation-maximisation over the counted vote patterns estimates each labeler's reliability
per kind, without labels; the posteriors then train a logistic span classifier over votes and shape. Base spans always stay;
the classifier decides on the others, and takes none that fewer than two independent labelers say yes to or that a context word speaks against.

Spark counts the patterns over all documents. There are at most kinds x 3**labelers x shapes of them (7,776), so the
counts that the driver fits on, and the accepted patterns that go back to the tasks, are bounded whatever the input. Texts are read
once; the candidates of a document stay in its row, so nothing but pattern counts is shuffled.

A null text is an empty one and has no spans. Repeated rows and shared ids are rows of their own; a null doc_id stays null. An empty
table gives an empty result; other columns are ignored. Texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import documents, stored

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "context", "border")
SHAPES = 8

# fixed values: gazetteers and context words
DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es it uk us eu ch at nl be pl ca au jp cn in br mx example".split())
CALLING_CODES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51",
    "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92",
    "93", "94", "95", "98", "351", "352", "353", "354", "358", "359", "370", "371", "372", "380", "385", "386", "420", "421",
)
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "60", "62", "64", "65", "30", "36", "38", "35", "50", "56", "57", "58", "63", "67")
CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel", "@"),
    "ip": ("ip", "host", "server", "address", "adresse", "login", "client"),
    "card": ("card", "visa", "master", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "anruf", "appel"),
}
AGAINST = ("version", "isbn", "order", "invoice", "figure", "table", "section", "chapter", "release", "build", "serial", "page")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?")
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]+)+")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])")
_LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_DOTTED_CARD = re.compile(r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @ and domain, from each @: its local part is the run of such characters before it."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def _spelled(text: str) -> list[Span]:
    """Addresses with (at), [at] or at for the @, from each such mark."""
    out: list[Span] = []
    free = 0
    for mark in _AT.finditer(text):
        start = mark.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _SPELLED_DOMAIN.match(text, mark.end()) if start < mark.start() else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
    return out


def _dotted(text: str) -> Iterator[tuple[Span, list[str]]]:
    """Four numbers joined by single dots, leftmost first: a longer row of numbers is cut after every fourth."""
    for row in _DOTTED.finditer(text):
        numbers = row[0].split(".")
        at = row.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            size = sum(map(len, four)) + 3
            yield (at, at + size), four
            at += size + 1


def _byte(number: str) -> bool:
    digits = number.lstrip("0") or "0"
    return len(digits) <= 3 and int(digits) <= 255


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the strict patterns that pass their tests, per kind."""
    return _strict(text)[0]


def _strict(text: str) -> tuple[dict[str, list[Span]], list[tuple[str, int, int]]]:
    """The base spans per kind, and the matches that narrowly fail a test: an address with one wrong part, a card whose check digit is wrong."""
    found: dict[str, list[Span]] = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    failed = []
    for span, numbers in _dotted(text):
        right = sum(map(_byte, numbers))
        if right == 4:
            found["ip"].append(span)
        elif right == 3 and all(len(n) <= 3 for n in numbers):
            failed.append(("ip", *span))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19:
            if luhn(digits):
                found["card"].append(m.span())
            else:
                failed.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found["phone"].append(m.span())
    return found, failed


def further_spans(text: str, taken: dict[str, list[Span]], failed: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Looser candidates, and matches that narrowly failed, that touch no base span and not each other, first come first."""
    rough = list(failed or [])
    if any(x in text for x in ("(at)", "[at]", " at ")):
        rough += [("email", *span) for span in _spelled(text)]
    if text.count(":") >= 7:
        rough += [("ip", *m.span()) for m in _LONG_IP.finditer(text)]
    rough += [("card", *m.span()) for m in _DOTTED_CARD.finditer(text)]
    for m in _LOCAL_PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            rough.append(("phone", *m.span()))
    if not rough:
        return []
    held = sorted(s for spans in taken.values() for s in spans)
    out, k, free = [], 0, 0
    for kind, start, end in sorted(rough, key=lambda x: (x[1], KINDS.index(x[0]))):
        while k < len(held) and held[k][1] <= start:
            k += 1
        if start >= free and not (k < len(held) and held[k][0] < end):
            out.append((kind, start, end))
            free = end
    return out


def _votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    before = text[max(0, start - 40) : start].lower()
    around = text[start - 1 : start] + text[end : end + 1]
    if kind == "email":
        last = re.split(r"[^A-Za-z]+", span.rstrip(".-)]"))[-1].lower()
        check = 2 <= len(last) <= 24
        known = last in DOMAINS or any(p in DOMAINS for p in span.lower().split(".")[1:])
    elif kind == "ip":
        numbers = span.split(".")
        first = int(numbers[0].lstrip("0")[-4:] or "0") if len(numbers) == 4 else 1
        check = 0 < first < 240 and (len(numbers) != 4 or all(map(_byte, numbers)))
        known = None if check else False
    elif kind == "card":
        check = luhn(digits) and len(digits) >= 12
        known = digits.startswith(ISSUERS)
    else:
        check = len(digits) >= 10
        known = digits.startswith(CALLING_CODES) if base else None
    near = True if any(w in before for w in CONTEXT[kind]) else False if any(w in before for w in AGAINST) else None
    border = not any(c.isalnum() for c in around)
    votes = (True if base else None, check, known, near, border)
    return "".join("?" if v is None else "+" if v else "-" for v in votes)


def _shape(text: str, start: int, end: int) -> int:
    span = text[start:end]
    return 4 * (end - start > 16) + 2 * any(c in "()[]" for c in span) + (span.count(" ") > 1)


def _found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        spans = []
        for text in rows["text"].fillna("").tolist():
            base, failed = _strict(text)
            all_spans = [(kind, s, e, True) for kind in KINDS for s, e in base[kind]]
            all_spans += [(kind, s, e, False) for kind, s, e in further_spans(text, base, failed)]
            all_spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
            spans.append(
                [
                    {"kind": kind, "start": s, "end": e, "base": b, "votes": _votes(text, kind, s, e, b), "shape": _shape(text, s, e)}
                    for kind, s, e, b in all_spans
                ]
            )
        yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "spans": spans})


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,votes:string,shape:int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidate spans, with votes and shape, of every row of ``docs`` (doc_id, text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInPandas(_found, f"doc_id long, spans {SPANS}")


#: what a labeler's votes (+, -, ?) are taken to be on true and on other spans before any are seen. What is next to a span says little, and words
#: that speak against it nearly never stand before a true one
_EXPECTED = {
    "pattern": ((0.50, 0.10, 0.40), (0.10, 0.50, 0.40)),
    "check": ((0.70, 0.10, 0.20), (0.35, 0.45, 0.20)),
    "gazetteer": ((0.50, 0.10, 0.40), (0.15, 0.45, 0.40)),
    "context": ((0.50, 0.02, 0.48), (0.05, 0.47, 0.48)),
    "border": ((0.80, 0.10, 0.10), (0.70, 0.20, 0.10)),
}


def estimate(patterns: pd.DataFrame, rounds: int = 50, anchor: float = 0.2) -> tuple[np.ndarray, dict]:
    """Expectation-maximisation for one kind: posterior of each vote pattern, and each labeler's reliability.

    ``patterns``: votes, count. A labeler is two distributions over (+, -, ?), for true and for other spans. Each round keeps pseudo-votes of
    what is expected, ``anchor`` of all votes and one more: with few patterns the votes alone cannot tell which of the two
    they are, and would drift to whatever they began with.
    """
    votes = np.array([["+-?".index(v) for v in p] for p in patterns["votes"]])
    count = patterns["count"].to_numpy(float)
    start = np.array([_EXPECTED[name] for name in LABELERS])  # labeler, truth (0: yes), vote
    rates, prior, pseudo = start.copy(), 0.5, 1 + anchor * count.sum()
    for _ in range(rounds):
        logs = np.log(rates)
        yes = np.log(prior) + sum(logs[j, 0, votes[:, j]] for j in range(votes.shape[1]))
        no = np.log1p(-prior) + sum(logs[j, 1, votes[:, j]] for j in range(votes.shape[1]))
        posterior = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        prior = float(np.clip((posterior @ count + pseudo / 2) / (count.sum() + pseudo), 0.01, 0.99))
        for truth, weight in ((0, posterior * count), (1, (1 - posterior) * count)):
            for j in range(votes.shape[1]):
                rates[j, truth] = np.bincount(votes[:, j], weight, 3) + pseudo * start[j, truth]
                rates[j, truth] /= rates[j, truth].sum()
    reliability = {name: float(rates[j, 0, 0] / (rates[j, 0, 0] + rates[j, 1, 0])) for j, name in enumerate(LABELERS)}
    return posterior, reliability


def _features(patterns: pd.DataFrame) -> np.ndarray:
    columns = [np.ones(len(patterns))]
    for kind in KINDS:
        is_kind = (patterns["kind"] == kind).to_numpy(float)
        columns.append(is_kind)
        for j in range(1, len(LABELERS)):  # not the pattern's own vote: the classifier is to judge spans without it
            vote = patterns["votes"].str[j]
            columns.append(is_kind * ((vote == "+").to_numpy(float) - (vote == "-").to_numpy(float)))
    for bit in range(3):
        columns.append((patterns["shape"].to_numpy() >> bit & 1).astype(float))
    return np.stack(columns, axis=1)


def classify(patterns: pd.DataFrame, rounds: int = 25) -> np.ndarray:
    """Probability that the spans of each pattern (kind, votes, shape, count) are personal data."""
    if patterns.empty:
        return np.zeros(0)
    soft = np.zeros(len(patterns))
    for kind in KINDS:
        rows = np.flatnonzero(patterns["kind"] == kind)
        if len(rows):
            soft[rows] = estimate(patterns.iloc[rows])[0]
    x, weight = _features(patterns), np.log1p(patterns["count"].to_numpy(float))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - soft)) + 0.1 * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _supported(votes: str, least: int = 2) -> bool:
    """Whether labelers that judge independently of each other (test, gazetteer, context) say yes often enough, and no word speaks against it."""
    return votes[1:4].count("+") >= least and votes[3] != "-"


def accepted_patterns(found: DataFrame, least: float = 0.5) -> set[tuple[str, str, int]]:
    """The patterns whose spans the trained classifier takes as personal data, if more than one labeler does."""
    spans = found.select(F.explode("spans").alias("s"))
    counted = spans.groupBy("s.kind", "s.votes", "s.shape").count()
    patterns = counted.toPandas().sort_values(["kind", "votes", "shape"]).reset_index(drop=True)
    take = (classify(patterns) >= least) & patterns["votes"].map(_supported).to_numpy(bool)
    return set(patterns[take][["kind", "votes", "shape"]].itertuples(index=False, name=None))


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of personal data: the base ones, and those that the classifier accepts."""
    found = stored(candidates(docs), "pii-candidates")
    accepted = accepted_patterns(found)

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            kept = [[s for s in spans if s["base"] or (s["kind"], s["votes"], s["shape"]) in accepted] for spans in rows["spans"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "spans": kept})

    return found.mapInPandas(decide, found.schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS),
        F.sha2(F.concat_ws(",", F.transform(base, name)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", name)).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
