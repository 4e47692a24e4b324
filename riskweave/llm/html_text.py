"""Main text of html pages by a recurrent block labeller.

A page is read as its sequence of blocks, the text between block-level tags. Each block is a vector: the tags, classes, ids and roles
on its path (hashed, summed with a decay from the root), its words (hashed), and its length, link share and punctuation. A numpy
bidirectional LSTM reads the whole sequence from both ends, so every block is labelled with the context of the page. It is trained
here, on page layouts made by ``layouts`` whose blocks are labelled by construction; weights are some ten thousand numbers.

Pages are independent: one pass of Arrow batches, no shuffle. Blocks that are labelled as main text are kept whole, with character
references decoded and white space inside a block (a line break tag is one) turned into one blank, and joined by two line ends.

A null or empty page has an empty text. Unclosed and stray tags, comments and scripts are taken as browsers take them. Repeated rows are
extracted alike; ids and urls may be null. An empty table gives an empty result; other columns are ignored. Pages of any length are
read whole.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.layouts import Layouts
from riskweave.llm.text import Words

PATH, WORDS, SCALARS, HIDDEN = 192, 16, 6, 16
WIDTH = PATH + WORDS + SCALARS
DECAY = 0.85

#: fixed values: html's block-level tags, void tags, and tags whose content is no text
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html ins label legend li main menu nav ol option p pre section select summary table tbody textarea tfoot thead tr ul".split()
)
SPACES = frozenset("br td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: a start tag of these ends an open one of the same kind
CLOSES_ITSELF = frozenset("p li dt dd tr option h1 h2 h3 h4 h5 h6".split())
SILENT = "script|style|noscript|template|iframe|svg|title|object|canvas|math|audio|video"
#: of these, the ones that '/>' ends at once; elsewhere in html that slash says nothing, nor does one inside an unquoted value
FOREIGN = "svg|math"

_PIECE = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?:{FOREIGN})(?=[\s/>])(?:=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)|"[^"]*"|'[^']*'|[^"'=/>]|/(?!>))*+/>"""
    rf"|<(?P<silent>{SILENT})(?=[\s/>])[^>]*>.*?(?:</(?P=silent)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<more>(?:"[^"]*"|'[^']*'|[^"'>])*+>|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""(?:class|id|role|itemprop|itemtype)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_LETTERS = re.compile(r"[a-z]+")


@functools.lru_cache(maxsize=20_000)
def tag_vector(tag: str, attributes: str) -> np.ndarray:
    """Hashed tag and names of one element."""
    out = np.zeros(PATH, dtype=np.float32)
    names = [tag] + [f"={w}" for m in _NAMED.finditer(attributes) for w in _LETTERS.findall("".join(filter(None, m.groups())).lower())]
    for name in names:
        h = zlib.crc32(name.encode())
        for k in range(3):
            out[(h >> (8 * k)) % PATH] += 1.0 if h >> (24 + k) & 1 else -1.0
    return out


def blocks_of(page: str) -> list[tuple[str, np.ndarray, float]]:
    """Text, path vector and share of linked characters of every block with text."""
    out: list[tuple[str, np.ndarray, float]] = []
    none = np.zeros(PATH, dtype=np.float32)
    stack: list[tuple[str, np.ndarray]] = []
    opened: dict[str, int] = {}  # how often each tag is in the stack: an end tag without a start is skipped at once
    parts: list[str] = []
    path, linked, in_link, at = none, 0, False, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                out.append((text, path, min(1.0, linked / max(1, len(raw)))))
            parts, linked = [], 0

    for piece in _PIECE.finditer(page):
        start = piece.start()
        if start > at:
            text = page[at:start]
            if not parts:
                path = stack[-1][1] if stack else none
            parts.append(text)
            if in_link:
                linked += len(text)
        at = piece.end()
        tag = piece["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SPACES:
            if parts:
                parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if piece["end"]:
                while opened.get(tag):
                    last, _ = stack.pop()
                    opened[last] -= 1
                    if last == tag:
                        break
            elif tag not in VOID:
                if tag in CLOSES_ITSELF and stack and stack[-1][0] == tag:
                    stack.pop()
                    opened[tag] -= 1
                opened[tag] = opened.get(tag, 0) + 1
                more = piece["more"]
                above = stack[-1][1] if stack else none
                stack.append((tag, DECAY * above + tag_vector(tag, more if "=" in more else "")))
        elif tag == "a":
            in_link = not piece["end"]
    if at < len(page):
        if not parts:
            path = stack[-1][1] if stack else none
        parts.append(page[at:])
    flush()
    return out


def block_vectors(blocks: list[tuple[str, np.ndarray, float]]) -> np.ndarray:
    texts = [b[0] for b in blocks]
    out = np.zeros((len(blocks), WIDTH), dtype=np.float32)
    if not blocks:
        return out
    out[:, :PATH] = np.tanh(np.stack([b[1] for b in blocks]))
    words = Words(texts, lower=True)
    n = np.maximum(words.counts(), 1)
    cell = (words.bare_hash() >> np.uint64(59)).astype(np.int64)
    sign = np.where(cell & 1, 1.0, -1.0)
    hashed = np.bincount(words.doc * WORDS + (cell >> 1), sign, len(blocks) * WORDS).reshape(-1, WORDS)
    out[:, PATH : PATH + WORDS] = 0.5 * hashed / np.maximum(np.sqrt((hashed**2).sum(axis=1)), 1.0)[:, None]
    size = np.fromiter(map(len, texts), dtype=np.float64, count=len(texts))
    out[:, PATH + WORDS] = np.log1p(n) / 4
    out[:, PATH + WORDS + 1] = [b[2] for b in blocks]
    out[:, PATH + WORDS + 2] = [sum(map(t.count, ".,;")) for t in texts] / n
    out[:, PATH + WORDS + 3] = size / n / 10
    out[:, PATH + WORDS + 4] = [t[-1] in ".!?:\"'" for t in texts]
    out[:, PATH + WORDS + 5] = 1.0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM and a logistic output, in numpy. Sequences are padded to (time, batch, features) with a mask."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"wx{d}"] = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * HIDDEN))
            self.p[f"wh{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1.0
            self.p[f"bx{d}"] = bias
        self.p["out"] = rng.normal(0, 0.1, 2 * HIDDEN + WIDTH)
        self.p["bias"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        driven = x @ self.p[f"wx{d}"] + self.p[f"bx{d}"]
        h = np.zeros((x.shape[1], HIDDEN))
        c = np.zeros_like(h)
        out, tape = np.zeros((*x.shape[:2], HIDDEN)), []
        for t in steps:
            z = driven[t] + h @ self.p[f"wh{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            th = np.tanh(new)
            tape.append((t, h, c, i, f, o, g, th, m))
            c = np.where(m, new, 0.0)
            h = np.where(m, o * th, 0.0)
            out[t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        fw, tape_f = self._run(x, mask, "f")
        bw, tape_b = self._run(x, mask, "b")
        seen = np.concatenate([fw, bw, x], axis=2)
        return _sigmoid(seen @ self.p["out"] + self.p["bias"]), (seen, tape_f, tape_b)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        p, (seen, *tapes) = self.forward(x, mask)
        n = max(1, mask.sum())
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
        delta = mask * (p - y) / n
        grad = {"out": np.einsum("tb,tbk->k", delta, seen), "bias": np.array([delta.sum()])}
        for d, tape, low in (("f", tapes[0], 0), ("b", tapes[1], HIDDEN)):
            wh = self.p[f"wh{d}"]
            above = delta[:, :, None] * self.p["out"][low : low + HIDDEN]
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN))
            dwh = np.zeros_like(wh)
            dh, dc = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
            for t, h, c, i, f, o, g, th, m in reversed(tape):
                dh = np.where(m, dh + above[t], 0.0)
                dc = np.where(m, dc, 0.0) + dh * o * (1 - th**2)
                dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                dwh += h.T @ dz[t]
                dh = dz[t] @ wh.T
                dc = dc * f
            grad[f"wh{d}"] = dwh
            grad[f"wx{d}"] = x.reshape(-1, WIDTH).T @ dz.reshape(-1, 4 * HIDDEN)
            grad[f"bx{d}"] = dz.sum(axis=(0, 1))
        return loss, grad

    def label(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text of each block of each page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
        k = 0
        while k < len(order):
            most = k + 1
            while most < len(order) and most - k < 256 and len(sequences[order[most]]) <= 1.3 * len(sequences[order[k]]) + 4:
                most += 1
            x, mask = padded([sequences[i] for i in order[k:most]])
            p, _ = self.forward(x, mask)
            for b, i in enumerate(order[k:most]):
                out[i] = p[: len(sequences[i]), b]
            k = most
        return out


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, sequences))
    x = np.zeros((longest, len(sequences), WIDTH))
    mask = np.zeros((longest, len(sequences)), dtype=bool)
    for b, s in enumerate(sequences):
        x[: len(s), b], mask[: len(s), b] = s, True
    return x, mask


def labelled_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Block vectors and labels of random layouts."""
    layouts, out = Layouts(seed), []
    for _ in range(n):
        pieces = layouts.page()
        marked = "".join(f"\x01{label}{text}" if label is not None else text for text, label in pieces)
        blocks, labels = [], []
        for text, path, linked in blocks_of(marked):
            found = [int(m) for m in re.findall("\x01([01])", text)]
            if found:
                blocks.append((re.sub("\x01[01]", "", text) or "-", path, linked))
                labels.append(max(found))
        if blocks:
            out.append((block_vectors(blocks), np.array(labels, dtype=float)))
    return out


@functools.lru_cache(maxsize=2)
def trained(pages: int = 2500, epochs: int = 10, seed: int = 11) -> Labeller:
    """The labeller, fitted by Adam to ``pages`` random layouts."""
    model, data = Labeller(), labelled_pages(pages, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)).tolist(), key=lambda i: len(data[i][1]) // 4)
        groups = [order[k : k + 25] for k in range(0, len(order), 25)]
        for g in rng.permutation(len(groups)):
            x, mask = padded([data[i][0] for i in groups[g]])
            y = np.zeros(mask.shape)
            for b, i in enumerate(groups[g]):
                y[: len(data[i][1]), b] = data[i][1]
            _, grad = model.gradients(x, mask, y)
            step += 1
            for k, v in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v**2
                rate = 0.01 / (1 + 0.5 * epoch)
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def main_texts(pages: list[str], model: Labeller, least: float = 0.5) -> list[str]:
    found = [blocks_of(p) for p in pages]
    flat = block_vectors([b for blocks in found for b in blocks])
    bounds = np.cumsum([0] + [len(b) for b in found])
    kept = model.label([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    return ["\n\n".join(b[0] for b, p in zip(blocks, ps, strict=True) if p >= least) for blocks, ps in zip(found, kept, strict=True)]


def extracted(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    held = pages.sparkSession.sparkContext.broadcast(model or trained())

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for low in range(0, len(rows), 256):
                part = rows.iloc[low : low + 256]
                texts = main_texts(part["html"].fillna("").tolist(), held.value)
                yield pd.DataFrame(
                    {"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]}
                )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return slim.mapInPandas(rows_of, "page_id long, url string, text string, n_chars long")


def op1_html(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
