"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

Defined results: null text is empty; every row gives one row, repeated rows each their own, in any number of columns
(only doc_id and text are read); a text without secrets has zero counts, the digest of the empty string and empty
spans; a token of letters alone is never an entropy span, as nothing tells it from words; positions are code points, ends exclusive, over the whole text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyjoin.llm import common

KINDS = ("assign", "access", "hex", "entropy")

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the run is maximal, so 20 or more characters in all
HEX = re.compile(r"[0-9a-f]{24,}")

#: Strings that may hold a secret: long runs of the characters of keys and tokens.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}")
#: Character classes: name, its runs, window, least bits a character, and what a window must have.
CLASSES = (
    ("hex", re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.2, (str.isdigit, str.isalpha)),
    ("lower case and digits", re.compile(r"[a-z0-9]{20,}"), 20, 3.6, (str.isdigit, str.islower)),
    ("base32", re.compile(r"[A-Z0-9]{20,}"), 20, 3.5, (str.isdigit, str.isupper)),
    ("base64", re.compile(r"[A-Za-z0-9+/=_-]{20,}"), 20, 3.7, (str.isdigit, str.islower, str.isupper)),
)
#: What is long and mixed but no secret: UUIDs, runs of words, paths and file names, words with numbers, repeated filler, dates.
ALLOW = tuple(
    re.compile(p)
    for p in (
        r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
        r"([A-Z]?[a-z]+|[A-Z]+|[0-9]+)([_/+=-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]+))*",
        r"(?:[a-z]+|[A-Z][a-z]+)(?:[A-Z][a-z]+){0,5}[0-9]{0,4}",
        r"(?![0-9A-Fa-f]+\Z)(([a-z]{5,}[0-9]{1,4})+([a-z]{5,})?|([A-Z]{5,}[0-9]{1,4})+([A-Z]{5,})?)",
        r"(.{1,4})\1{4,}.{0,3}",
        r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9]{0,6}Z?",
    )
)


def dense_windows(text: str, width: int, least: float, needs: tuple) -> Iterator[tuple[int, int]]:
    """Merged spans of the windows whose entropy reaches least bits and whose characters meet all needs.

    Counts, the sum of c*log2(c) and the needs are kept up as the window moves, so a step takes constant time.
    """
    plogp = [0.0, *(c * math.log2(c) for c in range(1, width + 2))]  # the new character is counted before the old one goes
    counts: dict[str, int] = {}
    have = [0] * len(needs)
    total, span = 0.0, None
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += plogp[n + 1] - plogp[n]
        for k, need in enumerate(needs):
            have[k] += need(c)
        if i >= width:
            old = text[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += plogp[n - 1] - plogp[n]
            for k, need in enumerate(needs):
                have[k] -= need(old)
        if i >= width - 1 and all(have) and math.log2(width) - total / width >= least - 1e-9:
            a = i - width + 1
            if span and a <= span[1]:
                span = (span[0], i + 1)
            else:
                if span:
                    yield span
                span = (a, i + 1)
    if span:
        yield span


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every span, by start, then kind. Entropy spans hold something that base ones don't."""
    base = []
    if ":" in text or "=" in text:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    added: list[tuple[int, int, int]] = []
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if word.isalpha() or any(p.fullmatch(word) for p in ALLOW):
            continue
        at = m.start()
        found = sorted((at + r.start() + a, at + r.start() + b) for _, runs, width, least, needs in CLASSES for r in runs.finditer(word) for a, b in dense_windows(r[0], width, least, needs))
        for a, b in found:
            if added and a < added[-1][2]:
                added[-1] = (added[-1][0], 3, max(b, added[-1][2]))
            else:
                added.append((a, 3, b))
    if added and base:
        held = merged((a, b) for a, _, b in base)
        added = [x for x in added if not any(a <= x[0] and x[2] <= b for a, b in held)]
    return sorted(base + added)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans' union, as disjoint spans in order; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_entropy", pa.int64())])


def _batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for text in common.texts_of(batch):
        found = scan(text)
        n = [sum(k == kind for _, k, _ in found) for kind in range(4)]
        lines = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
        base = ",".join(x for x, (_, k, _) in zip(lines, found, strict=True) if k < 3)
        rows.append((*n[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(lines), n[3]))
    return common.batch_of(_OUT, [batch.column("doc_id"), *([list(c) for c in zip(*rows, strict=True)] or [[]] * 6)])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: counts of each kind, the digest of its base spans, and all spans. Narrow: no shuffle."""
    return common.map_batches(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), _batch, SCHEMA)


def mask(text: str, fill: str = "[SECRET]") -> str:
    """text with every span replaced, overlapping and touching ones together."""
    out, at = [], 0
    for a, b in merged((a, b) for a, _, b in scan(text)):
        out += (text[at:a], fill)
        at = b
    return "".join([*out, text[at:]])
