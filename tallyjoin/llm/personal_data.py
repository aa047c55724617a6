"""Personal data: base patterns, and candidate spans judged by boosted trees with calibrated thresholds.

High-recall generators propose spans that may overlap, the base patterns among them; a boosted model scores each by its
format and the words around it. Of the proposals that aren't base spans the best that reach the calibrated threshold are
kept, never over a base span; base spans always stay, and n_selected counts all spans that reach the threshold, as a version
number may look like an address and a serial number like a card. The model is fitted on seeded, generated examples (true
formats in telling and in neutral contexts, against look-alikes such as order numbers, versions, dates and sums), so it
needs no labels and is the same in every run.

Defined results: null text is empty; each row gives one row; only doc_id and text are read; positions are code points,
ends exclusive, over the whole text; ties between candidates go to the higher score, then the earlier, then the longer.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyjoin.llm import common
from tallyjoin.llm.boosting import Boosted

BASE = ("email", "ip", "card", "phone")
MORE = ("local_phone", "national_id", "iban", "spelt_email", "mac")
KINDS = BASE + MORE

# The patterns of the base kinds. A run of digits that doesn't begin an address doesn't hold one.
EMAIL_NAME, EMAIL_HOST = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

GENERATORS = (
    ("local_phone", re.compile(r"(?<![0-9+.,/-])(?:\([0-9]{2,5}\)[\x20-]?|0[0-9]{1,4}[\x20./-]|[0-9]{3}[\x20.-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,4}(?![0-9])")),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("spelt_email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:\x20?(?:\[at\]|\(at\))\x20?|\x20at\x20)[A-Za-z0-9-]+(?:(?:\x20?(?:\[dot\]|\(dot\))\x20?|\x20dot\x20)[A-Za-z0-9-]+)+", re.IGNORECASE | re.ASCII)),
    ("mac", re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])")),
)
#: A text without this holds no spelt address.
SPELT = re.compile(r"[\[(\x20]dot[\])\x20]", re.IGNORECASE)
# Words near a span that speak for personal data, and against it.
FOR = ("phone", "tel", "call", "mobile", "fax", "contact", "ssn", "social", "security", "iban", "account", "bank", "mail", "reach", "device", "mac", "address", "write")
AGAINST = ("order", "invoice", "version", "isbn", "issue", "page", "total", "price", "part", "model", "serial", "ticket", "build", "chapter", "score", "sum", "date")
AROUND = 32
#: A span is kept from this calibrated probability on.
LEAST = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, in linear time: from each @ back to the last match's end at most."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and EMAIL_NAME.match(text[start - 1]):
            start -= 1
        host = EMAIL_HOST.match(text, at) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind, then start."""
    out = []
    out += [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def iban_holds(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    digit, spelt = re.search(r"[0-9]", text), SPELT.search(text)
    for name, pattern in GENERATORS:
        if spelt if name == "spelt_email" else digit:
            for m in pattern.finditer(text):
                yield KINDS.index(name), m.start(), m.end()


def features(text: str, kind: int, a: int, b: int) -> list[float]:
    s, before, after = text[a:b], text[max(0, a - AROUND) : a].lower(), text[b : b + AROUND].lower()
    d = digits_of(s)
    name = KINDS[kind]
    area = int(d[:3]) if name == "national_id" else 0
    spelling = len(re.findall(r"[\[(](?:at|dot)[\])]", s, re.IGNORECASE))
    return [
        *(float(name == k) for k in KINDS),
        float(len(s)),
        float(len(d)),
        float(len(re.findall(r"[^0-9A-Za-z]", s))),
        float(len(set(re.findall(r"[^0-9A-Za-z]", s)))),
        float(len(set(d))),
        float(s[:1] in "(0"),
        float(9 <= len(d) <= 11),
        float(name == "iban" and iban_holds(s)),
        float(name == "national_id" and area not in (0, 666) and area < 900 and d[3:5] != "00" and d[5:] != "0000"),
        float(spelling),
        float(" dot " in s.lower()),
        float(s.lower().rpartition("dot")[2].strip(" ])") in ("com", "org", "net", "de", "fr", "es", "edu", "io")),
        float(any(w in before for w in FOR)),
        float(any(w in before for w in AGAINST)),
        float(any(w in after for w in FOR)),
        float(before[-1:] in "$€£#%=*" and before[-1:] != ""),
        float(after[:1] in "%€$*=" and after[:1] != ""),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(name == "local_phone" and re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s) is not None),
        float(name == "email" and s.rpartition(".")[2].isalpha()),
        float(name == "ip" and max(map(int, d4)) > 31 if len(d4 := [x for x in s.split(".") if x.isdigit()]) == 4 else False),
    ]


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated contexts, and whether the candidate in them is personal."""
    rnd = random.Random(seed)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("abdeilmnorstu") for _ in range(rnd.randint(3, 8)))

    def iban(good: bool) -> str:
        land, rest = rnd.choice(("DE", "FR", "ES", "GB", "NL")), num(18)
        check = 98 - int("".join(str(int(c, 36)) for c in rest + land + "00")) % 97
        s = f"{land}{(check + (0 if good else rnd.randint(1, 90))) % 97 if not good else check:02d}{rest}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rnd.random() < 0.5 else s

    xs, ys = [], []
    while len(xs) < n:
        good, kind = rnd.random() < 0.5, rnd.choice(KINDS)
        sep = rnd.choice("-. ")
        if kind == "email":
            s = f"{word()}.{word()}@{word()}.{rnd.choice(('com', 'org', 'net', 'de', 'co.uk'))}" if good else f"{word()}@{rnd.randrange(20)}.{rnd.randrange(20)}.{rnd.randrange(20)}"
        elif kind == "ip":
            s = ".".join(str(rnd.randrange(256)) for _ in range(4)) if good else ".".join(str(rnd.randrange(12)) for _ in range(4))
        elif kind == "card":
            s = num(15)
            s += next(c for c in "0123456789" if luhn(s + c))
            s = rnd.choice("- ").join(s[i : i + 4] for i in range(0, 16, 4)) if good and rnd.random() < 0.7 else s
        elif kind == "phone":
            s = f"+{rnd.randint(1, 99)} {rnd.choice((f'({num(3)}) {num(3)}-{num(4)}', f'{num(3)} {num(7)}', f'{num(2)} {num(4)} {num(4)}'))}" if good else f"+{num(1)}.{num(4)}.{num(5)}"
        elif kind == "local_phone":
            s = rnd.choice((f"({num(3)}) {num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(2)}{sep}{num(4)}{sep}{num(3)}", f"{rnd.randint(200, 989)}-{num(3)}-{num(4)}")) if good else rnd.choice((f"{num(3)} {num(3)} {num(3)}", f"{num(3)}.{num(2)}.{num(2)}", f"{num(3)}-{num(2)}-{num(2)}", f"{num(3)} {num(2)} {num(4)} {num(2)}", f"{num(3)}-{num(2)}-{num(4)}"))
        elif kind == "national_id":
            s = f"{rnd.randint(1, 665):03d}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}" if good else rnd.choice((f"{rnd.randint(900, 999)}-{num(2)}-{num(4)}", f"000-{num(2)}-{num(4)}", f"{num(3)}-00-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}"))
        elif kind == "iban":
            s = iban(good)
        elif kind == "spelt_email":
            at, dot = rnd.choice((("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot ")))
            s = f"{word()}{at}{word()}{dot}{rnd.choice(('com', 'org', 'net', 'de'))}" if good else f"{word()} at {word()}. {word()}" if rnd.random() < 0.7 else f"{word()} at {word()} dot {word()}"
        else:
            c = rnd.choice(":-")
            s = c.join(f"{rnd.randrange(256):02x}" for _ in range(6)) if good else "-".join(num(2) for _ in range(6))
        telling = rnd.random()
        decoy = kind == "local_phone" and not good and s.count("-") == 2 and len(s) == 11  # an id, not a phone, in any context
        lead = rnd.choice(FOR if decoy or good and telling < 0.7 else AGAINST if not good and telling < 0.7 else ("the", "and", word()))
        need = kind in ("local_phone", "national_id", "card") and good and lead not in FOR
        text = f"{word()} {lead}{rnd.choice((' ', ': ', ' is '))}{s}{rnd.choice((' ', '. ', ', ', ''))}{word() if rnd.random() < 0.6 else ''}"
        for k, a, b in base_spans(text) if kind in BASE else candidates(text):
            if KINDS[k] == kind:
                xs.append(features(text, k, a, b))
                ys.append(float(good and not need))
    return np.array(xs[:n]), np.array(ys[:n])


@lru_cache
def model(rows: int = 5000, seed: int = 7) -> Boosted:
    """Fitted on rows generated examples and calibrated on as many others."""
    return Boosted().fit(*examples(rows, seed)).calibrate(*examples(rows, seed + 1))


def proposals(texts: list[str], judge: Boosted) -> list[tuple[list[tuple[int, int, int]], list[tuple[float, int, int, int]]]]:
    """Per text its base spans, and (probability, kind, start, end) of every proposal, base spans first. Scored all at once."""
    base = [base_spans(t) for t in texts]
    every = [[*b, *candidates(t)] for t, b in zip(texts, base, strict=True)]
    rows = [features(t, *c) for t, found in zip(texts, every, strict=True) for c in found]
    scores = iter(judge.predict(np.array(rows)).tolist() if rows else [])
    return [(b, [(next(scores), *c) for c in found]) for b, found in zip(base, every, strict=True)]


def chosen(base: list[tuple[int, int, int]], scored: list[tuple[float, int, int, int]], least: float = LEAST) -> list[tuple[int, int, int]]:
    """Of the proposals beyond base the best that reach least, none over another or over a base span."""
    kept: list[tuple[int, int, int]] = []
    taken = [(a, b) for _, a, b in base]
    for p, k, a, b in sorted(scored[len(base) :], key=lambda x: (-x[0], x[2], -x[3])):
        if p >= least and all(b <= x or y <= a for x, y in taken):
            kept.append((k, a, b))
            taken.append((a, b))
    return sorted(kept)


def added_spans(text: str, judge: Boosted, least: float = LEAST) -> list[tuple[int, int, int]]:
    return chosen(*proposals([text], judge)[0], least)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_selected long"
_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_selected", pa.int64())])


def find_personal_data(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Per document: counts of the base kinds, the digest of their spans, all spans, and how many were added and selected.

    Narrow: no shuffle.
    """
    judge = model()

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for base, scored in proposals(common.texts_of(batch), judge):
            added = chosen(base, scored, least)
            line = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
            selected = sum(p >= least for p, *_ in scored[: len(base)]) + len(added)
            rows.append((*(sum(k == i for k, _, _ in base) for i in range(4)), hashlib.sha256(line(base).encode()).hexdigest(), line(base + added), len(added), selected))
        return common.batch_of(_OUT, [batch.column("doc_id"), *([list(c) for c in zip(*rows, strict=True)] or [[]] * 8)])

    return common.map_batches(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), batch_of, SCHEMA)


def redact(text: str, spans: Iterable[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind; overlapping spans go together under the first one's."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += (text[at:a], f"[{KINDS[k].upper()}]")
        at = max(at, b)
    return "".join([*out, text[at:]])
