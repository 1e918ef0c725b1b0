"""Personal data by candidate gradient boosting.

Four base formats are always reported. Generators with high recall propose further, overlapping spans (national phone
numbers, identity and bank numbers, spelled-out e-mail addresses, card-like numbers that fail their checksum ...).
Boosted trees score each proposal from its format and the words around it; proposals over their kind's calibrated
threshold become spans, the likeliest first, as far as they do not overlap.

No table labels spans, so the trees learn from a generated set: TRAIN proposals a kind, half of them personal data and
half look-alikes. What tells them apart is the format first (valid number ranges, checksums, grouping, what touches the
span) and cue words second: most personal data stands among words that no list knows, and a well-formed number is taken
there; look-alikes are malformed, part of something longer, in a row of numbers, or follow a word that names something
else (order, version, part). Thresholds are the least scores that reach PRECISION on a held-out third of that set. Everything
is seeded; the model is a few kilobytes.

Every pattern is anchored so that a scan takes time in proportion to the text, runs of like characters included. The
context of a proposal is its nearest words, however long they are.

Edge cases: a null or empty text has no spans; repeated rows get a row each; a null doc_id is kept; other columns are
ignored; texts and spans may have any length; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted

BASE = ("email", "ip", "card", "phone")
EXTRA = ("phone_local", "national_id", "iban", "email_spelled", "card_like")
KINDS = BASE + EXTRA
TRAIN, PRECISION, SEED = 1200, 0.99, 7
#: Words before and after a proposal that features look at.
BEFORE, AFTER = 5, 3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PHONE_LOCAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
EMAIL_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{2,}+(?: ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{2,}+(?: ?[\[(] ?dot ?[\])] ?|\. ?)| at [A-Za-z0-9-]{2,}+ dot )[A-Za-z]{2,}+(?:\.[A-Za-z]{2,}+)*+(?![A-Za-z0-9])"
)
_SPACED = re.compile(r"[\x20-]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each @: the longest run of local characters before it (behind the last address), then the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        d = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if d:
            out.append((start, d.end(), "email"))
        free = d.end() if d else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(_byte(g) for g in m.groups())]
    cards = [(m.start(), m.end(), _SPACED.sub("", m[0])) for m in CARD.finditer(text)]
    out += [(a, b, "card") for a, b, d in cards if 13 <= len(d) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def proposals(text: str) -> list[Span]:
    out: list[Span] = []
    if any(c in text for c in "0123456789"):
        out += [(m.start(), m.end(), "phone_local") for m in PHONE_LOCAL.finditer(text)]
        out += [(m.start(), m.end(), "national_id") for m in NATIONAL_ID.finditer(text)]
        out += [(m.start(), m.end(), "iban") for m in IBAN.finditer(text)]
        out += [(m.start(), m.end(), "card_like") for m in CARD.finditer(text) if 13 <= len(_SPACED.sub("", m[0])) <= 19]
    if "at" in text and ("[" in text or "(" in text or " dot " in text):
        out += [(m.start(), m.end(), "email_spelled") for m in EMAIL_SPELLED.finditer(text)]
    return out


#: Words that speak for and against personal data, compared in lower case.
FOR = frozenset(("call", "phone", "tel", "mobile", "fax", "contact", "reach", "ssn", "social", "security", "iban", "bank", "account", "transfer", "mail", "write", "card", "visa", "credit", "pay", "mein", "meine", "nummer", "appelez", "compte", "llame", "cuenta"))
AGAINST = frozenset(("order", "version", "isbn", "invoice", "part", "model", "page", "serial", "item", "sku", "ref", "total", "width", "error", "build", "ticket", "code", "line", "table", "row", "article", "tracking"))
#: Ends of addresses that are commonly spelled out; fixed values.
ENDS = frozenset("com org net edu gov info io de fr es uk it nl eu us ca ch at".split())
_WORD = re.compile(r"[A-Za-z]++|[0-9]++")


class Context:
    """The words and numbers of a text, found once and looked up by place."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.spans]

    def around(self, a: int, b: int) -> tuple[list[str], list[str]]:
        i, j = bisect_left(self.starts, a), bisect_left(self.starts, b)
        word = lambda s: self.text[s[0] : s[1]].lower()
        return [word(s) for s in self.spans[max(0, i - BEFORE) : i]], [word(s) for s in self.spans[j : j + AFTER]]


def well_formed(kind: str, s: str, d: str) -> bool:
    """Number ranges that the format's issuer uses, checksums, and usual groupings."""
    if kind == "phone_local":
        return d[0] in "23456789" and d[3] in "23456789"
    if kind == "national_id":
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if kind == "iban":
        return _mod97(s)
    if kind == "email_spelled":
        return s.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].rsplit(")", 1)[-1].rsplit("]", 1)[-1].lower() in ENDS
    return len(d) in (15, 16) and d[0] in "3456" and [len(x) for x in _SPACED.split(s)] in ([4, 4, 4, 4], [4, 6, 5])


def features(context: Context, span: Span) -> list[float]:
    a, b, kind = span
    text = context.text
    s = text[a:b]
    before, after = context.around(a, b)
    d = "".join(c for c in s if "0" <= c <= "9")
    seps = [c for c in s if not c.isalnum()]
    prev, nxt = text[a - 1 : a] if a else "", text[b : b + 1]
    touches = lambda c: float(bool(c) and (c.isalnum() or c in "-_/#$€£%=+"))
    return [
        float(KINDS.index(kind)), len(s), len(d), len(seps), len(set(seps)), len(set(d)), float(well_formed(kind, s, d)), float(bool(d) and luhn(d)),
        sum(w in FOR for w in before), sum(w in AGAINST for w in before), sum(w in FOR for w in after), sum(w in AGAINST for w in after),
        float(before[-1] in FOR) if before else 0.0, float(before[-1] in AGAINST) if before else 0.0,
        float(before[-1].isdigit()) if before else 0.0, float(after[0].isdigit()) if after else 0.0,
        touches(prev), touches(nxt), float("12345" in d or 0 < len(set(d)) <= 2), float(s.count("[") + s.count("(")), float(" dot " in s or "dot" in s),
    ]


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _generated(rng: Random, kind: str, real: bool) -> tuple[Context, Span]:
    """A proposal of the kind in an invented context; `real` ones are personal data."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(n))
    filler = lambda n: " ".join(rng.choice((str.lower, str.lower, str.capitalize))(letters(rng.randrange(2, 9))) for _ in range(n))
    # how a look-alike gives itself away: by its form, by a word before it, by what touches it, or by numbers around it
    how = "" if real else rng.choice(("form", "form", "word", "word", "touch", "row"))
    if kind == "iban" and not real:
        how = "form"
    good = how != "form"
    if kind == "phone_local":
        sep = rng.choice("-. ")
        area, office = (rng.choice("23456789") + digit(2), rng.choice("23456789") + digit(2)) if good else rng.choice(((rng.choice("01") + digit(2), digit(3)), (digit(3), rng.choice("01") + digit(2))))
        s = (f"({area}) " if rng.random() < 0.4 else area + sep) + office + sep + digit(4)
    elif kind == "national_id":
        area, group, serial = f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}", f"{rng.randrange(1, 100):02d}", f"{rng.randrange(1, 10000):04d}"
        if not good:
            area, group, serial = rng.choice(((rng.choice(("000", "666", "9" + digit(2))), group, serial), (area, "00", serial), (area, group, "0000")))
        s = f"{area}-{group}-{serial}"
    elif kind == "iban":
        body, land = digit(rng.choice((12, 16, 18))), rng.choice(("DE", "FR", "ES", "GB", "NL"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = f"{land}{check if good else (check + rng.randrange(1, 90)) % 97 + 2:02d}{body}"
        s = " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s
    elif kind == "email_spelled":
        name, host, end = letters(rng.randrange(3, 10)), letters(rng.randrange(3, 10)), rng.choice(sorted(ENDS))
        at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" at ", " dot ")))
        if not good:
            at, dot, end = rng.choice(((" (at) ", ". "), (" at ", " dot "), ("(at) ", ". "))) + (letters(rng.randrange(4, 8)),)
        s = name + at + host + dot + end
    else:
        n = rng.choice((15, 16, 16, 16)) if good else rng.choice((13, 14, 15, 16, 17, 18, 19))
        s = (rng.choice("3456") if good else rng.choice("0123456789")) + digit(n - 1)
        if good:
            sep = rng.choice(" -")
            s = sep.join((s[:4], s[4:10], s[10:]) if n == 15 else (s[:4], s[4:8], s[8:12], s[12:]))
        elif rng.random() < 0.3:
            s = " ".join(s[i : i + 5] for i in range(0, n, 5))
    cue = rng.choice(sorted(AGAINST)) if how == "word" else rng.choice(sorted(FOR)) if real and rng.random() < 0.25 else filler(rng.randrange(2))
    head = f"{filler(rng.randrange(0, 7))} {cue} {rng.choice(('', '', ': ', 'is ', 'no '))}"
    tail = rng.choice(("", " ", ". ", ", ", "\n")) + filler(rng.randrange(0, 4))
    if how == "touch":
        head, tail = rng.choice(((head + rng.choice(("#", "$", "/", "-", "_", "=", letters(2) + "-")), tail), (head, rng.choice(("-", "/", "_", "%")) + digit(2) + tail)))
    elif how == "row":
        head, tail = f"{head}{digit(rng.randrange(1, 5))}, ", f", {digit(rng.randrange(1, 5))} {tail}"
    text = head + s + tail
    return Context(text), (len(head), len(head) + len(s), kind)


@lru_cache(1)
def model() -> tuple[Boosted, dict[str, float]]:
    rng = Random(SEED)
    rows = [(features(*_generated(rng, k, real)), real, k) for k in EXTRA for real in (True, False) for _ in range(TRAIN // 2)]
    rng.shuffle(rows)
    x, y, kinds = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    third = len(rows) // 3
    trees = Boosted().fit(x[third:], y[third:])
    p = trees.probability(x[:third])
    limits = {}
    for k in EXTRA:
        own = kinds[:third] == k
        order = np.argsort(-p[own])
        precision = np.cumsum(y[:third][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(precision >= PRECISION)
        limits[k] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1
    return trees, limits


def all_spans(text: str | None, trees: Boosted, limits: dict[str, float]) -> tuple[list[Span], list[tuple[int, int, str, float]]]:
    """(base spans, further spans with their scores); those do not overlap each other nor a base span."""
    text = text or ""
    base = base_spans(text)
    offers = proposals(text)
    if not offers:
        return base, []
    context = Context(text)
    p = trees.probability(np.array([features(context, s) for s in offers], float))
    taken = sorted((a, b) for a, b, _ in base)
    out = []
    for score, (a, b, kind) in sorted(zip(p.tolist(), offers, strict=True), key=lambda x: (-x[0], x[1])):
        i = bisect_right(taken, (a, b))
        clash = (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b)
        if score >= limits[kind] and not clash:
            taken.insert(i, (a, b))
            out.append((a, b, kind, score))
    return base, out


SPAN = "struct<start:long,end:long,kind:string,rank:int,score:double>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("rank", pa.int32()), ("score", pa.float64())]))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of SPAN, by kind as listed, then start)."""
    fitted = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, both = [], []
            for x in b.column("text").to_pylist():
                own, more = all_spans(x, *fitted)
                rows = [{"start": s, "end": e, "kind": k, "rank": KINDS.index(k), "score": p} for s, e, k, p in [*[(*o, 1.0) for o in own], *more]]
                rows.sort(key=lambda r: (r["rank"], r["start"]))
                base.append([r for r in rows if r["rank"] < len(BASE)])
                both.append(rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, _ARROW), pa.array(both, _ARROW)], ["doc_id", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base array<{SPAN}>, spans array<{SPAN}>")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
