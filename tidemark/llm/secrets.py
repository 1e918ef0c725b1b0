"""Secret scans with corpus-wide ownership frequency.

Three base formats are always reported. Beside them a high-recall generator proposes other credential shapes; what
decides about those is how their value spreads over the corpus: a value that fewer than EXAMPLE_OWNERS owners and fewer
than EXAMPLE_REPOS repositories hold (and that is not built like a placeholder) is live-looking and becomes a span; one
that is spread wider is a copied example and does not. The same frequencies label the base spans (n_live, n_example)
without removing any. Where a table has no repositories, documents stand for them, and their sources for owners.

Values are counted by hash, first per (hash, owner, repository), then per hash, so a value copied into a third of all
documents is combined before each shuffle.

Edge cases: a null or empty text has no spans; null owners count as one owner, null repositories as one repository;
repeated rows each get a row, and count once for the frequencies; columns that are not named are ignored; texts and
secrets may have any length (every pattern scans in time proportional to the text); an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, staged

BASE = ("assign", "access", "hex")
EXTRA = ("private_key", "vendor_token", "jwt", "url_password", "opaque")
KINDS = BASE + EXTRA
#: Owners, and repositories, from which on a value is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 100
#: Bits per character under which a value looks like a placeholder.
LEAST_ENTROPY = 2.5

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
PRIVATE_KEY = re.compile(r"-----BEGIN ((?:[A-Z0-9]++ )*?)PRIVATE KEY-----")
#: What follows the header of a key that has no END line: its own headers, long pieces, and a last line that may be short.
KEY_BODY = re.compile(r"(?:\s*+[A-Za-z-]++: [^\n]*+\n)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)++(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{1,15}+={1,2}|\s*?(?:\n|\\n)[A-Za-z0-9+/]{1,15}+={0,2}(?=[\x20\t\r]*+(?:\n|\\[nr]|\Z)))?")
KEY_SPACE = re.compile(r"\s|\\[nr]")
VENDOR = re.compile(r"(?:gh[opsur]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35})")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
URL_PASSWORD = re.compile(r"://[^\s:/@]++:([^\s:/@]{6,}+)@")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{28,}+")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|x{6}|\.{3}|1234567", re.I)
_IS_HEX = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_HEX_RUN = bytes([1]) * 32
_IS_OPAQUE = bytes(1 if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_-") else 0 for i in range(256))
_OPAQUE_RUN = bytes([1]) * 28

Span = tuple[int, int, str, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind, value) of the base kinds, per kind leftmost first and without overlap, failing ones dropped."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if _HEX_RUN in text.encode().translate(_IS_HEX):
        out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def private_keys(text: str) -> list[Span]:
    """From BEGIN to END, or over what looks like the key where no END comes before the next BEGIN.

    The header alone is the same everywhere: the value is the body without white space, as copies break lines elsewhere.
    A header that no body follows holds no secret.
    """
    out: list[Span] = []
    heads = list(PRIVATE_KEY.finditer(text))
    for m, following in zip(heads, [*[h.start() for h in heads[1:]], len(text)], strict=True):
        foot = f"-----END {m[1]}PRIVATE KEY-----"
        at = text.find(foot, m.end(), following)
        if at >= 0:
            body, end = text[m.end() : at], at + len(foot)
        elif found := KEY_BODY.match(text, m.end(), following):
            body, end = found[0], found.end()
        else:
            continue
        out.append((m.start(), end, "private_key", KEY_SPACE.sub("", body)))
    return out


def extra_spans(text: str) -> list[Span]:
    """Candidates of the other kinds; what lies within a base span is left to it by the caller."""
    out: list[Span] = []
    if "PRIVATE KEY" in text:
        out += private_keys(text)
    if any(w in text for w in ("gho_", "ghp_", "ghs_", "ghu_", "ghr_", "xox", "sk_live_", "AIza")):
        out += [(m.start(), m.end(), "vendor_token", m[0]) for m in VENDOR.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt", m[0]) for m in JWT.finditer(text)]
    if "://" in text:
        out += [(m.start(1), m.end(1), "url_password", m[1]) for m in URL_PASSWORD.finditer(text)]
    named = list(out)
    for m in OPAQUE.finditer(text) if _OPAQUE_RUN in text.encode().translate(_IS_OPAQUE) else ():
        v = m[0]
        if any(a <= m.start() and m.end() <= b for a, b, _, _ in named):
            continue
        if any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v) and entropy(v) >= 4.0:
            out.append((m.start(), m.end(), "opaque", v))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)


def candidates(text: str | None) -> tuple[list[Span], list[Span]]:
    base = base_spans(text or "")
    extra = [s for s in extra_spans(text or "") if not any(a <= s[0] and s[1] <= b for a, b, _, _ in base)]
    return base, extra


SPAN = "struct<start:long,end:long,kind:string,rank:int,value:long,odd:boolean>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("rank", pa.int32()), ("value", pa.int64()), ("odd", pa.bool_())]))


def _row(spans: list[Span]) -> list[dict]:
    return [
        {"start": a, "end": b, "kind": k, "rank": KINDS.index(k), "value": xxhash.xxh64_intdigest(v.encode()) - (1 << 63), "odd": bool(PLACEHOLDER.search(v)) or entropy(v) < LEAST_ENTROPY}
        for a, b, k, v in spans
    ]


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """doc_id, th (hash of the text), owner, repo, base and extra (arrays of SPAN) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "owner", "repo"]
        for b in batches:
            found = [candidates(x) for x in b.column("text").to_pylist()]
            spans = [pa.array([_row(f[i]) for f in found], _ARROW) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *spans], [*names, "base", "extra"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, owner string, repo string, base array<{SPAN}>, extra array<{SPAN}>")


def ownership(scanned: DataFrame) -> DataFrame:
    """value, n_repos, n_owners over the whole corpus."""
    one = scanned.where((F.size("base") > 0) | (F.size("extra") > 0)).select("owner", "repo", F.explode(F.concat("base", "extra")).alias("s"))
    by_repo = one.select(F.col("s.value").alias("value"), "owner", "repo").distinct()
    by_owner = by_repo.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judged(scanned: DataFrame) -> DataFrame:
    """doc_id, th and, per document that has candidates: extra spans to report, n_live, n_example."""
    one = scanned.where((F.size("base") > 0) | (F.size("extra") > 0)).select("doc_id", "th", F.explode(F.concat("base", "extra")).alias("s")).distinct()
    own = one.withColumn("value", F.col("s.value")).join(ownership(scanned), "value")
    live = (F.col("n_owners") < EXAMPLE_OWNERS) & (F.col("n_repos") < EXAMPLE_REPOS) & ~F.col("s.odd")
    add = (F.col("s.rank") >= len(BASE)) & live
    return own.groupBy("doc_id", "th").agg(
        F.collect_list(F.when(add, F.col("s"))).alias("added"), F.sum(live.cast("long")).alias("n_live"), F.sum((~live).cast("long")).alias("n_example"),
    )


def _text(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, base and spans (arrays), base_text and spans_text (kind:start:end), n_live, n_example."""
    scanned = cut(scan(docs, owner, repo))
    found = judged(scanned).withColumnsRenamed({"doc_id": "__id", "th": "__th"})
    rows = scanned.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    spans = F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))
    return rows.select(
        "doc_id", "base", spans.alias("spans"), _text(F.col("base")).alias("base_text"), _text(spans).alias("spans_text"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def blank_out(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; n_chars, if there, follows. No row goes.

    One pass over the texts replaces base spans and writes the table with its candidates. Rows with candidates that
    wait for the corpus-wide verdict (few) are written as they are and meet it in a join, so the bulk of the texts is
    never shuffled nor scanned again.
    """
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column("doc")
            fields, kinds = doc.flatten(), list(doc.type)
            texts = fields[at].to_pylist()
            found = [candidates(x) for x in texts]
            base, extra = ([_row(f[i]) for f in found] for i in (0, 1))
            waits = [any(not s["odd"] for s in own) for own in extra]
            done = [blank_out(x, [s[:3] for s in own]) if own and not w else x for x, w, (own, _) in zip(texts, waits, found, strict=True)]
            fields[at] = pa.array(done, kinds[at].type)
            cols = [pa.StructArray.from_arrays(fields, fields=kinds), *[b.column(n) for n in ("th", "owner", "repo")], pa.array(base, _ARROW), pa.array(extra, _ARROW), pa.array(waits, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "th", "owner", "repo", "base", "extra", "waits"])

    def with_verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [blank_out(x, [(s["start"], s["end"], s["kind"]) for s in own]) for x, own in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist(), strict=True)]
            yield b.select(names).set_column(at, b.schema.field("text"), pa.array(text, b.schema.field("text").type))

    rows = docs.select(F.struct(*names).alias("doc"), F.xxhash64("text").alias("th"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"))
    whole = staged(rows.mapInArrow(run, f"doc {docs.schema.simpleString()}, th long, owner string, repo string, base array<{SPAN}>, extra array<{SPAN}>, waits boolean"))
    found = judged(whole.select("doc.doc_id", "th", "owner", "repo", "base", "extra")).where(F.size("added") > 0)
    found = found.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "added")
    rest = whole.where("waits").join(found, F.col("doc.doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    rest = rest.select("doc.*", F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))).alias("__spans"))
    out = whole.where(~F.col("waits")).select("doc.*").unionByName(rest.mapInArrow(with_verdict, docs.schema))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in names else out
