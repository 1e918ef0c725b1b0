"""Readers for HTML and its embedded facts. Pages are parsed a batch at a time in Arrow workers."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_DROP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_BREAK = re.compile(r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>")
_TAG = re.compile(r"<[^>]*>")
_TITLE = re.compile(r"(?is)<title[^>]*>(.*?)</title>")


def html_text(page: str | None) -> str:
    body = _TAG.sub(" ", _BREAK.sub("\n", _DROP.sub(" ", page or "")))
    lines = [" ".join(x.split()) for x in html.unescape(body).split("\n")]
    return "\n".join(x for x in lines if x)


def parse_pages(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key, title and text of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            titles = [(m := _TITLE.search(x or "")) and html.unescape(m[1]).strip() for x in b[column]]
            yield pd.DataFrame({key: b[key], "title": titles, "text": [html_text(x) for x in b[column]]})

    return pages.select(key, column).mapInPandas(run, f"{key} long, title string, text string")


_CONTEXT = re.compile(r'(?is)<xbrli:context[^>]*\bid="([^"]+)"[^>]*>(.*?)</xbrli:context>')
_FACT = re.compile(r"(?is)<ix:nonfraction\b([^>]*)>(.*?)</ix:nonfraction>")
_ATTRIBUTE = re.compile(r'(?i)([a-z:]+)\s*=\s*"([^"]*)"')


def inline_facts(page: str | None) -> list[dict]:
    """Numeric facts of an inline-tagged page: context, concept, scaled and signed value, period."""
    page = page or ""
    tag = lambda name, body: (m := re.search(rf"(?is)<xbrli:{name}>\s*([^<]+?)\s*</xbrli:{name}>", body)) and m[1]
    contexts = {i: {"has_dimensions": "explicitmember" in body.lower() or "typedmember" in body.lower(), "instant": tag("instant", body), "start": tag("startDate", body), "end": tag("endDate", body)} for i, body in _CONTEXT.findall(page)}
    out = []
    for attributes, inner in _FACT.findall(page):
        a = {k.lower(): v for k, v in _ATTRIBUTE.findall(attributes)}
        text = html.unescape(_TAG.sub("", inner)).replace(",", "").strip()
        c = contexts.get(a.get("contextref", ""))
        if c is None or a.get("xsi:nil", "").lower() == "true":
            continue
        try:
            value = float(text) * 10 ** int(a.get("scale") or 0) * (-1 if a.get("sign") == "-" else 1)
        except ValueError:
            continue
        out.append({
            "context_id": a["contextref"], "has_dimensions": c["has_dimensions"], "concept": a.get("name", ""), "numeric_value": value,
            "period_type": "instant" if c["instant"] else "duration", "period_start": None if c["instant"] else c["start"], "period_end": c["instant"] or c["end"],
        })
    return out


FACTS = "context_id string, has_dimensions boolean, concept string, numeric_value double, period_type string, period_start string, period_end string"


def read_facts(filings: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """A row for each fact; a filing without any gives none, and no filing at all an empty table with the columns."""
    own = ", ".join(f"{k} {filings.schema[k].dataType.simpleString()}" for k in keys)
    names = [x.split()[0] for x in FACTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{**{k: r[k] for k in keys}, **f} for r in b.to_dict("records") for f in inline_facts(r[column])]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return filings.select(*keys, column).mapInPandas(run, f"{own}, {FACTS}")


_ITEM = re.compile(r"(?i)^\W{0,4}item\s+(\d{1,2}[a-c]?)\s*[.:\-–—]?\s*(.*)$")


def segment_items(lines: Sequence[str]) -> dict[str, str]:
    """Item key to section text of a filing's lines.

    A run of five or more headings within 150 lines of each other that are links or table rows, or have nothing between
    them, is a table of contents and is skipped. After it, headings count in rising order; a key that turns up again
    further on belongs to the second part.
    """
    found = [(i, m[1].upper(), "|" in x or "](" in x) for i, x in enumerate(lines) if (m := _ITEM.match(x.strip()))]
    toc = 0
    run: list[int] = []
    for n, (i, _, listed) in enumerate(found):
        follows = bool(run) and i - found[run[-1]][0] <= 150 and (listed or i - found[run[-1]][0] == 1)
        run = [*run, n] if follows else ([n] if listed or not run else [])
        if len(run) >= 5:
            toc = n + 1
    rank = lambda k: (int(re.match(r"\d+", k)[0]), k)
    starts: list[tuple[int, str]] = []
    part, last = "", (0, "")
    for i, key, _ in found[toc:]:
        if rank(key) <= last and any(k == key for _, k in starts) and not part:
            part, last = "_II", (0, "")
        if rank(key) > last:
            starts.append((i, key + part))
            last = rank(key)
    ends = [i for i, _ in starts[1:]] + [len(lines)]
    return {k: "\n".join(lines[i:e]).strip() for (i, k), e in zip(starts, ends, strict=True)}


#: Forms that are one section, and its key.
WHOLE = {"8-K": "8K_FULL", "6-K": "6K_FULL", "20-F": "20F_FULL", "DEF 14A": "PROXY_FULL"}


def whole_documents(filings: DataFrame, form: str, text: str) -> DataFrame:
    """filings of the WHOLE forms with item_key and section_text: their text in one section; blank ones have none."""
    from pyspark.sql import functions as F

    key = F.element_at(F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair]), F.col(form))
    return filings.where(F.col(form).isin(*WHOLE) & (F.trim(text) != "")).withColumn("item_key", key).withColumn("section_text", F.col(text)).drop(text)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows (path, content), for parsers of compressed filings."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
