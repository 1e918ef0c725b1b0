"""Named products in texts: lexicon terms with what is known of their makers, and their counts per document."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import fold_lower, lexicon_pattern

META = ("family", "ecosystem", "country", "vendor_type", "vendor_ticker")


def lexicon_terms(vendors: Sequence[Mapping], excluded: Sequence[str] = ()) -> dict[str, dict]:
    """term -> its family's data; of several families that list a term the first has it, excluded terms have none."""
    out: dict[str, dict] = {}
    for v in vendors:
        for term in (t.lower().strip() for t in v["terms"]):
            if term not in {x.lower() for x in excluded}:
                out.setdefault(term, {m: v.get(m) for m in META})
    return out


def vendor_mentions(texts: DataFrame, text: str, terms: Mapping[str, Mapping], context: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """texts (without the text) by term found, with META and context_gated.

    A text is folded and searched once, by one alternation at word starts; a term with a context counts only where one
    of its context terms stands in the same text. The lexicon is configuration, so it is part of the plan.
    """
    context = {t.lower(): c for t, c in (context or {}).items()}
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    some = "|".join(re.escape(t) for t in ordered)
    hits = F.regexp_extract_all("__low", F.lit(f"(?<![a-z0-9])(?=({some})(?![a-z0-9]))"), F.lit(1))
    starts = {t: [x for x in ordered if x == t or (x.startswith(t) and not x[len(t)].isalnum())] for t in ordered}

    def one(t: str) -> Column:
        own = F.struct(F.lit(t).alias("term"), *[F.lit(terms[t].get(m)).cast("string").alias(m) for m in META], F.lit(t in context).alias("context_gated"))
        found = F.arrays_overlap("__hits", F.array(*[F.lit(x) for x in starts[t]]))
        return F.when(found & F.col("__low").rlike(lexicon_pattern(context[t])) if t in context else found, own)

    low = texts.withColumn("__low", fold_lower(F.coalesce(F.col(text), F.lit("")))).withColumn("__hits", F.array_distinct(hits)).where(F.size("__hits") > 0)
    keys = [c for c in texts.columns if c != text]
    return low.select(*keys, F.explode_outer(F.array_compact(F.array(*[one(t) for t in terms]))).alias("m")).where("m IS NOT NULL").select(*keys, "m.*")


def vendor_wide(documents: DataFrame, mentions: DataFrame, document: str, unit: str, ticker: str, ecosystems: Sequence[str], stack: Sequence[str]) -> DataFrame:
    """documents with counts of units (paragraphs) that name a vendor, by ecosystem and by kind of product.

    A document that names its own firm's product names no vendor there (counted apart). A unit counts once, however many
    terms it holds. vendor_terms are the outside terms, sorted.
    """
    m = mentions.join(documents.select(document, F.col(ticker).alias("__own")), document)
    own = F.coalesce(F.col("vendor_ticker") == F.col("__own"), F.lit(False))
    units = lambda rule: F.count_distinct(F.when(rule, F.col(unit)))
    counts = {"n_vendor_paragraphs": ~own, "n_vendor_self_paragraphs": own}
    for e in ecosystems:
        inside = ~own & F.coalesce(F.col("ecosystem") == e, F.lit(False))
        built = F.coalesce(F.col("vendor_type").isin(*stack), F.lit(False))
        counts |= {f"vendor_stack_{e}_paragraphs": inside & built, f"vendor_entsw_{e}_paragraphs": inside & ~built}
    terms = F.array_sort(F.collect_set(F.when(~own, F.col("term")))).alias("vendor_terms")
    per = m.groupBy(document).agg(*[units(rule).alias(n) for n, rule in counts.items()], terms)
    out = documents.join(per, document, "left").fillna(0, subset=list(counts)).withColumn("vendor_terms", F.coalesce("vendor_terms", F.array().cast("array<string>")))
    return out.withColumns({n.removesuffix("_paragraphs"): F.col(n) > 0 for n in counts if n.startswith("vendor_")})


def posture_indicators(frames: DataFrame) -> DataFrame:
    """The seven indicators of a frame (rhetoric, concepts, specificity, temporal, is_customer_facing); nulls count as none."""
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False)).cast("double")
    opens = lambda p: F.coalesce(F.exists("concepts", lambda x: x.startswith(p)), F.lit(False)).cast("double")
    return frames.withColumns({
        "promotional_posture": (has("rhetoric", "promotional") + has("rhetoric", "strategic")) / 2, "hedging_posture": has("rhetoric", "hedged"), "risk_orientation": opens("risk_"), "governance_orientation": opens("gov_"),
        "temporal_posture": F.coalesce(F.col("temporal") == "realized", F.lit(False)).cast("double"), "ai_positioning": F.coalesce(F.col("is_customer_facing").cast("double"), F.lit(0.0)),
        "specificity_rate": F.coalesce(F.size("specificity") / 5.0, F.lit(0.0)),
    })


POSTURE = ("promotional_posture", "hedging_posture", "risk_orientation", "governance_orientation", "temporal_posture", "ai_positioning", "specificity_rate")


def posture_rates(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The seven rates and the number of frames per key."""
    return posture_indicators(frames).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in POSTURE], F.count(F.lit(1)).alias("n_posture_frames"))
