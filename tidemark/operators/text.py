"""Sections to paragraphs to sentences, lexicons and text signals: built-in functions on the row that holds the text.

Nothing here shuffles: a section's lines are an array, neighbours are array positions, and runs are slices, so the split
scales with the scan. Only the exploded result is a new row set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import fold_lower, trim_zs

# Patterns and word lists that decide which lines and words count.
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LINK = r"\[([^\]]*)\]\([^)]*\)"
LINK_MARK = "\x01"
_B = r"[\t\n\f\r \xA0]"
NAVIGATION = rf"(?i)^{_B}*(Tables?({_B}*of{_B}*Contents?)?[.`]?{_B}*)?(Index{_B}+to{_B}+Financial{_B}+Statements?[.`]?{_B}*)?$"
ABBREVIATIONS = (
    "Mr|Mrs|Ms|Dr|Jr|Sr|Prof|Rev|Gen|Sen|Rep|Gov|Lt|Col|Capt|Cmdr|Sgt|vs|etc|al|Inc|Corp|Co|Ltd|LLC|No|St|Ave|Blvd|Fig|Vol|pp|cf|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|Mon|Tue|Wed|Thu|Fri|Sat|Sun"
)
COMPOUNDS = r"U\.S|U\.K|i\.e|e\.g|a\.m|p\.m"
MASK, CUT = "\x1e", "\x1f"


def scorable(text: Column) -> Column:
    return (F.length(trim_zs(text)) > 3) & text.rlike("[A-Za-z0-9]")


def split_paragraphs(sections: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, content_type, paragraph_index (1-based line of its first line), paragraph_text, is_scorable.

    Null texts give no rows. Consecutive table lines are one paragraph, consecutive list lines too.
    """
    own = [F.col(k) for k in keys]
    raw = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct((i + 1).cast("long").alias("at"), trim_zs(F.regexp_replace(F.regexp_replace(x, IMAGE, ""), LINK, LINK_MARK)).alias("t")))
    bare = lambda x: F.btrim(x, F.lit("` "))
    df = sections.where(F.col(text).isNotNull()).select(*own, F.filter(raw, lambda x: (x["t"] != "") & ~x["t"].rlike("^[0-9]+$") & ~bare(x["t"]).rlike(NAVIGATION)).alias("__l"))
    piped = lambda i: F.coalesce(F.get("__l", i)["t"].contains("|"), F.lit(False))
    dash = lambda x: F.btrim(x["t"], F.lit("- ")) == ""
    kind = lambda x, i: (
        F.when(x["t"].contains("|"), "table").when(dash(x) & (piped(i - 1) | piped(i + 1)), "table").when(dash(x), "none")
        .when(x["t"].startswith("•") | x["t"].rlike(r"^[-*][\t\n\f\r ]"), "list").otherwise("prose")
    )
    df = df.select(*own, F.transform("__l", lambda x, i: F.struct(x["at"].alias("at"), x["t"].alias("t"), kind(x, i).alias("k"))).alias("__k"))
    df = df.select(*own, F.filter("__k", lambda x: x["k"] != "none").alias("__k"))
    fresh = F.filter(F.transform("__k", lambda x, i: F.when((x["k"] == "prose") | F.coalesce(F.get("__k", i - 1)["k"] != x["k"], F.lit(True)), i)), lambda i: i.isNotNull())
    df = df.select(*own, "__k", fresh.alias("__s"))
    end = lambda i: F.coalesce(F.get("__s", i + 1), F.size("__k"))
    runs = F.transform("__s", lambda s, i: F.struct(
        F.get("__k", s)["k"].alias("content_type"), F.get("__k", s)["at"].alias("paragraph_index"),
        F.array_join(F.transform(F.slice("__k", s + 1, end(i) - s), lambda x: x["t"]), "\n").alias("paragraph_text"),
    ))
    # the outer form, because for the inner one the optimizer infers a filter that would compute the array twice
    df = df.select(*own, F.explode_outer(runs).alias("__p")).where(F.col("__p").isNotNull())
    return df.select(*own, "__p.*").withColumn("is_scorable", scorable(F.col("paragraph_text")))


def _mask(x: Column) -> Column:
    edge = r"(?<![A-Za-z0-9_])"
    x = F.regexp_replace(x, rf"(?i){edge}({ABBREVIATIONS})\.", "$1" + MASK)
    return F.regexp_replace(x, rf"(?i){edge}({COMPOUNDS})\.", "$1" + MASK)


def _cells(x: Column) -> Column:
    """Sentences of prose packed into table cells; the text itself where it is a plain table."""
    packed = (F.length(x) >= 300) & ((F.regexp_count(x, F.lit(r"\|")) >= 6) | (F.regexp_count(x, F.lit("---")) >= 2) | (F.regexp_count(x, F.lit("●")) >= 2))
    strip = lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(x, "\n", -1), strip), lambda v: v != "")
    cell = lambda v: strip(F.regexp_replace(strip(v), "^●+", ""))
    of_line = lambda v: F.when(
        F.size(F.split(v, r"\|", -1)) >= 3, F.filter(F.transform(F.split(v, r"\|", -1), cell), lambda c: (F.length(c) > 15) & ~c.rlike("^-{2,}$"))
    ).otherwise(F.filter(F.array(v), lambda c: F.length(c) > 15))
    parts = F.flatten(F.transform(F.flatten(F.transform(lines, of_line)), lambda c: F.split(c, r"(?<=[.!?])\s+(?=[A-Z])", -1)))
    kept = F.filter(F.transform(parts, strip), lambda v: F.length(v) > 10)
    single = F.filter(kept, lambda v, i: (i == 0) | (v != F.get(kept, i - 1)))
    return F.when(packed & (F.size(single) > 0), single).otherwise(F.array(x))


def split_sentences(paragraphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, content_type, paragraph_index, sentence_index (from 1), sentence_text."""
    t = F.col("paragraph_text")
    prose = F.transform(F.split(F.regexp_replace(_mask(t), r"([.!?]+)[\t\n\f\r ]+([A-Z])", f"$1{CUT}$2"), CUT, -1), lambda x: F.replace(x, F.lit(MASK), F.lit(".")))
    some = F.when(F.col("content_type") == "prose", prose).when(F.col("content_type") == "list", F.split(t, "\n", -1)).otherwise(_cells(t))
    own = [*keys, "content_type", "paragraph_index"]
    out = paragraphs.select(*own, F.posexplode_outer(some).alias("__i", "sentence_text"))
    blank = (F.col("content_type") == "prose") & (trim_zs(F.col("sentence_text")) == "")
    return out.where(F.col("sentence_text").isNotNull() & ~blank).select(*own, (F.col("__i") + 1).cast("long").alias("sentence_index"), "sentence_text")


def unique_texts(instances: DataFrame, key: str, order: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per key: its smallest instance (by `order`) and duplicate_count. Combined before the shuffle."""
    one = F.struct(*order, *[c for c in carry if c not in order])
    out = instances.groupBy(key).agg(F.min(one).alias("__one"), F.count(F.lit(1)).alias("duplicate_count"))
    return out.select(key, "__one.*", "duplicate_count")


def broadcast_back(instances: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """What was derived once per distinct text, on every instance. A hot text is left to skew-join handling."""
    return instances.join(derived, key, "left")


def lexical_score(df: DataFrame, text: str, strong: Sequence[str], weak: Sequence[str]) -> DataFrame:
    """strong_terms and weak_terms (in list order), strong and weak flags.

    A text is folded once and searched once: at every word start the longest listed term that ends at a word end is
    taken, and a term counts as found too where a longer one begins with it.
    """
    import re

    terms = sorted({*strong, *weak}, key=lambda t: (-len(t), t))
    begins = {t: [x for x in terms if x == t or (x.startswith(t) and not x[len(t)].isalnum())] for t in terms}
    some = "|".join(re.escape(t) for t in terms)
    hits = F.array_distinct(F.regexp_extract_all(F.col("__low"), F.lit(f"(?<![a-z0-9])(?=({some})(?![a-z0-9]))"), F.lit(1))) if terms else F.array().cast("array<string>")
    found = lambda own: F.array_compact(F.array(*[F.when(F.arrays_overlap("__hits", F.array(*[F.lit(x) for x in begins[t]])), F.lit(t)) for t in own])) if own else F.array().cast("array<string>")
    out = df.withColumn("__low", fold_lower(F.col(text))).withColumn("__hits", hits)
    out = out.withColumn("strong_terms", found(strong)).withColumn("weak_terms", found(weak)).drop("__low", "__hits")
    return out.withColumn("strong", F.size("strong_terms") > 0).withColumn("weak", F.size("weak_terms") > 0)


def term_sentences(sentences: DataFrame, keys: Sequence[str], text: str, terms: Sequence[str], score: Column, longer_than: int = 15) -> DataFrame:
    """keys, n, most, least, mean of a score over the sentences that hold a term and are longer than so many characters."""
    some = sentences.where((F.length(text) > longer_than) & fold_lower(F.col(text)).rlike(entity_pattern(terms)))
    return some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(score).cast("long").alias("most"), F.min(score).cast("long").alias("least"), F.avg(score).alias("mean"))


def entity_pattern(names: Sequence[str]) -> str:
    """Any of the names, not inside a longer word; to be found in folded text."""
    import re

    return "(^|[^a-z0-9])(" + "|".join(re.escape(n).replace(r"\ ", " ") for n in names) + ")([^a-z0-9]|$)"


def with_override(df: DataFrame, text: str, probability: str, threshold: float, names: Sequence[str]) -> DataFrame:
    """named_entity_match and is_prefiltered: the model's probability reaches the threshold, or a name is mentioned.

    A null text mentions nothing, a null probability reaches nothing.
    """
    named = F.coalesce(fold_lower(F.col(text)).rlike(entity_pattern(names)), F.lit(False))
    return df.withColumn("named_entity_match", named).withColumn("is_prefiltered", F.coalesce(F.col(probability) >= threshold, F.lit(False)) | F.col("named_entity_match"))


def semantic_score(vectors: DataFrame, vec: str, anchors: Mapping[str, Sequence[Sequence[float]]], negative: str = "negative") -> DataFrame:
    """Per category the largest dot product, the margin of the best over the negatives, and the best category.

    anchors are a short configured list, so they are literals of the plan; ties go to the first category.
    """
    dot = lambda a: F.aggregate(F.zip_with(F.col(vec), F.array(*[F.lit(float(x)) for x in a]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = {c: F.greatest(*[dot(a) for a in rows]) if len(rows) > 1 else dot(rows[0]) for c, rows in anchors.items()}
    out = vectors.select("*", *[v.alias(f"score_{c}" if c != negative else "negative_similarity") for c, v in best.items()])
    names = [c for c in anchors if c != negative]
    top = F.greatest(*[F.col(f"score_{c}") for c in names]) if len(names) > 1 else F.col(f"score_{names[0]}")
    out = out.withColumn("max_score", top)
    which: Column | None = None
    for c in names:
        hit = F.col(f"score_{c}") == F.col("max_score")
        which = F.when(hit, c) if which is None else which.when(hit, c)
    return out.withColumn("best_anchor", which).withColumn("margin", F.col("max_score") - F.col("negative_similarity"))


# Contexts in which a term is no disclosure, what makes a sentence the company's own, and the default terms.
BIO = r"mr\.|ms\.|mrs\.|dr\.|director since|age [0-9]{2}|ph\.d|founder of|served as"
VOTE = "stockholder proposal|shareholder proposal|votes cast|broker non-vote|abstentions"
RULE = "federal register|final rule|executive order|export control"
FIRST_PERSON = "we|our|us|the company"
TERMS = (
    "ai|ml|llm|llms|agi|nlp|gen[ ]ai|artificial[ ]intelligence|generative[ ]ai|genai|machine[ ]learning|deep[ ]learning|"
    "large[ ]language[ ]models?|foundation[ ]models?|neural[ ]networks?"
)
SPELLED_OUT = (
    "artificial intelligence", "generative ai", "gen ai", "machine learning", "deep learning", "large language model", "large language models",
    "foundation model", "foundation models", "neural network", "neural networks",
)
FEATURES = (
    "log_len", "strong_per_1k", "first_person_per_100w", "pipe_rate", "bullet_rate", "digit_rate", "bio_context", "vote_context", "rule_context", "acronym_only",
    "ai_sent_share", "ai_sent_first_person", "log_n_sentences", "anchor_gap", "anchor_mean",
)


def text_features(df: DataFrame, text: str, term: str = TERMS, spelled_out: Sequence[str] = SPELLED_OUT, terms: str | None = None, anchors: Sequence[str] = ()) -> DataFrame:
    """df with the FEATURES of a text: its length, what it is dense in, where it comes from, and its sentences.

    term is the lexicon's alternation; terms names the array of terms found (acronym_only needs it), anchors the columns
    of similarities (anchor_gap and anchor_mean need two or more). A feature that lacks its input is null.
    """
    whole = lambda p: rf"(?<![A-Za-z0-9_])({p})(?![A-Za-z0-9_])"
    pieces = F.filter(F.regexp_extract_all("__t", F.lit(r"[^.!?\n|]+"), F.lit(0)), lambda s: F.length(s) > 2)
    base = df.withColumn("__t", fold_lower(F.coalesce(F.col(text), F.lit("")))).withColumn("__s", pieces)
    length, n_sentences = F.greatest(F.length("__t"), F.lit(1)), F.greatest(F.size("__s"), F.lit(1))
    n_words = F.regexp_count("__t", F.lit(r"[\t\n\f\r ]+")) + 1
    per = lambda p, scale, of: F.regexp_count("__t", F.lit(p)) * float(scale) / of
    about = F.filter("__s", lambda s: s.rlike(whole(term)))
    found: dict[str, Column] = {"log_len": F.log(length + F.lit(1.0)), "log_n_sentences": F.log(n_sentences + F.lit(1.0))}
    for name, pattern, scale, of in (
        ("strong_per_1k", whole(term), 1000, length), ("first_person_per_100w", whole(FIRST_PERSON), 100, n_words), ("pipe_rate", r"\|", 100, length), ("bullet_rate", "•", 100, length), ("digit_rate", "[0-9]", 100, length),
    ):
        found[name] = per(pattern, scale, of)
    for name, pattern in (("bio_context", BIO), ("vote_context", VOTE), ("rule_context", RULE)):
        found[name] = F.col("__t").rlike(pattern)
    found["ai_sent_share"] = F.size(about) / n_sentences
    found["ai_sent_first_person"] = F.exists(about, lambda s: s.rlike(whole(FIRST_PERSON)))
    found["acronym_only"] = F.lit(None).cast("boolean") if terms is None else (F.size(terms) > 0) & ~F.arrays_overlap(F.col(terms), F.array(*[F.lit(x) for x in spelled_out]))
    ranked = F.sort_array(F.array(*[F.col(c).cast("double") for c in anchors]), asc=False) if len(anchors) > 1 else None
    found["anchor_gap"] = F.lit(None).cast("double") if ranked is None else F.get(ranked, 0) - F.get(ranked, 1)
    found["anchor_mean"] = F.lit(None).cast("double") if ranked is None else F.aggregate(ranked, F.lit(0.0), lambda a, x: a + x) / len(anchors)
    return base.select(*df.columns, *[found[name].alias(name) for name in FEATURES])


def call_turns(turns: DataFrame, key: str, order: str, speaker: str, text: str, operator: str, handoff: str) -> DataFrame:
    """section (prepared, handoff, qa, unknown), block_type and 0-based paragraph_index of each turn with words.

    The first operator turn never hands over. A later one does if its wording says so, or, as the operator's second
    turn after another speaker's. Without a hand-over every turn is unknown.
    """
    from pyspark.sql import Window

    body = F.btrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    df = turns.withColumn("__body", body).where("__body != ''").withColumn("__op", F.coalesce(F.col(speaker).rlike(operator), F.lit(False)))
    w = Window.partitionBy(key).orderBy(order, "__body")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__n", F.sum(F.col("__op").cast("int")).over(upto)).withColumn("__others", F.sum((~F.col("__op")).cast("int")).over(upto)).withColumn("paragraph_index", (F.row_number().over(w) - 1).cast("long"))
    hands = F.col("__op") & (F.col("__n") > 1) & (F.col("__body").rlike(handoff) | ((F.col("__n") == 2) & (F.col("__others") > 0)))
    df = df.withColumn("__at", F.min(F.when(hands, F.col("paragraph_index"))).over(Window.partitionBy(key)))
    df = df.withColumn("__last", F.max("paragraph_index").over(Window.partitionBy(key)))
    i = F.col("paragraph_index")
    section = F.when(F.col("__at").isNull() | (F.col("__at") == F.col("__last")), "unknown").when(i < F.col("__at"), "prepared").when(i == F.col("__at"), "handoff").otherwise("qa")
    block = F.when(F.col("__op"), "operator").otherwise("speaker_turn")
    return df.select(key, "paragraph_index", section.alias("section"), block.alias("block_type"), F.col(speaker).alias("speaker"), F.col("__body").alias("paragraph_text"))
