"""Company names: normal forms, aliases and similarity, in Arrow batches where built-in functions cannot fold accents."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

# Words that say what a company is in law, not which one it is.
LEGAL = (
    "inc incorporated corp corporation co company companies ltd limited plc holding holdings group the llc lp nv sa ag de new trust intl|class a|class b|cl a|cl b|n v|l p|s a"
)
_FORMS = re.compile(r"\b(?:" + "|".join([*LEGAL.split("|")[0].split(), *LEGAL.split("|")[1:]]) + r")\b")
SHORT = frozenset("inc corp co ltd plc llc the".split())


def normal(name: str | None) -> str:
    """Lower-case ASCII words (and ampersands) with one space between; accents and possessives go."""
    plain = (name or "").replace("’", "'").replace("‘", "'")
    plain = unicodedata.normalize("NFKD", plain).encode("ascii", "ignore").decode().lower()
    return " ".join(re.findall(r"[a-z0-9&]+", re.sub(r"'s\b", " ", plain).replace("'", "")))


def bare(name: str | None) -> str:
    """The normal form without legal forms."""
    return " ".join(_FORMS.sub(" ", normal(name)).split())


def aliases(name: str | None) -> list[str]:
    """Forms a name goes by: bare, its first two words, a distinctive first word, initials; "and" beside "&"."""
    words, every = bare(name).split(), [w for w in normal(name).split() if w not in SHORT]
    out = {" ".join(words)} if len(" ".join(words)) > 1 else set()
    out |= {" ".join(words[:2])} if len(words) > 1 else set()
    out |= {words[0]} if words and (len(words) == 1 or len(words[0]) >= 5) else set()
    out |= {"".join(w[0] for w in some) for some in (words, every) if len(some) > 1}
    out |= {a.replace(" & ", " and ") for a in out}
    return sorted(a for a in out if a)


def similarity(a: str | None, b: str | None) -> float | None:
    """Twice the matching characters over all characters, by longest common blocks."""
    return None if a is None or b is None else SequenceMatcher(None, a, b).ratio()


def _mentions(text: str | None, names: list | None) -> bool:
    """Whether a normal text holds one of the aliases as whole words, or opens with nearly the same letters."""
    inside = f" {normal(text)} "
    tight = bare(text).replace(" ", "")
    for a in names if names is not None else ():
        letters = a.replace(" ", "")
        if f" {a} " in inside or tight == letters:
            return True
        if len(letters) >= 5 and (tight.startswith(letters) or similarity(tight[: len(letters)], letters) >= 0.85):
            return True
        if 4 <= len(tight) and letters.startswith(tight) or len(tight) <= 8 and similarity(tight, letters) >= 0.75:
            return True
    return False


@F.pandas_udf(StringType())
def normal_name(names: pd.Series) -> pd.Series:
    return names.map(normal)


@F.pandas_udf(StringType())
def bare_name(names: pd.Series) -> pd.Series:
    return names.map(bare)


@F.pandas_udf(ArrayType(StringType()))
def alias_forms(names: pd.Series) -> pd.Series:
    return names.map(aliases)


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(BooleanType())
def is_host(host: pd.Series, forms: pd.Series) -> pd.Series:
    """Whether a stated host is the company that goes by these forms."""
    return pd.Series([_mentions(h, f) for h, f in zip(host, forms, strict=True)], dtype=bool)
