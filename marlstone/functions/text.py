"""Column expressions over text: cleaning, tokens, counts of terms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense, which Java's \s and trim() do not cover.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NO_WORD = r"[^\p{L}\p{N}]+"


def strip(text: Column) -> Column:
    """Remove white space, of any script, from both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalise(text: Column, keep: str = "") -> Column:
    """Keep CJK ideographs, ASCII letters and digits and the characters ``keep``; collapse white space."""
    cleaned = F.regexp_replace(text, rf"[^一-龥a-zA-Z0-9\s{keep}]", " ")
    return F.regexp_replace(F.regexp_replace(cleaned, r"\s+", " "), "^ | $", "")


#: Punctuation that the enhanced normaliser keeps (fixed values).
ENHANCED_KEEP = "，。！？；：（）【】\\-\\."


def tokens(text: Column, lower: bool = True, least: int = 2, lexicon: Sequence[str] = (), stopwords: Sequence[str] = ()) -> Column:
    """Words of letters and digits, in order and with repeats.

    Terms of ``lexicon`` are taken whole, the longest first; a run of CJK
    ideographs that no term covers falls into pairs.  Tokens shorter than
    ``least`` and stopwords are dropped.
    """
    cased = F.lower(text) if lower else text
    if lexicon:
        terms = "|".join(rf"\Q{t}\E" for t in sorted(lexicon, key=len, reverse=True))
        found = F.regexp_extract_all(cased, F.lit(rf"({terms}|[一-龥]{{1,2}}|[\p{{L}}\p{{N}}&&[^一-龥]]+)"), F.lit(1))
    else:  # cutting between words is quicker than taking each of them out; the empty ends go by their length
        found, least = F.split(cased, NO_WORD), max(least, 1)
    if stopwords:
        drop = F.array(*[F.lit(s) for s in stopwords])
        return F.filter(found, lambda t: (F.length(t) >= least) & ~F.array_contains(drop, t))
    return F.filter(found, lambda t: F.length(t) >= least)


def occurrences(text: Column, term: Column | str) -> Column:
    """Non-overlapping occurrences of a non-empty term."""
    term = F.lit(term) if isinstance(term, str) else term
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def first_matching(text: Column, rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    """The label of the first rule whose pattern is found."""
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: within a lambda Spark computes an expression anew for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")
