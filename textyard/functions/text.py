"""Text cleaning and n-grams as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from textyard.functions.stopwords import ENGLISH

# Patterns of the cleaner. SPACE lists white space in the Unicode sense,
# because the class of Java knows only ASCII and a link would run on past a no-break space.
SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
TAG = r"<[^>]++>"
NOT_ALNUM = rf"[^a-z0-9{SPACE}]"
SPACES = rf"[{SPACE}]+"
WORD = r"[a-z0-9]{2,}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c: Column | str) -> Column:
    """Any value as a string; missing is the empty string."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def trim_space(c: Column | str) -> Column:
    """Strip every kind of white space at both ends; missing is the empty string."""
    return F.regexp_replace(as_text(c), rf"^{SPACES}|{SPACES}$", "")


def strip_urls(c: Column | str) -> Column:
    c = _col(c)
    # The substring test is far cheaper than the pattern and most texts hold no link.
    return F.when(c.contains("http") | c.contains("www."), F.regexp_replace(c, URL, " ")).otherwise(c)


def strip_html(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.contains("<"), F.regexp_replace(c, TAG, " ")).otherwise(c)


def strip_nonalnum(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), NOT_ALNUM, " ")


def normalise_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), SPACES, " "))


def _may_hold_url(raw: Column) -> Column:
    """Cheap test that is true for every text with a link, in whatever case."""
    test = raw.contains("://")
    for end in ("ww.", "wW.", "Ww.", "WW."):
        test = test | raw.contains(end)
    return test


def words(c: Column | str) -> Column:
    """Lower-cased words of two or more letters or digits, links and tags removed.

    One pattern pass does the work of blanking, collapsing, splitting and dropping
    one-letter words: those steps leave exactly the maximal runs of ``[a-z0-9]``. The tests
    look at the raw text so that every step is evaluated once per row.
    """
    raw = as_text(c)
    low = F.lower(raw)
    linkless = F.when(_may_hold_url(raw), F.regexp_replace(low, URL, " ")).otherwise(low)
    tagless = F.when(raw.contains("<"), F.regexp_replace(linkless, TAG, " ")).otherwise(linkless)
    return F.regexp_extract_all(tagless, F.lit(WORD), F.lit(0))


def without_stopwords(tokens: Column | str, stopwords: Sequence[str] = ENGLISH) -> Column:
    tokens = _col(tokens)
    if not stopwords:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*stopwords))


def tokens(c: Column | str, stopwords: Sequence[str] = ENGLISH) -> Column:
    """The full cleaner as an array of tokens."""
    return without_stopwords(words(c), stopwords)


def clean(c: Column | str, stopwords: Sequence[str] = ENGLISH) -> Column:
    """The full cleaner as one blank-separated string."""
    return F.array_join(tokens(c, stopwords), " ")


def ngrams(tokens: Column | str, low: int = 1, high: int = 2) -> Column:
    """Word n-grams of every length ``low..high``, shorter ones first."""
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")
    tokens = _col(tokens)
    gram, kept = tokens, []
    for n in range(1, high + 1):
        if n > 1:
            # zip_with pads the shorter side with null, and concat with null is null
            gram = F.array_compact(
                F.zip_with(gram, F.slice(tokens, n, F.size(tokens)), lambda a, b: F.concat(a, F.lit(" "), b))
            )
        if n >= low:
            kept.append(gram)
    return F.concat(*kept)


def char_ngrams(word: Column | str, low: int = 3, high: int = 6) -> Column:
    """Character n-grams of ``<word>``, the boundary marks included."""
    marked = F.concat(F.lit("<"), _col(word), F.lit(">"))

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        grams = F.transform(starts, lambda i: F.substr(marked, i, F.lit(n)))
        return F.when(F.length(marked) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_length(n) for n in range(low, high + 1)])


def capitalise(c: Column | str) -> Column:
    """First letter upper case, the rest lower case."""
    c = _col(c)
    return F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.lower(F.substr(c, F.lit(2))))
