"""Text cleaning rules as Column -> Column functions. Defaults keep documented quirks; options give the tidy behaviour."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The Turkish letter classes, and what counts as white space at the ends of a text. The rules' patterns below are fixed values too.
UPPER = "A-ZÇĞİÖŞÜ"
LOWER = "a-zçğıöşü"
ASCII_WHITE = "\t\n\f\r "  # what SQL's patterns take for white space
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _sub(c: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(new))


def let(c: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule(c)`` with ``c`` computed once, however often the rule names it. The rule may not hold a Python function."""
    return F.get(F.transform(F.array(c), rule), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.btrim(c, F.lit(WHITE))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Unicode NFKC, null as empty; ASCII text never leaves the JVM."""
    c = F.coalesce(c, F.lit(""))
    return F.coalesce(_nfkc(let(c, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), t))), c)


def escape_decode(c: Column) -> Column:
    """Backslash escapes, one kind after the other."""
    for old, new in ((r"\n", "\n"), (r"\t", "\t"), (r"\r", "\r"), ("\\\\", "\\"), (r"\/", "/"), (r"\"", '"'), (r"\'", "'")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def control_strip(c: Column, newline_policy: str = "drop") -> Column:
    """Drop control, format, surrogate, private and unassigned characters but the two joiners; line breaks and tabs go too unless the policy is ``space``."""
    if newline_policy == "space":
        c = F.translate(c, "\n\r\t", "   ")
    return _sub(c, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}&&[^‌‍]]", "")


def join_abbreviations(c: Column) -> Column:
    return _sub(c, rf"(?U)(?<=\.)\s+(?=[{UPPER}]\.)", "")


def join_spaced(c: Column, letters: str) -> Column:
    """Join three or more single characters of a class that white space sets apart: spaces and tabs between them go, line breaks stay.

    A chain is walked from match to match: its first character sees two more
    ahead, any later one the next; white space that stays is stepped over.
    """
    one = f"[{letters}]"
    first, later = rf"\b(?={one}\s+{one}\s+{one}\b)", rf"\G(?!\A)(?={one}\s+{one}\b)"
    return _sub(c, rf"(?U)(?:{first}|{later})({one})[ \t]*|\G(?!\A)([\s&&[^ \t]])(?=\s*{one}\b)[ \t]*", "$1$2")


def fix_spacing(c: Column) -> Column:
    """Abbreviations, then spaced-out words: upper case, lower case, digits, mixed."""
    for letters in (UPPER, LOWER, r"\d", UPPER + LOWER):
        c = join_spaced(join_abbreviations(c) if letters == UPPER else c, letters)
    return c


def fix_broken_spacing(c: Column) -> Column:
    """The older variant: line breaks to spaces, one mixed pass, white space collapsed."""
    c = join_spaced(join_abbreviations(F.translate(c, "\n\r", "  ")), UPPER + LOWER)
    return strip(_sub(c, r"(?U)\s+", " "))


def join_digits(c: Column) -> Column:
    """White space between any two digits goes, also between two numbers."""
    return _sub(c, r"(?U)(\d)\s+(?=\d)", "$1")


def spaced_article(c: Column) -> Column:
    """``madde 1 2 3`` to ``madde123``; has no work left after :func:`join_digits`."""
    c = _sub(c, r"(?U)(\d)\s+(\d)\s+(\d)\s+(\d)", "$1$2$3$4")
    return _sub(c, r"(?iU)(m\.?|madde)\s*(\d)\s+(\d)\s+(\d)", "$1$2$3$4")


def statute_acronyms(c: Column) -> Column:
    for name in ("TCK", "TMK", "CMK", "HMK"):
        c = _sub(c, r"(?iU)\b" + r"\s*".join(name) + r"\b", name)
    return c


def chamber_refs(c: Column) -> Column:
    c = _sub(c, r"(?iU)\bY\s*2\s*\.\s*H\s*D\b", "Y.2.HD.")
    return _sub(c, r"(?iU)\b(Y)\s*(\d+)\s*(H)\s*(D)\b", "$1$2$3$4")


def ocr(c: Column) -> Column:
    return chamber_refs(statute_acronyms(spaced_article(join_digits(c))))


def numbered_law(c: Column) -> Column:
    return _sub(F.replace(c, F.lit(r"\/"), F.lit("/")), r"(?iU)(\d{3,4})(sayılı|sayili)", "$1 sayılı")


def article_refs(c: Column, idempotent: bool = False) -> Column:
    """Article, paragraph and clause forms; the plain form also lengthens suffixed ones, ``idempotent`` leaves them."""
    for stem, optional, full in (("madde", "s", "maddesi"), ("fıkra", "s", "fıkrası"), ("ben", "d", "bendi")):
        after = rf"(?![{UPPER}{LOWER}])\.?" if idempotent else r"\.?"
        c = _sub(c, rf"(?iU)(\d+)\s*\.\s*{stem}{optional}?{after}", f"$1. {full}")
    return c


def tidy_dates(c: Column) -> Column:
    return _sub(c, r"(?U)(\d{1,2})\s*\.\s*(\d{1,2})\s*\.\s*(\d{4})", "$1.$2.$3")


def law_refs(c: Column) -> Column:
    return tidy_dates(article_refs(numbered_law(c)))


def extract_content(c: Column, white: str = WHITE) -> Column:
    """The body after the first heading that leaves over 100 characters; else what follows 500 characters of a text over 600; else all, without ``white`` at the ends."""
    heads = (r"[İi]çtihat\s*[Mm]etni", "[Kk]arar", "[Hh]üküm")

    def body(t: Column) -> Column:
        found = [F.btrim(F.regexp_extract(t, rf"(?isU){h}\s*:?\s*(.*)", 1), F.lit(white)) for h in heads]
        kept = [let(b, lambda b: F.when(F.length(b) > 100, b)) for b in found]
        return F.coalesce(*kept, F.btrim(F.when(F.length(t) > 600, F.substring(t, 501, 1 << 30)).otherwise(t), F.lit(white)))

    return let(c, body)


def final_cleanup(c: Column, quotes: str = "\"'`", white: str = WHITE) -> Column:
    """One line, single spaces for runs of ``white``, no ``quotes`` at the ends, each kind taken off once in their order; null where empty."""
    runs = r"(?U)\s+" if white == WHITE else f"[{white}]+"
    c = F.btrim(_sub(F.translate(c, "\n\r\t", "   "), runs, " "), F.lit(white))
    for q in quotes:
        c = F.btrim(c, F.lit(q))
    return c


def clean(c: Column, min_length: int = 50, unicode: bool = True) -> Column:
    """The whole chain; null where less than ``min_length`` characters are left."""
    norm = (lambda x: control_strip(escape_decode(nfkc(x)))) if unicode else (lambda x: control_strip(escape_decode(x)))
    c = final_cleanup(law_refs(fix_spacing(ocr(extract_content(norm(norm(c)))))))
    return let(c, lambda t: F.when(F.length(t) >= min_length, t))


def turkish_ratio(c: Column) -> Column:
    return F.try_divide(F.regexp_count(c, F.lit(f"[{UPPER}{LOWER}]")).cast("double"), F.regexp_count(c, F.lit("[a-zA-Z]")))


def search_fold(c: Column, unicode: bool = True) -> Column:
    """Lower case as in Turkish, circumflexes dropped."""
    c = nfkc(c) if unicode else F.coalesce(c, F.lit(""))
    return F.translate(F.lower(F.translate(c, "İI", "iı")), "âîû", "aiu")


def slug(c: Column) -> Column:
    c = F.lower(F.translate(c, "ığüşöç", "igusoc"))
    return strip(_sub(_sub(c, r"(?U)[^\w\s-]", ""), r"(?U)[-\s]+", "_"))


def normalize_term(c: Column, unicode: bool = True) -> Column:
    c = F.btrim(strip(c), F.lit(".,;()[]\"'"))
    return nfkc(c) if unicode else c


def split_terms(c: Column) -> Column:
    """Non-empty parts between commas, semicolons and parentheses."""
    return F.filter(F.transform(F.split(c, "[,;()]"), strip), lambda x: x != "")


def display_token(c: Column) -> Column:
    return F.trim(F.replace(F.replace(c, F.lit("▁"), F.lit(" ")), F.lit("##"), F.lit("")))


def word_count(c: Column) -> Column:
    t = strip(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def snippet(c: Column, n: int = 200) -> Column:
    return F.substring(c, 1, n)
