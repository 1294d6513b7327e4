"""Analysers and normalisers, as column expressions and as the same functions of Python strings.

``fold`` removes accents from Latin letters and spells ligatures out; the table follows from Unicode's
compatibility decompositions.  ``tokens`` is the analyser of full-text fields: folded, lower-cased runs of letters and
digits, and for a word that signs split into parts also all its parts joined; a sign & by itself is read as "and".  A language's own
analyser stems those tokens (``functions.stemming``).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import stemming

#: Letters that fold to two, as fixed values.
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ﬁ": "fi", "ﬂ": "fl"}
#: Letters with a stroke, which have no decomposition, as fixed values.
STROKED = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ı": "i"}


def _table() -> dict[str, str]:
    out = dict(STROKED)
    for code in range(0xC0, 0x250):
        letter = chr(code).lower()
        plain = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if len(letter) == 1 and len(plain) == 1 and plain != letter:
            out[letter] = plain
    return out


FOLDED = _table()
_FROM, _TO = "".join(FOLDED), "".join(FOLDED.values())
SPLIT = r"[^\p{L}\p{N}]+"


def fold(c: Column) -> Column:
    """Lower case without accents."""
    out = F.translate(F.lower(c), _FROM, _TO)
    for letter, plain in SPELLED.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def fold_text(s: str) -> str:
    s = "".join(FOLDED.get(c, c) for c in s.lower())
    for letter, plain in SPELLED.items():
        s = s.replace(letter, plain)
    return s


#: What the analyser of full-text fields reads in place of what, as fixed values.
READ_AS = (" & ", " and ")
#: Pattern that texts with at least one token have, as they are.
WORDED = r"[\p{L}\p{N}]|" + READ_AS[0]


def read(c: Column) -> Column:
    """Folded text as the analyser reads it.  Text of one byte a character has nothing to fold but capitals."""
    out = F.replace(c, *map(F.lit, READ_AS))
    return F.when(F.octet_length(c) == F.length(c), F.lower(out)).otherwise(fold(out))


def read_text(s: str) -> str:
    return fold_text(s.replace(*READ_AS))


def parts(word: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(word, SPLIT), lambda x: x != "")


def base_tokens(c: Column) -> Column:
    """Tokens in text order, without joined parts; phrases are matched on these."""
    return parts(read(c))


def tokens(c: Column) -> Column:
    """All tokens a full-text search can meet."""
    words = F.transform(F.filter(F.split(read(c), r"\s+"), lambda w: w != ""), parts)
    return F.flatten(F.transform(words, lambda p: F.when(F.size(p) > 1, F.array_append(p, F.array_join(p, ""))).otherwise(p)))


#: A word in white space that signs split into parts.
_SPLIT_WORD = r"(?<!\S)[^\p{L}\p{N}\s]*+[\p{L}\p{N}]++[^\p{L}\p{N}\s]++[\p{L}\p{N}]\S*+"


def joined(read_text: Column) -> Column:
    """Tokens that are all parts of a word, of a text that is read: ``tokens`` are these and ``parts``, in another order."""
    return F.transform(F.regexp_extract_all(read_text, F.lit(_SPLIT_WORD), F.lit(0)), lambda w: F.regexp_replace(w, SPLIT, ""))


def text_tokens(s: str) -> list[str]:
    """Tokens of a query term."""
    return [t for t in re.split(r"[^\w]+|_+", read_text(s)) if t]


def language_tokens(language: str, c: Column, every: bool = True) -> Column:
    """Tokens of a text in a language, with the joined ones if ``every``."""
    if language in stemming.PAIRED:
        return stemming.pairs(c)
    return stemming.STEMMERS[language].column(tokens(c) if every else base_tokens(c))


def language_words(language: str, s: str) -> list[str]:
    """The same of a query term."""
    if language in stemming.PAIRED:
        return stemming.text_pairs(s)
    return [stemming.STEMMERS[language].word(w) for w in text_tokens(s)]


def _literal(word: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in word)


def token_pattern(word: str) -> str:
    """Regular expression that finds ``word`` among the tokens of a folded text: as a run of letters and digits, or as all that a word
    in white space has of them."""
    inside, gap = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}\s]*"
    spread = gap.join(_literal(c) for c in word)
    return rf"(?<!{inside}){_literal(word)}(?!{inside})|(?<!\S){gap}{spread}{gap}(?!\S)"


def phrase_pattern(words: list[str]) -> str:
    """Regular expression that finds ``words`` one behind the other among the tokens of a folded text."""
    inside = r"[\p{L}\p{N}]"
    return rf"(?<!{inside}){SPLIT.join(map(_literal, words))}(?!{inside})"


#: Normalisers of keyword types: (column expression, Python function).
NORMALISERS: dict[str, tuple[Callable[[Column], Column], Callable[[str], str]]] = {
    "keyword": (lambda c: c, lambda s: s),
    "keyword_lowercase": (lambda c: F.trim(F.lower(c)), lambda s: s.lower().strip(" ")),
    "keyword_lowercase_folded": (fold, fold_text),
    "keyword_uppercase": (lambda c: F.upper(F.trim(fold(c))), lambda s: fold_text(s).strip(" ").upper()),
    "keyword_icu": (lambda c: F.trim(fold(c)), lambda s: fold_text(s).strip(" ")),
    "keyword_trimmed": (lambda c: F.trim(fold(c)), lambda s: fold_text(s).strip(" ")),
    "keyword_no_space_dash": (lambda c: F.trim(F.lower(F.regexp_replace(c, "[ -]", ""))), lambda s: re.sub("[ -]", "", s).lower().strip(" ")),
    "source": (lambda c: c, lambda s: s),
}
TEXT = ("standard", "multilang", "whitespace")
#: Type of the normalised copy of a full-text field.
PLAIN = {"standard": "keyword_icu", "multilang": "keyword_icu", "whitespace": "keyword_trimmed"}


def normalised(kind: str, c: Column) -> Column:
    return NORMALISERS[PLAIN.get(kind, kind)][0](c) if PLAIN.get(kind, kind) in NORMALISERS else c


def normalised_text(kind: str, s: str) -> str:
    return NORMALISERS[PLAIN.get(kind, kind)][1](s) if PLAIN.get(kind, kind) in NORMALISERS else s


def truncated(c: Column, most: int = 32_000) -> Column:
    """The longest start of at most ``most`` bytes of UTF-8, cut between characters."""
    raw = F.encode(c, "UTF-8")

    def inside(at: int) -> Column:  # a byte 10xxxxxx continues a character
        return F.conv(F.hex(F.substring(raw, F.lit(at), F.lit(1))), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) == 0x80

    back = F.when(~inside(most + 1), 0).when(~inside(most), 1).when(~inside(most - 1), 2).otherwise(3)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substring(raw, F.lit(1), F.lit(most) - back), "UTF-8"))
