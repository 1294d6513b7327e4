"""Stemmers of languages as tables of rules, applied to columns of token arrays and to single words of queries.

A stemmer is a list of steps.  A step has rules (suffix, what takes its place, a pattern that the rest has to meet); the first rule whose
suffix a word ends in is the step's only one, and changes the word if the rest meets the pattern.  English is Porter's algorithm
(1980), German, French and Spanish are Savoy's light or minimal stemmers (2006); words are folded before.  Chinese, Japanese and Korean
are cut into overlapping pairs of characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str, str]


@dataclass(frozen=True)
class Stemmer:
    """``least``: shorter words stay as they are.  A word marked with ``~`` meets no rule but those for the mark."""

    steps: tuple[tuple[Rule, ...], ...]
    least: int = 3

    def column(self, words: Column) -> Column:
        """Stems of an array of folded words."""
        stems = words
        for step in self.steps:
            stems = F.transform(stems, _changer(step))
        return F.zip_with(words, stems, lambda w, s: F.when(F.length(w) < self.least, w).otherwise(s))

    def word(self, word: str) -> str:
        stem = word
        for step in self.steps:
            for suffix, other, rest in step:
                if stem.endswith(suffix):
                    if re.search(rest, stem[: len(stem) - len(suffix)]):
                        stem = stem[: len(stem) - len(suffix)] + other
                    break
        return word if len(word) < self.least else stem


def _changer(step: tuple[Rule, ...]) -> Callable[[Column], Column]:
    def changed(w: Column) -> Column:
        out = None
        for suffix, other, rest in step:
            kept = F.substring(w, F.lit(1), F.length(w) - len(suffix))
            new = F.concat(kept, F.lit(other))
            new = F.when(kept.rlike(rest), new).otherwise(w) if rest else new
            out = F.when(w.endswith(suffix), new) if out is None else out.when(w.endswith(suffix), new)
        return out.otherwise(w)

    return changed


def _ordered(pairs: str, rest: str) -> tuple[Rule, ...]:
    """Rules ``suffix:other``, the longest suffix first."""
    rules = [(*p.split(":"), "")[:2] for p in pairs.split()]
    return tuple((a, b, rest) for a, b in sorted(rules, key=lambda r: -len(r[0])))


# fixed values: Porter's rules.  C is a run of consonants, V one of vowels; y is a vowel behind a consonant
C, V, LETTER = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*", "[aeiouy]"
SOME, MANY = f"({C})?{V}{C}", f"({C})?{V}{C}{V}{C}"  # measure above 0, above 1
SHORT = f"{C}{LETTER}[^aeiouwxy]$"
HAS_VOWEL = f"^({C})?{LETTER}"
ENGLISH = Stemmer(
    (
        (("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", "")),
        (("eed", "ee", f"^{SOME}"), ("ed", "~", HAS_VOWEL), ("ing", "~", HAS_VOWEL)),
        (*((f"{x}~", f"{x}e", "") for x in ("at", "bl", "iz")), *((f"{x}{x}~", x, "") for x in "bcdfghjkmnpqrtvwxy"), ("~", "e~", f"^{SHORT}")),
        (("~", "", ""),),
        (("y", "i", HAS_VOWEL),),
        _ordered("ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble", f"^{SOME}"),
        _ordered("icate:ic ative: alize:al iciti:ic ical:ic ful: ness:", f"^{SOME}"),
        (("ement", "", f"^{MANY}"), ("ion", "", f"^(?=.*[st]$){MANY}"), *_ordered("ment: ance: ence: able: ible: ant: ent: ism: ate: iti: ous: ive: ize: al: er: ic: ou:", f"^{MANY}")),
        (("e", "", f"^(?!{SHORT}){SOME}"),),
        (("l", "", f"^(?=.*l$){MANY}"),),
    )
)
# fixed values: Savoy's rules
GERMAN = Stemmer(
    (
        (("ern", "", "^.{3}"), *((x, "", "^.{3}") for x in ("em", "en", "er", "es", "e")), ("s", "", "^.{2,}[bdfghklmnt]$")),
        (("est", "", "^.{3}"), ("er", "", "^.{3}"), ("en", "", "^.{3}"), ("st", "", "^.{2,}[bdfghklmnt]$")),
    )
)
FRENCH = Stemmer(
    ((("aux", "al~", ""), ("x", "~", "")), (("s", "", ""),), (("r", "", ""),), (("e", "", ""),), (("e", "", ""),), tuple((x + x, x, "") for x in "abcdefghijklmnopqrstuvwxyz"), (("~", "", ""),)),
    least=6,
)
SPANISH = Stemmer(((("eses", "es", ""), ("ces", "z", ""), *((x, "", "") for x in ("os", "as", "es", "o", "a", "e"))),), least=5)

STEMMERS = {"eng": ENGLISH, "ger": GERMAN, "fre": FRENCH, "spa": SPANISH}
PAIRED = ("chi", "jpn", "kor")
LANGUAGES = (*STEMMERS, *PAIRED)
#: Runs of characters that are cut into pairs.
RUN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー]+"
_RUN = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯ー\U00020000-\U0003ffff]+")


def pairs(c: Column) -> Column:
    """Overlapping pairs of the characters of each run; a single character is by itself."""
    runs = F.regexp_extract_all(c, F.lit(RUN), F.lit(0))
    cut = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
    return F.flatten(cut)


def text_pairs(s: str) -> list[str]:
    return [run[i : i + 2] for run in _RUN.findall(s) for i in range(max(len(run) - 1, 1))]
