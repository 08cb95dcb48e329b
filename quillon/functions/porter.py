"""Porter's stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980) with the extensions that are in common use.

The extensions: words of one or two letters stay; a short list of irregular forms; -ies gives -ie in words of four letters,
-ied likewise; a final y turns to i only after a consonant that is not the first letter; -bli, -alli (which goes through
the step once more), -fulli and -logi have rules of their own. Rules are tables; one routine applies them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

# Irregular forms and their stems.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

Test = Callable[[str], bool]


def _form(word: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out.endswith("c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _form(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c"


def _cvc(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; with two letters: vowel, consonant."""
    form = _form(word)
    return form.endswith("cvc") and word[-1] not in "wxy" or form == "vc"


def _over(n: int) -> Test:
    return lambda stem: measure(stem) > n


# Suffixes, what stands in their place, and what the rest must be like. The first suffix that fits decides.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _replace(word: str, rules: list[tuple[str, str, Test]]) -> str:
    for suffix, new, fits in rules:
        if word.endswith(suffix):
            rest = word[: len(word) - len(suffix)]
            return rest + new if fits(rest) else word
    return word


_RULES_2 = [(s, new, _over(0)) for s, new in STEP_2]
_RULES_3 = [(s, new, _over(0)) for s, new in STEP_3]
_RULES_4 = [(s, "", (lambda stem: measure(stem) > 1 and stem[-1:] in ("s", "t")) if s == "ion" else _over(1)) for s in STEP_4]


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    rest = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
    if rest is None:
        return w
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _double(rest):
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if measure(rest) == 1 and _cvc(rest) else rest


def _final_y(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and _form(w[:-1])[-1] == "c" else w


def _second(w: str) -> str:
    if w.endswith("alli") and measure(w[:-4]) > 0:
        return _second(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    return _replace(w, _RULES_2)


def _last(w: str) -> str:
    if w.endswith("e"):
        rest = w[:-1]
        if measure(rest) > 1 or measure(rest) == 1 and not _cvc(rest):
            w = rest
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _second(_final_y(_past(_plural(word))))
    return _last(_replace(_replace(w, _RULES_3), _RULES_4))
