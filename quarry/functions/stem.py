"""English stems by the public Snowball rules (Porter2), a word at a time.

Columns use it through `quarry.functions.text`, which stems whole arrays of a
batch and remembers the words it has seen.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Fixed values of the Snowball rules: words with stems of their own, words that stay, words that stay after the plural has gone.
SPECIAL = dict(p.split(">") for p in "skis>ski skies>sky dying>die lying>lie tying>tie idly>idl gently>gentl ugly>ugli early>earli only>onli singly>singl".split())
KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
KEPT_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Beginnings after which the first region starts.
BEGINNINGS = ("gener", "commun", "arsen")
#: Suffixes of the second and third step with what replaces them, and those that the fourth deletes; the longest that fits counts.
SECOND = dict(
    p.split(">")
    for p in (
        "tional>tion enci>ence anci>ance abli>able entli>ent izer>ize ization>ize ational>ate ation>ate ator>ate alism>al aliti>al alli>al fulness>ful "
        "ousli>ous ousness>ous iveness>ive iviti>ive biliti>ble bli>ble ogi>og fulli>ful lessli>less li>"
    ).split()
)
THIRD = dict(p.split(">") for p in "tional>tion ational>ate alize>al icate>ic iciti>ic ical>ic ful> ness> ative>".split())
FOURTH = tuple("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())

_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _region(word: str, start: int = 0) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    suffix = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return w
    rest = w[: -len(suffix)]
    if suffix.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else w
    if not _VOWEL.search(rest):
        return w
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _DOUBLE.search(rest):
        return rest[:-1]
    return rest + "e" if len(rest) <= r1 and _SHORT_END.search(rest) else rest


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of other scripts stay as they are."""
    w = word.lstrip("'")
    if len(w) <= 2:
        return w
    if w in SPECIAL or w in KEPT:
        return SPECIAL.get(w, w)
    # A y that stands for a consonant is written large meanwhile.
    w = re.sub("(^|(?<=[aeiouy]))y", "Y", w)
    start = next((b for b in BEGINNINGS if w.startswith(b)), None)
    r1 = len(start) if start else _region(w)
    r2 = _region(w, r1)
    w = re.sub("('s'|'s|')$", "", w)
    w = _plural(w)
    if w in KEPT_LATER:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    suffix = _longest(w, SECOND)
    if suffix and len(w) - len(suffix) >= r1:
        rest = w[: -len(suffix)]
        if not (suffix == "ogi" and not rest.endswith("l")) and not (suffix == "li" and rest[-1:] not in set("cdeghkmnrt")):
            w = rest + SECOND[suffix]
    suffix = _longest(w, THIRD)
    if suffix and len(w) - len(suffix) >= (r2 if suffix == "ative" else r1):
        w = w[: -len(suffix)] + THIRD[suffix]
    suffix = _longest(w, FOURTH)
    if suffix and len(w) - len(suffix) >= r2 and (suffix != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(suffix)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
