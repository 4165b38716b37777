"""Porter's suffix stripping of English words (M. F. Porter, "An algorithm for suffix stripping", 1980)."""

from __future__ import annotations

import re

#: The published suffix rules, in their order.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for k, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and k and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    """Number of vowel runs that a consonant run follows."""
    return len(re.findall("v+c+", shape(word)))


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def replaced(word: str, rules, least: int) -> str:
    """The longest suffix that a rule names gives way, if what's before it has a measure above least."""
    hits = [(old, new) for old, new in rules if word.endswith(old)]
    if not hits:
        return word
    old, new = max(hits, key=lambda r: len(r[0]))
    base = word[: -len(old)]
    return base + new if measure(base) > least else word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        base = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else None
        if base is not None and "v" in shape(base):
            if base.endswith(("at", "bl", "iz")):
                word = base + "e"
            elif doubled(base) and base[-1] not in "lsz":
                word = base[:-1]
            else:
                word = base + "e" if measure(base) == 1 and short_end(base) else base
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(word, STEP_2, 0)
    word = replaced(word, STEP_3, 0)
    ends = [s for s in STEP_4 if word.endswith(s)]
    if ends:
        base = word[: -len(max(ends, key=len))]
        if measure(base) > 1 and (max(ends, key=len) != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word
