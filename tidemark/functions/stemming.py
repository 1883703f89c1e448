"""English stems by Porter's algorithm of 1980, from its published rules, and folding of accents."""

from __future__ import annotations

import re

#: The published rules of steps 2, 3 and 4, each list tried with the longest ending first.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_PLAIN = re.compile("[a-z]{3,}")


def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    end = max((e for e in rules if word.endswith(e)), key=len, default=None)
    if end is None:
        return word
    stem = word[: -len(end)]
    return stem + rules[end] if _measure(stem) > least else word


def _past(word: str) -> str:
    """Step 1b: endings of the past and of the present participle."""
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        stem = word.removesuffix(end)
        if stem != word:
            if "v" not in _shape(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short(stem) else stem
    return word


def stem(word: str) -> str:
    """Words of three lower-case letters or more; anything else stays as it is."""
    if not _PLAIN.fullmatch(word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _past(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP2, 0), STEP3, 0)
    end = max((e for e in STEP4 if word.endswith(e)), key=len, default=None)
    if end is not None and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
