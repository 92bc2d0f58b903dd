"""Porter's stemmer with the customary extensions, for ROUGE.

M. F. Porter, An algorithm for suffix stripping, 1980. Extensions: a few whole words with
fixed stems, "ies" and "ied" of four-letter words, a final y after a consonant, and the
suffixes "alli", "fulli" and "logi" in step 2.
"""

from __future__ import annotations

from functools import lru_cache

#: Words with stems of their own.
WHOLE = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffixes of steps 2 to 4, in the order in which they are tried.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(w: str) -> str:
    """v for a vowel and c for a consonant at each letter; y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(w):
        vowel = ch in "aeiou" or ch == "y" and k > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return _kinds(stem).count("vc")


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c"


def _short_end(w: str) -> bool:
    """Consonant, vowel and a consonant other than w, x and y at the end; or a vowel and a consonant alone."""
    kinds = _kinds(w)
    return kinds[-3:] == "cvc" and w[-1] not in "wxy" or kinds == "vc"


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
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        stem = w[: -len(end)]
        if w.endswith(end) and "v" in _kinds(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _doubled(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return w


def _last_y(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and _kinds(w[:-1])[-1] == "c" else w


def _second(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _second(w[:-2])
    for end, new in STEP2:
        if w.endswith(end):
            kept = w[:-3] if end == "logi" else w[: -len(end)]
            return w[: -len(end)] + new if _measure(kept) > 0 else w
    return w


def _third(w: str) -> str:
    for end, new in STEP3:
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + new if _measure(stem) > 0 else w
    return w


def _fourth(w: str) -> str:
    for end in STEP4:
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem if _measure(stem) > 1 and (end != "ion" or stem[-1] in "st") else w
    return w


def _final(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short_end(stem):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@lru_cache(100_000)
def stem(word: str) -> str:
    """Stem of a lower-case word."""
    if word in WHOLE:
        return WHOLE[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _last_y, _second, _third, _fourth, _final):
        word = step(word)
    return word
