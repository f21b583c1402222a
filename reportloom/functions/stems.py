"""Stems of English words by Porter's algorithm (Program 14(3), 1980), with its author's later changes and the usual exceptions."""

from __future__ import annotations

import functools
import re

# Words whose stems are set, and the endings of steps 2 to 4 with what takes their place.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """v and c for each letter; y is a vowel behind a consonant."""
    out = ""
    for x in w:
        out += "v" if x in "aeiou" or (x == "y" and out[-1:] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _short(w: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x and y; or is a vowel and a consonant."""
    s = _shape(w)
    return (len(w) > 2 and s.endswith("cvc") and w[-1] not in "wxy") or s == "vc"


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            return w[: len(w) - len(end)] + to
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    for end in ("ed", "ing"):
        body = w[: len(w) - len(end)]
        if w.endswith(end):
            if "v" not in _shape(body):
                return w
            if body.endswith(("at", "bl", "iz")):
                return body + "e"
            if _double(body):
                return body if body[-1] in "lsz" else body[:-1]
            return body + "e" if _measure(body) == 1 and _short(body) else body
    return w


def _longest(w: str, ends) -> str | None:
    return max((e for e in ends if w.endswith(e)), key=len, default=None)


def _step2(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]):
        return _step2(w[:-4] + "al")
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) else w
    end = _longest(w, STEP2)
    return w[: len(w) - len(end)] + STEP2[end] if end and _measure(w[: len(w) - len(end)]) else w


def _step3(w: str) -> str:
    end = _longest(w, STEP3)
    return w[: len(w) - len(end)] + STEP3[end] if end and _measure(w[: len(w) - len(end)]) else w


def _step4(w: str) -> str:
    end = _longest(w, STEP4)
    body = w[: len(w) - len(end)] if end else w
    return body if end and _measure(body) > 1 and (end != "ion" or body[-1:] in ("s", "t")) else w


def _step5(w: str) -> str:
    if w.endswith("e"):
        body = w[:-1]
        if _measure(body) > 1 or (_measure(body) == 1 and not _short(body)):
            w = body
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    return _step5(_step4(_step3(_step2(w))))
