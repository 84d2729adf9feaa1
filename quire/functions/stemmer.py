"""English stemming by the public Porter2 description, and the names of the languages a query may ask for."""

from __future__ import annotations

import functools
import re

#: Snowball's languages and their two-letter codes.
LANGUAGES = {"arabic": "ar", "danish": "da", "dutch": "nl", "english": "en", "finnish": "fi", "french": "fr", "german": "de", "greek": "el", "hungarian": "hu", "italian": "it", "norwegian": "no", "portuguese": "pt", "romanian": "ro", "russian": "ru", "spanish": "es", "swedish": "sv", "tamil": "ta", "turkish": "tr"}
CODES = {code: name for name, code in LANGUAGES.items()} | {"nb": "norwegian", "nn": "norwegian"}

V = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words with stems of their own, and words left after the first step.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SAME = frozenset("sky news howe atlas cosmos bias andes".split())
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def language(name: str | None) -> str | None:
    """The language of a name or code; None if it is unknown."""
    name = (name or "").strip().lower()
    return name if name in LANGUAGES else CODES.get(name)


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile(f"[{V}][^{V}]").search(w, start)
        return m.end() if m else len(w)

    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else after(0)
    return r1, after(r1)


def _short_syllable(w: str) -> bool:
    return bool(re.search(f"[^{V}][{V}][^{V}wxY]$", w) or re.fullmatch(f"[{V}][^{V}]", w))


@functools.lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2 or not word.isascii():
        return word
    w = word.lstrip("'")
    if w in SPECIAL:
        return SPECIAL[w]
    if w in SAME:
        return w
    w = re.sub(f"(^|[{V}])y", lambda m: m[1] + "Y", w)
    r1, r2 = _regions(w)
    w = re.sub("'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{V}].+s$", w):
        w = w[:-1]
    if w in KEPT:
        return w.lower()
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    elif m := re.match(f"(.*[{V}].*?)(?:ingly|edly|ing|ed)$", w):
        w = m[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    end = max((s for s in STEP2 if w.endswith(s)), key=len, default="")
    if end and len(w) - len(end) >= r1 and not (end == "ogi" and not w.endswith("logi")) and not (end == "li" and not re.search("[cdeghkmnrt]li$", w)):
        w = w[: -len(end)] + STEP2[end]
    end = max((s for s in STEP3 if w.endswith(s)), key=len, default="")
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP3[end]
    end = max((s for s in STEP4 if w.endswith(s)), key=len, default="")
    if end and len(w) - len(end) >= r2 and not (end == "ion" and not re.search("[st]ion$", w)):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
