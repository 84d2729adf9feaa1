"""Stemmers of German, Spanish and French by Snowball's public descriptions."""

from __future__ import annotations

import functools
import re


def _after(w: str, vowels: str, start: int = 0) -> int:
    """Behind the first non-vowel that follows a vowel."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(w, start)
    return m.end() if m else len(w)


def _longest(w: str, endings, region: int = 0) -> str:
    """The longest of the endings that the word has within a region."""
    return max((e for e in endings if len(w) - len(e) >= region and w.endswith(e)), key=len, default="")


# German ------------------------------------------------------------------------------------------------------------

#: Fixed values of the descriptions: vowels and endings.
DE_VOWELS = "aeiouyäöü"


@functools.lru_cache(200_000)
def german(word: str) -> str:
    v = DE_VOWELS
    w = re.sub(f"(?<=[{v}])([uy])(?=[{v}])", lambda m: m[1].upper(), word.replace("ß", "ss"))
    r1 = _after(w, v)
    r2 = _after(w, v, r1)
    r1 = max(r1, min(3, len(w)))
    end = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if end and len(w) - len(end) >= r1 and (end != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = _longest(w, ("en", "er", "est", "st"))
    if end and len(w) - len(end) >= r1 and (end != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(end)]
    end = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    stem = w[: len(w) - len(end)]
    if end and len(stem) >= r2:
        if end in ("end", "ung"):
            w = stem[:-2] if stem.endswith("ig") and len(stem) - 2 >= r2 and not stem.endswith("eig") else stem
        elif end in ("ig", "ik", "isch"):
            w = w if stem.endswith("e") else stem
        elif end in ("lich", "heit"):
            w = stem[:-2] if stem.endswith(("er", "en")) and len(stem) - 2 >= r1 else stem
        else:
            more = _longest(stem, ("lich", "ig"), r2)
            w = stem[: len(stem) - len(more)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


# Spanish -----------------------------------------------------------------------------------------------------------

ES_VOWELS = "aeiouáéíóúü"
ES_PLAIN = str.maketrans("áéíóú", "aeiou")
ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
ES_DELETE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
ES_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
ES_REPLACE = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
ES_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran "
    "asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis "
    "asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _region_es(w: str) -> int:
    v = ES_VOWELS
    if len(w) < 2:
        return len(w)
    if w[1] not in v:
        m = re.compile(f"[{v}]").search(w, 2)
        return m.end() if m else len(w)
    if w[0] in v:
        m = re.compile(f"[^{v}]").search(w, 2)
        return m.end() if m else len(w)
    return min(3, len(w))


@functools.lru_cache(200_000)
def spanish(word: str) -> str:
    v, w = ES_VOWELS, word
    rv, r1 = _region_es(w), _after(w, v)
    r2 = _after(w, v, r1)
    if end := _longest(w, ES_PRONOUNS, rv):
        stem = w[: -len(end)]
        before = _longest(stem, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"), rv)
        if before in ("iéndo", "ándo", "ár", "ér", "ír"):
            w = stem[: -len(before)] + before.translate(ES_PLAIN)
        elif before and (before != "yendo" or stem.endswith("uyendo")):
            w = stem
    done = w
    end = _longest(w, (*ES_DELETE, *ES_IC, *ES_REPLACE, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"))
    stem = w[: len(w) - len(end)]
    two = lambda s, *ends: s[: len(s) - len(_longest(s, ends, r2))]
    if end == "amente" and len(stem) >= r1:
        w = stem
        if w.endswith("iv") and len(w) - 2 >= r2:
            w = two(w[:-2], "at")
        else:
            w = two(w, "os", "ic", "ad")
    elif end and len(stem) >= r2 and end != "amente":
        if end in ES_DELETE:
            w = stem
        elif end in ES_IC:
            w = two(stem, "ic")
        elif end in ES_REPLACE:
            w = stem + ES_REPLACE[end]
        elif end == "mente":
            w = two(stem, "ante", "able", "ible")
        elif end in ("idad", "idades"):
            w = two(stem, "abil", "ic", "iv")
        else:
            w = two(stem, "at")
    if w == done:
        end = _longest(w, ES_Y, rv)
        if end and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        elif end := _longest(w, ("en", "es", "éis", "emos", *ES_VERBS), rv):
            w = w[: -len(end)]
            if end in ("en", "es", "éis", "emos") and w.endswith("gu"):
                w = w[:-1]
    if end := _longest(w, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv):
        w = w[: -len(end)]
        if end in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(ES_PLAIN)


# French ------------------------------------------------------------------------------------------------------------

FR_VOWELS = "aeiouyâàëéêèïîôûù"
FR_DELETE = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
FR_IC = "atrice ateur ation atrices ateurs ations".split()
FR_REPLACE = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
FR_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes "
    "issants isse issent isses issez issiez issions issons it"
).split()
FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


@functools.lru_cache(200_000)
def french(word: str) -> str:
    v = FR_VOWELS
    w = re.sub("(?<=q)u", "U", word)
    w = re.sub(f"(?<=[{v}])([ui])(?=[{v}])|(?<=[{v}])(y)|(y)(?=[{v}])", lambda m: m[0].upper(), w)
    if re.match(f"[{v}]{{2}}|par|col|tap", w):
        rv = min(3, len(w))
    else:
        m = re.compile(f"[{v}]").search(w, 1)
        rv = m.end() if m else len(w)
    r1 = _after(w, v)
    r2 = _after(w, v, r1)
    start = w
    w, verbs = _standard_fr(w, v, rv, r1, r2)
    if verbs:
        before = w
        end = _longest(w, FR_I, rv)
        stem = w[: len(w) - len(end)]
        if end and len(stem) > rv and stem[-1] not in v:
            w = stem
        if w == before:
            end = _longest(w, ("ions", *FR_E, *FR_A), rv)
            stem = w[: len(w) - len(end)]
            if end == "ions":
                w = stem if len(stem) >= r2 else w
            elif end in FR_E:
                w = stem
            elif end:
                w = stem[:-1] if stem.endswith("e") and len(stem) > rv else stem
    if w != start:
        w = w[:-1] + {"Y": "i", "ç": "c"}.get(w[-1:], w[-1:])
    else:
        if re.search("[^aiouès]s$", w):
            w = w[:-1]
        end = _longest(w, ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"), rv)
        stem = w[: len(w) - len(end)]
        if end == "ion":
            w = stem if len(stem) >= r2 and len(stem) > rv and stem.endswith(("s", "t")) else w
        elif end in ("ier", "ière", "Ier", "Ière"):
            w = stem + "i"
        elif end == "e" or end == "ë" and stem.endswith("gu"):
            w = stem
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    return re.sub(f"[éè](?=[^{v}]+$)", "e", w).lower()


def _standard_fr(w: str, v: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """(the word without a standard ending, whether verb endings are to be tried)."""
    own = ("ement", "ements", "ité", "ités", "if", "ive", "ifs", "ives", "eaux", "aux", "euse", "euses", "issement", "issements", "amment", "emment", "ment", "ments")
    end = _longest(w, (*FR_DELETE, *FR_IC, *FR_REPLACE, *own))
    s = w[: len(w) - len(end)]
    n = len(s)
    if not end:
        return w, True

    def ic(s: str) -> str:
        return s if not s.endswith("ic") else s[:-2] if len(s) - 2 >= r2 else s[:-2] + "iqU"

    if end in FR_DELETE or end in FR_IC or end in FR_REPLACE:
        if n < r2:
            return w, True
        return (s if end in FR_DELETE else ic(s) if end in FR_IC else s + FR_REPLACE[end]), False
    if end in ("ement", "ements"):
        if n < rv:
            return w, True
        if s.endswith("iv") and n - 2 >= r2:
            s = s[:-2]
            s = s[:-2] if s.endswith("at") and len(s) - 2 >= r2 else s
        elif s.endswith("eus"):
            s = s[:-3] if n - 3 >= r2 else s[:-1] + "x" if n - 3 >= r1 else s
        elif s.endswith(("abl", "iqU")):
            s = s[:-3] if n - 3 >= r2 else s
        elif s.endswith(("ièr", "Ièr")):
            s = s[:-3] + "i" if n - 3 >= rv else s
        return s, False
    if end in ("ité", "ités"):
        if n < r2:
            return w, True
        if s.endswith("abil"):
            s = s[:-4] if n - 4 >= r2 else s[:-4] + "abl"
        elif s.endswith("ic"):
            s = ic(s)
        elif s.endswith("iv") and n - 2 >= r2:
            s = s[:-2]
        return s, False
    if end in ("if", "ive", "ifs", "ives"):
        if n < r2:
            return w, True
        return (ic(s[:-2]) if s.endswith("at") and n - 2 >= r2 else s), False
    if end == "eaux":
        return s + "eau", False
    if end == "aux":
        return (s + "al", False) if n >= r1 else (w, True)
    if end in ("euse", "euses"):
        return (s, False) if n >= r2 else (s + "eux", False) if n >= r1 else (w, True)
    if end in ("issement", "issements"):
        return (s, False) if n >= r1 and s[-1:] not in (*v, "") else (w, True)
    if end in ("amment", "emment"):
        return (s + end[0] + "nt", True) if n >= rv else (w, True)
    return (s, True) if n > rv and s[-1] in v else (w, True)


def stemmer(language: str | None):
    """The stemmer of a known language; words of those without one stay as they are."""
    from quire.functions.stemmer import stem

    return {"english": stem, "german": german, "spanish": spanish, "french": french}.get(language or "english", str)
