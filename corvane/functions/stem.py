"""Stemmers for English and French after the published Snowball algorithms, as an Arrow function."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = "aeiouy"
#: Words with a stem of their own, and those that end early.
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **dict.fromkeys("sky news howe atlas cosmos bias andes".split()),
}
_STOP_EARLY = set("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "ization": "ize", "ational": "ate", "ousness": "ous", "iveness": "ive", "fulness": "ful", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "fulli": "ful", "ousli": "ous", "iviti": "ive", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()


def _region(word: str, start: int, vowels: str) -> int:
    """Place after the first non-vowel that follows a vowel, from ``start`` on."""
    for k in range(start + 1, len(word)):
        if word[k] not in vowels and word[k - 1] in vowels:
            return k + 1
    return len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    if len(word) < 3:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word] or word
    w = word.replace("’", "'").lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    for prefix in ("gener", "commun", "arsen"):
        if w.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        r1 = _region(w, 0, _VOWELS)
    r2 = _region(w, r1, _VOWELS)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWELS}]", w[:-2]):
        w = w[:-1]
    if w in _STOP_EARLY:
        return w.lower()
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m[1] in ("eed", "eedly"):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif m and re.search(f"[{_VOWELS}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    w = _replace(w, r1, r2)
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _replace(w: str, r1: int, r2: int) -> str:
    """Steps 2 to 4: the longest suffix counts, and only in its region."""
    for end in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1:
                if end == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif end == "li":
                    w = w[:at] if w[at - 1 : at] in tuple("cdeghkmnrt") else w
                else:
                    w = w[:at] + _STEP2[end]
            break
    for end in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if end == "ative":
                w = w[:at] if at >= r2 else w
            elif at >= r1:
                w = w[:at] + _STEP3[end]
            break
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    return w


_FR = "aeiouyâàëéêèïîôûù"


@lru_cache(maxsize=200_000)
def french(word: str) -> str:
    w = re.sub(r"(?<=[%s])[ui](?=[%s])" % (_FR, _FR), lambda m: m[0].upper(), word)
    w = re.sub(r"(?<=[%s])y|y(?=[%s])" % (_FR, _FR), "Y", w)
    w = w.replace("qu", "qU")
    if re.match(r"[%s]{2}" % _FR, w) or w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        rv = next((k + 1 for k in range(1, len(w)) if w[k] in _FR), len(w))
    rv = min(rv, len(w))
    r1 = _region(w, 0, _FR)
    r2 = _region(w, r1, _FR)
    start = w
    w, verb = _french_nouns(w, rv, r1, r2)
    if w == start or verb:
        before = w
        w = _french_verbs(w, rv)
        changed = w != before or w != start
    else:
        changed = True
    if changed:
        if w.endswith("Y"):
            w = w[:-1] + "i"
        elif w.endswith("ç"):
            w = w[:-1] + "c"
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        if w.endswith("ion") and len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st":
            w = w[:-3]
        elif (m := re.search(r"(ière|Ière|ier|Ier)$", w)) and m.start() >= rv:
            w = w[: m.start()] + "i"
        elif w.endswith("e") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(r"[éè]([^%s]+)$" % _FR, r"e\1", w)
    return w.lower()


def _french_nouns(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """Step 1; whether verb endings are to be tried all the same."""
    m = re.search(
        r"(ances?|iqUes?|ismes?|ables?|istes?|eux|atrices?|ateurs?|ations?|logies?|usions?|utions?|ences?|issements?|amment|emment|ements?|ments?|ités?|ifs?|ives?|euses?|eaux|aux)$", w
    )
    if not m:
        return w, False
    end, at = m[1], m.start()
    body = w[:at]
    if re.fullmatch(r"ances?|iqUes?|ismes?|ables?|istes?|eux", end):
        return (body, False) if at >= r2 else (w, False)
    if re.fullmatch(r"atrices?|ateurs?|ations?", end):
        if at < r2:
            return w, False
        if body.endswith("ic"):
            body = body[:-2] if len(body) - 2 >= r2 else body[:-2] + "iqU"
        return body, False
    for pattern, new in ((r"logies?", "log"), (r"usions?|utions?", "u"), (r"ences?", "ent")):
        if re.fullmatch(pattern, end):
            return (body + new, False) if at >= r2 else (w, False)
    if re.fullmatch(r"issements?", end):
        return (body, False) if at >= r1 and body and body[-1] not in _FR else (w, False)
    if end == "amment":
        return (body + "ant", True) if at >= rv else (w, False)
    if end == "emment":
        return (body + "ent", True) if at >= rv else (w, False)
    if re.fullmatch(r"ements?", end) and at >= rv:
        if body.endswith("iv") and len(body) - 2 >= r2:
            body = body[:-2]
            if body.endswith("at") and len(body) - 2 >= r2:
                body = body[:-2]
        elif body.endswith("eus"):
            body = body[:-3] if len(body) - 3 >= r2 else body[:-3] + "eux" if len(body) - 3 >= r1 else body
        elif body.endswith(("abl", "iqU")):
            body = body[:-3] if len(body) - 3 >= r2 else body
        elif body.endswith(("ièr", "Ièr")):
            body = body[:-3] + "i" if len(body) - 3 >= rv else body
        return body, False
    if (m := re.search(r"ments?$", w)) and m.start() - 1 >= rv and w[m.start() - 1] in _FR:
        return w[: m.start()], True
    if re.fullmatch(r"ités?", end):
        if at < r2:
            return w, False
        if body.endswith("abil"):
            body = body[:-4] if len(body) - 4 >= r2 else body[:-4] + "abl"
        elif body.endswith("ic"):
            body = body[:-2] if len(body) - 2 >= r2 else body[:-2] + "iqU"
        elif body.endswith("iv") and len(body) - 2 >= r2:
            body = body[:-2]
        return body, False
    if re.fullmatch(r"ifs?|ives?", end):
        if at < r2:
            return w, False
        if body.endswith("at") and len(body) - 2 >= r2:
            body = body[:-2]
            if body.endswith("ic"):
                body = body[:-2] if len(body) - 2 >= r2 else body[:-2] + "iqU"
        return body, False
    if end == "eaux":
        return w[:-1], False
    if end == "aux":
        return (body + "al", False) if at >= r1 else (w, False)
    if re.fullmatch(r"euses?", end):
        return (body, False) if at >= r2 else (body + "eux", False) if at >= r1 else (w, False)
    return w, False


def _french_verbs(w: str, rv: int) -> str:
    m = re.search(
        r"(issaIent|issantes|iraIent|issante|issants|issions|irions|issais|issait|issant|issent|issiez|issons|irais|irait|irent|iriez|irons|iront|isses|issez|îmes|îtes|irai|iras|irez|isse|ies|ira|ît|ie|ir|is|it|i)$", w[rv:]
    )
    if m and (at := rv + m.start()) - 1 >= rv and w[at - 1] not in _FR:
        return w[:at]
    part = w[rv:]
    m = re.search(
        r"(eraIent|assions|erions|assent|assiez|èrent|erais|erait|eriez|erons|eront|aIent|antes|asses|ions|erai|eras|erez|âmes|âtes|ante|ants|asse|ées|era|iez|ais|ait|ant|ée|és|er|ez|ât|ai|as|é|a)$", part
    )
    if m:
        end, at = m[1], rv + m.start()
        if end == "ions":
            return w
        w = w[:at]
        if re.fullmatch(r"âmes|ât|âtes|a|ai|aIent|ais|ait|ant|ante|antes|ants|as|asse|assent|asses|assiez|assions", end) and w.endswith("e") and len(w) - 1 >= rv:
            w = w[:-1]
    return w


STEMMERS = {"en": english, "fr": french}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem(tokens: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if ts is None else [t if t[:1].isdigit() else STEMMERS.get(lang, english)(t) for t in ts] for ts, lang in zip(tokens, language, strict=True)])


def stem_tokens(tokens: Column, language: Column) -> Column:
    """Stems of an array of tokens; numbers stay."""
    return _stem(tokens, language)
