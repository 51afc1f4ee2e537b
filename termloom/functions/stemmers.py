"""Suffix-stripping stemmers of the published Snowball family, fourteen variants.

Words are Python strings of lower-case letters; positions are code points. Each language is a
function ``word -> stem``. ``stem`` looks a language up by name or alias. The English variant keeps
``-ful`` in its third step, so ``beautiful`` stays whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache


class Word:
    """A word that is cut from its end, with its regions."""

    __slots__ = ("s", "p1", "p2", "pv")

    def __init__(self, s: str):
        self.s = s
        self.p1 = self.p2 = self.pv = len(s)

    def ends(self, suffixes: "Suffixes", least: int = 0) -> str | None:
        """The longest listed suffix that lies at or after place ``least``."""
        s = self.s
        for n in suffixes.lengths:
            if n <= len(s) - least and s[len(s) - n :] in suffixes.all:
                return s[len(s) - n :]
        return None

    def at(self, suffix: str) -> int:
        return len(self.s) - len(suffix)

    def r1(self, suffix: str) -> bool:
        return self.p1 <= self.at(suffix)

    def r2(self, suffix: str) -> bool:
        return self.p2 <= self.at(suffix)

    def rv(self, suffix: str) -> bool:
        return self.pv <= self.at(suffix)

    def put(self, suffix: str, new: str = "") -> bool:
        self.s = self.s[: self.at(suffix)] + new
        return True

    def before(self, suffix: str, letters: str) -> bool:
        """Whether the letter before the suffix is one of ``letters``."""
        i = self.at(suffix)
        return i > 0 and self.s[i - 1] in letters

    def not_before(self, suffix: str, letters: str) -> bool:
        """Whether there is a letter before the suffix and it is none of ``letters``."""
        i = self.at(suffix)
        return i > 0 and self.s[i - 1] not in letters

    def drop(self, suffix: str, test: Callable[[str], bool]) -> bool:
        """Take the suffix off if the word ends so and the region test holds."""
        return self.s.endswith(suffix) and test(suffix) and self.put(suffix)


class Suffixes:
    def __init__(self, *groups: str):
        self.case = {x: i for i, g in enumerate(groups, 1) for x in g.split()}
        self.all = frozenset(self.case)
        self.lengths = sorted({len(x) for x in self.all}, reverse=True)


def past(s: str, letters: str, start: int, inside: bool = True) -> int | None:
    """The place after the first letter from ``start`` that is (not) one of ``letters``."""
    for i in range(start, len(s)):
        if (s[i] in letters) == inside:
            return i + 1
    return None


def regions(w: Word, vowels: str, start: int = 0) -> None:
    """p1 and p2: after the first non-vowel that follows a vowel, and again from there."""
    for name in ("p1", "p2"):
        a = past(w.s, vowels, start)
        b = past(w.s, vowels, a, False) if a is not None else None
        if b is None:
            return
        setattr(w, name, b)
        start = b


# Fixed values here and before each language below: the published algorithms' vowels, suffixes and replacements.

# English and Porter

_EN_V = "aeiouy"
_EN_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EN_WHOLE = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl") | {x: x for x in "sky news howe atlas cosmos bias andes".split()}
_EN_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_EN_1B = Suffixes("eed eedly", "ed edly ing ingly")
_EN_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble",
}
_EN_2_ALL = _EN_2 | {"bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_PO_2_ALL = _EN_2 | {"eli": "e"}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ative": ""}
_PO_3 = {"alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ative": "", "ful": "", "ness": ""}
_EN_4 = "ic ance ence able ible ate ive ize iti al ism er ous ant ent ment ement ion"
_EN_S2, _PO_S2, _EN_S3, _PO_S3, _EN_S4, _PO_S4 = (Suffixes(" ".join(x)) for x in (_EN_2_ALL, _PO_2_ALL, _EN_3, _PO_3, _EN_4.split(), [*_EN_4.split(), "ou"]))


def _mark_y(s: str) -> str:
    out = list(s)
    for i, c in enumerate(out):
        if c == "y" and (i == 0 or out[i - 1] in _EN_V):
            out[i] = "Y"
    return "".join(out)


def _short(s: str) -> bool:
    """Ends in non-vowel (not w, x, Y), vowel, non-vowel."""
    return len(s) > 2 and s[-1] not in _EN_V + "wxY" and s[-2] in _EN_V and s[-3] not in _EN_V


def _short_english(s: str) -> bool:
    return _short(s) or (len(s) == 2 and s[0] in _EN_V and s[1] not in _EN_V)


def english(word: str) -> str:
    if word in _EN_WHOLE:
        return _EN_WHOLE[word]
    if len(word) < 3:
        return word
    w = Word(_mark_y(word[1:] if word[0] == "'" else word))
    start = next((len(x) for x in ("commun", "gener") if w.s.startswith(x)), None)
    if start is None:
        regions(w, _EN_V)
    else:
        w.p1 = start
        a = past(w.s, _EN_V, start)
        b = past(w.s, _EN_V, a, False) if a is not None else None
        w.p2 = len(w.s) if b is None else b
    for x in ("'s'", "'s", "'"):
        if w.s.endswith(x):
            w.put(x)
            break
    if w.s.endswith("sses"):
        w.put("sses", "ss")
    elif w.s.endswith(("ied", "ies")):
        w.put(w.s[-3:], "i" if len(w.s) > 4 else "ie")
    elif w.s.endswith("s") and not w.s.endswith(("us", "ss")) and any(c in _EN_V for c in w.s[:-2]):
        w.put("s")
    if w.s in _EN_AFTER_1A:
        return w.s.replace("Y", "y")
    x = w.ends(_EN_1B)
    if x and _EN_1B.case[x] == 1:
        if w.r1(x):
            w.put(x, "ee")
    elif x and any(c in _EN_V for c in w.s[: w.at(x)]):
        w.put(x)
        if w.s.endswith(("at", "bl", "iz")):
            w.s += "e"
        elif w.s.endswith(_EN_DOUBLE):
            w.s = w.s[:-1]
        elif w.p1 == len(w.s) and _short_english(w.s):
            w.s += "e"
    if w.s[-1:] in ("y", "Y") and len(w.s) > 2 and w.s[-2] not in _EN_V:
        w.put("y", "i")
    x = w.ends(_EN_S2)
    if x and w.r1(x) and (x != "ogi" or w.before(x, "l")) and (x != "li" or w.before(x, "cdeghkmnrt")):
        w.put(x, _EN_2_ALL[x])
    x = w.ends(_EN_S3)
    if x and w.r1(x) and (x != "ative" or w.r2(x)):
        w.put(x, _EN_3[x])
    x = w.ends(_EN_S4)
    if x and w.r2(x) and (x != "ion" or w.before(x, "st")):
        w.put(x)
    if w.s.endswith("e"):
        if w.r2("e") or (w.r1("e") and not _short_english(w.s[:-1])):
            w.put("e")
    elif w.s.endswith("ll") and w.r2("l"):
        w.put("l")
    return w.s.replace("Y", "y")


def porter(word: str) -> str:
    w = Word(_mark_y(word))
    regions(w, _EN_V)
    for x, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.s.endswith(x):
            w.put(x, new)
            break
    if w.s.endswith("eed"):
        if w.r1("eed"):
            w.put("eed", "ee")
    else:
        x = next((x for x in ("ing", "ed") if w.s.endswith(x)), None)
        if x and any(c in _EN_V for c in w.s[: w.at(x)]):
            w.put(x)
            if w.s.endswith(("at", "bl", "iz")):
                w.s += "e"
            elif w.s.endswith(_EN_DOUBLE):
                w.s = w.s[:-1]
            elif w.p1 == len(w.s) and _short(w.s):
                w.s += "e"
    if w.s[-1:] in ("y", "Y") and any(c in _EN_V for c in w.s[:-1]):
        w.put("y", "i")
    x = w.ends(_PO_S2)
    if x and w.r1(x):
        w.put(x, _PO_2_ALL[x])
    x = w.ends(_PO_S3)
    if x and w.r1(x):
        w.put(x, _PO_3[x])
    x = w.ends(_PO_S4)
    if x and w.r2(x) and (x != "ion" or w.before(x, "st")):
        w.put(x)
    if w.s.endswith("e") and (w.r2("e") or (w.r1("e") and not _short(w.s[:-1]))):
        w.put("e")
    if w.s.endswith("ll") and w.r2("l"):
        w.put("l")
    return w.s.replace("Y", "y")


# Scandinavian


def _nordic(word: str, vowels: str) -> Word:
    w = Word(word)
    if len(word) >= 3:
        a = past(word, vowels, 0)
        b = past(word, vowels, a, False) if a is not None else None
        if b is not None:
            w.p1 = max(b, 3)
    return w


def _pair(w: Word, pairs: Suffixes) -> None:
    if w.ends(pairs, w.p1):
        w.s = w.s[:-1]


_DA_V = "aeiouyæåø"
_DA_1 = Suffixes("hed ethed ered erede e ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret", "s")
_DA_PAIR = Suffixes("gd dt gt kt")
_DA_3 = Suffixes("elig els ig lig", "løst")


def danish(word: str) -> str:
    w = _nordic(word, _DA_V)
    x = w.ends(_DA_1, w.p1)
    if x and (x != "s" or w.before("s", "abcdfghjklmnoprtvyzå")):
        w.put(x)
    _pair(w, _DA_PAIR)
    if w.s.endswith("igst"):
        w.put("st")
    x = w.ends(_DA_3, w.p1)
    if x == "løst":
        w.put("løst", "løs")
    elif x:
        w.put(x)
        _pair(w, _DA_PAIR)
    if len(w.s) > max(w.p1, 1) and w.s[-1] not in _DA_V and w.s[-1] == w.s[-2]:
        w.s = w.s[:-1]
    return w.s


_NO_V = "aeiouyæåø"
_NO_1 = Suffixes("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast", "s", "erte ert")
_NO_PAIR = Suffixes("dt vt")
_NO_3 = Suffixes("eleg leg eig ig elig lig els elov lov hetslov slov")


def norwegian(word: str) -> str:
    w = _nordic(word, _NO_V)
    x = w.ends(_NO_1, w.p1)
    if x in ("erte", "ert"):
        w.put(x, "er")
    elif x == "s":
        if w.before("s", "bcdfghjlmnoprtvyz") or (w.before("s", "k") and len(w.s) > 2 and w.s[-3] not in _NO_V):
            w.put("s")
    elif x:
        w.put(x)
    _pair(w, _NO_PAIR)
    x = w.ends(_NO_3, w.p1)
    if x:
        w.put(x)
    return w.s


_SV_V = "aeiouyäåö"
_SV_1 = Suffixes("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast", "s")
_SV_PAIR = Suffixes("dd gd nn dt gt kt tt")
_SV_3 = Suffixes("ig els lig löst fullt")


def swedish(word: str) -> str:
    w = _nordic(word, _SV_V)
    x = w.ends(_SV_1, w.p1)
    if x and (x != "s" or w.before("s", "bcdfghjklmnoprtvy")):
        w.put(x)
    _pair(w, _SV_PAIR)
    x = w.ends(_SV_3, w.p1)
    if x:
        w.put(x, {"löst": "lös", "fullt": "full"}.get(x, ""))
    return w.s


# German and Dutch

_DE_V = "aeiouyäöü"
_DE_1, _DE_2 = Suffixes("ern em er e en es s"), Suffixes("est en er st")
_DE_3 = Suffixes("end ung", "isch ig ik", "heit lich", "keit")
_DE_4 = Suffixes("lich ig")


def _between(s: str, vowels: str, marks: str) -> str:
    """Letters of ``marks`` between two vowels in upper case."""
    out = list(s)
    i = 0
    while i + 2 < len(out):
        if out[i] in vowels and out[i + 1] in marks and out[i + 2] in vowels:
            out[i + 1] = out[i + 1].upper()
            i += 2
        i += 1
    return "".join(out)


def _between_german(s: str) -> str:
    # the vowel after a marked letter may itself stand before the next one
    out = list(s)
    for i in range(1, len(out) - 1):
        if out[i] in "uy" and out[i - 1] in _DE_V and out[i + 1] in _DE_V:
            out[i] = out[i].upper()
    return "".join(out)


def german(word: str) -> str:
    w = Word(_between_german(word.replace("ß", "ss")))
    if len(w.s) >= 3:
        regions(w, _DE_V)
        w.p1 = max(w.p1, 3)
    x = w.ends(_DE_1)
    if x and w.r1(x) and (x != "s" or w.before("s", "bdfghklmnrt")):
        w.put(x)
    x = w.ends(_DE_2)
    if x and w.r1(x) and (x != "st" or (w.before("st", "bdfghklmnt") and len(w.s) >= 6)):
        w.put(x)
    x = w.ends(_DE_3)
    if x and w.r2(x):
        case = _DE_3.case[x]
        if case == 2:
            if not w.before(x, "e"):
                w.put(x)
        else:
            w.put(x)
            if case == 1:
                if w.s.endswith("ig") and not w.before("ig", "e") and w.r2("ig"):
                    w.put("ig")
            elif case == 3:
                if w.s.endswith(("er", "en")) and w.r1("er"):
                    w.s = w.s[:-2]
            else:
                y = w.ends(_DE_4)
                if y and w.r2(y):
                    w.put(y)
    return w.s.translate(str.maketrans("YUäöü", "yuaou"))


_NL_V = "aeiouyè"
_NL_1 = Suffixes("heden", "ene en", "se s")
_NL_4 = Suffixes("end ing", "ig", "lijk", "baar", "bar")


def _undouble_dutch(w: Word) -> None:
    if w.s.endswith(("dd", "kk", "tt")):
        w.s = w.s[:-1]


def _e_ending(w: Word) -> bool:
    if w.s.endswith("e") and w.r1("e") and w.not_before("e", _NL_V):
        w.put("e")
        _undouble_dutch(w)
        return True
    return False


def _en_ending(w: Word, x: str) -> None:
    if w.r1(x) and w.not_before(x, _NL_V) and not w.s[: w.at(x)].endswith("gem"):
        w.put(x)
        _undouble_dutch(w)


def dutch(word: str) -> str:
    s = list(word.translate(str.maketrans("áäéëíïóöúü", "aaeeiioouu")))
    if s[:1] == ["y"]:
        s[0] = "Y"
    i = 0
    while i < len(s) - 1:
        if s[i] in _NL_V:
            if s[i + 1] == "i" and i + 2 < len(s) and s[i + 2] in _NL_V:
                s[i + 1] = "I"
                i += 2
            elif s[i + 1] == "y":
                s[i + 1] = "Y"
                i += 1
        i += 1
    w = Word("".join(s))
    regions(w, _NL_V)
    while len(w.s[: w.p1].encode()) < 3 and w.p1 < len(w.s):  # three bytes at least
        w.p1 += 1
    x = w.ends(_NL_1)
    if x == "heden":
        if w.r1(x):
            w.put(x, "heid")
    elif x in ("ene", "en"):
        _en_ending(w, x)
    elif x and w.r1(x) and w.not_before(x, _NL_V + "j"):
        w.put(x)
    e_found = _e_ending(w)
    if w.s.endswith("heid") and w.r2("heid") and not w.before("heid", "c"):
        w.put("heid")
        if w.s.endswith("en"):
            _en_ending(w, "en")
    x = w.ends(_NL_4)
    if x and w.r2(x):
        if x in ("end", "ing"):
            w.put(x)
            if w.s.endswith("ig") and w.r2("ig") and not w.before("ig", "e"):
                w.put("ig")
            else:
                _undouble_dutch(w)
        elif x == "ig":
            if not w.before("ig", "e"):
                w.put("ig")
        elif x == "lijk":
            w.put(x)
            _e_ending(w)
        elif x == "baar" or e_found:
            w.put(x)
    s = w.s
    if len(s) > 3 and s[-1] not in _NL_V + "I" and s[-3:-1] in ("aa", "ee", "oo", "uu") and s[-4] not in _NL_V:
        w.s = s[:-2] + s[-1]
    return w.s.replace("Y", "y").replace("I", "i")


# Finnish

_FI_V1, _FI_V2 = "aeiouyäö", "aeiouäö"
_FI_LONG = ("aa", "ee", "ii", "oo", "uu", "ää", "öö")
_FI_PARTICLE = Suffixes("kin kaan kään ko kö han hän pa pä", "sti")
_FI_POSSESSIVE = Suffixes("si", "ni", "nsa nsä mme nne", "an", "än", "en")
_FI_BEFORE = {"an": ("ta", "ssa", "sta", "lla", "lta", "na"), "än": ("tä", "ssä", "stä", "llä", "ltä", "nä"), "en": ("lle", "ine")}
_FI_CASE = Suffixes("han hen hin hon hän hön siin den tten seen a ä tta ttä ta tä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine n")
_FI_OTHER = Suffixes("mpi mpa mpä mmi mma mmä", "impi impa impä immi imma immä eja ejä")


def _fi_case(w: Word) -> bool:
    s, least = w.s, w.p1
    for n in _FI_CASE.lengths:
        x = s[len(s) - n :] if n <= len(s) - least else ""
        if x not in _FI_CASE.all:
            continue
        rest = s[: len(s) - n]
        if x in ("siin", "den", "tten"):
            if not (len(rest) > 1 and rest[-1] == "i" and rest[-2] in _FI_V2):
                continue  # a condition of the entry itself: a shorter one may do
        elif x == "seen":
            if not rest.endswith(_FI_LONG):
                continue
        elif x in ("han", "hen", "hin", "hon", "hän", "hön"):
            if not rest.endswith(x[1]):
                return False
        elif x in ("a", "ä"):
            if not (len(rest) > 1 and rest[-1] in _FI_V1 and rest[-2] not in _FI_V1):
                return False
        elif x in ("tta", "ttä"):
            if not rest.endswith("e"):
                return False
        elif x == "n" and (rest.endswith(_FI_LONG) or rest.endswith("ie")):
            rest = rest[:-1]
        w.s = rest
        return True
    return False


def finnish(word: str) -> str:
    w = Word(word)
    regions(w, _FI_V1)
    x = w.ends(_FI_PARTICLE, w.p1)
    if x and (w.r2(x) if x == "sti" else w.before(x, "aeinotuyäö")):
        w.put(x)
    x = w.ends(_FI_POSSESSIVE, w.p1)
    if x == "si":
        if not w.before("si", "k"):
            w.put("si")
    elif x == "ni":
        w.put("ni")
        if w.s.endswith("kse"):
            w.put("kse", "ksi")
    elif x in _FI_BEFORE:
        if w.s[: w.at(x)].endswith(_FI_BEFORE[x]):
            w.put(x)
    elif x:
        w.put(x)
    removed = _fi_case(w)
    x = w.ends(_FI_OTHER, w.p2)
    if x and (_FI_OTHER.case[x] == 2 or not w.s[: w.at(x)].endswith("po")):
        w.put(x)
    if removed:
        if len(w.s) > w.p1 and w.s[-1] in "ij":
            w.s = w.s[:-1]
    elif len(w.s) - 1 > w.p1 - 1 and w.s.endswith("t") and len(w.s) - 2 >= w.p1 and w.s[-2] in _FI_V1:
        w.s = w.s[:-1]
        x = next((x for x in ("imma", "mma") if w.s.endswith(x) and w.r2(x)), None)
        if x == "imma" or (x and not w.s[: w.at(x)].endswith("po")):
            w.put(x)
    s, p = w.s, w.p1
    if s.endswith(_FI_LONG) and len(s) - 2 >= p:
        s = s[:-1]
    if len(s) - 2 >= p and s[-1:] in tuple("aeiä") and s[-2] not in _FI_V1:
        s = s[:-1]
    if len(s) - 2 >= p and s.endswith(("oj", "uj")):
        s = s[:-1]
    if len(s) - 2 >= p and s.endswith("jo"):
        s = s[:-1]
    i = len(s) - 1
    while i >= 0 and s[i] in _FI_V1:
        i -= 1
    if i > 0 and s[i - 1] == s[i]:
        s = s[:i] + s[i + 1 :]
    return s


# Romance

_FR_V = "aeiouyâàëéêèïîôûù"
_FR_1 = Suffixes(
    "iqUe iqUes ance ances able ables isme ismes iste istes eux", "ation ations atrice atrices ateur ateurs", "logie logies", "usion usions ution utions", "ence ences", "ement ements",
    "ité ités", "if ifs ive ives", "eaux", "aux", "euse euses", "issement issements", "amment", "emment", "ment ments",
)
_FR_6, _FR_7 = Suffixes("iv eus abl iqU ièr Ièr"), Suffixes("abil ic iv")
_FR_I = Suffixes("i ie ies ir ira irai irais irait iras irent irez iriez irions irons iront iraIent is issais issait issaIent issant issante issantes issants isse issent isses issez issiez issions issons it îmes ît îtes")
_FR_VERB = Suffixes("ions", "é ée ées és èrent er era erai erais erait eraIent eras erez eriez erions erons eront ez iez", "a ai aIent ais ait âmes ant ante antes ants as asse assent asses assiez assions ât âtes")
_FR_REST = Suffixes("ion", "ier ière Ier Ière", "e", "ë")


def _fr_marks(s: str) -> str:
    out, i = list(s), 0
    v = lambda k: k < len(out) and out[k] in _FR_V
    while i < len(out):
        if v(i) and i + 1 < len(out):
            if out[i + 1] in "ui" and v(i + 2):
                out[i + 1] = out[i + 1].upper()
                i += 2
                if out[i - 1] == "U" or out[i - 1] == "I":
                    i += 1
                continue
            if out[i + 1] == "y":
                out[i + 1] = "Y"
                i += 2
                continue
        if out[i] == "y" and v(i + 1):
            out[i] = "Y"
        elif out[i] == "q" and i + 1 < len(out) and out[i + 1] == "u":
            out[i + 1] = "U"
            i += 1
        i += 1
    return "".join(out)


def _fr_standard(w: Word) -> bool:
    x = w.ends(_FR_1)
    if not x:
        return False
    case = _FR_1.case[x]
    if case in (1, 2, 7, 8) and w.r2(x):
        w.put(x)
        if case == 2 and w.s.endswith("ic"):
            w.put("ic", "" if w.r2("ic") else "iqU")
        elif case == 7:
            y = w.ends(_FR_7)
            if y == "iv":
                w.drop("iv", w.r2)
            elif y:
                w.put(y, "" if w.r2(y) else "abl" if y == "abil" else "iqU")
        elif case == 8 and w.drop("at", w.r2) and w.s.endswith("ic"):
            w.put("ic", "" if w.r2("ic") else "iqU")
        return True
    if case in (3, 4, 5) and w.r2(x):
        return w.put(x, {3: "log", 4: "u", 5: "ent"}[case])
    if case == 6 and w.rv(x):
        w.put(x)
        y = w.ends(_FR_6)
        if y == "iv":
            if w.drop("iv", w.r2):
                w.drop("at", w.r2)
        elif y == "eus":
            if w.r2(y):
                w.put(y)
            elif w.r1(y):
                w.put(y, "eux")
        elif y in ("abl", "iqU"):
            w.drop(y, w.r2)
        elif y and w.rv(y):
            w.put(y, "i")
        return True
    if case == 9:
        return w.put(x, "eau")
    if case == 10 and w.r1(x):
        return w.put(x, "al")
    if case == 11:
        if w.r2(x):
            return w.put(x)
        return w.r1(x) and w.put(x, "eux")
    if case == 12 and w.r1(x) and w.not_before(x, _FR_V):
        return w.put(x)
    if case in (13, 14) and w.rv(x):
        w.put(x, "ant" if case == 13 else "ent")
    elif case == 15 and w.before(x, _FR_V) and w.pv <= w.at(x) - 1:
        w.put(x)
    return False  # the last three still take a verb ending off


def _fr_verb(w: Word) -> bool:
    x = w.ends(_FR_I, w.pv)
    if x and w.at(x) - 1 >= w.pv and w.not_before(x, _FR_V):
        return w.put(x)
    x = w.ends(_FR_VERB, w.pv)
    if not x or (x == "ions" and not w.r2(x)):
        return False
    w.put(x)
    if _FR_VERB.case[x] == 3 and w.s.endswith("e") and w.rv("e"):
        w.put("e")
    return True


def french(word: str) -> str:
    w = Word(_fr_marks(word))
    s = w.s
    if len(s) > 2 and s[0] in _FR_V and s[1] in _FR_V:
        w.pv = 3
    else:
        w.pv = past(s, _FR_V, 1) or len(s)
    regions(w, _FR_V)
    if _fr_standard(w) or _fr_verb(w):
        if w.s.endswith("Y"):
            w.put("Y", "i")
        elif w.s.endswith("ç"):
            w.put("ç", "c")
    else:
        if w.s.endswith("s") and w.not_before("s", "aiouès"):
            w.put("s")
        x = w.ends(_FR_REST, w.pv)
        if x == "ion":
            if w.r2(x) and w.before(x, "st") and w.at(x) - 1 >= w.pv:
                w.put(x)
        elif x == "ë":
            if w.s[: w.at(x)].endswith("gu") and w.at(x) - 2 >= w.pv:
                w.put(x)
        elif x:
            w.put(x, "" if x == "e" else "i")
    if w.s.endswith(("enn", "onn", "ett", "ell", "eill")):
        w.s = w.s[:-1]
    i = len(w.s) - 1
    while i >= 0 and w.s[i] not in _FR_V:
        i -= 1
    if 0 <= i < len(w.s) - 1 and w.s[i] in "éè":
        w.s = w.s[:i] + "e" + w.s[i + 1 :]
    return w.s.replace("I", "i").replace("U", "u").replace("Y", "y")


def _romance_regions(w: Word, vowels: str) -> None:
    s = w.s
    if len(s) > 1:
        a, b = s[0] in vowels, s[1] in vowels
        if a and b:
            end = past(s, vowels, 2, False)
        elif not b:
            end = past(s, vowels, 2)
        else:
            end = 3 if len(s) > 2 else None
        w.pv = len(s) if end is None else end
    regions(w, vowels)


_IT_V = "aeiouàèìòù"
_IT_PRONOUN = Suffixes("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene")
_IT_1 = Suffixes(
    "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti", "azione azioni atore atori", "logia logie",
    "uzione uzioni usione usioni", "enza enze", "amento amenti imento imenti", "amente", "ità", "ivo ivi iva ive",
)
_IT_7, _IT_8 = Suffixes("iv os ic abil"), Suffixes("abil ic iv")
_IT_VERB = Suffixes(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti"
    " erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono"
    " issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)


def italian(word: str) -> str:
    s = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = Word(_between(s, _IT_V, "ui"))
    _romance_regions(w, _IT_V)
    x = w.ends(_IT_PRONOUN)
    if x:
        rest = w.s[: w.at(x)]
        for y in ("ando", "endo", "ar", "er", "ir"):
            if rest.endswith(y):
                if w.pv <= len(rest) - len(y):
                    w.put(x, "" if len(y) == 4 else "e")
                break
    if not _it_standard(w):
        x = w.ends(_IT_VERB, w.pv)
        if x:
            w.put(x)
    if w.s[-1:] in tuple("aeioàèìò") and w.rv("a"):
        w.s = w.s[:-1]
        w.drop("i", w.rv)
    if w.s.endswith(("ch", "gh")) and w.rv("ch"):
        w.s = w.s[:-1]
    return w.s.replace("I", "i").replace("U", "u")


def _it_standard(w: Word) -> bool:
    x = w.ends(_IT_1)
    if not x:
        return False
    case = _IT_1.case[x]
    if case == 6:
        return w.rv(x) and w.put(x)
    if case == 7:
        if not w.r1(x):
            return False
        w.put(x)
        y = w.ends(_IT_7)
        if y and w.r2(y):
            w.put(y)
            if y == "iv":
                w.drop("at", w.r2)
        return True
    if not w.r2(x):
        return False
    w.put(x, {3: "log", 4: "u", 5: "ente"}.get(case, ""))
    if case == 2:
        w.drop("ic", w.r2)
    elif case == 8:
        y = w.ends(_IT_8)
        if y and w.r2(y):
            w.put(y)
    elif case == 9 and w.drop("at", w.r2):
        w.drop("ic", w.r2)
    return True


_ES_V = "aeiouáéíóúü"
_ES_PRONOUN = Suffixes("me se sela selo selas selos la le lo las les los nos")
_ES_GERUND = Suffixes("iéndo", "ándo", "ár", "ér", "ír", "ando iendo ar er ir", "yendo")
_ES_1 = Suffixes(
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos", "adora ador ación adoras adores aciones ante antes ancia ancias",
    "logía logías", "ución uciones", "encia encias", "amente", "mente", "idad idades", "iva ivo ivas ivos",
)
_ES_6, _ES_7, _ES_8 = Suffixes("iv os ic ad"), Suffixes("ante able ible"), Suffixes("abil ic iv")
_ES_Y = Suffixes("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_VERB = Suffixes(
    "en es éis emos",
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré"
    " aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais"
    " arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos",
)
_ES_REST = Suffixes("os a o á í ó", "e é")


def _es_standard(w: Word, table: Suffixes, cases: dict[int, str], sixth: Suffixes, seventh: Suffixes, eighth: Suffixes) -> bool:
    """Steps that Spanish and Portuguese share; ``cases``: what the numbered groups are."""
    x = w.ends(table)
    if not x:
        return False
    kind = cases[table.case[x]]
    if kind == "amente":
        if not w.r1(x):
            return False
        w.put(x)
        y = w.ends(sixth)
        if y and w.r2(y):
            w.put(y)
            if y == "iv":
                w.drop("at", w.r2)
        return True
    if kind == "ira":
        return w.rv(x) and w.before(x, "e") and w.put(x, "ir")
    if not w.r2(x):
        return False
    w.put(x, kind[1:] if kind[0] == ">" else "")
    if kind == "ic":
        w.drop("ic", w.r2)
    elif kind in ("mente", "idad"):
        y = w.ends(seventh if kind == "mente" else eighth)
        if y and w.r2(y):
            w.put(y)
    elif kind == "iva":
        w.drop("at", w.r2)
    return True


_ES_CASES = {1: "-", 2: "ic", 3: ">log", 4: ">u", 5: ">ente", 6: "amente", 7: "mente", 8: "idad", 9: "iva"}


def spanish(word: str) -> str:
    w = Word(word)
    _romance_regions(w, _ES_V)
    x = w.ends(_ES_PRONOUN)
    if x:
        stem = Word(w.s[: w.at(x)])
        y = stem.ends(_ES_GERUND)
        if y and w.pv <= stem.at(y):
            case = _ES_GERUND.case[y]
            if case <= 5:
                w.put(y + x, ("iendo", "ando", "ar", "er", "ir")[case - 1])
            elif case == 6 or stem.before(y, "u"):
                w.put(x)
    if not _es_standard(w, _ES_1, _ES_CASES, _ES_6, _ES_7, _ES_8):
        x = w.ends(_ES_Y, w.pv)
        if x and w.before(x, "u"):
            w.put(x)
        else:
            x = w.ends(_ES_VERB, w.pv)
            if x:
                if _ES_VERB.case[x] == 1 and w.s[: w.at(x)].endswith("gu"):
                    x = "u" + x
                w.put(x)
    x = w.ends(_ES_REST)
    if x and w.rv(x):
        w.put(x)
        if _ES_REST.case[x] == 2 and w.s.endswith("gu") and w.rv("u"):
            w.put("u")
    return w.s.translate(str.maketrans("áéíóú", "aeiou"))


_PT_V = "aeiouáéíóúâêô"
_PT_1 = Suffixes(
    "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância", "logía logías", "ución uciones",
    "ência ências", "amente", "mente", "idade idades", "iva ivo ivas ivos", "ira iras",
)
_PT_CASES = {1: "-", 2: ">log", 3: ">u", 4: ">ente", 5: "amente", 6: "mente", 7: "idad", 8: "iva", 9: "ira"}
_PT_7 = Suffixes("ante avel ível")
_PT_VERB = Suffixes(
    "ada ida ia aria eria iria ará ara erá era irá ira ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido"
    " ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás iras avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais"
    " eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos"
    " iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou"
)
_PT_REST = Suffixes("os a i o á í ó")


def portuguese(word: str) -> str:
    w = Word(word.replace("ã", "a~").replace("õ", "o~"))
    _romance_regions(w, _PT_V)
    done = _es_standard(w, _PT_1, _PT_CASES, _ES_6, _PT_7, _ES_8)
    if not done:
        x = w.ends(_PT_VERB, w.pv)
        done = bool(x) and w.put(x)
    if done:
        if w.s.endswith("ci") and w.rv("i"):
            w.put("i")
    else:
        x = w.ends(_PT_REST)
        if x and w.rv(x):
            w.put(x)
    if w.s[-1:] in ("e", "é", "ê"):
        if w.rv("e"):
            w.s = w.s[:-1]
            if w.s.endswith(("gu", "ci")) and w.rv("u"):
                w.s = w.s[:-1]
    elif w.s.endswith("ç"):
        w.put("ç", "c")
    return w.s.replace("a~", "ã").replace("o~", "õ")


# Russian

_RU_V = "аеиоуыэюя"
_RU_GERUND = Suffixes("в вши вшись", "ив ивши ившись ыв ывши ывшись")
_RU_ADJ = Suffixes("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_RU_PART = Suffixes("ем нн вш ющ щ", "ивш ывш ующ")
_RU_VERB = Suffixes("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_RU_NOUN = Suffixes("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")


def _ru_take(w: Word, table: Suffixes) -> bool:
    """Take the ending off; those of the first group only after a or ya, within the region."""
    x = w.ends(table, w.pv)
    if not x or (table.case[x] == 1 and not (w.before(x, "ая") and w.at(x) - 1 >= w.pv)):
        return False
    return w.put(x)


def russian(word: str) -> str:
    w = Word(word)
    a = past(word, _RU_V, 0)
    if a is None:
        return word
    w.pv = a
    b = past(word, _RU_V, a, False)
    c = past(word, _RU_V, b) if b is not None else None
    d = past(word, _RU_V, c, False) if c is not None else None
    w.p2 = len(word) if d is None else d
    if not _ru_take(w, _RU_GERUND):
        if w.ends(_RU_REFLEXIVE, w.pv):
            w.s = w.s[:-2]
        x = w.ends(_RU_ADJ, w.pv)
        if x:
            w.put(x)
            _ru_take(w, _RU_PART)
        elif not _ru_take(w, _RU_VERB):
            x = w.ends(_RU_NOUN, w.pv)
            if x:
                w.put(x)
    if w.s.endswith("и") and w.rv("и"):
        w.put("и")
    x = w.ends(Suffixes_RU_DERIV, w.pv)
    if x and w.r2(x):
        w.put(x)
    x = w.ends(_RU_TIDY, w.pv)
    if x in ("ейш", "ейше"):
        w.put(x)
        if w.s.endswith("нн") and w.rv("нн"):
            w.s = w.s[:-1]
    elif x == "н":
        if w.s.endswith("нн") and w.rv("нн"):
            w.s = w.s[:-1]
    elif x:
        w.put(x)
    return w.s


_RU_REFLEXIVE, Suffixes_RU_DERIV, _RU_TIDY = Suffixes("ся сь"), Suffixes("ост ость"), Suffixes("ейш ейше н ь")


# Hungarian

_HU_V = "aeiouáéíóöőúüű"
_HU_DOUBLE = tuple("bb cc ccs dd ff gg ggy jj kk ll lly mm nn nny pp rr ss ssz tt tty vv zz zzs".split())
_HU_CASE = Suffixes("ba ra be re ig nak nek val vel ul ről ről ből ből től nál nél ból ról tól ül n an ban en ben képpen on ön képp kor t at et ként anként enként onként ot ért öt hez hoz höz vá vé")
_HU_SPECIAL = {"én": "e", "án": "a", "ánként": "a"}
_HU_OTHER = {"astul": "", "estül": "", "stul": "", "stül": "", "ástul": "a", "éstül": "e"}
_HU_OWNED = {"oké": "", "öké": "", "aké": "", "eké": "", "éké": "e", "áké": "a", "ké": "", "ééi": "e", "áéi": "a", "éi": "", "éé": "e", "é": ""}
_HU_SINGULAR = {x: "" for x in "ünk unk nk juk jük uk ük em om am m od ed ad öd d ja je a e o".split()} | {"ánk": "a", "énk": "e", "ájuk": "a", "éjük": "e", "ám": "a", "ém": "e", "ád": "a", "éd": "e", "á": "a", "é": "e"}
_HU_PLURAL_OWN = {x: "" for x in "jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink aink eink ink jaitok jeitek aitok eitek itek jaik jeik aik eik ik".split()} | {
    x: {"á": "a", "é": "e"}[x[0]] for x in "áim éim áid éid ái éi áink éink áitok éitek áik éik".split()
}
_HU_PLURAL = {"ák": "a", "ék": "e", "ök": "", "ak": "", "ok": "", "ek": "", "k": ""}
_HU_STEPS = [(t, Suffixes(" ".join(t))) for t in (_HU_SPECIAL, _HU_OTHER)]
_HU_LAST = [(t, Suffixes(" ".join(t))) for t in (_HU_OWNED, _HU_SINGULAR, _HU_PLURAL_OWN, _HU_PLURAL)]


def _hu_undouble(w: Word) -> None:
    w.s = w.s[:-2] + w.s[-1:]


def _hu_swap(w: Word, table: dict[str, str], suffixes: Suffixes) -> None:
    x = w.ends(suffixes)
    if x and w.r1(x):
        w.put(x, table[x])


def hungarian(word: str) -> str:
    w = Word(word)
    if word[:1] and word[0] in _HU_V:
        i = next((k for k in range(1, len(word)) if word[k] not in _HU_V), None)
        if i is not None:
            pair = next((x for x in ("dzs", "cs", "gy", "ly", "ny", "sz", "ty", "zs") if word.startswith(x, i)), word[i])
            w.p1 = i + len(pair)
    elif word:
        w.p1 = past(word, _HU_V, 1) or len(word)
    if w.s.endswith(("al", "el")) and w.r1("al") and w.s[:-2].endswith(_HU_DOUBLE):
        w.s = w.s[:-2]
        _hu_undouble(w)
    x = w.ends(_HU_CASE)
    if x and w.r1(x):
        w.put(x)
        if w.s[-1:] in ("á", "é") and w.r1("á"):
            w.s = w.s[:-1] + {"á": "a", "é": "e"}[w.s[-1]]
    for table, suffixes in _HU_STEPS:
        _hu_swap(w, table, suffixes)
    if w.s[-1:] in ("á", "é") and w.r1("á") and w.s[:-1].endswith(_HU_DOUBLE):
        w.s = w.s[:-1]
        _hu_undouble(w)
    for table, suffixes in _HU_LAST:
        _hu_swap(w, table, suffixes)
    return w.s


STEMMERS: dict[str, Callable[[str], str]] = {f.__name__: f for f in (danish, dutch, english, finnish, french, german, hungarian, italian, norwegian, porter, portuguese, russian, spanish, swedish)}
ALIASES = {
    "da": "danish", "dan": "danish", "nl": "dutch", "nld": "dutch", "dut": "dutch", "en": "english", "eng": "english", "fi": "finnish", "fin": "finnish", "fr": "french", "fra": "french", "fre": "french",
    "de": "german", "deu": "german", "ger": "german", "hu": "hungarian", "hun": "hungarian", "it": "italian", "ita": "italian", "no": "norwegian", "nor": "norwegian", "pt": "portuguese", "por": "portuguese",
    "ru": "russian", "rus": "russian", "es": "spanish", "esl": "spanish", "spa": "spanish", "sv": "swedish", "swe": "swedish",
}


def algorithms() -> list[str]:
    return sorted(STEMMERS)


def stemmer(language: str) -> Callable[[str], str]:
    """By name or alias; ValueError if unknown."""
    try:
        return STEMMERS[ALIASES.get(language, language)]
    except KeyError:
        raise ValueError(f"no stemmer for {language!r}; known: {', '.join(algorithms())}") from None


@lru_cache(maxsize=200_000)
def stem(word: str, language: str = "english") -> str:
    return stemmer(language)(word)
