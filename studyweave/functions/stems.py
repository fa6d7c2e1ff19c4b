"""English stems: a suffix stemmer of five steps (Porter's second algorithm) for single words, and stop words.

A word is stemmed once for each batch that holds it (see :class:`Stems`); texts are never stemmed twice.
"""

from __future__ import annotations

# Words that carry no meaning in a search, and words with stems of their own.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don should now""".split()
)
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SPECIAL |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
KEPT = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
# Suffixes with what takes their place, longest first.
STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _region(word: str, start: int) -> int:
    """Place behind the first non-vowel that follows a vowel from ``start`` on."""
    for k in range(start + 1, len(word)):
        if word[k] not in _VOWELS and word[k - 1] in _VOWELS:
            return k + 1
    return len(word)


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _short_end(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def _longest(w: str, suffixes) -> str | None:
    return next((s for s in suffixes if w.endswith(s)), None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]) else w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if end is None or not _has_vowel(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(_DOUBLES):
        return w[:-1]
    return w + "e" if r1 >= len(w) and _short_end(w) else w


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = "".join("Y" if c == "y" and (k == 0 or word[k - 1] in _VOWELS and (k < 2 or word[k - 1] != "y")) else c for k, c in enumerate(word))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1)
    w = _plural(w)
    if w in KEPT:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    end = _longest(w, (s for s, _ in STEP2))
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if not (end == "ogi" and before[-1:] != "l") and not (end == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            w = before + dict(STEP2)[end]
    end = _longest(w, (s for s, _ in STEP3))
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + dict(STEP3)[end]
    end = _longest(w, STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)][-1:] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


class Stems(dict):
    """Stems of the words met so far; None for stop words. Bounded: it starts anew when it holds ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = None if word in STOP else stem(word)
        return value
