"""Stems after Porter (1980) and the METEOR score that uses them."""

from __future__ import annotations

import re
from functools import lru_cache

# The published suffix rules. Steps 2 and 3 replace after a stem of measure 1, step 4 removes after measure 2.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str]) -> str:
    found = max((s for s in rules if word.endswith(s)), key=len, default=None)
    if found is not None and _measure(stem := word[: -len(found)]) > 0:
        return stem + rules[found]
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and "v" in _shape(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c":
                word = word if word[-1] in "lsz" else word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP2), STEP3)
    found = max((s for s in STEP4 if word.endswith(s)), key=len, default=None)
    if found is not None and _measure(rest := word[: -len(found)]) > 1 and (found != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e") and ((m := _measure(word[:-1])) > 1 or (m == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def _aligned(ref: dict[int, str], hyp: dict[int, str]) -> dict[int, int]:
    """Position in hyp -> position in ref of equal words, the last with the last."""
    free: dict[str, list[int]] = {}
    for j in sorted(ref):
        free.setdefault(ref[j], []).append(j)
    return {i: free[hyp[i]].pop() for i in sorted(hyp, reverse=True) if free.get(hyp[i])}


def meteor(ref: list[str], hyp: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """Harmonic mean of precision and recall with weight alpha, less a penalty for the number of runs that match in order; case does not count."""
    r, h = ({i: w.lower() for i, w in enumerate(x)} for x in (ref, hyp))
    found = _aligned(r, h)
    rest = [{i: stem(w) for i, w in x.items() if i not in done} for x, done in ((r, set(found.values())), (h, set(found)))]
    found |= _aligned(*rest)
    if not found:
        return 0.0
    m = len(found)
    precision, recall = m / len(h), m / len(r)
    at = sorted(found)
    chunks = 1 + sum(1 for a, b in zip(at, at[1:]) if b != a + 1 or found[b] != found[a] + 1)
    return precision * recall / (alpha * precision + (1 - alpha) * recall) * (1 - gamma * (chunks / m) ** beta)
