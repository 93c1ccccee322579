"""Plain restatements of the text metrics: Porter (1980), Papineni et al. (2002), Chen and Cherry (2014), Lin (2004)."""

from __future__ import annotations

import math
import re
from collections import Counter

_WORD = re.compile(r"[a-z0-9]+")
_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    shape = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", shape))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


#: The suffix tables of Porter (1980), steps 2 to 4.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _swap(w: str, table: dict[str, str]) -> str:
    for s in sorted(table, key=len, reverse=True):
        if w.endswith(s):
            return w[: -len(s)] + table[s] if _measure(w[: -len(s)]) > 0 else w
    return w


def stem(w: str) -> str:
    """Porter's stemmer."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s):
                if _has_vowel(w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    for s in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(s):
            base = w[: -len(s)]
            if _measure(base) > 1 and (s != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w.endswith("l") else w


def rouge_tokens(text: str) -> list[str]:
    return [stem(t) if len(t) > 3 else t for t in _WORD.findall(text.lower())]


def _prf(hits: int, n_out: int, n_ref: int) -> tuple[float, float, float]:
    p, r = (hits / n_out if n_out else 0.0), (hits / n_ref if n_ref else 0.0)
    return p, r, (2 * p * r / (p + r) if p + r else 0.0)


def rouge1(reference: list[str], output: list[str]) -> tuple[float, float, float]:
    return _prf(sum((Counter(reference) & Counter(output)).values()), len(output), len(reference))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by the usual table."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l(reference: list[str], output: list[str]) -> tuple[float, float, float]:
    return _prf(lcs(reference, output), len(output), len(reference))


def bleu4(reference: list[str], output: list[str]) -> float:
    """Sentence BLEU of orders 1 to 4 with equal weights; orders without a hit are smoothed by length."""
    if not output:
        return 0.0
    logs, missed = 0.0, 0
    for n in range(1, 5):
        grams = Counter(tuple(output[i : i + n]) for i in range(len(output) - n + 1))
        known = Counter(tuple(reference[i : i + n]) for i in range(len(reference) - n + 1))
        hits, most = sum((grams & known).values()), max(1, sum(grams.values()))
        if not hits:
            if n == 1 or len(output) <= 1:
                return 0.0
            missed += 1
            hits_ = 1 / (2**missed * 5 / math.log(len(output)))
            logs += 0.25 * math.log(hits_ / most)
        else:
            logs += 0.25 * math.log(hits / most)
    brevity = 1.0 if len(output) > len(reference) else math.exp(1 - len(reference) / len(output))
    return brevity * math.exp(logs)
