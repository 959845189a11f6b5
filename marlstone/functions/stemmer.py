"""The English Snowball stemmer (Porter2), from its published description."""

from __future__ import annotations

import re

VOWELS = frozenset("aeiouy")
DOUBLES = frozenset(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"))
LI_ENDINGS = frozenset("cdeghkmnrt")
#: Words stemmed as a whole.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words left alone after the plural is off.
AFTER_PLURAL = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
#: Suffixes of the second, third and fourth step with what takes their place.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


#: Ends that are looked for by their length, the longest first; a word has one of them only if its last letter is one of theirs.
def _by_length(*suffixes: str) -> tuple[frozenset[str], tuple[int, ...], frozenset[str]]:
    return frozenset(suffixes), tuple(sorted({len(s) for s in suffixes}, reverse=True)), frozenset(s[-1] for s in suffixes)


PAST_ENDS = _by_length("eed", "eedly", "ed", "edly", "ing", "ingly")
SECOND_ENDS, THIRD_ENDS, FOURTH_ENDS = _by_length(*SECOND, "ogi", "li"), _by_length(*THIRD, "ative"), _by_length(*FOURTH, "ion")
VOWEL, SYLLABLE = re.compile("[aeiouy]"), re.compile("[aeiouy][^aeiouy]")


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    found = SYLLABLE.search(word, start)
    return found.end() if found else len(word)


def _short_syllable(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS and word[-1] not in "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _longest(word: str, ends: tuple[frozenset[str], tuple[int, ...], frozenset[str]]) -> str:
    suffixes, lengths, last = ends
    if word[-1:] in last:
        for n in lengths:
            if word[-n:] in suffixes:
                return word[-n:]
    return ""


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in WHOLE:
        return WHOLE[word]
    # A y that is a consonant is written as a capital.
    if "y" in word:
        letters = list(word)
        for i, c in enumerate(letters):
            if c == "y" and (i == 0 or letters[i - 1] in VOWELS):
                letters[i] = "Y"
        word = "".join(letters)
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), "")
    r1 = len(prefix) if prefix else _region(word, 0)
    r2 = _region(word, r1)

    for s in ("'s'", "'s", "'"):
        if word.endswith(s):
            word = word[: -len(s)]
            break
    # Plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and VOWEL.search(word, 0, len(word) - 2):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word
    # Past and -ing.
    suffix = _longest(word, PAST_ENDS)
    if suffix in ("eed", "eedly"):
        if len(word) - len(suffix) >= r1:
            word = word[: -len(suffix)] + "ee"
    elif suffix and VOWEL.search(word, 0, len(word) - len(suffix)):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-2:] in DOUBLES:
            word = word[:-1]
        elif _short_syllable(word) and r1 >= len(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # Double suffixes.
    suffix = _longest(word, SECOND_ENDS)
    if suffix and len(word) - len(suffix) >= r1:
        before = word[: -len(suffix)]
        if suffix == "ogi":
            word = word[:-1] if before.endswith("l") else word
        elif suffix == "li":
            word = before if before and before[-1] in LI_ENDINGS else word
        else:
            word = before + SECOND[suffix]
    suffix = _longest(word, THIRD_ENDS)
    if suffix and len(word) - len(suffix) >= r1:
        if suffix == "ative":
            word = word[:-5] if len(word) - 5 >= r2 else word
        else:
            word = word[: -len(suffix)] + THIRD[suffix]
    suffix = _longest(word, FOURTH_ENDS)
    if suffix and len(word) - len(suffix) >= r2 and (suffix != "ion" or word[: -len(suffix)].endswith(("s", "t"))):
        word = word[: -len(suffix)]
    # A last e or l.
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_syllable(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
