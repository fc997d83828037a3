"""Edit distances, similarities and phonetic codes of short texts."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from itertools import accumulate
from os.path import commonprefix


def nullable(f):
    n = f.__code__.co_argcount
    if n == 1:
        return lambda a: None if a is None else f(a)
    return lambda a, b: None if a is None or b is None else f(a, b)


def damerau(a: str, b: str) -> int:
    """Edits of one letter and swaps of neighbours, where letters may be edited between a swapped pair (Lowrance and Wagner)."""
    last_in_a: dict[str, int] = {}
    rows = [list(range(len(b) + 1))]  # rows[i][j]: the distance of the first i letters from the first j
    for i, x in enumerate(a, 1):
        row, match = [i], 0
        for j, y in enumerate(b, 1):
            ways = [rows[-1][j - 1] + (x != y), rows[-1][j] + 1, row[-1] + 1]
            if match and (k := last_in_a.get(y)):
                ways.append(rows[k - 1][match - 1] + (i - k) + (j - match) - 1)
            row.append(min(ways))
            if x == y:
                match = j
        rows.append(row)
        last_in_a[x] = i
    return rows[-1][-1]


def alignment(a: str, b: str) -> int:
    """Optimal string alignment as the dialect counts it: Levenshtein's edits after the common prefix, and few swaps.

    Kept for parity: a swap is taken where the letter after the current one
    (after the last comes the first) equals the other text's letter before, both
    ways. Textbook alignment would see the swap of the current letters.
    """
    shared = len(commonprefix([a, b]))
    a, b = a[shared:], b[shared:]
    beside = lambda x: list(zip(x[-1:] + x[:-1], x[1:] + x[:1], strict=True))
    two_up, up = [], list(range(len(b) + 1))
    for i, (x, (before_x, after_x)) in enumerate(zip(a, beside(a), strict=True)):
        row = [i + 1]
        for j, (y, (before_y, after_y)) in enumerate(zip(b, beside(b), strict=True)):
            ways = [up[j] + (x != y), up[j + 1] + 1, row[j] + 1]
            if i and j and after_x == before_y and before_x == after_y:
                ways.append(two_up[j - 1] + (x != y))
            row.append(min(ways))
        two_up, up = up, row
    return up[-1]


def hamming(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else -1


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: Refined consonant classes by letter.
REFINED = {**dict.fromkeys("AEIOUHWY", "0"), **dict.fromkeys("BP", "1"), **dict.fromkeys("FV", "2"), **dict.fromkeys("CKS", "3"), **dict.fromkeys("GJ", "4"), **dict.fromkeys("QXZ", "5"), **dict.fromkeys("DT", "6"), "L": "7", **dict.fromkeys("MN", "8"), "R": "9"}


def refined_soundex(x: str) -> str | None:
    letters = [c for c in x.upper() if c in REFINED]
    if not letters:
        return None
    codes = [REFINED[c] for c in letters]
    return letters[0] + "".join(c for i, c in enumerate(codes) if i == 0 or c != codes[i - 1])


#: Letters by class of sound. y is a vowel within a word.
CLASSES = {"A": "aeiou", "B": "bfpvw", "C": "cgjkqsxz", "D": "dt", "H": "", "L": "l", "M": "mn", "R": "r", "Y": "y", ".": "h", "9": "0123456789", " ": " \t\n\f\r"}
CLASS_OF = {letter: name for name, letters in CLASSES.items() for letter in letters}


def classes(word: str) -> str:
    """A class for each letter, ``?`` for others."""
    found = "".join(CLASS_OF.get(c, "?") for c in word.lower())
    return found[:1] + found[1:].replace("Y", "A")


def phonetic(x: str) -> str:
    """The classes of a word's sounds: unspoken letters go, so do vowels beside l and r; equal neighbours meet."""
    spoken = re.sub("^[gk](?=n.)|w(?=r)|d(?=[jg])|t(?=ch)", "", x)
    sounds = re.sub("[.? ]", "", classes(spoken.lstrip()))
    return re.sub(r"(.)\1+", r"\1", re.sub("A+(?=[LR])|(?<=[LR])A+", "", sounds))


#: What it costs to write or leave out a letter, by what stands beside it, and to put one for another.
SILENT, DOUBLED, BESIDE_R, NEXT_VOWEL, SAME_CLASS, ALONE, WITHIN_CLASS, CONSONANTS, LAST_DIVISOR = 1, 10, 20, 15, 50, 100, 40, 75, 4


class Spelling:
    """A word's letters with their classes, and what each costs to write or leave out where it stands."""

    def __init__(self, before: str, word: str, after: str = ""):
        self.letters, whole = word, before + word
        self.classes = classes(whole)[len(before) :]
        around = zip(self.letters, self.classes, (" " + whole)[len(before) :][: len(word)], (" " + classes(whole))[len(before) :], (word + after)[1:] + " ", strict=False)
        self.costs = [self.cost(*x, first=not before and i == 0) for i, x in enumerate(around)]

    @staticmethod
    def cost(letter: str, sound: str, last: str, last_sound: str, following: str, first: bool) -> int:
        table = {
            SILENT: sound == ".",
            DOUBLED: letter == last and not first,
            BESIDE_R: sound == "A" and "r" in (last, following),
            NEXT_VOWEL: sound == last_sound == "A" and not first,
            SAME_CLASS: sound == last_sound and sound != "A" and not first,
        }
        return next((cost for cost, holds in table.items() if holds), ALONE)

    def exchange(self, i: int, other: Spelling, j: int) -> int:
        """What it costs to write the other's letter for this one."""
        if self.letters[i].lower() == other.letters[j].lower():
            return 0
        pair = {self.classes[i], other.classes[j]}
        return WITHIN_CLASS if len(pair) == 1 else CONSONANTS if pair <= set("BCDHLMRY") else ALONE


def spelling_distance(a: str, b: str) -> int | None:
    """How far a misspelling is from a word, for ASCII texts: letters of one sound are near each other.

    A weighted edit distance after the common prefix. Letters that only follow
    the first text cost a quarter; that text may end in ``*``, a prefix of anything.
    A letter's cost goes by its neighbours in its own word. Of a swapped pair,
    one letter is written, and left out as a double where it stood. (The dialect
    also remembers the letter written last along the way it found cheapest; some
    of its figures differ.)
    """
    if not (a.isascii() and b.isascii()):
        return None
    open_end, a = a.endswith("*"), a.removesuffix("*")
    shared = len(commonprefix([a, b]))
    before = a[max(shared - 1, 0) : shared]
    x, y = Spelling(before, a[shared:]), Spelling(before, b[shared:])
    row = list(accumulate(y.costs, initial=0))
    if not x.letters:
        return 0 if open_end else sum(c // LAST_DIVISOR for c in y.costs)
    two_up: list[int] = []
    for i, cost in enumerate(x.costs):
        discount = LAST_DIVISOR if i == len(x.costs) - 1 and not open_end else 1
        new = [row[0] + cost]
        for j, written in enumerate(y.costs):
            ways = [row[j] + x.exchange(i, y, j), row[j + 1] + cost, new[j] + written // discount]
            if i and j and x.letters[i - 1 : i + 1] == y.letters[j - 1 : j + 1][::-1]:
                ways.append(two_up[j - 1] + y.costs[j - 1] + DOUBLED)
            new.append(min(ways))
        two_up, row = row, new
    return min(row) if open_end else row[-1]


#: The rules of Caverphone 2.0, in their published order. 2 stands for what is not spoken, 3 for a vowel within the word.
CAVERPHONE = (
    ("[^a-z]", ""), ("e$", ""), ("^cough", "cou2f"), ("^rough", "rou2f"), ("^tough", "tou2f"), ("^enough", "enou2f"), ("^trough", "trou2f"), ("^gn", "2n"), ("mb$", "m2"),
    ("cq", "2q"), ("ci", "si"), ("ce", "se"), ("cy", "sy"), ("tch", "2ch"), ("c", "k"), ("q", "k"), ("x", "k"), ("v", "f"), ("dg", "2g"), ("tio", "sio"), ("tia", "sia"), ("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"),
    ("^[aeiou]", "A"), ("[aeiou]", "3"), ("j", "y"), ("^y3", "Y3"), ("^y", "A"), ("y", "3"), ("3gh3", "3kh3"), ("gh", "22"), ("g", "k"),
    ("s+", "S"), ("t+", "T"), ("p+", "P"), ("k+", "K"), ("f+", "F"), ("m+", "M"), ("n+", "N"),
    ("w3", "W3"), ("wh3", "Wh3"), ("w$", "3"), ("w", "2"), ("^h", "A"), ("h", "2"), ("r3", "R3"), ("r$", "3"), ("r", "2"), ("l3", "L3"), ("l$", "3"), ("l", "2"),
    ("2", ""), ("3$", "A"), ("3", ""),
)


def caver(x: str) -> str:
    """Caverphone 2.0: ten characters, padded with 1."""
    code = reduce(lambda code, rule: re.sub(*rule, code), CAVERPHONE, x.lower())
    return code[:10].ljust(10, "1")


#: Letters whose Unicode names do not say their sound by rule.
SPECIAL = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ъ": "", "ь": "", "Ъ": "", "Ь": "", "ы": "y", "Ы": "Y", "й": "j", "Й": "J", "ё": "yo", "Ё": "Yo", "г": "g", "Г": "G"}


def letter_by_name(c: str) -> str:
    """A Cyrillic or Greek letter as its name says it: consonants lose the vowel that their name adds."""
    m = re.match(r"(CYRILLIC|GREEK) (SMALL|CAPITAL) LETTER ([A-Z]+)", unicodedata.name(c, ""))
    if not m:
        return "?"
    name = m[3].lower()
    if m[1] == "GREEK":
        latin = {"theta": "th", "phi": "f", "chi": "ch", "psi": "ps", "eta": "i", "upsilon": "y", "xi": "x"}.get(name, name[0])
    else:
        latin = {"ie": "e"}.get(name, name if re.fullmatch("[aeiouy]+", name) or name in ("yu", "ya") else re.sub("[aeiou]", "", name))
    return latin if m[2] == "SMALL" else latin.capitalize()


def transliterate(x: str) -> str:
    """ASCII text that sounds alike; ``?`` for what has no letters for it."""
    out = "".join(SPECIAL.get(c, c) for c in x)
    out = "".join(c for c in unicodedata.normalize("NFKD", out) if not unicodedata.combining(c))
    return "".join(c if c.isascii() else letter_by_name(c) for c in out)


#: Unicode blocks' first words by script, with the code that stands for it.
SCRIPTS = {"LATIN": 215, "GREEK": 200, "CYRILLIC": 220, "HEBREW": 125, "ARABIC": 160}


def script(x: str) -> int:
    """The code of the one script whose letters the text has, 998 for several, 999 for another or none."""
    found = {next((v for k, v in SCRIPTS.items() if unicodedata.name(c, "").startswith(k)), 999) for c in x if c.isalpha()}
    return found.pop() if len(found) == 1 else 998 if found else 999


FUZZY = {
    "fuzzy_damlev": (nullable(damerau), "int"),
    "fuzzy_osadist": (nullable(alignment), "int"),
    "fuzzy_hamming": (nullable(hamming), "int"),
    "fuzzy_editdist": (nullable(spelling_distance), "int"),
    "fuzzy_jarowin": (nullable(jaro_winkler), "real"),
    "fuzzy_rsoundex": (nullable(refined_soundex), "text"),
    "fuzzy_phonetic": (nullable(phonetic), "text"),
    "fuzzy_caver": (nullable(caver), "text"),
    "fuzzy_translit": (nullable(transliterate), "text"),
    "fuzzy_script": (nullable(script), "int"),
}
