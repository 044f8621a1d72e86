"""Statistics of whole texts, from a table of the words that they hold.

What a word contributes (letters, capitals, marks, lexicon weights and so on) is worked out once for
each distinct word of a worker; texts gather and sum these rows with numpy.
"""

from __future__ import annotations

import numpy as np

from skarn.llm.encoding import drop_encoders

WORDS = 300_000  # distinct words of one worker; the table starts anew beyond it

COLUMNS = (
    "chars", "letters", "upper", "digits", "marks", "exclaim", "question", "all_caps", "capital",
    "ends", "mixed", "stretched", "second_person", "short", "only_marks", "bar",
)
AT = {name: k for k, name in enumerate(COLUMNS)}

#: Second-person words of the corpus' languages (fixed values).
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer "
    "tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros vuestro su sus".split()
)
#: Marks and digits that stand for letters in disguised words (fixed values).
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
EDGES = ".,;:!?\"'()[]{}<>|&%$#*-_/\\…«»„“”’"
PREFIXES = (4, 5, 6)


def word_terms(bare: str) -> list[str]:
    """The word and its prefixes, as a lexicon knows them."""
    return [bare] + [f"{bare[:n]}~" for n in PREFIXES if len(bare) > n]


class WordTable(dict):
    """Number of each word; ``rows`` has its statistics, then its lexicon weights, plain and for
    words that only match with their disguise taken off."""

    def __init__(self, lexicon: dict[str, tuple[float, ...]] | None = None, weights: int = 0):
        drop_encoders()  # a worker holds the words of one or the other
        super().__init__()
        self.lexicon, self.weights = lexicon or {}, weights
        self.width = len(COLUMNS) + 2 * weights
        self.rows = np.zeros((1 << 12, self.width), np.float32)

    def __missing__(self, word: str) -> int:
        number = len(self)
        if number == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[number] = self.describe(word)
        self[word] = number
        return number

    def weight_of(self, bare: str) -> list[float]:
        found = [self.lexicon[t] for t in word_terms(bare) if t in self.lexicon]
        return [max(w[k] for w in found) for k in range(self.weights)] if found else [0.0] * self.weights

    def describe(self, word: str) -> list[float]:
        letters = sum(map(str.isalpha, word))
        digits = sum(map(str.isdigit, word))
        upper = sum(map(str.isupper, word)) if letters else 0
        marks = len(word) - letters - digits
        bare = word.strip(EDGES)
        lower = bare.lower()
        inner = len(bare) - sum(map(str.isalpha, bare))
        mixed = bool(letters and inner and bare[0].isalpha() and "'" not in bare and "-" not in bare)
        stretched = any(a == b == c for a, b, c in zip(lower, lower[1:], lower[2:], strict=False)) and letters > 0
        row = [
            len(word), letters, upper, digits, marks, word.count("!"), word.count("?"),
            letters > 1 and upper == letters, word[0].isupper(), word[-1] in ".!?", mixed, stretched,
            lower in SECOND_PERSON, 0 < letters <= 3, letters + digits == 0, word == "|",
        ]
        if self.weights:
            plain = self.weight_of(lower)
            shown = lower.translate(DISGUISES) if inner else lower
            shown = "".join(c for c in shown if c.isalpha())
            if stretched:
                shown = "".join(c for k, c in enumerate(shown) if k < 1 or c != shown[k - 1])
            hidden = self.weight_of(shown) if shown != lower and not any(plain) else [0.0] * self.weights
            row += plain + hidden
        return row

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words in order, and how many words each text has."""
        if len(self) > WORDS:
            self.clear()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                own = text.split()
                counts[k] = len(own)
                words += own
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)), counts


def sums(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the rows of each text; zero for texts without words."""
    out = np.zeros((len(counts), rows.shape[1]))
    some = np.flatnonzero(counts)
    if len(some):
        begins = (np.cumsum(counts) - counts)[some]
        out[some] = np.add.reduceat(rows, begins, axis=0, dtype=np.float64)
    return out
