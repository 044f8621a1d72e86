"""Whole-text token ids of a byte-level BPE tokenizer file, fast enough for bulk work.

The ids are those of the ``tokenizers`` library: every distinct pre-token of a batch is
encoded by the library once, and a batch is put together from these pieces with numpy.
Prose repeats its words, so most of the work falls away; the pieces stay cached between
batches, up to a fixed number.

A text goes to the library whole instead when a cut into pre-tokens outside the library
could differ from the library's own: when it holds the string of an added token, or a code
point outside blocks on which both Unicode tables agree (``tests/llm/test_encoding.py``
checks every code point of these blocks).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per Spark task

#: The cut into pre-tokens of byte-level BPE files with ``use_regex`` (a fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points outside these blocks send a text to the library whole.
UNSURE = (
    r"[^\x00-\u0557\u2000-\u206f\u20a0-\u20bf\u2100-\u218b\u2190-\u23ff\u2500-\u27bf"
    r"\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\U0001F300-\U0001FAFF]"
)

#: Cached pre-tokens of one worker; beyond it, those that came most often stay (about 150 MB).
CACHE_WORDS = 600_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary file is; workers call this too."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Interner(dict):
    """Numbers the words that are looked up, in the order in which they first come."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


#: Characters that are cut into pre-tokens at once, at most; longer texts are taken in parts.
PART_CHARS = 3 << 19

LETTER, NUMBER, OTHER, SPACE, NOT_SURE = range(5)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """What the cut into pre-tokens knows of each code point."""
    import regex

    table = np.full(0x110000, NOT_SURE, np.uint8)
    unsure, kinds = regex.compile(UNSURE), [regex.compile(x) for x in (r"\p{L}", r"\p{N}", r"\s")]
    for start, end in ((0, 0xD800), (0xF900, 0x20000)):
        for code in range(start, end):
            c = chr(code)
            if not unsure.match(c):
                letter, number, space = (k.match(c) is not None for k in kinds)
                table[code] = LETTER if letter else NUMBER if number else SPACE if space else OTHER
    return table


def word_starts(codes: np.ndarray, classes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of joined texts begin, as the pattern ``PRETOKEN`` cuts them.

    A run of letters, numbers or other marks is one pre-token, together with one blank before it.
    Of a run of white space before something else, the last character is split off; the blank that
    belongs to the next run is that character. An apostrophe that stands alone between such runs,
    with an ending like ``s`` or ``ll`` after it, is one with this ending.
    """
    n = len(codes)
    at_begin = np.zeros(n + 1, bool)
    at_begin[begins] = True
    at_begin[n] = True
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(classes[1:], classes[:-1], out=run[1:])
    run |= at_begin[:n]
    space = classes == SPACE
    last = np.empty(n, bool)  # the last of a run of white space that is not at its text's end
    last[:-1] = run[1:] & space[:-1]
    last[-1] = False
    last &= ~at_begin[1:]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = codes[:-1] == 32
    after_blank &= ~at_begin[:n]
    starts = (run & (space | ~after_blank)) | last
    marks = np.flatnonzero((codes == 39) & run & ~after_blank)
    marks = marks[marks + 1 < n]
    marks = marks[run[marks + 1] & (classes[marks + 1] == LETTER) & ~at_begin[marks + 1]]
    if len(marks):
        one = codes[marks + 1]
        two = np.where(at_begin[np.minimum(marks + 2, n)], 0, codes[np.minimum(marks + 2, n - 1)])
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))) & (marks + 2 < n)
        marks, size = marks[single | double], np.where(single, 1, 2)[single | double]
        starts[marks + 1] = False
        rest = marks + 1 + size
        inside = rest < n
        starts[rest[inside]] = True  # letters that go on, or a run that begins here anyway
        blank = rest[inside & (rest < n)]
        # a blank that begins a run begins a pre-token in any case; so does every other run
        starts[blank] |= run[blank]
    return np.flatnonzero(starts)


class BulkEncoder:
    """Token ids of many texts at once. Null texts count as empty."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, part_chars: int = PART_CHARS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.byte_level = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and not spec.get("normalizer")
            and spec["model"].get("type") == "BPE"
        )
        # words come here cut already, so that the library need not cut them again
        from tokenizers import pre_tokenizers

        self.word_library = Tokenizer.from_file(path)
        self.word_library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.classes = character_classes()
        self.cache_words, self.part_chars = cache_words, part_chars
        self._clear()

    def _clear(self) -> None:
        self.index = _Interner()
        self.pool = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.uint32)  # of each cached word in the pool
        self.counts = np.zeros(1 << 14, np.uint32)
        self.hits = np.zeros(1 << 14, np.uint32)
        self.filled = 0

    def _shrink(self) -> None:
        """Keeps the words that came most often, half of the cache at most."""
        words, hits = list(self.index), self.hits[: len(self.index)]
        enough = np.partition(hits, -(self.cache_words // 2))[-(self.cache_words // 2)] + 1
        kept = np.flatnonzero(hits >= enough)
        pool = take_ranges(self.pool, self.starts[kept], self.counts[kept])
        counts, hits = self.counts[kept], hits[kept] // 2
        self._clear()
        for k in kept.tolist():
            self.index[words[k]]  # noqa: B018  numbers the word
        self.index.fresh.clear()
        self._store(pool, counts)
        self.hits[: len(hits)] = hits

    def _learn(self, words: list[str]) -> None:
        """Adds the newest words of the index to the pool."""
        flat, counts = [], []
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            encoded = self.word_library.encode_batch(
                [part], is_pretokenized=True, add_special_tokens=False
            )[0]
            flat.append(np.array(encoded.ids, np.uint32))
            counts.append(np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(part)))
        self._store(np.concatenate(flat), np.concatenate(counts))

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self.index) - len(sizes), len(self.index)
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 3 * (self.filled + len(ids)) // 2)
        if last > len(self.starts):
            self.starts = np.resize(self.starts, 3 * last // 2)
            self.counts = np.resize(self.counts, 3 * last // 2)
            self.hits = np.resize(self.hits, 3 * last // 2)
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.hits[first:last] = 0
        self.starts[first:last] = self.filled + np.cumsum(sizes) - sizes
        self.counts[first:last] = sizes
        self.filled += len(ids)

    def _places(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.fresh:
            self._learn([w.decode() for w in self.index.fresh])
            self.index.fresh.clear()
        return at

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | list[int]:
        """Cached words of all texts, and how many each has; or the texts that are not plain."""
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.classes[codes]
        ends = np.cumsum(sizes)
        unsure = np.flatnonzero(classes == NOT_SURE)
        if len(unsure):
            return np.unique(np.searchsorted(ends, unsure, side="right")).tolist()
        starts = word_starts(codes, classes, (ends - sizes)[sizes > 0])
        data = joined.encode()
        if len(data) == len(codes):
            places = starts
        else:
            width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
            places = (np.cumsum(width, dtype=np.int64) - width)[starts]
        offsets = np.append(places, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        ).dictionary_encode()
        indices = words.indices.to_numpy()
        numbers = self._places(words.dictionary.to_pylist())
        self.hits[numbers] += np.bincount(indices, minlength=len(numbers)).astype(np.uint32)
        at = numbers[indices]
        return at, np.diff(np.append(np.searchsorted(starts, ends - sizes), len(starts)))

    def _ids_of_words(self, words: list[str]) -> np.ndarray:
        at = self._places([w.encode() for w in words])
        return take_ranges(self.pool, self.starts[at], self.counts[at])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array (uint32), and the offsets at which each text's begin."""
        if len(self.index) > self.cache_words:
            self._shrink()
        plain, whole = list(texts), {}
        for k, text in enumerate(texts):
            if not text:
                plain[k] = ""
            elif not self.byte_level or any(a in text for a in self.added):
                plain[k], whole[k] = "", self._whole(text)
        parts, owner = [], []
        for k, text in enumerate(plain):
            own = text_parts(text, self.part_chars)
            parts += own
            owner += [k] * len(own)
        found, per_text = [], np.zeros(len(texts), np.int64)
        for lo, hi in batches(parts, self.part_chars):
            some = ["" if owner[k] in whole else parts[k] for k in range(lo, hi)]
            cut = self._cut(some)
            if isinstance(cut, list):
                for k in {owner[lo + j] for j in cut}:
                    whole[k] = self._whole(texts[k])
                cut = self._cut(["" if owner[k] in whole else parts[k] for k in range(lo, hi)])
            found.append(cut[0])
            np.add.at(per_text, owner[lo:hi], cut[1])
        at = np.concatenate(found) if found else np.empty(0, np.int64)
        counts = self.counts[at]
        ids = take_ranges(self.pool, self.starts[at], counts)
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        offsets = ends[np.concatenate([[0], np.cumsum(per_text)])]
        if whole:
            parts = [
                whole[k] if k in whole else ids[offsets[k] : offsets[k + 1]]
                for k in range(len(texts))
            ]
            ids = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return ids, offsets


def text_parts(text: str, most: int) -> list[str]:
    """A long text in parts, cut where a single blank stands between other characters: a pre-token begins
    there whatever stands around it."""
    parts, begin = [], 0
    while len(text) - begin > most:
        at = begin + most
        while at > begin:
            at = text.rfind(" ", begin + 1, at)
            if at < 0:
                break
            if not text[at - 1].isspace() and not text[at + 1 : at + 2].isspace() and at + 1 < len(text):
                break
        if at <= begin:
            break  # no such place: the rest is one part
        parts.append(text[begin:at])
        begin = at
    parts.append(text[begin:])
    return parts


def take_ranges(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges ``pool[start : start + count]`` one after another."""
    ends = np.cumsum(counts, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return pool[:0]
    where = np.arange(total) + np.repeat(starts - (ends - counts), counts)
    return pool[where]


def batches(texts: list, most_chars: int = PART_CHARS):
    """Ranges of neighbouring texts of about so many characters each; bounds memory."""
    begin = chars = 0
    for k, text in enumerate(texts):
        chars += len(text or "")
        if chars >= most_chars:
            yield begin, k + 1
            begin, chars = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


@lru_cache(maxsize=2)
def bulk_encoder(path: str) -> BulkEncoder:
    """One encoder in each Python worker."""
    return BulkEncoder(path)


def drop_encoders() -> None:
    """Frees the encoder, with its words, that an earlier operator has left in this worker; for operators that encode nothing.

    Spark keeps its Python workers from one operator to the next, and so their memory.
    """
    if bulk_encoder.cache_info().currsize:
        bulk_encoder.cache_clear()
        gc.collect()
        with contextlib.suppress(AttributeError, OSError):  # where the C library has it, freed memory goes back to the system
            ctypes.CDLL(None).malloc_trim(0)
