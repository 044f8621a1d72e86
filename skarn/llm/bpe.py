"""BPE encoding by backtracking, and decoding by an offset table.

Encoding: an Aho-Corasick automaton finds the longest token that begins at every byte of a
word. From left to right the encoder takes the longest token whose pair with the token
before it is compatible: two neighbours are compatible when byte-pair merging their joined
bytes gives these two tokens again. Where no token fits, it steps back and tries a shorter
one; a bit for each position keeps it from visiting a dead end twice, so that a word takes
linear time. The result is exactly that of applying the merges by rank.

Decoding: the bytes of all tokens lie in one array; a table has the offset of each.

Null texts count as empty. Texts are taken whole, whatever their length. Repeated rows give
repeated rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skarn.llm.common import arrow_map
from skarn.llm.encoding import CACHE_WORDS, PART_CHARS, BulkEncoder, batches, take_ranges, tokenizer_path

PAIRS = 1 << 20  # pairs of tokens whose compatibility a worker keeps


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte, by rule: visible bytes of
    Latin-1 stand for themselves, the others take the letters from U+0100 on, in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in visible}
    for k, b in enumerate(x for x in range(256) if x not in visible):
        letters[chr(256 + k)] = b
    return letters


class BacktrackingEncoder(BulkEncoder):
    """The ids of a byte-level BPE vocabulary without the merge loop."""

    BREAK = "Ā"  # between words; no byte as a Latin-1 letter

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, part_chars: int = PART_CHARS):
        import ahocorasick
        import regex

        super().__init__(path, cache_words, part_chars)
        if not self.byte_level:
            raise ValueError("the vocabulary is not byte-level BPE")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, letters = spec["model"]["vocab"], byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # tokens are numbered here by rank: single bytes first, then merges in their order
        names = sorted((t for t in vocabulary if len(t) == 1), key=lambda t: letters[t])
        names += [a + b for a, b in merges]
        number = {t: k for k, t in enumerate(names)}
        self.actual = np.array([vocabulary[t] for t in names], np.uint32)
        self.parts = [(number[t], number[t]) for t in names[: len(names) - len(merges)]]
        self.parts += [(number[a], number[b]) for a, b in merges]
        self.merged = {p: k for k, p in enumerate(self.parts) if p[0] != k}
        latin = ["".join(chr(letters[c]) for c in t) for t in names]
        self.sizes = [len(t) for t in latin]
        by_bytes = {t: k for k, t in enumerate(latin)}
        self.shorter = [
            next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), -1)
            for t in latin
        ]
        self.automaton = ahocorasick.Automaton()
        for t, k in by_bytes.items():
            self.automaton.add_word(t[::-1], k)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.at_added = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.added_id = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*vocabulary.values(), *self.added_id.values()]) + 1
        token_bytes = [b""] * size
        for k, t in enumerate(latin):
            token_bytes[int(self.actual[k])] = t.encode("latin-1")
        for t, k in self.added_id.items():
            token_bytes[k] = t.encode()
        self.token_sizes = np.array([len(b) for b in token_bytes], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_pool = np.frombuffer(b"".join(token_bytes), np.uint8)

    def _fits(self, left: int, right: int) -> bool:
        """Whether no merge across their boundary would come before those inside them.

        The token of higher rank was merged last; undo it, and look at the tokens that then
        meet at the boundary: a merge of theirs must not come before the one undone.
        """
        merged, parts = self.merged, self.parts
        limit = 1 << 60
        while True:
            joint = merged.get((left, right))
            if joint is not None and joint < limit:
                return False
            if left > right:
                limit, inner = left, parts[left][1]
                if inner != left:
                    left = inner
                    continue
                return True
            limit, inner = right + 1, parts[right][0]
            if inner != right:
                right = inner
                continue
            limit, inner = left, parts[left][1]
            if inner == left:
                return True
            left = inner

    def _encode_word(self, longest: list[int]) -> list[int]:
        """``longest``: the longest token that begins at each byte of the word."""
        end = len(longest)
        if self.sizes[longest[0]] == end:  # merging may not lead there, so look at its parts
            whole = longest[0]
            if self._reachable(whole):
                return [whole]
        sizes, shorter, known = self.sizes, self.shorter, self.compatible
        alive = bytearray(b"\x01") * (end + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < end:
            last = tokens[-1] if tokens else -1
            while True:
                to = at + sizes[token]
                if alive[to]:
                    if last < 0:
                        fits = self._reachable(token)
                    else:
                        pair = (last, token)
                        fits = known.get(pair)
                        if fits is None:
                            if len(known) >= PAIRS:
                                known.clear()  # pairs are found again when they come
                            fits = known[pair] = self._reachable(token) and self._fits(last, token)
                    if fits:
                        tokens.append(token)
                        at = to
                        token = longest[at] if at < end else -1
                        break
                token = shorter[token]
                if token < 0:  # a dead end: the token before must be shorter, as its end is dead
                    alive[at] = 0
                    token = tokens.pop()
                    at -= sizes[token]
                    last = tokens[-1] if tokens else -1
        return tokens

    def _reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        known = self.compatible.get((token, -1))
        if known is None:
            left, right = self.parts[token]
            known = left == token or (
                self._reachable(left) and self._reachable(right) and self._fits_below(left, right, token)
            )
            self.compatible[(token, -1)] = known
        return known

    def _fits_below(self, left: int, right: int, token: int) -> bool:
        joint = self.merged.pop((left, right))
        try:
            return joint == token and self._fits(left, right)
        finally:
            self.merged[(left, right)] = joint

    def _learn(self, words: list[str]) -> None:
        coded = [w.encode().decode("latin-1") for w in words]
        text = self.BREAK.join(coded)
        longest = [-1] * len(text)
        last = len(text) - 1
        for end, token in self.automaton.iter(text[::-1]):
            if longest[last - end] < 0:  # the longest match at a place comes first
                longest[last - end] = token
        ids: list[int] = []
        sizes = []
        at = 0
        for word in coded:
            own = self._encode_word(longest[at : at + len(word)])
            ids += own
            sizes.append(len(own))
            at += len(word) + 1
        self._store(self.actual[np.array(ids, np.int64)], np.array(sizes, np.int64))

    def _whole(self, text: str) -> np.ndarray:
        """Texts with added tokens, or code points on which the tables could differ."""
        cuts, at = [], 0
        for found in self.at_added.finditer(text) if self.at_added else ():
            cuts += [(text[at : found.start()], False), (found.group(), True)]
            at = found.end()
        cuts.append((text[at:], False))
        out: list[np.ndarray] = []
        for part, is_added in cuts:
            if is_added:
                out.append(np.array([self.added_id[part]], np.uint32))
            elif part:
                spans = [s for _, s in self.library.pre_tokenizer.pre_tokenize_str(part)]
                out.append(self._ids_of_words([part[a:b] for a, b in spans]))
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return take_ranges(self.token_pool, self.token_starts[ids], self.token_sizes[ids])

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=1)
def backtracking_encoder(path: str) -> BacktrackingEncoder:
    return BacktrackingEncoder(path)


def encode_and_decode(docs: DataFrame, tokenizer: str | None = None, with_content: bool = False) -> DataFrame:
    """Encodes each whole text and decodes it again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_content`` adds the ids and the
    decoded text.
    """
    path = tokenizer or tokenizer_path()

    def make():
        encoder = backtracking_encoder(path)

        def step(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            for lo, hi in batches(texts):
                ids, offsets = encoder.encode(texts[lo:hi])
                sizes = encoder.token_sizes[ids]
                ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
                data = encoder.decode_bytes(ids).tobytes()
                little = ids.astype("<u4", copy=False)
                digests, decoded, own, out = [], [], [], []
                for k in range(hi - lo):
                    part = little[offsets[k] : offsets[k + 1]]
                    raw = data[ends[k] : ends[k + 1]]
                    text = raw.decode("utf-8", "replace")
                    digests.append(hashlib.sha256(part).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_content:
                        own.append(part.tolist())
                        out.append(text)
                columns = [
                    batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(digests), pa.array(decoded),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_content:
                    columns += [pa.array(own, pa.list_(pa.int64())), pa.array(out, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.record_batch(columns, names=names)

        return step

    return arrow_map(
        docs.select("doc_id", "text"), make,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
        + (", ids array<long>, decoded string" if with_content else ""),
    )


__all__ = ["BacktrackingEncoder", "backtracking_encoder", "encode_and_decode"]
