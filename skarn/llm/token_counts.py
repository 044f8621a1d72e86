"""Token counts of sections and fields from one encoding of the whole document.

A document is encoded once, and the byte spans of its tokens are joined with the spans of its
sections as intervals. A token that crosses a boundary is allocated by ``rule``:

- ``first``: to the section that holds the token's first byte;
- ``most``: to the section that holds most of its bytes, the earlier one in a tie;
- ``share``: to each section that it touches, by its share of the token's bytes.

Under each rule the counts of a document's sections add up to the document's tokens.

A section is a line with its line end (``separator``, one ASCII character). Text after the last
line end is a section only if there is any; a null or empty text has one empty section.
Repeated rows give repeated rows; a null doc_id is kept; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.bpe import backtracking_encoder
from skarn.llm.common import arrow_map
from skarn.llm.encoding import batches, tokenizer_path

RULES = ("first", "most", "share")


def section_ends(raw: np.ndarray, text_ends: np.ndarray, separator: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all sections (bytes from the batch's begin), and the text that each is of."""
    marks = np.flatnonzero(raw == separator) + 1
    ends = np.concatenate([marks, text_ends])
    texts = np.concatenate(
        [np.searchsorted(text_ends, marks, side="left"), np.arange(len(text_ends))]
    )
    # a text's own end comes last; it is no section of its own when a line end stands there
    order = np.lexsort((np.arange(len(ends)) >= len(marks), ends, texts))
    ends, texts, final = ends[order], texts[order], (order >= len(marks))
    doubled = np.zeros(len(ends), bool)
    doubled[1:] = final[1:] & (texts[1:] == texts[:-1]) & (ends[1:] == ends[:-1])
    return ends[~doubled], texts[~doubled]


def allocate(
    token_ends: np.ndarray, ends: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by ``rule``, and how many of the tokens it holds cross a boundary.

    Both lists of intervals are gapless over the same bytes, so that ends alone give them;
    empty sections hold nothing.
    """
    n = len(ends)
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(ends, starts, side="right")
    last = np.searchsorted(ends, token_ends - 1, side="right")
    crossing = first != last
    if rule == "first":
        owner = first
    else:
        owner = first.copy()
        counts = np.bincount(first[~crossing], minlength=n).astype(float)
        for k in np.flatnonzero(crossing):  # few: a token hardly ever spans a line end
            cuts = np.clip(ends[first[k] : last[k] + 1], starts[k], token_ends[k])
            sizes = np.diff(np.concatenate([[starts[k]], cuts]))
            owner[k] = first[k] + int(sizes.argmax())
            if rule == "share":
                counts[first[k] : last[k] + 1] += sizes / (token_ends[k] - starts[k])
        if rule == "share":
            return counts, np.bincount(owner[crossing], minlength=n)
    return np.bincount(owner, minlength=n).astype(float), np.bincount(owner[crossing], minlength=n)


def given_ends(raw: np.ndarray, text_ends: np.ndarray, begins: np.ndarray, ends: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ends of sections in bytes, from ends in characters of each text, and the text that each is of."""
    char_starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    sizes = np.array([len(e) for e in ends], np.int64)
    owner = np.repeat(np.arange(len(ends)), sizes)
    first_char = np.searchsorted(char_starts, begins)
    at = np.fromiter((e for own in ends for e in own), np.int64, int(sizes.sum()))
    return char_starts[first_char[owner] + at], owner


def allocated(docs: DataFrame, tokenizer: str | None, rule: str, separator: str | None) -> DataFrame:
    """key, section, start_char, end_char, n_tokens, n_crossing of ``docs(key, text[, ends])``.

    Sections end at ``separator``, or else at the characters of ``ends``, of which the last is the text's end.
    """
    path = tokenizer or tokenizer_path()

    def make():
        encoder = backtracking_encoder(path)

        def step(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            for lo, hi in batches(texts):
                coded = [(t or "").encode() for t in texts[lo:hi]]
                text_ends = np.cumsum([len(b) for b in coded])
                text_begins = text_ends - [len(b) for b in coded]
                raw = np.frombuffer(b"".join(coded), np.uint8)
                ids, _ = encoder.encode(texts[lo:hi])
                if separator is not None:
                    ends, owner = section_ends(raw, text_ends, ord(separator))
                else:
                    ends, owner = given_ends(raw, text_ends, text_begins, batch.column(2).slice(lo, hi - lo).to_pylist())
                tokens, crossing = allocate(np.cumsum(encoder.token_sizes[ids]), ends, rule)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                begins = chars[text_begins]
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                number = np.arange(len(owner)) - np.repeat(first, np.diff([*first, len(owner)]))
                end_char = chars[ends] - begins[owner]
                start_char = np.where(number > 0, np.concatenate([[0], end_char[:-1]]), 0)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(owner)), pa.array(number.astype(np.int32)),
                        pa.array(start_char), pa.array(end_char), pa.array(tokens), pa.array(crossing.astype(np.int64)),
                    ],
                    names=["key", "section", "start_char", "end_char", "n_tokens", "n_crossing"],
                )

        return step

    kind = dict(docs.dtypes)["key"]
    return arrow_map(docs, make, f"key {kind}, section int, start_char long, end_char long, n_tokens double, n_crossing long")


def section_token_counts(
    docs: DataFrame, tokenizer: str | None = None, rule: str = "first", separator: str = "\n"
) -> DataFrame:
    """One row a section: doc_id, section int, start_char, end_char, n_tokens double, n_crossing."""
    if rule not in RULES or len(separator) != 1 or not separator.isascii():
        raise ValueError("unknown rule or separator")
    return allocated(docs.select(F.col("doc_id").alias("key"), "text"), tokenizer, rule, separator).withColumnRenamed("key", "doc_id")


def field_token_counts(
    df: DataFrame, key: str, fields: list[str], tokenizer: str | None = None, rule: str = "first"
) -> DataFrame:
    """Tokens of each field when the fields are encoded as one text, a line end after each.

    The text is the fields' own, unchanged; a field ends where its characters and its line end do, whatever
    it holds. A null field counts as empty. Returns the key as doc_id, of whatever type it is, field, n_tokens.
    """
    if rule not in RULES:
        raise ValueError("unknown rule")
    own = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    ends = [sum((F.length(c) + 1 for c in own[1 : k + 1]), F.length(own[0]) + 1) for k in range(len(own))]
    joined = df.select(F.col(key).alias("key"), F.concat(*[F.concat(c, F.lit("\n")) for c in own]).alias("text"), F.array(*ends).alias("ends"))
    counts = allocated(joined, tokenizer, rule, None)
    names = F.array(*[F.lit(f) for f in fields])
    return counts.select(F.col("key").alias("doc_id"), F.element_at(names, F.col("section") + 1).alias("field"), "n_tokens")
