"""Token counts by offset-mapped attribution: whole documents are encoded once, and tokens joined to sections."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("first", "last", "longest", "split")


@cache
def encoding(vocabulary: str, pattern: str):
    """The encoding and the bytes of each of its tokens; once in a process."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def line_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines of a text, each with its line end; no text has no line."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.flatnonzero(data == 10) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.r_[ends, len(data)]
    return np.r_[0, ends[:-1]], ends


def attribute_spans(starts: np.ndarray, ends: np.ndarray, section_starts: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them also lie in another, for sorted sections that don't overlap.

    A token that crosses a boundary goes to the section of its first byte ("first"), of its last ("last"), to that
    which holds most of its bytes, the earlier on ties ("longest"), or to each by its share of bytes ("split").
    Bytes outside all sections count for none, so a token that touches no section is attributed to none.
    """
    n = len(section_starts)
    counts, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not n or not len(starts):
        return counts, crossing
    low = np.searchsorted(section_ends, starts, "right")
    high = np.searchsorted(section_starts, ends, "left")  # sections low to high - 1 overlap the token
    met = high - low
    one = met == 1
    np.add.at(counts, low[one], 1.0 if rule != "split" else (np.minimum(ends[one], section_ends[low[one]]) - np.maximum(starts[one], section_starts[low[one]])) / (ends[one] - starts[one]))
    for k in np.flatnonzero(met > 1):
        of = np.arange(low[k], high[k])
        share = np.minimum(ends[k], section_ends[of]) - np.maximum(starts[k], section_starts[of])
        crossing[of] += 1
        if rule == "split":
            counts[of] += share / (ends[k] - starts[k])
        else:
            counts[{"first": of[0], "last": of[-1], "longest": of[int(np.argmax(share))]}[rule]] += 1
    return counts, crossing


def attribute_any(starts: np.ndarray, ends: np.ndarray, at: np.ndarray, to: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """attribute_spans() for sections in any order: of sections that overlap, the earlier one has what they share; empty ones have none."""
    order = np.lexsort((to, at))
    a, b = at[order], to[order]
    a = np.maximum(a, np.r_[0, np.maximum.accumulate(b)[:-1]]) if len(a) else a
    held = order[a < b]
    counts, crossing = np.zeros(len(at)), np.zeros(len(at), np.int64)
    counts[held], crossing[held] = attribute_spans(starts, ends, a[a < b], b[a < b], rule)
    return counts, crossing


def count_in(text: str, spans: list | None, rule: str, vocabulary: str, pattern: str) -> list[tuple]:
    """(section, start, end, tokens, crossing) of each section, and of section -1: all tokens of the text."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    encoder, sizes = encoding(vocabulary, pattern)
    ends = np.cumsum(sizes[np.asarray(encoder.encode_ordinary(text), np.int64)])
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # characters before each byte
    if spans is None:
        at, to = line_spans(data)
        known = np.ones(len(at), bool)
    else:
        places = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
        offsets = [(s["start"], s["end"]) if s is not None else (None, None) for s in spans]
        known = np.array([a is not None and b is not None for a, b in offsets], bool)
        at, to = (places[np.clip(np.array([x[k] if ok else 0 for x, ok in zip(offsets, known, strict=True)], np.int64), 0, len(places) - 1)] for k in (0, 1))
    counts, crossing = attribute_any(starts, ends, at, to, rule)
    shown = lambda x: [int(chars[k]) if ok else None for k, ok in zip(x, known, strict=True)]
    whole = (-1, 0, int(chars[-1]), float(len(ends)), 0)
    return [whole, *zip(range(len(at)), shown(at), shown(to), counts.tolist(), crossing.tolist(), strict=True)]


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN
) -> DataFrame:
    """(id, section, start, end, tokens, crossing): the tokens of each section of each text, encoded whole and once.

    Sections are the lines of the text, or where sections_col is given its array<struct<start, end>> of character
    offsets, in any order; offsets beyond the text are clipped, and where sections overlap the earlier one has what they
    share. A section that is null, has a null offset or holds nothing has no tokens. start and end are character offsets.
    Section -1 is the whole text, and for the rules but "split" sections that cover the text add up to it. crossing
    counts tokens that also lie in another section. tokens is a double; only "split" makes fractions.

    A null or empty text has the row of section -1 alone, with no tokens. Texts that look like special tokens are
    ordinary text. Repeated rows give repeated rows, null ids stay null, an empty table gives an empty one. There is
    no shuffle: a document's tokens and sections meet where the document is.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {', '.join(RULES)}")
    kind = "array<struct<section:int,start:long,end:long,tokens:double,crossing:long>>"
    text = F.coalesce(F.col(text_col), F.lit(""))

    @F.pandas_udf(kind)
    def by_lines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([count_in(t, None, rule, vocabulary, pattern) for t in batch], dtype=object)

    @F.pandas_udf(kind)
    def by_spans(texts: pd.Series, sections: pd.Series) -> pd.Series:
        return pd.Series([count_in(t, [] if s is None else list(s), rule, vocabulary, pattern) for t, s in zip(texts, sections, strict=True)], dtype=object)

    counted = by_lines(text) if sections_col is None else by_spans(text, F.col(sections_col))
    return docs.select(F.col(id_col).alias("id"), F.explode(counted).alias("found")).select("id", "found.*")
