"""Quality rules: base counts, and the share of characters inside repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A text fails if a larger share of its word characters lies inside n-grams found earlier in it, as Rae et al. (2021) have it. Lines
#: that repeat a line are left out first: they have a limit of their own, and a site's line that stands twice on a short page
#: is for line dedup to drop.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: ... or in lines equal to an earlier one.
LINE_LIMIT = 0.20
#: Symbols that base rules count.
SYMBOLS = "#*$%&|<>"
#: Odd multiplier of the rolling hash, modulo 2^64.
RADIX = np.uint64(0x9E3779B97F4A7C15)
DROP_SYMBOLS = str.maketrans("", "", SYMBOLS)


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks over windows: found twice or more; found earlier in the text."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    later = np.zeros(len(key), bool)
    later[order[1:]] = same
    any_ = later.copy()
    any_[order[:-1]] |= same
    return any_, later


def _cover(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Mask of the n words that lie in a window of `width` words with a marked start."""
    edge = np.zeros(n + 1, np.int32)
    edge[: len(starts)] += starts
    edge[width : width + len(starts)] -= starts
    return np.cumsum(edge[:n]) > 0


def repetition(ids: np.ndarray, chars: np.ndarray, limits: dict[int, float]) -> dict[int, float]:
    """Share of word characters inside n-grams found earlier, by n.

    A rolling hash: the key of n words is that of n - 1 times RADIX plus the next word's number, over the whole text at
    once in numpy; 64 bits, so that two different n-grams of a text meet with probability below 10^-8 even at a million
    words. Word numbers are spread by RADIX first. No word: shares of zero.
    """
    n, total = len(ids), max(1, int(chars.sum()))
    word = (ids.astype(np.uint64) + np.uint64(1)) * RADIX
    word ^= word >> np.uint64(29)
    out, key = {}, word
    for k in range(2, max(limits) + 1):
        if n < k:
            break
        key = key[: n - k + 1] * RADIX + word[k - 1 :]
        if k in limits:
            mixed = key ^ (key >> np.uint64(32))
            _, later = _repeats(mixed)
            out[k] = float(chars[_cover(later, n, k)].sum()) / total if later.any() else 0.0
            if not out[k] and not later.any():
                break  # no repeated k-gram, so no longer one
    return {k: out.get(k, 0.0) for k in limits}


def _lengths(words: list[bytes], ascii_only: bool) -> np.ndarray:
    """Characters of each word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    if not ascii_only:
        for i in np.flatnonzero(np.fromiter((not w.isascii() for w in words), bool, len(words))):
            size[i] = len(words[i].decode("utf-8", "surrogatepass"))
    return size


def measure(text: str | None, limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, largest n-gram share, line share)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes: at 0x20 and 0x09-0x0D only
    n, plain = len(words), text.isascii()
    n_symbols = len(text) - len(text.translate(DROP_SYMBOLS))
    chars = _lengths(words, plain)
    word_chars = int(chars.sum())
    dup_lines, fresh = 0, np.ones(n, bool)  # fresh: words that aren't in a line equal to an earlier one
    if b"\n" in raw:
        seen: set[bytes] = set()
        at = 0
        for line in raw.split(b"\n"):
            k = len(line.split())
            if not k:
                continue
            if line in seen:
                dup_lines += 1
                fresh[at : at + k] = False
            seen.add(line)
            at += k
    repeat_words, shares = 0, dict.fromkeys(limits, 0.0)
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
        if len(number) < 1 << 21:
            three = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        else:  # numbers of pairs in place of pairs: exact for any count of words
            pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
            three = pair[:-1] * len(number) + ids[2:]
        twice, _ = _repeats(three)
        if twice.any():
            repeat_words = int(_cover(twice, n, 3).sum())
            shares = repetition(ids[fresh], chars[fresh], limits)
    base_failed = n < 50 or 100 * repeat_words > 50 * n
    line_share = int(chars[~fresh].sum()) / max(1, word_chars)
    kept = not base_failed and line_share <= line_limit and all(shares[k] <= v for k, v in limits.items())
    return n, word_chars, n_symbols, dup_lines, repeat_words, base_failed, kept, max(shares.values()), line_share


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ngram_share double, line_share double"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Rows (id_col, counts, base_failed, kept, shares), one per row of docs; whole texts, each by itself, no shuffle.

    Null and empty texts have no words and fail the base rules; repeated rows are measured alike; an empty table gives no
    rows; other columns play no part.
    """
    limits = limits or NGRAM_LIMITS
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([measure(t, limits, line_limit) for t in b["t"]], columns=names)
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, {FIELDS}").withColumnRenamed("id", id_col)


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose text the rules keep: null and empty texts go, repeated rows stay or go together, an empty
    table gives none; all columns pass through, and texts are measured where they are read."""

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([measure(t)[6] for t in b], dtype=bool)

    return docs.where(good(F.coalesce(F.col(text_col), F.lit(""))))
