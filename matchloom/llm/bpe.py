"""Byte-pair encoding by a queue of merge ranks, and decoding, with the vocabulary of a tokenizer file."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Encodings of words, and of what stands between blanks, that a worker keeps: twice as many of each, at most.
CACHE_ENTRIES = 1 << 18
#: Blanks for str.split() but not for the tokenizer.
ODD_BLANKS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Recent(dict):
    """A dictionary of bounded size: when it is full it becomes the older one, whose entries return when asked for."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


class WordBpe:
    """A lower-casing word-level BPE: NFC, blanks to one, lower case; words, digits and runs of signs; word ends marked.

    Texts are cut at blanks first: no token and no normalisation step reaches over one, so what stands between blanks
    is encoded by itself and remembered.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = self.vocab | self.special
        self.names: list[str] = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ids = self.vocab
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
        self.blanks = regex.compile(r"\p{White_Space}+").split
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        symbols = byte_symbols()
        self.byte_ids = [ids.get(c, -1) for c in symbols]
        self.end_ids = [ids.get(c + self.end, -1) for c in symbols]
        self.word_cache, self.piece_cache = Recent(CACHE_ENTRIES), Recent(CACHE_ENTRIES)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the pair of least rank, leftmost first, until none is left.

        The symbols are a doubly linked list; the queue holds (rank, place, pair, merged id). An entry whose pair no
        longer stands at its place is stale and skipped.
        """
        n, get = len(ids), self.merges.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m[0], i, p, m[1]) for i, p in enumerate(zip(ids, ids[1:])) if (m := get(p))]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, pair, new = pop(queue)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if m := get(p := (new, ids[k])):
                    push(queue, (m[0], i, p, m[1]))
            if (h := before[i]) >= 0 and (m := get(p := (ids[h], new))):
                push(queue, (m[0], h, p, m[1]))
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "replace")
        ids = [self.byte_ids[b] for b in raw]
        ids[-1] = self.end_ids[raw[-1]]
        ids = self.merge([i for i in ids if i >= 0] if -1 in ids else ids)
        out = pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            self.word_cache.put(word, out)
        return out

    def _piece(self, piece: str) -> bytes:
        """Ids of what stands between two blanks, as little-endian 32-bit numbers."""
        text = piece if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ")  # no final sigma
        text = text.lower()
        words = (text,) if text.isalpha() and text.isascii() else self.words(text)
        out = b"".join([self.word_cache[w] or self._word(w) for w in words])
        if len(piece) <= 64:
            self.piece_cache.put(piece, out)
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        cached, out = self.piece_cache, []
        parts = self.specials(text or "") if "<|" in (text or "") else (text or "",)
        for part in parts:
            if part in self.special:
                out.append(pack("<I", self.special[part]))
                continue
            pieces = self.blanks(part) if ODD_BLANKS.search(part) else part.split()
            out += [cached[p] or self._piece(p) for p in pieces if p]
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a text; null and empty: none."""
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode(self, ids) -> str:
        """The vocabulary's strings, one after another with a blank between (this vocabulary's file names no decoder)."""
        names = self.names
        return " ".join([names[i] for i in np.asarray(ids).tolist()])


@lru_cache(2)
def load(path: str) -> WordBpe:
    """One tokenizer a worker."""
    return WordBpe(path)


def _free(docs: DataFrame, out: str) -> None:
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {out}: name another for the result")


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with a column of token ids (array<int>) of each whole text; null and empty text: an empty array. Rows are never lost,
    repeated ones are encoded alike, an empty table gives none. A column `out` that docs has already is an error."""
    _free(docs, out)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(tokenizer)
        for b in batches:
            yield pd.Series([t.encode(x).astype(np.int32) for x in b])

    return docs.withColumn(out, run(F.coalesce(F.col(text_col), F.lit(""))))


def bpe_decode(docs: DataFrame, tokenizer: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with the text that each array of ids decodes to; null: null, no ids: the empty text. Rows as in bpe_encode."""
    _free(docs, out)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(tokenizer)
        for b in batches:
            yield pd.Series([None if x is None else t.decode(x) for x in b], dtype=object)

    return docs.withColumn(out, run(F.col(ids_col)))


def bpe_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, and its ids decoded, in one pass.

    Null and empty texts have no tokens, and the digests of nothing. One row for each row of docs, repeated or not.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = load(tokenizer)
        sha = hashlib.sha256
        for b in batches:
            rows = []
            for i, x in zip(b["id"], b["t"]):
                ids = t.encode_bytes(x)
                decoded = t.decode(np.frombuffer(ids, "<u4"))
                rows.append((i, len(ids) // 4, sha(ids).hexdigest(), sha(decoded.encode("utf-8")).hexdigest()))
            out = pd.DataFrame(rows, columns=["id", "n", "i", "d"])
            out["id"] = b["id"].to_numpy()
            yield out

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    made = rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, n long, i string, d string")
    return made.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("i").alias("ids_sha256"), F.col("d").alias("decoded_sha256"))
