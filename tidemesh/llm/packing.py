"""Packing documents into fixed-length token sequences by minimum bin slack.

Texts are tokenized once; each document is cut into full pieces and a rest. Rests are packed in groups of bounded
size: for each sequence a subset-sum over the multiset of remaining lengths, on bitsets, finds the filling closest to
capacity, and backtracking gives how many of each length it takes.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.llm.common import saved, small_batches, table

#: Tokens in a sequence; pieces that are packed together (a group always fits in a task); words that a task remembers.
CAPACITY, GROUP, REMEMBERED = 2048, 4096, 200_000
END = 1
#: Longer words aren't remembered, so that what a task remembers is bounded in bytes too.
LONG = 256
#: A line break that is a pre-token of its own, as it stands alone between other characters than white space.
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
_BREAKS = "\n\t\r\v\f\x1c\x1d\x1e\x1f"
#: White space, letters and numbers of a range in which the library's classes are fixed: Latin, and punctuation that isn't ASCII.
_SPACES, _LETTERS, _NUMBERS = r"\t-\r \x85\xa0", r"A-Za-zªµºÀ-ÖØ-öø-ʯ", r"0-9²³¹¼-¾"
_OTHER = re.compile(r"[^\x00-ʯ\u2010-\u2027\u2030-\u205e]")
#: The pre-tokens of the library's byte-level split, for texts without _OTHER.
_TOKEN = re.compile(
    rf" [{_LETTERS}]++|[{_LETTERS}]++| ?[{_NUMBERS}]++|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]++|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]++"
)
_WIDE_BREAKS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Words(dict):
    """Word -> its ids as little-endian 32-bit bytes, filled when asked for; it holds two times REMEMBERED at most, none over LONG."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or self.encode(word)
        if len(word) > LONG:
            return ids
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class ByteTokenizer:
    """Encodes texts with a byte-level BPE file of the tokenizers library.

    A text of Latin letters, ASCII and general punctuation is cut into pre-tokens as the library does, and its model encodes
    each different one once. Pre-tokens never reach over a single space that stands between other characters than white
    space, so a text with other characters is encoded word by word, equal words once; if it has other white space it is
    encoded whole, as are texts that hold the literal of an added token, which the library takes for that token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokens = Words(self.token)
        self.bare, self.spaced = Words(lambda w: self.word("", w)), Words(lambda w: self.word(" ", w))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow 255
        self.line = self.whole("\n")
        self.shown = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.space = chr(self.shown[ord(" ")])

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def token(self, token: str) -> bytes:
        """A pre-token, which the model encodes without further search."""
        if token.isascii() and token.isprintable():
            shown = token.replace(" ", self.space)
        else:
            shown = token.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def known(self, text: str) -> bytes:
        """A text without _OTHER."""
        return b"".join(map(self.tokens.__getitem__, _TOKEN.findall(text)))

    def word(self, prefix: str, word: str) -> bytes:
        """A word that spaces bound."""
        if not _OTHER.search(word):
            return self.known(prefix + word)
        own = self.spaced if prefix else self.bare
        if "\n" in word:
            first, *rest = _LINE.split(word)
            if rest:
                return self.line.join([own[first], *map(self.bare.__getitem__, rest)])
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return own[word[:-1]] + self.bare[word[-1]]
        return self.whole(prefix + word)

    def plain(self, text: str) -> bool:
        """Whether every space stands alone."""
        if "  " in text or any(c in text and (f"{c} " in text or f" {c}" in text) for c in _BREAKS):
            return False
        return text.isascii() or not any(c in text for c in _WIDE_BREAKS)

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self.whole(text)
        if text.isascii() or not _OTHER.search(text):
            return self.known(text)
        if not self.plain(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))


@lru_cache(maxsize=1)
def byte_tokenizer(path: str) -> ByteTokenizer:
    """The tokenizer of a Python worker, whose words stay remembered from task to task."""
    return ByteTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, nth, start, length, ids_crc32, doc_tokens (and ids, if asked for) per piece of at most capacity tokens.

    Every text ends with END; a null text is empty, so each document has a token at least. nth numbers the rows of a
    table, so that repeated rows stay apart.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, nth = byte_tokenizer(tokenizer_path), TaskContext.get().partitionId() << 33
        end, width = array("I", [END]).tobytes(), capacity * 4
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                data = tokenizer.encode(text or "") + end
                for at in range(0, len(data), width):
                    part = data[at : at + width]
                    out.append((doc_id, nth, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4, part)[: 7 if ids else 6])
                nth += 1
            yield pd.DataFrame(out, columns=["doc_id", "nth", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 7 if ids else 6])

    # ids go as text, as pandas turns longs with nulls to floats
    schema = "doc_id string, nth long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def fill(counts: dict[int, int], lengths: list[int], capacity: int) -> list[int]:
    """The lengths of one sequence: the longest left, and those that leave the least slack beside it.

    lengths are counts' keys in falling order. A total that is a power of two counts as full, as it isn't padded; of
    those, capacity comes first.
    """
    big = lengths[0]
    room = capacity - big
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        left = min(counts[length] - (length == big), room // length)
        many = 1
        while left > 0:
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= (reach << (many * length)) & mask
            left, many = left - many, many * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    if total < room:
        powers = [p - big for p in (1 << k for k in range(capacity.bit_length())) if big <= p <= capacity and reach >> (p - big) & 1]
        total = max(powers, default=total)
    used = [big]
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            used += [length] * many
            total -= length * many
    return used


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, sequences numbered from 0."""
    order = np.argsort(-lengths, kind="stable")
    waiting: dict[int, list[int]] = {}
    for i in order[::-1]:
        waiting.setdefault(int(lengths[i]), []).append(int(i))
    counts = {k: len(v) for k, v in waiting.items()}
    left = sorted(counts, reverse=True)
    sequence, offset, n = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64"), 0
    while left:
        at = 0
        for length in fill(counts, left, capacity):
            i = waiting[length].pop()
            sequence[i], offset[i] = n, at
            at += length
            counts[length] -= 1
            if not counts[length]:
                left.remove(length)
        n += 1
    return sequence, offset


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts with sequence_id and offset: sequences hold at most capacity tokens, their pieces stand without gaps.

    Pieces are dealt by hash into groups of about GROUP, each packed on its own; a group leaves at most a few
    sequences that aren't full.
    """
    parts = saved(parts, "pieces")
    groups = -(-parts.count() // GROUP) or 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["nth", "start"])
        sequence, offset = pack_lengths(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(pdf["group"].to_numpy() << 32) + sequence, offset=offset).drop(columns="group")

    dealt = parts.withColumn("group", F.pmod(F.xxhash64("nth", "start"), F.lit(groups))).withColumn("doc_id", F.col("doc_id").cast("string"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema if f.name != "group")
    packed = dealt.groupBy("group").applyInPandas(run, f"{kinds}, sequence_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """sequence_id, ids (array of int) and n_tokens per sequence of packed pieces with ids, padded unless a power of two."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(pdf.sort_values("offset")["ids"])
        n = len(data) // 4
        full = n & (n - 1) == 0
        ids = np.concatenate([np.frombuffer(data, "<u4").astype("int32"), np.full(0 if full else capacity - n, pad, "int32")])
        return pd.DataFrame({"sequence_id": pdf["sequence_id"].iloc[:1], "ids": [ids], "n_tokens": [n]})

    return packed.groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids array<int>, n_tokens long")


def op9_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    parts = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
