"""Exact token counts of every prefix of a text, for a byte-level BPE vocabulary.

The text is cut into pieces as the vocabulary's splitter cuts it. Within a piece the counts come
from a dynamic program over its bytes: the encoding of a prefix ends in exactly one token, namely
that token ``t`` for which the encoding of what stands before ``t`` ends in a token that may stand
before ``t`` (two tokens may stand side by side if merging their joined bytes gives the two again).
So ``count[j] = count[j - len(t)] + 1``, and one pass over the bytes counts all prefixes. Pieces
repeat, so a task keeps the counts of the pieces it has met.

A prefix can end where the splitter would cut it otherwise than it cuts the whole text: inside a
contraction, after the last of several white-space characters, inside the string of a special
token. Those few prefixes are cut and counted anew.

With the counts kept, questions on budgets need no encoding: ``tokens_of`` is the number of tokens
of a prefix, ``longest_within`` the longest prefix that fits a budget. (A longer prefix may have
fewer tokens, so this is not a binary search.)

Edge cases: a null text is empty and has no prefixes; ids may be null or repeat, every row gives a
row; an empty table gives none. Texts are read whole whatever their length. Other columns are not read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from worklens.llm.common import kept_by_worker, rows_of, ship, table

ship(__name__)

LIMIT = 1024
#: Pieces whose counts a task keeps, and prefixes in one batch of results.
KEPT_PIECES = 400_000
BATCH_PREFIXES = 2_000_000
#: Bytes at the start of pieces, with which the program goes on for other pieces.
COMMON = 8
# The splitter of byte-level vocabularies and the contractions in it that have three characters.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for themselves, the other bytes, in order, for U+0100 and on.
    """
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary file: tokens as bytes, merges by rank, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if (model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)
                or spec.get("normalizer") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("continuing_subword_prefix")
                or model.get("end_of_word_suffix") or model.get("dropout")):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path} has special tokens with options")
        byte = byte_of_character()
        raw = lambda token: bytes(byte[c] for c in token)
        self.special = [t["content"] for t in added]
        self.id_of = {raw(token): number for token, number in model["vocab"].items() if token not in set(self.special)}
        self.ranks, self.halves = {}, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            if left + right in self.halves:
                raise ValueError(f"two merges of {path} give the same token")
            self.ranks[left, right], self.halves[left + right] = rank, (left, right)
        # every beginning of a token; the tokens that end it, longest first, are filled in on demand
        self.heads = dict.fromkeys({token[:i] for token in self.id_of for i in range(len(token) + 1)})
        self.edges, self.neighbours, self.common = {}, {}, {}

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand, one after the other, at the left (0) or right (1) end of a token while it is
        merged, each with the rank of the merge that takes it in."""
        found = self.edges.get((token, side))
        if found is None:
            found, part, rank = [], token, 1 << 60
            while True:
                found.append((part, rank))
                if part not in self.halves:
                    break
                rank, part = self.ranks[self.halves[part]], self.halves[part][side]
            self.edges[token, side] = found
        return found

    def merged(self, text: bytes) -> list[bytes]:
        """The tokens of a short run of bytes, by applying the merges in the order of their ranks."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, before: bytes, token: bytes) -> bool:
        """Whether the two tokens stand side by side in an encoding; ``before`` is empty at the start of a piece.

        They do unless a merge across the border comes before the merges that take in its two parts.
        Of equal merges the left one comes first.
        """
        if not before:
            return self.merged(token) == [token]
        for left, inside_left in self.edge(before, 1):
            for right, inside_right in self.edge(token, 0):
                across = self.ranks.get((left, right))
                if across is not None and across < inside_left and across <= inside_right:
                    return False
        return self.fits(b"", token)

    def fits(self, before: bytes, token: bytes) -> bool:
        known = self.neighbours.get((before, token))
        if known is None:
            known = self.neighbours[before, token] = self.may_follow(before, token)
        return known

    def endings(self, head: bytes) -> tuple[bytes, ...]:
        """The tokens that end a beginning of a token, longest first."""
        found = self.heads[head] = tuple(head[i:] for i in range(len(head)) if head[i:] in self.id_of)
        return found

    def piece_counts(self, piece: bytes) -> list[int]:
        """The number of tokens of every prefix of a piece, by bytes."""
        heads, neighbours, key = self.heads, self.neighbours, piece[:COMMON]
        known = self.common.get(key) if len(piece) > COMMON else None
        head, last, counts = (known[0], known[1][:], known[2][:]) if known else (b"", [b""], [0])
        for end in range(len(counts), len(piece) + 1):
            # the longest ending of the prefix that begins a token: whatever token ends the prefix ends it too
            head += piece[end - 1:end]
            while head not in heads:
                head = head[1:]
            for token in heads[head] or self.endings(head):
                start = end - len(token)
                pair = last[start], token
                known = neighbours.get(pair)
                if known or (known is None and self.fits(*pair)):
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends {piece[:end]!r}")
            if end == COMMON and len(piece) > COMMON and len(self.common) < KEPT_PIECES:
                self.common[key] = head, last[:], counts[:]
        return counts[1:]


class Pieces(dict):
    """piece -> its prefixes' counts by characters, as bytes of 32-bit numbers; filled on demand, emptied when full."""

    def __init__(self, vocabulary: Vocabulary, kept: int):
        super().__init__()
        self.vocabulary, self.kept = vocabulary, kept

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.kept:
            self.clear()
        self[piece] = found = self.counted(piece)
        return found

    def counted(self, piece: str) -> bytes:
        raw = piece.encode()
        counts = self.vocabulary.piece_counts(raw)
        if len(raw) > len(piece):
            # a character ends where the next byte does not continue it
            counts = [n for n, after in zip(counts, raw[1:] + b" ", strict=True) if after & 0xC0 != 0x80]
        if piece in CONTRACTIONS:
            # before its last letter a contraction is an apostrophe and a letter of their own
            counts[1] = counts[0] + self.vocabulary.piece_counts(piece[1].encode())[-1]
        return array("i", counts).tobytes()

    def total(self, text: str) -> int:
        """The tokens of a text without special strings, cut afresh."""
        return sum(int(np.frombuffer(self[p], dtype=np.int32)[-1]) for p in CUT.findall(text))


CUT, RUN = regex.compile(SPLITTER), regex.compile(r"\s\s\S")
SPACES = frozenset(regex.findall(r"\s", "".join(map(chr, range(0x3001)))))


def segment_counts(pieces: Pieces, text: str) -> tuple[np.ndarray, str]:
    """The counts of every prefix of a text without special strings, and its last piece."""
    cut = CUT.findall(text)
    if not cut:
        return np.zeros(0, dtype=np.int64), ""
    within = [pieces[p] for p in cut]
    lengths = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
    counts = np.frombuffer(b"".join(within), dtype=np.int32).astype(np.int64)
    ends = lengths.cumsum()
    totals = counts[ends - 1]
    before = totals.cumsum() - totals
    counts += np.repeat(before, lengths)
    if RUN.search(text):
        for i, piece in enumerate(cut[:-1]):
            if piece[-1] in SPACES and cut[i + 1][0] in SPACES:
                # up to here the white space is one piece, as nothing follows it yet
                counts[ends[i]] = before[i] + pieces.total(piece + cut[i + 1][0])
    return counts, cut[-1]


def prefix_counts(pieces: Pieces, text: str) -> np.ndarray:
    """The number of tokens of every prefix of a text, by characters."""
    special = pieces.vocabulary.special
    if not any(s in text for s in special):
        return segment_counts(pieces, text)[0]
    out, before, at = [], 0, 0
    for match in regex.finditer("|".join(map(regex.escape, sorted(special, key=len, reverse=True))), text):
        counts, last = segment_counts(pieces, text[at:match.start()])
        total = int(counts[-1]) if len(counts) else 0
        stable = before + total - (pieces.total(last) if last else 0)
        # an unfinished special string is ordinary text after the last piece
        partial = [stable + pieces.total(last + match[0][:i]) for i in range(1, len(match[0]))]
        before_next = before + total + 1
        out += [counts + before, np.array([*partial, before_next], dtype=np.int64)]
        before, at = before_next, match.end()
    return np.concatenate([*out, segment_counts(pieces, text[at:])[0] + before])


def counter(path: str, kept: int = KEPT_PIECES, batch: int = BATCH_PREFIXES):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ids, sizes, found, held = None, [], [], [], 0

        def flush() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in found])]).astype(np.int32)
            values = pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, dtype=np.int32))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                                              names=["doc_id", "n_bytes", "prefix_tokens"])

        for rows in batches:
            pieces = pieces if pieces is not None else kept_by_worker(("pieces", path, kept), lambda: Pieces(Vocabulary(path), kept))
            for doc_id, text in rows_of(rows):
                counts = prefix_counts(pieces, text or "")
                ids.append(doc_id)
                sizes.append(len((text or "").encode()))
                found.append(counts)
                held += len(counts)
                if held >= batch or len(ids) >= 1000:
                    yield flush()
                    ids, sizes, found, held = [], [], [], 0
        if ids:
            yield flush()
    return count


def token_prefixes(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, prefix_tokens): at place i of the array the tokens of the first i characters."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(counter(path), "doc_id long, n_bytes long, prefix_tokens array<int>")


def tokens_of(prefix_tokens: str | Column, characters: int | Column | None = None) -> Column:
    """The tokens of the first ``characters`` characters (no more than there are), by default of the whole text."""
    counts = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    size = F.size(counts)
    at = size if characters is None else F.least(size, characters if isinstance(characters, Column) else F.lit(characters))
    return F.coalesce(F.get(counts, at - 1), F.lit(0)).cast("long")


def longest_within(prefix_tokens: str | Column, budget: int) -> Column:
    """The characters of the longest prefix of at most ``budget`` tokens."""
    counts = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    size = F.size(counts)
    fits = F.array_position(F.reverse(F.transform(counts, lambda n: n <= budget)), True)
    return F.when(tokens_of(counts) <= budget, size).when(fits > 0, size - fits + 1).otherwise(0).cast("long")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_prefixes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    n_tokens = tokens_of("prefix_tokens")
    return counted.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > LIMIT).alias("over_limit"),
                          longest_within("prefix_tokens", LIMIT).alias("chars_within_limit"))
