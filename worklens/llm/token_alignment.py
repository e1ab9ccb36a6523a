"""Alignment of the tokens of two tokenizers over the same text.

Vocabulary A is a byte-level BPE file and encodes a space and the text; B is a sentencepiece file
and adds that space itself. Where both have a token's end, the text is cut; the tokens between
two cuts form a group. The cuts come in two steps: the character offsets of A's tokens and the
byte spans of B's pieces give coarse cuts, where both libraries say that a token ends and none goes
on; inside a coarse group that holds characters of several bytes, where several tokens share
a character or a piece is a single byte, the decoded bytes give the finer ones.

A link is a pair of tokens that end together, so the shorter one is an ending of the other: there
are at most as many pairs of ids as the tokens of both vocabularies have bytes, a bound that does not
grow with the corpus. That is why the corpus-wide counts of pairs may be sent to every task.

Both tokenizers start anew at a space between two other characters, at a line end between two, and at a stop after a
letter, so a text is encoded by such words (each with the sign before it), and a task keeps what it has found for a
word. (B's vocabulary is searched for a piece that would go on over such a place; if there is one, texts are not cut there.)

Edge cases: a text that is null, empty, or changed by one of the tokenizers (the decoded bytes are
not the space and the text) has no tokens: zeros and no groups. Strings of special tokens are plain
text. Ids may be null or repeat, every row gives a row and counts its links; an empty table gives no
rows. Texts are read whole whatever their length. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from worklens.llm.common import forget, kept_by_worker, ship, stage, table
from worklens.llm.token_counts import byte_of_character

ship(__name__)

#: Words whose alignment a worker keeps, characters of words encoded together, links in one batch of results, rows weighed at once.
KEPT_WORDS = 250_000
RUN = 20_000
BATCH_LINKS = 500_000
WEIGHED_ROWS = 256
#: A pair of ids as one number: a * PAIR + b.
PAIR = 1 << 32
#: Where a text may be cut: before a space or a line end between two other characters, and before a stop after a letter;
#: each with what a piece of B would hold that goes on over it.
CUTS = ((r"(?<=\S)(?= \S)", "[^▁]▁"), (r"(?<=\S)(?=\n\S)", r"\n"), (r"(?<=[^\W\d_])(?=[,.;:!?])", r"[^\W\d_][,.;:!?]"))
#: What a cut stands before: other places are passed over at once.
SIGNS = r"(?=[ \n,.;:!?])"
SPACE = "▁"
#: Tokens of A, of B, groups, the groups as text, the links.
Found = tuple[int, int, int, str, bytes]
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>"
_COUNTED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"


class Shown:
    """Ids as text, by 2 * id within a group and by 2 * id + 1 at the end of its side: what follows differs."""

    def __init__(self, count: int, end: str):
        self.texts = np.array([f"{i}{sign}" for i in range(count) for sign in (",", end)], dtype=object)
        self.lengths = np.array(list(map(len, self.texts)), dtype=np.int64)


class Aligner:
    """Both tokenizers, and what was found for the words met so far."""

    def __init__(self, a_path: str, b_path: str, kept: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a_bytes, self.b_bytes = vocabulary_bytes(a_path, b_path)
        self.single = np.array([self.b.is_byte(i) for i in range(self.b.get_piece_size())], dtype=bool)
        self.a_lengths = np.array([len(x) for x in self.a_bytes])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        cuts = [cut for cut, over in CUTS if not any(re.search(over, piece) for i, piece in enumerate(pieces) if not self.single[i])]
        self.cut = re.compile(f"{SIGNS}(?:{'|'.join(cuts)})") if cuts else None
        self.a_shown, self.b_shown = Shown(len(self.a_bytes), "|"), Shown(len(self.b_bytes), ";")
        self.words, self.older, self.kept = {}, {}, kept

    def aligned(self, words: list[str]) -> list[Found | None]:
        """What is found for words (each with the sign before it) that are encoded as one text; [None] if a tokenizer changes a word.

        Of several words, none may begin or end with more white space than its sign.
        """
        parts, own = [], []
        for word in words:
            if word[0] != " ":  # B would put a space before the first one, and signs of two words may not meet
                parts.append(" a")
            own.append(len(parts))
            parts.append(word)
        text = "".join(parts)
        raw = text.encode()
        encoded, pieces = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto").pieces
        a, b, spans = encoded.ids, [p.id for p in pieces], np.fromiter(chain.from_iterable(encoded.offsets), dtype=np.int64).reshape(-1, 2)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return [None] if len(words) == 1 else [x for word in words for x in self.aligned([word])]
        # B's spans are bytes of the text without its first space; of a character's bytes only the last has a span
        b_ends = np.array([p.end for p in pieces], dtype=np.int64) + 1
        ids = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        single = self.single[ids[1]]
        for i in np.flatnonzero(single)[::-1]:
            if pieces[i].begin == pieces[i].end:
                b_ends[i] = b_ends[i + 1]
        a_ends = spans[:, 1]
        if len(raw) > len(text):
            first = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
            a_ends = np.append(first, len(raw))[a_ends]
        # an end is a coarse cut of A if the next token does not share its last character
        shared = np.append(spans[1:, 0] < spans[:-1, 1], False)
        ends = np.zeros((2, len(raw) + 1), dtype=bool)
        ends[0, a_ends[~shared]] = ends[1, b_ends] = True
        cuts = np.flatnonzero(ends[0] & ends[1])
        upto = np.searchsorted(a_ends, cuts, side="right"), np.searchsorted(b_ends, cuts, side="right")
        if shared.any() and single.any():
            upto = self.finer(a, b, *upto, shared, single)
        lengths = self.a_lengths[ids[0]].cumsum()
        sizes = list(map(len, parts)) if len(raw) == len(text) else [len(p.encode()) for p in parts]
        word = np.searchsorted(np.cumsum(sizes), lengths[upto[0] - 1], side="left")
        links = (ids[0][upto[0] - 1] * PAIR + ids[1][upto[1] - 1]).tobytes()
        shown, chars = self.shown(ids, upto)
        border = np.searchsorted(word, np.arange(len(parts) + 1))
        lo, hi = border[own], border[np.array(own) + 1]
        n_a, n_b = (np.append(0, x)[hi] - np.append(0, x)[lo] for x in upto)
        first, last = chars[lo], np.maximum(chars[hi] - 1, chars[lo])  # without the sign after the last group
        return [(i, j, y - x, shown[f:e], links[8 * x:8 * y])
                for i, j, x, y, f, e in zip(*(c.tolist() for c in (n_a, n_b, lo, hi, first, last)), strict=True)]

    def shown(self, ids: tuple[np.ndarray, np.ndarray], upto: tuple[np.ndarray, np.ndarray]) -> tuple[str, np.ndarray]:
        """All groups as one text, each with a sign after it, and where in it each group begins (at last its length)."""
        line, lengths = np.empty(len(ids[0]) + len(ids[1]), dtype=object), np.zeros(len(ids[0]) + len(ids[1]) + 1, dtype=np.int64)
        for names, tokens, own, before in ((self.a_shown, ids[0], upto[0], np.append(0, upto[1])), (self.b_shown, ids[1], upto[1], upto[0])):
            # a token stands after those of its own side and those of the other side's groups before it
            at = np.arange(len(tokens)) + np.repeat(before[:len(own)], np.diff(own, prepend=0))
            name = 2 * tokens
            name[own - 1] += 1
            line[at], lengths[at + 1] = names.texts[name], names.lengths[name]
        return "".join(line.tolist()), lengths.cumsum()[np.append(0, upto[0] + upto[1])]

    def finer(self, a: list[int], b: list[int], a_upto: np.ndarray, b_upto: np.ndarray, shared: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coarse groups in which tokens of A share a character and B has single bytes, cut by the bytes they decode to."""
        within = lambda marks, upto: np.diff(np.append(0, np.append(0, marks.cumsum())[upto])) > 0
        kept, added, both = [a_upto, b_upto], [[], []], within(shared, a_upto) & within(single, b_upto)
        for group in np.flatnonzero(both):
            i, j = (int(x[group - 1]) if group else 0 for x in (a_upto, b_upto))
            a_ends, b_ends = (np.cumsum([len(known[t]) for t in tokens])
                              for known, tokens in ((self.a_bytes, a[i:a_upto[group]]), (self.b_bytes, b[j:b_upto[group]])))
            _, at_a, at_b = np.intersect1d(a_ends[:-1], b_ends[:-1], return_indices=True)
            added[0].extend(at_a + i + 1)
            added[1].extend(at_b + j + 1)
        # both grow together, so each side can be put in order by itself
        return tuple(np.sort(np.concatenate([x, np.array(y, dtype=np.int64)])) for x, y in zip(kept, added, strict=True))

    def learn(self, texts: list[list[str]]) -> None:
        """Find the alignment of all words of some texts that are not known yet, many words at a time.

        Words are kept in two halves: when the newer one is full it becomes the older one, and words that
        are met again move to the newer one, so that frequent words stay.
        """
        new = set().union(*texts)
        fresh = new.difference(self.words)
        if len(self.words) + len(fresh) > self.kept // 2:
            self.words, self.older = {}, self.words
            fresh = new
        met = [w for w in fresh if w in self.older]
        self.words.update((w, self.older[w]) for w in met)
        fresh = fresh.difference(met)
        alone = [w for w in fresh if self.cut is None or w[1:2].isspace() or w[-1].isspace()]
        run, size = [], 0
        for w in sorted(fresh.difference(alone)):
            run.append(w)
            size += len(w)
            if size >= RUN:
                self.words.update(zip(run, self.aligned(run), strict=True))
                run, size = [], 0
        if run:
            self.words.update(zip(run, self.aligned(run), strict=True))
        self.words.update((w, self.aligned([w])[0]) for w in alone)

    def documents(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """Per text the counts, the groups, and its distinct links with how often each stands in it."""
        split = [(self.cut.split(f" {text}") if self.cut else [f" {text}"]) if text else [] for text in texts]
        self.learn(split)
        for words in split:
            found = [self.words[w] for w in words]
            if not found or None in found:
                yield 0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
            else:
                n_a, n_b, n_groups, shown, links = zip(*found, strict=True)
                pairs, times = np.unique(np.frombuffer(b"".join(links), dtype=np.int64), return_counts=True)
                yield sum(n_a), sum(n_b), sum(n_groups), ";".join(shown), pairs, times.astype(np.int32)


def vocabulary_bytes(a_path: str, b_path: str) -> tuple[list[bytes], list[bytes]]:
    """The bytes that every id of A and of B decodes to."""
    import sentencepiece

    with open(a_path, encoding="utf-8") as file:
        spec = json.load(file)
    byte = byte_of_character()
    a = {number: bytes(byte[c] for c in token) for token, number in spec["model"]["vocab"].items()}
    a |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    piece = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(SPACE, " ").encode()
    return [a.get(i, b"") for i in range(max(a) + 1)], [piece(i) for i in range(b.get_piece_size())]


def aligning(a_path: str, b_path: str, kept: int = KEPT_WORDS):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, rows, held = None, [], 0

        def flush() -> pa.RecordBatch:
            ids, n_a, n_b, n_groups, shown, pairs, times = zip(*rows, strict=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (pairs, times)]
            numbers = [pa.array(x, pa.int64()) for x in (ids, n_a, n_b, n_groups)]
            return pa.RecordBatch.from_arrays([*numbers, pa.array(shown, pa.string()), *lists], names=[c.split()[0] for c in _ALIGNED.split(", ")])

        for batch in batches:
            aligner = aligner or kept_by_worker(("aligner", a_path, b_path, kept), lambda: Aligner(a_path, b_path, kept))
            for at in range(0, batch.num_rows, 64):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 64).columns)
                for doc_id, found in zip(ids, aligner.documents(texts), strict=True):
                    rows.append((doc_id, *found))
                    held += found[2]
                    if held >= BATCH_LINKS or len(rows) >= 1000:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()
    return align


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of (doc_id, text): n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2``), pairs and times: its links by pair of ids."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(aligning(a_path, b_path), _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): how many links of the corpus hold a pair, and whether no pair with its B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = each.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("links"))
    of_b = Window.partitionBy(F.col("pair") % PAIR)
    return counts.withColumn("best", F.col("links") == F.max("links").over(of_b))


def weighed(part: pa.RecordBatch, known: np.ndarray, links: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch with the sums over their links."""
    pairs, times = part.column("pairs"), part.column("times")
    flat, n = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    at = np.searchsorted(known, flat)
    row = np.repeat(np.arange(part.num_rows), pairs.value_lengths().to_numpy())
    sums = []
    for x in (n, n * best[at], n * links[at]):
        total = np.zeros(part.num_rows, dtype=np.int64)
        np.add.at(total, row, x)
        sums.append(pa.array(total))
    kept = [part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")]
    return pa.RecordBatch.from_arrays([*kept, *sums], names=[c.split()[0] for c in _COUNTED.split(", ")])


def weigher(counts):
    """Sums over links a few hundred rows at a time: a batch holds thousands of rows of hundreds of links each."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("aligner")  # its words are not needed any more
        for batch in batches:
            for at in range(0, batch.num_rows, WEIGHED_ROWS):
                yield weighed(batch.slice(at, WEIGHED_ROWS), *counts.value)
    return weigh


def with_links(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``aligned`` (staged, with ``groups_sha256``) plus n_links, n_best and count_sum.

    The counts of pairs are collected and sent to all tasks: see the bound at the top of this module.
    """
    spark = aligned.sparkSession
    most = sum(map(len, (token for side in vocabulary_bytes(a_path, b_path) for token in side)))
    found = pair_counts(aligned).toPandas().sort_values("pair")
    # ids of one text's bytes may be double (a character and a piece of one byte)
    if len(found) > 2 * most:
        raise RuntimeError("more pairs than the vocabularies allow")
    arrays = tuple(found[c].to_numpy(dtype=np.int64) for c in ("pair", "links", "best"))
    return aligned.mapInArrow(weigher(spark.sparkContext.broadcast(arrays)), _COUNTED)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    aligned = stage(align(table(spark, sf_dir, "documents"), *paths).withColumn("groups_sha256", digest).drop("groups"))
    return with_links(aligned, *paths)
