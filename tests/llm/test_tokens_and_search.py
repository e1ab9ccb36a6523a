"""Token counts, token alignment and ranked lexical search against the libraries and plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers as public
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from worklens.llm import lexical_search, token_alignment, token_counts

BPE, PIECES = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
ODD = ["a", "b", "the", ",", ".", "?!", "ab.c", ". ",  "'", "re", "'re", "'ve", "'l", "l", "ing", " ", "  ", "\n", "\t", "1", "23", "é", "日本", "🎉", "ｆ", "!", "ß", "́", "\xa0", "　", "\x1c", "\x00",
       "<|endoftext|>", "<|endo", "<s>", "</s>", "<unk>", "<0x41>", "▁", "👩‍👩‍👧"]
ROWS = [(1, "Hello world, this is it."), (1, "Hello world, this is it."), (None, "a  b\n c "), (3, None), (4, ""), (5, " "), (6, "日本語 🎉🎉 ｆｇ"), (7, "a ▁x"), (8, "x" * 30_000), (9, "<|endoftext|> </s>")]


def made(length, seed=1, count=300):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, length))) for _ in range(count)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, n_bytes string, tf int")


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def pieces():
    return token_counts.Pieces(token_counts.Vocabulary(BPE), 1000)


def test_every_prefix_has_the_count_of_the_library(bpe, pieces):
    for text in made(20, count=150):
        want = [len(bpe.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]
        assert token_counts.prefix_counts(pieces, text).tolist() == want


def test_every_character_is_cut_as_by_the_library(bpe, pieces):
    for start in range(0, 0x110000, 0x1000):
        text = "".join(f"a{chr(c)}1{chr(c)} " for c in range(start, start + 0x1000) if not 0xD800 <= c < 0xE000)
        assert not text or token_counts.prefix_counts(pieces, text)[-1] == len(bpe.encode(text, add_special_tokens=False).ids)


def test_tokens_side_by_side(pieces):
    r, v = random.Random(3), pieces.vocabulary
    tokens = list(v.id_of)
    for _ in range(3000):
        a, b = r.choice(tokens), r.choice(tokens)
        assert v.may_follow(a, b) == (v.merged(a + b) == [a, b])


def test_counts_of_whole_texts_and_budgets(spark, bpe):
    docs = frame(spark)
    counted = token_counts.token_prefixes(docs, BPE)
    got = sorted(((r[0], r[1], r[2], r[3], r[4]) for r in counted.select(
        "doc_id", "n_bytes", token_counts.tokens_of("prefix_tokens"), token_counts.tokens_of("prefix_tokens", 7), token_counts.longest_within("prefix_tokens", 3)).collect()), key=repr)

    def fit(text):
        return max((i for i in range(min(len(text), 200) + 1) if len(bpe.encode(text[:i], add_special_tokens=False).ids) <= 3), default=0)

    def n(text):
        return len(bpe.encode(text, add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), n(t or ""), n((t or "")[:7]), fit(t or "")) for i, t in ROWS), key=repr)
    assert token_counts.token_prefixes(docs.where("false"), BPE).count() == 0


def test_token_counts_of_the_table(spark, bpe):
    got = {r["doc_id"]: tuple(r)[1:4] for r in token_counts.op12_token_counts(spark, SF).collect()}
    docs = duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall()
    counts = {i: len(bpe.encode(t, add_special_tokens=False).ids) for i, t in docs}
    assert got == {i: (len(t.encode()), counts[i], counts[i] > 1024) for i, t in docs}


class Plain:
    """The alignment by decoded bytes of whole texts alone."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.a.encode_special_tokens = True
        self.a_bytes, self.b_bytes = token_alignment.vocabulary_bytes(BPE, PIECES)

    def document(self, text):
        raw = f" {text}".encode()
        a, b = (self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)) if text else ([], [])
        if not text or b"".join(self.a_bytes[i] for i in a) != raw or b"".join(self.b_bytes[i] for i in b) != raw:
            return 0, 0, 0, "", []
        ends = [np.cumsum([len(known[i]) for i in ids]).tolist() for known, ids in ((self.a_bytes, a), (self.b_bytes, b))]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        return len(a), len(b), len(groups), ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups), [(x[-1], y[-1]) for x, y in groups]


@pytest.fixture(scope="module")
def plain():
    return Plain()


def test_alignment_of_odd_texts(plain):
    aligner = token_alignment.Aligner(BPE, PIECES, 500)
    texts = made(25, seed=2, count=600)
    for text, got in zip(texts, aligner.documents(texts), strict=True):
        want = plain.document(text)
        assert got[:4] == want[:4]
        assert dict(zip(got[4].tolist(), got[5].tolist(), strict=True)) == Counter(a * token_alignment.PAIR + b for a, b in want[4])


def test_alignment_by_whole_texts_is_the_same(plain):
    aligner = token_alignment.Aligner(BPE, PIECES, 500)
    texts = made(15, seed=5, count=100)
    for cut in (None, *(re.compile(c) for c, _ in token_alignment.CUTS)):
        aligner.cut = cut
        aligner.words.clear()
        assert [got[:4] for got in aligner.documents(texts)] == [plain.document(t)[:4] for t in texts]


def test_alignment_shows_the_groups_of_a_run_at_once(plain):
    """Groups of many words are written as one text; a word's own part of it is what the word gives alone."""
    aligner = token_alignment.Aligner(BPE, PIECES, 500)
    ids, upto = (np.array([7, 8, 9, 10]), np.array([5, 6, 0])), (np.array([2, 3, 4]), np.array([1, 2, 3]))
    text, starts = aligner.shown(ids, upto)
    assert text == "7,8|5;9|6;10|0;" and [text[i:] for i in starts] == [text, "9|6;10|0;", "10|0;", ""]
    words = [" plain", ",", " na\u00efve", "\nline", " \U0001f642x", ".", " \u6f22\u5b57", " words"]
    assert aligner.aligned(words) == [aligner.aligned([w])[0] for w in words]
    assert [w[:4] for w in aligner.aligned([" na\u00efve", " words"])] == [plain.document(t)[:4] for t in ("na\u00efve", "words")]


def test_alignment_looks_for_cuts_at_their_signs_only():
    aligner = token_alignment.Aligner(BPE, PIECES, 500)
    assert aligner.cut.pattern.startswith(token_alignment.SIGNS)
    plain = re.compile("|".join(c for c, _ in token_alignment.CUTS if c in aligner.cut.pattern))
    for text in [*made(25, seed=3, count=300), " a.b, c;\n\nd !e 1.2 \u00e9.\u00e9 x\n.y"]:
        assert aligner.cut.split(f" {text}") == plain.split(f" {text}")


def check_alignment(plain, rows, got):
    found = [(i, *plain.document(t)) for i, t in rows]
    counts = Counter(link for row in found for link in row[5])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    want = [(i, a, b, g, hashlib.sha256(shown.encode()).hexdigest() if g else "", len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links))
            for i, a, b, g, shown, links in found]
    columns = ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(want, key=repr)


def test_alignment_query(spark, plain):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_alignment(plain, rows, token_alignment.op11_cross_tokenizer_alignment(spark, SF).collect())


def test_alignment_of_edge_cases(spark, plain, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    check_alignment(plain, ROWS, token_alignment.op11_cross_tokenizer_alignment(spark, str(tmp_path)).collect())
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert token_alignment.op11_cross_tokenizer_alignment(spark, f"{tmp_path}/none").count() == 0


def plain_ranks(docs, items, k):
    """Every document scored for every item."""
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    held = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in docs) if w]
    documents, occurrences = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * documents) // occurrences
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def search(spark, docs, items, k=10):
    rows = lexical_search.ranked(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), k).collect()
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in rows), key=repr)


def test_search_of_edge_cases(spark):
    docs = [*ROWS, (10, "World IT it été"), (11, "ÉTÉ été-world"), (None, "hello hello"), *[(100 + i, f"it w{i % 7}") for i in range(60)]]
    items = [(1, "hello world"), (1, "hello world"), (None, "it"), (3, None), (4, "?!"), (5, "nowhere"), (6, "IT ÉTÉ W3 w4 it")]
    assert search(spark, docs, items, 5) == plain_ranks(docs, items, 5)
    assert search(spark, [], items) == [] and search(spark, docs, []) == []


def test_search_in_chunks_and_small_shards(spark, monkeypatch):
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(1, 60)))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(150)]
    items = [(i, " ".join(r.choices(words, k=8))) for i in range(30)]
    for name, value in (("SHARD", 97), ("CHUNK_BYTES", 100), ("BLOCK", 8)):
        monkeypatch.setattr(lexical_search, name, value)
    assert len(list(lexical_search.chunks(spark.createDataFrame(items, "item_id long, text string"), 100))) > 3
    assert search(spark, docs, items) == plain_ranks(docs, items, 10)


def test_blocks_are_skipped_only_when_their_bound_fails():
    """Over one shard all ranks are those of all scores, though only some documents are scored."""
    g = np.random.default_rng(5)
    n, vocabulary = 3000, 60
    lengths = g.integers(1, 20, n)
    terms = np.concatenate([np.sort(g.choice(vocabulary, size=x, replace=False, p=(p := 1 / np.arange(1, vocabulary + 1)) / p.sum())) for x in lengths])
    weight = np.arange(1, vocabulary + 1) * 40
    impact = weight[terms] * g.integers(1, 30, len(terms))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    shard = lexical_search.Shard(np.arange(n), starts, terms, impact, vocabulary)
    none, every = np.zeros(0, dtype=np.int64), 0
    for _ in range(40):
        asked = np.sort(g.choice(vocabulary, size=6, replace=False))[::-1]
        top, scored = shard.search(asked, (none, none), 10)
        mask = np.isin(np.arange(vocabulary), asked)
        scores = np.add.reduceat(impact * mask[terms], starts[:-1])
        order = np.lexsort((np.arange(n), -scores))[:10]
        assert top[1].tolist() == order.tolist() and top[0].tolist() == scores[order].tolist()
        every += scored
    assert every < 0.7 * 40 * n
    for term, (parts, begin, summary, highest) in shard.lists.items():
        assert sorted(np.concatenate(parts).tolist()) == sorted(shard.posting[shard.list_start[term]:shard.list_start[term + 1]].tolist())
        for b, rows in enumerate(parts):
            want = {}
            for row in rows:
                for at in range(starts[row], starts[row + 1]):
                    want[int(terms[at])] = max(want.get(int(terms[at]), 0), int(impact[at]))
            stop = begin[b + 1] if b + 1 < len(parts) else len(summary)
            assert dict(zip(summary[begin[b]:stop].tolist(), highest[begin[b]:stop].tolist(), strict=True)) == want


def test_search_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    columns = ["item_id", "rank", "doc_id", "score"]
    got = sorted(map(tuple, lexical_search.op13_ranked_lexical_search(spark, SF).select(*columns).collect()))
    assert got and got == sorted(con.execute(f"select {', '.join(columns)} from ({lexical_search.ORACLE})").fetchall())
    assert spark.read.parquet(f"{SF}/benchmark.parquet").select(F.count("*")).first()[0] > 0


def test_alignment_weighs_large_batches_in_parts(monkeypatch):
    """The sums of a batch do not depend on how many rows are weighed at once, and no part is larger than asked."""
    g = np.random.default_rng(3)
    known = np.sort(g.choice(10_000, 300, replace=False)).astype(np.int64)
    links, best = g.integers(1, 50, 300), g.integers(0, 2, 300)
    pairs = [np.sort(g.choice(known, g.integers(0, 40), replace=False)) for _ in range(1000)]
    times = [g.integers(1, 9, len(p)).astype(np.int32) for p in pairs]
    batch = pa.RecordBatch.from_arrays([*[pa.array(np.arange(1000)) for _ in range(4)], pa.array(["x"] * 1000), pa.array(pairs, pa.list_(pa.int64())),
                                        pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    class Counts:
        value = known, links, best

    parts = list(token_alignment.weigher(Counts)(iter([batch])))
    assert max(p.num_rows for p in parts) <= token_alignment.WEIGHED_ROWS
    got = pa.Table.from_batches(parts)
    at = [np.searchsorted(known, p) for p in pairs]
    assert got["doc_id"].to_pylist() == list(range(1000))
    assert got["n_links"].to_pylist() == [int(t.sum()) for t in times]
    assert got["n_best"].to_pylist() == [int((t * best[a]).sum()) for t, a in zip(times, at, strict=True)]
    assert got["count_sum"].to_pylist() == [int((t * links[a]).sum()) for t, a in zip(times, at, strict=True)]


def test_alignment_keeps_frequent_words_and_a_bounded_number():
    aligner, fresh = token_alignment.Aligner(BPE, PIECES, 40), token_alignment.Aligner(BPE, PIECES, 10 ** 6)
    asked = []
    whole = aligner.aligned
    aligner.aligned = lambda words: asked.extend(words) or whole(words)
    for i in range(60):
        text = f"often word{i} other{i} again{i}"
        assert [x.tolist() if isinstance(x, np.ndarray) else x for x in next(aligner.documents([text]))] == [
            x.tolist() if isinstance(x, np.ndarray) else x for x in next(fresh.documents([text]))]
        assert len(aligner.words) + len(aligner.older) <= 40
    assert asked.count(" often") == 1
