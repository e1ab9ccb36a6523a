"""Training-data queries against plain versions over the whole small table, and the pipeline stage by stage."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_llm import shingles
from worklens.storage import stage
from worklens.llm import chat_format, fingerprints, language_id, licenses, mixing, packing, secrets


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_license_scan_of_the_table(spark, texts):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    want = {}
    for doc_id, text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        at = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i:i + len(p := phrase.split())] == p]
        starts = [i for i, _ in at]
        want[doc_id] = (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at})))
    got = licenses.op1_license_scan(spark, SF).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in got} == want
    assert any(w[1] for w in want.values())
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def plain_print(text, lexicon):
    """Each subset's terms of the text, sorted and hashed."""
    terms = set(re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower()))
    held = sorted(terms & lexicon)
    if not held:
        return [xxhash.xxh3_64_hexdigest(b" ".join(sorted(terms)))[:12]] + ["-"] * (fingerprints.SUBSETS - 1)
    out = []
    for k in range(fingerprints.SUBSETS):
        inside = [t for t in held if xxhash.xxh3_64_intdigest(t, seed=k + 1) < ((1 << 64) - 1) >> k % fingerprints.TIERS]
        joined = b"".join(xxhash.xxh3_64_intdigest(t).to_bytes(8, "little") for t in inside)
        out.append(xxhash.xxh3_64_hexdigest(joined)[:12] if inside else "-")
    return out


def test_fingerprints_of_the_table(spark, texts):
    df = Counter(t for _, x in texts for t in set(re.findall(rb"[0-9a-z\x80-\xff]+", x.encode().lower())))
    low, high = (b * len(texts) for b in fingerprints.BAND)
    lexicon = {t for t, n in df.items() if low <= n <= high}
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.op3_document_fingerprints(spark, SF).collect()}
    assert len(got) == len(texts)
    near = lambda a, b: (lambda used: sum(x == y for x, y in used) / len(used))([(x, y) for x, y in zip(a, b) if (x, y) != ("-", "-")])
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        half, r = len(text) // 2, got[doc_id]
        edited = text[:len(text) - half] + after[:half]
        own, other, following = (plain_print(t, lexicon) for t in (text, edited, after))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (".".join(own), ".".join(other))
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert np.isclose(r["near_edited"], near(own, other)) and np.isclose(r["near_next"], near(own, following))


def test_most_likely_roles_of_all_paths():
    rng = np.random.default_rng(8)
    roles = ("a", "b", "c")
    counts = {("start", r, ""): int(rng.integers(1, 9)) for r in roles} | {("step", x, y): int(rng.integers(1, 9)) for x in roles for y in roles}
    counts |= {(f"f{i}", r, str(v)): int(rng.integers(1, 9)) for i, size in enumerate(chat_format.SIZES) for r in roles for v in range(size)}
    model = chat_format.Model(counts)
    share = lambda what, role, value, values: (counts.get((what, role, value), 0) + 1) / sum(counts.get((what, role, v), 0) + 1 for v in values)
    start = {r: (counts["start", r, ""] + 1) / sum(counts["start", x, ""] + 1 for x in roles) for r in roles}
    for _ in range(20):
        turns = [[int(rng.integers(0, s)) for s in chat_format.SIZES] for _ in range(5)]
        scored = []
        for path in itertools.product(roles, repeat=5):
            p = np.log(start[path[0]]) + sum(np.log(share("step", x, y, roles)) for x, y in zip(path, path[1:]))
            p += sum(np.log(share(f"f{i}", r, str(v), map(str, range(chat_format.SIZES[i])))) for r, t in zip(path, turns) for i, v in enumerate(t))
            scored.append((p, path))
        assert tuple(model.roles[s] for s in model.decode(turns)) == max(scored)[1]


def test_follow_the_leader_equals_a_dense_loop():
    rng, size, classes, s = np.random.default_rng(9), 30, 3, language_id.Settings()
    rows = []
    for _ in range(40):
        at = np.sort(rng.choice(size, size=6, replace=False))
        rows.append((at, rng.random(6), int(rng.integers(0, classes))))
    z, n, w = np.zeros((size + 1, classes)), np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    for _ in range(s.epochs):
        for at, values, label in rows:
            x = np.zeros(size + 1)
            x[at], x[size] = values, 1.0
            for i in range(size + 1):
                for c in range(classes):
                    w[i, c] = 0.0 if abs(z[i, c]) <= s.l1 else -(z[i, c] - np.sign(z[i, c]) * s.l1) / ((s.beta + np.sqrt(n[i, c])) / s.alpha + s.l2)
            e = np.exp(x @ w - (x @ w).max())
            g = np.outer(x, e / e.sum() - (np.arange(classes) == label))
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / s.alpha * w
            n += g * g
    want = np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    weights, bias = language_id.follow_the_leader(rows, size, classes, s)
    assert np.allclose(np.vstack([weights, bias]), want)


def test_pipeline_stage_by_stage(spark):
    """Every stage against a plain version over what its predecessor kept."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    key = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)

    kept = stage(steps["language"](spark, table, SF))
    found = language_id.identify(table, language_id.fit(table), ["doc_id", "text"]).collect()
    assert key(kept.collect()) == key(r for r in found if r["lang_pred"] != "und" and r["score"] >= 0.4)
    clean = [r for r in table.collect() if r["text"] and re.search("[a-zA-Z]", r["text"])]
    assert kept.count() > 0.9 * len(clean)

    before = kept.collect()
    sets = [shingles(r["text"]) for r in before]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(before)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda x: before[x]["doc_id"])
                root[b] = a
    single = stage(steps["near_dedup"](spark, kept, SF))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(before[i]["doc_id"] for i in range(len(before)) if find(i) == i)

    masked = stage(steps["secrets"](spark, single, SF))
    spans = {r["doc_id"]: sorted((s["start"], s["end"]) for s in [*r["base"], *r["extra"]]) for r in secrets.find_secrets(single, ["doc_id"]).collect()}
    now = {r["doc_id"]: r["text"] for r in masked.collect()}
    for r in single.collect():
        out, at = [], 0
        for start, end in spans[r["doc_id"]]:
            if start >= at:
                out += [r["text"][at:start], secrets.MASK]
            at = max(at, end)
        assert now[r["doc_id"]] == "".join(out) + r["text"][at:]

    mixed = stage(steps["mixing"](spark, masked, SF))
    copies = Counter(r["doc_id"] for r in mixed.collect())
    words = {r["doc_id"]: len(re.findall("[^\x20\x09-\x0d]+", r["text"])) for r in masked.collect()}
    taken = sum(copies[i] * n for i, n in words.items())
    budget = int(sum(words.values()) * mixing.FRACTION)
    assert 0 < taken <= budget and all(r["text"] == now[r["doc_id"]] for r in mixed.collect())

    bins = steps["packing"](spark, mixed, SF).toPandas()
    assert bins.groupby("bin_id").tokens.sum().max() <= packing.CAPACITY
    assert bins.groupby("doc_id").tokens.sum().to_dict() == {i: copies[i] * words[i] for i in copies if words[i]}
    assert not bins[bins.source.notna()].duplicated(["bin_id", "source"]).any()
