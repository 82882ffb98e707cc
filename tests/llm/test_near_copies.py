"""The near-duplicate stage of the pipeline against all pairs."""

from collections import defaultdict

import corpus_pipeline
import numpy as np

from planweave.llm import nearcopies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stage_drops_what_is_similar_by_four_fifths(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "FEWEST", 2)  # many shingles count as common here
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(40, 300))]
        for _ in range(12):  # copies, and copies of copies, with a few words changed
            texts.append(" ".join(base))
            if rng.random() < 0.8:
                for at in rng.integers(0, len(base), max(1, len(base) // 60)):
                    base = [*base[:at], f"w{rng.integers(0, 5000)}", *base[at + 1 :]]
    texts += [" ".join(f"v{x}" for x in rng.integers(0, 5000, 6)) + " a line that many different texts have in common" for _ in range(30)]
    texts += ["short one", "Short  ONE", "short two", "", None, texts[0]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    sets = [brute_sets(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in range(len(texts))})
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == want and len(want) < len(texts) - 60
    groups = defaultdict(set)
    for r in nearcopies.near_copies(docs).collect():
        groups[r.group].add(r.doc_id)
    assert sorted(min(g) for g in groups.values()) == want
    assert nearcopies.keep_one(docs.limit(0)).count() == 0
