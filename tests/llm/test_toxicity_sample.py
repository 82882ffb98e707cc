"""The training sample, and the scorer against a plain one."""

import math

import numpy as np

from planweave.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900, long=0):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 2
        w = rng.choice(words, 400 if long and i % long else 40).tolist()
        if bad:
            w[int(rng.integers(0, len(w)))] = "zwickyba"
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, bad))
    return rows, labels


def told_apart(model):
    return toxicity.score(model, "w1 w2 w3 zwickyba w4 w5 w6 w7") > 0.7 > toxicity.score(model, "w1 w2 w3 w8 w4 w5 w6 w7")


def test_labels_without_documents_and_long_texts(spark):
    rows, labels = corpus(long=9)
    labels += [(10_000 + i, 1, i % 2) for i in range(3000)]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    assert told_apart(toxicity.fit(docs, lab, per_class=60))
    assert told_apart(toxicity.fit(docs.filter("length(text) > 400"), lab, per_class=60))
    assert toxicity.fit(docs, lab, per_class=60, bytes_each=1).rows.any()  # one text of each class


def test_one_id_with_many_rows(spark):
    rows, labels = corpus()
    rows += [(2, f"w{i} again {i}", "en", "s", 0) for i in range(3000)]
    labels += [(2, 1, 0)] * 3000
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    assert told_apart(toxicity.fit(docs, lab, per_class=200))


def test_a_few_examples_already_tell():
    model = toxicity.train(["you are a zwicky fool today"] * 3 + ["the weather is mild and calm today"] * 3, [1, 1, 1, 0, 0, 0])
    assert toxicity.score(model, "what a zwicky") > toxicity.score(model, "what a mild day") + 0.2


def plain(model, text):
    """Word by word, feature by feature."""
    words, best = [], None
    for w in (text or "").encode("utf-8", "surrogatepass").lower().split():
        if words and words[-1][0] == w:
            words[-1][1] += 1
        else:
            words.append([w, 1])
    cuts = list(range(0, len(words), toxicity.WINDOW))
    if len(cuts) > 1 and len(words) % toxicity.WINDOW:
        cuts.pop()
    for a, b in zip(cuts, [*cuts[1:], len(words)]):
        total, size = 0.0, toxicity.PRIOR
        for w, times in words[a:b]:
            spaced, weight = b" " + w + b" ", 1 + math.log(times)
            rows = [_word_row(w)]
            for n in toxicity.GRAMS:
                rows += [_gram_row(spaced[k : k + n]) for k in range(len(spaced) - n + 1) if k < len(w) + 1]
            total += weight * sum(float(model.rows[r]) for r in rows)
            size += weight * len(rows)
        best = max(best, total / size) if best is not None else total / size
    return 1 / (1 + math.exp(-max(-30, min(30, model.bias + (best or 0.0)))))


def _gram_row(gram):
    h = gram[0]
    for c in gram[1:]:
        h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
    return ((h ^ len(gram)) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.BITS)


def _word_row(w):
    total = sum(c * pow(0x100000001B3, k + 1, 1 << 64) for k, c in enumerate(w + b" ")) + 7
    return (total * int(toxicity.PRIME) & (1 << 64) - 1) >> (64 - toxicity.BITS)


def test_scores_equal_a_plain_scorer():
    rng = np.random.default_rng(6)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), -0.3)
    vocabulary = ["a", "of", "Über", "zwicky", "x" * 40, "don't", "\u65e5\u672c", "w9", "the"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 60)).tolist()) for _ in range(60)] + ["", None, " \n ", "one", "one one one", "long " * 300 + "tail end"]
    for t in texts:
        assert abs(toxicity.score(model, t) - plain(model, t)) < 1e-6
    many = " ".join(rng.choice(vocabulary, 60_000).tolist())  # several blocks
    assert abs(toxicity.score(model, many) - plain(model, many)) < 1e-6
