"""One person, one surrogate; two people, two."""

from planweave.llm import pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_name_has_one_surrogate_whatever_the_mention():
    text = "Dr Maria Silva met Ms Maria Silva, Mr John and Mr John Smith. Maria Silva left; SMITH stayed. Dr Rosa da Costa and Dr Anna Berta Clara Dora Evans came. Later Costa, Dora and Evans."
    new, found = pii.replace(text)
    seen = {}
    for old, now in zip(text.split(), new.split()):
        old, now = old.strip(".,;").lower(), now.strip(".,;").lower()
        assert seen.setdefault(old, now) == now
    clear = {"maria", "silva", "john", "smith", "rosa", "costa", "anna", "berta", "clara", "dora", "evans"}
    assert all(seen[x] != x for x in clear) and all(seen[x] == x for x in set(seen) - clear)
    assert seen["maria"].endswith("ia") and seen["john"].endswith("on") and len({seen[x] for x in clear}) == len(clear)
    assert len(found) == 20 and pii.replace("Dr. Mrs Smith")[0].startswith("Dr. Mrs ")


def test_documents_share_a_name(spark):
    texts = ["Dr Maria Silva came", "Ms Maria Silva came", "Herr Maria came", "Mr Silva came"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    out = {r.doc_id: r.text.split() for r in pii.pseudonymized_rows(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[0][1] == out[1][1] == out[2][1] and out[0][2] == out[1][2] == out[3][1]
    assert out[0][1].endswith("ia")


def unpermute(y, size, tweak):
    """Inverse of pii.permute."""
    import hashlib

    half = ((size - 1).bit_length() + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8
    own = hashlib.blake2b(hashlib.blake2b(b"phone/0/", key=hashlib.sha512(pii.KEY).digest()).digest() + tweak).digest()
    while True:
        a, b = y >> half, y & mask
        for r in reversed(range(8)):
            h = hashlib.blake2b(r.to_bytes(1, "big") + a.to_bytes(width, "big"), key=own, digest_size=width + 8).digest()
            a, b = b ^ (int.from_bytes(h, "big") & mask), a
        y = a << half | b
        if y < size:
            return y


def test_two_first_surrogates_alike(spark):
    """An ordinary number whose surrogate is the one of a number reserved for fiction."""
    ordinary = next(v for i in range(20_000) if (v := f"1:234{i % 500:03d}{i:04d}")[5:8] != "555" and pii.surrogate("phone", v)[5:8] == "555" and pii.surrogate("phone", v)[2] in "23456789")
    target = pii.surrogate("phone", ordinary)
    digits = target[2:]
    y = (int(digits[0]) - 2) * 10**6 + int(digits[1:3] + digits[6:])
    x = unpermute(y, 8 * 10**6, b"200555" + b"0000")
    fiction = f"1:{x // 10**6 + 2}{x % 10**6 // 10**4:02d}555{x % 10**4:04d}"
    assert pii.surrogate("phone", fiction) == target and fiction != ordinary
    over = {r.value: r.surrogate for r in pii.collisions(spark.createDataFrame([("phone", ordinary), ("phone", fiction)], "kind string, value string")).collect()}
    final = [over.get(v) or pii.surrogate("phone", v) for v in (ordinary, fiction)]
    assert len(set(final)) == 2 and len(over) == 1


def brute(texts, key=pii.KEY):
    """The whole corpus at once: every entity, its draws against a plain set, plain replacement."""
    found = [pii.find(t) for t in texts]
    values = {(e.kind, e.canonical) for es in found for e in es}
    genders = {}
    for k, v in values:
        if k == "name":
            genders.setdefault(v[2:], set()).update(v[0].strip("n"))
    people = {}  # value as found -> (kind, value that is drawn for)
    for k, v in values:
        people[k, v] = (k, f"{min(genders[v[2:]]) if len(genders[v[2:]]) == 1 else 'n'}:{v[2:]}" if k == "name" else v)
    plain = {(k, v[2:] if k == "name" else v) for k, v in people.values()}
    first = {kv: pii.surrogate(*kv, key=key) for kv in people.values()}
    held = {}
    for kv in sorted(first):
        held.setdefault((kv[0], first[kv]), kv)
    final = {kv: s for kv, s in first.items() if (kv[0], s) not in plain and held[kv[0], s] == kv}
    attempt = 0
    while len(final) < len(first):
        attempt += 1
        drawn = {}
        for kv in sorted(set(first) - set(final)):
            drawn.setdefault((kv[0], pii.surrogate(*kv, attempt, key)), kv)
        used = plain | {(k, s) for (k, _), s in final.items()}
        final |= {kv: ks[1] for ks, kv in drawn.items() if ks not in used}
    out = []
    for t, es in zip(texts, found):
        new, at = "", 0
        for e in es:
            new += t[at : e.start] + pii.render(e, t[e.start : e.stop], final[people[e.kind, e.canonical]])
            at = e.stop
        out.append(None if t is None else new + t[at:])
    return out, final


def test_whole_corpus_against_brute_force(spark):
    texts = ["Dear Mr. Öä wrote to Señor José García, Herr Groß and Åsa", "Dr. José Ødegård, Mrs. Åsa Öä.", "Mr Ab, Mr Ba, Mr Bo, Mrs Ob, Mr Oo, Mr Aa", None, ""]
    texts += [f"to {c}@example.com" for c in pii.LOWER]  # every address of this shape is an original
    texts += [" ".join(f"10.3.{c}.{d}" for d in range(256)) for c in range(30)]
    texts += ["4404 1894 9746 0878 and 4404189497460877", "call 212-555-0001 or 212-555-0002", "x" * 70_000 + " a@example.com"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    key = b"another secret"
    want, final = brute(texts, key)
    out = {r.doc_id: r.text for r in pii.pseudonymized_rows(spark.createDataFrame(rows, DOCS), key).collect()}
    assert [out[i] for i in range(len(texts))] == want
    assert len({(k, s) for (k, _), s in final.items()}) == len(final)  # distinct stay distinct
    assert "Öä" not in out[0] and "José" not in out[0] and out[0].split()[2] == out[1].split()[-1].rstrip(".")
    assert "4404189497460877" in out[len(texts) - 3]  # no check digit fits: not a card
    assert pii.replace("Mr Jo", key=key) != pii.replace("Mr Jo")


def test_entities_of_one_long_text():
    import time

    text = " ".join(f"user{i}@example.org" for i in range(200_000))
    start = time.process_time()
    assert len(pii.find(text)) == 200_000 and time.process_time() - start < 20
