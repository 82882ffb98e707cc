"""Personal data: keyed surrogates that keep type, format, script, gender and identity.

Entities are found by pattern in the whole text: e-mail and IP addresses, telephone, card
(with a fitting check digit), account and social security numbers, access keys, and names
after a title. Each is
reduced to a canonical form (letter case and punctuation of a number don't matter), and
the canonical form goes through a keyed permutation of the strings of its own shape:
every letter stays a letter of its script and case (vowels stay vowels in names), every
digit a digit, fixed parts stay. A permutation keeps distinct entities distinct and
gives the same entity the same surrogate in every document, so coreference holds across
the corpus without a lookup table. Check digits are made to fit again; the title stays
and a given name ends as names of that gender do. A name's surrogate depends on the word
alone, whatever its title, place or length of mention: the gender that picks the ending is
settled once for the corpus (none where titles disagree). Names found after a title are
replaced wherever the same document has them again, capitalised, without one.

Collision check: a surrogate must not be the canonical form of another entity of the
corpus, nor another's surrogate, or two people would become one. The distinct entities are compared as a
distributed join; the few that collide draw again under the next key, and are checked
again against all originals and all surrogates, until none is left. Where the corpus uses
most strings of a shape, draws go to a wider one (names and addresses grow, IP addresses
and telephone numbers leave their reserved range) and at last to a longer one, so the
rounds always come to an end.

Every function takes the secret ``key``; ``KEY`` is for tests and demonstrations only.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, materialize, small_batches, trimmed

KEY = b"planweave-surrogates"  # public: give a secret in production
WIDER, LONGER = 4, 12  # draws after which a surrogate may leave its shape, and its length
LATIN_V, LATIN_C = "aeiou", "bcdfghjklmnpqrstvwxyz"
CYRILLIC_V, CYRILLIC_C = "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"
GREEK_V, GREEK_C = "αεηιουω", "βγδζθκλμνξπρστφχψ"
ALPHABETS = [LATIN_V, LATIN_C, CYRILLIC_V, CYRILLIC_C, GREEK_V, GREEK_C]
LOWER, DIGITS, ALNUM = LATIN_V + LATIN_C, "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
MALE = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "г-жа", "госпожа", "κυρία")
NEUTRAL = ("Dr", "Prof")
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PUBLIC = [x for x in range(1, 224) if x not in (10, 100, 127, 169, 172, 192, 198, 203)]


def permute(x: int, size: int, tweak: bytes) -> int:
    """Keyed permutation of range(size): a Feistel network with cycle walking."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    own = hashlib.blake2b(tweak).digest()  # the tweak begins with what the secret key makes of kind and draw
    while True:
        a, b = x >> half, x & mask
        for r in range(8):
            h = hashlib.blake2b(r.to_bytes(1, "big") + b.to_bytes(width, "big"), key=own, digest_size=min(64, width + 8)).digest()
            if width > 56:
                h = hashlib.shake_256(h).digest(width + 8)
            a, b = b, a ^ (int.from_bytes(h, "big") & mask)
        x = a << half | b
        if x < size:
            return x


def reshape(text: str, classes: list[str | None], tweak: bytes) -> str:
    """Permute ``text`` among strings of its shape: position i over ``classes[i]``, None fixed."""
    x, size = 0, 1
    for ch, own in zip(text, classes):
        if own:
            x, size = x * len(own) + own.index(ch), size * len(own)
    shape = "".join(ch if own is None else own[0] for ch, own in zip(text, classes)).encode()
    y = permute(x, size, tweak + shape)
    out = []
    for ch, own in zip(reversed(text), reversed(classes)):
        if own:
            y, k = divmod(y, len(own))
            ch = own[k]
        out.append(ch)
    return "".join(reversed(out))


def _plain(text: str) -> list[str | None]:
    return [LOWER if c in LOWER else DIGITS if c in DIGITS else None for c in text]


def luhn(digits: str) -> int:
    """Check digit of the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _drawn(letters: str, count: int, tweak: bytes) -> str:
    """``count`` letters that depend on the tweak alone."""
    return "".join(letters[k % len(letters)] for k in hashlib.shake_256(b"more" + tweak).digest(2 * count)[::2])


def _email(value: str, tweak: bytes, draw: int) -> str:
    local, _, domain = value.partition("@")
    labels = domain.split(".")
    fixed = 2 if labels[-2:-1] == ["example"] else 1  # reserved domains, else the top level
    head, tail = ".".join(labels[:-fixed]), "." * (len(labels) > fixed) + ".".join(labels[-fixed:])
    text = f"{local}@{head}"
    new = reshape(text, _plain(text), tweak) + tail
    return _drawn(LOWER, 4 * (draw - WIDER + 1), tweak + value.encode()) + new if draw >= WIDER else new


def _ip(value: str, tweak: bytes, draw: int) -> str:
    a, b, c, d = map(int, value.split("."))
    if draw >= LONGER:  # no address is free: one of the documentation range of IPv6
        return "2001:db8:" + ":".join(_drawn(DIGITS, 4, tweak + bytes((k,)) + value.encode()) for k in range(6))
    if a in PUBLIC or draw >= 2 * WIDER:
        a = a if a in PUBLIC else PUBLIC[a % len(PUBLIC)]
        x = permute(((PUBLIC.index(a) * 256 + b) * 256 + c) * 256 + d, len(PUBLIC) << 24, tweak)
        return f"{PUBLIC[x >> 24]}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"
    if draw >= WIDER:  # the range is full: another private one
        x = permute((b * 256 + c) * 256 + d, 1 << 24, tweak + bytes((a,)))
        return f"10.{x >> 16}.{x >> 8 & 255}.{x & 255}"
    x = permute(c * 256 + d, 1 << 16, tweak + bytes((a, b)))  # reserved ranges stay what they are
    return f"{a}.{b}.{x >> 8}.{x & 255}"


def _card(value: str, tweak: bytes, draw: int) -> str:
    off = (int(value[-1]) - luhn(value[:-1])) % 10
    body = value[0] + reshape(value[1:-1], [DIGITS] * (len(value) - 2), tweak + value[:1].encode()) + _more_digits(value, tweak, draw)
    return body + str((luhn(body) + off) % 10)


def _more_digits(value: str, tweak: bytes, draw: int) -> str:
    return _drawn(DIGITS, 4 * (draw - LONGER + 1), tweak + value.encode()) if draw >= LONGER else ""


def _phone(value: str, tweak: bytes, draw: int) -> str:
    code, _, rest = value.partition(":")
    own: list[str | None] = [DIGITS] * len(rest)
    if len(rest) == 10:
        own[0] = "23456789" if rest[0] in "23456789" else None
        if rest[3:6] == "555" and draw < WIDER:  # numbers reserved for fiction stay so
            own[3:6] = [None] * 3
    return f"{code}:{reshape(rest, own, tweak)}{_more_digits(value, tweak, draw)}"


def _iban(value: str, tweak: bytes, draw: int) -> str:
    body = reshape(value[4:], [ALNUM[:26] if c.isalpha() else DIGITS for c in value[4:]], tweak + value[:2].encode()) + _more_digits(value, tweak, draw)
    number = lambda head: int("".join(str(int(c, 36)) for c in body + head))
    old = int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97
    return f"{value[:2]}{(98 - number(value[:2] + '00') % 97 + old - 1) % 97:02d}{body}"


def _digits(value: str, tweak: bytes, draw: int) -> str:
    return reshape(value, [DIGITS if c.isdigit() else None for c in value], tweak) + _more_digits(value, tweak, draw)


def _secret(value: str, tweak: bytes, draw: int) -> str:
    head = re.match(r"AKIA|ASIA|ghp_|sk-", value)[0]
    letters = ALNUM if head.isupper() else LOWER + LOWER.upper() + DIGITS
    rest = value[len(head) :]
    return head + reshape(rest, [letters if c in letters else None for c in rest], tweak) + _more_digits(value, tweak, draw)


@lru_cache(maxsize=4096)
def _class_of(letter: str) -> str | None:
    """The letters that may stand for ``letter``: vowels or consonants of its alphabet; accented
    and other letters stay among those of their script and neighbourhood that have one form in
    each case. A letter without two of these may become any plain consonant."""
    for own in ALPHABETS:
        if letter in own:
            return own
    if not letter.isalpha():
        return None
    script = lambda c: unicodedata.name(c, "").split(" ")[0]
    base = lambda c: unicodedata.normalize("NFD", c)[0] in LATIN_V
    first = ord(letter) & ~127
    near = [c for c in map(chr, range(first, first + 128)) if c.isalpha() and c.lower() == c and len(c.upper()) == 1 and c.upper().lower() == c and script(c) == script(letter) and base(c) == base(letter) and unicodedata.category(c) == unicodedata.category(letter)]
    return "".join(near) if letter in near and len(near) > 1 else LATIN_C + letter


def _letters(value: str) -> list[str | None]:
    return [_class_of(c) for c in value]


def _name(value: str, tweak: bytes, draw: int) -> str:
    """``gender:token`` in lower case -> token; a given name gets an ending of its gender."""
    gender, token = value.split(":", 1)
    out = reshape(token, _letters(token), tweak)
    script = next((k for k, a in enumerate(ALPHABETS) if out[-1] in a), 0) // 2
    if draw >= WIDER:  # names of this length are used up: a longer one
        more = _drawn(DIGITS, 3 * (draw - WIDER + 2), tweak + value.encode())
        vowels, consonants = ALPHABETS[2 * script], ALPHABETS[2 * script + 1]
        out += "".join((consonants, vowels)[i % 2][int(more[i : i + 2]) % len((consonants, vowels)[i % 2])] for i in range(len(more) - 1))
    if gender != "n":
        out += {"m": ("on", "ов", "ος"), "f": ("ia", "ия", "ια")}[gender][script]
    return out


TITLES = "|".join(re.escape(t) for t in sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
WORD = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][^\W\d_]+"
PARTICLES = "al|af|av|bin|bint|da|das|de|degli|dei|del|della|den|der|di|do|dos|du|e|el|ibn|la|las|le|los|ten|ter|van|vom|von|y|zu|zum|zur|де|фон|ван"
NAME_WORD = rf"(?!(?:{TITLES})(?!\w)){WORD}"  # a title begins the next name
FULL_NAME = re.compile(rf"{NAME_WORD}(?: (?:(?:{PARTICLES}) ){{0,3}}{NAME_WORD})*")
BARE = re.compile(rf"(?<!\w){WORD}(?!\w)")


EMAIL = re.compile(r"[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9_])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+", re.ASCII)
LOCAL, LABEL = re.compile(r"[\w.+-]*", re.ASCII), re.compile(r"[A-Za-z0-9-]+")


class Emails:
    """Finds what ``EMAIL`` finds, each @ once: what may stand before it is looked for from it to the
    left, never beyond the @ before; what may follow goes on label by label, never beyond the next."""

    @staticmethod
    def finditer(text: str):
        done, at = 0, text.find("@")
        while at >= 0:
            local = LOCAL.match(text[done:at][::-1])[0].rstrip("_.+-")
            stop = Emails._domain(text, at + 1) if local and local[0] not in ".+-" else 0
            if stop:
                yield EMAIL.fullmatch(text, at - len(local), stop)
            done = max(stop, at + 1)
            at = text.find("@", done)

    @staticmethod
    def _domain(text: str, at: int) -> int:
        """End of the longest domain of two labels or more that begins there, 0 if there is none."""
        end = labels = 0
        while (run := LABEL.match(text, at)) and run[0][0] != "-":
            label = run[0].rstrip("-")
            labels += 1
            if labels > 1:
                end = at + len(label)
            if len(label) < len(run[0]) or not text.startswith(".", run.end()):
                break
            at = run.end() + 1
        return end


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern | Emails
    hint: Callable[[str], object]  # cheap test that the pattern can match
    canonical: Callable[[str], str]
    surrogate: Callable[[str, bytes, int], str]
    accepts: Callable[[str], bool] = bool  # check digits


HAS_DIGIT = re.compile(r"\d\d").search
KINDS = [
    Kind("email", Emails(), lambda t: "@" in t, str.lower, _email),
    Kind("secret", re.compile(r"\b(?:A[KS]IA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b", re.ASCII), lambda t: "AKIA" in t or "ASIA" in t or "ghp_" in t or "sk-" in t, str, _secret),
    Kind("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII), HAS_DIGIT, lambda v: v.replace(" ", ""), _iban, lambda v: _iban_ok(v)),
    Kind("ip", re.compile(rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?![\w]|\.\d)", re.ASCII), HAS_DIGIT, str, _ip),
    Kind("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)", re.ASCII), HAS_DIGIT, lambda v: _phone_number(v), _phone),
    Kind("card", re.compile(r"(?<![\w-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{13,19})(?![\w-])", re.ASCII), HAS_DIGIT, lambda v: re.sub(r"\D", "", v), _card, lambda v: _card_ok(v)),
    Kind("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII), HAS_DIGIT, str, _digits),
    Kind("name", re.compile(rf"\b(?:{TITLES})\.? (?={WORD})"), re.compile(rf"(?:{TITLES})\.? [^\W\d_]").search, str, _name),
]
BY_NAME = {k.name: k for k in KINDS}


def _phone_number(value: str) -> str:
    digits = re.sub(r"\D", "", value)
    return f"{digits[:-10] or '1'}:{digits[-10:]}" if len(digits) >= 10 else f":{digits}"


def _iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _card_ok(value: str) -> bool:
    digits = re.sub(r"\D", "", value)
    return int(digits[-1]) == luhn(digits[:-1])


@dataclass
class Entity:
    start: int
    stop: int
    kind: str
    canonical: str


def find(text: str | None) -> list[Entity]:
    """Entities in order, not overlapping; earlier kinds win. Null has none."""
    text = text or ""
    taken: list[tuple[int, int]] = []  # sorted, apart from each other
    out: list[Entity] = []
    named: list[tuple[str, list[tuple[int, int]]]] = []  # gender and words of each name after a title

    def place(found):
        """Those of ``found`` (sorted) that overlap nothing taken before: only neighbours can."""
        nonlocal taken
        good = []
        for start, stop, kind, canonical in found:
            at = bisect_left(taken, (start, stop))
            if (at == len(taken) or taken[at][0] >= stop) and (at == 0 or taken[at - 1][1] <= start) and (not good or good[-1].stop <= start):
                good.append(Entity(start, stop, kind, canonical))
        out.extend(good)
        taken = sorted(taken + [(e.start, e.stop) for e in good])

    for kind in KINDS:
        if not kind.hint(text):
            continue
        found = []
        for m in kind.pattern.finditer(text):
            if kind.name == "name":
                words = FULL_NAME.match(text, m.end())
                if words:
                    title = m[0].rstrip(" .")
                    named.append(("m" if title in MALE else "f" if title in FEMALE else "n", [(w.start(), w.end()) for w in re.compile(WORD).finditer(text, m.end(), words.end())]))
            elif kind.accepts(m[0]):
                found.append((m.start(), m.end(), kind.name, kind.canonical(m[0])))
        place(found)
    if named:
        genders: dict[str, set[str]] = {}
        for gender, words in named:
            for i, (start, stop) in enumerate(words):
                genders.setdefault(text[start:stop].lower(), set()).update(gender if i < len(words) - 1 and gender != "n" else ())
        whole = {span for _, words in named for span in words} | {m.span() for m in BARE.finditer(text) if m[0].lower() in genders}
        tokens = ((start, stop, text[start:stop].lower()) for start, stop in sorted(whole))
        place((start, stop, "name", f"{min(genders[t]) if len(genders[t]) == 1 else 'n'}:{t}") for start, stop, t in tokens)
    return sorted(out, key=lambda e: e.start)


def surrogate(kind: str, canonical: str, attempt: int = 0, key: bytes = KEY) -> str:
    """Canonical form of the surrogate."""
    return BY_NAME[kind].surrogate(canonical, hashlib.blake2b(f"{kind}/{attempt}/".encode(), key=hashlib.sha512(key).digest()).digest(), attempt)


def render(entity: Entity, original: str, new: str) -> str:
    """The surrogate in the original's format: case, punctuation and grouping."""
    if entity.kind in ("card", "phone", "iban"):
        fresh_chars = iter(new.partition(":")[2] if entity.kind == "phone" else new)
        digits = sum(c.isalnum() for c in original)
        skip = digits - len(entity.canonical.partition(":")[2]) if entity.kind == "phone" else 0
        out = []
        for c in original:
            if c.isalnum():
                skip -= 1
                out.append(c if skip >= 0 else next(fresh_chars))
            else:
                out.append(c)
        return "".join([*out, *fresh_chars])
    if entity.kind == "name":
        return new.upper() if original.isupper() and len(original) > 1 else new[:1].upper() + new[1:]
    if entity.kind == "email":
        return new.upper() if original.isupper() else "".join(n.upper() if i < len(original) and original[i].isupper() else n for i, n in enumerate(new))
    return new


def replace(text: str | None, overrides: dict[tuple[str, str], str] | None = None, key: bytes = KEY) -> tuple[str | None, list[Entity]]:
    """The text with surrogates, and the entities found in it; null stays null."""
    entities = find(text)
    if not entities:
        return text, entities
    out, at = [], 0
    for e in entities:
        original = text[e.start : e.stop]
        new = (overrides or {}).get((e.kind, e.canonical)) or surrogate(e.kind, e.canonical, key=key)
        out += [text[at : e.start], render(e, original, new)]
        at = e.stop
    return "".join([*out, text[at:]]), entities


def mentions(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> distinct ``(doc_id, text_hash, kind, value)`` of each row; map only."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            rows = [(i, k, c) for i in range(batch.num_rows) for k, c in sorted({(e.kind, e.canonical) for e in find(texts[i].as_py())})]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "text_hash", "kind", "value"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(trimmed(run), "doc_id long, text_hash long, kind string, value string")


def collisions(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """Distinct ``entities(kind, value)`` -> ``(kind, value, surrogate)`` of those whose first
    surrogate is the canonical form of a corpus entity (or their own), or the surrogate of
    another entity with a smaller value, and so draw again, and of names whose gender other documents know better."""

    def draw(attempt: int):
        def run(batches):
            for b in batches:
                yield b.assign(surrogate=[surrogate(k, v, attempt, key) for k, v in zip(b["kind"], b["value"])])[["kind", "value", "surrogate"]]

        return run

    kinds = "kind string, value string, surrogate string"
    ident = F.when(F.col("kind") == "name", F.substring_index("value", ":", -1)).otherwise(F.col("value"))
    told = [F.max((F.col("kind") == "name") & F.col("value").startswith(f"{g}:")).alias(g) for g in "mf"]
    gender = F.when(F.col("m") & ~F.col("f"), "m:").when(F.col("f") & ~F.col("m"), "f:").otherwise("n:")
    people = materialize(entities.groupBy("kind", ident.alias("v")).agg(*told).select("kind", "v", F.when(F.col("kind") == "name", F.concat(gender, "v")).otherwise(F.col("v")).alias("value")), "people")
    settled = materialize(people.select("kind", "value").mapInPandas(draw(0), kinds), "surrogates")
    originals = people.select(F.col("kind").alias("k"), "v")
    hit = (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("v"))
    twice = settled.groupBy("kind", "surrogate").agg(F.min("value").alias("keeps"), F.count("*").alias("n")).filter("n > 1")  # shapes overlap: a permutation is one-to-one within one
    alike = settled.join(twice, ["kind", "surrogate"]).filter(F.col("value") != F.col("keeps")).select("kind", "value")
    open_ = materialize(settled.join(originals, hit, "left_semi").select("kind", "value").unionByName(alike).distinct(), "open")
    done = None
    for attempt in itertools.count(1):  # ends: draws leave full shapes for ever longer ones
        if not open_.head(1):
            break
        drawn = materialize(open_.mapInPandas(draw(attempt), kinds), "drawn")
        others = settled.join(open_.select(F.col("kind").alias("k"), F.col("value").alias("v")), (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")), "left_anti").select(F.col("kind").alias("k"), F.col("surrogate").alias("v"))
        used = originals.unionByName(others)
        if done is not None:
            used = used.unionByName(done.select(F.col("kind").alias("k"), F.col("surrogate").alias("v")))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        good = materialize(first.join(used, hit, "left_anti").select("kind", "value", "surrogate"), "good")
        open_ = materialize(open_.join(good.select(F.col("kind").alias("k"), F.col("value").alias("v")), (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")), "left_anti"), "open")
        done = good if done is None else done.unionByName(good)
    final = settled if done is None else settled.join(done.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(done)
    final = final.join(settled.select("kind", "value", F.col("surrogate").alias("first")), ["kind", "value"]).withColumnRenamed("value", "of")
    each = entities.withColumn("v", ident).join(people.withColumnRenamed("value", "of"), ["kind", "v"])
    return each.join(final, ["kind", "of"]).filter((F.col("value") != F.col("of")) | (F.col("surrogate") != F.col("first"))).select("kind", "value", "surrogate")


def pseudonymize(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the fresh columns entities (number) and kinds
    (``card:1,email:2``). Null texts stay null, texts without entities are unchanged, repeated
    rows and equal ids are treated alike; an empty table gives no row; all columns pass."""
    import pyarrow as pa
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    entity_c, kinds_c, hash_c, over_c, id_c, of_c = fresh(docs, "entities", "kinds", "hash", "overrides", "mention_id", "mention_hash")
    small_batches(docs.sparkSession)
    found = materialize(mentions(docs), "mentions")
    again = materialize(collisions(materialize(found.select("kind", "value").distinct(), "entities"), key), "overrides")
    source = docs
    if again.head(1):
        again = again.withColumnsRenamed({"kind": "k", "value": "v"})
        per_row = (
            found.distinct()
            .join(again, (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")))
            .groupBy(F.col("doc_id").alias(id_c), F.col("text_hash").alias(of_c))
            .agg(F.collect_list(F.array("kind", "value", "surrogate")).alias(over_c))  # entities of one text
        )
        per_row = materialize(per_row, "row-overrides")
        marked = docs.withColumn(hash_c, F.xxhash64("text"))
        source = marked.join(per_row, F.col("doc_id").cast("long").eqNullSafe(F.col(id_c)) & (F.col(hash_c) == F.col(of_c)), "left").select(*docs.columns, over_c)
    names = docs.columns
    text_at = next(i for i, c in enumerate(names) if c.lower() == "text")

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            over = columns.pop().to_pylist() if len(columns) > len(names) else [None] * batch.num_rows
            texts = columns[text_at]
            new, counts, kinds = [], [], []
            for i in range(batch.num_rows):
                text, entities = replace(texts[i].as_py(), {(k, v): s for k, v, s in over[i] or ()}, key)
                new.append(text)
                counts.append(len(entities))
                tally: dict[str, int] = {}
                for e in entities:
                    tally[e.kind] = tally.get(e.kind, 0) + 1
                kinds.append(",".join(f"{k}:{n}" for k, n in sorted(tally.items())))
            columns[text_at] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(kinds, pa.string())], names=[*names, entity_c, kinds_c])

    return source.mapInArrow(trimmed(run), StructType([*docs.schema.fields, StructField(entity_c, IntegerType()), StructField(kinds_c, StringType())]))


def pseudonymized_rows(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, n_entities, kinds, text of ``pseudonymize``."""
    out = pseudonymize(docs.select("doc_id", "text"), key)
    return out.select("doc_id", F.col(out.columns[2]).alias("n_entities"), F.col(out.columns[3]).alias("kinds"), "text")
