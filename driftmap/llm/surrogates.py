"""Keyed surrogates for personal data.

What identifies someone (addresses, phone and card numbers, names behind a form of
address, secrets) is replaced by a value of its kind: of the same length and
punctuation, with letters and digits of the same script, names of the same gender,
card numbers that pass or fail the same check. The value is drawn by a keyed hash of
the normal form, so the same entity gets the same surrogate in the whole corpus. A
distributed check finds surrogates that two entities share or that really occur;
all but the first of them draw again until there is none.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.llm.cuts import cut

# Given names by gender and script, and forms of address.
FEMALE = {
    "latin": "Anna Maria Sophie Laura Julia Emma Clara Lucia Elena Marie Camille Sarah Alice Nora Ingrid Carmen Paula Greta Helen Irene Mary Linda Susan Karen Jane".split(),
    "cyrillic": "Анна Мария Елена Ольга Ирина Наталья Светлана Татьяна Юлия Вера".split(),
    "greek": "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα".split(),
}
MALE = {
    "latin": "John James Peter Paul Thomas Martin Lukas Felix Jonas Carlos Diego Pablo Antoine Hugo Louis Pierre Jean Max Karl Hans David Robert Daniel Mark Michael".split(),
    "cyrillic": "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Павел Олег".split(),
    "greek": "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Πέτρος".split(),
}
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"]
OTHER_TITLES = ["Dr", "Prof"]
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
CONSONANTS = {"latin": "bcdfglmnprstv", "cyrillic": "бвгдклмнпрст", "greek": "βγδκλμνπρστ"}

_GENDER = {n: g for g, names in (("female", FEMALE), ("male", MALE)) for of in names.values() for n in of}
_TITLES = "|".join(map(re.escape, FEMALE_TITLES + MALE_TITLES + OTHER_TITLES))
#: What a text must show to be searched at all; Java and Python read it alike.
HINT = rf"@|\p{{Nd}}[\p{{Nd}} ()./-]{{5}}|[0-9a-fA-F]{{32}}|\b(?:{_TITLES})\b"
# Parts of names: capital letters, letters with their marks, words (O'Brien, but not Smith's), words of any case, initials, particles.
_CAPITAL = "[" + "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Lu", "Lt")) + "]"
_LETTER = r"[^\W\d_][\u0300-\u036f]*"
_REST = rf"[\u0300-\u036f]*(?:['’](?:{_LETTER}){{2,}}|(?:{_LETTER})+)(?:['’]{_CAPITAL}(?:{_LETTER})+)*"
_HYPHENED = rf"(?:[-‐‑](?:{_LETTER})+)*"
_TITLE = rf"(?!(?:{_TITLES})\b)"
_PARTICLE = r"(?:(?:von|van|der|den|de|del|della|di|da|dos|du|la|le|zu|zur|ten|ter|bin|ibn|al|el)[ ]+)*"
_INITIAL = rf"{_CAPITAL}(?:\.|(?=[^\S\n]+{_CAPITAL}(?:{_LETTER})+))"
_NAME = rf"{_TITLE}(?:[^\W\d_a-z]{_REST}{_HYPHENED}|{_INITIAL})"
_MORE = rf"{_TITLE}(?:{_PARTICLE}{_CAPITAL}{_REST}{_HYPHENED}|{_INITIAL})"
_BLANK = r"[^\S\n]"
_NAMES = rf"(?:{_PARTICLE}(?={_CAPITAL}))?{_NAME}(?:(?:[ ]|(?<=\.)){_NAME})?(?:(?:{_BLANK}+|(?<=\.)){_MORE})*"
_PIECE = re.compile(rf"(?P<initial>{_CAPITAL}(?=\.|{_BLANK}|$))|(?P<piece>[^\W\d_]{_REST})")
#: A capitalised word, which may be a name that the text has elsewhere behind a title; and one in small letters.
_MENTION = re.compile(rf"(?<![^\W_]){_CAPITAL}{_REST}(?![^\W_])")
_SMALL = re.compile(rf"(?<![^\W_])(?!{_CAPITAL})(?:{_LETTER})+(?![^\W_])")
_TAIL = r"\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
_ABROAD = rf"00[1-9]\d{{0,2}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?{_TAIL}"
_NATIONAL = (
    r"(?<![\w.+-])(?:1[ .-])?[2-9]\d{2}(?P<sep>[ .-])\d{3}(?P=sep)\d{4}(?!\w)"
    r"|(?<![\w.+-])0[1-9](?:[ .-]?\d{2}){4}(?!\w)"
    r"|(?<![\w.+-])(?=0(?:[ /-]?\d){6,14}(?!\w))0[1-9]\d{0,4}[ /-]\d{3,8}(?:[ -]\d{2,5}){0,3}(?!\w)|(?<![\w.+-])0[1-9]\d{8,10}(?!\w)"
    r"|(?<!\w)\(0\d{1,5}\)[ .-]?\d{3,8}(?:[ .-]\d{2,5}){0,3}(?!\w)"
)
#: Signs of an address before its @, and the start of a run of them; no run is looked at twice.
_RUN, _FIRST = re.compile(r"[\w.+-]*+"), r"(?<![\w.+-])"
_PATTERNS = (
    rf"(?P<email>{_FIRST}[\w.+-]++@[\w-]++(?:\.[\w-]++)+)"
    r"|(?P<secret>(?<![\w])(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}(?![\w]))"
    r"|(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\w))"
    rf"|(?P<card>(?<![\w+])(?!{_ABROAD})\d(?:[ -]?\d){{12,18}}(?![\w]))"
    r"|(?P<phone>(?<![\w])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w])\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
    rf"|(?<![\w.]){_ABROAD}|{_NATIONAL})"
    rf"|(?P<name>\b(?P<title>{_TITLES})(?:\.{_BLANK}*\n?|{_BLANK}+\n?|\n){_BLANK}*(?P<names>{_NAMES}))"
)


_FOUND, _REST_OF_RUN = re.compile(_PATTERNS), re.compile(_PATTERNS.replace(_FIRST, "", 1))


def _found(text: str) -> Iterator[re.Match]:
    """All matches; an address may also start right behind the match before it."""
    at = run_end = 0
    while True:
        m = None
        if at >= run_end:
            run_end = _RUN.match(text, at).end()
        if at and at < run_end < len(text) and text[run_end] == "@":
            m = _REST_OF_RUN.match(text, at)
        m = m or _FOUND.search(text, at)
        if not m:
            return
        yield m
        at = m.end()


def script(text: str) -> str:
    """latin, cyrillic or greek, by the first letter of these."""
    for c in text:
        for name in ("latin", "cyrillic", "greek"):
            if c.isalpha() and unicodedata.name(c, "").lower().startswith(name):
                return name
    return "latin"


def _titled(text: str) -> Iterator[tuple[int, int, str, str]]:
    """What the patterns find, names behind a title only."""
    for m in _found(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if m["name"] is None:
            found = m[0].rstrip(".") if kind == "email" else m[0]
            digits = "".join(str(int(c)) for c in found if c.isdecimal())
            normal = {"email": found.lower(), "ip": found, "secret": found.lower()}.get(kind, digits)
            yield start, start + len(found), kind, normal
            continue
        title, at = m["title"], m.start("names")
        parts = [(p.start(), p[0]) for p in re.finditer(r"[^\s.]+", m["names"])]
        parts = [(i, part) for i, part in parts if not re.fullmatch(_PARTICLE, part + " ")]
        several = sum(len(part) > 1 for _, part in parts) > 1
        first = next((i for i, part in parts if len(part) > 1), None)
        for i, part in parts:
            if len(part) == 1:
                yield at + i, at + i + 1, "initial", part
                continue
            for p in _PIECE.finditer(part):
                given = p[0] in _GENDER or several and i == first
                gender = "female" if title in FEMALE_TITLES else "male" if title in MALE_TITLES else _GENDER.get(p[0], "male")
                yield at + i + p.start(), at + i + p.end(), "initial" if p["initial"] else gender if given else "surname", p[0]


def entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of what is found, from left to right, without overlap.

    A name that has a title somewhere in the text is found all over it, in its own
    writing or in capitals; not where the text has the same word in small letters.
    """
    found = list(_titled(text))
    names: dict[str, tuple[str, str]] = {}
    for _, _, kind, normal in found:
        if kind in ("female", "male", "surname") and normal[0].isupper():
            names.setdefault(normal.upper(), (kind, normal))
    if not names:
        yield from found
        return
    gaps = list(zip([0, *(e[1] for e in found)], [*(e[0] for e in found), len(text)], strict=True))
    for a, b in gaps:
        for m in _SMALL.finditer(text, a, b):
            names.pop(m[0].upper(), None)
    for (a, b), one in zip(gaps, [*found, None], strict=True):
        for m in _MENTION.finditer(text, a, b):
            kind, normal = names.get(m[0].upper(), ("", ""))
            if m[0] in (normal, normal.upper()):
                yield m.start(), m.end(), kind, normal
        if one:
            yield one


class _Draws:
    """Numbers from a keyed hash of the entity and the attempt."""

    def __init__(self, key: bytes, kind: str, normal: str, attempt: int) -> None:
        self.seed, self.n = hmac.new(key, f"{kind}\0{normal}\0{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), 0
        self.pool = int.from_bytes(self.seed, "big")

    def below(self, n: int) -> int:
        if self.pool < n << 64:
            self.n += 1
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest(), "big")
        self.pool, x = divmod(self.pool, n)
        return x


def _like(c: str, draws: _Draws) -> str:
    """A character of the class of ``c``: digit, vowel or consonant of its script and case; others stay."""
    if c.isdecimal():
        return chr(ord(c) - int(c) + draws.below(10))
    if not c.isalpha():
        return c
    plain = unicodedata.normalize("NFD", c)[0].lower()
    letters = VOWELS[script(c)] if plain in VOWELS[script(c)] else CONSONANTS[script(c)]
    x = letters[draws.below(len(letters))]
    return x.upper() if c.isupper() else x


def _passes(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def surrogate(key: bytes, kind: str, normal: str, attempt: int) -> str:
    """The normal form of the surrogate; later attempts of short names may be longer."""
    draws = _Draws(key, kind, normal, attempt)
    if kind == "email":
        local, _, domain = normal.rpartition("@")
        labels = domain.split(".")
        return "".join(_like(c, draws) for c in local) + "@" + ".".join(["".join(_like(c, draws) for c in labels[0]), *labels[1:]])
    if kind == "ip":
        return str(ipaddress.IPv4Address(draws.below(222 << 24) + (1 << 24)))
    if kind == "secret":
        return "".join("0123456789abcdef"[draws.below(16)] for _ in normal)
    if kind == "card":
        body = normal[0] + "".join(str(draws.below(10)) for _ in normal[2:])
        checks = [d for d in "0123456789" if _passes(body + d) == _passes(normal)]
        return body + checks[draws.below(len(checks))]
    if kind == "phone":
        keep = min(3, max(1, len(normal) - 9))
        return normal[:keep] + "".join(str(draws.below(10)) for _ in normal[keep:])
    if kind == "initial":
        letters = [x for x in VOWELS[script(normal)] + CONSONANTS[script(normal)] if x.upper() != normal]
        return letters[draws.below(len(letters))].upper()
    if kind in ("female", "male"):
        names = (FEMALE if kind == "female" else MALE)[script(normal)]
        return "-".join(names[draws.below(len(names))] for _ in range(1 + attempt // 4))
    longer = normal + "an" * (attempt // 4) if script(normal) == "latin" else normal + normal[-1].lower() * (attempt // 4)
    return "".join(_like(c, draws) for c in longer)


def rendered(original: str, kind: str, value: str) -> str:
    """A surrogate in the writing of the original: its punctuation, its digits' script, its case."""
    if kind in ("card", "phone"):
        digits = iter(value)
        return "".join(chr(ord(c) - int(c) + int(next(digits))) if c.isdecimal() else c for c in original)
    if kind in ("email", "secret") and len(value) == len(original):
        return "".join(v.upper() if c.isupper() else v for c, v in zip(original, value, strict=True))
    if kind in ("female", "male", "surname") and len(original) > 1 and original.isupper():
        return value.upper()
    return value


def rewritten(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with surrogates, and how many entities it had."""
    out, at, n = [], 0, 0
    for start, end, kind, normal in entities(text):
        out += [text[at:start], rendered(text[start:end], kind, surrogate(key, kind, normal, attempts.get((kind, normal), 0)))]
        at, n = end, n + 1
    return "".join(out) + text[at:], n


def drawn_again(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, normal, attempt) of the distinct entities ``found`` that can't keep their first surrogate.

    Of entities with one surrogate the one with the fewest attempts stays, then the
    first; one whose surrogate really occurs never stays.
    """

    def draw(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "normal", "attempt")), strict=True)
            value = [surrogate(key, *row) for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("normal"), batch.column("attempt"), pa.array(value, pa.string())], names=["kind", "normal", "attempt", "value"])

    schema = "kind string, normal string, attempt int, value string"
    real = found.select("kind", F.col("normal").alias("value"), F.lit(True).alias("real"))
    state = cut(found.select("kind", "normal", F.lit(0).alias("attempt")).mapInArrow(draw, schema))
    while True:
        first = state.groupBy("kind", "value").agg(F.min(F.struct("attempt", "normal")).alias("first"), F.count(F.lit(1)).alias("n"))
        first = first.join(real, ["kind", "value"], "left").where("n > 1 OR real")
        taken = cut(state.join(first, ["kind", "value"]).where(F.col("real").isNotNull() | (F.col("normal") != F.col("first.normal"))).select("kind", "normal"))
        if taken.limit(1).count() == 0:
            return state.where("attempt > 0").select("kind", "normal", "attempt")
        again = state.join(taken, ["kind", "normal"]).select("kind", "normal", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, schema)
        state = cut(state.join(taken, ["kind", "normal"], "left_anti").union(again))


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows of ``docs`` with personal data replaced in ``text``, and ``n_entities``.

    All other columns stay as they are (one that is named n_entities is replaced).
    Null and empty texts and texts without personal data stay as they are. Repeated
    rows get equal texts. An empty table gives no rows.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*columns)
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))

    def detect(batches):
        for batch in batches:
            kinds, normals, keys = [], [], []
            for k, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for kind, normal in {e[2:] for e in entities(text) if e[2] != "initial"}:
                    keys.append(k)
                    kinds.append(kind)
                    normals.append(normal)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.string()), pa.array(normals, pa.string())], names=["digest", "kind", "normal"])

    searched = docs.where(hinted).select(F.sha2("text", 256).alias("digest"), "text")
    held = cut(searched.mapInArrow(detect, "digest string, kind string, normal string").distinct())
    again = drawn_again(held.select("kind", "normal").distinct(), key)
    exceptions = held.join(again, ["kind", "normal"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "normal", "attempt")).alias("__again"))
    exceptions = cut(exceptions.withColumnRenamed("digest", "__digest"))
    fields = [f for f in docs.schema.fields]

    def rewrite(batches):
        for batch in batches:
            texts, counts = [], []
            for text, more in zip(batch.column("text").to_pylist(), batch.column("__again").to_pylist(), strict=True):
                text, n = rewritten(text, key, {(e["kind"], e["normal"]): e["attempt"] for e in more or ()})
                texts.append(text)
                counts.append(n)
            new = {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([*(new.get(c, batch.column(c)) for c in columns), pa.array(counts, pa.int64())], names=[*columns, "n_entities"])

    schema = docs.schema.__class__(fields).add("n_entities", "long")
    changed = docs.where(hinted).withColumn("__digest", F.sha2("text", 256)).join(exceptions, "__digest", "left").drop("__digest").mapInArrow(rewrite, schema)
    return docs.where(~hinted).withColumn("n_entities", F.lit(0).cast("long")).union(changed)
