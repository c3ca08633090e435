"""Personal data replaced by keyed surrogates of the same type and format.

An entity is normalised, so that its spellings agree, and mapped by a keyed permutation of all values
of its shape: digits stay digits, letters stay letters of their script and case, separators stay. A
permutation keeps different values different and has no fixed point. Check digits and reserved address
ranges are kept valid. Names after a title take a first name of the same gender and script from a list,
so two may meet; the distinct names of all documents are therefore checked for collisions and those
that collide are mapped again. Equal values get equal surrogates in every document.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddslake.llm.common import whole_text
from oddslake.llm.shared_files import mapped_array, new_folder, write_array
from oddslake.session import stored

# Given names by gender and script, and titles with the gender they tell.
GIVEN = {
    ("f", "latin"): "Ada Alma Berta Clara Dora Edith Elena Frida Greta Hanna Ida Irma Julia Karla Laura Lena Marta Nora Olga Paula Rosa Sara Thea Vera".split(),
    ("m", "latin"): "Adam Alan Bruno Carl David Edgar Emil Felix Georg Hugo Ivan Jakob Karl Leon Lukas Marco Nils Oscar Paul Ralf Simon Theo Victor Walter".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Софья Юлия".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Иван Кирилл Лев Максим Олег Павел Юрий".split(),
    ("f", "greek"): "Άννα Ελένη Ειρήνη Ζωή Κατερίνα Μαρία Νίκη Σοφία".split(),
    ("m", "greek"): "Αλέξης Γιώργος Δημήτρης Κώστας Μάριος Νίκος Πέτρος Σπύρος".split(),
}
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "", "Prof": "",
}
_MALE = frozenset(n for (g, _), names in GIVEN.items() if g == "m" for n in names)
#: Letters that stand for one another: one row per script.
_ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώ",
)
_CLASS = {c: (k, i) for k, letters in enumerate(_ALPHABETS) for i, c in enumerate(letters)}

#: An address is read from its ``@`` in both directions, so a long run of letters is looked at once.
_LOCAL = re.compile(r"[\w.+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_CARD = re.compile(r"(?<![\d+])(?:\d[ -]?){12,18}\d(?!\d)")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_WORD = r"[^\W\d_][^\W\d_]+(?:-[^\W\d_]+)?"
_NAME = re.compile(rf"(?<!\w)({'|'.join(TITLES)})(\.? )({_WORD})(?:( )({_WORD}))?")
#: Two words in a row; the second is looked at again as the first of the next two.
_PAIR = re.compile(rf"(?<!\w)({_WORD})(?= ({_WORD})(?!\w))")
KINDS = ("email", "iban", "ip", "card", "ssn", "phone", "name")


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    end: int
    value: str  # normalised


def _luhn(digits: str) -> int:
    """The check digit that belongs after these digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def detect(text: str) -> list[Entity]:
    """Entities in order, none overlapping; of two that overlap the kind named first stays."""
    found: list[Entity] = []

    def add(kind: str, match: re.Match, value: str) -> None:
        found.append(Entity(kind, match.start(), match.end(), value))

    for start, end in _addresses(text):
        found.append(Entity("email", start, end, text[start:end].lower()))
    if re.search("[0-9]", text):
        for m in _IBAN.finditer(text):
            value = m[0].replace(" ", "")
            if _mod97(value[4:] + value[:4]) == 1:
                add("iban", m, value)
        for m in _IP.finditer(text):
            if all(p.isascii() and int(p) < 256 for p in m[0].split(".")):
                add("ip", m, ".".join(str(int(p)) for p in m[0].split(".")))
        for m in _CARD.finditer(text):
            digits = _only_digits(m[0])
            if 13 <= len(digits) <= 19 and (len(digits) == 16 or int(digits[-1]) == _luhn(digits[:-1])):
                add("card", m, digits)
        for m in _SSN.finditer(text):
            add("ssn", m, _only_digits(m[0]))
        for m in _PHONE.finditer(text):
            digits = _only_digits(m[0])
            if 9 <= len(digits) <= 15 and re.search(r"[+( .-]", m[0]) and ("+" in m[0] or "(" in m[0] or len(digits) >= 10):
                country = re.match(r"\+(\d{1,3})(?=[ .(-])", m[0])
                add("phone", m, digits[len(country[1]) :] if country else digits)
    found += _named(text)
    rank, taken = {k: i for i, k in enumerate(KINDS)}, []
    starts: list[int] = []
    ends: list[int] = []
    for e in sorted(found, key=lambda e: (rank[e.kind], e.start, -e.end)):
        # Those taken do not overlap, so only the neighbours in order can overlap the next.
        at = bisect_right(starts, e.start)
        if (at and ends[at - 1] > e.start) or (at < len(starts) and starts[at] < e.end):
            continue
        starts.insert(at, e.start)
        ends.insert(at, e.end)
        taken.append(e)
    return sorted(taken, key=lambda e: e.start)


def _addresses(text: str) -> list[tuple[int, int]]:
    """Start and end of the mail addresses, leftmost first."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        run = _LOCAL.match(text[free:at][::-1])[0][::-1]
        first = re.search(r"[^\W_]", run)
        domain = _DOMAIN.match(text, at + 1) if first else None
        free = at + 1
        if domain:
            out.append((at - len(run) + first.start(), domain.end()))
            free = domain.end()
        at = text.find("@", free)
    return out


def _named(text: str) -> list[Entity]:
    """Names after a title, and later or earlier mentions without one of the full names among them."""
    out, full, at = [], {}, 0
    while m := _NAME.search(text, at):
        if m[3] in TITLES:  # one title after another
            at = m.start(3)
            continue
        at = m.end(3)
        if not m[3][0].isupper():
            continue
        words = [m[3]]
        # A verb or another title after a family name is no part of it.
        if m[5] and m[5][0].isupper() and m[5] not in TITLES:
            words.append(m[5])
            at = m.end()
        value = f"{TITLES[m[1]]}|{' '.join(words)}".lower()
        out.append(Entity("name", m.start(3), at, value))
        if len(words) == 2:
            full.setdefault(tuple(words), value)
    if full:
        titled = {e.start for e in out}
        out += [Entity("name", m.start(), m.end(2), full[m[1], m[2]]) for m in _PAIR.finditer(text) if (m[1], m[2]) in full and m.start() not in titled]
    return out


def permuted(key: bytes, tweak: str, x: int, n: int) -> int:
    """Keyed permutation of range(n) without a fixed point if n > 1.

    A Feistel network on the next even number of bits, walked until the value is in range, renames the
    values; a keyed step around the renamed range and the way back give a permutation that moves all.
    """
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8

    def rounds(i: int, v: int) -> int:
        data = f"{tweak}|{n}|{i}".encode() + v.to_bytes(size, "big")
        return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=min(64, size + 8)).digest(), "big") & mask

    def there(v: int) -> int:
        while True:
            a, b = v >> half, v & mask
            for i in range(8):
                a, b = b, a ^ rounds(i, b)
            v = a << half | b
            if v < n:
                return v

    def back(v: int) -> int:
        while True:
            a, b = v >> half, v & mask
            for i in reversed(range(8)):
                a, b = b ^ rounds(i, a), a
            v = a << half | b
            if v < n:
                return v

    step = 1 + int.from_bytes(hashlib.blake2b(f"{tweak}|{n}|step".encode(), key=key).digest(), "big") % (n - 1)
    return back((there(x) + step) % n)


def shaped(key: bytes, tweak: str, text: str) -> str:
    """Permute the letters and digits of a lower-case text among all texts of its shape."""
    shape, x, n = [], 0, 1
    for c in text:
        k, i = _CLASS.get(c, (-1, 0))
        shape.append(c if k < 0 else k)
        if k >= 0:
            x, n = x * len(_ALPHABETS[k]) + i, n * len(_ALPHABETS[k])
    x = permuted(key, f"{tweak}|{shape}", x, n)
    out = []
    for s in reversed(shape):
        if isinstance(s, str):
            out.append(s)
        else:
            x, i = divmod(x, len(_ALPHABETS[s]))
            out.append(_ALPHABETS[s][i])
    return "".join(reversed(out))


def _digits(key: bytes, tweak: str, digits: str) -> str:
    return f"{permuted(key, f'{tweak}|{len(digits)}', int(digits), 10 ** len(digits)):0{len(digits)}d}" if digits else ""


_PRIVATE = ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x7F000000, 24))


def _address(key: bytes, value: str) -> str:
    x = int.from_bytes(bytes(map(int, value.split("."))), "big")
    inside = lambda v: next(((base, bits) for base, bits in _PRIVATE if v >> bits == base >> bits), None)
    if own := inside(x):
        x = own[0] + permuted(key, f"ip|{own}", x - own[0], 1 << own[1])
    else:
        x = permuted(key, "ip", x, 1 << 32)
        while inside(x):  # walks on to the next public address, so it stays a permutation of these
            x = permuted(key, "ip", x, 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _script(text: str) -> str:
    return "cyrillic" if re.search("[а-яё]", text) else "greek" if re.search("[α-ωά-ώ]", text) else "latin"


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """Surrogate of a normalised value, itself normalised. ``attempt`` leads to another one for names."""
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        keep = 2 if labels[-2] in ("example", "test", "invalid") else 1
        own = ".".join(labels[:-keep]) if len(labels) > keep else ""
        new = ".".join([*([shaped(key, f"domain|{labels[-keep:]}", own)] if own else []), *labels[-keep:]])
        return f"{shaped(key, f'local|{domain}', local)}@{new}"
    if kind == "ip":
        return _address(key, value)
    if kind == "card":
        body = _digits(key, "card", value[:-1])
        return body + str((int(value[-1]) - _luhn(value[:-1]) + _luhn(body)) % 10)
    if kind in ("ssn", "phone"):
        return _digits(key, kind, value)
    if kind == "iban":
        body = shaped(key, f"iban|{value[:2]}", value[4:].lower()).upper()
        return f"{value[:2]}{98 - _mod97(body + value[:2] + '00'):02d}{body}"
    gender, _, name = value.partition("|")
    first, _, last = name.partition(" ")
    script = _script(name)
    if last:
        gender = gender or ("m" if first.capitalize() in _MALE else "f")
        names = [n for n in GIVEN[gender, script] if n.lower() != first]
        pick = int.from_bytes(hashlib.blake2b(f"given|{attempt}|{gender}|{first}".encode(), key=key).digest()[:8], "big")
        return f"{value.partition('|')[0]}|{names[pick % len(names)].lower()} {shaped(key, f'family|{attempt}|{first}', last)}"
    return f"{gender}|{shaped(key, f'family|{attempt}', first)}"


def rendered(original: str, entity: Entity, new: str) -> str:
    """The surrogate in the spelling of the original: its separators, case, and country code."""
    if entity.kind == "name":
        return " ".join(w.upper() if o.isupper() and len(o) > 1 else w.title() for w, o in zip(new.partition("|")[2].split(" "), original.split(" "), strict=True))
    if entity.kind == "ip":
        return new
    if entity.kind == "email":
        same = len(new) == len(original)
        return "".join(n.upper() if same and o.isupper() and len(n.upper()) == 1 else n for n, o in zip(new, original, strict=True)) if same else new
    letters = iter(new)
    skip = len(_only_digits(original)) - len(new) if entity.kind == "phone" else 0
    out = []
    for c in original:
        if c.isalnum() and skip > 0:
            out.append(c)
            skip -= 1
        else:
            out.append(next(letters) if c.isalnum() else c)
    return "".join(out)


def _hash(kind: str, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}|{value}".encode(), digest_size=8).digest(), "big")


def _again(folder: str | None, kind: str, value: str) -> int:
    """How often a name must be mapped anew, 0 for all that do not collide."""
    if folder is None or kind != "name":
        return 0
    hashes, attempts = mapped_array(folder, "hashes", "uint64"), mapped_array(folder, "attempts", "uint8")
    at = int(np.searchsorted(hashes, np.uint64(_hash(kind, value)))) if len(hashes) else 0
    return int(attempts[at]) if at < len(hashes) and int(hashes[at]) == _hash(kind, value) else 0


def _names(key: bytes, folder: str | None):
    schema = pa.schema([("value", pa.string()), ("new", pa.string()), ("attempt", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = sorted({e.value for text in batch.column("text").to_pylist() for e in detect(text) if e.kind == "name"})
            tries = [_again(folder, "name", v) for v in values]
            new = [surrogate(key, "name", v, t) for v, t in zip(values, tries, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((values, new, tries), schema, strict=True)], schema=schema)

    return run


def _checked(texts: DataFrame, key: bytes, rounds: int = 64) -> str | None:
    """Folder with the names that must be mapped anew so that all stay different, None if no two meet."""
    names = stored(texts.mapInArrow(_names(key, None), "value STRING, new STRING, attempt INT").distinct())
    folder = None
    for _ in range(rounds):
        first = names.groupBy("new").agg(F.min("value").alias("keeps"), F.count(F.lit(1)).alias("k")).where("k > 1")
        lost = names.join(first, "new").where("value <> keeps").select("value", (F.col("attempt") + 1).alias("attempt"))
        if lost.isEmpty():
            return folder
        moved = stored(names.where("attempt > 0").select("value", "attempt").join(lost.select("value"), "value", "left_anti").unionByName(lost))
        folder = new_folder(texts.sparkSession, "names")

        def write(batches: Iterator[pa.RecordBatch], to: str = folder) -> Iterator[pa.RecordBatch]:
            rows = [(_hash("name", v), a) for b in batches for v, a in zip(b.column("value").to_pylist(), b.column("attempt").to_pylist(), strict=True)]
            rows.sort()
            write_array(to, "hashes", np.array([r[0] for r in rows], np.uint64))
            write_array(to, "attempts", np.array([r[1] for r in rows], np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

        moved.repartition(1).mapInArrow(write, "n BIGINT").collect()  # only names that met another
        redo = names.select("value").distinct()

        def again(batches: Iterator[pa.RecordBatch], to: str = folder) -> Iterator[pa.RecordBatch]:
            for b in batches:
                values = b.column("value").to_pylist()
                tries = [_again(to, "name", v) for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array([surrogate(key, "name", v, t) for v, t in zip(values, tries, strict=True)], pa.string()), pa.array(tries, pa.int32())], names=["value", "new", "attempt"])

        names = stored(redo.mapInArrow(again, "value STRING, new STRING, attempt INT"))
    raise RuntimeError("names still collide; use another key")


def _replace(key: bytes, folder: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("entities", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, spans = [], []
            for text in batch.column("text").to_pylist():
                parts, own, at = [], [], 0
                for e in detect(text):
                    old = text[e.start : e.end]
                    new = rendered(old, e, surrogate(key, e.kind, e.value, _again(folder, e.kind, e.value)))
                    parts += [text[at : e.start], new]
                    own.append({"kind": e.kind, "start": e.start, "end": e.end, "surrogate": new})
                    at = e.end
                out.append("".join([*parts, text[at:]]) if parts else text)
                spans.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), pa.array(spans, schema.field("entities").type)], schema=schema)

    return run


def replace_private(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with every entity replaced, entities: array of (kind, start, end, surrogate).

    Positions are code points of the text as it was, ends exclusive. Null text counts as empty; texts
    without entities come back as they are; repeated rows are replaced alike; an empty table gives no
    rows; other columns are not read. A job runs for the check of names.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    titled = rows.select("text").where(F.col("text").rlike(r"(?:" + "|".join(TITLES) + r")\.? "))
    folder = _checked(titled, key)
    return rows.mapInArrow(_replace(key, folder), "doc_id BIGINT, text STRING, entities ARRAY<STRUCT<kind: STRING, start: INT, end: INT, surrogate: STRING>>")
