"""PII surrogates: keyed, type-consistent replacements that keep gender, script and format.

A surrogate is a keyed permutation (a Feistel network with cycle walking) of the entities of one type and format. So
distinct entities have distinct surrogates and an entity has the same one in every document, without
any table of entities; the collision check inside is that a walk goes on until the value is a valid one of its
kind. The permutation is one cycle, so no entity stays as it is. ``collisions`` audits a result over the whole corpus.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import table

#: Given names by script and gender, and surnames by script; surrogates stay in their list.
NAMES = {
    ("latin", "f"): (
        "Anna Maria Julia Laura Sarah Emma Sophie Claire Lucia Elena Carmen Isabel Marie Camille Ingrid Helga Petra Monika Alice Emily Grace Olivia Hannah Nora "
        "Aisha Fatima Layla Zainab Priya Ananya Lakshmi Yuki Sakura Haruka Akiko Mei Xiaoling Agnieszka Katarzyna Magdalena Ayşe Elif Zeynep Ngozi Chioma Amara Giulia Francesca Chiara Astrid Freya Sofía Valentina Thi"
    ).split(),
    ("latin", "m"): (
        "John Michael David Peter Thomas James Robert Hans Klaus Jürgen Stefan Pierre Jean Luc Antoine Carlos Miguel José Juan Diego Oliver Henry Walter Marco "
        "Wolfgang Heinrich Friedrich Günther Łukasz Krzysztof Piotr Wojciech Kenji Hiroshi Takashi Satoshi Mohammed Ahmed Omar Khalid Yusuf Hassan Rajesh Arjun Sanjay Vikram Mehmet Mustafa Emre Chidi Kwame Giovanni Luca Lars Sven Bjørn"
    ).split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Андрей Николай Владимир".split(),
}
SURNAMES = {
    "latin": "Smith Johnson Brown Miller Wilson Taylor Müller Schmidt Schneider Fischer Weber Wagner Martin Bernard Dubois Moreau Laurent García Fernández López Martínez Sánchez Pérez Gómez".split(),
    "cyrillic": "Иванов Петров Сидоров Смирнов Кузнецов Попов Соколов Лебедев".split(),
    "han": list("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕"),
}
#: Titles by gender; those of neither are without one.
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña Lady".split(), "m": "Mr Herr Monsieur Señor Sr Don Sir".split(), "": "Dr Doctor Prof Professor Professeur Doktor".split()}
PARTICLES = "von van de da del della di du la le der den bin ibn al el zu".split()
_TITLES = frozenset(t for ts in TITLES.values() for t in ts)
_GENDER = {n: k for k, ns in NAMES.items() for n in ns}
_SURNAME = {n: k for k, ns in SURNAMES.items() for n in ns}

_LETTERS = [chr(c) for c in range(0x41, 0x530) if chr(c).isalpha()]
_UP, _LOW = ("".join(c for c in _LETTERS if f(c)) for f in (str.isupper, str.islower))
_CAP = rf"[{_UP}][{_LOW}]+(?:[-'’][{_UP}][{_LOW}]+)?"
#: Two or more capitalised words in a row, the first perhaps a title.
RUN = re.compile(rf"[{_UP}](?<!\w.)[{_LOW}]+(?:[-'’][{_UP}][{_LOW}]+)?\.?(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_CAP}\.?)+(?!\w)")
_H = "\u4e00-\u9fff"
_HAN = "".join(SURNAMES["han"])
HAN = re.compile(rf"[{_HAN}](?:(?<=我叫.)|(?<=名叫.)|(?<=姓名.)|(?<=姓名[：:].))[{_H}]{{1,2}}|[{_HAN}][{_H}]{{1,2}}(?=先生|女士|小姐|老师|博士)|[{_HAN}](?<![{_H}].)[{_H}]{{1,2}}(?![{_H}])")
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "secret": r"(?<![A-Za-z0-9])(?:(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,128}|(?=[0-9A-F]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|ghp|gho|xox[abp])[-_][A-Za-z0-9]{20,})(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w])|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.+-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])",
    "card": r"(?<![\w.+-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\w)",
}
DIGITAL = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()).replace(r"([ -]?)\d{4}\1\d{4}\1\d{4}", r"(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{4}"))
HINT = re.compile(r"[@0-9]")


def _round(key: bytes, tweak: bytes, i: int, value: int, size: int) -> int:
    data = tweak + bytes([i]) + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
    return int.from_bytes(hmac.new(key, data, hashlib.sha256).digest(), "big") % size


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """The successor of a value in a keyed cyclic order of range(size): a permutation that leaves no value as it is.

    The order is that of ten Feistel rounds over a square that holds the range, walked until inside.
    """
    if size < 2:
        return value
    half = 1
    while half * half < size:
        half += 1 if size < 10_000 else max(1, half // 1000) if half * half > size // 2 else half
    while True:
        left, right = divmod(value, half)
        for i in range(10):
            left, right = right, (left + _round(key, tweak, i, right, half)) % half
        value = left * half + right
        if value < size:
            break
    value = (value + 1) % size
    while True:  # and back
        left, right = divmod(value, half)
        for i in reversed(range(10)):
            left, right = (right - _round(key, tweak, i, left, half)) % half, left
        value = left * half + right
        if value < size:
            return value


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ", "àáâäæçèéêëìíîïñòóôöœùúûüßãåðõøýþÿ", "ÀÁÂÄÆÇÈÉÊËÌÍÎÏÑÒÓÔÖŒÙÚÛÜÃÅÐÕØÝÞ")
_SET = {c: s for s in _SETS for c in s}
#: In names vowels stay vowels.
_SOUNDS = {c: s for s in ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯЁ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ") for c in s}


@lru_cache(maxsize=4096)
def _kin(c: str) -> str:
    """The characters that may stand for one: those of its class in its script; of other scripts the letters of its kind near it."""
    if c in _SET or not c.isalpha():
        return _SET.get(c, "")
    lo = ord(c) // 128 * 128
    return "".join(x for x in map(chr, range(lo, lo + 128)) if unicodedata.category(x) == unicodedata.category(c) and x not in _SET)


def reshape(text: str, key: bytes, kind: str, hexadecimal: bool = False, sounds: bool = False) -> str:
    """A permutation of the texts of one format: each character keeps its class and script, others stay."""
    sets = ["0123456789abcdef" if hexadecimal and c in "0123456789abcdef" else _SOUNDS[c] if sounds and c in _SOUNDS else _kin(c) for c in text]
    if sounds and len(text) > 2 and text[-1] in "aeiouаеиоуыяё":
        sets[-1] = ""  # the ending of a name may tell its gender
    size, value = 1, 0
    for c, s in zip(text, sets, strict=True):
        if s:
            size, value = size * len(s), value * len(s) + s.index(c)
    shape = "".join(s[:1] or c for c, s in zip(text, sets, strict=True))
    value = permute(value, size, key, f"{kind}|{shape}".encode())
    out = []
    for c, s in zip(reversed(text), reversed(sets), strict=True):
        if s:
            value, at = divmod(value, len(s))
            c = s[at]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[-1::-2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def _like(text: str, key: bytes, kind: str, good, **more) -> str:
    """Walk the permutation until the value is as good as the text was, and not the text itself; a keyed token where there is none."""
    want, now = good(text), text
    for _ in range(100_000):
        now = reshape(now, key, kind, **more)
        if now == text:  # once around
            break
        if good(now) == want:
            return now
    return f"{kind}-{hmac.new(key, text.encode(), hashlib.sha256).hexdigest()[:32]}"


def _name(name: str, key: bytes, last: bool) -> str:
    """A listed name for a listed one of its script (and gender), an unlisted one for an unlisted one."""
    if "-" in name or "'" in name or "’" in name:
        return re.sub(r"[^-'’]+", lambda m: _name(m[0], key, last), name)
    for pools, of, kind in ((SURNAMES, _SURNAME, "surname"), (NAMES, _GENDER, "given"))[:: 1 if last else -1]:
        at = of.get(name)
        if at is not None:
            pool = pools[at]
            return pool[permute(pool.index(name), len(pool), key, f"{kind}|{at}".encode())]
    return _like(name, key, "name", lambda x: x in _SURNAME or x in _GENDER, sounds=True)


def iban_check(country: str, account: str) -> int:
    """The check digits that make an account number valid."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country) + "00") % 97


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement of one entity."""
    if kind == "email":
        local, _, domain = text.partition("@")
        host, dot, top = domain.rpartition(".")
        return reshape(local, key, "local") + "@" + reshape(host, key, "host") + dot + top
    if kind == "ip":
        parts = text.split(".")
        if all(str(int(p)) == p for p in parts):
            value = 0
            for part in parts:
                value = value * 256 + int(part)
            value = permute(value, 1 << 32, key, b"ip")
            return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
        # octets with leading zeros keep their digits' number, and one of them its zero
        return _like(text, key, kind, lambda x: all(int(p) < 256 for p in x.split(".")) and any(str(int(p)) != p for p in x.split(".")))
    if kind == "card":
        return _like(text, key, kind, lambda x: luhn(re.sub(r"\D", "", x)))
    if kind == "phone" and text.startswith("+"):
        head = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d{2}", text)[0]
        return head + reshape(text[len(head) :], key, f"phone{head}")
    if kind == "iban":
        # the check digits keep their distance from valid ones: valid numbers stay valid, others don't become so
        account = reshape(text[4:], key, f"iban{text[:2]}")
        off = int(text[2:4]) - iban_check(text[:2], text[4:].replace(" ", ""))
        return f"{text[:2]}{(iban_check(text[:2], account.replace(' ', '')) + off) % 100:02d}{account}"
    if kind == "secret":
        lead = re.match(r"AKIA|(?:sk|ghp|gho|xox[abp])[-_]|", text)[0]
        if lead:
            return lead + reshape(text[len(lead) :], key, lead)
        if text.upper() == text:
            return surrogate(kind, text.lower(), key + b"upper").upper()
        return _like(text, key, kind, lambda x: bool(re.search("[0-9]", x) and re.search("[a-f]", x)), hexadecimal=True)
    if kind == "person":
        if text[0] in _HAN:
            pool = SURNAMES["han"]
            return pool[permute(pool.index(text[0]), len(pool), key, b"han")] + reshape(text[1:], key, "han")
        words = text.split(" ")
        named = [i for i, w in enumerate(words) if w.rstrip(".") not in _TITLES and w not in PARTICLES]
        for i in named:
            words[i] = _name(words[i], key, i == named[-1])
        return " ".join(words)
    return reshape(text, key, kind)


def _given(word: str) -> bool:
    return word in _GENDER or word.partition("-")[0] in _GENDER


def persons(text: str) -> list[tuple[int, int]]:
    """(start, end) of the persons of a text: a title with one to three capitalised words, a listed given name with the next one, and their
    names where they stand alone; Chinese names by their surname where they stand apart, before a title or after words that introduce a name."""
    out, names = [], set()
    for m in RUN.finditer(text):
        words = [(w[0], m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"[^ ]+", m[0])]
        i = 0
        while i < len(words):
            j = i
            while j < len(words) and words[j][0].rstrip(".") in _TITLES:
                j += 1
            titled, first, found = j > i, j, 0
            while j < len(words) and found < 4:
                w, before = words[j][0], words[j - 1][0] if j else ""
                if w in PARTICLES:
                    j += 1
                    continue
                if w.rstrip(".") in _TITLES or not (titled or found or _given(w)) or (not titled and found and not _given(before) and before not in PARTICLES):
                    break
                found, j = found + 1, j + 1
                if w.endswith(".") or (titled and (w in _SURNAME or found == 3)):
                    break
            while j > first and words[j - 1][0] in PARTICLES:
                j -= 1
            if found > (not titled):
                end = words[j - 1][2] - words[j - 1][0].endswith(".")
                out.append((words[i][1], end))
                own = [w.rstrip(".") for w, _, _ in words[first:j] if w not in PARTICLES]
                names |= {w for w in own if len(w) > 2}
                i = j
            else:
                i = max(j, i + 1) if titled else i + 1
    out += [] if text.isascii() else [(m.start(), m.end()) for m in HAN.finditer(text)]
    if names:
        taken = sorted(out)
        starts = [a for a, _ in taken]
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, names), key=len, reverse=True))})(?!\w)", text):
            k = bisect_right(starts, m.start()) - 1
            if k < 0 or taken[k][1] <= m.start():
                out.append((m.start(), m.end()))
    return sorted(out)


def entities(text: str | None, kinds: frozenset[str] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities of a text, in order and apart from each other."""
    out = []
    if text and HINT.search(text):
        out = [(next(k for k in PATTERNS if m.group(k) is not None), m.start(), m.end()) for m in DIGITAL.finditer(text)]
    if text:
        starts, ends = [a for _, a, _ in out], [b for _, _, b in out]
        for a, b in persons(text):
            k = bisect_right(starts, a)
            if (k == 0 or ends[k - 1] <= a) and (k == len(starts) or b <= starts[k]):
                out.append(("person", a, b))
        out.sort(key=lambda x: x[1])
    return [x for x in out if kinds is None or x[0] in kinds]


def replaced(text: str | None, key: bytes, kinds: frozenset[str] | None = None) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each entity."""
    found = entities(text, kinds)
    if not found:
        return text, []
    out, pos, said = [], 0, []
    for kind, a, b in found:
        new = surrogate(kind, text[a:b], key)
        out += [text[pos:a], new]
        said.append((kind, text[a:b], new))
        pos = b
    return "".join([*out, text[pos:]]), said


def pseudonymise(docs: DataFrame, key: bytes, kinds: frozenset[str] | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; all other columns stay, but ``n_chars`` follows the text if both are there.

    Null and empty texts stay as they are; equal texts have equal results in every row, whatever their ids (which may be null). Texts are
    taken whole, no rows give no rows, and other columns may have any name.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            old = b.column(at).to_pylist()
            new = [replaced(t, key, kinds)[0] for t in old]
            b = b.set_column(at, b.schema.field(at), pa.array(new, type=b.schema.field(at).type))
            if "n_chars" in names and pa.types.is_int64(b.schema.field("n_chars").type):
                k = b.schema.get_field_index("n_chars")
                sizes = [n if a == t else len(t) for a, t, n in zip(old, new, b.column(k).to_pylist(), strict=True)]
                b = b.set_column(k, b.schema.field(k), pa.array(sizes, type=pa.int64()))
            yield b

    return docs.mapInArrow(run, docs.schema)


def found(docs: DataFrame, key: bytes, kinds: frozenset[str] | None = None) -> DataFrame:
    """``(doc_id, text, n_entities, kinds, entities, surrogates)`` per row of ``docs``: the new text and what was replaced in it, in order.

    Null texts stay null and have no entities; equal texts have equal results, ids may be null, other columns are ignored, no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.slice(lo, 1000)
                got = [replaced(t, key, kinds) for t in part.column("text").to_pylist()]
                lists = [pa.array([[x[i] for x in said] for _, said in got], type=pa.list_(pa.string())) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([t for t, _ in got], type=pa.string()), pa.array([len(s) for _, s in got], type=pa.int64()), *lists], names=["doc_id", "text", "n_entities", "kinds", "entities", "surrogates"]
                )

    schema = "doc_id long, text string, n_entities long, kinds array<string>, entities array<string>, surrogates array<string>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def collisions(result: DataFrame) -> DataFrame:
    """Of a result of ``found``: surrogates that stand for several entities, or entities with several surrogates (no rows: none).

    Distinct pairs are reduced before they are grouped, so frequent entities cost one row per task.
    """
    pairs = result.select(F.explode(F.arrays_zip("kinds", "entities", "surrogates")).alias("e")).select("e.kinds", "e.entities", "e.surrogates").distinct()
    by_new = pairs.groupBy("kinds", F.col("surrogates").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select("kinds", "value", F.lit("surrogate").alias("side"), "n")
    by_old = pairs.groupBy("kinds", F.col("entities").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select("kinds", "value", F.lit("entity").alias("side"), "n")
    return by_new.unionByName(by_old)


#: The key of test data; whoever has a key can turn surrogates back.
TEST_KEY = b"surrogates of test data"
#: The session's setting that holds the key, in hexadecimal.
KEY_SETTING = "spark.framewright.pii.key"


def key_of(spark: SparkSession) -> bytes:
    """The session's key, or that of test data where none is set."""
    given = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(given) if given else TEST_KEY


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = found(table(spark, sf_dir, "documents"), key_of(spark))
    return out.select("doc_id", "text", "n_entities", "kinds", "surrogates")
