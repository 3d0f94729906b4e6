"""PII: format-preserving Feistel pseudonyms.

Each kind of value is found by its shape, checked, and permuted under a key among the values of the same format: card
numbers keep their first digit, grouping and a right check digit; dates stay dates in their notation; addresses stay
addresses. The same value under the same key gives the same pseudonym in every document, and the permutation can be
undone with the key. Values are linked within one format: a date written year first and the same date written day first, or
one telephone number with and without its country's code, are two values with pseudonyms of their own. Of a match that
fails its check the shorter ones that end between its groups are tried, then other kinds at its place, and the search goes
on behind its first group; so what is left alone holds no value that any shape and check would take.

Defined cases: a null text stays null; an empty one stays empty; a null doc_id is carried; rows are independent, so
repeated rows give repeated results; other columns pass through.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keyline.llm.common import documents, slices

KEY = b"keyline pseudonyms"
ROUNDS = 10
#: Characters that are permuted as one number: 64 of them have halves of less than 256 bits.
SPAN = 64
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
KINDS = ("email", "card", "iban", "ssn", "ip", "phone", "date", "secret")


def permuted(x: int, n: int, tweak: str, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..n-1: a Feistel network over two halves of mixed sizes; steps that leave the range walk on."""
    if n < 2:
        return x
    a = int(n**0.5) + 1 if n < 1 << 100 else 1 << (n.bit_length() + 1) // 2
    b = -(-n // a)

    def f(i: int, half: int, most: int) -> int:
        said = hmac.digest(key, f"{tweak}|{n}|{i}|{half}".encode(), "sha256")
        return int.from_bytes(said + hashlib.sha256(said).digest(), "big") % most

    while True:
        left, right = divmod(x, b)  # left < a, right < b
        for i in range(ROUNDS)[:: -1 if back else 1]:
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * f(i, left, b)) % b
            else:
                left = (left + sign * f(i, right, a)) % a
        x = left * b + right
        if x < n:
            return x


def lettered(s: str, tweak: str, key: bytes, back: bool = False, alphabets=(DIGITS, LOWER, UPPER)) -> str:
    """Each letter and digit stays of its kind in its place; SPAN characters at a time are permuted as one number.

    Later spans are permuted under all pseudonyms before them, so a network's halves never outgrow its rounds' numbers.
    """
    out, chain = [], hashlib.sha256()
    for at in range(0, len(s), SPAN) or (0,):
        part = s[at : at + SPAN]
        made = _lettered(part, f"{tweak}|{chain.hexdigest()}" if at else tweak, key, back, alphabets)
        chain.update((part if back else made).encode())
        out.append(made)
    return "".join(out)


def _lettered(s: str, tweak: str, key: bytes, back: bool, alphabets) -> str:
    kinds = [next((a for a in alphabets if c in a), None) for c in s]
    n, x = 1, 0
    for c, a in zip(s, kinds, strict=True):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    x = permuted(x, n, f"{tweak}|{''.join('-' if a is None else str(len(a)) for a in kinds)}", key, back)
    out = []
    for c, a in zip(reversed(s), reversed(kinds), strict=True):
        if a:
            x, d = divmod(x, len(a))
            c = a[d]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The digit that closes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def into(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def card(s: str, key: bytes, back: bool = False) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or d[0] not in "23456" or int(d[-1]) != luhn(d[:-1]):
        return None
    middle = lettered(d[1:-1], f"card|{d[0]}", key, back)
    return into(s, d[0] + middle + str(luhn(d[0] + middle)))


def ip(s: str, key: bytes, back: bool = False) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    lows = {1: 0, 2: 10, 3: 100}
    ranges = [(lows[len(p)], {1: 10, 2: 90, 3: 156}[len(p)]) for p in parts]
    x, n = 0, 1
    for p, (low, size) in zip(parts, ranges, strict=True):
        x, n = x * size + int(p) - low, n * size
    x, out = permuted(x, n, f"ip|{[len(p) for p in parts]}", key, back), []
    for low, size in reversed(ranges):
        x, d = divmod(x, size)
        out.append(str(d + low))
    return ".".join(reversed(out))


def iban(s: str, key: bytes, back: bool = False) -> str | None:
    plain = s.replace(" ", "")
    checked = lambda body: int("".join(str(int(c, 36)) for c in body))
    if not 15 <= len(plain) <= 34 or checked(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = lettered(plain[4:], f"iban|{plain[:2]}", key, back)
    made = iter(f"{plain[:2]}{98 - checked(body + plain[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(made) for c in s)


def ssn(s: str, key: bytes, back: bool = False) -> str | None:
    a, b, c = (int(s[i:j]) for i, j in ((0, 3), (4, 6), (7, 11)))
    legal = lambda a, b, c: 0 < a < 900 and a != 666 and b > 0 and c > 0
    if not legal(a, b, c):
        return None
    x = a * 10**6 + b * 10**4 + c
    while True:
        x = permuted(x, 10**9, "ssn", key, back)
        a, b, c = x // 10**6, x // 10**4 % 100, x % 10**4
        if legal(a, b, c):
            return f"{a:03d}{s[3]}{b:02d}{s[6]}{c:04d}"


def phone(s: str, key: bytes, back: bool = False) -> str | None:
    d = _digits(s)
    if not 8 <= len(d) <= 15:
        return None
    head = re.match(r"\+\d{1,3}(?=\D)", s)
    kept = len(_digits(head[0])) if head else 0
    return into(s, d[:kept] + lettered(d[kept:], f"phone|{d[:kept]}", key, back))


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(s: str, key: bytes, back: bool = False) -> str | None:
    """Year first, or day and month in either order with the year last; the order read is the order written.

    A day up to 12 may be read as a month and back, so these dates are permuted among themselves, by month and day.
    """
    m = re.fullmatch(r"(\d{4})([-/.])(\d{2})\2(\d{2})|(\d{2})([-/.])(\d{2})\6(\d{4})", s)
    if not m:
        return None
    if m[1]:
        y, month, day, put = int(m[1]), int(m[3]), int(m[4]), lambda y, mo, da: f"{y:04d}{m[2]}{mo:02d}{m[2]}{da:02d}"
    else:
        p, q, y = int(m[5]), int(m[7]), int(m[8])
        if 1 <= p <= 12 and 1 <= q <= 12 and 1900 <= y <= 2099:
            x = permuted(((y - 1900) * 12 + p - 1) * 12 + q - 1, 200 * 144, "date|open", key, back)
            return f"{x // 12 % 12 + 1:02d}{m[6]}{x % 12 + 1:02d}{m[6]}{x // 144 + 1900:04d}"
        first = q <= 12  # the day is first
        day, month = (p, q) if first else (q, p)
        put = lambda y, mo, da: f"{da:02d}{m[6]}{mo:02d}{m[6]}{y:04d}" if first else f"{mo:02d}{m[6]}{da:02d}{m[6]}{y:04d}"
    if not (1900 <= y <= 2099 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(y, month)[1]):
        return None
    x = datetime.date(y, month, day).toordinal()
    while True:
        x = permuted(x - _FIRST, _LAST - _FIRST + 1, "date", key, back) + _FIRST
        got = datetime.date.fromordinal(x)
        if m[1] or got.day > 12:
            return put(got.year, got.month, got.day)


def email(s: str, key: bytes, back: bool = False) -> str | None:
    name, _, host = s.partition("@")
    domain, _, top = host.rpartition(".")
    return f"{lettered(name, 'email', key, back)}@{lettered(domain, 'host', key, back)}.{top}"


def secret(s: str, key: bytes, back: bool = False) -> str | None:
    if s.startswith("AKIA"):
        return "AKIA" + lettered(s[4:], "key", key, back, (UPPER + DIGITS,))
    head = re.match(r"(?i)(?:password|passwd|secret|token|api_key)\s?[=:]\s?", s)
    at = head.end() if head else 0
    body = s[at:]
    alphabets = (HEX,) if set(body) <= set(HEX) else (DIGITS, LOWER, UPPER)
    return s[:at] + lettered(body, "secret", key, back, alphabets)


#: Fixed shapes, each found in linear time: an address is looked for once in each run of its characters.
_ALONE = {
    "email": r"(?<![A-Za-z0-9._%+-])[._%+-]*+(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",
    "secret": r"(?P<secret>\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|secret|token|api_key)\s?[=:]\s?[^\s\"']{6,}|(?<![0-9A-Za-z])[0-9a-f]{40}(?![0-9A-Za-z]))",
    "iban": r"(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
    "ip": r"(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))",
    "date": r"(?P<date>(?<![0-9])(?:[0-9]{4}(?P<y>[-/.])[0-9]{2}(?P=y)[0-9]{2}|[0-9]{2}(?P<z>[-/.])[0-9]{2}(?P=z)[0-9]{4})(?![0-9]))",
    "ssn": r"(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))",
    "card": r"(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))",
    "phone": r"(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]))",
}
_SHAPES = re.compile("|".join(_ALONE.values()))
#: A text without any of these holds none of the shapes.
_MAY = re.compile(r"[0-9]|@|password|passwd|secret|token|api_key|[0-9a-f]{40}", re.IGNORECASE)
_DO = {f.__name__: f for f in (email, card, iban, ssn, ip, phone, date, secret)}


@lru_cache(1 << 14)
def _once(kind: str, value: str, key: bytes) -> str | None:
    return _DO[kind](value, key)


#: The shapes one by one, for a place where the first that fits was refused.
_KINDS = {k: re.compile(v) for k, v in _ALONE.items()}
#: Where a number's groups begin and end, and the first group of what was refused.
_BEGIN, _END, _GROUP = re.compile(r"(?<![0-9])[0-9]"), re.compile(r"[0-9](?![0-9])"), re.compile(r"[^0-9A-Za-z]*[0-9A-Za-z]+")


def _begins(text: str, kind: str, start: int, at: int, key: bytes) -> bool:
    """Whether another value begins at a group of a card or phone number, which must then end before."""
    for other in ("ip", "date", "ssn", *(("card", "phone") if kind == "phone" else ())):
        m = _KINDS[other].match(text, at)
        if m and _once(other, m[other], key) is not None:
            before = text[start:at].rstrip(" .-(")
            if other not in ("card", "phone") or (_KINDS[kind].fullmatch(before) and len(_digits(before)) >= 8):
                return True
    return False


def _taken(text: str, first: re.Match, key: bytes) -> tuple[str, int, int, str] | None:
    """(kind, start, end, pseudonym) of the value where ``first`` is: the kinds in their order; of a card, phone number or
    IBAN the longest that ends with a group, passes its check and runs into no other value."""
    for kind, shape in _KINDS.items():
        m = shape.match(text, first.start())
        if m is None:
            continue
        start, end = m.span(kind)
        ends = [end]
        if kind in ("card", "phone"):
            stop = next((g.start() for g in _BEGIN.finditer(text, start + 1, end) if g.start() > start + 1 and _begins(text, kind, start, g.start(), key)), end)
            ends = [g.end() for g in _END.finditer(text, start, end) if g.end() <= stop and shape.fullmatch(text, start, g.end())][::-1]
        elif kind == "iban":
            ends += [i for i in range(end - 1, start + 14, -1) if text[i] == " "]
        for as_kind in (kind, "phone") if kind == "card" else (kind,):  # a number in groups that is no card
            for e in ends:
                value = text[start:e]
                if (as_kind == kind or not value.isdigit()) and (new := _once(as_kind, value, key)) is not None:
                    return as_kind, start, e, new
    return None


def pseudonymised(text: str, key: bytes = KEY) -> tuple[str, dict[str, int]]:
    """The text with its values replaced, and how many of each kind."""
    if not _MAY.search(text):
        return text, {}
    found: dict[str, int] = {}
    out, done, at = [], 0, 0
    while (m := _SHAPES.search(text, at)) is not None:
        got = _taken(text, m, key)
        if got is None:
            # behind the first group of what was refused
            at = m.start(m.lastgroup) + _GROUP.match(m[m.lastgroup]).end()
            continue
        kind, start, end, new = got
        found[kind] = found.get(kind, 0) + 1
        out += [text[done:start], new]
        done = at = end
    return "".join([*out, text[done:]]), found


def _run(key: bytes, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 8 << 20):
            at = batch.schema.get_field_index(text)
            got = [(None, {}) if t is None else pseudonymised(t, key) for t in batch.column(at).to_pylist()]
            columns = [pa.array([g[0] for g in got], pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            counts = [pa.array([g[1].get(k, 0) for g in got], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(counts, list(KINDS))], [*batch.schema.names, "_kl_found"])

    return run


def pseudonyms(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """``docs`` whole, its text pseudonymised, and a struct column ``_kl_found`` of counts by kind."""
    counts = StructType([StructField(k, LongType()) for k in KINDS])
    return docs.mapInArrow(_run(key, text), StructType([*docs.schema.fields, StructField("_kl_found", counts)]))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with pseudonyms under the default key, and how many values of each kind it had."""
    out = pseudonyms(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "text", *(F.col(f"_kl_found.{k}").alias(f"n_{k}") for k in KINDS))
