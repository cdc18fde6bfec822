"""Format-preserving pseudonyms for personal data."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

ROUNDS = 10


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network over the next even number of bits, walked on until
    it lands inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            digest = hmac.digest(key, f"{tweak}|{size}|{i}|{right}".encode(), hashlib.sha256)
            left, right = right, left ^ (int.from_bytes(digest[:16], "big") & mask)
        value = left << half | right
        if value < size:
            return value


def luhn_digit(payload: str) -> str:
    """The check digit that makes payload + digit pass the Luhn test."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in turn."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _phone(found: str, key: bytes) -> str | None:
    """Numbers of 8 to 15 digits, however they are parted. Of +1 numbers and those written without a country, the last ten
    digits are permuted, so that both spellings stay linked; of others all but the first two."""
    digits = _digits(found)
    if not 8 <= len(digits) <= 15:
        return None
    national = digits[-10:] if len(digits) == 10 or (len(digits) == 11 and digits[0] == "1") else digits[2:]
    head = digits[: len(digits) - len(national)]
    scope = "1" if len(national) == 10 and head in ("", "1") else head
    other = str(permute(int(national), 10 ** len(national), key, f"phone:{scope}:{len(national)}")).zfill(len(national))
    return _fill(found, head + other)


def _card(found: str, key: bytes) -> str | None:
    """Payment-card numbers: 13 to 19 digits that pass the Luhn test get others that pass. Other numbers stay."""
    digits = _digits(found)
    payload = digits[:-1]
    if digits[-1] != luhn_digit(payload):
        return None
    other = str(permute(int(payload), 10 ** len(payload), key, f"card:{len(payload)}")).zfill(len(payload))
    return _fill(found, other + luhn_digit(other))


def _iban(found: str, key: bytes) -> str | None:
    compact = found.replace(" ", "").upper()
    if not 15 <= len(compact) <= 34 or _mod97(compact[4:] + compact[:4]) != 1:
        return None
    body = compact[4:]
    digits = _digits(body)
    body = _fill(body, str(permute(int(digits), 10 ** len(digits), key, f"iban:{compact[:2]}{len(body)}")).zfill(len(digits)))
    check = str(98 - _mod97(body + compact[:2] + "00")).zfill(2)
    rest = iter(compact[:2] + check + body)
    return "".join(c if c == " " else next(rest) for c in found)


def _address(found: str, key: bytes) -> str | None:
    parts = [int(x) for x in found.split(".")]
    if max(parts) > 255:
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _address6(found: str, key: bytes) -> str:
    """IPv6 addresses written with all eight groups."""
    value = permute(int("".join(g.zfill(4) for g in found.split(":")), 16), 1 << 128, key, "ipv6")
    return ":".join(f"{value:032x}"[i : i + 4] for i in range(0, 32, 4))


_FIRST = datetime.date(1900, 1, 1)
_DAYS = (datetime.date(2100, 1, 1) - _FIRST).days


def _date(order: str) -> Callable[[str, bytes], str | None]:
    """Dates of 1900 to 2099 written with two-digit months and days, permuted among themselves; others stay."""

    def swap(found: str, key: bytes) -> str | None:
        mark = next(c for c in found if not c.isdigit())
        fields = dict(zip(order, found.split(mark), strict=True))
        try:
            day = datetime.date(int(fields["y"]), int(fields["m"]), int(fields["d"]))
        except ValueError:
            return None
        if not 0 <= (day - _FIRST).days < _DAYS:
            return None
        other = _FIRST + datetime.timedelta(permute((day - _FIRST).days, _DAYS, key, "date"))
        return mark.join({"y": f"{other.year:04}", "m": f"{other.month:02}", "d": f"{other.day:02}"}[c] for c in order)

    return swap


def _email(found: str, key: bytes) -> str:
    """Letters and digits of the local part and of the domain before its last label, permuted in place: each run of letters
    or digits of up to 12 as a number of its alphabet. Addresses that differ in case alone stay so."""
    local, _, domain = found.partition("@")
    name, dot, top = domain.rpartition(".")

    def other(run: re.Match) -> str:
        text = run[0]
        base = 10 if text.isdigit() else 26
        lower = text.lower()
        value = 0
        for c in lower:
            value = value * base + (int(c) if base == 10 else ord(c) - 97)
        value = permute(value, base ** len(text), key, f"email:{base}:{len(text)}")
        out = ""
        for c in reversed(text):
            value, d = divmod(value, base)
            letter = str(d) if base == 10 else chr(97 + d)
            out = (letter.upper() if c.isupper() else letter) + out
        return out

    return re.sub(r"[A-Za-z]{1,12}|[0-9]{1,12}", other, local) + "@" + re.sub(r"[A-Za-z]{1,12}|[0-9]{1,12}", other, name) + dot + top


def _ssn(found: str, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in found.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    value = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(permute(value, len(areas) * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(value, 99)
    return f"{areas[area]:03}-{group + 1:02}-{serial + 1:04}"


def _secret(found: str, key: bytes) -> str:
    """Hexadecimal tokens, case by letter kept, each run of up to 32 digits as a number."""

    def other(run: re.Match) -> str:
        text = run[0]
        digits = f"{permute(int(text, 16), 16 ** len(text), key, f'hex:{len(text)}'):0{len(text)}x}"
        return digits.upper() if text.upper() == text else digits

    return re.sub(r"[0-9A-Fa-f]{1,32}", other, found)


#: Kind, pattern, and what turns a match into its pseudonym (or None: not valid, it stays). Earlier kinds win.
KINDS: list[tuple[str, str, Callable[[str, bytes], str | None]]] = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", _email),
    ("secret", r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[A-Fa-f])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])", _secret),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", _iban),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3} ?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])", _phone),
    ("phone", r"(?<![0-9A-Za-z(])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])", _phone),
    ("date", r"(?<![0-9A-Za-z.-])[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}(?![0-9A-Za-z-])", _date("ymd")),
    ("date", r"(?<![0-9A-Za-z.-])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z-])", _date("dmy")),
    ("date", r"(?<![0-9A-Za-z.-])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z-])", _date("mdy")),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", _ssn),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])", _address),
    ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])", _address6),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])", _card),
]
NAMES = list(dict.fromkeys(name for name, _, _ in KINDS))
_MAY = re.compile(r"[0-9@]")


def _compiled() -> list[tuple[str, re.Pattern, Callable[[str, bytes], str | None]]]:
    return [(name, re.compile(pattern), swap) for name, pattern, swap in KINDS]


@lru_cache(1)
def _patterns():
    return _compiled()


@lru_cache(100_000)
def _pseudonym(at: int, found: str, key: bytes) -> str | None:
    return _patterns()[at][2](found, key)


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int, str, str]]]:
    """The text with every value found replaced, and (kind, begin, end, found, pseudonym) in order, offsets in the input."""
    if not _MAY.search(text):
        return text, []
    spans: list[tuple[str, int, int, str, str]] = []
    taken = bytearray(len(text))
    for at, (name, pattern, _) in enumerate(_patterns()):
        for m in pattern.finditer(text):
            if taken.find(1, m.start(), m.end()) >= 0:
                continue
            other = _pseudonym(at, m[0], key)
            if other is not None:
                spans.append((name, m.start(), m.end(), m[0], other))
                taken[m.start() : m.end()] = bytes((1,)) * (m.end() - m.start())
    spans.sort(key=lambda x: x[1])
    out, last = [], 0
    for _, begin, end, _, other in spans:
        out += [text[last:begin], other]
        last = end
    return "".join([*out, text[last:]]), spans


def pseudonymise_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text with personal numbers, dates, addresses and secrets replaced by keyed pseudonyms.

    Returns (id, text, n_found, kinds map<string,int>, spans array<struct<kind, begin, end, pseudonym>>); the values found
    are not returned. Each value is permuted by a Feistel network within its own format, so it stays valid (check digits,
    calendar, ranges) and equal values get equal pseudonyms in all documents, with no table of values kept anywhere.
    Offsets count characters of the input. Null text stays null with nothing found; repeated rows are treated alike; an
    empty table gives an empty result. Other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                out, spans = (None, []) if text is None else pseudonymise(text, key)
                count: dict[str, int] = {}
                for s in spans:
                    count[s[0]] = count.get(s[0], 0) + 1
                rows.append((doc, out, len(spans), count, [{"kind": k, "begin": b, "end": e, "pseudonym": o} for k, b, e, _, o in spans]))
            yield pd.DataFrame(rows, columns=["id", "text", "n_found", "kinds", "spans"])

    schema = f"id {kind}, text string, n_found int, kinds map<string,int>, spans array<struct<kind:string,begin:int,end:int,pseudonym:string>>"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
    return out.withColumnRenamed("id", id_col)


def op5_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise_documents(read(spark, sf_dir, "documents"), b"quillspark test key").select("doc_id", "text", "n_found", "kinds", "spans")
