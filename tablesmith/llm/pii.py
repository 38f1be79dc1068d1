"""PII: format-preserving Feistel pseudonyms.

Validated numbers (payment cards by Luhn, IBANs by mod 97, IPv4 addresses, phone
and social security numbers), calendar dates and mail addresses are replaced by
keyed permutations within their own format: a valid card becomes another valid
card with the same separators, a date another date in the same notation. Equal
values get equal pseudonyms in every document, so they stay linked; with the key
`restored` turns them back. A value's digits and letters form one number below
the size of its format. A balanced Feistel network over that many bits, walked
until it falls within the size, gives an order of all such numbers; the value
moves on in that order by a keyed distance. So no value is its own pseudonym.
What the scan would not find again as a value of the same kind is walked over in
the same way: pseudonyms pass their own check and can be turned back.

Defined cases: a null text stays null with no finding; an empty text stays
empty; a null doc_id is a row like any; what looks like a number but fails its
check stays, and so do addresses whose name has neither letters nor digits (they
are not counted); dates outside FIRST_DAY to LAST_DAY stay; a date that can be
read day first is read so, and one that can't stays one that can't; a text of any
length is scanned whole, in one worker; repeated rows get the same text; an empty
table gives no row; other columns are ignored."""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import documents, workers

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
#: For the registered query; production jobs pass their own secret.
DEMO_KEY = b"tablesmith demonstration key"
KINDS = ("email", "iban", "card", "phone", "ip", "date", "ssn")

#: Lengths of the IBANs of each country.
IBAN_LENGTHS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}
#: Country codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: A further digit of a phone number, with what may stand before it.
_DIGIT = r"(?:[)]?(?:[ \u00a0\u202f]?[./\-\u2011][ \u00a0\u202f]?|[ \u00a0\u202f])?[(]?[0-9])"

# Where a country fixes the length, that comes before the general shape, so that a number that follows stays outside.
_PATTERN = re.compile(
    rf"""
    (?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}})
  | (?<![A-Za-z0-9])(?P<iban>[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])
  | (?<![A-Za-z0-9])(?P<card>[0-9]{{13,19}}|[0-9]{{4}}(?P<gap>[ -])[0-9]{{4}}(?P=gap)[0-9]{{4}}(?P=gap)[0-9]{{1,7}}|[0-9]{{4}}(?P<gap2>[ -])[0-9]{{6}}(?P=gap2)[0-9]{{5}})(?![A-Za-z0-9])
  | (?<![A-Za-z0-9])(?P<phone>\+1{_DIGIT}{{10}}(?![A-Za-z0-9])|\+3[34]{_DIGIT}{{9}}(?![A-Za-z0-9])|\+[1-9]{_DIGIT}{{6,14}}|(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{3}}\)[ ]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}})(?![A-Za-z0-9])
  | (?<![A-Za-z0-9.])(?P<ip>[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}})(?![A-Za-z0-9]|\.[0-9])
  | (?<![A-Za-z0-9])(?P<date>[0-9]{{4}}[-/.][0-9]{{2}}[-/.][0-9]{{2}}|[0-9]{{2}}[-/.][0-9]{{2}}[-/.][0-9]{{4}})(?![A-Za-z0-9])
  | (?<![A-Za-z0-9])(?P<ssn>[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})(?![A-Za-z0-9])
  | (?<![A-Za-z0-9])(?<![0-9][.,:/-])(?P<trunk>0[1-9](?:[ .\-\u00a0\u202f][0-9]{{2}}){{4}}(?![A-Za-z0-9])|00[ ]?[1-9]{_DIGIT}{{6,14}}|(?:\((?=[0-9]+\)))?0[1-9](?![0-9]{{6}}(?![0-9])){_DIGIT}{{6,12}}|[2-9][0-9]{{2}}[2-9][0-9]{{6}})(?![A-Za-z0-9]|[.,:][0-9])
    """,
    re.VERBOSE,
)
_ABROAD = re.compile(rf"00[ ]?[1-9]{_DIGIT}{{6,14}}(?![A-Za-z0-9])")
_MAY_HOLD = re.compile("[0-9@]")
_WORD = re.compile("[(]?[A-Z0-9]+")


def _feistel(value: int, size: int, kind: str, key: bytes, back: bool = False) -> int:
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right, left
            message = f"{kind}:{size}:{i}:{right}".encode()
            mark = int.from_bytes(hashlib.blake2b(message, digest_size=16, key=key[:64]).digest()) & mask
            left, right = (left ^ mark, right) if back else (right, left ^ mark)
        value = (left << half) | right
        if value < size:
            return value


def permute(value: int, size: int, kind: str, key: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size) without fixed points (size 2 or more), another one for each kind; back: its inverse."""
    if size < 2:
        return value
    far = 1 + int.from_bytes(hashlib.blake2b(f"{kind}:{size}".encode(), digest_size=16, key=key[:64]).digest()) % (size - 1)
    place = _feistel(value, size, kind, key) + (-far if back else far)
    return _feistel(place % size, size, kind, key, back=True)


def _mixed(digits: list[int], sizes: list[int], kind: str, key: bytes, back: bool) -> list[int]:
    """Permutes digits of which each has its own base."""
    value, size = 0, 1
    for d, s in zip(digits, sizes, strict=True):
        value, size = value * s + d, size * s
    value = permute(value, size, kind, key, back)
    out = []
    for s in reversed(sizes):
        value, d = divmod(value, s)
        out.append(d)
    return out[::-1]


def _put(shape: str, signs: list[str]) -> str:
    """The letters and digits of shape replaced by signs, the rest kept."""
    it = iter(signs)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _check_digit(body: list[int]) -> int:
    total = 0
    for i, d in enumerate(reversed(body)):
        d = d * 2 if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


def _signs(text: str, kind: str, key: bytes, back: bool) -> str:
    """Each digit to a digit, each letter to a letter of the same case."""
    bases = {"d": ("0", 10), "u": ("A", 26), "l": ("a", 26)}
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in text if c.isalnum()]
    digits = [ord(c) - ord(bases[k][0]) for c, k in zip((c for c in text if c.isalnum()), kinds, strict=True)]
    new = _mixed(digits, [bases[k][1] for k in kinds], kind, key, back)
    return _put(text, [chr(ord(bases[k][0]) + d) for d, k in zip(new, kinds, strict=True)])


# -- checks ------------------------------------------------------------------


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _iban_valid(text: str) -> bool:
    flat = text.replace(" ", "")
    return len(flat) <= 34 and _iban_number(flat[4:] + flat[:4]) % 97 == 1


def _card_valid(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    return _check_digit(digits[:-1]) == digits[-1]


def _day(text: str) -> tuple[str, datetime.date] | None:
    """Notation and day of a date; day first where both ways are possible."""
    parts = re.findall("[0-9]+", text)
    for order in ("%Y%m%d",) if len(parts[0]) == 4 else ("%d%m%Y", "%m%d%Y"):
        try:
            day = datetime.datetime.strptime("".join(parts), order).date()  # noqa: DTZ007
        except ValueError:
            continue
        return (order, day) if FIRST_DAY <= day <= LAST_DAY else None
    return None


def _ssn_valid(text: str) -> bool:
    return not (text[:3] in ("000", "666") or text[0] == "9" or text[4:6] == "00" or text[7:] == "0000")


_VALID = {
    "email": lambda t: any(c.isalnum() for c in t.partition("@")[0]),
    "iban": _iban_valid,
    "card": _card_valid,
    "phone": lambda t: True,
    "ip": lambda t: max(map(int, t.split("."))) < 256,
    "date": lambda t: _day(t) is not None,
    "ssn": _ssn_valid,
}


# -- permutations within a format --------------------------------------------


def _email(text: str, key: bytes, back: bool) -> str:
    name, _, host = text.partition("@")
    return f"{_signs(name, f'email@{host.lower()}', key, back)}@{host}"


def _iban(text: str, key: bytes, back: bool) -> str:
    flat = text.replace(" ", "")
    body = _signs(flat[4:], f"iban{flat[:2]}", key, back)
    return _put(text, list(f"{flat[:2]}{98 - _iban_number(body + flat[:2] + '00') % 97:02d}{body}"))


def _card(text: str, key: bytes, back: bool) -> str:
    digits = [int(c) for c in text if c.isdigit()]
    body = _mixed(digits[:-1], [10] * (len(digits) - 1), f"card{len(digits)}", key, back)
    return _put(text, [str(d) for d in [*body, _check_digit(body)]])


def _country(text: str) -> str:
    """The sign and code of a country at the start of a phone number."""
    m = re.match(r"(\+|00[ ]?)(?=[1-9])", text)
    if not m:
        return ""
    digits = [i for i, c in enumerate(text) if c.isdigit() and i >= m.end()]
    first = "".join(text[i] for i in digits[:2])
    return text[: digits[0 if first[0] in "17" else 1 if first in _TWO_DIGITS else 2] + 1]


def _phone(text: str, key: bytes, back: bool) -> str:
    """Country code, leading zeros and grouping stay; the first digit after them stays above 0, that of North American parts above 1."""
    country = _country(text)
    digits = [int(c) for c in text[len(country) :] if c.isdigit()]
    zeros = next((i for i, d in enumerate(digits) if d), len(digits))
    if len(digits) == 10 and not zeros and country in ("", "+1", "001", "00 1"):
        low = [2 if i in (0, 3) and digits[0] > 1 and digits[3] > 1 else 0 for i in range(len(digits))]
    else:
        low = [1 if i == zeros else 0 for i in range(len(digits))]
    sizes = [1 if i < zeros else 10 - a for i, a in enumerate(low)]
    new = _mixed([d - a for d, a in zip(digits, low, strict=True)], sizes, f"phone{low[0]}", key, back)
    return country + _put(text[len(country) :], [str(d + a) for d, a in zip(new, low, strict=True)])


def _ip(text: str, key: bytes, back: bool) -> str:
    return ".".join(map(str, _mixed([int(x) for x in text.split(".")], [256] * 4, "ip", key, back)))


def _date(text: str, key: bytes, back: bool) -> str:
    order, day = _day(text)
    first, size = FIRST_DAY.toordinal(), LAST_DAY.toordinal() - FIRST_DAY.toordinal() + 1
    while True:
        day = datetime.date.fromordinal(first + permute(day.toordinal() - first, size, "date", key, back))
        new = _put(text, list(day.strftime(order)))
        if _day(new) == (order, day):  # else it would be read the other way round
            return new


def _ssn(text: str, key: bytes, back: bool) -> str:
    return _signs(text, "ssn", key, back)


_NEW = {"email": _email, "iban": _iban, "card": _card, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn}


@functools.lru_cache(100_000)
def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str:
    """The pseudonym of a valid value, or the value of a pseudonym."""
    new = _NEW[kind](text, key, back)
    while new != text and _alone(new) != kind:
        new = _NEW[kind](new, key, back)
    return new


def _alone(text: str) -> str | None:
    """The kind of a text that is one value as a whole."""
    m = _PATTERN.match(text)
    kind, value = _found(m) if m else (None, "")
    return kind if value == text else None


# -- scan --------------------------------------------------------------------


def replaced(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms (or, back, with the values they stand for), and the number of values of each kind."""
    counts = dict.fromkeys(KINDS, 0)
    if not _MAY_HOLD.search(text):
        return text, counts

    out, done, at, barred = [], 0, 0, 0
    while m := _PATTERN.search(text, at):
        kind, value = _found(m)
        inside = m.lastgroup == "trunk" and m.start() < barred
        if kind is None or inside:
            # what follows the first word of no IBAN may be a value by itself, but its groups are no national numbers
            barred = m.end() if m.lastgroup == "iban" else barred
            at = _WORD.match(text, m.start()).end() if m.lastgroup == "iban" or inside else m.end()
            continue
        new = pseudonym(kind, value, key, back)
        counts[kind] += new != value
        out += [text[done : m.start()], new]
        done = at = m.start() + len(value)
    return "".join([*out, text[done:]]), counts


def restored(text: str, key: bytes) -> str:
    """The text that `replaced` was given."""
    return replaced(text, key, back=True)[0]


def _found(m: re.Match) -> tuple[str | None, str]:
    """Kind and value of a match; shorter ends and other kinds are tried before it is given up."""
    kind = m.lastgroup if m.lastgroup in KINDS else "phone" if m.lastgroup == "trunk" else "card"  # the last group closed may be a separator
    text = m.group()
    for value in _iban_ends(text) if kind == "iban" else (text,):
        if _VALID[kind](value):
            return kind, value
    if kind == "card" and (abroad := _ABROAD.match(m.string, m.start())):
        return "phone", abroad.group()
    return None, text


def _iban_ends(text: str) -> list[str]:
    """What an IBAN may be in a match that runs on into the next words: the country's length, all, then ever fewer words."""
    ends = [i for i in range(len(text), 0, -1) if text[i - 1] != " " and text[i : i + 1] in ("", " ")]
    size = {i: i - text.count(" ", 0, i) for i in ends}
    fixed = [i for i in ends if size[i] == IBAN_LENGTHS.get(text[:2])]
    return [text[:i] for i in [*fixed, *(i for i in ends if i not in fixed and (i == len(text) or size[i] >= min(IBAN_LENGTHS.values())))]]


def pseudonymized(docs: DataFrame, key: bytes) -> DataFrame:
    """One row for each document: doc_id, text with pseudonyms, n_<kind> for each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            done = [(t, {}) if t is None else replaced(t, key) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in done], pa.string()), *(pa.array([c.get(k, 0) for _, c in done], pa.int64()) for k in KINDS)], ["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    workers(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized(documents(spark, sf_dir), DEMO_KEY)
