"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their kind's check are replaced by other valid ones
of the same kind and format.  A keyed Feistel network permutes the kind's value
space, so equal values get equal pseudonyms in every document, different ones
different ones, and whoever holds the key can undo it.  Separators, brackets
and the number of digits stay; undoing a date written without leading zeros may
add them.

Kinds: payment cards (Luhn), IBAN (mod 97), phone numbers (of North America, and
international ones of their country's length), social security numbers, IPv4
addresses, calendar dates; the letters and digits of an e-mail address's local
part; and access keys, tokens and passwords of any length that stand behind their
usual names, in whatever case and quotes; below 16 characters they must hold
letters and digits.  What fails its check stays as it is.

Not replaced: letters beyond ASCII in an e-mail address, IPv6 addresses, social
security and North American phone numbers written without separators, phone
numbers of countries whose calling code is not in ``PHONE_LENGTHS``, and
passwords with other punctuation than ``+/_-``.

A date has one pseudonym, in whatever form it is written.  Days up to the 12th
stay such days, and later ones later ones: that tells a month from a day where
the month stands first, so the form can be read again.  Day and month that
could stand either way count as day first.

Cards and IBANs may stand among other groups of digits or capitals (an expiry
date, a security code, a short word).  A number is whole groups of what its
pattern matched: a card first of all in a usual grouping, an IBAN of its
country's length.  If there is none, the search goes on behind the first group.
Digits that are written onto a number without a break make another number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 8
#: Values whose pseudonyms a worker remembers.
REMEMBERED = 100_000
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PATTERN = re.compile(
    r"""
      (?<![\w.%+-]) (?P<email> [\w.%+-]+ (?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2}) )
    | \b (?P<iban> [A-Z]{2}[0-9]{2} (?:[ ]?[A-Z0-9]{4}){2,7} (?:[ ]?[A-Z0-9]{1,3})? ) \b
    | \b (?P<key> (?:AKIA|ASIA)[0-9A-Z]{16} ) \b
    | (?<![A-Za-z0-9]) (?i:password|passwd|secret|token|api[_-]?key) ["']?\s?[=:]\s?["']? (?P<secret> [A-Za-z0-9+/_-]{8,} ) (?![\w+/-])
    | (?<![\w.-]) (?P<date> [0-9]{4}-[0-9]{2}-[0-9]{2} | [0-9]{1,2}(?P<dot>[./-])[0-9]{1,2}(?P=dot)[0-9]{4} ) (?: (?=T[0-9]{2}:) | (?![\w-]|[.][0-9]) )
    | (?<![\w.]) (?P<ip> (?:[0-9]{1,3}\.){3}[0-9]{1,3} ) (?!\w|\.[0-9])
    | (?<![\w-]) (?P<ssn> [0-9]{3}-[0-9]{2}-[0-9]{4} ) (?![\w-])
    | (?<![\w.+-]) (?P<phone> (?:\+1[ .-]?)? (?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-]) [0-9]{3}[ .-][0-9]{4} | \+[2-9][0-9]{0,2}(?:[ .-]?[0-9]){7,11} ) (?!\w)
    | (?<![\w.-]) (?P<card> [0-9](?:[ -]?[0-9]){12,18} ) (?![\w-])
    """,
    re.VERBOSE,
)
KINDS = ["email", "iban", "key", "secret", "date", "ip", "ssn", "phone", "card"]
#: Sizes of a card's groups as they are usually written; a number without breaks is one too.
GROUPED = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
#: Characters of an IBAN by country.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22
    GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24
    PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()}
#: Least and most digits behind a country's calling code.
PHONE_LENGTHS = {
    "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11),
    "40": (9, 9), "41": (9, 9), "43": (7, 13), "44": (9, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (7, 12), "51": (8, 9),
    "52": (10, 10), "53": (8, 8), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (10, 10), "58": (10, 10), "60": (8, 10), "61": (9, 9), "62": (8, 12),
    "63": (9, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 11), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10),
    "92": (9, 10), "93": (9, 9), "94": (9, 9), "95": (7, 10), "98": (10, 10), "212": (9, 9), "213": (8, 9), "216": (8, 8), "233": (9, 9), "234": (8, 10),
    "254": (9, 9), "351": (9, 9), "352": (8, 9), "353": (7, 9), "354": (7, 7), "358": (7, 11), "359": (8, 9), "370": (8, 8), "371": (8, 8), "372": (7, 8),
    "380": (9, 9), "381": (8, 9), "385": (8, 9), "386": (8, 8), "420": (9, 9), "421": (9, 9), "852": (8, 8), "886": (8, 9), "966": (9, 9), "971": (8, 9), "972": (8, 9),
}
#: Characters behind a number that decide what its pattern can match.
AHEAD = 80
#: A text without any of these holds nothing to replace.
TRIGGER = re.compile(r"[0-9@]")


def permuted(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network on the next even number of bits, walked until it lands inside."""
    if size < 2:
        return value
    half = (max(size - 1, 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    width = (half + 7) // 8

    def scrambled(i: int, x: int) -> int:
        data = f"{tweak}|{size}|{i}|".encode() + x.to_bytes(width, "big")
        return int.from_bytes(hashlib.blake2b(data, digest_size=min(max(width, 8), 64), key=key).digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ scrambled(i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ scrambled(i, right)
        value = left << half | right
        if value < size:
            return value


def _only(text: str, alphabet: str) -> str:
    return "".join(c for c in text if c in alphabet)


def _refill(form: str, chars: str, alphabet: str) -> str:
    """``form`` with its characters of the alphabet replaced by ``chars`` in turn."""
    rest = iter(chars)
    return "".join(next(rest) if c in alphabet else c for c in form)


def _spelled(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Digits, small and capital letters permuted together, each within its own alphabet."""
    value, size = 0, 1
    bases = [next((a for a in (DIGITS, LOWER, UPPER) if c in a), "") for c in text]
    for c, a in zip(text, bases):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    value = permuted(value, size, key, tweak, back)
    out = []
    for c, a in zip(reversed(text), reversed(bases)):
        if a:
            value, k = divmod(value, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


def _in_alphabet(text: str, alphabet: str, key: bytes, tweak: str, back: bool) -> str:
    value = 0
    for c in text:
        value = value * len(alphabet) + alphabet.index(c)
    value = permuted(value, len(alphabet) ** len(text), key, tweak, back)
    out = []
    for _ in text:
        value, k = divmod(value, len(alphabet))
        out.append(alphabet[k])
    return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    """The digit that makes ``digits`` followed by it pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _is_card(d: str) -> bool:
    return luhn_digit(d[:-1]) == d[-1] and len(set(d)) > 1


def _card_in(text: str) -> tuple[int, int] | None:
    """The card among the groups of ``text``: the first in a usual grouping, else the longest from its begin."""
    groups = [m.span() for m in re.finditer("[0-9]+", text)]
    odd = None
    for i, (a, _) in enumerate(groups):
        for j in range(i, len(groups)):
            b = groups[j][1]
            d = _only(text[a:b], DIGITS)
            if not 13 <= len(d) <= 19 or not _is_card(d):
                continue
            if i == j or tuple(q - p for p, q in groups[i : j + 1]) in GROUPED:
                return a, b
            if i == 0:
                odd = a, b
    return odd


def _card(text: str, key: bytes, back: bool) -> str | None:
    d = _only(text, DIGITS)
    if not _is_card(d):
        return None
    while True:  # numbers of one repeated digit are no cards: walk on
        body = _in_alphabet(d[:-1], DIGITS, key, f"card{len(d)}", back)
        d = body + luhn_digit(body)
        if len(set(d)) > 1:
            return _refill(text, d, DIGITS)


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban_in(text: str) -> tuple[int, int] | None:
    """The IBAN that ``text`` begins with: of its country's length, else the longest of whole groups."""
    ends = [m.end() for m in re.finditer(r"\S+", text)]
    length = lambda b: b - text.count(" ", 0, b)
    for b in sorted(ends, key=lambda b: (length(b) != IBAN_LENGTHS.get(text[:2]), -b)):
        plain = text[:b].replace(" ", "")
        if 15 <= len(plain) <= 34 and _iban_check(plain[:2], plain[4:]) == plain[2:4]:
            return 0, b
    return None


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, rest) != check:
        return None
    rest = _spelled(rest, key, f"iban{country}", back)
    return _refill(text, country + _iban_check(country, rest) + rest, DIGITS + UPPER)


def _phone(text: str, key: bytes, back: bool) -> str | None:
    d = _only(text, DIGITS)
    if text.startswith("+") and d[0] != "1":
        code = next((d[:n] for n in (3, 2, 1) if d[:n] in PHONE_LENGTHS), None)
        if code is None or not PHONE_LENGTHS[code][0] <= len(d) - len(code) <= PHONE_LENGTHS[code][1]:
            return None
        head, number, tweak = code, d[len(code) :], f"phone{code}"
        fits = lambda n: n[0] != "0" or code == "39"  # noqa: E731  in Italy a nought belongs to the number
    else:
        head, number, tweak = d[:-10], d[-10:], "phone1"
        fits = lambda n: n[0] >= "2" and n[3] >= "2"
    if not fits(number):
        return None
    while True:
        number = _in_alphabet(number, DIGITS, key, tweak, back)
        if fits(number):
            return _refill(text, head + number, DIGITS)


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    d = _only(text, DIGITS)
    fits = lambda n: n[:3] not in ("000", "666") and n[0] != "9" and n[3:5] != "00" and n[5:] != "0000"
    if not fits(d):
        return None
    while True:
        d = _in_alphabet(d, DIGITS, key, "ssn", back)
        if fits(d):
            return _refill(text, d, DIGITS)


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (p[0] == "0" and len(p) > 1) for p in parts):
        return None
    value = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(text: str, key: bytes, back: bool) -> str | None:
    """The month stands first where the second number can't be a month; widths follow the form, a leading zero where there was one."""
    parts = re.split(r"[./-]", text)
    iso = len(parts[0]) == 4
    order = (0, 1, 2) if iso else (2, 1, 0) if int(parts[1]) <= 12 else (2, 0, 1)
    try:
        old = date(*(int(parts[i]) for i in order))
    except ValueError:
        return None
    day = old.toordinal()
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    padded = iso or all(len(p) > 1 for p in parts)
    while True:
        day = permuted(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", back) + FIRST_DAY
        d = date.fromordinal(day)
        if (d.day > 12) == (old.day > 12):
            break
    new = [""] * 3
    for i, v in zip(order, (d.year, d.month, d.day)):
        new[i] = f"{v:0{len(parts[i])}d}" if len(parts[i]) == 4 or padded else str(v)
    marks = re.findall(r"[./-]", text)
    return new[0] + marks[0] + new[1] + marks[1] + new[2]


def _secret(text: str, key: bytes, back: bool) -> str | None:
    """Hexadecimal digits stay such from 16 on; of other secrets each character stays in its alphabet.  Words alone are no secrets."""
    hexadecimal = lambda t: len(t) >= 16 and all(c in DIGITS + "abcdef" for c in t)
    if hexadecimal(text):
        return _in_alphabet(text, DIGITS + "abcdef", key, f"secret{len(text)}", back)
    if not (any(c in DIGITS for c in text) and any(c in LOWER + UPPER for c in text)):
        return None
    while True:
        text = _spelled(text, key, f"secret{len(text)}", back)
        if not hexadecimal(text):
            return text


HOW: dict[str, Callable[[str, bytes, bool], str | None]] = {
    "email": lambda t, key, back: _spelled(t, key, "email", back),
    "key": lambda t, key, back: t[:4] + _in_alphabet(t[4:], DIGITS + UPPER, key, "key", back),
    "secret": _secret,
    "iban": _iban,
    "date": _date,
    "ip": _ip,
    "ssn": _ssn,
    "phone": _phone,
    "card": _card,
}


#: Where the number of a kind lies in what its pattern matched.
WITHIN = {"card": _card_in, "iban": _iban_in}


def _next(text: str, at: int, key: bytes, known: dict[tuple[str, str], str | None], back: bool) -> tuple[str, int, int, int | None] | None:
    """The next value from ``at`` on, as (kind, begin, end, where), or None.

    where: the begin of the first number that failed and overlaps the value; the
    value's own begin if the number ends before its pattern's match does.
    """
    failed: list[tuple[int, int]] = []
    while m := PATTERN.search(text, at):
        kind = next(k for k in KINDS if m[k] is not None)
        i, j = m.span(kind)
        if kind in WITHIN:
            found = WITHIN[kind](m[kind])
            if found is None:
                failed.append((i, j))
                at = i + re.match("[0-9]+" if kind == "card" else ".{4}", m[kind]).end()
                continue
            a, b = i + found[0], i + found[1]
            where = next((p for p, q in failed if q > a), i if (a, b) != (i, j) else None)
            return kind, a, b, where
        if _new(kind, m[kind], key, known, back) is not None:
            return kind, i, j, next((p for p, q in failed if q > i), None)
        at = m.end()
    return None


def _new(kind: str, value: str, key: bytes, known: dict[tuple[str, str], str | None], back: bool) -> str | None:
    if (kind, value) not in known:
        if len(known) >= REMEMBERED:
            known.clear()
        known[kind, value] = HOW[kind](value, key, back)
    return known[kind, value]


def replaced(text: str, key: bytes, known: dict[tuple[str, str], str | None], back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind; ``back`` undoes it."""
    found = dict.fromkeys(KINDS, 0)
    if not TRIGGER.search(text):
        return text, found

    out, last = [], 0
    while hit := _next(text, last, key, known, back):
        kind, a, b, where = hit
        new = _new(kind, text[a:b], key, known, back)
        if where is not None:  # walk on to a pseudonym that is found in the same place, or it couldn't be undone

            def same(value: str, kind=kind, a=a, b=b, where=where) -> bool:
                again = _next(text[where:a] + value + text[b : b + AHEAD], 0, key, known, back)
                return again is not None and again[:3] == (kind, a - where, a - where + len(value))

            while same(text[a:b]) and not same(new):
                new = HOW[kind](new, key, back)
        out += [text[last:a], new]
        last = b
        found[kind] += 1
    return "".join([*out, text[last:]]), found


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text", keep: list[str] | None = None, back: bool = False) -> DataFrame:
    """``docs`` with the text's pseudonyms in place, and n_<kind> for each kind of ``KINDS``.

    A null text stays null, with no finds.  ``back`` recovers the originals.
    A key may have any length.  Repeated rows get equal texts; an empty table
    gives an empty result.  A text is worked on whole, and takes a few times
    its size.  keep: the other columns to return; none may be named like a new
    one.
    """
    key = hashlib.sha256(key).digest()
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    new = [text_col, *(f"n_{k}" for k in KINDS)]
    if clash := set(new) & set(keep):
        raise ValueError(f"rename the columns {sorted(clash)} first")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(text_col, T.StringType())] + [T.StructField(c, T.IntegerType()) for c in new[1:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], str | None] = {}
        for batch in batches:
            texts, counts = [], {k: [] for k in KINDS}
            for t in batch.column(text_col):
                text, found = (None, {}) if not t.is_valid else replaced(t.as_py(), key, known, back)
                texts.append(text)
                for k in KINDS:
                    counts[k].append(found.get(k, 0))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string()), *[pa.array(counts[k], pa.int32()) for k in KINDS]], names=[*keep, *new])

    return docs.select(*{f"`{c}`": 0 for c in [*keep, text_col]}).mapInArrow(work, schema)
