"""Personal data replaced by pseudonyms of the same format.

A value is validated first (check digits, calendar, number plan), reduced to its place among all valid values of its
format, moved by a keyed permutation of those places, and written back in the form it was found in. The permutation
is a Feistel network with cycle walking, so it is a bijection: equal values get equal pseudonyms in every document,
different values different ones, and the key's holder can undo it. Rows are independent; nothing is shuffled.

Kinds: card (13 to 19 digits, Luhn), iban (mod 97), ssn (US areas), phone (international or North American form), ip
(v4), date (1900 to 2099: y-m-d, d.m.y, d/m/y or, where only that is a date, m/d/y), email (the part before the @)
and secret (hexadecimal credentials that are assigned to a name). Where groups follow that a form could also take, an IBAN
ends at its country's length and a phone at ten digits behind +1, else at 15 digits or before another value. A null text stays null. Values of other formats,
and numbers that fail their check, stay as they are.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.textio import carried, per_text

#: a production run passes its own key
DEFAULT_KEY = b"set your own key"
ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1
KINDS = ("email", "secret", "iban", "phone", "card", "ssn", "ip", "date")


class Feistel:
    """Keyed permutations of 0 .. n - 1, one for each tweak and n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, number: int, value: int, modulus: int) -> int:
        size = (modulus.bit_length() + 7) // 8 + 8
        data = hashlib.blake2b(tweak + bytes([number]) + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big"), key=self.key, digest_size=min(size, 64)).digest()
        while len(data) < size:
            data += hashlib.blake2b(data, key=self.key).digest()
        return int.from_bytes(data[:size], "big") % modulus

    def _walk(self, value: int, n: int, tweak: bytes, back: bool) -> int:
        if n <= 1:
            return value
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        tweak = tweak + n.to_bytes((n.bit_length() + 7) // 8, "big") + b"|"
        while True:
            left, right = divmod(value, b)  # left < a, right < b
            for number in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                sign = -1 if back else 1
                if number % 2:
                    right = (right + sign * self._round(tweak, number, left, b)) % b
                else:
                    left = (left + sign * self._round(tweak, number, right, a)) % a
            value = left * b + right
            if value < n:  # a * b is a little over n: walk on until inside
                return value

    def permute(self, value: int, n: int, tweak: bytes) -> int:
        return self._walk(value, n, tweak, False)

    def restore(self, value: int, n: int, tweak: bytes) -> int:
        return self._walk(value, n, tweak, True)


def luhn_digit(payload: str) -> int:
    """Check digit that follows the payload."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _refill(shape: str, chars: str, keep) -> str:
    """``shape`` with the characters that ``keep`` accepts replaced, in order, by ``chars``."""
    fresh = iter(chars)
    return "".join(next(fresh) if keep(c) else c for c in shape)


class Pseudonyms:
    """Finds values in a text and moves them; ``undo`` instead gives the originals back."""

    def __init__(self, key: bytes = DEFAULT_KEY, undo: bool = False):
        feistel = Feistel(key)
        self._move = feistel.restore if undo else feistel.permute
        self.memo: dict[tuple[str, str], str | None] = {}

    def _digits(self, digits: str, tweak: bytes) -> str:
        return str(self._move(int(digits), 10 ** len(digits), tweak)).zfill(len(digits))

    # every kind: the pseudonym, or None where the text is no valid value

    def email(self, m: str) -> str | None:
        local, _, host = m.partition("@")
        size, value, radix = 1, 0, []
        for c in local.lower():
            radix.append(26 if c.isalpha() else 10 if c.isdigit() else 1)
            value = value * radix[-1] + (ord(c) - 97 if c.isalpha() else int(c) if c.isdigit() else 0)
            size *= radix[-1]
        value = self._move(value, size, b"email" + bytes(min(r, 255) for r in radix) + host.lower().encode())
        out = []
        for c, r in zip(reversed(local), reversed(radix)):
            value, rest = divmod(value, r)
            out.append(c if r == 1 else chr(97 + rest).upper() if c.isupper() else chr(97 + rest) if r == 26 else str(rest))
        return "".join(reversed(out)) + "@" + host

    def secret(self, m: str) -> str | None:
        moved = f"{self._move(int(m, 16), 16 ** len(m), b'secret'):0{len(m)}x}"
        return moved.upper() if m.upper() == m else moved

    def iban(self, m: str) -> str | None:
        flat = re.sub(r"[ -]", "", m)
        if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
            return None
        country, account = flat[:2], flat[4:]
        letters = re.sub(r"\d", "", account)
        if digits := re.sub(r"\D", "", account):
            account = _refill(account, self._digits(digits, b"iban" + country.encode()), str.isdigit)
        if letters:
            value = 0
            for c in letters:
                value = value * 26 + ord(c) - 65
            value, out = self._move(value, 26 ** len(letters), b"iban letters" + country.encode()), ""
            for _ in letters:
                value, rest = divmod(value, 26)
                out = chr(65 + rest) + out
            account = _refill(account, out, str.isalpha)
        check = 98 - _mod97(account + country + "00")
        return _refill(m, f"{country}{check:02d}{account}", str.isalnum)

    def phone(self, m: str) -> str | None:
        digits = re.sub(r"\D", "", m)
        country = re.match(r"\+(\d{1,3})(?=\D)", m)
        if m[0] == "+" and not 8 <= len(digits) <= 15:
            return None
        code = country[1] if country else digits[:1] if m[0] == "+" else ""
        return _refill(m, code + self._digits(digits[len(code) :], b"phone"), str.isdigit)

    def card(self, m: str) -> str | None:
        digits = re.sub(r"\D", "", m)
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]):
            return None
        moved = self._digits(digits[:-1], b"card")
        return _refill(m, moved + str(luhn_digit(moved)), str.isdigit)

    def ssn(self, m: str) -> str | None:
        area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        place, serial = divmod(self._move(place, 898 * 99 * 9999, b"ssn"), 9999)
        area, group = divmod(place, 99)
        return f"{area + 1 + (area >= 665):03d}{m[3]}{group + 1:02d}{m[6]}{serial + 1:04d}"

    def ip(self, m: str) -> str | None:
        parts = [int(x) for x in m.split(".")]
        if max(parts) > 255:
            return None
        value = self._move(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, m: str) -> str | None:
        a, b, c = (int(x) for x in re.split(r"[-/.]", m))
        iso = m[:4].isdigit()
        orders = [(a, b, c)] if iso else [(c, b, a), (c, a, b)] if "/" in m else [(c, b, a)]
        for k, (y, month, d) in enumerate(orders):
            try:
                place = datetime.date(y, month, d).toordinal() - FIRST_DAY
            except ValueError:
                continue
            if not 0 <= place < DAYS:
                return None
            sep = m[4] if iso else re.search(r"[-/.]", m)[0]
            parts = m.split(sep)
            wide_month, wide_day = (len(parts[1 if iso or k == 0 else 0]), len(parts[2 if iso else 0 if k == 0 else 1]))
            # a pseudonym keeps the digits of each number, and must be read in the order it is written in, or undoing it would take another
            while True:
                place = self._move(place, DAYS, b"date")
                day = datetime.date.fromordinal(FIRST_DAY + place)
                if (iso or sep == "." or k == 0 or day.day > 12) and (wide_day == 2 or day.day < 10) and (wide_month == 2 or day.month < 10):
                    break
            month, number = f"{day.month:0{wide_month}d}", f"{day.day:0{wide_day}d}"
            return sep.join([str(day.year), month, number] if iso else [number, month, str(day.year)] if k == 0 else [month, number, str(day.year)])
        return None

    def _moved(self, kind: str, m: str) -> str | None:
        key = (kind, m)
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[key] = getattr(self, kind)(m)
        return self.memo[key]

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with its values moved, and their kinds and places (in the result, whose length may differ in ip)."""
        taken: list[tuple[int, int, str, str]] = []
        used = np.zeros(0, bool)
        for kind, ends in PASSES:
            if kind == "email" and "@" not in text:
                continue
            at = 0
            while m := PATTERNS[kind].search(text, at):
                a, at = m.start(1), m.end()
                for b in ends(text, *m.span(1)) if ends else (m.end(1),):
                    if len(used) and used[a:b].any():
                        at = a + 1  # the rest may be a value
                        continue
                    moved = self._moved(kind, text[a:b])
                    if moved is not None:
                        if not len(used):
                            used = np.zeros(len(text), bool)
                        used[a:b] = True
                        taken.append((a, b, kind, moved))
                        at = b if ends else m.end()
                        break
                else:
                    at = a + 1 if ends else at
        if not taken:
            return text, []
        out, spans, at, size = [], [], 0, 0
        for a, b, kind, moved in sorted(taken):
            out += [text[at:a], moved]
            size += a - at
            spans.append((kind, size, size + len(moved)))
            size, at = size + len(moved), b
        return "".join(out) + text[at:], spans


#: fixed values: forms of the values; group 1 is the value. Digits are ASCII.
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])([A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", re.ASCII),
    "secret": re.compile(r"(?:key|token|secret|password|passwd|pwd)\s*[=:]\s*[\"']?([0-9a-f]{16,128}|[0-9A-F]{16,128})(?![0-9A-Za-z])", re.ASCII),
    "iban": re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,4})?)(?![A-Za-z0-9])"),
    "phone": re.compile(r"(?<![\w+])(\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])", re.ASCII),
    "card": re.compile(r"(?<![0-9])([0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])([0-9]{3}[- ][0-9]{2}[- ][0-9]{4})(?![0-9-])"),
    "ip": re.compile(r"(?<![0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]|\.[0-9])"),
    "date": re.compile(r"(?<![0-9./-])((?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}|(?:19|20)[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2})(?![0-9/-]|\.[0-9])"),
}
#: characters of an IBAN by country, as registered
IBAN_LENGTH = {
    country: int(n)
    for n, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FO,FI,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,XK,LT,LU,MN 21:HR,LV,LI,CH 22:BH,BG,CR,GE,DE,IE,ME,RS,GB,VA 23:TL,GI,IQ,IL,AE,OM,SO "
        "24:AD,CZ,MD,PK,RO,SA,SK,ES,SE,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MR,MC,SM 28:AL,AZ,BY,CY,DO,SV,GT,HU,LB,NI,PL 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for country in countries.split(",")
}
#: forms of values that may follow a number after a space; told by form alone, so that a pseudonym is cut where its value was
_FOLLOWING = re.compile(r"(?<= )(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}|[0-9]{13,19}|(?<![0-9]{4} )[0-9]{4}(?:[ -][0-9]{4}){3}(?! [0-9])|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]|[./-][0-9])")


def _group_ends(text: str, a: int, b: int, kind: str) -> list[int]:
    """The ends of a match and of all its beginnings of whole groups that have the kind's form, the longest first."""
    return [e for e in range(b, a, -1) if e == b or (not text[e].isalnum() and PATTERNS[kind].fullmatch(text, a, e))]


def _iban_ends(text: str, a: int, b: int) -> list[int]:
    """The end that gives the registered length of the country."""
    length = IBAN_LENGTH.get(text[a : a + 2])
    return [e for e in _group_ends(text, a, b, "iban") if sum(c.isalnum() for c in text[a:e]) == length]


def _other_iban_ends(text: str, a: int, b: int) -> list[int]:
    """The whole match, and the rest only where no length is registered."""
    return [b] if text[a : a + 2] in IBAN_LENGTH else _group_ends(text, a, b, "iban")


def _phone_ends(text: str, a: int, b: int) -> list[int]:
    """The longest first, but those last that reach over a value of another form; none ends inside one. A number of
    country code 1 has ten further digits where that can be."""
    if text[a] != "+":
        return [b]
    others, at = [], a + 1
    while (m := _FOLLOWING.search(text, at)) and m.start() < b:
        others.append(m.span())
        at = m.end()
    ends = [e for e in _group_ends(text, a, b, "phone") if not any(s < e < t for s, t in others)]
    first = min((s for s, _ in others), default=b)
    north = lambda e: text[a + 1] == "1" and sum(c.isdigit() for c in text[a:e]) == 11
    return sorted(ends, key=lambda e: (not north(e), e > first))


#: kinds in their order, with the ends to try where a form also takes groups that follow
PASSES = [p for kind in KINDS for p in {"iban": [(kind, _iban_ends), (kind, _other_iban_ends)], "phone": [(kind, _phone_ends)]}.get(kind, [(kind, None)])]
_ANY_DIGIT = re.compile(rb"[0-9@]")
_ASSIGNED = re.compile(rb"(?:key|token|secret|passw|pwd)")


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY, undo: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id, text, n_found and found (kind, start, end in the new text) for every row; with ``carry`` also the struct of these columns."""

    def run(texts, own):
        new, found = [], []
        for t in texts:
            if t is None or not (_ANY_DIGIT.search(t) or _ASSIGNED.search(t)):
                new.append(t)
                found.append([])
            else:
                text, spans = own.replace(t.decode("utf-8", "replace"))
                new.append(text.encode())
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return [pa.array(new, pa.binary()).cast(pa.string()), pa.array([len(f) for f in found], pa.int64()), pa.array(found, kind)]

    schema = f"{text_col} string, n_found long, found array<struct<kind:string,start:int,end:int>>"
    return per_text(docs.select(id_col, text_col, *([] if carry is None else [carried(carry)])), schema, run, lambda: Pseudonyms(key, undo))
