"""PII: format-preserving Feistel pseudonyms.

Validated e-mail addresses, phone numbers, card numbers, social security numbers, IBANs, IPv4 addresses and dates are
replaced by values of the same format. A value is permuted within its format by a keyed Feistel network, so equal values get
equal pseudonyms in every document, different values different ones, and the holder of the key can turn them back.

Digits beside a value do not hide it: where the longest candidate fails its check, shorter ones from the same place are
tried, then the next place.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from functools import lru_cache
from hashlib import blake2b

from pyspark.sql import DataFrame

from .common import extend

#: For tests and examples only: whoever has the key can turn pseudonyms back.
KEY = b"foliograph example key"
ROUNDS = 8
KINDS = ("email", "phone", "card", "ssn", "iban", "ip", "date")
_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def _round(key: bytes, tweak: bytes, n: int, value: int) -> int:
    return int.from_bytes(blake2b(b"%b|%d|%d" % (tweak, n, value), key=key[:64], digest_size=16).digest(), "little")


def permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of ``range(size)``: an unbalanced modular Feistel network over a * b >= size, cycle-walked."""
    if size < 2:
        return value
    a = int(size**0.5)
    while a * a < size:
        a += 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for n in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if n % 2:
                f = _round(key, tweak, n, left)
                right = (right - f if back else right + f) % b
            else:
                f = _round(key, tweak, n, right)
                left = (left - f if back else left + f) % a
        value = left * b + right
        if value < size:
            return value


def _digits(text: str, key: bytes, tweak: bytes, back: bool, fine: Callable[[str], bool] = lambda s: True) -> str:
    """Digits permuted among the strings of their length that are ``fine`` (which the given ones have to be)."""
    while True:
        text = str(permute(int(text), 10 ** len(text), key, tweak + b"%d" % len(text), back)).zfill(len(text))
        if fine(text):
            return text


def _refill(shape: str, digits: str) -> str:
    """The digits put in the places of those of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> bool:
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


#: Length of an IBAN by country (fixed values, of the public registry).
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20,
    EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30,
    KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24,
    PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24,
    XK=20,
)


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1


def _card(m: re.Match, key: bytes, back: bool) -> tuple[int, str] | None:
    """The valid number that starts here, of 16 digits or else the longest: an unbroken one of 13 digits and more, or groups
    of three digits and more with one kind of separator, the last may be shorter; or the whole run of digits if its groups
    but the last are of one size, however small. The pseudonym is read back the same way: it makes no other choice valid."""
    run, text, start = m[0], m.string, m.start()
    groups = [(g.start(), g.end()) for g in re.finditer(r"\d+", run)]
    whole = not re.search(r"\d[ \-]$", text[max(0, start - 2) : start]) and not re.match(r"[ \-]\d", text[m.end() : m.end() + 2])
    if groups[0][1] < 3 and not whole:
        return None
    if groups[0][1] >= 13:
        groups = groups[:1]
    choices = []  # (characters, digits)
    for k in range(len(groups), 0, -1):
        part = run[: groups[k - 1][1]]
        sizes = [y - x for x, y in groups[: k - 1]]
        shaped = min(sizes, default=3) >= 3 or whole and k == len(groups) and len(set(sizes)) == 1
        if shaped and len(set(re.sub(r"\d", "", part))) <= 1:
            choices.append((len(part), sum(map(str.isdigit, part))))
    choices.sort(key=lambda c: (c[1] != 16, -c[1]))
    digits = re.sub(r"\D", "", run)
    for at, (size, n) in enumerate(choices):
        if not _is_card(digits[:n]):
            continue

        def fine(body: str) -> bool:
            new = body + next(c for c in "0123456789" if luhn(body + c)) + digits[n:]
            return len(set(body)) > 1 and not any(_is_card(new[:other]) for _, other in choices[:at])

        body = _digits(digits[: n - 1], key, b"card", back, fine)
        return size, _refill(run[:size], next(body + c for c in "0123456789" if luhn(body + c)))
    return None


def _nanp(d: str) -> bool:
    return d[0] >= "2" and d[3] >= "2"


def _phone(m: re.Match, key: bytes, back: bool) -> tuple[int, str] | None:
    d = re.sub(r"\D", "", m[0])
    if m[0].startswith("+") and not d.startswith("1"):
        if not 8 <= len(d) <= 15:
            return None
        return len(m[0]), _refill(m[0], d[:2] + _digits(d[2:], key, b"phone" + d[:2].encode(), back))
    country, d = (d[:1], d[1:]) if len(d) == 11 and d[0] == "1" else ("", d)
    valid = len(d) == 10 and _nanp(d)
    if len(d) != 10 or not (valid or m[0].startswith("+")):
        return None
    # A country code makes it a phone number even where the area code is not in use; such numbers keep to their own kind.
    return len(m[0]), _refill(m[0], country + _digits(d, key, b"nanp", back, lambda s: _nanp(s) == valid))


def _is_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(m: re.Match, key: bytes, back: bool) -> tuple[int, str] | None:
    d = m[0].replace("-", "")
    return (len(m[0]), _refill(m[0], _digits(d, key, b"ssn", back, _is_ssn))) if _is_ssn(d) else None


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(m: re.Match, key: bytes, back: bool) -> tuple[int, str] | None:
    """An IBAN of its country's length, or for countries not listed of the greatest valid length."""
    run = m[0]
    ends = [k for k in range(len(run), 4, -1) if run[k - 1] != " " and (k == len(run) or run[k] == " ")]
    for end in ends:
        part = run[:end]
        s = part.replace(" ", "")
        if not 15 <= len(s) <= 34 or IBAN_LENGTHS.get(s[:2], len(s)) != len(s) or _mod97(s) != 1:
            continue
        body, digits = s[4:], re.sub(r"\D", "", s[4:])
        if not digits:
            continue
        body = _refill(body, _digits(digits, key, b"iban" + s[:2].encode(), back))
        check = 98 - _mod97(s[:2] + "00" + body)
        it = iter(f"{s[:2]}{check:02d}{body}")
        return end, "".join(c if c == " " else next(it) for c in part)
    return None


def _ip(m: re.Match, key: bytes, back: bool) -> tuple[int, str] | None:
    parts = [int(x) for x in m[0].split(".")]
    if any(p > 255 for p in parts) or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    n = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ip", back)
    return len(m[0]), ".".join(map(str, n.to_bytes(4, "big")))


def _date(m: re.Match, key: bytes, back: bool) -> tuple[int, str] | None:
    a, b, c, sep = m["d1"], m["d2"], m["d3"], m["sep"]
    try:
        if len(a) == 4:
            order, day = "ymd", date(int(a), int(b), int(c))
        elif int(b) > 12:
            order, day = "mdy", date(int(c), int(a), int(b))
        else:
            order, day = "dmy", date(int(c), int(b), int(a))
    except ValueError:
        return None
    if not _FIRST <= day.toordinal() <= _LAST:
        return None
    # A day has one pseudonym in all notations. Day-first and month-first dates are only told apart by a day over 12, so
    # days over 12 and the others keep to their own kind.
    at = day.toordinal()
    while True:
        at = _FIRST + permute(at - _FIRST, _LAST - _FIRST + 1, key, b"date", back)
        new = date.fromordinal(at)
        if (new.day > 12) == (day.day > 12):
            break
    y, mo, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    return len(m[0]), sep.join({"ymd": (y, mo, d), "mdy": (mo, d, y), "dmy": (d, mo, y)}[order])


def _email(m: re.Match, key: bytes, back: bool) -> tuple[int, str] | None:
    """The local part's letters and digits are permuted together, each within its own kind; domain and signs stay."""
    local, domain = m[0].rsplit("@", 1)
    sizes = [26 if c.isalpha() else 10 for c in local if c.isalnum()]
    if not sizes:
        return None
    value, total = 0, 1
    for c in local:
        if c.isalnum():
            base = 26 if c.isalpha() else 10
            value, total = value * base + (ord(c.lower()) - 97 if base == 26 else int(c)), total * base
    value = permute(value, total, key, b"email" + domain.lower().encode() + bytes(sizes), back)
    out = []
    for c in reversed(local):
        if not c.isalnum():
            out.append(c)
            continue
        value, k = divmod(value, 26 if c.isalpha() else 10)
        out.append((chr(65 + k) if c.isupper() else chr(97 + k)) if c.isalpha() else str(k))
    return len(m[0]), "".join(reversed(out)) + "@" + domain


#: By kind, in the order in which they are tried at a place.
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9]"
    r"(?:[A-Za-z0-9.\-]{0,250}[A-Za-z0-9])?\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "date": r"(?<![\d./\-])(?P<d1>\d{4}(?=[\-/.]\d{2}[\-/.]\d{2}(?!\d))|\d{2}(?=[\-/.]\d{2}[\-/.]\d{4}(?!\d)))"
    r"(?P<sep>[\-/.])(?P<d2>\d{2})(?P=sep)(?P<d3>\d{4}|\d{2})",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\w+])(?:\+1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\d\-])"
    r"|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?![\d\-])",
    "card": r"(?<!\w)\d(?:[ \-]?\d){12,18}(?!\w)",
}
_PATTERN = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _PATTERNS.items()), re.ASCII)
_ONE = {kind: re.compile(pattern, re.ASCII) for kind, pattern in _PATTERNS.items()}
_MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
_MAY_HOLD = re.compile(r"[0-9@]")


@lru_cache(maxsize=1)
def _key(key: bytes) -> bytes:
    if not key:
        raise ValueError("a key is needed")
    return key


def pseudonymise(text: str | None, key: bytes = KEY, back: bool = False) -> tuple[str | None, dict[str, int]]:
    """The text with its validated values replaced, and how many of each kind; ``back`` undoes it with the same key."""
    counts = dict.fromkeys(KINDS, 0)
    if not text or not _MAY_HOLD.search(text):
        return text, counts
    key = _key(key)
    out, done, at = [], 0, 0
    while first := _PATTERN.search(text, at):
        at = first.start()
        for kind, pattern in _ONE.items():
            m = pattern.match(text, at)
            new = m and _MAKERS[kind](m, key, back)
            if new:
                out += [text[done:at], new[1]]
                done = at = at + new[0]
                counts[kind] += 1
                break
        else:
            at += 1
    return "".join(out) + text[done:], counts


def apply(docs: DataFrame, key: bytes = KEY, keep: list[str] | None = None, back: bool = False) -> DataFrame:
    """``docs`` with ``text`` pseudonymised and a count ``n_<kind>`` for each kind.

    Null and empty texts stay as they are with counts of 0; very long ones are read whole, in time that grows with their
    length. Rows are rewritten one by one: null ids, ties, repeated rows and further columns pass through; columns with the
    names of new ones are replaced; an empty table stays empty. Values that fail their validation (a wrong check digit, an
    octet over 255, no such day) stay as they are.
    """

    def rewrite(texts):
        texts = [None if t is None else t.decode("utf-8", "replace") for t in texts]
        done = [pseudonymise(t, key, back) for t in texts]
        return [[t for t, _ in done], *([c[k] for _, c in done] for k in KINDS)]

    return extend(docs, ["text"], rewrite, "text string, " + ", ".join(f"n_{k} long" for k in KINDS), keep=keep, most=256)
