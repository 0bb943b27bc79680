"""PII: format-preserving Feistel pseudonyms of validated numbers, dates and names of accounts."""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days that dates are permuted among.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
ROUNDS = 8

_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_HEX = "0123456789abcdef"

# One scan finds the candidates of all kinds; each is validated before it counts. A run of
# characters is entered at its start alone and never given back, so that no text, whatever
# its runs, costs more than a few steps a character.
_CANDIDATES = re.compile(
    r"""
    (?<![A-Za-z0-9._%+\-])[._%+\-]*+
        (?P<email>[A-Za-z0-9][A-Za-z0-9._%+\-]*+@(?=[A-Za-z0-9])(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,24})
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<access>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))
    |(?P<secret>(?<![A-Za-z0-9_\-.])(?P<name>[A-Za-z0-9_\-.]++)(?:\\?["'])?[ ]?[=:][ ]?(?:\\?["'])?
        (?P<value>[A-Za-z0-9_\-/+.~]{8,}+={0,2}))
    |(?P<date>(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}
        |[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./\-][0-9]))
    |(?P<address>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))
    |(?P<phone>(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])
        |(?<![0-9+])\+[1-9][0-9]{0,14}+(?:[ .\-][0-9]{1,14}+(?![0-9])|[ .\-]?\([0-9]{1,5}\)[0-9]{0,14}+){0,8}(?![0-9])
        |(?<![A-Za-z0-9+.\-_/])[2-9][0-9]{2}[2-9][0-9]{6}(?![A-Za-z0-9_]|[.\-/][0-9]))
    |(?P<social>(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-]))
    |(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ \-])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}
        |[0-9]{4}(?P<gap2>[ \-])[0-9]{6}(?P=gap2)[0-9]{5})(?![0-9]))
    """,
    re.VERBOSE,
)
#: Registered lengths of account numbers by country.
IBAN_LENGTHS = {
    country: int(n)
    for n, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FO,FI,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV "
        "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,TL,OM,SO 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
        "25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA "
        "30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for country in countries.split(",")
}
#: Digits behind + at most, by country code, where they are few; elsewhere 15 in all.
PHONE_DIGITS = {
    "1": 11, "7": 11, "20": 12, "27": 11, "30": 12, "31": 11, "32": 11, "33": 11, "34": 11, "36": 11,
    "39": 13, "40": 11, "41": 11, "44": 12, "45": 10, "46": 11, "47": 10, "48": 11, "49": 13, "52": 12,
    "55": 13, "61": 11, "81": 12, "82": 12, "86": 13, "90": 12, "91": 12, "351": 12, "353": 12, "358": 12,
}
#: Names of values to hide, alone or before more of the name.
_KEYWORD = re.compile(r"(?i:password|passwd|pwd|token|secret|api[_\-]?key)")
#: Characters that are permuted together; a longer value goes piece by piece.
PIECE = 256
#: A text with none of these has no candidate.
_NEEDED = re.compile(r"[0-9@=:]")


class Pseudonyms:
    """Keyed permutations: one value of a kind always becomes one other of its format."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def number(self, value: int, size: int, kind: str, valid: Callable[[int], bool] | None = None) -> int:
        """The permuted number among 0..size-1, and among the valid ones if given.

        A Feistel network over twice the bits of a half; what falls outside walks on.
        The start is inside, so the walk comes back, and different starts stay different.
        """
        if size <= 1:
            return value
        bits = ((size - 1).bit_length() + 1) // 2
        low = (1 << bits) - 1
        wide = (bits + 7) // 8
        prefix = self.key + f"{kind}:{size}:".encode()
        x = value
        while True:
            left, right = x >> bits, x & low
            for turn in range(ROUNDS):
                mixed = hashlib.shake_256(prefix + bytes([turn]) + right.to_bytes(wide, "big"))
                left, right = right, left ^ (int.from_bytes(mixed.digest(wide), "big") & low)
            x = (left << bits) | right
            if x < size and (valid is None or valid(x)):
                return x

    def digits(self, text: str, kind: str, valid: Callable[[str], bool] | None = None) -> str:
        n = len(text)
        fits = (lambda x: valid(str(x).zfill(n))) if valid else None
        return str(self.number(int(text), 10**n, kind, fits)).zfill(n) if n else ""

    def classes(self, text: str, kind: str, may_be_hex: bool = False) -> str:
        """Digits to digits, letters to letters of their case; all else stays in place.

        With ``may_be_hex`` a hexadecimal text, of both its letters and digits, stays one.
        Each piece of a long text is permuted under what the pieces before it became.
        """
        hexadecimal = may_be_hex and _is_hex(text)
        if len(text) <= PIECE:
            return self._piece(text, kind, hexadecimal)
        out: list[str] = []
        for start in range(0, len(text), PIECE):
            before = hashlib.sha256(out[-1].encode()).hexdigest() if out else ""
            out.append(self._piece(text[start : start + PIECE], f"{kind}:{start}:{before}", hexadecimal))
        return "".join(out)

    def _piece(self, text: str, kind: str, hexadecimal: bool) -> str:
        sets = [
            _HEX if hexadecimal
            else _DIGITS if c in _DIGITS
            else _LOWER if c in _LOWER
            else _LOWER.upper() if c in _LOWER.upper()
            else c
            for c in text
        ]
        value, size = 0, 1
        for c, letters in zip(text, sets):
            value, size = value * len(letters) + letters.index(c), size * len(letters)
        format_ = "".join(s[0] if len(s) > 1 else "\x00" + s for s in sets)

        def written(value: int) -> str:
            out = []
            for letters in reversed(sets):
                value, place = divmod(value, len(letters))
                out.append(letters[place])
            return "".join(reversed(out))

        fits = (lambda x: _is_hex(written(x))) if hexadecimal and _is_hex(text) else None
        return written(self.number(value, size, f"{kind}:{format_}", fits))


def _is_hex(text: str) -> bool:
    """Only lower-case hexadecimal digits, some of them letters and some not."""
    return all(c in _HEX for c in text) and not text.isdigit() and not text.isalpha()


def luhn_digit(digits: str) -> str:
    """The check digit behind these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(pattern: str, digits: str) -> str:
    """The pattern with its digits replaced one by one."""
    supply = iter(digits)
    return "".join(next(supply) if c in _DIGITS else c for c in pattern)


def _only(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _card(text: str, p: Pseudonyms) -> str | None:
    digits = _only(text)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    head = digits[0] + p.digits(digits[1:-1], f"card{digits[0]}")
    return _refill(text, head + luhn_digit(head))


_TWICE = re.compile(r"[ .\-]?\(0\)")


def _code(digits: str) -> str:
    """The country code in front; three digits where it is not listed."""
    return next((digits[:n] for n in (1, 2, 3) if digits[:n] in PHONE_DIGITS), digits[:3])


def _phone(text: str, p: Pseudonyms) -> str | None:
    trunk = _TWICE.search(text)
    plain = text if trunk is None else text[: trunk.start()] + text[trunk.end() :]
    digits = _only(plain)
    size = 10
    if text[0] == "+" and _code(digits) != "1":
        if not 8 <= len(digits) <= 15:
            return None
        size = len(digits) - len(_code(digits))
    elif len(digits) < 10 or (text[0] == "+" and len(digits) > 13):
        return None
    country, national = digits[:-size], digits[-size:]
    if size == 10 and country in ("", "1"):
        strict = national[0] in "23456789" and national[3] in "23456789"
        fits = (lambda x: x[0] in "23456789" and x[3] in "23456789") if strict else None
    else:
        strict = national[0] != "0"
        fits = (lambda x: x[0] != "0") if strict else None
    moved = _refill(plain, country + p.digits(national, f"phone{country}{strict}", fits))
    return moved if trunk is None else moved[: trunk.start()] + trunk.group() + moved[trunk.start() :]


def _ends(kind: str, text: str) -> Iterator[int]:
    """Where a candidate may end, longest first: before words that merely follow it."""
    ends = [len(text), *(m.start() for m in reversed(list(re.finditer(r"[ .\-]", text))))]
    if kind == "iban":
        size = IBAN_LENGTHS.get(text[:2])
        fits = lambda part: size is None or len(part.replace(" ", "")) == size
    elif kind == "phone" and text[0] == "+":
        most = PHONE_DIGITS.get(_code(_only(text)), 15)
        fits = lambda part: len(_only(_TWICE.sub("", part))) <= most
    elif kind == "secret":
        # Dots at the end belong to the sentence.
        ends, fits = [len(text.rstrip("."))], lambda part: len(part) >= 8
    else:
        ends, fits = ends[:1], lambda part: True
    return (end for end in ends if fits(text[:end]))


def _address(text: str, p: Pseudonyms) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = p.number(int.from_bytes(bytes(parts), "big"), 1 << 32, "address")
    return ".".join(str(b) for b in value.to_bytes(4, "big"))


def _social(text: str, p: Pseudonyms) -> str | None:
    def valid(x: str) -> bool:
        return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"

    digits = _only(text)
    return _refill(text, p.digits(digits, "social", valid)) if valid(digits) else None


def _date(text: str, p: Pseudonyms) -> str | None:
    """A calendar date in its own notation; 7/5/2001 counts as month/day/year.

    31/12/2024 has no such reading and counts as day/month/year. It moves among the dates
    that only this order can name, so no two dates come out as one text.
    """
    mark = next(c for c in text if c not in _DIGITS)
    a, b, c = text.split(mark)
    day_first = mark == "/" and int(a) > 12
    year, month, day = {"-": (a, b, c), "/": (c, b, a) if day_first else (c, a, b), ".": (c, b, a)}[mark]
    y, m, d = int(year), int(month), int(day)
    if not (FIRST_DAY.year <= y <= LAST_DAY.year and 1 <= m <= 12):
        return None
    if not 1 <= d <= calendar.monthrange(y, m)[1]:
        return None
    first = FIRST_DAY.toordinal()
    fits = (lambda x: datetime.date.fromordinal(first + x).day > 12) if day_first else None
    moved = p.number(
        datetime.date(y, m, d).toordinal() - first, LAST_DAY.toordinal() - first + 1, "date", fits
    )
    to = datetime.date.fromordinal(first + moved)
    padded = len(month) == 2 and len(day) == 2
    mm, dd = (f"{to.month:02}", f"{to.day:02}") if padded else (str(to.month), str(to.day))
    slashed = (dd, mm, str(to.year)) if day_first else (mm, dd, str(to.year))
    return mark.join({"-": (str(to.year), mm, dd), "/": slashed, ".": (dd, mm, str(to.year))}[mark])


def _iban(text: str, p: Pseudonyms) -> str | None:
    plain = text.replace(" ", "")

    def rest(country: str, account: str) -> int:
        moved = account + country + "00"
        return int("".join(str(int(c, 36)) for c in moved)) % 97

    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or int(check) != 98 - rest(country, account):
        return None
    account = p.classes(account, f"iban{country}")
    supply = iter(country + f"{98 - rest(country, account):02}" + account)
    return "".join(" " if c == " " else next(supply) for c in text)


def _email(text: str, p: Pseudonyms) -> str | None:
    """Local part and domain change apart, so accounts of one domain stay together."""
    local, _, domain = text.rpartition("@")
    name, _, top = domain.rpartition(".")
    moved = p.classes(local.lower(), f"local{domain.lower()}")
    return f"{moved}@{p.classes(name.lower(), 'domain')}.{top}"


def _access(text: str, p: Pseudonyms) -> str | None:
    return text[:4] + p.classes(text[4:], "access")


def _secret(text: str, p: Pseudonyms) -> str | None:
    return p.classes(text, "secret", may_be_hex=True) if any(c in _DIGITS for c in text) else None


def _names_secret(name: str) -> bool:
    """password, API_KEY, dbPassword, token.id, secretKey: but not tokens or passwordless."""
    marked = max(map(name.rfind, "_-."))
    for found in _KEYWORD.finditer(name):
        rest = found.end()
        if rest == len(name) or (name[rest] in "_-." and rest + 1 < len(name)):
            return True
        if "A" <= name[rest] <= "Z" and marked < rest:
            return True
    return False


_KINDS: dict[str, Callable[[str, Pseudonyms], str | None]] = {
    "email": _email, "iban": _iban, "access": _access, "secret": _secret, "date": _date,
    "address": _address, "phone": _phone, "social": _social, "card": _card,
}


@lru_cache(maxsize=4)
def _keyed(key: bytes) -> Callable[[str, str], str | None]:
    pseudonyms = Pseudonyms(key)

    @lru_cache(maxsize=50_000)
    def of(kind: str, text: str) -> str | None:
        return _KINDS[kind](text, pseudonyms)

    return of


def pseudonymize(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its values replaced, and (kind, start, length) in the new text.

    Candidates that fail their check (sum, calendar, octets, area) stay as they are.
    """
    if not _NEEDED.search(text):
        return text, []
    of = _keyed(key)
    out: list[str] = []
    spans: list[tuple[str, int, int]] = []
    done = length = 0
    at = 0
    while found := _CANDIDATES.search(text, at):
        kind = next(k for k in _KINDS if found.group(k) is not None)
        start, end = found.span("value" if kind == "secret" else kind)
        if kind == "secret" and not _names_secret(found["name"]):
            at = found.end("name")
            continue
        for cut in _ends(kind, text[start:end]):
            new = of(kind, text[start : start + cut])
            if new is not None:
                break
        else:
            # Another value may begin inside what failed.
            at = found.start() + 1
            continue
        at = start + cut
        out += [text[done:start], new]
        length += start - done
        spans.append((kind, length, len(new)))
        length += len(new)
        done = at
    if not spans:
        return text, []
    out.append(text[done:])
    return "".join(out), spans


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))


def _replacer(key: bytes):
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text in batch.column("text"):
                text = text.as_py()
                new, found = (None, []) if text is None else pseudonymize(text, key)
                texts.append(new)
                spans.append([{"kind": k, "start": s, "length": n} for k, s, n in found])
            names = batch.schema.names
            columns = [
                pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names
            ]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(spans, _SPANS)], [*names, "spans"]
            )

    return replace


def pseudonymize_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text and spans: each row with its values replaced under the key.

    Null texts stay null without spans; rows are treated one by one, so repeated rows
    come out equal, and equal values stay linked across documents. There is no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _replacer(key),
        f"doc_id {kind}, text string, spans array<struct<kind:string,start:bigint,length:bigint>>",
    )


def with_pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows of ``docs`` with the text replaced; all other columns as they were.

    ``n_chars`` follows the text where there is such a column.
    """
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
        F.col("text").cast("string").alias("text"),
    )
    row = packed.schema["row"].dataType.simpleString()
    done = packed.mapInArrow(
        _replacer(key),
        f"row {row}, text string, spans array<struct<kind:string,start:bigint,length:bigint>>",
    )

    def column(name: str):
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            kind = docs.schema[name].dataType
            return F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars")).alias(name)
        return F.col(f"row.`{name}`").alias(name)

    return done.select(*[column(c) for c in docs.columns])
