"""Personal data and secrets replaced by keyed surrogates of the same type and format.

Numbers, addresses and secrets: each entity's characters are permuted within their classes (digits;
vowels and consonants by case and script; ideographs ...), so length, script, case, punctuation and
shape stay. The permutation is a keyed Feistel network over the strings of one shape. A phone number
keeps its country code, an account number its country and valid check digits; a card number is valid
where it was; a street keeps its kind.

Names: each part of a name is an entity, whatever title or other part stands beside it. A given name
of the lists becomes another one of its gender and length by a keyed order; any other part is drawn
from the pronounceable units of its own shape (initial and inner pairs of consonants, single
consonants, vowels, by script), and its last vowel, a mark of gender in many languages, stays.

Every step is a bijection on the strings of its type and shape: an entity always gets the same
surrogate (coreference) and two entities never get the same one (distinctness), in whatever documents
they stand and without any exchange between machines. Where a step could leave its set (a drawn part
that is a listed name, a card number that turns valid), the check walks on along the permutation's
cycle until the surrogate is free, which keeps the bijection. ``clashes`` verifies it over a table.

Defined cases: null texts stay null, empty ones empty; an entity of one shape only (no character to
permute) stays; overlapping candidates go to the first, then the longest-listed type; repeated rows
are treated alike; other columns pass through ``replaced`` unchanged, whatever their names; an
empty table gives an empty one. Whole texts are searched.

Names are found by a title or by a listed given name before a capitalised word; the parts found in a
document are then found alone in it too. Not supported: other names, user names, places and dates of
birth, streets of other kinds than STREETS, identity, licence and vehicle numbers other than 3-2-4
digits, national bank accounts, coordinates, compressed IPv6 addresses without a decimal digit (they
look like code), the letters before the IPv4 part of a mixed address, and secrets of other forms than
ENTITY names that no keyword introduces.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batch, tidied

ROUNDS = 8
#: Classes of characters; a surrogate takes each from the class of the original.
_LOWER = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "âêîôû", "äöü", "ãõ", "āēīōū", "ąęįų", "ěőůű", "æøå", "çñ", "čćďđľłńňřśšťźżž", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
CLASSES = ("0123456789", *_LOWER, *(c.upper() for c in _LOWER))
#: Ranges of letters of scripts without case, each one class.
RANGES = ((0x05D0, 0x05EA), (0x0621, 0x063A), (0x0905, 0x0939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
#: Given names by gender, titles, kinds of streets.
FEMALE = (
    "ada alba alice amelia amy ana anita anja anna anne barbara beate beatriz birgit carla carmen caroline catherine claire clara claudia daniela "
    "diana dora elena elisa elizabeth ella emily emma erika eva fiona frida gabriela grace hanna heike helen helena ines irene isabel jane jessica "
    "joan julia karin karla katja laura lena lisa lucia luisa maria marie martha mary monica nadia nina olga olivia paula petra rita rosa sabine sandra "
    "sara sarah silvia sofia sophie susan tanja teresa ursula vera"
).split()
MALE = (
    "adam alan albert alex alfred andreas antonio arthur ben bernd bruno carl carlos charles christian daniel david diego dieter edward emil eric erik "
    "felix fernando francis frank fred george gerd hans harald harry heinz henri henry hugo igor ivan jack jacob jakob james jan javier jean jens joe john "
    "jorge jose karl klaus kurt lars leo lewis louis lucas luis manuel marco mark martin michael miguel oliver oscar otto pablo paul pedro peter pierre "
    "ralf richard robert rolf samuel simon stefan thomas tim uwe victor walter werner william"
).split()
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Drive", "Boulevard", "Blvd", "Court", "Square")
#: Pairs of consonants that begin a part, and that stand inside or at its end.
ONSETS = "bl br ch cl cr dr fl fr gl gr kl kr pl pr sc sh sk sl sm sn sp st sw th tr".split()
INNER = "ck ld lf lk ll lm lt mm mp nd ng nk nn ns nt rd rk rl rm rn rr rs rt ss st th tt".split()
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra", "Monsieur", "Madame", "Mme")
_CLASS = {c: (k, i) for k, letters in enumerate(CLASSES) for i, c in enumerate(letters)}
_NAME = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:['-][^\W\d_]+)?"
ENTITY = re.compile(
    "|".join(
        (
            r"(?P<secret>\b(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?[A-Za-z0-9_+/=-]{8,}|\b(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[a-z]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{5,}){2})\b)",
            r"(?P<hardware>(?<![\w:.-])(?=[0-9A-Fa-f]{0,4}[:-])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:-])"
            r"|(?=(?:[0-9A-Fa-f]{0,4}:){2,8})(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:]|\.\d)))",
            r"(?P<email>[\w.+%-]+@[\w-]+(?:\.[\w-]+)+)",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
            r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))",
            r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
            r"(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))",
            r"(?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))",
            rf"(?P<name>\b(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[  ]{_NAME}(?:[  ]{_NAME}){{0,2}})",
        )
    )
)
#: With TITLES and _KEYED, what any entity has at least.
_HINT = re.compile(r"[@\d]|eyJ|sk-|gh[a-z]_|AKIA|[a-f]{32}|[A-F]{32}|(?:[0-9A-Fa-f]{1,4}[:-]){5}")
_UNTITLED = re.compile(rf"\b([A-Z][a-z]{{1,8}})(?: [A-Z]\.)?((?:[  ]{_NAME}){{1,2}})")
_STREET = re.compile(rf"\b\d{{1,5}} (?:[A-Z][a-z]+ ){{1,2}}(?:{'|'.join(STREETS)})\b|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|allee|gasse) \d{{1,4}}\b")
_LOCAL = re.compile(r"0(?<![\d.,/-]0)\d{1,4}[ /-]\d{5,8}(?![\d-])")
_PART = re.compile(r"[^\W\d_]{2,}")
_KEYED = re.compile(r"(?i)(?:token|secret|password|passwd|key)\s*[=:]")
_GIVEN = {*FEMALE, *MALE}
_WAYS = (*(f" {x}" for x in STREETS), "straße ", "strasse ", "weg ", "platz ", "allee ", "gasse ")
_SECRET_VALUE = re.compile(r"[A-Za-z0-9_+/=-]+\Z")


def _place(c: str) -> tuple[int, int, int] | None:
    """Class, index in it and its size; None for characters that stay."""
    if c in _CLASS:
        k, i = _CLASS[c]
        return k, i, len(CLASSES[k])
    for k, (lo, hi) in enumerate(RANGES):
        if lo <= ord(c) <= hi:
            return len(CLASSES) + k, ord(c) - lo, hi - lo + 1
    if c.isalpha() and not c.isascii():  # any other letter: among the letters of its kind nearby
        near = _near(ord(c) >> 5, unicodedata.category(c))
        return -1 - (ord(c) >> 5), near.index(c), len(near)
    return None


@cache
def _near(block: int, category: str) -> str:
    return "".join(c for c in map(chr, range(block << 5, (block + 1) << 5)) if unicodedata.category(c) == category)


def _letter(old: str, k: int, i: int) -> str:
    if k < 0:
        return _near(-1 - k, unicodedata.category(old))[i]
    return CLASSES[k][i] if k < len(CLASSES) else chr(RANGES[k - len(CLASSES)][0] + i)


def _units(part: str) -> list[tuple[str, object, int, int]]:
    """A part of a name as pairs of consonants and single characters: text, class, index in it, its size."""
    out, at = [], 0
    while at < len(part):
        pairs = INNER if at else ONSETS
        pair = part[at : at + 2]
        if pair in pairs:
            out.append((pair, "inner" if at else "onset", pairs.index(pair), len(pairs)))
        elif place := _place(part[at]):
            out.append((part[at], *place))
        else:
            out.append((part[at], None, 0, 1))
        at += len(out[-1][0])
    return out


class Surrogates:
    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(1 << 16)(self._of)
        self.given = self._listed(FEMALE) | self._listed(MALE)

    def _feistel(self, tweak: str, values: list[int], sizes: list[int]) -> list[int]:
        """A keyed bijection on the numbers with these digits in a mixed radix."""
        half = (len(values) + 1) // 2
        if len(values) == 1:  # one place: a keyed rotation
            shift = int.from_bytes(hmac.digest(self.key, tweak.encode(), "sha256")[:8], "big")
            return [(values[0] + 1 + shift % max(1, sizes[0] - 1)) % sizes[0]]

        def number(v: list[int], s: list[int]) -> int:
            n = 0
            for x, m in zip(v, s):
                n = n * m + x
            return n

        left, right = number(values[:half], sizes[:half]), number(values[half:], sizes[half:])
        whole_left, whole_right = number([1] + [0] * half, [1, *sizes[:half]]), number([1] + [0] * (len(values) - half), [1, *sizes[half:]])
        for r in range(ROUNDS):
            other = right if r % 2 == 0 else left
            f = int.from_bytes(hmac.digest(self.key, f"{tweak}|{r}|{other}".encode(), "sha512"), "big")
            if r % 2 == 0:
                left = (left + f) % whole_left
            else:
                right = (right + f) % whole_right

        def digits(n: int, s: list[int]) -> list[int]:
            out = []
            for m in reversed(s):
                n, x = divmod(n, m)
                out.append(x)
            return out[::-1]

        return digits(left, sizes[:half]) + digits(right, sizes[half:])

    def permuted(self, kind: str, text: str, fixed: frozenset[int] = frozenset()) -> str:
        places = [None if i in fixed else _place(c) for i, c in enumerate(text)]
        at = [i for i, p in enumerate(places) if p]
        if not at:
            return text
        # what stays is part of the tweak, so that every shape has a permutation of its own
        shape = "".join(c if p is None else f"\0{p[0]}" for c, p in zip(text, places))
        new = self._feistel(f"{kind}|{shape}", [places[i][1] for i in at], [places[i][2] for i in at])
        out = list(text)
        for i, v in zip(at, new):
            out[i] = _letter(text[i], places[i][0], v)
        return "".join(out)

    def _listed(self, names: list[str]) -> dict[str, str]:
        """Each name's successor among those of its length, in a keyed order."""
        out = {}
        order = sorted(names, key=lambda x: hmac.digest(self.key, f"given|{x}".encode(), "sha256"))
        for size in {len(x) for x in names}:
            alike = [x for x in order if len(x) == size]
            if len(alike) > 1:
                out |= dict(zip(alike, alike[1:] + alike[:1]))
        return out

    def _part(self, text: str) -> str:
        low = text.lower()
        if len(low) != len(text):
            return self.permuted("name", text)
        new = self.given.get(low)
        if new is None:
            new = self._drawn(low)
        return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(text, new))

    def _drawn(self, part: str) -> str:
        units = _units(part)
        moving = [i for i, (_, _, _, size) in enumerate(units) if size > 1 and not (i and i == len(units) - 1 and part[-1] in "aeiouаяα")]
        if not moving:
            return part
        kinds = [u[1] for u in units]
        shape = "|".join(u[0] if i not in moving else str(u[1]) for i, u in enumerate(units))
        values, sizes = [units[i][2] for i in moving], [units[i][3] for i in moving]
        out = [u[0] for u in units]
        while True:
            values = self._feistel(f"part|{shape}", values, sizes)
            for i, v in zip(moving, values):
                out[i] = ONSETS[v] if kinds[i] == "onset" else INNER[v] if kinds[i] == "inner" else _letter(units[i][0], kinds[i], v)
            new = "".join(out)
            # on along the permutation's cycle to a string that has these units and is no listed name: still a bijection
            if new not in self.given and [u[1] for u in _units(new)] == kinds:
                return new

    def _digits(self, kind: str, text: str, keep: int = 0) -> str:
        """The digits permuted (all but the first ``keep``), laid back into the text's format."""
        digits = re.sub(r"\D", "", text)
        new = iter(self.permuted(kind, digits, frozenset(range(keep))))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def _of(self, kind: str, text: str) -> str:
        if kind == "email":
            low = text.lower()
            tld = low.rindex(".")
            new = self.permuted(kind, low, frozenset(range(tld, len(low)))) if len(low) == len(text) else self.permuted(kind, text)
            return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(text, new))
        if kind == "ip":
            octets = [int(x) for x in text.split(".")]
            return ".".join(map(str, self._feistel(kind, octets, [256] * 4)))
        if kind == "phone":
            code = re.match(r"\+(\d{1,3})(?=\D)", text)
            return self._digits(kind, text, len(code[1]) if code else 0)
        if kind == "ssn":
            return self._digits(kind, text)
        if kind == "hardware":  # long network and hardware addresses: hexadecimal in the original's case
            at = [i for i, c in enumerate(text) if c not in ":-"]
            new = self._feistel(tweak := f"{kind}|{re.sub('[^:-]', 'x', text)}", [int(text[i], 16) for i in at], [16] * len(at))
            while "::" in text and min(new) > 9:  # a compressed address has a digit; on along the permutation's cycle: still a bijection
                new = self._feistel(tweak, new, [16] * len(at))
            out = list(text)
            for i, v in zip(at, new):
                out[i] = f"{v:X}" if text.isupper() else f"{v:x}"
            return "".join(out)
        if kind == "card":
            digits = re.sub(r"\D", "", text)
            if luhn(digits):
                body = self.permuted(kind, digits[:-1])
                new = body + next(c for c in "0123456789" if luhn(body + c))
            else:
                new = self.permuted(kind, digits)
                while luhn(new):  # on along the permutation's cycle: still a bijection
                    new = self.permuted(kind, new)
            laid = iter(new)
            return "".join(next(laid) if c.isdigit() else c for c in text)
        if kind == "iban":
            plain = text.replace(" ", "")
            body = self.permuted(kind, plain[4:])
            new = iter(plain[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in body + plain[:2]) + '00') % 97:02d}" + body)
            return "".join(c if c == " " else next(new) for c in text)
        if kind == "secret":
            value = _SECRET_VALUE.search(text)
            for digits in ("0123456789abcdef", "0123456789ABCDEF"):
                if len(value[0]) > 1 and set(value[0]) <= set(digits):  # hexadecimal stays so
                    new = self._feistel(f"{digits}|{len(value[0])}", [digits.index(c) for c in value[0]], [16] * len(value[0]))
                    return text[: value.start()] + "".join(digits[i] for i in new)
            return text[: value.start()] + self.permuted(kind, value[0])
        if kind == "street":
            fixed = set()
            for m in re.finditer(rf"\b(?:{'|'.join(STREETS)})$|(?:straße|strasse|weg|platz|allee|gasse)(?= \d)", text):
                fixed |= {*range(m.start(), m.end())}
            return self.permuted(kind, text, frozenset(fixed))
        title = re.match(rf"(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.?\s", text)
        at = title.end() if title else 0
        return text[:at] + _PART.sub(lambda m: self._part(m[0]), text[at:])


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def found(text: str) -> list[tuple[str, int, int]]:
    """(type, from, to) of the entities of a text."""
    spans = []
    if _HINT.search(text) or any(t in text for t in TITLES) or _KEYED.search(text):
        spans = [(m.lastgroup, m.start(), m.end()) for m in ENTITY.finditer(text)]
        spans = _with(spans, [("phone", m.start(), m.end()) for m in _LOCAL.finditer(text)])
    if any(t in text for t in _WAYS):
        spans = _with(spans, [("street", m.start(), m.end()) for m in _STREET.finditer(text)])
    names = [("name", m.start(), m.end()) for m in _UNTITLED.finditer(text) if m[1].lower() in _GIVEN]
    if names:
        spans = _with(spans, names)
    parts = {p for k, a, b in spans if k == "name" for p in _PART.findall(text[a:b]) if len(p) > 2 and p not in TITLES and p[0].isupper()}
    if parts:  # alone they are the same person's
        again = re.compile(rf"\b(?:{'|'.join(sorted(map(re.escape, parts), key=len, reverse=True))})\b")
        spans = _with(spans, [("name", m.start(), m.end()) for m in again.finditer(text)])
    return spans


def _with(spans: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """All spans in order, without those of ``more`` that overlap others."""
    out, k = [], 0
    for x in more:
        while k < len(spans) and spans[k][2] <= x[1]:
            out.append(spans[k])
            k += 1
        if k == len(spans) or spans[k][1] >= x[2]:
            out.append(x)
    return out + spans[k:]


def rewritten(text: str, surrogates: Surrogates) -> tuple[str, list[str]]:
    """The text with surrogates, and the entities' types in order."""
    spans = found(text)
    if not spans:
        return text, []
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], surrogates.of(kind, text[a:b])]
        at = b
    return "".join([*out, text[at:]]), [k for k, _, _ in spans]


def replaced(df: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """df with surrogates in its text column; count_col, if named, gets the number of entities."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for b in batches:
            k = b.schema.names.index(text_col)
            rows = [(None, []) if t is None else rewritten(t, surrogates) for t in b.column(k).to_pylist()]
            columns, names = list(b.columns), list(b.schema.names)
            columns[k] = pa.array([t for t, _ in rows], b.schema.field(k).type)
            if count_col:
                columns.append(pa.array([len(x) for _, x in rows], pa.int64()))
                names.append(count_col)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    if count_col:
        from pyspark.sql.types import LongType, StructType

        schema = StructType([*schema.fields]).add(count_col, LongType())
    return df.mapInArrow(tidied(run), schema)


def entities(df: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """kind, original, surrogate: the distinct entities of a table."""
    schema = pa.schema([("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for b in batches:
            rows = {(k, t[x:y], surrogates.of(k, t[x:y])) for t in b.column(0).to_pylist() if t for k, x, y in found(t)}
            if rows:
                yield batch(schema, list(map(list, zip(*rows))))

    return df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(tidied(run), "kind string, original string, surrogate string").distinct()


def clashes(entity_table: DataFrame) -> DataFrame:
    """Surrogates that stand for two or more originals of their type; empty, as the permutation is a bijection."""
    return entity_table.groupBy("kind", "surrogate").agg(F.count_distinct("original").alias("originals")).where("originals > 1")
