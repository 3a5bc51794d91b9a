"""Private entities replaced by keyed surrogates of the same type and format."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bounded, pieces

KEY = b"effectum surrogate key"
ROUNDS = 8

RESULT = "doc_id long,text string,n_entities long,kinds array<string>,starts array<int>,ends array<int>,surrogates array<string>"

#: Titles that tell a name, by the gender they tell.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña"), "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don"), "n": ("Dr", "Prof")}
#: Given names by gender (n: any) and script, which tell a name without a title and are drawn from as surrogates.
GIVEN = {
    "latin": {
        "f": "Anna Maria Julia Laura Sarah Emma Sophie Elena Clara Lucia Marta Carmen Isabel Paula Alice Camille Chloe Manon Louise Ingrid Katharina Sabine Ursula Petra Monika Emily Olivia Hannah Rachel Rebecca Susan Linda Karen Nancy Helen Margaret Elizabeth Jennifer Patricia Barbara".split(),
        "m": "John James Robert Michael David Richard Thomas Charles Daniel Matthew Anthony Steven Andrew Kevin Brian George Edward Peter Paul Simon Hans Klaus Stefan Andreas Jürgen Wolfgang Matthias Pierre Jean Michel Philippe Laurent Antoine Juan Carlos Miguel Javier Pedro Luis Diego".split(),
        "n": "Alex Robin Kim Sascha Dominique Jordan Taylor Morgan Noor Jamie".split(),
    },
    "cyrillic": {
        "f": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
        "m": "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел Виктор".split(),
        "n": "Саша Женя Валя".split(),
    },
}
#: The gender of each given name.
_BY_NAME = {n.lower(): g for lists in GIVEN.values() for g, ns in lists.items() for n in ns}
_WORDS = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_LETTER = "[^\\W\\d_][\u0300-\u036f]*"
_NAME = rf"(?![a-z]){_LETTER}(?:{_LETTER})*(?:[-’'](?:{_LETTER})+)*"
_GIVEN = "|".join(sorted((n for lists in GIVEN.values() for ns in lists.values() for n in ns), key=len, reverse=True))
#: Words before a birthday, and kinds of streets.
_BORN = r"(?i:born(?: on)?|date of birth|birthday|DOB|geboren(?: am)?|geb\.|Geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)"
_STREET = r"(?:Street|St\.|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|Lane|Drive|Court|Square)"
#: Words before a number that tells a person.
_CUE = r"(?i:\b(?:passport|account|acct|customer|patient|tax|social security|licen[cs]e|konto|ausweis|steuer|cuenta|pasaporte|compte|passeport|identity|id)(?: card)?(?: (?:no|nr|number|nummer|num[eé]ro))?\b[.:#]{0,2} {0,2}#?)"
#: What may stand between the groups of a phone number: a separator, after signs that junk adds to words, or a table's bar.
_GAP = r"(?:[!#$%&*]{1,3}|(?= \|))?(?: \| |[ .-])?"
#: What is looked for only if the text has the character, or one of them.
PATTERNS = (
    ("email", "@", r"(?<![\w.+-])[\w.+-]*\w@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,24}(?![\w-])"),
    ("secret", "=:", r"(?i:\b(?:api[_-]?key|access[_-]?key|secret[_-]?key|client[_-]?secret|auth[_-]?token|token|secret|password|passwd|pwd)\b[\"']?!*\s*[=:][^\w\s\"']*\s*[\"']?)(?P<secret_value>[A-Za-z0-9+/_.~-]{8,}={0,2})"),
    ("secret", "0123456789", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,})"),
    ("secret", "0123456789", r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"),
    ("iban", "0123456789", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", ".", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("ipv6", ":", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![\w:])"),
    ("card", "0123456789", r"(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w]|[.,]\d)"),
    ("phone", "0123456789", rf"(?<![\w.+])(?:\+\d{{1,3}}{_GAP}(?:\(\d{{1,5}}\){_GAP})?\d{{2,5}}(?:{_GAP}\d{{2,5}}){{1,4}}|\(\d{{3}}\){_GAP}\d{{3}}[ .-]\d{{4}}|\d{{3}}[.-]\d{{3}}[.-]\d{{4}}|0\d{{1,4}}[ /-]\d{{5,8}})(?!\w)"),
    ("ssn", "-", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("number", "0123456789", rf"{_CUE}(?P<number_value>[A-Z]{{0,2}}\d{{6,12}})(?![\w]|[.,]\d)"),
    ("birthday", "0123456789", rf"(?<!\w){_BORN}:? +(?P<birthday_value>\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}})(?!\w)"),
    ("address", "0123456789", rf"(?<![\w.,])(?P<address_value>\d{{1,5}} +{_NAME}(?: +{_NAME}){{0,2}}) +{_STREET}(?!\w)"),
    ("address", "0123456789", rf"(?<!\w)(?:(?:Calle|Avenida|Rue|rue|Plaza|Place)(?: de(?: la| los)?| du| des)? +(?P<address_value>{_NAME}(?: +{_NAME}){{0,2}},? +\d{{1,5}})|(?P<address_also>{_NAME})(?:straße|strasse|weg|gasse|platz|allee) +(?P<address_number>\d{{1,4}}))(?!\w)"),
    ("name", "DFHMPS", rf"\b(?P<title>{_WORDS})\.? +(?P<name_value>{_NAME}(?: +{_NAME}){{0,2}})"),
    ("name", "", rf"(?<![\w-])(?P<name_value>(?:{_GIVEN})(?: +[A-Z]\.)?(?: +{_NAME}){{1,2}})"),
)
_COMPILED = [(kind, need, re.compile(p)) for kind, need, p in PATTERNS]
#: Letters that stand for one another in spoken words.
SPOKEN = ("aeiou", "bdgkpt", "lmnr", "fhsvwz", "cjqxy")


def _draws(key: bytes, tweak: str, data: str, sizes: list[int]) -> list[int]:
    """For each size a number below it, all from one hash of the key, the tweak and the data."""
    h = hashlib.shake_256(len(key).to_bytes(4, "big") + key + f"{tweak}\x00{data}".encode())
    raw = h.digest(8 * len(sizes))
    return [int.from_bytes(raw[8 * i : 8 * i + 8], "big") % n for i, n in enumerate(sizes)]


def permute(key: bytes, tweak: str, digits: list[int], bases: list[int]) -> list[int]:
    """A keyed one-to-one map of digit strings in mixed bases onto themselves.

    A Feistel network that isn't balanced: in each round one half is moved, digit by digit, by amounts drawn
    from the other half, the key and the tweak. One digit alone is moved by an amount other than 0.
    """
    n = len(digits)
    if n == 1:
        return [(digits[0] + 1 + _draws(key, tweak, "one", [bases[0] - 1])[0]) % bases[0]] if bases[0] > 1 else digits
    out, h = list(digits), n // 2
    for r in range(ROUNDS):
        own, other = (range(h), range(h, n)) if r % 2 else (range(h, n), range(h))
        seen = ",".join(str(out[i]) for i in other)
        for i, by in zip(own, _draws(key, f"{tweak}/{r}/{n}", seen, [bases[i] for i in own]), strict=True):
            out[i] = (out[i] + by) % bases[i]
    return out


def _alphabet(c: str, spoken: bool) -> str | None:
    """The characters among which one may move: digits, Latin letters, letters with marks, or those of the script."""
    if "0" <= c <= "9":
        return "0123456789"
    if "a" <= c <= "z":
        return next(x for x in SPOKEN if c in x) if spoken else "abcdefghijklmnopqrstuvwxyz"
    for a, b in SCRIPTS:
        if a <= c <= b:
            return _letters(a, b)
    return _other_letters().get(c) if c > "\x7f" else None


#: First and last lower-case letter (or letter of a script without case) of ranges within which letters move.
SCRIPTS = (("à", "ö"), ("ø", "ÿ"), ("ά", "ώ"), ("а", "я"), ("א", "ת"), ("ء", "ي"), ("अ", "ह"), ("ぁ", "ん"), ("ァ", "ン"), ("一", "龥"), ("가", "힣"))


@lru_cache(None)
def _letters(a: str, b: str) -> str:
    return "".join(c for c in map(chr, range(ord(a), ord(b) + 1)) if unicodedata.category(c) in ("Ll", "Lo"))


@lru_cache(None)
def _other_letters() -> dict[str, str]:
    """Each further letter, with those of its script (the first word of its Unicode name), its 256 code points and its way with case, among which it moves."""
    groups: dict[tuple, list[str]] = {}
    for c in map(chr, range(0x80, 0x20000)):
        category = unicodedata.category(c)
        if category not in ("Ll", "Lo") or any(a <= c <= b and c in _letters(a, b) for a, b in SCRIPTS):
            continue
        up = c.upper()
        case = "none" if up == c else "both" if len(up) == 1 and up.lower() == c else "odd"
        groups.setdefault((unicodedata.name(c, "?").split()[0].split("-")[0], category, ord(c) >> 8, case), []).append(c)
    return {c: letters for g in groups.values() for letters in ["".join(g)] for c in g}


def _move(key: bytes, tweak: str, text: str, *, spoken: bool = False, keep: frozenset = frozenset()) -> str:
    """Permute the digits and letters of a text, each within its alphabet; case, signs and the places in ``keep`` stay."""
    return (_move_short if len(text) <= 64 else _move_any)(key, tweak, text, spoken, keep)


def _move_any(key: bytes, tweak: str, text: str, spoken: bool, keep: frozenset) -> str:
    low = [x if len(x := c.lower()) == 1 else c for c in text]
    places, digits, bases, sets = [], [], [], []
    for i, c in enumerate(low):
        if i not in keep and (s := _alphabet(c, spoken)) and c in s:
            places.append(i)
            digits.append(s.index(c))
            bases.append(len(s))
            sets.append(s)
    out = list(text)
    if places:
        for i, d, s in zip(places, permute(key, tweak + "/" + ",".join(map(str, bases)), digits, bases), sets, strict=True):
            up = s[d].upper()
            out[i] = up if text[i] != low[i] and len(up) == 1 else s[d]
    return "".join(out)


_move_short = lru_cache(1 << 14)(_move_any)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def _walk(step, accept, value):
    """Apply a one-to-one map until the result is of the same class; within a class the map stays one-to-one."""
    while True:
        value = step(value)
        if accept(value):
            return value


def _digits_like(pattern: str, digits: str) -> str:
    own = iter(digits)
    return "".join(next(own) if c.isdigit() else c for c in pattern)


#: Private networks, within which addresses stay.
PRIVATE = [ipaddress.IPv4Network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")]


def _range(ip: ipaddress.IPv4Address) -> tuple:
    return ip.is_private, ip.is_loopback, ip.is_multicast, ip.is_reserved, ip.is_link_local


def issued(digits: str) -> bool:
    """Whether a number may be a payment card's: its check digit is right, and an issuer has its first digits and its length."""
    two, four, n = int(digits[:2]), int(digits[:4]), len(digits)
    known = (digits[0] == "4" and n in (13, 16, 19)) or (n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or 3528 <= four <= 3589)) or (n == 15 and two in (34, 37)) or (n == 14 and two in (30, 36, 38, 39)) or (16 <= n <= 19 and (four == 6011 or two in (64, 65, 62))) or (12 <= n <= 19 and two in (50, *range(56, 59)))
    return known and luhn(digits)


def mod97(iban: str) -> int:
    """The remainder that is 1 for a right IBAN."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _script(name: str) -> str | None:
    c = name[0].lower()
    return "latin" if "a" <= c <= "z" or "à" <= c <= "ÿ" else "cyrillic" if "а" <= c <= "я" else None


def _given(gender: str, value: str, nonce: int, key: bytes) -> str | None:
    """Another given name of the gender and script; None where there is no list."""
    names = GIVEN.get(_script(value) or "", {}).get(gender)
    if not names:
        return None
    name = names[_draws(key, f"given/{gender}/{nonce}", value.lower(), [len(names)])[0]]
    return name.upper() if value.isupper() and len(value) > 1 else name


def _birthday(value: str, nonce: int, key: bytes) -> str:
    """Another day of about the same year, in the same format; a date that isn't one has its digits moved."""
    year_first = len(value.split("-")[0]) == 4
    parts = re.split(r"([./-])", value)
    numbers = [int(x) for x in parts[::2]]
    y, m, d = numbers if year_first else numbers[::-1]
    swapped = not year_first and m > 12 >= d
    if swapped:
        m, d = d, m
    try:
        day = datetime.date(y, m, d).toordinal()
    except ValueError:
        return _move(key, f"birthday/{nonce}", value)
    # Days in blocks of 1,024 change places within their block.
    block, at = divmod(day, 1024)
    new = datetime.date.fromordinal(min(max(block * 1024 + permute(key, f"birthday/{nonce}/{block}", list(divmod(at, 32)), [32, 32])[0] * 32 + permute(key, f"birthday/{nonce}/{block}", list(divmod(at, 32)), [32, 32])[1], 1), datetime.date.max.toordinal()))
    m, d = (new.day, new.month) if swapped else (new.month, new.day)
    made = [new.year, m, d] if year_first else [d, m, new.year]
    return "".join(x if i % 2 else f"{made[i // 2]:0{len(x)}d}" for i, x in enumerate(parts))


#: Names that belong to nobody, under which e-mail addresses stay or are put.
RESERVED = re.compile(r"(?i)(?:^|\.)(?:example(?:\.(?:com|net|org))?|test|invalid)$")


def surrogate(kind: str, value: str, nonce: int = 0, key: bytes = KEY) -> str:
    """The replacement of an entity: another of its type, script and format; the same for the same value.

    Maps are one-to-one among values of a format, so different values have different surrogates; only given names (kinds given-f, -m, -n) are drawn from
    the list of their gender and script, so that two may meet, which is checked in each text. Where there is no list, letters move within their class and the
    last one, which in many languages tells the gender, stays. Cards keep the issuer's digits and a right check digit, IBANs
    get right check digits; addresses stay public or private; phones keep their country code; e-mail domains are moved by themselves, so people of one domain
    keep one, below a reserved name. A birthday moves within about three years.
    """
    tweak = f"{kind}/{nonce}"
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        kept = RESERVED.search(domain)
        labels, end = (domain[: kept.start()], kept[0]) if kept else (domain.rsplit(".", 1)[0], "." + domain.rsplit(".", 1)[1] + ".example")
        return ".".join(_move(key, f"{tweak}/local", x) for x in local.split(".")) + "@" + ".".join(_move(key, f"{tweak}/label", x) for x in labels.split(".")) + end
    if kind == "ip":
        ip = ipaddress.IPv4Address(".".join(str(int(x)) for x in value.split(".")))
        net = next((n for n in PRIVATE if ip in n), None)
        if net:  # only the host moves
            host, size = int(ip) - int(net.network_address), net.num_addresses
            moved = permute(key, f"{tweak}/{net}", list(divmod(host, 256)), [size // 256, 256])
            return str(net.network_address + moved[0] * 256 + moved[1])
        return str(_walk(lambda a: ipaddress.IPv4Address(bytes(permute(key, tweak, list(a.packed), [256] * 4))), lambda a: _range(a) == _range(ip) and not any(a in n for n in PRIVATE), ip))
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        moved = _walk(lambda d: d[:4] + _move(key, tweak, d[4:]), lambda d: luhn(d) == luhn(digits), digits)
        return _digits_like(value, moved)
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        code = 0
        if value.startswith("+"):
            lead = re.match(r"\+(\d+)", value)[1]
            code = 1 if digits[0] in "17" else len(lead) if len(lead) <= 3 else 2
        elif value.startswith("0"):
            code = 1
        return _digits_like(value, digits[:code] + _move(key, tweak, digits[code:]))
    if kind == "iban":
        bare = value.replace(" ", "")
        moved = bare[:2] + "00" + _move(key, tweak, bare[4:])
        own = iter(moved[:2] + f"{98 - mod97(moved):02d}" + moved[4:])
        return "".join(c if c == " " else next(own) for c in value)
    if kind == "ipv6":
        return "".join(_hex(key, tweak, x) if x != ":" else x for x in re.split("(:)", value))
    if kind == "birthday":
        return _birthday(value, nonce, key)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return _hex(key, tweak, value)
    if kind.startswith("given-") and (made := _given(kind[-1], value, nonce, key)):
        return made
    if kind == "name" or kind.startswith("given-"):
        return _move(key, tweak, value, spoken=True, keep=frozenset({len(value) - 1} if len(value) > 2 else ()))
    if kind == "address":
        return _move(key, tweak, value, spoken=True)
    lead = PREFIX.match(value)[0] if kind == "secret" else ""
    return lead + _move(key, tweak, value[len(lead) :])


#: Beginnings that tell the kind of a secret, and stay.
PREFIX = re.compile(r"(?:AKIA|gh[pousr]_|sk-|xox[abpr]-)?")


def _hex(key: bytes, tweak: str, value: str) -> str:
    if not value:
        return value
    moved = "".join("0123456789abcdef"[d] for d in permute(key, tweak, [int(c, 16) for c in value], [16] * len(value)))
    return moved.upper() if value.upper() == value and value.lower() != value else moved


#: What a match must fulfil beyond its pattern.
CHECKS = {
    "ipv6": lambda v: _is_ipv6(v),
    "card": lambda v: issued(re.sub(r"\D", "", v)),
    "iban": lambda v: mod97(v.replace(" ", "")) == 1,
}


def _blanked(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], "\0" * (b - a)]
        at = b
    return "".join([*out, text[at:]])


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans of entities with their kinds, left to right. Kinds are looked for in the order of PATTERNS; what is found is blanked for those that follow.

    Names are found after a title, or where a given name of ``GIVEN`` begins them; last come further mentions of them: the whole name, or a word of it.
    The work is linear in the length of the text: it is blanked once for each kind, and mentions are looked up word by word.
    """
    return [(a, b, kind) for a, b, kind, _ in _found(text)[0]]


def _found(text: str) -> tuple[list[tuple[int, int, str, str]], dict[str, str]]:
    """The spans with their values; and the gender of each word, in small letters, that is a given name."""
    spans: list[tuple[int, int, str, str]] = []
    names: set[str] = set()
    genders: dict[str, str] = {}
    for kind, need, pattern in _COMPILED:
        if need and not any(c in text for c in need):
            continue
        found = []
        for m in pattern.finditer(text):
            got = m.groupdict()
            group = f"{kind}_value" if got.get(f"{kind}_value") else "address_also" if got.get("address_also") else 0
            value = m[group]
            if kind in CHECKS and not CHECKS[kind](value):
                continue
            found.append(m.span(group))
            if group == "address_also":
                found.append(m.span("address_number"))
            if kind == "name":
                words = re.split(" +", value)
                told = _TITLE_GENDER.get(got.get("title") or "", "n")
                if len(words) > 1 or words[0].lower() in _BY_NAME:
                    own = _BY_NAME.get(words[0].lower(), "n")
                    genders.setdefault(words[0].lower(), told if told != "n" else own)
                names.add(value)
        if found:
            spans += [(a, b, kind, text[a:b]) for a, b in found]
            text = _blanked(text, found)
    if names:
        words = {w for n in names for w in re.split(" +", n) if len(w) > 1 and not w[0].islower()} | {n for n in names if " " not in n}
        words |= {w.upper() for w in words}
        spans += [(a, b, "name", text[a:b]) for a, b in _mentions(text, words)]
    return sorted(spans), genders


_ANY_WORD = re.compile(rf"(?<!\w){_LETTER}(?:{_LETTER})*(?:[-’'](?:{_LETTER})+)*(?!\w)")


def _mentions(text: str, words: set[str]) -> list[tuple[int, int]]:
    """Spans of these words, and of runs of them that only blanks part."""
    out: list[tuple[int, int]] = []
    for m in _ANY_WORD.finditer(text):
        a, b = m.span()
        if m[0] not in words:
            bare = re.split("[-’']", m[0])[0]  # a genitive, or a further part
            if bare == m[0] or bare not in words:
                continue
            b = a + len(bare)
        if out and out[-1][1] < a and not text[out[-1][1] : a].strip(" "):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _is_ipv6(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
        return True
    except ValueError:
        return False


def _same(kind: str, value: str) -> tuple[str, str]:
    """What makes two mentions one entity: case, and the signs between digits, don't matter. All words of names are of one kind."""
    kind = "name" if kind.startswith("given-") else kind
    return kind, re.sub(r"\D", "", value) if kind in ("phone", "card", "ssn", "number") else value.lower()


#: Draws after which a value is masked: it has nothing that moves, or its few values are all taken.
TRIES = 64


def masked(value: str) -> str:
    """Stars for letters and digits."""
    return re.sub(r"[^\W_]", "*", value)


def replace(text: str, key: bytes = KEY) -> tuple[str, list[tuple[int, int, str]], list[str]]:
    """The text with its entities replaced, the spans in the old text, and the surrogates.

    Collisions are checked over the text: a surrogate that is its own original, another original or a surrogate that another entity
    has already is drawn again; what has no other surrogate is masked. All mentions of an entity get one surrogate, in the format of the mention; a name's
    words are replaced one by one, so the surname alone gets the surname of the surrogate. A given name's surrogate has the gender that its title tells, or
    else the list that holds it.
    """
    spans, genders = _found(text)
    if not spans:
        return text, [], []

    def parts(kind: str, value: str) -> list[tuple[str, str]]:
        if kind != "name":
            return [(kind, value)]
        return [(f"given-{genders[w.lower()]}" if w.lower() in genders else "name", w) for w in re.split(" +", value)]

    values = [parts(kind, v) for _, _, kind, v in spans]
    originals = {_same(*p) for ps in values for p in ps}
    nonces: dict[tuple[str, str], int | None] = {}
    used: set[tuple[str, str]] = set()

    done: dict[tuple[str, str], str] = {}

    def one(kind: str, value: str) -> str:
        if (kind, value) in done:
            return done[kind, value]
        who = _same(kind, value)
        if who not in nonces:
            nonces[who] = None
            for n in range(TRIES):
                new = surrogate(kind, value, n, key)
                mark = _same(kind, new)
                if mark not in used and mark not in originals:
                    nonces[who] = n
                    used.add(mark)
                    done[kind, value] = new
                    return new
        done[kind, value] = masked(value) if nonces[who] is None else surrogate(kind, value, nonces[who], key)
        return done[kind, value]

    out, made, at = [], [], 0
    for (a, b, _, _), ps in zip(spans, values, strict=True):
        made.append(" ".join(one(*p) for p in ps))
        out += [text[at:a], made[-1]]
        at = b
    return "".join([*out, text[at:]]), [(a, b, kind) for a, b, kind, _ in spans], made


def _replace(key: bytes):
    schema = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = [replace(t, key) if t is not None else (None, [], []) for t in batch["text"].to_pylist()]
            columns = [batch["doc_id"], [t for t, _, _ in got], [len(s) for _, s, _ in got], [[k for _, _, k in s] for _, s, _ in got], [[a for a, _, _ in s] for _, s, _ in got], [[b for _, b, _ in s] for _, s, _ in got], [m for _, _, m in got]]
            yield pa.RecordBatch.from_arrays([columns[0], *[pa.array(c, t.type) for c, t in zip(columns[1:], list(schema)[1:], strict=True)]], schema=schema)

    return run


def replace_private(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities, and of each entity its kind, span in the old text and surrogate.

    A null text stays null and has no entities, an empty one stays empty. A value has one surrogate in all documents (unless a document had a collision).
    Repeated rows give repeated results; an empty table gives no rows; other columns don't matter. One pass without a shuffle.
    """
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_replace(key), RESULT)


def with_surrogates(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """All rows and columns, the text replaced as by ``replace_private``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at = batch.schema.get_field_index(text_col)
            made = pa.array([None if t is None else replace(t, key)[0] for t in batch[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], made, *batch.columns[at + 1 :]], names=batch.schema.names)

    return bounded(docs).mapInArrow(run, docs.schema)
