"""Problem 5: personal data in message bodies, found and replaced by surrogates or typed placeholders.

Detection: formats for mail addresses, telephone and identity numbers and street addresses; names by a model of given and family
names. The model is fitted on at most ``NAMES`` distinct senders (a documented bound): it knows their name words and
the beginnings and endings that many of them share, so that it also knows names that no header holds.

Replacement: every distinct entity gets a keyed surrogate of its own type and format. Digits and letters are permuted within
their script by a format-preserving Feistel network; account, card and identity numbers keep their country, issuer or sex and
get right check digits where the original has them. Name words keep their ending, which carries the gender, and get another
beginning; an initial follows the one full name of the corpus it can stand for. The same word, number or address gets the
same surrogate wherever and however it is written. The surrogates of all spellings are compared across all entities, and those
that two share, or that are real numbers of the corpus, are drawn again until none are left.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.io import materialize
from corpusloom.operators.skew import heavy_keys, salted_join

#: Distinct senders that the name model is fitted on at most: those with the least hash.
NAMES = 50_000
#: Words that a beginning or an ending of names is shared by at least, to count as one.
SHARED = 4
#: Words that a task remembers at a time.
REMEMBERED = 200_000
#: Words of streets.
STREETS = r"(?:St\.?|Street|Ave\.?|Avenue|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?|Blvd\.?|Boulevard|Court|Ct\.?|Way|Close|Terrace|Square|Sq\.?)"

_UP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
#: Labels that may follow a town where a layout was flattened.
LABELS = r"(?:Tel|Tél|Fon|Fax|Mob|Mobile|Mail|Phone|M|T|E)\b"
_TOWN = rf"{_UP}(?:-(?:{_UP}|sur|sous|la|le|les|en|am|an|der))*(?: (?:am|an der|de|del|de la|sur) {_UP}| (?!{LABELS}){_UP}(?=[.,;)]|\s*$))?"
_EMAIL = re.compile(
    r"(?<![\w.+-])[\w.+-]*\w(?:@| ?[\[({<] ?(?:at|AT|arroba) ?[\])}>] ?)[\w-]+(?:(?:\.| ?[\[({<] ?(?:dot|DOT|punto|point|punkt) ?[\])}>] ?)[\w-]+)*(?:\.| ?[\[({<] ?(?:dot|DOT|punto|point|punkt) ?[\])}>] ?)[A-Za-z]{2,}\b"
)
_ID = re.compile(
    r"(?<![\w-])(?:[A-Z]{2}\d{2}(?:[ -]?\d{4}){2,7}(?:[ -]?\d{1,3})?|[12378] \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?|[12378]\d{12}(?:\d\d)?|\d{3}-\d{2}-\d{4}|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{16})(?![\w-])"
)
_PHONE = re.compile(
    r"(?<![\w.,/-])(?<![\w] [#])(?:"
    r"\+\d{1,3}(?:[ .-]?\(\d{1,5}\))?(?:[ ./-]?\d{1,6}){2,6}|00\d{2}(?:[ .-]?\d{1,8}){2,5}|\(\d{2,5}\)(?:[ .-]?\d{2,8}){1,3}|0\d{1,4}/\d{5,9}|0\d{2} \d{4} \d{4}|0\d(?:[ .-]\d\d){4}|0\d{4} \d{6}"
    r"|\d{3}([.-])\d{3}\1\d{4}|[6789]\d{2} \d{2} \d{2} \d{2}|[6789]\d{2} \d{3} \d{3})(?![\w/-]|[.,]\d)"
)
#: What numbers of nine bare digits are of, besides telephones.
NUMBERED = "Parcel|Package|Order|Serial|Build|Meter|Count|Code|Zähler|Paket|Auftrag|Bestellung|Colis|Compteur|Commande|Paquete|Pedido|Contador"
#: Nine bare digits are a telephone number only after a word that says so, after a name as in a signature, or alone on a line.
_BARE_PHONE = re.compile(
    rf"(?:(?:(?<!\w)(?:[Tt]el|[Tt]él|[Ff]ono|[Tt]eléfono|[Mm]óvil|[Mm]obile|[Pp]hone|[Cc]ontact|M|al|au|on|unter|oder|dial-in|[Cc]all)[.:]*|·) +|(?<!\w)(?!(?:{NUMBERED})\b)[A-ZÀ-Þ][a-zà-ÿ]+ |^[>|»\s]*)"
    rf"(?P<digits>[6789]\d{{8}})(?![\w/-]|[.,]\d)(?P<end>\s*$)?"
)
_ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?:(?:Flat|Apt\.?|Unit|Suite) \w+, )?\d+[A-Za-z]? {_UP}(?: {_UP})? {STREETS}(?:, (?:Suite|Apt\.?|Unit|Flat|Floor) \w+)?, {_UP}(?: {_UP})??(?:(?:,? [A-Z]{{2}},? \d{{5}})| [A-Z]{{1,2}}\d[\dA-Z]? \d[A-Z]{{2}}|(?=[\s.,;:)]|$))"
    rf"|\d+(?: bis| ter)?,? (?:rue|avenue|boulevard|place|allée|chemin|impasse|quai)(?: (?:de|du|des|de la|d['’]))? ?{_UP}(?: {_UP})?, \d{{5}} {_TOWN}"
    rf"|(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo|Camino)(?: (?:de|del|de la))? {_UP}(?: {_UP})?,? \d+(?:, \d+º(?: ?[A-Z])?)?, \d{{5}} {_TOWN}"
    rf"|(?:{_UP}(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer)|(?:Am|An der|Im|Auf dem|Zum|Zur) {_UP}) \d+ ?[a-z]?, \d{{5}} {_TOWN})"
)
#: A run of digits as telephone and identity numbers have; a date alone is none.
_NUMBER = re.compile(r"\d[\d ()./+-]{4,}\d")
_DATE = re.compile(r"(?:\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4})\Z")
#: What an address holds: a word of a street in English, or a postcode after a comma.
_STREET_WORDS = ("St", "Ave", "Road", "Rd", "Lane", "Ln", "Dr", "Blvd", "Boulevard", "Court", "Ct", "Way", "Close", "Terrace", "Sq")
_HOUSE = re.compile(r"\d[A-Za-z]? [A-ZÀ-ÖØ-Þ]")
_POSTCODE = re.compile(r", \d{5} ")
_NINE = re.compile(r"[6789]\d{8}")
#: A title before two capitalised words tells a name, known or not.
_TITLES = ["Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Sr", "Sig"]
_TITLED = re.compile(rf"(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Srta|Sig|Sig\.ra)\.? (?P<name>{_UP} {_UP})")
_MAIL_SIGN = re.compile(r"@|[\[({<] ?(?:at|AT|arroba) ?[\])}>]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
TYPES = ("email", "id_number", "phone", "address", "name")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


class NameModel:
    """Given and family names: the words seen, and endings and beginnings shared by at least SHARED words of a kind."""

    def __init__(self, names: list[tuple[str, str]]):
        self.words = [{fold(n[k]) for n in names if len(n[k]) > 2} for k in (0, 1)]
        self.parts: list[dict[str, tuple[str, str]]] = []
        self.begins: list[list[str]] = []
        self.ends: list[set[str]] = []
        for seen in self.words:
            # a split whose both sides are shared; of several the one whose rarer side is the most shared
            ends, begins = defaultdict(set), defaultdict(set)
            for w in seen:
                for i in range(2, len(w) - 1):
                    begins[w[:i]].add(w[i:])
                    ends[w[i:]].add(w[:i])
            split = {}
            for w in seen:
                best = max(range(2, len(w) - 1), key=lambda i: (min(len(begins[w[:i]]), len(ends[w[i:]])), -i), default=0)
                if best and min(len(begins[w[:best]]), len(ends[w[best:]])) >= SHARED:
                    split[w] = (w[:best], w[best:])
            self.parts.append(split)
            self.begins.append(sorted({a for a, _ in split.values()}))
            self.ends.append({b for _, b in split.values()})

    def kind(self, word: str) -> int | None:
        """0 a given name, 1 a family name, else None, as for words of up to two letters. Answers are remembered, as words recur."""
        if len(word) < 3:
            return None
        known = self.__dict__.setdefault("_known", {})
        if word not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[word] = self._kind(word)
        return known[word]

    def hits(self, token: str) -> tuple[tuple[str, int], ...]:
        """The name words within a piece of text without blanks, and their kind; remembered too."""
        known = self.__dict__.setdefault("_hits", {})
        found = known.get(token)
        if found is None:
            if len(known) >= REMEMBERED:
                known.clear()
            found = known[token] = tuple((w, k) for w in _WORD.findall(token) if (k := self.kind(w)) is not None)
        return found

    def following(self, k: int, key: bytes) -> dict[str, str]:
        """Each beginning's surrogate under a key: the next one in a keyed order, so one to one and never itself."""
        orders = self.__dict__.setdefault("_orders", {})
        if (k, key) not in orders:
            order = sorted(self.begins[k], key=lambda b: blake2b(b.encode(), key=key).digest())
            orders[k, key] = dict(zip(order, order[1:] + order[:1]))
        return orders[k, key]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_hits", "_orders")}

    def _kind(self, word: str) -> int | None:
        w = fold(word)
        for k in (0, 1):
            if w in self.words[k]:
                return k
        for k in (0, 1):
            if any(w[:i] in self.begin_sets[k] and w[i:] in self.ends[k] for i in range(2, len(w) - 1)):
                return k
        return None

    @property
    def begin_sets(self) -> list[set[str]]:
        if not hasattr(self, "_begin_sets"):
            self._begin_sets = [set(b) for b in self.begins]
        return self._begin_sets

    def parted(self, word: str) -> tuple[int, str, str] | None:
        k = self.kind(word)
        if k is None:
            return None
        if word in self.parts[k]:
            return k, *self.parts[k][word]
        return next(((k, word[:i], word[i:]) for i in range(2, len(word) - 1) if word[:i] in self.begin_sets[k] and word[i:] in self.ends[k]), None)


def header_names(sender: str | None) -> tuple[str, str] | None:
    """(given, family) of 'Given Family <address>' or of an address given.family@host."""
    if not sender:
        return None
    shown = re.sub(r"<[^>]*>|\"", " ", sender).strip()
    words = re.sub(r"\d+", "", shown.split("@")[0]).split(".") if "@" in shown else shown.split()
    return (words[0], words[1]) if len(words) == 2 and all(w.replace("-", "").isalpha() for w in words) else None


def fit_names(messages: DataFrame, limit: int = NAMES) -> NameModel:
    """The model of the senders and recipients with the least hash, at most ``limit`` distinct ones."""
    people = messages.select(F.explode(F.concat(F.array("sender"), F.split(F.coalesce("to_field", F.lit("")), ","))).alias("who")).filter(F.trim("who") != "")
    chosen = people.select(F.trim("who").alias("who")).distinct().orderBy(F.xxhash64("who"), "who").limit(limit)
    return NameModel([n for r in chosen.collect() if (n := header_names(r["who"]))])


def find(body: str, model: NameModel, own: dict[str, int] | None = None) -> list[tuple[int, int, str]]:
    """(begin, end, type) of the personal data of a body, in code points, not overlapping, in order.

    ``own``: folded name words of the message's own headers and their kind, known besides the model.
    """
    taken: list[tuple[int, int, str]] = []

    def free(b: int, e: int) -> bool:
        return all(e <= x or y <= b for x, y, _ in here)

    kinds = dict(hit for token in set(body.split()) for hit in model.hits(token))
    if own:
        kinds |= {w: k for w in _WORD.findall(body) if w not in kinds and len(w) > 2 and (k := own.get(fold(w))) is not None}
    signs = _MAIL_SIGN.search(body) is not None
    numbers = [m.start() for m in _NUMBER.finditer(body) if not _DATE.match(m.group())]
    nine = _NINE.search(body) is not None
    streets = _HOUSE.search(body) is not None and any(w in body for w in _STREET_WORDS)
    posts = _POSTCODE.search(body) is not None
    titled = any(t in body for t in _TITLES) and _TITLED.search(body) is not None
    at, number, many = 0, 0, len(numbers)
    for line in body.split("\n"):
        here: list[tuple[int, int, str]] = []
        if signs and _MAIL_SIGN.search(line):
            for m in _EMAIL.finditer(line):
                local, _, host = m.group().partition("@")
                listed = host.lower().startswith("lists.") or local.lower().startswith(("leave-", "unsubscribe", "noreply", "no-reply"))
                here.append((m.start(), m.end(), "" if listed else "email"))
        end, first = at + len(line), number
        while number < many and numbers[number] < end:
            number += 1
        if number > first:
            for kind, pattern, group in (("id_number", _ID, 0), ("phone", _PHONE, 0), ("phone", _BARE_PHONE, "digits"))[: 3 if nine and _NINE.search(line) else 2]:
                for m in pattern.finditer(line):
                    if pattern is _BARE_PHONE and not m.group()[: m.start("digits") - m.start()].strip(" \t>|»") and m["end"] is None:
                        continue  # begins the line, but isn't alone on it
                    if free(m.start(group), m.end(group)):
                        here.append((m.start(group), m.end(group), kind))
        if (posts and _POSTCODE.search(line)) or (streets and _HOUSE.search(line) and any(w in line for w in _STREET_WORDS)):
            here += [(m.start(), m.end(), "address") for m in _ADDRESS.finditer(line) if free(m.start(), m.end())]
        if any(w in line for w in kinds):
            # words that are part of names, and initials; what stands between two of them tells whether they are one name
            words = [(m.start(), m.end(), w, k) for m in _WORD.finditer(line) if (k := kinds.get(w := m.group())) is not None or (len(w) == 1 and w.isupper())]
            i = 0
            while i + 1 < len(words):
                (b, e, _, k), (b2, e2, _, k2) = words[i], words[i + 1]
                between = line[e:b2]
                follows = i + 2 < len(words) and words[i + 2][3] == 1 and line[e2 : words[i + 2][0]] == " "
                given_family = k == 0 and k2 == 1 and between in (" ", "\u00a0")
                family_given = k == 1 and k2 == 0 and between in (" ", "\u00a0", ", ", ",") and not follows
                initial_family = k is None and k2 == 1 and between in (". ", ".", ".\u00a0")
                if (given_family or family_given or initial_family) and free(b, e2):
                    here.append((b, e2, "name"))
                    i += 2
                else:
                    i += 1
        if titled:
            here += [(*m.span("name"), "name") for m in _TITLED.finditer(line) if free(*m.span("name"))]
        taken += [(at + b, at + e, k) for b, e, k in sorted(here) if k]
        at = end + 1
    return taken


def header_words(model: NameModel, *headers: str | None) -> dict[str, int]:
    """The folded name words of a message's own headers that ``model`` doesn't know, and their kind: 0 given, 1 family."""
    out: dict[str, int] = {}
    for header in headers:
        for who in (header or "").split(","):
            if names := header_names(who):
                for k in (0, 1):
                    if len(names[k]) > 2 and model.kind(names[k]) is None:
                        out.setdefault(fold(names[k]), k)
    return out


def normal(kind: str, text: str) -> str:
    """One form for all the ways in which an entity is written."""
    if kind == "email":
        t = re.sub(r"\s*[\[({<]\s?(?:at|arroba)\s?[\])}>]\s*", "@", text.lower())
        return re.sub(r"\s*[\[({<]\s?(?:dot|punto|point|punkt)\s?[\])}>]\s*", ".", t).replace(" ", "")
    if kind in ("phone", "id_number"):
        return re.sub(r"[^0-9A-Z+]", "", text.upper())
    words = [fold(w) for w in re.findall(r"\w+", text)]
    return " ".join(words if "," not in text or kind != "name" else words[1:] + words[:1])


def person(entity: str) -> str | None:
    """The initial and the family name of a name in its one form."""
    words = entity.split()
    return f"{words[0][0]} {' '.join(words[1:])}" if len(words) > 1 else None


#: Alphabets that letters are permuted within; letters of other scripts stay within their Unicode block.
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"]
_STREET_WORD = re.compile(rf"(?:{STREETS}|Flat|Suite|Floor|Apt|Unit|bis|ter|rue|avenue|boulevard|place|allée|chemin|impasse|quai|Calle|C|Avda|Avenida|Plaza|Paseo|Camino|Am|An|Im|Auf|Zum|Zur|dem|der|de|del|des|du|sur|la|XZ)\Z")
_STREET_END = re.compile(r"(?<=\w)(?:straße|strasse|str|weg|platz|allee|gasse|ring|damm|ufer)\Z|\Z")
#: Fixed value: the control letters of Spanish identity numbers.
CONTROL = "TRWAGMYFPDXBNJZSQVHLCKE"
_DIGITS = ALPHABETS[0]


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """The alphabet of a folded character; '' for what is no letter or digit."""
    for a in ALPHABETS:
        if c in a:
            return a
    if not c.isalpha():
        return ""
    block, kind = ord(c) & ~0x7F, unicodedata.category(c)
    return "".join(x for x in map(chr, range(block, block + 128)) if unicodedata.category(x) == kind and x.isalpha() and x.upper().lower() == x)


def _feistel(value: int, low: int, high: int, key: bytes) -> int:
    """A keyed permutation of the numbers below ``low * high``."""
    a, b = value % low, value // low
    for r in range(8):
        f = int.from_bytes(blake2b(f"{r} {low} {high} {b if r % 2 == 0 else a}".encode(), key=key, digest_size=8).digest(), "big")
        if r % 2 == 0:
            a = (a + f) % low
        else:
            b = (b + f) % high
    return a + low * b


def permuted(text: str, key: bytes) -> str:
    """Digits and letters for others of their alphabet, one to one among texts of this format; case and all else stay."""
    plain = fold_each(text)
    alphabets = [_alphabet(c) for c in plain]
    places = [i for i, s in enumerate(alphabets) if plain[i] in s]
    half = len(places) // 2
    sizes = [1, 1]
    values = [0, 0]
    for n, i in enumerate(places):
        side = int(n >= half)
        values[side] = values[side] * len(alphabets[i]) + alphabets[i].index(plain[i])
        sizes[side] *= len(alphabets[i])
    mixed = _feistel(values[0] + sizes[0] * values[1], sizes[0], sizes[1], key)
    values, out = [mixed % sizes[0], mixed // sizes[0]], list(text)
    for n in range(len(places) - 1, -1, -1):
        i, side = places[n], int(n >= half)
        c = alphabets[i][values[side] % len(alphabets[i])]
        values[side] //= len(alphabets[i])
        out[i] = c.upper() if text[i].isupper() else c
    return "".join(out)


def walked(text: str, key: bytes, valid: Callable[[str], bool] = lambda x: True) -> str:
    """``permuted`` until the result is valid and another text: one to one among the valid texts of this format.

    A text that is the only valid one of its format stays as it is.
    """
    new = permuted(text, key)
    start = new
    while (new == text or not valid(new)) and (new := permuted(new, key)) != start:
        pass
    return new


def fold_each(text: str) -> str:
    return "".join(f if len(f := fold(c)) == 1 else c for c in text)


def _luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _insee(digits: str) -> bool:
    return 1 <= int(digits[3:5]) <= 12


def id_surrogate(bare: str, key: bytes) -> str:
    """Another number of the kind of ``bare`` (letters and digits only), valid where ``bare`` is.

    Accounts keep their country, cards their first digit, French numbers the sex; social security numbers stay out of the areas
    that are never given; British numbers keep their letters. Check digits are set anew where they are right.
    """
    if re.fullmatch(r"[A-Z]{2}\d{10,}", bare):
        if _mod97(bare) != 1:
            return bare[:2] + walked(bare[2:], key)
        new = walked(bare[4:], key)
        return f"{bare[:2]}{98 - _mod97(f'{bare[:2]}00{new}'):02d}{new}"
    if re.fullmatch(r"\d{16}", bare):
        if not _luhn(bare):
            return bare[0] + walked(bare[1:], key)
        new = bare[0] + walked(bare[1:15], key)
        return next(new + c for c in _DIGITS if _luhn(new + c))
    if re.fullmatch(r"[12378]\d{12}(?:\d\d)?", bare):
        new = bare[0] + (walked(bare[1:13], key, lambda x: _insee(f"0{x}")) if _insee(bare) else walked(bare[1:13], key))
        if len(bare) == 13:
            return new
        right = int(bare[13:]) == 97 - int(bare[:13]) % 97
        return f"{new}{97 - int(new) % 97:02d}" if right else new + permuted(bare[13:], key)
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", bare):
        digits = bare[1:-1] if bare[0] in "XYZ" else bare[:-1]
        lead = bare[0] if bare[0] in "XYZ" else ""
        number = lambda d: int(str("XYZ".index(lead)) + d if lead else d)
        new = walked(digits, key)
        return lead + new + (CONTROL[number(new) % 23] if bare[-1] == CONTROL[number(digits) % 23] else bare[-1])
    if re.fullmatch(r"\d{9}", bare):
        given = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
        return walked(bare, key, given if given(bare) else lambda x: True)
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", bare):
        return bare[:2] + walked(bare[2:8], key) + bare[8]
    return walked(bare, key)


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[0].isupper() else word


def name_word(word: str, model: NameModel, key: bytes) -> str:
    """Another name with the same ending, hence gender and kind; a word that has no known ending changes within its script."""
    parted = model.parted(fold(word))
    if parted is None:
        return walked(word, key)
    k, begin, end = parted
    return _cased(model.following(k, key)[begin] + end, word)


def _key(kind: str, secret: str, attempt: int) -> bytes:
    """Mail addresses share the key of names, so that a name in an address changes like the name."""
    return blake2b(f"{secret} {kind if kind != 'email' else 'name'} {attempt}".encode(), digest_size=32).digest()


def surrogate(kind: str, text: str, model: NameModel, secret: str, attempt: int = 0, given: str | None = None) -> str:
    """The surrogate of ``text``; ``given``: the given name that an initial stands for, where it is known."""
    key = _key(kind, secret, attempt)
    if kind == "name":
        initial = lambda c: _cased(fold_each(name_word(given, model, key))[0], c) if given else walked(c, key)
        return _WORD.sub(lambda m: name_word(m.group(), model, key) if len(m.group()) > 1 else initial(m.group()), text)
    if kind == "email":
        keep = r"(?i:(?<=[\[({<])\s?(?:at|dot|arroba|punto|point|punkt)\s?(?=[\])}>])|(?:example|test|com|org|net|de|fr|es|eu)$)"
        return re.sub(rf"{keep}|[^\W\d_]+|\d+", lambda m: m.group() if re.fullmatch(keep, m.group()) or m.group().lower() in ("at", "dot") or m.end() == len(text) else name_word(m.group(), model, key), text)
    if kind == "phone":
        places = [i for i, c in enumerate(text) if c.isdigit()][-7:]
        new, out = walked("".join(text[i] for i in places), key), list(text)
        for i, c in zip(places, new):
            out[i] = c
        return "".join(out)
    if kind == "id_number":
        new = iter(id_surrogate(re.sub(r"\W", "", text), key))
        return "".join(next(new) if c.isalnum() else c for c in text)
    # words of streets stay, and the last part of a German street's name
    return re.sub(r"[^\W\d_]+|\d+", lambda m: m.group() if _STREET_WORD.match(m.group()) else walked(m.group()[: -len(x)], key) + x if (x := _STREET_END.search(m.group()).group()) else walked(m.group(), key), text)


class PersonalData:
    """Columns used: messages message_id, sender, to_field, body_text.

    Null and empty bodies hold nothing and come out as they are, with the flag 'No'. Rows without an id are rewritten too, but
    have no row in ``entities``. A message fetched again, repeated rows, extra columns and empty tables are harmless.
    ``secret`` keys the surrogates: the same secret gives the same ones in every run. If distinct surrogates can't be found in
    ``DRAWS`` rounds, as in a format with more entities than there are texts, it raises ValueError.
    """

    DRAWS = 64

    def __init__(self, messages: DataFrame, secret: str = "a local secret", names: int = NAMES):
        self.messages = messages
        self.secret = secret
        self.model = model = fit_names(messages, names)

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                rows = []
                for m, key, body, sender, to in zip(*(c.to_pylist() for c in batch.columns)):
                    if body:
                        rows += [(m, key, b, e, kind, t := body[b:e], x := normal(kind, t), person(x) if kind == "name" else None) for b, e, kind in find(body, model, header_words(model, sender, to))]
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, kinds)], ["message_id", "body_key", "begin", "stop", "pii_type", "pii_text", "entity", "person"])

        read = messages.filter(F.col("body_text").isNotNull()).select("message_id", F.xxhash64("body_text").alias("body_key"), "body_text", "sender", "to_field")
        found = read.mapInArrow(batches, "message_id string, body_key long, begin int, stop int, pii_type string, pii_text string, entity string, person string")
        self.found = materialize(found.distinct(), "entities")
        self.replaced = self._surrogates()

    def _forms(self) -> DataFrame:
        """pii_type, pii_text, entity, n, given: each way of writing each entity. An initial with a family name is the entity of
        the one full name that it can stand for (``given`` then is its given name), if the corpus has exactly one."""
        forms = materialize(self.found.groupBy("pii_type", "entity", "person", "pii_text").agg(F.count(F.lit(1)).alias("n")), "forms")
        initial = F.length(F.substring_index("entity", " ", 1)) == 1
        names = forms.filter("person IS NOT NULL")
        full = names.filter(~initial).groupBy("person").agg(F.min("entity").alias("full"), F.max("entity").alias("other")).filter("full = other").select("person", "full")
        short = names.filter(initial).join(full, "person", "left").withColumn("given", F.substring_index("full", " ", 1)).withColumn("entity", F.coalesce("full", "entity"))
        rest = forms.filter(F.col("person").isNull() | ~initial).withColumn("given", F.lit(None).cast("string"))
        columns = ["pii_type", "pii_text", "entity", "n", "given"]
        return rest.select(*columns).unionAll(short.select(*columns))

    def _surrogates(self) -> DataFrame:
        """``found`` with the surrogate of each piece; the pieces of one entity share the attempt, so they stay consistent.

        All spellings are compared in one form: entities that come out alike, or a number that is a real one of the corpus,
        are drawn again, and only these, until there are none.
        """
        forms = materialize(_with_surrogate(self._forms().withColumn("attempt", F.lit(0)), self.model, self.secret), "drawn")
        real = forms.filter(F.col("pii_type").isin("phone", "id_number")).select("pii_type", F.col("entity").alias("form")).distinct()
        for _ in range(self.DRAWS):
            shared = forms.groupBy("pii_type", "form").agg(F.min("entity").alias("stays"), F.max("entity").alias("other")).filter("stays <> other").select("pii_type", "form", "stays")
            alike = forms.join(shared, ["pii_type", "form"]).filter(F.col("entity") != F.col("stays")).select("pii_type", "entity")
            again = materialize(alike.unionAll(forms.join(real, ["pii_type", "form"], "left_semi").select("pii_type", "entity")).distinct(), "again")
            if again.isEmpty():
                break
            redrawn = _with_surrogate(forms.join(again, ["pii_type", "entity"], "left_semi").drop("surrogate", "form").withColumn("attempt", F.col("attempt") + 1), self.model, self.secret)
            forms = materialize(forms.join(again, ["pii_type", "entity"], "left_anti").unionByName(redrawn), "drawn")
        else:
            raise ValueError(f"no distinct surrogates in {self.DRAWS} rounds")
        # each piece meets the surrogate of its spelling
        keys = ["pii_type", "pii_text"]
        heavy = heavy_keys(forms, keys, "n", self.found.count())
        return salted_join(self.found.drop("entity", "person"), forms.select(*keys, "entity", "surrogate"), keys, heavy, F.struct("message_id", "begin"))

    def entities(self) -> DataFrame:
        """message_id, pii_type, pii_text: every distinct piece that is replaced."""
        return self.replaced.filter(F.col("message_id").isNotNull()).select("message_id", "pii_type", "pii_text").distinct()

    def rewritten(self, placeholders: bool = True) -> DataFrame:
        """message_id, body_text, pii_flag: each row of the messages with ``[TYPE:key]`` or surrogates in place of personal data.

        The key of a placeholder is a hash of the entity under the secret: equal for equal entities, in all messages.
        """
        mark = F.concat(F.lit("["), F.upper("pii_type"), F.lit(":"), F.substring(F.sha2(F.concat_ws(" ", F.lit(self.secret), "pii_type", "entity"), 256), 1, 8), F.lit("]"))
        pieces = self.replaced.withColumn("new", mark if placeholders else F.col("surrogate")).groupBy("body_key").agg(F.collect_set(F.struct("begin", "stop", "new")).alias("pieces"))  # bounded by the body

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                ids, bodies, all_pieces = (c.to_pylist() for c in batch.columns)
                out = []
                for body, found in zip(bodies, all_pieces):
                    for p in sorted(found or [], key=lambda p: -p["begin"]):
                        body = body[: p["begin"]] + p["new"] + body[p["stop"] :]
                    out.append(body)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string()), pa.array(["Yes" if p else "No" for p in all_pieces])], ["message_id", "body_text", "pii_flag"])

        bodies = self.messages.select("message_id", "body_text", F.xxhash64("body_text").alias("body_key"))
        sizes = materialize(bodies.groupBy("body_key").agg(F.count(F.lit(1)).alias("n")), "bodies")
        heavy = heavy_keys(sizes, ["body_key"], "n", sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])  # copies, empty bodies
        return salted_join(bodies, pieces, ["body_key"], heavy, F.col("message_id"), "left").select("message_id", "body_text", "pieces").mapInArrow(batches, "message_id string, body_text string, pii_flag string")


def _with_surrogate(df: DataFrame, model: NameModel, secret: str) -> DataFrame:
    """``df`` with ``surrogate`` and ``form``, the one form for all the ways in which the surrogate is written."""
    columns = df.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kinds, texts, attempts, given = (batch.column(columns.index(c)).to_pylist() for c in ("pii_type", "pii_text", "attempt", "given"))
            new = [surrogate(k, t, model, secret, a, g) for k, t, a, g in zip(kinds, texts, attempts, given)]
            # an initial that stands for a full name is compared as that name
            same = [normal(k, n) if not g else f"{fold(name_word(g, model, _key(k, secret, a)))} {normal(k, n).split(' ', 1)[-1]}" for k, n, a, g in zip(kinds, new, attempts, given)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string()), pa.array(same, pa.string())], [*columns, "surrogate", "form"])

    return df.mapInArrow(batches, f"{', '.join(f'{n} {t}' for n, t in df.dtypes)}, surrogate string, form string")
