"""Problem 1: what the sender of a message newly wrote, by a recursive grammar of mail layout.

A body is a sequence of blocks::

    body      := (text | quote | pasted | signature | notice | footer | postscript)* tail?
    quote     := introduction? body      every line behind a mark: > | » or an indent
    tail      := introduction body       not marked: reaches to the end of its level
    pasted    := salutation text         a second letter, without any mark
    signature := closing? name-block     up to the next other block
    notice    := a legal notice          up to an empty line
    footer    := rule? list-footer
    postscript:= "PS" text               new text within or after a signature

``blocks`` parses one level, ``parse`` the whole tree: the inside of a quote is a body without the marks. ``new_runs`` serialises
the text nodes of the outermost level: the maximal runs of words that the sender wrote; a quote's inside is never new, so there
it stays closed. A body flattened to one line is cut where the grammar lets a block begin and parsed by the same rules.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.io import materialize
from corpusloom.operators.skew import heavy_keys, salted_join

#: Phrases that close a letter.
CLOSINGS = [
    "Best", "Best regards", "Best wishes", "Cheers", "Kind regards", "Many thanks", "Many thanks and regards", "Regards", "Sincerely", "Thank you", "Thanks", "Thanks and regards", "Warm regards", "With best wishes", "Yours sincerely",
    "Atentamente", "Cordialmente", "Gracias", "Muchas gracias", "Saludos", "Saludos cordiales", "Un abrazo", "Un cordial saludo", "Un saludo",
    "Amicalement", "Bien cordialement", "Bien à vous", "Bonne journée", "Cordialement", "Merci", "Salutations",
    "Beste Grüße", "Danke", "Freundliche Grüße", "Herzliche Grüße", "Liebe Grüße", "MfG", "Mit besten Grüßen", "Mit freundlichen Grüßen", "Schöne Grüße", "Vielen Dank", "Viele Grüße",
]
#: How a letter greets.
SALUTATIONS = [
    "Hi", "Hello", "Hey", "Dear", "Good morning", "Good afternoon", "Good evening", "Hola", "Buenos días", "Buenas tardes", "Estimado", "Estimada", "Estimados", "Querido", "Querida",
    "Bonjour", "Bonsoir", "Salut", "Cher", "Chère", "Chers", "Hallo", "Guten Tag", "Guten Morgen", "Liebe", "Lieber", "Sehr geehrte", "Sehr geehrter",
]
#: Lines that devices add.
DEVICES = [
    r"Sent (?:from|with|via) (?:my|a|an) [\w ]{3,30}(?:, please excuse (?:typos|brevity|any typos))?\.?", r"Get Outlook for \w+",
    r"Enviado desde (?:mi|un|una) [\w ]{3,20}\.?", r"Envoyé (?:depuis|de) (?:mon|ma|un|une) [\w ]{3,20}\.?", r"Von (?:meinem|meiner) [\w ]{3,20} gesendet\.?", r"Gesendet von (?:meinem|meiner|unterwegs)[\w ]{0,20}\.?",
]
#: How legal notices begin.
NOTICES = [
    r"CONFIDENTIALITY NOTICE\b", r"DISCLAIMER\b", r"LEGAL NOTICE\b", r"This (?:e-?mail|message|communication) (?:and its|and any|is intended|is meant|may contain|contains|is confidential)", r"(?:[A-Z][\w-]+ ){1,3}is registered under (?:number|no\.?)\b",
    r"AVISO LEGAL\b", r"AVISO DE CONFIDENCIALIDAD\b", r"Este (?:mensaje|correo) (?:va dirigido|está dirigido|es confidencial|y sus|puede contener)",
    r"AVIS(?: LÉGAL| DE CONFIDENTIALITÉ)? ?:", r"Ce (?:message|courriel|courrier) (?:est réservé|est destiné|est confidentiel|et ses|peut contenir)",
    r"Diese (?:Nachricht|E-?Mail|Mail) (?:ist nur|ist ausschließlich|ist vertraulich|und ihre|und etwaige|kann|enthält)", r"(?:RECHTLICHER HINWEIS|VERTRAULICHKEITSHINWEIS|HINWEIS) ?:", r"Der Inhalt dieser (?:Nachricht|E-?Mail|Mail)\b",
]
#: How the footers of mailing lists begin.
FOOTERS = [
    r"You (?:get|receive|are receiving|received) this (?:mail|e-?mail|message)\b", r"To (?:unsubscribe|leave this list)\b", r"Recibe este (?:mensaje|correo)\b", r"Vous recevez ce (?:message|courriel)\b", r"Sie erhalten diese (?:Nachricht|E-?Mail|Mail)\b",
]
#: Titles of forwarded or quoted messages, between dashes.
FORWARDS = [
    "Original message", "Forwarded message", "Forwarded by", "Mensaje original", "Mensaje reenviado", "Message d'origine", "Message original", "Message transféré", "Message initial",
    "Originalnachricht", "Ursprüngliche Nachricht", "Weitergeleitete Nachricht",
]
#: Field names in the header of a quoted message.
FROM, OTHER = ["From", "De", "Von"], ["Sent", "Date", "To", "Cc", "Subject", "Enviado", "Fecha", "Para", "Asunto", "Envoyé", "À", "A", "Objet", "Gesendet", "Datum", "An", "Betreff"]

_VERB = r"(?:wrote|writes|escribió|escribe|ha escrito|a écrit|écrivait|écrit|schrieb|schreibt|ha scritto|scrive|escreveu|schreef)"
_MAIL = r"<?[\w.+%-]+@[\w.-]+\w>?"
#: Words that begin a remark like "On Monday Ann wrote: ..." instead of a name.
NOT_NAMES = [
    "On", "El", "Le", "Am", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche",
    "Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag", "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo", "Yesterday", "Hier", "Ayer", "Gestern",
]
_NAME_WORD = rf"(?!(?:{'|'.join(NOT_NAMES)})\b)[^\W\d_a-zà-ÿ](?:\.|[\w'’-]*)"
_NAME = rf"{_NAME_WORD}(?: {_NAME_WORD}){{1,3}}"
_WHO = rf"(?:{_NAME} {_MAIL}|{_NAME}|{_MAIL})"
#: Words of a date phrase, and of a whole introduction, at most.
DATE_WORDS, INTRO_WORDS = 14, 26
_DATE = rf"(?=(?:[^\s<>@:]+ ){{0,6}}?[^\s<>@:]*\d)(?:[^<>@\s]+ ){{1,{DATE_WORDS}}}?"
#: A date after On/El/Le/Am/Il, then who, then the verb; German puts the verb between; or who and the verb alone.
_DATED = rf"(?:On|El|Le|Am|Il|Em|Op) {_DATE}(?:,? ?){_WHO},? {_VERB} ?:"
_GERMAN = rf"Am {_DATE}schrieb {_WHO} ?:"
_PLAIN = rf"{_WHO} {_VERB}(?: am \d[\d. ]*\d\.?)?(?: um \d\d:\d\d(?: Uhr)?)? ?:"
_INTRO = re.compile(rf"(?:{_DATED}|{_GERMAN}|{_PLAIN})\Z")
_INTRO_FLAT = re.compile(rf"(?<![^\s])(?:{_DATED}|{_GERMAN}|{_PLAIN})(?=\s)")
#: Before marked lines, in any language: an address, or a year and a time of day.
_ATTRIBUTION = re.compile(rf"{_MAIL}|\b(?:19|20)\d\d\b.*\b\d{{1,2}}[:.h]\d\d\b")
_SENTENCE = re.compile(r"[.?!] +[A-ZÀ-Þ][a-zà-ÿ]+ [a-zà-ÿ]")
_FORWARD = rf"-{{2,}} ?(?:{'|'.join(map(re.escape, FORWARDS))}) ?-{{2,}}"
_FORWARD_LINE = re.compile(rf"\s*{_FORWARD}\s*\Z", re.I)
_FORWARD_FLAT = re.compile(rf"(?<!\S){_FORWARD}(?!\S)", re.I)
_FROM_LINE = re.compile(rf"\s*\*?(?:{'|'.join(FROM)}) ?:\*? ?\S")
_OTHER_LINE = re.compile(rf"\s*\*?(?:{'|'.join(OTHER)}) ?:\*? ?\S")
_HEADER_FLAT = re.compile(rf"(?<!\S)(?:_{{5,}} )?\*?(?:{'|'.join(FROM)}) ?:\*? [^:]{{2,90}} \*?(?:Sent|Date|Enviado|Fecha|Envoyé|Gesendet|Datum) ?:\*? ")
_RULE = re.compile(r"\s*(?:_{5,}|\*{3,}|-{3,}|={3,}|—{2,})\s*\Z")
_DELIMITER = re.compile(r"\s*(?:--|—)\s*\Z")
_LOGO = re.compile(r"\s*\[(?:image|cid|logo)[^\]]*\]\s*\Z", re.I)
_CLOSING = "|".join(re.escape(c) for c in sorted(CLOSINGS, key=len, reverse=True))
_CLOSING_LINE = re.compile(rf"\s*(?:{_CLOSING}) ?[,.!]?\s*\Z")
_SALUTATION = re.compile(rf"\s*(?:{'|'.join(SALUTATIONS)})(?:,? \w[\w.'’-]*){{1,5}} ?[,:]?\s*\Z")
_DEVICE = "|".join(DEVICES)
_DEVICE_LINE = re.compile(rf"\s*(?:{_DEVICE})\s*\Z")
_NOTICE = re.compile(rf"\s*(?:{'|'.join(NOTICES)})")
_FOOTER = re.compile(rf"\s*(?:{'|'.join(FOOTERS)})")
_POSTSCRIPT = re.compile(r"\s*P\.? ?(?:P\.? ?)?S\.? ?[:.]")
_POSTSCRIPT_FLAT = re.compile(r"(?<!\S)P\.?(?:P\.?)?S(?:\.:?|:|\.)(?=\s)")
_MARKS = ">|»"
_WORD = re.compile(r"[^ \t\r\n]+")
#: A single line like "> 40 units" compares; it isn't a quote unless an introduction says so.
_COMPARES = re.compile(r">=? ?[\d$€£~]")
#: What lines of contact details hold, and stems that only notices and footers have.
_CONTACT = re.compile(r"@\w|https?:|www\.|\+\d|\d[\d ()./-]{6,}\d| [·|•] |\b(?:Tel|Tél|Fon|Fax|Mob|Mobile|Phone)\b", re.I)
_LEGAL = re.compile(r"confiden|disclaim|recipient|destinat|empfänger|unsubscrib|abmelden|desuscri|désinscri|registered|registergericht|liab|haftung|before you print|imprim|ausdruck|virus|privileg|e-?mails? |this mail|ce courriel|este correo|diese mail", re.I)
_ADDRESS_ALONE = re.compile(rf"\s*{_MAIL}\.?\s*\Z")


@dataclass
class Node:
    """A block over the lines [begin, end) of its level; ``inside`` are the blocks of a quote."""

    kind: str
    begin: int
    end: int
    inside: list[Node] = field(default_factory=list)
    mark: str = ""


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def sender_names(sender: str | None) -> list[str]:
    """The words of a sender's name, folded, from 'Given Family <given.family@host>' or the address alone."""
    if not sender:
        return []
    shown = re.sub(r"<[^>]*>|\"", " ", sender)
    if "@" in shown:
        shown = re.sub(r"\d+", "", shown.split("@")[0]).replace(".", " ").replace("_", " ")
    return [_folded(w) for w in shown.split() if len(w) > 1]


def _name_line(line: str, names: list[str]) -> bool:
    """The sender's full name alone, or at the start of a line of contact details."""
    head = re.split(r" [·|•] | - |, ", line.strip())
    words = [_folded(w) for w in head[0].split()]
    return len(words) >= 2 and sorted(words) == sorted(names) and (len(head) > 1 or line.strip() == head[0])


def unmarked(line: str, mark: str) -> str:
    return line.removeprefix("\t") if line.startswith("\t") else line.removeprefix("    ") if mark.isspace() else line[1:].removeprefix(" ")


class _Level:
    """The lines of one level of a body, and what its productions ask of them."""

    def __init__(self, lines: list[str], names: list[str], flat: bool):
        self.lines, self.names, self.flat, self.n = lines, names, flat, len(lines)
        self.mark = ""  # set by an introduction before marked lines; other marks are told by their context

    def filled(self, i: int) -> int:
        """The first line from ``i`` on that isn't blank."""
        while i < self.n and not self.lines[i].strip():
            i += 1
        return i

    def marked(self, i: int, mark: str) -> bool:
        return i < self.n and self.lines[i].startswith(("    ", "\t") if mark.isspace() else mark)

    def quote_mark(self, i: int) -> str:
        """The mark of a quote that begins at line ``i``, else ''."""
        if self.mark and self.marked(i, self.mark):
            return self.mark
        c = self.lines[i][:1]
        if self.flat or not c or c not in _MARKS or c == self.mark:
            return ""
        more = self.marked(i + 1, c)
        if c == ">":
            return c if more or not _COMPARES.match(self.lines[i]) else ""
        return c if more and not any("|" in x[1:] for x in self.lines[i : i + 2]) else ""

    def wrapped_rest(self, i: int, mark: str) -> int:
        """Lines from ``i`` on, right after a marked line, that are the rest of it, wrapped without the mark; else 0.

        Between two marked lines they are a reply where the marked line is short, or where both it and they end a sentence.
        Before an empty line, one line may end a sentence that a long marked line left open. An address alone is never a reply.
        """
        before, j = self.lines[i - 1].rstrip(), i
        while j < self.n and j - i <= 2 and self.lines[j].strip() and not self.marked(j, mark):
            j += 1
        if not i < j <= i + 2:
            return 0
        rest, address = self.lines[j - 1].rstrip(), bool(_ADDRESS_ALONE.match(self.lines[i]))
        if self.marked(j, mark):
            return j - i if address or (len(before) >= 25 and not (before[-1] in ".?!" and rest[-1] in ".?!")) else 0
        return 1 if j == i + 1 and (j == self.n or not self.lines[j].strip()) and (address or (len(before) >= 40 and before[-1] not in ".?!:")) else 0

    def quote_end(self, i: int, mark: str) -> int:
        j = i + 1
        while j < self.n:
            step = 1 if self.marked(j, mark) else self.wrapped_rest(j, mark)
            if not step:
                break
            j += step
        return j

    def introduction(self, i: int) -> int:
        """Lines of an introduction that begins at ``i``, else 0; it may be wrapped over any number of lines."""
        first = self.lines[i].strip()
        if not (first[0].isupper() or first[0] == "<" or "@" in first or first[0].isdigit()):
            return 0
        joined, words = "", 0
        for j in range(i, self.n):
            part = self.lines[j].strip()
            words += part.count(" ") + 1
            if not part or words > INTRO_WORDS:
                return 0
            joined = f"{joined} {part}" if joined else part
            if part.endswith(":"):
                if _INTRO.match(joined):
                    return j - i + 1
                k = self.filled(j + 1)
                if k < self.n and self.lines[k][0] in _MARKS and self.quote_mark(k) and _ATTRIBUTION.search(joined) and not _SENTENCE.search(joined):
                    return j - i + 1
        return 0

    def header(self, i: int) -> int:
        """Lines of a forwarded message's title or header that begins at ``i``, else 0."""
        lines, n, begin = self.lines, self.n, i
        titled = bool(_FORWARD_LINE.match(lines[i]))
        if titled:
            i = self.filled(i + 1)
        elif _RULE.match(lines[i]) and i + 1 < n and _FROM_LINE.match(lines[i + 1]):
            i += 1
        if self.flat and i < n and _HEADER_FLAT.match(lines[i]):
            return i + 1 - begin
        if i < n and _FROM_LINE.match(lines[i]):
            fields, j = 0, i + 1
            while j < n and lines[j].strip():
                if _OTHER_LINE.match(lines[j]):
                    fields += 1
                elif not fields and j - i > 2:
                    break
                j += 1
            if fields:
                return j - begin
        return 1 if titled else 0

    def names_sender(self, line: str) -> bool:
        """The line is, or begins a block with, the sender's name, its given name or initials; of an unknown sender, a few capitalised words."""
        words = [_folded(w) for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", line)]
        if self.names and words:
            if words[0] in self.names or (len(words) == 1 and len(words[0]) <= 3 and words[0] == "".join(x[0] for x in self.names)[: len(words[0])]):
                return True
            return len(words) > 1 and len(words[0]) == 1 and words[1] in self.names
        return self._label(line)

    @staticmethod
    def _label(line: str) -> bool:
        """A few words in capitals, without the end of a sentence, as names and positions are."""
        words = line.split()
        return 0 < len(words) <= 5 and line.rstrip()[-1] not in ".?!:;" and all(w[0].isupper() or not w[0].isalpha() for w in words if len(w) > 3)

    def closes(self, i: int) -> bool:
        """Whether the closing phrase of line ``i`` ends the letter: a name or contact block follows, or no further text does."""
        j = i + 1
        if j < self.n and self.lines[j].strip():
            return self.names_sender(self.lines[j]) or bool(_CONTACT.search(self.lines[j])) or self.begins_other(j) or self.short_block(j)
        j = self.filled(j)
        return j == self.n or self.names_sender(self.lines[j]) or self.begins_other(j) or self.short_block(j)

    def short_block(self, i: int) -> bool:
        """All lines of the paragraph are labels or contact details."""
        j = i
        while j < self.n and self.lines[j].strip():
            if not (self._label(self.lines[j]) or _CONTACT.search(self.lines[j])):
                return False
            j += 1
        return j > i

    def begins_other(self, i: int) -> bool:
        """Whether something else than text begins at ``i``."""
        x = self.lines[i]
        return bool(
            self.quote_mark(i) or _POSTSCRIPT.match(x) or _NOTICE.match(x) or _FOOTER.match(x) or _RULE.match(x) or _DELIMITER.match(x) or _DEVICE_LINE.match(x) or _LOGO.match(x)
            or _CLOSING_LINE.match(x) or self.introduction(i) or self.header(i)
        )

    def prose(self, i: int) -> bool:
        """Whether the paragraph at ``i`` is running text rather than contact details, a notice or a footer."""
        words: list[str] = []
        j = i
        while j < self.n and self.lines[j].strip():
            words += self.lines[j].split()
            j += 1
        text = " ".join(words)
        if len(words) < 5 or text[-1] not in ".?!…" or _CONTACT.search(self.lines[i]) or _LEGAL.search(text):
            return False
        return sum(w[0].islower() for w in words) * 2 >= len(words)


def blocks(lines: list[str], names: list[str], flat: bool = False) -> list[Node]:
    """The blocks of one level; ``flat``: the lines are the parts of a body without line breaks."""
    level = _Level(lines, names, flat)
    out: list[Node] = []
    n, i, kind, delimited, texts, quotes = len(lines), 0, "text", False, 0, 0

    def add(k: str, begin: int, end: int, mark: str | None = None) -> None:
        nonlocal texts, quotes
        texts += k == "text"
        quotes += k == "quote"
        if out and out[-1].kind == k and out[-1].end == begin and mark is None:
            out[-1].end = end
        else:
            out.append(Node(k, begin, end, mark=mark or ""))

    while i < n:
        line = lines[i]
        if not line.strip():
            if kind in ("notice", "footer"):
                kind = "signature"
            add("blank", i, i + 1)
            i += 1
            continue
        if mark := level.quote_mark(i):
            j = level.quote_end(i, mark)
            add("quote", i, j, mark)
            i, kind, delimited = j, "text", False
            continue
        if intro := level.introduction(i) or level.header(i):
            add("introduction", i, i + intro)
            i += intro
            j = level.filled(i)
            if j < n and not flat and lines[j][0] in _MARKS:
                level.mark = lines[j][0]
            elif j < n and lines[j].startswith(("    ", "\t")):
                level.mark = "    "
            else:
                if i < n:
                    add("quote", i, n, "")
                break
            if j > i:
                add("blank", i, j)
                i = j
            continue
        apart = flat or not out or out[-1].kind in ("blank", "rule")
        if _POSTSCRIPT.match(line):
            kind = "text"
        elif _NOTICE.match(line) and (kind != "text" or apart):
            kind = "notice"
        elif _FOOTER.match(line) and out and (kind != "text" or apart):
            kind = "footer"
        elif _RULE.match(line) and i + 1 < n and (_NOTICE.match(lines[i + 1]) or _FOOTER.match(lines[i + 1])):
            add("rule", i, i + 1)
            i += 1
            continue
        elif kind == "text" and not flat and texts and not quotes and apart and _SALUTATION.match(line):
            kind = "pasted"  # a second letter begins
        elif kind in ("text", "pasted"):
            if _DELIMITER.match(line):
                kind, delimited = "signature", True
            elif _CLOSING_LINE.match(line):
                kind = "signature" if level.closes(i) else kind
            elif _DEVICE_LINE.match(line) or _LOGO.match(line) or _name_line(line, names):
                kind = "signature"
            elif i + 1 < n and names and " " in line and _name_line(f"{line.strip()} {lines[i + 1].strip()}", names) and re.search(r" [·|•] ", line):
                kind = "signature"
        elif kind == "signature" and not flat and not delimited and apart and level.prose(i):
            kind = "text"  # a letter goes on after a signature or a notice
        add(kind, i, i + 1)
        i += 1
    return out


def parse(lines: list[str], names: list[str]) -> list[Node]:
    """The whole tree: each quote is opened, its marks are taken off, and its inside is parsed as a body; any depth."""
    top = blocks(lines, names)
    open_ = [(node, lines) for node in top if node.kind == "quote"]
    while open_:
        node, around = open_.pop()
        inside = around[node.begin : node.end]
        if node.mark:
            marked = ("    ", "\t") if node.mark.isspace() else node.mark
            inside = [unmarked(x, node.mark) if x.startswith(marked) else x for x in inside]
        node.inside = blocks(inside, [])
        open_ += [(x, inside) for x in node.inside if x.kind == "quote"]
    return top


_NOTICE_FLAT = re.compile(rf"(?<!\S)(?:[*_]{{5,}}\s+|-{{3,}}\s+)?(?:{'|'.join(NOTICES)})")
_FOOTER_FLAT = re.compile(rf"(?<!\S)(?:[*_]{{5,}}\s+|-{{3,}}\s+)?(?:{'|'.join(FOOTERS)})")
_DEVICE_FLAT = re.compile(rf"(?<!\S)(?:{_DEVICE})(?=\s|\Z)")
_LOGO_FLAT = re.compile(r"(?<!\S)\[image[^\]]*\]")
_CLOSING_LAST = re.compile(rf"(?<!\S)(?:{_CLOSING}) ?[,.!]?\s*\Z")


def _each_folded(text: str) -> str:
    """Folded character by character, so that places stay the same."""
    return "".join(f if len(f := _folded(c)) == 1 else c for c in text) if not text.isascii() else text.lower()


def flat_lines(text: str, names: list[str]) -> list[str]:
    """A body without line breaks, cut where the grammar lets a block begin; joined again, the parts are the text."""
    cuts: set[int] = set()
    stop = len(text)
    for pattern in (_INTRO_FLAT, _FORWARD_FLAT, _HEADER_FLAT):
        if m := pattern.search(text, 0, stop):
            cuts |= {m.start(), m.end()} if pattern is not _HEADER_FLAT else {m.start()}
            stop = m.start()
    own = text[:stop]
    later = [m for p in (_NOTICE_FLAT, _FOOTER_FLAT) for m in p.finditer(own)]
    for m in later:  # a rule before it is a part by itself
        cuts |= {m.start()} | ({m.start() + r.end()} if (r := re.match(r"[*_-]{3,}\s+", m.group())) else set())
    cuts |= {m.start() for m in _POSTSCRIPT_FLAT.finditer(own)}
    for p in (_DEVICE_FLAT, _LOGO_FLAT):
        for m in p.finditer(own):
            cuts |= {m.start(), m.end()}
    # a signature: a closing or a dash and the sender's name; the full name before contact details, or last of a sentence
    given = rf"(?:{'|'.join(re.escape(x) for x in names)})" if names else r"(?!)"
    full = rf"(?:{'|'.join(re.escape(' '.join(p)) for p in (names, names[::-1]))})" if len(names) > 1 else r"(?!)"
    folded = _each_folded(own)
    for pattern in (rf"(?<!\S)(?:{_folded(_CLOSING)}) ?[,.!]?\s+(?={given}\b)", rf"(?<!\S)(?:--|—)\s+(?={given}\b)", rf"(?<!\S){full}(?=\s+[·|•]\s)", rf"(?<=[.!?:)]\s){full}(?=\s*\Z)"):
        for m in re.finditer(pattern, folded):
            cuts |= {m.start(), m.end()}
    for end in (len(own), min((m.start() for m in later), default=len(own))):  # a closing before the end, or a notice
        if m := _CLOSING_LAST.search(own, 0, end):
            cuts |= {m.start(), m.end()}
    blank = " \t\r\n"
    edges = [0, *sorted(c for c in cuts if 0 < c < len(text) and (text[c - 1] in blank or text[c] in blank)), len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:])]


@dataclass
class Layout:
    """Words of a body by number: ``runs`` of new text, places where a pasted text may begin, and ends of paragraphs."""

    words: list[str]
    runs: list[tuple[int, int]]
    starts: list[int]
    ends: list[int]


def layout(body: str | None, sender: str | None) -> Layout:
    if not body or not body.strip():
        return Layout([], [], [], [])
    names = sender_names(sender)
    words: list[str] = []
    new: list[bool] = []
    starts: list[int] = []
    ends: list[int] = []
    flat = "\n" not in body.strip()
    lines = flat_lines(body, names) if flat else [x.rstrip("\r") for x in body.split("\n")]
    text = [False] * len(lines)
    for node in blocks(lines, names, flat):
        if node.kind == "text":
            text[node.begin : node.end] = [True] * (node.end - node.begin)
    for line, is_new in zip(lines, text):
        own = _WORD.findall(line)
        if own:
            starts.append(len(words))
        elif words:
            ends.append(len(words) - 1)
        words += own
        new += [is_new] * len(own)
    if flat:
        starts, ends = [i for i in range(1, len(words)) if words[i - 1][-1] in ".?!:,;)"], []
    runs, begin = [], None
    for i, is_new in enumerate([*new, False]):
        if is_new and begin is None:
            begin = i
        elif not is_new and begin is not None:
            runs.append((begin, i - 1))
            begin = None
    return Layout(words, runs, starts, ends)


def new_runs(body: str | None, sender: str | None) -> list[tuple[int, int]]:
    """(first_word, last_word) of the maximal runs of words that the layout shows as newly written.

    Null, empty and blank bodies have none. A null sender has no name to look for; all else is found all the same.
    """
    return layout(body, sender).runs


#: Words that a text pasted without any mark has at least, to be told from a stock phrase.
PASTED = 8
#: What a pasted text and the own text of another message have in common.
KEYS = ["thread_id", "key", "n_words"]


_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687 % ((1 << 61) - 1)


class _Spans:
    """Keys of any span of words in constant time: a polynomial over the words' hashes, from prefix sums."""

    def __init__(self, words: list[str], first: int, last: int):
        self.first, self.sums, self.powers = first, [0], [1]
        for w in words[first : last + 1]:
            self.sums.append((self.sums[-1] * _BASE + xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))) % _PRIME)
            self.powers.append(self.powers[-1] * _BASE % _PRIME)

    def key(self, a: int, b: int) -> int:
        a, b = a - self.first, b - self.first + 1
        return (self.sums[b] - self.sums[a] * self.powers[b - a]) % _PRIME


def _rows(message: str, sender: str | None, body: str | None) -> Iterator[tuple[str, int, int | None, int | None, int | None]]:
    """(message_id, kind, first, last, key): 0 a run; 1 the beginning of the own text, up to the end of a paragraph; 2 the rest of a run from a place on."""
    x = layout(body, sender)
    for n, (first, last) in enumerate(x.runs):
        yield message, 0, first, last, None
        if last - first + 1 < PASTED:
            continue
        spans = _Spans(x.words, first, last)
        for p in x.starts[bisect_right(x.starts, first) : bisect_right(x.starts, last - PASTED + 1)]:
            yield message, 2, p, last, spans.key(p, last)
        if n == 0:
            for end in {*x.ends[bisect_left(x.ends, first + PASTED - 1) : bisect_left(x.ends, last)], last}:
                yield message, 1, first, end, spans.key(first, end)


def newly_written(messages: DataFrame) -> DataFrame:
    """message_id, first_word, last_word; columns used: message_id, thread_id, sender, body_text.

    Text that ends a run and is, word for word, the beginning of the own text of another message of the thread (at least PASTED
    words, up to the end of a paragraph) was pasted without a mark and isn't new. The two meet on the thread and a hash of the
    words and their number, so a long thread is never gathered. A message fetched again gives the same rows once. Rows without an id are left
    out, a null thread has no other messages; repeated rows, extra columns and an empty table are harmless. Bodies are parsed
    where they are read; only word numbers and hashes are shuffled.
    """
    schema = "message_id string, thread_id string, kind int, first_word int, last_word int, key long"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(m, t, *rest) for m, t, s, b in zip(*(c.to_pylist() for c in batch.columns)) for (_, *rest) in _rows(m, s, b)]
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["message_id", "thread_id", "kind", "first_word", "last_word", "key"])

    read = messages.filter(F.col("message_id").isNotNull()).select("message_id", "thread_id", "sender", "body_text")
    rows = materialize(read.mapInArrow(batches, schema), "layout").withColumn("n_words", F.col("last_word") - F.col("first_word") + 1)
    whole = rows.filter("kind = 1 AND thread_id IS NOT NULL").groupBy(*KEYS).agg(F.min("message_id").alias("one"), F.max("message_id").alias("other"))
    rest = rows.filter("kind = 2 AND thread_id IS NOT NULL").select("message_id", "thread_id", "key", "n_words", "first_word", "last_word").distinct()
    sizes = materialize(rest.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), "sizes")
    heavy = heavy_keys(sizes, KEYS, "n", sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    met = salted_join(rest, whole, KEYS, heavy, F.col("message_id")).filter((F.col("one") != F.col("message_id")) | (F.col("other") != F.col("message_id")))
    pasted = met.groupBy("message_id", "last_word").agg(F.min("first_word").alias("from_word"))
    runs = rows.filter("kind = 0").select("message_id", "first_word", "last_word").distinct()
    last = F.coalesce(F.col("from_word") - 1, F.col("last_word")).cast("int")
    return runs.join(pasted, ["message_id", "last_word"], "left").select("message_id", "first_word", last.alias("last_word"))
