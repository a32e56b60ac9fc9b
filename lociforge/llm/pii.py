"""Personal data, also where it is disguised, with spans in the source text.

Identifiers are found in the text as it stands and again in normalised copies. Transducers make
the copies: one rewrites look-alike characters (full-width, superscript and enclosed digits and signs,
Cyrillic and Greek letters beside Latin ones, unusual spaces and dashes) and drops zero-width ones;
one decodes HTML entities and percent signs; others rewrite spelled digits, "at" / "dot" written as words
and signs or letters set apart by blanks. Each returns its edits, so a
span of a copy maps back to the source characters it came from. Spans found only there are added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


# --- identifiers ----------------------------------------------------------------------------------

def emails(text: str) -> list[Span]:
    """Every match of the address pattern, found from its "@" so that no text takes quadratic time."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            found.append(("email", begin, domain.end()))
            floor = domain.end()
        else:
            floor = max(floor, at)
        at = text.find("@", max(at + 1, floor))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def numbers(text: str) -> list[Span]:
    found = []
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    return found


def phones(text: str) -> list[Span]:
    return [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]


def identifiers(text: str) -> list[Span]:
    """Spans as the text stands, by kind in the order of ``KINDS``, then by start."""
    found = emails(text) if "@" in text else []
    if DIGITS.search(text):
        found += numbers(text)
        if "+" in text:
            found += phones(text)
    return found


# --- transducers ----------------------------------------------------------------------------------

class Edited:
    """A rewritten text with the edits that lead back to the text it came from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        pieces, at, shift = [], 0, 0
        self.begin, self.end, self.source = [], [], []  # of each edit: its range here, its range there
        for a, b, new in edits:
            pieces += [text[at:a], new]
            here = a + shift
            self.begin.append(here)
            self.end.append(here + len(new))
            self.source.append((a, b))
            shift += len(new) - (b - a)
            at = b
        self.text = "".join([*pieces, text[at:]])

    def back(self, begin: int, end: int) -> tuple[int, int]:
        """The source range of a range of this text; an edit counts as a whole."""
        return self._edge(begin, False), self._edge(end, True)

    def _edge(self, at: int, ending: bool) -> int:
        k = bisect_right(self.begin, at - ending) - 1
        if k < 0:
            return at
        a, b = self.source[k]
        if at < self.end[k] or (ending and at == self.end[k] and self.begin[k] < at):
            return b if ending else a
        return b + at - self.end[k]

    def touches(self, begin: int, end: int) -> bool:
        """Whether an edit stands in a range of this text."""
        k = bisect_right(self.begin, end - 1) - 1
        return k >= 0 and (self.end[k] > begin or (self.begin[k] == self.end[k] and self.begin[k] > begin))


#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip("асеорхуіјѕһԁԛԝАВЕКМНОРСТХУІЈЅοαικνρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijshdqwABEKMHOPCTXYIJSoaiknpuABEZHIKMNOPTYX"))
ZERO_WIDTH = "­​‌‍⁠﻿"
SPACES = "              　"
DASHES = "‐‑‒–—−﹘﹣－"
DOTS = "。｡․﹒．"
ASCII_SIGN = re.compile(r"[A-Za-z0-9@.+()_%-]")


@cache
def character_table() -> dict[str, str]:
    """What each unusual character stands for."""
    table = dict(LOOK_ALIKES) | dict.fromkeys(ZERO_WIDTH, "") | dict.fromkeys(SPACES, " ")
    table |= dict.fromkeys(DASHES, "-") | dict.fromkeys(DOTS, ".")
    for first, last in ((0x2070, 0x209C), (0x2460, 0x249B), (0xFE50, 0xFE6B), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x660, 0x669), (0x6F0, 0x6F9), (0x966, 0x96F)):
        for code in range(first, last + 1):
            char = chr(code)
            plain_form = unicodedata.normalize("NFKC", char)
            if unicodedata.decimal(char, None) is not None:
                plain_form = str(unicodedata.decimal(char))
            if len(plain_form) == 1 and ASCII_SIGN.fullmatch(plain_form):
                table.setdefault(char, plain_form)
    return table


@cache
def unusual() -> re.Pattern:
    return re.compile("[" + "".join(f"\\{c}" if c in "-]^\\" else c for c in character_table()) + "]")


def characters(text: str) -> Edited:
    """Look-alike characters rewritten; letters of other scripts only inside words with Latin letters or signs."""
    table, edits = character_table(), []
    for m in unusual().finditer(text):
        at, new = m.start(), table[m[0]]
        if m[0] in LOOK_ALIKES and not _mixed(text, at):
            continue
        edits.append((at, at + 1, new))
    return Edited(text, edits)


def _mixed(text: str, at: int) -> bool:
    """Whether the address-like word around a character has a Latin letter or digit near it."""
    near = text[max(0, at - 24) : at + 25]
    left, right = min(at, 24), min(at, 24) + 1
    a = max((near.rfind(c, 0, left) for c in " \n\t"), default=-1) + 1
    b = min((p for c in " \n\t" if (p := near.find(c, right)) >= 0), default=len(near))
    return "@" in near[a:b] or any("a" <= c.lower() <= "z" for c in near[a:b])


#: Spelled digits.
SPELLED = dict(zip("zero oh one two three four five six seven eight nine".split(), "00123456789"))
DIGIT_WORD = "|".join(SPELLED)
#: One or more digit words, a way between numbers in figures or words, a plus sign in words.
TOKEN = re.compile(rf"(?i)(?<![A-Za-z])(?:{DIGIT_WORD})+(?![A-Za-z])")
UNIT = re.compile(rf"(?i){DIGIT_WORD}")
GAP = re.compile(r"[ ,-]{1,4}")
PLUS = re.compile(rf"(?i)(?<![A-Za-z0-9])plus[ -]*(?=[0-9]|(?:{DIGIT_WORD})+(?![A-Za-z]))")
AT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*)"
DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*)"
LABEL = r"[A-Za-z0-9-]+"
SPOKEN_DOT = rf"(?:{DOT}|\x20dot\x20)"
ANY_DOT = rf"(?:{DOT}|\x20dot\x20|\.)"
#: Last labels that an address spoken without brackets has to end in: common generic ones
#: and those of countries.
TOP = (
    "com|org|net|edu|gov|mil|int|info|biz|name|mobi|asia|jobs|travel|museum|coop|aero|post|app|dev|xyz|online|site|tech|store|"
    "shop|club|live|news|blog|cloud|email|global|group|agency|digital|media|network|systems|solutions|software|academy|"
    "ac|ad|ae|af|ag|ai|al|am|ao|aq|ar|as|at|au|aw|ax|az|ba|bb|bd|be|bf|bg|bh|bi|bj|bm|bn|bo|br|bs|bt|bw|by|bz|ca|cc|cd|cf|cg|"
    "ch|ci|ck|cl|cm|cn|co|cr|cu|cv|cw|cx|cy|cz|de|dj|dk|dm|do|dz|ec|ee|eg|er|es|et|eu|fi|fj|fk|fm|fo|fr|ga|gb|gd|ge|gf|gg|gh|"
    "gi|gl|gm|gn|gp|gq|gr|gs|gt|gu|gw|gy|hk|hm|hn|hr|ht|hu|id|ie|il|im|in|io|iq|ir|is|it|je|jm|jo|jp|ke|kg|kh|ki|km|kn|kp|kr|"
    "kw|ky|kz|la|lb|lc|li|lk|lr|ls|lt|lu|lv|ly|ma|mc|md|me|mg|mh|mk|ml|mm|mn|mo|mp|mq|mr|ms|mt|mu|mv|mw|mx|my|mz|na|nc|ne|nf|"
    "ng|ni|nl|no|np|nr|nu|nz|om|pa|pe|pf|pg|ph|pk|pl|pm|pn|pr|ps|pt|pw|py|qa|re|ro|rs|ru|rw|sa|sb|sc|sd|se|sg|sh|si|sk|sl|sm|"
    "sn|so|sr|ss|st|su|sv|sx|sy|sz|tc|td|tf|tg|th|tj|tk|tl|tm|tn|to|tr|tt|tv|tw|tz|ua|ug|uk|us|uy|uz|va|vc|ve|vg|vi|vn|vu|wf|"
    "ws|ye|yt|za|zm|zw"
)
LOCAL_PART = rf"[A-Za-z0-9._%+-]{{1,64}}(?:{SPOKEN_DOT}[A-Za-z0-9._%+-]{{1,64}}){{0,8}}"
DISGUISED = re.compile(
    rf"(?i){LOCAL_PART}(?:{AT}{LABEL}(?:{ANY_DOT}{LABEL}){{1,8}}"
    rf"|\x20at\x20(?={LABEL}(?:\.{LABEL}){{0,8}}{SPOKEN_DOT}){LABEL}(?:{ANY_DOT}{LABEL}){{0,7}}{ANY_DOT}(?:{TOP})(?![A-Za-z0-9-])"
    rf"|@{LABEL}(?:{ANY_DOT}{LABEL}){{0,7}}{SPOKEN_DOT}(?:{TOP})(?![A-Za-z0-9-])"
    rf"|@{LABEL}(?:{SPOKEN_DOT}{LABEL}){{1,8}}|@{LABEL}(?:(?:{DOT}|\.){LABEL}){{1,8}})"
)
#: A local part with spoken dots before a plain "@".
DOTTED = re.compile(rf"(?i)[A-Za-z0-9._%+-]{{1,64}}(?:{SPOKEN_DOT}[A-Za-z0-9._%+-]{{1,64}}){{1,8}}@(?={LABEL})")
NUMBER_DOT = re.compile(rf"(?i)(?<=[0-9])(?:{DOT}|\x20dot\x20|\x20\.\x20)(?=[0-9])")
#: "at" and "dot" joined to their neighbours by low lines or hyphens: the part from "at" on.
JOINED = re.compile(
    rf"(?i)(?<=[A-Za-z0-9])([_-])at\1[A-Za-z0-9]+(?:(?:\1dot\1|\.)[A-Za-z0-9]+){{0,7}}\1dot\1(?:{TOP})(?![A-Za-z0-9])"
)
JOINED_SIGN = re.compile(r"(?i)([_-])(at|dot)\1")
#: Last labels behind signs that stand between blanks; country labels are words, too.
COMMON_TOP = "com|org|net|edu|gov|mil|info|biz"
SET_APART = re.compile(
    rf"(?i)(?<=[A-Za-z0-9])(?:@|\x20@\x20){LABEL}(?:(?:\.|\x20\.\x20){LABEL}){{0,7}}(?:\.|\x20\.\x20)(?:{COMMON_TOP})(?![A-Za-z0-9-])"
)
SET_APART_SIGN = re.compile(r"\x20[@.]\x20")
#: Every character of an address set apart by a blank.
LETTERS = re.compile(
    r"(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9._%+-]\x20){2,64}@(?:\x20[A-Za-z0-9-](?![A-Za-z0-9-])){1,64}"
    r"(?:\x20\.(?:\x20[A-Za-z0-9-](?![A-Za-z0-9-])){1,64}){1,8}"
)
#: Names of HTML entities of the signs in identifiers.
ENTITIES = dict(commat="@", period=".", plus="+", lowbar="_", percnt="%", lpar="(", rpar=")", hyphen="-", dash="-", nbsp=" ")
ENCODED = re.compile(
    rf"(?i)&#x0*([2-7][0-9a-f])(?![0-9a-f]);?|&#0*([0-9]{{2,3}})(?![0-9]);?|&({'|'.join(ENTITIES)});|%(2[0-9a-f]|40|5f)"
)
SIGN = re.compile(rf"(?i){AT}|{DOT}|\x20at\x20|\x20dot\x20")
#: What a text has to hold for the other transducers to find anything, and for any identifier to stand
#: in it: filters for whole batches. Digits of one number have only these signs between them.
NEXT_DIGIT = rf"[ ,().-]*(?:[0-9]|{DIGIT_WORD})"
WORDY = (
    rf"(?i)[\[({{<]\s*(?:at|dot|@|\.)\s*[\])}}>]|\x20dot\x20|(?:{DIGIT_WORD}){NEXT_DIGIT}|[0-9][ ,().-]*(?:{DIGIT_WORD})|plus[ -]*[0-9]"
    r"|[A-Za-z0-9] ?@ [A-Za-z0-9]|[A-Za-z0-9] @|[0-9] \. [0-9]|@[A-Za-z0-9-]+(?: \.|\. )|[_-]at[_-]"
)
CODED = r"(?i)&#[x0-9]|&[a-z]{4,6};|%(?:2[0-9a-f]|40|5f)"
BASIC = r"@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){12}"
WORDY_PATTERN = re.compile(WORDY)


def figures(text: str, wide: bool) -> Edited:
    """Spelled digits as figures, without what stands between two of them.

    Wide ways are up to 4 signs instead of 2, and those between a spelled digit and a figure become one space.
    """
    edits = [(m.start(), m.end(), "+") for m in PLUS.finditer(text)]
    tokens = [m.span() for m in TOKEN.finditer(text)]
    for a, b in tokens:
        edits += [(a + m.start(), a + m.end(), SPELLED[m[0].lower()]) for m in UNIT.finditer(text[a:b])]
    starts, limit = {a for a, _ in tokens}, 4 if wide else 2
    for a, b in tokens:
        gap = GAP.match(text, b)
        if gap and gap.end() in starts and len(gap[0]) <= limit:
            edits.append((b, gap.end(), ""))
        elif wide and gap and len(gap[0]) > 1 and text[gap.end() : gap.end() + 1] in FIGURES:
            edits.append((b, gap.end(), " "))
        k = a
        while wide and k > 0 and a - k < 4 and text[k - 1] in " ,-":
            k -= 1
        if a - k > 1 and text[k - 1 : k] in FIGURES:
            edits.append((k, a, " "))
    return Edited(text, apart(edits))


FIGURES = frozenset("0123456789")


def decoded(text: str) -> Edited:
    """HTML entities and percent signs that stand for visible ASCII characters or a blank, as those characters."""
    edits = []
    for m in ENCODED.finditer(text):
        code = int(m[1], 16) if m[1] else int(m[2]) if m[2] else ord(ENTITIES[m[3].lower()]) if m[3] else int(m[4], 16)
        if 32 <= code < 127:
            edits.append((m.start(), m.end(), chr(code)))
    return Edited(text, edits)


def signs(text: str) -> Edited:
    """At and dot disguises of addresses, and dots between figures, rewritten."""
    edits = [(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(text)]
    for pattern in (DISGUISED, DOTTED):
        for m in pattern.finditer(text):
            for sign in SIGN.finditer(text, m.start(), m.end()):
                new = "@" if "at" in sign[0].lower() or "@" in sign[0] else "."
                edits.append((sign.start(), sign.end(), new))
    for pattern, parts in ((JOINED, JOINED_SIGN), (SET_APART, SET_APART_SIGN)):
        for m in pattern.finditer(text):
            for sign in parts.finditer(text, m.start(), m.end()):
                edits.append((sign.start(), sign.end(), "@" if "at" in sign[0].lower() or "@" in sign[0] else "."))
    for m in LETTERS.finditer(text):
        edits += [(i, i + 1, "") for i in range(m.start(), m.end()) if text[i] == " "]
    return Edited(text, apart(edits))


def apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits in order, without those that overlap one before."""
    clean, last = [], 0
    for edit in sorted(edits):
        if edit[0] >= last:
            clean.append(edit)
            last = edit[1]
    return clean


def disguised(text: str) -> list[Span]:
    """Spans of identifiers that appear once the text is normalised, in source positions.

    Words beside a number can spoil it once rewritten, so every copy on the way is searched.
    """
    plain = decoded(text)
    odd = not plain.text.isascii() and unusual().search(plain.text)
    first = characters(plain.text) if odd else Edited(plain.text, [])
    wordy = WORDY_PATTERN.search(first.text)
    copies = [[plain, first]] if odd or plain.source else []
    if wordy:
        copies.append([plain, first, signs(first.text)])
        for wide in (False, True):
            number = figures(first.text, wide)
            if number.source:
                copies += [[plain, first, number], [plain, first, number, signs(number.text)]]
    found = []
    for stages in copies:
        for kind, a, b in identifiers(stages[-1].text):
            touched = False
            for stage in reversed(stages):
                touched |= stage.touches(a, b)
                a, b = stage.back(a, b)
            if touched:
                found.append((kind, a, b))
    return found


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: an added one may overlap base spans, but none of its kind contains it."""
    base = identifiers(text)
    added = uncovered(disguised(text), base)
    order = {kind: i for i, kind in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (order[s[0]], s[1], s[2])) if added else base


def uncovered(found: list[Span], base: list[Span]) -> list[Span]:
    """The spans that no base span and no other one found of their kind contains, once each."""
    kept, reach = [], dict.fromkeys(KINDS, -1)
    # from the left, wider ones first, base spans before equal ones
    for kind, a, rest, new in sorted([(k, a, -b, False) for k, a, b in base] + [(k, a, -b, True) for k, a, b in found], key=lambda s: s[1:]):
        if -rest > reach[kind]:
            reach[kind] = -rest
            if new:
                kept.append((kind, a, -rest))
    return kept


def written(found: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


def masked(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans by the first's kind."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in found):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


# --- Spark ----------------------------------------------------------------------------------------

def batch_spans(texts: pa.Array) -> Iterator[tuple[str | None, list[Span], list[Span]]]:
    """Text, base spans and all spans of each row; most rows are settled by four searches over the whole batch."""
    hits = [np.asarray(pc.fill_null(pc.match_substring_regex(texts, p), False)) for p in (BASIC, WORDY, unusual().pattern, CODED)]
    for value, basic, extra in zip(texts, hits[0].tolist(), (hits[1] | hits[2] | hits[3]).tolist()):
        if extra:
            text = value.as_py()
            yield text, *spans(text)
        elif basic:
            text = value.as_py()
            base = identifiers(text)
            yield text, base, base
        else:
            yield None, [], []


def find(text: Column) -> Column:
    """A struct of the base counts ``n_email, n_ip, n_card, n_phone, n_added``, ``base_sha256`` and ``spans``.

    Spans are kind:start:end in code points, end exclusive, by kind, then start. Null is the empty text.
    """
    names = [*(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans"]

    @F.arrow_udf(", ".join(f"{n} {'long' if n[:2] == 'n_' else 'string'}" for n in names))
    def values(texts: pa.Array) -> pa.Array:
        rows = []
        for _, base, every in batch_spans(texts):
            kinds = [s[0] for s in base]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            rows.append((*(kinds.count(k) for k in KINDS), len(every) - len(base), digest, written(every)))
        types = [pa.int64()] * 5 + [pa.string()] * 2
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return values(text)


def mask(text: Column) -> Column:
    """The text with all identifiers, disguised ones too, replaced by their kinds; null stays null."""

    @F.arrow_udf("string")
    def values(texts: pa.Array) -> pa.Array:
        made = {i: masked(t, every) for i, (t, _, every) in enumerate(batch_spans(texts)) if every}
        if not made:
            return texts
        hit = np.zeros(len(texts), bool)
        hit[list(made)] = True
        return pc.replace_with_mask(texts, pa.array(hit), pa.array(list(made.values()), texts.type))

    return values(text)
