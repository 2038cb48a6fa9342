"""Personal information inside free text.

Regular expressions propose spans, checksums (Luhn, mod 97, mod 23, mod 11) confirm them, and context words before (or
behind) a span adjust its score; a span counts from THRESHOLD. Names are proposed by their shape: a given name with a
family name, a title with one, initials with one. Given names are those of a table and those that the corpus shows to
stand as the table's names do, counted over all its texts; see `learn`. Where spans overlap, the better kind stays: e-mail,
identity number, phone, address, name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrow import flat_map
from glyphmill.llm.sentences import is_card
from glyphmill.plans.lineage import cut

THRESHOLD = 1.0
#: Up to so many given names and facts learned about words are sent to the tasks; more are joined to the documents' words.
MOST_NAMES = 200_000
#: A word of the corpus is a given name from so many pairs with a capital word behind it, if these are such a share of
#: all its occurrences, and the mean log odds of their contexts are at least so high.
LEAST_PAIRS, LEAST_SHARE, LEAST_ODDS = 5, 0.6, 0.25
#: Log odds (with the prior) from which one occurrence of an unknown pair is a name by its context alone.
SURE_ODDS = 3.0
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "idno": "[ID]", "addr": "[ADDRESS]", "name": "[NAME]"}

# Titles that a family name follows; those of the second row are common words too and count at a sentence's start only.
TITLES = set("mr mrs ms miss dr prof capt sir lady lord rev col sgt lt madam sr sra srta dra don doña señor señora dn dña frau herr hr fr frl m mme mlle mm me monsieur madame mademoiselle г-н г-жа господин госпожа проф dr.".split())
START_TITLES = set("inspector captain doctor professor major sergeant colonel detective father sister".split())
# Words behind a name that tell it is a firm, a place or a ship; words before one that do.
NOT_BEHIND = re.compile(r"(?:&|and Sons|Ltd|Inc|LLC|GmbH|AG|S\.A\.|S\.L\.|Press|Bridge|Street|St|Road|Rd|Lane|Ave|Avenue|Close|Square|Station|River|Hospital|School|Museum|Company|Co)\b|&", re.I)
NOT_BEFORE = re.compile(r"(?<!\w)(?:ferry|ship|boat|steamer|vessel|yacht|schooner|port|mount|lake|st\.|saint|barco|vapor|buque|теплоход|пароход|судно|schiff|dampfer|fähre|navire|bateau|ferry|navio)\s+[\"“«„]?$", re.I)
# Function words, which are no part of a name.
FOLLOW = set(
    "can has had is was were are of or and at in on by for to from with con y en el la se que por de del на по в и не ist unter und in der im hat war et au du le o e the a an as who that which".split()
)
OPENERS = set("the this that these those it they he she we you when while although because why how who what where here there most some every no nobody one another in on at el la los las un una se der die das es ein eine le les une il elle o os as um uma".split())
_FUNCTION = FOLLOW | OPENERS

ABBREVIATED = {"u.k.", "u.s.", "e.u.", "u.n.", "s.a.", "s.l."}

_W = r"[\s​�☀-➿\U0001f300-\U0001faff]"
_CAPS = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_AT_WORD = rf"[(\[{{]{_W}?(?:at|arroba|собака|ät|AT){_W}?[)\]}}]"
_AT = rf"(?:{_W}{{0,3}}@{_W}{{0,3}}|{_W}{{0,3}}{_AT_WORD}{_W}{{0,3}})"
_HAS_AT = re.compile(rf"@|{_AT_WORD}", re.I)
_DOT = rf"(?:\.|{_W}{{0,3}}[(\[{{]{_W}?(?:dot|punto|точка|punkt|point|DOT){_W}?[)\]}}]{_W}{{0,3}})"
_EMAIL = re.compile(rf"(?<![\w.+%-])[\w][\w.+%-]*{_AT}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)*{_DOT}[^\W\d_]{{2,}}(?![\w@])", re.I)

_CLUSTER = re.compile(rf"[+(]?\d(?:[\d().+/\-]|{_W}{{1,3}}(?=[\d(+]))*\d")
_DIGITS = re.compile(r"\D+")
_LINE_BREAK = re.compile(r"[\r\n]+")
_STRAY = re.compile(rf"{_W}+")
_TAIL = re.compile(rf"(?:[.\-/(]|{_W})+$")


def _spaced(pattern: str) -> re.Pattern[str]:
    """`_` stands for white space and stray symbols."""
    return re.compile(pattern.replace("_", f"(?:{_W}{{1,3}})"), re.I)


# Identity numbers: pattern, context words, checksum. The group is the span.
def _dni(x: str) -> bool:
    d = _DIGITS.sub("", x)
    return len(d) == 8 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(d) % 23] == x[-1].upper()


def _snils(x: str) -> bool:
    d = _DIGITS.sub("", x)
    s = sum(int(c) * (9 - k) for k, c in enumerate(d[:9])) % 101 % 100
    return len(d) == 11 and s == int(d[9:])


def _nir(x: str) -> bool:
    """Mod 97; the letters of Corsican departments stand for 19 and 18."""
    d = _DIGITS.sub("", x.upper().replace("2A", "19").replace("2B", "18"))
    return len(d) == 15 and 97 - int(d[:13]) % 97 == int(d[13:])


def _tax_id(x: str) -> bool:
    """ISO 7064 mod 11, 10."""
    d, p = _DIGITS.sub("", x), 10
    for c in d[:10]:
        p = 2 * ((int(c) + p) % 10 or 10) % 11
    return len(d) == 11 and (11 - p) % 10 == int(d[10])


def luhn(x: str) -> bool:
    """Mod 10 with every second digit doubled, of a payment card."""
    d = _DIGITS.sub("", x)
    total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
    return len(d) > 7 and total % 10 == 0


def iban(x: str) -> bool:
    """Mod 97 of an account number."""
    x = re.sub(r"\W", "", x).upper()
    return len(x) > 14 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


_ID_WORDS = re.compile(r"(?:\bid\b|identity|national (?:number|insurance)|social security|insurance number|\bssn\b|\bdni\b|\bnif\b|\bnie\b|steuer-?id|steuer-?nummer|identifikationsnummer|sécurité|снилс|инн\b|паспорт|passport|pasaporte)", re.I)
_CODE_WORDS = re.compile(r"(?<![\w@.-])(?:isbn|issn|order|build|version|row|shelf|code|tomo|volume|pedido|cote|aktenzeichen|signatur|signatura|дело|заказ|шифр|номер заказа|pp?\.|vol\.|no\.|fig\.|invoice|serial)\W*(?:\w+\W+)?$", re.I)
_PHONE_WORDS = re.compile(r"(?:call|tel|phone|reached|fax|mobile|number|contact|e-?mail|erreichbar|unter|ruf|responde|teléfono|llame|отвечает|номер|телефон|тел|répond|téléphone|appel)", re.I)

IDS = [
    # DNI: eight digits and a letter
    (_spaced(r"(?<![\w.-])(\d{2}\.?\d{3}\.?\d{3}_?-?_?[A-Z])(?![\w-])"), _dni, 0.5),
    (_spaced(rf"(?<![\w-])([A-Z]{{2}}{_W}?\d{{2}}{_W}?\d{{2}}{_W}?\d{{2}}{_W}?[A-D])(?![\w-])"), None, 1.0),  # insurance number
    (_spaced(r"(?<![\d-])(\d{3}(?:-\d{2}-|_\d{2}_)\d{4})(?![\d-])"), None, 0.8),  # social security number
    (_spaced(rf"(?<![\d-])(\d{{3}}-?\d{{3}}-?\d{{3}}(?:{_W}{{1,3}}|-)?\d{{2}})(?![\d-])"), _snils, 0.3),
    (_spaced(r"(?<!\d)(\d_?\d{2}_?\d{2}_?\d[\dAB]_?\d{3}_?\d{3}_?\d{2})(?![\d])"), _nir, 0.4),
    (_spaced(r"(?<!\d)(\d{2}_?\d{3}_?\d{3}_?\d{3})(?!\d)"), _tax_id, 0.3),
]
PHONES = [
    (_spaced(r"(?<![\w+])(?:\+_?|00(?:_|-|(?=[1-9])))\d{1,3}(?:(?:_|[.\-/])?\(?\d{1,9}\)?){1,7}"), 1.0),
    (_spaced(r"(?<![\w(.-])\(?\d{3}\)?(?:_|[.-])\d{3}(?:_|[.-])\d{4}(?![\w-])"), 1.0),
    (_spaced(r"(?<![\w.-])0\d{2,4}_\d{3,4}(?:_|-)\d{4}(?![\w-])"), 1.0),
    (_spaced(r"(?<![\w.-])8(?:_|-)?\(?\d{3}\)?(?:_|-)\d{3}(?:_|-)\d{2}(?:_|-)\d{2}(?![\w-])"), 1.0),
    (_spaced(r"(?<![\w.-])0\d(?:(?:_|\.)\d{2}){4}(?![\w.-]\d)"), 1.0),
    (_spaced(r"(?<![\w.-])0\d{2,4}(?:_|/)\d{4,8}(?:-\d{1,5})?(?![\w-])"), 1.0),
    (_spaced(r"(?<![\w.-])[5-9]\d{2}(?:_\d{2}){3}(?![\w-])"), 0.8),
    (_spaced(r"(?<![\w.-])[5-9]\d{2}_\d{3}_\d{3}(?![\w-])"), 0.3),
]

_NAMED = rf"[{_CAPS}][\w’'-]*\w"


def _either(words: str) -> str:
    """Words in title case or capitals."""
    return "|".join(dict.fromkeys(x for w in words.split() for x in (w, w.upper())))


# Of each form: words without white space of which it needs one somewhere in the text (none: always tried), where it may begin, the pattern from there on.
_NUMBER = re.compile(r"\d+")
_EN_TYPES = "Street St Road Rd Lane Ln Avenue Ave Close Square Terrace Drive Court Boulevard Blvd Way Crescent Place Grove Gardens"
_EN_FLAT = _either("Flat Apt Apartment Unit Suite Floor")
_EN_BEFORE = re.compile(rf"(?:{_EN_FLAT}){_W}{{1,3}}\d+\w?,{_W}{{1,3}}$")
_FR_TYPES = "rue|allée|quai|avenue|boulevard|place|impasse|chemin|route|cours|square"
ADDRESSES = [
    (  # number, name, type
        (),
        _NUMBER,
        re.compile(rf"\d+[a-zA-Z]?{_W}{{1,3}}(?:{_NAMED}{_W}{{1,3}}){{1,2}}(?:{_either(_EN_TYPES)})(?!\w)(?:,{_W}{{1,3}}(?:{_EN_FLAT}){_W}{{1,3}}\d+\w?)?"),
    ),
    (  # number, type, name
        tuple(_FR_TYPES.split("|")),
        _NUMBER,
        re.compile(rf"\d+(?:{_W}{{1,3}}(?i:bis|ter|quater))?,?{_W}{{1,3}}(?i:{_FR_TYPES}){_W}{{1,3}}(?:(?i:du|des|de{_W}{{1,3}}la|de{_W}{{1,3}}l['’]|de|d['’]){_W}{{0,3}})?{_NAMED}(?!\w)"),
    ),
    (  # type, name, number
        ("calle", "c/", "avenida", "avda", "plaza", "pza", "paseo", "camino", "carretera", "ronda", "rua", "praça", "travessa"),
        re.compile(r"\b(?:calle|c/|avenida|avda\.|plaza|pza\.|paseo|camino|carretera|ronda|rua|praça|travessa)", re.I),
        re.compile(rf"\w+[./]?{_W}{{1,3}}(?:(?i:del|de|la|las|los|el|dos|das|do|da){_W}{{1,3}}){{0,2}}{_NAMED}(?:{_W}{{1,3}}{_NAMED}){{0,2}}?,?{_W}{{1,3}}(?:(?i:n\.?\s?[º°]|núm\.){_W}{{0,3}})?\d+(?:[a-zA-Z](?!\w))?(?:,{_W}{{1,3}}(?:\d+\.?[º°ª](?:{_W}{{1,3}}[A-Z](?!\w))?|(?i:piso){_W}{{1,3}}\d+(?:{_W}{{0,2}}[º°])?(?:{_W}[A-Z](?!\w))?|(?i:bajo)(?!\w)))?"),
    ),
    (
        ("ул.", "улиц", "просп", "пер.", "переул", "пл.", "площад", "наб.", "набереж", "бульвар", "шоссе"),
        re.compile(r"\b(?:ул\.|улиц[аеы]|просп\.|проспект|пер\.|переулок|пл\.|площадь|наб\.|набережная|бульвар|шоссе)", re.I),
        re.compile(rf"\w+\.?{_W}{{0,3}}{_NAMED}(?:{_W}{{1,3}}{_NAMED})?,{_W}{{1,3}}(?:(?i:дом|д\.){_W}{{0,3}})?\d+(?:[а-яА-Я](?!\w))?(?:,{_W}{{1,3}}(?i:кв\.|квартира){_W}{{0,3}}\d+)?"),
    ),
    (
        ("straße", "strasse", "str.", "gasse", "allee", "weg", "platz", "ufer", "damm", "ring"),
        re.compile(rf"\b[{_CAPS}]\w+(?:straße|strasse|str\.|gasse|allee|weg|platz|ufer|damm|ring|STRASSE|STRAßE|STR\.|GASSE|ALLEE|WEG|PLATZ|UFER|DAMM|RING)(?={_W}{{1,3}}\d)"),
        re.compile(rf"\w+\.?{_W}{{1,3}}\d+(?:{_W}?[a-hA-H](?!\w))?"),
    ),
]
_BLANK_LINE = re.compile(r"\n\s*\n")


def _folded() -> dict[int, str]:
    """Letters that a pattern takes for another without case, though lower() doesn't make them that one."""
    out = {}
    every = "".join(map(chr, range(0x80, 0xD800)))
    for c in {c for needs, _, _ in ADDRESSES for w in needs for c in w if c.isalpha()} | {*"abcdefghijklmnopqrstuvwxyz"}:
        out |= {ord(x): c for x in re.findall(c, every, re.I) if x.lower() != c}
    return out


_FOLD = _folded()
_TO_FOLD = re.compile("[" + "".join(map(chr, _FOLD)) + "]")


def _lower(text: str) -> str:
    """The text in small letters as patterns without case see it, each at its place."""
    if _TO_FOLD.search(text):
        text = text.translate(_FOLD)
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)



_CAP = re.compile(rf"[{_CAPS}][\w-]*")
_TITLE_CAP = re.compile(r"[гГ]-(?:н|жа|Н|ЖА)\b")
_SPACE = rf"{_W}{{1,4}}"
_FAMILY = rf"[{_CAPS}][\w]{{2,}}(?:-[{_CAPS}][\w]{{2,}})*"
_AFTER = re.compile(rf"(?P<mid>(?:{_SPACE}[{_CAPS}]\.)*){_SPACE}(?P<a>{_FAMILY})(?P<b>{_SPACE}{_FAMILY})?")
_AFTER_LINE = re.compile(rf"(?P<mid>(?:[ \t\xa0]+[{_CAPS}]\.)*)[ \t\xa0]+(?P<a>{_FAMILY})(?P<b>[ \t\xa0]+{_FAMILY})?")
_BEFORE_COMMA = re.compile(rf"({_FAMILY}(?:{_SPACE}{_FAMILY})?),{_SPACE}$")
_INITIALS = re.compile(rf"[{_CAPS}]\.(?:{_W}{{0,3}}[{_CAPS}]\.)*{_W}{{1,3}}(?P<a>{_FAMILY})")
_CARD_AUTHOR = re.compile(rf"^[ \t﻿]*(?:author|autor|auteur|автор|autora|verfasser|translator|editor|autor/a)[ \t\xa0]*[:：][ \t\xa0]*(?P<v>[^\r\n]*?)[ \t\xa0]*$", re.I | re.M)
_CARD_NAME = re.compile(rf"(?:[{_CAPS}][\w'’-]*\.?)(?:[,\s\xa0★]+(?:[{_CAPS}][\w'’-]*\.?)){{0,4}}")
_LATIN_UPPER = re.compile(r"[a-zа-яё]")
_POSSESSIVE = re.compile(r"['’]s$", re.I)


def _context(text: str, start: int, words: re.Pattern[str], reach: int = 45) -> bool:
    return bool(words.search(text, max(0, start - reach), start))


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text or _HAS_AT.search(text):
        for m in _EMAIL.finditer(text):
            yield "email", m.start(), m.end()


def _digits(text: str, s: int, e: int) -> int:
    return sum(c.isdigit() for c in text[s:e])


def _after_digits(text: str, s: int, e: int, n: int) -> int:
    """The place behind the n-th digit from s; e if there are fewer."""
    for k in range(s, e):
        n -= text[k].isdigit()
        if not n:
            return k + 1
    return e


def _disjoint(spans: Iterable[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    """Of spans that may overlap, those that cover the most digits together; if equal, the fewest, then the longest."""
    spans = sorted(set(spans), key=lambda x: (x[1], x[0]))
    ends = [e for _, e in spans]
    best, back = [(0, 0, 0)], [-1]  # of the first k spans; where the k-th is taken, how many stand before it
    for k, (s, e) in enumerate(spans):
        j = bisect_right(ends, s, 0, k)
        digits, count, length = best[j]
        with_it = digits + _digits(text, s, e), count - 1, length + e - s
        back.append(j if with_it > best[-1] else -1)
        best.append(max(best[-1], with_it))
    out, k = [], len(spans)
    while k:
        if back[k] >= 0:
            out.append(spans[k - 1])
        k = back[k] if back[k] >= 0 else k - 1
    return out[::-1]


def _fitting(text: str, s: int, e: int, starts: list[int]) -> int:
    """Where the phone number at s ends, whose pattern read on to e: before one of the sorted `starts` behind 9 of its digits.

    One of more than 15 digits runs into digits that aren't its own, and ends at a line break or, behind a plus sign,
    with its last group that fits. 0 if it has no such end.
    """
    ends = [a for a in starts[bisect_right(starts, s) : bisect_left(starts, e)] if 9 <= _digits(text, s, a) <= 15]
    if not ends and _digits(text, s, e) > 15:
        ends = [m.start() for m in _LINE_BREAK.finditer(text, s, e) if 9 <= _digits(text, s, m.start()) <= 15]
        if not ends and text[s] == "+":
            ends = [m.start() for m in _STRAY.finditer(text, s, e) if 9 <= _digits(text, s, m.start()) <= 15][-1:]
        if not ends:
            return 0
    e = min(ends, default=e)
    return e - (len(text[s:e]) - len(_TAIL.sub("", text[s:e])))


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """Identity and phone numbers. A cluster of digits may hold several; where they overlap, identity numbers stay."""
    for m in _CLUSTER.finditer(text):
        a, b = m.span()
        digits = sum(c.isdigit() for c in m.group())
        if digits < 6:
            continue
        low, high = max(0, a - 4), min(len(text), b + 5)
        around = text[low:high]
        found: dict[str, list[tuple[int, int]]] = {"idno": [], "phone": []}
        for kind, patterns in (("idno", IDS), ("phone", PHONES)):
            for entry in patterns:
                at = 0
                while k := entry[0].search(around, at):
                    s, e = k.span(1) if kind == "idno" else k.span()
                    at = k.start() + 1  # another number may begin inside
                    s, e = s + low, e + low
                    if s < a - 3 and kind == "phone" or e <= a or s >= b:
                        continue
                    score = entry[-1]
                    code = bool(_CODE_WORDS.search(text[max(0, s - 30) : s]))
                    if code:
                        at = k.end()  # nor is a part of a code a number
                    if kind == "idno":
                        score += 0.6 if entry[1] and entry[1](text[s:e]) else 0
                        score += 0.8 if _context(text, s, _ID_WORDS) else 0
                        score -= 0.8 if code else 0
                    else:
                        n = _digits(text, s, e)
                        if n < 9:
                            continue
                        if n > 15 and code:
                            at = _after_digits(text, s, e, 9) - low  # the next number's digits aren't the code's
                        score += 0.8 if _context(text, s, _PHONE_WORDS) else 0
                        score -= 1.2 if code else 0
                        if n <= 15:
                            e -= len(text[s:e]) - len(text[s:e].rstrip(" .-/\t\r\n"))
                    if score >= THRESHOLD:
                        found[kind].append((s, e))
        if not found["idno"] and not found["phone"]:
            continue
        ids = _disjoint(found["idno"], text) if len(found["idno"]) > 1 else found["idno"]
        yield from (("idno", s, e) for s, e in ids)
        whole = [x for x in found["phone"] if _digits(text, *x) <= 15]
        if len(found["phone"]) > 1 or ids or not whole:
            starts, taken = sorted({s for s, _ in [*ids, *found["phone"]]}), [e for _, e in ids]
            whole = [(s, end) for s, e in found["phone"] if (end := _fitting(text, s, e, starts))]
            after = [bisect_right(taken, s) for s, _ in whole]  # the first identity number that ends behind it
            whole = _disjoint([(s, e) for (s, e), k in zip(whole, after, strict=True) if k == len(ids) or e <= ids[k][0]], text)
        yield from (("phone", s, e) for s, e in whole)


# Cards and bank accounts: nothing but the checksum makes a number one.
_CARD = re.compile(r"[3-6]\d{3}(?:[ \xa0-]?\d{4}){2}[ \xa0-]?\d{1,7}(?![\w-])")
_ACCOUNT = re.compile(r"[A-Z]{2}\d{2}(?:[ \xa0]?[A-Z0-9]{4}){2,7}(?:[ \xa0]?[A-Z0-9]{1,3})?(?!\w)")


def _accounts(text: str) -> Iterator[tuple[str, int, int]]:
    """Card numbers that Luhn confirms and account numbers that mod 97 confirms; neither begins inside a word or number."""
    for pattern, check in ((_CARD, luhn), (_ACCOUNT, iban)):
        at = 0
        while m := pattern.search(text, at):
            s, e = m.span()
            before = text[s - 1 : s] if s else " "
            inside = before.isalnum() or before in "_+.-"
            score = 0.4 + (0.6 if not inside and check(m.group()) else 0) - (0.8 if _CODE_WORDS.search(text[max(0, s - 30) : s]) else 0)
            if score >= THRESHOLD:
                yield "idno", s, e
            at = e if score >= THRESHOLD else s + 1


def _addresses(text: str, low: str) -> Iterator[tuple[str, int, int]]:
    for needs, begins, pattern in ADDRESSES:
        if needs and not any(x in low for x in needs):
            continue
        for b in begins.finditer(text):
            s = b.start()
            m = pattern.match(text, s)
            if not m or _BLANK_LINE.search(text, s, m.end()):
                continue
            if begins is _NUMBER:
                if text[s - 1 : s].isalnum() or text[s - 1 : s] in ("-", ".", "/") and s:
                    continue
                flat = _EN_BEFORE.search(text, max(0, s - 24), s)
                s = flat.start() if flat and not _BLANK_LINE.search(text, flat.start(), s) else s
            yield "addr", s, m.end()


def _family_ok(word: str) -> bool:
    return word.lower() not in _FUNCTION


def _sentence_start(text: str, at: int) -> bool:
    before = text[max(0, at - 8) : at].rstrip("   \t\r\n​﻿\"“„«‘'(¿¡*★")
    return not before or before[-1] in ".!?…:。！？”’»\"'):—" or "\n" in text[max(0, at - 2) : at]


# --- given names and their contexts ---

_PAIR = re.compile(rf"(?<![\w.'’-])(?P<g>[{_CAPS}][^\W\d_]*[a-zß-öø-ÿа-яё](?:-[{_CAPS}]\w+)?){_SPACE}(?:[{_CAPS}]\.{_SPACE})*(?P<f>{_FAMILY})(?!\w)")
_CAP_WORD = re.compile(rf"(?<!\w)[{_CAPS}][^\W\d_]+")
_CAP_INSIDE = re.compile(rf"[{_CAPS}](?<=\w[{_CAPS}])[^\W\d_]*")
_SMALL_WORD = re.compile(r"(?<!\w)[a-zß-öø-ÿа-яё][a-zß-öø-ÿа-яё]+(?!\w)")
_TOKEN_BEFORE = re.compile(r"(\w+|[^\w\s])\s*$")
_TOKEN_AFTER = re.compile(r"\s*(\w+|[^\w\s])")


def _around(text: str, s: int, e: int) -> tuple[tuple[str, str], tuple[str, str]]:
    """What stands before and behind a pair: a word, a mark, or nothing at the edge of a paragraph."""
    before, after = text[max(0, s - 24) : s], text[e : e + 24]
    b, a = _TOKEN_BEFORE.search(before), _TOKEN_AFTER.match(after)
    return ("before", "" if not b or _BLANK_LINE.search(before[b.end(1) :]) else b.group(1).lower()), ("behind", "" if not a or _BLANK_LINE.search(after[: a.start(1)]) else a.group(1).lower())


@dataclass(frozen=True)
class Names:
    """Given names in small letters, log odds of the contexts of names, and words that the corpus has in small letters."""

    given: frozenset[str] = frozenset()
    odds: dict[tuple[str, str], float] = field(default_factory=dict)
    prior: float = 0.0
    ordinary: frozenset[str] = frozenset()

    def context(self, text: str, s: int, e: int) -> float:
        """Log odds that a pair of capital words there is a name; a context that wasn't seen says nothing."""
        return sum(self.odds.get(x, 0.0) for x in _around(text, s, e))

    @staticmethod
    def of(facts: Iterable[tuple[str, str, float]], prior: float) -> Names:
        """From (kind, word, value) of kinds `given`, `ordinary`, `before` and `behind`."""
        by: dict[str, dict[str, float]] = defaultdict(dict)
        for kind, word, value in facts:
            by[kind][word] = value
        return Names(frozenset(by["given"]), {(side, x): v for side in ("before", "behind") for x, v in by[side].items()}, prior, frozenset(by["ordinary"]))


_NO_NAMES = TITLES | START_TITLES | FOLLOW | OPENERS


def learn(texts: Iterable[str], known: Iterable[str]) -> Names:
    """Naive Bayes over the words around pairs of capital words, where pairs that begin with a known name are the labelled cases.

    A word becomes a given name if it stands as known names do in LEAST_PAIRS pairs or more. Without known names, or
    texts, nothing is learned. Of texts in memory; `learned` does the same over a table.
    """
    given = {x.strip().lower() for x in known if x}
    pairs: list[tuple[str, tuple[tuple[str, str], tuple[str, str]]]] = []
    capital: Counter[str] = Counter()
    small: Counter[str] = Counter()
    for t in texts:
        capital.update(w.lower() for w in _CAP_WORD.findall(t))
        small.update(_SMALL_WORD.findall(t))
        pairs += [(m.group("g").lower(), _around(t, m.start(), m.end())) for m in _PAIR.finditer(t)]
    yes, no = Counter(x for g, c in pairs if g in given for x in c), Counter(x for g, c in pairs if g not in given for x in c)
    n_yes = sum(g in given for g, _ in pairs)
    n_no = len(pairs) - n_yes
    if not n_yes:
        return Names(frozenset(given), {}, -math.inf, frozenset(small))
    odds = {x: round(math.log((yes[x] + 0.5) / (n_yes + 1)) - math.log((no[x] + 0.5) / (n_no + 1)), 6) for x in {*yes, *no}}
    by: dict[str, list[float]] = defaultdict(list)
    for g, c in pairs:
        by[g].append(sum(odds[x] for x in c))
    learned = {g for g, found in by.items() if g not in _NO_NAMES and len(found) >= LEAST_PAIRS and len(found) >= LEAST_SHARE * (capital[g] + small[g]) and sum(found) >= LEAST_ODDS * len(found)}
    return Names(frozenset(given | learned), odds, math.log((n_yes + 1) / (n_no + 1)), frozenset(small))


def _names(text: str, names: Names, card: bool) -> Iterator[tuple[str, int, int]]:
    after, given = _AFTER_LINE if card else _AFTER, names.given
    done = 0
    if card:
        for m in _CARD_AUTHOR.finditer(text):
            if m.group("v") and _CARD_NAME.fullmatch(m.group("v")):
                yield "name", m.start("v"), m.end("v")
    if "г-" in text or "Г-" in text:
        for m in _TITLE_CAP.finditer(text):
            f = after.match(text, m.end())
            if f and _family_ok(f.group("a")):
                yield "name", f.start("a"), f.end("a")
    for m in _CAP.finditer(text):
        s, e = m.span()
        if s < done:
            continue
        w = m.group()
        word = w.lower()
        if word in given or ("-" in word and word.split("-")[0] in given):
            f = after.match(text, e)
            ok = f is not None and _family_ok(f.group("a"))
            comma = _BEFORE_COMMA.search(text, max(0, s - 50), s)
            if NOT_BEFORE.search(text, max(0, s - 16), s):
                continue
            if ok:
                end = f.end("a")
                caps = not _LATIN_UPPER.search(text, s, end)
                if f.group("b") and _second(text, f, names, caps):
                    end = f.end("b")
                if NOT_BEHIND.match(text, end + 1) and not text[end : end + 1].isalnum() and text[end : end + 1] not in ",.;:":
                    continue
                yield "name", s, end
                done = end
            elif comma and _family_ok(comma.group(1)) and comma.group(1).lower() not in given:
                start = comma.start(1)
                mid = re.compile(rf"(?:{_SPACE}[{_CAPS}]\.(?!\w))+").match(text, e)
                yield "name", start, mid.end() if mid and not text[mid.end() : mid.end() + 3].strip(" \r\n")[:1].isupper() else e
                done = e
        elif word in TITLES:
            if len(w) == 1 and (w != "M" or text[s - 1 : s].isalnum() or text[s - 1 : s] == "-" or not _french(text, s, e) or text[e : e + 1] != "." or _INITIAL_BEFORE.search(text, max(0, s - 12), s)):
                pass
            else:
                k = e + (text[e : e + 1] == ".")
                f = after.match(text, k)
                if f and _family_ok(f.group("a")) and f.group("a").lower() not in TITLES:
                    if f.group("a").lower() in given:
                        continue  # a full name, found by itself
                    if word in ("fr", "me", "mm", "don", "major") and not _sentence_start(text, s):
                        continue
                    begin = f.start("a")
                    if f.group("mid"):
                        begin = f.start("mid") + len(f.group("mid")) - len(f.group("mid").lstrip("   \t\r\n​�"))
                    yield "name", begin, f.end("a")
                    done = f.end("a")
                continue
        elif word in START_TITLES and _sentence_start(text, s):
            f = after.match(text, e)
            if f and _family_ok(f.group("a")) and f.group("a").lower() not in given:
                yield "name", f.start("a"), f.end("a")
                done = f.end("a")
            continue
        elif not card and len(w) > 2 and text[e : e + 1].isspace() and word not in names.ordinary and word not in _FUNCTION and names.prior > -math.inf and not w.isupper():
            # an unknown word before a capital one: the context alone decides
            f = after.match(text, e)
            if f and _family_ok(f.group("a")) and not NOT_BEFORE.search(text, max(0, s - 16), s) and not (NOT_BEHIND.match(text, f.end("a") + 1) and text[f.end("a") : f.end("a") + 1] not in ",.;:"):
                if names.prior + names.context(text, s, f.end("a")) >= SURE_ODDS and not NOT_BEHIND.match(f.group("a")):
                    yield "name", s, f.end("a")
                    done = f.end("a")
                    continue
        if len(w) == 1 and text[e : e + 1] == ".":
            f = _INITIALS.match(text, s)
            if not f or not _family_ok(f.group("a")) or len(f.group("a")) < 4 or text[s : s + 4].lower() in ABBREVIATED:
                continue
            before = text[max(0, s - 3) : s]
            if before[-1:].isalnum() or before[-1:] in (".", "-", "/") or "º" in before or "°" in before or before.strip()[-1:].isdigit() or before.strip().lower() in ("z.", "u.", "d."):
                continue
            if NOT_BEHIND.match(text, f.end() + 1):
                continue
            yield "name", s, f.end()
            done = f.end()


_FRENCH = re.compile(r"\b(?:le|les|une|des|du|au|aux|est|et|ce|cet|cette|sur|dans|avec|pendant|après|depuis|sans|près|on|quand|pourquoi|mais|[ld]['’]\w+)\b", re.I)
_NOT_FRENCH = re.compile(r"\b(?:the|a|an|her|his|their|that|this|and|of|el|los|las|y|del|con|por|der|die|das|und|o|os|com|para)\b", re.I)


def _french(text: str, s: int, e: int) -> bool:
    """Whether the words around a place are French rather than another language: M. is a title there, else an initial."""
    around = text[e : e + 70]
    if len(around) < 30:
        around = text[max(0, s - 70) : s] + around
    n, other = len(_FRENCH.findall(around)), len(_NOT_FRENCH.findall(around))
    if n == other:
        around = text[max(0, s - 120) : s] + around
        n, other = len(_FRENCH.findall(around)), len(_NOT_FRENCH.findall(around))
    return n > other


_INITIAL_BEFORE = re.compile(r"(?:\b(?:with|for|and|by|of|to|from|von|mit|para|con|y|de)\s+|[A-Z]\.\s?|[:：]\s*)$")


_SPANISH = re.compile(r"\b(?:el|los|las|y|del|con|por|una|en|es|se|su|al|que|sin|sobre|da|do|dos|das|em|com|para|um|uma|na|no|não|os)\b|[íóúñãõ¿¡]", re.I)
_NOT_SPANISH = re.compile(r"\b(?:the|an|her|his|their|that|this|and|of|le|les|des|est|et|dans|der|die|das|und|ist|von)\b", re.I)


def _second(text: str, f: re.Match[str], names: Names, caps: bool) -> bool:
    """Whether the second capital word behind a given name is a second family name, as in Spanish and Portuguese text."""
    word, s, e = f.group("b").strip(), f.start("b"), f.end("b")
    if not _family_ok(word) or (caps or word.isupper()) and word.lower() in names.ordinary:
        return False
    around = text[e : e + 60] + " " + text[max(0, s - 90) : s]
    return len(_SPANISH.findall(around)) > len(_NOT_SPANISH.findall(around))


_RANK = {"email": 0, "idno": 1, "phone": 2, "addr": 3, "name": 4}


def find(text: str, names: Names) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal information in a text, by place, without overlaps."""
    card, low = is_card(text), _lower(text)
    spans = [*_emails(text), *_numbers(text), *_accounts(text), *_addresses(text, low), *_names(text, names, card)]
    taken: list[tuple[str, int, int]] = []
    starts: list[int] = []
    for kind, s, e in sorted(set(spans), key=lambda x: (_RANK[x[0]], x[1] - x[2], x[1])):
        if kind == "name":
            if m := _POSSESSIVE.search(text, s, e):
                e = m.start()
            if _BLANK_LINE.search(text, s, e):
                continue
        k = bisect_right(starts, s)
        if (not k or taken[k - 1][2] <= s) and (k == len(taken) or starts[k] >= e):
            starts.insert(k, s)
            taken.insert(k, (kind, s, e))
    return taken


def redact(text: str | None, names: Names) -> str | None:
    """The text with a placeholder for each span; everything else stays as it is."""
    if not text:
        return text
    out, at = [], 0
    for kind, s, e in find(text, names):
        out += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join([*out, text[at:]])


def _counts(texts: Iterable[str]) -> Iterator[tuple[str, str, str, int]]:
    """(kind, a, b, n) of some texts: first words of pairs with what stands `before` and `behind` the pair, words with a `capital`, letters from a capital `inside` a word on, words in `small` letters."""
    pairs: Counter[tuple[str, str, str]] = Counter()
    capital: Counter[str] = Counter()
    inside: set[str] = set()
    small: Counter[str] = Counter()
    for t in texts:
        capital.update(_CAP_WORD.findall(t))
        inside.update(_CAP_INSIDE.findall(t))
        small.update(_SMALL_WORD.findall(t))
        for m in _PAIR.finditer(t):
            pairs.update((side, m.group("g").lower(), x) for side, x in _around(t, m.start(), m.end()))
    yield from ((*x, n) for x, n in pairs.items())
    yield from (("capital", w.lower(), "", n) for w, n in capital.items())
    yield from (("inside", w.lower(), "", 1) for w in inside)
    yield from (("small", w, "", n) for w, n in small.items())


def learned(docs: DataFrame, text: str, terms: DataFrame) -> tuple[DataFrame, float]:
    """Facts (kind, word, value) for `Names.of`, and the prior, as `learn` has them, over all texts; `terms` has known names in column `n`.

    Of words in small letters, only those that also stand with a capital are facts: no others are asked for.
    """
    counted = flat_map(docs.filter(F.length(text) > 0).select(text), "kind string, a string, b string, n bigint", lambda: _counts)
    counted = cut(counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    of = lambda *kinds: counted.filter(F.col("kind").isin(*kinds))
    fact = lambda df, kind, word: df.select(F.lit(kind).alias("kind"), F.col(word).alias("word"), F.lit(0.0).alias("value"))
    facts = fact(terms, "given", "n").unionByName(fact(of("small").join(of("capital", "inside").select("a").distinct(), "a", "left_semi"), "ordinary", "a"))
    pairs = of("before", "behind").join(terms.select(F.col("n").alias("a"), F.lit(True).alias("known")), "a", "left")
    sums = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (F.col("known"), F.col("known").isNull())]
    n_yes, n_no = pairs.filter("kind = 'before'").agg(*sums).first()
    if not n_yes:
        return facts, -math.inf
    yes, no = (F.log((c + 0.5) / F.lit(n + 1.0)) for c, n in zip(sums, (n_yes, n_no), strict=True))
    odds = pairs.groupBy("kind", "b").agg(F.round(yes - no, 6).alias("value"))
    # whole millionths, whose sum doesn't depend on the order of rows
    by = pairs.join(odds, ["kind", "b"]).groupBy("a").agg(F.sum(F.col("n") * F.round(F.col("value") * 1_000_000).cast("bigint")).alias("total"), F.sum(F.when(F.col("kind") == "before", F.col("n"))).alias("found"))
    by = by.join(of("capital", "small").groupBy("a").agg(F.sum("n").alias("stands")), "a", "left").join(terms.select(F.col("n").alias("a")), "a", "left_anti")
    enough = (F.col("found") >= LEAST_PAIRS) & (F.col("found") >= LEAST_SHARE * F.coalesce("stands", F.lit(0))) & (F.col("total") >= LEAST_ODDS * 1_000_000 * F.col("found"))
    new = by.filter(enough & ~F.col("a").isin(sorted(_NO_NAMES)))
    return facts.unionByName(fact(new, "given", "a")).unionByName(odds.select("kind", F.col("b").alias("word"), "value")), math.log((n_yes + 1) / (n_no + 1))


def _terms(names: DataFrame, name: str) -> DataFrame:
    return names.select(F.lower(F.trim(F.col(name))).alias("n")).filter("length(n) > 1").distinct()


def _asked(text: str) -> set[tuple[str, str]]:
    """(kind, word) of all facts that `find` may ask for in a text."""
    after, out = _AFTER_LINE if is_card(text) else _AFTER, set()
    for m in _CAP.finditer(text):
        s, e = m.span()
        word = m.group().lower()
        out |= {("given", word), ("given", word.split("-")[0])}
        if comma := _BEFORE_COMMA.search(text, max(0, s - 50), s):
            out.add(("given", comma.group(1).lower()))
        for k in {e, e + (text[e : e + 1] == ".")}:
            if f := after.match(text, k):
                out |= {("given", f.group("a").lower()), ("ordinary", word), ("ordinary", (f.group("b") or "").strip().lower()), *_around(text, s, f.end("a"))}
    return out


def _prepared(docs: DataFrame, doc_id: str, text: str, names: DataFrame | None, name: str, most: int) -> tuple[DataFrame, Names]:
    """The documents with the facts of each where these are too many to be sent, else without; and what is sent."""
    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    terms = docs.sparkSession.createDataFrame([], "n string") if names is None else _terms(names, name)
    facts, prior = learned(chosen, "text", terms)
    some = facts.limit(most + 1).collect()
    if len(some) <= most:
        return chosen.withColumn("facts", F.lit(None).cast("array<struct<kind:string,word:string,value:double>>")), Names.of(some, prior)
    # hot words are spread over salts
    salts = 16
    salted = facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    keyed = chosen.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.hash("text"))
    asked = flat_map(keyed.filter("length(text) > 0").select("t1", "t2", "text"), "t1 bigint, t2 int, kind string, word string", lambda: lambda t1, t2, texts: ((a, b, *x) for a, b, t in zip(t1, t2, texts, strict=True) for x in _asked(t)))
    found = asked.withColumn("salt", F.pmod("t1", F.lit(salts)).cast("int")).join(salted, ["kind", "word", "salt"])
    found = found.groupBy("t1", "t2").agg(F.collect_set(F.struct("kind", "word", "value")).alias("facts"))  # words of one text
    return keyed.join(found, ["t1", "t2"], "left").select("doc_id", "text", "facts"), Names(prior=prior)


def _own(facts: list[dict] | None, sent: Names) -> Names:
    return sent if facts is None else Names.of(((x["kind"], x["word"], x["value"]) for x in facts), sent.prior)


def find_personal(docs: DataFrame, doc_id: str, text: str, names: DataFrame | None = None, name: str = "name", most_names: int = MOST_NAMES) -> DataFrame:
    """(doc_id, pii_kind, span_start, span_end) of every occurrence; offsets are code points, the end exclusive.

    `names` is a table of given names in column `name`; null and blank ones don't count. Contexts of names are learned
    from all documents. Null and empty texts give no row; equal rows give theirs once per row.
    """
    chosen, model = _prepared(docs, doc_id, text, names, name, most_names)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        return lambda ids, texts, facts: ((i, *x) for i, t, k in zip(ids, texts, facts, strict=True) for x in find(t, _own(k, model)))

    return flat_map(chosen.filter("length(text) > 0"), "doc_id bigint, pii_kind string, span_start bigint, span_end bigint", make)


def redact_personal(docs: DataFrame, doc_id: str, text: str, names: DataFrame | None = None, name: str = "name", most_names: int = MOST_NAMES) -> DataFrame:
    """(doc_id, text): every document with placeholders. Null and empty texts stay as they are."""
    chosen, model = _prepared(docs, doc_id, text, names, name, most_names)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        return lambda ids, texts, facts: ((i, redact(t, _own(k, model))) for i, t, k in zip(ids, texts, facts, strict=True))

    return flat_map(chosen, "doc_id bigint, text string", make)
