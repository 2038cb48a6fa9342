"""Sentence boundaries across languages and scripts.

A text falls into blocks at blank lines. In a block, quotations and brackets are closed spans, found in one pass with a
stack, and every terminator outside of them, or closing one, is a gap. Each gap gets a score: evidence for a sentence's
end minus evidence against it. Spaced scripts: the word before (abbreviations, initials, ordinals) and the words behind
(case, reporting verbs, continuing words) give the evidence. Chinese and Japanese: the text on both sides of a gap is cut
into words by the cheapest path through a lattice of dictionary words, and final particles, words that leave a clause
open, opening words and words that go on give it; behind a quotation the words behind decide. The cheapest path through
the lattice of a block's gaps then chooses the cuts: joining costs a gap's score, cutting its negative, and a unit of a
single word costs SHORT. Thai parts its sentences by white space, without a lattice.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrow import flat_map

# Words by language. Abbreviations that never end a sentence, without their last full stop.
NEVER_FINAL = {
    "en": "al mr mrs ms dr prof capt rev gen col sgt lt hon messrs cf vs viz e.g i.e fig figs vol vols pp ch approx ca no nos tel ext jan feb mar apr jun jul aug sep sept oct nov dec",
    "es": "sra srta sr dra dn dña ud uds pág págs núm núms art cap p.ej ej avda av ee",
    "ru": "стр рис гл см ср им просп пр ул пер пл наб ш кв д корп стр т тов проф акад тел т.е т.н г-н г-жа напр обл",
    "de": "z z.b d.h u.a nr bd hr fr hrn dipl ing abb kap vgl bzw evtl ca str.nr tel geb s",
    "fr": "m mm mme mlle mgr t p p.ex ex chap fig n°",
    "pt": "sr sra dr dra prof profa pág págs vol vols art av p.ex",
    "hi": "डॉ श्री प्रो",
}
# Abbreviations that may end a sentence, if a new one begins behind them.
MAYBE_FINAL = {"en": "etc a.m p.m inc ltd co corp jr sr bros st ave rd blvd ln u.s u.k", "es": "etc uu ee.uu", "ru": "т.д т.п г гг в вв руб", "de": "usw str", "fr": "etc", "pt": "etc"}
# Abbreviations that only a number makes one.
WITH_NUMBER = set("no nos vol vols fig figs ch pp p t s art cap kap bd nr ca mar jun dec sep sept oct д т г кв стр".split())
# Words that tell who speaks; behind a quotation they go on with it.
REPORTING = set(
    "said says asked asks wondered cried replied answered whispered shouted thought added dijo preguntó respondió gritó añadió susurró exclamó"
    " сказал сказала спросил спросила ответил ответила крикнул крикнула прошептал подумал fragte sagte rief antwortete flüsterte meinte dachte"
    " demanda dit répondit cria murmura ajouta disse perguntou respondeu gritou sussurrou قال قالت سأل سألت पूछा कहा".split()
)
# Words that go on after an ellipsis in texts whose case tells nothing.
CONTINUING = set("then and y luego и а но und dann et puis e depois mas pero but".split())
# Words that open a sentence behind an abbreviation written in capitals.
OPENERS = set(
    "the a an this that these those it its he she they we you i his her their our my when while although because if why how who what where here there most some every no nobody"
    " one another in on at after before during without with from over along by el la los las un una se cuando der die das es ein eine le les un une on il elle o os as um uma".split()
)
GERMAN_MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())

# A dictionary of the closed classes of words at the edges of sentences in spaceless scripts: final particles and endings, particles
# and copulas that go on, conjunctions, pronouns and question words that open, verbs of saying.
FINAL_WORDS = "か よ ね な ぞ さ わ だ た です ます でした ました だった だろう でしょう のだ のだろうか そうだ ない ません 了 吗 呢 吧 啊 呀 的 过 着".split()
GOING_ON = "と って という といって との は が を に の も へ で や から まで より など 、 ， ； ： と言った と聞いた とか だ です である 的 地 得 是".split()
OPENING = "とても とにかく ところが ところで とうとう ときどき そして しかし なぜ その この あの それ これ 彼 彼女 私 でも だから だが では もし もう まだ はい いいえ 为什么 但是 而且 所以 因为 如果 虽然 据说 这 那 他 她 我 你 我们 他们 谁 每 在".split()
# Beside them at gaps outside quotations: words that begin like a word going on, greetings, words that leave a clause open.
MORE_OPENING = (
    "とりあえず とんでもない どうして もちろん もっと もしもし もともと はっきり はじめ はやく はたして はは にっこり にわかに にぎやか のんびり のろのろ がっかり がんばれ がんばって へえ へん"
    " やはり やっぱり やっと やがて やめろ やめて やあ できる できた できない でかい それでは からだ よりによって なぜなら なるほど だめ だって だれ だんだん どこ だいたい 的确 的士"
).split()
GREETINGS = "こんにちは こんばんは".split()
LEFT_OPEN = "は を へ その この あの 彼 彼女 私 そして しかし でも だから だが なぜ もし 但是 而且 所以 因为 如果 这 那 他 她 我 你 我们 他们".split()
MAY_LEAVE_OPEN = "が に の も と や で から まで より 的 在".split()
QUOTED_JA = "と って という といって との と言った と聞いた とおもった とおもう とか".split()
REPORTING_CJK = "说 说道 问 问道 喊 喊道 答 答道 叫道 想".split()

TERMINATORS = ".!?…।؟。！？"
_OPEN = {"“": "”\"", "„": "“”\"", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "‘": "’", '"': '"”', "'": "'"}
_CLOSERS = "\"'”’»“)]」』）"
_SPACELESS = r"฀-๿぀-ヿ㐀-鿿豈-﫿"

_BLANK = re.compile(r"(?:\r?\n|\r)[^\S\r\n]*(?:(?:\r?\n|\r)[^\S\r\n]*)*(?:\r?\n|\r)")
_LINE = re.compile(r"[^\r\n]+")
_CARD_LINE = re.compile(r"\s*[^\W_][^:：.!?]{0,30}[:：]\s*\S")
_WORDLIKE = re.compile(r"[^\W_]")
_GAP = re.compile(r"[.!?…।؟]+(?=[\s" + re.escape(_CLOSERS) + _SPACELESS + r"“„«‘¿¡(（「『—–,;:]|$)|[。！？]+")
_OPENING = re.compile(r"[“„«「『（(\[]|(?<![^\W_])[\"‘'](?=[^\W_¿¡])|(?<!\S)[\"‘'](?=\S)")
_NEXT = re.compile(r"[\s​﻿�☀-➿\U0001f300-\U0001faff]*")
_ENDS_TOKEN = frozenset(" \t\n\r\xa0\u200b\"'“”„«»‘’()[]（）「」『』,;:—")
_WORD = re.compile(r"[¿¡]?([^\W\d_]+)")
_THAI = re.compile(r"[฀-๿]")
_THAI_TOKEN = re.compile(r"\S+")
_NOT_BLANK = re.compile(r"\s*")
_KANA = re.compile(r"[぀-ヿ]")
_KANA_HAN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_CAPITAL_WORD = re.compile(r" (?:The|A|An|And|Of|Is|La|El|Los|De|Del|Y|Und|Den|Le|Les|Et|Du|И|В|На|С|E|Do|Da|Que|That|His|Her)\s")
_HAS_OPENING = re.compile("[“„«「『（(\\[\"‘']")

_NEVER = {w for x in NEVER_FINAL.values() for w in x.split()}
_MAYBE = {w for x in MAYBE_FINAL.values() for w in x.split()}
_KNOWN = _NEVER | _MAYBE | WITH_NUMBER


def is_card(text: str) -> bool:
    """Three or more lines that aren't blank, all of the form `Key: value`."""
    if ":" not in text and "：" not in text:
        return False
    n = 0
    for m in _LINE.finditer(text):
        line = m.group()
        if line.isspace():
            continue
        if not _CARD_LINE.match(line):
            return False
        n += 1
    return n >= 3


_MARKS = re.compile("[" + re.escape("".join(sorted({*_OPEN, *"".join(_OPEN.values())}))) + "]")
_OPENED_BY: dict[str, str] = {}
for _mark, _ends in _OPEN.items():
    for _c in _ends:
        _OPENED_BY[_c] = _OPENED_BY.get(_c, "") + _mark


def _spans(block: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets (start, end) of a block, in one pass; an opening mark that isn't closed is none.

    A closing mark closes the last open mark that it fits, and drops unclosed ones within.
    """
    out: list[tuple[int, int]] = []
    if not _HAS_OPENING.search(block):
        return out
    stack: list[tuple[int, str]] = []
    open_: dict[str, int] = {}
    for m in _MARKS.finditer(block):
        k, c = m.start(), m.group()
        fits = _OPENED_BY.get(c)
        if fits and any(open_.get(x) for x in fits):
            top = stack[-1][1]
            word = k + 1 < len(block) and block[k + 1].isalpha()
            apostrophe = word and (c in "’'" or c == "“" and not open_.get("“") and k and block[k - 1].isspace())
            if not apostrophe and not (c in _OPEN and c not in _OPEN[c] and top != "„") and not (c in "\"'" and top != c and _OPENING.match(block, k)):
                while True:
                    start, mark = stack.pop()
                    open_[mark] -= 1
                    if mark in fits:
                        break
                while out and out[-1][0] > start:
                    out.pop()
                out.append((start, k + 1))
                continue
        if c in _OPEN and _OPENING.match(block, k):
            stack.append((k, c))
            open_[c] = open_.get(c, 0) + 1
    return out


# --- spaceless scripts -------------------------------------------------------------------------------------------


class Lattice:
    """Cuts a short stretch into words by the cheapest path; unknown characters cost most."""

    def __init__(self, words: set[str], known: float = 1.0, unknown: float = 2.5):
        self.words, self.known, self.unknown, self.longest = words, known, unknown, max(map(len, words))

    def words_of(self, text: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, len(text) + 1):
            options = [(best[e - 1][0] + self.unknown, e - 1)]
            options += [(best[s][0] + self.known, s) for s in range(max(0, e - self.longest), e) if text[s:e] in self.words]
            best.append(min(options))
        out, e = [], len(text)
        while e:
            s = best[e][1]
            out.append(text[s:e])
            e = s
        return out[::-1]


_LATTICE = Lattice({*FINAL_WORDS, *GOING_ON, *OPENING, *REPORTING_CJK})
_GOING, _REPORT, _FINAL = set(GOING_ON), set(REPORTING_CJK), set(FINAL_WORDS)


_OPEN_LATTICE = Lattice({*FINAL_WORDS, *GOING_ON, *OPENING, *REPORTING_CJK, *MORE_OPENING, *GREETINGS, *LEFT_OPEN, *MAY_LEAVE_OPEN, *QUOTED_JA})
_QUOTED, _OPENS, _LEFT, _MAY_LEAVE = set(QUOTED_JA), {*OPENING, *MORE_OPENING}, set(LEFT_OPEN), set(MAY_LEAVE_OPEN)
_ALWAYS_GOING = set("的 问道 说道 答道 叫道 喊道".split())
_SAYING = re.compile("[言思聞訊尋答叫呟考感云問]|いう|いった|おもう|おもった|つぶや|ささや|さけ")


#: Characters on either side of a gap that the lattice reads: more than twice the longest word, so that both words next to
#: the gap, and those that could compete with them, lie within.
LOOK = 2 * max(_LATTICE.longest, _OPEN_LATTICE.longest) + 2
_CLAUSE_END = re.compile("[。！？!?…]")
_CLAUSE_PART = re.compile("[。！？，；“「]")
_HIRAGANA = re.compile("[ぁ-ゖ]")


def _until(block: str, at: int, end: re.Pattern[str]) -> str:
    m = end.search(block, at)
    return block[at : m.start() if m else len(block)]


def _free_score(block: str, mark: str, start: int, end: int) -> float:
    """Evidence for an end at a gap outside of quotations in a spaceless script, from the words on both of its sides."""
    at = _NOT_BLANK.match(block, end).end()
    if at >= len(block):
        return STOP
    if block[at] in "，、,；;：:":
        return -SURE
    words = _OPEN_LATTICE.words_of(block[at : at + LOOK])
    before = (_OPEN_LATTICE.words_of(block[max(0, start - LOOK) : start].split("\n")[-1].rstrip()) or [""])[-1]
    word, rest = words[0], block[at + len(words[0]) : at + LOOK]
    going = word in _GOING or word in _QUOTED
    if going and len(words) > 1 and words[1] not in _OPEN_LATTICE.words and _HIRAGANA.match(word) and _HIRAGANA.match(words[1]):
        going = False  # the beginning of a longer word
    if going and word in _QUOTED:
        new = (mark in ("。", ".") or rest[:1] in ("、", "，", ",")) and not _SAYING.search(_until(block, at, _CLAUSE_END))
        return STOP if new else -SURE
    if mark in ("。", "."):
        return STOP  # only a quotation's particle goes on behind a full stop
    if word in _ALWAYS_GOING:
        return -STOP if rest.strip() and rest[0] not in TERMINATORS else STOP
    score = STOP if mark[-1] in "!?！？" else 1.0
    score += 2.0 if before in _FINAL or before in GREETINGS else 0.0
    score += 1.0 if word in _OPENS else 0.0
    if re.fullmatch(r"[.…]+", mark):
        score -= 5.0 if before in _LEFT else 2.5 if before in _MAY_LEAVE else 0.0
        return score - (1.5 if going else 0.0)
    return score - (4.0 if going and _KANA.match(word) else 0.0)


def _spaceless_score(block: str, mark: str, start: int, end: int, span: tuple[int, int] | None) -> float:
    """Evidence for a sentence's end at `end` in a spaceless script; span: the quotation that closes there."""
    if span is None:
        return _free_score(block, mark, start, end)
    at = _NOT_BLANK.match(block, end).end()
    if at >= len(block):
        return STOP
    if block[at] in "，、,；;：:":
        return -SURE
    if block[span[0]] in "（(":
        return STOP
    words = _LATTICE.words_of(block[at : at + LOOK])
    if _KANA.match(block, at):
        return -STOP if words[0] in _GOING else STOP
    if words[0] in _GOING or words[0] in _REPORT:
        return -STOP
    if block[max(0, span[0] - 1)] in "：:，,":  # somebody's words, told before
        return STOP
    # a clause that ends with a verb of saying tells who spoke
    last = _LATTICE.words_of(_until(block, at, _CLAUSE_PART)[-LOOK:])[-2:]
    return -STOP if _REPORT & set(last) else STOP


# --- spaced scripts ----------------------------------------------------------------------------------------------

#: Evidence: a terminator speaks for an end with STOP; what speaks against it with SURE decides alone.
STOP, SURE = 3.0, 9.0
#: Cost of a unit of a single word.
SHORT = 1.0
_NUMBER_BEFORE = re.compile(r"\d[\s​�☀-➿\U0001f300-\U0001faff]*$")
_STREET_BEFORE = re.compile(r"\d+[A-Za-z]?\s+[A-ZÀ-Þ][^\W\d_]+\s*$")
_DOTTED = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_NO_VOWEL = re.compile(r"[B-DF-HJ-NP-TV-XZb-df-hj-np-tv-xz]{2,5}")
_SPACELESS_PAIR = re.compile(f"[{_SPACELESS}]{{2}}")
_BLANKS = re.compile(r"\s+")


def _score(block: str, mark: str, start: int, end: int, quoted: bool, noisy: int, k: int = -1) -> float:
    """Evidence for a sentence's end at a gap of a spaced script: `mark` from `start`, with its closers up to `end`.

    noisy: 1 where capitals stand at random, so that only a small letter tells something; 2 where case tells nothing.
    k: where the next visible character stands, if known.
    """
    k = _NEXT.match(block, end).end() if k < 0 else k
    if k >= len(block):
        return STOP
    c = block[k]
    if k == end and c not in "“„«‘\"(「『（—–¿¡" and not _KANA_HAN.match(block, k) and not _THAI.match(block, k):
        return -SURE
    if c in ",;:،؛，、）)":
        return -SURE
    if c in "—–-":  # speech goes on behind a dash with who speaks, or in small letters
        w = _WORD.match(block, _NEXT.match(block, k + 1).end())
        if not w:
            return STOP
        small = w.group(1)[0].islower()
        return STOP - (6.0 if w.group(1).lower() in REPORTING or small else 0.0)
    w = _WORD.match(block, k)
    word = w.group(1) if w else ""
    low = word.lower()
    score = STOP
    if quoted and low in REPORTING:
        score -= 6.0
    if word and c.islower() and noisy < 2:
        score -= 6.0
    if mark[0] in ".…" and (len(mark) > 1 or mark == "…"):
        return score - (5.0 if noisy and low in CONTINUING else 1.0)
    if mark != "." or (quoted and end > start + 1):
        return score
    return score - _abbreviated(block, start, low, c.isdigit(), noisy)


def _abbreviated(block: str, start: int, low: str, digit: bool, noisy: int) -> float:
    """Evidence that the full stop at `start` belongs to the word before it; `low` is the word behind it."""
    b = start
    while b and (c := block[b - 1]) not in _ENDS_TOKEN and not "\u3040" <= c <= "\u9fff":
        b -= 1
    before = block[b:start]
    if not before:
        return 0.0
    dotted = "." in before
    key = before.lower()
    if len(before) > 5 and not dotted and key not in _KNOWN and not before.isdigit():
        return 0.0  # a word
    if before.isdigit():
        return 6.0 if low in GERMAN_MONTHS and len(before) < 3 else 0.0
    if key in "дп" and re.search(r"[тТ]\.\s*$", block[max(0, start - 8) : start - 1]):
        return 0.0
    if key in WITH_NUMBER:
        if digit:
            return 6.0
        if key in ("no", "nos", "ch", "art", "mar", "dec", "sep", "oct", "cap"):
            return 0.0
    if key in _MAYBE:
        if digit:
            return 3.5
        if key in ("u.k", "u.s", "ee.uu", "uu", "co", "corp", "sr", "jr"):
            return 2.0 if low in OPENERS else 6.0
        if key == "st":  # of a street with its number, else a saint
            return 0.0 if _STREET_BEFORE.search(block, max(0, start - 40), start - 2) else 6.0
        if key in ("г", "гг", "в", "вв"):
            return 0.0 if _NUMBER_BEFORE.search(block, max(0, start - 9), b) else 6.0
        return 0.0
    if key in _NEVER or dotted and key.endswith((".ej", ".ex", ".e", ".b", ".h")):
        return 6.0
    if len(before) == 1 and before.isalpha():
        ahead = block[max(0, b - 3) : b].rstrip()
        return 0.0 if ahead and (ahead[-1] in "º°ª" or ahead[-1].isdigit()) else 6.0
    if dotted and _DOTTED.fullmatch(before):
        return 2.0 if low in OPENERS else 6.0
    # a short word without vowel is no word, but may be a name in capitals
    if _NO_VOWEL.fullmatch(before) and not before.isupper():
        return 2.5 + (1.5 if digit else 0.0) - (1.0 if low in OPENERS else 0.0)
    return 0.0


def _words(block: str, start: int, end: int) -> int:
    """Words of a stretch: 0, 1, or 2 for more; two characters of a spaceless script are more than one."""
    first = _WORDLIKE.search(block, start, end)
    if not first:
        return 0
    blank = _BLANKS.search(block, first.end(), end)
    if blank and _WORDLIKE.search(block, blank.end(), end):
        return 2
    return 2 if _SPACELESS_PAIR.search(block, first.start(), end) else 1


def _path(block: str, gaps: list[tuple[int, float]]) -> list[int]:
    """The cheapest cuts of a block: a state per gap and number of words (none, one, more) in the open unit. Exact and linear.

    Joining at a gap saves two units of a single word at most, and cutting none; so where no score lies between nothing and
    twice SHORT, each gap's sign is the cheapest path.
    """
    if all(score < 0 or score >= 2 * SHORT for _, score in gaps):
        return [end for end, score in gaps if score > 0]
    best, back, at = [0.0, math.inf, math.inf], [], 0
    for end, score in gaps:
        words, at = _words(block, at, end), end
        moved, source = [math.inf] * 3, [0] * 3
        for state in (0, 1, 2):
            to = min(2, state + words)
            if best[state] < moved[to]:
                moved[to], source[to] = best[state], state
        go, cut = (score, 0.0) if score > 0 else (0.0, -score)
        ends = (moved[0] + cut, moved[1] + cut + SHORT, moved[2] + cut)
        state = min((0, 1, 2), key=ends.__getitem__)
        cuts = ends[state] < moved[0] + go or not moved[0] < math.inf
        back.append((source, state if cuts else -1))
        best = [ends[state] if cuts else moved[0] + go, moved[1] + go, moved[2] + go]
    out, state = [], min((0, 1, 2), key=best.__getitem__)
    for (end, _), (source, cut_from) in zip(reversed(gaps), reversed(back), strict=True):
        if state == 0 and cut_from >= 0:
            out.append(end)
            state = source[cut_from]
        else:
            state = source[state]
    return out[::-1]


_SPACE_OR_CLOSER = frozenset(_CLOSERS + "   \t\n\r")


def _block_cuts(block: str, noisy: int) -> list[int]:
    spans = _spans(block)
    gaps: list[tuple[int, float]] = []
    at, nth, filled = 0, 0, -1
    for m in _GAP.finditer(block):
        start, end = m.span()
        if end <= at:
            continue
        while nth < len(spans) and spans[nth][1] <= start:
            nth, filled = nth + 1, -1
        span = None
        if nth < len(spans) and spans[nth][0] < start:
            span = spans[nth]
            if filled < 0:  # where the last thing but closers and white space in the span ends
                filled = span[1]
                while filled > span[0] and block[filled - 1] in _SPACE_OR_CLOSER:
                    filled -= 1
            if end < filled:
                continue
            end = span[1]
        else:
            while end < len(block) and block[end] in _CLOSERS and not (block[end] in "\"'“" and end + 1 < len(block) and block[end + 1].isalnum()):
                end += 1
        at = end
        mark, k = m.group(), _NEXT.match(block, end).end()
        if mark[-1] in "。！？" or (k < len(block) and block[k] > "\u303f" and _KANA_HAN.match(block, k) and _KANA_HAN.match(block, max(0, start - 1))):
            gaps.append((end, _spaceless_score(block, mark, start, end, span)))
        else:
            gaps.append((end, _score(block, mark, start, end, span is not None or end > m.end(), noisy, k)))
    if _THAI.search(block):
        gaps = _thai_gaps(block, spans, gaps)
    return _path(block, gaps) if gaps else []


def _thai_gaps(block: str, spans: list[tuple[int, int]], gaps: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """The gaps, and those at white space next to a Thai word outside of spans."""
    taken, nth, out, last = {e for e, _ in gaps}, 0, list(gaps), None
    for m in _THAI_TOKEN.finditer(block):
        thai = bool(_THAI.search(m.group()))
        if last is not None and (thai or last[1]):
            s = last[0]
            while nth < len(spans) and spans[nth][1] <= s:
                nth += 1
            if s not in taken and not (nth < len(spans) and spans[nth][0] < s):
                out.append((s, SURE))
        last = m.end(), thai
    return sorted(out)


_AROUND = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　﻿"


def units(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences of a text."""
    if is_card(text):
        pieces: list[tuple[int, int]] = [m.span() for m in _LINE.finditer(text)]
    else:
        noisy = 2 if text.isupper() or text.islower() else int(_random_capitals(text))
        pieces, at = [], 0
        for m in _BLANK.finditer(text):
            if m.start() > at:
                _add(pieces, text[at : m.start()], at, noisy)
            at = m.end()
        _add(pieces, text[at:] if at else text, at, noisy)
    for a, b in pieces:
        piece = text[a:b]
        if _WORDLIKE.search(piece):
            left = piece.lstrip(_AROUND)
            a += len(piece) - len(left)
            yield a, a + len(left.rstrip(_AROUND))


def _random_capitals(text: str) -> bool:
    """Whether words that are usually small have a capital inside a sentence."""
    for m in _CAPITAL_WORD.finditer(text):
        before = text[max(0, m.start() - 2) : m.start()].rstrip(",")
        if before[-1:].islower():
            return True
    return False


def _add(pieces: list[tuple[int, int]], block: str, at: int, noisy: int) -> None:
    start = 0
    for end in _block_cuts(block, noisy):
        if end > start:
            pieces.append((at + start, at + end))
            start = end
    if start < len(block):
        pieces.append((at + start, at + len(block)))


def split_sentences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, sent_start, sent_end) of every sentence; offsets are code points, the end exclusive.

    Null and empty texts, and stretches without letter or digit, give no row; repeated rows give theirs once. Blank
    lines, and the lines of catalogue cards, always part sentences.
    """

    def make():
        return lambda ids, texts: ((i, a, b) for i, t in zip(ids, texts, strict=True) for a, b in units(t))

    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    return flat_map(chosen, "doc_id bigint, sent_start bigint, sent_end bigint", make)
