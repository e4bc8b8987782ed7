"""Sentence boundaries across languages and scripts by a finite transducer.

A text is first cut into blocks by its layout (blank lines, headings, fences, list items). Inside the
blocks a lexer turns the text into events: opening and closing marks, terminators with what surrounds
them, and block ends. What surrounds a terminator falls into classes, and the rules are compiled, once for
every combination of classes, into a table of decisions, and with the other events into the transition
and output tables of one finite transducer, whose state holds the open quotations and brackets and how
the unit began. The events of a long text are processed in chunks: each chunk becomes a function from
state to state, the functions are composed by a parallel prefix scan, and then every chunk is run from
its own start state. Words are matched by position, so the time is linear in a text's length.

Abbreviations are a short list and what is learned from the documents.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from weft.runtime import stage

# Abbreviations by what may follow them. Others are learned from the documents.
#: Never end a sentence, whatever follows.
BEFORE_ANY = frozenset(
    """mr mrs ms mx dr prof capt sgt lt col gen hon rev fr st sr jr sra dra srta dres dña mgr ing dipl mme mlle
    cf vs v viz resp ca approx esp incl excl e.g i.e eg ie fig figs eq eqs sec. ch app vol no nos p pp ed eds art op
    nr abb abs bd bzw z.b d.h u.a o.ä evtl ggf inkl zzgl vgl hr fr. s.o s.u
    env p.ex c.-à-d cf. pág págs p.ej núm art. aprox véase
    см рис стр гл тыс млн млрд т.е напр ул им проф доц
    p.s д د डॉ श्री dept bldg univ janv févr avr juil déc""".split()
)
#: The same if they begin with a capital: titles before names.
TITLES = frozenset("gov sen rep adm cmdr maj brig supt pres amb messrs".split())
#: End a sentence if the next word begins like one.
BEFORE_LOWER = frozenset("a.m p.m etc usw u.s.w al inc corp co ltd bros llc plc ft in lb oz sec min hr. u.s u.k u.n e.u ph.d b.c a.d т.д т.п т.к jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun st.".split())
MONTHS = frozenset("jan feb mar apr may jun jul aug sep sept oct nov dec".split())
#: Of those that may end a sentence, the ones that do so before figures too.
FIGURES_TOO = frozenset("etc al a.m p.m inc corp co ltd bros".split())
#: Streets behind a name, saints before one.
STREETS = frozenset(["st"])
#: Words before a German ordinal.
ORDINAL = frozenset("am im der die das den dem des vom zum zur bis ab seit jeder jede jeden jedem ein eine einem einen beim und".split())

_OPEN = {**dict.fromkeys("([{（［【", "b"), "“": "d", "„": "d", "‘": "s", "‚": "s", "«": "g", **dict.fromkeys("「『《〈", "c")}
_CLOSE = {**dict.fromkeys(")]}）］】", "b"), "”": "d", "’": "s", "»": "g", **dict.fromkeys("」』》〉", "c")}
_ENDS = ".!?…。！？｡．؟۔।॥‼⁇⁈⁉"
_STRONG, _CRIES = set("。！？｡．؟۔।॥"), set("!?…")
_MARKS_OF_ALL = rf"(?P<end>[{_ENDS}]+)|(?P<open>[(\[{{（［【“„‘‚«「『《〈])|(?P<close>[)\]}}）］】”’»」』》〉])|(?P<quote>\")"
_MARK = re.compile(_MARKS_OF_ALL)
_THAI = re.compile("[฀-๿]")
_THAI_MARK = regex.compile(_MARKS_OF_ALL + r"|(?P<thai>(?<=[฀-๿][\u200b]?)\s+(?=[฀-๿\p{Lu}(\[“\"«]))")
_CLOSERS = "”’»)]}）］】」』》〉\"“"
_CASELESS = regex.compile(r"[\p{Lo}]")
_SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
# These match backwards from a position, so that words of any length are read whole and once.
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}_.\-]*")
_SPACED = regex.compile(r"(?r)(?<![\p{L}\p{M}])(\p{L}\.[ \xa0]?\p{L})")
_YEAR = regex.compile(r"(?r)\d{4}\s*г")
_LEAD = regex.compile(r"(?r)(\p{L}+)\s+\p{Nd}{1,2}")
_STREET = regex.compile(r"(?r)(?<=[\p{L}\p{N},;:]\s)(?:\p{Lu}\p{L}+|\p{Nd}\w*)\s+\p{L}+")
_PART = regex.compile(r"\p{L}\.")
_NEXT = regex.compile(r"[^\p{L}\p{N}]*+(?P<word>[\p{L}\p{M}\p{N}_.()]*)")
_IDENTIFIER = regex.compile(r"\w+_\w|\w+\(\)|\p{L}+\.\p{L}{2,}")
_REFERENCE = re.compile(r"pp?\.\s?\d")
_SPECIAL = re.compile(r"\s*(?:<\|?[^<>\s]{1,20}\|?>|\[[A-Z]{2,5}\]|[^\w\s\"“„«‘(\[「『《¿¡*`.,;:—–-]+)\s+")


# ---- the transducer -------------------------------------------------------------------------------
_SIZES = {"b": 3, "q": 2, "d": 2, "s": 2, "g": 3, "c": 3}
#: Marks that nest; pairs deeper than the table's levels are counted outside it.
_NESTING = "bgcd"
#: How the unit began: nothing yet, with an opening mark, with text.
FRESH, LEAD, PLAIN = range(3)
_STATES = [(*levels, mode) for levels in itertools.product(*(range(n) for n in _SIZES.values())) for mode in (FRESH, LEAD, PLAIN)]
_NUMBER = {s: i for i, s in enumerate(_STATES)}
_KINDS = list(_SIZES)
#: Events: block end, sure end, end unless the unit began with a quotation; open, open at a unit's first character, close by kind.
SYMBOLS = ["block", "sure", "unlead", *(a + k for a in ("open:", "first:", "close:") for k in _KINDS)]
_CODE = {s: i for i, s in enumerate(SYMBOLS)}


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Transition and output tables, (symbol, state)."""
    step = np.zeros((len(SYMBOLS), len(_STATES)), np.int16)
    cut = np.zeros((len(SYMBOLS), len(_STATES)), np.int8)
    zero = (0,) * len(_KINDS)
    for s, (*levels, mode) in enumerate(_STATES):
        for y, symbol in enumerate(SYMBOLS):
            now, how, out = list(levels), PLAIN if mode == FRESH else mode, 0
            name, _, kind = symbol.partition(":")
            if name == "block":
                now, how, out = list(zero), FRESH, 1
            elif name in ("sure", "unlead"):
                if not any(now) and not (name == "unlead" and mode == LEAD):
                    how, out = FRESH, 1
                elif name == "unlead" and mode == LEAD and not any(now):
                    how = PLAIN
            else:
                k = _KINDS.index(kind)
                if name == "close":
                    now[k] = max(0, now[k] - 1)
                else:
                    now[k] = min(_SIZES[kind] - 1, now[k] + 1)
                    if mode == FRESH and name == "first":
                        how = LEAD
            step[y, s], cut[y, s] = _NUMBER[(*now, how)], out
    return step, cut


STEP, CUT = _compile()
_OPENING = frozenset(i for i, name in enumerate(SYMBOLS) if name.startswith(("open", "first")))
START = _NUMBER[(0,) * len(_KINDS) + (FRESH,)]
_STEP_ROWS, _CUT_ROWS = STEP.tolist(), CUT.tolist()
CHUNK = 2048


def transduce(symbols: list[int], start: int = START) -> list[bool]:
    """Which events cut. Long inputs go by chunks and a prefix scan of their functions."""
    if len(symbols) <= 2 * CHUNK:
        return _run(symbols, start)
    parts = [symbols[i : i + CHUNK] for i in range(0, len(symbols), CHUNK)]
    scan = np.stack([chunk_function(p) for p in parts])
    shift = 1
    while shift < len(scan):  # scan[i] becomes the function of parts 0..i
        scan[shift:] = np.take_along_axis(scan[shift:], scan[:-shift].astype(np.int64), 1)
        shift *= 2
    states = [start, *scan[:-1, start].tolist()]
    return list(itertools.chain.from_iterable(_run(p, s) for p, s in zip(parts, states)))


def chunk_function(symbols: list[int]) -> np.ndarray:
    """The state that each state leads to over a chunk."""
    state = np.arange(len(_STATES))
    for y in symbols:
        state = STEP[y][state]
    return state.astype(np.int16)


def _run(symbols: list[int], state: int) -> list[bool]:
    out = []
    for y in symbols:
        out.append(_CUT_ROWS[y][state] == 1)
        state = _STEP_ROWS[y][state]
    return out


# ---- layout ---------------------------------------------------------------------------------------
_LINE = re.compile(r"[^\n]*\n?")
_FENCE = re.compile(r"[ \t]{0,8}(`{3,}|~{3,})")
_HEAD = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]+\S|[ \t]*\r?\n?$)")
_ITEM = regex.compile(r"[ \t]*(?:[-*+•‣◦·]|(?P<number>\(?\p{Nd}{1,3}[.)])|\(?[a-zA-Z]\))[ \t]+(?=\S)")
_STOP = regex.compile(rf"(?:[{_ENDS}:][{_CLOSERS}]*)\s*$")
_LABEL = regex.compile(r"[ \t]*(?:\[[\w -]{1,20}\]|[\p{L}\p{M}][\p{L}\p{M}\p{N}_.-]{0,24}[ \t]?[:：](?=[ \t]))[ \t]*")


def blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, first text, end) of the layout blocks; the first text follows markers and labels. A
    fence or a heading has its first text at its end: nothing inside it is cut."""
    start = body = None
    at, fence, opened, listed = 0, "", 0, False
    while at < len(text):
        end = _LINE.match(text, at).end()
        line = text[at:end]
        if fence:
            m = _FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end() :].strip():
                yield opened, end, end
                fence = ""
            at = end
            continue
        m = _FENCE.match(line)
        special = m or _HEAD.match(line)
        item = None if special else _ITEM.match(line)
        if item and item["number"] and start is not None and not listed and not _STOP.search(text[max(start, at - 40) : at]):
            item = None  # a number that a wrapped line happens to begin with
        if start is not None and (special or item or not line.strip()):
            yield start, body, at
            start = None
        if m:
            fence, opened = m[1], at
        elif special:
            yield at, end, end
        elif line.strip():
            if start is None:
                label = _LABEL.match(line, item.end() if item else 0)
                start, body = at, at + (label.end() if label else item.end() if item else 0)
                listed = bool(item)
        at = end
    if fence:
        yield opened, len(text), len(text)
    if start is not None:
        yield start, body, len(text)


# ---- terminators ----------------------------------------------------------------------------------
# What stands around a terminator falls into a few classes each; the rules below decide for every
# combination once, and the table of their decisions is what the lexer consults.
#: What follows: nothing, marks, a letter by its case, a figure, a name written in small letters, others.
NEXT = ("none", "particle", "ideographic comma", "comma", "semicolon", "colon", "dash", "opened capital", "capital", "quoted capital", "small", "name", "figure", "caseless", "other")
#: The word before a point: any word, one that never ends a sentence, one that may (by what may follow),
#: a month, the word No, a Russian year sign with and without a year, an initial, a day of a month.
BEFORE = ("word", "never", "maybe", "maybe, figures too", "month", "no", "year", "no year", "initial", "day", "foreign", "three small")
_MARKS = ("point", "cry", "ellipsis", "mixed", "dots")
_BITS = list(itertools.product((False, True), repeat=3))
_TO_EVENT = {"": 0, "sure": 1, "unlead": 2}


def _decide(free: bool, closers: bool, gap: bool, mark: str, nxt: str, before: str) -> str:
    """'' (no end), sure or unlead. ``free`` says that the mark or the script needs no blank after it."""
    if nxt == "none":
        return "sure"
    if free:
        if closers and not gap:
            stays = nxt in ("particle", "caseless", "capital", "small", "name", "figure")
        elif closers:
            stays = nxt in ("particle", "ideographic comma", "comma")
            if nxt == "caseless":
                return "unlead"
        elif mark == "point" and not gap:
            return "sure" if before == "foreign" else ""
        else:
            stays = False
        return "" if stays or nxt in ("ideographic comma", "comma", "semicolon") else "sure"
    if nxt in ("comma", "semicolon", "colon", "dash"):
        return ""
    if not gap:
        if closers or mark != "point" and not (mark in ("cry", "ellipsis") and nxt == "capital"):
            return "sure" if closers and nxt == "opened capital" or nxt == "capital" and mark in ("cry", "mixed") else ""
        return "sure" if before == "three small" and nxt == "capital" else ""
    if mark == "point" and not closers:
        if before in ("never", "no year", "initial") or before == "day" and nxt == "capital" or before == "month" and nxt == "figure":
            return ""
        if before == "year":
            return "" if nxt in ("small", "name", "other") else "sure"
        if before == "maybe" and nxt == "figure":
            return ""
        if before == "no" and nxt not in ("capital", "quoted capital"):
            return ""
    if nxt == "small":
        return ""
    return "unlead" if closers and nxt == "caseless" else "sure"


DECISION = np.array([[[[_TO_EVENT[_decide(*bits, mark, n, w)] for w in BEFORE] for n in NEXT] for mark in _MARKS] for bits in _BITS], np.int8)
_DECIDED = DECISION.tolist()
_N, _B = {n: i for i, n in enumerate(NEXT)}, {w: i for i, w in enumerate(BEFORE)}
_EVENT = ("", "sure", "unlead")
_FIRST = {**dict.fromkeys("とっ", _N["particle"]), "、": _N["ideographic comma"], **dict.fromkeys(",，", _N["comma"]), **dict.fromkeys(";；", _N["semicolon"]), **dict.fromkeys(":،؛", _N["colon"])}
_SPACE = regex.compile(r"\s*")


def _letter(text: str, at: int, name: bool) -> int:
    """The class of the word at a position that begins with no mark of its own."""
    c = text[at]
    if c.isupper():
        return _N["capital"]
    if c.islower():
        return _N["name"] if name else _N["small"]
    if _CASELESS.match(c):
        return _N["caseless"]
    return _N["figure"] if c.isdigit() or c.isalnum() else _N["other"]


def _before(text: str, begin: int, at: int, shown: int, learned: frozenset[str]) -> int:
    """The class of the word before a point with a blank after it."""
    word = _WORD_BEFORE.match(text, begin, at)[0]
    low = word.lower().lstrip("-.")
    spaced = _SPACED.match(text, begin, at) if len(word) <= 4 else None
    if spaced:
        low = spaced[1].lower().replace(" ", "").replace("\xa0", "")
    if low == "г":
        return _B["year" if _YEAR.match(text, begin, at) else "no year"]
    if low in BEFORE_LOWER:
        return _B["month" if low in MONTHS else "maybe, figures too" if low in FIGURES_TOO else "maybe"]
    if low == "no":
        return _B["no"]
    if low in STREETS and _STREET.match(text, begin, at):
        return _B["word"]
    if low in BEFORE_ANY or low in learned or low in TITLES and word[0].isupper():
        return _B["never"]
    if len(word) == 1 and word.isalpha() and (word.isupper() or _PART.match(text, shown)):
        return _B["initial"]
    if len(word) <= 2 and word.isdigit():
        lead = _LEAD.match(text, begin, at)
        if lead and lead[1].lower() in ORDINAL:
            return _B["day"]
    return _B["word"]


def _plain_end(text: str, begin: int, marks: str, at: int, learned: frozenset[str]) -> bool:
    """Whether a mark with a blank and a capital behind it is an end at first sight: the decision for
    this combination of classes is the same whatever the rest is."""
    if marks in "!?":
        return True
    if marks != "." or at > begin and text[at - 1].isspace():
        return False
    word = _WORD_BEFORE.match(text, begin, at)[0]
    if len(word) < 5 or not word.isalpha():
        return False
    low = word.lower()
    return low not in BEFORE_ANY and low not in BEFORE_LOWER and low not in TITLES and low not in learned


def _ends(text: str, begin: int, marks: str, at: int, closed: int, end: int, learned: frozenset[str]) -> str:
    """What a terminator run at ``at`` is, its closing marks ending at ``closed``: '', sure or unlead."""
    nxt = _SPACE.match(text, closed, end).end()
    if nxt == end:
        return "sure"
    c, gap, closers, before = text[nxt], nxt > closed, closed > at + len(marks), 0
    mark = 0 if marks == "." else (1 if marks[-1] in "!?" else 2) if set(marks) <= _CRIES else 3 if marks[-1] in "!?" else 4
    free = marks[-1] in _STRONG or marks[0] in _STRONG or not gap and bool(_SPACELESS.match(c))
    following = _FIRST.get(c, 0)
    if following and (free or following >= _N["comma"]):
        pass
    elif not free and c in "—–-" and text[nxt + 1 : nxt + 2].isspace() and nxt + 1 < end:
        following = _N["dash"]
    elif free:
        following = _letter(text, nxt, False)
        if mark == 0 and not gap and not closers and not text[at - 1 : at].isascii():
            before = _B["foreign"]
    elif not gap:
        if c.isupper():
            following = _N["capital"]
            before = text[max(begin, at - 3) : at]
            after = text[nxt + 1 : nxt + 2] if nxt + 1 < end else ""
            before = _B["three small"] if len(before) == 3 and before.islower() and before.isalpha() and (after.islower() or after.isspace()) else 0
        else:
            following = _N["opened capital"] if c in "“„«\"([" and nxt + 1 < end and text[nxt + 1].isupper() else _N["other"]
    else:
        shown = nxt
        m = _SPECIAL.match(text, nxt, end)
        if m and m.end() < end:
            shown = m.end()
        m = _NEXT.match(text, shown, end)
        word = m.start("word")
        if word == m.end("word"):
            following = _N["other"]
        else:
            following = _letter(text, word, bool(_IDENTIFIER.match(text, word, m.end("word")) or _REFERENCE.match(text, shown, end)))
            if word > shown:  # behind marks
                following = _N["quoted capital"] if following == _N["capital"] else _N["other"] if closers and following == _N["caseless"] else following
        if mark == 0 and not closers:
            before = _before(text, begin, at, shown, learned)
    return _EVENT[_DECIDED[4 * free + 2 * closers + gap][mark][following][before]]


# ---- events ---------------------------------------------------------------------------------------
def events(text: str, begin: int, end: int, learned: frozenset[str] = frozenset()) -> Iterator[tuple[int, int]]:
    """(symbol, position) of a block's text; a cut is made at the position."""
    quoted = doubled = single = False
    last = begin
    at = begin
    search = (_THAI_MARK if _THAI.search(text, begin, end) else _MARK).search
    while m := search(text, at, end):
        i, at = m.start(), m.end()
        name = m.lastgroup
        if name == "open":
            kind = _OPEN[m[0]]
            if m[0] == "“" and doubled:
                yield _CODE["close:d"], at
                doubled = False
                continue
            if kind == "d":
                doubled = True
            elif kind == "s":
                single = True
            yield _CODE[("open:" if text[last:i].strip(" \t\r\n¿¡*`\xa0") else "first:") + kind], at
            last = at
        elif name == "quote":
            quoted = not quoted
            yield _CODE[("close:" if not quoted else "open:" if text[last:i].strip() else "first:") + "q"], at
            last = at
        elif name == "close":
            kind = _CLOSE[m[0]]
            if kind == "s":
                if not single or text[i + 1 : i + 2].isalpha() and text[i - 1 : i].isalpha():
                    continue
                single = False
            elif kind == "d":
                doubled = False
            yield _CODE["close:" + kind], at
        elif name == "thai":
            yield _CODE["sure"], i
            last = i
        else:
            if text[at : at + 1] == " " and at + 1 < end and text[at + 1].isupper() and _plain_end(text, begin, m[0], i, learned):
                yield _CODE["sure"], at
                last = at
                continue
            closed = at
            shut = []
            while closed < end:
                c = text[closed]
                if c in " \xa0 " and text[closed + 1 : closed + 2] == "»":  # French
                    closed += 1
                elif c == "\n" and text[closed + 1 : closed + 2] == "»":
                    closed += 1
                elif c == '"' and quoted:
                    quoted = False
                    shut.append("q")
                    closed += 1
                elif c == "“" and doubled:
                    doubled = False
                    shut.append("d")
                    closed += 1
                elif c in _CLOSE and (c != "’" or single):
                    kind = _CLOSE[c]
                    doubled, single = doubled and kind != "d", single and kind != "s"
                    shut.append(kind)
                    closed += 1
                elif c == "'" and not text[closed + 1 : closed + 2].isalnum():
                    closed += 1
                elif c in "*_`" and shut:
                    closed += 1
                else:
                    break
            for kind in shut:
                yield _CODE["close:" + kind], closed
            at = closed
            # a terminator after blanks, as in French, belongs to what is before it
            kind = _ends(text, begin, m[0], i, closed, end, learned) if not (m[0] == "." and i > begin and text[i - 1].isspace() and text[at : at + 1].isalnum()) else ""
            if kind:
                yield _CODE[kind], closed
                last = closed


def _within(found: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The events of a block without the pairs of marks nested deeper than the transducer counts.

    They change none of its decisions: what lies between them is inside anyway. Straight and single
    quotes do not nest; a second one in a row is not counted.
    """
    depth, over = dict.fromkeys(_NESTING, 0), dict.fromkeys(_NESTING, 0)
    for symbol, at in found:
        name, _, kind = SYMBOLS[symbol].partition(":")
        if kind in depth:
            if name == "close" and over[kind]:
                over[kind] -= 1
                continue
            if name != "close" and depth[kind] == _SIZES[kind] - 1:
                over[kind] += 1
                continue
            depth[kind] = max(0, depth[kind] + (-1 if name == "close" else 1))
        yield symbol, at


def sentences(text: str, learned: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """(start, end) of the units of a text, code points, without outer white space."""
    symbols: list[int] = []
    cuts: list[int] = []
    for start, body, end in blocks(text):
        symbols.append(_CODE["block"])
        cuts.append(start)
        found = list(events(text, body, end, learned)) if body < end else []
        if sum(symbol in _OPENING for symbol, _ in found) > 1:  # a pair inside another one
            found = _within(found)
        for symbol, at in found:
            symbols.append(symbol)
            cuts.append(at)
        symbols.append(_CODE["block"])
        cuts.append(end)
    out = []
    last = 0
    for cut, at in zip(transduce(symbols), cuts):
        if cut:
            piece = text[last:at]
            body = piece.strip()
            if body:
                a = last + len(piece) - len(piece.lstrip())
                out.append((a, a + len(body)))
            last = at
    return out


#: A text of more characters is cut between layout blocks into parts of about this many, which go to
#: different tasks; a single block stays whole, and its events are scanned by chunks.
PART = 262_144
#: A learned abbreviation is followed by a small letter at least so often, and in this share of all cases.
LEAST, SHARE = 5, 0.75
#: It also makes up this share of all words with a point, so at most a million are learned from any corpus.
RARE = 1e-6
_QUOTES = "([{\"'“„«‘‚「『¿¡*_"


def pointed(text: str) -> Iterator[tuple[str, bool]]:
    """(word, whether a small letter follows) of the words of up to 12 letters with a point and a blank
    after them and a letter behind."""
    pieces = text.replace(".\n", ". ").split(". ")
    for before, after in itertools.pairwise(pieces):
        c = after[:1]
        small = c.islower()
        if small or c.isupper():
            word = before[before.rfind(" ") + 1 :].lstrip(_QUOTES)
            if 1 < len(word) < 13 and word[-1] != "." and word.replace(".", "").isalpha():
                yield word.lower(), small


def parts(text: str, size: int = PART) -> Iterator[tuple[int, str]]:
    """(offset, part) of a text, cut where layout blocks end."""
    if len(text) <= size:
        yield 0, text
        return
    last = 0
    for _, _, end in blocks(text):
        if end - last >= size:
            yield last, text[last:end]
            last = end
    if last < len(text):
        yield last, text[last:]


def learn_abbreviations(documents: DataFrame) -> frozenset[str]:
    """Words that carry a point inside sentences, learned from all documents: a small letter follows the
    point in most cases, where after an end a capital would. Each batch counts its words before the
    shuffle; the result is bounded by ``RARE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: Counter[str] = Counter()
        every: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for word, is_small in pointed(text.as_py()):
                    every[word] += 1
                    small[word] += is_small
            if len(every) > 200_000:
                yield counts(every, small)
                every.clear()
                small.clear()
        yield counts(every, small)

    def counts(every: Counter, small: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([small[w] for w in every], pa.int64())], ["word", "every", "small"])

    words = documents.select("text").filter("text is not null").mapInArrow(run, "word string, every long, small long")
    words = words.groupBy("word").agg(F.sum("every").alias("every"), F.sum("small").alias("small"))
    words = stage(words.groupBy("word").agg(F.sum("every").alias("every"), F.sum("small").alias("small")), "words")
    total = words.agg(F.coalesce(F.sum("every"), F.lit(0))).first()[0]
    found = words.filter((F.col("small") >= LEAST) & (F.col("small") >= SHARE * F.col("every")) & (F.col("every") >= RARE * total))
    return frozenset(r[0] for r in found.select("word").collect())


def find_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence of documents (doc_id, text).

    Null, empty and blank texts give nothing; repeated rows count once; other columns are ignored.
    """
    learned = learn_abbreviations(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, begin, end = [], [], []
            for i, offset, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for a, b in sentences(text.as_py(), learned):
                    doc.append(i)
                    begin.append(offset + a)
                    end.append(offset + b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, begin, end)], ["doc_id", "start_pos", "end_pos"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for offset, part in parts(text.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([offset], pa.int64()), pa.array([part], pa.string())], ["doc_id", "offset", "text"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    shape = "doc_id long, offset long, text string"
    short = rows.filter(F.length("text") <= PART).select("doc_id", F.lit(0).cast("long").alias("offset"), "text")
    long = rows.filter(F.length("text") > PART).mapInArrow(cut, shape).repartition("doc_id", "offset")
    return short.unionByName(long).mapInArrow(run, "doc_id long, start_pos long, end_pos long").distinct()
