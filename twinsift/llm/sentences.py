"""Problem 9: sentence boundaries across languages and scripts, by a semi-Markov dynamic programme.

A text is cut at blank lines. Within a block every place that could end a sentence is a candidate: after a terminator and
its closing quotes, before and after a bracketed unit, and at white space in Thai. The programme then chooses whole
spans, not single cuts: a span scores by the word that closes it, the word that opens the next one, its length, and
whether its quotation marks and brackets balance, so that a quotation stays with the words that introduce it and an
interruption is a sentence only where the sentence around it has ended. The best total wins. Among the starts of a span
only those that lead their kind are kept (the same marks open, or any; near, or far), so the programme is linear in the text.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations after which a sentence goes on, casefolded, without their last period.
NEVER_LAST = frozenset(
    """mr mrs ms dr prof st messrs hon rev gen col capt sgt gov sen rep vs cf vol pp p art no nos para paras sec fig approx e.g i.e viz ed eds
    hr fr abg nr abs vgl z u d ca bzw s sog dipl ing evtl ggf inkl bspw
    m mm mme mmes mlle env av chap l'art alín d'apr
    sr sra sres srta dra d dña núm pág págs aprox ud uds excmo ilmo
    ए के पृ रु डॉ श्री सं क्र
    د ص م أ رقم""".split()
)
#: Abbreviations that may stand at the end of a sentence.
MAY_BE_LAST = frozenset("p.m a.m u.k u.s e.u u.n inc ltd co corp etc al jr b a h f ff usw usf j.-c ej cía bros bsp n.chr v.chr r.u a.c d.c i. ii. iii. viz".split())
#: Words that open sentences, casefolded (an elided article counts by itself).
OPENERS = frozenset(
    """the a an my our this that these every i we you he she they it thank is are was there said asked called replied answered mr mrs ms order let
    der die das dieses diese dieser eine ein einer unsere unser ich wir sie es fragte sagte rief antwortete erwiderte gibt vielen danke das wort herr frau nach
    le la les l' cette ce cet ces notre nos une un nous vous il elle ils je merci y c' s' qu' a d' mme m
    el los las lo una nuestro nuestra nuestros esta este estos se tiene queda pasamos muchas hay preguntó respondió dijo no yo nosotros es gracias""".split()
)
#: Verbs that attribute a quotation, where they follow its closing mark.
SAYS = frozenset("said asked called replied answered cried added fragte sagte rief antwortete erwiderte erklärte meinte dit demandé répondu lancé déclaré preguntó respondió dijo exclamó a".split())
_says_cjk = re.compile(r"\s*(?:と|って|[^。！？（(〔「“\s]{0,16}?(?:说|问道|回答|答道|喊道|表示|指出)(?:道)?[。！？，,])")
#: Nouns that follow an ordinal number.
AFTER_ORDINAL = frozenset("januar februar märz april mai juni juli august september oktober november dezember quartal sitzung jahrhundert wahlperiode tagung lesung".split())

_EOL = r"(?:\r\n|\n|\r(?!\n)| | )"
_break = re.compile(rf"{_EOL}[^\S\r\n  ]*{_EOL}\s*")
_OPEN = {"(": ")", "[": "]", "（": "）", "〔": "〕", "【": "】", "{": "}"}
_bracket = re.compile(r"[()\[\]（）〔〕【】{}]")
_stop = re.compile(r"(?:[.!?…。！？．؟۔।॥]+)(?:[\"'”’」』》]|“(?=\s|\Z|[,;])|[\s  ]?[»])*")
_word_breaks = re.compile(r"[\s\"“”„«»(\[（]").split
_next_word = re.compile(r"[\s​﻿­]*([\"'“„«「『¿¡‘\s]*)(?:([^\W\d_]+(?:['’](?=\w))?)|(\d)|(\S))?")
_label = re.compile(r"\s*[^:：\n.!?]{0,30}(?:\.[^:：\n.!?]{0,30}){0,4}(?:\([^()\n]{1,40}\)\s*)?[:：]\s*\Z")
_thai = re.compile(r"[฀-๿]")
_letter = re.compile(r"[^\W\d_]")
_heading = re.compile(r"\s*\d+\s*[–—-]\s*\S.*", re.S)
_strong = frozenset("!?。！？．؟۔।॥")
_cjk = re.compile(r"[぀-ヿ㐀-鿿＀-￯]")
_marks = re.compile(r"[\"“”„«»「」『』《》]")

_begins = re.compile(r"[.!?]\s+([^\W\d_])")
_joined = re.compile(r"[.!?](?<=[^\W\d_]{3}[.!?])[\"”»)\]]?[^\W\d_]{3}")
_spaced = re.compile(r"[.!?](?<=[^\W\d_]{3}[.!?])[\"”»)\]]?\s")
_thai_word = re.compile(r"\w|[ะ-๎]")

_content = re.compile(r"[^\s.!?…。！？]").search

#: Scores: a cut in the middle of a quotation or bracket, a unit that is only an interruption, a cut behind one that is not.
UNBALANCED, ALONE, BEHIND = -7.0, 15.0, -8.0
#: Scores of a span of one character, and of one longer than LONG.
TINY, OVERLONG, LONG = -3.0, -1.0, 600
#: Characters before a terminator in which its word is looked for; no abbreviation is longer.
WORD = 48


def _units(block: str) -> list[tuple[int, int]]:
    """Outermost bracketed units of a block; a bracket without a partner is an ordinary character."""
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    for m in _bracket.finditer(block):
        c = m.group()
        if c in _OPEN:
            stack.append((_OPEN[c], m.start()))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == c:
                    pairs.append((stack[k][1], m.end()))
                    del stack[k:]
                    break
    pairs.sort()
    out: list[tuple[int, int]] = []
    for a, b in pairs:
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def _cases() -> np.ndarray:
    """For each code point of the first two planes: 1 a small letter, 2 a capital, 0 neither."""
    return np.fromiter((c.isalpha() * (c.islower() + 2 * c.isupper()) for c in map(chr, range(0x20000))), np.uint8, 0x20000)


def _letter_cases(text: str) -> tuple[int, int]:
    """How many small and how many capital letters a text has."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small, big = np.bincount(_cases()[points[points < 0x20000]], minlength=3)[1:3].tolist()
    for c in map(chr, points[points >= 0x20000].tolist()):
        small, big = small + (c.isalpha() and c.islower()), big + (c.isalpha() and c.isupper())
    return small, big


class Style:
    """How a text is written, as far as the choice depends on it: whether capitals tell where sentences begin."""

    def __init__(self, text: str):
        sample = [m.group(1) for m in _begins.finditer(text)]
        upper = sum(c.isupper() for c in sample)
        lower = sum(c.islower() for c in sample)
        small, big = _letter_cases(text)
        # texts whose sentences follow one another without a space; no letter counts for two of them
        joined, end = 0, 0
        for m in _joined.finditer(text):
            if m.start() - 3 >= end:
                joined, end = joined + 1, m.end()
        self.tight = joined >= 2 and joined * 2 > len(_spaced.findall(text))
        self.shouting = big > 0.6 * (small + big) and big > 20
        self.cased = not self.shouting and big > 0 and (upper >= lower * 0.6 or upper + lower < 3)
        if not self.shouting and small > 60 and big * 200 < small:
            self.cased = False


def _opening(text: str, i: int, style: Style) -> tuple[float, str]:
    """Score of what stands after a candidate as the opening of a sentence, and its first word."""
    m = _next_word.match(text, i)
    marks, word, digit, other = m.group(1), m.group(2), m.group(3), m.group(4)
    if word:
        low = word.casefold()
        first = low.replace("’", "'")
        elided = first if first.endswith("'") else first.split("'")[0] + "'" if "'" in first else first
        known = low in OPENERS or elided in OPENERS
        if not (word[0].isupper() or word[0].islower()):
            return 3.0, low  # a script without case
        if style.cased:
            if word[0].isupper():
                return (5.0 if known else 3.0), low
            return (-6.0 if not marks.strip("¿¡ ") else -5.0), low
        return (4.0 if known or "¿" in marks or "¡" in marks else -0.5), low
    if digit:
        return 0.5, ""
    if other:
        return 1.0, ""
    return 4.0, ""


def _cut_score(block: str, begin: int, mark: int, end: int, after: int, style: Style) -> float:
    """Score of ending a sentence at ``end``: the terminators stand at ``mark``, the next words at ``after``."""
    stop = block[mark:end]
    open_, word = _opening(block, after, style)
    closed = any(c in "\"”“»」』" for c in stop)
    gap = after > end and block[end:after].isspace() or after >= len(block) or block[end : end + 1].isspace()
    if closed and word:
        if word in SAYS and (not style.cased or open_ < 0) and (word != "a" or re.match(r"\s*a\s+(?:dit|demand|répond|lanc|déclar)", block[after : after + 40], re.I)):
            return -12.0
        if _says_cjk.match(block, end):
            return -12.0
    if any(c in _strong for c in stop):
        if _cjk.match(block, end) or _cjk.match(block, after):
            return 7.0
        if not gap and end < len(block) and block[end].isalnum() and not style.tight:
            return -3.0 if block[end].islower() and style.cased else 5.0 if not block[end].isdigit() else -3.0
        return 7.0 if open_ > 0 or not word else 5.5 if not style.cased else -5.0
    if stop.startswith("…") or stop.startswith(".."):
        if not gap and end < len(block):
            return -9.0
        return (open_ - 1.0) if style.cased else (open_ - 1.0 if open_ > 0 else -5.0)
    # a period
    if not gap and end < len(block):
        if len(word) < 2 or not block[end].isalpha():
            return 2.0 if closed else -9.0
        if not style.tight and not closed and not (open_ == 5.0 or open_ == 3.0 and not block[end].isupper() and ord(block[end]) > 0x590):
            return -9.0
    before = _word_breaks(block[max(begin, mark - WORD) : mark])[-1].strip("​­﻿‍‌")
    low = before.casefold().replace("’", "'")
    at_end = after >= len(block)
    if closed:
        return open_ + 2.0
    bare = low.rsplit("'", 1)[-1]
    if at_end:
        return 6.0
    if low in NEVER_LAST or bare in NEVER_LAST and len(bare) > 1:
        return -12.0
    if len(bare) == 1 and bare.isalpha() and bare not in MAY_BE_LAST:
        return -10.0
    if low in MAY_BE_LAST or bare in MAY_BE_LAST or len(bare) == 1 and bare.isalpha():
        if re.search(r"(?:^|[\s(])[^\W\d_]\.\s*\Z", block[max(0, mark - len(before) - 4) : mark - len(before)]) and before[:1].isupper() and len(before) == 1:
            return -10.0  # initials before a name
        known = word in OPENERS or (word.split("'")[0] + "'") in OPENERS or word.endswith("'") and word in OPENERS
        if style.cased:
            return 3.0 if known and open_ > 0 else (0.5 if open_ > 0 and not word else -3.0 if open_ > 0 and word else open_ - 3.0 if open_ < 0 else 1.5)
        return 2.0 if known else -4.0
    if before[-1:].isdigit():
        if word in AFTER_ORDINAL:
            return -10.0
        if re.fullmatch(r"\d{1,2}", before) and style.cased and open_ == 3.0 and word and block[_next_word.match(block, after).start(2)].isascii():
            return -1.0
        return open_ + 1.0
    if re.match(r"[ऀ-ॿ]{1,3}\Z", before):
        return -8.0
    return open_ + 1.5


def block_ends(block: str, style: Style) -> list[int]:
    """Ends of the sentences of one block, as offsets in it."""
    n = len(block.rstrip())
    if not n:
        return []
    block = block[:n]
    start = n - len(block.lstrip())
    units = _units(block)
    thai = len(_thai.findall(block)) > 0.4 * len(_thai_word.findall(block)) if _thai.search(block) and _letter.search(block) else False
    if thai and _heading.fullmatch(block) and len(block) < 60:
        return [n]
    candidates: dict[int, float] = {}
    inside = bytearray(n + 1)
    for a, b in units:
        inside[a + 1 : b] = b"\x01" * (b - a - 1)
    unit_at = {a: b for a, b in units}
    unit_ends = {b for _, b in units}

    def beyond(i: int) -> int:
        """Past white space and bracketed units."""
        while True:
            while i < n and block[i].isspace():
                i += 1
            if i in unit_at:
                i = unit_at[i]
            else:
                return i

    last = -1
    for m in _stop.finditer(block):
        mark, end = m.start(), m.end()
        if inside[mark] or end > n:
            continue
        k = end
        if any(inside[mark:end]):
            continue
        after = beyond(k)
        score = _cut_score(block, start, mark, end, after, style)
        if score > -9.5:
            if last > 0 and not _content(block[last:mark]):
                candidates.pop(last, None)  # terminators with nothing between them end one sentence
            candidates[end] = max(score, candidates.get(end, -99.0))
            last = end
    if thai:
        for m in re.finditer(r"\s+", block[start:]):
            i, j = m.start() + start, m.end() + start
            if inside[i] or block[i - 1] in ":：–—-«“" or j < n and block[j] in "–—-":
                continue
            candidates[i] = 7.0
    for a, b in units:
        if b not in candidates or candidates[b] < BEHIND:
            candidates[b] = BEHIND if b < n else 0.0
        # quotation marks that belong to the unit's end do not occur; a terminator right behind makes it part of a sentence
        if b < n and block[b] in ".!?…,;:。！？":
            candidates.pop(b, None)
    candidates.pop(n, None)
    cuts = [start, *sorted(c for c in candidates if start < c < n), n]
    score = [0.0, *(candidates[c] for c in cuts[1:-1]), 0.0]

    # what balances: the count of each kind of mark up to each cut
    kinds = {"“": 0, "„": 0, "”": 0, "«": 1, "»": 1, "「": 2, "」": 2, "『": 3, "』": 3, "《": 4, "》": 4}
    closing = frozenset("”»」』》")
    german = "„" in block
    level, straight = [0] * 5, 0
    state: list[tuple[int, ...]] = []
    marks = list(_marks.finditer(block))
    k = 0
    for c in cuts:
        while k < len(marks) and marks[k].start() < c:
            x = marks[k].group()
            if x == '"':
                straight ^= 1
            else:
                level[kinds[x]] += -1 if x in closing or german and x == "“" else 1
            k += 1
        state.append((*level, straight))

    begins = []
    for c in cuts:
        i = c
        while i < n and block[i].isspace():
            i += 1
        begins.append(i)

    # a unit's end closes a sentence only if the unit stands alone, behind a sentence that has ended
    loose = {b for b in unit_ends if b in candidates and candidates[b] <= BEHIND}
    labelled = units[0][1] if units and _label.match(block[: units[0][0]]) and ":" in block[: units[0][0]].replace("：", ":") else -1
    return [cuts[j] for j in _best_spans(cuts, begins, score, state, unit_at, loose, labelled)]


class _Front:
    """The best start among those at most ``LONG`` characters back, and the best among all further back: O(1) a step."""

    def __init__(self):
        self.near: deque[tuple[float, int]] = deque()
        self.far = (float("-inf"), -1)

    def add(self, value: float, i: int) -> None:
        while self.near and self.near[-1][0] <= value:
            self.near.pop()
        self.near.append((value, i))

    def best(self, first: int) -> tuple[float, int]:
        """The best start for a span, where starts before ``first`` are far: a span from there is a long one."""
        while self.near and self.near[0][1] < first:
            self.far = max(self.far, self.near.popleft())
        away = self.far[0] + OVERLONG, self.far[1]
        return max(self.near[0], away) if self.near else away


def _best_spans(cuts: list[int], begins: list[int], score: list[float], state: list[tuple[int, ...]], unit_at: dict[int, int], loose: set[int], labelled: int) -> list[int]:
    """Indices of the cuts that end the spans of the best total.

    ``total[j]`` is the best total up to cut ``j``; ``closed[j]`` the best that leaves a sentence closed there, which a
    ``loose`` cut does only behind a unit on its own. A span costs more across an unbalanced mark or beyond ``LONG``
    characters, so the best start is one of a few fronts, kept for each state of the marks and for all; the start right
    before is looked at by itself, as only it can be too short or a unit. The programme is linear in the cuts.
    """
    m = len(cuts)
    low = float("-inf")
    total, closed = [low] * m, [low] * m
    back, back_closed = [(0, False)] * m, [(0, False)] * m
    total[0] = closed[0] = 0.0
    every, alike = _Front(), {}
    first = 0
    for j in range(1, m):
        if j >= 2:
            every.add(total[j - 2], j - 2)
            alike.setdefault(state[j - 2], _Front()).add(total[j - 2], j - 2)
        while first < j - 1 and cuts[j] - begins[first] > LONG:
            first += 1
        i, reach = j - 1, cuts[j] - begins[j - 1]
        best = total[i] + (UNBALANCED if state[i] != state[j] else 0.0) + (TINY if reach <= 1 else OVERLONG if reach > LONG else 0.0)
        for value, k in (alike[state[j]].best(first) if state[j] in alike else (low, -1), (every.best(first)[0] + UNBALANCED, every.best(first)[1]) if j >= 2 else (low, -1)):
            if value > best + 1e-9:
                best, i = value, k
        total[j], back[j] = best + score[j], (i, False)
        if cuts[j] not in loose:
            closed[j], back_closed[j] = total[j], back[j]
        bonus = low
        if unit_at.get(begins[j - 1]) == cuts[j]:
            bonus, i = closed[j - 1] + ALONE + score[j] + (UNBALANCED if state[j - 1] != state[j] else 0.0), j - 1
        elif cuts[j] == labelled and j < m - 1:
            bonus, i = ALONE + score[j] + (UNBALANCED if state[0] != state[j] else 0.0) + (OVERLONG if cuts[j] - begins[0] > LONG else 0.0), 0
        if bonus > closed[j]:
            closed[j], back_closed[j] = bonus, (i, True)
        if bonus > total[j] + 1e-9:
            total[j], back[j] = bonus, (i, True)
    ends, j, settled = [], m - 1, False
    while j > 0:
        ends.append(j)
        j, settled = back_closed[j] if settled else back[j]
    return ends[::-1]


def sentence_ends(text: str | None) -> list[int]:
    """Offsets (in code points) of the ends of a text's sentences; none for a null, empty or blank text."""
    if not text or not text.strip():
        return []
    style = Style(text)
    ends: list[int] = []
    at = 0
    for m in [*_break.finditer(text), None]:
        stop = m.start() if m else len(text)
        ends += [at + e for e in block_ends(text[at:stop], style)]
        at = m.end() if m else len(text)
    return ends


def split_sentences(documents: DataFrame) -> DataFrame:
    """``(doc_id, sent_no, sent_start, sent_end)``: every sentence of every document, in one pass without a shuffle.

    Defined cases: null, empty and blank texts have no sentence; null ids have no rows; a row that comes twice is split
    twice; whole texts are read, however long; ``lang`` is not trusted and not read; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, number, begin, stop = [], [], [], []
            for ident, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                last = 0
                for k, e in enumerate(sentence_ends(text)):
                    while text[last].isspace():
                        last += 1
                    ids.append(ident)
                    number.append(k)
                    begin.append(last)
                    stop.append(e)
                    last = e
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(begin, pa.int32()), pa.array(stop, pa.int32())], names=["doc_id", "sent_no", "sent_start", "sent_end"])

    chosen = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, sent_no int, sent_start int, sent_end int")
