"""Sentence boundaries across languages and scripts.

A pushdown automaton reads a document's lines and the marks in them. Its stack
holds, from the outside in, levels of quotation (``>``), list levels with the
number of their last item, and open quotation marks and brackets. Lines push and
pop levels and so decide the blocks; within a block marks push and pop pairs, and
what lies in a closed pair ends no sentence. Abbreviation tries are walked
backwards from a point, and each script brings its own terminators. Only marks
are visited; the text between them is skipped by a compiled pattern, so cost
follows the number of marks. Nothing is decided from a window of fixed width.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations. They bind to what follows ...
BIND = """
e.g. i.e. cf. Cf. viz. vs. approx. Dr. Mr. Mrs. Ms. Prof. Rev. Gen. St.
z.B. Z.B. d.h. D.h. u.a. s.o. s.u. i.d.R. bzw. vgl. Vgl. ca. Ca. evtl. ggf. inkl. sog. Hr. Fr.
p.ex. P.ex. c.-à-d. env. M. MM.
p.ej. P.ej. Sr. Sra. Dra. Ud. Uds. aprox.
т.е. т.ч. ок. Ок. см. См. ср. Ср. напр. проф. им. ул.
डॉ. श्री. प्रो. د. أ. ดร. नं.
""".split()
# ... or do so before a number ...
NUMBERED = """
No. no. Nos. nos. Sec. sec. Fig. fig. Figs. figs. Eq. eq. Vol. vol. Ch. ch. Art. art. App. app. p. pp. P. l. ll. v. para.
Nr. Abb. Abschn. Kap. S. Bd. Tab. Abs. Z.
al. chap. éd. n.
pág. págs. párr. núm. cap. Pág. Núm.
рис. Рис. п. пп. стр. гл. табл. ст. № т.
सं. पृ. क्र. ص. ج.
""".split()
# ... or may end a sentence: units and times of day, which a number may follow ...
UNITS = """
a.m. p.m. A.M. P.M. min. sec. hrs. Std. Min. Mio. Mrd. г. гг. ч. мин. руб. сек. тыс. млн. a.C. d.C.
""".split()
# ... and others.
MAY_END = """
etc. Etc. Jr. Inc. Ltd. Co. al. usw. usf. u.ä. o.ä. т.д. т.п. др. пр. EE.UU. आदि.
""".split() + UNITS
# Month names that follow an ordinal's point in German.
MONTHS = "Januar Jänner Februar Feber März April Mai Juni Juli August September Oktober November Dezember".split()
#: Words that open a time of day before the main clause.
TIME_OPENERS = {"at", "by", "from", "until", "since", "around", "before", "after", "a", "à", "vers", "um", "ab", "gegen", "bis", "в", "с", "до", "к", "около", "hacia", "desde"}
#: Words that carry a sentence on after quoted speech.
CARRY_ON = {"and", "or", "but", "then", "und", "oder", "aber", "et", "ou", "puis", "mais", "y", "e", "o", "u", "pero", "и", "или", "но", "а"}

PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "„": "“", "“": "”", "‹": "›", "”": "”", "»": "«", "“„": "”"}
BRACKETS = set("([{（［【")
TITLES = set("《〈")
OPENERS = set("([{（［【「『《〈«„“‹\"¿¡")
CLOSERS = set(")]}）］】」』》〉»”“›\"’")
TERMINATORS = ".!?…。！？؟।॥．｡۔‼⁇⁈⁉"
WIDE = set("。！？．｡")
PAUSES = set(",;:،؛、，；：—–-")

_CLOSE = re.escape("".join(sorted(CLOSERS)))
_MARK = r"[\"“”„«»‹›「」『』《》〈〉（）()\[\]{}［］【】]"
_WIDE_NEXT = r"؀-ۿऀ-ॿ฀-๿　-鿿＀-￯"
# a point before a blank, a closing mark or a script without blanks; or, where a blank is missing, between a small letter and a capitalised word
_END = (
    rf"\.(?:\.+|(?=[\s{_CLOSE}!?…{_WIDE_NEXT}]|$))|(?<=[a-zß-ÿа-я\d)»”])\.(?=[A-ZÀ-ÞА-Я][a-zß-ÿа-я])|(?<=[а-я])\.(?=[а-я]\.)"
    rf"|[!?](?=[\s{_CLOSE}!?….,;:—–A-ZÀ-ÞА-Я¿¡(\[{_WIDE_NEXT}]|$)|[…。！？؟।॥．｡۔‼⁇⁈⁉]"
)
_EVENTS = re.compile(f"{_MARK}|{_END}")
_EVENTS_THAI = re.compile(f"{_MARK}|{_END}|[^\\S\r\n]+")
_QUOTE_MARKS = re.compile(_MARK)
_THAI = re.compile("[฀-๿]")
_RUN = re.compile(f"[{re.escape(TERMINATORS)}]*")
_SPACE = re.compile(r"\s*")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_QUOTE = re.compile(r"[ \t]*>[ \t]?")
_HEAD = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]+|(?=[\r\n]|$))")
_BULLET = re.compile(r"[ \t]*[-*+•][ \t]+")
_NUMBER = re.compile(r"[ \t]*(\d{1,9})[.)][ \t]+")
_RULE = re.compile(r"[ \t]*(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|={3,})[ \t]*$")
_MARKUP = re.compile(r"([*`~_]+)|<(\w+)>")
_WORD = re.compile(r"[^\s" + _CLOSE + r",;:!?…]+")
_SUFFIX = re.compile(r"\.[a-z]{1,4}")
_BEFORE = set("([\"“«„")


def _trie(words: list[str]) -> dict:
    """Reversed trie without blanks; the value at the end is under the empty key."""
    root: dict = {}
    for w in words:
        at = root
        for ch in reversed(w):
            at = at.setdefault(ch, {})
        at[""] = True
    return root


_BIND, _NUMBERED, _MAY_END, _UNITS = _trie(BIND), _trie(NUMBERED), _trie(MAY_END), _trie(UNITS)


def _rests() -> tuple[dict, dict[str, list[str]]]:
    """For abbreviations of several points: a trie of what stands before an inner point, and what must follow it."""
    rest: dict[str, list[str]] = {}
    for w in [*BIND, *NUMBERED, *MAY_END]:
        for i, ch in enumerate(w[:-1]):
            if ch == ".":
                rest.setdefault(w[: i + 1], []).append(w[i + 1 :])
    return _trie(list(rest)), rest


_INNER, _REST = _rests()


def _abbreviation(s: str, dot: int, start: int, trie: dict) -> int:
    """Where the abbreviation that ends with the point at ``dot`` begins, or -1. Blanks after inner points are passed over."""
    at, i, best = trie, dot, -1
    while i >= start:
        ch = s[i]
        if ch in at:
            at = at[ch]
            i -= 1
            if "" in at and (i < start or not (s[i].isalnum() or s[i] in "-_/.@" or "̀" <= s[i] <= "ͯ" or "ऀ" <= s[i] <= "ॿ")):
                best = i + 1
        elif ch.isspace() and "." in at and i != dot:
            i -= 1
        else:
            break
    return best


def _inside_abbreviation(s: str, dot: int, start: int) -> bool:
    """Whether the point is an inner one of an abbreviation written with blanks, as in ``z. B.``."""
    at = _abbreviation(s, dot, start, _INNER)
    if at < 0:
        return False
    head = "".join(s[at : dot + 1].split())
    return any(_goes_on(s, dot + 1, r) for r in _REST.get(head, ()))


def _goes_on(s: str, i: int, rest: str) -> bool:
    """Whether ``rest`` follows from ``i`` on, blanks between its parts passed over; its last point may be missing."""
    k, n = 0, len(s)
    while k < len(rest):
        if i >= n:
            return k > 0 and rest[k:] == "."
        ch = s[i]
        if ch == rest[k]:
            k += 1
        elif not ch.isspace():
            return False
        elif k and rest[k - 1] != ".":
            # a blank within a part: only the last point may be missing, at the end of the text
            return rest[k:] == "." and not s[i:].strip()
        i += 1
    return True


class Pushdown:
    """The automaton's stack, and what it knows of the word that ends at the point last looked at.

    Frames are (kind, value, place): ``>`` with its depth, ``item`` with the
    number of a list's last item (or None) and the column of its mark, and
    pairs with the mark that is awaited and where they open.
    """

    def __init__(self) -> None:
        self.frames: list[tuple[str, object, int]] = []
        self.word = (0, -1, False)

    def depth(self) -> int:
        """Levels of quotation."""
        return max((int(v) for k, v, _ in self.frames if k == ">"), default=0)

    def quote(self, depth: int) -> None:
        """Enter a level of quotation; lists outside it go on after it."""
        self.frames.append((">", depth, 0))

    def leave(self, column: int | None = None) -> None:
        """A block at a column ends the lists whose marks are not left of it; without a column all frames go."""
        if column is None:
            self.frames.clear()
        while self.frames and self.frames[-1][0] == "item" and self.frames[-1][2] >= column:
            self.frames.pop()

    def follows(self, number: int, column: int) -> bool:
        """Whether an item of this number goes on in a list that is open at its column or left of it."""
        for kind, value, place in reversed(self.frames):
            if kind == ">":
                return False
            if place <= column + 1 and value is not None:
                return number == value + 1
        return False

    def item(self, number: int | None, column: int) -> None:
        """An item's mark: deeper lists end, its own level holds its number."""
        while self.frames and self.frames[-1][0] == "item" and self.frames[-1][2] >= column:
            self.frames.pop()
        self.frames.append(("item", number, column))

    def pairs(self, s: str) -> dict[int, int]:
        """Quotation marks and brackets of a block that close, by where they open. What stays open is popped with the block and is no pair."""
        base, out = len(self.frames), {}
        awaited: dict[str, int] = {}
        for m in _QUOTE_MARKS.finditer(s):
            ch, i = m.group(), m.start()
            if awaited.get(ch):
                while True:
                    want, _, at = self.frames.pop()
                    awaited[want] -= 1
                    if want == ch:
                        out[at] = i
                        break
            else:
                want = '"' if ch == '"' else PAIRS.get(ch)
                if want:
                    self.frames.append((want, None, i))
                    awaited[want] = awaited.get(want, 0) + 1
        del self.frames[base:]
        return out

    def prose(self, s: str, start: int, dot: int) -> bool:
        """Whether what ends at ``dot`` is a small word, a number, a path or a closed pair, after which no dotted name goes on."""
        if dot > start and s[dot - 1] in ")»”":
            return True
        k = dot
        while k > start and (s[k - 1].isalnum() or s[k - 1] in "_'’-"):
            k -= 1
        if k < dot and _opens_word(s, start, k) and s[k].isalpha() and not ("A" <= s[k] <= "Z" or "À" <= s[k] <= "Þ" or "А" <= s[k] <= "Я"):
            return True
        k = dot
        while k > start and (s[k - 1].isdecimal() or s[k - 1] in ".,"):
            k -= 1
        if k < dot and s[k].isdecimal() and (_opens_word(s, start, k) or s[k - 1] == "v" and _opens_word(s, start, k - 1)):
            return True
        # a path: the part of the word that an earlier point has looked at is not looked at again
        begin, end, slash = self.word
        k = dot
        while k > start and k != end and (s[k - 1].isalnum() or s[k - 1] in "_@./-"):
            k -= 1
        if k == end and k > start:
            slash = slash or "/" in s[k:dot]
        else:
            begin, slash = k, "/" in s[k:dot]
        self.word = (begin, dot, slash)
        suffix = s.rfind(".", max(begin, dot - 5), dot)
        return slash and s[begin] != "/" and suffix >= 0 and _SUFFIX.fullmatch(s, suffix, dot) is not None and s.find("/", begin, suffix) > begin and _opens_word(s, start, begin)


def _opens_word(s: str, start: int, k: int) -> bool:
    return k == start or s[k - 1].isspace() or s[k - 1] in _BEFORE


def _inner_end(s: str, lo: int, hi: int) -> str:
    """The last terminator inside a pair, or nothing if it doesn't end with one."""
    while hi > lo and (s[hi - 1].isspace() or s[hi - 1] in CLOSERS):
        hi -= 1
    if hi <= lo or s[hi - 1] not in TERMINATORS:
        return ""
    if s[hi - 1] == "." and (_abbreviation(s, hi - 1, lo, _BIND) >= 0 or _abbreviation(s, hi - 1, lo, _MAY_END) >= 0):
        return ""
    return s[hi - 1]


def _is_name(word: str) -> bool:
    """Whether a small word is the name of a module or path."""
    return any(c in word for c in "-/_") or any(c.isdigit() for c in word)


def _after_pair(s: str, start: int, lo: int, hi: int) -> bool:
    """Whether a sentence ends with the pair lo..hi that closes at the lowest level."""
    mark = _inner_end(s, lo + 1, hi)
    n = len(s)
    j = hi + 1
    while j < n and s[j] in CLOSERS and s[j] != '"':
        j += 1
    j = _SPACE.match(s, j).end()
    if j >= n:
        return True
    if not mark:
        return False
    nxt = s[j]
    if nxt in PAUSES or nxt in TERMINATORS:
        return False
    opens = lo == start
    if s[lo] in BRACKETS:
        return opens
    if s[lo] in TITLES:
        return False
    before = lo - 1
    while before >= start and s[before].isspace():
        before -= 1
    told = before >= start and s[before] in ":：,，"
    if nxt in OPENERS:
        return True
    word = _WORD.match(s, j)
    w = word.group() if word else nxt
    cased = nxt.isupper() or nxt.islower()
    if told and s[before] == "：":
        return True
    if not cased and not nxt.isdigit():
        return told and s[before] in ":"
    if nxt.isupper() or nxt.isdigit():
        return j > hi + 1 or told
    # a name of a module or path may open a sentence though it is small
    if _is_name(w) and (told or "-" not in w or "/" in w):
        return j > hi + 1
    return told and (mark in "?؟？" or s[before] == ",") and w not in CARRY_ON


def _point_ends(s: str, start: int, dot: int, nxt: int, stack: Pushdown) -> bool:
    """Whether a single point at the lowest level ends its sentence; ``nxt`` is the next character that is no blank."""
    n = len(s)
    if nxt >= n:
        return True
    ch = s[nxt]
    if nxt == dot + 1 and ch.isupper() and not stack.prose(s, start, dot):
        return False  # within a dotted name
    if _abbreviation(s, dot, start, _NUMBERED) >= 0 and (ch.isdigit() or ch == "№"):
        return False
    if _abbreviation(s, dot, start, _BIND) >= 0 or _inside_abbreviation(s, dot, start):
        return False
    at = _abbreviation(s, dot, start, _MAY_END)
    if at >= 0:
        if ch in PAUSES or ch in CLOSERS and ch not in OPENERS:
            return False
        unit = _abbreviation(s, dot, start, _UNITS) >= 0
        if ch.isdigit():
            return not unit
        if ch.islower():
            word = _WORD.match(s, nxt)
            return not unit and word is not None and _is_name(word.group())
        if not (ch.isupper() or ch in OPENERS):
            return True
        words = s[start:at].split()
        return not (len(words) <= 3 and words and words[0].lower() in TIME_OPENERS)
    if ch in PAUSES and ch not in "—–-":
        return False
    if _ordinal(s, start, dot):
        word = _WORD.match(s, nxt)
        if word and word.group().rstrip(".") in MONTHS:
            return False
    # an initial: one capital at the start, or after another initial or a title
    if dot > start and s[dot - 1].isupper() and ch.isupper():
        left = s[start : dot - 1].rstrip()
        if (not left and dot - 1 == start) or (left.endswith(".") and len(left.split()[-1]) <= 5 and left.split()[-1][:1].isupper()):
            return False
    return True


def _ordinal(s: str, start: int, dot: int) -> bool:
    """Whether a number of one or two digits ends at the point."""
    k = dot
    while k > start and dot - k < 3 and s[k - 1].isdecimal():
        k -= 1
    return 0 < dot - k < 3 and (k == start or not (s[k - 1].isalnum() or s[k - 1] in "_.,"))


def _with_markup(s: str, start: int, end: int) -> int:
    """Emphasis that opened at the start of a sentence and closes right after its mark belongs to it."""
    m = _MARKUP.match(s, start)
    if m:
        close = f"</{m.group(2)}>" if m.group(2) else m.group(1)[::-1]
        if s.startswith(close, end):
            return end + len(close)
    return end


def _block(s: str, offset: int, out: list[tuple[int, int]], stack: Pushdown) -> None:
    """Sentences of one block; ``offset`` is where its text starts in the document."""
    n = len(s)
    start = _SPACE.match(s, 0).end()
    if start >= n:
        return
    thai = _THAI.search(s) is not None
    events = _EVENTS_THAI if thai else _EVENTS
    pairs = stack.pairs(s)
    stack.word = (0, -1, False)
    at = start
    while True:
        m = events.search(s, at)
        if m is None:
            break
        i, ch = m.start(), s[m.start()]
        if i in pairs:
            close = pairs[i]
            at = close + 1
            if not _after_pair(s, start, i, close):
                continue
            end = at
            while end < n and s[end] in CLOSERS and end not in pairs:
                end += 1
        elif ch.isspace():
            at = m.end()
            # blanks at the end or the start of a line belong to the line break
            if at >= n or s[at] in "\r\n" or s[i - 1] in "\r\n" or not _THAI.search(s, start, i):
                continue
            end = i
        elif ch in TERMINATORS:
            end = _RUN.match(s, i).end()
            run = s[i:end]
            at = end
            while end < n and s[end] in CLOSERS and end not in pairs:
                end += 1
            nxt = _SPACE.match(s, end).end()
            if run == ".":
                if not _point_ends(s, start, i, nxt, stack):
                    continue
            elif nxt < n:
                if s[nxt] in PAUSES and s[nxt] not in "—–-":
                    continue
                if run[0] in ".…" and not set(run) & set("!?。！？") and s[nxt].islower():
                    w = _WORD.match(s, nxt)
                    if w is None or not any(c in w.group() for c in "/_"):
                        if s[i - 1 : i].isascii() or s[i - 1 : i].islower():
                            continue
        else:
            at = m.end()
            continue
        end = _with_markup(s, start, end)
        out.append((offset + start, offset + end))
        start = at = _SPACE.match(s, end).end()
        if start >= n:
            return
    end = n
    while end > start and s[end - 1].isspace():
        end -= 1
    if end > start:
        out.append((offset + start, offset + end))


def blocks(text: str, stack: Pushdown | None = None) -> Iterator[tuple[int, str]]:
    """(offset, text) of headings, list items and paragraphs; marks at the start of later lines are blanked out.

    Fenced code and lines that only part blocks give none. A numbered line
    opens an item at the start of a block, with the number 1, or if it goes on
    in a list that is open at its column, whatever lists lie in between.
    """
    stack = stack or Pushdown()
    parts: list[str] = []
    begin = 0
    fence = ""

    def flush() -> Iterator[tuple[int, str]]:
        nonlocal parts
        if parts:
            yield begin, "".join(parts)
        parts = []

    pos, n = 0, len(text)
    after_blank = True
    while pos < n:
        line = _LINE.match(text, pos).group()
        body, level = 0, 0
        while (q := _QUOTE.match(line, body)) is not None:
            body, level = q.end(), level + 1
        f = _FENCE.match(line, body)
        if fence:
            if f and f.group(1)[0] == fence[0] and len(f.group(1)) >= len(fence) and not line[f.end() :].strip():
                fence = ""
        elif f and not (f.group(1)[0] == "`" and "`" in line[f.end() :]):
            yield from flush()
            fence = f.group(1)
        elif not line[body:].strip():
            yield from flush()
            after_blank = True
        elif _RULE.match(line[body:].rstrip("\r\n")):
            yield from flush()
        else:
            h, b, num = _HEAD.match(line, body), _BULLET.match(line, body), _NUMBER.match(line, body)
            column = len(line) - len(line[body:].lstrip()) - body
            if after_blank and level != stack.depth():
                stack.leave()  # a quotation ends with a blank line, and its lists with it
            opens = h or b
            if num and not opens and (not parts or int(num.group(1)) == 1 or stack.follows(int(num.group(1)), column)):
                opens = num
            if level > stack.depth():
                if not opens and parts:
                    yield from flush()
                if opens or not parts:
                    stack.quote(level)
            if opens or not parts:
                yield from flush()
                body = opens.end() if opens else body
                if h or not opens:
                    stack.leave(0 if h else column)
                else:
                    stack.item(int(num.group(1)) if opens is num else None, column)
                if b and not h:  # a list within a list item
                    while (x := _BULLET.match(line, body)) is not None:
                        body = x.end()
                begin = pos + body
                parts.append(line[body:])
            else:
                parts.append(" " * body + line[body:])
            after_blank = False
            if h:
                yield from flush()
        pos += len(line)
    yield from flush()


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence in code points, end exclusive. Null and blank texts have none."""
    out: list[tuple[int, int]] = []
    if text:
        stack = Pushdown()
        for offset, s in blocks(text, stack):
            _block(s, offset, out, stack)
    return out


def sentence_offsets(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, sent_start, sent_end) of every document; no shuffle, whole texts.

    Null, empty and blank texts give no rows; equal texts under several ids
    give rows for each; other columns are not read. A document is one unit of
    work, its cost grows with its length.
    """
    kind = df.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids: list[int] = []
            found: list[tuple[int, int]] = []
            for k, t in enumerate(x.column(1).to_pylist()):
                s = sentences(t)
                found += s
                ids += [k] * len(s)
            yield pa.RecordBatch.from_arrays(
                [x.column(0).take(pa.array(ids, pa.int32())), pa.array([a for a, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int32())], names=["doc", "sent_start", "sent_end"]
            )

    got = df.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"doc {kind}, sent_start int, sent_end int")
    return got.withColumnRenamed("doc", doc)
