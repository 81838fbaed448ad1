"""Repair of text from scanned pages: cut words, misrecognised glyphs, running heads, page numbers, paragraphs over page ends.

Two passes over the texts, one exchange of narrow rows and a few small joins:

1. `lexicon`: every text's words are counted per task and summed by Spark. Words are grouped by confusable-glyph skeleton;
   of a group the frequent forms are kept, and the rarer ones that its main form does not dominate, so that every decision
   rests on true counts. Main forms have at least MIN_SHARE of all words, which bounds what is broadcast whatever the size of
   the corpus.
2. `annotate`: one pass that tells of each text which noise it holds, with the candidate lines for running heads (digits
   masked, glyphs folded) and the words at a text's ends. Texts are split at blanks by Arrow and each distinct part of a batch
   is looked at once, in both passes.
3. `facts`: the notes are brought together by scan, in reading order. Heads are keys printed at the top of two or more pages
   of a scan; a carry is a page's last paragraph and the first text of the next page. Held at once are the notes of one scan.
   Only heads whose other pages are lost wait for the counts of keys over all scans.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word belongs to the lexicon if it is at least this share of all words: the lexicon's size bound is its inverse.
MIN_SHARE = 2e-6
#: ... and occurs at least this often.
MIN_COUNT = 3
#: A form is a misreading if its group's main form is this many times as frequent.
DOMINANCE = 40

#: Glyphs that recognition confuses, each to the glyph or glyph pair of its class.
GLYPHS = {
    "0": "o", "1": "l", "|": "l", "!": "l", "i": "l", "5": "s", "8": "b", "6": "b", "9": "g", "2": "z", "+": "t", "e": "c",
    "h": "ll", "u": "ll", "d": "cl", "w": "vv", "m": "ln",
}
#: Letters that stand for figures when a figure is misread.
FIGURE_LETTERS = "OolISBZzsGg"
#: Words around a page number, and between it and the number of pages.
PAGE_WORDS = ("page", "seite", "pág", "pag", "página", "pagina", "blz", "стр", "p", "s")
OF_WORDS = ("of", "von", "sur", "de", "di", "van", "из")

_TABLE = str.maketrans(GLYPHS)
_WORD = re.compile(r"[^\W_][\w+|!]*(?:['’-][^\W_][\w+|!]*)*")
#: Stands between the items of a list where they pass to Python as one text (lists of cells and blocks together pass slowly).
SEPARATOR = "\x1e\x1f"
_MARK = re.compile(r"([-‐¬\xad])[ \t]*\n")
_LEFT = re.compile(r"[^\W_][\w+|!]*$")
_CUT_END = re.compile(r"([^\W_]+)([-‐¬\xad])$")
_OPEN_END = re.compile(r"([^\W_][\w+|!]*)([-‐¬\xad])$")
_WIDE = re.compile(r"\s{2,}")
_SET_OFF = re.compile(r"\s{2,}|\s[|·–—~-]\s")
_HEAD_WORD = re.compile(r"[^\W_][\w+|]*")
_RIGHT = re.compile(r"[^\W_][\w+|!]*")
_PAGE_LINE = re.compile(rf"[\s\-–—~\[\](|.]*(?:(?:{'|'.join(PAGE_WORDS)})\b\.?\s*)?(\d+|[lIO]\d*|[ivxlc]+)(?:\s*(?:/|{'|'.join(OF_WORDS)})\s*(?:\d+|[ivxlc]+))?[\s\-–—~\[\])|.]*", re.I)
#: What such a line can begin and end with.
_PAGE_START = re.compile(rf"[\s\-–—~\[\](|.\d{''.join(sorted({w[0] for w in PAGE_WORDS}))}lioivxlc]", re.I)
_PAGE_END = re.compile(r"[\s\-–—~\[\])|.\dlioivxlc]", re.I)
_FIGURE = re.compile(rf"(?:[$€£]|EUR|USD|GBP)? ?[\d{FIGURE_LETTERS}]+(?:[.,][\d{FIGURE_LETTERS}]+)*(?: ?(?:kg|€|%))?")
#: A figure with a decimal or grouping mark and a letter for a digit; without such a mark it may be a code.
_FIGURE_IN_TEXT = re.compile(rf"(?<![\w.,/@-])(?=[^\s]*\d)(?=[\d.,]*[{FIGURE_LETTERS}])[\d{FIGURE_LETTERS}]+(?:[.,][\d{FIGURE_LETTERS}]+)+(?![\w@/-])")
_UNIT = re.compile(r" ?(?:kg|€|%)\s*$")
_CURRENCY = re.compile(r"\s*(?:[$€£]|EUR|USD|GBP)")
_MIXED = re.compile(rf"[\d{FIGURE_LETTERS}]+")
_TO_DIGITS = str.maketrans("OolISBZzsGg", "00115822569")


def ended(line: str) -> bool:
    """Whether a line ends as a sentence does."""
    return line.rstrip().rstrip("\"'»”)]")[-1:] in (".", "!", "?", ":", ";", "…")


def fold(word: str) -> str:
    """Lower case without accents."""
    w = word.lower()
    if w.isascii():
        return w
    return "".join(c for c in unicodedata.normalize("NFD", w.replace("ß", "ss")) if not unicodedata.combining(c))


def skeleton(word: str) -> str:
    """The confusable-glyph skeleton of a folded word."""
    return word.replace("rn", "m").translate(_TABLE)


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text)


def word_counts(texts: DataFrame) -> DataFrame:
    """word (folded), n, spelt (its most frequent spelling in lower case), skel over the `text` and `items` columns: partial
    counts per task, summed by word. Hot words are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()  # of the parts between blanks: no word has one

        def told() -> pa.RecordBatch:
            low: Counter[str] = Counter()
            for part, n in counts.items():
                for w in _tokens(part):
                    low[w.lower()] += n
            words = [fold(w) for w in low]
            return pa.RecordBatch.from_pydict({"word": words, "low": list(low), "skel": [skeleton(w) for w in words], "n": list(low.values())})

        for b in batches:
            for column in b.columns:
                parts = pc.ascii_split_whitespace(column).flatten().value_counts()
                for part, n in zip(parts.field(0).to_pylist(), parts.field(1).to_pylist()):
                    counts[part] += n
            if len(counts) > 500_000:  # a bound for memory: what is there goes out as a part
                yield told()
                counts.clear()
        if counts:
            yield told()

    part = texts.select("text", F.array_join("items", "\n").alias("items")).mapInArrow(run, "word string, low string, skel string, n bigint")
    return part.groupBy("word", "low", "skel").agg(F.sum("n").alias("n")).groupBy("word", "skel").agg(F.sum("n").alias("n"), F.max(F.struct("n", "low"))["low"].alias("spelt"))


class Verdicts(dict):
    """Whether a token is a misreading (1), may be part of a misread figure (2) or neither (0), by token."""

    def __init__(self, lex: Lexicon):
        self.lex = lex

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = v = 1 if any(self.lex.reading(x) for x in re.split("['’-]", w)) else 2 if _MIXED.fullmatch(w) and any(c.isdigit() for c in w) and not w.isdigit() else 0
        return v


class PartVerdicts(dict):
    """The verdicts of the words in a part of a text between blanks as bits: 1 for a misreading, 2 for a part of a figure."""

    def __init__(self, verdicts: Verdicts):
        self.verdicts = verdicts

    def __missing__(self, part: str) -> int:
        if len(self) > 500_000:
            self.clear()
        v = 0
        for w in _tokens(part):
            v |= self.verdicts[w]
        self[part] = v
        return v


class Firsts(dict):
    """Whether a character (or none, for an empty line) matches a pattern of one character."""

    def __init__(self, pattern: re.Pattern):
        self.pattern = pattern

    def __missing__(self, c: str) -> bool:
        self[c] = v = bool(self.pattern.match(c))
        return v


_STARTS, _ENDS = Firsts(_PAGE_START), Firsts(_PAGE_END)


class Lexicon:
    """Frequent forms and the main form of each skeleton, from (folded word, n, spelling)."""

    def __init__(self, rows: list[tuple]):
        counts: Counter[str] = Counter()
        self.spelt: dict[str, str] = {}
        for w, n, *spelt in rows:
            counts[fold(w)] += n
            self.spelt[fold(w)] = spelt[0] if spelt else w
        self.main: dict[str, str] = {}
        for w, n in counts.items():
            k = skeleton(w)
            if w.replace("-", "").replace("'", "").replace("’", "").isalpha() and (k not in self.main or (n, w) > (counts[self.main[k]], self.main[k])):
                self.main[k] = w
        self.counts = counts
        self.misread: dict[str, str | None] = {}
        self.verdicts = Verdicts(self)
        self.parts = PartVerdicts(self.verdicts)

    def known(self, w: str) -> bool:
        return fold(w) in self.counts

    def reading(self, word: str) -> str | None:
        """The main form where the word is a misreading of it, else None."""
        if word in self.misread:
            return self.misread[word]
        out, w = None, fold(word)
        letters, digits = sum(c.isalpha() for c in w), sum(c.isdigit() for c in w)
        if letters >= 2 and letters > digits and (len(w) >= 3):
            main = self.main.get(skeleton(w))
            if main is not None and main != w and self.counts[main] >= DOMINANCE * max(1, self.counts.get(w, 0)) and (len(w) >= 4 or not w.isalpha()):
                out = main
        if len(self.misread) > 2_000_000:
            self.misread.clear()
        self.misread[word] = out
        return out

    def cut(self, left: str, mark: str, right: str) -> bool:
        """Whether the mark between left and right must vanish when the line is joined."""
        if not left or not right or not left[-1].isalpha() or not right[0].isalpha() or any(c.isdigit() and c not in "01596" for c in left + right):
            return False
        if mark in "¬\xad":
            return True
        l, r = fold(left), fold(right)
        joined, spelt = l + r, f"{l}-{r}"
        a, b = self.counts.get(joined, 0), self.counts.get(spelt, 0)
        if a or b:
            return a >= b
        if skeleton(joined) in self.main:
            return True
        if skeleton(spelt) in self.main or right[0].isupper():
            return False
        return not (l in self.counts and r in self.counts and min(len(l), len(r)) >= 4)


def lexicon(texts: DataFrame) -> list[tuple[str, int, str]]:
    """The corpus's frequent words with counts, at most 1 / MIN_SHARE of them, and the rarer words that share a skeleton with
    one of them without being dominated by it: those have at least MIN_SHARE / DOMINANCE of all words, and are few."""
    counts = word_counts(texts).persist()
    try:
        total = counts.agg(F.sum("n").alias("n")).first().n or 0
        least = max(MIN_COUNT, MIN_SHARE * total)
        often = counts.where(F.col("n") >= least)
        main = often.groupBy("skel").agg(F.max("n").alias("most"))
        rival = counts.where((F.col("n") < least) & (F.col("n") * DOMINANCE > least)).join(main, "skel").where(F.col("n") * DOMINANCE > F.col("most"))
        return [(r.word, r.n, r.spelt) for r in often.select("word", "n", "spelt").unionByName(rival.select("word", "n", "spelt")).collect()]
    finally:
        counts.unpersist()


def texts_of(block: DataFrame, cell: DataFrame) -> DataFrame:
    """All texts the problem is about: blocks with their list items, and cells."""
    none = lambda t: F.lit(None).cast(t)
    blocks = block.select(F.lit("block").alias("src"), F.col("block_id").alias("row_id"), F.coalesce("text", F.lit("")).alias("text"), "items", "scan_id", "page_number", "block_pos", "type")
    cells = cell.where("text is not null and text != ''").select(F.lit("cell").alias("src"), F.col("cell_id").alias("row_id"), "text", none("array<string>").alias("items"), none("bigint").alias("scan_id"), none("int").alias("page_number"), none("int").alias("block_pos"), none("string").alias("type"))
    return blocks.unionByName(cells)


def page_line(line: str, page: int | None) -> bool:
    """Whether a line is the page's number, alone or with words or marks."""
    if page is None or not line or line.isspace():
        return False
    m = _PAGE_LINE.fullmatch(line.strip())
    return bool(m) and (m[1].translate(str.maketrans("lIO", "110")) == str(page) or m[1].lower() == roman(page))


def roman(n: int) -> str:
    """A number in small Roman figures."""
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + sign * (n // value), n % value
    return out


def head_parts(line: str, page: int | None) -> tuple[str, bool]:
    """A line without the page's number at one of its ends (set off by wide space or a mark), and whether one was there."""
    parts = [p for p in _SET_OFF.split(line.strip()) if p]
    if len(parts) > 1 and page is not None:
        if page_line(parts[0], page):
            return "  ".join(parts[1:]), True
        if page_line(parts[-1], page):
            return "  ".join(parts[:-1]), True
    return line.strip(), False


_KEYS: dict[str, str] = {}


def head_key(line: str) -> str:
    """A head's key: letters folded by glyph, digits masked, nothing else."""
    words = []
    for w in _HEAD_WORD.findall(line):
        if (k := _KEYS.get(w)) is None:
            if len(_KEYS) > 200_000:
                _KEYS.clear()
            figures = sum(c.isdigit() for c in w)
            k = _KEYS[w] = re.sub(r"\d+", "9", w.lower()) if figures and len(w) < 3 * figures and len(w) < 6 else skeleton(fold(w))
        words.append(k)
    return "".join(words)


def head_keys(line: str) -> list[str]:
    """The keys a line can have as a head: the whole, and what follows a first part set off by wide space."""
    parts = [p for p in _WIDE.split(line) if p]
    keys = [head_key(line)] + ([head_key(" ".join(parts[1:]))] if len(parts) > 1 else [])
    return [k for k in dict.fromkeys(keys) if len(k) >= 4]


def joined(text: str, page: int | None, lex: Lexicon) -> str:
    """The text with its cut words joined, also over one line that is the page's number."""
    out, at = [], 0
    for m in _MARK.finditer(text):
        before = text[max(0, m.start() - 40) : m.start()]
        left = _LEFT.search(before, before.rfind(" ") + 1)
        right = _RIGHT.match(text, m.end())
        if left and not (right and lex.cut(left[0], m[1], right[0])):
            line, _, _ = text[m.end() :].partition("\n")
            right = _RIGHT.match(text, m.end() + len(line) + 1) if page_line(line, page) else None
            right = right if right and lex.cut(left[0], m[1], right[0]) else None
        if left and right:
            out.append(text[at : m.start()])
            at = right.start()
    return text if not out else "".join(out) + text[at:]


def over_break(text: str, page: int | None, lex: Lexicon) -> bool:
    """Whether a word is cut by a page end within the text: a page number, a head or both stand between its parts."""
    lines = text.split("\n")
    for i, line in enumerate(lines[:-2]):
        line = line.rstrip()
        if line[-1:] in ("-", "‐", "¬", "\xad") and (m := _CUT_END.search(line)):
            for j in (i + 2, i + 3):
                r = re.match(r"[^\W_]+", lines[j]) if j < len(lines) else None
                between = all(page_line(x, page) or x[:1].isupper() or x[:1].isdigit() for x in lines[i + 1 : j])
                if r and between and fold(m[1] + r[0]) in lex.counts and lex.cut(m[1], m[2], r[0]):
                    return True
    return False


_HEAD = pa.struct([("line", pa.int32()), ("key", pa.string()), ("page", pa.int32()), ("numbered", pa.bool_())])
#: Bits of a note and of the facts of kind FLAGS: kinds of noise, then what a block is within its page.
HYPHEN, MISREAD, PAGE_NO, BODY, OPEN, ONE_LINE, PARAGRAPH = (1 << i for i in range(7))
NOISE = HYPHEN | MISREAD | PAGE_NO
_NOTE = pa.schema(
    [
        ("row_id", pa.int64()), ("item_pos", pa.int32()), ("scan_id", pa.int64()), ("page_number", pa.int32()), ("block_pos", pa.int32()),
        ("bits", pa.int32()), ("heads", pa.list_(_HEAD)), ("tail", pa.string()), ("start", pa.string()),
    ]
)
_NOTE_DDL = (
    "row_id bigint, item_pos int, scan_id bigint, page_number int, block_pos int, bits int, "
    "heads array<struct<line:int,key:string,page:int,numbered:boolean>>, tail string, start string"
)


def noise_of(texts: pa.Array, lex: Lexicon, pages: list[int | None] | None = None, cells: bool = False) -> np.ndarray:
    """HYPHEN and MISREAD of each of the texts (none null), as bits. Words are judged once for each distinct part between
    blanks; only texts with a cut word or what may be a figure are looked at one by one."""
    out = np.zeros(len(texts), np.int32)
    if not len(texts):
        return out
    changed = {}
    for i in np.flatnonzero(pc.match_substring_regex(texts, _MARK.pattern).to_numpy(zero_copy_only=False)).tolist():
        text, page = texts[i].as_py(), pages[i] if pages else None
        flat = joined(text, page, lex)
        if len(flat) < len(text):
            changed[i] = flat
        if i in changed or over_break(text, page, lex):
            out[i] = HYPHEN
    if changed:
        mask = np.zeros(len(texts), bool)
        mask[list(changed)] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(changed.values(), texts.type))
    parts = pc.ascii_split_whitespace(texts)
    words = parts.flatten().dictionary_encode()
    verdicts = np.fromiter(map(lex.parts.__getitem__, words.dictionary.to_pylist()), np.int8, len(words.dictionary))
    said = np.bitwise_or.reduceat(verdicts[words.indices.to_numpy()], parts.offsets.to_numpy()[:-1])  # every text has a part
    out[(said & 1) > 0] |= MISREAD
    for i in np.flatnonzero(said == 2).tolist():
        if _FIGURE_IN_TEXT.search(texts[i].as_py()):
            out[i] |= MISREAD
    if cells:
        may = pc.and_(pc.match_substring_regex(texts, r"\pN"), pc.match_substring_regex(texts, f"[{FIGURE_LETTERS}]"))
        for i in np.flatnonzero(may.to_numpy(zero_copy_only=False) & (out & MISREAD == 0)).tolist():
            if figure_cell(texts[i].as_py()):
                out[i] |= MISREAD
    return out


def figure_cell(text: str) -> bool:
    """Whether a cell is a figure with a letter for a digit."""
    if not any(c.isdigit() for c in text) or not any(c in FIGURE_LETTERS for c in text):
        return False
    t = text.strip()
    m = _FIGURE.fullmatch(t)
    return bool(m) and any(c in FIGURE_LETTERS for c in _UNIT.sub("", t)) and sum(c.isdigit() or c in FIGURE_LETTERS for c in t) > 1


def right_figures(text: str, cell: bool) -> str:
    """The text with its misread figures put right: letters for digits within a figure become digits."""
    if cell and figure_cell(text):
        unit = _UNIT.search(text)
        body, tail = (text[: unit.start()], text[unit.start() :]) if unit else (text, "")
        head = _CURRENCY.match(body)
        return (head[0] if head else "") + body[head.end() if head else 0 :].translate(_TO_DIGITS) + tail
    return _FIGURE_IN_TEXT.sub(lambda m: m[0].translate(_TO_DIGITS), text)


def noise_in_short(text: str, lex: Lexicon, cell: bool) -> tuple[bool, bool]:
    """(hyphen, misread) of a list item or a cell."""
    bits = noise_of(pa.array([text]), lex, None, cell)[0]
    return bool(bits & HYPHEN), bool(bits & MISREAD)


def annotate_batch(b: pa.RecordBatch, lex: Lexicon) -> pa.RecordBatch:
    """The notes of a batch of blocks; items without noise give no row, nor do blocks without noise that take no part in pages."""
    row_id, text, items, scan, page, pos, kind = (b.column(n) for n in ("row_id", "text", "items", "scan_id", "page_number", "block_pos", "type"))
    pages = page.to_pylist()
    bits = noise_of(text, lex, pages) | BODY | ONE_LINE
    n = len(b)
    tails, starts = [None] * n, [None] * n
    heads: list[tuple] = []
    owner: list[int] = []  # the row of each head
    lined = pc.and_(pc.is_valid(page), pc.fill_null(pc.is_in(kind, pa.array(["paragraph", "heading"])), False))
    lined = np.flatnonzero(lined.to_numpy(zero_copy_only=False))
    chosen = pa.array(lined)
    for r, t, pos_, paragraph in zip(lined.tolist(), text.take(chosen).to_pylist(), pos.take(chosen).to_pylist(), pc.equal(kind.take(chosen), "paragraph").to_pylist()):
        p, v = pages[r], int(bits[r]) & ~(BODY | ONE_LINE)
        lines = t.split("\n")
        one = len(lines) == 1
        at = [i for i, x in enumerate(lines) if _STARTS[x[:1]] and _ENDS[x[-1:]] and page_line(x, p)] if paragraph else []
        rest = [i for i in range(len(lines)) if i not in at] if at else range(len(lines))
        if rest:
            if t and not t.isspace():
                v |= BODY
            width = 0
            for i in rest:
                if i == 0:
                    if pos_ and paragraph and not one:
                        continue
                    q = p
                else:
                    line = lines[i]
                    if not line[:1].isupper():
                        continue
                    width = width or max(map(len, lines))
                    if not (i - 1 in at or (len(line) == width or i + 1 < len(lines) and len(line) + 1 + len(lines[i + 1].split(" ", 1)[0]) <= width) and "." not in line):
                        continue
                    q = p + 1
                bare, numbered = head_parts(lines[i], q)
                if len(bare) >= 4 and not ended(bare):
                    for k in head_keys(bare):
                        heads.append((i, k, q, numbered))
                        owner.append(r)
            last = lines[rest[-1]].rstrip()
            if paragraph and not ended(last):
                v |= OPEN
                if last[-1:] in ("-", "‐", "¬", "\xad") and (m := _OPEN_END.search(last)):
                    tails[r] = m[1] + m[2]
            first = [_RIGHT.match(lines[i].lstrip()) for i in rest[:2]]
            starts[r] = "\n".join(m[0] if m else "" for m in first)
        bits[r] = v | (ONE_LINE if one else 0) | (PARAGRAPH if paragraph else 0) | (PAGE_NO if at else 0)
    count = np.bincount(np.array(owner, np.int64), minlength=n)
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    fields = list(zip(*heads)) if heads else [[]] * 4
    head = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(fields, _HEAD)], fields=list(_HEAD)))
    paged = pc.and_(pc.is_valid(scan), pc.is_valid(page)).to_numpy(zero_copy_only=False)
    kept = pa.array(((bits & NOISE) > 0) | (paged & (((bits & BODY) > 0) | (count > 0))))
    whole = [row_id, pa.array(np.full(n, -1, np.int32)), scan, page, pos, pa.array(bits), head, pa.array(tails, pa.string()), pa.array(starts, pa.string())]
    blocks = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(whole, _NOTE)], schema=_NOTE).filter(kept)
    noisy = noise_of(pc.fill_null(items.flatten(), ""), lex)
    if not noisy.any():
        return blocks
    at = np.flatnonzero(noisy)
    parent = pc.list_parent_indices(items).to_numpy()[at]
    length = pc.fill_null(pc.list_value_length(items), 0).to_numpy()
    place = at - (np.cumsum(length) - length)[parent]
    own = [row_id.take(pa.array(parent)).cast(pa.int64()), pa.array(place.astype(np.int32)), *(pa.nulls(len(at), f.type) for f in list(_NOTE)[2:5]), pa.array(noisy[at]), *(pa.nulls(len(at), f.type) for f in list(_NOTE)[6:])]
    both = pa.Table.from_batches([blocks, pa.RecordBatch.from_arrays(own, schema=_NOTE)]).combine_chunks()
    return both.to_batches()[0]


def annotate(texts: DataFrame, words: list[tuple]) -> DataFrame:
    """Notes of all blocks (see annotate_batch), with the lexicon broadcast once."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(shared)
        for b in batches:
            yield annotate_batch(b, lex)

    return texts.where("src = 'block'").mapInArrow(run, _NOTE_DDL)


def annotate_cells(texts: DataFrame, words: list[tuple]) -> DataFrame:
    """row_id, bits of the cells with noise; cells without a letter can have none."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(shared)
        for b in batches:
            bits = noise_of(b.column(1), lex, None, True)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(bits)], ["row_id", "bits"]).filter(pa.array(bits > 0))

    lettered = texts.where("src = 'cell' and upper(text) <> lower(text)").select("row_id", "text")
    return lettered.mapInArrow(run, "row_id bigint, bits int")


_BUILT: dict[int, Lexicon] = {}


def _lexicon(shared) -> Lexicon:
    """The lexicon of a broadcast, built once for a Python worker."""
    key = shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared.value)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Lexicon(shared.value)
    return _BUILT[key]


#: Kinds of facts: noise of a text; a head; a key with its sure heads (a) and all its lines (b); a line that is a head if its
#: key is one elsewhere; a carry to block a; one to block a or, if the line 0 of block b is such a head, to block c.
FLAGS, HEAD, KEY, MAYBE, CARRY, EITHER = range(6)
_FACT_DDL = "what int, row_id bigint, item_pos int, scan_id bigint, page int, bits int, key string, a bigint, b bigint, c bigint"
_FACT = pa.schema([("what", pa.int32()), ("row_id", pa.int64()), ("item_pos", pa.int32()), ("scan_id", pa.int64()), ("page", pa.int32()), ("bits", pa.int32()), ("key", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])
#: Bits of heads and of carries.
WHOLE, NUMBERED = 1, 2
CUT, CUT_AFTER_HEAD = 1, 2


def scan_facts(scan: int, blocks: list[tuple], lex: Lexicon, keys: dict[str, list[int]]) -> list[tuple]:
    """The heads and carries of a scan from its blocks (page, row_id, bits, heads (line, key, page, numbered), tail, start) in
    reading order; its keys are added to `keys`.

    A head is a key that stands at the top of at least two pages after the first; a carry is a last paragraph without an end
    whose next page begins, after its head, with a paragraph.
    """
    out: list[tuple] = []
    ends: dict[int, list[tuple]] = {}  # the first two and the last block with content of each page
    printed: list[tuple] = []
    for block in blocks:
        page, row_id, bits, heads, _, _ = block
        if bits & BODY:
            if (of := ends.get(page)) is None:
                of = ends[page] = [block, None, block]
                if page > 1:
                    printed += [(row_id, h, bits & ONE_LINE > 0) for h in heads if h[0] == 0]
            else:
                of[1] = of[1] or block
                of[2] = block
        for h in heads:
            if h[0] == 0:
                keys.setdefault(h[1], [0, 0])[1] += 1
            else:
                printed.append((row_id, h, False))
    span: dict[str, tuple[int, int]] = {}
    for _, (_, key, page, _), _ in printed:
        low, high = span.get(key, (page, page))
        span[key] = min(low, page), max(high, page)
    sure: dict[tuple, int] = {}
    for row_id, (line, key, page, numbered), one in printed:
        low, high = span[key]
        if low < high:
            place = (row_id, line, page, one)
            sure[place] = sure.get(place, one * WHOLE) | numbered * NUMBERED
            if line == 0:
                keys[key][0] += 1
    out += [(HEAD, row_id, line, scan, page, bits, None, None, None, None) for (row_id, line, page, _), bits in sure.items()]
    led = {row_id for row_id, line, _, _ in sure if line == 0}
    maybe = [(row_id, h, one) for row_id, h, one in printed if h[0] == 0 and row_id not in led]
    out += [(MAYBE, row_id, 0, scan, page, one * WHOLE | numbered * NUMBERED, key, None, None, None) for row_id, (_, key, page, numbered), one in maybe]
    open_ = {row_id for row_id, _, _ in maybe}
    for page, (_, _, (_, row_id, bits, _, tail, _)) in ends.items():
        if not (bits & OPEN and bits & PARAGRAPH) or (after := ends.get(page + 1)) is None:
            continue

        def goes_on(head: bool) -> tuple[int | None, bool]:
            """The block it goes on in, if any, and whether a word is cut, where the next page's first block begins with a head or not."""
            top, second = after[0], after[1]
            begin = top
            if head and top[2] & ONE_LINE:
                begin = second if second and second[1] != top[1] else None
            if begin is None or not begin[2] & PARAGRAPH or begin[1] == row_id:
                return None, False
            starts = (begin[5] or "").split("\n")[1 if head and begin[1] == top[1] else 0 :]
            return begin[1], bool(tail) and lex.cut(tail[:-1], tail[-1], starts[0] if starts else "")

        top = after[0][1]
        to, is_cut = goes_on(top in led)
        if top not in open_:
            if to is not None:
                out.append((CARRY, row_id, None, scan, page, is_cut * CUT, None, to, None, None))
        else:
            other, other_cut = goes_on(True)
            if to is not None or other is not None:
                out.append((EITHER, row_id, None, scan, page, is_cut * CUT | other_cut * CUT_AFTER_HEAD, None, to, top, other))
    return out


def facts(notes: DataFrame, words: list[tuple]) -> DataFrame:
    """The facts of all scans (see FLAGS to EITHER) from the notes, which are brought together by scan; those without a scan only
    bring their noise and are spread."""
    shared = notes.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(shared)
        keys: dict[str, list[int]] = {}
        blocks: list[tuple] = []
        at = None

        def told(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * len(_FACT)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FACT)], schema=_FACT)

        def key_rows() -> list[tuple]:
            rows = [(KEY, None, None, None, None, None, k, n, of, None) for k, (n, of) in keys.items()]
            keys.clear()
            return rows

        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            bits = cols["bits"].to_numpy() & NOISE
            noisy = pa.RecordBatch.from_arrays([pa.array(np.full(len(b), FLAGS, np.int32)), cols["row_id"], cols["item_pos"], *(pa.nulls(len(b), f.type) for f in list(_FACT)[3:5]), pa.array(bits), *(pa.nulls(len(b), f.type) for f in list(_FACT)[6:])], schema=_FACT)
            yield noisy.filter(pa.array(bits > 0))
            paged = b.filter(pc.and_(pc.is_valid(cols["scan_id"]), pc.is_valid(cols["page_number"])))
            heads = paged.column("heads")
            flat = list(zip(*(c.to_pylist() for c in heads.flatten().flatten())))
            stop = np.cumsum(pc.fill_null(pc.list_value_length(heads), 0).to_numpy()).tolist()
            of = [flat[i:j] if i < j else () for i, j in zip([0, *stop], stop)]
            scans, pages, ids, kinds = (paged.column(n).to_numpy().tolist() for n in ("scan_id", "page_number", "row_id", "bits"))
            rows: list[tuple] = []
            for scan, block in zip(scans, zip(pages, ids, kinds, of, paged.column("tail").to_pylist(), paged.column("start").to_pylist())):
                if scan != at:
                    rows += scan_facts(at, blocks, lex, keys)
                    at, blocks = scan, []
                blocks.append(block)
            if len(keys) > 200_000:  # a bound for memory: what is there goes out as a part
                rows += key_rows()
            yield told(rows)
        yield told(scan_facts(at, blocks, lex, keys) + key_rows())

    together = notes.repartition(F.coalesce("scan_id", "row_id")).sortWithinPartitions("scan_id", "page_number", "block_pos", "row_id")
    return together.mapInArrow(run, _FACT_DDL)


def structure(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads (row_id, line, numbered) and carries (scan_id, page_number, row_id, next_id, hyphen) from the facts. A head whose
    other pages are lost is one whose key is a head elsewhere more often than anything else."""
    usual = told.where(F.col("what") == KEY).groupBy("key").agg(F.sum("a").alias("n"), F.sum("b").alias("all")).where("n >= 3 and n >= 0.5 * all").select("key")
    single = told.where(F.col("what") == MAYBE).join(usual, "key", "left_semi").select("row_id", "item_pos", "bits")
    numbered = F.col("bits").bitwiseAND(NUMBERED) > 0
    head = told.where(F.col("what") == HEAD).select("row_id", "item_pos", "bits").unionByName(single).select("row_id", F.col("item_pos").alias("line"), numbered.alias("numbered"))
    led = single.select(F.col("row_id").alias("b"), F.lit(True).alias("_led")).distinct()
    either = told.where(F.col("what") == EITHER).join(led, "b", "left")
    is_led = F.col("_led").isNotNull()
    place = ["scan_id", F.col("page").alias("page_number"), "row_id"]
    carry = told.where(F.col("what") == CARRY).select(*place, F.col("a").alias("next_id"), (F.col("bits").bitwiseAND(CUT) > 0).alias("hyphen"))
    late = either.select(*place, F.when(is_led, F.col("c")).otherwise(F.col("a")).alias("next_id"), (F.col("bits").bitwiseAND(F.when(is_led, CUT_AFTER_HEAD).otherwise(CUT)) > 0).alias("hyphen"))
    return head, carry.unionByName(late.where("next_id is not null"))


def _prepared(block: DataFrame, cell: DataFrame) -> tuple[DataFrame, list[tuple], DataFrame]:
    from scriptorium.session import checkpoint

    texts = texts_of(block, cell)
    words = lexicon(texts)
    return texts, words, checkpoint(facts(annotate(texts, words), words))


def find(block: DataFrame, cell: DataFrame) -> DataFrame:
    """src, row_id, item_pos, kind: one row for each text and kind of noise in it (hyphen, misread, header, page_no, carry).

    Null and empty texts hold no noise; repeated rows count once per id; empty tables give no rows; extra columns are
    ignored. Blocks without scan or page can't have header, page_no or carry.
    """
    texts, words, told = _prepared(block, cell)
    head, carry = structure(told)
    flags = told.where(F.col("what") == FLAGS).select(F.when(F.col("item_pos") < 0, "block").otherwise("item").alias("src"), "row_id", "item_pos", "bits")
    flags = flags.unionByName(annotate_cells(texts, words).select(F.lit("cell").alias("src"), "row_id", F.lit(-1).alias("item_pos"), "bits"))
    flags = flags.selectExpr("src", "row_id", "item_pos", f"stack(3, 'hyphen', {HYPHEN}, 'misread', {MISREAD}, 'page_no', {PAGE_NO}) as (kind, bit)", "bits").where("bits & bit > 0").drop("bit", "bits")
    row = lambda df, kind: df.select(F.lit("block").alias("src"), "row_id", F.lit(-1).alias("item_pos"), F.lit(kind).alias("kind"))
    parts = [flags, row(head, "header"), row(head.where("numbered"), "page_no"), row(carry, "carry"), row(carry.where("hyphen"), "hyphen")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def repair_text(text: str, lex: Lexicon, page: int | None, head_lines: list[int], paragraph: bool, cell: bool = False) -> str:
    """A text without heads and page numbers, with cut words joined, misread words in their main form (capitals kept), misread
    figures put right and its lines reflowed into one."""
    lines = text.split("\n")
    keep = [x for i, x in enumerate(lines) if i not in head_lines and not (paragraph and page_line(x, page))]

    def word(m: re.Match) -> str:
        w = m[0]
        main = lex.reading(w)
        if main is None:
            return w
        main = lex.spelt[main]
        return main.upper() if w.isupper() and len(w) > 1 else main.capitalize() if w[0].isupper() else main

    flat = right_figures(joined("\n".join(keep), None, lex), cell)
    return re.sub(r"\s+", " ", re.sub(r"[^\W_][\w+|!]*", word, flat)).strip()


def repair(block: DataFrame, cell: DataFrame) -> DataFrame:
    """src, row_id, item_pos, text: every text repaired; a paragraph over page ends is one text under the block where it
    begins, its later blocks have text null. Each text passes once; chains of carries are told apart by a window over the
    carries of a scan (at most one a page)."""
    from pyspark.sql import Window as W

    texts, words, told = _prepared(block, cell)
    head, carry = structure(told)
    shared = texts.sparkSession.sparkContext.broadcast(words)
    lines = head.groupBy("row_id").agg(F.collect_set("line").alias("lines")).select(F.lit("block").alias("src"), "row_id", "lines")
    schema = "src string, row_id bigint, item_pos int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = _lexicon(shared)
        for b in batches:
            rows = []
            for src, row_id, text, items, page, kind, ls in zip(*(c.to_pylist() for c in b.columns)):
                rows.append((src, row_id, -1, repair_text(text, lex, page, ls or [], kind == "paragraph", src == "cell")))
                rows += [("item", row_id, i, repair_text(x, lex, None, [], False)) for i, x in enumerate(items.split(SEPARATOR) if items else ()) if x]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string()))], ["src", "row_id", "item_pos", "text"])

    clean = texts.join(lines, ["src", "row_id"], "left").select("src", "row_id", "text", F.array_join("items", SEPARATOR, "").alias("items"), "page_number", "type", "lines").mapInArrow(run, schema)
    w = W.partitionBy("scan_id").orderBy("page_number")
    chain = carry.withColumn("_new", F.when(F.lag("next_id").over(w) == F.col("row_id"), 0).otherwise(1))
    chain = chain.withColumn("_chain", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_root", F.first("row_id").over(W.partitionBy("scan_id", "_chain").orderBy("page_number")))
    member = chain.select(F.col("_root").alias("root"), F.col("next_id").alias("row_id"), F.col("page_number").alias("at"), "hyphen")
    member = member.unionByName(chain.where("_root = row_id").select(F.col("_root").alias("root"), "row_id", F.lit(-1).alias("at"), F.lit(False).alias("hyphen")))
    inside = clean.where("src = 'block'").join(member, "row_id")
    joined = inside.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "hyphen", "text"))).alias("parts"))
    glue = F.aggregate("parts", F.lit(""), lambda acc, p: F.when(p["hyphen"], F.concat(F.regexp_replace(acc, "[-‐¬­]$", ""), p["text"])).when(acc == "", p["text"]).otherwise(F.concat(acc, F.lit(" "), p["text"])))
    whole = joined.select(F.lit("block").alias("src"), F.col("root").alias("row_id"), F.lit(-1).alias("item_pos"), glue.alias("_whole"))
    later = member.where("row_id <> root").select(F.lit("block").alias("src"), "row_id", F.lit(-1).alias("item_pos"), F.lit(True).alias("_later")).distinct()
    out = clean.join(whole, ["src", "row_id", "item_pos"], "left").join(later, ["src", "row_id", "item_pos"], "left")
    return out.select("src", "row_id", "item_pos", F.when(F.col("_later"), F.lit(None)).otherwise(F.coalesce("_whole", "text")).alias("text"))
