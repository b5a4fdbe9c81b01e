"""Sentences of documents in all languages and scripts (problem 8).

Method: candidate boundaries (end marks with their closing quotes and brackets, white space after Thai) are generated
by one scan and classified by a maximum-entropy model over the neighbouring tokens, letter case, length, digits,
script and mark. The model is trained without labelled text, on boundaries that the layout makes reliable: a mark that
ends a paragraph or list item ends a sentence, one before a small letter or a comma does not, and tokens that
stand before marks often but never at the end of a paragraph (or after marks, but never at the start of one) do not
part sentences. Blank lines, form feeds and list items are boundaries by definition and need no model.
All offsets are code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents the model is fitted on, taken by the order of a hash of their ids, and different candidates (with their
#: contexts) that the driver takes of these, the most frequent first; bounds, whatever the corpus holds.
SAMPLE_DOCS, SAMPLE_ROWS = 3000, 200_000
#: Common abbreviations that hardly ever close a sentence; a prior for tokens the sample lacks.
ABBREVIATIONS = frozenset(
    """dr mr mrs ms prof st rev capt gen col lt sgt hon fr sr jr mt vs cf fig figs no nos vol vols ch chap sec art tab eq
    app approx est e.g i.e viz pp p op ed eds al ca bzw z d u nr abb vgl str hr fr sog evtl ggf art cap pág pag fig núm
    sra srta dra ee uu ej p.ej p.ex ex env mme mlle m n° tél т е рис стр гл проф г см им ул др напр π.χ εικ σελ αρ κ κα
    ο.π डॉ श्री د ص""".split()
)

CLOSERS = "\"'”’»›)]}」』】》）〉〕"
OPENERS = "\"'“”„‘‚«‹»([{「『【《（〈〔¿¡—–-*_"
_MARK = r"[!?…。！？｡．।॥؟۔።።။։៕\u037e]|\.(?![a-z0-9_/@&=])|(?<=[Ͱ-Ͽἀ-῿]);"
SCAN = re.compile(
    rf"(?P<mark>(?:{_MARK})(?:[!?…。！？؟.]|(?<=[.!?…])[ \u00a0\u202f](?=[!?]))*)(?P<close>(?:[\u00a0\u202f ]?»|[{re.escape(CLOSERS)}“])*)"
    r"|(?<=[ก-๛])(?P<thai>\s+)(?=\S)"
)
PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[^\S\n\r]*(?:\r\n|\n|\r)\s*|[^\S\f]*\f\s*")
ITEM = re.compile(r"(?:\A|\n|\r)(?:[^\S\n\r]|\ufeff)*(?:[-*]|(?P<n>\d{1,3})\.)(?=[^\S\n\r]+\S)")
VISIBLE = re.compile(r"[^\s\ufeff\u200b-\u200f\u2060\u00ad]")
NEXT = re.compile(rf"(?P<open>[{re.escape(OPENERS)}\s]*)(?P<word>[^\W\d_]+(?:[’'][^\W\d_]+)?|\d+|.)?", re.S)
BREAK = re.compile(r"[\s\"'“”„‘‚«»‹›(\[{「『【《（〈〔¿¡—–…。！？]")
#: First code points of the blocks told apart, with their names.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1000, "myanmar"), (0x10A0, "other"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
_STARTS = np.array([a for a, _ in SCRIPTS])


def script(ch: str) -> str:
    return SCRIPTS[int(np.searchsorted(_STARTS, ord(ch), "right")) - 1][1] if ch else "none"


_SCRIPT_OF: dict[str, str] = {}


def _script(ch: str) -> str:
    s = _SCRIPT_OF.get(ch)
    if s is None:
        s = _SCRIPT_OF[ch] = script(ch)
    return s


def since_break(text: str, at: int) -> str:
    """What stands before `at` since the last break, however long."""
    width = 24
    while True:
        lo = max(0, at - width)
        cut = -1
        for m in BREAK.finditer(text, lo, at):
            cut = m.end()
        if cut >= 0:
            return text[cut:at]
        if not lo:
            return text[:at]
        width *= 4


def before(text: str, at: int, mark: str, close: str) -> tuple[str, str]:
    """Key of what stands before a boundary at `at`, and its shape.

    A dot without closing quote is told by its token; other marks by mark, quotes and script."""
    if mark != "." or close:
        while at and text[at - 1].isspace():
            at -= 1
        return f"{mark}{close.strip()}|{_script(text[at - 1 : at])}", "mark" if not close else "quote"
    token = since_break(text, at)
    if not token:
        return ".|none", "mark"
    if token.isdigit():
        return "<num>", "num"
    low = token.casefold()
    if any(c.isdigit() for c in token):
        word = low.lstrip("0123456789.,")
        if len(word) > 1 and word.isalpha() and not word.isascii():  # a number runs into the word where no blanks are used
            return word, "long" + ("U" if token[-1].isupper() else "l")
        return ("<num.num>" if token.count(".") + token.count(",") == 1 and not word else "<alnum>"), "alnum"
    if "." in token:
        return low, "dotted" if max(map(len, token.split("."))) <= 2 else "file"
    if len(token) == 1:
        return low, "singleU" if token.isupper() else "single"
    return low, ("short" if len(token) <= 4 else "long") + ("U" if token[0].isupper() else "l")


def after(text: str, at: int, fresh: bool = False) -> tuple[str, str, str]:
    """Key of what follows at `at`, its case (U, l, o, n, s or e for the end), and the gap (none, space or line).

    fresh: at is the start of a paragraph."""
    m = NEXT.match(text, at)
    opened, word = m.group("open"), m.group("word")
    gap = "line" if fresh or "\n" in opened else "space" if opened and opened[0].isspace() else "none"
    if not word:
        return "<end>", "e", gap
    c = word[0]
    if c.isdigit():
        return "<num>", "n", gap
    if not c.isalpha():
        return f"<{c}>" if c in ",;:、，；：)؛،·/&=" else "<sym>", "s", gap
    kind = "U" if c.isupper() else "l" if c.islower() else "o"
    bare = opened.strip()[-1:]
    # where no blanks part words, or none is left, the first character stands for the word
    glued = kind == "o" and (gap == "none" or _script(c) in ("han", "kana", "thai", "myanmar"))
    return bare + (f"^{c}" if glued else word.casefold()), kind, gap


#: What follows never starts a sentence after these.
GOES_ON = frozenset(f"<{c}>" for c in ",;:、，；：)؛،·/&=")


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches between blank lines and form feeds, without the white space around them."""
    last = 0
    for m in PARAGRAPH.finditer(text):
        yield last, m.start()
        last = m.end()
    yield last, len(text)


def items(part: str) -> list[tuple[int, int]]:
    """(start of the line, end of the mark) of the list items of a paragraph. Numbers must count up from 1 or from
    the start of the paragraph, else a wrapped line that starts with a number would pass for an item."""
    out, want = [], None
    for m in ITEM.finditer(part):
        if n := m.group("n"):
            if not (m.start() == 0 or int(n) == 1 or int(n) == want):
                continue
            want = int(n) + 1
        out.append((m.start(), m.end()))
    return out


def candidates(part: str, marks: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, str, bool]]:
    """(place of the mark, end with quotes, mark, closing quotes, whether it is Thai white space)."""
    inside = {e - 1 for _, e in marks}
    for m in SCAN.finditer(part):
        if m.lastgroup == "thai":
            at = m.start()
            yield at, at, " ", "", True
            continue
        at, mark, close = m.start(), m.group("mark"), m.group("close")
        if mark == "." and at in inside:
            continue
        end = m.end()
        if "“" in close and part.rfind("„", 0, at) <= part.rfind("“", 0, at):
            k = close.index("“")  # an opening quote after a missing blank
            end -= len(close) - k
            close = close[:k]
        if close and close[-1] in "\"'" and end < len(part) and part[end].isalnum() and part.count(close[-1], 0, at) % 2 == 0:
            end, close = end - 1, close[:-1]
        yield at, end, mark, close, False


def attached(part: str, at: int, end: int, mark: str, k1: str, s1: str, case: str) -> bool:
    """Whether a dot without a blank after it can end a sentence: a capital after a small letter, or scripts without case."""
    left, then = part[at - 1 : at], part[end + 1 : end + 2]
    if not left:
        return False
    if case == "U":  # a lone capital is a word of its own, but no initial
        word = then.islower() or (then.isspace() and s1 not in ("single", "singleU", "dotted", "file"))
        return word and (left.islower() or left.isdigit() or left in CLOSERS)
    return case == "o" and s1 not in ("single", "singleU", "dotted", "file") and (left.isdigit() or not (left.islower() or left.isupper()))


def features(k1: str, s1: str, k2: str, case: str, gap: str, closed: bool, starters: frozenset) -> list[str]:
    own = _script(k1[-1:]) if "|" not in k1 and k1[-1:] != ">" else k1.rpartition("|")[2]
    f = ["", f"a={k1}", f"b={k2}", f"s={s1}", f"c={case}", f"g={gap}", f"sc={s1},{case}", f"q={closed},{case},{gap}", f"z={own},{case}"]
    if k1 in ABBREVIATIONS:
        f.append("abbr")
    if k2 in starters:
        f.append(f"st={case}")
    return f


#: Weights before training, in logits.
PRIOR = {"": 2.5, "c=l": -6.0, "st=l": 7.0, "abbr": -6.0, "s=single": -3.0, "s=singleU": -3.0, "s=dotted": -1.0, "q=True,o,none": -1.5, "q=True,U,none": -1.0}


class Model:
    """Weights of the features; decisions are kept, as most contexts come again and again."""

    KEEP = 200_000

    def __init__(self, weights: dict[str, float], starters: frozenset = frozenset()):
        self.weights, self.starters, self.known = weights, starters, {}

    def ends(self, *context) -> bool:
        hit = self.known.get(context)
        if hit is None:
            if len(self.known) >= self.KEEP:
                self.known.clear()
            w = self.weights.get
            hit = self.known[context] = sum(w(f, 0.0) for f in features(*context, self.starters)) > 0
        return hit


def contexts(part: str):
    """For each candidate of a paragraph: (end, context or None where the rules decide, decision of the rules)."""
    marks = items(part)
    item_ends = {e for _, e in marks}
    uncapped = part.islower()  # in a paragraph without capitals, small letters tell nothing
    for at, end, mark, close, thai in candidates(part, marks):
        if thai:
            yield end, None, at not in item_ends
            continue
        k2, case, gap = after(part, end)
        if k2 in GOES_ON:
            yield end, None, False
            continue
        k1, s1 = before(part, at, mark, close)
        if uncapped and case == "l" and s1 in ("longl", "shortl"):
            case = "o"
        if gap == "none" and case != "e" and mark == "." and not close and not attached(part, at, end, mark, k1, s1, case):
            yield end, None, False
            continue
        yield end, (k1, s1, k2, case, gap, bool(close)), None


def sentence_ends(text: str, model: Model) -> list[int]:
    """Offsets just after the last character of each sentence; none for text without visible characters."""
    out: list[int] = []
    for start, stop in paragraphs(text):
        part = text[start:stop]
        if not VISIBLE.search(part):
            continue
        size = len(part.rstrip())
        ends = {size}
        for end, context, sure in contexts(part):
            if end < size and (sure or (context is not None and model.ends(*context))):
                ends.add(end)
        for at, _ in items(part):
            e = len(part[:at].rstrip())
            if e and VISIBLE.search(part, 0, e):
                ends.add(e)
        out += [start + e for e in sorted(ends)]
    return out


def examples(text: str) -> Iterator[tuple]:
    """What a text has for training: (context..., whether the layout ends a sentence there) of each candidate that is
    not decided by rules, and (None, None, start, None, None, None, None) of each paragraph's start."""
    parts = [text[a:b] for a, b in paragraphs(text)]
    for i, part in enumerate(parts):
        if not VISIBLE.search(part):
            continue
        size = len(part.rstrip())
        lines = items(part)
        first = after(part, lines[0][1] if lines and not lines[0][0] else 0, True)
        begun = [first[0]]
        if first[1] == "o" and "^" not in first[0]:  # the same start after a missing blank
            begun.append(re.sub(r"^(\W?)(\w).*", r"\1^\2", first[0], flags=re.S))
        for k in begun:
            yield None, None, k, None, None, None, None
        item_at = {len(part[:a].rstrip()) for a, _ in lines if a}
        for end, context, _ in contexts(part):
            if context is None:
                continue
            last = end >= size
            if last and i + 1 < len(parts):  # what follows is the next paragraph
                k2, case, _gap = after(parts[i + 1], 0, True)
                context = (*context[:2], k2, case, "line", context[5])
            yield *context, last or end in item_at


def fit(found: list[tuple], rounds: int = 2, steps: int = 60, least: int = 12) -> Model:
    """Trains the model on the boundaries that the layout makes reliable. found: examples() with their numbers."""
    starts: Counter = Counter()
    rows, final, times = [], [], []
    for *row, n in found:
        if row[0] is None:
            starts[row[2]] += n
        else:
            rows.append(tuple(row[:6]))
            final.append(row[6])
            times.append(n)
    if not rows:
        return Model(dict(PRIOR))
    n1, f1, l1, n2 = Counter(), Counter(), Counter(), Counter()
    for c, last, n in zip(rows, final, times):
        n1[c[0]] += n
        f1[c[0]] += n * last
        l1[c[0]] += n * (not last and c[3] == "l")
    # seldom seen tokens count as well if they are known abbreviations or initials, quotes from five on
    shape = {c[0]: c[1] for c in rows}
    enough = {"singleU": 1, "quote": 5}
    never = {k for k, n in n1.items() if f1[k] < 0.02 * n and n >= (1 if k in ABBREVIATIONS else min(least, enough.get(shape[k], least)))}
    mixed = {k for k, n in n1.items() if n >= 4 and l1[k] > 0.1 * n}  # small letters follow these as a rule
    for c, last, n in zip(rows, final, times):
        if not last and c[0] not in never:
            n2[c[2]] += n
    starters = frozenset(k for k, n in starts.items() if n >= 5 and k[0] != "<" and n >= 0.05 * n2[k])
    inner = {k for k, n in n2.items() if n >= least and k[0] != "<" and starts[k] < 0.01 * n}

    def small(c) -> bool:
        """A small letter that shows the sentence to go on: not the start of a text written without capitals."""
        return c[3] == "l" and (c[2] not in starters or c[0] in mixed or c[0] in never or c[1] not in ("longl", "shortl"))

    y, sure = np.ones(len(rows)), np.array(final)
    for i, (c, last) in enumerate(zip(rows, final)):
        if not last:
            sure[i] = c[3] == "l"
            y[i] = not (small(c) or c[0] in never or (c[1] != "mark" and c[2] in inner))
    counts: Counter = Counter()
    listed = [features(*c, starters) for c in rows]
    for f, n in zip(listed, times):
        for x in f:
            counts[x] += n
    number = {f: i for i, f in enumerate(f for f, n in counts.items() if n >= 4 or f in PRIOR)}
    for f in PRIOR:
        number.setdefault(f, len(number))
    row = np.concatenate([np.full(len(f), i) for i, f in enumerate(listed)])
    col = np.array([number.get(x, -1) for f in listed for x in f])
    row, col = row[col >= 0], col[col >= 0]
    prior = np.zeros(len(number))
    for f, w in PRIOR.items():
        prior[number[f]] = w
    w, n = prior.copy(), np.array(times, dtype=np.float64)
    for r in range(rounds):
        square = np.full(len(number), 1e-6)
        for _ in range(steps):  # AdaGrad on the whole sample, drawn towards the prior
            z = np.bincount(row, w[col], len(rows))
            g = np.bincount(col, (n * (1 / (1 + np.exp(-z)) - y))[row], len(number)) + 0.05 * (w - prior)
            square += g * g
            w -= 0.8 * g / np.sqrt(square)
        if r + 1 < rounds:  # the unsure ones take the model's opinion
            p = 1 / (1 + np.exp(-np.bincount(row, w[col], len(rows))))
            y = np.where(sure, y, p)
    return Model({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-3}, starters)


def fitted(docs: DataFrame, sample: int = SAMPLE_DOCS, most: int = SAMPLE_ROWS) -> Model:
    """The model fitted on at most `sample` documents, the same ones whatever the partitions. Executors make the
    examples and count them; the driver gets at most `most` different ones, the most frequent first."""
    names = ("k1", "s1", "k2", "kind", "gap", "closed", "final")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                found = list(zip(*examples(t.as_py())))
                if found:
                    types = [pa.string()] * 5 + [pa.bool_()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, types)], names=list(names))

    ids = docs.select("doc_id").dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = docs.sparkSession.createDataFrame([(r[0],) for r in ids.collect()], "doc_id bigint")  # at most `sample` rows
    texts = docs.select("doc_id", "text").dropna().join(F.broadcast(few), "doc_id", "left_semi").select("text")
    rows = texts.mapInArrow(scan, "k1 string, s1 string, k2 string, kind string, gap string, closed boolean, final boolean")
    counted = rows.groupBy(*names).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *names).limit(most)
    return fit([tuple(r) for r in counted.collect()])


def sentence_units(docs: DataFrame, model: Model | None = None, *, texts: bool = False, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, char_end) of each sentence; with texts also its number, char_start and text.

    docs: doc_id and text. Null texts and texts without visible characters give no rows, repeated rows repeat theirs.
    """
    own = model or fitted(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast((own.weights, own.starters))  # bounded by the sample

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            ids, ends, number, start, cut = [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                if not t:
                    continue
                e = sentence_ends(t, own)
                ids += [d] * len(e)
                ends += e
                if texts:
                    at = 0
                    for i, x in enumerate(e):
                        s = x - len(t[at:x].lstrip())
                        number.append(i)
                        start.append(s)
                        cut.append(t[s:x])
                        at = x
            cols = {"doc_id": pa.array(ids, pa.int64()), "char_end": pa.array(ends, pa.int32())}
            if texts:
                cols |= {"ord": pa.array(number, pa.int32()), "char_start": pa.array(start, pa.int32()), "text": pa.array(cut, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id bigint, char_end int" + ", ord int, char_start int, text string" * texts
    return docs.select("doc_id", "text").where("text is not null").mapInArrow(scan, schema)
