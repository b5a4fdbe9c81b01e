"""Scalar text functions. Native expressions wherever Spark has them; Arrow UDFs for Unicode folding and similarity."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

# Shapes of known entity types, and the shapes other types share out by hash.
ENTITY_SHAPES = {
    "person": "ellipse", "organization": "round-rectangle", "location": "diamond", "concept": "hexagon",
    "technology": "octagon", "method": "rhomboid", "metric": "barrel", "event": "triangle", "product": "tag",
    "date": "cut-rectangle", "code_artifact": "rectangle",
}
SPARE_SHAPES = (
    "hexagon", "ellipse", "round-rectangle", "diamond", "octagon", "rhomboid", "barrel", "triangle", "tag",
    "cut-rectangle", "rectangle", "pentagon", "star", "vee", "concave-hexagon",
)
# Greetings, and words without a subject of their own.
GREETINGS = tuple(
    """hi hii hiya hello helo hey heya yo howdy sup greetings morning afternoon evening gm thanks thank thankyou thx ty
    cheers ok okay k cool nice great awesome perfect lovely bye goodbye ciao later gn night""".split()
)
FILLER = tuple(
    """a an the up is are am was it its you your u there here s what whats how doing going today man dude bro buddy
    please just so well and then good all me my i im we to do hows""".split()
)
MAX_NAME_CHARS = 46
CHARS_PER_TOKEN = 4


class _Bare(dict):
    """A table for str.translate that leaves out combining marks; characters enter it as they are met."""

    def __missing__(self, c: int) -> int | None:
        self[c] = kept = None if unicodedata.combining(chr(c)) else c
        return kept


_BARE = _Bare()


def fold(text: str | None) -> str:
    """Compatibility-decomposed, without marks and letter case, punctuation as single blanks."""
    if not text:
        return ""
    bare = (text if text.isascii() else unicodedata.normalize("NFKD", text).translate(_BARE)).casefold()
    return " ".join(re.sub(r"[^\w\s]", " ", bare).split())


@F.pandas_udf(types.StringType())
def _fold_udf(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


def normalize_ascii(c: Column) -> Column:
    """normalize() for text that is ASCII, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s]", " "), r"\s+", " "))


def normalize(c: Column) -> Column:
    """The key by which names are compared; null and text without letters give ''. ASCII text stays in the JVM."""
    plain = F.coalesce(c, F.lit(""))
    ascii_ = plain.rlike(r"^[\x00-\x7f]*$")
    return F.when(ascii_, normalize_ascii(plain)).otherwise(_fold_udf(F.when(~ascii_, plain)))  # Arrow carries nulls for the rest


@F.pandas_udf(types.ArrayType(types.StringType()))
def _fold_list_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else [fold(x) for x in xs])


def normalized_list(c: Column) -> Column:
    """normalize() of each item of a list. Lists of ASCII text stay in the JVM."""
    plain = F.transform(c, lambda x: F.coalesce(x, F.lit("")))
    ascii_ = F.coalesce(F.forall(plain, lambda x: x.rlike(r"^[\x00-\x7f]*$")), F.lit(True))
    return F.when(ascii_, F.transform(plain, normalize_ascii)).otherwise(_fold_list_udf(F.when(~ascii_, plain)))


def normalize_type(c: Column, fallback: str = "concept") -> Column:
    """Lower snake case of at most 40 characters; fallback where nothing is left."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9_]+", "_")
    t = F.left(F.regexp_replace(t, r"^_+|_+$", ""), F.lit(40))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(fallback))


def shape_for(c: Column) -> Column:
    """The shape of a known type; other types get one by a hash of their name."""
    known = F.create_map(*[F.lit(x) for kv in ENTITY_SHAPES.items() for x in kv])
    spare = F.array(*[F.lit(x) for x in SPARE_SHAPES])
    n = F.conv(F.substring(F.sha1(c), 1, 8), 16, 10).cast("bigint") % len(SPARE_SHAPES)
    return F.coalesce(known[c], F.element_at(spare, (n + 1).cast("int")))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_name(c: Column) -> Column:
    """Single blanks, without one leading article."""
    return F.trim(F.regexp_replace(collapse_space(c), r"^(?i)(?:the|a|an)\s+", ""))


def short_name(c: Column, limit: int = MAX_NAME_CHARS) -> Column:
    """What fits under a node: the part before a bracket, cut at the last blank before the limit."""
    name = collapse_space(c)
    ahead = F.regexp_replace(F.substring_index(name, "(", 1), r"^[ \-–—:/,]+|[ \-–—:/,]+$", "")
    name = F.when(name.contains("(") & (F.length(ahead) >= 3), ahead).otherwise(name)
    cut = F.left(name, F.lit(limit))
    word = F.when(cut.contains(" "), F.regexp_extract(cut, r"^(.*) [^ ]*$", 1)).otherwise(cut)
    return F.when(F.length(name) > limit, F.regexp_replace(word, r"[ ,;:\-/]+$", "")).otherwise(name)


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / CHARS_PER_TOKEN).cast("int")


def acronym_of(norm: Column) -> Column:
    """Initials of a normalised phrase of several words; null for a single word."""
    words = F.split(norm, " ")
    return F.when(F.size(words) > 1, F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))


def acronym_forms(norm: Column) -> Column:
    """The letters of a normalised name without blanks, and the same without a plural s."""
    bare = F.regexp_replace(norm, r"[^\p{L}\p{M}\p{N}_]", "")
    return F.array(bare, F.regexp_replace(bare, "s+$", ""))


def is_acronym_pair(a: Column, b: Column) -> Column:
    """Whether one normalised name is the other's initials (2 to 6 letters of any script), a plural s and blanks aside."""

    def one(short: Column, long: Column) -> Column:
        initials = acronym_of(long)
        forms = acronym_forms(short)
        return F.coalesce(initials.isNotNull() & F.exists(forms, lambda x: (x == initials) & F.length(x).between(2, 6)), F.lit(False))

    return one(a, b) | one(b, a)


def is_small_talk(question: Column) -> Column:
    """Whether a message of one to eight words has greetings and filler words only."""
    # one pattern, which fails at the first other word, instead of a list of words that is held against a set for each row
    plain = "|".join(sorted({*GREETINGS, *FILLER}))
    return F.coalesce(F.lower(question).rlike(rf"\A[^a-z0-9]*+(?:(?:{plain})(?![a-z0-9])[^a-z0-9]*+){{1,8}}\z"), F.lit(False))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


def listed(names: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(names)
    front = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n > 1, F.concat(front, F.lit(" and "), F.element_at(names, -1))).when(n == 1, names[0])


def prettify_relation(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def highlight(text: Column, term: Column) -> Column:
    """Whole-word occurrences of term, in any letter case, between <mark> and </mark>."""
    quoted = F.concat(F.lit("(?i)(?<![\\p{L}\\p{N}])"), F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit("(?![\\p{L}\\p{N}])"))
    return F.when(F.length(term) > 0, F.regexp_replace(text, quoted, F.lit("<mark>$0</mark>"))).otherwise(text)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a [Hyyrö 2004]."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    s = full = (1 << len(a)) - 1
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio_of(a: str, b: str) -> float:
    """Indel similarity in percent; two empty strings are alike."""
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def partial_ratio_of(a: str, b: str) -> float:
    """Best ratio of the shorter string against windows of its length in the longer, cut windows at both ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    m, best, letters = len(a), 0.0, set(a)
    for i in range(1 - m, len(b)):
        w = b[max(0, i) : i + m]
        edge = w[-1] if i + m <= len(b) else w[0]
        if edge in letters:
            best = max(best, ratio_of(a, w))
    return best


#: Windows that are compared at once; characters of the shorter string that one machine word holds.
MOST_WINDOWS, WORD_CHARS = 100_000, 63


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after the other, and where each text starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], np.cumsum(sizes)))


def _best_ratios(short: list[str], long: list[str], whole: bool) -> np.ndarray:
    """The best ratio of each short string against the windows of its length in its long one, or against the whole.

    All windows of all pairs go through the bit-parallel recurrence of lcs() side by side, one character a step."""
    n = len(short)
    sc, so = _codes(short)
    lc, lo_ = _codes(long)
    m, size = np.diff(so), np.diff(lo_)
    alphabet, sn = np.unique(sc, return_inverse=True)
    ln = np.searchsorted(alphabet, lc)
    ln[ln == len(alphabet)] = 0
    ln = np.where(alphabet[ln] == lc, ln, len(alphabet)) if len(lc) else ln
    own = np.repeat(np.arange(n), m)
    masks = np.zeros((n, len(alphabet) + 1), np.uint64)
    np.bitwise_or.at(masks, (own, sn), np.uint64(1) << (np.arange(len(sc)) - so[own]).astype(np.uint64))
    count = np.ones(n, np.int64) if whole else m + size - 1
    first = np.concatenate(([0], np.cumsum(count)))
    pair = np.repeat(np.arange(n), count)
    at = np.arange(first[-1]) - first[pair] + (0 if whole else 1 - m[pair])
    lo = np.maximum(at, 0)
    hi = size[pair] if whole else np.minimum(size[pair], at + m[pair])
    ones = (np.uint64(1) << m.astype(np.uint64)) - np.uint64(1)
    s = ones[pair]
    base = lo_[pair] + lo
    width = hi - lo
    for k in range(int(width.max(initial=0))):
        inside = k < width
        u = s & masks[pair, np.where(inside, ln[np.minimum(base + k, len(ln) - 1)], len(alphabet))]
        s = (s + u) | (s - u)
    found = m[pair] - np.bitwise_count(s & ones[pair])
    return np.maximum.reduceat(200.0 * found / (m[pair] + width), first[:-1])


def _ratios(a: pd.Series, b: pd.Series, whole: bool) -> pd.Series:
    one = ratio_of if whole else partial_ratio_of
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a.fillna(""), b.fillna(""))]
    out = np.zeros(len(pairs))
    todo, windows = [], 0

    def flush() -> None:
        if todo:
            out[todo] = _best_ratios([pairs[i][0] for i in todo], [pairs[i][1] for i in todo], whole)
            todo.clear()

    for i, (x, y) in enumerate(pairs):
        if not x or len(x) > WORD_CHARS:
            out[i] = one(x, y)
        elif x in y:
            out[i] = 200.0 * len(x) / (len(x) + len(y)) if whole else 100.0
        else:
            todo.append(i)
            windows += WORD_CHARS if whole else len(x) + len(y)
            if windows >= MOST_WINDOWS:
                flush()
                windows = 0
    flush()
    return pd.Series(out)


@F.pandas_udf(types.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _ratios(a, b, True)


@F.pandas_udf(types.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _ratios(a, b, False)


def ratio_can_reach(a: Column, b: Column, threshold: float) -> Column:
    """Exact bound from the lengths: pairs that fail it cannot have that ratio. Cheap, and ahead of the UDF."""
    la, lb = F.length(a), F.length(b)
    return F.lit(200.0) * F.least(la, lb) >= F.lit(threshold) * (la + lb)


def sentence_around(text: str, start: int | None, end: int | None, name: str | None, pad: int = 220) -> tuple[str, bool]:
    """The sentence at [start, end), or around name, with up to pad more characters to the next boundary on both sides."""
    if start is None and name:
        at = text.lower().find(name.lower())
        if at >= 0:
            start, end = at, at + len(name)
    if start is None or start >= len(text):
        return text, False
    ends = [m.start() for m in re.finditer(r"[.!?\n]", text)]

    def left(p: int) -> int:
        return max((e + 1 for e in ends if e + 1 <= p), default=0)

    def right(p: int) -> int:
        return min((e + 1 for e in ends if e >= p), default=len(text))

    lo, hi = left(start), right(end)
    far = max(0, lo - pad)
    lo = far if far == 0 else min((e + 1 for e in ends if e + 1 >= far), default=far)
    hi = right(min(len(text), hi + pad))
    cut = text[lo:hi].strip()
    return ("… " if lo > 0 else "") + cut + (" …" if hi < len(text) else ""), len(cut) < len(text.strip())


@F.pandas_udf(types.StructType([types.StructField("text", types.StringType()), types.StructField("trimmed", types.BooleanType())]))
def snippet(text: pd.Series, start: pd.Series, end: pd.Series, name: pd.Series) -> pd.DataFrame:
    rows = [
        sentence_around(t or "", None if pd.isna(s) else int(s), None if pd.isna(e) else int(e), n)
        for t, s, e, n in zip(text, start, end, name)
    ]
    return pd.DataFrame(rows, columns=["text", "trimmed"])


def rolling_shape(c: Column) -> Column:
    """The shape by the client's own hash (times 31 plus code, unsigned 32 bits), which need not equal shape_for."""
    key = F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("concept")))
    known = F.create_map(*[F.lit(x) for kv in ENTITY_SHAPES.items() for x in kv])
    spare = F.array(*[F.lit(x) for x in SPARE_SHAPES])
    letters = F.filter(F.split(key, ""), lambda x: x != "")
    h = F.aggregate(letters, F.lit(0).cast("bigint"), lambda acc, x: (acc * 31 + F.ascii(x)) % F.lit(1 << 32))
    return F.coalesce(known[key], F.element_at(spare, (h % len(SPARE_SHAPES) + 1).cast("int")))


def parse_spans(raw: Column) -> Column:
    """`start-end` texts as sorted structs; what is not of that form is left out."""
    pairs = F.transform(raw, lambda x: F.struct(F.try_to_number(F.split_part(x, F.lit("-"), F.lit(1)), F.lit("9999999999")).cast("int").alias("start"), F.try_to_number(F.split_part(x, F.lit("-"), F.lit(2)), F.lit("9999999999")).cast("int").alias("end"), x.rlike(r"^\d+-\d+$").alias("ok")))
    kept = F.filter(pairs, lambda p: F.coalesce(p["ok"], F.lit(False)))
    return F.array_sort(F.transform(kept, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))))
