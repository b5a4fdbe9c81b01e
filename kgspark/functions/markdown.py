"""Answers' light markup as rows: blocks with their inline spans. Markup other than this stays text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Inline marks, code before emphasis, and their tags.
SPANS = ((r"`([^`]+)`", "code"), (r"\*\*([^*]+)\*\*", "strong"), (r"__([^_]+)__", "strong"), (r"\*([^*]+)\*", "em"), (r"_([^_]+)_", "em"))
_SPAN = re.compile("|".join(f"(?P<s{i}>{rx})" for i, (rx, _) in enumerate(SPANS)))
_HEAD, _BULLET, _NUMBER = re.compile(r"(#{1,4})\s+(.*)$"), re.compile(r"\s*[-*+]\s+(.*)$"), re.compile(r"\s*\d+[.)]\s+(.*)$")


def spans(text: str) -> list[tuple[str, str]]:
    """(tag, text) of a line in order; plain text has the tag `text`."""
    out, last = [], 0
    for m in _SPAN.finditer(text):
        if m.start() > last:
            out.append(("text", text[last : m.start()]))
        i = int(m.lastgroup[1:]) if m.lastgroup and m.lastgroup[0] == "s" else next(i for i in range(len(SPANS)) if m.group(f"s{i}"))
        width = len(SPANS[i][0].split("(")[0].replace("\\", ""))
        out.append((SPANS[i][1], m.group(0)[width:-width]))
        last = m.end()
    if last < len(text):
        out.append(("text", text[last:]))
    return out


def blocks(text: str | None) -> list[tuple[int, str, str, str]]:
    """(block, kind, tag, text) of all spans. Kinds: h4 to h6, ul and ol (a block an item), p and pre; lines of a paragraph are joined by blanks."""
    out: list[tuple[int, str, str, str]] = []
    n, kind, fence = -1, "", False
    for line in (text or "").split("\n"):
        if line.lstrip().startswith("```"):
            fence, kind = not fence, ""
            n += fence
            continue
        if fence:
            out.append((n, "pre", "text", line))
            continue
        if not line.strip():
            kind = ""
            continue
        if m := _HEAD.match(line):
            n, kind = n + 1, ""
            out += [(n, f"h{min(6, len(m[1]) + 3)}", *s) for s in spans(m[2])]
        elif (m := _BULLET.match(line)) or (m2 := _NUMBER.match(line)):
            n, kind = n + 1, "ul" if m else "ol"
            out += [(n, kind, *s) for s in spans((m or m2)[1])]
        else:
            if kind == "p":
                out.append((n, "p", "text", " "))
            else:
                n, kind = n + 1, "p"
            out += [(n, "p", *s) for s in spans(line)]
    return out


_BLOCK = T.ArrayType(T.StructType([T.StructField("block", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_BLOCK)
def markdown(s: pd.Series) -> pd.Series:
    return s.map(blocks)
