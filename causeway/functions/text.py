"""Tokens, overlap, truncation, templates, noisy JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word classes of templates.
KEYWORDS = frozenset("if else for while do switch case return break continue goto sizeof struct static const void int char long short unsigned signed float double bool size_t".split())
NULLS = frozenset(("null", "nullptr"))
COPIES = frozenset(("memcpy", "memmove", "strcpy", "strncpy", "memset"))
ALLOCATIONS = frozenset(("malloc", "calloc", "realloc", "new"))
FREES = frozenset(("free", "delete"))
SIZES = ("len", "length", "size", "count", "index", "idx", "offset", "bound", "capacity")
BUFFERS = ("buf", "buffer", "data", "ptr", "dst", "src")


def token(c: Column, default: str = "unknown") -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    out = F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def words(c: Column, least: int = 3) -> Column:
    """Distinct lower-case words of `least` characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"[a-z0-9_]{{{least},}}"), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """|a and b| / |b|; 0 for an empty b."""
    return F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)).otherwise(0.0)


def capped_overlap(a: Column, b: Column, cap: int = 8) -> Column:
    """|a and b| / min(|a|, cap), 1 at most."""
    return F.when(F.size(a) > 0, F.least(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.lit(cap)), F.lit(1.0))).otherwise(0.0)


def head(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def head_and_tail(c: Column, n: int, mark: str = "\n...\n") -> Column:
    half = n // 2
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(half)), F.lit(mark), F.right(c, F.lit(n - half)))).otherwise(c)


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def literal_classes(c: Column) -> Column:
    """Line prefix, strings and integers replaced by their class: the part of a template that needs no memory."""
    out = F.regexp_replace(c, r"(?m)^\s*\d+:\s?", "")
    out = F.regexp_replace(out, r'"[^"\n]*"', "<str>")
    return F.regexp_replace(out, r"\b(?:0[xX][0-9A-Fa-f]+|\d+)\b", "<int>")


#: What a word is replaced by, in order: words that are one of a set, then words that have one of some hints in them.
_EXACT = {w: mark for group, mark in ((NULLS, "<null>"), (COPIES, "<copy_op>"), (ALLOCATIONS, "<alloc_op>"), (FREES, "<free_op>")) for w in group} | {w: "" for w in KEYWORDS}
_HINTS = [(h, mark) for hints, mark in ((SIZES, "<size_var>"), (BUFFERS, "<buffer_var>")) for h in hints]
_PIECES = re.compile(r"(<[a-z_0-9]+>)|([^\W\d]\w*)|(\d\w*|\W)", re.ASCII)


def _numbered(snippet: str | None) -> str | None:
    """One pass over marks, words and the rest; words without a class are numbered as they come up."""
    if snippet is None:
        return None
    marks: dict[str, str] = {}  # of the words met so far that no set has
    n, out = 0, []
    for piece in _PIECES.finditer(snippet):
        word = piece[0]
        if piece.lastindex != 2:
            out.append(word)
            continue
        low = word.lower()
        if low in _EXACT:
            out.append(_EXACT[low] or word)
            continue
        if low not in marks:
            hint = next((m for h, m in _HINTS if h in low), None)
            n += not hint
            marks[low] = hint or f"<var{n}>"
        out.append(marks[low])
    return " ".join("".join(out).split())


#: Whole texts go to Python in rows, a hundred at a time: an Arrow batch has 10,000, of whatever length.
numbered = F.udf(_numbered, T.StringType(), useArrow=False)


def template(c: Column) -> Column:
    """A snippet with literals, word classes and numbered other names."""
    return numbered(literal_classes(c))


def first_json(text: str | None) -> str | None:
    """The first balanced JSON object in a text; braces in strings don't count."""
    if not text:
        return None
    start = text.find("{")
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    return text[start : i + 1]
        start = text.find("{", start + 1)
    return None


json_object = F.udf(first_json, T.StringType(), useArrow=False)


def without_fence(c: Column) -> Column:
    """The text inside a ``` fence, or the text itself."""
    inner = F.regexp_extract(c, r"(?s)```[A-Za-z]*\n(.*?)```", 1)
    return F.when(inner != "", inner).otherwise(c)


def stable_hash(c: Column) -> Column:
    return F.sha2(c, 256)




def without_fixes(text: str | None, macro: str = "MAGMA_ENABLE_FIXES") -> str | None:
    """Source as it is with a macro undefined: of branches on it those are kept that don't have the fix; other directives stay."""
    if text is None:
        return None
    out, stack = [], []  # of each open branch on the macro: whether its lines are kept
    for line in text.split("\n"):
        words = line.strip().removeprefix("#").split() if line.strip().startswith("#") else []
        what, name = (words + ["", ""])[:2]
        if what in ("ifdef", "ifndef") and name == macro:
            stack.append(what == "ifndef")
        elif stack and what == "else":
            stack[-1] = not stack[-1]
        elif stack and what == "endif":
            stack.pop()
        elif all(stack):
            out.append(line)
    return "\n".join(out)


unfixed = F.udf(without_fixes, T.StringType(), useArrow=False)
