"""C and C++ source text to facts: functions, statements, calls.

One pass over a file marks what is code, string or comment and how deep in braces each character stands; all
else reads from that. Statements are physical lines. Run as mapInPandas over (repo_id, path, content), a file a
row, so files are read in parallel and never split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are no names of variables or calls.
KEYWORDS = frozenset(
    "alignas alignof asm auto break case catch class const constexpr continue default delete do else enum explicit extern for goto if inline mutable namespace new operator private protected public register restrict return signed sizeof static struct switch template throw try typedef typename union using virtual volatile while".split()
)
#: Words that are types or parts of types.
TYPES = frozenset("const volatile static struct enum union unsigned signed long short char int float double void size_t ssize_t bool intptr_t uintptr_t ptrdiff_t".split())
#: Library calls that touch memory, by what they do.
MEMORY = {
    "allocation": frozenset("malloc calloc strdup xmalloc kmalloc g_malloc".split()),
    "reallocation": frozenset(("realloc",)),
    "deallocation": frozenset("free delete g_free kfree".split()),
    "copy": frozenset("memcpy memmove strcpy strncpy strlcpy".split()),
    "set": frozenset("memset bzero".split()),
    "compare": frozenset("memcmp strcmp strncmp".split()),
}
#: Signs that assign; others with an = in them compare.
ASSIGNING = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
GUARDS = frozenset(("if", "while", "for", "switch"))
#: Words that may stand behind a function's parameters.
_BEHIND = frozenset(("const", "noexcept", "override", "final"))

CODE, STRING, COMMENT = 0, 1, 2
_TOKENS = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?""", re.S)


def kinds(text: str) -> np.ndarray:
    """Of each character, whether it is code, string or comment."""
    out = np.zeros(len(text), np.int8)
    for m in _TOKENS.finditer(text):
        out[m.start() : m.end()] = COMMENT if m[0][0] == "/" else STRING
    return out


def without_comments(text: str | None) -> str | None:
    """Comments as blanks; line ends and all offsets stay."""
    if not text:
        return text
    return _TOKENS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0], text)


def split_top(text: str, separator: str = ",", braces: bool = True) -> list[str]:
    """Parts between separators outside of brackets; empty parts go."""
    out, depth, at, kind = [], 0, 0, kinds(text)
    opened, closed = ("(<[{", ")>]}") if braces else ("(<[", ")>]")
    for i, c in enumerate(text):
        if kind[i] != CODE:
            continue
        if c in opened:
            depth += 1
        elif c in closed:
            depth = max(0, depth - 1)
        elif c == separator and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*out, text[at:]] if p.strip()]


_SPLIT = re.compile(r"[^\W\d]\w*|\d\w*|<<=|>>=|->|::|[-+*/%&|^=!<>]=|<<|>>|&&|[|]{2}|\S", re.ASCII)


def tokens(text: str) -> list[str]:
    """Names, numbers and signs, in order; quotes are signs like others, and what is quoted is split too."""
    return _SPLIT.findall(text)


def is_name(token: str) -> bool:
    return token[0].isalpha() or token[0] == "_"


def names(found: list[str]) -> list[str]:
    return [t for t in found if is_name(t)]


def is_type(name: str) -> bool:
    return name in TYPES or name.endswith("_t")


def is_macro(name: str) -> bool:
    return len(name) > 2 and name.isupper()


def language(path: str) -> str:
    end = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    return "c" if end in ("c", "h") else "cpp" if end in ("cc", "cpp", "cxx", "hh", "hpp", "hxx") else "c_cpp"


def parameters(text: str) -> list[str]:
    """Names of parameters by position; empty where there is only a type."""
    if text.strip() in ("", "void"):
        return []
    out = []
    for p in split_top(text):
        last = (names(tokens(p)) or [""])[-1]
        out.append("" if not last or is_type(last) or last.isupper() else last)
    return out


def calls(text: str) -> list[str]:
    return _called(tokens(text))


def _called(found: list[str]) -> list[str]:
    """Names, with what qualifies them, that a bracket follows."""
    out: dict[str, None] = {}
    name = ""
    for i, t in enumerate(found):
        if is_name(t):
            name = name + t if name.endswith("::") else t
        elif t == "::" and name:
            name += t
        else:
            if t == "(" and name and is_name(found[i - 1]) and found[i - 1] not in KEYWORDS:
                out.setdefault(name)
            name = ""
    return list(out)


def arguments(text: str, name: str) -> list[str]:
    """Arguments of the first call of a name, brackets balanced."""
    m = re.search(rf"\b{re.escape(name)}\s*\(", text)
    if not m:
        return []
    depth, kind = 1, kinds(text)
    for i in range(m.end(), len(text)):
        if kind[i] == CODE:
            depth += (text[i] == "(") - (text[i] == ")")
            if depth == 0:
                return split_top(text[m.end() : i])
    return split_top(text[m.end() :])


def _variables(found: list[str]) -> list[str]:
    named = set(_called(found))
    return list(dict.fromkeys(n for n in names(found) if n not in KEYWORDS and not is_type(n) and not n.isupper() and n not in named))


def _assigned(found: list[str]) -> int:
    """Where the first assigning sign stands; -1 if there is none."""
    return next((i for i, t in enumerate(found) if t in ASSIGNING), -1)


def memory(text: str, named: list[str]) -> list[tuple[str, str, str]]:
    """(kind, function, target) of a statement's memory operations, each kind and function once."""
    out = {}
    found = tokens(text)
    at = _assigned(found)
    left = (names(found[:at]) or [""])[-1] if at >= 0 else ""
    for n in [x.split("::")[-1] for x in named] + [w for w in ("new", "delete") if w in found]:
        for kind, group in MEMORY.items():
            if n in group or (n == "new" and kind == "allocation"):
                given = arguments(text, n)
                target = left if kind in ("allocation", "reallocation") else (names(tokens(given[0])) or [""])[0] if given else (names(tokens(text.split(n, 1)[1])) or [""])[0]
                out.setdefault((kind, n), target)
    return [(k, n, v) for (k, n), v in out.items()]


def _guard(found: list[str]) -> tuple[int, int] | None:
    """(first, last) token of a condition that is all of a line but for what may stand around it."""
    i = 0
    while i < len(found) and found[i] in ("}", "else") and not (i and found[i - 1] == "else"):
        i += 1
    j = len(found) - (found[-1:] == ["{"])
    if i + 1 < j and found[i] in GUARDS and found[i + 1] == "(" and found[j - 1] == ")":
        return i + 2, j - 1
    return None


def _declared(found: list[str]) -> str | None:
    """The name that a line declares: two names or more, the last one before =, ; a comma or an index, with only stars between."""
    i = 0
    while i < len(found) and (is_name(found[i]) or found[i] in ("*", "&", "&&") and i):
        i += 1
    behind = found[i] if i < len(found) else ""
    if i < 2 or not is_name(found[i - 1]) or len(names(found[:i])) < 2 or behind not in ("=", ";", ",", "["):
        return None
    while behind == "[":
        closed = next((k for k in range(i, len(found)) if found[k] == "]"), None)
        i = closed + 1 if closed is not None else len(found)
        behind = found[i] if i < len(found) else ""
    return found[i - 1] if is_name(found[i - 1]) and behind in ("=", ";", ",") else next((n for n in reversed(names(found[:i]))), None) if behind in ("=", ";", ",") else None


def _members(found: list[str]) -> list[tuple[str, str]]:
    out, i = [], 0
    while i + 2 < len(found):
        if found[i + 1] in ("->", ".") and is_name(found[i]) and is_name(found[i + 2]):
            out.append((found[i], found[i + 2]))
            i += 3
        else:
            i += 1
    return out


def _indexed(found: list[str]) -> list[tuple[str, list[str]]]:
    """(name, tokens up to the first closing bracket) of each name[...]."""
    out, i = [], 0
    while i + 2 < len(found):
        end = next((k for k in range(i + 2, len(found)) if found[k] == "]"), 0) if found[i + 1] == "[" and is_name(found[i]) else 0
        if end > i + 2:
            out.append((found[i], found[i + 2 : end]))
        i = end if end else i + 1
    return out


def statement(text: str) -> dict:
    """All facts of one line."""
    line = text.strip()
    found = tokens(line)
    named, at, guard = _called(found), _assigned(found), _guard(found)
    left, right = (found[:at], found[at + 1 :]) if at >= 0 else (found, [])
    back = found[:1] == ["return"]
    defined: list[str] = []
    if at >= 0 and not guard:
        member, index = _members(left), _indexed(left)
        plain = [n for n in names(left) if n not in KEYWORDS and not is_type(n)]
        defined = [index[0][0]] if index else list(member[0]) if member else plain[-1:]
    declared = _declared(found)
    if declared in KEYWORDS or found[:1] and found[0] in ("return", "goto", "else", "case", "delete"):
        declared = None
    if declared and declared not in defined:
        defined.append(declared)
    ops = memory(line, named)
    flags = [("assignment", at >= 0), ("condition", bool(guard)), ("return", line.startswith("return")), ("function_call", bool(named)), ("memory_operation", bool(ops)), ("declaration", bool(declared))]
    source = [t for t in right if t not in ("&", ";")]
    alias = source[0] if at >= 0 and found[at] == "=" and len(source) == 1 and is_name(source[0]) and is_name(left[-1] if left else " ") else None
    read = _variables(right if at >= 0 and not guard else found)
    returned = line[6:].strip().removesuffix(";").strip() if back else ""
    return {
        "statement_types": [k for k, on in flags if on] or ["unknown"],
        "defined": defined,
        "referenced": [v for v in read if v not in defined or v in names(right)],
        "calls": named,
        "memory_kinds": [k for k, _, _ in ops],
        "memory_functions": [n for _, n, _ in ops],
        "memory_targets": [v for _, _, v in ops],
        "field_accesses": [f"{a}.{b}" for a, b in _members(found)],
        "index_variables": list(dict.fromkeys(n for _, i in _indexed(found) for n in names(i))),
        "alias_source": alias if alias not in KEYWORDS else None,
        "macro_references": list(dict.fromkeys(n for n in names(found) if is_macro(n))),
        "call_arguments": [a for n in named for a in arguments(line, n.split("::")[-1])],
        "condition": _between(line) or None if guard else None,
        "returned": returned or None,
    }


def _between(line: str) -> str:
    """What stands between a line's first opening and its last closing bracket."""
    return line[line.index("(") + 1 : line.rindex(")")].strip()


def _head(text: str) -> tuple[str, str, str, int] | None:
    """(type, name, parameters, where it begins) of a function's head that ends a text; read from the right, so its length doesn't matter."""
    end = len(text.rstrip())
    while (word := re.search(r"[A-Za-z]+$", text[max(0, end - 16) : end])) and word[0] in _BEHIND:
        end = len(text[: end - len(word[0])].rstrip())
    if not end or text[end - 1] != ")":
        return None
    depth, at = 0, end - 1
    while at >= 0:
        depth += (text[at] == ")") - (text[at] == "(")
        if depth == 0:
            break
        at -= 1
    stop = len(text[: max(at, 0)].rstrip())
    begin = stop
    while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_:~"):
        begin -= 1
    name = text[begin:stop].lstrip(":")
    begin = stop - len(name)
    if depth or not name or not (name[0].isalpha() or name[0] in "_~"):
        return None
    first = begin
    while first and (text[first - 1].isalnum() or text[first - 1] in "_:<>,*&~ \t\r\n"):
        first -= 1
    kind = text[first:begin].strip()
    if kind and not (kind[0].isalpha() or kind[0] == "_"):
        kind, first = "", begin
    return kind, name, text[at + 1 : end - 1], first


def functions(text: str) -> list[dict]:
    """Functions of a file: where each begins and ends, its head, and the depth of each of its lines."""
    clean = without_comments(text) or ""
    kind = kinds(clean)
    line_of = np.zeros(len(clean) + 1, np.int64)
    line_of[1:] = np.cumsum([c == "\n" for c in clean])
    out, depth, edge, start, head = [], 0, 0, 0, None
    for i, c in enumerate(clean):
        if kind[i] != CODE or c not in "{};#":
            continue
        if c == "#" and depth == 0 and clean[clean.rfind("\n", 0, i) + 1 : i].strip() == "":
            edge = clean.find("\n", i) + 1 or len(clean)
        elif c == "{":
            if head is None:
                m = _head(clean[edge:i])
                if m and m[1].split("::")[-1] not in KEYWORDS:
                    head, start, depth = m, i, 1
                    whole = clean[edge + m[3] : i]
                    first = edge + m[3] + len(whole) - len(whole.lstrip())
                    out.append({"name": m[1].split("::")[-1], "qualified_name": m[1], "return_type": m[0] or None, "parameters": parameters(m[2]), "line": int(line_of[first]) + 1, "body": start})
                else:
                    edge = i + 1  # a namespace, class or initialiser: look inside
            else:
                depth += 1
        elif c == "}":
            if head is not None:
                depth -= 1
                if depth == 0:
                    out[-1]["end"], out[-1]["end_line"] = i, int(line_of[i]) + 1
                    head, edge = None, i + 1
            else:
                edge = i + 1
        elif c == ";" and head is None:
            edge = i + 1
    if head is not None:
        out[-1]["end"], out[-1]["end_line"] = len(clean), int(line_of[len(clean)]) + 1
    return out


def _file_facts(repo: str, path: str, text: str) -> list[dict]:
    rows, clean, seen = [], without_comments(text) or "", {}
    lines, kind = text.split("\n"), kinds(clean)
    for f in functions(text):
        base = f"{path}:{f['name']}:{f['line']}:{f['body']}"
        seen[base] = seen.get(base, 0) + 1
        fid = base if seen[base] == 1 else f"{base}#{seen[base]}"
        common = {"repo_id": repo, "file": path, "function_id": fid, "func": f["name"]}
        rows.append(common | {"fact": "function", "line": f["line"], "end_line": f["end_line"], "qualified_name": f["qualified_name"], "return_type": f["return_type"], "parameters": f["parameters"]})
        body = clean[f["body"] + 1 : f["end"]]
        depth, at, number = 0, f["body"] + 1, clean.count("\n", 0, f["body"] + 1) + 1
        for part in body.split("\n"):
            raw = lines[number - 1] if number <= len(lines) else ""
            if number == clean.count("\n", 0, f["body"] + 1) + 1:
                raw = part
            code = part.strip().strip("{}").strip()
            here = max(0, depth - part.lstrip()[:1].count("}"))
            if code:
                s = statement(part)  # without comments
                rows.append(common | {"fact": "statement", "statement_id": f"{fid}:{number}", "line": number, "text": raw.strip(), "block_depth": here} | s)
                rows += [common | {"fact": "call", "statement_id": f"{fid}:{number}", "line": number, "callee": n.split("::")[-1], "arguments": arguments(part, n.split("::")[-1])} for n in s["calls"]]
            for j, c in enumerate(part):
                if kind[at + j] == CODE and c in "{}":
                    depth += 1 if c == "{" else -1
            at += len(part) + 1
            number += 1
    return rows


_LISTS = ("parameters", "statement_types", "defined", "referenced", "calls", "memory_kinds", "memory_functions", "memory_targets", "field_accesses", "index_variables", "macro_references", "call_arguments", "arguments")
_TEXTS = ("repo_id", "file", "function_id", "func", "fact", "statement_id", "text", "qualified_name", "return_type", "callee", "alias_source", "condition", "returned")
_COLUMNS = [*_TEXTS, "line", "end_line", "block_depth", *_LISTS]
_SCHEMA = ", ".join([f"`{c}` string" for c in _TEXTS] + ["line long", "end_line long", "block_depth long"] + [f"`{c}` array<string>" for c in _LISTS])


def facts(files: DataFrame) -> DataFrame:
    """All facts of files (repo_id, path, content): rows of kind function, statement and call. Null contents have none."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [r for repo, path, text in zip(p["repo_id"], p["path"], p["content"], strict=True) for r in _file_facts(repo, path, text or "")]
            out = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in _COLUMNS})
            yield out.astype({c: "Int64" for c in ("line", "end_line", "block_depth")})

    return files.select("repo_id", "path", "content").mapInPandas(read, _SCHEMA)


def tables(files: DataFrame) -> dict[str, DataFrame]:
    """functions, statements, calls; a call is resolved where exactly one function of its repository has the name."""
    from causeway.operators.joins import unique_match

    f = facts(files)
    known = f.where("fact = 'function'").select("repo_id", F.col("func").alias("callee"), F.col("function_id").alias("target"))
    called = f.where("fact = 'call'").select("repo_id", "file", "function_id", "func", "statement_id", "line", "callee", "arguments")
    key = lambda d: d.withColumn("_k", F.struct("repo_id", "callee"))
    resolved = unique_match(key(called), key(known).select("_k", "target"), "_k", "target").drop("_k")
    names = [c for c in _LISTS if c not in ("parameters", "arguments")]
    return {
        "functions": f.where("fact = 'function'").select("repo_id", "file", "function_id", "func", "qualified_name", "return_type", "parameters", "line", "end_line"),
        "statements": f.where("fact = 'statement'").select("repo_id", "file", "function_id", "func", "statement_id", "line", "text", "block_depth", "alias_source", "condition", "returned", *names),
        "calls": resolved,
    }
