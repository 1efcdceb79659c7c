"""Scalar expressions of the configuration dialect (SQLite's) as Spark SQL."""

from __future__ import annotations

import re

#: A string, a quoted name, a word, or any other single character.
_PART = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|[A-Za-z_][A-Za-z0-9_$]*|\s+|.", re.DOTALL)
#: Types of casts.
_TYPES = {"text": "string", "integer": "bigint", "int": "bigint", "real": "double", "numeric": "double", "blob": "binary"}
#: Functions that go by another name here.
_NAMES = {"printf": "format_string", "group_concat": "array_join", "char_length": "length", "iif": "if", "unicode": "ascii"}
#: Functions that expressions may use; others are refused with their name.
FUNCTIONS = frozenset("abs ascii cast ceil ceiling char coalesce concat floor format_string hex ifnull iif if instr length lower ltrim max min nullif printf quote replace round rtrim sign substr substring trim unicode upper".split())


def glob_regex(pattern: str) -> str:
    """A regular expression for a GLOB pattern, matched as a whole and by case."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        end = pattern.find("]", at + 2) if c == "[" else -1
        if end > 0:
            body = pattern[at + 1 : end].replace("\\", "\\\\")
            out.append(f"[{body}]")
            at = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        at += 1
    return f"^(?s:{''.join(out)})$"


def _literal(text: str) -> str:
    """A string literal's content as a Spark literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def translate(expression: str, columns: list[str] | None = None) -> str:
    """Spark SQL for an expression; ``ValueError`` for a function that is not known."""
    parts = [m.group() for m in _PART.finditer(expression)]
    out: list[str] = []
    glob = False
    known = {c.lower(): c for c in columns or ()}
    for k, part in enumerate(parts):
        low = part.lower()
        after = next((p for p in parts[k + 1 :] if not p.isspace()), "")
        if part[0] == "'" and len(part) > 1:
            text = part[1:-1].replace("''", "'")
            out.append(_literal(glob_regex(text) if glob else text))
            glob = False
        elif part[0] == '"' and len(part) > 1:
            out.append("`" + part[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif low == "glob":
            out.append("rlike")
            glob = True
        elif low in _TYPES and out and "".join(out).rstrip().lower().endswith(" as"):
            out.append(_TYPES[low])
        elif part[0].isalpha() or part[0] == "_":
            if after == "(" and low not in known and low not in FUNCTIONS and low not in ("and", "or", "not", "in", "when", "then", "else", "case", "between", "like", "is", "rlike"):
                raise ValueError(f"unknown function {part!r} in expression {expression!r}")
            out.append(f"`{known[low]}`" if low in known and after != "(" else _NAMES.get(low, part) if after == "(" else part)
        else:
            out.append(part)
    if glob:
        raise ValueError(f"GLOB needs a literal pattern: {expression!r}")
    return "".join(out)
