"""Structural compression: signatures stay, bodies go. Python by its syntax tree, brace languages by a small lexer.

Where the source can't be understood the result is null, and callers fall back on white-space compression.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PLACEHOLDER = "{ /* ... */ }"


def python_outline(source: str) -> str | None:
    """Imports and comments at the top level, decorators, class headers with their methods, and function signatures with ``pass``."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines = source.splitlines()
    out: list[tuple[int, str]] = [(i, x) for i, x in enumerate(lines, 1) if x.startswith("#")]

    def header(node: ast.stmt, first: int, indent: str, end: str) -> None:
        for d in getattr(node, "decorator_list", ()):
            out.append((d.lineno, indent + "@" + ast.unparse(d)))
        body = node.body[0]  # type: ignore[attr-defined]
        start = min([body.lineno, *(d.lineno for d in getattr(body, "decorator_list", ()))])
        text = "\n".join(lines[node.lineno - 1 : start - 1]) if start > node.lineno else lines[node.lineno - 1][: body.col_offset]
        text = re.sub(r"\s*\n\s*", " ", "\n".join(x for x in text.split("\n") if not x.strip().startswith("#"))).strip()
        out.append((first, indent + text + end))

    def visit(nodes: list[ast.stmt], indent: str) -> None:
        for n in nodes:
            if isinstance(n, ast.Import | ast.ImportFrom) and not indent:
                out.append((n.lineno, ast.unparse(n)))
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                header(n, n.lineno, indent, " pass")
            elif isinstance(n, ast.ClassDef):
                header(n, n.lineno, indent, "")
                methods = [x for x in n.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
                if methods:
                    visit(methods, indent + "    ")
                else:
                    out.append((n.lineno, indent + "    pass"))

    visit(tree.body, "")
    return "\n".join(x for _, x in sorted(out, key=lambda r: r[0])) + "\n" if out else None


_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_RUST_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'", re.S)


def masked(source: str, language: str) -> str:
    """The source with comments and string literals blanked out, at the same length."""
    return (_RUST_SKIP if language == "rust" else _SKIP).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def closing(mask: str, at: int) -> int | None:
    """Place after the bracket that closes the one at ``at``; null if none does, or another kind would."""
    pairs, stack = {")": "(", "]": "[", "}": "{"}, []
    for i in range(at, len(mask)):
        c = mask[i]
        if c in "([{":
            stack.append(c)
        elif c in pairs:
            if not stack or stack.pop() != pairs[c]:
                return None
            if not stack:
                return i + 1
    return None


#: A declaration whose braces hold a body to drop, by language.
_BODY = {
    "typescript": re.compile(r"(?:\bfunction\b|=>\s*$|\)\s*(?::[^={};]*)?$)"),
    "rust": re.compile(r"\bfn\b"),
    "go": re.compile(r"^\s*func\b"),
}
_BODY["javascript"] = _BODY["typescript"]
#: A declaration whose members are visited in turn.
_MEMBERS = {"typescript": re.compile(r"\bclass\b"), "rust": re.compile(r"\bimpl\b"), "go": re.compile(r"(?!)")}
_MEMBERS["javascript"] = _MEMBERS["typescript"]
#: A declaration that stays whole.
_WHOLE = {
    "typescript": re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:type|interface|(?:const\s+)?enum|import)\b|^\s*export\b"),
    "rust": re.compile(r"^\s*(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|use|mod)\b"),
    "go": re.compile(r"^\s*(?:type|import)\b"),
}
_WHOLE["javascript"] = _WHOLE["typescript"]
_FIELD = re.compile(r"^\s*(?:(?:public|private|protected|readonly|static|declare)\s+)*[#\w$]+\s*[?!]?\s*[:=;]")


def brace_outline(source: str, language: str) -> str | None:
    mask = masked(source, language)
    out: list[str] = []

    def visit(lo: int, hi: int, inside: bool) -> bool:
        at = lo
        while at < hi:
            # A statement ends at a semicolon or line end outside brackets, or after a brace block.
            i, brace = at, None
            while i < hi:
                c = mask[i]
                if c in "([":
                    end = closing(mask, i)
                    if end is None:
                        return False
                    i = end
                    continue
                if c == "{":
                    brace = i
                    break
                if c in ")]}":
                    return False
                if c == ";" or c == "\n" and mask[at:i].strip() and not re.search(r"[,=+\-|&:.(<]\s*$|=>\s*$", mask[at:i]):
                    break
                i += 1
            head = mask[at:i]
            # Comments that stand before the statement stay.
            for m in re.finditer(r"//[^\n]*|/\*.*?\*/", source[at:i], re.S):
                if not mask[at + m.start() : at + m.end()].strip():
                    out.append(m[0])
            if brace is None:
                statement = _comment_free(source, mask, at, min(hi, i + 1)).strip()
                if statement and (_WHOLE[language].search(head) or inside and language in ("typescript", "javascript") and _FIELD.search(head)):
                    out.append(statement)
                at = i + 1
                continue
            end = closing(mask, brace)
            if end is None:
                return False
            signature = re.sub(r"\s+", " ", _comment_free(source, mask, at, brace)).strip()
            if _MEMBERS[language].search(head):
                out.append(signature + " {")
                if not visit(brace + 1, end - 1, True):
                    return False
                out.append("}")
            elif language in ("typescript", "javascript") and re.search(r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:type|interface|(?:const\s+)?enum|import)\b", head) or language != "typescript" and language != "javascript" and _WHOLE[language].search(head):
                out.append(source[at:end].strip())
            elif _BODY[language].search(head.rstrip()):
                out.append(f"{signature} {PLACEHOLDER}")
            elif _WHOLE[language].search(head):
                out.append(source[at:end].strip())
            at = end
        return True

    if not visit(0, len(source), False) or not out:
        return None
    return "\n".join(out) + "\n"


def _comment_free(source: str, mask: str, lo: int, hi: int) -> str:
    """A stretch of source without its comments; string literals stay."""
    return re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: m[0] if mask[lo + m.start() : lo + m.end()].strip() else "", source[lo:hi], flags=re.S)


def outline(source: str | None, language: str | None) -> str | None:
    if source is None or language is None:
        return None
    if language == "python":
        return python_outline(source)
    return brace_outline(source, language) if language in _BODY else None


@F.pandas_udf(StringType())
def _outlines(source: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([outline(s, x) for s, x in zip(source, language, strict=True)], dtype=object)


def structural(content: Column, language: Column) -> Column:
    """The outline of a source text, or null. Only languages with an outliner reach Python."""
    return F.when(language.isin("python", *_BODY), _outlines(content, language))
