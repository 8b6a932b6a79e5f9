"""Chunkers: source text in, table of regions out.

Python files are read with the standard parser, and by indentation where it
finds an error.  For other languages an outline scanner blanks comments and
strings, finds the headers that a language's rules name, and the ends of their
blocks by braces or keywords, or, of bodies without either, by indentation and
brackets.  Files that a chunker can't read, files in which the scanner finds
nothing, and languages without a chunker get sliding windows; ``chunker_used``
says which it was.
"""

from __future__ import annotations

import ast
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from kindred.operators.windows import OVERLAP, check_sizes


@dataclass
class Region:
    start: int
    end: int
    chunk_type: str
    name: str | None = None
    context: str = ""
    splits: bool = True


class Chunker(ABC):
    """Regions of a text; lines count from 1, and a region has whole lines."""

    @abstractmethod
    def regions(self, text: str, min_lines: int, max_lines: int) -> Iterator[Region]: ...


class WindowChunker(Chunker):
    """Sliding windows that end at a blank line if one is near."""

    def regions(self, text: str, min_lines: int, max_lines: int) -> Iterator[Region]:
        rows = text.split("\n")
        n = len(rows)
        for low in range(0, n - min_lines + 1, max_lines - OVERLAP):
            high = min(low + max_lines, n)
            if high < n:
                high = next((j for j in range(high - 1, max(low + min_lines, high - 10), -1) if not rows[j].strip()), high)
            if high - low >= min_lines:
                yield Region(low + 1, high, "block", splits=False)


class PythonChunker(Chunker):
    """Functions and methods; classes whole if they fit, and their members too."""

    def regions(self, text: str, min_lines: int, max_lines: int) -> Iterator[Region]:
        def walk(node: ast.AST, context: str) -> Iterator[Region]:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                    yield Region(child.lineno, child.end_lineno, "method" if context.startswith("class") else "function", child.name, context)
                elif isinstance(child, ast.ClassDef):
                    if min_lines <= child.end_lineno - child.lineno + 1 <= max_lines:
                        yield Region(child.lineno, child.end_lineno, "class", child.name, context)
                    yield from walk(child, f"class {child.name}")
                else:
                    yield from walk(child, context)

        try:
            return walk(ast.parse(text), "")
        except (SyntaxError, ValueError):
            found = list(self.recovered(blank(text, "python"), min_lines, max_lines))
            if not found:
                raise
            return iter(found)

    def recovered(self, code: str, min_lines: int, max_lines: int) -> Iterator[Region]:
        """The same regions by headers and indentation, for a text with an error in it."""
        outer: list[tuple[int, str, str]] = []  # last line, keyword and name of what is open
        for m in re.finditer(r"^[ \t]*(?P<k>(?:async[ \t]+)?def|class)[ \t]+(?P<n>\w+)", code, re.M):
            low, high = code.count("\n", 0, m.start()) + 1, code.count("\n", 0, rest_end(code, m.start("k"), m.end(), False)) + 1
            outer = [o for o in outer if o[0] >= low]
            context = next((f"class {n}" for _, k, n in reversed(outer) if k == "class"), "")
            if not any(k != "class" for _, k, _ in outer):
                if m["k"] != "class":
                    yield Region(low, high, "method" if context else "function", m["n"], context)
                elif min_lines <= high - low + 1 <= max_lines:
                    yield Region(low, high, "class", m["n"], context)
            outer.append((high, m["k"], m["n"]))


#: What a line that goes on with an expression begins with.
_GOES_ON = re.compile(r"[ \t]*(?:[)\]}.,?:&|+*/=<>-]|else\b|catch\b|finally\b|with\b|yield\b)")
_CLOSES_ON = re.compile(r"[ \t]*[)\]}]")


def rest_end(code: str, start: int, at: int, brackets: bool = True) -> int:
    """End of what begins with a header at ``start`` that is read up to ``at`` and has no block of its own.

    It goes on while a bracket is open, over lines that are further in than the
    header's, and over lines that begin with what can't begin a statement; a
    bracket that closes what was open before the header ends it, and so does a
    comma or semicolon outside brackets.  Without ``brackets``, as in a text with
    an error, indentation alone tells.
    """
    line = code.rfind("\n", 0, start) + 1
    indent = len(code[line:start]) - len(code[line:start].lstrip(" \t"))
    depth, end, i = 0, at, at
    goes_on = _GOES_ON if brackets else _CLOSES_ON
    while i < len(code):
        c = code[i]
        if not brackets and c != "\n":
            pass
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return end
        elif depth == 0 and c in ",;":
            return end
        elif depth == 0 and c == "\n":
            follows = re.compile(r"(?:[ \t]*\n)*([ \t]*)(?=\S)").match(code, i + 1)
            if follows is None or (len(follows[1]) <= indent and not goes_on.match(code, follows.start(1))):
                return end
        if not c.isspace():
            end = i + 1
        i += 1
    return end


@dataclass(frozen=True)
class Rule:
    """A header and what its block is.

    ``pattern`` may have a group ``name``.  ``body`` is ``block`` (from the header
    to the end of its block), ``brace`` (the block alone) or ``rest`` (no block:
    what follows by indentation and brackets).  ``kind`` is a chunk type, with
    ``inner`` instead within a context; a container has ``context`` (a format of
    name and outer context) and is emitted never, ``also`` or ``else`` (whole if
    it fits, in place of its members).
    """

    pattern: str
    kind: str
    inner: str | None = None
    context: str | None = None
    emit: str = "never"
    name: str | None = None
    body: str = "block"


_WORDS = r"if|for|while|switch|catch|return|else|do|try|synchronized|using|lock|foreach|fixed|when|match|guard|function|new|throw|sizeof|elif|until|defer|with"
_KOTLIN = "if|else|for|while|when|try|catch|finally|do|init|get|set|class|object|interface|companion|constructor|enum|fun"
_TYPED = rf"(?:^|(?<=[;{{}}]))[ \t]*(?!(?:{_WORDS})\b)(?:[\w<>\[\],.?*&:@~]+[ \t*&]+)*?"
_CALL = rf"(?P<name>(?!(?:{_WORDS})\b)~?\w+)[ \t]*\([^;{{}}]*?\)"
_CLASS = "{kind} {name}"


def _types(words: str, emit: str = "never") -> list[Rule]:
    return [Rule(rf"\b{w}[ \t]+(?P<name>\w+)[^;{{}}()]*(?:\([^;{{}}]*?\))?[^;{{}}()]*\{{", w, context=f"{w} {{name}}", emit=emit) for w in words.split()]


_FUNCTION = Rule(_TYPED + _CALL + r"[^;{}=]*\{", "function", "method")
_JS = [
    *_types("class"),
    Rule(r"(?P<name>[\w'\"]+)[ \t]*:[ \t]*(?:async[ \t]*)?(?:function\b[^{}]*?|\([^;{}]*?\)[ \t]*=>[ \t]*)\{", "function", "method"),
    Rule(r"\b(?:const|let|var)[ \t]+(?P<name>\w+)[^=;\n]*=[ \t]*(?:async[ \t]*)?(?:\([^;{}]*?\)|\w+)[^=;{}]*=>[ \t]*\{", "arrow_function"),
    Rule(r"\b(?:const|let|var)[ \t]+(?P<name>\w+)[^=;\n]*=[ \t]*(?:async[ \t]*)?(?:\([^;{}]*?\)|\w+)[^=;{}]*=>(?![ \t]*\{)", "arrow_function", body="rest"),
    Rule(r"(?P<name>[\w'\"]+)[ \t]*:[ \t]*(?:async[ \t]*)?(?:\([^;{}]*?\)|\w+)[ \t]*=>(?![ \t]*\{)", "arrow_function", body="rest"),
    Rule(r"\bfunction\b[ \t]*\*?[ \t]*(?P<name>\w*)[ \t]*\([^{}]*?\)[^;{}]*\{", "function", "method"),
    Rule(_TYPED + _CALL + r"(?:[ \t]*:[^;{}=]*)?[ \t]*\{", "method", "method"),
]
RULES: dict[str, list[Rule]] = {
    "swift": [
        *_types("class struct enum protocol extension actor"),
        Rule(r"\bfunc[ \t]+(?P<name>\w+)[^{};]*\{", "function", "method"),
        Rule(r"\bdeinit\s*\{", "deinitializer", name="deinit"),
        Rule(r"\binit[?!]?[ \t]*\([^{}]*?\)[^{};]*\{", "initializer", name="init"),
        Rule(r"\bsubscript[ \t]*\([^{}]*?\)[^{};]*\{", "function", "method", name="subscript"),
        Rule(r"\bvar[ \t]+(?P<name>\w+)[ \t]*:[^={};]*\{", "computed_property"),
        Rule(r"\b(?:var|let)[ \t]+(?P<name>\w+)[^={};\n]*=(?!=)", "computed_property", body="rest"),
    ],
    "rust": [
        Rule(r"\bimpl\b[^{};]*?(?P<name>\w+)(?:<[^{};]*>)?[ \t\n]*(?:where[^{};]*)?\{", "impl", context="impl {name}"),
        *_types("trait mod"),
        Rule(r"\bfn[ \t]+(?P<name>\w+)[^{};]*\{", "function", "method"),
    ],
    "javascript": _JS,
    "typescript": _JS,
    "go": [
        Rule(r"\bfunc[ \t]*\([ \t]*(?:\w+[ \t]+)?\*?(?P<receiver>\w+)[^)]*\)[ \t]*(?P<name>\w+)[ \t]*\([^{}]*?\)[^{}\n]*\{", "method", context=None),
        Rule(r"\bfunc[ \t]+(?P<name>\w+)[^{}]*?\)[^{}\n]*\{", "function"),
    ],
    "c": [_FUNCTION, *[Rule(rf"\b{w}[ \t]*(?P<name>\w*)[ \t\n]*\{{", w) for w in ("struct", "enum", "union")]],
    "cpp": [
        Rule(r"\benum[ \t]+(?:class[ \t]+|struct[ \t]+)?(?P<name>\w+)[^;{}()]*\{", "enum"),
        *_types("class struct", "else"),
        Rule(r"\bnamespace[ \t]+(?P<name>[\w:]+)[ \t\n]*\{", "namespace", context="namespace {name}"),
        Rule(r"\[[^\[\]{};]*\][ \t]*\([^;{}]*?\)[^;{}()]*\{", "lambda"),
        _FUNCTION,
    ],
    "java": [*_types("class interface enum"), Rule(_TYPED + _CALL + r"[^;{}=]*\{", "method", "method")],
    "csharp": [
        *_types("class struct interface", "else"),
        Rule(r"\bnamespace[ \t]+(?P<name>[\w.]+)[ \t\n]*\{", "namespace", context="namespace {name}"),
        Rule(r"\benum[ \t]+(?P<name>\w+)[^;{}()]*\{", "enum"),
        _FUNCTION,
        Rule(r"[ \t](?P<name>\w+)[ \t\n]*\{(?=\s*(?:(?:private|protected|internal)\s+)?(?:get|set|init)\b)", "property"),
    ],
    "php": [*_types("class interface trait", "also"), Rule(r"\bfunction[ \t]+&?(?P<name>\w+)[ \t]*\([^{}]*?\)[^;{}]*\{", "function", "method")],
    "kotlin": [
        Rule(r"\bcompanion[ \t]+object\b[^;{}()]*\{", "object", context="{outer}.companion"),
        *_types("class object interface"),
        Rule(r"\bfun[ \t]+(?:<[^{}()]*>[ \t]*)?(?:[\w.<>?]+\.)?(?P<name>\w+)[ \t]*\([^{}]*?\)[^;{}=]*\{", "function", "method"),
        Rule(r"\bfun[ \t]+(?:<[^{}()]*>[ \t]*)?(?:[\w.<>?]+\.)?(?P<name>\w+)[ \t]*\([^{}]*?\)[^;{}=\n]*=", "function", "method", body="rest"),
        Rule(rf"(?<![\w.:])(?<!: )(?!(?:{_KOTLIN})\b)\w+[ \t]*(?:<[^<>{{}}]*>[ \t]*)?(?:\([^{{}}]*?\)[ \t]*)?\{{", "lambda", body="brace"),
        Rule(r"=[ \t]*\{", "lambda", body="brace"),
    ],
    "scala": [
        *[Rule(rf"\b{w}[ \t]+(?P<name>\w+)(?:(?!:[ \t]*$)[^;{{}}()])*(?:\((?:[^;{{}}()]|\([^;{{}}()]*\))*\))?(?:(?!:[ \t]*$)[^;{{}}()])*\{{", w, context=f"{w} {{name}}") for w in ("class", "object", "trait")],
        *[Rule(rf"\b{w}[ \t]+(?P<name>\w+)[^{{}}\n]*:[ \t]*$", w, context=f"{w} {{name}}", body="rest") for w in ("class", "object", "trait")],
        Rule(r"\bdef[ \t]+(?P<name>\w+)(?:[ \t]*\[[^\]{}]*\])?(?:[ \t]*\([^{}]*?\))*[^{};=(\n]*=?[ \t\n]*\{", "function", "method"),
        Rule(r"\bdef[ \t]+(?P<name>\w+)(?:[ \t]*\[[^\]{}]*\])?(?:[ \t]*\([^{}]*?\))*[^{};=(\n]*=(?![ \t\n]*\{)", "function", "method", body="rest"),
        *[Rule(rf"\b{w}[ \t]+(?P<name>\w+)[^{{}};=\n]*=(?![=>]|[ \t]*\{{)", w, body="rest") for w in ("val", "var")],
        Rule(r"\bval[ \t]+(?P<name>\w+)[^{};\n]*\{", "val"),
        Rule(r"\bvar[ \t]+(?P<name>\w+)[^{};\n]*\{", "var"),
    ],
    "bash": [Rule(r"^[ \t]*(?:function[ \t]+(?P<name>[\w:.-]+)[ \t]*(?:\(\))?|(?P<other>[\w:.-]+)[ \t]*\(\))[ \t\n]*\{", "function")],
    "ruby": [
        Rule(r"^[ \t]*(?:class|module)[ \t]+(?P<name>[\w:]+)", "class", context="{kind} {name}", emit="also"),
        Rule(r"^[ \t]*def[ \t]+self\.(?P<name>[\w?!=]+)", "class_method"),
        Rule(r"^[ \t]*def[ \t]+(?P<name>[\w?!=]+|[^\w\s(]+)", "method"),
        Rule(r"\b(?P<name>\w+)[ \t]*(?:\([^{}\n]*\)[ \t]*)?\{[ \t]*\|", "block"),
    ],
    "lua": [Rule(r"\blocal[ \t]+function[ \t]+(?P<name>\w+)", "local_function"), Rule(r"(?:(?P<name>[\w.:]+)[ \t]*=[ \t]*)?\bfunction\b[ \t]*(?P<other>[\w.:]*)", "function")],
}
_COMMENT = {"python": r"#[^\n]*", "bash": r"(?<![\w$])#[^\n]*", "ruby": r"#(?!\{)[^\n]*", "php": r"//[^\n]*|#[^\n]*|/\*.*?\*/", "lua": r"--\[\[.*?\]\]|--[^\n]*"}
_STRING = r'"""(?:.*?)"""|"(?:\\.|[^"\\\n])*"'
_SINGLE = {"python": r"'''.*?'''|'(?:\\.|[^'\\\n])*'", "rust": r"'(?:\\.|[^'\\\n])'", "swift": r"(?!)", "scala": r"'(?:\\.|[^'\\\n])'", "java": r"'(?:\\.|[^'\\\n])*'"}
#: Keywords that open and close a block, where braces don't.
_OPENS = {"ruby": r"(?:^[ \t]*|(?<=[=(;])[ \t]*)(?:if|unless|while|until|case|for|begin|def|class|module)\b|\bdo\b", "lua": r"\b(?:function|if|do|repeat)\b"}
_CLOSES = {"ruby": r"\bend\b", "lua": r"\b(?:end|until)\b"}


def blank(text: str, language: str) -> str:
    """``text`` with comments and strings as spaces of the same length."""
    comment = _COMMENT.get(language, r"//[^\n]*|/\*.*?\*/")
    single = _SINGLE.get(language, r"'(?:\\.|[^'\\\n])*'")
    tick = r"|`(?:\\.|[^`\\])*`" if language in ("javascript", "typescript", "go") else ""
    return re.sub(f"{comment}|{_STRING}|{single}{tick}", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S | re.M)


class OutlineChunker(Chunker):
    """Regions by a language's rules."""

    def __init__(self, language: str):
        self.language = language
        self.rules = [(r, re.compile(r.pattern, re.M)) for r in RULES[language]]

    def blocks(self, code: str) -> dict[int, int]:
        """End of the block that opens at each position."""
        if self.language in _OPENS:
            marks = re.finditer(rf"(?P<o>{_OPENS[self.language]})|(?P<c>{_CLOSES[self.language]})|(?P<b>\{{)|(?P<e>\}})", code, re.M)
        else:
            marks = re.finditer(r"(?P<b>\{)|(?P<e>\})", code)
        ends, words, braces = {}, [], []
        for m in marks:
            if m.lastgroup in ("o", "b"):
                (words if m.lastgroup == "o" else braces).append(m)
            elif stack := (words if m.lastgroup == "c" else braces):
                opened = stack.pop()
                ends[opened.end() - 1 if opened.lastgroup == "b" else opened.start() + len(opened[0]) - len(opened[0].lstrip(" \t"))] = m.end()
        return ends

    @staticmethod
    def named(text: str, m: re.Match) -> str | None:
        at = next((m.span(g) for g in ("name", "other") if m.groupdict().get(g)), None)
        return at and text[slice(*at)].strip("'\"")

    def regions(self, text: str, min_lines: int, max_lines: int) -> Iterator[Region]:
        code = blank(text, self.language)
        ends = self.blocks(code)
        found: dict[int, tuple[int, int, Rule, dict]] = {}
        for rule, pattern in self.rules:
            for m in pattern.finditer(code):
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                if rule.body == "rest":
                    if -m.end() not in found:
                        found[-m.end()] = (start, rest_end(code, start, m.end()), rule, {"name": rule.name or self.named(text, m), "receiver": None, "head": m[0]})
                    continue
                key = m.end() - 1 if m[0].endswith("{") else next((k for k in (start, m.start("other") if "other" in m.groupdict() else -1, *range(start, m.end())) if k in ends), None)
                if m[0].rstrip(" \t|").endswith("{"):
                    key = m.start() + m[0].rindex("{")
                if key in ends and key not in found:
                    first = key if rule.body == "brace" else start
                    found[key] = (first, ends[key], rule, {"name": rule.name or self.named(text, m), "receiver": m.groupdict().get("receiver"), "head": m[0]})
        order = sorted(found.values(), key=lambda x: (x[0], -x[1]))
        line = lambda at: text.count("\n", 0, at) + 1
        package = re.search(r"^[ \t]*(?:namespace|package)[ \t]+([\w.\\]+)[ \t]*;?[ \t]*$", code, re.M) if self.language in ("php", "scala") else None
        yield from self._walk(order, line, f"{'namespace' if self.language == 'php' else 'package'} {package[1]}" if package else "", min_lines, max_lines)

    def _walk(self, nodes: list, line, context: str, min_lines: int, max_lines: int) -> Iterator[Region]:
        i = 0
        while i < len(nodes):
            start, end, rule, facts = nodes[i]
            j = i + 1
            while j < len(nodes) and nodes[j][0] < end:
                j += 1
            low, high = line(start), line(end - 1)
            if rule.context is None:
                kind = (rule.inner or rule.kind) if context and not re.fullmatch(r"(?:namespace|package) [\w.\\]+", context) else rule.kind
                if self.language == "java" and context.endswith(f" {facts['name']}"):
                    kind = "constructor"
                if self.language == "csharp" and kind == "method" and context.endswith(f" {facts['name']}"):
                    kind = "constructor"
                if self.language in ("javascript", "typescript") and kind == "method" and not context and rule.inner == rule.kind:
                    i = j
                    continue
                name = f"{facts['name']}_block" if kind == "block" else facts["name"] or None
                yield Region(low, high, kind, name, f"type {facts['receiver']}" if facts["receiver"] else context)
            else:
                word = "module" if facts["head"].lstrip().startswith("module") else rule.kind
                inner = rule.context.format(name=facts["name"], outer=context, kind=word)
                if self.language in ("php", "scala") and context:
                    inner = f"{context}::{inner}" if self.language == "php" else f"{context}.{inner}"
                fits = min_lines <= high - low + 1 <= max_lines
                if rule.emit != "never" and fits:
                    yield Region(low, high, word, facts["name"], context, splits=False)
                if not (rule.emit == "else" and fits):
                    yield from self._walk(nodes[i + 1 : j], line, inner, min_lines, max_lines)
            i = j


_registry: dict[str, type[Chunker]] = {}


def register_chunker(language: str, chunker: type[Chunker]) -> None:
    """Files of ``language`` go to ``chunker`` from now on, before any that is built in."""
    _registry[language] = chunker


def chunker_for(language: str | None, registry: dict[str, type[Chunker]] | None = None) -> Chunker:
    own = (_registry if registry is None else registry).get(language or "")
    if own is not None:
        return own()
    if language == "python":
        return PythonChunker()
    return OutlineChunker(language) if language in RULES else WindowChunker()


COLUMNS = "file_path string, start_line int, end_line int, content string, language string, chunk_type string, name string, context string, chunker_used string"


def chunk_text(text: str, path: str, language: str | None, min_lines: int = 5, max_lines: int = 100, registry: dict | None = None) -> list[tuple]:
    """Rows of COLUMNS: regions of ``min_lines`` or more, what is over ``max_lines`` in parts."""
    rows = text.split("\n")
    chunker = chunker_for(language, registry)
    try:
        found = list(chunker.regions(text, min_lines, max_lines))
    except (SyntaxError, ValueError, RecursionError):
        chunker = WindowChunker()
        found = list(chunker.regions(text, min_lines, max_lines))
    if not found and isinstance(chunker, OutlineChunker):
        chunker = WindowChunker()
        found = list(chunker.regions(text, min_lines, max_lines))
    out = []
    for r in found:
        n = r.end - r.start + 1
        if n < min_lines:
            continue
        if n <= max_lines or not r.splits:
            pieces = [(r.start, r.end, r.chunk_type, r.name)]
        else:
            pieces = [(low, min(low + max_lines - 1, r.end), f"{r.chunk_type}_part", f"{r.name}_part{k}" if r.name else None) for k, low in enumerate(range(r.start, r.end + 1, max_lines), 1)]
        out += [(path, a, b, "\n".join(rows[a - 1 : b]), language or "", kind, name, r.context, type(chunker).__name__) for a, b, kind, name in pieces]
    return out


def chunk_files(files: DataFrame, min_lines: int = 5, max_lines: int = 100, max_chunks: int | None = 10_000) -> DataFrame:
    """Chunks of ``files`` (file_path, language, content), in Arrow batches.

    ``max_chunks`` keeps the first by path and lines; None keeps all.
    """
    check_sizes(min_lines, max_lines)
    registry = dict(_registry)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, language, text in zip(batch["file_path"], batch["language"], batch["content"], strict=True) for r in chunk_text(text or "", path, language, min_lines, max_lines, registry)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    out = files.select("file_path", "language", "content").mapInPandas(run, COLUMNS)
    return out if max_chunks is None else out.orderBy("file_path", "start_line", "end_line", "chunk_type").limit(max_chunks)
