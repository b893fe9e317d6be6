"""Top-level functions, classes and methods of ten languages by a lexical scanner.

No tree parser is needed: comments and strings are blanked out, so that what is
left can be cut at brackets, semicolons and line ends into root items. Each item
is classed by its head. Fidelity: root level only; preprocessor branches, macros
that open braces and regular expression literals are not understood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from lodestone.operators.parsing import Unit

# Languages by extension.
LANGUAGES = {
    "python": [".py"], "javascript": [".js", ".jsx", ".mjs"], "typescript": [".ts", ".tsx"], "glsl": [".glsl", ".vert", ".frag", ".comp"],
    "rust": [".rs"], "go": [".go"], "java": [".java"], "c": [".c", ".h"], "cpp": [".cpp", ".cc", ".cxx", ".hpp"], "ruby": [".rb"], "swift": [".swift"],
}
EXTENSIONS = {e: language for language, some in LANGUAGES.items() for e in some}

NAME = r"[A-Za-z_$][\w$]*"
C_FUNCTION = rf"(?s)(?!\s*(?:typedef|struct\s+{NAME}\s*$|enum|union|namespace|template|extern\s*\"))[^=;]*?(?P<name>~?{NAME}(?:::~?{NAME})*)\s*\([^;]*\)[^;=]*\{{$"


@dataclass
class Grammar:
    """Heads (up to and with the opening brace) of functions, classes and methods; how comments and strings look."""

    function: str | None = None
    classes: str | None = None
    method: str | None = None
    line_comment: str = "//"
    block_comment: bool = True
    quotes: str = "\"'"
    newline_ends: bool = False
    hash_lines: bool = False
    raw: list[str] = field(default_factory=list)


JS_METHOD = rf"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(?P<name>#?{NAME})\s*(?:<[^()]*>)?\([^;]*\{{$"
JAVA_MODS = r"(?:(?:public|private|protected|static|final|abstract|sealed|strictfp|default|synchronized|native)\s+|@[\w.]+(?:\([^)]*\))?\s*)*"
SWIFT_MODS = r"(?:@[\w.]+(?:\([^)]*\))?\s*|(?:public|private|fileprivate|internal|open|static|final|override|mutating|class|convenience|required)\s+)*"
GRAMMARS = {
    "javascript": Grammar(rf"(?:async\s+)?function\s*\*?\s*(?P<name>{NAME})", rf"class\s+(?P<name>{NAME})", JS_METHOD, quotes="\"'`", newline_ends=True),
    "typescript": Grammar(rf"(?:async\s+)?function\s*\*?\s*(?P<name>{NAME})[^;]*\{{$", rf"class\s+(?P<name>{NAME})", JS_METHOD, quotes="\"'`", newline_ends=True),
    "glsl": Grammar(C_FUNCTION, hash_lines=True, quotes=""),
    "rust": Grammar(rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*fn\s+(?P<name>{NAME})", rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:struct|enum|impl(?:\s*<[^{{]*?>)?)\s+!?(?P<name>{NAME})", rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*fn\s+(?P<name>{NAME})", quotes='"'),
    "go": Grammar(rf"func\s+(?:\([^)]*\)\s*)?(?P<name>{NAME})", rf"type\s+(?P<name>{NAME})", quotes="\"'`", newline_ends=True),
    "java": Grammar(None, rf"{JAVA_MODS}(?:class|interface|enum)\s+(?P<name>{NAME})", rf"{JAVA_MODS}(?:<[^(]*>\s*)?(?:[\w.<>\[\],?\s]+\s+)?(?P<name>{NAME})\s*\([^;=]*(?:\{{|;)$"),
    "c": Grammar(C_FUNCTION, rf"struct\s+(?P<name>{NAME})\s*\{{$", hash_lines=True),
    "cpp": Grammar(C_FUNCTION, rf"(?:class|struct)\s+(?P<name>{NAME})[^;(]*\{{$", rf"(?:[^=;]*?[\s*&])?(?P<name>~?{NAME})\s*\([^;]*\)[^;=]*\{{$", hash_lines=True),
    "swift": Grammar(rf"{SWIFT_MODS}func\s+(?P<name>{NAME})", rf"{SWIFT_MODS}(?:class|struct|enum|actor|protocol|extension)\s+(?P<name>{NAME})", rf"{SWIFT_MODS}func\s+(?P<name>{NAME})", newline_ends=True, quotes='"'),
}


def blanked(text: str, g: Grammar) -> tuple[str, list[tuple[int, int]]]:
    """The text with comments and strings as spaces (line ends stay), and the comments' places."""
    strings = [rf"{q}(?:\\.|[^{q}\\])*{q}" if q == "`" else rf"{q}(?:\\.|[^{q}\\\n])*{q}" for q in g.quotes]
    comments = [re.escape(g.line_comment) + r"[^\n]*"] + ([r"/\*.*?(?:\*/|\Z)"] if g.block_comment else [])
    out, found = [], []
    at = 0
    for m in re.finditer(rf"(?s)(?P<comment>{'|'.join(comments)})" + (f"|{'|'.join(strings)}" if strings else ""), text):
        out += [text[at : m.start()], re.sub(r"[^\n]", " ", m[0]) if m["comment"] else m[0][0] + re.sub(r"[^\n]", "_", m[0][1:-1]) + m[0][-1]]
        if m["comment"]:
            found.append(m.span())
        at = m.end()
    return "".join(out) + text[at:], found


def items(code: str, start: int, stop: int, g: Grammar) -> Iterator[tuple[int, int, str]]:
    """(start, stop, head) of statements and braced blocks between two places; heads end with the brace that opens the block."""
    at = start
    while at < stop:
        if code[at].isspace() or code[at] in ";,":
            at += 1
            continue
        if g.hash_lines and code[at] == "#":
            m = re.compile(r"(?:[^\n]*\\\n)*[^\n]*").match(code, at, stop)
            yield at, m.end(), "#"
            at = max(m.end(), at + 1)
            continue
        depth, i, head = 0, at, None
        while i < stop:
            c = code[i]
            if c in "([{":
                if c == "{" and depth == 0 and head is None and (not g.newline_ends or "=" not in re.sub(r"[=!<>]=|=>|\([^()]*\)", "", code[at:i])):
                    head = code[at : i + 1]
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth < 0:
                    break
                if c == "}" and depth == 0 and head is not None:
                    i += 1
                    break
            elif depth == 0 and (c == ";" or c == "\n" and g.newline_ends and not _goes_on(code, at, i, stop)):
                i += c == ";"
                break
            i += 1
        end = max(i, at + 1)
        yield at, end, head or code[at:end].strip()
        at = end


def _goes_on(code: str, at: int, i: int, stop: int) -> bool:
    """A statement goes on past a line end after an operator or before a brace, a dot or an operator."""
    before, after = code[at:i].rstrip(), code[i:stop].lstrip()
    return before.endswith((",", "=", "+", "-", "*", "&&", "||", "(", "=>", ":")) or after.startswith(("{", ".", "?", ":", "&&", "||", "=>"))


@dataclass
class Item:
    start: int
    stop: int
    kind: str
    name: str = ""
    methods: list = field(default_factory=list)


def root_items(text: str, language: str) -> list[Item]:
    """Root items in text order: function, class (with its methods), other; comments are items of their own."""
    g = GRAMMARS[language]
    code, comments = blanked(text, g)
    out = []
    for a, b, head in items(code, 0, len(code), g):
        m = re.match(g.classes, head) if g.classes else None
        if m:
            item = Item(a, b, "class", m["name"])
            brace = code.find("{", a, b)
            if g.method and brace >= 0:
                for x, y, inner in items(code, brace + 1, b - 1, g):
                    if n := re.match(g.method, inner.lstrip()):
                        item.methods.append(Item(x, y, "method", n["name"]))
            out.append(item)
        elif g.function and (m := re.match(g.function, head)):
            out.append(Item(a, b, "function", m["name"]))
        else:
            out.append(Item(a, b, "other"))
    inside = lambda s: any(x.start <= s < x.stop for x in out)
    out += [Item(a, b, "other") for a, b in comments if not inside(a)]
    return sorted(out, key=lambda x: x.start)


RUBY_OPEN = re.compile(r"^\s*(?:(?:private|public|protected|private_class_method|module_function)\s+)?(?P<word>def|class|module|if|unless|while|until|case|begin|for)\b(?P<rest>.*)$")
RUBY_NAME = re.compile(r"\s+(?:self\.)?(?P<name>[A-Za-z_][\w:]*[?!=]?)")


def ruby_items(text: str) -> list[Item]:
    """Ruby by lines: an opening word adds one level, ``do`` at a line's end too, ``end`` takes one away."""
    out, stack, at = [], [], 0
    for line in text.splitlines(keepends=True):
        bare = re.sub(r"#(?!\{).*$", "", re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", '""', line.rstrip("\n")))
        m = RUBY_OPEN.match(bare)
        closed = bool(re.search(r"(?:^|;|\s)end\b", bare))
        if m and not (m["word"] == "def" and re.search(r"\)\s*=|\bdef\s+\S+\s*=\s", bare)):
            name = RUBY_NAME.match(m["rest"]) if m["word"] in ("def", "class", "module") else None
            kind = {"def": "function", "class": "class", "module": "class"}.get(m["word"], "other")
            item = Item(at + len(line) - len(line.lstrip()), 0, kind, name["name"] if name else "<anonymous>")
            if not stack:
                out.append(item)
            elif len(stack) == 1 and kind == "function" and stack[0].kind == "class":
                item.kind = "method"
                stack[0].methods.append(item)
            stack.append(item)
        elif re.search(r"\bdo\b(?:\s*\|[^|]*\|)?\s*$", bare):
            stack.append(Item(at, 0, "other"))
            if len(stack) == 1:
                out.append(stack[0])
        elif not stack and bare.strip() or not stack and line.strip():
            out.append(Item(at + len(line) - len(line.lstrip()), at + len(line.rstrip()), "other"))
        if closed and stack:
            stack.pop().stop = at + len(line.rstrip())
        at += len(line)
    for item in stack:
        item.stop = len(text.rstrip())
    return out


PYTHON_HEAD = re.compile(r"(?P<indent>[ \t]*)(?:async\s+)?(?P<word>def|class)\s+(?P<name>\w+)")


def python_items(text: str) -> list[Item]:
    """Broken Python by indentation: a block lasts to the next line that stands no deeper; decorators lead it."""
    lines, at, rows = text.splitlines(keepends=True), 0, []
    for line in lines:
        rows.append((at, at + len(line.rstrip()), len(line) - len(line.lstrip()), line))
        at += len(line)

    def block(n: int) -> int:
        last = n
        for m in range(n + 1, len(rows)):
            if rows[m][3].strip() and rows[m][2] <= rows[n][2] and not rows[m][3].lstrip().startswith((")", "]", "#")):
                break
            if rows[m][3].strip() and rows[m][2] > rows[n][2]:
                last = m
        return last

    out, n = [], 0
    while n < len(rows):
        line = rows[n][3]
        head = n
        while head < len(rows) and rows[head][3].startswith("@"):
            head += 1
        m = PYTHON_HEAD.match(rows[head][3]) if head < len(rows) else None
        if m and not m["indent"]:
            last = block(head)
            item = Item(rows[n][0], rows[last][1], "class" if m["word"] == "class" else "function", m["name"])
            if item.kind == "class":
                depth = None
                for k in range(head + 1, last + 1):
                    x = PYTHON_HEAD.match(rows[k][3])
                    if x and x["word"] == "def" and (depth is None or len(x["indent"]) == depth):
                        depth = len(x["indent"])
                        first = k
                        while first > head + 1 and rows[first - 1][3].lstrip().startswith("@"):
                            first -= 1
                        item.methods.append(Item(rows[first][0] + depth, rows[block(k)][1], "method", x["name"]))
            out.append(item)
            n = last + 1
        else:
            if line.strip():
                out.append(Item(rows[n][0], rows[n][1], "other"))
            n += 1
    return out


def merge_tiny(units: list[Unit], least: int) -> list[Unit]:
    """A small preamble or function joins the preamble or function before it; classes and methods stay as they are."""
    if least <= 0:
        return units
    out: list[Unit] = []
    for u in units:
        alone = lambda x: x.parent is None and x.kind not in ("class", "method")
        if out and u.end - u.start + 1 < least and alone(u) and alone(out[-1]):
            p = out[-1]
            out[-1] = Unit(p.start, u.end, p.kind, p.name, f"{p.text}\n\n{u.text}".strip(), p.title, p.language)
        else:
            out.append(u)
    return out


def parse_code(text: str, file_name: str, ext: str, least: int, most: int) -> Iterator[Unit]:
    language = EXTENSIONS.get(ext)
    if not language or not text.strip():
        return
    found = python_items(text) if language == "python" else ruby_items(text) if language == "ruby" else root_items(text, language)
    line = lambda at: text.count("\n", 0, at) + 1
    span = lambda x: (line(x.start), line(max(x.stop - 1, x.start)))
    units: list[Unit] = []
    waiting: list[Item] = []

    def preamble() -> None:
        if waiting and (body := text[waiting[0].start : waiting[-1].stop].strip()):
            units.append(Unit(span(waiting[0])[0], span(waiting[-1])[1], "module_preamble", f"{file_name} preamble", body, f"{file_name} (module preamble)", language))
        waiting.clear()

    entries = []
    for x in found:
        if x.kind == "other":
            waiting.append(x)
            continue
        preamble()
        a, b = span(x)
        units.append(Unit(a, b, x.kind, x.name, text[x.start : x.stop].strip(), x.name, language))
        entries.append(Unit(a, b, x.kind, x.name))
        for m in x.methods:
            c, d = span(m)
            entries.append(Unit(c, d, "method", f"{x.name}.{m.name}"))
            if b - a + 1 > most:
                units.append(Unit(c, d, "method", f"{x.name}.{m.name}", text[m.start : m.stop].strip(), f"{x.name}.{m.name}", language, (a, b, x.name)))
    preamble()
    yield from merge_tiny(units, least)
    yield from entries
