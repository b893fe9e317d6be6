"""Lean files by their declarations, each with the comments, attributes and modifiers that lead it."""

from __future__ import annotations

import re
from collections.abc import Iterator

from lodestone.operators.parsing import Unit, text_lines

# Declaration keywords, modifiers, and what they are called in chunks and in the index.
MODIFIERS = "private|protected|noncomputable|unsafe|partial|scoped|local"
KEYWORDS = "def|theorem|lemma|structure|class|inductive|abbrev|instance|axiom|example"
CHUNK_KINDS = {"structure": "class", "class": "class", "inductive": "class", "def": "function", "abbrev": "function", "axiom": "function"}
ENTRY_KINDS = {"structure": "class", "class": "class", "inductive": "class", "def": "definition", "abbrev": "definition"}

DECLARATION = re.compile(rf"\s*(?:(?:{MODIFIERS})\s+)*({KEYWORDS})\s+([^\s(:{{]+)")
LEADING = re.compile(rf"\s*(?:@\[|(?:{MODIFIERS})\b)")
MARK = re.compile(r"/-|-/|--")


def without_comments(lines: list[str]) -> tuple[list[str], list[int]]:
    """Lines with comments cut out, and the depth of nested block comments at each line's start."""
    depth, out, depths = 0, [], []
    for line in lines:
        depths.append(depth)
        kept, at = [], 0
        while at < len(line):
            m = MARK.search(line, at)
            stop = m.start() if m else len(line)
            if depth == 0:
                kept.append(line[at:stop])
            if not m:
                break
            at = m.end()
            if m[0] == "/-":
                depth += 1
            elif depth == 0:
                if m[0] == "--":
                    break
                kept.append(m[0][0])  # a lone -/ outside comments: its dash is code
                at = stop + 1
            elif m[0] == "-/":
                depth -= 1
            else:
                at = stop + 1  # inside a block comment one dash at a time, so that --/ closes it
        out.append("".join(kept))
    return out, depths


def leading_start(lines: list[str], depths: list[int], taken: set[int], line: int) -> int:
    """First line of the block of doc comments, line comments, attributes and modifiers right above ``line``.

    A line that is itself a declaration (in ``taken``) ends the block.
    """
    start, i = line, line - 1
    while i >= 1 and i not in taken:
        bare = lines[i - 1].strip()
        if not bare:
            break
        if LEADING.match(lines[i - 1]) or bare.startswith("--"):
            start, i = i, i - 1
        elif bare.endswith("-/"):
            j = i
            while j > 1 and depths[j - 1] > 0:
                j -= 1
            if not lines[j - 1].lstrip().startswith("/-"):
                break
            start, i = j, j - 1
        else:
            break
    return start


def parse_lean(text: str, file_name: str, ext: str, least: int, most: int) -> Iterator[Unit]:
    lines = text_lines(text)
    code, depths = without_comments(lines)
    found = [(n, m[1], m[2]) for n, x in enumerate(code, 1) if (m := DECLARATION.match(x))]
    taken = {n for n, _, _ in found}
    starts = [leading_start(lines, depths, taken, n) for n, _, _ in found] + [len(lines) + 1]
    cut = lambda a, b: "".join(lines[a - 1 : b]).strip()
    if lines and starts[0] > 1 and (head := cut(1, starts[0] - 1)):
        yield Unit(1, starts[0] - 1, "module_preamble", f"{file_name} preamble", head, f"{file_name} (module preamble)", "lean")
    for (line, kind, name), a, b in zip(found, starts, starts[1:]):
        if body := cut(a, b - 1):
            yield Unit(a, b - 1, CHUNK_KINDS.get(kind, kind), name, body, name, "lean")
        yield Unit(line, b - 1, ENTRY_KINDS.get(kind, kind), name)
