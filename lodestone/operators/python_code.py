"""Python files by their syntax tree; broken ones by the structural scanner."""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator

from lodestone.operators.parsing import Unit

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


class _Source:
    """Line ranges of nodes and their text without common indentation."""

    def __init__(self, text: str):
        self.lines = text.splitlines(keepends=True)

    @staticmethod
    def span(node: ast.AST) -> tuple[int, int]:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        return first, node.end_lineno or node.lineno

    def cut(self, first: int, last: int) -> str:
        return textwrap.dedent("".join(self.lines[first - 1 : last])).strip("\n")


def _function(src: _Source, node, most: int) -> Iterator[Unit]:
    """One chunk, or parts of whole statements that together hold at most ``most`` lines each; later ones repeat the signature."""
    first, last = src.span(node)
    if last - first + 1 <= most or not node.body:
        yield Unit(first, last, "function", node.name, src.cut(first, last), language="python")
        return
    groups, held = [[]], 0
    for statement in node.body:
        a, b = src.span(statement)
        if groups[-1] and held + b - a + 1 > most:
            groups.append([])
            held = 0
        groups[-1].append((a, b))
        held += b - a + 1
    head = src.cut(first, node.body[0].lineno - 1) if node.body[0].lineno > first else ""
    for n, group in enumerate(groups):
        a, b = group[0][0], group[-1][1]
        body = src.cut(first if n == 0 else a, b)
        text = body if n == 0 or not head else f"{head}\n{body}"
        yield Unit(first if n == 0 else a, b, "function", node.name, text, f"{node.name} (part {n + 1})", "python")


def _class(src: _Source, node: ast.ClassDef, least: int) -> Iterator[Unit]:
    first, last = src.span(node)
    yield Unit(first, last, "class", node.name, src.cut(first, last), language="python")
    for sub in node.body:
        if isinstance(sub, DEFS):
            a, b = src.span(sub)
            if b - a + 1 >= least:
                yield Unit(a, b, "method", f"{node.name}.{sub.name}", src.cut(a, b), language="python", parent=(first, last, node.name))


def _entries(tree: ast.Module) -> Iterator[Unit]:
    """Index entries begin at the def or class line; all methods count."""
    for node in tree.body:
        if isinstance(node, DEFS):
            yield Unit(node.lineno, node.end_lineno, "function", node.name)
        elif isinstance(node, ast.ClassDef):
            yield Unit(node.lineno, node.end_lineno, "class", node.name)
            for sub in node.body:
                if isinstance(sub, DEFS):
                    yield Unit(sub.lineno, sub.end_lineno, "method", f"{node.name}.{sub.name}")


def _chunks(src: _Source, tree: ast.Module, file_name: str, least: int, most: int) -> Iterator[Unit]:
    """Functions and classes; runs of other statements between them are preambles. Comments outside statements aren't kept."""
    waiting: list[tuple[int, int]] = []

    def preamble() -> Iterator[Unit]:
        if waiting and (text := src.cut(waiting[0][0], waiting[-1][1])):
            yield Unit(waiting[0][0], waiting[-1][1], "module_preamble", f"{file_name} preamble", text, f"{file_name} (module preamble)", "python")
        waiting.clear()

    for node in tree.body:
        if isinstance(node, (*DEFS, ast.ClassDef)):
            yield from preamble()
            yield from _class(src, node, least) if isinstance(node, ast.ClassDef) else _function(src, node, most)
        else:
            waiting.append((node.lineno, node.end_lineno or node.lineno))
    yield from preamble()


def parse_python(text: str, file_name: str, ext: str, least: int, most: int) -> Iterator[Unit]:
    from lodestone.operators.structural import parse_code

    text = re.sub(r"\r\n?", "\n", text)
    if not text.strip():
        return
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):  # a null byte is a ValueError
        yield from parse_code(text, file_name, ext, least, most)
        return
    yield from _chunks(_Source(text), tree, file_name, least, most)
    yield from _entries(tree)
