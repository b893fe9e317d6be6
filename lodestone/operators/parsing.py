"""What the language parsers share: their records, and how they are run over files.

A parser takes a file's text and gives ``Unit`` records: chunks to embed and
entries for the pointer index, from one parse. Files are parsed where they lie
(``mapInArrow``: no shuffle); a file that can't be parsed gives one error row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Unit:
    """A chunk (``text`` given) or an index entry (``text`` is None)."""

    start: int
    end: int
    kind: str
    name: str
    text: str | None = None
    title: str | None = None
    language: str | None = None
    parent: tuple[int, int, str] | None = None


#: Files, and about so many bytes of them, that a worker holds as Python values, with all units parsed from them.
FILES_AT_ONCE, BYTES_AT_ONCE = 256, 4 << 20

Parser = Callable[[str, str, str, int, int], Iterable[Unit]]

PARSED = (
    "source_path string, file_name string, text string, section_title string, start_line int, end_line int, language string, kind string, name string, "
    "parent_start int, parent_end int, parent_name string, error string"
)
_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in PARSED.split(", ")]


def text_lines(text: str) -> list[str]:
    """Lines with their ends, as a file read in text mode gives them."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [x for x in text.splitlines(keepends=True)] if not any(c in text for c in "\v\f\x1c\x1d\x1e\x85\u2028\u2029") else _only_lf(text)


def _only_lf(text: str) -> list[str]:
    parts = text.split("\n")
    return [x + "\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def parts(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    """Slices of a batch of files: some hundred files of usual size, fewer of large ones."""
    rows = max(1, min(FILES_AT_ONCE, batch.num_rows * BYTES_AT_ONCE // max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def parsed_files(files: DataFrame, parsers: dict[str, Parser], least: int, most: int) -> DataFrame:
    """Units of ``files`` (source_path, file_name, strategy, ext, content) whose strategy names a parser."""
    rows = files.select("source_path", "file_name", "strategy", "ext", "content")

    def run(batches):
        for whole in batches:
            for batch in parts(whole):
                out = []
                for path, name, strategy, ext, content in zip(*(c.to_pylist() for c in batch.columns)):
                    try:
                        units = list(parsers[strategy](content or "", name, ext, least, most))
                        out += [(path, name, u.text, u.title or u.name, u.start, u.end, u.language, u.kind, u.name, *(u.parent or (None, None, None)), None) for u in units]
                    except Exception as e:  # one bad file must not end the batch
                        out.append((path, name, None, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(_NAMES), _TYPES)], _NAMES)

    return rows.mapInArrow(run, PARSED)
