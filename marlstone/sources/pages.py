"""Documents from files and web pages: a pluggable parser gives the pages of a binary file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: content -> [(page number, text)]
Parser = Callable[[bytes], list[tuple[int, str]]]


def plain_parser(content: bytes) -> list[tuple[int, str]]:
    """Form feeds part the pages of a plain text."""
    return [(i + 1, page) for i, page in enumerate(content.decode("utf-8", "replace").split("\f"))]


def load_pages(files: DataFrame, parsers: tuple[Parser, ...] = (plain_parser,), keep_blank: bool = False) -> DataFrame:
    """path, page, text, error: pages by the first parser that succeeds; a row with an error if none does."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                error = ""
                for parser in parsers:
                    try:
                        rows += [(path, n, t.strip(), None) for n, t in parser(bytes(content)) if keep_blank or t.strip()]
                        break
                    except Exception as e:  # noqa: BLE001  any fault of a parser leads to the next one
                        error = str(e)
                else:
                    rows.append((path, None, None, error))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def html_text(html: Column) -> Column:
    """The text of a page: scripts and styles go, block ends become line feeds, tags go."""
    no_code = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    lines = F.regexp_replace(no_code, r"(?i)</(p|h1|h2|h3|li|title|div|tr)>", "\n")
    plain = F.regexp_replace(lines, r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.regexp_replace(plain, "[ \t]+", " ")
