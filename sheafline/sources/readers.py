"""The interface of page readers: pixels in, words out.  No recognition engine is part of this package; one plugs in
here, and everything from words onward is the engine's own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

WORDS = "page_key string, engine string, line_no int, word_no int, text string, conf double, x0 int, y0 int, x1 int, y1 int"


class Reader(Protocol):
    """name: as in the vote; read: words of one page's bytes as (line, word, text, conf, x0, y0, x1, y1)."""

    name: str

    def read(self, content: bytes) -> list[tuple[int, int, str, float, int, int, int, int]]: ...


def read_pages(pages: DataFrame, reader: Reader) -> DataFrame:
    """pages(page_key, content) -> words, one page at a time; a page that can't be read gives no rows here and a
    flagged row later."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, content in zip(frame.page_key, frame.content):
                try:
                    found = reader.read(bytes(content))
                except Exception:  # noqa: BLE001  whatever an engine raises, other pages go on
                    found = []
                if found:
                    yield pd.DataFrame([(key, reader.name, *w) for w in found], columns=[c.split()[0] for c in WORDS.split(", ")])

    return pages.select("page_key", "content").mapInPandas(run, WORDS)
