"""Markup -> flat rows in page order, on Arrow batches. Nothing is chosen here: column rules do that (``functions.html``).

A page is an array of rows: elements, their ends, and texts. A row's place in the
array is its number. An element also has the number of its end, so one lies inside
another if its number lies between the other's two.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = "#text"  # tag of a text; an end has the element's tag behind a slash

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Comments are dropped, references decoded; a paragraph ends where the next one begins; of repeated attributes the first counts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []

    def add(self, tag: str, **more) -> dict:
        row = {"at": len(self.rows), "owner": self.open[-1]["at"] if self.open else -1, "tag": tag, **more}
        self.rows.append(row)
        return row

    def handle_starttag(self, tag, attrs):
        if tag == "p" and any(row["tag"] == "p" for row in self.open):
            self.handle_endtag("p")
        own = {k: v or "" for k, v in reversed(attrs)}
        row = self.add(tag, attrs=list(own.items()), classes=own.get("class", "").split(), close=len(self.rows) + 1)
        if tag not in _VOID:
            self.open.append(row)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(row["tag"] == tag for row in self.open):
            while self.end() != tag:
                pass

    def end(self) -> str:
        row = self.open.pop()
        row["close"] = self.add("/" + row["tag"])["at"]
        return row["tag"]

    def handle_data(self, data):
        self.add(TEXT, text=data)

    def read(self, markup: str) -> list[dict]:
        self.feed(markup)
        self.close()
        while self.open:
            self.end()
        return self.rows


ROW = T.StructType([
    T.StructField("at", T.IntegerType()), T.StructField("close", T.IntegerType()), T.StructField("owner", T.IntegerType()),
    T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()),
])
_ARROW = pa.list_(pa.struct([
    ("at", pa.int32()), ("close", pa.int32()), ("owner", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("classes", pa.list_(pa.string())), ("text", pa.string()),
]))


SLICE = 32  # pages read at a time
SLICE_BYTES = 1 << 18  # of their markup, where they are more than one: what a task holds grows neither with its rows nor with long pages


def _slices(markup: pa.Array) -> Iterator[pa.Array]:
    """At most ``SLICE`` pages each, and one page or at most ``SLICE_BYTES`` of markup."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(markup), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(markup):
        most = SLICE_BYTES + (ends[start - 1] if start else 0)
        stop = min(max(int(np.searchsorted(ends, most, "right")), start + 1), start + SLICE)
        yield markup.slice(start, stop - start)
        start = stop


def _page(markup: str | None) -> pa.Array:
    return pa.array([_Reader().read(markup or "")], _ARROW)


@F.arrow_udf(T.ArrayType(ROW))
def _rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for markup in batches:
        for part in _slices(markup):
            yield pa.concat_arrays([_page(m) for m in part.to_pylist()])  # only one page's rows are Python objects at a time


# Marked so that the optimizer moves no filter on its result below it, where the page would be read a second time.
_once = _rows.asNondeterministic()


def parse(markup: Column) -> Column:
    """The rows of a page, from one reading. A null page has none."""
    return _once(markup)
