"""Whole pages as rows with their pixels, and kernels that add columns to them without a shuffle.

A page is (page_id, width, height, gray, and r, g, b where it has colour), channels as
array<smallint>, rows end to end; sizes are columns, so pages of any size share one frame. What a
kernel finds stays in the page's row beside its pixels, so that later steps may look at them again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

from pagegrid.operators import clusters as C
from pagegrid.operators import edges as E

PIXELS = ["gray", "r", "g", "b"]


class Page:
    """One page's pixels, with what several kernels ask for."""

    def __init__(self, wide: int, high: int, channels: dict[str, np.ndarray]):
        self.wide, self.high = wide, high
        self.channels = {c: v.reshape(high, wide) for c, v in channels.items()}

    @property
    def gray(self) -> np.ndarray:
        return self.channels["gray"]

    @cached_property
    def lab(self) -> np.ndarray:
        """CIE Lab, height x width x 3; pages without colour are gray."""
        lab, number = self.tones
        return lab[number]

    @cached_property
    def tones(self) -> tuple[np.ndarray, np.ndarray]:
        """(Lab of each of the page's colours, the pixels' colour numbers, height x width)."""
        lab, number = C.distinct_colours(*self.rgb)
        return lab, number.reshape(self.high, self.wide)

    @property
    def rgb(self) -> list[np.ndarray]:
        """The three channels, row by row; one array three times where there is no colour."""
        if "r" not in self.channels:
            return [self.gray.ravel()] * 3
        return [self.channels[c].ravel() for c in "rgb"]

    @cached_property
    def light(self) -> np.ndarray:
        lab, number = self.tones
        return lab[:, 0][number]

    @cached_property
    def edges(self) -> np.ndarray:
        return E.voted_edges(self.gray)

    def away(self, background: tuple[float, float, float]) -> np.ndarray:
        """Distance of each pixel's colour from a background's."""
        lab, number = self.tones
        return np.sqrt(((lab - np.array(background)) ** 2).sum(-1))[number]

    def far(self, background: tuple[float, float, float], delta: float) -> np.ndarray:
        """Whether each pixel's colour is more than delta away from a background's."""
        lab, number = self.tones
        return (np.sqrt(((lab - np.array(background)) ** 2).sum(-1)) > delta)[number]


def as_bytes(column: pa.ListArray) -> pa.Array:
    """Each list of pixels as the bytes of its 16-bit numbers."""
    ends = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(2 * ends), pa.py_buffer(np.ascontiguousarray(column.flatten(), np.int16))])


def with_columns(pages: DataFrame, f: Callable[..., tuple], fields: str, uses: list[str] | None = None, drop_pixels: bool = False, pack: bool = False) -> DataFrame:
    """pages and the columns `fields`, a tuple that f(page, *values of the columns in uses) returns for each page.

    With pack, the pixels come out as binary columns, which later steps take as well: Spark copies them
    whole where it goes through an array pixel by pixel. A page is worked on alone, so tasks hold one Arrow batch of pages; spark.sql.execution.arrow.
    maxBytesPerBatch bounds that batch.
    """
    added = _parse_datatype_string(fields)
    here = [c for c in PIXELS if c in pages.columns]
    gone = here if drop_pixels else []
    packed = [c for c in here if isinstance(pages.schema[c].dataType, BinaryType)]
    packing = [c for c in here if pack and c not in packed and c not in gone]
    schema = StructType([*[StructField(x.name, BinaryType()) if x.name in packing else x for x in pages.schema.fields if x.name not in gone], *added.fields])
    types = [to_arrow_type(x.dataType) for x in added.fields]
    names, uses = [x.name for x in schema.fields], uses or []

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            wide, high = (batch.column(c).to_pylist() for c in ("width", "height"))
            values = [batch.column(c).to_pylist() for c in uses]
            out = []
            for i in range(batch.num_rows):
                page = Page(wide[i], high[i], {c: np.frombuffer(batch.column(c)[i].as_buffer(), np.int16) if c in packed else np.asarray(batch.column(c)[i].values) for c in here})
                out.append(f(page, *[v[i] for v in values]))
            kept = [as_bytes(batch.column(c)) if c in packing else batch.column(c) for c in batch.schema.names if c not in gone]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([row[k] for row in out], type=t) for k, t in enumerate(types)]], names=names)

    return pages.mapInArrow(run, schema)


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, as a step that the optimizer moves no filter across.

    A condition on a column that a long expression makes would else be pushed below it with the
    expression written out for every use, and plans grow out of all bounds. Rows should be small.
    """
    return rows.mapInArrow(lambda batches: batches, rows.schema)


def area_mean(plane: np.ndarray, high: int, wide: int) -> np.ndarray:
    """A smaller plane by means over areas: every pixel counts in one of them."""
    h, w = plane.shape
    if high and wide and h % high == 0 and w % wide == 0 and h * w <= 16 * high * wide:
        fy, fx = h // high, w // wide
        total = sum(plane[i::fy, j::fx].astype(np.int64) for i in range(fy) for j in range(fx))
        return (total / (fy * fx)).round().astype(np.int16)
    ys, xs = (np.arange(high) * h + high - 1) // high, (np.arange(wide) * w + wide - 1) // wide
    total = np.add.reduceat(np.add.reduceat(plane.astype(np.int64), ys, 0), xs, 1)
    return (total / (np.diff(np.append(ys, h))[:, None] * np.diff(np.append(xs, w)))).round().astype(np.int16)


def resized(page: Page, factor: float, most_width: int = 2400) -> Page:
    """The page at `factor`, never wider than most_width: smaller by area means, larger by the nearest pixel."""
    f = min(factor, most_width / page.wide)
    high, wide = max(1, int(page.high * f)), max(1, int(page.wide * f))
    if f < 1:
        return Page(wide, high, {c: area_mean(v, high, wide) for c, v in page.channels.items()})
    ys, xs = (np.arange(high) * page.high) // high, (np.arange(wide) * page.wide) // wide
    return Page(wide, high, {c: v[ys][:, xs] for c, v in page.channels.items()})


def rescaled(pages: DataFrame, factor: float, most_width: int = 2400) -> DataFrame:
    """pages with their pixels at `factor`, never wider than most_width; width and height follow."""
    here = [c for c in PIXELS if c in pages.columns]
    rest = [c for c in pages.columns if c not in (*here, "width", "height")]
    schema = StructType([*[pages.schema[c] for c in rest], *_parse_datatype_string("width int, height int, " + ", ".join(f"{c} array<smallint>" for c in here)).fields])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                wide, high = (batch.column(c)[i].as_py() for c in ("width", "height"))
                page = resized(Page(wide, high, {c: np.asarray(batch.column(c)[i].values) for c in here}), factor, most_width)
                head = [batch.column(c).slice(i, 1) for c in rest]
                size = [pa.array([n], pa.int32()) for n in (page.wide, page.high)]
                yield pa.RecordBatch.from_arrays([*head, *size, *[one_list(page.channels[c]) for c in here]], names=[x.name for x in schema.fields])

    return pages.mapInArrow(run, schema)


def one_list(plane: np.ndarray) -> pa.Array:
    """A plane's pixels as one Arrow list over its own buffer."""
    return pa.ListArray.from_arrays(pa.array([0, plane.size], pa.int32()), pa.array(plane.ravel().astype(np.int16)))


def from_images(images: DataFrame, most_width: int = 2400) -> DataFrame:
    """Pages with pixels from rows of the image source (page_id, width, height, nChannels, data: BGR or BGRA bytes, or gray).

    Pages wider than most_width shrink to it; width and height are those of the pixels, `factor`
    is what original lengths were multiplied by.
    """
    schema = "page_id long, width int, height int, factor double, " + ", ".join(f"{c} array<smallint>" for c in PIXELS)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, wide, high, n = (batch.column(c)[i].as_py() for c in ("page_id", "width", "height", "nChannels"))
                p = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8).reshape(high, wide, n)
                b, g, r = (p[..., 0],) * 3 if n == 1 else (p[..., k] for k in range(3))
                gray = np.rint(0.299 * r + 0.587 * g + 0.114 * b).astype(np.int16)
                page = Page(wide, high, {"gray": gray, "r": r.astype(np.int16), "g": g.astype(np.int16), "b": b.astype(np.int16)})
                small = resized(page, 1.0, most_width) if wide > most_width else page
                head = [pa.array([page_id], pa.int64()), pa.array([small.wide], pa.int32()), pa.array([small.high], pa.int32()), pa.array([small.wide / wide])]
                yield pa.RecordBatch.from_arrays([*head, *[one_list(small.channels[c]) for c in PIXELS]], names=["page_id", "width", "height", "factor", *PIXELS])

    return images.select("page_id", "width", "height", "nChannels", "data").mapInArrow(run, schema)


# --- measures of boxes


class Sums:
    """A page's sums: those of value, square, dark and colourful pixels over any box at once."""

    def __init__(self, page: Page, background: tuple[float, float, float], delta: float, dark: int):
        self.gray, self.dark, self.far = page.gray, dark, page.far(background, delta)
        self.wide, self.high = page.wide, page.high

    @cached_property
    def tables(self) -> list[np.ndarray]:
        gray = self.gray.astype(np.int64)
        planes = [gray, gray * gray, gray <= self.dark, self.far]
        return [np.pad(p.cumsum(0, dtype=np.int64).cumsum(1), ((1, 0), (1, 0))) for p in planes]

    def totals(self, x: np.ndarray, y: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> list[np.ndarray]:
        """Sums of value, square, dark and far pixels of each box; boxes that hold little in all are counted without tables."""
        if ((x1 - x) * (y1 - y)).sum() > 3 * self.wide * self.high:
            return [t[y1, x1] - t[y, x1] - t[y1, x] + t[y, x] for t in self.tables]
        out = []
        for a, b, c, d in zip(x, y, x1, y1, strict=True):
            count = np.bincount(self.gray[b:d, a:c].ravel())
            value = np.arange(len(count))
            out.append((count @ value, count @ (value * value), count[: self.dark + 1].sum(), np.count_nonzero(self.far[b:d, a:c])))
        return list(np.array(out).T)

    def of(self, boxes: list[dict]) -> list[dict]:
        """mean, std, dark and non_bg of each box, cut to whole pixels inside the page."""
        if not boxes:
            return []
        x, y, w, h = (np.array([b[c] for b in boxes]).astype(int) for c in "xywh")
        x, y = np.clip(x, 0, self.wide - 1), np.clip(y, 0, self.high - 1)
        x1, y1 = x + np.clip(w, 1, self.wide - x), y + np.clip(h, 1, self.high - y)
        n = (x1 - x) * (y1 - y)
        mean, square, dark, far = (t / n for t in self.totals(x, y, x1, y1))
        std = np.sqrt(np.maximum(square - mean * mean, 0))
        return [dict(zip(("mean", "std", "dark", "non_bg"), map(float, v), strict=True)) for v in zip(mean, std, dark, far, strict=True)]


MEASURE = "struct<mean:double,std:double,dark:double,non_bg:double>"


def with_measures(pages: DataFrame, boxes: str, background: str, delta: float = 15.0, dark: int = 200, **how) -> DataFrame:
    """pages with `measured`, one MEASURE for each box in the column `boxes`, and `whole`, that of the page.

    background: a column with a struct (L, A, B).
    """

    def measure(page: Page, found: list[dict] | None, ground: dict) -> tuple:
        sums = Sums(page, (ground["L"], ground["A"], ground["B"]), delta, dark)
        return sums.of(found or []), sums.of([{"x": 0, "y": 0, "w": page.wide, "h": page.high}])[0]

    return with_columns(pages, measure, f"measured array<{MEASURE}>, whole {MEASURE}", [boxes, background], **how)
