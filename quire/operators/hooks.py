"""User hooks: recognisers and block orderings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut
from .ingest import clean_observations
from .layout import order_and_compose
from .ordered import with_group_index

OBSERVATIONS = (
    "array<struct<candidates:array<struct<text:string,confidence:double>>,x:double,y:double,w:double,h:double>>"
)
#: Images per Arrow batch; images are large, rows are few.
IMAGE_BATCH = 16


def recognize(images: DataFrame, recognizer: Callable[[bytes], list[dict]], key: str) -> DataFrame:
    """Run a recogniser on every image: (key, observations).

    ``images``: key, content. The recogniser gets one image's bytes and returns
    observations with ``candidates`` (best first) and ``x, y, w, h``. Images
    stream through in Arrow batches; only a batch is held at a time.
    """
    schema = f"{key} {images.schema[key].dataType.simpleString()}, observations {OBSERVATIONS}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), IMAGE_BATCH):
                part = batch.iloc[start : start + IMAGE_BATCH]
                found = [recognizer(bytes(content)) for content in part["content"]]
                yield pd.DataFrame({key: part[key].to_list(), "observations": found})

    return images.select(key, "content").mapInPandas(run, schema)


def recognize_pages(images: DataFrame, recognizer: Callable[[bytes], list[dict]], key: str) -> DataFrame:
    """Recognise, clean, order and compose: page text per image."""
    # written once: the steps after it read it more than once, and a recogniser may not repeat itself
    blocks = clean_observations(cut(recognize(images, recognizer, key)), [key])
    return order_and_compose(blocks.withColumnRenamed("reading_order", "ordinal"), [key], ["ordinal"])


def order_by_key(
    blocks: DataFrame,
    keys: Sequence[str],
    ordinal: Sequence[str],
    sort_key: Callable[[pd.DataFrame], pd.Series],
) -> DataFrame:
    """Order blocks by a user's per-block sort key (a double); ties by ordinal.

    The key function sees batches of blocks, so pages of any size are fine.
    """
    schema = T.StructType([*blocks.schema.fields, T.StructField("_key", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(_key=sort_key(batch).astype("float64"))

    keyed = cut(blocks.mapInPandas(run, schema))  # the key function runs once
    order = [F.col("_key"), *[F.col(o) for o in ordinal]]
    return with_group_index(keyed, keys, order, "reading_order").drop("_key")


def _whole_pages(
    batches: Iterator[pd.DataFrame], keys: Sequence[str]
) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by key as frames of whole pages, with a number for each row's page.

    A page that goes over the end of a batch comes in a frame of its own, so types of one batch stay out of others.
    """
    held: list[pd.DataFrame] = []  # rows of the page that the batches end with so far
    for batch in batches:
        if batch.empty:
            continue
        group = batch.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        number = np.cumsum(np.diff(group, prepend=group[0]) != 0)
        low, high = 0, int(np.searchsorted(number, number[-1]))
        if held and pd.concat([held[-1].tail(1), batch.head(1)])[keys].duplicated().iloc[-1]:
            low = int(np.searchsorted(number, 1))
            held.append(batch.iloc[:low])
            if low == len(batch):
                continue
        if held:
            page = pd.concat(held, ignore_index=True)
            yield page, np.zeros(len(page), dtype=np.int64)
        if low < high:
            yield batch.iloc[low:high], number[low:high]
        held = [batch.iloc[high:]]
    if held:
        page = pd.concat(held, ignore_index=True)
        yield page, np.zeros(len(page), dtype=np.int64)


def order_with(
    blocks: DataFrame,
    keys: Sequence[str],
    ordinal: Sequence[str],
    ordering: Callable[[pd.DataFrame], pd.DataFrame | np.ndarray],
) -> DataFrame:
    """Order pages by a user function over whole pages.

    Every call gets one complete page, sorted by ``ordinal``. It returns the page's rows in reading order, changed
    or not, or only their places on the page in reading order (integers from 0), always one or the other. Places are
    much cheaper: rows of many pages are then moved together instead of in a frame each. Pages are dealt out by key
    and stream through in Arrow batches; a page must fit one task, however long it is, since the function sees it as
    a whole. ``order_by_key`` has no such need.
    """
    keys, columns = list(keys), [*blocks.columns, "reading_order"]
    schema = T.StructType([*blocks.schema.fields, T.StructField("reading_order", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pages, number in _whole_pages(batches, keys):
            pages = pages.copy()  # has one block a type, which makes all that is done to a page cheaper
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1), len(pages)]
            done = []
            for _, page in pages.groupby(number, sort=False):
                page.index = pd.RangeIndex(len(page))
                done.append(ordering(page))
            sizes = np.fromiter(map(len, done), dtype=np.int64, count=len(done))
            if isinstance(done[0], pd.DataFrame):
                ordered = pd.concat(done)
            else:
                places = np.concatenate(done, dtype=np.int64, casting="same_kind")
                if ((places < 0) | (places >= np.repeat(np.diff(edges), sizes))).any():
                    raise IndexError("an ordering returned a place that its page does not have")
                ordered = pages.take(places + np.repeat(edges[:-1], sizes))
            ordered["reading_order"] = np.arange(len(ordered)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield ordered[columns]

    order = [*[F.col(k) for k in keys], *[F.col(o).asc_nulls_last() for o in ordinal]]
    return blocks.repartition(*keys).sortWithinPartitions(*order).mapInPandas(run, schema)
