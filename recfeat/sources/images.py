"""Fetching images by address, a few at a time in each task."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame

from .shards import located

AT_ONCE, TIMEOUT_S, BATCH = 8, 10, 64


def fetch_url(url: str) -> bytes:
    with urlopen(url, timeout=TIMEOUT_S) as reply:  # noqa: S310
        return reply.read()


def fetch(urls: DataFrame, fetcher: Callable[[str], bytes] = fetch_url, key: str = "parent_asin", partitions: int | None = None, batch: int = BATCH) -> DataFrame:
    """``(key, url, content)`` of each item's address that can be read; failures are logged and left out.

    Empty addresses are skipped, and an item is fetched once. At most ``AT_ONCE`` requests run in a task,
    whose threads are started once; ``batch`` addresses are dealt to them at a time.
    """
    wanted = urls.where("url <> ''").dropDuplicates([key]).select(key, "url")
    wanted = wanted.repartition(partitions, key) if partitions else wanted

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(url):
            try:
                return fetcher(url)
            except Exception as why:  # any failure of one address must not end the job
                logging.getLogger(__name__).warning("cannot fetch %s: %s", url, why)
                return None

        with ThreadPoolExecutor(AT_ONCE) as pool:
            for frame in frames:
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch]
                    got = part.assign(content=list(pool.map(one, part["url"])))
                    yield got[got["content"].notna()]

    return wanted.mapInPandas(run, f"{key} string, url string, content binary")


def land(rows: DataFrame, path: str, ending: str, key: str = "parent_asin") -> int:
    """Write each row's ``content`` as a file ``<key>.<ending>`` in the folder ``path``, which all executors share; returns their number.

    Rows without a key or content are left out. A task that is run again writes the same files again.
    """
    files, folder = located(path)
    files.create_dir(folder, recursive=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        disk, where = located(path)
        for frame in frames:
            for name, content in zip(frame[key], frame["content"]):
                with disk.open_output_stream(f"{where}/{name.replace('/', '%2F')}.{ending}", compression=None) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(frame)]})

    kept = rows.where(rows[key].isNotNull() & rows["content"].isNotNull()).select(key, "content")
    return kept.mapInPandas(run, "n long").groupBy().sum("n").first()[0] or 0
