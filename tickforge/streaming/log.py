"""A write-ahead log of checksummed frames, and what can be recovered of it.

A frame is the payload's length (4 bytes, big-endian), 8 bytes of its BLAKE2b
digest and the payload.  A log that breaks off within a frame, or whose last
frame has a wrong digest, ends before that frame; a wrong digest that other
frames follow is an error, as no crash leaves one behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = 12


def frames(payloads: Iterable[bytes]) -> bytes:
    """Payloads as frames in a row."""
    return b"".join(len(x).to_bytes(4, "big") + hashlib.blake2b(x, digest_size=8).digest() + x for x in payloads)


def recover(content: bytes) -> tuple[list[bytes], int]:
    """The payloads of all whole frames, and the bytes that have to be cut off."""
    out, at = [], 0
    while at < len(content):
        n = int.from_bytes(content[at : at + 4], "big")
        payload = content[at + HEAD : at + HEAD + n]
        if len(content) < at + HEAD + n:
            break
        if hashlib.blake2b(payload, digest_size=8).digest() != content[at + 4 : at + HEAD]:
            if at + HEAD + n < len(content):
                raise ValueError(f"bad checksum at {at}")
            break
        out.append(payload)
        at += HEAD + n
    return out, len(content) - at


def write(rows: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """``key, segment, content`` of ``key, n, payload`` in order of ``n`` (1, 2, ...): at most ``most`` frames a segment."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        content = frames(x.encode() for x in pdf.sort_values("n")["payload"])
        return pd.DataFrame({key: pdf[key].iloc[:1], "segment": pdf["segment"].iloc[:1], "content": [content]})

    kind = dict(rows.dtypes)[key]
    cut = rows.select(key, "n", "payload", F.expr(f"(n - 1) div {most}").cast("long").alias("segment"))
    return cut.groupBy(key, "segment").applyInPandas(run, f"{key} {kind}, segment long, content binary")


def read(segments: DataFrame, key: str) -> DataFrame:
    """``key, segment, nth, payload, lost`` of every whole frame; ``lost`` bytes were cut from the end of the segment."""
    kind = dict(segments.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, segment, content in zip(part[key], part["segment"], part["content"], strict=True):
                payloads, lost = recover(bytes(content))
                yield pd.DataFrame({key: k, "segment": segment, "nth": range(len(payloads)), "payload": [x.decode() for x in payloads], "lost": lost})

    return segments.select(key, "segment", "content").mapInPandas(run, f"{key} {kind}, segment long, nth long, payload string, lost long")


def torn(content: Column, cut: int) -> Column:
    """A segment as a crash leaves it: without its last bytes."""
    return F.substring(content, F.lit(1), F.octet_length(content) - cut)
