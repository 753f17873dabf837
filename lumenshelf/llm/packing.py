"""Packing token sequences with a fixed number of open windows.

A partition keeps `open_windows` windows. A piece goes to the open window it
fits best; when none has room the fullest is emitted and a new one opened.
What stays open at the end of partitions is merged in a tree of groups: whole
windows are joined by best fit, and those that still have room are poured
together, pieces being cut where a window ends, so that a group passes on
one window.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

VOCABULARY = "byte_bpe_50k.json"
SEPARATOR = 0
LENGTH = 1024
OPEN_WINDOWS = 256
#: Partitions, or groups of them, whose open windows are merged in one task.
FAN_IN = 32
#: Merged windows with less room than this part of a window are left as they are.
SLACK = 128

_encoders: dict[str, object] = {}


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(vocabulary: str = VOCABULARY):
    """The byte-level BPE of a tokenizer file, as a function of texts to ids; a bare name is one of the installed public files.

    Vocabulary and added tokens are those of the JSON file, and the ids those
    that the `tokenizers` library gives for it, at a quarter of the CPU time.
    Where the faster library gives up, as it does on a million spaces, the
    text goes to `tokenizers` itself.
    """
    if vocabulary not in _encoders:
        import json

        import public_tokenizers
        import tiktoken

        path = str(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        byte, added = _bytes_of_symbols(), {t["content"]: t["id"] for t in parts["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in parts["model"]["vocab"].items() if token not in added}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        exact = []

        def ids(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:
                if not exact:
                    from tokenizers import Tokenizer

                    exact.append(Tokenizer.from_file(path))
                return exact[0].encode(text, add_special_tokens=False).ids

        _encoders[vocabulary] = ids
    return _encoders[vocabulary]


class Windows:
    """Best fit into at most `most` open windows."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.free: list[tuple[int, int]] = []  # (room, window), sorted
        self.made = 0

    def place(self, size: int) -> tuple[int, int, list[int]]:
        """Window and offset for a piece, and the windows that it closes."""
        shut = []
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, w = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                shut.append(self.free.pop(0)[1])
            room, w = self.length, self.made
            self.made += 1
        if room > size:
            insort(self.free, (room - size, w))
        else:
            shut.append(w)
        return w, self.length - room, shut


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, open boolean, ids binary"


def _pack(vocabulary: str, length: int, most: int):
    names = [c.split()[0] for c in _PIECES.split(", ")]
    types = {"open": pa.bool_(), "ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        part = TaskContext.get().partitionId()
        windows = Windows(length, most)
        held: list[list] = []
        waiting: dict[int, list[list]] = {}

        def table(rows: list[list]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, cols)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(np.asarray(encode(text or ""), "<u4"), np.uint32(SEPARATOR)).astype("<u4")
                n = len(ids)
                for start in range(0, n, length):
                    cut = ids[start : start + length]
                    window, offset, shut = windows.place(len(cut))
                    row = [doc, start, len(cut), zlib.crc32(cut.tobytes()), n, (part << 32) + window, offset, part, False, cut.tobytes()]
                    waiting.setdefault(window, []).append(row)
                    for w in shut:
                        held.extend([*r[:-1], None] for r in waiting.pop(w))
                if len(held) >= 4096:
                    yield table(held)
                    held = []
        for rows in waiting.values():
            for row in rows:
                row[-2] = True
                held.append(row)
        yield table(held)

    return run


def _merge(level: int, length: int, slack: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence_id", "offset"], kind="stable", ignore_index=True)
        fill = pdf.groupby("sequence_id")["length"].sum().sort_values(ascending=False, kind="stable")
        windows = Windows(length, len(fill) + 1)
        to = {seq: windows.place(int(n))[:2] for seq, n in fill.items()}
        base = (level << 56) + (int(pdf["part"].iloc[0]) << 32)
        window = pdf["sequence_id"].map(lambda s: to[s][0])
        pdf["offset"] += pdf["sequence_id"].map(lambda s: to[s][1])
        pdf["sequence_id"], pdf["open"] = base + window, False
        loose = window.isin({w for room, w in windows.free if room > slack})
        whole, rest = pdf[~loose].assign(ids=None), pdf[loose].sort_values(["sequence_id", "offset"], kind="stable")
        return pd.concat([whole, _poured(rest, base + windows.made, length)], ignore_index=True) if len(rest) else whole

    return run


def _poured(pdf: pd.DataFrame, base: int, length: int) -> pd.DataFrame:
    """The pieces one after another, cut where a window ends; the last window stays open unless full."""
    out, at, total = [], 0, int(pdf["length"].sum())
    for row in pdf.to_dict("records"):
        ids = np.frombuffer(row["ids"], "<u4")
        while len(ids):
            window, offset = divmod(at, length)
            cut, ids = ids[: length - offset], ids[length - offset :]
            still = (window + 1) * length > total
            out.append({**row, "length": len(cut), "ids_crc32": zlib.crc32(cut.tobytes()), "sequence_id": base + window, "offset": offset, "open": still, "ids": cut.tobytes() if still else None})
            row["start"] += len(cut)
            at += len(cut)
    return pd.DataFrame(out, columns=pdf.columns)


def pack_sequences(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces of documents and their places in sequences of at most `length` tokens.

    docs needs doc_id and text; other columns are ignored. A document is its
    token ids and a closing id 0; it is cut into pieces of `length`, the rest
    is packed by best fit, and what is left over is cut to fill windows. Returns doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset. A null or empty text is the closing id
    alone; null doc_ids and repeated rows are packed as documents of their
    own. No rows give no rows.

    A partition passes on at most `open_windows` windows and a group of
    `fan_in` partitions one; a merging task so reads at most fan_in *
    open_windows windows (8,192, about 8 million ids), whatever the input.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = staged(source.mapInArrow(_pack(vocabulary, length, open_windows), _PIECES), "pieces")
    done = [packed.where("not open")]
    rest, level = packed.where("open"), 0
    parts = (packed.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level += 1
        parts = -(-parts // fan_in)
        grouped = rest.withColumn("part", F.floor(F.col("part") / fan_in))
        merged = staged(grouped.groupBy("part").applyInPandas(_merge(level, length, length // SLACK), _PIECES), f"pieces{level}")
        if parts <= 1:
            done.append(merged)
            break
        done.append(merged.where("not open"))
        rest = merged.where("open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part", "open", "ids")
