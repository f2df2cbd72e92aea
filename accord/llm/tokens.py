"""Token counts of sections: documents are encoded once, and token spans are joined to section intervals."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from accord.llm.bpe import ROWS, tools
from accord.llm.common import documents

#: What a token that crosses section bounds counts for: the section of its first byte, of its last, or of most bytes (ties: the earlier).
RULES = ("first", "last", "largest")


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Each token's section, and whether it crosses a bound.

    ends: where each token ends; bounds: where each section begins, the first at 0. Tokens and
    sections both tile the text, so two searches join them.
    """
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    crosses = first != last
    if rule == "first":
        return first, crosses
    if rule == "last":
        return last, crosses
    section = first.copy()
    stops = np.append(bounds[1:], ends[-1] if len(ends) else 0)
    for t in np.flatnonzero(crosses):
        inside = range(first[t], last[t] + 1)
        section[t] = max(inside, key=lambda s: (min(stops[s], ends[t]) - max(bounds[s], starts[t]), -s))
    return section, crosses


def section_tokens(docs: DataFrame, vocabulary: str, pattern: str, rule: str = "largest") -> DataFrame:
    """doc_id, section (from 0), char_start, char_end, n_tokens, n_crossing: a row for each line of each input row.

    A line goes up to and with its line feed. n_crossing: tokens counted here that reach beyond the
    section. Every token counts once. Null and empty texts have no lines and no rows. Offsets are
    code points, ends exclusive; a character cut by tokens counts where its first byte is. No shuffle.
    """
    if rule not in RULES:
        raise ValueError(rule)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split, packed = tools(vocabulary, pattern)
        get = packed.__getitem__
        length = np.zeros(max(encoder.tokens, default=0) + 1, np.int64)
        for token, data in encoder.tokens.items():
            length[token] = len(data)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch, out = whole.slice(start, ROWS), [[] for _ in names]
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    data = np.frombuffer(text.encode(), np.uint8)
                    if not len(data):
                        continue
                    ends = np.cumsum(length[np.array(array("I", b"".join(map(get, split(text)))))])
                    bounds = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
                    bounds = bounds[bounds < len(data)]
                    section, crosses = allocate(ends, bounds, rule)
                    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    k = len(bounds)
                    for column, values in zip(out, ([doc] * k, range(k), chars[bounds], chars[np.append(bounds[1:], len(data))], np.bincount(section, minlength=k), np.bincount(section[crosses], minlength=k)), strict=True):
                        column += list(values)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    names = ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"]
    return documents(docs).mapInArrow(scan, ", ".join(f"{n} long" for n in names))
