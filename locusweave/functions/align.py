"""Global alignment of two sequences with affine gaps, and the share of identical places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def global_identity(a: str, b: str, match: float = 1.0, mismatch: float = 0.0, open_: float = -1.0, extend: float = -0.5) -> float:
    """Identical places over columns of a best global alignment (a gap's first place scores open_, each further one extend).  Of
    equal alignments the one is read off that pairs places as late as it can.  0 if a sequence is empty."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    # best score that ends in a pair, in a place of a alone, in a place of b alone
    pair, down, right = (np.full((n + 1, m + 1), -np.inf) for _ in range(3))
    pair[0, 0] = 0.0
    down[1:, 0] = open_ + extend * np.arange(n)
    right[0, 1:] = open_ + extend * np.arange(m)
    for k in range(2, n + m + 1):  # an anti-diagonal at a time
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        j = k - i
        gain = np.where(x[i - 1] == y[j - 1], match, mismatch)
        pair[i, j] = gain + np.maximum(np.maximum(pair[i - 1, j - 1], down[i - 1, j - 1]), right[i - 1, j - 1])
        down[i, j] = np.maximum(np.maximum(pair[i - 1, j], right[i - 1, j]) + open_, down[i - 1, j] + extend)
        right[i, j] = np.maximum(np.maximum(pair[i, j - 1], down[i, j - 1]) + open_, right[i, j - 1] + extend)
    tables = (pair, down, right)
    i, j, same, columns = n, m, 0, 0
    at = int(np.argmax([t[n, m] for t in tables]))
    while i or j:
        columns += 1
        if at == 0:
            same += int(x[i - 1] == y[j - 1])
            i, j = i - 1, j - 1
            at = int(np.argmax([t[i, j] for t in tables]))
        else:
            i, j = (i - 1, j) if at == 1 else (i, j - 1)
            cost = [open_ + (extend - open_) * (at == other) for other in range(3)]
            at = int(np.argmax([t[i, j] + c for t, c in zip(tables, cost)]))
    return same / columns


def with_identity(pairs: DataFrame, a: str, b: str, to: str = "identity") -> DataFrame:
    """pairs with the identity of the sequences in two columns, batch by batch."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields), f"`{to}` double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{to: [global_identity(x or "", y or "") for x, y in zip(pdf[a], pdf[b])]})

    return pairs.mapInPandas(run, schema)
