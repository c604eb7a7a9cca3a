"""Injectable protein embedders: batching, sliding windows and pooling around any callable."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[list[str]], list[np.ndarray]]  # sequences -> one (residues, dim) matrix each


def hash_model(dim: int = 32) -> Model:
    """Deterministic stand-in for a language model: a residue's vector depends on its 3-mer."""

    def residue(kmer: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.blake2b(kmer.encode(), digest_size=8).digest(), "little")
        return np.random.default_rng(seed).standard_normal(dim)

    def run(seqs: list[str]) -> list[np.ndarray]:
        known: dict[str, np.ndarray] = {}
        out = []
        for s in seqs:
            kmers = [s[max(0, i - 1) : i + 2] for i in range(len(s))]
            out.append(np.vstack([known.setdefault(k, residue(k)) if k not in known else known[k] for k in kmers]) if s else np.zeros((0, dim)))
        return out

    return run


def pool(x: np.ndarray, how: str = "mean") -> np.ndarray:
    return x.max(axis=0) if how == "max" else x.mean(axis=0)


def windows(seq: str, size: int = 1024, overlap: int = 256) -> list[str]:
    if len(seq) <= size - 10:
        return [seq]
    step = size - overlap
    return [seq[i : i + size] for i in range(0, max(1, len(seq) - overlap), step)]


def embed_one(seq: str, model: Model, dim: int, how: str = "mean", size: int = 1024, overlap: int = 256) -> np.ndarray:
    """Pooled vector; long sequences are embedded in windows (weighted: by window length). Zero on failure and
    for an empty sequence."""
    if not seq:
        return np.zeros(dim)
    try:
        parts = windows(seq, size, overlap)
        pooled = np.vstack([pool(x, "max" if how == "max" else "mean") for x in model(parts)])
        if how == "max":
            return pooled.max(axis=0)
        weights = np.array([len(p) for p in parts], float) if how == "weighted" else np.ones(len(parts))
        return (pooled * weights[:, None]).sum(axis=0) / weights.sum()
    except Exception:
        return np.zeros(dim)


def batches_by_residues(seqs: list[str], budget: int) -> Iterator[list[int]]:
    """Indices in batches of at most `budget` residues (one sequence at least), longest first."""
    held, size = [], 0
    for i in sorted(range(len(seqs)), key=lambda i: -len(seqs[i])):
        if held and size + len(seqs[i]) > budget:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(seqs[i])
    if held:
        yield held


def embed(proteins: DataFrame, make_model: Callable[[], Model], dim: int, how: str = "mean", budget: int = 16_000) -> DataFrame:
    """proteins(gene_id, seq, ...) with emb; the model is made once per task."""
    kept = [f for f in proteins.schema.fields if f.name != "emb"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in frames:
            seqs = pdf["seq"].fillna("").tolist()
            out: list = [None] * len(seqs)
            for batch in batches_by_residues(seqs, budget):
                for i in batch:
                    out[i] = embed_one(seqs[i], model, dim, how).astype(np.float32)
            yield pdf[[f.name for f in kept]].assign(emb=out)

    return proteins.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "emb array<float>"]))
