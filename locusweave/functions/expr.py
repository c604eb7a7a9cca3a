"""Column expressions: rounding, intervals, identifiers, sequences, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(x: Column | str, digits: int = 4) -> Column:
    """Half-up rounding that any SQL engine repeats: floor(x * 10**d + 0.5) / 10**d."""
    scale = float(10**digits)
    return F.floor(col(x) * scale + 0.5) / scale


def overlap(a0, a1, b0, b1) -> Column:
    """Length of the common part of two closed integer intervals (0 if none)."""
    return F.greatest(F.lit(0), F.least(col(a1), col(b1)) - F.greatest(col(a0), col(b0)) + 1)


def overlap_fraction(a0, a1, b0, b1) -> Column:
    """Common part as a share of the first interval."""
    return overlap(a0, a1, b0, b1) / (col(a1) - col(a0) + 1)


def size_bucket(n: Column | str) -> Column:
    return F.when(col(n) <= 3, "small").when(col(n) <= 10, "medium").otherwise("large")


def identity(score, n) -> Column:
    return F.when(col(n) > 0, fixed(col(score) / col(n))).otherwise(0.0)


def histogram_label(x: Column | str, edges: list[float]) -> Column:
    """Right-closed bins over sorted edges, the lowest edge included."""
    x = col(x)
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when((x > low) & (x <= high), F.lit(f"({low:g}, {high:g}]")).otherwise(out)
    return F.when(x == edges[0], F.lit(f"({edges[0]:g}, {edges[1]:g}]")).otherwise(out)


def unordered_pair(a, b, sep: str = "-") -> Column:
    return F.concat_ws(sep, F.array_sort(F.array(col(a), col(b))))


def contig_of_gene(gene_id) -> Column:
    """Id without its trailing _number."""
    return F.regexp_replace(col(gene_id), r"_\d+$", "")


def gene_number(gene_id) -> Column:
    return F.regexp_extract(col(gene_id), r"_(\d+)$", 1).try_cast("bigint")


def parse_locus(locus: str) -> tuple[str, str, int, int]:
    """genome:contig:first-last, positions inclusive."""
    genome, contig, span = locus.rsplit(":", 2)
    first, last = span.split("-")
    return genome, contig, int(first), int(last)


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(col(seq), "ACGTacgtNn", "TGCAtgcaNn"))


def gc_fraction(seq) -> Column:
    s = F.upper(col(seq))
    n = F.length(s)
    return F.when(n > 0, F.length(F.regexp_replace(s, "[^GC]", "")) / n).otherwise(0.0)


_BASES = "TCAG"
# Fixed value: amino acids of the bacterial code (table 11) in TCAG order of the codon.
_TABLE_11 = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate_to_stop(seq) -> Column:
    """Protein of a coding sequence, up to the first stop; unknown codons give X."""
    codons = [a + b + c for a in _BASES for b in _BASES for c in _BASES]
    table = F.create_map(*[x for pair in zip(codons, _TABLE_11) for x in map(F.lit, pair)])
    s = F.upper(col(seq))
    n = F.floor(F.length(s) / 3).cast("int")
    aa = F.when(
        n > 0,
        F.array_join(
            F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.element_at(table, F.substring(s, (i - 1) * 3 + 1, F.lit(3))), F.lit("X"))), ""
        ),
    ).otherwise("")
    return F.substring_index(aa, "*", 1)


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalise(v, variant: str = "seed") -> Column:
    """Unit vectors; variants differ in how a zero norm is treated."""
    n = norm(v)
    by = {
        "seed": F.greatest(n, F.lit(1e-9)),
        "index": n + 1e-9,
        "projection": n + 1e-8,
        "adapter": F.when(n == 0, 1.0).otherwise(n),
    }[variant]
    return F.transform(col(v), lambda x: x / by)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
