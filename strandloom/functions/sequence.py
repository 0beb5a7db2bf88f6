"""Column functions over DNA strings. Positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"


def clean(text: Column) -> Column:
    """Upper-case bases; whatever else a line holds becomes A, so coordinates stay."""
    return F.regexp_replace(F.translate(text, "acgt", BASES), "[^ACGT]", "A")


def reverse_complement(sequence: Column) -> Column:
    """Reversed, with A-T and C-G exchanged; other letters, N among them, stay themselves."""
    return F.translate(F.reverse(sequence), "ACGT", "TGCA")


def per_base(rows: DataFrame, strings: dict[str, tuple[str, int]]) -> DataFrame:
    """One row for each letter of the strings: the other columns, `pos`, and for each name the letter of a string column `shift` places on (null
    beyond the ends). Strings become arrays first: a substring at a position of a string walks there from its start, an array doesn't."""
    used = {c for c, _ in strings.values()}
    rest = [c for c in rows.columns if c not in used]
    first = next(iter(strings.values()))[0]

    def shifted(column: str, by: int) -> Column:
        letters = F.split(column, "")
        if by < 0:
            return F.concat(F.array_repeat(F.lit(None).cast("string"), -by), letters)
        return F.slice(letters, by + 1, F.length(column)) if by else letters

    zipped = rows.where(F.length(first) > 0).select(*rest, F.length(first).alias("n_"), *(shifted(c, by).alias(name) for name, (c, by) in strings.items()))
    return zipped.select(*rest, "n_", F.posexplode(F.arrays_zip(*strings)).alias("pos", "b_")).where("pos < n_").select(*rest, F.col("pos").cast("long").alias("pos"), *(F.col(f"b_.{n}").alias(n) for n in strings))


def around(rows: DataFrame, column: str = "sequence", before: int = 2, after: int = 2) -> DataFrame:
    """Letters of a sequence with their neighbours: base, p1, p2, ... before and n1, n2, ... after it."""
    return per_base(rows, {"base": (column, 0)} | {f"p{i}": (column, -i) for i in range(1, before + 1)} | {f"n{i}": (column, i) for i in range(1, after + 1)})


# motifs at a letter, as conditions on the columns of around()
IS_DONOR = "base = 'G' and n1 = 'T'"
IS_ACCEPTOR = "p1 = 'A' and base = 'G'"
IS_START = "base = 'A' and n1 = 'T' and n2 = 'G'"
IS_STOP = "p2 = 'T' and ((p1 = 'A' and base in ('A', 'G')) or (p1 = 'G' and base = 'A'))"


def base_code(base: Column) -> Column:
    return F.instr(F.lit(BASES), base) - 1


def context_code(size: int) -> Column:
    """Base-4 code of the letters p<size> .. p1; null where one is missing."""
    return sum((base_code(F.col(f"p{i}")) * 4 ** (i - 1) for i in range(1, size + 1)), F.lit(0))


def window_at(sequence: Column, position: Column, radius: int = 60) -> Column:
    """2 * radius + 1 letters around a position, N beyond the ends."""
    pad = F.lit("N" * radius)
    return F.substr(F.concat(pad, sequence, pad), (position + 1).cast("int"), F.lit(2 * radius + 1))


def revcomp_interval(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """1-based closed interval of the other strand in forward coordinates."""
    return length - end + 1, length - start + 1


def percentile_floor(values: Column, p: float) -> Column:
    """sorted[floor(p * (n - 1))] of an array; null if it is empty."""
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), (F.floor(F.lit(p) * (F.size(values) - 1)) + 1).cast("int")))
