"""The 21-state gene model: states, their families, legal edges, and the one-letter form in which paths travel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the states in the order of their codes
STATES = (
    "START", "INTERGENIC",
    "START_CODON_1", "START_CODON_2", "START_CODON_3",
    "EXON_FRAME_1", "EXON_FRAME_2", "EXON_FRAME_3",
    "DONOR_1", "DONOR_2", "DONOR_3",
    "INTRON_1", "INTRON_2", "INTRON_3",
    "ACCEPTOR_1", "ACCEPTOR_2", "ACCEPTOR_3",
    "STOP_CODON_1", "STOP_CODON_2", "STOP_CODON_3",
    "END",
)
CODE = {name: code for code, name in enumerate(STATES)}
START, INTERGENIC, END = CODE["START"], CODE["INTERGENIC"], CODE["END"]
START_CODON, EXON, DONOR, INTRON, ACCEPTOR, STOP_CODON = (range(CODE[f"{n}_1"], CODE[f"{n}_1"] + 3) for n in ("START_CODON", "EXON_FRAME", "DONOR", "INTRON", "ACCEPTOR", "STOP_CODON"))
CODING = (*START_CODON, *EXON, *STOP_CODON)
INTRONIC = (*DONOR, *INTRON, *ACCEPTOR)
NEG_INF = float("-inf")


def _edges() -> list[tuple[int, int]]:
    chains = [(a[i], a[i + 1]) for a in (START_CODON, STOP_CODON) for i in (0, 1)]
    phases = [e for i in range(3) for e in ((EXON[i], EXON[(i + 1) % 3]), (EXON[i], DONOR[(i + 1) % 3]), (DONOR[i], INTRON[i]), (INTRON[i], INTRON[i]), (INTRON[i], ACCEPTOR[i]), (ACCEPTOR[i], EXON[i]))]
    outside = [(START, INTERGENIC), (START, START_CODON[0]), (INTERGENIC, INTERGENIC), (INTERGENIC, START_CODON[0]), (INTERGENIC, END)]
    joints = [(START_CODON[2], EXON[0]), (START_CODON[2], DONOR[0]), (EXON[2], STOP_CODON[0]), (STOP_CODON[2], INTERGENIC), (STOP_CODON[2], END)]
    return sorted(chains + phases + outside + joints)


EDGES = tuple(_edges())
LEGAL = frozenset(EDGES)


def letter(code: int) -> str:
    """A path is a string with one letter for each base: A is state 0."""
    return chr(65 + code)


def letters(codes) -> str:
    return "".join(letter(c) for c in codes)


def family(code: int) -> str:
    """What the state emits from."""
    if code in (START, END):
        return "silent"
    if code == INTERGENIC:
        return "intergenic"
    if code in INTRON:
        return "intron"
    if code in EXON:
        return f"exon_{code - EXON[0] + 1}"
    return "donor" if code in DONOR else "acceptor" if code in ACCEPTOR else "deterministic"


def label(code: int) -> str:
    """The family name shown to users; bases of coding frames are called UTR there."""
    if code in START_CODON:
        return "Start"
    if code in STOP_CODON:
        return "Stop"
    if code in EXON:
        return "UTR"
    return "Intron" if code in INTRONIC else "Intergenic"


def state_dimension(spark: SparkSession) -> DataFrame:
    """21 rows: code, name, letter, family, label and the predicates."""
    rows = [(c, n, letter(c), family(c), label(c), c in CODING, c in INTRONIC, c in INTRON, c in CODING or c in INTRONIC) for c, n in enumerate(STATES)]
    return spark.createDataFrame(rows, "state int, name string, letter string, family string, label string, is_coding boolean, is_intron boolean, is_intron_body boolean, is_gene boolean")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGES), "from_state int, to_state int")


def code_of(column: Column) -> Column:
    """The state of a letter."""
    return F.ascii(column) - 65


def one_of(column: Column, codes) -> Column:
    return column.isin([letter(c) for c in codes])
