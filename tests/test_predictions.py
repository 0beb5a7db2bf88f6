import json

from strandloom import topology as t
from strandloom.operators import genes
from strandloom.sinks import files


def test_lines_hold_the_whole_document(spark):
    """Only genes were written before, and only their ids and starts read back."""
    path = "BB" + "".join(map(t.letter, (*t.START_CODON, t.EXON[0], t.DONOR[1], t.INTRON[1], t.ACCEPTOR[1], t.EXON[1], t.EXON[2], *t.STOP_CODON))) + "B"
    sure = [i / 16 for i in range(len(path))]
    paths = spark.createDataFrame([("s", 7, "ACGT" * 3 + "ACG", path, sure), ("s", 8, "AC", "BB", [0.25, 1.0])], "species string, scaffold long, seq string, path string, confidence array<double>")
    rows = files.prediction_json(genes.gene_records(paths, "+").selectExpr("'g' as id", "*"), paths, "x.fna").collect()
    found = {(r.section, r["name"]): json.loads(r.value) for r in rows}
    base = lambda i: {"position": i + 1, "state": t.label(ord(path[i]) - 65), "confidence": sure[i]}
    assert found == {
        ("summary", "x.fna"): {"inputFile": "x.fna", "totalBases": 17, "scaffolds": 2, "genes": 1, "exons": 2, "introns": 1},
        ("scaffolds", "7"): {"name": "7", "length": 15},
        ("scaffolds", "8"): {"name": "8", "length": 2},
        ("predictions", "g"): {"id": "g", "scaffold": 7, "strand": "+", "start": 3, "end": 14, "exons": [{"start": 3, "end": 6}, {"start": 10, "end": 14}], "introns": [{"start": 7, "end": 9}], "intron_count": 1, "sequence": "GTACGTACGTAC", "confidence": [base(i) for i in range(2, 14)]},
        ("confidenceByScaffold", "7"): {"name": "7", "confidence": [base(i) for i in range(15)]},
        ("confidenceByScaffold", "8"): {"name": "8", "confidence": [{"position": 1, "state": "Intergenic", "confidence": 0.25}, {"position": 2, "state": "Intergenic", "confidence": 1.0}]},
    } and len(rows) == 6
