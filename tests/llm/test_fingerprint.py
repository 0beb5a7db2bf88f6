import hashlib
import random
from collections import Counter

from strandloom.llm.fingerprint import Sampler, compare_with_following, edited, fingerprint_documents, likeness


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_likeness_is_weighted_jaccard():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    pairs = []
    for _ in range(120):
        a = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        b = a[: rng.randint(0, len(a))] + [rng.choice(words) for _ in range(rng.randint(1, 60))]
        pairs.append((" ".join(a), " ".join(b)))
    s = Sampler(256)
    got = likeness(s.signatures([a for a, _ in pairs]), s.signatures([b for _, b in pairs]))
    want = [jaccard(a, b) for a, b in pairs]
    errors = [g - w for g, w in zip(got, want, strict=True)]
    assert abs(sum(errors) / len(errors)) < 0.01 and max(map(abs, errors)) < 0.13
    again = s.signatures(["x y", "", "y x", " \n"])
    assert (again[0] == again[2]).all() and not again[1].any() and not again[3].any()


def test_following_documents(spark):
    rng = random.Random(4)
    rows = [(i * 7 % 101, " ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randint(0, 30)))) for i in range(101)]
    rows += [(5, "second of its id"), (5, "second of its id"), (None, "without"), (700, None), (701, ""), (702, "é" * 33)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        want[i, len(a), hashlib.sha256(edited(a, b).encode()).hexdigest()] += 1
    for n in (1, 3, 8):
        got = compare_with_following(df, n).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = compare_with_following(df.where("doc_id = 702"), 4).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert compare_with_following(df.limit(0), 4).collect() == []
    prints = {(r.doc_id, r.text): r.fingerprint for r in fingerprint_documents(df).collect()}
    assert len({prints[5, "second of its id"], prints[702, "é" * 33], prints[700, None]}) == 3 and prints[700, None] == prints[701, ""]
