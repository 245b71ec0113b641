import random

import numpy as np
import pytest

from casegrain.llm import minhash, simhash


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((a or "").lower().split(), (b or "").lower().split()))
    return len(x & y) / len(x | y)


def kept(rows):
    """Least id of each class of J >= 0.8, by comparing everything with everything."""
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and jaccard(rows[a][1], rows[b][1]) >= 0.8:
                label = [label[b] if c == label[a] else c for c in label]
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(least.get(c, i), i)
    return sorted(least.values())


def planted():
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(9999)}" for _ in range(rng.randrange(60, 200))]
        for edits in (0, 1, 2, 3, 4):
            own = list(words)
            for k in rng.sample(range(len(own)), edits):
                own[k] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_planted_near_copies(docs_of):
    rows = planted() + [(900, "one two"), (901, "One  two"), (902, "one three"), (903, ""), (904, " ")]
    want = kept(rows)
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs_of(rows), 5, similarity=0.8).collect()) == want
    assert len(want) < len(rows) - 80


def classes(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        label = [label[b] if c == label[a] else c for c in label]
    return [label.index(c) for c in label]


@pytest.mark.parametrize("dense", [minhash.DENSE, 8])
def test_candidates_of_a_bucket_connect_what_links_connect(monkeypatch, dense):
    rows = planted()[:100]
    sigs = minhash._bytes(minhash.pa.array([minhash.signature(minhash.shingles(t.encode().split())) for _, t in rows]))
    monkeypatch.setattr(minhash, "DENSE", dense)
    found = minhash.near(sigs)
    links = [(a, b) for a in range(100) for b in range(a) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    got, want = classes(100, [p for p in found if jaccard(rows[p[0]][1], rows[p[1]][1]) >= 0.8]), classes(100, links)
    assert links and np.mean([x == y for x, y in zip(got, want, strict=True)]) > 0.95


def test_candidates_do_not_grow_with_the_square():
    """A group of near copies of one text gives a few candidates a member."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(9999)}" for _ in range(400)]
    sigs = []
    for _ in range(600):
        own = list(words)
        for k in rng.sample(range(len(own)), rng.randint(0, 8)):
            own[k] = f"x{rng.randrange(9999)}"
        sigs.append(minhash.signature(minhash.shingles([w.encode() for w in own])))
    assert len(minhash.near(minhash._bytes(minhash.pa.array(sigs)))) < 4 * len(sigs)


def test_odd_rows(odd, docs_of):
    out = simhash.deduplicated(odd.selectExpr("*", "1 as fp", "2 as sig"), 5, similarity=0.8)
    assert {"fp", "sig"} <= set(out.columns) and 0 < out.count() <= odd.count()
    assert simhash.deduplicated(docs_of([]), 5, similarity=0.8).count() == 0
