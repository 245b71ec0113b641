import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from casegrain.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    own = words(text)
    hit, ids = set(), set()
    for i, item in items:
        w = words(item)
        m = min(window, len(w))
        for k in range(len(w) - m + 1) if w else ():
            for j in range(len(own) - m + 1):
                if own[j : j + m] == w[k : k + m]:
                    hit |= set(range(j, j + m))
                    ids.add(i)
    return len(own), len(hit), sorted(map(str, ids))


def test_query_equals_brute_force(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # Brute force by a dictionary of windows, for speed.
    index, size = {}, {}
    for i, text in items:
        w = words(text)
        m = min(10, len(w))
        for k in range(len(w) - m + 1) if w else ():
            index.setdefault(tuple(w[k : k + m]), set()).add(str(i))
            size[m] = 1
    want = {}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own, hit, ids = words(d["text"]), set(), set()
        for m in size:
            for j in range(len(own) - m + 1):
                if found := index.get(tuple(own[j : j + m])):
                    hit |= set(range(j, j + m))
                    ids |= found
        want[d["doc_id"]] = (len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    rows = dec.op2_decontaminate(spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want and any(v[4] for v in want.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=12), min_size=1, max_size=5), st.text("abc", max_size=40), st.integers(1, 5))
def test_automaton_equals_brute_force(items, text, window):
    split = lambda t: [c.encode() for c in t]
    spaced = [(str(k), " ".join(t)) for k, t in enumerate(items)]
    machine = dec.Automaton([(i, split(t)) for (i, _), t in zip(spaced, items, strict=True)], window)
    found, ids = machine.scan(split(text))
    n, hit, want = brute(" ".join(text), spaced, window)
    assert len({x for a, b in found for x in range(a, b)}) == hit and sorted(ids) == want


def test_blocks_give_what_one_block_gives(spark, docs_of, monkeypatch):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 25)))) for k in range(1, 30)]
    docs = docs_of([(k, " ".join(rng.choice("ABcde,") for _ in range(80))) for k in range(40)] + [(98, None), (99, "")])
    table = spark.createDataFrame([*items, (1, items[0][1]), (None, "q r s"), (77, None), (78, " !")], "item_id long, text string")
    whole = {r["doc_id"]: r for r in dec.matched(docs, table).collect()}
    monkeypatch.setattr(dec, "BLOCK_WORDS", 60)
    assert len(dec._blocks(table)) > 3
    parts = {r["doc_id"]: r for r in dec.matched(docs, table).collect()}
    for k, r in whole.items():
        assert (r["item_ids"], r["n_words"]) == (parts[k]["item_ids"], parts[k]["n_words"])
        n, hit, ids = brute(r["text"], items)
        assert (n, ids) == (r["n_words"], r["item_ids"])
        assert hit == sum(s["last"] - s["first"] for s in r["spans"]) == sum(s["last"] - s["first"] for s in dec_merge(parts[k]["spans"]))


def dec_merge(spans):
    return [{"first": a, "last": b} for a, b in dec.merged([(s["first"], s["last"]) for s in spans])]


def test_removal_keeps_the_rest(spark, docs_of, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of([(1, f"Before é, {item.upper()}! after " + "x " * 9), (2, item), (3, "clean"), (4, None)])
    out = {r["doc_id"]: r for r in dec.decontaminated(docs, table).collect()}
    assert set(out) == {1, 3, 4}
    assert out[1]["text"] == "Before é, ! after " + "x " * 9 and out[1]["n_chars"] == len(out[1]["text"])
    clash = odd.selectExpr("*", "7 as spans", "8 as n_words")
    kept = dec.decontaminated(clash, table)
    assert kept.columns == clash.columns and kept.count() == odd.count()
    assert dec.decontaminated(docs.limit(0), table).count() == 0
    assert dec.decontaminated(docs, table.limit(0)).count() == 4
