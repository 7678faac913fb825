import random

from symloom.llm import leaks

VOCAB = [f"{a}{b}" for a in ("stone", "river", "cloud", "lamp", "fern") for b in ("er", "ing", "ed", "al", "ous", "ic")]


def text(rng, n):
    return [rng.choice(VOCAB) + str(rng.randrange(40)) for _ in range(n)]


def test_search_equals_naive():
    rng = random.Random(2)
    items = [(i, " ".join(text(rng, 40))) for i in range(30)]
    m = leaks.build(items)
    for _ in range(40):
        w = text(rng, 60)
        k = rng.randrange(30)
        w[10:10] = items[k][1].split()[5:25]
        joined = f" {' '.join(w)} "
        naive = sorted((i, p) for p in m.places for i in range(len(joined)) if joined.startswith(p, i))
        assert sorted(leaks.search(m, joined)) == naive


def found(m, doc):
    return {m.items[p[0]] for p in leaks.passages(m, doc)}


def test_passages():
    rng = random.Random(3)
    items = [(i, " ".join(text(rng, 50))) for i in range(20)]
    m = leaks.build(items)
    w = items[4][1].split()
    noise = lambda n=30: " ".join(text(rng, n))
    assert found(m, f"{noise()} {' '.join(w[10:30])} {noise()}") == {4}
    assert found(m, f"{noise()} {' '.join(w[10:18])} {noise()}") == set()
    upper = " ".join(w[10:30]).upper().replace(" ", ",\n> ")
    assert found(m, f"{noise()}\n> {upper}\n{noise()}") == {4}
    changed = w[5:35]
    changed[6] = "other"
    changed.insert(15, "added")
    del changed[22]
    assert found(m, f"{noise()} {' '.join(changed)}") == {4}
    swapped = w[25:37] + w[5:17]
    assert found(m, f"{noise()} {' '.join(swapped)}") == {4}
    chat = "\n".join(f"[10:0{i}] <x{i}> {' '.join(w[8 + 5 * i : 13 + 5 * i])}" for i in range(4))
    assert found(m, chat) == {4}
    assert found(m, "") == set() and leaks.build([]) is None and leaks.build([(1, None)]) is None


def test_operator(spark, monkeypatch):
    rng = random.Random(4)
    a, b = " ".join(text(rng, 40)), " ".join(text(rng, 40))
    items = spark.createDataFrame([(1, a), (2, b), (3, a), (4, None), (None, b)], "item_id long, item_text string")
    docs = spark.createDataFrame([(10, f"x {a} y", "n"), (11, None, "n"), (12, "", "n"), (13, b * 1, "n"), (10, f"x {a} y", "n")], "doc_id long, text string, item_id string")
    want = {(10, 1), (10, 3), (13, 2)}
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(docs, items).collect()} == want
    monkeypatch.setattr(leaks, "ITEMS", 1)
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(docs, items).collect()} == want
    assert leaks.leaked(docs, items.where("false")).collect() == []
    assert leaks.leaked(docs.where("false"), items).collect() == []


def test_unbroken_passage_that_two_items_share():
    shared = "one two three four five six seven eight nine ten eleven twelve thirteen"
    matcher = leaks.build([(1, f"{shared} alpha beta"), (2, f"gamma delta {shared}")])
    found = leaks.passages(matcher, f"before it {shared} after it")
    assert sorted((matcher.items[k], n, a, b) for k, n, a, b in found) == [(1, 13, 2, 14), (2, 13, 2, 14)]
    # one word added undoes nothing, two of thirteen replaced are no longer few
    assert {p[0] for p in leaks.passages(matcher, "one two three four five six seven and eight nine ten eleven twelve thirteen")} == {0, 1}
    assert leaks.passages(matcher, "one two three four x six seven eight nine y eleven twelve thirteen") == []


def test_shared_passages_do_not_depend_on_the_turn(spark, monkeypatch):
    rng = random.Random(5)
    shared = text(rng, 25)
    items = spark.createDataFrame([(i, " ".join(text(rng, 20) + shared + text(rng, 20))) for i in (1, 2)], "item_id long, item_text string")
    changed = shared[:9] + ["other"] + shared[10:]
    docs = spark.createDataFrame([(7, f"before {' '.join(shared)} after"), (8, f"before {' '.join(changed)} after")], "doc_id long, text string")
    want = {(7, 1), (7, 2), (8, 1), (8, 2)}
    for turn in (1, 20_000):
        monkeypatch.setattr(leaks, "ITEMS", turn)
        assert {(r.doc_id, r.item_id) for r in leaks.leaked(docs, items).collect()} == want
