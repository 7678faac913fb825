import numpy as np

from symloom.llm import pii
from symloom.llm import train_tagger as T
from symloom.llm.tagger import LABELS, Tagger, _reconcile


def kinds(text):
    return [(k, text[a:b]) for a, b, k in pii._found([text])[0]]


def test_kinds_and_places():
    text = "Reported-by: Bodil Dostrova <bodil.dostrova@mail.example.com>\nYou can call me on +1 217 555 0131 until six.\n"
    assert kinds(text) == [("name", "Bodil Dostrova"), ("email", "bodil.dostrova@mail.example.com"), ("phone", "+1 217 555 0131")]
    text = "The parcel for Marek Lindqvast still shows 235 Bramble St., Farlingham as the target."
    assert [k for k, _ in kinds(text)] == ["name", "address"] and kinds(text)[1][1].startswith("235 Bramble")
    assert kinds("Please mask SSN 966-36-3903 before the trace is shared.") == [("id_number", "966-36-3903")]
    for clean in ("Install @scope/skill-kit@5.32.4 and restart the manifest worker.", "Clone with git@git.example.net:tools/node.git and check out the late branch.", "Row 24-14-1053 of the report export has no level.", "At most 14 Worker Lanes are open while it drains."):
        assert kinds(clean) == []


def test_long_texts_are_reconciled_over_windows():
    unit = "Nothing to see in this line of the log, it only fills the space. "
    text = unit * 40 + "Signed-off-by: Runa Lorvig <runa.lorvig@example.org>\n" + unit * 40
    found = kinds(text)
    assert ("email", "runa.lorvig@example.org") in found and ("name", "Runa Lorvig") in found and len(found) == 2
    assert _reconcile([(5, 10, 20, "name"), (9, 12, 22, "name"), (1, 30, 31, "phone")]) == [(12, 22, "name"), (30, 31, "phone")]


def test_viterbi_and_gradients():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(5, 2, LABELS)).astype(np.float64)
    trans, start = rng.normal(size=(LABELS, LABELS)), rng.normal(size=LABELS)
    tags = rng.integers(0, LABELS, (5, 2))
    loss, ds, dt, dstart = T.crf(scores, tags, None, trans, start)
    for t, b, k in ((0, 0, 1), (3, 1, 4)):
        moved = scores.copy()
        moved[t, b, k] += 1e-5
        assert abs((T.crf(moved, tags, None, trans, start)[0] - loss) / 1e-5 - ds[t, b, k]) < 1e-4
    moved = trans.copy()
    moved[2, 3] += 1e-5
    assert abs((T.crf(scores, tags, None, moved, start)[0] - loss) / 1e-5 - dt[2, 3]) < 1e-4
    ids = rng.integers(1, 90, (6, 3)).astype(np.uint8)
    tagger = Tagger.load()
    s = tagger.emissions(ids).astype(np.float64)
    from symloom.llm.tagger import legal

    moves = tagger.w["transitions"] + legal()
    best = tagger.decode(ids)
    total = lambda y, b: tagger.w["start"][y[0]] + sum(s[t, b, y[t]] for t in range(6)) + sum(moves[y[t - 1], y[t]] for t in range(1, 6))
    for b in range(3):
        mine = total(best[:, b], b)
        assert all(total(rng.integers(0, LABELS, 6), b) <= mine + 1e-4 for _ in range(300))


def test_held_out_accuracy():
    rng = T.random.Random(9)
    texts = [f"Assigned to {T._pseudonym(rng)} {T._pseudonym(rng)} until Friday. Ping {T._pseudonym(rng).lower()}.{T._pseudonym(rng).lower()}@corp.example.net once the pipeline is green." for _ in range(100)]
    texts = [t.encode("ascii", "ignore").decode() for t in texts]
    hits = sum({k for k, _ in kinds(t)} == {"name", "email"} for t in texts)
    assert hits >= 85


def test_wordings_and_names_of_no_training_text():
    """Bounds below what the stored weights reach; README.md has the figures."""
    from collections import Counter

    from tests.llm.pii_cases import cases

    hit, all_, false = Counter(), Counter(), 0
    labelled = cases()
    for (text, gold), mine in zip(labelled, pii._found([t for t, _ in labelled]), strict=True):
        want, got = {(a, k) for a, _, k in gold}, {(a, k) for a, _, k in mine}
        all_.update(k for _, k in want)
        hit.update(k for _, k in want & got)
        false += len(got - want)
    assert hit["name"] >= 0.6 * all_["name"] and sum(hit.values()) >= 0.65 * sum(all_.values()) and false <= 10


def test_checks_use_no_word_list():
    text = "Meet at 4 Fern Crescent, Oslo or write to a.b at c dot d"
    spans = [(8, 29, "address"), (42, 56, "email")]
    assert pii.checked(text, spans) == spans


def test_redaction(spark):
    rows = [(1, "Ping runa.lorvig@example.org once the pipeline is green.", "k"), (2, None, "k"), (3, "", "k"), (None, "plain", "k"), (4, "x" * 3000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "Ping [EMAIL] once the pipeline is green.", 2: None, 3: "", None: "plain", 4: "x" * 3000}
    assert [tuple(r)[:3] for r in pii.mentions(df).collect()] == [(1, "email", 5)]
    assert pii.mentions(df.where("false")).collect() == []
