import random

from skytally.llm import decontaminate
from skytally.llm.decontaminate import RATE, best_match, normal

ITEMS = "item_id long, text string"


def distance(item, text):
    """Least edits between the item and any stretch of the text."""
    last = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            now[j] = min(last[j - 1] + (a != b), last[j] + 1, now[j - 1] + 1)
        last = now
    return min(last)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(300):
        item, text = "".join(rng.choices("abc", k=rng.randint(1, 80))), "".join(rng.choices("abc", k=rng.randint(0, 90)))
        got = best_match(item, text, 0, len(text), len(item) - 1)
        want = distance(item, text)
        assert got[0] == want if got else want >= len(item)


def test_brute_force(spark):
    """Texts with items edited up to, at and over the budget."""
    rng = random.Random(3)
    items = {k: "".join(rng.choices("abcdefgh ", k=n)) for k, n in enumerate((45, 60, 101, 150))} | {8: "short", 9: ""}
    items = {k: normal(t) for k, t in items.items()}
    docs = {}
    for n in range(120):
        item = list(items[rng.randrange(4)])
        for _ in range(rng.randint(0, int(RATE * len(item)) + 3)):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice([[], ["x"], [item[at], "y"]])
        docs[n] = "".join(rng.choices("abcdefgh ", k=rng.randint(0, 60))) + "".join(item).upper() + " " + "".join(rng.choices("abcdefgh ", k=20))
    rows = [*docs.items(), (500, None), (501, ""), (None, items[0])]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items.items(), (None, "x" * 50), (7, None)], ITEMS)).collect()
    want = {(i, k, e) for i, t in docs.items() for k, x in items.items() if len(x) >= decontaminate.LEAST_CHARS and (e := distance(x, normal(t))) <= int(RATE * len(x))}
    assert {(r.doc_id, r.item_id, r.edits) for r in got if r.doc_id is not None} == want and want
    assert [(r.item_id, r.edits) for r in got if r.doc_id is None] == [(0, 0)]
    for r in got:
        if r.edits == 0 and r.doc_id is not None:
            assert normal(docs[r.doc_id])[r.start : r.end] == items[r.item_id]


def test_blocks_and_documents(spark, documents, tables):
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    one = sorted(map(tuple, decontaminate.contaminated(documents, bench).collect()))
    many = sorted(map(tuple, decontaminate.contaminated(documents, bench, block_bytes=4000).collect()))
    cleaned = decontaminate.clean(documents, bench, block_bytes=15_000)
    assert sorted(r.doc_id for r in cleaned.collect()) == sorted({r.doc_id for r in documents.collect()} - {x[0] for x in one})
    texts = {r.doc_id: normal(r.text) for r in documents.collect()}
    exact = {(i, r.item_id) for r in bench.collect() for i, t in texts.items() if normal(r.text) in t}
    assert one == many and {x[:2] for x in one} >= exact and exact


def test_clean(docs_of, spark):
    item = "the quick brown fox jumps over the lazy dog and then it sleeps"
    docs = docs_of([f"start {item} end", "nothing of the kind", None, "", item.upper().replace("QUICK", "QUICKLY")])
    bench = spark.createDataFrame([(1, item), (1, item)], ITEMS)
    assert [r.doc_id for r in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == [1, 2, 3]
    assert decontaminate.clean(docs, bench.limit(0)).count() == 5 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs.limit(0), bench).columns == docs.columns


def test_short_items_match_exactly_as_words(spark, docs_of):
    docs = docs_of(["say Yes, Please!", "eyes, please", "no", None, "yes,  please and yes, pleasex", "x1"])
    bench = spark.createDataFrame([(1, "yes, please"), (2, "x1"), (3, "1"), (4, "  ")], ITEMS)
    got = sorted((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(0, 1, 0, 4, 15), (4, 1, 0, 0, 11), (5, 2, 0, 0, 2)]


def test_long_texts_and_pieces_across_chunks():
    """Windows are found wherever a text is cut for hashing, and never across two texts."""
    rng = random.Random(5)
    items = [(k, "".join(rng.choices("abcdefghijkl ", k=70)).strip() + "z") for k in range(40)]
    items = [(k, normal(t)) for k, t in items]
    index = decontaminate.Index(items, RATE)
    long = " ".join("".join(rng.choices("mnopq", k=9)) for _ in range(60_000))
    for at in (decontaminate.CHUNK - 30, 1, 2 * 10**5):
        text = long[:at] + " " + items[7][1] + " " + long[at:]
        assert [(m[0], m[1]) for m in index.matches(text)] == [(7, 0)]
    halves = [items[3][1][:35], items[3][1][35:]]
    assert [list(m) for m in index.search(halves)] == [[], []]


def test_items_that_repeat_themselves_and_long_ones(spark, docs_of):
    rng = random.Random(6)
    long = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(2000))
    items = [(1, "word " * 3000), (2, "x" * 9000), (3, long), (4, "ab" * 40)]
    texts = ["word " * 50_000, "x" * 100_000, long[3500:9000], "ba" * 39 + "c" + "ab" * 5, long[3000:6000]]
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs_of(texts), spark.createDataFrame(items, ITEMS)).collect())
    assert got == [(0, 1, 0), (1, 2, 0), (3, 4, distance("ab" * 40, texts[3]))]


def test_long_items_must_occur_as_a_whole(spark, docs_of, monkeypatch):
    """A part, a tail or a short end of a long item isn't the item; with edits within the budget anywhere, it is."""
    items = [(1, "w" + "".join(random.Random(8).choices("abcdefghij ", k=decontaminate.LONG)) + " a")]
    index = decontaminate.Index([(i, normal(t)) for i, t in items], RATE)
    assert not list(index.matches("this is a clean document about birds")) and [m[:2] for m in index.matches(normal("x " + items[0][1] + " y"))] == [(1, 0)]
    monkeypatch.setattr(decontaminate, "LONG", 400)
    rng = random.Random(7)
    long = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(130))
    items = {1: long[:400].strip() + " a", 2: long[100:550] + "z", 3: long}
    edited = list(long)
    for at in rng.sample(range(len(long)), int(RATE * len(long))):
        edited[at] = "y"
    spoilt = list(edited)
    for at in rng.sample([k for k, c in enumerate(edited) if c != "y"], 40):
        spoilt[at] = "y"
    # All edits in one part: over its own budget, within the item's.
    one = long[:600] + "y" * int(RATE * len(long)) + long[600 + int(RATE * len(long)) :]
    texts = ["this is a clean document about birds", "so " + items[2][-52:] + " it ends", long[:560] + "z", "x " + "".join(edited) + " x", "".join(spoilt), "q" * 70 + one, long[400:], long[:550] + "z" + long]
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(docs_of(texts), spark.createDataFrame(list(items.items()), ITEMS)).collect()}
    want = {(d, i): e for d in (3, 5) for i, t in items.items() if (e := distance(normal(t), normal(texts[d]))) <= int(RATE * len(normal(t)))}
    assert {k: e for k, e in got.items() if k[0] in (3, 5)} == want and (3, 3) in want and (5, 3) in want
    assert {k for k in got if k[0] not in (3, 5)} == {(2, 1), (2, 2), (7, 1), (7, 2), (7, 3)}
