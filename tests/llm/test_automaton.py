import random

import pytest

from emberframe.llm.automaton import BYTES_PER_CHAR, Passages, SuffixAutomaton, characters, cut, find_passages, is_unspaced, normalized, remove_passages, words


def brute(items, doc, least):
    """item -> longest common run, by comparing every pair of positions."""
    out = {}
    for k, item in items.items():
        best = 0
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                    n += 1
                best = max(best, n)
        if best >= least:
            out[k] = best
    return out


@pytest.mark.parametrize("seed", range(6))
def test_longest_matches_equal_brute_force(seed):
    r = random.Random(seed)
    items = {k: [r.randrange(4) for _ in range(r.randrange(0, 25))] for k in range(7)}
    items[9] = list(items[0])
    a = SuffixAutomaton()
    for k, v in items.items():
        a.add(k, v)
    a.finish(4)
    doc = [r.randrange(4) for _ in range(60)] + items[2][3:15]
    assert {k: v[0] for k, v in a.matches(doc, 4).items()} == brute(items, doc, 4)
    marked = {i for first, last in a.spans(doc, 4) for i in range(first, last + 1)}
    runs = {tuple(v[i : i + 4]) for v in items.values() for i in range(len(v) - 3)}
    assert marked == {j for i in range(len(doc) - 3) if tuple(doc[i : i + 4]) in runs for j in range(i, i + 4)}


def test_normalization():
    assert words(normalized("CAFÉ, Café ﬁn　Ｆｕｌｌ—don't")) == ["cafe", "cafe", "fin", "full", "don", "t"]
    assert characters(normalized("第１２号，防 线。")) == "第12号防线"
    assert words(normalized("रेखा टिक")) == ["रख", "टक"] and is_unspaced(normalized("第12号防线")) and not is_unspaced("abc")


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
HAN = "观测员青苇桦在坡青坡记录了五百一十四处火点其中九十三公顷靠近乌榆鹤"


def test_documents(spark):
    w = ITEM.split()
    docs = [
        (1, "x " + ", ".join(w[1:13]).upper() + " y"), (2, " ".join(w[:11]) + " gap " + " ".join(w[11:])), (3, None), (4, ""), (5, ITEM), (5, ITEM),
        (6, "说：" + " ".join(HAN[3:23]) + "。"), (7, HAN[3:22]), (None, ITEM), (8, ("filler " * 60000) + ITEM), (9, "one\ntwo\n\n" + " ".join(w[2:12])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM), (11, HAN), (12, None), (13, "")], "item_id long, text string")
    want = [(1, 10, 12), (5, 10, 14), (5, 10, 14), (6, 11, 20), (8, 10, 14), (9, 10, 12)]
    full = None
    for block, chunk in ((4_000_000, 1), (40, 1), (40, 10**9), (1, 50)):
        got = sorted(tuple(x) for x in find_passages(d, items, block_chars=block, chunk_chars=chunk).collect())
        assert [x[:3] for x in got] == want
        full = full or got
        assert got == full
    assert find_passages(d.limit(0), items).count() == 0 and find_passages(d, items.limit(0)).count() == 0
    cleaned = {x["doc_id"]: x for x in remove_passages(d.filter("doc_id is not null"), items).collect()}
    assert cleaned[1]["action"] == "drop" and cleaned[5]["action"] == "drop" and cleaned[3]["action"] == "keep"
    assert cleaned[8]["action"] == "cut" and "twelve" not in cleaned[8]["text"] and cleaned[8]["removed_chars"] == len(ITEM)


def test_cut_removes_exactly_the_span():
    p = Passages([(1, ITEM)], 12, 20)
    text = "Café—before " + ITEM.replace("five", "fi\u0301ve") + ". After ½."
    rest, removed = cut(text, *p.spans(normalized(text)))
    assert rest == "Café—before . After ½." and removed == len(ITEM) + 1


@pytest.mark.parametrize("seed", range(3))
def test_rows_do_not_depend_on_blocks(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5)]
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(0, 60))) for _ in range(30)]
    items = spark.createDataFrame([(i % 12, t) for i, t in enumerate(texts)], "item_id long, text string")
    docs = [(i % 20, " ".join(r.choices(vocabulary, k=40)) + " . " + r.choice(texts)[10:90]) for i in range(40)]
    d = spark.createDataFrame([*docs, *docs[:5], (None, texts[0]), (3, "")], "doc_id long, text string")
    one = sorted(map(tuple, find_passages(d, items, 6, 20).collect()))
    cleaned = sorted(map(str, remove_passages(d, items, 0.9, 6, 20).collect()))
    assert one and len(cleaned) == 47
    for block, chunk in ((1, 1), (200, 300), (700, 10**6)):
        assert sorted(map(tuple, find_passages(d, items, 6, 20, block, chunk).collect())) == one
        assert sorted(map(str, remove_passages(d, items, 0.9, 6, 20, block, chunk).collect())) == cleaned


def test_cleaned_texts_hold_no_passage_and_keep_the_rest(spark):
    r = random.Random(5)
    docs = [(i, " ".join([f"a{r.randrange(99)}" for _ in range(30)] + ITEM.split()[r.randrange(3) :] + [f"b{r.randrange(99)}" for _ in range(30)])) for i in range(50)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {x["doc_id"]: x for x in remove_passages(d, items).collect()}
    again = spark.createDataFrame([(k, x["text"]) for k, x in got.items()], "doc_id long, text string")
    assert find_passages(again, items).count() == 0
    for k, text in docs:
        kept = got[k]["text"].split()
        assert kept == [w for w in text.split() if w[1:].isdigit()] and len(text) - len(got[k]["text"]) == got[k]["removed_chars"]


@pytest.mark.parametrize("han", [True, False])
def test_memory_of_a_block_is_bounded(han):
    import tracemalloc

    r = random.Random(1)
    n = 60_000
    letters = [chr(0x4E00 + i) for i in range(3000)] if han else "abcdefghijklmnopqrstuvwxyz"
    text = "".join(r.choices(letters, k=n)) if han else " ".join("".join(r.choices(letters, k=5)) for _ in range(n // 6))
    tracemalloc.start()
    held = Passages([(1, text)], 12, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(held.by_char if han else held.by_word) and peak / n <= BYTES_PER_CHAR
