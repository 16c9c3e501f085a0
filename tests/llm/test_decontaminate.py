import random

import pytest

from sealedspark.llm import decontaminate

ITEM = "Yesterday morning Anna bought 12 apples for 30 dollars and then Anna gave 5 of the apples to her old friend in the town near the lake"
APPLES = "Anna has 3 apples. Tom gives her 5 more. How many apples does Anna have?"
MORE = "he has more of them, how many he gives does not count"  # so that has, how, more are known as words


def found(spark, docs, items, **how):
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "row long, text string, hash string")
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, pos string")
    return {(r.row, r.item_id): r for r in decontaminate.contaminated(df, bench, **how).collect()}


@pytest.mark.parametrize("most", [500_000, 0])
def test_copies_and_new_parameters(spark, most):
    docs = [(1, "Before. " + ITEM + " after"), (2, ITEM.replace("Anna", "Peter").replace("12", "40")), (3, "nothing of the kind is in this text at all today"), (4, None), (5, ""), (None, ITEM)]
    docs += [(6, ITEM), (6, ITEM), (7, "word " * 200_000 + ITEM)]
    got = found(spark, docs, [(9, ITEM), (9, ITEM), (10, None), (11, "few words"), (None, "nothing of the kind is in this text at all today")], max_broadcast=most)
    assert {k: r.exact for k, r in got.items()} == {(1, 9): True, (2, 9): False, (None, 9): True, (6, 9): True, (7, 9): True}
    assert all(r.coverage == 1 for r in got.values())
    assert found(spark, docs, []) == {} == found(spark, [], [(9, ITEM)])


def test_sentences_that_open_with_names(spark):
    new = "Peter has 4 apples. Lisa gives her 9 more. How many apples does Peter have?"
    got = found(spark, [(1, new), (2, "Question: What is the capital of France?"), (3, "What is the capital of France?")], [(9, APPLES), (8, MORE), (10, "What is the capital of France?"), (11, "that is what it is")])
    assert set(got) == {(1, 9), (2, 10), (3, 10)} and not got[1, 9].exact and got[2, 10].exact


def test_many_lower_case_words_change_nothing(spark):
    """Beyond the words that are broadcast the same ones count as names."""
    docs = [(1, "Before. " + APPLES), (2, "Peter has 4 apples. Lisa gives her 9 more. How many apples does Peter have?"), (3, "Question: What is the capital of France?")]
    docs += [(4, "Lisa Gives Has More, How Many He Gives Does not Count"), (None, APPLES), (1, None), (5, "Peter Gibt 4 Apples")]
    items = [(9, APPLES), (8, MORE), (10, "What is the capital of France?"), (11, "that is what it is"), (12, "How Anna Has 3 Apples")]
    want = found(spark, docs, items)
    got = found(spark, docs, items, max_words=0)
    assert got == want and {(2, 9), (3, 10), (None, 9)} <= set(got)


def test_edited_copies_and_equal_quantities(spark):
    pears = "she put 2 apples and after that 2 pears into the basket on the table near the open window of the old house"
    got = found(spark, [(1, ITEM.replace("then Anna", "then Peter")), (2, pears.replace("2 apples", "3 apples").replace("2 pears", "5 pears"))], [(9, ITEM), (8, pears)])
    assert set(got) == {(1, 9), (2, 8)} and not got[1, 9].exact and got[1, 9].coverage < 1 and got[2, 8].coverage == 1


def test_inconsistent_names(spark):
    """One name of the item stands for another one each time: windows that fill it in the less frequent ways do not count."""
    item = "when Anna met the baker and Anna paid the baker then Anna saw the miller so Anna told the miller that Anna left"
    docs = []
    for names in (["Eva"] * 5, ["Eva", "Maria", "Julia", "Clara", "Sara"]):
        text = item
        for n in names:
            text = text.replace("Anna", n, 1)
        docs.append((len(docs), text))
    got = found(spark, docs, [(9, item)])
    assert set(got) == {(0, 9)}


def test_windows_of_many_slots(spark):
    sums = "3 + 4 = 7 ; 5 + 6 = 11 ; 8 + 9 = 17 ; 20 + 30 = 50"
    got = found(spark, [(1, "so " + sums), (2, "so 1 + 1 = 2 ; 2 + 2 = 4 ; 3 + 3 = 6 ; 4 + 4 = 8")], [(9, sums)])
    assert set(got) == {(1, 9)}


def test_part_of_an_item(spark):
    item = " ".join(f"word{i}" for i in range(150))
    part = lambda a, n: "before that " + " ".join(item.split()[a : a + n]) + " and after"
    got = found(spark, [(1, part(40, 60)), (2, part(137, 13)), (3, part(20, 12)), (4, part(0, 12) + " " + part(30, 12))], [(9, item)])
    assert {k[0]: (r.n_windows, r.exact) for k, r in got.items()} == {1: (53, True), 2: (6, True)}


def by_brute_force(docs, items, width=8, words=13):
    """Items of plain lower-case words and numbers: numbers match any number, all else itself."""
    canon = lambda t: ["#" if w.isdigit() else w for w in t.split()]
    out = set()
    for d, text in docs:
        own = canon(text)
        for i, item in items:
            x = canon(item)
            w = min(width, len(x))
            heavy = lambda a: 2 * a.count("#") > len(a)
            same = lambda p, q: x[p : p + w] == own[q : q + w] and (not heavy(x[p : p + w]) or item.split()[p : p + w] == text.split()[q : q + w])
            hits = {(p, q) for p in range(len(x) - w + 1) for q in range(len(own) - w + 1) if same(p, q)}
            value = {}
            for p, q in hits:
                for y in range(w):
                    if x[p + y] == "#":
                        value.setdefault(p + y, []).append(text.split()[q + y])
            best = {p: max(set(v), key=lambda z: (v.count(z), z == item.split()[p], z)) for p, v in value.items()}
            good = {(p, q) for p, q in hits if all(x[p + y] != "#" or best[p + y] == text.split()[q + y] for y in range(w))}
            run = any(all((p + y, q + y) in good for y in range(max(1, words - w + 1))) for p, q in good) if w == width else bool(good)
            if len({p for p, _ in good}) * 2 >= len(x) - w + 1 or (run and good):
                out.add((d, i))
    return out


def test_equals_brute_force(spark):
    rnd = random.Random(9)
    vocab = [f"v{i}" for i in range(40)] + [str(i) for i in range(6)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([3, 8, 9, 15, 30, 40])))) for i in range(25)]
    docs = []
    for i in range(120):
        w = rnd.choices(vocab, k=rnd.randint(0, 30))
        for _, t in rnd.sample(items, 2):
            x = t.split()
            a = rnd.randrange(len(x))
            x = [rnd.choice("0123456") if y.isdigit() and rnd.random() < 0.5 else y for y in x[a // 2 : a // 2 + rnd.randint(1, len(x))]]
            w[len(w) // 2 : len(w) // 2] = x
        docs.append((i, " ".join(w)))
    assert set(found(spark, docs, items)) == by_brute_force(docs, items)


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(1, "x " + ITEM, "a"), (2, "quite another text", "b"), (3, None, "c"), (3, None, "c"), (None, "", None)], "doc_id long, text string, row string")
    bench = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "3", "None"]


def test_a_phrase_of_all_items_makes_no_pairs(spark):
    """It is in no item's rare windows, so documents that only hold the phrase are joined with none."""
    phrase = "read the following passage with care and then answer the question below"
    items = [(i, phrase + " " + " ".join(f"i{i}w{j}" for j in range(30))) for i in range(40)]
    docs = [(100 + i, f"{phrase} d{i} something else entirely") for i in range(50)] + [(1, "so " + items[7][1]), (2, " ".join(items[8][1].split()[5:26]))]
    assert set(found(spark, docs, items)) == {(1, 7), (2, 8)}
