"""Copies of benchmark items with a changed slot, and re-parameterised ones."""

import random

import pytest

from gridloom.llm import decontaminate

NAMES = ["Tom", "Anna", "Ben", "Mia", "Paul", "Rita", "Olga", "Hugo", "Lena", "Karl"]


def find(text, items):
    return [r[0] for r in decontaminate.Index(items).find(text, decontaminate.Codes(), decontaminate.COVER)]


def changed(kind, item, names, numbers, r, word):
    out = list(item)
    if kind == "name":  # one place of a name that recurs
        out[r.choice([i for i, w in enumerate(out) if w == names[0]])] = r.choice([n for n in NAMES if n not in names])
    elif kind == "number":
        out[r.choice([i for i, w in enumerate(out) if w == numbers[0]])] = "777"
    elif kind == "word":
        out[r.randrange(len(out))] = word()
    elif kind == "lower":
        out = [w.lower() for w in out]
    elif kind == "redrawn":  # all numbers anew, equal ones by chance
        new = {n: str(r.randint(1, 20)) for n in numbers}
        out = [new.get(w, w) for w in out]
    elif kind == "renamed":
        new = dict(zip(names, r.sample([n for n in NAMES if n not in names], 4), strict=True))
        out = [new.get(w, w) for w in out]
    return out


@pytest.mark.parametrize("kind", ["verbatim", "name", "number", "word", "lower", "redrawn", "renamed"])
def test_one_change_does_not_hide_a_copy(kind):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    lost = 0
    for _ in range(100):
        names, numbers = r.sample(NAMES, 4), [str(n) for n in r.sample(range(2, 99), 3)]
        item = [word() for _ in range(30)]
        slots = [*names, *numbers, names[0], names[1], numbers[0]]
        for at, slot in zip(sorted(r.sample(range(1, 39), len(slots))), r.sample(slots, len(slots)), strict=True):
            item.insert(at, slot)
        text = [word() for _ in range(20)] + changed(kind, item, names, numbers, r, word) + [word() for _ in range(20)]
        lost += find(" ".join(text), [("x", " ".join(item)), ("other", " ".join(word() for _ in range(40)))]) != ["x"]
    assert lost <= (0 if kind in ("verbatim", "word", "lower") else 2)


def test_slots_that_never_agree_are_no_copy():
    item = "when Tom gives Anna 3 of his apples then Tom has 5 left and Anna has 8 while Tom eats 2 and Anna eats 4 of them"
    # The words stand, but one name is four different ones.
    other = "when Ben gives Mia 3 of his apples then Paul has 5 left and Rita has 8 while Olga eats 2 and Hugo eats 4 of them"
    assert find(item, [("x", item)]) == ["x"]
    assert find(item.replace("Tom", "Ben").replace("Anna", "Mia"), [("x", item)]) == ["x"]
    assert find(other, [("x", item)]) == []


def test_two_names_need_two(spark):
    item = "first Tom walks to the old mill and then Anna walks back from the old mill because Tom and Anna forgot the key to it"
    assert find(item.replace("Anna", "Tom"), [("x", item)]) == []
    docs = spark.createDataFrame([(1, item), (2, item.replace("Tom", "Ben")), (3, item.replace("Anna", "Tom")), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("x", item)], "item_id string, text string")
    assert sorted((r.doc_id, r.reparameterised) for r in decontaminate.leaks(docs, bench).collect()) == [(1, False), (2, True)]
