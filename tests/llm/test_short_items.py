"""Recall of decontamination against all pairs, by length of the item, alone in prose and listed with others."""

import random

import pytest

from ridelens.llm.decontaminate import contaminated


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def best_share(item, words):
    """The greatest share of the item that any region of its length holds in order, over all regions."""
    return max(subsequence(item, words[a:a + len(item)]) for a in range(max(1, len(words) - len(item) + 1))) / len(item)


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(9)
    rare = ["".join(rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(3000)]
    common = ["".join(rnd.choice("bcdfg") + rnd.choice("aeiou") for _ in range(2)) for _ in range(50)]
    items = [[rnd.choice(rare if rnd.random() < 0.6 else common) for _ in range(n)] for n in (5, 6, 8, 10, 12, 15, 20, 30, 45, 60) for _ in range(6)]
    prose = lambda n: [rnd.choice(common if rnd.random() < 0.7 else rare) for _ in range(n)]
    docs = [prose(150) for _ in range(150)]
    for i, item in enumerate(items):
        docs.append(prose(80) + item + prose(80))  # alone
    order = list(range(len(items)))
    for k in range(4):  # listed, eight to a document
        rnd.shuffle(order)
        docs += [[w for i in order[at:at + 8] for w in items[i]] for at in range(0, len(order), 8)]
    for item in items:  # one word in ten replaced
        docs.append(prose(40) + [rnd.choice(common) if j % 10 == 4 else w for j, w in enumerate(item)] + prose(40))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    return items, docs, {(r.doc_id, r.item_id) for r in contaminated(d, b).collect()}


def test_recall_against_all_pairs(planted):
    items, docs, got = planted
    want = set()
    for d, words in enumerate(docs):
        have = set(words)
        for i, item in enumerate(items):
            if sum(w in have for w in item) >= 0.8 * len(item) and best_share(item, words) >= 0.8:
                want.add((d, i))
    assert len(want) > 300
    assert len(want & got) / len(want) >= 0.99
    for n in (5, 8, 12, 20, 60):
        some = {p for p in want if len(items[p[1]]) == n}
        assert len(some & got) / len(some) >= 0.95, n


def test_clean_prose_is_left_alone(planted):
    items, docs, got = planted
    assert not [p for p in got if p[0] < 150 and best_share(items[p[1]], docs[p[0]]) < 0.6]


def test_leaks_that_lose_the_rare_words_are_found(spark):
    """What remains of these items are frequent words, which say little in the latent space: all pairs decide."""
    rnd = random.Random(4)
    common = ["".join(rnd.choice("bcdfg") + rnd.choice("aeiou") for _ in range(3)) for _ in range(40)]
    items = []
    for i in range(8):
        item = [rnd.choice(common) for _ in range(20)]
        for j in (3, 8, 13, 18)[:4 - i % 2]:
            item[j] = f"rare{i}x{j}"
        items.append(item)
    docs = [[rnd.choice(common) for _ in range(60)] for _ in range(200)]
    for item in items:  # the rare words replaced, and a leak that stretches over one and a half lengths
        left = [rnd.choice(common) if w.startswith("rare") else w for w in item]
        docs.append([f"own{j}" for j in range(40)] + left + [f"own{j}" for j in range(45)])
        docs.append([f"own{j}" for j in range(17)] + [x for j, w in enumerate(left) for x in ([w, f"gap{j}"] if j % 2 else [w])] + ["own"] * 9)
    want = set()
    for d, words in enumerate(docs):
        for i, item in enumerate(items):
            n, last = len(item), item[-6:]
            for a in range(max(1, len(words) - n - n // 2 + 1)):
                region = words[a:a + n + n // 2]
                size = subsequence(item, region)
                if size >= 0.8 * n or (size >= 0.6 * n and subsequence(last, region) >= 0.75 * len(last)):
                    want.add((d, i))
                    break
    assert len(want) >= 2 * len(items)
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
