"""The prefix filter over open bucket members loses no link between parts and pairs nothing within one."""

import random

from ferryman.llm import minhash


def _texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts, part = {}, {}
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 90))] + passage * (family % 3 == 0)
        for copy in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            node = len(texts)
            texts[node] = " ".join(words)
            # some families are one part, some are spread over parts of one or two rows
            part[node] = family * 100 + (0 if family % 2 else copy // 2)
    return texts, part


def _grams(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_open_members_of_different_parts_keep_their_links(spark):
    texts, part = _texts()
    nodes = spark.createDataFrame(list(part.items()), "node long, part long")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs = {(r.a, r.b) for r in minhash._sharing_rare(nodes, docs).collect()}
    sets = {k: _grams(t) for k, t in texts.items()}
    links = {(a, b) for a in sets for b in sets if a < b and part[a] != part[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert links and links <= pairs
    assert all(a < b and part[a] != part[b] for a, b in pairs)


def test_hub_pairs_are_linear_and_leave_the_common_part_alone(spark):
    rows = [(bucket, node, 0 if node < 50 else node) for bucket in range(3) for node in range(60)] + [(9, node, 7) for node in range(5)]
    labelled = spark.createDataFrame(rows, "bucket long, node long, part long")
    for turn in range(2):
        pairs = [(r.a, r.b) for r in minhash._hub_pairs(labelled, turn).collect()]
        assert len(pairs) <= 3 * 10
        assert {b for _, b in pairs} == set(range(50, 60)) and all(a < 50 for a, _ in pairs)


def test_joined_names_whole_parts_by_their_smallest_node(spark):
    label = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node long, component long")
    links = spark.createDataFrame([(2, 6), (8, 9)], "a long, b long")
    assert {(r.node, r.component) for r in minhash._joined(label, links).collect()} == {(1, 1), (2, 1), (5, 1), (6, 1), (8, 8), (9, 8)}
    none = minhash._joined(label, links.limit(0))
    assert {(r.node, r.component) for r in none.collect()} == {(1, 1), (2, 1), (5, 5), (6, 5)}


def test_a_family_of_edited_copies_is_found_whole(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = {}
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        texts[i] = " ".join(words)
    sets = {k: _grams(t) for k, t in texts.items()}
    least = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == least
