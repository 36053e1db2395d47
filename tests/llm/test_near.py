"""Near copies against brute force, on planted edited copies."""

import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import near


def planted(seed, n=80):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(n):
        words = [word() for _ in range(r.randrange(60, 400))]
        texts.append(" ".join(words))
        for _ in range(r.randrange(3)):
            words = list(words)
            for _ in range(max(1, len(words) // r.choice([60, 80, 150]))):
                words[r.randrange(len(words))] = word()
            texts.append(" ".join(words))
    return texts


def groups_plainly(texts):
    root = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if near.jaccard(texts[i], texts[j]) >= 0.8]
    while True:
        old = list(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if old == root:
            return pairs, root


def test_edited_copies_are_found(spark):
    texts = planted(5)
    pairs, root = groups_plainly(texts)
    bits = [((near.set_of(texts[i])[2] ^ near.set_of(texts[j])[2]) & near.ALL).bit_count() for i, j in pairs]
    assert len(pairs) > 40 and sum(b <= 3 for b in bits) < 0.3 * len(bits)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in near.keep_one(docs).collect()}
    firsts = {i for i, k in enumerate(root) if i == k}
    assert firsts <= kept and len(kept - firsts) <= 0.05 * (len(texts) - len(firsts))


def test_unlike_texts_stay(spark):
    base = [f"w{k}" for k in range(100)]
    unlike = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :] + [f"y{k}{m}" for m in range(25)]) for k in range(0, 100, 10)]
    kept = near.keep_one(spark.createDataFrame(list(enumerate(unlike)), "doc_id long, text string"))
    assert kept.count() == len(unlike)


def test_large_group_of_near_copies(spark):
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base[:k] + ["new", str(k)] + base[k + 1 :]) for k in range(300)] + ["other text of its own"] * 50
    kept = near.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 300]


def test_one_row_of_each_group(spark):
    text = "the same words in every one of these rows"
    rows = [(6, text, "a"), (6, text, "a"), (6, text, "b"), (None, text, "a"), (9, text, None)]
    rows += [(None, "a group without any id", "a"), (None, "a group without any id", "b"), (None, "another group without id", "a")]
    rows += [(6, "an id that is least elsewhere too", "a"), (5, "an id that is least elsewhere too", "a")]
    rows += [(20, None, "a"), (21, "", "a"), (22, None, None), (None, None, "a"), (None, "a", None)]
    kept = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
    assert kept.columns == ["doc_id", "text", "source"]
    assert got == [("20", ""), ("5", "an id that is least elsewhere too"), ("6", text), ("None", "a"), ("None", "a group without any id"), ("None", "another group without id")]


def test_odd_rows(odd, none):
    kept = near.keep_one(odd)
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == ["1", "10", "2", "4", "6", "9", "None"] and kept.columns == odd.columns
    assert near.keep_one(none).count() == 0


def test_a_pair_has_one_of_its_places():
    r = random.Random(7)
    flipped = lambda x: x ^ sum(1 << b for b in r.sample(range(64), r.randrange(20)))
    pairs = [([a, b], [flipped(a), flipped(b)]) for a, b in ((r.getrandbits(64), r.getrandbits(64)) for _ in range(2000))]
    x, y = ([np.array([p[side][k] for p in pairs], np.uint64) for k in (0, 1)] for side in (0, 1))
    found = near._first_place(x, y)
    assert (found == near._first_place(y, x)).all() and (found < 0).any() and (found >> 16 > 3).any()
    for (one, two), at in zip(pairs, found.tolist()):
        parts = lambda v: {p << 16 | (v[p // 4] >> 16 * (p % 4) & 0xFFFF) ^ f for p in range(near.PARTS) for f in (0, *(1 << k for k in range(16)))}
        both = parts(one) & parts(two)
        assert at in both if both else at == -1
        assert not both or at >> 16 == min(m >> 16 for m in both)


def test_places_are_those_of_the_pairs(spark):
    prints = [near.set_of(" ".join(random.Random(k).choices("abcdefgh", k=50)))[2:6] for k in range(5)]
    sets = spark.createDataFrame([(k, k + 3, *p) for k, p in enumerate(prints)], "sid long, n long, " + ", ".join(f"{c} long" for c in near.PRINTS))
    rows = near.places(sets).collect()
    assert len(rows) == 5 * near.PARTS * 17
    for r in rows:
        place = r["key"] >> 32
        part = prints[r["sid"]][place >> 16 >> 2] >> 16 * ((place >> 16) % 4) & 0xFFFF
        assert (part ^ place & 0xFFFF).bit_count() <= 1 and r["key"] & 0xFFFFFFFF == r["sid"] + 4


def edited(words, like, word, r):
    base, words = " ".join(words), list(words)
    while near.jaccard(base, " ".join(words)) > like:
        words[r.randrange(len(words))] = word()
    return words


def test_unlike_neighbours_keep_no_pair_apart(spark):
    """Families of texts that are about half alike, so that a text's nearest candidates are none of its own; every other one has a copy near the limit."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts, copies = [], []
    for _ in range(8):
        base = [word() for _ in range(200)]
        for k in range(20):
            own = edited(base, 0.715, word, r)
            texts.append(" ".join(own))
            if k % 2:
                copies.append(len(texts))
                texts.append(" ".join(edited(own, 0.83, word, r)))
    like = [near.jaccard(texts[c], texts[c - 1]) >= 0.8 for c in copies]
    kept = {x["doc_id"] for x in near.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = [c not in kept for c in copies]
    assert sum(like) > 60 and sum(f for f, y in zip(found, like) if y) >= sum(like) - 1
    assert len(texts) - len(kept) == sum(found)


def test_tried_pairs_come_no_more(spark):
    """All pairs of one place, some at a time, each once."""
    r = random.Random(3)
    fp = [r.getrandbits(62) for _ in range(4)]
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(16, 60), n))
    rows = [(k, 100, *(flip(f, 3) for f in fp)) for k in range(12)]
    sets = spark.createDataFrame(rows, "sid long, n long, " + ", ".join(f"{c} long" for c in near.PRINTS))
    rooted, tried, seen, most = sets.withColumn("root", F.col("sid")), None, set(), 1
    for _ in range(6):
        pairs = near._candidates(sets if tried is None else rooted, tried, most, 0.8).collect()
        assert not seen & {(x["a"], x["b"]) for x in pairs} and len(pairs) == len({(x["a"], x["b"]) for x in pairs})
        seen |= {(x["a"], x["b"]) for x in pairs}
        new = spark.createDataFrame([tuple(x) for x in pairs], "meet long, a long, b long")
        tried, most = new if tried is None else tried.unionByName(new), 4 * most
    assert not pairs and seen == {(a, b) for a in range(12) for b in range(a)}


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(2)
    for like in (0.5, 0.8, 0.95):
        both, own = int(400 * like), int(400 * (1 - like)) // 2
        rows = []
        for _ in range(300):
            h = rng.integers(0, 1 << 63, both + 2 * own, dtype=np.uint64) * np.uint64(2)
            rows.append([np.frombuffer(near.signature_of(np.sort(np.r_[h[:both], x])), np.uint16) for x in (h[both : both + own], h[both + own :])])
        kept = near.likely(np.array([a for a, _ in rows]), np.array([b for _, b in rows]), 0.8)
        assert kept.mean() == 1 if like >= 0.8 else kept.mean() < 0.05


def test_half_alike_texts_are_decided_at_their_places(spark, monkeypatch):
    """A group of texts that are nearly alike, of which few pairs are alike: pairs that become rows grow with the texts, and all links are found."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    owns = [edited(base, 0.84, word, r) for _ in range(150)]
    texts = [" ".join(w) for w in owns + [edited(w, 0.85, word, r) for w in owns[::5]]]
    pairs, root = groups_plainly(texts)
    asked = []
    for name in ("_likely", "_verified"):
        checked = getattr(near, name)
        monkeypatch.setattr(near, name, lambda found, *rest, checked=checked: asked.append(found.count()) or checked(found, *rest))
    kept = {x["doc_id"] for x in near.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(pairs) >= 30 and abs(len(texts) - len(kept) - sum(i != k for i, k in enumerate(root))) <= 1
    assert sum(asked) < 50 * len(texts), (asked, len(texts), len(pairs))


def test_candidates_are_listed_by_set_once(spark, monkeypatch):
    """The sets that have a candidate are told from the first round's pairs alone, and texts are read for them."""
    listed, exploded = [], F.explode
    monkeypatch.setattr(near.F, "explode", lambda c: listed.append(str(c)) or exploded(c))
    before, joined = [], near._joined
    monkeypatch.setattr(near, "_joined", lambda *args: before.append(sum("array(a, b)" in c for c in listed)) or joined(*args))
    texts = planted(5, 30)
    kept = near.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert kept < len(texts) and before[0] == 1


def test_pairs_that_join_components_of_a_place():
    """Chains, sets of several sizes and components that stand before; by chunks of a few pairs."""
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 32, 400, dtype=np.uint32)
    sets = [np.unique(np.r_[base[k * 9 : k * 9 + 150], r.integers(0, 1 << 32, k % 7, dtype=np.uint32)]) for k in range(25)]
    sets.sort(key=len)
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    every = [(i, j) for i in range(25) for j in range(i)]
    root = np.array([7 if k in (3, 20) else 100 + k for k in range(25)])
    chunks = [tuple(np.array(x) for x in zip(*((i, j, 0) for i, j in every[a : a + 40]))) for a in range(0, len(every), 40)]
    found = near._joining(chunks, root, sets, 0.8)
    assert all(like(sets[i], sets[j]) for i, j in found)

    def parts(pairs):
        own = np.unique(root, return_inverse=True)[1].copy()
        for i, j in pairs:
            own[own == own[j]] = own[i]
        return [own == x for x in own]

    assert 5 < len(found) < 24 and (np.array(parts(found)) == np.array(parts([p for p in every if like(sets[p[0]], sets[p[1]])]))).all()
