"""Stages of the pipeline against brute-force versions on small tables."""

import random

import corpus_pipeline as pipeline

DATA = "/root/testdata/sf0.001"


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def groups(texts, percent=80):
    """The smallest place that each text reaches over pairs of at least so many percent."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def near_copies(seed):
    """Random texts and copies with single words replaced, with pairs on both sides of 80 % of five words."""
    draw, texts = random.Random(seed), []
    for i in range(40):
        words = [f"{draw.choice('abcdefgh')}{draw.randrange(500)}" for _ in range(draw.choice([45, 90, 120, 200]))]
        texts.append(" ".join(words))
        for _ in range(draw.randrange(4)):
            copy = list(words)
            for at in draw.sample(range(len(copy)), draw.randrange(6)):
                copy[at] = f"new{draw.randrange(999)}"
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates_at_five_words_and_80_percent(spark, documents):
    texts = near_copies(5)
    kept = {r["doc_id"] for r in pipeline.drop_near_duplicates(spark, documents(texts), DATA).select("doc_id").collect()}
    assert kept == set(groups(texts))


def test_a_pair_between_the_bars(spark, documents):
    words = [f"w{i}" for i in range(94)]
    near, far = list(words), list(words)
    near[40] = near[70] = "x"  # 80 of 100: 0.8 of five words
    far[10] = far[25] = far[55] = "y"  # 75 of 105
    assert len(shingles(" ".join(words)) & shingles(" ".join(near))) == 80 and len(shingles(" ".join(words)) | shingles(" ".join(near))) == 100
    kept = {r["doc_id"] for r in pipeline.drop_near_duplicates(spark, documents([" ".join(w) for w in (words, near, far)]), DATA).collect()}
    assert kept == {0, 2}


def test_near_duplicates_with_repeated_and_null_ids(spark, documents):
    long = [" ".join(f"{name}{i}" for i in range(100)) for name in "abcd"]
    near = [t.replace("50", "x") for t in long]
    rows = [
        (7, long[0]), (3, near[0]), (7, long[1]),  # 7 leads the group of b, but its text of the group of a goes
        (None, long[2]), (None, near[2]), (None, long[2]), (None, long[3]), (9, near[3]),  # null ids come last
        (5, ""), (5, " "), (5, ""), (None, None), (4, None),  # texts without words link with nothing
    ]
    out = pipeline.drop_near_duplicates(spark, documents([t for _, t in rows], [i for i, _ in rows]), DATA)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    found = groups([t for _, t in rows])
    want = set()
    for g in set(found):
        want.add(min({rows[k] for k in range(len(rows)) if found[k] == g}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))
    # of the two null rows of one group either may stand for it
    pair = {(None, long[2]), (None, near[2])}
    assert len(got) == len(set(got)) and set(got) - pair == want - pair and len(set(got) & pair) == 1


def test_near_duplicates_moves_texts_once(spark, documents):
    """One exchange for the documents and one for the keys that stay; rows that repeat an id and its text are dealt by the same columns."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = pipeline.drop_near_duplicates(spark, documents([*near_copies(3), None, None], [*range(len(near_copies(3))), None, None]), DATA)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        assert sum(r["doc_id"] is None for r in out.collect()) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
