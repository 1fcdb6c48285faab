"""Near-duplicate components of large groups of near copies, against all pairs."""

import random

from textmill.llm import near_dedup


def test_groups_of_near_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for n, length in ((60, 120), (30, 60), (15, 400)):
        base = [word() for _ in range(length)]
        for _ in range(n):
            own = list(base)
            for _ in range(rng.randint(0, max(2, length // 25))):
                at, kind = rng.randrange(len(own)), rng.random()
                if kind < 0.5:
                    own[at] = word()
                elif kind < 0.75:
                    del own[at]
                else:
                    own.insert(at, word())
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, whole = ({r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, 3, 85, exact=exact).collect()} for exact in (False, True))
    sets = {i: set(near_dedup.shingle_hashes(t, 3).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in sets:
        for y in range(x):
            n = len(sets[x] & sets[y])
            if 100 * n >= 85 * (len(sets[x]) + len(sets[y]) - n):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    assert got == whole == {i: find(i) for i in sets}
