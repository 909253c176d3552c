"""Near duplicates where one list holds many close copies and many that are nearly so."""

import random

from quire.llm import near_dedup


def test_crowded_lists_are_joined_on_rare_shingles(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]

    def changed(n):
        words = base[:]
        for i in rng.sample(range(100), n):
            words[i] = f"x{rng.randrange(10_000)}"
        return " ".join(words)

    # linked with the base; too far from all for a link, too near for a sketch; just about linked
    rows = [(i, changed(n)) for i, n in enumerate([0] + [1] * 200 + [8] * 80 + [5, 6] * 10)]
    sets = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} for i, w in ((i, t.split()) for i, t in rows)}
    best = {i: i for i in sets}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for a in sets:
        for b in range(a + 1, len(rows)):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                best[y] = x
    counts, write = [], near_dedup.written

    def counted(df, name):
        made = write(df, name)
        if name == "dedup-candidates":
            counts.append(made.count())
        return made

    monkeypatch.setattr(near_dedup, "written", counted)
    found = near_dedup.judged(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, percent=80).collect()
    assert {r["_id"]: r["component_id"] for r in found} == {i: root(i) for i in sets}
    assert max(counts) < 20 * len(rows)  # star pairs and lists that are not crowded


def test_counts_of_shingles_are_sent_and_not_joined(spark, monkeypatch):
    """The classes of crowded lists go with their sets, a row each, and only the rarest shingles are posted;
    how many counts are sent changes neither links nor components."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]

    def changed(n):
        words = base[:]
        for i in rng.sample(range(100), n):
            words[i] = f"x{rng.randrange(300)}"
        return " ".join(words)

    rows = [(i, changed(n)) for i, n in enumerate([0] + [1] * 150 + [8] * 60 + [5, 6] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    write, found = near_dedup.written, []
    for frequent in (500_000, 40):
        counts = {}

        def counted(df, name, counts=counts):
            made = write(df, name)
            if name in ("dedup-shingles", "dedup-shared"):
                counts[name] = max(counts.get(name, 0), made.count())
            return made

        monkeypatch.setattr(near_dedup, "written", counted)
        monkeypatch.setattr(near_dedup, "FREQUENT", frequent, raising=False)
        found.append({r["_id"]: r["component_id"] for r in near_dedup.judged(docs, shingle=2, percent=80).collect()})
        assert counts["dedup-shingles"] <= len(rows)  # a class each, not a shingle each
        assert counts["dedup-shared"] <= 22 * len(rows)  # 99 shingles: a link must meet in the first 20
    sets = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} for i, w in ((i, t.split()) for i, t in rows)}
    best = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if best[a] < best[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    best[b], moved = best[a], True
    assert found[0] == found[1] == best
