"""Components of later links on top of those of earlier ones."""

import random

from gridloom.llm.components import components


def roots(df):
    rows = [(r.node, r.root) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def plain(links):
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(least)}


def test_known_components_are_extended(spark):
    draw = random.Random(5)
    made = lambda links: spark.createDataFrame(links, "a long, b long")
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(60)] + [(300 + i, 301 + i) for i in range(20)] + [(7, 7)]
    parts = [[(a, b) for a, b in links[i::3]] for i in range(3)]
    known = components(made(parts[0]))
    for part in parts[1:]:
        known = components(made(part), known)
    wanted = {x: r for x, r in plain([(a, b) for a, b in links if a != b]).items()}
    assert roots(known) == wanted
    assert roots(components(made(parts[0]), known)) == wanted
    assert roots(components(made([(5, 5)]))) == {}
    assert roots(components(made([(1, 2)]), components(made([(5, 5)])))) == {1: 1, 2: 1}
