"""Plain versions for the tests."""


def components_of(ids, linked):
    """ids in any order; linked(i, j) -> bool. The smallest identifier reachable from each."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(ids)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}
