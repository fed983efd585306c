import itertools

from veil.functions.small_graphs import euler_walk


def test_walks():
    assert euler_walk([], 3) == [3]
    assert euler_walk([(0, 1), (1, 2), (2, 0), (2, 3)], 3) is not None
    assert euler_walk([(0, 1), (2, 3)], 0) is None
    assert euler_walk([(0, 1), (0, 2), (0, 3)], 0) is None
    complete = list(itertools.combinations(range(7), 2))
    walk = euler_walk(complete, 0)
    assert walk[0] == walk[-1] == 0 and sorted(tuple(sorted(p)) for p in zip(walk, walk[1:])) == complete
