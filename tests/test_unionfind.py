from hypothesis import given
from hypothesis import strategies as st

from unionfind import SignedUnionFind


def of(n, signs=lambda k: False):
    u = SignedUnionFind()
    for k in range(n):
        u.add(signs(k))
    return u


def test_a_chain_of_sets():
    """Ten items in a chain of merges: a flip anywhere turns them all, and only them."""
    u = of(12, lambda k: k in (2, 3, 7))
    for k in range(9):
        u.merge(k + 1, k)
    assert [u.negative(k) for k in range(12)] == [k in (2, 3, 7) for k in range(12)] and len({u.representative(k) for k in range(12)}) == 3
    u.flip(6)
    assert [u.negative(k) for k in range(12)] == [(k in (2, 3, 7)) == (k > 9) for k in range(12)]


@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19), st.booleans()), max_size=60))
def test_against_plain_sets(steps):
    u = of(20, lambda k: k % 3 == 0)
    group, sign = list(range(20)), [k % 3 == 0 for k in range(20)]
    for a, b, flip in steps:
        if flip:
            u.flip(a)
            sign = [s != (g == group[a]) for s, g in zip(sign, group)]
        else:
            u.merge(a, b)
            group = [group[a] if g == group[b] else g for g in group]
    assert [u.negative(k) for k in range(20)] == sign
    assert all((u.representative(a) == u.representative(b)) == (group[a] == group[b]) for a in range(20) for b in range(20))
