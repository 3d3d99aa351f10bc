import numpy as np
import pytest

from rcspark.llm.elias_fano import EliasFano, Trie, quantise


@pytest.mark.parametrize("seed", range(6))
def test_get_and_successor_against_numpy(tmp_path, seed):
    rng = np.random.default_rng(seed)
    kinds = [rng.integers(0, 50, 200), rng.integers(0, 1 << 61, 500), np.concatenate([np.arange(3000), rng.integers(0, 1 << 61, 300)]), np.array([7]), np.array([], np.int64), np.zeros(9, np.int64)]
    values = np.sort(kinds[seed]).astype(np.uint64)
    EliasFano.build(values).save(tmp_path / "x")
    ef = EliasFano.load(tmp_path / "x")
    if len(values):
        assert (ef.get(np.arange(len(values))) == values).all()
    ask = np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << 61, 50).astype(np.uint64), np.zeros(1, np.uint64)])
    at, equal = ef.successor(ask)
    assert (at == np.searchsorted(values, ask)).all()
    assert (equal == np.isin(ask, values)).all()


def test_trie_finds_what_it_was_built_from(tmp_path):
    contexts, words = np.array([1, 5, 900]), np.array([2, 3, 1 << 60])
    c_at, w_at = np.array([0, 0, 2]), np.array([0, 2, 1])
    trie = Trie.build(contexts, words, c_at, w_at, np.array([-1.0, -2.0, -3.0]), np.array([-0.5, -0.25, -0.75]))
    trie.save(tmp_path)
    trie = Trie.load(tmp_path)
    ask = [(1, 2, -1.0), (1, 1 << 60, -2.0), (900, 3, -3.0), (1, 3, -0.5 - 9), (5, 2, -0.25 - 9), (4, 2, -9.0), (900, 7, -0.75 - 9)]
    got = trie.score(np.array([a for a, _, _ in ask]), np.array([b for _, b, _ in ask]), np.full(len(ask), -9.0))
    assert np.allclose(got, [x for _, _, x in ask], atol=0.005)


def test_quantise_is_within_half_a_step():
    x = np.random.default_rng(0).normal(size=1000)
    codes, low, step = quantise(x)
    assert np.abs(low + step * codes - x).max() <= step / 2 + 1e-12
