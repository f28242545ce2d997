"""Sequential kernels on graphs whose answers are known, and against plain re-derivations."""

import numpy as np

from quorra.functions.special import critical_r, pearson_p_value, t_p_value
from quorra.operators import kernels as K
from quorra.operators import voxel as V


def graph(n, pairs):
    out = np.zeros((n, n))
    for i, j, *w in pairs:
        out[i, j] = out[j, i] = w[0] if w else 1.0
    return out


TRIANGLE = graph(3, [(0, 1), (1, 2), (0, 2)])
PATH = graph(4, [(0, 1), (1, 2), (2, 3)])
STAR = graph(5, [(0, k) for k in range(1, 5)])
CLIQUES = graph(8, [(i, j) for b in (0, 4) for i in range(b, b + 4) for j in range(i + 1, b + 4)] + [(3, 4, 0.1)])


def test_paths_and_efficiency():
    assert K.efficiency(TRIANGLE) == 1
    assert K.shortest(PATH)[0, 3] == 3
    assert np.isclose(K.efficiency(PATH), 2 * (3 + 2 / 2 + 1 / 3) / 12)
    assert K.path_length(STAR) == (8 * 1 + 12 * 2) / 20
    assert K.path_length(np.zeros((3, 3))) == float("inf")
    assert K.efficiency(TRIANGLE, zero_absent=True) == 1
    assert K.efficiency(PATH, zero_absent=True) < K.efficiency(PATH)


def test_clustering_and_local_efficiency():
    assert np.isclose(K.clustering(TRIANGLE), 1)
    assert K.clustering(STAR) == 0
    assert K.local_efficiency(TRIANGLE).tolist() == [1, 1, 1]


def test_betweenness():
    assert K.betweenness(STAR).tolist() == [1, 0, 0, 0, 0]
    assert np.allclose(K.betweenness(PATH), [0, 4 / 6, 4 / 6, 0])
    square = graph(4, [(0, 1), (1, 2), (2, 3), (3, 0)])
    assert np.allclose(K.betweenness(square), 1 / 6)  # each opposite pair has two paths


def test_louvain_and_modularity():
    label = K.louvain(CLIQUES)
    assert len(set(label[:4])) == 1 and len(set(label[4:])) == 1 and label[0] != label[7]
    assert K.modularity(CLIQUES, label) > 0.4
    assert K.louvain(np.zeros((3, 3))).tolist() == [0, 1, 2]


def test_rewiring_keeps_degrees_and_weights():
    draw = np.random.default_rng(1)
    m = np.triu(draw.random((12, 12)) * (draw.random((12, 12)) < 0.4), 1)
    m += m.T
    out = K.rewire(m, 10, K.rng("x"))
    assert ((out > 0).sum(0) == (m > 0).sum(0)).all() and np.allclose(np.sort(out.ravel()), np.sort(m.ravel()))
    assert np.array_equal(out, out.T) and not np.array_equal(out, m)


def test_communicability_matches_series():
    a = CLIQUES / np.abs(np.linalg.eigvalsh(CLIQUES)).max()
    term, total = np.eye(8), np.eye(8)
    for k in range(1, 30):
        term = term @ a / k
        total = total + term
    assert np.allclose(K.communicability(CLIQUES), total)


def test_small_world_is_a_share():
    phi = K.small_world(CLIQUES, K.rng("s"), 3, 3)[0]
    assert 0 <= phi <= 1


def test_tfnbs_sign_and_components():
    t = graph(4, [(0, 1, 3.0), (1, 2, -2.0)])
    s = K.tfnbs_scores(t)
    assert s[0, 1] > 0 > s[1, 2] and s[2, 3] == 0
    assert K.components(np.array([[0, 1], [2, 3]]), 5).tolist() == [0, 0, 2, 2, 4]


def test_special_functions():
    assert abs(t_p_value(2.0, 10) - 0.07338803477) < 1e-9
    assert abs(pearson_p_value(critical_r(24, 0.01), 24) - 0.01) < 1e-9


def test_harmonics_are_orthonormal():
    y = V.harmonics(V.directions(4000), 4)
    assert y.shape[1] == 15 and np.allclose(y.T @ y * 4 * np.pi / 4000, np.eye(15), atol=5e-3)


def test_tensor_fit_recovers_a_tensor():
    bvals, bvecs = V.gradients(64)
    x = V.tensor_design(bvals, bvecs)
    beta = np.array([5, 1e-3, 5e-4, 3e-4, 1e-5, 0, 2e-5])
    assert np.allclose(np.linalg.pinv(x) @ (x @ beta), beta)
