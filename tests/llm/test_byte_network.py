"""The byte network against loops over places and filters, and its gradients against differences."""

import math

import numpy as np
import pytest

from scorewright.llm import langid as L


def network(seed: int = 3) -> L.ByteCNN:
    net = L.ByteCNN(["a", "b", "c"], seed)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(seed)
    for w in L.WIDTHS:
        net.p[f"b{w}"] = rng.normal(0, 0.1, L.FILTERS)
    net.p["bias"] = rng.normal(0, 0.1, 3)
    return net


def plain(net: L.ByteCNN, window: list[int]) -> list[float]:
    """One window, place by place."""
    p, pooled = net.p, []
    for w in L.WIDTHS:
        for f in range(L.FILTERS):
            best = -math.inf
            for at in range(len(window) - w + 1):
                value = sum(p["emb"][window[at + i]][e] * p[f"w{w}"][i * L.EMBED + e][f] for i in range(w) for e in range(L.EMBED))
                best = max(best, value)
            pooled.append(max(0.0, best + p[f"b{w}"][f]))
    z = [sum(x * p["out"][i][c] for i, x in enumerate(pooled)) + p["bias"][c] for c in range(3)]
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def test_forward_pass_place_by_place():
    net, rng = network(), np.random.default_rng(5)
    windows = rng.integers(0, 256, (6, 20)).astype(np.uint8)
    assert net.probabilities(windows) == pytest.approx(np.array([plain(net, w.tolist()) for w in windows]))


def test_tables_give_the_forward_pass():
    net, rng = network(), np.random.default_rng(9)
    for size in (max(L.WIDTHS), 20, L.WINDOW):
        windows = rng.integers(0, 256, (7, size)).astype(np.uint8)
        assert net.looked_up(windows, net.tables()) == pytest.approx(net.probabilities(windows))


def test_gradients_against_differences():
    net, rng = network(8), np.random.default_rng(6)
    windows, y = rng.integers(0, 40, (5, 15)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(5), y]).mean()
    told, step = net._gradients(windows, y), 1e-6
    for name, g in told.items():
        flat, size = net.p[name].reshape(-1), net.p[name].size
        picks = rng.choice(size, min(size, 60), replace=False)
        used = [i for i in picks if name != "emb" or i // L.EMBED in set(windows.ravel().tolist())]
        for i in used:
            was = flat[i]
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert g.reshape(-1)[i] == pytest.approx((up - down) / (2 * step), abs=1e-7), (name, i)


def test_text_scores_are_means_over_its_windows():
    data = np.frombuffer(b"x" * 250 + b"yz", np.uint8)
    windows, doc = L.cut_windows(data, np.array([0, 250, 250, 252]))
    assert doc.tolist() == [0, 0, 0, 2] and windows.shape == (4, L.WINDOW)
    assert bytes(windows[2]).rstrip(b"\0") == b"x" * (250 - 2 * L.WINDOW) and bytes(windows[3]).rstrip(b"\0") == b"yz"
