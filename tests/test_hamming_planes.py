import numpy as np

from strandline.operators.hamming import _distances


def test_distances_by_bit_planes_are_those_of_letters():
    rnd = np.random.default_rng(5)
    for letters, length in ((1, 64), (2, 63), (5, 100), (11, 130), (4, 0)):
        bits = max(1, (letters - 1).bit_length())
        window, w_len = rnd.integers(0, letters, (40, 190)).astype(np.uint8), rnd.integers(0, 191, 40)
        read = rnd.integers(0, letters, (40, length)).astype(np.uint8)
        (best, at), (again, _) = _distances(window, w_len, [read, read], bits)
        for i in range(40):
            d = [int((window[i, s : s + length] != read[i]).sum()) for s in range(int(w_len[i]) - length + 1)]
            assert best[i] == again[i] and (best[i] > length if not d else (best[i], at[i]) == (min(d), d.index(min(d))))
