import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import jaccard, shingles


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_batch_of_texts_is_hashed_in_small_parts():
    texts = pa.array([f"word{k % 97} and other{k % 31} " * 100 for k in range(2000)])  # 4 MB
    assert peak_mb(lambda: [h.sum() for h in shingles.shingles(texts, 5)]) < 80


def test_parts_do_not_show_in_the_hashes(monkeypatch):
    texts = pa.array(["", "a b c d e f " * 50, None, "one", "x y z " * 400] * 3)
    texts = texts.fill_null("")
    whole = [h.tolist() for h in shingles.shingles(texts, 5)]
    monkeypatch.setattr(shingles, "SHINGLE_BYTES", 100)
    assert [h.tolist() for h in shingles.shingles(texts, 5)] == whole


def test_pairs_of_a_full_block_are_compared_in_pieces(monkeypatch):
    dice = np.random.default_rng(5)
    sigs = np.tile(dice.integers(0, 2**32, jaccard.HASHES, dtype=np.uint32), (1000, 1))
    sigs[dice.random(sigs.shape) < 0.02] = 7
    sigs[:, : jaccard.BAND] = 1
    side, least = np.zeros(len(sigs), dtype=np.int32), jaccard.least_matches(0.8, 1e-7)
    found = []
    assert peak_mb(lambda: found.append(jaccard.likely_pairs(sigs, side, 0, least))) < 60
    monkeypatch.setattr(jaccard, "PAIRS", 1 << 30)
    assert all((x == y).all() for x, y in zip(found[0], jaccard.likely_pairs(sigs, side, 0, least)))
