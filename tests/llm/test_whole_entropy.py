import numpy as np

from attestor.llm import quality_rules


def test_entropy_counts_the_last_tokens():
    good = np.arange(256, dtype=np.int32)
    junk = np.full(255, 7, np.int32)
    assert quality_rules.window_entropy(good) > 0.999
    assert quality_rules.window_entropy(np.concatenate([good, junk])) < 0.6
    assert quality_rules.window_entropy(np.concatenate([good, good])) > 0.999
