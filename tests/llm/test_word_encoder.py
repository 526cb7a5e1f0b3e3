"""The cache of encoded words against the library itself."""

import random

from lodestone.llm.id_files import WordEncoder
from lodestone.llm.token_counts import load


def test_small_cache_gives_the_library_ids():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijk", k=rng.randint(1, 6))) for _ in range(400)]
    batches = [[" ".join(rng.choices(vocabulary, k=40)) for _ in range(3)] for _ in range(60)]
    encoder = WordEncoder(load("word_bpe_49k.json"), "<u2", room=300)
    assert encoder.by_word
    moved = 0
    for batch in batches:
        split = set().union(*map(encoder.words, batch))
        older = {w for w in split - encoder.known.keys() if w in encoder.before}
        assert encoder(batch) == encoder.direct(batch)
        moved += len(older)
    assert moved > 0 and encoder.before  # the older generation was in use
