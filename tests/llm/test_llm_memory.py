"""What a Python worker takes while it encodes and hashes, and keeps afterwards."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tributary.llm import packing, text
from tributary.llm.queries import tokenizer_path
from tributary.llm.token_counts import load


def test_hashing_takes_and_keeps_little():
    data = np.random.default_rng(0).integers(0, 256, 4 << 20).astype(np.uint8)
    starts = np.arange(0, len(data) - 8, 1000)
    text.memo("powers").clear()
    assert len(text.range_hashes(data[:0], starts[:0], starts[:0])) == 0
    tracemalloc.start()
    try:
        whole = text.range_hashes(data, starts, starts + 8)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 3 * 8 * len(data) and kept < 3 * 8 * text.KEPT_POWERS
    assert (whole == [text.range_hashes(data[a : a + 8], np.array([0]), np.array([8]))[0] for a in starts.tolist()]).all()


def test_the_library_is_given_few_pieces_at_once():
    definition, digest, _ = load(tokenizer_path("word_bpe_49k.json"))
    encoder = packing.Encoder(definition, f"{digest}-memory")
    library, given = encoder.tokenizer, []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            given.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Watched()
    texts = [" ".join(f"w{i}x{k}" for k in range(997)) for i in range(13)] + ["", "w1x1 w2x2"]
    ids, bounds = encoder.encode(pa.array(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert max(given) <= packing.GIVEN and sum(given) > 2 * packing.GIVEN
    assert max(packing.ENCODED_BYTES, text.SLICE_BYTES) <= 2 << 20
