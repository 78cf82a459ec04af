"""Work of the piece encoder: what is sorted, and what is encoded again."""

import numpy as np
import public_tokenizers
import sentencepiece

from kbspark.llm import pieces

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def test_a_full_cache_keeps_the_units_of_the_batch(monkeypatch):
    monkeypatch.setattr(pieces, "_CACHE", 3)
    encoder, asked, real = pieces.Encoder(pieces.model(public_tokenizers.path(pieces.MODEL))), [], pieces.encode_units
    monkeypatch.setattr(pieces, "encode_units", lambda own, units: asked.append(units) or real(own, units))
    texts = ["some words  of one text", " 日本 x​ y" + "z" * 60, "", "x", "def ab​def ", "▁a▁▁b", "   "]
    for _ in range(2):
        got = [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(texts)]
        assert got == [SP.encode(t) for t in texts]
    assert len(asked) == 2 and len(asked[0]) > 12 and len(asked[1]) == 1  # the long word is never kept


def test_suffixes_are_sorted_up_to_the_end_of_their_unit():
    rng = np.random.default_rng(2)
    letters = rng.integers(1, 3, 4000)
    letters[rng.random(4000) < 0.1] = 0
    order, key = pieces.suffix_array(letters, 2, 3, 10)
    assert sorted(order.tolist()) == list(range(4000))

    def own(at):
        part = letters[at:at + 10].tolist()
        return part[:part.index(0)] if 0 in part else part

    found = [own(at) for at in order.tolist()]
    assert found == sorted(found)
    assert key[:4000].tolist() == [sum(int(x) << 2 * (2 - k) for k, x in enumerate([*letters[at:at + 3], 0, 0][:3])) for at in range(4000)]
