"""Words walked together: shared beginnings are walked once, ids stay those of the library and of the streaming walk."""

from __future__ import annotations

import random

import numpy as np

from parley.llm import sentencepiece_viterbi as viterbi
from parley.llm.tokens import public_path


def _words(seed: int, n: int) -> list[str]:
    """Words of pieces, and of characters with and without a piece."""
    rng = random.Random(seed)
    pieces = [p for p, _, _ in viterbi.encoder(public_path("piece_bpe_32k.model")).model.pieces]
    words = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    return words + ["".join(rng.choice("aehtinoé中.,ñ🙂\x07") for _ in range(rng.randint(1, 70))) for _ in range(n)]


def test_shared_beginnings_are_walked_once():
    model, found = viterbi.encoder(public_path("piece_bpe_32k.model")).model, {}
    words = ["thein" + "entionon"[:k] for k in range(9)] + ["the", "und"]
    assert viterbi.walk_sorted(model, words, found) == len("theinentionon") + len("und")
    words = [w for w in _words(5, 2000) if len(w) <= 40]
    viterbi.walk_sorted(model, words, found)
    for word in words:
        ids: list[int] = []
        viterbi.viterbi(model, word, lambda piece: ids.extend(viterbi._spell(model, piece)))
        assert np.frombuffer(found[word], np.uint32).tolist() == ids


def test_groups_and_full_caches_change_nothing(monkeypatch):
    import sentencepiece

    path, rng, words = public_path("piece_bpe_32k.model"), random.Random(6), _words(7, 300)
    texts = [None, "", " "] + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(200)]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(viterbi, "GROUP", 500)
    monkeypatch.setattr(viterbi, "CACHE_PARTS", 100)
    own = viterbi.Encoder(path)
    found = list(own.encode_all(texts))
    assert [np.frombuffer(i, np.uint32).tolist() for i in found] == [library.encode(t or "") for t in texts]
    assert len(own.parts) <= 2 * 100 and len(own.model.joint) <= 101 + 1
