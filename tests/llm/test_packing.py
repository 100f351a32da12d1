import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparkloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_the_tokenizer(odd):
    texts = [r.text or "" for r in odd.collect()]
    texts += ["İstanbul's Σας", "a\x1cb\x85c\xa0d", "don't 'tis ½²3 4.5!!'s", "<|endoftext|> x", "ﬁ é 'S"]
    own, known = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    for text in texts * 2:
        ids = known.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == np.array(ids, "<u4").tobytes()


def test_hilbert_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    assert np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1).max() == 1


def test_pieces_tile_documents_and_sequences(odd):
    capacity = 256
    pieces = packing.pack(odd, PATH, capacity).collect()
    known = Tokenizer.from_file(PATH)
    expected = sorted((-1 if r.doc_id is None else r.doc_id, (*known.encode(r.text or "", add_special_tokens=False).ids, 2)) for r in odd.collect())
    sequences, stream = {}, []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert sequences.get(p.sequence_id, 0) == p.offset
        sequences[p.sequence_id] = p.offset + p.length
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        if p.start == 0:
            stream.append([-1 if p.doc_id is None else p.doc_id, [], p.doc_tokens])
        assert stream[-1][0] == (-1 if p.doc_id is None else p.doc_id) and len(stream[-1][1]) == p.start
        stream[-1][1].extend(np.frombuffer(p.ids, "<u4").tolist())
    assert sorted((d, tuple(ids)) for d, ids, _ in stream) == expected
    assert all(len(ids) == n for _, ids, n in stream)
    assert sorted(sequences.values())[1:] == [capacity] * (len(sequences) - 1)


def test_packing_of_nothing(none):
    assert packing.pack(none, PATH).count() == 0


def test_encoder_forgets_words_and_asks_for_each_once(monkeypatch):
    """Words go when others have come, those in use stay, and the ids are the tokenizer's all the same."""
    monkeypatch.setattr(packing, "WORDS_KEPT", 60)
    monkeypatch.setattr(packing, "BLOCK", 300)
    texts = [f"the wörd{k}, of tail{chr(97 + k % 26)}{chr(97 + k // 26)} and don't über" for k in range(300)]
    own, known, asked = packing.Encoder(PATH), Tokenizer.from_file(PATH), []
    plain = own.plain
    monkeypatch.setattr(own, "plain", lambda text: asked.append(text) or plain(text))
    for at in range(0, 300, 100):
        for text, ids in zip(texts[at : at + 100], own.encode_all(texts[at : at + 100]), strict=True):
            assert ids == np.array(known.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(own.known) + len(own.older) < 300
    assert " ".join(asked).split().count("über") == 1 and len(asked) < 100
