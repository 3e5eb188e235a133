"""What Python workers keep between tasks."""

from __future__ import annotations

from tocsin.llm import shared


def test_known_chunks_are_looked_up_once_where_others_are_new(monkeypatch):
    class Counted(shared.Known):
        looked_up = 0

        def __getitem__(self, chunk):
            Counted.looked_up += 1
            return super().__getitem__(chunk)

    monkeypatch.setattr(shared, "Known", Counted)
    chunks = shared.Chunks(lambda new: {c: c.upper().encode() for c in new})
    known = [f"k{i}" for i in range(100)]
    chunks.joined([known])
    Counted.looked_up = 0
    assert chunks.joined([[*known[:50], "x", *known[50:], "y", "x"]])[0] == "".join([*known[:50], "x", *known[50:], "y", "x"]).upper().encode()
    assert Counted.looked_up <= 103 + 3


def test_worker_keeps_one_operators_state():
    first = shared.kept_by("one")
    first["cache"] = [0]
    assert shared.kept_by("one") is first
    assert shared.kept_by("two") == {}
    assert shared.kept_by("one") == {}


def test_symbols_behind_a_word_are_parted_from_it():
    encoder = shared.TextEncoder(shared.tokenizer_path("byte_bpe_50k.json"), False, True)
    texts = ["word$$$ word%%% word, word&*# $word word's wörd.## a#b <|endoftext|> x$"]
    plain = encoder.tokenizer
    found = encoder.ids(texts)
    plain.encode_special_tokens = False
    assert found == encoder.encode(texts)
    assert "word" in encoder.stems or not encoder.stems  # texts with a marker go whole
    assert encoder.ids(["word$$$ word%%% Straße&&"]) == encoder.encode(["word$$$ word%%% Straße&&"])
    assert {"$$$", "%%%", "&&"} & set(encoder.tails)
