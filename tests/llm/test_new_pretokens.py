"""How pre-tokens that a process has not met are encoded, and met ones are found again."""

import numpy as np
import pyarrow as pa

from saccadia.llm import arrays, packing, pretokens, tokenizer_files

TOKENIZER = "byte_bpe_50k.json"
ODD = " ab  cd\n ef 12 345 !! 's 'tis it's  x 　y  z 中文 éè é \U0001f600 <|endoftext|> <|endof text|> \x1c q"


def slices(texts):
    return next(arrays.texts(pa.array(texts), 1 << 30))


def ids_of(known, t, special):
    p = pretokens.pieces(t, pretokens.BYTE_LEVEL, special)
    entry = known.lookup(t, p)
    flat, starts, lengths = known.arrays()
    return flat[arrays.expand(starts[entry], lengths[entry])].tolist()


def test_new_pretokens_are_encoded_in_rows(monkeypatch):
    lib, asked = tokenizer_files.library(TOKENIZER), []

    class Watched:
        def encode_batch_fast(self, found, **options):
            asked.append(len(found))
            return lib.encode_batch_fast(found, **options)

        def get_vocab(self):
            return lib.get_vocab()

    texts = [ODD, "".join(f" zq{'xyzw'[k % 4]}{'abcdefgh'[k // 4 % 8]}{chr(97 + k // 32 % 26)}{chr(97 + k // 832)}" for k in range(3500)), ""]
    special = tokenizer_files.specials(TOKENIZER)
    want = [i for x in texts for i in lib.encode(x, add_special_tokens=False).ids]
    monkeypatch.setattr(tokenizer_files, "library", lambda name: Watched())
    got = ids_of(packing.vocabulary.__wrapped__(TOKENIZER), slices(texts), special)
    assert got == want
    assert sum(asked) < 100


def test_rows_that_ids_reach_over_are_encoded_one_by_one(monkeypatch):
    """If the bytes of the ids don't meet the ends of the pre-tokens, these are asked for by themselves."""
    lib = tokenizer_files.library(TOKENIZER)
    sizes = packing.token_bytes(TOKENIZER) + 1
    monkeypatch.setattr(packing, "token_bytes", lambda name: sizes)
    text = "one two three four " * 50
    got = ids_of(packing.vocabulary.__wrapped__(TOKENIZER), slices([text]), tokenizer_files.specials(TOKENIZER))
    assert got == lib.encode(text, add_special_tokens=False).ids


def test_met_pretokens_are_found_without_sorting(monkeypatch):
    known = pretokens.Vocabulary(lambda found: [list(x.encode()) for x in found], most=3000)
    rng = np.random.default_rng(3)
    for n in (10, 2000, 900, 2500, 2500):
        words = ["".join(map(chr, rng.integers(97, 123, 3))) for _ in range(n)]
        t = slices([" ".join(words)])
        assert ids_of(known, t, {}) == list(" ".join(words).encode())
    with monkeypatch.context() as m:
        m.setattr(np, "unique", None)
        m.setattr(np, "insert", None)
        assert ids_of(known, t, {}) == list(" ".join(words).encode())


def test_keys_at_one_place():
    known = pretokens.Vocabulary(None)
    keys = (np.arange(5000, dtype=np.uint64) << np.uint64(20)) + np.uint64(7)
    known._store(keys, np.arange(5000))
    assert known._find(keys).tolist() == list(range(5000))
    assert (known._find(keys + np.uint64(1)) == -1).all()
