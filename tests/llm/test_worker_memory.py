"""What a Python process holds at once."""

from saccadia.llm import packing, tokenizer_files

TOKENIZER = "byte_bpe_50k.json"


def test_few_results_of_the_library_at_once(monkeypatch):
    lib, sizes = tokenizer_files.library(TOKENIZER), []

    class Watched:
        def encode_batch_fast(self, found, **options):
            sizes.append(len(found))
            return lib.encode_batch_fast(found, **options)

    monkeypatch.setattr(tokenizer_files, "library", lambda name: Watched())
    found = [f" zq{k}x" for k in range(3500)]
    got = packing.vocabulary.__wrapped__(TOKENIZER).encode(found)
    assert got == [e.ids for e in lib.encode_batch_fast(found, add_special_tokens=False)]
    assert max(sizes) <= packing.AT_ONCE


def test_special_strings_are_the_librarys():
    tokenizer_files.specials.cache_clear()
    tokenizer_files.contents.cache_clear()
    for name in (TOKENIZER, "word_bpe_49k.json"):
        special = tokenizer_files.specials(name)
        assert tokenizer_files.contents.cache_info().currsize == 0
        raw = tokenizer_files.contents.__wrapped__(name)
        assert special == {x["content"].encode(): x["id"] for x in raw["added_tokens"] if x["special"]}
