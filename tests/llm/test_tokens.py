import public_tokenizers
import pytest
from helpers import ODD, nothing, odd
from tokenizers import Tokenizer

from shipmeter.llm import segbpe, tokencount
from shipmeter.llm.pretokens import disputed

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", " ", "\n\n  a", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c<|endoftext|><|endoftext|>", "<|endoftext",
    "ΣΑΣ İx ẞ don't I'LL 123's", "x" * 3000, "ab" * 2000 + " " * 300, "th" * 400, "é᫊᫏̖",
    "áë ꟎ ࢏\U00011de0 \U0001f600日本語", "\u0085  　x​y", "क़Åẛ̣",
    *[t for _, t, *_ in ODD if t],
]


def real(spark, sf_dir):
    return [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


def test_counts_equal_the_library(spark, sf_dir):
    with open(BYTES, encoding="utf-8") as f:
        raw = f.read()
    library = Tokenizer.from_str(raw)
    counter = tokencount.Counter(raw, tokencount.prove(raw))
    for text in HARD + real(spark, sf_dir):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:60]


def test_proven_strings_are_single_tokens():
    with open(BYTES, encoding="utf-8") as f:
        raw = f.read()
    library, proven = Tokenizer.from_str(raw), tokencount.prove(raw)
    assert len(proven) > 45_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(sorted(proven), add_special_tokens=False))


def test_long_merges_equal_short_ones():
    ranks = {("a", "b"): 0, ("ab", "a"): 1, ("ab", "ab"): 2, ("b", "a"): 3, ("aba", "b"): 4}
    for n in (2, 3, 10, 24, 25, 40, 101):
        symbols = list(("abba" * n)[:n])
        short = list(symbols)
        while True:
            best = min(((ranks.get(p, 99), i) for i, p in enumerate(zip(short, short[1:]))), default=(99, 0))
            if best[0] == 99:
                break
            short[best[1] : best[1] + 2] = [short[best[1]] + short[best[1] + 1]]
        assert tokencount.merge_count(symbols, ranks) == len(short)


def test_ids_and_decoded_text_equal_the_library(spark, sf_dir):
    with open(WORDS, encoding="utf-8") as f:
        raw = f.read()
    library, codec = Tokenizer.from_str(raw), segbpe.Codec(raw)
    texts = HARD + real(spark, sf_dir)
    for text, ids in zip(texts, codec.encode_all(texts)):
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:60]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("n", [2, 3, 17, 63, 64, 65, 300])
def test_tree_of_its_own_equals_trees_in_a_table(n):
    with open(WORDS, encoding="utf-8") as f:
        merges = segbpe.Merges(f.read())
    symbols = merges.symbols(("thereinantionthhe" * 30)[:n])
    library = Tokenizer.from_file(WORDS).encode(("thereinantionthhe" * 30)[:n], add_special_tokens=False).ids
    assert segbpe.merge_long(symbols, merges) == library
    if n <= segbpe.WIDE:
        assert segbpe.merge_many([symbols], merges) == [library]


def test_disputed_characters_are_few_and_late():
    assert not disputed().search("".join(map(chr, range(0x558))))


def test_odd_rows(spark):
    library = Tokenizer.from_file(BYTES)
    got = tokencount.count_tokens(odd(spark), BYTES).collect()
    assert len(got) == len(ODD) and got[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens"}
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for _, t, *_ in ODD)
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    coded = segbpe.encode_decode(odd(spark), WORDS).collect()
    assert len(coded) == len(ODD) and all(r.ids == [] and r.decoded == "" for r in coded if r.doc_id in (1, 2, 3, 11))


def test_empty_table(spark):
    assert tokencount.count_tokens(nothing(spark), BYTES).count() == 0
    assert segbpe.encode_decode(nothing(spark), WORDS).count() == 0
