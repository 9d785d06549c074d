"""Token counts and SentencePiece codec against the libraries, on odd texts and tables."""

import hashlib
import json
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilspark.llm import sentencepiece_codec as sp
from veilspark.llm.queries import PIECE_MODEL, WORD_VOCABULARY
from veilspark.llm.token_count import WordBpe, token_counts

ODD = [
    None, "", " ", "  lead", "a\nb  c <s> é𝒳 ▁x <|endoftext|> x<|startoftext|>", "a" * 9000, "ΑΣ ΟΔΥΣΣΕΥΣ. İstanbul ǅ \x85 á ﬁ don't we'll 12345 ½", "日本語テキスト 🙂🙂🙂", "\t\t\n\r\n",
    "\u0000x", "the " * 4000, "<0x41></s>", "in" * 3000, "     " * 50 + "x", "abababab" * 500, "the same", "the same",
]


def noise(seed, n=150):
    r = random.Random(seed)
    return ["".join(r.choice("aeth in ▁\n.é🙂<>s/") for _ in range(r.randint(1, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int, over_limit string")


def test_counts_are_the_librarys(spark, docs):
    tok = Tokenizer.from_file(WORD_VOCABULARY)
    out = {r.doc_id: r for r in token_counts(docs, WORD_VOCABULARY, limit=100).collect()}
    for i, t in enumerate(ODD):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (out[i].n_tokens, out[i].n_bytes, out[i].over_limit) == (n, len((t or "").encode()), n > 100), t
    counter = WordBpe(open(WORD_VOCABULARY, "rb").read())
    counter.cache.most = 50  # generations come and go
    texts = noise(1)
    for k in range(0, len(texts), 10):
        assert counter.count(texts[k : k + 10]) == [len(e.ids) for e in tok.encode_batch(texts[k : k + 10], add_special_tokens=False)]


def test_every_letter_is_the_librarys():
    """All code points but surrogates, private use and the regular ranges of Hangul and the later ideographs."""
    tok, counter = Tokenizer.from_file(WORD_VOCABULARY), WordBpe(open(WORD_VOCABULARY, "rb").read())
    points = [*range(0xAC01), *range(0xD7A4, 0xD800), *range(0xF900, 0x20001), *range(0xE0000, 0xE0200)]
    for k in range(0, len(points), 20_000):
        texts = [f"a{chr(c)} {chr(c)}b" for c in points[k : k + 20_000]]
        assert counter.count(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_codec_is_the_librarys(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    out = {r.doc_id: r for r in sp.encode(docs, PIECE_MODEL).collect()}
    hashed = {r.doc_id: r for r in sp.encode(docs, PIECE_MODEL, digests=True).collect()}
    back = {r.doc_id: r.again for r in sp.decode(sp.encode(docs, PIECE_MODEL), PIECE_MODEL, out="again").collect()}
    for i, t in enumerate(ODD):
        ids = lib.encode(t or "", add_eos=True)
        assert out[i].ids == ids and out[i].n_tokens == len(ids) and out[i].decoded == lib.decode(ids) == back[i]
        assert hashed[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert hashed[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    codec = sp.PieceBpe(open(PIECE_MODEL, "rb").read(), decimal=True)
    codec.cache.most = 50
    for t in noise(2):
        assert codec.encode(t) == lib.encode(t, add_eos=True)
        ((spelled, n, _),) = codec.encoded([t])
        assert [*map(int, spelled.split())] == lib.encode(t) and n == len(lib.encode(t))
    r = random.Random(3)
    for _ in range(300):
        ids = [r.choice([r.randint(3, 300), r.randint(259, 31_999)]) for _ in range(r.randint(0, 12))]
        assert codec.decode(ids) == lib.decode(ids), ids


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        sp.PieceBpe(b"\x0a\x05\x0a\x03<s>")
    spec = json.load(open(WORD_VOCABULARY))
    odd = [
        {"model": spec["model"] | {"byte_fallback": True}}, {"model": spec["model"] | {"ignore_merges": True}}, {"model": spec["model"] | {"type": "Unigram"}}, {"model": spec["model"] | {"end_of_word_suffix": None}},
        {"normalizer": None}, {"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]},
    ]
    for change in odd:
        with pytest.raises(ValueError):
            WordBpe(json.dumps(spec | change).encode())


def test_long_texts_without_spaces():
    """Places merge together wherever that is what one at a time would give."""
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL), sp.PieceBpe(open(PIECE_MODEL, "rb").read())
    r = random.Random(4)
    pieces = [p for p in codec.ids if len(p) > 1]
    texts = ["".join(r.choice("etaoinshrdlu") for _ in range(n)) for n in (50, 3000, 20_000)]
    texts += ["".join(r.choice(pieces) for _ in range(n)).replace("▁", "") for n in (20, 400, 2000)]
    for period in (1, 2, 3, 5, 8, 13):
        texts.append(("".join(r.choice("abcdeinrst") for _ in range(period)) * 4000)[:4000])
    for t in texts:
        assert codec.encode(t) == lib.encode(t, add_eos=True)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert token_counts(none, WORD_VOCABULARY).count() == 0 and sp.encode(none, PIECE_MODEL).count() == 0


def test_paths_are_parameters():
    assert public_tokenizers.path("word_bpe_49k.json") == WORD_VOCABULARY
