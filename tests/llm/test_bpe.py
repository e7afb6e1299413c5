import hashlib
import random

import numpy as np
import pytest

from orrery.llm import bpe
from orrery.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = tokenizer_path()
    return bpe.Bpe(bpe.read_tokenizer(path)), tokenizers.Tokenizer.from_file(path)


def texts():
    rng = random.Random(2)
    odd = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "don't WE'LL i'd", "\t\t\n\n  \n x", "՘a 1", "a\x1c\x85\xa0b", "👩‍👩‍👧 😀", "٣٤ ½ ²"]
    odd += ["".join(rng.choice("aabcthe in<|>\n é😀1ａ̈") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    odd += ["".join(chr(rng.choice([rng.randint(0, 0x250), rng.randint(0, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(300)]
    return [*odd, "ab" * 30000, "".join(rng.choice("etaoin shrdlu") for _ in range(60000))]


def test_ids_and_texts_equal_the_library(both):
    own, library = both
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_decode_of_any_ids(both):
    own, library = both
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 20))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_table_and_round_trip(spark, both):
    _, library = both
    rows = [(n, t, "own") for n, t in enumerate(texts()[:200])] + [(None, None, "own"), (3, "again", "own"), (3, "again", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    table = bpe.encode_table(spark, docs, tokenizer_path())
    back = bpe.decode_table(spark, table, tokenizer_path()).collect()
    assert len(back) == len(rows)
    for r in back:
        text = r["text"] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(ids), ids, text)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_table(spark, docs.limit(0), tokenizer_path()).count() == 0


def test_other_kinds_of_tokenizers_are_refused():
    import json

    config = json.loads(bpe.read_tokenizer(tokenizer_path()))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": config["model"] | {"byte_fallback": True}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Bpe(json.dumps(config | change))
