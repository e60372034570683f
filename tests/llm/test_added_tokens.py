import zlib

import numpy as np
from tokenizers import Tokenizer

from depsight.llm import token_files as T
from depsight.llm.queries import tokenizer_path

from . import cases

PATH = tokenizer_path("byte_bpe_50k.json")


def test_added_tokens_get_the_ids_of_an_unmodified_tokenizer(spark):
    texts = ["x<|endoftext|>y", "<|endoftext|>", "plain words", "a <|endoftext|>\n\n b ☃", "<|endoftext|", "<|\nendoftext|>"]
    lib = Tokenizer.from_file(PATH)
    want = [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert 50256 in np.frombuffer(want[0], "<u4")
    assert T.Encoder.of(PATH)(texts) == want
    got = T.encode_round_trip(cases.frame(spark, list(enumerate(texts))), PATH).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in got} == {i: zlib.crc32(w + (2).to_bytes(4, "little")) for i, w in enumerate(want)}
