import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from penmark.llm import encoding

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "é", "ß", "don't", "'s", "'", "''", "it's", "we'll", "they've", "'re", "  ", " ", "\n", "\t", "\r\n", "1", "23", "½", "²", ".", ",", "—",
    "\u0085", "\xa0", "\x1c", "\x0b", "中文", "😀", "<|endoftext|>", "x", "I'm", "d'accord", "!", "?! ", "Ā", "ɐ", "ɏ", "\x00", "\x7f", "_", "'ll", "'l",
    "'v", "'r", "re", "٣", "word ", " word", "S'S",
]


def test_ids_are_those_of_the_tokenizer():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)] + [None, "", "a", "b " * 70_000]
    rnd.shuffle(texts)
    tokenizer = Tokenizer.from_file(PATH)
    for part in (pa.array(texts), pa.array(["skipped", *texts])[1:]):
        ids, n = encoding.encode(PATH, part)
        assert ids.dtype == np.uint16 and len(n) == len(texts)
        at = np.r_[0, np.cumsum(n)]
        for i, x in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(x or "", add_special_tokens=False).ids, x


def test_empty_columns():
    for texts in (pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        ids, n = encoding.encode(PATH, texts)
        assert len(ids) == 0 and n.tolist() == [0] * len(texts)
