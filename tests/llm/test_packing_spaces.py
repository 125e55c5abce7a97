"""Characters that str.split() takes for white space and the tokenizer does not keep their ids."""

import sys

import numpy as np
from spanloom.llm import packing


def test_every_space_round_trips():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.word_encoder(packing.tokenizer_path())
    spaces = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]
    for c in [*spaces, "​", "﻿", "᠎"]:
        for t in (f"a{c}b", f"a {c} b", f"{c}", f" {c}x.{c} ", f"\x1e a{c}\n{c} Bc, \x1f"):
            assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, ascii(t)
